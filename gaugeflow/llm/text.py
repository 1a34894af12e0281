"""Post texts: words without markup, and the paragraphs that are the author's own."""

from __future__ import annotations

import html
import re

_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
#: Tags that end a line; other tags may stand inside a word.
_BREAK = re.compile(r"</?(?:br|p|div|li|ul|ol|tr|td|table|blockquote|cite|h\d|hr|pre)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-z][^<>]*>|<!--.*?-->", re.I | re.S)
_CODE = re.compile(r"\[/?[a-z*]+(?:=[^\[\]]*)?\]", re.I)
_IMAGE = re.compile(r"\[img\][^\[\]]*\[/img\]", re.I)
_WORD = re.compile(r"[^\W_]+")

#: Pairs of marks of a quotation; the innermost is removed first.
_QUOTES = [
    re.compile(r"\[quote(?:=[^\[\]]*)?\](?:(?!\[quote).)*?\[/quote\]", re.I | re.S),
    re.compile(r"<blockquote[^<>]*>(?:(?!<blockquote).)*?</blockquote>", re.I | re.S),
]
#: Line that names the author of the quotation below it, in English, German and Spanish.
_SAID = re.compile(r"^.{0,80}\b(?:wrote|said|writes|schrieb|schreibt|escribió|dijo)\s*:\s*$", re.I)
_SIGNATURE = re.compile(r"^\s*(?:(?:--+|~~+|__+|—+|–+)(?:\s.{0,60})?\s*$|\[size=[12]\])", re.I)
_MARKER = re.compile(r"^\s*(?:>|\|\s|»)")
_TWO_BREAKS = re.compile(r"(?:<br\s*/?\s*>\s*){2,}", re.I)
#: A single break ends a line only before a mark that stands at the start of lines.
_MARK_BREAK = re.compile(r"<br\s*/?\s*>\s*(?=>|--|~~|__|\[size=)", re.I)
#: UTF-8 read as Windows-1252: a lead byte and its followers.
_MOJIBAKE = re.compile("[Â-ô][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]{1,3}")


def _mended(match: re.Match) -> str:
    try:
        return match[0].encode("cp1252").decode("utf-8")
    except UnicodeError:
        return match[0]


def mend(text: str) -> str:
    """The text with broken encoding repaired and entities decoded."""
    return html.unescape(_MOJIBAKE.sub(_mended, text))


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, case apart, after decoding entities and removing tags, bracket codes and
    invisible characters. None has no words."""
    if not text:
        return []
    text = _INVISIBLE.sub("", html.unescape(text))
    if "<" in text:
        text = _TAG.sub("", _BREAK.sub(" ", text))
    if "[" in text:
        text = _CODE.sub("", _IMAGE.sub(" ", text))
    return _WORD.findall(text.casefold())


def own_paragraphs(text: str | None) -> list[str]:
    """Paragraphs that the author wrote: no quotations, names of the quoted, signatures or markup."""
    if not text:
        return []
    text = _INVISIBLE.sub("", mend(text)).replace("\r\n", "\n").replace(" ", " ")
    for mark in _QUOTES:
        n = 1
        while n:
            text, n = mark.subn("\n\n", text)
    text = re.sub(r"</?(?:p|div|blockquote|ul|ol|table)\b[^<>]*>", "\n\n", text, flags=re.I)
    text = _MARK_BREAK.sub("\n", _TWO_BREAKS.sub("\n\n", text))
    text = _TAG.sub("", _BREAK.sub(" ", _IMAGE.sub(" ", text)))
    kept: list[str] = []
    signed = False
    for line in text.split("\n"):
        # a signature ends with its paragraph; what comes after a rule is the author's own again
        signed = bool(_SIGNATURE.match(line)) or (signed and bool(line.strip()))
        if signed:
            kept.append("")
        elif _MARKER.match(line):
            # the name of the quoted stands above
            while kept and not kept[-1].strip():
                kept.pop()
            if kept and _SAID.match(kept[-1]):
                kept.pop()
            kept.append("")
        else:
            kept.append(_CODE.sub("", line))
    parts = re.split(r"\n\s*\n", "\n".join(kept))
    return [p for part in parts if (p := re.sub(r"\s+", " ", part).strip())]
