"""Held-out test passages in a corpus: which documents hold which items, in part, whole, or nearly.

Windows of words of items and documents get 64-bit SimHash fingerprints. A fingerprint is cut into radius + 1
blocks: two fingerprints within the radius agree in at least one block, so an index of the items' blocks finds
every pair within the radius. Candidates are then verified on the words themselves.

Windows have several lengths. The shortest is that of the shortest passage that counts (12 words): a window of
an item's length can't find a part of it. The others are a ladder of lengths; each item also has windows of the
longest rung that fits it, so that a whole item with a few changed words is found by its item-sized window.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.text import words

#: Words hashed at a time; bounds the memory of a long document's bit counts.
_STRETCH = 1 << 14
#: Characters of texts that are searched together.
TOGETHER = 1 << 20
#: Shortest windows of all items that one broadcast index may hold; it takes about 80 bytes for each (words, shingle
#: weights, and fingerprints of all lengths with their blocks), in every Python worker. More items are searched by joins.
ITEM_WINDOWS = 1 << 20
#: Fingerprints compared at a time.
_PAIRS = 1 << 22


@lru_cache(maxsize=1 << 18)
def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def word_hashes(text: str | None) -> np.ndarray:
    return np.fromiter(map(_hash, words(text)), np.uint64)


def prints_of(hashes: np.ndarray, wanted: Sequence[tuple[int, np.ndarray]]) -> list[np.ndarray]:
    """SimHash of windows of words, for each (window, ascending starts): bit i is set where most of the words' hashes have it set.

    Sums of 1, 2, 4, ... words are taken once for all windows.
    """
    out = [np.empty(len(starts), np.uint64) for _, starts in wanted]
    longest = max(window for window, _ in wanted)
    for at in range(0, len(hashes), _STRETCH):
        part = hashes[at : at + _STRETCH + longest - 1]
        sums = [np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1)]
        while 2 << len(sums) - 1 <= longest and len(sums[-1]) > 1 << len(sums) - 1:
            half, last = 1 << len(sums) - 1, sums[-1]
            last = last.astype(np.min_scalar_type(2 * half), copy=False)
            sums.append(last[:-half] + last[half:])
        for (window, starts), prints in zip(wanted, out, strict=True):
            low, high = np.searchsorted(starts, (at, at + _STRETCH))
            if low == high:
                continue
            here, total = starts[low:high] - at, np.zeros((high - low, 64), np.min_scalar_type(window))
            for bit, of in enumerate(sums):
                if window >> bit & 1:
                    total += of[here]
                    here = here + (1 << bit)
            prints[low:high] = np.packbits(total > window // 2, axis=1).view(np.uint64).ravel()
    return out


def prints_at(hashes: np.ndarray, window: int, starts: np.ndarray) -> np.ndarray:
    return prints_of(hashes, [(window, starts)])[0]


def fingerprints(hashes: np.ndarray, window: int) -> np.ndarray:
    """SimHash of each window of words."""
    return prints_at(hashes, window, np.arange(max(len(hashes) - window + 1, 0)))


def _blocks(prints: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bits, values) of each of radius + 1 blocks that together make up the fingerprint."""
    cuts = np.linspace(0, 64, radius + 2).astype(int)
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(high - low), (prints >> np.uint64(low)) & np.uint64((1 << int(high - low)) - 1)


def stride(window: int) -> int:
    """Steps between the windows of a document; an item's windows begin at each of its words."""
    return max(window // 8, 1)


def rung_of(length: int, window: int) -> int:
    """The longest rung of the ladder (window, 4/3 of it, ...) of which an item holds as many windows as a stride has words."""
    best, rung = window, float(window)
    while round(rung) + stride(round(rung)) - 1 <= length:
        best = round(rung)
        rung *= 4 / 3
    return best


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the runs of n words; of all words if there are fewer."""
    n = min(n, len(hashes))
    if not n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ hashes[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Rung:
    """The items' windows of one length: fingerprints, sorted by each block, and where they begin."""

    def __init__(self, window: int, radius: int, prints: np.ndarray, starts: np.ndarray):
        self.window, self.radius, self.prints, self.starts = window, radius, prints, starts
        self.sorted = []
        for bits, values in _blocks(prints, radius):
            order = np.argsort(values, kind="stable").astype(np.int32)
            # where each value of a short block begins, else the values themselves
            ends = np.searchsorted(values[order], np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32) if bits <= 16 else values[order]
            self.sorted.append((ends, order))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (document window, item window) pairs whose fingerprints differ in at most radius bits."""
        distinct, back = np.unique(prints, return_inverse=True)
        pairs = [np.empty((0, 2), np.int64)]
        for (values, order), (bits, own) in zip(self.sorted, _blocks(distinct, self.radius), strict=True):
            if bits <= 16:
                first, last = values[own.astype(np.int64)].astype(np.int64), values[own.astype(np.int64) + 1]
            else:
                first, last = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
            ends = np.cumsum(last - first)
            # some at a time, so that crowded blocks need no more memory
            begin = 0
            while begin < len(own):
                end = max(int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + _PAIRS, "right")), begin + 1)
                n = (last - first)[begin:end]
                left = np.repeat(np.arange(begin, end), n)
                right = order[np.repeat(first[begin:end] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if n.sum() else np.empty(0, int)
                near = np.bitwise_count(distinct[left] ^ self.prints[right]) <= self.radius
                pairs.append(np.column_stack([left[near], right[near]]))
                begin = end
        found = np.unique(np.concatenate(pairs), axis=0)
        if not len(found):
            return np.empty(0, int), np.empty(0, int)
        # back to the windows that have these fingerprints
        order = np.argsort(back, kind="stable")
        starts = np.searchsorted(back[order], np.arange(len(distinct) + 1))
        n = starts[found[:, 0] + 1] - starts[found[:, 0]]
        at = np.repeat(starts[found[:, 0]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return order[at], np.repeat(found[:, 1], n)


class Index:
    """The items' words, the weights of their shingles, and a `Rung` for each length of window."""

    def __init__(self, items: Sequence[tuple[int, str]], window: int, radius: int, shingle: int, near_radius: int = 7, weights: tuple[np.ndarray, np.ndarray, float] | None = None):
        self.window, self.shingle = window, shingle
        hashes = [word_hashes(text) for _, text in items]
        self.ids = np.array([i for i, _ in items], np.int64)
        self.begin = np.concatenate([[0], np.cumsum([len(h) for h in hashes])]).astype(np.int64)
        self.words = np.concatenate([*hashes, np.empty(0, np.uint64)])
        self.weights = weights or _weights(hashes, shingle)
        rungs: dict[int, list[int]] = {window: []}
        for n, h in enumerate(hashes):
            if len(h) >= window:
                rungs[window].append(n)
                if (longest := rung_of(len(h), window)) > window:
                    rungs.setdefault(longest, []).append(n)
        self.rungs = []
        for size, held in sorted(rungs.items()):
            starts = np.concatenate([np.empty(0, np.int64), *[np.arange(self.begin[n], self.begin[n + 1] - size + 1) for n in held]])
            self.rungs.append(Rung(size, radius if size == window else near_radius, prints_at(self.words, size, starts), starts))

    @property
    def prints(self) -> np.ndarray:
        """Fingerprints of the shortest windows."""
        return self.rungs[0].prints

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.rungs[0].candidates(prints)

    def similarity(self, a: np.ndarray, b: np.ndarray) -> float:
        """Weighted Jaccard similarity of the shingles of two stretches of words."""
        x, y = np.unique(shingles(a, self.shingle)), np.unique(shingles(b, self.shingle))
        both, whole = self._weigh(np.intersect1d(x, y, assume_unique=True)), self._weigh(np.union1d(x, y))
        return both / whole if whole else 0.0

    def _weigh(self, some: np.ndarray) -> float:
        keys, values, other = self.weights
        if not len(keys):
            return other * len(some)
        at = np.minimum(np.searchsorted(keys, some), len(keys) - 1)
        return float(np.where(keys[at] == some, values[at], other).sum())

    def search(self, texts: Sequence[str | None], similar: float) -> list[tuple[int, int, float, bool]]:
        """(text, item, best similarity, exact) of each item that a text holds, in part word for word, or nearly."""
        lists = [words(t) for t in texts]
        hashes = np.fromiter((_hash(w) for ws in lists for w in ws), np.uint64)
        sizes = np.array([len(ws) for ws in lists], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        text = np.repeat(np.arange(len(lists)), sizes)
        place = np.arange(len(hashes)) - first[text]
        best: dict[tuple[int, int], tuple[float, bool]] = {}
        # windows that reach into the next text are none
        owns = [np.flatnonzero((place + r.window <= sizes[text]) & (place % (1 if r.window == self.window else stride(r.window)) == 0)) for r in self.rungs]
        prints = prints_of(hashes, [(r.window, own) for r, own in zip(self.rungs, owns, strict=True)])
        for rung, own, marks in zip(self.rungs, owns, prints, strict=True):
            left, right = rung.candidates(marks)
            if not len(left):
                continue
            left, right = own[left], rung.starts[right]
            exact = np.zeros(len(left), bool)
            for at in range(0, len(left), _STRETCH):
                part, reach = slice(at, at + _STRETCH), np.arange(rung.window)
                exact[part] = (hashes[left[part, None] + reach] == self.words[right[part, None] + reach]).all(1)
            item = np.searchsorted(self.begin, right, "right") - 1
            for t, i in np.unique(np.column_stack([text[left[exact]], self.ids[item[exact]]]), axis=0).tolist():
                best[t, i] = (1.0, True)
            # an item that stands in a text word for word needs no nearly equal windows
            for k in np.flatnonzero(~exact):
                pair, p, q, n = (int(text[left[k]]), int(self.ids[item[k]])), left[k], right[k], item[k]
                if best.get(pair, (0.0, False))[1]:
                    continue
                s = self.similarity(hashes[p : p + rung.window], self.words[q : q + rung.window])
                # the whole item, laid where the window lies
                begin, end = p - (q - self.begin[n]), p + (self.begin[n + 1] - q)
                s = max(s, self.similarity(hashes[max(begin, first[pair[0]]) : min(end, first[pair[0] + 1])], self.words[self.begin[n] : self.begin[n + 1]]))
                if s >= similar and s > best.get(pair, (0.0, False))[0]:
                    best[pair] = (s, False)
        return [(t, i, s, e) for (t, i), (s, e) in best.items()]


def _weights(hashes: list[np.ndarray], shingle: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(shingles, their weights, the weight of any other): the rarer among the items, the more one says."""
    keys, seen = np.unique(np.concatenate([np.empty(0, np.uint64), *[np.unique(shingles(h, shingle)) for h in hashes]]), return_counts=True)
    most = float(np.log(max(len(hashes), 1)))
    return keys, (1 + most - np.log(seen)).astype(np.float32), 1 + most


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = 12,
    radius: int = 3,
    near_radius: int = 7,
    shingle: int = 5,
    similar: float = 0.8,
    item_windows: int = ITEM_WINDOWS,
) -> DataFrame:
    """(key, item, similarity, exact): items of which a document holds a passage of window words, or nearly the whole.

    exact: the passage stands there word for word (see words(); quoted text counts). Otherwise one of the
    document's windows is within radius bits of a window of the item (near_radius for item-sized windows), and
    the windows, or the whole item and the stretch of the document it lies on, have a weighted similarity of
    similar or more in shingles of shingle words. With five words and 0.8, one changed word in about fifty is
    found; shingle=1 and a near_radius of 16 find one in ten. Every whole text is searched, without a cap on
    candidates; a document's item-sized windows begin at every eighth of a window, an item's at every word.

    Items shorter than a window, and null or empty texts, match nothing; null keys and items are left out;
    repeated rows give one result; other columns are ignored; empty tables give an empty result. Held-out items
    of up to item_windows windows in all are sent to all executors as one index; more are matched by joins on
    the fingerprints' blocks, with the same result.
    """
    docs = documents.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).filter("k is not null and t is not null")
    held = items.select(F.col(item).cast("bigint").alias("i"), F.col(item_text).alias("t")).filter("i is not null and t is not null").distinct()
    sizes = {"window": window, "radius": radius, "near_radius": near_radius, "shingle": shingle}

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"n": [sum(max(len(words(t)) - window + 1, 0) for t in part["t"])]})

    most = held.mapInPandas(count, "n bigint").agg(F.sum("n")).first()[0] or 0
    if most > item_windows:
        found = _by_joins(docs, held, similar, sizes)
    else:
        index = documents.sparkSession.sparkContext.broadcast(Index([(r.i, r.t) for r in held.orderBy("i", "t").collect()], **sizes))

        def search(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for row in rows:
                keys, texts = row["k"].to_numpy(), row["t"].tolist()
                # texts are taken together up to some size; a long one may be alone
                ends = np.cumsum([len(t) for t in texts]) // TOGETHER
                for cut in np.unique(ends):
                    some = np.flatnonzero(ends == cut)
                    hits = [(keys[some[0] + t], *hit) for t, *hit in index.value.search([texts[i] for i in some], similar)]
                    yield pd.DataFrame(hits, columns=["key", "item", "similarity", "exact"])

        found = docs.mapInPandas(search, "key bigint, item bigint, similarity double, exact boolean")
    return found.groupBy("key", "item").agg(F.max("similarity").alias("similarity"), F.max("exact").alias("exact"))


def _by_joins(docs: DataFrame, held: DataFrame, similar: float, sizes: dict[str, int]) -> DataFrame:
    """Hits of item sets of any size: equal blocks of fingerprints are joined, each pair of texts found is searched.

    Different fingerprints are joined first and their windows after, so that a passage that many documents
    repeat is compared once; a crowded key is left to the adaptive skew join.
    """
    window, radius, near_radius, shingle = (sizes[k] for k in ("window", "radius", "near_radius", "shingle"))

    def of_items(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i, t in zip(part["i"], part["t"], strict=True):
                h = word_hashes(t)
                for size in sorted({window, rung_of(len(h), window)}) if len(h) >= window else []:
                    yield pd.DataFrame({"i": i, "rung": size, "print": np.unique(fingerprints(h, size)).view(np.int64)})

    item_prints = held.mapInPandas(of_items, "i bigint, rung int, print bigint")
    rungs = [r.rung for r in item_prints.select("rung").distinct().collect()]  # the ladder's lengths

    def of_documents(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for k, t in zip(part["k"], part["t"], strict=True):
                h = word_hashes(t)
                wanted = [(size, np.arange(0, max(len(h) - size + 1, 0), 1 if size == window else stride(size))) for size in rungs]
                for size, marks in zip(rungs, prints_of(h, wanted), strict=True):
                    yield pd.DataFrame({"k": k, "rung": size, "print": np.unique(marks).view(np.int64)})

    document_prints = docs.mapInPandas(of_documents, "k bigint, rung int, print bigint")

    def blocked(prints: DataFrame) -> DataFrame:
        """(rung, print, block): each different fingerprint once for each of its blocks."""
        parts = []
        for bits, near in ((radius, F.col("rung") == window), (near_radius, F.col("rung") != window)):
            cuts = [int(c) for c in np.linspace(0, 64, bits + 2).astype(int)]
            ends = zip(cuts[:-1], cuts[1:], strict=True)
            values = [F.struct(F.lit(n).alias("n"), (F.shiftrightunsigned("print", low).bitwiseAND((1 << (high - low)) - 1) if high - low < 64 else F.col("print")).alias("v")) for n, (low, high) in enumerate(ends)]
            parts.append(F.when(near, F.array(*values)))
        return prints.select("rung", "print").distinct().select("rung", "print", F.explode(F.coalesce(*parts)).alias("block"))

    own, other = blocked(document_prints), blocked(item_prints).withColumnRenamed("print", "item_print")
    near = own.join(other, ["rung", "block"])
    most = F.when(F.col("rung") == window, radius).otherwise(near_radius)
    near = near.filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= most).select("rung", "print", "item_print").distinct()
    pairs = document_prints.join(near, ["rung", "print"]).join(item_prints.withColumnRenamed("print", "item_print"), ["rung", "item_print"]).select("k", "i").distinct()

    def of_shingles(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i, t in zip(part["i"], part["t"], strict=True):
                yield pd.DataFrame({"i": i, "t": t, "s": np.unique(shingles(word_hashes(t), shingle)).view(np.int64)})

    listed = held.mapInPandas(of_shingles, "i bigint, t string, s bigint")
    seen = listed.groupBy("s").agg(F.count("*").alias("n"))
    weighted = listed.join(seen, "s").groupBy("i", "t").agg(F.collect_list(F.struct("s", "n")).alias("w"))  # as long as the item
    number = held.count()

    def verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        most = float(np.log(number))
        for part in parts:
            for k, t, i, passage, w in zip(part["k"], part["t"], part["i"], part["passage"], part["w"], strict=True):
                keys = np.array([x["s"] for x in w], np.int64).view(np.uint64)
                order = np.argsort(keys)
                weights = (1 + most - np.log([x["n"] for x in w])).astype(np.float32)
                index = Index([(i, passage)], weights=(keys[order], weights[order], 1 + most), **sizes)
                yield pd.DataFrame([(k, *hit) for _, *hit in index.search([t], similar)], columns=["key", "item", "similarity", "exact"])

    texts = pairs.join(weighted.withColumnRenamed("t", "passage"), "i").join(docs.distinct(), "k").select("k", "t", "i", "passage", "w")
    return texts.mapInPandas(verify, "key bigint, item bigint, similarity double, exact boolean")
