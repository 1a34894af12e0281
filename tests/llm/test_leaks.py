import numpy as np

from gaugeflow.llm.leaks import Index, find_leaks, fingerprints, word_hashes
from gaugeflow.llm.text import words

ITEM = " ".join(f"word{i}" for i in range(40))


def leaks(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, item_id string")
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, suite string")
    return {(r.key, r["item"]): r.exact for r in find_leaks(d, q, **more).collect()}


def test_words():
    assert words("It&#39;s <b>w­o</b>rd [url=/x]A[/url]1&nbsp;é_x<br>y") == ["it", "s", "word", "a1", "é", "x", "y"]
    assert words(None) == words("") == []


def test_passages_whole_part_and_marked_up(spark):
    w = ITEM.split()
    docs = [
        (1, "before " + ITEM + " after"), (2, "x " + " ".join(w[10:22]) + " y"), (3, " ".join(w[10:21])), (4, "> " + "\n> ".join(w[5:20])),
        (5, " ".join(f"<i>{x.upper()}</i>&nbsp;" for x in w[3:16])), (6, None), (7, ""), (8, " ".join(["zz"] * 100_000 + w[:12])), (None, ITEM), (9, " ".join(reversed(w))),
        (1, "before " + ITEM + " after"),
    ]
    got = leaks(spark, docs, [(1, ITEM), (2, "too short"), (3, None), (None, ITEM), (1, ITEM)])
    assert {k for k, exact in got.items() if exact} == {(1, 1), (2, 1), (4, 1), (5, 1), (8, 1)}


def test_parts_of_items_give_the_same(spark):
    items = [(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(8)]
    docs = [(i, "a b c " + " ".join(t.split()[4:18])) for i, t in items]
    assert leaks(spark, docs, items, item_windows=20) == leaks(spark, docs, items) == {(i, i): True for i in range(8)}


def test_empty(spark):
    assert leaks(spark, [], [(1, ITEM)]) == {}
    assert leaks(spark, [(1, ITEM)], []) == {}


def test_all_fingerprints_within_the_radius():
    random = np.random.default_rng(0)
    index = Index([(1, " ".join(f"a{i}" for i in range(200)))], 12, 3, 5)
    flips = np.array([np.bitwise_xor.reduce([np.uint64(1) << np.uint64(b) for b in random.choice(64, n, replace=False)] or [np.uint64(0)]) for n in random.integers(0, 7, len(index.prints))], np.uint64)
    prints = index.prints ^ flips
    left, right = index.candidates(prints)
    brute = np.bitwise_count(prints[:, None] ^ index.prints[None, :]) <= 3
    assert set(zip(left.tolist(), right.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(brute)), strict=True))


def test_fingerprints_over_stretches():
    h = word_hashes(" ".join(f"a{i % 977}" for i in range(70_000)))
    whole = fingerprints(h, 12)
    assert len(whole) == len(h) - 11
    assert (whole[65_530:65_545] == fingerprints(h[65_530:65_556], 12)).all()


def changed(ws, how, random, one_in=11):
    """ws with one word in one_in replaced, dropped or swapped with the next."""
    out = list(ws)
    for at in range(random.integers(0, one_in), len(ws) - 1, one_in):
        if how == "replaced":
            out[at] = f"other{random.integers(0, 10**6)}"
        elif how == "dropped":
            out[at] = ""
        else:
            out[at], out[at + 1] = out[at + 1], out[at]
    return " ".join(w for w in out if w)


def planted(how, one_in, n=300):
    random = np.random.default_rng(5)
    items = [(i, " ".join(f"v{random.integers(0, 4000)}" for _ in range(40))) for i in range(n)]
    noise = lambda: " ".join(f"v{random.integers(0, 4000)}" for _ in range(60))
    docs = [(i, f"{noise()} {changed(t.split(), how, random, one_in)} {noise()}") for i, t in items]
    return docs + [(n + j, noise()) for j in range(200)], items


def test_passages_with_changed_words(spark):
    for how in ("replaced", "dropped", "swapped"):
        docs, items = planted(how, 11)
        got = leaks(spark, docs, items, shingle=1, similar=0.7, near_radius=16)
        right = sum(got.get((i, i)) is not None for i, _ in items)
        assert right >= 0.9 * len(items), how
        assert right >= 0.99 * len(got), how


def test_near_passages_are_those_of_brute_force():
    """Whole items against all stretches of a text, without fingerprints."""
    docs, items = planted("replaced", 11, 60)
    index = Index(items, 12, 3, 1, near_radius=16)
    found = {(t, i): s for t, i, s, exact in index.search([t for _, t in docs], 0.7) if not exact}
    assert found.keys() <= {(i, i) for i, _ in items}
    brute = {}
    for t, text in docs[: len(items)]:
        own, h = word_hashes(text), word_hashes(items[t][1])
        brute[t, t] = max(index.similarity(own[p : p + len(h)], h) for p in range(len(own) - len(h) + 1))
    brute = {k: s for k, s in brute.items() if s >= 0.7}
    assert len(brute) > 50 and len(brute.keys() & found.keys()) >= 0.95 * len(brute)
    assert all(found[k] >= brute[k] - 1e-6 for k in brute.keys() & found.keys())


def test_joins_give_the_same_as_the_broadcast_index(spark):
    docs, items = planted("replaced", 11, 30)
    docs += [(900, items[0][1]), (901, "x y " + " ".join(items[1][1].split()[3:20])), (902, items[0][1]), (None, items[2][1])]
    for more in ({}, {"shingle": 1, "similar": 0.7, "near_radius": 12}):
        assert leaks(spark, docs, items, item_windows=10, **more) == leaks(spark, docs, items, **more)
