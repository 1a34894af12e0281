import os

import pytest

from gaugeflow.llm.mixture import mix, shares
from gaugeflow.llm.tokens import VOCABULARY, with_token_counts

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="needs the vocabulary")

DOC = "doc_id bigint, source string, text string, weight string, n_tokens string"
TARGET = "source string, weight double, max_repeats int"


def docs(spark, sizes):
    data, n = [], 0
    for source, count, text in sizes:
        for _ in range(count):
            data.append((n, source, text, "x", "y"))
            n += 1
    return spark.createDataFrame(data, DOC)


def test_shares_follow_weights(spark):
    d = docs(spark, [("a", 300, "one two three four"), (" A ", 100, "one two three four"), ("b", 200, "five six"), ("c", 10, "seven"), ("z", 50, "no target"), (None, 5, "x"), ("a", 3, None), ("a", 3, "")])
    t = spark.createDataFrame([("a", 0.5, 1), ("B", 0.25, 2), ("c", 0.25, 3), ("gone", 0.1, 1), ("bad", -1.0, 1), ("null", None, 1), (None, 1.0, 1)], TARGET)
    chosen = mix(d, t, budget=800)
    rows = chosen.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    assert sum(r.n_tokens * r.repeats for r in rows) <= 800
    got = {r.source: r for r in shares(chosen, t).collect()}
    assert set(got) == {"a", "b", "c", "gone"}
    assert got["gone"].share == 0
    assert got["c"].most_repeats == 3 and got["c"].documents == 10
    assert got["a"].share / got["b"].share == pytest.approx(2, rel=0.05)


def test_repeats_are_capped_and_second_rounds_follow_first(spark):
    d = docs(spark, [("a", 5, "one two"), ("b", 100, "one two")])
    t = spark.createDataFrame([("a", 1.0, 2), ("b", 1.0, 1)], TARGET)
    rows = mix(d, t, budget=10_000).collect()
    assert {r.source: r.repeats for r in rows} == {"a": 2, "b": 1}
    assert len(rows) == 105
    few = mix(d, t, budget=28).collect()
    assert {r.repeats for r in few if r.source == "a"} <= {1, 2}
    assert sum(1 for r in few if r.source == "a") == 5


def test_empty(spark):
    d = docs(spark, [("a", 3, "x")])
    t = spark.createDataFrame([("a", 1.0, 1)], TARGET)
    assert mix(d.limit(0), t).count() == 0
    assert mix(d, t.limit(0)).count() == 0
    assert [(r.source, r.share) for r in shares(mix(d.limit(0), t), t).collect()] == [("a", 0.0)]


def test_counts_are_those_of_the_tokenizer(spark):
    from gaugeflow.llm.tokens import _encoding

    texts = ["Hello world", "", None, "<|endoftext|>", "ß" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.n for r in with_token_counts(df, "t", "n").collect()}
    assert got == {i: len(_encoding(VOCABULARY).encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert all(_encoding(VOCABULARY).decode(_encoding(VOCABULARY).encode_ordinary(t)) == t for t in texts if t)


def test_largest_budget_that_meets_all_targets(spark):
    d = docs(spark, [("a", 400, "one two three four"), ("b", 30, "five six"), ("c", 500, "seven eight nine")])
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.2, 3), ("c", 0.3, 1), ("gone", 1.0, 1)], TARGET)
    got = {r.source: r for r in shares(mix(d, t, meet=True), t).collect()}
    assert {s: round(r.share, 1) for s, r in got.items()} == {"a": 0.5, "b": 0.2, "c": 0.3, "gone": 0.0}
    assert all(r.share == pytest.approx(r.present_share, abs=0.02) for r in got.values())
    # the scarcest source is used up
    assert got["b"].documents == 30 and got["b"].most_repeats == 3
