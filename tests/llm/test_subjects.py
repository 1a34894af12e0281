import os

import numpy as np
import pytest

from gaugeflow.llm.subjects import Scorer, Settings, assign_subjects, fit, spread
from gaugeflow.llm.text import own_paragraphs

SMALL = Settings(sample_documents=2000, sample_sentences=4000, buckets=1 << 12, rounds=60, partitions=2)
WORDS = {
    "tea": "kettle leaf brew steep saucer oolong infuser matcha strainer sencha teapot blend aroma rooibos chai tisane".split(),
    "rail": "track signal platform carriage locomotive gauge siding bogie sleeper viaduct junction tender buffer shunter ballast turntable".split(),
}
FRAMES = ["the {} needs a {} before long", "nobody told me that a {} and a {} go together", "my sister compares the {} with every {} she sees", "between {} and {} i would wait"]
CHAT = ["thanks in advance for any hint", "you may be right but i doubt it", "please keep it civil everybody"]
MENTION = ["that joke is older than any {}", "my boss behaves like a {} on a monday"]


def made(n, seed):
    """(text, subjects) of posts about one subject, two or none, some with a passing mention."""
    random = np.random.default_rng(seed)
    pick = lambda s: random.choice(WORDS[s], 2, replace=False)
    out = []
    for _ in range(n):
        about = [s for s in WORDS if random.random() < 0.4]
        parts = [" ".join(f"{random.choice(FRAMES).format(*pick(s)).capitalize()}." for _ in range(3)) + f" {random.choice(CHAT).capitalize()}." for s in about]
        if random.random() < 0.5:
            parts.append(f"{random.choice(CHAT).capitalize()}. {random.choice(MENTION).format(random.choice(WORDS[random.choice(list(WORDS))])).capitalize()}.")
        out.append(("\n\n".join(parts) or "Same here.", set(about)))
    return out


def examples(spark, seed=0):
    random = np.random.default_rng(seed)
    rows = [(s, f"{random.choice(FRAMES).format(*random.choice(WORDS[s][:9], 2, replace=False)).capitalize()}. {random.choice(CHAT).capitalize()}.") for s in WORDS for _ in range(12)]
    return spark.createDataFrame([*rows, *[(None, f"{c.capitalize()}.") for c in CHAT]], "subject string, text string")


def test_held_out_posts(spark):
    posts = made(900, 1)
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(posts)] + [(None, posts[0][0], "x"), (9000, None, "x"), (9001, "", "x")], "doc_id bigint, text string, subject string")
    got = {}
    for r in assign_subjects(df, examples(spark), settings=SMALL).collect():
        got.setdefault(r.key, set()).add(r.subject)
    truth = {i: s for i, (_, s) in enumerate(posts) if s}
    pairs = {(i, s) for i, ss in truth.items() for s in ss}
    found = {(i, s) for i, ss in got.items() for s in ss}
    assert len(pairs & found) / len(found) > 0.98
    assert len(pairs & found) / len(pairs) > 0.98


def test_without_examples_or_documents(spark):
    docs = spark.createDataFrame([(1, "A kettle."), (1, "A kettle.")], "doc_id bigint, text string")
    none = examples(spark).limit(0)
    assert assign_subjects(docs, none, settings=SMALL).count() == 0
    assert assign_subjects(docs.limit(0), examples(spark), settings=SMALL).count() == 0


def test_gradient_is_that_of_the_loss(spark):
    from gaugeflow.llm.subjects import Model, Shard

    random = np.random.default_rng(0)
    model = Model(["a", "b"], random.normal(0, 0.3, (64, 3)), random.normal(0, 0.3, (3, 2)), np.zeros(2))
    shard = Shard.of([(["one", "two", "one"], np.array([1.0, 0.0])), (["three"], np.array([0.0, 1.0]))], 64)
    there, vectors, outputs, biases, loss = shard.gradient(model)
    for array, grad, at in ((model.outputs, outputs, (1, 0)), (model.biases, biases, (1,)), (model.vectors, dict(zip(there.tolist(), vectors, strict=True)), (int(there[3]), 1))):
        known = grad[at[0]][at[1]] if isinstance(grad, dict) else grad[at]
        array[at] += 1e-5
        more = shard.gradient(model)[4]
        array[at] -= 1e-5
        assert (more - loss) / 1e-5 == pytest.approx(float(known), rel=1e-2, abs=1e-4)


def test_set_phrases_stand_for_nothing():
    given = [(0, ["kettle", "leaf"]), (0, ["leaf", "kettle"]), (1, ["track", "signal"]), (1, ["signal", "track"])] * 4
    given.append((0, "thanks in advance for any hint".split()))
    corpus = [["kettle", "leaf", f"x{i}"] for i in range(20)] + [["track", "signal", f"y{i}"] for i in range(20)] + ["thanks in advance for any hint".split()] * 500
    stands = spread(given, corpus, 2)
    assert stands.get("kettle") == 0
    assert "hint" not in stands


def test_own_paragraphs():
    assert own_paragraphs("bob wrote:\n> quoted\n> more<br><br>mine\n\n-- \nbob\nmotto") == ["mine"]
    assert own_paragraphs("[quote=a][quote=b]x[/quote]y[/quote]\nown <b>words</b><blockquote>z</blockquote>end\n[size=1]sig") == ["own words", "end"]
    assert own_paragraphs("Itâ€™s") == ["It’s"]
    assert own_paragraphs(None) == own_paragraphs("") == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_held_out_examples(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/subject_examples.parquet").orderBy("example_id").collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    given = spark.createDataFrame([(r.subject, r.text) for i, r in enumerate(rows) if i % 4], "subject string, text string")
    scorer = Scorer(fit(docs, given))
    right = sum(set(scorer.subjects(r.text)) == ({r.subject} if r.subject else set()) for r in rows[::4])
    # a quarter of the few examples is held back; in this small corpus some words never get a subject
    assert right / len(rows[::4]) >= 0.8


def test_counts_over_tables_are_those_over_lists(spark):
    from gaugeflow.llm import subjects as s

    posts = [t for t, _ in made(300, 5)] + ["Thanks in advance for any hint."] * 400 + ["[quote]A kettle.[/quote]\n\nMy kettle broke."]
    names = sorted(WORDS)
    given = sorted((names.index(r.subject) if r.subject else 2, ws) for r in examples(spark).distinct().collect() for ws in s.sentences(r.text))
    corpus = [ws for t in posts for p in own_paragraphs(t) for ws in s.sentences(p)]
    found = s.spread_over(s._sets(spark.createDataFrame([(t,) for t in posts], "text string"), "text", given, 1), given, 2)
    assert {r.w: r.k for r in found.stands.collect()} == spread(given, corpus, 2)
    found.close()


def test_words_stand_however_often_a_corpus_repeats_its_sentences():
    given = [(0, ["kettle", "leaf"]), (0, ["leaf", "kettle"]), (1, ["track", "signal"]), (1, ["signal", "track"])] * 4
    corpus = [[a, b, f"{a[0]}{i}"] for a, b in (("kettle", "brew"), ("track", "siding")) for i in range(20)]
    stands = spread(given, corpus * 50, 2)
    assert (stands.get("kettle"), stands.get("track")) == (0, 1)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_held_out_examples_of_each_group(spark):
    """A quarter of the examples of each language and subject held back."""
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/subject_examples.parquet").orderBy("example_id").collect()
    nth, given, held = {}, [], []
    for r in rows:
        n = nth[r.lang, r.subject] = nth.get((r.lang, r.subject), -1) + 1
        (given if n % 4 else held).append((r.subject, r.text))
    scorer = Scorer(fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.createDataFrame(given, "subject string, text string")))
    right = sum(set(scorer.subjects(t)) == ({s} if s else set()) for s, t in held)
    assert right / len(held) >= 0.9
