"""Subjects of posts: averaged word and subword embeddings with independent logistic outputs.

A sentence is the mean of its words' vectors, a word the mean of the vectors of itself and of its letter
groups; each subject has its own logistic output. The labelled examples are few, so the classifier is fitted
on the corpus's sentences, labelled by words: a word's subjects spread from the examples to the words it stands
with, and a sentence with two words of a subject is about it, while one with a single such word only mentions
it. Words are counted over the different own sentences of all documents; only the labelled sentences that the
classifier is fitted on are a bounded sample. Fitting is synchronous: each round sends the parameters out, sums
the gradients of all partitions and takes one step. Every document is scored.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.llm.text import own_paragraphs, words
from gaugeflow.session import cut

_SENTENCE = re.compile(r"(?<=[.?!])\s+")
#: How many times as much evidence a word must have for its subject as for any other, by round of spreading.
_TIMES = (1.5, 2.0, 2.5, 2.5, 2.5, 2.5)
#: Least share of one subject in a word's examples; least share of its sentences that hold other evidence at all.
_FIRST, _TOLD = 0.5, 0.25
#: Words in fewer different sentences say nothing; nor do set phrases, of whose sentences fewer than this share differ,
#: unless their repeats are spread as over this many equally frequent ones: the share falls as a corpus grows.
_RARE, _VARIED, _EVEN = 5, 0.1, 10


#: Characters of texts that are scored together.
TOGETHER = 1 << 20
#: Numbers of a table of words that may be broadcast; a larger one is joined by shuffles.
_BROADCAST = 1 << 20


@dataclass(frozen=True)
class Settings:
    """Bound of the labelled sentences that the classifier is fitted on, and its size; counts and scores have no bounds.

    `sample_documents` bounds nothing any more: the labelled sentences are drawn from all documents.
    """

    sample_documents: int = 20_000
    sample_sentences: int = 60_000
    buckets: int = 1 << 15
    dimensions: int = 16
    rounds: int = 50
    rate: float = 0.1
    partitions: int = 6
    seed: int = 1


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence, numbers left out; sentences without words are none."""
    parts = ([w for w in words(s) if not w.isdigit()] for s in _SENTENCE.split(text))
    return [ws for ws in parts if ws]


@lru_cache(maxsize=1 << 18)
def _features(word: str, buckets: int) -> np.ndarray:
    """Buckets of a word and of its groups of 3 to 5 letters."""
    marked = f"<{word}>"
    groups = [xxhash.xxh64_intdigest(marked[i : i + n], seed=n) % buckets for n in (3, 4, 5) for i in range(len(marked) - n + 1)]
    return np.array([xxhash.xxh64_intdigest(word) % buckets, *groups], np.int64)


def spread(examples: list[tuple[int, list[str]]], corpus: list[list[str]], subjects: int) -> dict[str, int]:
    """word -> subject, spread from example sentences (subject, or subjects for none) to the corpus's words.

    On lists; `spread_over` gives the same over tables.
    """
    index: dict[str, int] = {}
    for _, ws in examples:
        for w in ws:
            index.setdefault(w, len(index))
    for ws in corpus:
        for w in ws:
            index.setdefault(w, len(index))
    seen = np.zeros((len(index), subjects + 1))
    for k, ws in examples:
        for w in set(ws):
            seen[index[w], k] += 1
    seen = seen / np.maximum(seen.sum(0), 1) * seen.sum(0).mean()
    distinct: dict[tuple[int, ...], int] = {}
    for ws in [ws for _, ws in examples] + corpus:
        one = tuple(sorted({index[w] for w in ws}))
        distinct[one] = distinct.get(one, 0) + 1
    # a sentence that many repeat counts once: set phrases have no subject
    sets = sorted(distinct)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    col = np.fromiter((w for s in sets for w in s), np.int64)
    repeats = np.array([distinct[s] for s in sets], float)[row]
    times, squares = np.bincount(col, repeats, len(index)), np.bincount(col, repeats**2, len(index))
    often = np.bincount(col, minlength=len(index))
    often = (often >= _RARE) & ((often >= _VARIED * times) | (times**2 >= _EVEN * squares))

    def shares(counts: np.ndarray, more: float) -> np.ndarray:
        counts = counts + more / counts.shape[1]
        return counts / counts.sum(1, keepdims=True)

    def clear(belief: np.ndarray, many: float) -> np.ndarray:
        order = np.sort(belief, 1)
        return order[:, -1] >= (many * order[:, -2] if subjects > 1 else 0)

    belief = shares(seen, 2)[:, :subjects]
    stands = (belief.max(1) >= _FIRST) & clear(belief, 2)
    for many in _TIMES:
        vote = belief * stands[:, None]
        sums = np.stack([np.bincount(row, vote[col, k], len(sets)) for k in range(subjects)], 1)
        other = sums[row] - vote[col]  # a word has no say about itself
        total = other.sum(1)
        told = total > 0.3
        given = np.zeros((len(row), subjects))
        given[told] = other[told] / total[told, None]
        counts = np.stack([np.bincount(col, given[:, k], len(index)) for k in range(subjects)], 1)
        evidence = np.bincount(col, told, len(index))
        # a subject that holds much of the corpus has no more say about the words of all subjects
        sizes = counts.sum(0)
        counts *= sizes.mean() / np.maximum(sizes, max(0.05 * sizes.mean(), 1e-9))
        belief = shares(seen[:, :subjects] + counts, 1)
        stands = often & clear(belief, many) & (evidence >= _RARE / 2) & (evidence >= _TOLD * np.bincount(col, minlength=len(index)))
    names = list(index)
    return {names[i]: int(belief[i].argmax()) for i in np.flatnonzero(stands)}


def label(ws: list[str], stands: dict[str, int], known: set[str], subjects: int) -> np.ndarray | None:
    """The subjects of which a sentence has two words; None if a rare word leaves it open."""
    counts = np.bincount([stands[w] for w in set(ws) if w in stands], minlength=subjects)
    if counts.max(initial=0) == 1 and any(w not in known for w in ws):
        return None
    return (counts >= 2).astype(np.float32)


def _sums(values: np.ndarray, segment: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by a sorted segment number."""
    ends = np.searchsorted(segment, np.arange(n + 1))
    whole = np.vstack([np.zeros((1, values.shape[1]), values.dtype), np.cumsum(values, 0, dtype=np.float64).astype(values.dtype)])
    return whole[ends[1:]] - whole[ends[:-1]]


@dataclass
class Shard:
    """A part of the training sentences as arrays: features of words, words of sentences, labels."""

    features: np.ndarray
    of_word: np.ndarray
    words: np.ndarray
    of_sentence: np.ndarray
    labels: np.ndarray
    n_words: int = field(default=0)

    @classmethod
    def of(cls, rows: list[tuple[list[str], np.ndarray]], buckets: int) -> Shard:
        index: dict[str, int] = {}
        words = np.array([index.setdefault(w, len(index)) for ws, _ in rows for w in ws], np.int64)
        lists = [_features(w, buckets) for w in index]
        return cls(np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(f) for f in lists]), words, np.repeat(np.arange(len(rows)), [len(ws) for ws, _ in rows]), np.array([y for _, y in rows], np.float32), len(index))

    def gradient(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
        """(buckets, their gradients, gradients of outputs and biases, summed loss) over this shard."""
        n = len(self.labels)
        size = np.bincount(self.of_word, minlength=self.n_words).astype(np.float32)[:, None]
        vectors = _sums(model.vectors[self.features], self.of_word, self.n_words) / size
        length = np.bincount(self.of_sentence, minlength=n).astype(np.float32)[:, None]
        means = _sums(vectors[self.words], self.of_sentence, n) / length
        p = 1 / (1 + np.exp(-(means @ model.outputs + model.biases)))
        miss = p - self.labels
        loss = -float(np.log(np.where(self.labels > 0.5, p, 1 - p) + 1e-9).sum())
        back = (miss @ model.outputs.T / length)[self.of_sentence]
        to_words = np.stack([np.bincount(self.words, back[:, d], self.n_words) for d in range(back.shape[1])], 1) / size
        there = np.unique(self.features)
        place = np.searchsorted(there, self.features)
        spread = to_words[self.of_word]
        grads = np.stack([np.bincount(place, spread[:, d], len(there)) for d in range(back.shape[1])], 1)
        return there, grads.astype(np.float32), (means.T @ miss).astype(np.float32), miss.sum(0).astype(np.float32), loss


@dataclass
class Model:
    subjects: list[str]
    vectors: np.ndarray
    outputs: np.ndarray
    biases: np.ndarray

    def word_scores(self, word: str) -> np.ndarray:
        """What a word adds to the logits, before the mean over its sentence."""
        return self.vectors[_features(word, len(self.vectors))].mean(0) @ self.outputs


class Scorer:
    """A model with the scores of the words met so far."""

    def __init__(self, model: Model, most_words: int = 1 << 18):
        self.model, self.most = model, most_words
        self.index: dict[str, int] = {}
        self.scores = np.empty((0, len(model.subjects)), np.float32)

    def _rows(self, flat: list[str]) -> np.ndarray:
        """Scores of words, one row each."""
        if len(self.index) > self.most:
            self.index, self.scores = {}, self.scores[:0]
        known = len(self.index)
        at = np.fromiter((self.index.setdefault(w, len(self.index)) for w in flat), np.int64, len(flat))
        if len(self.index) > known:
            new = [self.model.word_scores(w) for w in list(self.index)[known:]]
            self.scores = np.concatenate([self.scores, np.array(new, np.float32)])
        return self.scores[at]

    def many(self, texts: list[str | None]) -> list[tuple[int, str, float]]:
        """(text, subject, highest probability of any sentence) of the subjects that some paragraph is about."""
        flat: list[str] = []
        starts, owners = [], []
        for i, text in enumerate(texts):
            for paragraph in own_paragraphs(text):
                for ws in sentences(paragraph):
                    starts.append(len(flat))
                    owners.append(i)
                    flat += ws
        if not flat or not self.model.subjects:
            return []
        sums = np.add.reduceat(self._rows(flat), starts, axis=0)
        logits = sums / np.diff([*starts, len(flat)])[:, None] + self.model.biases
        first = np.flatnonzero(np.diff(owners, prepend=-1))
        best = np.maximum.reduceat(logits, first, axis=0)
        text, subject = np.nonzero(best >= 0)
        p = 1 / (1 + np.exp(-best[text, subject].astype(float)))
        return [(owners[first[t]], self.model.subjects[s], float(v)) for t, s, v in zip(text, subject, p, strict=True)]

    def subjects(self, text: str | None) -> dict[str, float]:
        """subject -> highest probability, of one text."""
        return {s: p for _, s, p in self.many([text])}


def _sets(documents: DataFrame, text: str, given: list[tuple[int, list[str]]], seed: int) -> DataFrame:
    """(i, words, s, n, given, h): the own sentences of all documents and the examples' sentences, each set of words once.

    s is one of the sentences, n how many there are, h a hash of s; i numbers the sets.
    """

    def parts_of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"s": [" ".join(ws) for t in part["t"] for p in own_paragraphs(t) for ws in sentences(p)]}, dtype=object)

    rows = documents.filter(F.col(text).isNotNull()).select(F.col(text).alias("t"))
    found = rows.mapInPandas(parts_of, "s string").select("s", F.lit(False).alias("given"))
    own = documents.sparkSession.createDataFrame([(" ".join(ws), True) for _, ws in given], "s string, given boolean")
    once = found.union(own).groupBy("s").agg(F.count("*").alias("n"), F.max("given").alias("given"))
    key = F.sort_array(F.array_distinct(F.split("s", " "))).alias("words")
    sets = once.groupBy(key).agg(F.min("s").alias("s"), F.sum("n").alias("n"), F.max("given").alias("given"))
    # numbered after the cut, so that lost tasks number alike
    return cut(sets.withColumn("h", F.xxhash64(F.lit(seed), "s"))).withColumn("i", F.monotonically_increasing_id())


def _told_by(given: list[tuple[int, list[str]]], subjects: int) -> tuple[list[tuple], tuple]:
    """Rows (word, evidence by subject, belief by subject, whether it stands) of the examples' words, and those of any other."""
    index: dict[str, int] = {}
    for _, ws in given:
        for w in ws:
            index.setdefault(w, len(index))
    seen = np.zeros((len(index) + 1, subjects + 1))  # the last row is any other word's
    for k, ws in given:
        for w in set(ws):
            seen[index[w], k] += 1
    seen = seen / np.maximum(seen.sum(0), 1) * seen.sum(0).mean()
    belief = seen + 2 / (subjects + 1)
    belief = (belief / belief.sum(1, keepdims=True))[:, :subjects]
    order = np.sort(belief, 1)
    stands = (order[:, -1] >= _FIRST) & (order[:, -1] >= (2 * order[:, -2] if subjects > 1 else 0))
    rows = [(w, *map(float, seen[j, :subjects]), *map(float, belief[j]), bool(stands[j])) for w, j in (*index.items(), ("", len(index)))]
    return rows[:-1], rows[-1][1:]


def _total(columns: list[Column]) -> Column:
    return sum(columns[1:], columns[0])


@dataclass
class Spread:
    """What `spread_over` gives; `close` frees what it keeps."""

    stands: DataFrame
    groups: DataFrame
    cells: DataFrame
    small: bool

    def words(self, table: DataFrame) -> DataFrame:
        """A table of words as the right side of a join."""
        return F.broadcast(table) if self.small else table

    def close(self) -> None:
        self.cells.unpersist()
        self.groups.unpersist()


def spread_over(sets: DataFrame, given: list[tuple[int, list[str]]], subjects: int) -> Spread:
    """`spread` over the table of `_sets`: counts of words and of words with subjects are aggregations over all rows.

    stands has (w, k), the words and their subjects; groups (i, h, given, ws, others, open) the sets with the words
    that can stand, the number of other words and whether a word is rare; cells (i, w, more) one row for each such word.
    """
    ks = range(subjects)
    told, other = _told_by(given, subjects)
    seen, belief = [f"e{k}" for k in ks], [f"b{k}" for k in ks]
    names = [*seen, *belief, "stands"]
    examples = sets.sparkSession.createDataFrame(told, ", ".join(["w string", *(f"{c} double" for c in seen + belief), "stands boolean"]))
    words = sets.select(F.explode("words").alias("w"), "n").groupBy("w").agg(F.count("*").alias("often"), F.sum("n").alias("times"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"))
    words = words.join(examples, "w", "left").select("w", "often", "times", "squares", *(F.coalesce(c, F.lit(v)).alias(c) for c, v in zip(names, other, strict=True)))
    # a sentence that many repeat counts once: set phrases have no subject
    times = F.col("times").cast("double")
    words = words.withColumn("varied", (F.col("often") >= _RARE) & ((F.col("often") >= _VARIED * times) | (times * times >= _EVEN * F.col("squares"))))
    words = words.withColumn("known", F.col("times") >= _RARE).withColumn("can", F.col("varied") | F.col("stands"))
    words = cut(words.filter("known or can"))
    small = words.count() * (subjects + 1) <= _BROADCAST
    joined = (lambda table: F.broadcast(table)) if small else (lambda table: table)

    cells = sets.select("i", "h", "given", F.explode("words").alias("w")).join(joined(words.select("w", "known", "can")), "w", "left")
    groups = cells.groupBy("i", "h", "given").agg(
        F.collect_list(F.when(F.col("can"), F.col("w"))).alias("ws"), F.count("*").alias("others"), F.max(~F.coalesce("known", F.lit(False))).alias("open")
    )
    groups = groups.withColumn("others", F.col("others") - F.size("ws")).persist()
    cells = groups.select("i", F.try_divide("others", F.size("ws")).alias("more"), F.explode("ws").alias("w"))
    cells = cells.repartition("i").sortWithinPartitions("i").persist()

    base = words.filter("can").select("w", "often", "varied", *seen)
    state = words.filter("can").select("w", *belief, "stands")
    sentence = Window.partitionBy("i")
    for many in _TIMES:
        votes = state.filter("stands").select("w", *(F.col(b).alias(f"v{k}") for k, b in enumerate(belief)))
        voted = cells.join(joined(votes), "w", "left").select("i", "w", "more", *(F.coalesce(f"v{k}", F.lit(0.0)).alias(f"v{k}") for k in ks))
        summed = voted.select("*", *(F.sum(f"v{k}").over(sentence).alias(f"s{k}") for k in ks))
        # a word has no say about itself
        summed = summed.withColumn("all", _total([F.col(f"s{k}") for k in ks])).withColumn("rest", _total([F.col(f"s{k}") - F.col(f"v{k}") for k in ks]))
        part = [F.when(F.col("rest") > 0.3, (F.col(f"s{k}") - F.col(f"v{k}")) / F.col("rest")).otherwise(0.0) for k in ks]
        # words that can't stand are told of as well: each word that can carries its share of them
        more = [F.when(F.col("all") > 0.3, F.col("more") * F.col(f"s{k}") / F.col("all")).otherwise(0.0) for k in ks]
        counts = summed.groupBy("w").agg(
            *(F.sum(part[k]).alias(f"c{k}") for k in ks), *(F.sum(more[k]).alias(f"m{k}") for k in ks), F.sum(F.when(F.col("rest") > 0.3, 1).otherwise(0)).alias("evidence")
        )
        counts = cut(counts)
        sizes = counts.agg(*(F.coalesce(F.sum(F.col(f"c{k}") + F.col(f"m{k}")), F.lit(0.0)).alias(f"z{k}") for k in ks))
        mean = _total([F.col(f"z{k}") for k in ks]) / subjects
        # a subject that holds much of the corpus has no more say about the words of all subjects; one row, joined rather
        # than written into the plan, so that all rounds share their generated code
        scales = sizes.select(*((mean / F.greatest(F.col(f"z{k}"), 0.05 * mean, F.lit(1e-9))).alias(f"z{k}") for k in ks))
        state = base.join(joined(counts), "w").crossJoin(F.broadcast(scales))
        weights = [F.col(f"e{k}") + F.col(f"c{k}") * F.col(f"z{k}") + 1 / subjects for k in ks]
        state = state.withColumn("sum", _total(weights)).select("w", "often", "varied", "evidence", *((weights[k] / F.col("sum")).alias(f"b{k}") for k in ks))
        order = F.sort_array(F.array(*belief), asc=False)
        clear = order[0] >= many * order[1] if subjects > 1 else F.lit(True)
        state = state.withColumn("stands", F.col("varied") & clear & (F.col("evidence") >= _RARE / 2) & (F.col("evidence") >= _TOLD * F.col("often")))
    best = F.array_position(F.array(*belief), F.array_max(F.array(*belief))) - 1
    stands = state.filter("stands").select("w", best.cast("int").alias("k"))
    return Spread(stands, groups, cells, small)


def _shards(sets: DataFrame, given: list[tuple[int, list[str]]], subjects: int, settings: Settings) -> DataFrame:
    """(n, shard): a bounded, hash-ordered sample of the sentences that `label` doesn't leave open, as `Shard`s of n sentences.

    The examples' sentences are always taken. A subject that few sentences are about has at least its share of a
    tenth of the sample, if there are so many. The sample stays on the executors.
    """
    ks = range(subjects)
    spread = spread_over(sets, given, subjects)
    try:
        stands = cut(spread.stands)
        counts = spread.cells.join(spread.words(stands), "w").groupBy("i").agg(*(F.sum(F.when(F.col("k") == k, 1).otherwise(0)).alias(f"n{k}") for k in ks))
        rows = spread.groups.join(counts, "i", "left").select("i", "h", "given", "open", F.array(*(F.coalesce(f"n{k}", F.lit(0)) for k in ks)).alias("ns"))
        rows = rows.filter(~(F.col("open") & (F.array_max("ns") == 1)))
        rows = rows.withColumn("ys", F.transform("ns", lambda n: n >= 2)).withColumn("kind", F.array_position("ys", True)).drop("ns", "open").persist()
        try:
            sizes = {r[0]: r[1] for r in rows.groupBy("kind").count().collect()}
            n = sum(sizes.values())
            least = settings.sample_sentences / 10 / (subjects + 1)
            shares = [max(settings.sample_sentences / max(n, 1), least / max(sizes.get(kind, 0), 1)) for kind in range(subjects + 1)]
            turn = (F.pmod("h", F.lit(1 << 30)) / (1 << 30)) / F.element_at(F.array(*map(F.lit, shares)), (F.col("kind") + 1).cast("int"))
            turn = F.when(F.col("given"), -1.0).otherwise(turn)
            kept = rows.withColumn("turn", turn).filter("turn < 1.2").join(sets.select("i", "s"), "i")
            kept = kept.orderBy("turn", "s").limit(settings.sample_sentences + len(given)).select("s", "ys")
            return cut(kept.repartition(settings.partitions, "s").sortWithinPartitions("s").mapInPandas(_gather(settings.buckets), "n bigint, shard binary"))
        finally:
            rows.unpersist()
    finally:
        spread.close()


def _gather(buckets: int):
    """One shard of all rows (s, ys) of a partition, which holds its part of the bounded sample."""

    def gather(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(s.split(" "), np.array(ys, np.float32)) for part in parts for s, ys in zip(part["s"], part["ys"], strict=True)]
        if rows:
            yield pd.DataFrame({"n": [len(rows)], "shard": [pickle.dumps(Shard.of(rows, buckets))]})

    return gather


def fit(documents: DataFrame, examples: DataFrame, *, text: str = "text", example_text: str = "text", subject: str = "subject", settings: Settings | None = None) -> Model:
    """The classifier, from labelled examples (a bounded, fixed set; a null subject is none) and the corpus.

    Without examples of any subject the model has no subjects. The driver holds the examples and the parameters
    (buckets times dimensions numbers); the labelled sample, bounded by the settings, stays on the executors.
    """
    settings = settings or Settings()
    labelled = [(r[0], r[1]) for r in examples.select(subject, example_text).filter(F.col(example_text).isNotNull()).distinct().collect()]
    subjects = sorted({s for s, _ in labelled if s is not None})
    k = len(subjects)
    random = np.random.default_rng(settings.seed)
    model = Model(subjects, random.normal(0, 0.1, (settings.buckets, settings.dimensions)).astype(np.float32), random.normal(0, 0.1, (settings.dimensions, k)).astype(np.float32), np.full(k, -1.0, np.float32))
    if not k:
        return model
    given = sorted((subjects.index(s) if s is not None else k, ws) for s, t in labelled for ws in sentences(t))
    shards = _shards(_sets(documents, text, given, settings.seed), given, k, settings)
    n = shards.agg(F.sum("n")).first()[0]
    if n:
        _descend(model, shards, n, settings)
    return model


def _descend(model: Model, data: DataFrame, n: int, settings: Settings) -> None:
    """Rounds of synchronous steps: each partition's gradient, summed on the driver, one Adam step."""
    parameters = (model.vectors, model.outputs, model.biases)
    first = [np.zeros_like(p) for p in parameters]
    second = [np.zeros_like(p) for p in parameters]
    context = data.sparkSession.sparkContext
    for step in range(1, settings.rounds + 1):
        sent = context.broadcast(model)

        def slope(parts: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for part in parts:
                yield pd.DataFrame({"g": [pickle.dumps(pickle.loads(s).gradient(sent.value)) for s in part["shard"]]})  # noqa: S301 own data

        grads = [np.zeros_like(p) for p in parameters]
        for row in data.select("shard").mapInPandas(slope, "g binary").collect():  # one row a partition, of at most 2 MB
            there, vectors, outputs, biases, _ = pickle.loads(row.g)  # noqa: S301 own data
            grads[0][there] += vectors / n
            grads[1] += outputs / n
            grads[2] += biases / n
        sent.destroy()
        for p, g, m, v in zip(parameters, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= settings.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def assign_subjects(documents: DataFrame, examples: DataFrame, *, key: str = "doc_id", text: str = "text", settings: Settings | None = None) -> DataFrame:
    """(key, subject, probability): the subjects that at least one own paragraph of a document is about.

    Quotations, signatures and markup are not the author's own words. Null and empty texts and null keys
    have no subject; a repeated row gives its subjects once; other columns are ignored; without documents or
    examples the result is empty. Texts are scored whole, sentence by sentence.
    """
    model = fit(documents.select(text), examples, text=text, settings=settings)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(sent.value)
        for part in parts:
            keys, texts = part["k"].to_numpy(), part["t"].tolist()
            # texts are taken together up to some size; a long one may be alone
            ends = np.cumsum([len(t) for t in texts]) // TOGETHER
            for cut in np.unique(ends):
                some = np.flatnonzero(ends == cut)
                found = [(keys[some[i]], s, p) for i, s, p in scorer.many([texts[i] for i in some])]
                yield pd.DataFrame(found, columns=["key", "subject", "probability"])

    rows = documents.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).filter("k is not null and t is not null")
    found = rows.mapInPandas(score, "key bigint, subject string, probability double")
    return found.groupBy("key", "subject").agg(F.max("probability").alias("probability"))
