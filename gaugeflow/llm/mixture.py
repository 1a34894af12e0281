"""Sources mixed to target weights by weighted fair queueing.

Each source's documents are shuffled; a document's virtual finish time is its source's tokens up to and with
it, divided by the source's weight. In the order of finish times all sources are served in proportion to
their weights, so the documents up to the total budget have the wanted shares, as far as the sources last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.tokens import VOCABULARY, with_token_counts
from gaugeflow.operators.shards import running_total
from gaugeflow.session import cut


def _board(column: str):
    return F.lower(F.trim(column))


def wanted(targets: DataFrame) -> DataFrame:
    """(source, weight, max_repeats) of usable targets: a positive weight, at least one repeat.

    A source named twice has its largest weight and number of repeats.
    """
    rows = targets.select(_board("source").alias("source"), "weight", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
    rows = rows.filter("source is not null and weight > 0 and not isnan(weight) and max_repeats > 0")
    return rows.groupBy("source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))


def mix(documents: DataFrame, targets: DataFrame, *, budget: int | None = None, meet: bool = False, seed: int = 0, vocabulary: str = VOCABULARY) -> DataFrame:
    """The chosen documents: (doc_id, source, n_tokens, repeats), repeats at most the source's max_repeats.

    documents: doc_id (unique), source, text; targets: source, weight, max_repeats. Sources are matched case
    and outer spaces apart. budget is the total in tokens; by default that of all documents of wanted
    sources, once each. A source whose documents run out, repeats included, falls short of its share, and the
    others go on in proportion to their weights. With meet the total is at most the largest at which every source
    that has documents reaches its share, so that the scarcest one sets it. The order inside a source is a hash of
    seed and doc_id; a source's second round begins after its first. Documents of other or null sources, with null
    ids or without tokens are left out; empty tables give an empty result.

    The running totals are prefix sums over range partitions; no source is gathered in one task. The
    targets, one row for each source, are broadcast.
    """
    rows = documents.select("doc_id", _board("source").alias("source"), "text").filter("doc_id is not null and text is not null")
    rows = rows.join(F.broadcast(wanted(targets)), "source")
    rows = cut(with_token_counts(rows, "text", "n_tokens", vocabulary).filter("n_tokens > 0"))
    if budget is None:
        budget = rows.agg(F.sum("n_tokens")).first()[0] or 0
    if meet:
        budget = min(budget, largest_budget(rows))
    rows = rows.withColumn("_turn", F.xxhash64(F.lit(seed), "doc_id"))
    rows = running_total(rows, ["source"], ["_turn", "doc_id"], "n_tokens", "_sum")
    totals = rows.groupBy("source").agg(F.sum("n_tokens").alias("_round"))  # one row for each wanted source
    copies = rows.join(F.broadcast(totals), "source").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("max_repeats") - 1)))
    copies = copies.select("doc_id", "source", "n_tokens", "_copy", ((F.col("_copy") * F.col("_round") + F.col("_sum")) / F.col("weight")).alias("_finish"))
    queue = running_total(copies, [], ["_finish", "source", "_copy", "doc_id"], "n_tokens", "_total")
    served = queue.filter(F.col("_total") <= budget)
    return served.groupBy("doc_id", "source", "n_tokens").agg(F.count(F.lit(1)).alias("repeats"))


def largest_budget(rows: DataFrame) -> int:
    """Tokens up to which every source of rows (source, weight, max_repeats, n_tokens) can have its weight's share; 0 without rows."""
    have = rows.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.max("weight").alias("weight"), F.max("max_repeats").alias("times")).collect()  # one row for each wanted source
    whole = sum(r.weight for r in have)
    return int(min((r.n * r.times * whole / r.weight for r in have), default=0))


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """What was reached: (source, wanted_share, present_share, share, tokens, documents, most_repeats) of each wanted source.

    chosen as from mix(). wanted_share is the weight's share among all targets, present_share that among the sources
    of which there are chosen documents (0 for others); a source without chosen documents has a share of 0.
    """
    goal = wanted(targets)
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"))
    rows = goal.join(got, "source", "left")  # one row for each wanted source
    present = F.when(F.col("tokens").isNotNull(), F.col("weight"))
    whole = rows.agg(F.sum("weight").alias("_weights"), F.sum(present).alias("_present"), F.sum("tokens").alias("_tokens"))
    rows = rows.crossJoin(F.broadcast(whole))  # one row
    return rows.select(
        "source",
        (F.col("weight") / F.col("_weights")).alias("wanted_share"),
        F.coalesce(present / F.col("_present"), F.lit(0.0)).alias("present_share"),
        F.coalesce(F.col("tokens") / F.col("_tokens"), F.lit(0.0)).alias("share"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("tokens", "documents", "most_repeats")],
    )
