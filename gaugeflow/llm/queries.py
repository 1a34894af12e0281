"""Queries of the text problems p7 to p9 over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.llm.leaks import find_leaks
from gaugeflow.llm.mixture import mix, shares
from gaugeflow.llm.subjects import assign_subjects
from gaugeflow.sources.tables import table


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    found = find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark_items"))
    return found.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), F.round("similarity", 6).alias("similarity"), "exact")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_leaks(spark, folder).filter("exact").select("doc_id", "item_id")


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"), table(spark, folder, "source_targets"))


def p8_balanced(spark: SparkSession, folder: str) -> DataFrame:
    """The largest mixture in which every board that has documents reaches its share, with the shares."""
    targets = table(spark, folder, "source_targets")
    return shares(mix(table(spark, folder, "documents"), targets, meet=True), targets)


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return shares(p8_mix(spark, folder), table(spark, folder, "source_targets"))


def p9_subjects(spark: SparkSession, folder: str) -> DataFrame:
    found = assign_subjects(table(spark, folder, "documents"), table(spark, folder, "subject_examples"))
    return found.select(F.col("key").alias("doc_id"), "subject", F.round("probability", 4).alias("probability"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_subjects(spark, folder).select("doc_id", "subject")


QUERIES = {f.__name__: f for f in (p7_found, p7_leaks, p8_mix, p8_balanced, p8_shares, p9_found, p9_subjects)}



def _windows(table: str, key: str) -> str:
    """SQL for (key, w): all windows of 12 words of a table's texts."""
    text = r"regexp_replace(text, '[\x{00AD}\x{034F}\x{061C}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]', '', 'g')"
    for entity, mark in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")):
        text = f"replace({text}, '{entity}', '{mark}')"
    for pattern, mark in ((r"(?i)</?(br|p|div|li|ul|ol|tr|td|table|blockquote|cite|h\d|hr|pre)\b[^<>]*>", " "), (r"(?i)</?[a-z][^<>]*>", ""), (r"(?i)\[img\][^\[\]]*\[/img\]", " "), (r"(?i)\[/?[a-z*]+(=[^\[\]]*)?\]", "")):
        text = f"regexp_replace({text}, '{pattern}', '{mark}', 'g')"
    words = f"select {key}, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+') w from {table} where text is not null"
    return f"select distinct {key}, array_to_string(w[i:i + 11], ' ') w from (select {key}, w, unnest(range(1, len(w) - 10)) i from ({words}))"


#: Equivalent SQL; the others are tested by brute force and on held-out labels.
ORACLE: dict[str, str] = {
    "p7_found": f"select distinct doc_id, item_id from ({_windows('documents', 'doc_id')}) join ({_windows('benchmark_items', 'item_id')}) using (w)",
}
