"""Queries of the problems 1 and 5 to 9."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gambitflow.llm import endings, leaks, pairs, percentile_queries, sentences, tokens
from gambitflow.session import materialise
from gambitflow.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(table(spark, d, "openai_gpt_5"), table(spark, d, "documents"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    seen = materialise(endings.inspected(table(spark, d, "openai_gpt_5")), "endings")
    return endings.cut_values(seen).select("rec_id", "field")


def p6_limits(spark: SparkSession, d: str) -> DataFrame:
    """Hidden storage limits of each source and field."""
    seen = materialise(endings.inspected(table(spark, d, "openai_gpt_5")), "endings")
    return endings.hidden_limits(seen).select("run_key", "field", "measure", "size", "n")


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each source truncates."""
    lines = table(spark, d, "openai_gpt_5")
    seen = materialise(endings.inspected(lines), "endings")
    return endings.cut_rates(lines, seen, endings.cut_values(seen))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "bench_items"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """How many documents leak each item."""
    return leaks.leak_report(table(spark, d, "documents"), table(spark, d, "bench_items"))


def p8_removed(spark: SparkSession, d: str) -> DataFrame:
    """The documents that leak, with what is left of them: leaked spans are cut out, and a
    document that is mostly leaked is removed whole (text null)."""
    return leaks.without_leaks(table(spark, d, "documents"), table(spark, d, "bench_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    **percentile_queries.QUERIES,
    "p6_found": p6_found,
    "p6_limits": p6_limits,
    "p6_rates": p6_rates,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p8_report": p8_report,
    "p8_removed": p8_removed,
    "p9_found": p9_found,
}
#: SQL cannot express the others; tests/llm holds brute-force versions and round trips.
SQL: dict[str, str] = dict(percentile_queries.SQL)
