"""Queries of problem 5, with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gambitflow.llm import quantiles
from gambitflow.operators.deliveries import clean_identifier
from gambitflow.sources.tables import table

PERCENTILES = [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


def _measures(spark: SparkSession, d: str) -> DataFrame:
    """task_type, batch_id, metric, value, n: the mergeable summaries of single batches."""
    tasks = table(spark, d, "tasks").select(clean_identifier(F.col("task_id")).alias("task"), "task_type")
    rows = table(spark, d, "results").select(clean_identifier(F.col("task_id")).alias("task"), "batch_id", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("completion_tokens", "latency_ms")])).alias("m"))
    # summed up by task before the join: the join moves distinct values, not rows
    counts = quantiles.summary(rows.select("task", "batch_id", "m.metric", "m.value"), ["task", "metric"], "value", ["batch_id"])
    return counts.join(tasks, "task").groupBy("task_type", "metric", "batch_id", "value").agg(F.sum("n").alias("n"))


def p5_batch_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles per task type of each single batch; their summaries combine."""
    return quantiles.percentiles(_measures(spark, d), ["task_type", "metric", "batch_id"], PERCENTILES)


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles per task type, from the summaries of single batches."""
    counts = quantiles.combine(_measures(spark, d), group=["task_type", "metric"])
    return quantiles.percentiles(counts, ["task_type", "metric"], PERCENTILES)


def p5_by_batch(spark: SparkSession, d: str) -> DataFrame:
    """Medians of single batches over all task types."""
    counts = quantiles.combine(_measures(spark, d), group=["batch_id", "metric"])
    return quantiles.percentiles(counts, ["batch_id", "metric"], [0.5])


def p5_costs(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of the recorded cost of a result, a column of fractions, by run."""
    return quantiles.percentiles(quantiles.summary(table(spark, d, "results"), ["run_id"], "cost_usd"), ["run_id"], [0.5, 0.9])


_MEASURE = """WITH m AS (
  SELECT t.task_type, r.batch_id, 'completion_tokens' AS metric, r.completion_tokens AS value
  FROM results r JOIN tasks t ON lower(trim(r.task_id, ' ' || chr(9) || chr(10) || chr(13))) = lower(trim(t.task_id, ' ' || chr(9) || chr(10) || chr(13))) WHERE r.completion_tokens IS NOT NULL
  UNION ALL
  SELECT t.task_type, r.batch_id, 'latency_ms', r.latency_ms
  FROM results r JOIN tasks t ON lower(trim(r.task_id, ' ' || chr(9) || chr(10) || chr(13))) = lower(trim(t.task_id, ' ' || chr(9) || chr(10) || chr(13))) WHERE r.latency_ms IS NOT NULL)
"""
_ALL = "unnest([0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) AS p, unnest(quantile_disc(value, [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99])) AS v, count(*) AS n"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p5_batch_percentiles": p5_batch_percentiles,
    "p5_percentiles": p5_percentiles,
    "p5_by_batch": p5_by_batch,
    "p5_costs": p5_costs,
}

SQL: dict[str, str] = {
    "p5_batch_percentiles": _MEASURE + f"SELECT task_type, metric, batch_id, p::DOUBLE AS p, v AS value, n FROM (SELECT task_type, metric, batch_id, {_ALL} FROM m GROUP BY task_type, metric, batch_id)",
    "p5_percentiles": _MEASURE
    + """SELECT task_type, metric, p::DOUBLE AS p, v AS value, n FROM (
  SELECT task_type, metric, unnest([0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) AS p,
         unnest(quantile_disc(value, [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99])) AS v, count(*) AS n
  FROM m GROUP BY task_type, metric)""",
    "p5_by_batch": _MEASURE + "SELECT batch_id, metric, 0.5::DOUBLE AS p, quantile_disc(value, 0.5) AS value, count(*) AS n FROM m GROUP BY batch_id, metric",
    "p5_costs": "SELECT run_id, p::DOUBLE AS p, v AS value, n FROM (SELECT run_id, unnest([0.5, 0.9]) AS p, unnest(quantile_disc(cost_usd, [0.5, 0.9])) AS v, count(cost_usd) AS n FROM results WHERE cost_usd IS NOT NULL GROUP BY run_id)",
}
