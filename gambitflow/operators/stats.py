"""Grading of stored responses and the aggregates over graded results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gambitflow.functions import text
from gambitflow.operators.deliveries import clean_identifier


def graded(results: DataFrame, tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """Responses extracted and graded again, without any model call: result_id, run_id,
    task, task_type, task_category, answer, ok, error_type, completion_tokens, cost.
    Runs are few (checked by Spark's own size limit for broadcasts); tasks are hashed on
    the cleaned id. Rows whose task is unknown are left out."""
    t = tasks.select(clean_identifier(F.col("task_id")).alias("task"), "task_type", "task_category", "correct_answer", "answer_type").dropDuplicates(["task"])
    r = results.select(
        "result_id", "run_id", clean_identifier(F.col("task_id")).alias("task"), text.extract_answer(F.col("response")).alias("x"), "completion_tokens", "total_tokens", "prompt_tokens", F.col("cost_usd").alias("cost"), "latency_ms", "thinking_source", "usage_json"
    )
    limits = runs.select("run_id", "max_tokens")
    joined = r.join(t, "task").join(limits, "run_id", "left")
    error = text.grade(F.col("x.answer"), F.col("correct_answer"), F.col("answer_type"), F.col("x.ok"), F.coalesce("completion_tokens", F.lit(0)), F.col("max_tokens"))
    return joined.select("result_id", "run_id", "task", "task_type", "task_category", F.col("x.answer").alias("answer"), F.col("x.ok").alias("ok"), error.alias("error_type"), "completion_tokens", "total_tokens", "prompt_tokens", "cost", "latency_ms", "thinking_source", "usage_json")


def rollup_stats(rows: DataFrame) -> DataFrame:
    """Overall, by error type, by task type and by category in one pass over the rows."""
    level = F.when(F.grouping_id() == 3, F.lit("error_type")).when(F.grouping_id() == 5, F.lit("task_type")).when(F.grouping_id() == 6, F.lit("task_category")).otherwise(F.lit("all"))
    good = F.col("error_type") == "correct"
    return (
        rows.groupingSets([[], [F.col("error_type")], [F.col("task_type")], [F.col("task_category")]], "error_type", "task_type", "task_category")
        .agg(
            level.alias("level"), F.count("*").alias("n"), F.count_if(good).alias("n_correct"), F.count_if("ok").alias("n_extracted"),
            F.round(F.sum(F.coalesce("cost", F.lit(0.0))), 6).alias("total_cost"), F.sum(F.coalesce("total_tokens", F.lit(0))).alias("sum_tokens"),
        )
        .select("level", F.coalesce("error_type", "task_type", "task_category", F.lit("")).alias("key"), "n", "n_correct", "n_extracted", "total_cost", F.col("sum_tokens").alias("total_tokens"), F.round(F.col("n_correct") / F.col("n"), 6).alias("accuracy"), F.round(F.col("n_extracted") / F.col("n"), 6).alias("format_rate"))
    )


def usage_rollup(rows: DataFrame, by: list[str]) -> DataFrame:
    """Token and cost sums with guarded ratios; averages are over all rows, an empty usage is an error."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.sum(F.coalesce("cost", F.lit(0.0))), 6).alias("total_cost"), F.sum(z("prompt_tokens")).alias("total_prompt_tokens"), F.sum(z("completion_tokens")).alias("total_completion_tokens"),
        F.sum(z("total_tokens")).alias("total_tokens"), F.count_if(F.col("usage_json").isNull() | F.col("usage_json").isin("", "{}")).alias("error_count"), F.count_if("ok").alias("extraction_success_count"),
    )
    ratio = lambda a, b, k=1.0: F.when(F.col(b) > 0, F.round(F.col(a) * k / F.col(b), 6)).otherwise(F.lit(0.0))
    return sums.select(
        "*", ratio("extraction_success_count", "n").alias("extraction_success_rate"), ratio("total_cost", "n").alias("avg_cost_per_task"), ratio("total_tokens", "n").alias("avg_tokens_per_task"),
        ratio("total_cost", "total_tokens", 1000.0).alias("cost_per_1k_tokens"), ratio("total_completion_tokens", "total_prompt_tokens").alias("completion_ratio"),
        ratio("total_tokens", "total_cost").alias("tokens_per_dollar"), ratio("total_prompt_tokens", "n").alias("avg_prompt_tokens"), ratio("total_completion_tokens", "n").alias("avg_completion_tokens"),
    )


def batch_accuracy(rows: DataFrame, batch: str) -> DataFrame:
    """batch, n, accuracy: how the rows of each saved batch did."""
    return rows.groupBy(batch).agg(F.count("*").alias("n"), F.round(F.avg((F.col("error_type") == "correct").cast("double")), 6).alias("accuracy"))


def error_rates(rows: DataFrame) -> DataFrame:
    """Histogram of error types within each run, with rates."""
    n = rows.groupBy("run_id", "error_type").agg(F.count("*").alias("n"))
    return n.withColumn("rate", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("run_id")), 6))


def run_summary(rows: DataFrame) -> DataFrame:
    """One row per run with its histogram of trace sources as a map."""
    sources = rows.groupBy("run_id", F.coalesce("thinking_source", F.lit("none")).alias("s")).agg(F.count("*").alias("k")).groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("s", "k")))).alias("thinking_sources"))
    base = rows.groupBy("run_id").agg(
        F.count("*").alias("n_results"), F.count_if(F.col("error_type") == "correct").alias("n_correct"), F.count_if(F.col("error_type") == "max_token_reached").alias("n_capped"),
        F.round(F.sum("cost"), 4).alias("total_cost"), F.round(F.avg("completion_tokens")).cast("long").alias("avg_completion_tokens"),
        F.bool_and(F.coalesce("thinking_source", F.lit("")).isin("", "none")).alias("traceless"),
    )
    return base.join(sources, "run_id")


def outcome_documents(rows: DataFrame, tasks: DataFrame) -> DataFrame:
    """task, doc: one JSON document per task with the outcome of every run, keys sorted.
    Repeated deliveries of a cell are reduced to the smallest result id first."""
    cell = rows.groupBy("task", "run_id").agg(F.min(F.struct("result_id", text.outcome(F.col("error_type"), F.lit(None).cast("string")).alias("o"))).alias("m"))
    cells = cell.groupBy("task").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.format_string("%06d", "run_id").alias("r"), F.col("m.o").alias("o"))))).alias("outcomes"))
    t = tasks.select(clean_identifier(F.col("task_id")).alias("task"), "task_category", "task_type").dropDuplicates(["task"])
    return cells.join(t, "task").select("task", F.to_json(F.struct(F.col("task_category").alias("category"), "outcomes", F.col("task").alias("task_id"), F.col("task_type").alias("type"))).alias("doc"))


def last_line_wins(lines: DataFrame, key: list, order: str) -> DataFrame:
    """The newest line of each key; the aggregate combines before the shuffle."""
    keys = [c.alias(f"k{n}") for n, c in enumerate(key)]
    return lines.select(*keys, order).groupBy(*[f"k{n}" for n in range(len(keys))]).agg(F.max(order).alias(order))


def completed(rows: DataFrame, retry_capped: bool = False) -> DataFrame:
    """Adds `complete`: no error text, and an answer or a spent budget (which is run again
    on request)."""
    capped = F.col("error_type") == "max_token_reached"
    good = ~F.coalesce(F.col("response"), F.lit("")).startswith("ERROR") & ((F.length(F.coalesce(F.col("response"), F.lit(""))) > 0) | capped)
    return rows.withColumn("complete", F.coalesce(good & ~capped if retry_capped else good, F.lit(False)))


def resume_split(tasks: DataFrame, results: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, state, n: how many tasks of the whole set each run has complete, to do again
    or never tried. States are counted from the results; the task set is never multiplied
    out by the runs."""
    done = completed(results).groupBy("run_id", clean_identifier(F.col("task_id")).alias("task")).agg(F.max(F.col("complete").cast("int")).alias("c"))
    known = done.join(tasks.select(clean_identifier(F.col("task_id")).alias("task")).distinct(), "task", "left_semi")
    per = known.groupBy("run_id").agg(F.sum("c").cast("long").alias("complete"), F.sum(1 - F.col("c")).cast("long").alias("again"))
    total = tasks.select(clean_identifier(F.col("task_id")).alias("task")).agg(F.count_distinct("task").alias("total"))
    wide = runs.select("run_id").join(per, "run_id", "left").crossJoin(F.broadcast(total))  # one row
    c, a = F.coalesce("complete", F.lit(0)), F.coalesce("again", F.lit(0))
    return wide.select("run_id", F.explode(F.array(F.struct(F.lit("complete").alias("state"), c.alias("n")), F.struct(F.lit("again").alias("state"), a.alias("n")), F.struct(F.lit("new").alias("state"), (F.col("total") - c - a).alias("n")))).alias("x")).select("run_id", "x.state", "x.n")
