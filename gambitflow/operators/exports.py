"""Exports of graded results: one document per task, an index of runs, files by category.

Documents stay rows until they are written: a category is a folder of JSON lines, however
many tasks it has, so no category is ever collected into one task. Keys are sorted, so equal
data give equal bytes.

Defined results: repeated deliveries of a cell are reduced to the smallest result id; a task
that no run has tried is no document; a cell without a result is left out of its document
and counted by `missing_cells`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gambitflow.functions import primitives, text
from gambitflow.operators import moves
from gambitflow.operators.deliveries import clean_identifier

#: Categories and the names of their folders.
CATEGORIES = {"Structural": "structural", "Motifs": "motifs", "Short Tactics": "short-tactics", "Position Judgement": "position-judgement", "Semantic": "semantic"}


def canonical_runs(runs: DataFrame, results: DataFrame, least: int = 50) -> DataFrame:
    """Complete runs with at least so many results, by run_key."""
    n = results.groupBy("run_id").agg(F.count("*").alias("n_results")).where(F.col("n_results") >= least)
    return runs.where("status = 'complete'").join(n, "run_id").orderBy("run_key")


def require_one_variant(runs: DataFrame) -> None:
    """Raise if a run differs in the flags that change the prompt, as one prompt is shown for all."""
    odd = runs.where("coalesce(add_context, 0) != 0 or coalesce(format_example_group, 1) != 1").select("run_key").limit(5).collect()
    if odd:
        raise ValueError(f"runs with other prompts: {', '.join(str(r.run_key) for r in odd)}")


def cells(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row per task and run: outcome, and the legality of answers to tactics tasks."""
    best = results.withColumn("task", clean_identifier(F.col("task_id"))).groupBy("task", "run_id").agg(F.min(F.struct("result_id", "extracted", "error_type", "cost_usd", "completion_tokens", "reasoning_tokens", "latency_ms", "n_attempts", "thinking_source", F.length(F.coalesce("thinking_content", F.lit(""))).alias("thinking_chars"))).alias("b"))
    t = tasks.select(clean_identifier(F.col("task_id")).alias("task"), "task_type", "task_category", "input", "question", "correct_answer", "answer_type", "metadata").dropDuplicates(["task"])
    rows = best.select("task", "run_id", "b.*").join(t, "task")
    # only tactics answers are played out; their legality is told by the result id
    tactics = rows.where("task_type like 'short_tactics%'").select(F.col("result_id").cast("string").alias("id"), text.split_input(F.col("input"))["fen"].alias("fen"), F.col("extracted").alias("answer"))
    legal = moves.legality(tactics).select(F.col("id").cast("long").alias("result_id"), "legality")
    joined = rows.join(legal, "result_id", "left")
    return joined.withColumn("outcome", text.outcome(F.col("error_type"), F.col("legality")))


def task_documents(cell_rows: DataFrame, runs: DataFrame, details: bool = True) -> DataFrame:
    """task, category, doc: a JSON document of each task with its results by run_key. A task
    has one result for each run, and runs are few."""
    r = F.broadcast(runs.select("run_id", "run_key")) if runs.count() <= 100_000 else runs.select("run_id", "run_key")
    result = [F.col(c).alias(c) for c in ("completion_tokens", "error_type", "extracted", "latency_ms", "legality", "n_attempts", "outcome", "thinking_source")]
    if details:
        result.append(primitives.primitive(F.col("task_type"), F.col("extracted"), F.col("correct_answer")).alias("primitives"))
    result.append(F.col("run_key").alias("run"))
    by_run = F.array_sort(F.collect_list(F.struct(F.col("run_key").alias("k"), F.struct(*result).alias("r"))))
    first = lambda c: F.first(c).alias(c)
    g = cell_rows.join(r, "run_id").groupBy("task").agg(F.transform(by_run, lambda x: x["r"]).alias("results"), *[first(c) for c in ("task_type", "task_category", "input", "question", "correct_answer", "answer_type", "metadata")])
    x = text.split_input(F.col("input"))
    parts = {
        "answer_type": F.col("answer_type"), "correct_answer": F.col("correct_answer"), "input_fen": x["fen"], "input_moves": x["moves"], "question": F.col("question"), "results": F.col("results"), "task_category": F.col("task_category"),
        "task_id": F.col("task"), "task_type": F.col("task_type"),
    }
    if details:
        parts |= {"correct_primitives": primitives.primitive(F.col("task_type"), F.col("correct_answer")), "metadata": F.from_json("metadata", "map<string,string>")}
    doc = F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)]), {"ignoreNullFields": "false"})
    slug = F.element_at(F.create_map(*[F.lit(v) for kv in CATEGORIES.items() for v in kv]), F.col("task_category"))
    return g.select("task", F.coalesce(slug, F.lit("other")).alias("category"), doc.alias("doc"))


def trace_documents(results: DataFrame, runs: DataFrame) -> DataFrame:
    """task, run_key, doc: what a run thought and said about a task."""
    best = results.withColumn("task", clean_identifier(F.col("task_id"))).groupBy("task", "run_id").agg(F.min(F.struct("result_id", "thinking_content", "response", "thinking_source")).alias("b"))
    body = F.to_json(F.struct(F.coalesce("b.thinking_content", F.lit("")).alias("content"), F.coalesce("b.response", F.lit("")).alias("response"), F.col("b.thinking_source").alias("thinking_source")), {"ignoreNullFields": "false"})
    return best.join(runs.select("run_id", "run_key"), "run_id").select("task", "run_key", body.alias("doc"))


def run_index(cell_rows: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per run: outcomes counted, cost and tokens (null where none is told), sources."""
    src = cell_rows.groupBy("run_id", F.coalesce("thinking_source", F.lit("none")).alias("s")).agg(F.count("*").alias("k")).groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("s", "k")))).alias("thinking_sources"))
    count = lambda o: F.count_if(F.col("outcome") == o)
    sums = cell_rows.groupBy("run_id").agg(
        F.count("*").alias("n_results"), count("correct").alias("n_correct"), count("capped").alias("n_capped"), count("illegal").alias("n_illegal"), F.round(F.sum("cost_usd"), 4).alias("total_cost_usd"),
        F.round(F.avg("completion_tokens")).cast("long").alias("avg_completion_tokens"),
    )
    name = text.display_name(F.col("run_key"), F.col("model"), F.coalesce("enable_thinking", F.lit(0)))
    head = runs.select("run_id", F.col("run_key").alias("slug"), name.alias("display_name"), "model", "backend", (F.coalesce("enable_thinking", F.lit(0)) != 0).alias("enable_thinking"), "reasoning_config", "git_commit", "started_at")
    return head.join(sums, "run_id").join(src, "run_id").orderBy("slug")


def missing_cells(cell_rows: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, missing: how many of the tasks in the export a run has no result for."""
    total = cell_rows.agg(F.count_distinct("task").alias("total"))
    have = cell_rows.groupBy("run_id").agg(F.count_distinct("task").alias("have"))
    return runs.select("run_id").join(have, "run_id", "left").crossJoin(F.broadcast(total)).select("run_id", (F.col("total") - F.coalesce("have", F.lit(0))).alias("missing"))  # total is one row


def generated_at(runs: DataFrame) -> str:
    """The newest change of the runs, '' without any."""
    return runs.agg(F.coalesce(F.max("updated_at"), F.lit(""))).first()[0]


def write_documents(documents: DataFrame, root: str) -> DataFrame:
    """Write documents as JSON lines, a folder for each category; returns category, n, bytes."""
    documents.select("category", F.col("doc").alias("value")).write.partitionBy("category").mode("overwrite").text(root)
    written = documents.sparkSession.read.schema("value string, category string").text(root)
    return written.groupBy("category").agg(F.count("*").alias("n"), F.sum(F.octet_length("value") + 1).alias("bytes"))
