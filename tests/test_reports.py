"""Exports, projections and the comment pipeline on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from gambitflow.operators import commentary, exports, projection

RESULTS = "result_id long, run_id long, task_id string, extracted string, error_type string, cost_usd double, completion_tokens long, reasoning_tokens long, latency_ms long, n_attempts int, thinking_source string, thinking_content string, response string, task string"
RUNS = "run_id long, run_key string, model string, backend string, enable_thinking int, add_context int, format_example_group int, reasoning_config string, git_commit string, started_at string, updated_at string, status string"
TASKS = "task_id string, task_type string, task_category string, input string, question string, correct_answer string, answer_type string, metadata string, outcome string"


def frames(spark):
    start = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"
    tasks = spark.createDataFrame([("T1", "short_tactics_x", "Short Tactics", start, "q", "e2e4", "single", '{"a": 1}', "clash"), ("t2", "structural_x", "Structural", None, None, "b", "multi", None, None)], TASKS)
    rows = [
        (5, 1, " t1", "e2e5", "wrong_answer", 0.5, 10, None, 5, 1, None, "abc", "r", "clash"), (6, 1, "t1", "e2e4", "correct", 9.0, 99, None, 5, 1, None, None, "r", None), (7, 1, "t2", None, "format_error", None, None, None, None, None, "", None, None, None),
        (8, 2, "t1", "e2e4", "correct", None, 20, 3, 6, 2, "summary", None, None, None), (9, None, "t2", "b", "correct", None, 1, None, None, None, None, None, None, None),
    ]
    runs = spark.createDataFrame([(1, "m_a", "m/a", "g", 0, 0, 1, None, None, "s", "u1", "complete"), (2, "m_b-thinking", "m/b", "g", 1, 0, 1, None, None, "s", "u2", "complete"), (3, "idle", "i", "g", 0, 0, 1, None, None, "s", None, "in_progress")], RUNS)
    return spark.createDataFrame(rows, RESULTS), tasks, runs


def test_exports(spark, tmp_path):
    results, tasks, runs = frames(spark)
    cells = exports.cells(results, tasks)
    got = {(r.task, r.run_id): (r.outcome, r.legality, r.thinking_chars) for r in cells.collect()}
    assert got == {("t1", 1): ("illegal", "illegal", 3), ("t1", 2): ("correct", "legal", 0), ("t2", 1): ("format_error", None, 0), ("t2", None): ("correct", None, 0)}
    docs = {r.task: (r.category, json.loads(r.doc)) for r in exports.task_documents(cells, runs).collect()}
    assert docs["t1"][0] == "short-tactics" and [x["run"] for x in docs["t1"][1]["results"]] == ["m_a", "m_b-thinking"] and docs["t1"][1]["metadata"] == {"a": "1"} and docs["t2"][1]["results"][0]["outcome"] == "format_error"
    assert list(docs["t1"][1]) == sorted(docs["t1"][1])
    index = {r.slug: r for r in exports.run_index(cells, runs).collect()}
    assert (index["m_a"].n_results, index["m_a"].n_illegal, index["m_a"].total_cost_usd, index["m_a"].avg_completion_tokens, index["m_a"].display_name) == (2, 1, 0.5, 10, "a (no thinking)")
    assert index["m_b-thinking"].total_cost_usd is None and index["m_b-thinking"].thinking_sources == {"summary": 1}
    assert {r.run_id: r.missing for r in exports.missing_cells(cells, runs).collect()} == {1: 0, 2: 1, 3: 2}
    written = {r.category: (r.n, r.bytes) for r in exports.write_documents(exports.task_documents(cells, runs), f"{tmp_path}/d").collect()}
    assert {k: v[0] for k, v in written.items()} == {"short-tactics": 1, "structural": 1} and all(b > 100 for _, b in written.values())
    assert exports.generated_at(runs) == "u2" and exports.generated_at(runs.limit(0)) == ""
    assert [r.run_id for r in exports.canonical_runs(runs, results, 1).collect()] == [1, 2] and exports.canonical_runs(runs, results).count() == 0
    exports.require_one_variant(runs)
    with pytest.raises(ValueError, match="m_a"):
        exports.require_one_variant(runs.withColumn("add_context", F.when(F.col("run_id") == 1, 1).otherwise(0)))
    assert exports.task_documents(exports.cells(results.limit(0), tasks), runs).count() == 0


ROWS = "slug string, task_type string, task_category string, is_correct int, prompt_tokens long, completion_tokens long, cost double, thinking_source string, error_type string"


def test_projection(spark):
    weights = projection.type_weights(spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "task_type string"))
    prices = spark.createDataFrame([("m", 1.0, 4.0), ("n", 2.0, 8.0)], "slug string, price_in double, price_out double")
    rows = [("m", "a", "X", 1, 100, 1_000_000, None, None, "correct"), ("m", "b", "X", 0, 100, 500_000, None, "summary", "max_token_reached"), ("m", "a", "Y", 1, 5, 0, 9.0, None, None), ("m", "z", None, None, None, None, None, None, None), ("n", "q", "X", 1, 10, 10, 0.25, "", "")]
    df = spark.createDataFrame(rows, ROWS)
    got = {r.slug: r for r in projection.projection(df, weights, prices).collect()}
    m, n = got["m"], got["n"]
    assert (m.n, m.error_rows, m.native_priced, m.smoke_cost, m.accuracy, m.max_token_reached, m.projected_out_m, m.projected_cost, m.types_missing) == (2, 2, True, 6.0002, 0.5, 1, 2.5, 10.8, 1)
    assert (n.native_priced, n.smoke_cost, n.projected_out_m, n.types_missing, n.accuracy) == (False, 0.25, 0.0, 2, 1.0)
    assert {(r.slug, r.category): (r.correct, r.n) for r in projection.by_category(df).collect()} == {("m", "X"): (1, 2), ("n", "X"): (1, 1)}
    assert ("n", "error_type", "correct", 1) in {tuple(r) for r in projection.histograms(df).collect()}
    with pytest.raises(KeyError, match="n"):
        projection.projection(df, weights, prices.where("slug = 'm'"))
    assert projection.projection(df.limit(0), weights, prices).count() == 0


ITEMS = "id int, comment string, cleaned_comment string, white_player string, black_player string, annotator string, reply string"


def test_commentary(spark):
    rows = [
        (1, "12...Nf6! Levon and I hold; my knight wins.", None, "So, Wesley", "Aronian, Levon", "Levon Aronian", "x"), (2, "12...Nf6! So wins, says Aronian.", None, "So, Wesley", "Aronian, Levon", "aronianlevon", None), (3, " ", None, "a", "b", None, None),
        (4, None, None, None, None, None, None), (5, "$4", None, None, None, None, None), (6, "skip", None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, ITEMS).drop("reply")
    got = {r.id: r for r in commentary.cleaned(df).collect()}
    assert {i: r.comment for i, r in got.items()} == {1: "12 Nf6! Black and I hold; my knight wins.", 2: "12 Nf6! White wins, says Black."}
    assert got[1].original_comment.startswith("12...") and got[1].cleaned_comment == got[1].comment
    model = lambda m: m.select("id", F.when(F.col("id") == 1, F.lit("<think>a</think>Output: I and Wesley move.")).otherwise(F.lit("SKIP")).alias("reply"))
    assert [(r.id, r.comment) for r in commentary.cleaned(df.withColumn("annotator", F.lit("levon ARONIAN, ")).withColumn("black_player", F.lit("Levon Aronian")), model).collect()] == [(1, "Black and White move.")]
    m = commentary.cleaning_messages(df.withColumn("annotator", F.col("white_player"))).where("id = 1").first().messages
    assert [x.role for x in m] == ["system", "user", "assistant", "user", "assistant", "user"] and "player of White" in m[0].content and m[-1].content.startswith("Comment: 12 Nf6!")
    items = spark.createDataFrame([(1, "The knight on e5 dominates the board.", "", None, None, None, None), (2, "life is long and full of the knight on e5 things", None, None, None, None, None), (3, "x", "The rook on a1 defends against mate.", None, None, None, None), (4, None, None, None, None, None, None)], ITEMS)
    assert sorted(r.id for r in commentary.judged(items).collect()) == [1, 3]
    labels = lambda m: m.select("id", F.when(F.col("id") == 3, F.lit("I say keep it")).otherwise(F.lit("no idea")).alias("reply"))
    assert [r.id for r in commentary.judged(items, labels).collect()] == [3] and commentary.judged(items.limit(0), labels).count() == 0
