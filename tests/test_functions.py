"""Column functions on literal cases."""

import json
import re

import pytest
from pyspark.sql import functions as F

from gambitflow.functions import primitives, text
from gambitflow.operators import geometry, sampling, similarity, stats, warehouse


def run(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"n int, v {kind}").select("n", f(F.col("v")).alias("out")).orderBy("n").collect()
    return [r.out for r in rows]


def test_extract_answer(spark):
    cases = {
        "FINAL ANSWER: e4": ("e4", True), "final answer:  **Nf3**  \nmore": ("Nf3", True), "FINAL ANSWER: a\nFINAL ANSWER: b": ("b", True), "FINAL ANSWER:   \n": ("", True),
        "The final answer is $\\boxed{ c7 }$": ("c7", True), "the  final answer is \\boxed{x} The final answer is \\boxed{y}": ("y", True), "So e4.": ("", False), "": ("", False), None: ("", False),
        "FINAL ANSWER: FINAL ANSWER: d5": ("d5", True), "FINAL ANSWER:  e5 ": ("e5", True), "FINAL ANSWER:\n\ne4\nx": ("e4", True),
    }
    assert [(r.answer, r.ok) for r in run(spark, list(cases), text.extract_answer)] == list(cases.values())


def test_grade(spark):
    rows = [("a, B", "b,a", "multi", True, 10, 100), ("a,b,c", "a,b", "multi", True, 10, 100), ("a", "a,b", "multi", True, 10, 100), ("c", "a,b", "multi", True, 10, 100), (" E4 ", "e4", "single", True, None, 100),
            ("e5", "e4", "single", True, 0, None), ("", "e4", "single", False, 0, 100), ("e4", "e4", "single", True, 98, 100), (None, None, None, None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, c string, k string, ok boolean, u long, m long")
    got = [r.e for r in df.select("i", text.grade(F.col("a"), F.col("c"), F.col("k"), F.col("ok"), F.col("u"), F.col("m")).alias("e")).orderBy("i").collect()]
    assert got == ["correct", "multi_extra_items", "multi_missing_items", "multi_false_items", "correct", "wrong_answer", "format_error", "max_token_reached", "format_error"]


def test_prompt_and_input(spark):
    df = spark.createDataFrame([("CONTEXT_PLACEHOLDERPick FORMAT_EXAMPLE_PLACEHOLDER.", ["e2e4", "d2d4"]), ("Pick FORMAT_EXAMPLE_PLACEHOLDER.", ["x"]), ("FORMAT_EXAMPLE_PLACEHOLDER", None), (None, [])], "q string, ex array<string>")
    assert [r.p for r in df.select(text.resolve_prompt(F.col("q"), F.col("ex"), 2).alias("p")).collect()] == ["Pick d2d4.", "Pick x.", "FORMAT_EXAMPLE_PLACEHOLDER", None]
    got = run(spark, ["F w - | d1b3  f8e7", "F", None, ""], text.split_input)
    assert [(r.fen, list(r.moves)) for r in got] == [("F w -", ["d1b3", "f8e7"]), ("F", []), ("", []), ("", [])]


def test_names(spark):
    df = spark.createDataFrame([("a_b-thinking-piecearr-fmt2", "a/b", 1), ("a_b-verbose-cot", "a/b", 0), ("a_b", "a/b", 0)], "k string, m string, t int")
    r = df.select(text.display_name(F.col("k"), F.col("m"), F.col("t")).alias("d"), text.run_meta(F.col("k")).alias("x")).collect()
    assert [x.d for x in r] == ["b (thinking)", "b (verbose CoT)", "b (no thinking)"]
    assert tuple(r[0].x) == ("a/b", 1, 1, 2)
    assert [(p.first, p.last) for p in run(spark, ["Aronian, Levon", "Levon  Aronian", "Levon", "Aronian, Levon G.", "Levon/G. Aronian", None, " "], text.name_parts)] == [("Levon", "Aronian"), ("Levon", "Aronian"), ("Levon", "Levon"), ("Levon", "Aronian"), ("Levon", "Aronian"), ("", ""), ("", "")]


def test_commentary(spark):
    assert run(spark, ["12...Nf6! [%csl Ra1] is $4 good", "1. e4 wins. 14", "(3... Nc6)", None], text.strip_notation) == ["12 Nf6! is good", "1 e4 wins.", "(3 Nc6)", None]
    assert run(spark, ["So Sokolov and so", "nothing"], lambda c: text.replace_aliases(c, F.array(F.lit("So"), F.lit("")), "White")) == ["White Sokolov and White", "nothing"]
    assert run(spark, ["I'm sure my rook beats me; I win"], lambda c: text.replace_first_person(c, "Black")) == ["Black is sure Black's rook beats Black; Black win"]
    assert run(spark, ["<think>x</think>Cleaned: a  b", 'He said "one" and "two"', "```\nskip\n```", None, "", "'q'"], text.clean_model_text) == ["a b", "two", "SKIP", "SKIP", "SKIP", "q"]
    assert run(spark, ["White plays Nf3 with a strong pin.", "short Nf3", "In general the knight is better here.", "There is nothing in this long comment at all", None], text.relevant) == [True, False, False, False, False]
    assert run(spark, ["a1​  x", "e4 "], text.plain_symbols) == ["Qa1  x", "e4 "]
    assert run(spark, [" e4 "], lambda c: text.plain_symbols(c, pawn=True)) == ["Pe4"]
    assert run(spark, ["The passed pawn; rook", "pawns"], lambda c: text.keywords_in(c, ["rook", "passed pawn", "pawn"])) == [["passed pawn", "pawn", "rook"], []]
    assert run(spark, ["keep it", "no", None, "drop or keep"], text.keep_or_drop) == ["KEEP", "DROP", "DROP", "DROP"]


def test_strip_notation_cases(spark):
    cases = {
        "12...Nf6 13.e4 14... x": "12 Nf6 13 e4 14 x", "a 5.": "a", "see 5., then": "see , then", "(14.) (15. Nf3) (16.": "() (15 Nf3) (", "x...y": "x y", "at 7...": "at 7", "3 .. 4 5.. b": "3 .. 4 5.. b", "2.5 and 10.c": "2.5 and 10 c", "won! 31": "won!", "so (a) 31": "so (a)",
        "no 31": "no 31", "9...0-0 9.0-0": "9 0-0 9.0-0", "\ue123x \ue025": "x", "...e5": "e5", "$1$22": "", "": "", "1.e4": "1 e4", "v1.Nf3": "v1 Nf3", "5.": "", "7. ": "7",
    }
    assert dict(zip(cases, run(spark, list(cases), text.strip_notation), strict=True)) == cases


def test_names_and_first_person(spark):
    assert sorted(run(spark, ["So, Wesley"], text.aliases)[0]) == ["So", "So, Wesley", "Wesley"] and run(spark, [None, ""], text.aliases) == [[], []]
    side = lambda c: text.annotator_side(c, F.lit("Steinitz, William"), F.lit("Blackburne"))
    assert run(spark, ["STEINITZ William", "Blackburne.", "Someone", "", None, "12"], side) == ["White", "Black", None, None, None, None]
    assert run(spark, ["I'd've said: MINE, i'll (myself) Imine I'm", "no"], lambda c: text.replace_first_person(c, "White")) == ["White would've said: White's, White will (White) Imine White is", "no"]
    assert run(spark, ["I win"], lambda c: text.replace_first_person(c, F.lit(None).cast("string"))) == ["I win"]
    assert run(spark, ["Output : x", "a\n`b`", "<think>never closed", "say <THINK>a</think>it\n\nnow", "Result\uff1a \"q r\"", '""', "note: x"], text.clean_model_text) == ["x", "b", "SKIP", "now", "q r", "SKIP", "note: x"]


def test_strip_notation_against_python(spark):
    cases = ["1.e4 e5 2.Nf3", "see 12... and 13. then", "(14.) x", "a 5.", "x...y", "9...O-O", "9...0-0", "end. 14", "end) 7", "3 .. 4"]
    got = run(spark, cases, text.strip_notation)
    assert all(re.sub(r"\s+", " ", g) == g == g.strip() for g in got)
    assert got[0] == "1 e4 e5 2 Nf3" and got[5] == "9 O-O" and got[7] == "end."


def test_bands(spark):
    assert run(spark, [999, 1000, 1999, 2000, None], text.rating_level, "int") == ["beginner", "intermediate", "advanced", "expert", None]
    assert run(spark, [-450, -350, -349, 50, 51, None], text.eval_band, "int") == ["losing", "losing", None, "neutral", None, None]
    assert run(spark, [100, -1000], lambda c: text.nearest_option(c, F.array(*[F.lit(x) for x in (-400, 0, 200)])), "int") == [0, -400]


@pytest.mark.parametrize(("kind", "answer", "want"), [
    ("short_tactics_x", "e7e8q, A2A4", ("moves", [("e7", "e8", "q"), ("a2", "a4", None)])), ("short_tactics_x", "e7e8q, junk", ("text", None)), ("motifs_pin", "b4>d2>e1", ("chain", [("b4", "d2", None), ("d2", "e1", None)])),
    ("motifs_fork", "d3>c5-f2", ("chain", [("d3", "c5", None), ("d3", "f2", None)])), ("motifs_battery", "b3>e3", ("chain", [("b3", "e3", None)])), ("position_judgement_x", "+200", ("eval", None)), ("semantic_x", "(c)", ("choice", None)),
    ("structural_capture_squares", "a1, b2", ("squares", None)), ("structural_check_detection", "white knight at f6", ("pieces", None)), ("structural_piece_arrangement", "White King: ['e1'], Black Rook: ['a8', 'h8']", ("pieces", None)), ("any", "None", ("none", None)), ("any", None, ("none", None)), ("other", "x", ("text", None)),
])
def test_primitives(spark, kind, answer, want):
    p = spark.createDataFrame([(kind, answer)], "t string, a string").select(primitives.primitive(F.col("t"), F.col("a")).alias("p")).first().p
    assert p.type == want[0] and (want[1] is None or [tuple(x) for x in p.arrows] == want[1])
    if answer == "+200":
        assert p.value == 200
    if answer == "(c)":
        assert p.letter == "C"
    if kind == "structural_piece_arrangement":
        assert [x.square for x in p["items"]] == ["e1", "a8", "h8"]


def test_boards_as_answers(spark):
    a, b = "8/8/8/8/8/8/8/K7 w - - 0 1", "8/8/8/8/8/8/8/1K6 w - - 0 1"
    p = spark.createDataFrame([("structural_state_tracking_mid", a, b), ("structural_state_tracking_mid", "junk", b), ("structural_state_tracking_mid", a, None)], "t string, a string, c string").select(primitives.primitive(F.col("t"), F.col("a"), F.col("c")).alias("p")).collect()
    assert [(r.p.type, r.p.squares, r.p.text) for r in p] == [("fen", ["a1", "b1"], a), ("text", None, "junk"), ("fen", [], a)]


def test_board_difference(spark):
    df = spark.createDataFrame([("8/8/8/8/8/8/8/8", "8/8/8/3P4/8/8/8/R7")], "a string, b string")
    assert df.select(geometry.board_difference(geometry.board_string(F.col("a")), geometry.board_string(F.col("b"))).alias("d")).first().d == ["a1", "d5"]


def test_quotas_match_the_greedy_loop(spark):
    import random

    rng = random.Random(3)
    kinds = ["a", "b", "c"]
    rows = [(k, i, i) for i in range(60) for k in kinds if rng.random() < 0.4]
    got = sorted((r.kind, r.id) for r in sampling.quotas(spark.createDataFrame(rows, "kind string, id long, o long"), kinds, 5, "id", "o").collect())
    left = {k: 5 for k in kinds}
    want = []
    for i in range(60):
        for k in kinds:
            if left[k] and (k, i, i) in rows:
                want.append((k, i))
                left[k] -= 1
                break
    assert got == sorted(want)


def test_neighbours(spark):
    rows = [(i, [float((i * 7 + j * 3) % 11) for j in range(4)] if i != 5 else None) for i in range(40)] + [(200, [1.0, 2.0, 3.0, 4.0]), (201, [0.0] * 4)]
    got = {}
    for r in similarity.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 3).collect():
        got.setdefault(r.vec_id, []).append((r.neighbour, round(r.similarity, 5)))
    import numpy as np

    v = {i: np.array(x) for i, x in rows if x and any(x)}
    for q in (0, 200):
        want = sorted(((-round(float(v[q] @ v[i] / np.linalg.norm(v[q]) / np.linalg.norm(v[i])), 9), i) for i in v if i != q))[:3]
        assert [(i, round(-s, 5)) for s, i in want] == got[q]
    assert similarity.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_sharing_neighbours(spark):
    rows = [("a", ["x", "y"]), ("b", ["y"]), ("c", ["z"]), ("d", None), ("e", ["x", "x", ""]), ("f", [None])]
    got = {r.id: r.n for r in similarity.sharing_neighbours(spark.createDataFrame(rows, "id string, tags array<string>"), "id", "tags", 1).collect()}
    assert got == {"a": 2, "b": 1, "c": 0, "e": 1}


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", "s"), (2, "b", "t"), (None, "n", "u")], "k int, v string, s string")
    new = spark.createDataFrame([(2, "B", None), (3, "C", None), (None, "N", "w")], "k int, v string, s string")
    got = {r.k: (r.v, r.s) for r in warehouse.upsert(old, new, ["k"], coalesce=["s"]).collect()}
    assert got == {1: ("a", "s"), 2: ("B", "t"), 3: ("C", None), None: ("N", "w")}
    again = warehouse.upsert(warehouse.upsert(old, new, ["k"]), new, ["k"])
    assert again.count() == 4
    kids = warehouse.replace_children(spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "p int, c int"), spark.createDataFrame([(1, 9)], "p int, c int"), ["p"])
    assert sorted(map(tuple, kids.collect())) == [(1, 9), (2, 1)]


def test_resume_states(spark):
    res = spark.createDataFrame([(1, "a", "ok", "correct"), (1, "b", "", "format_error"), (1, "c", "ERROR x", None), (1, "d", "", "max_token_reached"), (1, "zz", "ok", "correct")], "run_id long, task_id string, response string, error_type string")
    tasks = spark.createDataFrame([(x,) for x in "abcde"], "task_id string")
    runs = spark.createDataFrame([(1,), (2,)], "run_id long")
    got = {(r.run_id, r.state): r.n for r in stats.resume_split(tasks, res, runs).collect()}
    assert got == {(1, "complete"): 2, (1, "again"): 2, (1, "new"): 1, (2, "complete"): 0, (2, "again"): 0, (2, "new"): 5}
    assert [r.complete for r in stats.completed(res, retry_capped=True).orderBy("task_id").collect()] == [True, False, False, False, True]


def test_numbered_ids(spark):
    df = spark.createDataFrame([("k", i) for i in range(3)], "kind string, i int")
    assert [r.numbered_id for r in sampling.numbered(df, "kind", ["i"]).orderBy("i").collect()] == ["k_0000", "k_0001", "k_0002"]
    assert json.dumps(1) == "1"
