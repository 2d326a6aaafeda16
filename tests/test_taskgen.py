"""Task generators, quotas, choices and searches against brute force and literal cases."""

import json
import random

import numpy as np
from pyspark.sql import functions as F

from gambitflow.functions import board, prompts, text
from gambitflow.operators import choices, sampling, similarity, taskgen


def test_quotas_equal_the_greedy_loop(spark):
    rng = random.Random(4)
    kinds = ["k1", "k2", "k3", "k4"]
    for n in (1, 3, 10):
        items = {i: [k for k in kinds if rng.random() < 0.4] for i in range(60)}
        rows = [(i, k, f"{(i * 37) % 101:03d}") for i, ks in items.items() for k in ks]
        got = {(r.kind, r.id) for r in sampling.quotas(spark.createDataFrame(rows, "id int, kind string, o string"), kinds, n, "id", "o").collect()}
        want, count = set(), dict.fromkeys(kinds, 0)
        for i in sorted(items, key=lambda i: (i * 37) % 101):
            for k in kinds:
                if k in items[i] and count[k] < n:
                    count[k] += 1
                    want.add((k, i))
                    break
        assert got == want
    assert sampling.quotas(spark.createDataFrame([], "id string, kind string, o string"), kinds, 3, "id", "o").count() == 0


def test_position_tasks(spark):
    fens = ["4k3/8/8/8/8/8/4R3/4K3 b - - 0 1", "no position", None, "4k3/4n3/8/8/8/8/4R3/4K3 b - - 0 1", "r3k3/8/8/8/8/8/8/R3K2R w KQq - 0 1 | e1g1", "8/8/8/8/8/8/8/8 w - - 0 1"]
    rows = spark.createDataFrame([(f"p{n}", f, "x") for n, f in enumerate(fens)], "puzzle_id string, fen string, answer string")
    got = taskgen.structural_tasks(rows, 2).collect()
    assert len({(r.input) for r in got}) == len(got) and {r.task_category for r in got} == {"Structural"}
    one = [r for r in got if r.task_type == "structural_piece_arrangement"]
    assert len(one) == 2 and all(r.task_id.endswith(("_0000", "_0001")) and "CONTEXT_PLACEHOLDER" in r.question and r.input in r.question and r.answer_type == "single" for r in one)
    check = taskgen.position_tasks(rows, [k for k in prompts.STRUCTURAL if k.name == "structural_check_detection"], 5).collect()
    assert [(r.correct_answer, json.loads(r.metadata)) for r in check] == [("White Rook at e2", {"puzzle_id": "p0", "n_checkers": 1})]
    pins = taskgen.motif_tasks(rows, 5).where("task_type = 'motifs_pin'").collect()
    assert [(r.correct_answer, r.format_examples) for r in pins] == [("e2>e7>e8", prompts.LINE_EXAMPLES)]
    drawn = taskgen.position_tasks(rows, [k for k in prompts.STRUCTURAL if k.name in ("structural_legal_move_piece", "structural_control_squares")], 5).collect()
    for r in drawn:
        m = json.loads(r.metadata)
        assert f"{m['target_square']}" in r.question and "{" not in r.question and m.get("n_moves", m.get("n_controlled")) == len(r.correct_answer.split(", "))
        if "legal" in r.task_type:
            p = board.Position.from_fen(r.input)
            assert r.correct_answer.split(", ") == sorted(u for u in map(p.uci, p.legal()) if u.startswith(m["target_square"]))
    assert taskgen.structural_tasks(rows.limit(0), 2).count() == 0
    assert taskgen.motif_tasks(rows, 5, used=spark.createDataFrame([("p3",)], "puzzle_id string")).where("input like '%n3%'").count() == 0


def test_context_is_filled_in(spark):
    rows = [("a", "4k3/8/8/8/8/8/8/K7 w - - 0 1", "Q CONTEXT_PLACEHOLDERx FORMAT_EXAMPLE_PLACEHOLDER", ["1", "2"]), ("b", "none", "CONTEXT_PLACEHOLDERy", None)]
    df = spark.createDataFrame(rows, "task_id string, input string, question string, format_examples array<string>")
    got = {r.task_id: r.prompt for r in taskgen.with_context(df, 2).collect()}
    assert got == {"a": "Q Piece arrangement: White King: ['a1'], Black King: ['e8']\nLegal moves: a1a2, a1b1, a1b2\n\nx 2", "b": "y"}


def test_tactics_and_tracking(spark):
    start = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"
    rows = [(f"z{n}", start, "e2e4 e7e5 g1f3" if n else "e2e4", 500 + 400 * n, 80, 95, "fork pin" if n % 2 else "pin", f"{n:02d}") for n in range(6)]
    df = spark.createDataFrame(rows, "PuzzleId string, FEN string, Moves string, Rating int, RatingDeviation int, Popularity int, Themes string, o string")
    got = {r.task_id: r for r in taskgen.rating_tasks(df, 1).collect()}
    # z0 takes the place of its level and then has no second move
    assert set(got) == {"short_tactics_rating_intermediate_0000", "short_tactics_rating_advanced_0000", "short_tactics_rating_expert_0000"}
    r = got["short_tactics_rating_expert_0000"]
    assert r.correct_answer == "e7e5" and r.input.startswith("rnbqkbnr/pppppppp/8/8/4P3") and json.loads(r.metadata)["pv_length"] == 3
    themes = taskgen.theme_tasks(df, ["pin", "fork"], 2, used=df.where("PuzzleId = 'z1'")).collect()
    assert sorted((t.task_id, json.loads(t.metadata)["puzzle_id"], json.loads(t.metadata)["primary_theme"]) for t in themes) == [("short_tactics_theme_fork_0000", "z3", "fork"), ("short_tactics_theme_fork_0001", "z5", "fork"), ("short_tactics_theme_pin_0001", "z2", "pin")]
    moves = (["g1f3", "g8f6", "f3g1", "f6g8"] * 12)[:46]
    plies, fen = [], start
    for m in moves:
        fen, _ = board.apply_moves(fen, [m])
        plies.append((m, fen))
    games = spark.createDataFrame([(f"g{n}", plies[:k]) for n, k in enumerate((46, 46, 46, 33, 20))], "game_id string, plies array<struct<uci:string,fen_after:string>>")
    got = taskgen.tracking_tasks(games, 1).collect()
    assert sorted(r.task_type.rsplit("_", 1)[1] for r in got) == ["long", "mid", "short"] and len({json.loads(r.metadata)["game_id"] for r in got}) == 3
    for r in got:
        m = json.loads(r.metadata)
        a, b = taskgen.TRACKED[r.task_type.rsplit("_", 1)[1]]
        assert a <= m["track_length"] <= b and r.correct_answer == plies[29 + m["track_length"]][1] and r.input == f"{plies[29][1]} | {' '.join(m['moves_uci'])}"


def test_judgement_tasks(spark):
    rows = [("8/8/8/8/8/8/8/8 w - - 0 1", 9, 5, 210, "l"), ("8/8/8/8/8/8/8/8 w - - 7 9", 3, 5, -400, "l"), ("k7/8/8/8/8/8/8/8 w - -", 1, 1, 120, "l"), ("K7/8/8/8/8/8/8/8 w - -", 1, 1, -30, None)]
    got = {r.task_type: r for r in taskgen.judgement_tasks(spark.createDataFrame(rows, "fen string, depth int, knodes long, cp int, line string"), 5).collect()}
    assert {k: v.correct_answer for k, v in got.items()} == {"position_judgement_advantage": "200", "position_judgement_neutral": "0"}
    assert "-400, -200, 0, 200, 400" in got["position_judgement_neutral"].question


ITEMS = "id int, comment string, cleaned_comment string, keywords array<string>, move_piece string, move_number string, fen_before string, fen_after string, move_uci string, side_to_move string, n int"


def test_choices(spark):
    rng = random.Random(6)
    rows = [(n, f"comment {n // 2}", " " if n % 3 else f"clean {n}", rng.sample(["fork", "pin", "mate", " Fork "], 2) if n % 5 else None, rng.choice(["rook", "Rook", None]), str(n), "fen", None, "e2e4", "white", n) for n in range(60)]
    rows.append((99, None, None, None, None, None, None, None, None, None, 1))
    items = choices.prepared(spark.createDataFrame(rows, ITEMS), "id")
    assert items.count() == 60
    texts = {r.item_id: r.text for r in items.collect()}
    vectors = spark.createDataFrame([(n, [float(x) for x in np.random.default_rng(n).normal(size=6)]) for n in range(60)], "vec_id int, embedding array<double>")
    for strategy in ("easy_random", "keyword", "piece_stage", "embedding"):
        got = choices.choice_tasks(items, strategy, 12, vectors=vectors).collect()
        assert len(got) == 12 and len({r.task_id for r in got}) == 12
        for r in got:
            m = json.loads(r.metadata)
            assert len(set(m["options"])) == 4 and m["options"]["ABCD".index(r.correct_answer)] == m["correct_text"] and f"{r.correct_answer}. {m['correct_text']}\n" in r.question
    # related items come first: the nearest vector's text is always among the options
    base = items.where("item_id < 5")
    opts = {r.item_id: r.opts for r in choices.options(base, items, "embedding", 3, vectors).collect()}
    near = {r.vec_id: r.neighbour for r in similarity.nearest_of(vectors, base.selectExpr("item_id as vec_id"), 1).collect()}
    assert all(texts[near[i]] in opts[i] or texts[near[i]] == texts[i] for i in range(5))
    assert choices.choice_tasks(items.limit(3), "keyword", 5).count() == 0  # too few different texts


def test_vectors_are_embedded_once(spark, tmp_path):
    items = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a")], "item_id int, text string")
    asked = []

    def embed(df):
        asked.append(sorted(r.text for r in df.collect()))
        return df.select("h", F.array(F.length("text").cast("float")).alias("vector"))

    for extra in ([], [(4, "ccc")]):
        got = choices.cached_vectors(items.union(spark.createDataFrame(extra, "item_id int, text string")), f"{tmp_path}/v", "m", embed)
        assert {r.item_id: r.vector[0] for r in got.collect()} == {1: 1.0, 2: 2.0, 3: 1.0} | {i: float(len(t)) for i, t in extra}
    assert asked == [["a", "bb"], ["ccc"]]


def test_bucket_search_has_recall(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 24))
    rows = [(int(n), [float(x) for x in centres[n % 40] + 0.4 * rng.normal(size=24)]) for n in range(1200)] + [(5000, None), (5001, [0.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = {(r.vec_id, r.neighbour) for r in similarity.nearest(df, 5, 20).collect()}
    for block in (4096, 50):  # with and without split buckets
        found = {(r.vec_id, r.neighbour) for r in similarity.nearest_by_buckets(df, 5, 20, block=block).collect()}
        assert len(found & exact) >= 0.9 * len(exact)
    assert similarity.nearest_by_buckets(df.limit(0)).count() == 0


def test_sharing_neighbours_of_large_and_hot_tags(spark):
    rng = random.Random(1)
    rows = [(f"i{n}", ["hot"] * (n % 3 == 0) + rng.sample([f"t{k}" for k in range(30)], rng.choice([0, 1, 3, 12])) + [None, ""]) for n in range(150)]
    got = {r.id: r.n for r in similarity.sharing_neighbours(spark.createDataFrame(rows, "id string, tags array<string>"), "id", "tags", 1).collect()}
    sets = {i: {t for t in ts if t} for i, ts in rows}
    assert got == {i: sum(j != i and bool(s & x) for j, x in sets.items()) for i, s in sets.items() if s}


def test_text_list_is_plain():
    assert "fork" in text.CHESS_WORDS
