"""Readers, sinks and event streams."""

import json

import pytest
import zstandard

from gambitflow.sources import readers, sinks
from gambitflow.streaming import events


def test_puzzles(spark, tmp_path):
    (tmp_path / "p.csv").write_text("PuzzleId,FEN,Moves,Rating,RatingDeviation,Popularity,NbPlays,Themes,GameUrl,OpeningTags\na,f,e2e4 e7e5,1500,80,95,1,fork pin,,\nb,f,e2e4,1500,180,95,1,,,\n")
    df = readers.puzzles(spark, str(tmp_path / "p.csv"))
    assert [r.PuzzleId for r in readers.good_puzzles(df).collect()] == ["a"]


def test_evaluations(spark, tmp_path):
    lines = [
        {"fen": "a", "evals": [{"depth": 5, "knodes": 1, "pvs": [{"cp": 1, "line": "x"}]}, {"depth": 9, "knodes": 2, "pvs": [{"cp": 2, "line": "y"}]}, {"depth": 9, "pvs": [{"cp": 3}]}]},
        {"fen": "b", "evals": [{"depth": 5, "pvs": [{"mate": 3}]}]}, {"fen": "c", "evals": []}, {"fen": "d", "evals": [{"depth": 1, "pvs": []}]}, {"evals": [{"depth": 1, "pvs": [{"cp": 1}]}]},
        {"fen": "e", "evals": [{"depth": 1, "pvs": [{"cp": 7, "mate": None}]}]}, {"fen": "f", "evals": [{"pvs": [{"line": "z"}]}]},
    ]
    text = "\n".join(map(json.dumps, lines)) + "\nnot json\n\n"
    (tmp_path / "e.jsonl.zst").write_bytes(zstandard.compress(text.encode()))
    got = sorted((r.fen, r.depth, r.cp, r.line) for r in readers.evaluations(spark, str(tmp_path / "e.jsonl.zst")).collect())
    assert got == [("a", 9, 2, "y"), ("f", 0, 0, "z")]
    assert readers.evaluations(spark, str(tmp_path / "e.jsonl.zst"), 1).count() == 1


PGN = '[Event "One"]\n[White "A"]\n[Black "B/C"]\n[Round "1"]\n\n1. e4 {a fine rook move indeed, yes} e5 2. Nf3 Nc6 1-0\n\n[Event "Two"]\n[White "D"]\n\n1. d4 d5 *\n'


def test_games(spark, tmp_path):
    (tmp_path / "g.pgn").write_text(PGN)
    df = readers.games(spark, str(tmp_path / "g.pgn"))
    assert sorted(len(r.plies) for r in df.collect()) == [2, 4]
    c = readers.comments(df, ["rook"]).collect()
    assert [(r.game_id, r.ply, r.keywords, r.side) for r in c] == [("One_1_A_B_C", 1, ["rook"], "white")]
    f = readers.fragments(df, 2, 2).collect()
    assert [(r.game_id, list(r.moves)) for r in f] == [("One_1_A_B_C", ["g1f3", "b8c6"])]


def test_tasks_and_results(spark, tmp_path):
    a = {"task_id": "t1", "task_type": "x", "format_examples": ["e"], "metadata": {"k": 1}}
    (tmp_path / "b.jsonl").write_text(json.dumps(a | {"task_id": "t3"}) + "\n")
    (tmp_path / "a.jsonl").write_text(json.dumps(a) + "\n\n" + json.dumps(a | {"task_id": "t2"}) + "\n")
    (tmp_path / "note.txt").write_text("{}")
    df = readers.tasks(spark, str(tmp_path))
    assert [(r.ord, r.task_id, r.file, json.loads(r.metadata)) for r in df.orderBy("ord").collect()] == [(1, "t1", "a.jsonl", {"k": 1}), (2, "t2", "a.jsonl", {"k": 1}), (3, "t3", "b.jsonl", {"k": 1})]
    (tmp_path / "r.json").write_text('{"task_id": "t1", "v": 1}\n{"task_id": "t1", "v": 2}\n\n')
    assert [json.loads(r.line)["v"] for r in readers.results(spark, str(tmp_path / "r.json")).collect()] == [2]
    assert readers.results(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "arr.json").write_text('[{"a": 1}, {"a": 2}]')
    assert readers.json_array(spark, str(tmp_path / "arr.json"), "a int", 1).count() == 1


def test_keywords_and_env(tmp_path):
    (tmp_path / "k.json").write_text('{"pin": {"synonyms": ["nail"]}, "fork": ["double attack"]}')
    assert readers.keyword_list(str(tmp_path / "k.json"), []) == ["double attack", "fork", "nail", "pin"]
    (tmp_path / "k.txt").write_text("# no\npin # yes\n")
    assert readers.keyword_list(str(tmp_path / "k.txt"), ["d"]) == ["pin"]
    assert readers.keyword_list(None, ["d", "ee"]) == ["ee", "d"]
    (tmp_path / ".env").write_text("export A='1'\nB=2\n#C=3\n")
    assert readers.env_file(str(tmp_path / ".env"), {"B": "old"}) == {"B": "old", "A": "1"}


def test_lists_samples_and_reports(spark, tmp_path):
    from gambitflow.operators import ingest, stats

    (tmp_path / "k.json").write_text('["pin", "Fork "]')
    assert readers.keyword_list(str(tmp_path / "k.json"), spark=spark) == ["fork", "pin"] and readers.theme_list(str(tmp_path / "k.json"), spark) == ["Fork ", "pin"]
    assert len(readers.keyword_list(None)) == len(set(readers.KEYWORDS)) and readers.keyword_list(None)[0] == max(readers.KEYWORDS, key=len)
    d = tmp_path / "tasks"
    d.mkdir()
    for f in "ab":
        (d / f"{f}.jsonl").write_text("".join(json.dumps({"task_id": f"{f}{n}", "task_type": f"t{n % 2}"}) + "\n\n" for n in range(40)))
    every = readers.tasks(spark, str(d)).orderBy("ord").collect()
    assert [(r.ord, r.task_id) for r in every] == [(k + 1, f"{'ab'[k // 40]}{k % 40}") for k in range(80)]
    few = readers.tasks(spark, str(d), per_type=3).collect()
    assert len(few) == 6 and readers.tasks(spark, str(d), per_type=3, most=4).count() == 4 and [r.ord for r in readers.tasks(spark, str(d), most=4).collect()] == [1, 2, 3, 4]
    assert sinks.report(spark.createDataFrame([("b", 0.5, None), ("a", 1.0, "x")], "k string, v double, n string"), "k").splitlines() == ["k  v       n", "a  1.0000  x", "b  0.5000"]
    rows = spark.createDataFrame([("g", "correct"), ("g", "wrong"), (None, "correct")], "b string, error_type string")
    assert {(r.b, r.n, r.accuracy) for r in stats.batch_accuracy(rows, "b").collect()} == {("g", 2, 0.5), (None, 1, 1.0)}
    assert ingest.git_commit(str(tmp_path / "none")) is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", None), (1, "ä", "x")], "o int, v string, n string")
    sinks.write_lines(df, str(tmp_path / "out"), "o")
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"v":"ä","n":"x"}', '{"v":"b","n":null}']
    at = str(tmp_path / "t")
    sinks.swap_table(df, at)
    sinks.swap_table(spark.read.parquet(at).where("o = 1"), at)  # reads what it replaces
    assert spark.read.parquet(at).count() == 1
    assert sinks.sorted_json({"b": 1, "a": "ä"}) == '{"a":"ä","b":1}\n'
    sinks.create_warehouse(spark, str(tmp_path / "w"))
    sinks.create_warehouse(spark, str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w/schema_meta")).count() == 1


def _line(x):
    return "data: " + (x if isinstance(x, str) else json.dumps(x))


def _delta(**d):
    return {"choices": [{"delta": d}]}


STREAMS = {
    "full": [": ping", _line(_delta(reasoning_details=[{"type": "reasoning.text", "index": 0, "text": "a"}])), _line(_delta(reasoning_details=[{"type": "reasoning.text", "index": 0, "text": "b"}])), _line(_delta(content="hi")), _line({"choices": [{"delta": {"content": "!"}, "finish_reason": "stop"}]}), _line({"usage": {"t": 1}}), _line("[DONE]"), _line(_delta(content="late"))],
    "cut": [_line(_delta(content="hi"))],
    "forged": [_line("[DONE]")],
    "error": [_line(_delta(content="x")), _line({"error": {"code": 1}}), _line(_delta(content="y"))],
    "usage": [_line(_delta(content="z")), _line({"usage": {"t": 2}})],
    "native": [_line({"type": "content_block_delta", "index": 0, "delta": {"thinking": "m"}}), _line({"type": "content_block_delta", "index": 1, "delta": {"text": "n"}}), _line({"type": "message_stop"})],
}


def test_event_fold(spark):
    rows = [(k, n, 10 * n, x) for k, v in STREAMS.items() for n, x in enumerate(v)]
    got = {r.attempt_key: r for r in events.folded(spark.createDataFrame(rows[::-1], "attempt_key string, seq int, ms long, line string")).collect()}
    assert (got["full"].content, got["full"].reasoning, got["full"].complete, got["full"].first_ms, got["full"].chunks) == ("hi!", "ab", True, 10, 4)
    assert [got[k].complete for k in ("cut", "forged", "error", "usage", "native")] == [False, False, False, True, True]
    assert got["error"].content == "x" and got["native"].reasoning == "m"


@pytest.mark.parametrize("kind", ["fold", "copies"])
def test_streams(spark, tmp_path, kind):
    src = str(tmp_path / "in")
    rows = [(k, n, 10 * n, x, f"2026-01-01 00:00:{n:02d}") for k, v in STREAMS.items() for n, x in enumerate(v)]
    rows.append(("later", 0, 0, _line("[DONE]"), "2026-01-02 00:00:00"))
    schema = "attempt_key string, seq int, ms long, line string, ts timestamp"
    frame = spark.createDataFrame(rows, "attempt_key string, seq int, ms long, line string, t string").selectExpr("attempt_key", "seq", "ms", "line", "cast(t as timestamp) ts")
    frame.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    out = events.folded_stream(stream) if kind == "fold" else events.first_copies(stream, ["attempt_key"])
    q = out.writeStream.format("memory").queryName(f"t_{kind}").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        # a second file moves the watermark on, so attempts without an end time out
        spark.createDataFrame([("end", 0, 0, _line("[DONE]"), "2026-01-03 00:00:00")], "attempt_key string, seq int, ms long, line string, t string").selectExpr("attempt_key", "seq", "ms", "line", "cast(t as timestamp) ts").coalesce(1).write.mode("append").parquet(src)
        q.processAllAvailable()
        got = {r.attempt_key: r for r in spark.table(f"t_{kind}").collect()}
    finally:
        q.stop()
    if kind == "fold":
        assert got["full"].content == "hi!" and got["error"].error and not got["cut"].complete
    else:
        assert set(got) == {*STREAMS, "later", "end"}


def test_counters(spark):
    df = spark.createDataFrame([("a", "2026-01-01 00:00:01"), ("bb", "2026-01-01 00:00:01"), ("c", "2026-01-01 00:00:03")], "line string, t string").selectExpr("line", "cast(t as timestamp) ts")
    assert [(r.n, r.characters) for r in events.counters(df).orderBy("tick").collect()] == [(2, 3), (1, 1)]
