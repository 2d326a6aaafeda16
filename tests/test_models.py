"""Model calls by replay, limiter, retries and event streams out of order."""

import json

import pytest
from pyspark.sql import functions as F

from gambitflow.streaming import events, models
from gambitflow.streaming.models import Reply


def body(text, tokens=5, **message):
    return {"choices": [{"message": {"content": text, **message}}], "usage": {"completion_tokens": tokens, "prompt_tokens": 1}, "id": "g1", "other": 2}


def test_limiter():
    clock, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        clock[0] += s

    limiter = models.Limiter(2.0, 2, clock=lambda: clock[0], sleep=sleep)
    assert [round(limiter.acquire(), 6) for _ in range(4)] == [0.0, 0.0, 0.5, 0.5]
    limiter.penalize(5)
    limiter.penalize(1)  # a shorter penalty does not shorten a longer one
    assert round(limiter.acquire(), 6) == 5.0
    clock[0] += 100  # the bucket holds no more than the burst
    assert [round(limiter.acquire(), 6) for _ in range(3)] == [0.0, 0.0, 0.5]


@pytest.mark.parametrize(("replies", "outcomes", "error"), [
    ([Reply(429, retry_after=7.0), Reply(body=body("x"))], ["retried", "success"], ""),
    ([Reply(500), Reply(500), Reply(body=body("x"))], ["retried", "gave_up"], "http_5xx"),
    ([Reply(503)] * 5, ["retried", "retried", "retried", "gave_up"], "http_5xx"),
    ([Reply(401)], ["fatal"], "http_4xx"),
    ([Reply(None, failure="connection"), Reply(None, failure="timeout"), Reply()], ["retried", "gave_up"], "timeout"),
    ([Reply(200, failure="parse")], ["fatal"], "parse"),
])
def test_retries(replies, outcomes, error):
    waits = []
    client = models.replay({"p": replies})()
    got, attempts, why = models.converse(client, "p", jitter=lambda: 1.0, sleep=waits.append, clock=lambda: 0.0, now=lambda: "t")
    assert [a["outcome"] for a in attempts] == outcomes and why == error and (got is None) == bool(error)
    assert waits == [a["wait_s"] for a in attempts if a["outcome"] == "retried"] and (replies[0].retry_after is None or waits[0] == 7.0)


def test_answered_tasks(spark):
    tasks = spark.createDataFrame([("t1", "Q1", None, "e4", "single", 1), ("t2", "Q2", None, "a, b", "multi", 2), ("t3", "Q3", None, "x", "single", 3), ("t4", None, None, "x", "single", 4)], "task_id string, question string, format_examples array<string>, correct_answer string, answer_type string, prompt_tokens int")
    recorded = {"Q1": [Reply(503), Reply(body=body(" FINAL ANSWER: e4 ", reasoning="thought"))], "Q2": [Reply(body=body("FINAL ANSWER: a", 8100))], "Q3": [Reply(401)]}
    got = {r.task_id: r.inference for r in models.answered(tasks, models.replay(recorded), rate=1e6, burst=1000, sleep=lambda s: None).collect()}
    assert (got["t1"].response, got["t1"].extracted, got["t1"].is_correct, got["t1"].thinking_content, got["t1"].thinking_source) == ("FINAL ANSWER: e4", "e4", True, "thought", "plain")
    assert [a.outcome for a in got["t1"].attempts] == ["retried", "success"] and json.loads(got["t1"].provider_meta) == {"id": "g1"} and json.loads(got["t1"].usage)["completion_tokens"] == 5
    assert got["t2"].error_type == "max_token_reached" and got["t3"].response == "ERROR http_4xx" and got["t4"].response == "" and got["t4"].error_type == "format_error"


def test_permits_and_chains(spark):
    rows = [("r", n, 0.0) for n in range(4)] + [("r", 9, 60.0), ("s", 0, 5.0), (None, 0, 1.0), ("r", 10, None)]
    got = {(r.run_key, r.seq): r.allowed_at for r in models.permitted(spark.createDataFrame(rows, "run_key string, seq int, at_s double"), 2.0, 2).collect()}
    assert got == {("r", 0): 0.0, ("r", 1): 0.0, ("r", 2): 0.5, ("r", 3): 1.0, ("r", 9): 60.0, ("s", 0): 5.0, (None, 0): 1.0}
    a = spark.createDataFrame([("t", 1, "retried", 1, 2.0), ("t", 2, "success", 1, None), ("u", 1, "gave_up", 0, None)], "task string, attempt_no int, outcome string, billed_risk int, wait_s double")
    assert sorted(tuple(r) for r in models.retry_chains(a, ["task"]).collect()) == [("t", 2, True, "success", 2.0, 1), ("u", 1, False, "gave_up", 0.0, 0)]


def _data(x):
    return "data: " + (x if isinstance(x, str) else json.dumps(x))


def test_native_usage_and_drops(spark):
    native = [None, ": hi", _data({"type": "message_start", "message": {"usage": {"input_tokens": 7, "output_tokens": 1}}}), _data({"type": "content_block_delta", "index": 0, "delta": {"thinking": "th"}}), _data({"type": "content_block_delta", "index": 1, "delta": {"text": "answer"}}),
              _data({"type": "message_delta", "delta": {"stop_reason": "end_turn"}, "usage": {"output_tokens": 9}}), _data({"type": "message_stop"}), _data({"type": "content_block_delta", "delta": {"text": "late"}})]
    rows = [("whole", n, 100 + 10 * n, x) for n, x in enumerate(native)] + [("drop", n, 100 + 10 * n, x) for n, x in enumerate(native[:5])]
    got = {r.attempt_key: r for r in events.folded(spark.createDataFrame(rows, "attempt_key string, seq int, ms long, line string")).collect()}
    w, d = got["whole"], got["drop"]
    assert json.loads(w.usage) == {"input_tokens": 7, "output_tokens": 9} and w.complete and w.content == "answer" and w.ttft_ms == 30 and w.finish_reason == "end_turn"
    assert not d.complete and (d.chunks, d.content_chars, d.reasoning_chars) == (2, 6, 2)


def test_stream_keeps_order_across_batches(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "attempt_key string, seq int, ms long, line string, ts timestamp"
    part = lambda t: _data({"choices": [{"delta": {"content": t}}]})

    def put(rows):
        spark.createDataFrame(rows, "attempt_key string, seq int, ms long, line string, t string").selectExpr("attempt_key", "seq", "ms", "line", "cast(t as timestamp) ts").coalesce(1).write.mode("append").parquet(src)

    put([("a", 2, 20, part("c"), "2026-01-01 00:00:02"), ("a", 0, 0, part("a"), "2026-01-01 00:00:00"), ("gap", 1, 5, part("x"), "2026-01-01 00:00:00")])
    q = events.folded_stream(spark.readStream.schema(schema).parquet(src)).writeStream.format("memory").queryName("ordered").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        put([("a", 3, 30, _data("[DONE]"), "2026-01-01 00:00:03"), ("a", 1, 10, part("b"), "2026-01-01 00:00:01")])
        q.processAllAvailable()
        put([("a", 1, 10, part("b"), "2026-01-01 00:00:04"), ("a", 4, 40, part("late"), "2026-01-01 00:00:05")])
        q.processAllAvailable()
        for day in (3, 5):  # moves the watermark beyond every time-out
            put([(f"end{day}", 0, 0, _data("[DONE]"), f"2026-01-0{day} 00:00:00")])
            q.processAllAvailable()
        got = [(r.attempt_key, r.content) for r in spark.table("ordered").collect() if not r.attempt_key.startswith("end")]
    finally:
        q.stop()
    assert sorted(got) == [("a", "abc"), ("gap", "x")]


def test_mirror_and_guard(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    q = models.mirror(spark.readStream.schema("id int, v string").parquet(str(tmp_path / "in")), lambda df: df.withColumn("n", F.lit(1)).write.mode("append").parquet(out), str(tmp_path / "c"))
    q.awaitTermination(60)
    assert spark.read.parquet(out).count() == 2
    marks = []
    with pytest.raises(KeyboardInterrupt):
        models.guarded(lambda: (_ for _ in ()).throw(KeyboardInterrupt()), marks.append)
    assert marks == ["aborted"] and models.guarded(lambda: 5, marks.append) == 5
