"""Model calls as a source: prompts in, answered results out, with an injected client.

A client is built once in each task by a factory and called for one prompt after the other;
partitions are the workers. Every attempt is recorded with its class, what followed it and
how long was waited. The limiter belongs to a task: each of n tasks takes its n-th part of
the rate. Replies can be recorded and replayed, so runs are repeatable without a network.

Defined results: a client that fails for good gives a row with the error as its response; a
null prompt is not sent and gives an empty response; rows are written as they come, so a
task that is lost is taken up again without those that were written.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gambitflow.functions import calls, text

CALL = "call_id string, response string, thinking_content string, thinking_source string, usage string, raw_message string, provider_meta string, latency_ms long, ok boolean, attempts array<struct<attempt_no:int,started_at:string,duration_ms:bigint,http_status:int,error_class:string,billed_risk:int,retry_after_s:double,wait_s:double,outcome:string>>"


@dataclass
class Reply:
    """What a client returns: a status, the body of a success, the header of a refusal."""

    status: int | None = 200
    body: dict = field(default_factory=dict)
    retry_after: float | None = None
    failure: str | None = None  # timeout, connection, parse or another kind


class Limiter:
    """Token bucket with a gate that a penalty closes; clock and sleep can be replaced."""

    def __init__(self, rate: float, burst: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.clock, self.sleep = max(rate, 0.01), max(burst, 1), clock, sleep
        self.tokens, self.seen, self.opens = float(self.burst), clock(), 0.0

    def acquire(self) -> float:
        """Wait for a token; returns how long it took."""
        waited = 0.0
        while True:
            now = self.clock()
            self.tokens, self.seen = min(self.burst, self.tokens + (now - self.seen) * self.rate), now
            lacking = max(self.opens - now, (1 - self.tokens) / self.rate if self.tokens < 1 else 0.0)
            if lacking <= 1e-9:
                self.tokens -= 1
                return waited
            self.sleep(lacking)
            waited += lacking

    def penalize(self, seconds: float) -> None:
        self.opens = max(self.opens, self.clock() + max(seconds, 0.0))


def _verdict(reply: Reply) -> tuple[str, bool, bool]:
    """error_class, retriable, billed_risk: the rule of functions.calls.attempt_class."""
    s = reply.status
    if s is None or reply.failure:
        return {"timeout": ("timeout", True, True), "connection": ("connection", True, False), "parse": ("parse", False, True), "stream_drop": ("stream_drop", True, True)}.get(reply.failure, ("unknown", True, True))
    if 200 <= s < 300:
        return "ok", False, True
    if s == 429:
        return "http_429", True, False
    if 400 <= s < 500:
        return "http_4xx", False, False
    return ("http_5xx", True, False) if s in calls.CHEAP else ("http_5xx", True, True)


def converse(client: Callable[[str], Reply], prompt: str, limiter: Limiter | None = None, most: int = 4, jitter: Callable[[], float] = random.random, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic, now: Callable[[], str] | None = None) -> tuple[dict | None, list[dict], str]:
    """(body, attempts, error): calls with retries until one succeeds or nothing is left to try."""
    stamp = now or (lambda: time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()))
    attempts: list[dict] = []
    for no in range(1, most + 1):
        if limiter:
            limiter.acquire()
        row = {"attempt_no": no, "started_at": stamp(), "http_status": None, "retry_after_s": None, "wait_s": None}
        begun = clock()
        try:
            reply = client(prompt)
        except Exception as e:  # a client may fail in any way; the kind decides
            kinds = ((TimeoutError, "timeout"), (ConnectionError, "connection"), ((ValueError, KeyError, TypeError, AttributeError), "parse"))
            reply = Reply(None, failure=next((k for t, k in kinds if isinstance(e, t)), "unknown"))
        kind, again, billed = _verdict(reply)
        row |= {"duration_ms": int((clock() - begun) * 1000), "http_status": reply.status, "error_class": kind, "billed_risk": int(billed)}
        attempts.append(row)
        if kind == "ok":
            row["outcome"] = "success"
            return reply.body, attempts, ""
        retry = again and no < (calls.COSTLY_ATTEMPTS if billed else most)
        row["retry_after_s"] = reply.retry_after
        row["outcome"] = "retried" if retry else "gave_up" if again else "fatal"
        if not retry:
            return None, attempts, kind
        wait = min(reply.retry_after, calls.LONGEST_ASKED) if reply.retry_after is not None else jitter() * min(calls.LONGEST_WAIT, 2.0**no)
        row["wait_s"] = wait
        if limiter and kind == "http_429":
            limiter.penalize(wait)
        sleep(wait)
    return None, attempts, kind


def model_calls(prompts: DataFrame, factory: Callable[[], Callable[[str], Reply]], rate: float = 2.0, burst: int = 4, most: int = 4, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """call_id, prompt -> CALL. The rate is that of the whole run; tasks share it evenly."""
    tasks = max(1, prompts.sparkSession.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = factory()
        limiter = Limiter(rate / tasks, max(1, burst // tasks), sleep=sleep)
        for b in batches:
            rows = []
            for i, prompt in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                begun = time.monotonic()
                body, attempts, error = converse(client, prompt, limiter, most, sleep=sleep) if prompt is not None else ({}, [], "")
                message = ((body or {}).get("choices") or [{}])[0].get("message") or ((body or {}) if "content" in (body or {}) else {})
                rows.append({"call_id": i, "response": f"ERROR {error}" if body is None else None, "message": json.dumps(message), "usage": json.dumps((body or {}).get("usage") or {}), "meta": json.dumps({k: body[k] for k in ("id", "model", "provider", "created") if body.get(k)}) if body else "{}", "ms": int((time.monotonic() - begun) * 1000), "ok": body is not None, "attempts": attempts})
            yield pa.RecordBatch.from_pylist(rows, _RAW)

    schema = "call_id string, response string, message string, usage string, meta string, ms long, ok boolean, attempts " + CALL.split(" attempts ")[1]
    raw = prompts.select(F.col("call_id").cast("string").alias("call_id"), "prompt").mapInArrow(run, schema)
    trace = calls.thinking(F.col("message"))
    content = F.coalesce("response", F.regexp_replace(F.coalesce(F.get_json_object("message", "$.content"), F.lit("")), r"\A\s+|\s+\z", ""))
    return raw.select("call_id", content.alias("response"), trace["content"].alias("thinking_content"), trace["source"].alias("thinking_source"), "usage", F.col("message").alias("raw_message"), F.col("meta").alias("provider_meta"), F.col("ms").alias("latency_ms"), "ok", "attempts")


_ATTEMPT = pa.struct([("attempt_no", pa.int32()), ("started_at", pa.string()), ("duration_ms", pa.int64()), ("http_status", pa.int32()), ("error_class", pa.string()), ("billed_risk", pa.int32()), ("retry_after_s", pa.float64()), ("wait_s", pa.float64()), ("outcome", pa.string())])
_RAW = pa.schema([("call_id", pa.string()), ("response", pa.string()), ("message", pa.string()), ("usage", pa.string()), ("meta", pa.string()), ("ms", pa.int64()), ("ok", pa.bool_()), ("attempts", pa.list_(_ATTEMPT))])


def replay(recorded: dict[str, list[Reply]]) -> Callable[[], Callable[[str], Reply]]:
    """Factory of a client that gives the recorded replies of a prompt in order, the last one
    again when they are used up; an unknown prompt is a lasting error."""

    def make() -> Callable[[str], Reply]:
        at: dict[str, int] = {}

        def call(prompt: str) -> Reply:
            replies = recorded.get(prompt)
            if not replies:
                return Reply(404)
            n = at.get(prompt, 0)
            at[prompt] = n + 1
            return replies[min(n, len(replies) - 1)]

        return call

    return make


def answered(tasks: DataFrame, factory: Callable[[], Callable[[str], Reply]], max_tokens: int = 8192, group: int = 1, **options) -> DataFrame:
    """Tasks with their prompt, call, extracted answer and grade: one result line each."""
    asked = tasks.withColumn("prompt", text.resolve_prompt(F.col("question"), F.col("format_examples"), group))
    done = model_calls(asked.select(F.col("task_id").alias("call_id"), "prompt"), factory, **options)
    joined = asked.join(done, asked.task_id == done.call_id).drop("call_id")
    x = joined.withColumn("_x", text.extract_answer(F.col("response")))
    used = F.coalesce(F.get_json_object("usage", "$.completion_tokens").try_cast("long"), F.lit(0))
    error = text.grade(F.col("_x.answer"), F.col("correct_answer"), F.col("answer_type"), F.col("_x.ok"), used, F.lit(max_tokens))
    call_columns = ["prompt", "response", "thinking_content", "thinking_source"]
    graded = x.withColumn("_error", error)
    return graded.select(*tasks.columns, F.struct(*call_columns, F.col("_x.answer").alias("extracted"), F.col("_x.ok").alias("extraction_successful"), (F.col("_error") == "correct").alias("is_correct"), F.col("_error").alias("error_type"), "usage", "raw_message", "provider_meta", "attempts", "latency_ms").alias("inference"))


def permitted(requests: DataFrame, rate: float, burst: int, key: str = "run_key") -> DataFrame:
    """When a token bucket would have let each request of a key through: adds `allowed_at` and
    `waited_s`. requests: key, seq, at_s (seconds). The bucket of a key is replayed in the
    order of time; keys are independent, and each holds the requests of one run."""
    import pandas as pd

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at_s", "seq"])
        clock = [float(pdf["at_s"].iloc[0])]
        limiter = Limiter(rate, burst, clock=lambda: clock[0], sleep=lambda s: clock.__setitem__(0, clock[0] + s))
        out = []
        for at in pdf["at_s"]:
            clock[0] = max(clock[0], float(at))
            limiter.acquire()
            out.append(clock[0])
        return pdf.assign(allowed_at=[round(x, 6) for x in out], waited_s=[round(x - float(a), 6) for x, a in zip(out, pdf["at_s"], strict=True)])[[key, "seq", "at_s", "allowed_at", "waited_s"]]

    return requests.select(key, F.col("seq").cast("long").alias("seq"), F.col("at_s").cast("double").alias("at_s")).where("at_s is not null").groupBy(key).applyInPandas(run, f"{key} string, seq long, at_s double, allowed_at double, waited_s double")


def retry_chains(attempts: DataFrame, by: list[str]) -> DataFrame:
    """Per task: tries, whether one succeeded, seconds waited and attempts that may have been
    billed in vain. attempts: by, attempt_no, outcome, billed_risk, wait_s."""
    order = Window.partitionBy(*by).orderBy("attempt_no")
    last = attempts.withColumn("_last", F.last("outcome").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    good = F.col("outcome") == "success"
    return last.groupBy(*by).agg(F.count("*").alias("tries"), F.bool_or(good).alias("succeeded"), F.first("_last").alias("ended"), F.round(F.sum(F.coalesce("wait_s", F.lit(0.0))), 6).alias("waited_s"), F.count_if(~good & (F.col("billed_risk") == 1)).alias("billed_in_vain"))


def mirror(stream: DataFrame, write: Callable[[DataFrame], None], checkpoint: str, trigger: str | None = None):
    """Write every micro-batch of results by `write` (for instance an upsert), at least once;
    `write` must therefore do no harm when it is repeated. Returns the running query."""
    q = stream.writeStream.foreachBatch(lambda df, _: write(df)).option("checkpointLocation", checkpoint)
    return (q.trigger(processingTime=trigger) if trigger else q.trigger(availableNow=True)).start()


def guarded(work: Callable[[], object], on_abort: Callable[[str], None]) -> object:
    """Run a job; when it is interrupted or fails, the caller's mark is set before the error
    goes on."""
    try:
        return work()
    except KeyboardInterrupt:
        on_abort("aborted")
        raise
    except Exception:
        on_abort("failed")
        raise
