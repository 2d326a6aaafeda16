"""Model event streams: ordered events of an attempt folded to one message.

`fold` is the rule; `folded` applies it to stored events, `folded_stream` to a stream with
a state per attempt. An event is the text of one line; comments and lines without data are
ignored. A message counts as complete only with positive evidence: usage or a finish
reason, not the mere end of the stream. A stream that broke off tells how much had come.

Defined results: a null line or one without data changes nothing; nothing behind the end mark
counts; lines of one seq beyond the first are ignored in a stream.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "attempt_key string, content string, reasoning string, finish_reason string, usage string, chunks int, complete boolean, error string, first_ms long, ttft_ms long, content_chars int, reasoning_chars int"


def start() -> dict:
    return {"content": "", "reasoning": [], "finish": None, "usage": None, "chunks": 0, "done": False, "error": None, "first": None, "begun": None}


def merge_fragments(parts: list[dict], new: list[dict]) -> list[dict]:
    """Fragments with an index go on at that index, others at the last one of their type;
    texts are joined, other keys take the last value."""
    for f in new:
        index, kind = f.get("index"), f.get("type")
        at = next((p for p in reversed(parts) if (p.get("index") == index if index is not None else p.get("type") == kind)), None)
        if at is None or (index is None and parts and parts[-1] is not at):
            at = {}
            parts.append(at)
        for k, v in f.items():
            at[k] = at.get(k, "") + v if k in ("text", "summary", "data") and isinstance(v, str) and isinstance(at.get(k, ""), str) else v
    return parts


def fold(state: dict, line: str, ms: int | None = None) -> dict:
    """One line into the state; nothing after the end mark counts."""
    if state["begun"] is None:
        state["begun"] = ms
    if state["done"] or not line or not line.startswith("data:"):
        return state
    body = line[5:].strip()
    if body == "[DONE]":
        state["done"] = True
        return state
    try:
        event = json.loads(body)
    except ValueError:
        state["error"] = state["error"] or "unreadable event"
        return state
    if not isinstance(event, dict):
        return state
    if event.get("error"):
        state["error"], state["done"] = json.dumps(event["error"], sort_keys=True), True
        return state
    if event.get("usage") and event.get("type") != "message_delta":
        state["usage"] = {**(state["usage"] or {}), **event["usage"]}
    for choice in event.get("choices") or []:
        delta = choice.get("delta") or {}
        if delta.get("content") or delta.get("reasoning_details") or delta.get("reasoning"):
            state["chunks"] += 1
            state["first"] = ms if state["first"] is None else state["first"]
        state["content"] += delta.get("content") or ""
        if delta.get("reasoning_details"):
            merge_fragments(state["reasoning"], delta["reasoning_details"])
        elif delta.get("reasoning"):
            merge_fragments(state["reasoning"], [{"type": "text", "text": delta["reasoning"]}])
        state["finish"] = choice.get("finish_reason") or state["finish"]
    kind = event.get("type")
    begun = event.get("message") if kind == "message_start" else None
    if isinstance(begun, dict) and begun.get("usage"):
        # the start event tells the input tokens; later ones add to them
        state["native"] = {**begun["usage"], **(state.get("native") or {})}
    if kind == "content_block_delta":
        d = event.get("delta") or {}
        state["chunks"] += 1
        state["first"] = ms if state["first"] is None else state["first"]
        state["content"] += d.get("text") or ""
        if d.get("thinking"):
            merge_fragments(state["reasoning"], [{"index": event.get("index"), "type": "thinking", "text": d["thinking"]}])
    elif kind == "message_delta":
        state["native"] = {**(state.get("native") or {}), **(event.get("usage") or {})}
        state["finish"] = (event.get("delta") or {}).get("stop_reason") or state["finish"]
    elif kind == "message_stop":
        state["finish"] = state["finish"] or "stop"
        state["done"] = True
    return state


def row_of(key: str, s: dict) -> dict:
    """The row of an attempt. Usage of a native start event alone is no evidence of an end."""
    usage = s["usage"] if not s.get("native") else {**s["native"], **(s["usage"] or {})}
    complete = s["error"] is None and (s["usage"] is not None or s["finish"] is not None)
    reasoning = "\n".join(p.get("text") or p.get("summary") or "" for p in s["reasoning"])
    ttft = None if s["first"] is None or s["begun"] is None else s["first"] - s["begun"]
    return {
        "attempt_key": key, "content": s["content"], "reasoning": reasoning or None, "finish_reason": s["finish"], "usage": None if usage is None else json.dumps(usage, sort_keys=True), "chunks": s["chunks"], "complete": complete,
        "error": s["error"], "first_ms": s["first"], "ttft_ms": ttft, "content_chars": len(s["content"]), "reasoning_chars": sum(len(p.get("text") or p.get("summary") or "") for p in s["reasoning"]),
    }


def _frame(key: str, state: dict) -> pd.DataFrame:
    return pd.DataFrame([row_of(key, state)]).astype({"first_ms": "Int64", "ttft_ms": "Int64"})


def folded(events: DataFrame) -> DataFrame:
    """events: attempt_key, seq, ms, line -> one row per attempt. Events of one attempt are
    ordered inside its task; an attempt is one message, bounded by the model's token limit.
    ttft_ms counts from the first event, so the first one should be the request."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        state = start()
        for line, ms in pdf.sort_values("seq")[["line", "ms"]].itertuples(index=False):
            fold(state, line, None if pd.isna(ms) else int(ms))
        return _frame(key[0], state)

    return events.groupBy("attempt_key").applyInPandas(run, OUT)


def folded_stream(events: DataFrame, timeout: str = "10 minutes", first_seq: int = 0) -> DataFrame:
    """The same over a stream with event time `ts`: an attempt is emitted once, when its end
    mark or an error comes, or as it is when the watermark passes its time-out.

    seq numbers the lines of an attempt without gaps from `first_seq`. A line that comes
    before its turn, within a micro-batch or across several, is held until the gap is closed
    or the time-out comes. After the end the state stays until the time-out, so late and
    repeated lines start no second row."""
    minutes = int(timeout.split()[0]) * 60_000

    def advance(now: dict) -> None:
        while (step := now["held"].pop(str(now["next"]), None)) is not None:
            fold(now["fold"], step[0], step[1])
            now["next"] += 1

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else {"fold": start(), "next": first_seq, "held": {}, "told": False}
        if state.hasTimedOut:
            state.remove()
            if not now["told"]:
                for k in sorted(now["held"], key=int):  # the gap was never closed
                    fold(now["fold"], *now["held"][k])
                yield _frame(key[0], now["fold"])
            return
        last = 0
        for pdf in pdfs:
            for seq, line, ms, ts in pdf[["seq", "line", "ms", "ts"]].itertuples(index=False):
                last = max(last, int(pd.Timestamp(ts).timestamp() * 1000))
                if not now["told"] and int(seq) >= now["next"]:
                    now["held"].setdefault(str(int(seq)), [line, None if pd.isna(ms) else int(ms)])
        advance(now)
        if now["fold"]["done"] and not now["told"]:
            row = _frame(key[0], now["fold"])
            now = {"fold": start(), "next": now["next"], "held": {}, "told": True}
            yield row
        state.update((json.dumps(now),))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + minutes)

    return events.withWatermark("ts", timeout).groupBy("attempt_key").applyInPandasWithState(run, OUT, "state string", "append", "EventTimeTimeout")


def counters(events: DataFrame, seconds: int = 2) -> DataFrame:
    """Lines and characters per tick; the same plan for stored events and streams."""
    return events.groupBy(F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("characters")).select(F.col("w.start").alias("tick"), "n", "characters")


def first_copies(messages: DataFrame, key: list[str], delay: str = "1 hour") -> DataFrame:
    """A stream of messages delivered at least once, each once; state is kept for `delay`."""
    return messages.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)
