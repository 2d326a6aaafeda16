"""Column functions about model calls: routing, traces, messages, attempts, waiting times.

JSON is read with get_json_object and variants inside the JVM; text that is no JSON gives
nulls or the empty result, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: status codes of attempts that may be repeated at no cost, of those that may
# have been billed, and of lasting errors of the client
CHEAP, COSTLY, FATAL = (429, 502, 503), (500, 504, 524), (400, 401, 402, 403, 404, 405, 413, 422)
#: Attempts where one may have been billed, and longest waiting times in seconds.
COSTLY_ATTEMPTS, LONGEST_WAIT, LONGEST_ASKED = 2, 60.0, 300.0


def adaptive_thinking(model: Column) -> Column:
    """Does a model take the adaptive interface: one vendor's names, version 4.7 or later?
    A version is the text behind the last hyphen; text that is no number is none."""
    version = F.regexp_replace(F.element_at(F.split(model, "-"), -1), "(?<=[0-9])_(?=[0-9])", "").try_cast("double")
    return F.coalesce(model.startswith("anthropic/claude") & (version >= 4.7) & ~F.isnan(version), F.lit(False))


def reasoning_payload(model: Column) -> Column:
    """The reasoning part of a request, as JSON."""
    return F.when(adaptive_thinking(model), F.lit('{"type":"adaptive","display":"summarized"}')).otherwise(F.lit('{"effort":"medium"}'))


def _elements(json: Column, path: str) -> Column:
    """The elements of an array as JSON texts; strings keep their quotes."""
    return F.coalesce(F.from_json(F.get_json_object(json, path), "array<variant>"), F.array().cast("array<variant>"))


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _joined(xs: Column) -> Column:
    return F.array_join(F.filter(xs, lambda x: x.isNotNull() & (x != "")), "\n")


def thinking(message: Column) -> Column:
    """struct(content, source) of a message (JSON): the most faithful trace that it holds.
    Typed text comes before summaries, these before untyped pieces, these before the flat
    field; then what is encrypted, else none. Pieces are joined by line feeds."""
    details = _elements(message, "$.reasoning_details")
    is_object = lambda d: F.schema_of_variant(d).startswith("OBJECT")
    kind = lambda d: _text(d, "$.type")
    typed = lambda k, field: _joined(F.transform(F.filter(details, lambda d: is_object(d) & (kind(d) == k)), lambda d: _text(d, f"$.{field}")))
    # a piece without any type key; bare strings come behind the objects
    bare = F.concat(
        F.transform(F.filter(details, lambda d: is_object(d) & ~F.contains(F.schema_of_variant(d), F.lit("type:"))), lambda d: _text(d, "$.text")),
        F.transform(F.filter(details, lambda d: F.schema_of_variant(d) == "STRING"), lambda d: _text(d, "$")),
    )
    full, short, plain = typed("reasoning.text", "text"), typed("reasoning.summary", "summary"), F.coalesce(F.get_json_object(message, "$.reasoning"), F.lit(""))
    hidden = F.exists(details, lambda d: is_object(d) & (kind(d) == "reasoning.encrypted"))
    found = lambda content, source: F.struct(content.alias("content"), F.lit(source).alias("source"))
    return (
        F.when(full != "", found(full, "full_text")).when(short != "", found(short, "summary")).when(_joined(bare) != "", found(_joined(bare), "untyped")).when(plain != "", found(plain, "plain"))
        .when(F.coalesce(hidden, F.lit(False)), found(F.lit(""), "encrypted_only")).otherwise(found(F.lit(""), "none"))
    )


def native_message(result: Column) -> Column:
    """struct(content, thinking, source, prompt_tokens, completion_tokens, total_tokens, usage)
    of a native response (JSON). usage: the native keys as they are."""
    blocks = _elements(result, "$.content")
    of = lambda kinds, field: _joined(F.transform(F.filter(blocks, lambda b: F.coalesce(_text(b, "$.type").isin(*kinds), F.lit(False))), lambda b: _text(b, f"$.{field}")))
    thought = of(("thinking", "redacted_thinking"), "thinking")
    any_thought = F.exists(blocks, lambda b: F.coalesce(_text(b, "$.type").isin("thinking", "redacted_thinking"), F.lit(False)))
    tokens = lambda k: F.coalesce(F.get_json_object(result, f"$.usage.{k}").try_cast("long"), F.lit(0).cast("long"))
    source = F.when(thought != "", F.lit("summary")).when(any_thought, F.lit("encrypted_only")).otherwise(F.lit("none"))
    return F.struct(
        F.regexp_replace(of(("text",), "text"), r"\A\s+|\s+\z", "").alias("content"), thought.alias("thinking"), source.alias("source"), tokens("input_tokens").alias("prompt_tokens"), tokens("output_tokens").alias("completion_tokens"),
        (tokens("input_tokens") + tokens("output_tokens")).alias("total_tokens"), F.get_json_object(result, "$.usage").alias("usage"),
    )


# attempts ---------------------------------------------------------------------------------
def retry_after(header: Column, now: Column) -> Column:
    """Seconds to wait by a Retry-After header: a number of seconds, or a date less `now`;
    at least 0; null without a header or for other text."""
    h = F.trim(header)
    number = h.try_cast("double")
    # the day of the week is redundant; two zones of the same meaning are usual
    date = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(h, r"^[A-Za-z]{3},\s*", ""), r"\s*(GMT|UTC|[+-]0000)$", ""), F.lit("d MMM yyyy HH:mm:ss"))
    wait = F.coalesce(number, (F.unix_micros(date) - F.unix_micros(now)) / 1e6)
    return F.when((h != "") & wait.isNotNull(), F.greatest(F.lit(0.0), wait) + F.lit(0.0)).cast("double")


def attempt_class(status: Column, failure: Column) -> Column:
    """struct(error_class, retriable, billed_risk) of an attempt by its HTTP status, else by
    the kind of failure: timeout, connection, parse or anything else."""
    told = lambda c, again, billed: F.struct(F.lit(c).alias("error_class"), F.lit(again).alias("retriable"), F.lit(billed).alias("billed_risk"))
    by_failure = F.when(failure == "timeout", told("timeout", True, True)).when(failure == "connection", told("connection", True, False)).when(failure == "parse", told("parse", False, True)).otherwise(told("unknown", True, True))
    by_status = (
        F.when(status.between(200, 299), told("ok", False, True)).when(status == 429, told("http_429", True, False)).when(status.between(400, 499), told("http_4xx", False, False))
        .when(status.isin(*CHEAP), told("http_5xx", True, False)).otherwise(told("http_5xx", True, True))
    )
    return F.when(status.isNotNull(), by_status).otherwise(by_failure)


def stream_class(chunks: Column, cause: Column) -> Column:
    """The same for a stream that broke off: with chunks received the output was generated
    and may be billed; before the first one the cause counts."""
    drop = F.struct(F.lit("stream_drop").alias("error_class"), F.lit(True).alias("retriable"), F.lit(True).alias("billed_risk"))
    return F.when(chunks > 0, drop).otherwise(attempt_class(F.lit(None).cast("int"), cause))


def backoff(attempt_no: Column, asked: Column, jitter: Column | None = None) -> Column:
    """Seconds before the next attempt: what the server asked for, up to a limit, else a part
    of 2^attempt seconds, up to a limit. jitter: a number from 0 to 1 (default: random)."""
    part = F.rand() if jitter is None else jitter
    return F.when(asked.isNotNull(), F.least(asked, F.lit(LONGEST_ASKED))).otherwise(part * F.least(F.lit(LONGEST_WAIT), F.pow(F.lit(2.0), attempt_no)))


def after_attempt(attempt_no: Column, retriable: Column, billed: Column, most: Column | int = 4) -> Column:
    """What follows a failed attempt: retried, gave_up or fatal."""
    budget = F.when(billed, F.lit(COSTLY_ATTEMPTS)).otherwise(F.lit(most) if isinstance(most, int) else most)
    return F.when(retriable & (attempt_no < budget), F.lit("retried")).when(retriable, F.lit("gave_up")).otherwise(F.lit("fatal"))


# showing ----------------------------------------------------------------------------------
def readable_number(n: Column) -> Column:
    """With B, M or K from a thousand on; two places, halves rounded up."""
    unit = lambda size, sign: F.concat(F.format_string("%.2f", n.cast("double") / size), F.lit(sign))
    return F.when(n >= 1e9, unit(1e9, "B")).when(n >= 1e6, unit(1e6, "M")).when(n >= 1e3, unit(1e3, "K")).otherwise(n.cast("string"))


def readable_time(seconds: Column) -> Column:
    """Hours and minutes where there are any, seconds with two places."""
    h, m = F.floor(seconds / 3600), F.floor((seconds % 3600) / 60)
    s = F.concat(F.format_string("%.2f", F.round((seconds % 60).cast("double"), 6)), F.lit("s"))
    return F.when(seconds.isNull(), F.lit(None)).when(h > 0, F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m "), s)).when(m > 0, F.concat(m.cast("string"), F.lit("m "), s)).otherwise(s)


def run_slug(stem: Column) -> Column:
    """Model slug of the stem of a results file: without the first suffix, in this order, that
    it ends with; the first underscore is a slash."""
    out = stem
    cut = F.lit(None).cast("string")
    for suffix in reversed(("-fmt2", "-piecearr", "-thinking", "-verbose-cot")):  # fixed values
        cut = F.when(stem.endswith(suffix), F.substring(stem, F.lit(1), F.length(stem) - len(suffix))).otherwise(cut)
    return F.regexp_replace(F.coalesce(cut, out), r"\A([^_]*)_", "$1/")
