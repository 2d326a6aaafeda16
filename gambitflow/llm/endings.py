"""Text cut off by field limits or in transfer (problem 6).

Lengths of every value are recomputed under alternative encodings and escapes; a length at
which a source's values pile up with next to nothing beyond it is a hidden storage limit.
Then the ending of each value is inspected: it is `cut` (inside a word or sentence),
`complete`, or `weak` - a form that a complete text may have too, such as a number, a
letter or a time of day with its stop, a marked move, or a quotation that opens a sentence.
The limit decides weak endings: at a limit, or so close below it that the rest of a
character or a space was dropped, they are cuts; elsewhere they are complete. Values cut
away from any limit were cut in transfer.

Defined results: null, blank and mere marks are no cut; a value that ends a sentence at a
limit is no case; repeated lines count each.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gambitflow.llm.sentences import _MOVE_END, BEFORE_NAME, WITHIN

MEASURES = {
    "characters": len,
    "utf8": lambda s: len(s.encode("utf-8", "surrogatepass")),
    "utf16": lambda s: len(s.encode("utf-16-le", "surrogatepass")) // 2,
    "entities": lambda s: len(html.escape(s, quote=False)),
    "entities_quoted": lambda s: len(html.escape(s)),
    "entities_utf8": lambda s: len(html.escape(s).encode("utf-8", "surrogatepass")),
    "entities_plain_utf8": lambda s: len(html.escape(s, quote=False).encode("utf-8", "surrogatepass")),
    "json_ascii": lambda s: len(json.dumps(s)) - 2,
    "json": lambda s: len(json.dumps(s, ensure_ascii=False)) - 2,
    "json_utf8": lambda s: len(json.dumps(s, ensure_ascii=False).encode("utf-8", "surrogatepass")) - 2,
    "crlf": lambda s: len(s.replace("\n", "\r\n")),
    "crlf_utf8": lambda s: len(s.replace("\n", "\r\n").encode("utf-8", "surrogatepass")),
}

_MARK = re.compile(r"(?:\s*(?:\.\.\.|…|\[\s*(?:\.\.\.|…|truncated|cut|snip|continued|more)[^\]]{0,20}\]|\((?:truncated|cut off|continued)\)|<(?:truncated|cut|snip)[^>]{0,20}>|�+))+\s*$", re.IGNORECASE)
_ANSWER = re.compile(r"^(?:\W*final answer\s*[:：]|\W*answer\s*[:：]|.*\\boxed\{|(?:so )?the (?:final )?answer is\b|die lösung lautet\b|die antwort (?:lautet|ist)\b|la réponse est\b|la respuesta es\b|ответ\s*[:：]|答案是|答えは|正解は)", re.IGNORECASE)
_LATE = re.compile(r"[.!?。！？]\s+(?P<at>\W*final answer\s*[:：]\s*\S)(?!.*final answer)", re.IGNORECASE)
_END = re.compile(r"[.!?。！？｡।॥؟۔;]$")
_OPEN_CLOSE = (("“", "”"), ("„", "“”"), ("«", "»"), ("「", "」"), ("『", "』"), ("(", ")"), ("（", "）"))
_SHAPES = [
    re.compile(x)
    for x in (
        r"[a-h][1-8][a-h][1-8][qrbn]?", r"[a-h][1-8]", r"(?:[a-h][1-8])(?:[>-][a-h][1-8])+", r"(?:White|Black) (?:Pawn|Knight|Bishop|Rook|Queen|King) at [a-h][1-8]", r"[-+]?\d+",
        r"\(?[A-Da-d]\)?\.?", r"none|N/A|n/a", r"(?:[pnbrqkPNBRQK1-8]{1,8}/){7}[pnbrqkPNBRQK1-8]{1,8} [wb] (?:-|[KQkq]{1,4}) (?:-|[a-h][36]) \d+ \d+",
    )
]


#: Items of an answer with a clause of three words or more behind them.
_CLAUSE = re.compile(rf"\s*(?:(?:{'|'.join(p.pattern for p in _SHAPES[:6])})\s*,\s*)*(?:{'|'.join(p.pattern for p in _SHAPES[:6])})(?:\s+[^\W\d_]+){{3,}}[.!]?\s*$")


def _shape(item: str) -> int:
    return next((k for k, p in enumerate(_SHAPES) if p.fullmatch(item)), -1)


def answer_of(line: str) -> str | None:
    """What an answer line answers, without marks; None if the line is none."""
    line = line.strip()
    late = _LATE.search(line)
    if late:
        line = line[late.start("at") :]
    m = _ANSWER.match(line)
    if not m:
        return None
    rest = line[m.end() :]
    if re.search(r"[.!?]\s+\S+\s+\S+\s+\S", rest) or _CLAUSE.match(rest):
        return None  # only the announcement of an answer, or text after it
    if "boxed{" in m.group():
        rest = rest.split("}")[0]
    return rest.strip().strip("*`$_ \t").rstrip(".。").strip().strip("*`$_").strip()


def _unclosed(s: str) -> bool:
    """Is a quotation or bracket of the last paragraph still open?"""
    for a, b in _OPEN_CLOSE:
        k = s.rfind(a)
        if k >= 0 and a != b and not any(c in s[k + 1 :] for c in b):
            if a == "“" and "„" in s[:k]:  # it closed a low quotation mark
                continue
            return True
    return s.count('"') % 2 == 1


def verdict(text: str | None) -> str:
    """'cut', 'complete', 'weak' or '' (nothing that could be cut)."""
    if not text:
        return ""
    s = text.rstrip()
    mark = _MARK.search(s)
    body = s[: mark.start()].rstrip() if mark else s
    if not any(c.isalnum() for c in body):
        return ""
    if s.count("```") % 2 == 1 and not s.endswith("```"):
        return "cut"
    if "\ufffd" in s[len(body) :]:
        return "cut"  # half a character of the next word
    if mark and not re.search(r"[.!?。！？]$", body):
        # a trailing mark after an unfinished sentence; CJK texts may trail off
        return "cut"
    s = body if mark else s
    fenced = s.endswith("```")
    if fenced:
        s = s[:-3].rstrip()
    para = s[s.rfind("\n\n") + 2 :] if "\n\n" in s else s
    line = s.rsplit("\n", 1)[-1].strip()
    answer = answer_of(line)
    if answer is not None:
        items = [x.strip() for x in answer.split(",")] if answer else []
        closed = fenced or re.search(r"(?:\*\*|\}\$?|\.|。)$", line) or text.endswith("\n")
        kinds = {_shape(x) for x in items}
        if "\\boxed{" in line and "}" not in line[line.rindex("\\boxed{") :]:
            return "cut"
        if not items:
            # a heading alone is an empty answer; behind a text the answer is missing
            return "" if line == s.strip() else "cut"
        if _shape(answer) >= 0 or len(kinds - {-1}) == 1 and -1 not in kinds:
            return "complete"
        return "complete" if closed and not line.startswith("**") or line.endswith("**") else "cut"
    if re.search(r"\$?\\\w{0,5}$", line):
        return "cut"  # inside the command that would box the answer
    plain = re.sub(r"[*_`~]+$", "", line)
    if line.startswith("**") and line.endswith("**") and len(line) > 4:
        return "complete"  # a heading
    if line.startswith("**") and line.count("**") == 1:
        return "cut"
    if s.endswith("-->") or re.search(r"</\w+>$", s):
        return "complete"
    core = re.sub(r"[\"'”’»）)\]」』】]+$", "", plain.rstrip("   "))
    if not _END.search(core):
        if _thai_end(core):
            return "weak"
        return "cut"
    if _unclosed(para):
        return "cut"
    if core.endswith(".") and core == plain:
        stem = core[:-1]
        word = re.search(r"[^\s(\"“«„]*$", stem).group().lower()
        if stem.endswith("."):
            return "cut" if re.search(r"\d\.*$", stem) else "weak"
        if word.isdigit():
            # a move number, or the end of a sentence; a year is no move number
            return "weak" if len(word) < 4 else "complete"
        if re.fullmatch(r"v?\d+|[^\W\d_]", word):
            return "weak"
        if word in ("etc", "usw", "д", "т.д"):
            return "complete"
        if word in ("p.m", "a.m"):
            return "weak"
        if word in BEFORE_NAME or word in WITHIN:
            return "cut"
    if re.search(r"[!?]$", core) and core == plain and _MOVE_END.search(re.sub(r"[!?]+$", "", core)):
        # a marked move may stand in the middle of a sentence
        if core.endswith("!") and re.search(r"\d\.\s*\S+$", core):
            return "weak"
        if re.search(r"\?!$|!\?$|!!$|\?\?$", core):
            return "weak"
    if plain != core and re.match(r"\s*[“„«\"][^“„«\"]*[!?.][”“»\"]$", re.split(r"(?<=[.!?])\s+(?=[“„«\"])", para)[-1].strip() or " "):
        return "weak"  # a quotation that opens a sentence usually goes on
    if core.endswith(";"):
        return "weak"
    return "complete"


def _thai_end(s: str) -> bool:
    """Thai has no terminators; a sentence of it may just end."""
    return bool(s) and "฀" <= s[-1] <= "๿"


FIELDS = ("response", "thinking_content")


def _inspect(fields: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            head: list[list] = [[], [], [], []]
            sizes: list[list[int]] = []
            slack: list[int] = []
            ids, keys = b.column(0).to_pylist(), b.column(1).to_pylist()
            for n, field in enumerate(fields):
                for i, key, text in zip(ids, keys, b.column(2 + n).to_pylist(), strict=True):
                    found = verdict(text)
                    if found:
                        for c, v in zip(head, (i, key, field, found), strict=True):
                            c.append(v)
                        plain = text.isascii() and not any(c in text for c in "&<>\"'\\\n\t\r")
                        sizes.append([len(text)] * len(MEASURES) if plain else [f(text) for f in MEASURES.values()])
                        # a space may be dropped at the cut, or all bytes but the last of a character
                        top = max(text)
                        slack.append(1 if top < "\u0800" else 2 if top < "\U00010000" else 3)
            yield pa.RecordBatch.from_arrays(
                [pa.array(head[0], pa.int64()), *[pa.array(c, pa.string()) for c in head[1:]], pa.array(sizes, pa.list_(pa.int32())), pa.array(slack, pa.int32())], ["rec_id", "run_key", "field", "verdict", "sizes", "slack"]
            )

    return run


def inspected(lines: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """rec_id, run_key, field, verdict, sizes and slack (how far below a limit a cut value of
    such characters may end) of every value with words in it."""
    return lines.select("rec_id", "run_key", *[F.col(f"inference.{f}").alias(f) for f in fields]).mapInArrow(_inspect(fields), "rec_id long, run_key string, field string, verdict string, sizes array<int>, slack int")


def hidden_limits(seen: DataFrame, least: int = 4, beyond: float = 0.02, times: float = 4.0) -> DataFrame:
    """run_key, field, measure, size, n: lengths at which values pile up with at most
    `beyond` of the values longer, `times` as many as at the 20 lengths below together on average."""
    sizes = seen.select("run_key", "field", F.posexplode("sizes").alias("m", "size")).groupBy("run_key", "field", "m", "size").agg(F.count("*").alias("n"))
    group = Window.partitionBy("run_key", "field", "m")
    sizes = (
        sizes.withColumn("all", F.sum("n").over(group))
        .withColumn("longer", F.coalesce(F.sum("n").over(group.orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("near", F.coalesce(F.sum("n").over(group.orderBy("size").rangeBetween(-20, -1)), F.lit(0)) / 20)
        .where((F.col("n") >= least) & (F.col("longer") <= F.greatest(F.lit(2), F.col("all") * beyond)) & (F.col("n") >= times * F.col("near")) & (F.col("size") >= 64))
    )
    names = F.element_at(F.array(*[F.lit(x) for x in MEASURES]), F.col("m") + 1)
    return sizes.select("run_key", "field", "m", names.alias("measure"), "size", "n")


def cut_values(seen: DataFrame) -> DataFrame:
    """rec_id, run_key, field, verdict, at_limit of the values that are cut."""
    limits = hidden_limits(seen).groupBy("run_key", "field").agg(F.collect_list(F.struct("m", "size")).alias("limits"))
    # one row per source and field, however many values there are
    known = seen.join(limits, [seen.run_key.eqNullSafe(limits.run_key), seen.field == limits.field], "left").select(seen["*"], "limits")
    hit = F.exists(F.coalesce("limits", F.array().cast("array<struct<m:int,size:int>>")), lambda x: F.element_at("sizes", x["m"] + 1).between(x["size"] - F.col("slack"), x["size"]))
    return known.withColumn("at_limit", hit).where("verdict = 'cut' or (verdict = 'weak' and at_limit)").select("rec_id", "run_key", "field", "verdict", "at_limit")


def cut_rates(lines: DataFrame, seen: DataFrame, cut: DataFrame) -> DataFrame:
    """run_key, field, n, cut, at_limit, rate: how often each source truncates."""
    n = seen.groupBy("run_key", "field").agg(F.count("*").alias("n"))
    c = cut.groupBy("run_key", "field").agg(F.count("*").alias("cut"), F.count_if("at_limit").alias("at_limit"))
    on = [n.run_key.eqNullSafe(c.run_key), n.field == c.field]
    return n.join(c, on, "left").select(n.run_key, n.field, "n", F.coalesce("cut", F.lit(0)).alias("cut"), F.coalesce("at_limit", F.lit(0)).alias("at_limit"), F.round(F.coalesce("cut", F.lit(0)) / F.col("n"), 6).alias("rate"))
