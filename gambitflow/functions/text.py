"""Column functions for prompts, answers, names and commentary; all stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode knows it; Java's \s and trim know less.
WS = r"[\s\x1c-\x1f\x{85}\p{Z}]"


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, rf"{WS}+", " "))


# prompts and answers -------------------------------------------------------------------
def resolve_prompt(question: Column, examples: Column, group: Column | int = 1, context: Column | None = None) -> Column:
    """Fill the two placeholders of a question; without examples the second one stays."""
    group = F.lit(group) if isinstance(group, int) else group
    n = F.coalesce(F.size(examples), F.lit(0))
    example = F.when((n >= 2) & (group == 2), F.get(examples, F.lit(1))).when(n >= 1, F.get(examples, F.lit(0)))
    filled = F.replace(question, F.lit("CONTEXT_PLACEHOLDER"), context if context is not None else F.lit(""))
    return F.when(example.isNotNull(), F.replace(filled, F.lit("FORMAT_EXAMPLE_PLACEHOLDER"), example)).otherwise(filled)


def extract_answer(response: Column) -> Column:
    """struct(answer, ok): the last final answer, else the last boxed one, else ('', false).
    An empty capture is a successful extraction; a null response is a failed one."""
    r = F.coalesce(response, F.lit(""))
    marked = F.regexp_extract_all(r, F.lit(rf"(?isd)FINAL ANSWER:{WS}*(.+?)(?:\n|\z)"), 1)
    boxed = F.regexp_extract_all(r, F.lit(rf"[Tt]he{WS}+final{WS}+answer{WS}+is{WS}+\$?\\boxed\{{([^}}]+)\}}\$?"), 1)
    last = strip(F.try_element_at(marked, F.lit(-1)))
    last = strip(F.regexp_replace(last, rf"\A(?i:FINAL ANSWER:){WS}*", ""))
    last = strip(F.regexp_replace(last, r"\A\*+|\*+\z", ""))
    return F.struct(
        F.when(F.size(marked) > 0, last).when(F.size(boxed) > 0, strip(F.try_element_at(boxed, F.lit(-1)))).otherwise(F.lit("")).alias("answer"),
        ((F.size(marked) > 0) | (F.size(boxed) > 0)).alias("ok"),
    )


def answer_set(c: Column) -> Column:
    """Items of a list answer: split at commas, stripped, lower case, without empty ones."""
    return F.array_distinct(F.filter(F.transform(F.split(F.lower(c), ","), strip), lambda x: x != ""))


def grade(answer: Column, correct: Column, kind: Column, ok: Column, used: Column, allowed: Column) -> Column:
    """The error type of an answer. A spent token budget comes before a failed extraction,
    and that before the comparison; answers of kind 'multi' are compared as sets."""
    a, c = answer_set(answer), answer_set(correct)
    extra, missing = F.size(F.array_except(a, c)), F.size(F.array_except(c, a))
    multi = (
        F.when((extra == 0) & (missing == 0), F.lit("correct"))
        .when((extra > 0) & (missing == 0), F.lit("multi_extra_items"))
        .when((extra == 0) & (missing > 0), F.lit("multi_missing_items"))
        .otherwise(F.lit("multi_false_items"))
    )
    same = strip(F.lower(F.coalesce(answer, F.lit("")))) == strip(F.lower(F.coalesce(correct, F.lit(""))))
    return (
        F.when(F.coalesce(used >= allowed * 0.98, F.lit(False)), F.lit("max_token_reached"))
        .when(~F.coalesce(ok, F.lit(False)), F.lit("format_error"))
        .when(kind == "multi", multi)
        .otherwise(F.when(same, F.lit("correct")).otherwise(F.lit("wrong_answer")))
    )


def outcome(error_type: Column, legality: Column) -> Column:
    return (
        F.when(error_type == "correct", F.lit("correct"))
        .when(error_type == "max_token_reached", F.lit("capped"))
        .when(error_type == "format_error", F.lit("format_error"))
        .when(legality == "illegal", F.lit("illegal"))
        .otherwise(F.lit("wrong"))
    )


def split_input(c: Column) -> Column:
    """struct(fen, moves): what stands before and after the first bar."""
    parts = F.split(F.coalesce(c, F.lit("")), r"\|", 2)
    moves = F.filter(F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), rf"{WS}+"), lambda x: x != "")
    return F.struct(strip(F.get(parts, F.lit(0))).alias("fen"), moves.alias("moves"))


# names and keys ------------------------------------------------------------------------
def display_name(run_key: Column, model: Column, thinking: Column) -> Column:
    short = F.regexp_replace(model, r"\A[^/]*/", "")
    return F.concat(short, F.when(run_key.endswith("-verbose-cot"), F.lit(" (verbose CoT)")).when(thinking != 0, F.lit(" (thinking)")).otherwise(F.lit(" (no thinking)")))


def run_key(model: Column, thinking: Column, context: Column, group: Column) -> Column:
    return F.concat(
        F.translate(model, "/:", "__"),
        F.when(thinking != 0, F.lit("-thinking")).otherwise(F.lit("")),
        F.when(context != 0, F.lit("-piecearr")).otherwise(F.lit("")),
        F.when(group == 2, F.lit("-fmt2")).otherwise(F.lit("")),
    )


def run_meta(key: Column) -> Column:
    """struct(model, enable_thinking, add_context, format_example_group) of a run key."""
    no_format = F.regexp_replace(key, r"-fmt2\z", "")
    no_context = F.regexp_replace(no_format, r"-piecearr\z", "")
    return F.struct(
        F.regexp_replace(F.regexp_replace(no_context, r"-thinking\z", ""), "^([^_]*)_", "$1/").alias("model"),
        no_context.endswith("-thinking").cast("int").alias("enable_thinking"),
        no_format.endswith("-piecearr").cast("int").alias("add_context"),
        F.when(key.endswith("-fmt2"), 2).otherwise(1).alias("format_example_group"),
    )


def position_hash(fen: Column) -> Column:
    """First 16 hex digits of the md5 of the first four fields."""
    return F.substring(F.md5(F.array_join(F.slice(F.split(strip(fen), rf"{WS}+"), 1, 4), " ")), 1, 16)


def rating_level(c: Column) -> Column:
    return F.when(c <= 999, F.lit("beginner")).when(c <= 1499, F.lit("intermediate")).when(c <= 1999, F.lit("advanced")).when(c.isNotNull(), F.lit("expert"))


#: Centre of each evaluation band; a band reaches 50 to both sides.
EVAL_BANDS = {"losing": -400, "disadvantage": -200, "neutral": 0, "advantage": 200, "winning": 400}


def eval_band(c: Column) -> Column:
    return F.coalesce(*[F.when(F.abs(c - v) <= 50, F.lit(k)) for k, v in EVAL_BANDS.items()])


def nearest_option(value: Column, options: Column) -> Column:
    """The option next to a value; the first of equally near ones."""
    return F.get(F.array_sort(F.transform(options, lambda v, i: F.struct(F.abs(v - value).alias("d"), i.alias("i"), v.alias("v")))), F.lit(0))["v"]


def game_stage(move_number: Column, opening: int = 12, middlegame: int = 30) -> Column:
    n = F.coalesce(move_number.try_cast("int"), F.lit(0))
    return F.when(n <= opening, F.lit("opening")).when(n <= middlegame, F.lit("middlegame")).otherwise(F.lit("endgame"))


def numbered_moves(san: Column) -> Column:
    return F.array_join(F.transform(san, lambda s, i: F.when(i % 2 == 0, F.concat((F.floor(i / 2) + 1).cast("string"), F.lit(". "), s)).otherwise(s)), " ")


# commentary ----------------------------------------------------------------------------
#: Glyphs of the private use area that stand for pieces.
FIGURINES = {"\ue025": "Q", "\ue026": "R", "\ue027": "B", "\ue028": "N", "\ue024": "K"}


def plain_symbols(c: Column, pawn: bool = False) -> Column:
    """Piece glyphs as letters, without invisible marks, no-break spaces as spaces. With
    `pawn` also the pawn glyph, and stripped (the form of the question stage)."""
    glyphs = FIGURINES | ({"\ue029": "P"} if pawn else {})
    t = F.translate(c, "".join(glyphs), "".join(glyphs.values()))
    t = F.replace(F.regexp_replace(t, r"[\x{200B}-\x{200F}\x{202A}-\x{202E}]", ""), F.lit("\u00a0"), F.lit(" "))
    return strip(t) if pawn else t


def letters_and_digits(c: Column) -> Column:
    """Only letters and digits, small."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def count_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[A-Za-z0-9']+"))


def strip_notation(c: Column) -> Column:
    """Comments without inline tags, annotation numbers and the dots of move numbers.

    The text is cut into runs of digits, of dots, of white space and of anything else; what
    becomes of a run of dots or of a number is decided by its neighbours:
    dots between a number and a letter are a space (two dots are no mark); three dots or more
    behind a number go, and before a letter they are a space; the dot of a number that stands
    free, or opens a bracket, goes, and the number with it where nothing follows; a number
    behind the last mark of a sentence goes."""
    plain = F.regexp_replace(c, r"\[%[^\]]*\]|\$\d+", "")

    def decide(runs: Column, x: Column, k: Column) -> Column:
        at = lambda d: F.coalesce(F.get(runs, k + d), F.lit(""))
        number, dots = x.rlike(r"\A\d+\z"), x.startswith(".")
        free = lambda d: (k + d < 0) | at(d).rlike(r"\A\s") | (at(d) == "")
        bracket = lambda d: at(d).endswith("(")
        # of dots: the number before them and what stands before that
        n, after = F.length(x), at(1)
        counted = at(-1).rlike(r"\A\d+\z")
        letter = after.rlike(r"\A[A-Za-z]")
        many = n >= 3
        closed = lambda own, nxt: (free(own) & (nxt.rlike(r"\A[,;:!?]") | (nxt == ""))) | (bracket(own) & (nxt.startswith(")") | (nxt == "")))
        stands = free(-2) | bracket(-2)
        of_dots = (
            F.when(counted & ((letter & (many | (n == 1))) | (many & after.startswith("0"))), F.lit(" "))
            .when(counted & many, F.lit(""))
            .when(many & letter, F.lit(" "))
            .when(counted & (n == 1) & ((stands & after.rlike(r"\A\s")) | closed(-2, after)), F.lit(""))
            .otherwise(x)
        )
        # of a number: does its dot go with nothing behind it, or is it a stray counter at the end
        dropped = (at(1) == ".") & closed(-1, at(2))
        mark = F.when(at(-1).rlike(r"\A\s"), at(-2)).otherwise(at(-1))
        stray = (k == F.size(runs) - 1) & mark.rlike(r"[.!?)]\z")
        return F.when(dots, of_dots).when(number & (dropped | stray), F.lit("")).otherwise(x)

    cut = F.regexp_extract_all(plain, F.lit(r"\d+|\.+|\s+|[^\d.\s]+"), 0)
    joined = _with(cut, lambda runs: F.array_join(F.transform(runs, lambda x, k: decide(runs, x, k)), ""))
    return collapse(F.regexp_replace(joined, r"[\x{E000}-\x{F8FF}]", ""))


def keywords_in(c: Column, keywords: list[str]) -> Column:
    """Keywords whose words stand in a text, the longest first."""
    norm = lambda x: F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), 0), " "), F.lit(" "))
    ordered = sorted(set(keywords), key=lambda k: (-len(k), k))
    plain = [" ".join(re.findall("[a-z0-9]+", k.lower())) for k in ordered]
    known = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(f" {p} ").alias("p")) for k, p in zip(ordered, plain, strict=True)])
    return _with(norm(c), lambda t: F.transform(F.filter(known, lambda k: F.contains(t, k["p"])), lambda k: k["k"]))


#: Phrases of comments without chess content, and words of those with it.
GENERIC = ["i will play", "we will draw", "as they say", "people say", "it is said", "in general", "generally speaking", "quote", "famous quote", "life", "luck"]
CHESS_WORDS = [
    "king", "queen", "rook", "bishop", "knight", "pawn", "kingside", "queenside", "file", "rank", "diagonal", "check", "checkmate", "mate", "castle", "castling", "gambit", "fork", "pin", "skewer", "x-ray", "xray",
    "tempo", "initiative", "zugzwang", "outpost", "passed pawn",
]
#: A move or a square at the beginning of a word; piece letters are capitals.
_MOVE = r"(?<![A-Za-z0-9])(?:(?i:o-o|0-0)|[KQRBN]?(?i:(?:[a-h][1-8]|[a-h]|[1-8])?x?[a-h][1-8]))"


def relevant(c: Column) -> Column:
    """Is a comment long enough, not generic, and about chess?"""
    t = strip(F.coalesce(c, F.lit("")))
    holds = lambda words: _with(F.lower(t), lambda low: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w)))
    return (F.length(t) >= 25) & ~holds(GENERIC) & (holds(CHESS_WORDS) | t.rlike(_MOVE))


def keep_or_drop(c: Column) -> Column:
    """The first of two labels in a model's reply, DROP without one."""
    return F.coalesce(F.nullif(F.upper(F.regexp_extract(F.coalesce(c, F.lit("")), "(?i)(KEEP|DROP)", 1)), F.lit("")), F.lit("DROP"))


def name_parts(c: Column) -> Column:
    """struct(first, last, parts) of 'Last, First Middle' or 'First .. Last'; a single word is
    both. parts: the pieces of letters and apostrophes. Null and blank names have none."""
    t = collapse(F.translate(F.coalesce(c, F.lit("")), "\\/", "  "))
    comma = F.instr(t, ",")
    words = lambda x: F.filter(F.split(x, r"\s+"), lambda w: w != "")
    behind = words(strip(F.substring(t, comma + 1, F.length(t))))
    before = strip(F.substring(t, F.lit(1), F.greatest(comma - 1, F.lit(0))))
    return F.struct(
        F.coalesce(F.when(comma > 0, F.try_element_at(behind, F.lit(1))).otherwise(F.try_element_at(words(t), F.lit(1))), F.lit("")).alias("first"),
        F.coalesce(F.when(comma > 0, before).otherwise(F.try_element_at(words(t), F.lit(-1))), F.lit("")).alias("last"),
        F.regexp_extract_all(t, F.lit("[A-Za-z']+"), 0).alias("parts"),
    )


def aliases(name: Column) -> Column:
    """All forms of a name: whole, first, last, every part."""
    p = name_parts(name)
    return F.array_distinct(F.filter(F.concat(F.array(F.coalesce(name, F.lit("")), p["first"], p["last"]), p["parts"]), lambda a: a != ""))


def annotator_side(annotator: Column, white: Column, black: Column) -> Column:
    """White or Black if the annotator is that player, by the letters of their names; else null."""
    letters = lambda x: F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z]", "")
    a = letters(annotator)
    return F.when(a == "", F.lit(None)).when(a == letters(white), F.lit("White")).when(a == letters(black), F.lit("Black"))


def replace_aliases(text: Column, aliases: Column, to: str) -> Column:
    """Each alias, the longest first, outside of longer words and whatever its case."""
    ordered = F.transform(F.array_sort(F.transform(F.array_distinct(F.filter(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: a != "")), lambda a: F.struct((-F.length(a)).alias("n"), F.lower(a).alias("l"), a.alias("a")))), lambda s: s["a"])
    quoted = lambda a: F.concat(F.lit(r"(?i)(?<![A-Za-z])"), F.regexp_replace(a, r"([\\^$.|?*+()\[\]{}-])", r"\\$1"), F.lit("(?![A-Za-z])"))
    return F.aggregate(ordered, text, lambda acc, a: F.regexp_replace(acc, quoted(a), F.lit(to)))


#: What stands for a word of the first person; {} is the side.
FIRST_PERSON = {"i": "{}", "me": "{}", "myself": "{}", "my": "{}'s", "mine": "{}'s", "i'm": "{} is", "i've": "{} has", "i'll": "{} will", "i'd": "{} would"}


def replace_first_person(c: Column, side: Column | str) -> Column:
    """Words of the first person as the side; the text is cut into words and looked up. A
    null side leaves the text as it is."""
    side = F.lit(side) if isinstance(side, str) else side
    words = F.regexp_extract_all(c, F.lit(r"(?i)\bi'(?:m|ve|ll|d)\b|\w+|\W"), 0)
    known = F.create_map(*[F.lit(x) for kv in FIRST_PERSON.items() for x in kv])
    said = lambda w: F.coalesce(F.replace(F.try_element_at(known, F.lower(w)), F.lit("{}"), side), w)
    return F.when(side.isNull(), c).otherwise(F.array_join(F.transform(words, said), ""))


#: Labels that a model puts before its text.
LABELS = ["cleaned", "output", "result", "answer", "text", "comment"]


def clean_model_text(c: Column) -> Column:
    """What a cleaning model meant to say: its last quoted piece, else its last line, without
    thoughts, fences, a label and quotes around it; SKIP where it says so or nothing is left."""
    parts = F.split(c, "(?i)<think>")
    spoken = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, 1 << 30), lambda p: F.coalesce(F.get(F.split(p, "(?i)</think>", 2), F.lit(1)), F.lit(""))), ""))
    bare = lambda x: strip(F.btrim(x, F.lit("`")))
    lines = F.filter(F.transform(F.filter(F.split(spoken, r"\R"), lambda x: ~x.rlike(r"\A```\w*\s*\z")), bare), lambda x: x != "")
    quoted = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit('"([^"]+)"'), 1)))
    pick = F.coalesce(strip(F.try_element_at(quoted, F.lit(-1))), F.try_element_at(lines, F.lit(-1)))
    colon = F.regexp_instr(pick, F.lit("[:\uff1a]"))
    labelled = (colon > 1) & F.lower(F.rtrim(F.substring(pick, F.lit(1), colon - 1))).isin(*LABELS)
    said = collapse(F.when(labelled, F.substring(pick, colon + 1, F.length(pick))).otherwise(pick))
    first, last = F.left(said, F.lit(1)), F.right(said, F.lit(1))
    said = F.when((F.length(said) > 1) & (first == last) & first.isin('"', "'"), strip(F.substring(said, F.lit(2), F.length(said) - 2))).otherwise(said)
    skip = F.exists(lines, lambda x: F.upper(x) == "SKIP")
    return F.when(c.isNull() | skip | said.isNull() | (said == ""), F.lit("SKIP")).otherwise(said)
