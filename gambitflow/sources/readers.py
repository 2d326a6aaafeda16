"""Readers of raw inputs, with explicit schemas; none infers a schema from the data."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gambitflow.functions import board
from gambitflow.functions.text import count_words, keywords_in, strip
from gambitflow.operators.sampling import sample_tasks, shuffled

PUZZLES = "PuzzleId string, FEN string, Moves string, Rating int, RatingDeviation int, Popularity int, NbPlays int, Themes string, GameUrl string, OpeningTags string"
EVALS = "fen string, evals array<struct<depth:int, knodes:bigint, pvs:array<struct<cp:int, mate:int, line:string>>>>"
TASKS = "task_id string, task_type string, task_category string, input string, question string, format_examples array<string>, correct_answer string, answer_type string, metadata string"


#: The words that make a comment worth keeping where no list is given.
KEYWORDS = [
    "advantage", "slight advantage", "clear advantage", "decisive advantage", "compensation", "initiative", "equality", "equalize", "unclear", "winning", "drawish", "brilliant", "inaccuracy",
    "mistake", "error", "blunder", "dubious", "only move", "good", "bad", "attack", "counterattack", "counterstroke", "counterplay", "mate threat", "mating net", "checkmate", "perpetual check",
    "fork", "pin", "skewer", "double attack", "discovered attack", "discovered check", "x-ray", "deflection", "decoy", "interference", "clearance", "overloading", "overworked", "zwischenzug",
    "intermezzo", "trap", "trapped piece", "sacrifice", "exchange sacrifice", "underpromotion", "promotion", "smothered mate", "windmill", "quiet move", "forcing move", "tempo", "prophylaxis",
    "overprotection", "blockade", "outpost", "weak square", "weakness", "open file", "half-open file", "open diagonal", "battery", "rook lift", "seventh rank", "back rank", "space advantage",
    "centralization", "centralisation", "center", "centre", "control of the center", "control of the centre", "king safety", "exposed king", "castling", "opposite-side castling", "kingside",
    "king side", "queenside", "queen side", "bishop pair", "good bishop", "bad bishop", "opposite-colored bishops", "opposite-coloured bishops", "same-colored bishops", "same-coloured bishops",
    "color complex", "colour complex", "knight vs bishop", "domination", "isolated pawn", "iqp", "isolani", "backward pawn", "doubled pawns", "hanging pawns", "pawn majority", "pawn minority attack",
    "minority attack", "pawn chain", "pawn break", "breakthrough", "pawn storm", "passed pawn", "protected passer", "connected passers", "outside passer", "outside passed pawn", "distant passed pawn",
    "theory", "book move", "in book", "out of book", "move order", "transposition", "novelty", "gambit", "endgame", "pawn ending", "rook ending", "bishop ending", "knight ending", "opposition",
    "distant opposition", "triangulation", "lucena", "philidor", "shoulder", "shouldering", "bridge-building", "corresponding squares", "fortress", "zugzwang", "resign", "resigns", "resignation",
    "draw", "repetition", "agreed draw", "time trouble", "zeitnot", "flag",
]


def puzzles(spark: SparkSession, path: str, seed: int = 42) -> DataFrame:
    """Puzzle CSV with a repeatable shuffle order in `o`; columns are matched by header."""
    return spark.read.option("header", True).option("enforceSchema", False).schema(PUZZLES).csv(path).withColumn("o", shuffled(F.col("PuzzleId"), seed))


def good_puzzles(df: DataFrame, min_popularity: int = 90, max_deviation: int = 100, max_moves: int = 4) -> DataFrame:
    return df.where((F.col("RatingDeviation") <= max_deviation) & (F.col("Popularity") >= min_popularity) & (F.size(F.split(F.col("Moves"), " ")) <= max_moves))


def evaluations(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """fen, depth, knodes, cp, line of JSON lines (plain or zstd): the deepest evaluation
    (the first of equally deep ones), its first line; records without one, with a mate or
    that do not parse are left out. A limit counts parsed records."""
    raw = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    r = raw.select("value", F.from_json("value", EVALS).alias("r")).where("r.fen is not null and size(r.evals) > 0")
    best = F.get(F.array_sort(F.transform("r.evals", lambda e, i: F.struct((-F.coalesce(e["depth"], F.lit(0))).alias("d"), i.alias("i")))), F.lit(0))["i"]
    x = r.withColumn("i", best).withColumn("e", F.get("r.evals", F.col("i"))).where("size(e.pvs) > 0")
    # a key "mate" that holds null discards the record too: ask for the key, not the value
    first = F.get_json_object("value", "$.evals")
    keyed = F.array_contains(F.json_object_keys(F.to_json(F.get(F.get(F.from_json(first, "array<struct<pvs:array<map<string,string>>>>"), F.col("i"))["pvs"], F.lit(0)), {"ignoreNullFields": "false"})), "mate")
    out = x.where(~F.coalesce(keyed, F.lit(False))).select(F.col("r.fen").alias("fen"), F.coalesce("e.depth", F.lit(0)).alias("depth"), F.col("e.knodes").alias("knodes"), F.coalesce(F.get("e.pvs", F.lit(0))["cp"], F.lit(0)).alias("cp"), F.get("e.pvs", F.lit(0))["line"].alias("line"))
    return out.limit(limit) if limit and limit > 0 else out


def games(spark: SparkSession, path: str) -> DataFrame:
    """headers map, plies array: one row per game. Files are split at the headers, so a
    large file is read by many tasks."""
    text = spark.read.option("lineSep", "\n\n[Event ").text(path)
    whole = F.when(F.ltrim("value").startswith("[Event "), F.col("value")).otherwise(F.concat(F.lit("[Event "), F.col("value")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ply = pa.struct([("ply", pa.int32()), ("san", pa.string()), ("uci", pa.string()), ("fen_before", pa.string()), ("fen_after", pa.string()), ("comment", pa.string()), ("move_number", pa.int32()), ("side", pa.string())])
        for b in batches:
            heads, plies = [], []
            for t in b.column(0).to_pylist():
                if not t or "[" not in t:
                    continue
                try:
                    h, p = board.read_game(t.replace("\r\n", "\n"))
                except ValueError:
                    continue
                heads.append(list(h.items()))
                plies.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(heads, pa.map_(pa.string(), pa.string())), pa.array(plies, pa.list_(ply))], ["headers", "plies"])

    schema = "headers map<string,string>, plies array<struct<ply:int, san:string, uci:string, fen_before:string, fen_after:string, comment:string, move_number:int, side:string>>"
    return text.select(whole.alias("value")).where(F.length(F.trim("value")) > 0).mapInArrow(run, schema)


def game_id(headers) -> F.Column:
    part = lambda k: F.coalesce(F.try_element_at(headers, F.lit(k)), F.lit("Unknown"))
    return F.translate(F.concat_ws("_", *[part(k) for k in ("Event", "Round", "White", "Black")]), " /", "__")


def fragments(df: DataFrame, skip: int = 30, length: int = 5) -> DataFrame:
    """game_id, fen, moves: the position after `skip` plies and the next `length` moves of
    games that are long enough."""
    return df.where(F.size("plies") >= skip + length).select(
        game_id(F.col("headers")).alias("game_id"), F.element_at("plies", F.lit(skip))["fen_after"].alias("fen"), F.transform(F.slice("plies", skip + 1, length), lambda p: p["uci"]).alias("moves")
    )


def comments(df: DataFrame, keywords: list[str], min_words: int = 5, max_games: int | None = None) -> DataFrame:
    """Comments of main lines with a keyword and enough words, with the position around."""
    df = df.limit(max_games) if max_games else df
    c = df.select("headers", F.explode("plies").alias("p")).select(
        game_id(F.col("headers")).alias("game_id"), F.try_element_at("headers", F.lit("White")).alias("white_player"), F.try_element_at("headers", F.lit("Black")).alias("black_player"),
        "p.ply", "p.uci", "p.fen_before", "p.fen_after", "p.move_number", "p.side", strip(F.col("p.comment")).alias("comment"),
    )
    return c.where("comment != ''").withColumn("keywords", keywords_in(F.col("comment"), keywords)).where((F.size("keywords") > 0) & (count_words(F.col("comment")) >= min_words))


def comment_counts(games: DataFrame, kept: DataFrame) -> dict[str, int]:
    """games, plies, comments and kept comments of a run of the comment filter."""
    c = F.aggregate("plies", F.lit(0).cast("long"), lambda n, p: n + F.when(F.length(F.trim(F.coalesce(p["comment"], F.lit("")))) > 0, 1).otherwise(0))
    r = games.agg(F.count("*").alias("games"), F.coalesce(F.sum(F.size("plies")), F.lit(0)).alias("plies"), F.coalesce(F.sum(c), F.lit(0)).alias("comments")).first()
    return {**r.asDict(), "kept": kept.count()}


def tasks(spark: SparkSession, path: str, per_type: int | None = None, most: int | None = None, pattern: str = "*.jsonl") -> DataFrame:
    """Benchmark JSON lines of all files of a folder in file order: the task columns, file
    name and `ord`, the place among all. Metadata stays JSON text. No file is an error. per_type, most: a shuffled
    sample of each type, then the first tasks only."""
    raw = spark.read.option("pathGlobFilter", pattern).text(path).where(F.length(F.trim("value")) > 0).select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"))
    cols = [c.split()[0] for c in TASKS.split(", ")]
    parsed = raw.select("file", "at", F.from_json("value", TASKS).alias("t")).select("file", *[f"t.{c}" for c in cols], "at")
    # the id tells the split and the line in it; lines of a file lie together in a split, so
    # only the splits are numbered, not the lines
    per = parsed.groupBy("file", F.shiftright("at", 33).alias("split")).agg(F.count("*").alias("n"), F.min("at").alias("low"))
    per = per.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = parsed.withColumn("split", F.shiftright("at", 33)).join(per.drop("n"), ["file", "split"])
    return sample_tasks(joined.withColumn("ord", F.col("before") + F.col("at") - F.col("low") + 1).drop("split", "low", "before", "at"), per_type, most, order="ord")


def results(spark: SparkSession, path: str) -> DataFrame:
    """The last line of each task of a results file, or of files in the order of their names;
    a missing file gives an empty frame."""
    schema = "task_id string, line string"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    raw = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.get_json_object("value", "$.task_id").alias("task_id"), F.struct(F.col("_metadata.file_name").alias("f"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line")).alias("x"))
    return raw.where("task_id is not null").groupBy("task_id").agg(F.max("x").alias("x")).select("task_id", "x.line")


def json_array(spark: SparkSession, path: str, schema: str, limit: int = 0) -> DataFrame:
    """Records of files that hold one JSON array each; other content is an error."""
    df = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(schema).json(path)
    return df.limit(limit) if limit > 0 else df


def _whole(path: str, spark: SparkSession | None) -> str:
    """The text of a small file; with a session from wherever the cluster can read."""
    return Path(path).read_text(encoding="utf-8", errors="ignore") if spark is None else (spark.read.text(path, wholetext=True).first() or [""])[0]


def keyword_list(path: str | None, default: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """A JSON list, a JSON object (keys and their synonyms) or lines with # comments, the
    longest first; without a file, or with an empty one, the default."""
    found: list[str] = []
    if path:
        body = _whole(path, spark)
        try:
            data = json.loads(body)
        except ValueError:
            data = [line.split("#")[0] for line in body.splitlines()]
        if isinstance(data, dict):
            for k, v in data.items():
                found += [k, *(v.get("synonyms", []) if isinstance(v, dict) else v if isinstance(v, list) else [])]
        else:
            found = [str(x) for x in data]
    clean = {x.strip().lower() for x in found if x and x.strip()}
    return sorted(clean or set(KEYWORDS if default is None else default), key=lambda k: (-len(k), k))


def theme_list(path: str, spark: SparkSession | None = None) -> list[str]:
    """The themes of a JSON array, each once, by name."""
    return sorted({str(x) for x in json.loads(_whole(path, spark))})


def env_file(path: str, known: dict[str, str]) -> dict[str, str]:
    """Variables of a .env file; those that are known already keep their values."""
    out = dict(known)
    if Path(path).exists():
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            line = line.strip().removeprefix("export ")
            if line and not line.startswith("#") and "=" in line:
                k, v = (x.strip() for x in line.split("=", 1))
                out.setdefault(k, v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'" else v)
    return out
