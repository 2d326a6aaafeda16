"""Multiple-choice tasks over comments, with distractors by named strategies.

A bounded set of base items is taken in shuffled order; each gets distractors by its
strategy: related items by keyword, by piece and stage or by vector, the nearest by a hash
of the pair. What a strategy does not fill is filled from a shuffled reserve that all items
share, so no item is ever matched with all others. A task is kept if it has exactly as many
different options as asked for.

Defined results: items without text are no base and no option; a text that several items
share is one option; an empty keyword list has no related items; a null piece is `unknown`;
an unreadable move number is the opening; ties are broken by the item id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gambitflow.functions import prompts, text
from gambitflow.operators import sampling, similarity
from gambitflow.session import materialise

#: Reserve items that fill up options; each base item needs only a few of them.
RESERVE = 256


def prepared(items: DataFrame, id_col: str = "item_id") -> DataFrame:
    """item_id, text and the bucket keys of items with columns comment, cleaned_comment,
    keywords, move_piece, move_number, fen_before, fen_after, move_uci, side_to_move."""
    comment = text.plain_symbols(F.coalesce(F.when(F.trim("cleaned_comment") != "", F.col("cleaned_comment")), F.col("comment")), pawn=True)
    piece = F.coalesce(F.nullif(F.lower(F.trim("move_piece")), F.lit("")), F.lit("unknown"))
    words = F.array_distinct(F.filter(F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: F.lower(F.trim(k))), lambda k: k != ""))
    stage = text.game_stage(F.col("move_number").cast("string"))
    rest = ["fen_before", "fen_after", "move_uci", "move_number", "side_to_move"]
    return items.select(F.col(id_col).alias("item_id"), comment.alias("text"), words.alias("words"), piece.alias("piece"), F.concat_ws("/", piece, stage).alias("piece_stage"), *rest).where("item_id is not null and text != ''")


def _pair_order() -> Column:
    return F.md5(F.concat_ws(":", F.col("item_id").cast("string"), F.col("other_id").cast("string")))


def _related(base: DataFrame, items: DataFrame, key: Column, k: int) -> DataFrame:
    """item_id, other_id, other_text, o: for each base item k others of its bucket. The base
    is a bounded set, so the items are passed once and never joined with each other; each
    task keeps k candidates of a base item before the shuffle."""
    b = base.select("item_id", F.explode(key).alias("bucket"))
    others = items.select(F.col("item_id").alias("other_id"), F.col("text").alias("other_text"), F.explode(key).alias("bucket"))
    met = others.join(F.broadcast(b), "bucket").where("other_id != item_id").withColumn("o", _pair_order()).select("item_id", "other_id", "other_text", "o")
    # an item that shares several keywords counts once: its copies rank alike
    w = Window.partitionBy("item_id").orderBy("o", "other_id")
    return met.withColumn("r", F.dense_rank().over(w)).where(F.col("r") <= k).drop("r").distinct()


def _by_vector(base: DataFrame, items: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    near = similarity.nearest_of(vectors, base.select(F.col("item_id").alias("vec_id")), k).select(F.col("vec_id").alias("item_id"), F.col("neighbour").alias("other_id"), F.format_string("%06d", "rank").alias("o"))
    return near.join(items.select(F.col("item_id").alias("other_id"), F.col("text").alias("other_text")), "other_id").select("item_id", "other_id", "other_text", "o")


#: strategy -> (base, items, k) -> item_id, other_id, other_text, o. More can be entered here.
STRATEGIES: dict[str, list[Callable[[DataFrame, DataFrame, int], DataFrame]]] = {
    "easy_random": [],
    "keyword": [lambda b, i, k: _related(b, i, F.col("words"), k)],
    "piece_stage": [lambda b, i, k: _related(b, i, F.array("piece_stage"), k), lambda b, i, k: _related(b, i, F.array("piece"), k)],
}


def options(base: DataFrame, items: DataFrame, strategy: str, k: int = 3, vectors: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """item_id, opts: the texts of the item itself and up to k different ones, by the sources
    of the strategy in order, then by the reserve."""
    sources = [lambda b, i, n: _by_vector(b, i, vectors, n)] if strategy == "embedding" else STRATEGIES[strategy]
    found = None
    for level, source in enumerate(sources):
        x = source(base, items, k).withColumn("level", F.lit(level))
        found = x if found is None else found.unionByName(x)
    # the reserve is small and shared: every base item takes its own order of it
    reserve = items.orderBy(sampling.shuffled(F.col("item_id"), seed + 1), "item_id").limit(RESERVE).select(F.col("item_id").alias("other_id"), F.col("text").alias("other_text"))
    held = reserve.agg(F.collect_list(F.struct("other_id", "other_text")).alias("reserve"))
    fill = base.select("item_id").crossJoin(F.broadcast(held))  # one row
    fill = fill.select("item_id", F.explode("reserve").alias("x")).select("item_id", "x.*").where("other_id != item_id").withColumn("o", _pair_order()).withColumn("level", F.lit(len(sources)))
    all_ = fill if found is None else found.unionByName(fill)
    # one place for each text: the first source that offers it
    texts = all_.join(base.select("item_id", "text"), "item_id").where("other_text != text").groupBy("item_id", "other_text").agg(F.min(F.struct("level", "o", "other_id")).alias("at"))
    w = Window.partitionBy("item_id").orderBy("at")
    best = texts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return best.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "other_text"))), lambda s: s["other_text"]).alias("others")).join(base.select("item_id", "text"), "item_id").select("item_id", F.concat(F.array("text"), "others").alias("opts"))


def choice_tasks(items: DataFrame, strategy: str, n: int = 100, num_options: int = 4, vectors: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """n tasks of one strategy from prepared items. Base items are tried in shuffled order,
    first n, then ten times as many, until n tasks are found or all items were tried."""
    items = materialise(items, "choice-items")
    total, tried = items.count(), n
    while True:
        base = materialise(items.orderBy(sampling.shuffled(F.col("item_id"), seed), "item_id").limit(tried), "choice-base")
        full = materialise(options(base, items, strategy, num_options - 1, vectors, seed).where(F.size("opts") == num_options), "choice-options")
        if full.count() >= n or tried >= total:
            break
        tried *= 10
    order = sampling.shuffled(F.col("item_id"), seed)
    first = full.orderBy(order, "item_id").limit(n).withColumn("no", F.row_number().over(Window.orderBy(order, "item_id")) - 1)  # n rows
    shown = F.transform(F.array_sort(F.transform("opts", lambda t: F.struct(F.md5(F.concat_ws(":", F.col("item_id").cast("string"), t)).alias("h"), t.alias("t")))), lambda s: s["t"])
    letters = F.array(*[F.lit(chr(65 + i)) for i in range(num_options)])
    t = first.withColumn("shown", shown).join(items.drop("words", "piece", "piece_stage"), "item_id")
    answer = F.element_at(letters, F.array_position("shown", F.col("text")).cast("int"))
    listed = F.array_join(F.zip_with(letters, "shown", lambda a, o: F.concat(a, F.lit(". "), o)), "\n")
    kind = prompts.CHOICE
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    meta = F.struct(F.lit(strategy).alias("variant"), F.col("shown").alias("options"), F.col("text").alias("correct_text"), "fen_before", "fen_after", "move_uci", "move_number", "side_to_move")
    name = f"semantic_{strategy}"
    return t.select(
        F.concat(F.lit(f"{name}_"), F.format_string("%04d", "no")).alias("task_id"), F.lit(name).alias("task_type"), F.lit(kind.category).alias("task_category"), F.col("fen_before").alias("input"),
        prompts.question(kind, fen=empty("fen_before"), moves=empty("move_uci"), options=listed).alias("question"), F.array(*[F.lit(e) for e in kind.examples]).alias("format_examples"), answer.alias("correct_answer"),
        F.lit(kind.answer_type).alias("answer_type"), F.to_json(meta, {"ignoreNullFields": "false"}).alias("metadata"),
    )


def cached_vectors(items: DataFrame, cache: str, model: str, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """item_id, vector of prepared items. Vectors are kept by text hash and model; only texts
    that the cache lacks are embedded and added. embed: h, text -> h, vector."""
    spark = items.sparkSession
    schema = "h string, model string, vector array<float>"
    at = spark._jvm.org.apache.hadoop.fs.Path(cache)
    known = spark.read.schema(schema).parquet(cache) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else spark.createDataFrame([], schema)
    keyed = items.select("item_id", F.sha2("text", 256).alias("h"), "text")
    lacking = keyed.select("h", "text").dropDuplicates(["h"]).join(known.where(F.col("model") == model).select("h"), "h", "left_anti")
    made = materialise(embed(lacking).select("h", F.lit(model).alias("model"), F.col("vector").cast("array<float>").alias("vector")), "new-vectors")
    made.write.mode("append").parquet(cache)
    every = spark.read.schema(schema).parquet(cache).where(F.col("model") == model).dropDuplicates(["h"])
    return keyed.join(every, "h").select("item_id", "vector")
