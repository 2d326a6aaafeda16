"""What a full run would cost, from the results of a small one: token counts of its rows,
weighted by how many tasks of each type the whole set has, times the prices of a table.

Defined results: rows whose completion tokens are null or 0 are left out and counted as
errors; a type that the weights do not know weighs 0; a model without a price is an error;
where no cost was recorded the list price is taken; a run without rows has no accuracy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def type_weights(tasks: DataFrame) -> DataFrame:
    """task_type, weight: how many tasks the whole set has of each type."""
    return tasks.groupBy("task_type").agg(F.count("*").alias("weight"))


def projection(rows: DataFrame, weights: DataFrame, prices: DataFrame, input_tokens: int = 800_000, by: str = "slug") -> DataFrame:
    """One row per model. rows: slug, task_type, task_category, is_correct, prompt_tokens,
    completion_tokens, cost, thinking_source, error_type; prices: slug, price_in, price_out
    (per million tokens)."""
    known = rows.join(prices, by, "left")
    unpriced = known.where("price_in is null or price_out is null").select(by).limit(1).collect()
    if unpriced:
        raise KeyError(f"no price of {unpriced[0][0]}")
    good = F.coalesce("completion_tokens", F.lit(0)) != 0
    weighted = known.join(weights, "task_type", "left").withColumn("w", F.coalesce("weight", F.lit(0)))
    z = lambda c: F.when(good, F.coalesce(c, F.lit(0)))
    # one pass by model and type, then by model
    per = weighted.groupBy(by, "price_in", "price_out").agg(
        F.count_if(good).alias("n"), F.count_if(~good).alias("error_rows"), F.sum(z("cost")).alias("cost"), F.coalesce(F.sum(z("prompt_tokens")), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum(z("completion_tokens")), F.lit(0)).alias("completion_tokens"),
        F.coalesce(F.sum(F.when(good, F.col("w") * F.col("completion_tokens"))), F.lit(0)).alias("out"), F.count_if(good & (F.coalesce(F.col("is_correct").cast("boolean"), F.lit(False)))).alias("right"),
        F.count_if(good & (F.col("error_type") == "max_token_reached")).alias("max_token_reached"), F.count_distinct(F.when(good, F.col("task_type"))).alias("covered"),
    )
    types = weights.agg(F.count("*").alias("types"))
    native = F.coalesce("cost", F.lit(0.0)) == 0
    listed = (F.col("prompt_tokens") * F.col("price_in") + F.col("completion_tokens") * F.col("price_out")) / 1e6
    whole = (F.lit(float(input_tokens)) * F.col("price_in") + F.col("out") * F.col("price_out")) / 1e6
    return per.crossJoin(F.broadcast(types)).select(  # types is one row
        by, "n", "error_rows", native.alias("native_priced"), F.round(F.when(native, listed).otherwise(F.col("cost")), 4).alias("smoke_cost"), "prompt_tokens", "completion_tokens",
        F.when(F.col("n") > 0, F.round(F.col("right") / F.col("n"), 3)).alias("accuracy"), "max_token_reached", F.round(F.col("out") / 1e6, 2).alias("projected_out_m"), F.round(whole, 2).alias("projected_cost"), (F.col("types") - F.col("covered")).alias("types_missing"),
    )


def by_category(rows: DataFrame, by: str = "slug") -> DataFrame:
    """slug, category, correct, n of rows with tokens."""
    good = rows.where("coalesce(completion_tokens, 0) != 0")
    return good.groupBy(by, F.col("task_category").alias("category")).agg(F.count_if(F.coalesce(F.col("is_correct").cast("boolean"), F.lit(False))).alias("correct"), F.count("*").alias("n"))


def histograms(rows: DataFrame, by: str = "slug") -> DataFrame:
    """slug, kind, value, n: thinking sources and error types of rows with tokens."""
    good = rows.where("coalesce(completion_tokens, 0) != 0")
    correct = F.coalesce(F.col("is_correct").cast("boolean"), F.lit(False))
    error = F.coalesce(F.nullif("error_type", F.lit("")), F.when(correct, F.lit("correct")).otherwise(F.lit("?")))
    source = F.coalesce(F.nullif("thinking_source", F.lit("")), F.lit("none"))
    pair = F.explode(F.array(F.struct(F.lit("thinking_source").alias("kind"), source.alias("value")), F.struct(F.lit("error_type").alias("kind"), error.alias("value"))))
    return good.select(by, pair.alias("x")).groupBy(by, "x.kind", "x.value").agg(F.count("*").alias("n"))
