"""Cleaning and judging of comments with a pluggable model.

The model is a function from rows with chat messages to rows with its text; without one the
text itself stands for the model's answer, so the pipeline runs offline and repeatably. What
the model leaves undone - names, pronouns, notation - is finished by column expressions.

Defined results: null and blank comments are skipped; SKIP and comments that nothing is left
of are dropped; an item without a label is dropped by the judge; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gambitflow.functions import text

Model = Callable[[DataFrame], DataFrame]  # id, messages -> id, reply

#: Rules and worked examples given to a cleaning model; own wording, the caller's to replace.
CLEANING = "You clean comments on chess games. Answer with one line: the comment, with every mention of the white player replaced by White and of the black player by Black, or the word SKIP if it names any other person. Change nothing else."
CLEANING_SHOTS = [
    ("Comment: Petrov blundered, as I told him.\nWhite: Petrov, Ivan\nBlack: Lang, Eva", "White blundered, as I told him."),
    ("Comment: My coach Ety loved such endings.\nWhite: Petrov, Ivan\nBlack: Lang, Eva", "SKIP"),
]
JUDGING = "You judge comments on chess games. Answer with one word: KEEP if the comment tells something about the position, a move or a plan, else DROP."
JUDGING_SHOTS = [("The knight on e5 cannot be driven away.", "KEEP"), ("What a lovely tournament hall.", "DROP")]


def messages(system: Column | str, shots: list[tuple[str, str]], asked: Column) -> Column:
    """array<struct(role, content)>: the rules, worked examples, then what is asked."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), (F.lit(c) if isinstance(c, str) else c).alias("content"))
    return F.array(turn("system", system), *[t for q, a in shots for t in (turn("user", q), turn("assistant", a))], turn("user", asked))


def best_comment(cleaned: Column, comment: Column) -> Column:
    """The cleaned comment unless it is empty, else the raw one."""
    return F.coalesce(F.nullif(cleaned, F.lit("")), comment)


def cleaning_messages(items: DataFrame) -> DataFrame:
    """id, messages of items with comment, white_player, black_player, annotator."""
    e = lambda c: text.strip(F.coalesce(F.col(c), F.lit("")))
    asked = F.concat(F.lit("Comment: "), text.strip_notation(text.plain_symbols(e("comment"))), F.lit("\nWhite: "), e("white_player"), F.lit("\nBlack: "), e("black_player"))
    side = text.annotator_side(F.col("annotator"), F.col("white_player"), F.col("black_player"))
    own = F.concat(F.lit(" The writer is the player of "), side, F.lit(": rewrite I, me, my, mine and myself to that side."))
    return items.select("id", messages(F.concat(F.lit(CLEANING), F.coalesce(own, F.lit(""))), CLEANING_SHOTS, asked).alias("messages"))


def cleaned(items: DataFrame, model: Model | None = None) -> DataFrame:
    """Items with `original_comment`, `cleaned_comment` and `comment` replaced by it; those to
    be skipped are left out. items: id, comment, white_player, black_player, annotator, ..."""
    rows = items.where(F.length(text.strip(F.coalesce("comment", F.lit("")))) > 0)
    said = model(cleaning_messages(rows)).select(F.col("id").alias("_id"), "reply") if model else None
    joined = rows.join(said, F.col("id") == F.col("_id"), "left").drop("_id") if said is not None else rows.withColumn("reply", F.col("comment"))
    pick = text.clean_model_text(F.col("reply")) if model else F.col("reply")
    side = text.annotator_side(F.col("annotator"), F.col("white_player"), F.col("black_player"))
    done = text.strip_notation(text.plain_symbols(F.col("_said")))
    done = text.replace_aliases(text.replace_aliases(done, text.aliases(F.col("white_player")), "White"), text.aliases(F.col("black_player")), "Black")
    out = joined.withColumn("_said", pick).where(F.upper("_said") != "SKIP").withColumn("cleaned_comment", text.replace_first_person(done, side))
    return out.where("cleaned_comment != ''").withColumn("original_comment", F.col("comment")).withColumn("comment", F.col("cleaned_comment")).drop("_said", "reply")


def judged(items: DataFrame, model: Model | None = None, heuristics: bool = True) -> DataFrame:
    """Items that are kept: those that the rules do not drop and that the model, asked only
    about these, labels KEEP. Without a model the rules alone decide."""
    shown = text.plain_symbols(best_comment(F.col("cleaned_comment"), F.col("comment")))
    rows = items.withColumn("_shown", text.strip(F.coalesce(shown, F.lit(""))))
    passed = rows.where(text.relevant(F.col("_shown"))) if heuristics else rows
    if model:
        asked = passed.select("id", messages(JUDGING, JUDGING_SHOTS, F.col("_shown")).alias("messages"))
        labels = model(asked).select("id", text.keep_or_drop(F.col("reply")).alias("_label"))
        passed = passed.join(labels.where("_label = 'KEEP'").select("id"), "id", "left_semi")
    return passed.drop("_shown")
