"""Operators that need the rules of chess, as Arrow functions over distinct positions.

Unreadable positions give nulls or empty lists, never an error."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from gambitflow.functions import board


def _per_position(df: DataFrame, cols: list[str], f: Callable, schema: str) -> DataFrame:
    """Runs f(*values) -> tuple on every row; each batch computes equal inputs once."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known: dict = {}
            out: list[list] = [[] for _ in names]
            args = [b.column(k).to_pylist() for k in range(1, len(cols) + 1)]
            for values in zip(*args, strict=True):
                key = tuple(map(str, values))
                if key not in known:
                    known[key] = f(*values)
                for col, v in zip(out, known[key], strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, target.field(n).type) for c, n in zip(out, names, strict=True)]], ["id", *names])

    full = f"id string, {schema}"
    target = to_arrow_schema(df.sparkSession.createDataFrame([], full).schema)
    return df.select(F.col(df.columns[0]).cast("string").alias("id"), *cols).mapInArrow(run, full)


def _safe(fen: str | None) -> board.Position | None:
    try:
        return board.Position.from_fen(fen.split("|")[0].strip()) if fen else None
    except ValueError:
        return None


def legal_moves(df: DataFrame, fen: str = "fen") -> DataFrame:
    """id, moves: sorted legal moves."""

    def f(text):
        p = _safe(text)
        return (None if p is None else sorted(p.uci(m) for m in p.legal()),)

    return _per_position(df, [fen], f, "moves array<string>")


def check_motifs(df: DataFrame, fen: str = "fen") -> DataFrame:
    """id, checks, double_checks, discovered: moves that give check, of three kinds."""

    def f(text):
        p = _safe(text)
        return (None, None, None) if p is None else (board.checking_moves(p), board.double_checks(p), board.discovered_checks(p))

    return _per_position(df, [fen], f, "checks array<string>, double_checks array<string>, discovered array<string>")


def analysed(df: DataFrame, fen: str = "fen") -> DataFrame:
    """id, moves, checks, double_checks, discovered: all that the rules tell of a position, in
    one pass; positions that can't be read are left out."""

    def f(text):
        p = _safe(text)
        return (None,) * 4 if p is None else (sorted(p.uci(m) for m in p.legal()), board.checking_moves(p), board.double_checks(p), board.discovered_checks(p))

    return _per_position(df, [fen], f, "moves array<string>, checks array<string>, double_checks array<string>, discovered array<string>").where("moves is not null")


def legality(df: DataFrame, fen: str = "fen", answer: str = "answer") -> DataFrame:
    """id, legality of an answer that is one move."""
    return _per_position(df, [fen, answer], lambda a, b: (board.legality((a or "").split("|")[0].strip(), b),), "legality string")


def played(df: DataFrame, fen: str = "fen", moves: str = "moves") -> DataFrame:
    """id, final_fen, san: the moves of a list played one after the other; an unreadable
    position or move gives nulls."""

    def f(text, list_):
        try:
            return board.apply_moves(text, list(list_ or [])) if text else (None, None)
        except ValueError:
            return (None, None)

    return _per_position(df, [fen, moves], f, "final_fen string, san array<string>")


def normal_fen(df: DataFrame, fen: str = "fen") -> DataFrame:
    """id, final_fen: parsed and written again; null for what is no position."""

    def f(text):
        p = _safe(text)
        return (None if p is None else p.fen(),)

    return _per_position(df, [fen], f, "final_fen string")
