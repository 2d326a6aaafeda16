"""Boards as 64-character strings, by column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gambitflow.functions.board import square_name
from gambitflow.functions.text import strip


def board_string(fen: Column) -> Column:
    """64 squares from a1 to h8; null if the text is no placement."""
    placement = F.get(F.split(strip(fen), r"\s+"), F.lit(0))
    for n in range(8, 0, -1):
        placement = F.replace(placement, F.lit(str(n)), F.lit("." * n))
    board = F.array_join(F.reverse(F.split(placement, "/")), "")
    return F.when(placement.rlike(r"\A(?:[pnbrqkPNBRQK.]{8}/){7}[pnbrqkPNBRQK.]{8}\z"), board)


def board_difference(a: Column, b: Column) -> Column:
    """Names of the squares on which two board strings differ, sorted."""
    names = F.array(*[F.lit(square_name(s)) for s in range(64)])
    differs = lambda s, i: F.when(F.substring(a, i + 1, F.lit(1)) != F.substring(b, i + 1, F.lit(1)), s)
    return F.array_sort(F.filter(F.transform(names, differs), lambda x: x.isNotNull()))
