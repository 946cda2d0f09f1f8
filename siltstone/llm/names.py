"""Column names of a caller's table: quoting them, and drawing helper names that it doesn't have."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """The column of exactly this name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def cols(names: Iterable[str]) -> list[Column]:
    return [col(n) for n in names]


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """For each wanted name, one like it that is not taken; letter case doesn't count, as in Spark."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def without(frame: DataFrame, *names: str) -> DataFrame:
    """The frame without columns of these names, in any letter case."""
    gone = {n.lower() for n in names}
    return frame.select(*cols(c for c in frame.columns if c.lower() not in gone))
