"""Comma lists to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.columns import UNKNOWN, known


def pieces(c: Column, delimiter: str = ",") -> Column:
    """Trimmed, non-empty parts of a delimited text."""
    parts = F.transform(F.split(c, rf"\Q{delimiter}\E"), lambda part: F.trim(part))
    return F.filter(parts, lambda part: part != "")


def explode_list(
    df: DataFrame, column: str, into: str, *, delimiter: str = ",", drop_unknown: bool = True
) -> DataFrame:
    """One row per listed value.  NULL lists give no rows, nor does the sentinel if dropped.

    Filtering comes first, so a list that is not wanted is never split.
    """
    kept = df.filter(known(F.col(column))) if drop_unknown else df
    return kept.withColumn(into, F.explode(pieces(F.col(column), delimiter)))


def list_length(c: Column, delimiter: str = ", ") -> Column:
    """Number of listed values, 0 for NULL and for the sentinel."""
    kept = F.filter(pieces(c, delimiter), lambda part: part != UNKNOWN)
    return F.when(known(c), F.size(kept)).otherwise(0).cast("long")
