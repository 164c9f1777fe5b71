"""Column expressions shared by the plans.  Everything here is a native Spark expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "Unknown"
NO_TEXT_PREFIX = "No synopsis"


def try_double(c: Column) -> Column:
    return c.try_cast("double")


def try_int(c: Column) -> Column:
    """Text to int; ``12.0`` and ``1e3`` are numbers too, ``4.5`` rounds, junk is NULL."""
    return F.round(c.try_cast("double")).try_cast("int")


def year_of(c: Column) -> Column:
    """First run of four digits."""
    return F.regexp_extract(c, r"(\d{4})", 1).try_cast("int")


def season_of(c: Column) -> Column:
    """First word of ``Spring 2016``; NULL for the sentinel."""
    return F.when(known(c), F.split_part(c, F.lit(" "), F.lit(1)))


def known(c: Column) -> Column:
    return c.isNotNull() & (c != UNKNOWN)


def has_text(c: Column) -> Column:
    return F.coalesce((c != "") & ~c.startswith(NO_TEXT_PREFIX), F.lit(False))


def words_by_space(c: Column) -> Column:
    """Pieces between single spaces, empty pieces counted; 0 when there is no usable text."""
    usable = F.coalesce((F.trim(c) != "") & ~c.startswith(NO_TEXT_PREFIX), F.lit(False))
    return F.when(usable, F.size(F.split(F.trim(c), " "))).otherwise(0).cast("long")


def words_by_whitespace(c: Column) -> Column:
    """Runs of non-whitespace; NULL text gives NULL."""
    return F.regexp_count(c, F.lit(r"\S+")).cast("long")


def ladder(c: Column, rungs: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first rung whose bound is at or below the value; NULL takes ``otherwise``."""
    out = None
    for bound, label in rungs:
        out = (F if out is None else out).when(c >= bound, label)
    return out.otherwise(otherwise)


def cut(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins ``(edges[i], edges[i+1]]``; NULL outside."""
    out = None
    for low, high, label in zip(edges, edges[1:], labels, strict=False):
        out = (F if out is None else out).when((c > low) & (c <= high), label)
    return out


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double, NULL when the whole is 0."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    return 100.0 * ratio(part, whole)


def growth(recent: Column, previous: Column) -> Column:
    return F.when(previous > 0, (recent - previous) / previous)


def unit_score(c: Column) -> Column:
    """A 1..10 score mapped to 0..1, scaled by the caller's weight."""
    return (c - 1.0) / 9.0


def round_to(c: Column, digits: int) -> Column:
    """Round half away from zero on the binary value: scale, round to a whole, scale back.

    ``F.round(c, digits)`` rounds the decimal text instead, so 1.005 would give 1.01.
    """
    if digits == 0:
        return F.round(c)
    scale = float(10**digits)
    return F.round(c * scale) / scale


def round_mean(c: Column, digits: int) -> Column:
    """``round_to`` for means: a mean that is a tie but for its last bits is taken as the tie.

    The last bits depend on the order of summation, which no engine promises.
    """
    return round_to(round_to(c, 9), digits)


def special_share(c: Column) -> Column:
    """Characters other than ASCII letters, digits and whitespace, per character."""
    return F.regexp_count(c, F.lit(r"[^a-zA-Z0-9\s]")).cast("double") / F.greatest(
        F.length(c), F.lit(1)
    )


def first_listed(c: Column, delimiter: str = ",") -> Column:
    return F.trim(F.split_part(c, F.lit(delimiter), F.lit(1)))


def equal_width_bin(c: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based bin of a value in [low, high]; the maximum belongs to the last bin."""
    position = F.floor((c - low) / (high - low) * bins)
    return F.when(high > low, F.least(position, F.lit(bins - 1))).otherwise(F.lit(0)).cast("long")


def cells_equal(expected: Column, actual: Column, tolerance: float = 0.05) -> Column:
    """Equality of two result cells, each a struct of ``num`` (fractional), ``whole`` or ``txt``.

    Fractional values match within the relative tolerance (exactly when zero is expected),
    whole numbers and text match exactly, NULL matches NULL and NaN matches NaN.
    """
    e_num, a_num = expected["num"], actual["num"]
    both_missing = F.lit(True)
    for kind in ("num", "whole", "txt"):
        both_missing = both_missing & expected[kind].isNull() & actual[kind].isNull()
    both_nan = F.isnan(e_num) & F.isnan(a_num)
    close = F.when(e_num == 0, a_num == 0).otherwise(
        F.abs(e_num - a_num) < F.abs(e_num) * tolerance
    )
    return both_missing | F.coalesce(
        F.when(e_num.isNotNull() & a_num.isNotNull(),
               both_nan | (close & ~F.isnan(e_num) & ~F.isnan(a_num))),
        expected["whole"] == actual["whole"],
        expected["txt"] == actual["txt"],
        F.lit(False),
    )
