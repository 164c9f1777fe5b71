"""Tolerant comparison of query results, and the rates that sum it up.

Results are tables of rows: ``expected`` (query_id, row_no, cells) and ``actual`` with a ``mode`` in
front.  A cell is (column, num, whole, txt): ``num`` if the column is fractional, ``whole`` if it holds
whole numbers, else ``txt``, none of them if it is NULL.  All rows of a result have the same columns;
rows are numbered from 0.

A result without rows has no cells to tell its columns.  ``runs`` (mode, query_id, expected_columns,
actual_columns) names every run and its columns, NULL for a run that failed; left out, the runs are
those that have rows on both sides.

Only fractions get the tolerance.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.columns import cells_equal, round_to
from marquee.operators.distribution import VALUES_PER_RANGE, number_rows
from marquee.sources.writers import Keep, unkept

RUN = ["mode", "query_id"]
SLOTS = ["num", "whole", "txt"]
TOLERANCE = 0.05
ENOUGH = 0.5


def row_cells(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Wide result rows to (keys..., cells)."""
    kinds = dict(df.dtypes)

    def cell(name: str) -> Column:
        kind = kinds[name]
        fractional = kind in ("double", "float") or kind.startswith("decimal")
        whole = kind in ("tinyint", "smallint", "int", "bigint")
        held = {"double": fractional, "bigint": whole, "string": not fractional and not whole}
        slots = [F.col(name).cast(to) if here else F.lit(None).cast(to)
                 for to, here in held.items()]
        return F.struct(F.lit(name).alias("column"), *[
            slot.alias(into) for slot, into in zip(slots, SLOTS, strict=True)
        ])

    return df.select(*keys, F.array(*[cell(c) for c in columns]).alias("cells"))


def _shape(results: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    """Rows and column names per result; only partial counts are shuffled."""
    names = F.transform("cells", lambda cell: cell["column"])
    counted = results.groupBy(*keys, names.alias("names")).agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(
        F.sum("n").alias(f"{side}_rows"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("names"))))
        .alias(f"{side}_columns"),
    )


def shapes_of(expected: DataFrame, actual: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """One small row per run: do the sizes agree, and which columns do both sides have?"""
    actual_shape = _shape(actual, RUN, "actual")
    expected_shape = _shape(expected, ["query_id"], "expected")
    if runs is None:
        shapes = actual_shape.join(expected_shape, "query_id")
    else:
        named = runs.select(*RUN, F.array_sort("expected_columns").alias("expected_columns"),
                            F.array_sort("actual_columns").alias("actual_columns"))
        shapes = (
            named.join(actual_shape.drop("actual_columns"), RUN, "left")
            .join(expected_shape.drop("expected_columns"), "query_id", "left")
            .fillna(0, ["actual_rows", "expected_rows"])
        )
    ran = F.col("expected_columns").isNotNull() & F.col("actual_columns").isNotNull()
    common = F.coalesce(
        F.array_intersect("expected_columns", "actual_columns"), F.array().cast("array<string>")
    )
    return shapes.select(
        *RUN,
        (ran & (F.col("expected_rows") == F.col("actual_rows"))).alias("row_match"),
        (ran & (F.size("expected_columns") == F.size("actual_columns"))).alias("col_match"),
        common.alias("common"),
        F.col("expected_rows").alias("size"),
    )


def structure(expected: DataFrame, actual: DataFrame, runs: DataFrame | None = None,
              shapes: DataFrame | None = None) -> DataFrame:
    """Per run: are there as many rows and as many columns, and how many columns are common?

    ``shapes`` are `shapes_of` the same results, if they are made already.
    """
    return (shapes or shapes_of(expected, actual, runs)).select(
        *RUN, "row_match", "col_match",
        (F.col("row_match") & F.col("col_match")).alias("structure_match"),
        F.size("common").cast("long").alias("common_columns"),
    )


def first_row(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Per run: do at least half of the common columns agree in the first row, as returned?"""
    first = F.col("row_no") == 0

    def cells_of(results: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
        cells = results.filter(first).select(*keys, F.explode("cells").alias(name))
        return cells.withColumn("column", F.col(name)["column"])

    e = cells_of(expected, ["query_id"], "e")
    a = cells_of(actual, RUN, "a")
    return a.join(e, ["query_id", "column"]).groupBy(*RUN).agg(
        (F.avg(cells_equal(F.col("e"), F.col("a"), TOLERANCE).cast("int")) >= ENOUGH)
        .alias("first_row_match")
    )


def _placed(results: DataFrame, runs: DataFrame, on: Sequence[str], keys: Sequence[str], into: str,
            largest: int | None, per_range: int, keep: Keep) -> DataFrame:
    """Rows of every run, cut to its common columns, fractions rounded to 2, numbered in the order of
    their first common column by its own type, then of the others; NULL comes last."""
    shared = F.filter("cells", lambda cell: F.array_contains("common", cell["column"]))
    rounded = F.sort_array(F.transform(shared, lambda cell: F.struct(
        cell["column"].alias("column"),
        reduce(Column.__and__, [cell[slot].isNull() for slot in SLOTS]).alias("missing"),
        round_to(cell["num"], 2).alias("num"),
        cell["whole"].alias("whole"),
        cell["txt"].alias("txt"),
    )))
    # all rows of a result have the same columns: their names order the cells, not the rows
    nameless = F.transform(rounded, lambda cell: F.struct(*[cell[c].alias(c) for c in ("missing", *SLOTS)]))
    rows = results.join(runs, list(on)).select(*keys, "row_no", nameless.alias(into))
    return number_rows(
        rows, [into, "row_no"], keys, "place", sizes=runs.select(*keys, "size"), largest=largest,
        per_range=per_range, keep=lambda name, df: keep(f"compared_{into}_{name}", df),
    ).drop("row_no")


def result(
    expected: DataFrame, actual: DataFrame, runs: DataFrame | None = None,
    *, shapes: DataFrame | None = None, per_range: int = VALUES_PER_RANGE, keep: Keep = unkept,
) -> DataFrame:
    """Per run with equal row counts: do half of the rows agree in half of their common columns?

    Both sides are sorted by their common columns in the order of the names and compared by place.
    ``shapes`` are `shapes_of` the same results, if they are made already; ``keep`` is the cut point
    after the runs and around the sorting of each side.
    """
    # modes with the same common columns of a query share one order of its expected rows
    alike = Window.partitionBy("query_id", "common")
    runs = keep("compared_runs", (shapes or shapes_of(expected, actual, runs)).filter(
        F.col("row_match") & (F.size("common") > 0) & (F.col("size") > 0)
    ).select(*RUN, "common", "size", F.min("mode").over(alike).alias("of")))
    largest = None if keep is unkept else runs.agg(F.max("size")).first()[0]
    e = _placed(expected, runs.filter(F.col("mode") == F.col("of")).drop("mode"), ["query_id"],
                ["query_id", "of"], "e", largest, per_range, keep)
    a = _placed(actual, runs, RUN, [*RUN, "of"], "a", largest, per_range, keep)
    paired = a.join(e, ["query_id", "of", "place"])
    agreeing = F.size(F.filter(
        F.zip_with("e", "a", lambda x, y: cells_equal(x, y, TOLERANCE)), lambda same: same
    ))
    return (
        paired.withColumn("row_agrees", agreeing >= F.size("e") * ENOUGH)
        .groupBy(*RUN)
        .agg(
            F.count("*").alias("rows_compared"),
            F.count_if("row_agrees").alias("rows_agreeing"),
            (F.avg(F.col("row_agrees").cast("int")) >= ENOUGH).alias("result_match"),
        )
    )


def verdicts(expected: DataFrame, actual: DataFrame, runs: DataFrame | None = None,
             compared: DataFrame | None = None, shapes: DataFrame | None = None) -> DataFrame:
    """The three levels side by side, one row per run.  ``compared`` is `result` and ``shapes`` are
    `shapes_of` the same results, if they are made already."""
    out = structure(expected, actual, runs, shapes)
    if compared is None:
        compared = result(expected, actual, runs, shapes=shapes)
    for level in (first_row(expected, actual), compared):
        out = out.join(level, RUN, "left")
    false = F.lit(False)
    return out.select(
        *RUN, "row_match", "col_match", "structure_match",
        F.coalesce("first_row_match", false).alias("first_row_match"),
        F.coalesce("result_match", false).alias("result_match"),
        "common_columns",
    )


def error_label(message: Column) -> Column:
    """Kind of failure, from the words of the message; the first rule that fits decides."""
    text = F.lower(message)

    def says(*words: str) -> Column:
        return reduce(Column.__and__, [text.contains(w) for w in words])

    return (
        F.when(message.isNull(), None)
        .when(says("syntax") | says("parser"), "syntax_error")
        .when(says("no such table") | says("table", "not found"), "wrong_table")
        .when(says("no such column") | says("column", "not found"), "wrong_column")
        .when(says("join"), "wrong_join")
        .when(says("type") | says("cast"), "type_error")
        .when(says("binder"), "binder_error")
        .otherwise("other_error")
    )


def outcomes(attempts: DataFrame, verdict: DataFrame) -> DataFrame:
    """Attempts (mode, query_id, difficulty, category, message) with their flags.

    An attempt with a message has failed and matches nothing.
    """
    ran = F.col("message").isNull()
    flags = verdict.select(*RUN, "structure_match", "result_match")
    joined = attempts.join(flags, RUN, "left")
    return joined.select(
        *attempts.columns,
        ran.alias("success"),
        error_label(F.col("message")).alias("error_type"),
        *[(ran & F.coalesce(F.col(c), F.lit(False))).alias(c)
          for c in ("structure_match", "result_match")],
    )


_FLAGS = {"success": "execution_success", "structure_match": "structure_match",
          "result_match": "result_match"}


def rates(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts and rates of the three flags per group."""
    return df.groupBy(*by).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col(flag)).alias(name) for flag, name in _FLAGS.items()],
        *[round_to(F.avg(F.col(flag).cast("int")), 4).alias(f"{name}_rate")
          for flag, name in _FLAGS.items()],
    )


def rates_by_level(df: DataFrame) -> DataFrame:
    """Rates per mode and difficulty and per mode and category, in one pass."""
    grouped = df.groupingSets(
        [["mode", "difficulty"], ["mode", "category"]], "mode", "difficulty", "category"
    ).agg(
        F.grouping("difficulty").alias("_no_difficulty"),
        F.count("*").alias("total"),
        *[F.count_if(F.col(flag)).alias(name) for flag, name in _FLAGS.items()],
    )
    by_category = F.col("_no_difficulty") == 1
    return grouped.select(
        "mode",
        F.when(by_category, "category").otherwise("difficulty").alias("level"),
        F.when(by_category, F.col("category")).otherwise(F.col("difficulty")).alias("value"),
        "total",
        *_FLAGS.values(),
    )


def error_counts(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("success")).groupBy("mode", "error_type").agg(
        F.count("*").alias("attempt_count")
    )


def mode_difference(df: DataFrame, base: str, other: str) -> DataFrame:
    """Each rate in two modes and by how much it changes."""
    names = list(_FLAGS.values())
    row = df.agg(*[
        F.avg(F.when(F.col("mode") == mode, F.col(flag).cast("int"))).alias(f"{name}_{side}")
        for flag, name in _FLAGS.items()
        for side, mode in (("base", base), ("other", other))
    ])
    cells = [
        F.struct(
            F.lit(f"{n}_rate").alias("measure"),
            round_to(F.col(f"{n}_base"), 4).alias("base_rate"),
            round_to(F.col(f"{n}_other"), 4).alias("other_rate"),
            (round_to(F.col(f"{n}_other"), 4) - round_to(F.col(f"{n}_base"), 4)).alias("change"),
        )
        for n in names
    ]
    return row.select(F.inline(F.array(*cells)))
