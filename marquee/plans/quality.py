"""Data tests.  Each returns (table_name, column_name, check_name, failing_rows, passed)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from marquee.plans.warehouse import Marts, Staged
from marquee.sources.writers import Shelf

# fixed values
ITEM_TYPES = ["TV", "OVA", "Movie", "Special", "ONA", "Music", "Unknown"]
ENTRY_STATUSES = ["Watching", "Completed", "On Hold", "Dropped", "Plan to Watch", "Unknown"]


def _verdict(failures: DataFrame, table: str, column: str, check: str) -> DataFrame:
    """From a one-row frame (failing_rows)."""
    return failures.select(
        F.lit(table).alias("table_name"),
        F.lit(column).alias("column_name"),
        F.lit(check).alias("check_name"),
        "failing_rows",
        (F.col("failing_rows") == 0).alias("passed"),
    )


def unique(df: DataFrame, table: str, column: str) -> DataFrame:
    """Fails once per value held by several rows; NULLs do not count."""
    repeated = (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("n"))
        .agg(F.count_if(F.col("n") > 1).alias("failing_rows"))
    )
    return _verdict(repeated, table, column, "unique")


Check = tuple[str, str, Column]


def _failures(checks: Sequence[Check]) -> list[Column]:
    return [F.coalesce(F.sum(failures.cast("long")), F.lit(0)).alias(f"_{i}")
            for i, (_, _, failures) in enumerate(checks)]


def row_checks(df: DataFrame, table: str, checks: Sequence[Check]) -> DataFrame:
    """Several checks of one table in one pass: (column, check, failures of a row, 0 or more)."""
    counts = df.agg(*_failures(checks))
    rows = [
        F.struct(
            F.lit(table).alias("table_name"),
            F.lit(column).alias("column_name"),
            F.lit(check).alias("check_name"),
            F.col(f"_{i}").alias("failing_rows"),
            (F.col(f"_{i}") == 0).alias("passed"),
        )
        for i, (column, check, _) in enumerate(checks)
    ]
    return counts.select(F.inline(F.array(*rows)))


def _missing(columns: Sequence[str]) -> list[Check]:
    return [(c, "not_null", F.col(c).isNull()) for c in columns]


def _unlisted(values: dict[str, Sequence[str]]) -> list[Check]:
    return [(c, "accepted_values", F.col(c).isNotNull() & ~F.col(c).isin(list(allowed)))
            for c, allowed in values.items()]


def not_null(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    return row_checks(df, table, _missing(columns))


def accepted_values(df: DataFrame, table: str, values: dict[str, Sequence[str]]) -> DataFrame:
    return row_checks(df, table, _unlisted(values))


def orphans(child: DataFrame, parent: DataFrame, table: str, column: str) -> DataFrame:
    """Child rows whose key the parent lacks.  The child meets the parent as keys with counts.

    Both are sorted by the key: one column of a wide compressed file looks small to Spark, which would
    broadcast the keys of the whole parent.
    """
    keyed = child.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    lost = keyed.join(parent.select(column).hint("merge"), column, "left_anti").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("failing_rows")
    )
    return _verdict(lost, table, column, "relationships")


# fixed values
LIMITS = {
    "completion_rate": (0.0, 1.0),
    "drop_rate": (0.0, 1.0),
    "performance_score": (0.0, 1.0),
    "community_score": (1.0, 10.0),
}


def out_of_range(content: DataFrame) -> DataFrame:
    """(metric, item_id, value) of rates and scores outside their range, from one scan."""
    cells = [
        F.struct(F.lit(name).alias("metric"), F.col(name).alias("value"),
                 F.lit(low).alias("low"), F.lit(high).alias("high"))
        for name, (low, high) in LIMITS.items()
    ]
    return content.select("item_id", F.inline(F.array(*cells))).filter(
        (F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))
    ).select("metric", "item_id", "value")


def _outside() -> list[Check]:
    outside = [F.coalesce(~F.col(name).between(low, high), F.lit(False)).cast("int")
               for name, (low, high) in LIMITS.items()]
    return [("rates and scores", "valid_ranges", reduce(Column.__add__, outside))]


def ranges(content: DataFrame) -> DataFrame:
    return row_checks(content, "content", _outside())


def more_ratings_than_entries(stats: DataFrame) -> DataFrame:
    """(item_id, rating_count, total_list_count): ratings are a part of the list entries."""
    return stats.filter(F.col("rating_count") > F.col("total_list_count")).select(
        "item_id", "rating_count", "total_list_count"
    )


def _excess() -> list[Check]:
    more = F.coalesce(F.col("rating_count") > F.col("total_list_count"), F.lit(False))
    return [("rating_count", "at_most_total_list_count", more)]


def cross_column(stats: DataFrame) -> DataFrame:
    return row_checks(stats, "item_stats", _excess())


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def all_unique(s: Staged, m: Marts) -> DataFrame:
    return _union([
        unique(s.items, "stg_items", "item_id"),
        unique(s.text, "stg_item_text", "item_id"),
        unique(m.item_stats, "item_stats", "item_id"),
        unique(m.user_profiles, "user_profiles", "user_id"),
        unique(m.tag_metrics, "tag_metrics", "tag"),
        unique(m.content, "content", "item_id"),
        unique(m.users, "users", "user_id"),
        unique(m.tags, "tags", "tag"),
    ])


REQUIRED = {
    "stg_items": ["item_id", "name"],
    "stg_ratings": ["user_id", "item_id", "rating"],
    "stg_list_entries": ["user_id", "item_id"],
    "stg_item_text": ["item_id"],
    "item_stats": ["item_id"],
    "user_profiles": ["user_id"],
    "tag_metrics": ["tag"],
    "content": ["item_id"],
    "users": ["user_id"],
    "tags": ["tag"],
}
ACCEPTED = {"stg_items": {"type": ITEM_TYPES}, "stg_list_entries": {"status": ENTRY_STATUSES}}


def _table(s: Staged, m: Marts, name: str) -> DataFrame:
    staged = {"stg_items": "items", "stg_ratings": "ratings", "stg_list_entries": "entries",
              "stg_item_text": "text"}
    return getattr(s, staged[name]) if name in staged else getattr(m, name)


def all_not_null(s: Staged, m: Marts) -> DataFrame:
    return _union([not_null(_table(s, m, name), name, columns) for name, columns in REQUIRED.items()])


def all_accepted(s: Staged) -> DataFrame:
    return _union([
        accepted_values(s.items, "stg_items", ACCEPTED["stg_items"]),
        accepted_values(s.entries, "stg_list_entries", ACCEPTED["stg_list_entries"]),
    ])


def all_orphans(s: Staged, m: Marts) -> DataFrame:
    return _union([
        orphans(m.item_stats, s.items, "item_stats", "item_id"),
        orphans(m.content, m.item_stats, "content", "item_id"),
        orphans(m.users, m.user_profiles, "users", "user_id"),
        orphans(m.tags, m.tag_metrics, "tags", "tag"),
    ])


def _checks_of(name: str) -> list[Check]:
    """All checks of the rows of a table."""
    further = {"content": _outside, "item_stats": _excess}
    return [*_missing(REQUIRED[name]), *_unlisted(ACCEPTED.get(name, {})),
            *(further[name]() if name in further else [])]


def all_checks(s: Staged, m: Marts, seen: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """The thirty checks as one table: one pass per table for all checks of rows, one per key.

    ``seen`` are failures counted when tables were written (`CheckedShelf`); those are not scanned again.
    """
    seen = seen or {}
    spark = s.items.sparkSession
    known = [
        (name, column, check, int(seen[name][f"_{i}"]), seen[name][f"_{i}"] == 0)
        for name in REQUIRED if name in seen
        for i, (column, check, _) in enumerate(_checks_of(name))
    ]
    parts = [all_unique(s, m), all_orphans(s, m), *[
        row_checks(_table(s, m, name), name, _checks_of(name)) for name in REQUIRED if name not in seen
    ]]
    if known:
        parts.append(spark.createDataFrame(
            known, "table_name string, column_name string, check_name string, failing_rows long,"
                   " passed boolean"))
    return _union(parts)


# what the tables are called where they are kept
KEPT_AS = {"content_performance": "content", "user_segments": "users", "tag_trends": "tags"}


class CheckedShelf(Shelf):
    """A shelf that counts the failures of row checks while it writes a table: no second scan."""

    def __init__(self, spark: SparkSession, label: str):
        super().__init__(spark, label)
        self.failures: dict[str, dict[str, int]] = {}

    def __call__(self, name: str, df: DataFrame) -> DataFrame:
        table = KEPT_AS.get(name, name)
        if name in self or table not in REQUIRED:
            return super().__call__(name, df)
        counted = Observation()
        written = super().__call__(name, df.observe(counted, *_failures(_checks_of(table))))
        self.failures[table] = counted.get
        return written
