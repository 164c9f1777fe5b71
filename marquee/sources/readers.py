"""Raw sources by name.  A reader takes (spark, path) and returns the raw DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marquee.sources import schemas


def _csv(spark: SparkSession, path: str, schema: StructType, *, multiline: bool) -> DataFrame:
    """Read by header name, so that sources with more or reordered columns still fit.

    A header that lacks a column is refused.  All files of a source must share one header: Spark
    compares each file's header with that of the first and fails where they differ, so that no
    value can land under another name.  Quotes inside quoted text are doubled.  A multi-line file cannot be split: keep such data in
    many files, or copy it to Parquet once with ``writers.to_parquet``.
    """
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": multiline,
               "enforceSchema": False}
    header = spark.read.options(**options).csv(path).columns
    absent = [f.name for f in schema if f.name not in header]
    if absent:
        raise ValueError(f"{path} has no column {', '.join(absent)}")
    as_text = ", ".join(f"`{name}` string" for name in header)
    raw = spark.read.options(**options).schema(as_text).csv(path)
    return raw.select([
        F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema
    ])


def items(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.ITEMS, multiline=True)


def ratings(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.RATINGS, multiline=False)


def list_entries(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.LIST_ENTRIES, multiline=False)


def item_text(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.ITEM_TEXT, multiline=True)


SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "items": items,
    "ratings": ratings,
    "list_entries": list_entries,
    "item_text": item_text,
}


def source(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A named raw source; Parquet copies (``*.parquet``) are read as they are."""
    if name not in SOURCES:
        raise KeyError(f"no source {name!r}; known: {sorted(SOURCES)}")
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return SOURCES[name](spark, path)
