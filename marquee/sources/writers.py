"""Where results go: views, tables, Parquet copies, JSON, and tables shared within a session."""

from __future__ import annotations

import re
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Keep = Callable[[str, DataFrame], DataFrame]

_local_folders: dict[str, str] = {}


def as_view(df: DataFrame, name: str) -> DataFrame:
    """A lazy view: nothing runs until the view is read."""
    df.createOrReplaceTempView(name)
    return df


def to_parquet(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def to_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def to_table(df: DataFrame, name: str, comments: dict[str, str] | None = None) -> DataFrame:
    """Replace the table ``database.name`` as a whole, with column comments."""
    spark = df.sparkSession
    database, _, _ = name.rpartition(".")
    if database:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for column, comment in (comments or {}).items():
        df = df.withMetadata(column, {"comment": comment})
    df.write.mode("overwrite").format("parquet").saveAsTable(name)
    return spark.table(name)


VERSION = "__v"


def versions(spark: SparkSession, name: str) -> list[str]:
    """The written versions of a published table, oldest first."""
    database, _, short = name.rpartition(".")
    tables = spark.catalog.listTables(database or None, f"{short}{VERSION}*")
    return sorted(f"{database}.{t.name}" if database else t.name for t in tables)


def to_version(df: DataFrame, name: str, comments: dict[str, str] | None = None,
               older: int = 1) -> DataFrame:
    """Publish ``database.name`` so that readers see the old rows or the new ones, never a part.

    The rows are written as a table of their own first; ``name`` is a view that is switched to it in
    one step of the catalog.  ``older`` versions stay behind it: for readers that opened them before
    the switch, and for `to_previous`.  A write that fails leaves everything as it was.
    """
    spark = df.sparkSession
    database, _, _ = name.rpartition(".")
    if database:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for column, comment in (comments or {}).items():
        df = df.withMetadata(column, {"comment": comment})
    written = f"{name}{VERSION}{time.time_ns():020d}"
    try:
        df.write.format("parquet").saveAsTable(written)
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {written}")
        raise
    _switch(spark, name, written)
    for old in versions(spark, name)[:-1 - older]:
        spark.sql(f"DROP TABLE {old}")
    return spark.table(name)


def _switch(spark: SparkSession, name: str, written: str) -> None:
    if spark.catalog.tableExists(name) and spark.catalog.getTable(name).tableType != "VIEW":
        # written in place by an earlier release: it becomes the oldest version
        spark.sql(f"ALTER TABLE {name} RENAME TO {name}{VERSION}{0:020d}")
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {written}")


def to_previous(spark: SparkSession, name: str) -> DataFrame:
    """Switch a published table back to the version before its newest one, which is dropped."""
    known = versions(spark, name)
    if len(known) < 2:
        raise ValueError(f"{name} has no earlier version")
    _switch(spark, name, known[-2])
    spark.sql(f"DROP TABLE {known[-1]}")
    return spark.table(name)


def bucketed(df: DataFrame, name: str, key: str, buckets: int, folder: str | None = None) -> DataFrame:
    """A copy of a fact table laid out by key, so that aggregates by that key need no shuffle.

    Rows are dealt out by key first: a bucket is one file and not one per task.  ``folder`` keeps the
    files outside the warehouse.
    """
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    if folder:
        writer = writer.option("path", f"{folder}/{name}")
    writer.format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def columns_of(spark: SparkSession, table: str) -> DataFrame:
    """(position, column_name, column_type) of a table."""
    fields = spark.table(table).schema.fields
    return spark.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(fields)],
        "position int, column_name string, column_type string",
    ).orderBy(F.col("position"))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder.  Only a local session without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="marquee-")
    return _local_folders[application]


class Shelf:
    """Tables written once per session under the shared folder and read back from there.

    A kept table cuts the lineage: its readers scan Parquet with only the columns they need, and a
    lost executor costs them a re-read, not a rebuild from the facts.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        safe = re.sub(r"[^A-Za-z0-9_.-]+", "_", label).strip("_")
        self.root = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{safe}"
        self._kept: dict[str, DataFrame] = {}

    def __call__(self, name: str, df: DataFrame) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = to_parquet(df, f"{self.root}/{name}.parquet")
        return self._kept[name]

    def __contains__(self, name: str) -> bool:
        return name in self._kept

    def __getitem__(self, name: str) -> DataFrame:
        return self._kept[name]


def unkept(name: str, df: DataFrame) -> DataFrame:
    """The cut point that cuts nothing: the plan stays lazy."""
    return df
