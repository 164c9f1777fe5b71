"""What several operators share: tables, kept results, connected components, words of a text."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.sources.writers import shared_folder

# fixed values: what the contracts call white space, and so a word
WHITE_SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{WHITE_SPACE}]+"

TEXTS_PER_BATCH = 2500


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crc_of(key: str) -> Column:
    """crc32 of a number written as text; NULL counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")))


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python by no more than TEXTS_PER_BATCH rows, so that a worker holds few at a time.

    The setting of the session is only ever lowered.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if not 0 < now <= TEXTS_PER_BATCH:
        spark.conf.set(name, str(TEXTS_PER_BATCH))


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write a table under the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = _scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _scratch(spark: SparkSession, label: str) -> str:
    name = re.sub(r"[^A-Za-z0-9_-]+", "_", label)
    application = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/{application}/llm/{name}-{uuid.uuid4().hex}"


@contextmanager
def handing_back() -> Iterator[None]:
    """Give a worker's free memory back to the system when a task ends.

    Python workers live on between tasks and stages; without this they keep the pages that their
    largest task has used.
    """
    try:
        yield
    finally:
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by `keep`, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge, component being its smallest reachable node.

    ``edges`` has two long columns, a and b, in any direction, repeats and loops allowed.  Large-star
    and small-star steps alternate until every node hangs on its smallest one; the number of rounds
    grows with the logarithm of the longest chain.  Each round is written to the shared folder, the
    one before last is deleted, and only counts reach the driver.
    """
    links = keep(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("low")).select(
            F.col("a").alias("b"), F.least("a", "low").alias("low")
        )
        large = links.join(lowest, "b").select("a", F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            large.join(low, "a").filter("b <> low").select(F.col("b").alias("a"), "low")
            .unionByName(low)
            .select("a", F.col("low").alias("b")).distinct()
        )
        after = keep(small, "links")
        forget(links)
        links = after
        # done when every node hangs on one other, and nothing hangs on a hanging node
        roles = links.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
        roles = roles.unionByName(
            links.select(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds"))
        ).groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
        if not roles.filter("hangs > 1 or (hangs = 1 and holds = 1)").limit(1).count():
            break
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int,
                    allowed: Column | None = None) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents, to fit a classifier on.

    The documents are those whose id hashes lowest, among ids that ``allowed`` admits.  The label of an
    id labelled more than once is its majority, 1 when even; of several texts under one id the
    smallest counts.  NULL ids, labels and texts take no part.  At most ``rows`` ids are sent to the
    executors.
    """
    voted = labels.select("doc_id", F.col(label).cast("double").alias("label")).dropna()
    if allowed is not None:
        voted = voted.filter(allowed)
    chosen = (
        voted.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    return (
        docs.select("doc_id", "text").dropna().join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    )
