"""The whole build: staging, intermediate tables, marts."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from marquee.plans import models, staging
from marquee.plans.models import Keep
from marquee.sources import supplied
from marquee.sources.readers import source
from marquee.sources.writers import Shelf, as_view, bucketed, to_version, unkept


class Staged:
    """The staged rows of the four raw sources.  A source is opened when it is first asked for."""

    def __init__(self, raw: Callable[[str], DataFrame]):
        self._raw = raw

    @cached_property
    def items(self) -> DataFrame:
        return staging.staged_items(self._raw("items"))

    @cached_property
    def ratings(self) -> DataFrame:
        return staging.staged_ratings(self._raw("ratings"))

    @cached_property
    def entries(self) -> DataFrame:
        return staging.staged_list_entries(self._raw("list_entries"))

    @cached_property
    def text(self) -> DataFrame:
        return staging.staged_item_text(self._raw("item_text"))


class Facts(NamedTuple):
    ratings: DataFrame
    entries: DataFrame


def facts_by_key(staged: Staged, key: str, prefix: str, folder: str | None = None,
                 buckets: int | None = None) -> Facts:
    """Copies of the facts laid out by a key, made once: aggregates by it read them without a shuffle.

    The facts are shuffled when they are written, once for all builds that follow.  ``buckets`` is the
    session's number of shuffle partitions unless given.
    """
    spark = staged.ratings.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    copies = {}
    for fact in Facts._fields:
        name = f"{prefix}_{fact}_by_{key}"
        copies[fact] = spark.table(name) if spark.catalog.tableExists(name) else bucketed(
            getattr(staged, fact), name, key, buckets, folder
        )
    return Facts(**copies)


def stage_files(spark: SparkSession, paths: dict[str, str]) -> Staged:
    """Stage the named sources from their paths."""
    return Staged(lambda name: source(spark, name, paths[name]))


def stage_supplied(spark: SparkSession, folder: str) -> Staged:
    return Staged(lambda name: getattr(supplied, name)(spark, folder))


def as_views(staged: Staged, prefix: str = "stg_") -> None:
    for name in ("items", "ratings", "entries", "text"):
        as_view(getattr(staged, name), prefix + name)


class Marts:
    """The tables.  Each is made when it is first asked for, from the tables it reads.

    ``keep`` is the cut point between them: it writes a table and hands back its reader, or, left
    out, leaves the whole plan lazy.
    """

    def __init__(self, staged: Staged, keep: Keep = unkept, *, diversity=models.VIEWING_DIVERSITY):
        self._staged, self._keep, self._diversity = staged, keep, diversity

    @cached_property
    def item_stats(self) -> DataFrame:
        s = self._staged
        return self._keep("item_stats", models.item_stats(s.items, s.ratings, s.entries))

    @cached_property
    def user_profiles(self) -> DataFrame:
        s = self._staged
        return self._keep(
            "user_profiles",
            models.user_profiles(s.items, s.ratings, s.entries, keep=self._keep),
        )

    @cached_property
    def tag_metrics(self) -> DataFrame:
        return self._keep("tag_metrics", models.tag_metrics(self.item_stats))

    @cached_property
    def content(self) -> DataFrame:
        return self._keep("content_performance", models.content_performance(
            self.item_stats, self._staged.text
        ))

    @cached_property
    def users(self) -> DataFrame:
        return self._keep("user_segments", models.user_segments(
            self.user_profiles, diversity=self._diversity
        ))

    @cached_property
    def tags(self) -> DataFrame:
        return self._keep("tag_trends", models.tag_trends(self.tag_metrics, self.item_stats))

    def make_all(self) -> Marts:
        """Make every table.  Those that do not read one another are submitted side by side, so
        the tail of one fills up with the tasks of the next."""
        in_session = inheritable_thread_target(self._staged.items.sparkSession)
        with ThreadPoolExecutor(2) as pool:
            users = pool.submit(in_session(lambda: self.users))
            _ = self.item_stats
            content = pool.submit(in_session(lambda: self.content))
            _ = self.tags
            users.result()
            content.result()
        return self


def marts_of(staged: Staged, keep: Keep = unkept, **options) -> Marts:
    return Marts(staged, keep, **options)


def shelved(spark: SparkSession, staged: Staged, label: str, **options) -> Marts:
    """Every table, written once under the shared folder."""
    return marts_of(staged, Shelf(spark, label), **options).make_all()


def save(marts: Marts, database: str = "marts") -> None:
    """Replace the mart tables ``database.content_performance`` and so on, each in one step."""
    to_version(marts.content, f"{database}.content_performance")
    to_version(marts.users, f"{database}.user_segments")
    to_version(marts.tags, f"{database}.tag_trends")
