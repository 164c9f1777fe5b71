"""What the plans promise on a large cluster."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marquee.operators.distribution import add_ranks, cumulative
from marquee.operators.stats import favourite
from marquee.plans import models, profiling, quality, registry
from marquee.plans.registry import marts, staged
from tests.conftest import SMALL


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


def test_no_plan_pairs_all_rows_or_gathers_them_in_one_task(spark, no_broadcast):
    """Without size-based broadcasts every join still has a key, no row goes to Python, and what
    ends in a single task is already aggregated or limited."""
    marts(spark, SMALL).make_all()
    bounded = re.compile(r"(\(\d+\) )?(HashAggregate|ObjectHashAggregate|SortAggregate|LocalLimit|"
                         r"TakeOrderedAndProject|Sort )")
    for name, query in registry.all_queries().items():
        plan = executed(query(spark, SMALL))
        for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
            assert word not in plan, (name, word)
        lines = [line.lstrip(" :+-*") for line in plan.split("\n")]
        for line, below in zip(lines, lines[1:], strict=False):
            if line.startswith("Exchange SinglePartition"):
                assert bounded.match(below), (name, below[:120])


def test_facts_are_read_by_column(spark):
    stats = models.item_stats(*_facts(spark))
    plan = executed(stats.select("item_id", "completion_rate"))
    read = [s for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan) if "l_partkey" in s]
    assert read
    assert all("l_extendedprice" not in s and "l_quantity" not in s for s in read)


def test_status_filter_reaches_the_scan(spark):
    plan = executed(staged(spark, SMALL).items.filter("item_id = 7").select("name"))
    assert "PushedFilters: [IsNotNull(p_partkey), EqualTo(p_partkey,7)]" in plan


def _facts(spark):
    s = staged(spark, SMALL)
    return s.items, s.ratings, s.entries


def test_items_are_dealt_out_before_their_texts_are_made(spark):
    """The file of parts is one task's; making and parsing texts must not be."""
    columns = ["item_id", "score", "followers", "favorites", "start_year", "season", "episodes"]
    plan = executed(staged(spark, SMALL).items.select(*columns))
    above, exchange, below = plan.partition("Exchange hashpartitioning(p_partkey")
    assert exchange
    assert "regexp_extract" in above
    assert "regexp_extract" not in below and "concat" not in below


def test_generated_code_of_item_stats_is_compiled(spark, no_broadcast):
    """The JVM leaves methods above 8,000 bytes to its interpreter."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = models.item_stats(*_facts(spark))._jdf.queryExecution().executedPlan()
        debug = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$")
        stages = getattr(debug, "MODULE$").codegenStringSeq(plan)
        sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.length())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) < 8000


def test_entries_meet_their_buyers_as_numbers(spark):
    """The two flags of a line become a status before the join: no texts are shuffled for it."""
    plan = staged(spark, SMALL).entries.select("item_id", "status")._jdf.queryExecution()
    above, join, below = plan.optimizedPlan().toString().partition("Join Inner")
    assert join
    assert "l_returnflag" not in above
    assert "l_returnflag" in below


def test_stacked_values_are_never_broadcast(spark):
    """Four values a row and no row less: only the places of values may be sent to all tasks."""
    df = spark.range(2000).selectExpr("id", "id % 7 a", "id % 11 / 3 b", "id c", "id / 2 d")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 40))
    try:
        ranked = add_ranks(df, {f"{c}_rank": ("rank_desc", c) for c in "abcd"}, key="id")
        joins = re.findall(r"BroadcastHashJoin \[measure.*", executed(ranked))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert joins
    assert all("BuildLeft" not in join for join in joins), joins


def test_keys_and_tags_of_all_items_are_never_broadcast(spark):
    """Spark takes a column of a compressed file for less than it is, so size alone must not decide."""
    s = staged(spark, SMALL)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 40))
    try:
        lost = executed(quality.orphans(s.ratings, s.items, "stg_ratings", "item_id"))
        profiles = executed(models.user_profiles(s.items, s.ratings, s.entries))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.findall(r"(\w+Join) .*LeftAnti", lost) == ["SortMergeJoin"]
    # users meet their tags on the left; the inner join by items is that of the ratings
    assert set(re.findall(r"(\w+Join) \[item_id.*Inner", profiles)) == {"SortMergeJoin"}


def test_ranked_rows_are_not_sorted_as_a_whole(spark, no_broadcast):
    plan = executed(add_ranks(_facts(spark)[0].select("item_id", "followers"),
                              {"p": ("percent_rank", "followers")}))
    assert "PercentRank" not in plan
    assert "percent_rank" not in plan


def test_the_histogram_is_built_once(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 3001).alias("v"))
    counts = cumulative(df, "v", weigh=True, per_range=100)
    counts.collect()
    final = executed(counts).split("== Initial Plan ==")[0]
    assert final.count("partial_count(v") <= 1
    assert "ReusedExchange" in executed(counts)


def test_a_hot_item_is_split_in_the_join(spark, no_broadcast):
    """A third of the facts name one item: the sort-merge join splits its partition."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.shuffle.partitions": "16",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        facts = spark.range(0, 200_000, 1, 8).select(
            (F.col("id") % 9000).alias("user_id"),
            F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).alias("item_id"),
        )
        items = spark.range(5000).select(
            F.col("id").alias("item_id"), F.concat(F.lit("t"), F.col("id") % 40).alias("tags"))
        best = favourite(facts.join(items, "item_id"), "user_id", "tags")
        assert len(best.collect()) == 9000
        assert "skew=true" in executed(best)
    finally:
        for key in settings:
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_busy_user_reaches_the_semi_join_as_a_few_rows(spark, no_broadcast):
    s = staged(spark, SMALL)
    plan = executed(profiling.status_of_raters(s.entries, s.ratings))
    join = plan[plan.index("SortMergeJoin"):]
    assert "HashAggregate" in join.split("Exchange")[1]


def test_top_answers_keep_only_k_rows_per_task(spark):
    plan = executed(entry.queries()["cp04"](spark, SMALL))
    assert "TakeOrderedAndProject" in plan


def test_shared_folder_is_read_from_the_session(spark):
    built = marts(spark, SMALL)
    folder = spark.conf.get("spark.checkpoint.dir")
    assert all(folder in f for f in built.content.inputFiles())
