from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marquee.operators.explode import explode_list
from marquee.plans.metrics import METRICS, metric
from marquee.plans.registry import marts, staged
from tests.conftest import SMALL


def test_thirteen_metrics_with_kind_and_meaning():
    assert len(METRICS) == 13
    assert all(m.kind and m.meaning and m.table for m in METRICS.values())


def test_unknown_metric_is_named(spark):
    with pytest.raises(KeyError, match="nothing"):
        metric(spark.range(1), "nothing")


def test_item_rates_equal_the_model(spark, rows):
    built, facts = marts(spark, SMALL), staged(spark, SMALL)
    for name in ("completion_rate", "drop_rate"):
        found = rows(metric(facts.entries, name, ["item_id"]))
        model = rows(built.content.filter(F.col(name).isNotNull()), "item_id", name)
        listed = {k for k, _ in model}
        assert [r for r in found if r[0] in listed] == model


def test_tag_metrics_equal_the_model(spark):
    built = marts(spark, SMALL)
    listings = explode_list(built.item_stats, "tags", "tag")
    for name, column in (("tag_item_count", "item_count"), ("tag_health_score", None)):
        found = {r["tag"]: r[name] for r in metric(listings, name, ["tag"]).collect()}
        for row in built.tags.collect():
            assert found[row["tag"]] == pytest.approx(row[column or name])


def test_any_grain_and_a_condition(spark):
    built, facts = marts(spark, SMALL), staged(spark, SMALL)
    whole = metric(facts.ratings, "total_ratings").first()[0]
    by_user = metric(facts.ratings, "total_ratings", ["user_id"]).agg(F.sum("total_ratings"))
    assert by_user.first()[0] == whole == facts.ratings.count()
    high = metric(facts.ratings, "total_ratings", where=F.col("rating") >= 8).first()[0]
    share = metric(facts.ratings, "high_rating_ratio").first()[0]
    assert share == pytest.approx(high / whole)
    by_year = metric(built.content, "avg_score", ["start_year", "type"])
    assert by_year.columns == ["start_year", "type", "avg_score"]


def test_shares_of_nothing_are_null(spark):
    from marquee.operators.distribution import cumulative, gini, lorenz, top_share
    from marquee.plans import profiling

    empty = spark.createDataFrame([], "v int, t string")
    assert [r["null_pct"] for r in profiling.null_share(empty).collect()] == [None, None]
    assert profiling.sentinel_share(empty, ["t"]).first()["sentinel_pct"] is None
    zeros = cumulative(spark.createDataFrame([(0,), (0,)], "v int"), "v", weigh=True)
    assert gini(zeros).first()["gini"] is None
    assert top_share(zeros, {"k": F.lit(1)}).first()["share"] is None
    assert lorenz(zeros).first()["value_share"] is None
    flat = spark.createDataFrame([(5,), (5,)], "v int")
    assert profiling.equal_width_histogram(flat, F.col("v"), 10).first()["row_count"] == 2
