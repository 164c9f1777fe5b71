from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marquee.plans import profiling, texts


def test_no_type_is_left_out_of_the_years(spark):
    df = spark.createDataFrame(
        [(2001, "TV"), (2001, "CM"), (2001, None), (2002, "ONA"), (1990, "TV")],
        "start_year int, type string")
    found = {r["start_year"]: r.asDict() for r in profiling.pivot_year_type(df).collect()}
    assert set(found) == {2001, 2002}
    counts = [sum(v for k, v in row.items() if k.endswith("_count")) for row in found.values()]
    assert counts == [3, 1]
    assert found[2001]["tv_count"] == 1 and found[2001]["other_count"] == 2


def test_the_density_of_each_group_integrates_to_one(spark):
    df = spark.createDataFrame(
        [("a", float(i % 7)) for i in range(70)] + [("b", float(i)) for i in range(3)] + [("b", None)],
        "g string, v double")
    found = profiling.histogram_by(df, F.col("v"), 5, "g").collect()
    for group, rows in (("a", 70), ("b", 3)):
        own = [r for r in found if r["g"] == group]
        assert sum(r["row_count"] for r in own) == rows
        assert sum(r["density"] * (r["high"] - r["low"]) for r in own) == pytest.approx(1)
    assert max(r["high"] for r in found if r["g"] == "b") == pytest.approx(2)


def test_a_repeated_id_does_not_repeat_a_text(spark, rows):
    df = spark.createDataFrame(
        [(1, "same"), (1, "same"), (2, "same"), (1, "other"), (3, ""), (4, None)],
        "item_id int, text string")
    assert [(r[0], r[2]) for r in rows(texts.most_repeated(df, 1))] == [(3, "same")]
