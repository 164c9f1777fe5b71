from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from marquee.functions import columns as c
from marquee.operators.explode import explode_list, list_length


def values(spark, kind, data, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_try_int_reads_numbers_in_any_notation(spark):
    given = ["Unknown", None, "", "7", " 7 ", "12.0", "4.5", "1e3", "-2.5", "99999999999", "1,000"]
    assert values(spark, "string", given, c.try_int) == [
        None, None, None, 7, 7, 12, 5, 1000, -3, None, None]


def test_try_double(spark):
    assert values(spark, "string", ["8.25", "Unknown", None], c.try_double) == [8.25, None, None]


def test_year_is_the_first_four_digits(spark):
    given = ["Apr 3, 1998 to Apr 24, 1999", "no year", None, "Unknown", "2016"]
    assert values(spark, "string", given, c.year_of) == [1998, None, None, None, 2016]


def test_season_is_the_first_word(spark):
    given = ["Spring 2016", "Spring", "Unknown", None]
    assert values(spark, "string", given, c.season_of) == ["Spring", "Spring", None, None]


TEXTS = [None, "", "   ", "No synopsis here", "a  b", "  a b ", "a\tb", "é ü ß"]


def test_text_flag_and_word_counts(spark):
    assert values(spark, "string", TEXTS, c.has_text) == [
        False, False, True, False, True, True, True, True]
    assert values(spark, "string", TEXTS, c.words_by_space) == [0, 0, 0, 0, 3, 2, 1, 3]
    assert values(spark, "string", TEXTS, c.words_by_whitespace) == [
        None, 0, 0, 3, 2, 2, 2, 3]


def test_ladder_takes_the_bound_and_sends_null_to_the_end(spark):
    rungs = [(8.5, "high"), (7.0, "mid")]
    found = values(spark, "double", [8.5, 8.49, 7.0, 6.9, None],
                   lambda v: c.ladder(v, rungs, "low"))
    assert found == ["high", "mid", "mid", "low", "low"]


def test_cut_is_closed_on_the_right(spark):
    found = values(spark, "double", [0.0, 0.1, 4.0, 4.1, 9.0, None],
                   lambda v: c.cut(v, [0, 4, 9], ["a", "b"]))
    assert found == [None, "a", "a", "b", "b", None]


def test_ratio_and_growth_guard_the_divisor(spark):
    assert values(spark, "double", [0.0, 4.0], lambda v: c.ratio(F.lit(2), v)) == [None, 0.5]
    assert values(spark, "double", [0.0, 4.0, None], lambda v: c.growth(F.lit(5.0), v)) == [
        None, 0.25, None]


def test_rounding_is_of_the_binary_value(spark):
    given = [1.005, 2.5, -2.5, 0.125, 1e300]
    assert values(spark, "double", given[:4], lambda v: c.round_to(v, 2)) == [
        1.0, 2.5, -2.5, 0.13]
    assert values(spark, "double", [2.5, -2.5, 2.4], lambda v: c.round_to(v, 0)) == [
        3.0, -3.0, 2.0]


def test_means_that_are_ties_but_for_noise_round_as_ties(spark):
    noisy = [5.318499999999999, 5.3185, 5.318500000000001]
    assert set(values(spark, "double", noisy, lambda v: c.round_mean(v, 3))) == {5.319}


def test_special_share_counts_characters(spark):
    assert values(spark, "string", ["ab c!", "", "é"], c.special_share) == [0.2, 0.0, 1.0]


def test_first_listed(spark):
    assert values(spark, "string", ["A, B", " A ", "A,B"], c.first_listed) == ["A", "A", "A"]


def test_equal_width_bins_keep_the_maximum(spark):
    found = values(spark, "double", [0.0, 2.4, 2.5, 10.0],
                   lambda v: c.equal_width_bin(v, F.lit(0.0), F.lit(10.0), 4))
    assert found == [0, 0, 1, 3]


@pytest.mark.parametrize(("expected", "actual", "same"), [
    ((100.0, None, None), (104.9, None, None), True),
    ((100.0, None, None), (105.1, None, None), False),
    ((0.0, None, None), (0.0, None, None), True),
    ((0.0, None, None), (0.001, None, None), False),
    ((-100.0, None, None), (-104.0, None, None), True),
    ((None, None, None), (None, None, None), True),
    ((1.0, None, None), (None, None, None), False),
    ((math.nan, None, None), (math.nan, None, None), True),
    ((math.nan, None, None), (1.0, None, None), False),
    ((1.0, None, None), (math.nan, None, None), False),
    ((None, 100, None), (None, 101, None), False),
    ((None, None, "x"), (None, None, "x"), True),
    ((5.0, None, None), (None, 5, None), False),
])
def test_cells_equal(spark, expected, actual, same):
    df = spark.createDataFrame(
        [(expected, actual)], "e struct<num:double,whole:long,txt:string>, a struct<num:double,whole:long,txt:string>")
    assert df.select(c.cells_equal(F.col("e"), F.col("a"))).first()[0] is same


LISTS = ["a, b", "a", "a,", "a,,b", "a, a", "Unknown", None, " a ,b"]


def test_explode_drops_blanks_and_the_sentinel(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(LISTS)], "i int, tags string")
    found = sorted(tuple(r) for r in explode_list(df, "tags", "tag").select("i", "tag").collect())
    assert found == [(0, "a"), (0, "b"), (1, "a"), (2, "a"), (3, "a"), (3, "b"), (4, "a"),
                     (4, "a"), (7, "a"), (7, "b")]
    kept = explode_list(df, "tags", "tag", drop_unknown=False).filter("i = 5").collect()
    assert [r["tag"] for r in kept] == ["Unknown"]


def test_list_length(spark):
    assert values(spark, "string", ["a, b, c", "a", "Unknown", None, ""], list_length) == [
        3, 1, 0, 0, 0]
