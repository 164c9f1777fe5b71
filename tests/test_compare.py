from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marquee.plans import compare
from marquee.sources.writers import to_parquet


def cells(spark, results, mode=None):
    """{query: [row dicts]} to cells by the types of the values."""
    data = []
    for query, given in results.items():
        for number, row in enumerate(given):
            data.append((mode or "m", query, number, [
                (column, *[value if isinstance(value, kind) else None for kind in (float, int, str)])
                for column, value in row.items()]))
    schema = ("mode string, query_id string, row_no long, "
              "cells array<struct<column:string,num:double,whole:long,txt:string>>")
    df = spark.createDataFrame(data, schema)
    return df if mode else df.drop("mode")


EXPECTED = {
    "same": [{"k": "a", "v": 1.0}, {"k": "b", "v": 2.0}],
    "close": [{"k": "a", "v": 100.0}, {"k": "b", "v": 200.0}],
    "far": [{"v": 100.0, "w": 50.0}, {"v": 200.0, "w": 60.0}],
    "reordered": [{"k": "a", "v": 1.0}, {"k": "b", "v": 9.0}, {"k": "c", "v": 5.0}],
    "longer": [{"k": "a"}],
    "wider": [{"k": "a", "v": 1.0}],
    "disjoint": [{"k": "a"}],
    "nulls": [{"k": None, "v": 1.0}, {"k": "a", "v": None}],
    "copies": [{"k": "x", "v": 1.0}] * 6,
}
ACTUAL = {
    "same": EXPECTED["same"],
    "close": [{"k": "aa", "v": 104.9}, {"k": "b", "v": 200.0}],
    "far": [{"v": 106.0, "w": 99.0}, {"v": 300.0, "w": 99.0}],
    "reordered": EXPECTED["reordered"][::-1],
    "longer": [{"k": "a"}, {"k": "b"}],
    "wider": [{"k": "a", "v": 1.0, "extra": 7}],
    "disjoint": [{"q": "a"}],
    "nulls": EXPECTED["nulls"][::-1],
    "copies": [{"k": "x", "v": 1.0}] * 6,
}


@pytest.fixture(scope="module")
def found(spark):
    df = compare.verdicts(cells(spark, EXPECTED), cells(spark, ACTUAL, "m"))
    return {r["query_id"]: r.asDict() for r in df.collect()}


@pytest.mark.parametrize(("query", "row", "col", "first", "result"), [
    ("same", True, True, True, True),
    ("close", True, True, True, True),
    ("far", True, True, False, False),
    ("reordered", True, True, False, True),
    ("longer", False, True, True, False),
    ("wider", True, False, True, True),
    ("disjoint", True, True, False, False),
    ("nulls", True, True, False, True),
    ("copies", True, True, True, True),
])
def test_three_levels(found, query, row, col, first, result):
    verdict = found[query]
    assert verdict["row_match"] is row
    assert verdict["col_match"] is col
    assert verdict["structure_match"] is (row and col)
    assert verdict["first_row_match"] is first
    assert verdict["result_match"] is result


def test_whole_numbers_get_no_tolerance(spark):
    df = compare.verdicts(cells(spark, {"q": [{"v": 100}]}), cells(spark, {"q": [{"v": 101}]}, "m"))
    assert df.first()["result_match"] is False


def test_ranges_do_not_change_the_verdict(spark):
    rows = [{"k": f"{i % 50:03d}", "v": float(i)} for i in range(600)]
    expected = cells(spark, {"q": rows, "other": rows[:40]})
    actual = cells(spark, {"q": rows[::-1], "other": rows[:40]}, "m")
    for per_range in (7, 50_000):
        found = compare.result(expected, actual, per_range=per_range).collect()
        assert {r["query_id"]: (r["rows_compared"], r["rows_agreeing"]) for r in found} == {
            "q": (600, 600), "other": (40, 40)}


def test_kept_rows_are_made_once_and_shared_by_modes(spark, rows, tmp_path):
    """Two modes with the same columns are compared with one copy of the expected rows."""
    data = [{"k": f"{i % 50:03d}", "v": float(i)} for i in range(600)]
    expected = cells(spark, {"q": data, "short": data[:40]})
    actual = cells(spark, {"q": data[::-1], "short": [{"k": r["k"]} for r in data[:40]]}, "m").unionByName(
        cells(spark, {"q": data, "short": data[:40]}, "n"))
    plain = rows(compare.result(expected, actual))
    for per_range in (1, 7, 50_000):  # 1: two levels of ranges
        kept = {}

        def keep(name, df, kept=kept, per_range=per_range):
            assert name not in kept
            kept[name] = to_parquet(df, f"{tmp_path}/{per_range}/{name}")
            return kept[name]

        assert rows(compare.result(expected, actual, per_range=per_range, keep=keep)) == plain
        assert kept["compared_e_keyed"].count() == 600 + 40 + 40
        assert kept["compared_a_keyed"].count() == 2 * 640


def test_row_cells_split_numbers_and_texts(spark):
    df = spark.createDataFrame([(0, 1, 2.5, "x", True)],
                               "row_no int, a int, b double, c string, d boolean")
    row = compare.row_cells(df, ["row_no"], ["a", "b", "c", "d"]).first()
    assert [tuple(cell) for cell in row["cells"]] == [
        ("a", None, 1, None), ("b", 2.5, None, None), ("c", None, None, "x"),
        ("d", None, None, "true")]


def test_whole_numbers_are_ordered_as_numbers(spark):
    """As texts, 10 would come before 9 and pair every row with another one."""
    expected = cells(spark, {"q": [{"k": 9, "v": 1.0}, {"k": 10, "v": 50.0}]})
    actual = cells(spark, {"q": [{"k": 8, "v": 1.0}, {"k": 10, "v": 50.0}]}, "m")
    row = compare.result(expected, actual).first()
    assert (row["rows_compared"], row["rows_agreeing"]) == (2, 2)


def test_runs_without_rows_have_verdicts(spark):
    full = [{"k": 1}]
    expected = cells(spark, {"both": full, "lost": full, "failed": full})
    actual = cells(spark, {"both": full, "more": full}, "m")
    runs = spark.createDataFrame(
        [("m", "both", ["k"], ["k"]), ("m", "lost", ["k"], ["k"]), ("m", "more", ["k"], ["k", "x"]),
         ("m", "none", ["k", "j"], ["j", "k"]), ("m", "failed", ["k"], None)],
        "mode string, query_id string, expected_columns array<string>, actual_columns array<string>")
    found = {r["query_id"]: tuple(r)[2:] for r in compare.verdicts(expected, actual, runs).collect()}
    assert found == {
        "both": (True, True, True, True, True, 1),
        "lost": (False, True, False, False, False, 1),
        "more": (False, False, False, False, False, 1),
        "none": (True, True, True, False, False, 2),
        "failed": (False, False, False, False, False, 0),
    }


@pytest.mark.parametrize(("message", "label"), [
    (None, None),
    ("Parser Error: near SELECT", "syntax_error"),
    ("Catalog: Table x Not Found", "wrong_table"),
    ("no such column: y", "wrong_column"),
    ("Column y was not found in the table", "wrong_table"),
    ("cannot JOIN here", "wrong_join"),
    ("could not CAST", "type_error"),
    ("Binder problem", "binder_error"),
    ("out of memory", "other_error"),
])
def test_error_labels(spark, message, label):
    df = spark.createDataFrame([(message,)], "m string")
    assert df.select(compare.error_label(F.col("m"))).first()[0] == label


def test_rates(spark, rows):
    log = spark.createDataFrame(
        [("a", "q1", "easy", "x", None), ("a", "q2", "hard", "x", "syntax"),
         ("b", "q1", "easy", "x", None), ("b", "q2", "hard", "y", None)],
        "mode string, query_id string, difficulty string, category string, message string")
    verdict = spark.createDataFrame(
        [("a", "q1", True, True), ("a", "q2", True, True), ("b", "q1", False, True)],
        "mode string, query_id string, structure_match boolean, result_match boolean")
    out = compare.outcomes(log, verdict)
    assert rows(compare.rates(out, ["mode"])) == [
        ("a", 2, 1, 1, 1, 0.5, 0.5, 0.5), ("b", 2, 2, 0, 1, 1.0, 0.0, 0.5)]
    assert rows(compare.error_counts(out)) == [("a", "syntax_error", 1)]
    change = {r["measure"]: r["change"] for r in compare.mode_difference(out, "a", "b").collect()}
    assert change == {"execution_success_rate": 0.5, "structure_match_rate": -0.5,
                      "result_match_rate": 0.0}
    levels = rows(compare.rates_by_level(out))
    assert ("b", "category", "y", 1, 1, 0, 0) in levels
    assert ("a", "difficulty", "hard", 1, 0, 0, 0) in levels
