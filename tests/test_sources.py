from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from marquee.plans import registry
from marquee.plans.dictionary import TABLES
from marquee.plans.registry import marts
from marquee.plans.warehouse import as_views, save, shelved, stage_files, stage_supplied
from marquee.sources import published, readers, schemas, writers
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    names = schemas.ITEM_HEADERS
    item = dict.fromkeys(names, "Unknown") | {
        "MAL_ID": "1", "Name": 'The ""Quoted"", one', "Genres": "a, b", "Members": "12",
        "Plan to Watch": "3", "On-Hold": "4", "Score-10": "5.0", "Aired": "Apr 3, 1998"}
    header = ",".join(reversed(names))
    line = ",".join(f'"{item[n]}"' for n in reversed(names))
    (folder / "items.csv").write_text(f"{header}\n{line}\n")
    (folder / "ratings.csv").write_text("user_id,anime_id,rating\n1,1,7\n1,1,0\n")
    (folder / "entries.csv").write_text(
        "user_id,anime_id,rating,watching_status,watched_episodes\n1,1,7,2,12\n2,1,0,6,0\n")
    (folder / "text.csv").write_text(
        'MAL_ID,Name,Score,Genres,sypnopsis\n1,n,8.1,"a, b","first line\nsecond ""line"", é"\n')
    return {"items": str(folder / "items.csv"), "ratings": str(folder / "ratings.csv"),
            "list_entries": str(folder / "entries.csv"), "item_text": str(folder / "text.csv")}


def test_csv_sources_to_staged_rows(spark, files):
    staged = stage_files(spark, files)
    item = staged.items.first()
    assert item["name"] == 'The "Quoted", one'
    assert (item["item_id"], item["followers"], item["plan_to_watch_count"]) == (1, 12, 3)
    assert (item["on_hold_count"], item["score_10_count"], item["start_year"]) == (4, 5.0, 1998)
    assert [tuple(r) for r in staged.ratings.collect()] == [(1, 1, 7)]
    assert sorted(r["status"] for r in staged.entries.collect()) == ["Completed", "Plan to Watch"]
    text = staged.text.first()
    assert text["text"] == 'first line\nsecond "line", é'
    assert text["score"] == 8.1


def test_files_to_written_tables(spark, files):
    built = shelved(spark, stage_files(spark, files), "from files")
    row = built.content.first()
    assert (row["item_id"], row["rating_count"], row["completion_rate"]) == (1, 1, 0.5)
    assert built.users.count() == 1
    assert built.tags.count() == 0
    assert all("from_files" in f for f in built.content.inputFiles())


def test_files_of_one_header_are_read_together(spark, tmp_path):
    (tmp_path / "a.csv").write_text("rating,extra,user_id,anime_id\n7,x,1,2\n")
    (tmp_path / "b.csv").write_text("rating,extra,user_id,anime_id\n8,y,3,4\n")
    found = readers.source(spark, "ratings", str(tmp_path)).collect()
    assert sorted(tuple(r) for r in found) == [(1, 2, 7), (3, 4, 8)]


def test_a_file_with_another_header_is_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("user_id,anime_id,rating\n1,2,7\n")
    (tmp_path / "b.csv").write_text("anime_id,user_id,rating\n4,3,8\n")
    with pytest.raises(Exception, match="header"):
        readers.source(spark, "ratings", str(tmp_path)).collect()


def test_an_absent_column_is_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("user_id,rating\n1,7\n")
    with pytest.raises(ValueError, match="anime_id"):
        readers.source(spark, "ratings", str(tmp_path))


def test_unknown_source_is_named(spark):
    with pytest.raises(KeyError, match="nothing"):
        readers.source(spark, "nothing", "/nowhere")


def test_parquet_copy_stands_in_for_a_source(spark, files, tmp_path):
    copy = str(tmp_path / "ratings.parquet")
    writers.to_parquet(readers.source(spark, "ratings", files["ratings"]), copy)
    assert readers.source(spark, "ratings", copy).count() == 2


def test_views_are_lazy_and_readable(spark):
    as_views(stage_supplied(spark, SMALL))
    assert spark.sql("select count(*) from stg_items").first()[0] == 200


def test_json_and_describe(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5)], "k int, rate double")
    writers.to_json(df, str(tmp_path / "out"))
    written = [json.loads(line) for p in (tmp_path / "out").glob("*.json")
               for line in p.read_text().splitlines()]
    assert written == [{"k": 1, "rate": 0.5}]
    writers.to_table(df, "plain_table", {"k": "a key"})
    assert [tuple(r) for r in writers.columns_of(spark, "plain_table").collect()] == [
        (0, "k", "int"), (1, "rate", "double")]


def test_table_is_replaced_as_a_whole(spark):
    for value in (1, 2):
        writers.to_table(spark.createDataFrame([(value,)], "k int"), "replaced")
    assert [r["k"] for r in spark.table("replaced").collect()] == [2]


def test_a_failing_write_leaves_the_published_table(spark):
    """Readers see the old version until the new one is whole."""
    good = spark.createDataFrame([(1,), (2,)], "k int")
    writers.to_version(good, "steady.rows_of", {"k": "a key"})
    bad = spark.range(100).select(F.when(F.col("id") < 99, F.col("id").cast("int")).otherwise(
        F.raise_error(F.lit("lost")).cast("int")).alias("k"))
    with pytest.raises(Exception, match="lost"):
        writers.to_version(bad, "steady.rows_of")
    assert sorted(r["k"] for r in spark.table("steady.rows_of").collect()) == [1, 2]
    assert spark.table("steady.rows_of").schema["k"].metadata["comment"] == "a key"
    assert len(writers.versions(spark, "steady.rows_of")) == 1


def test_versions_are_switched_and_the_one_before_is_kept(spark):
    for value in (1, 2, 3):
        before = spark.table("switched") if value > 1 else None
        writers.to_version(spark.createDataFrame([(value,)], "k int"), "switched")
        # a reader that opened the table before the switch still reads its rows
        assert before is None or [r["k"] for r in before.collect()] == [value - 1]
    assert [r["k"] for r in spark.table("switched").collect()] == [3]
    assert len(writers.versions(spark, "switched")) == 2
    assert [r["k"] for r in writers.to_previous(spark, "switched").collect()] == [2]
    with pytest.raises(ValueError, match="earlier"):
        writers.to_previous(spark, "switched")


def test_a_table_written_in_place_becomes_the_oldest_version(spark):
    writers.to_table(spark.createDataFrame([(1,)], "k int"), "in_place")
    writers.to_version(spark.createDataFrame([(2,)], "k int"), "in_place")
    assert [r["k"] for r in spark.table("in_place").collect()] == [2]
    assert [r["k"] for r in writers.to_previous(spark, "in_place").collect()] == [1]


def test_bucketed_copy_aggregates_without_a_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 50 as user_id", "cast(id % 10 as int) as rating")
    table = writers.bucketed(df, "bucketed_ratings", "user_id", 4)
    plan = table.groupBy("user_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_saved_and_published_tables(spark):
    built = marts(spark, SMALL)
    save(built, "marts")
    assert spark.table("marts.content_performance").count() == 200
    names = published.publish(built)
    assert names == ["main_marts.mart_content_performance", "main_marts.mart_user_segments",
                     "main_marts.mart_genre_trends"]
    best = spark.sql("""
        SELECT name, type, performance_score, mal_score, members_tier
        FROM main_marts.mart_content_performance
        WHERE performance_score IS NOT NULL ORDER BY performance_score DESC LIMIT 20""")
    assert best.count() == 20
    assert spark.sql("SELECT genre, genre_health_score FROM main_marts.mart_genre_trends").columns
    field = spark.table(names[0]).schema["members_tier"]
    assert field.metadata["comment"] == TABLES["content"]["followers_tier"].meaning


def test_the_shelf_writes_once_under_the_shared_folder(spark):
    shelf = writers.Shelf(spark, "a label/with parts")
    df = shelf("one", spark.range(3))
    assert spark.conf.get("spark.checkpoint.dir") in df.inputFiles()[0]
    assert shelf("one", spark.range(99)).count() == 3


def test_files_that_cannot_be_split_have_bounded_rows(spark, monkeypatch):
    """Ten times the rows make ten times the files, not larger ones."""
    monkeypatch.setattr(registry, "ROWS_PER_FILE", 30)
    found = registry.file_queries()["csv_item_text"](spark, SMALL)
    per_file = found.groupBy(F.input_file_name().alias("file")).count().collect()
    assert sum(r["count"] for r in per_file) == 200
    assert max(r["count"] for r in per_file) <= 30
