"""The four raw sources, derived from the supplied star-schema tables.

Only whole-number and text arithmetic, so that any SQL engine gets the same rows.  Catalogue
fields come from ``part``, list entries from ``lineitem`` with the buyer of ``orders``, texts from
``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions.columns import UNKNOWN

ITEM_TYPES = {
    "ECONOMY": "ONA", "SMALL": "Special", "MEDIUM": "OVA", "LARGE": "Movie", "PROMO": "Music",
}
NO_TEXT = "No synopsis information has been added to this title."


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _text(c: Column) -> Column:
    return c.cast("string")


def _div(a: Column, b: Column | int) -> Column:
    """Whole-number division of non-negative numbers."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def _pick(c: Column, values: dict, otherwise: str) -> Column:
    out = F
    for number, value in values.items():
        out = out.when(c == number, value)
    return out.otherwise(otherwise)


def _unless(missing: Column, value: Column) -> Column:
    return F.when(missing, UNKNOWN).otherwise(value)


def items(spark: SparkSession, folder: str) -> DataFrame:
    k, name, size = F.col("p_partkey"), F.col("p_name"), F.col("p_size").cast("long")

    year = F.lit(1998) + k % 23
    year = (
        F.when(name.startswith("hot") & year.between(2010, 2014), year + 5)
        .when(name.startswith("cold") & (k % 2 == 0) & year.between(2015, 2019), year - 5)
        .otherwise(year)
    )
    followers = _div(F.lit(2600000).cast("long"), F.lit(1) + (k * 7919) % 4999) + size
    # the file is small, so one task reads it, but the texts made of a row and parsed again are long work:
    # rows are dealt out before it, by the key that later joins use.  Numbers that several columns need
    # are made here; with them the code of one stage would be too large to be compiled
    part = table(spark, folder, "part").withColumns({"year": year, "followers": followers})
    part = part.repartition("p_partkey")
    year, followers = F.col("year"), F.col("followers")
    cents = F.lit(100) + (k * 37 + size) % 901
    share = k % 50

    def follower_part(percent: Column) -> Column:
        return _unless(k % 211 == 0, _text(_div(followers * percent, 100)))

    score_levels = {
        f"Score-{level}": F.concat(_text(_div(followers, 12 - level)), F.lit(".0"))
        for level in range(10, 0, -1)
    }
    return part.select(
        k.alias("MAL_ID"),
        name.alias("Name"),
        _unless(k % 7 == 0, F.concat(_text(_div(cents, 100)), F.lit("."),
                                     F.lpad(_text(cents % 100), 2, "0"))).alias("Score"),
        _unless(k % 41 == 0, F.replace(name, F.lit(" "), F.lit(", "))).alias("Genres"),
        _unless(k % 2 == 0, F.upper(name)).alias("English name"),
        name.alias("Japanese name"),
        _unless(k % 53 == 0, _pick(F.col("p_type"), ITEM_TYPES, "TV")).alias("Type"),
        F.when(k % 11 == 0, UNKNOWN)
        .when(k % 13 == 0, F.concat(_text(size), F.lit(".0")))
        .when(k % 17 == 0, _text(size + 30))
        .otherwise(_text(size)).alias("Episodes"),
        _unless(k % 43 == 0, F.concat(
            F.lit("Apr 3, "), _text(year),
            F.when(k % 3 == 0, F.concat(F.lit(" to Jun 24, "), _text(year + 1))).otherwise(""),
        )).alias("Aired"),
        _unless(k % 9 == 0, F.concat(
            _pick(k % 4, {0: "Winter", 1: "Spring", 2: "Summer"}, "Fall"), F.lit(" "), _text(year),
        )).alias("Premiered"),
        F.when(k % 31 == 0, UNKNOWN)
        .when(k % 5 == 0, F.concat(F.col("p_brand"), F.lit(", Second House")))
        .otherwise(F.col("p_brand")).alias("Studios"),
        _pick(k % 6, {0: "Manga", 1: "Light novel", 2: "Original", 3: UNKNOWN, 4: "Game"},
              "Visual novel").alias("Source"),
        F.concat(_text(size), F.lit(" min. per ep.")).alias("Duration"),
        F.lit("PG-13 - Teens 13 or older").alias("Rating"),
        _unless(k % 7 == 0, F.concat(_text(k + 1), F.lit(".0"))).alias("Ranked"),
        _text(k + 1).alias("Popularity"),
        _unless(k % 211 == 0, _text(followers)).alias("Members"),
        follower_part(F.lit(2)).alias("Favorites"),
        follower_part(F.lit(10)).alias("Watching"),
        follower_part(share + 30).alias("Completed"),
        follower_part(F.lit(5)).alias("On-Hold"),
        follower_part(k % 19).alias("Dropped"),
        follower_part(F.lit(20)).alias("Plan to Watch"),
        *[c.alias(header) for header, c in score_levels.items()],
    )


def list_entries(spark: SparkSession, folder: str) -> DataFrame:
    """One row per line of an order: the buyer listed the part."""
    buyers = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    flags = F.concat("l_returnflag", "l_linestatus")
    status = (
        F.when(flags == "AO", 1).when(flags == "AF", 2).when(flags == "NF", 3)
        .when(flags == "RF", 4).when(flags == "RO", 5).when(flags == "NO", 6)
    )
    # worked out before the join, so that whole numbers are shuffled and sorted instead of texts
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey",
        F.col("l_partkey").alias("anime_id"),
        (F.ceil(F.col("l_quantity") / 4) - 1).cast("int").alias("rating"),
        status.alias("watching_status"),
        F.col("l_linenumber").alias("watched_episodes"),
    )
    return lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"), "anime_id", "rating", "watching_status", "watched_episodes"
    )


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    """The ratings of completed entries; values above 10 stay in for staging to drop."""
    completed = list_entries(spark, folder).filter(F.col("watching_status") == 2)
    return completed.select("user_id", "anime_id", "rating")


def item_text(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    k = F.col("doc_id")
    return documents.select(
        k.alias("MAL_ID"),
        F.col("source").alias("Name"),
        _unless(k % 7 == 0, F.concat(_text(k % 9 + 1), F.lit("."),
                                     F.lpad(_text(k * 7 % 100), 2, "0"))).alias("Score"),
        _unless(k % 37 == 0, F.concat_ws(", ", "lang", "source")).alias("Genres"),
        F.when(k % 22 == 0, "").when(k % 11 == 0, NO_TEXT).otherwise(F.col("text"))
        .alias("sypnopsis"),
    )


# --- results and attempts, for the comparison jobs -------------------------------------------

QUESTIONS = 40


def _query_id(q: Column) -> Column:
    return F.concat(F.lit("Q"), F.lpad(_text(q), 2, "0"))


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as the rows of forty results: question, row number, four columns."""
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        (key % QUESTIONS).alias("q"),
        _div(key, QUESTIONS).alias("row_no"),
        F.col("o_custkey").alias("customer"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("total"),
    )


def expected_results(spark: SparkSession, folder: str) -> DataFrame:
    return _answers(spark, folder).withColumn("query_id", _query_id(F.col("q"))).drop("q")


def actual_results(spark: SparkSession, folder: str) -> list[tuple[DataFrame, list[str]]]:
    """Two modes' answers, with known defects, and the columns each part returns.

    ``plain`` inflates totals, loses rows, loses a column, swaps neighbours and shifts customers,
    each in some questions; ``guided`` does the first two less often.
    """
    answers = _answers(spark, folder)
    q, row, total = F.col("q"), F.col("row_no"), F.col("total")
    plain = answers.filter(~((q % 5 == 1) & (row % 3 == 2))).select(
        F.lit("plain").alias("mode"), "q",
        F.when(q % 7 == 3, row + 1 - 2 * (row % 2)).otherwise(row).alias("row_no"),
        F.when(q % 8 == 5, F.col("customer") + 1).otherwise(F.col("customer")).alias("customer"),
        "priority", "status",
        F.when(q % 4 == 0, total * 1.2).otherwise(total * 1.01).alias("total"),
    )
    guided = answers.filter(~((q % 10 == 1) & (row % 3 == 2))).select(
        F.lit("guided").alias("mode"), "q", "row_no", "customer", "priority", "status",
        F.when(q % 8 == 0, total * 1.2).otherwise(total).alias("total"),
    )
    whole = plain.filter(q % 6 != 2).unionByName(guided)
    short = plain.filter(q % 6 == 2).drop("priority")

    def named(df: DataFrame) -> DataFrame:
        return df.withColumn("query_id", _query_id(q)).drop("q")

    return [
        (named(whole), ["customer", "priority", "status", "total"]),
        (named(short), ["customer", "status", "total"]),
    ]


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """One attempt per order: mode, question, its difficulty and category, error message or NULL."""
    key = F.col("o_orderkey")
    q = key % QUESTIONS
    messages = [
        F.concat(F.lit('Parser Error: syntax error at or near "'), F.col("o_orderpriority"),
                 F.lit('"')),
        F.lit("Catalog Error: Table with that name not found"),
        F.lit("no such column: total"),
        F.lit("Cannot JOIN on a missing key"),
        F.lit("Conversion Error: could not CAST the value"),
        F.lit("Binder Error: ambiguous reference"),
        F.lit("Out of time"),
        F.lit("Binder Error: column of that type not found"),
    ]
    message = F
    for number, text in enumerate(messages):
        message = message.when(key % 17 == number, text)
    return table(spark, folder, "orders").select(
        F.when(_div(key, QUESTIONS) % 2 == 0, "plain").otherwise("guided").alias("mode"),
        _query_id(q).alias("query_id"),
        _pick(q % 3, {0: "easy", 1: "medium"}, "hard").alias("difficulty"),
        _pick(q % 5, {0: "content", 1: "users", 2: "tags", 3: "trends"}, "comparison")
        .alias("category"),
        message.alias("message"),
    )
