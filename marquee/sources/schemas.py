"""Layouts of the four raw CSV files.

The header names are fixed values: they are how the public data set spells them.
"""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values: headers of the item file
ITEM_HEADERS = [
    "MAL_ID", "Name", "Score", "Genres", "English name", "Japanese name", "Type", "Episodes",
    "Aired", "Premiered", "Producers", "Licensors", "Studios", "Source", "Duration", "Rating",
    "Ranked", "Popularity", "Members", "Favorites", "Watching", "Completed", "On-Hold", "Dropped",
    "Plan to Watch", "Score-10", "Score-9", "Score-8", "Score-7", "Score-6", "Score-5", "Score-4",
    "Score-3", "Score-2", "Score-1",
]

# every item column is read as text: the sentinel stands in numeric columns too
ITEMS = T.StructType([
    T.StructField(name, T.IntegerType() if name == "MAL_ID" else T.StringType())
    for name in ITEM_HEADERS
])

RATINGS = T.StructType([
    T.StructField("user_id", T.IntegerType()),
    T.StructField("anime_id", T.IntegerType()),
    T.StructField("rating", T.IntegerType()),
])

LIST_ENTRIES = T.StructType([
    T.StructField("user_id", T.IntegerType()),
    T.StructField("anime_id", T.IntegerType()),
    T.StructField("rating", T.IntegerType()),
    T.StructField("watching_status", T.IntegerType()),
    T.StructField("watched_episodes", T.IntegerType()),
])

ITEM_TEXT = T.StructType([
    T.StructField("MAL_ID", T.IntegerType()),
    T.StructField("Name", T.StringType()),
    T.StructField("Score", T.StringType()),
    T.StructField("Genres", T.StringType()),
    T.StructField("sypnopsis", T.StringType()),
])
