"""Named queries over the supplied tables: name -> function of (spark, folder)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from marquee.functions.columns import round_mean
from marquee.operators.distribution import add_ranks, describe
from marquee.operators.explode import explode_list
from marquee.plans import (
    compare,
    dictionary,
    models,
    patterns,
    profiling,
    quality,
    refresh,
    sketches,
    questions,
    texts,
)
from marquee.plans.metrics import metric
from marquee.plans.quality import CheckedShelf
from marquee.plans.questions import ITEM
from marquee.plans.texts import DESCRIBED
from marquee.plans.warehouse import (
    Marts,
    Staged,
    facts_by_key,
    marts_of,
    stage_files,
    stage_supplied,
)
from marquee.sources import schemas, supplied

Query = Callable[[SparkSession, str], DataFrame]

# the supplied facts hold about seven ratings per user, so the diversity rungs stand lower
DIVERSITY = [(9, "Explorer"), (6, "Regular Viewer"), (3, "Selective")]


_marts: dict[tuple[str, str], Marts] = {}
_shelves: dict[tuple[str, str], CheckedShelf] = {}


_staged: dict[tuple[str, str], Staged] = {}


def staged(spark: SparkSession, folder: str) -> Staged:
    """The staged rows of a folder; the plan is made once per session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _staged:
        _staged[key] = stage_supplied(spark, folder)
    return _staged[key]


def shelf(spark: SparkSession, folder: str) -> CheckedShelf:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _shelves:
        _shelves[key] = CheckedShelf(spark, folder)
    return _shelves[key]


def marts(spark: SparkSession, folder: str) -> Marts:
    """The tables of a folder, each made once per session in the shared folder when first read.

    The questions read these as they would the saved tables of a warehouse.
    """
    key = (spark.sparkContext.applicationId, folder)
    if key not in _marts:
        _marts[key] = marts_of(
            staged(spark, folder), shelf(spark, folder), diversity=DIVERSITY
        )
    return _marts[key]


def settled(df: DataFrame) -> DataFrame:
    """Fractions cut to six decimals, so that the order of summation cannot show."""
    return df.select([
        round_mean(F.col(f.name), 6).alias(f.name) if isinstance(f.dataType, DoubleType)
        else F.col(f.name)
        for f in df.schema.fields
    ])


def on_staged(function: Callable[[Staged], DataFrame]) -> Query:
    return lambda spark, folder: settled(function(staged(spark, folder)))


def on_marts(function: Callable[[Marts], DataFrame]) -> Query:
    return lambda spark, folder: settled(function(marts(spark, folder)))


def table_queries() -> dict[str, Query]:
    def profiles(s: Staged) -> DataFrame:
        return models.user_profiles(s.items, s.ratings, s.entries)

    def stats(s: Staged) -> DataFrame:
        return models.item_stats(s.items, s.ratings, s.entries)

    def refreshed_stats(spark: SparkSession, folder: str) -> DataFrame:
        """Three quarters of the users make the kept state, the others come as the new slice."""
        s, kept = staged(spark, folder), shelf(spark, folder)
        new = F.coalesce(F.col("user_id") % 4 == 0, F.lit(True))
        old = refresh.state_of(s.ratings.filter(~new), s.entries.filter(~new))
        state = refresh.ItemState(kept("old_ratings", old.ratings), kept("old_statuses", old.statuses))
        state = refresh.refreshed(state, s.ratings.filter(new), s.entries.filter(new), keep=kept)
        return settled(refresh.item_stats_from(s.items, state))

    def stats_by_key(spark: SparkSession, folder: str) -> DataFrame:
        s = staged(spark, folder)
        root = shelf(spark, folder).root
        prefix = f"facts_{hashlib.sha1(root.encode()).hexdigest()[:12]}"
        facts = facts_by_key(s, ITEM, prefix, root)
        return settled(models.item_stats(s.items, facts.ratings, facts.entries))

    return {
        "stg_items": on_staged(lambda s: s.items),
        "stg_ratings": on_staged(lambda s: s.ratings),
        "stg_list_entries": on_staged(lambda s: s.entries),
        "stg_item_text": on_staged(lambda s: s.text),
        "item_stats": on_staged(stats),
        "item_stats_refreshed": refreshed_stats,
        "item_stats_by_key": stats_by_key,
        "user_profiles": on_staged(profiles),
        "tag_metrics": on_marts(lambda m: models.tag_metrics(m.item_stats)),
        "content_performance": lambda spark, folder: settled(models.content_performance(
            marts(spark, folder).item_stats, staged(spark, folder).text
        )),
        "user_segments": on_marts(
            lambda m: models.user_segments(m.user_profiles, diversity=DIVERSITY)
        ),
        "tag_trends": on_marts(lambda m: models.tag_trends(m.tag_metrics, m.item_stats)),
    }


# the supplied tags carry other names, and recent items are a smaller share of them
QUESTION_OPTIONS = {"cm02": {"pair": ("hot", "cold")}, "ga08": {"above": 0.3}}


def question_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    books = (
        (questions.CONTENT_QUESTIONS, lambda m: m.content),
        (questions.USER_QUESTIONS, lambda m: m.users),
        (questions.TAG_QUESTIONS, lambda m: m.tags),
    )
    for book, table in books:
        for name, ask in book.items():
            options = QUESTION_OPTIONS.get(name, {})
            out[name] = on_marts(
                lambda m, ask=ask, table=table, options=options: ask(table(m), **options)
            )
    return out


def pattern_queries() -> dict[str, Query]:
    return {
        "pattern_tag_explode": on_marts(lambda m: patterns.tag_explode(m.content)),
        "pattern_tier_filter": on_marts(lambda m: patterns.tier_filter(m.content)),
        "pattern_segment_means": on_marts(lambda m: patterns.segment_means(m.users)),
        "pattern_segment_share": on_marts(lambda m: patterns.segment_share(m.users)),
        "pattern_year_range": on_marts(lambda m: patterns.year_range(m.content)),
        "pattern_decade_comparison": on_marts(lambda m: patterns.decade_comparison(m.content)),
        "pattern_segment_pivot": on_marts(lambda m: patterns.segment_pivot(m.users)),
        "pattern_top_decile": on_marts(lambda m: patterns.top_share(m.content)),
        "pattern_single_maker": on_marts(lambda m: patterns.single_maker(m.content)),
        "pattern_table_sample": on_marts(lambda m: patterns.table_sample(m.content, ITEM)),
    }


def profile_queries() -> dict[str, Query]:
    P = profiling

    def events(spark: SparkSession, folder: str) -> DataFrame:
        return supplied.table(spark, folder, "events")

    def over_events(function: Callable[[DataFrame], DataFrame]) -> Query:
        return lambda spark, folder: settled(function(events(spark, folder)))

    def scaled_ranks(spark: SparkSession, folder: str) -> DataFrame:
        key = F.col("o_orderkey")
        priced = supplied.table(spark, folder, "orders").select(
            key, F.when(key % 13 != 0, F.col("o_totalprice")).alias("price")
        )
        return settled(add_ranks(priced, {
            "price_rank": ("rank_desc", "price"), "price_place": ("percent_rank", "price"),
        }))

    def per_user(s: Staged) -> DataFrame:
        return P.activity(s.ratings, "user_id")

    def sketched_distinct(s: Staged) -> DataFrame:
        return sketches.distinct_check(s.ratings, "item_id", "user_id")

    def sketched_quantiles(s: Staged) -> DataFrame:
        return sketches.quantile_check(s.items, "type", "followers", [0.1, 0.5, 0.9])

    return {
        "sketched_distinct": on_staged(sketched_distinct),
        "sketched_quantiles": on_staged(sketched_quantiles),
        "profile_nulls": on_staged(lambda s: P.null_share(s.items)),
        "profile_sentinels": lambda spark, folder: settled(P.sentinel_share(
            supplied.items(spark, folder),
            ["Score", "Episodes", "Members", "Type", "Genres", "Studios", "Source", "Aired",
             "Premiered"])),
        "profile_duplicates": on_staged(
            lambda s: P.duplicates(s.items, "item_id").unionByName(P.duplicates(s.items, "name"))
        ),
        "profile_describe": over_events(
            lambda e: describe(e, "value", DESCRIBED, ["event_type"])),
        "profile_describe_followers": on_staged(
            lambda s: describe(s.items, "followers", DESCRIBED)),
        "profile_describe_score": on_staged(lambda s: describe(
            s.items, "score", [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99])),
        "profile_value_counts": on_staged(lambda s: P.value_counts(s.items, "type")),
        "profile_distribution": on_staged(lambda s: P.value_shares(s.ratings, "rating")),
        "profile_fixed_categories": on_staged(
            lambda s: P.counts_in_order(s.items, "season", P.SEASONS)),
        "correlation": on_staged(lambda s: P.correlations(
            s.items.filter(F.col("score").isNotNull()), "score",
            ["followers", "favorites", "completed_count", "watching_count", "dropped_count"])),
        "engagement_correlation": on_staged(lambda s: P.correlations(
            P.engagement(s.items), "score",
            ["completed_per_follower", "dropped_per_follower", "log_followers"])),
        "histogram_linear": over_events(
            lambda e: P.equal_width_histogram(e, F.col("value"), 100).drop("weight", "density")),
        "histogram_log": on_staged(
            lambda s: P.log_histogram(s.items, "followers", 50).drop("weight", "density")),
        "histogram_weighted": on_staged(lambda s: P.equal_width_histogram(
            s.items, F.col("score"), 50, F.col("followers"))),
        "box_by_group": on_staged(lambda s: P.box_by_group(s.items, "score", "type")),
        "binned_rates": on_staged(lambda s: P.binned_rates(s.items)),
        "pivot_year_type": on_staged(lambda s: P.pivot_year_type(s.items)),
        "yearly_series": on_staged(lambda s: P.yearly_series(s.items)),
        "tag_counts": on_staged(lambda s: P.tag_counts(s.items)),
        "tags_per_item": on_staged(lambda s: P.tags_per_item(s.items)),
        "score_by_tag": on_staged(lambda s: P.score_by_tag(s.items)),
        "type_stats": on_staged(lambda s: P.group_stats(s.items, "type")),
        "source_stats": on_staged(lambda s: P.group_stats(s.items, "source_material")),
        "primary_maker_stats": on_staged(lambda s: P.primary_maker_stats(s.items, 20)),
        "concentration_top_pct": on_staged(lambda s: P.concentration(s.items, "followers")),
        "concentration_users": on_staged(lambda s: P.concentration(per_user(s), "rating_count")),
        "concentration_items": on_staged(
            lambda s: P.concentration(P.activity(s.ratings, "item_id"), "rating_count")),
        "concentration_top_n": on_staged(
            lambda s: P.concentration_top_n(s.items, "followers")),
        "gini": on_staged(lambda s: P.gini_of(s.items, "followers")),
        "lorenz_curve": on_staged(
            lambda s: P.lorenz_of(s.items, "followers")),
        "activity_cdf": on_staged(lambda s: P.cdf_of(per_user(s), "rating_count")),
        "value_cdf": over_events(lambda e: P.cdf_of(e, "value")),
        "global_rank_scaled": scaled_ranks,
        "sparsity": on_staged(lambda s: P.rating_overview(s.ratings)),
        "cold_start": on_staged(lambda s: P.cold_start(s.ratings)),
        "rating_by_activity": on_staged(lambda s: P.rating_by_activity(s.ratings)),
        "power_vs_rest": on_staged(lambda s: P.power_vs_rest(s.ratings)),
        "status_distribution": on_staged(lambda s: P.status_distribution(s.entries)),
        "semi_join_active_users": on_staged(lambda s: P.status_of_raters(s.entries, s.ratings)),
        "activity_per_user": on_staged(per_user),
        "activity_per_item": on_staged(lambda s: P.activity(s.ratings, "item_id")),
        "activity_describe": on_staged(
            lambda s: describe(per_user(s), "rating_count", DESCRIBED)),
        "activity_describe_items": on_staged(
            lambda s: describe(P.activity(s.ratings, "item_id"), "rating_count", DESCRIBED)),
        "histogram_user_counts": on_staged(lambda s: P.equal_width_histogram(
            per_user(s), F.col("rating_count"), 100).drop("weight")),
        "histogram_user_means": on_staged(lambda s: P.equal_width_histogram(
            per_user(s), F.col("avg_rating"), 50).drop("weight")),
        "histogram_item_counts": on_staged(lambda s: P.equal_width_histogram(
            P.activity(s.ratings, "item_id"), F.col("rating_count"), 100).drop("weight")),
        "histogram_item_means": on_staged(lambda s: P.equal_width_histogram(
            P.activity(s.ratings, "item_id"), F.col("avg_rating"), 50).drop("weight")),
        "histogram_unweighted": on_staged(lambda s: P.equal_width_histogram(
            s.items, F.col("score"), 40).drop("weight")),
        "histogram_tag_diversity": on_staged(lambda s: P.equal_width_histogram(
            P.tag_diversity(s.ratings, s.items), F.col("tag_count"), 40).drop("weight")),
        "density_by_activity": on_staged(lambda s: P.histogram_by(
            P.with_activity_group(s.ratings), F.col("avg_rating"), 30, "user_group")),
        "tag_diversity_per_user": on_staged(lambda s: P.tag_diversity(s.ratings, s.items)),
        "tag_diversity_describe": on_staged(lambda s: describe(
            P.tag_diversity(s.ratings, s.items), "tag_count", [0.1, 0.25, 0.5, 0.75, 0.9])),
    }


def text_queries() -> dict[str, Query]:
    T = texts

    def item_texts(spark: SparkSession, folder: str) -> DataFrame:
        return staged(spark, folder).text

    def documents(spark: SparkSession, folder: str) -> DataFrame:
        """The documents as they are, as texts without score."""
        return supplied.table(spark, folder, "documents").select(
            F.col("doc_id").alias("item_id"), "text", F.col("lang").alias("tags"),
            F.lit(None).cast("double").alias("score"),
        )

    def on_kept(name: str, make: Callable[[DataFrame], DataFrame],
                source: Callable[[SparkSession, str], DataFrame]):
        """What several profiles read is made from the texts once and kept."""
        def over(function: Callable[[DataFrame], DataFrame]) -> Query:
            def run(spark: SparkSession, folder: str) -> DataFrame:
                kept = shelf(spark, folder)
                if name not in kept:
                    kept(name, make(source(spark, folder)))
                return settled(function(kept[name]))
            return run
        return over

    on_measures = on_kept("text_measures", T.measured, item_texts)
    on_words = on_kept("text_words", T.word_counts, item_texts)
    on_documents = on_kept("document_measures", T.measured, documents)
    on_document_words = on_kept("document_words", T.word_counts, documents)

    return {
        "text_presence": on_staged(lambda s: T.presence(s.text)),
        "text_length_stats": on_measures(T.length_stats),
        "text_short_shares": on_measures(T.short_shares),
        "text_clipped_histogram": on_measures(
            lambda m: T.clipped_histogram(m).drop("weight", "density")),
        "text_length_by_tag": on_measures(T.length_by_tag),
        "text_score_by_length": on_measures(T.score_by_length),
        "text_length_correlation": on_measures(T.length_score_correlation),
        "text_repeated": on_measures(T.repeated),
        "text_most_repeated": on_staged(lambda s: T.most_repeated(s.text)),
        "special_char_ratio": on_measures(T.special_characters),
        "word_frequency": on_words(T.frequent_words),
        "word_counts": on_words(lambda counts: counts),
        "vocabulary_coverage": on_words(T.vocabulary),
        "text_share": on_staged(lambda s: T.text_share(s.text)),
        "score_by_text_presence": on_staged(lambda s: T.score_by_presence(s.text)),
        "document_length_stats": on_documents(T.length_stats),
        "document_special_chars": on_documents(T.special_characters),
        "document_word_frequency": on_document_words(T.frequent_words),
        "document_vocabulary": on_document_words(T.vocabulary),
        "document_most_repeated": lambda spark, folder: T.most_repeated(documents(spark, folder)),
    }


# the longest supplied texts have 20,000 words, some 120 KB; they take 3 KB on the average
ROWS_PER_FILE = 5_000


def file_queries() -> dict[str, Query]:
    """The raw-file path: a supplied table is written as CSV, read back by header and staged."""
    layouts = {"items": schemas.ITEMS, "ratings": schemas.RATINGS,
               "list_entries": schemas.LIST_ENTRIES, "item_text": schemas.ITEM_TEXT}

    def through_files(name: str, part: str) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            path = f"{shelf(spark, folder).root}/csv/{name}"
            raw = getattr(supplied, name)(spark, folder)
            # the supplied items have no column for two headers that nothing reads
            raw = raw.select([F.col(f"`{f.name}`") if f.name in raw.columns
                              else F.lit(None).cast("string").alias(f.name) for f in layouts[name]])
            # a multi-line file is read by one task, so its rows are bounded and not the number of files
            rows = ROWS_PER_FILE if name in ("items", "item_text") else 0
            raw.write.mode("overwrite").option("escape", '"').option(
                "maxRecordsPerFile", rows).csv(path, header=True)
            return settled(getattr(stage_files(spark, {name: path}), part))
        return run

    return {
        "csv_items": through_files("items", "items"),
        "csv_ratings": through_files("ratings", "ratings"),
        "csv_list_entries": through_files("list_entries", "entries"),
        "csv_item_text": through_files("item_text", "text"),
    }


def quality_queries() -> dict[str, Query]:
    Q = quality

    def on_both(function: Callable[[Staged, Marts], DataFrame]) -> Query:
        return lambda spark, folder: function(
            staged(spark, folder), marts(spark, folder)
        )

    def on_all(function: Callable[[Staged, Marts], DataFrame]) -> Query:
        """These read every table: what does not read one another is made side by side."""
        return on_both(lambda s, m: function(s, m.make_all()))

    return {
        "quality_unique": on_all(Q.all_unique),
        "quality_not_null": on_all(Q.all_not_null),
        "quality_accepted": on_both(lambda s, m: Q.all_accepted(s)),
        "quality_orphans": on_all(Q.all_orphans),
        "quality_ranges": on_both(lambda s, m: Q.ranges(m.content)),
        "quality_cross_column": on_both(lambda s, m: Q.cross_column(m.item_stats)),
        "quality_all": lambda spark, folder: Q.all_checks(
            staged(spark, folder), marts(spark, folder).make_all(), shelf(spark, folder).failures
        ),
    }


def metric_queries() -> dict[str, Query]:
    def over(table: Callable[[Staged, Marts], DataFrame], name: str, by: list[str]) -> Query:
        return lambda spark, folder: settled(metric(
            table(staged(spark, folder), marts(spark, folder)), name, by
        ))

    def content(s: Staged, m: Marts) -> DataFrame:
        return m.content

    def listings(s: Staged, m: Marts) -> DataFrame:
        return explode_list(m.item_stats, "tags", "tag")

    def ratings(s: Staged, m: Marts) -> DataFrame:
        return s.ratings

    def entries(s: Staged, m: Marts) -> DataFrame:
        return s.entries

    grains = {
        "avg_score": (content, ["type"]),
        "completion_rate": (entries, ["item_id"]),
        "drop_rate": (entries, ["item_id"]),
        "performance_score": (content, ["source_category"]),
        "high_rating_ratio": (ratings, ["item_id"]),
        "low_rating_ratio": (ratings, ["item_id"]),
        "total_ratings": (ratings, ["user_id"]),
        "user_avg_rating": (ratings, ["user_id"]),
        "user_completion_rate": (entries, ["user_id"]),
        "rating_engagement_ratio": (lambda s, m: m.users, ["user_tier"]),
        "tag_item_count": (listings, ["tag"]),
        "tag_health_score": (listings, ["tag"]),
        "count_growth_rate": (lambda s, m: models.yearly_tags(m.item_stats), ["tag"]),
    }
    return {
        f"metric_{name}": over(table, name, by) for name, (table, by) in grains.items()
    }


def compare_queries() -> dict[str, Query]:
    C = compare
    keys = ["query_id", "row_no"]

    def results(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
        expected = C.row_cells(
            supplied.expected_results(spark, folder), keys,
            ["customer", "priority", "status", "total"],
        )
        parts = [C.row_cells(df, ["mode", *keys], columns)
                 for df, columns in supplied.actual_results(spark, folder)]
        return expected, parts[0].unionByName(parts[1])

    def few_rows(spark: SparkSession, folder: str) -> DataFrame:
        """Runs of which one side or both return no rows, or which failed."""
        expected, actual = results(spark, folder)
        number = F.substring("query_id", 2, 2).cast("int") % 4
        columns = F.array(*[F.lit(c) for c in ("customer", "priority", "status", "total")])
        runs = actual.select(*C.RUN).distinct().select(
            *C.RUN, columns.alias("expected_columns"),
            F.when(number != 3, columns).alias("actual_columns"),
        )
        # 0: both empty, 1: nothing expected, 2: nothing returned, 3: failed
        return C.verdicts(expected.filter(number >= 2), actual.filter(number == 1), runs)

    def level(function: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
        return lambda spark, folder: function(*results(spark, folder))

    def shapes(spark: SparkSession, folder: str) -> DataFrame:
        kept = shelf(spark, folder)
        return kept["compared_shapes"] if "compared_shapes" in kept else kept(
            "compared_shapes", C.shapes_of(*results(spark, folder)))

    def compared(spark: SparkSession, folder: str) -> DataFrame:
        """The comparison of all rows, kept: verdicts and rates read it."""
        kept = shelf(spark, folder)
        return kept["compared"] if "compared" in kept else kept("compared", C.result(
            *results(spark, folder), shapes=shapes(spark, folder), keep=kept))

    def verdicts(spark: SparkSession, folder: str) -> DataFrame:
        kept = shelf(spark, folder)
        return kept["verdicts"] if "verdicts" in kept else kept("verdicts", C.verdicts(
            *results(spark, folder), compared=compared(spark, folder),
            shapes=shapes(spark, folder)))

    def log(function: Callable[[DataFrame], DataFrame]) -> Query:
        return lambda spark, folder: settled(function(
            C.outcomes(supplied.attempts(spark, folder), verdicts(spark, folder))))

    return {
        "compare_structure": level(C.structure),
        "compare_first_row": level(C.first_row),
        "compare_result": compared,
        "compare_verdicts": verdicts,
        "compare_few_rows": few_rows,
        "error_labels": lambda spark, folder: supplied.attempts(spark, folder).groupBy(
            "message", C.error_label(F.col("message")).alias("error_type")
        ).agg(F.count("*").alias("attempt_count")),
        "rates_by_mode": log(lambda o: C.rates(o, ["mode"])),
        "rates_by_level": log(C.rates_by_level),
        "error_counts": log(C.error_counts),
        "mode_difference": log(lambda o: C.mode_difference(o, "plain", "guided")),
    }


def all_queries() -> dict[str, Query]:
    return (
        table_queries()
        | question_queries()
        | pattern_queries()
        | profile_queries()
        | text_queries()
        | file_queries()
        | quality_queries()
        | metric_queries()
        | {"dictionary_content": lambda spark, folder: dictionary.dictionary(marts(spark, folder))}
        | compare_queries()
    )
