"""DuckDB SQL for the profiles of items, facts, events and texts."""

from __future__ import annotations

from oracle.tables import PIECES

# fixed values: words left out of the frequency count
_STOP_WORDS = """
the a an and or but in on at to for of with by from is are was were be been has have had do does
did will would could should may might this that these those it its his her he she they them
their who which what when where how all each every both few more most other some such no not
only own same than too very just about also into as after before between through during while if
then so because up out one two new now way can over him my our your any being there even
""".split()

_POINTS = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
_DESCRIBED = "mean std min max " + " ".join(_POINTS)


def _describe(value: str, source: str, by: str = "", points: dict | None = None) -> str:
    points = _POINTS if points is None else points
    quantiles = ", ".join(f"quantile_cont({value}, {p}) as {n}" for n, p in points.items())
    lead = f"{by}, " if by else ""
    tail = f" group by {by}" if by else ""
    return f"""select {lead}count({value}) as count, avg({value}) as mean,
        stddev_samp({value}) as std, cast(min({value}) as double) as min,
        cast(max({value}) as double) as max, {quantiles} from {source}{tail}"""


def _top_pct(value: str, source: str) -> str:
    return " union all ".join(
        f"""select 'top {label}%' as label, cast(floor((select count(*) from {source}) * {p}) as bigint)
          as top_rows,
          sum({value}) filter (where place <= floor((select count(*) from {source}) * {p}))
            / sum({value}) as share
        from (select {value}, row_number() over (order by {value} desc nulls last) as place
              from {source})"""
        for label, p in (("1", 0.01), ("5", 0.05), ("10", 0.1))
    )


PIECES["user_activity"] = """
select user_id, count(*) as rating_count, avg(rating) as avg_rating from stg_ratings
group by user_id
"""
PIECES["item_activity"] = """
select item_id, count(*) as rating_count, avg(rating) as avg_rating from stg_ratings
group by item_id
"""
PIECES["followed"] = """
select item_id, score, followers, cast(completed_count as double) / followers as completed,
  cast(dropped_count as double) / followers as dropped, log10(greatest(followers, 1)) as log_f
from stg_items where score is not null and completed_count is not null and followers > 0
"""
PIECES["item_tags"] = """
select * from (select item_id, score, trim(unnest(string_split(tags, ', '))) as tag
               from stg_items where tags <> 'Unknown') where tag <> ''
"""
PIECES["usable_text"] = """
select item_id, tags, score, text, length(text) as text_length,
  len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) as word_count
from stg_item_text
where text <> '' and text <> 'No synopsis information has been added to this title.'
"""
PIECES["text_tags"] = """
select * from (select item_id, word_count, trim(unnest(string_split(tags, ', '))) as tag
               from usable_text where tags <> 'Unknown') where tag <> ''
"""

PIECES["text_words"] = f"""
select word, count(*) as word_count
from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from usable_text)
where length(word) >= 3 and word not in ({", ".join(f"'{w}'" for w in _STOP_WORDS)})
group by word
"""


PIECES["usable_documents"] = """
select doc_id as item_id, text, length(text) as text_length,
  len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) as word_count
from documents where text <> ''
"""
PIECES["document_word_list"] = f"""
select word, count(*) as word_count
from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from usable_documents)
where length(word) >= 3 and word not in ({", ".join(f"'{w}'" for w in _STOP_WORDS)})
group by word
"""
PIECES["user_tags"] = """
select user_id, count(distinct tag) as tag_count
from (select user_id, unnest(string_split(tags, ', ')) as tag
      from stg_ratings join stg_items using (item_id)) group by user_id
"""
PIECES["grouped_users"] = """
select *, if(rating_count >= (select quantile_cont(rating_count, 0.99) from user_activity),
             'power', 'rest') as user_group
from user_activity
"""


def _histogram(value: str, source: str, bins: int, weight: str = "") -> str:
    extra = (
        f""", sum(w) as weight,
        sum(w) / max(total) / max((hi - lo) / {bins}) as density""" if weight else ""
    )
    return f"""select bin, max(lo + bin * ((hi - lo) / {bins})) as low,
          max(lo + (bin + 1) * ((hi - lo) / {bins})) as high, count(*) as row_count{extra}
        from (select *, cast(least(floor((v - lo) / (hi - lo) * {bins}), {bins - 1}) as bigint) as bin
              from (select v, w, min(v) over () as lo, max(v) over () as hi, sum(w) over () as total
                    from (select cast({value} as double) as v,
                            cast(coalesce({weight or 1}, 0) as double) as w
                          from {source} where {value} is not null)))
        group by bin"""


def _correlate(against: str, names: list[str], source: str, labels: list[str] | None = None) -> str:
    return " union all ".join(
        f"select '{label}' as column_name, corr({against}, {name}) as correlation from {source}"
        for name, label in zip(names, labels or names, strict=True)
    )


def _bands(value: str, edges: list[int], labels: list[str]) -> str:
    rungs = " ".join(f"when {value} <= {e} then '{t}'" for e, t in zip(edges[1:], labels, strict=False))
    return f"case when {value} <= {edges[0]} then null {rungs} else '{labels[-1]}' end"


_ITEM_COLUMNS = (
    "item_id name english_name japanese_name type source_material makers tags age_rating duration "
    "aired premiered episodes listed_rank followers favorites watching_count completed_count "
    "on_hold_count dropped_count plan_to_watch_count score ranked "
    + " ".join(f"score_{n}_count" for n in range(10, 0, -1))
    + " start_year season source_category is_digital_native"
).split()

_STATUS = """case status_code when 1 then 'Watching' when 2 then 'Completed' when 3 then 'On Hold'
          when 4 then 'Dropped' when 6 then 'Plan to Watch' end"""

_GROUP_STATS = """count(*) as item_count, avg(score) as avg_score, avg(followers) as avg_followers"""

PROFILES: dict[str, tuple[str, str]] = {
    "profile_nulls": (" union all ".join(
        f"select '{c}' as column_name, 100.0 * (count(*) - count({c})) / count(*) as null_pct "
        "from stg_items" for c in _ITEM_COLUMNS), "null_pct"),
    "profile_sentinels": (" union all ".join(
        f"""select '{c}' as column_name, count(*) filter (where "{c}" = 'Unknown') as sentinel_count,
        100.0 * count(*) filter (where "{c}" = 'Unknown') / count(*) as sentinel_pct from raw_items"""
        for c in ("Score", "Episodes", "Members", "Type", "Genres", "Studios", "Source", "Aired",
                  "Premiered")), "sentinel_pct"),
    "profile_duplicates": (" union all ".join(
        f"""select '{c}' as column_name, count(*) as row_count,
          count(*) - count(distinct {c}) as duplicate_count,
          cast(count(*) - count(distinct {c}) as double) / count(*) as duplicate_ratio
        from stg_items""" for c in ("item_id", "name")), "duplicate_ratio"),
    "profile_describe": (_describe("value", "events", "event_type"), _DESCRIBED),
    "profile_describe_followers": (_describe("followers", "stg_items"), _DESCRIBED),
    "profile_describe_score": (
        _describe("score", "stg_items", points={"p1": 0.01, "p10": 0.1, "p25": 0.25, "p50": 0.5,
                                                "p75": 0.75, "p90": 0.9, "p99": 0.99}),
        "mean std min max p1 p10 p25 p50 p75 p90 p99"),
    "profile_value_counts": (
        "select type, count(*) as value_count from stg_items group by type", ""),
    "profile_distribution": ("""select rating, count(*) as value_count,
          count(*) * 100.0 / (select count(*) from stg_ratings) as pct
        from stg_ratings group by rating""", "pct"),
    "profile_fixed_categories": ("""select cast(p as integer) as position, category,
          (select count(*) from stg_items where season = category) as value_count
        from (values (0, 'Winter'), (1, 'Spring'), (2, 'Summer'), (3, 'Fall')) t(p, category)""", ""),
    "correlation": (_correlate("score", ["followers", "favorites", "completed_count",
                                         "watching_count", "dropped_count"], "stg_items"),
                    "correlation"),
    "engagement_correlation": (
        _correlate("score", ["completed", "dropped", "log_f"], "followed",
                   ["completed_per_follower", "dropped_per_follower", "log_followers"]),
        "correlation"),
    "histogram_linear": (_histogram("value", "events", 100), "low high"),
    "histogram_log": (_histogram("log10(greatest(followers, 1))",
                                 "(select followers from stg_items where followers is not null)",
                                 50), "low high"),
    "histogram_weighted": (_histogram("score", "stg_items", 50, "followers"),
                           "low high weight density"),
    "box_by_group": ("""select type, count(*) as row_count, min(score) as p0,
          quantile_cont(score, 0.25) as p25, median(score) as p50,
          quantile_cont(score, 0.75) as p75, max(score) as p100
        from stg_items where score is not null group by type""", "p0 p25 p50 p75 p100"),
    "binned_rates": (f"""select {_bands('score', [0, 4, 5, 6, 7, 8, 9, 10], [
            '(0, 4]', '(4, 5]', '(5, 6]', '(6, 7]', '(7, 8]', '(8, 9]', '(9, 10]'])} as score_band,
          count(*) as item_count, avg(completed) as avg_completion, avg(dropped) as avg_drop
        from followed group by 1""", "avg_completion avg_drop"),
    "pivot_year_type": ("select start_year, " + ", ".join(
        f"sum(if(type = '{t}', 1, 0))::bigint as {t.lower()}_count"
        for t in ("TV", "OVA", "Movie", "ONA", "Special", "Music", "Unknown"))
        + ", sum(if(coalesce(type in ('TV', 'OVA', 'Movie', 'ONA', 'Special', 'Music', 'Unknown'), "
        "false), 0, 1))::bigint as other_count from stg_items where start_year >= 2000 group by start_year", ""),
    "yearly_series": ("""select start_year, count(*) as item_count, avg(score) as avg_score,
          count(score) as scored_count
        from stg_items where start_year >= 1960 group by start_year""", "avg_score"),
    "tag_counts": ("select tag, count(*) as value_count from item_tags group by tag", ""),
    "tags_per_item": (_describe(
        "n", """(select case when tags = 'Unknown' then 0
              else len(list_filter(string_split(tags, ', '), lambda x: trim(x) <> '')) end as n
            from stg_items)""", points={"p25": 0.25, "p50": 0.5, "p75": 0.75}),
        "mean std min max p25 p50 p75"),
    "score_by_tag": ("""select tag, avg(score) as avg_score, count(*) as item_count from item_tags
        where score is not null group by tag having count(*) >= 50""", "avg_score"),
    "type_stats": (f"select type, {_GROUP_STATS} from stg_items where score is not null "
                   "group by type", "avg_score avg_followers"),
    "source_stats": (f"select source_material, {_GROUP_STATS} from stg_items "
                     "where score is not null group by source_material",
                     "avg_score avg_followers"),
    "primary_maker_stats": (f"""select trim(split_part(makers, ',', 1)) as primary_maker,
          {_GROUP_STATS} from stg_items where score is not null and makers <> 'Unknown'
        group by 1 having count(*) >= 20""", "avg_score avg_followers"),
    "concentration_top_pct": (_top_pct("followers", "stg_items"), "share"),
    "concentration_users": (_top_pct("rating_count", "user_activity"), "share"),
    "concentration_items": (_top_pct("rating_count", "item_activity"), "share"),
    "concentration_top_n": (" union all ".join(
        f"""select 'top {k}' as label, cast({k} as bigint) as top_rows,
          (select sum(followers) from (select followers from stg_items
             order by followers desc nulls last limit {k})) / sum(followers) as share
        from stg_items""" for k in (10, 50, 100, 500)), "share"),
    "gini": ("""select count(*) as n_rows,
          2 * sum(cast(i * f as double)) / (count(*) * sum(f))
            - (count(*) + 1) / cast(count(*) as double) as gini
        from (select followers as f, row_number() over (order by followers) as i
              from stg_items where followers is not null)""", "gini"),
    "lorenz_curve": ("""select value, max(i) / max(n) as population_share,
          max(c) / max(t) as value_share
        from (select followers as value, row_number() over w as i,
                sum(followers) over (w rows unbounded preceding) as c,
                count(*) over () as n, sum(followers) over () as t
              from stg_items where followers is not null window w as (order by followers))
        group by value""", "population_share value_share"),
    "activity_cdf": ("""select value, count(*) as n, max(d) as cumulative_share
        from (select rating_count as value, cume_dist() over (order by rating_count) as d
              from user_activity) group by value""", "cumulative_share"),
    "value_cdf": ("""select value, count(*) as n, max(d) as cumulative_share
        from (select value, cume_dist() over (order by value) as d from events)
        group by value""", "value cumulative_share"),
    "global_rank_scaled": ("""select o_orderkey, price,
          rank() over (order by price desc nulls last) as price_rank,
          percent_rank() over (order by price asc nulls last) as price_place
        from (select o_orderkey, if(o_orderkey % 13 = 0, null, o_totalprice) as price
              from orders)""", "price price_place"),
    "sparsity": ("""select count(*) as rating_count, min(rating) as min_rating,
          max(rating) as max_rating, avg(rating) as avg_rating, median(rating) as median_rating,
          count(distinct user_id) as user_count, count(distinct item_id) as item_count,
          1 - count(*) / (cast(count(distinct user_id) as double) * count(distinct item_id))
            as sparsity
        from stg_ratings""", "avg_rating median_rating sparsity"),
    "cold_start": ("""select threshold,
          100.0 * (select count(*) from user_activity where rating_count <= threshold)
            / (select count(*) from user_activity) as cold_user_pct,
          100.0 * (select count(*) from item_activity where rating_count <= threshold)
            / (select count(*) from item_activity) as cold_item_pct,
          concat_ws(' ', if(threshold = u10, 'user p10', null), if(threshold = u20, 'user p20', null),
            if(threshold = i10, 'item p10', null), if(threshold = i20, 'item p20', null)) as label
        from (select distinct cast(unnest([5, 10, 20, u10, u20]) as bigint) as threshold,
                u10, u20, i10, i20
              from (select floor(quantile_cont(rating_count, 0.1)) as u10,
                      floor(quantile_cont(rating_count, 0.2)) as u20 from user_activity),
                   (select floor(quantile_cont(rating_count, 0.1)) as i10,
                      floor(quantile_cont(rating_count, 0.2)) as i20 from item_activity))""",
                   "cold_user_pct cold_item_pct"),
    "rating_by_activity": (f"""select {_bands('rating_count', [0, 10, 30, 100, 300, 1000], [
            '1-10', '11-30', '31-100', '101-300', '301-1000', '1000+'])} as activity_band,
          count(*) as user_count, avg(avg_rating) as avg_rating,
          stddev_samp(avg_rating) as std_rating
        from user_activity u group by 1""", "avg_rating std_rating"),
    "power_vs_rest": ("""select user_group, user_count, total_ratings, avg_rating,
          100.0 * user_count / sum(user_count) over () as user_pct,
          100.0 * total_ratings / sum(total_ratings) over () as rating_pct
        from (select if(rating_count >= (select quantile_cont(rating_count, 0.99)
                          from user_activity), 'power', 'rest') as user_group,
                count(*) as user_count, cast(sum(rating_count) as bigint) as total_ratings,
                avg(avg_rating) as avg_rating
              from user_activity u group by 1)""", "avg_rating user_pct rating_pct"),
    "status_distribution": (f"""select status_code, {_STATUS} as status_name,
          count(*) as entry_count, avg(rating) as avg_rating,
          count(*) filter (where rating > 0) as rated_count,
          100.0 * count(*) / (select count(*) from stg_list_entries) as pct,
          100.0 * count(*) filter (where rating > 0) / count(*) as rated_pct
        from stg_list_entries group by status_code""", "avg_rating pct rated_pct"),
    "semi_join_active_users": (f"""select status_code, {_STATUS} as status_name,
          count(*) as entry_count, avg(rating) filter (where rating > 0) as avg_rating_when_rated,
          100.0 * count(*) filter (where rating > 0) / count(*) as rated_pct
        from stg_list_entries where user_id in (select user_id from stg_ratings)
        group by status_code""", "avg_rating_when_rated rated_pct"),
    "activity_per_user": ("select * from user_activity", "avg_rating"),
    "activity_per_item": ("select * from item_activity", "avg_rating"),
    "activity_describe": (_describe("rating_count", "user_activity"), _DESCRIBED),
    "sketched_distinct": ("""select count(*) as keys, count(*) as within
        from (select item_id from stg_ratings group by item_id)""", ""),
    "sketched_quantiles": ("""select type, count(*) as n, 3::bigint as within
        from stg_items where followers is not null group by type""", ""),
    "tag_diversity_per_user": ("""select user_id, count(distinct tag) as tag_count
        from (select user_id, unnest(string_split(tags, ', ')) as tag
              from stg_ratings join stg_items using (item_id))
        group by user_id""", ""),
    "tag_diversity_describe": (_describe(
        "tag_count", """(select user_id, count(distinct tag) as tag_count
            from (select user_id, unnest(string_split(tags, ', ')) as tag
                  from stg_ratings join stg_items using (item_id)) group by user_id)""",
        points={"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}),
        "mean std min max p10 p25 p50 p75 p90"),
}

_LONG = "(select 'text_length' as measure, text_length as value from usable_text union all " \
        "select 'word_count', word_count from usable_text)"

_SPECIAL = """(select len(regexp_extract_all(text, '[^a-zA-Z0-9 \\t\\n\\x0B\\f\\r]'))
              / cast(greatest(length(text), 1) as double) as s from {source})"""


def _density(value: str, source: str, bins: int) -> tuple[str, str]:
    """An unweighted histogram with its density."""
    select = _histogram(value, source, bins, "1")
    return f"select * exclude (weight) from ({select})", "low high density"


PROFILES |= {
    "activity_describe_items": (_describe("rating_count", "item_activity"), _DESCRIBED),
    "histogram_user_counts": _density("rating_count", "user_activity", 100),
    "histogram_user_means": _density("avg_rating", "user_activity", 50),
    "histogram_item_counts": _density("rating_count", "item_activity", 100),
    "histogram_item_means": _density("avg_rating", "item_activity", 50),
    "histogram_unweighted": _density("score", "stg_items", 40),
    "histogram_tag_diversity": _density("tag_count", "user_tags", 40),
    "density_by_activity": (" union all ".join(
        f"select '{group}' as user_group, * exclude (weight) from ("
        + _histogram("avg_rating", f"(select * from grouped_users where user_group = '{group}')", 30, "1")
        + ")" for group in ("power", "rest")), "low high density"),
    "text_share": ("""select (select count(*) from usable_text) as item_count,
          100.0 * (select count(*) from usable_text) / count(*) as item_pct from stg_item_text""",
                   "item_pct"),
    "score_by_text_presence": ("""select if(item_id in (select item_id from usable_text),
            'has text', 'no text') as presence, count(*) as row_count, min(score) as p0,
          quantile_cont(score, 0.25) as p25, median(score) as p50,
          quantile_cont(score, 0.75) as p75, max(score) as p100
        from stg_item_text where score is not null group by 1""", "p0 p25 p50 p75 p100"),
    "document_length_stats": (_describe("value", _LONG.replace("usable_text", "usable_documents"),
                                        "measure"), _DESCRIBED),
    "document_special_chars": (_describe(
        "s", _SPECIAL.format(source="usable_documents"),
        points={"p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}),
        "mean std min max p75 p90 p95 p99"),
    "document_word_frequency": ("""select word, word_count from document_word_list
        order by word_count desc, word limit 30""", ""),
    "document_vocabulary": ("""select count(*) as vocabulary_size,
          cast(sum(word_count) as bigint) as words,
          100.0 * (select sum(word_count) from (select word_count from document_word_list
            order by word_count desc limit 5000)) / sum(word_count) as coverage_pct
        from document_word_list""", "coverage_pct"),
    "document_most_repeated": ("""select count(*) as copies, sha256(text) as digest, text
        from usable_documents group by text order by copies desc, digest limit 5""", ""),
    "text_presence": ("""select if(coalesce(text <> '' and text <>
            'No synopsis information has been added to this title.', false),
            'has text', 'no text') as presence,
          count(*) as item_count, avg(score) as avg_score
        from stg_item_text group by 1""", "avg_score"),
    "text_length_stats": (_describe("value", _LONG, "measure"), _DESCRIBED),
    "text_short_shares": ("""select
          100.0 * count(*) filter (where word_count <= 10) / count(*) as upto_10_pct,
          100.0 * count(*) filter (where word_count <= 50) / count(*) as upto_50_pct,
          cast(floor(quantile_cont(word_count, 0.1)) as bigint) as p10_words
        from usable_text""", "upto_10_pct upto_50_pct"),
    "text_clipped_histogram": (_histogram(
        "c", """(select least(word_count, (select quantile_cont(word_count, 0.99)
              from usable_text)) as c from usable_text)""", 50), "low high"),
    "text_length_by_tag": ("""select tag, count(*) as item_count, avg(word_count) as avg_words,
          median(word_count) as median_words
        from text_tags group by tag having count(*) >= 100""", "avg_words median_words"),
    "text_score_by_length": (f"""select {_bands('word_count', [0, 20, 50, 100, 200, 500], [
            '0-20', '21-50', '51-100', '101-200', '201-500', '500+'])} as length_band,
          avg(score) as avg_score, count(*) as item_count, stddev_samp(score) as std_score
        from usable_text where score is not null group by 1""", "avg_score std_score"),
    "text_length_correlation": (
        "select corr(word_count, score) as correlation from usable_text", "correlation"),
    "text_repeated": ("""select count(*) as text_count,
          count(*) - count(distinct text) as duplicate_count,
          100.0 * (count(*) - count(distinct text)) / count(*) as duplicate_pct
        from usable_text""", "duplicate_pct"),
    "text_most_repeated": ("""select count(*) as copies, sha256(text) as digest, text
        from usable_text group by text order by copies desc, digest limit 5""", ""),
    "special_char_ratio": (_describe(
        "s", """(select len(regexp_extract_all(text, '[^a-zA-Z0-9 \\t\\n\\x0B\\f\\r]'))
              / cast(greatest(length(text), 1) as double) as s from usable_text)""",
        points={"p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}),
        "mean std min max p75 p90 p95 p99"),
    "word_frequency": (
        "select word, word_count from text_words order by word_count desc, word limit 30", ""),
    "word_counts": ("select word, word_count from text_words", ""),
    "vocabulary_coverage": ("""select count(*) as vocabulary_size,
          cast(sum(word_count) as bigint) as words,
          100.0 * (select sum(word_count) from (select word_count from text_words
            order by word_count desc limit 5000)) / sum(word_count) as coverage_pct
        from text_words""", "coverage_pct"),
}
