"""DuckDB SQL for the raw sources, the staged rows and the item, user and tag tables.

Named pieces; ``sql`` puts together the ones a final select needs.
"""

from __future__ import annotations

import re

PIECES: dict[str, str] = {}

PIECES["part_keys"] = """
select p_partkey as k, p_name, p_brand, p_type, cast(p_size as bigint) as size,
  case when starts_with(p_name, 'hot') and 1998 + p_partkey % 23 between 2010 and 2014
       then 1998 + p_partkey % 23 + 5
       when starts_with(p_name, 'cold') and p_partkey % 2 = 0
            and 1998 + p_partkey % 23 between 2015 and 2019 then 1998 + p_partkey % 23 - 5
       else 1998 + p_partkey % 23 end as y,
  100 + (p_partkey * 37 + p_size) % 901 as cents,
  2600000 // (1 + (p_partkey * 7919) % 4999) + p_size as fol
from part
"""

_LEVELS = ",\n  ".join(
    f"cast(fol // {12 - n} as varchar) || '.0' as \"Score-{n}\"" for n in range(10, 0, -1)
)


def _fol(percent: str) -> str:
    return f"case when k % 211 = 0 then 'Unknown' else cast(fol * ({percent}) // 100 as varchar) end"


PIECES["raw_items"] = f"""
select k as "MAL_ID", p_name as "Name",
  case when k % 7 = 0 then 'Unknown'
       else cast(cents // 100 as varchar) || '.' || lpad(cast(cents % 100 as varchar), 2, '0')
  end as "Score",
  case when k % 41 = 0 then 'Unknown' else replace(p_name, ' ', ', ') end as "Genres",
  case when k % 2 = 0 then 'Unknown' else upper(p_name) end as "English name",
  p_name as "Japanese name",
  case when k % 53 = 0 then 'Unknown' when p_type = 'ECONOMY' then 'ONA'
       when p_type = 'SMALL' then 'Special' when p_type = 'MEDIUM' then 'OVA'
       when p_type = 'LARGE' then 'Movie' when p_type = 'PROMO' then 'Music' else 'TV'
  end as "Type",
  case when k % 11 = 0 then 'Unknown' when k % 13 = 0 then cast(size as varchar) || '.0'
       when k % 17 = 0 then cast(size + 30 as varchar) else cast(size as varchar)
  end as "Episodes",
  case when k % 43 = 0 then 'Unknown'
       else 'Apr 3, ' || cast(y as varchar)
            || case when k % 3 = 0 then ' to Jun 24, ' || cast(y + 1 as varchar) else '' end
  end as "Aired",
  case when k % 9 = 0 then 'Unknown'
       else (case k % 4 when 0 then 'Winter' when 1 then 'Spring' when 2 then 'Summer'
             else 'Fall' end) || ' ' || cast(y as varchar) end as "Premiered",
  case when k % 31 = 0 then 'Unknown' when k % 5 = 0 then p_brand || ', Second House'
       else p_brand end as "Studios",
  case k % 6 when 0 then 'Manga' when 1 then 'Light novel' when 2 then 'Original'
       when 3 then 'Unknown' when 4 then 'Game' else 'Visual novel' end as "Source",
  cast(size as varchar) || ' min. per ep.' as "Duration",
  'PG-13 - Teens 13 or older' as "Rating",
  case when k % 7 = 0 then 'Unknown' else cast(k + 1 as varchar) || '.0' end as "Ranked",
  cast(k + 1 as varchar) as "Popularity",
  case when k % 211 = 0 then 'Unknown' else cast(fol as varchar) end as "Members",
  {_fol('2')} as "Favorites", {_fol('10')} as "Watching", {_fol('k % 50 + 30')} as "Completed",
  {_fol('5')} as "On-Hold", {_fol('k % 19')} as "Dropped", {_fol('20')} as "Plan to Watch",
  {_LEVELS}
from part_keys
"""

PIECES["raw_list_entries"] = """
select o_custkey as user_id, l_partkey as anime_id,
  cast(ceil(l_quantity / 4) - 1 as integer) as rating,
  case l_returnflag || l_linestatus when 'AO' then 1 when 'AF' then 2 when 'NF' then 3
       when 'RF' then 4 when 'RO' then 5 when 'NO' then 6 end as watching_status,
  l_linenumber as watched_episodes
from lineitem join orders on l_orderkey = o_orderkey
"""

PIECES["raw_ratings"] = """
select user_id, anime_id, rating from raw_list_entries where watching_status = 2
"""

PIECES["raw_item_text"] = """
select doc_id as "MAL_ID", source as "Name",
  case when doc_id % 7 = 0 then 'Unknown'
       else cast(doc_id % 9 + 1 as varchar) || '.' || lpad(cast(doc_id * 7 % 100 as varchar), 2, '0')
  end as "Score",
  case when doc_id % 37 = 0 then 'Unknown' else lang || ', ' || source end as "Genres",
  case when doc_id % 22 = 0 then ''
       when doc_id % 11 = 0 then 'No synopsis information has been added to this title.'
       else text end as "sypnopsis"
from documents
"""

_WHOLE = {
    "episodes": "Episodes", "listed_rank": "Popularity", "followers": "Members",
    "favorites": "Favorites", "watching_count": "Watching", "completed_count": "Completed",
    "on_hold_count": "On-Hold", "dropped_count": "Dropped", "plan_to_watch_count": "Plan to Watch",
}
_REAL = {"score": "Score", "ranked": "Ranked"} | {
    f"score_{n}_count": f"Score-{n}" for n in range(10, 0, -1)
}

PIECES["stg_items"] = f"""
select "MAL_ID" as item_id, "Name" as name, "English name" as english_name,
  "Japanese name" as japanese_name, "Type" as type, "Source" as source_material,
  "Studios" as makers, "Genres" as tags, "Rating" as age_rating, "Duration" as duration,
  "Aired" as aired, "Premiered" as premiered,
  {", ".join(f'try_cast("{raw}" as integer) as {name}' for name, raw in _WHOLE.items())},
  {", ".join(f'try_cast("{raw}" as double) as {name}' for name, raw in _REAL.items())},
  try_cast(regexp_extract("Aired", '([0-9]{{4}})', 1) as integer) as start_year,
  case when "Premiered" <> 'Unknown' then split_part("Premiered", ' ', 1) end as season,
  -- fixed values: which sources count as what
  case when "Source" in ('Manga', 'Light novel', 'Visual novel', 'Novel', 'Web manga')
       then 'IP-based'
       when "Source" = 'Original' then 'Original'
       when "Source" = 'Unknown' then null
       else 'Other-IP' end as source_category,
  coalesce("Type" = 'ONA', false) as is_digital_native
from raw_items
"""

PIECES["stg_ratings"] = """
select user_id, anime_id as item_id, rating from raw_ratings where rating >= 1 and rating <= 10
"""

PIECES["stg_list_entries"] = """
select user_id, anime_id as item_id, rating, watching_status as status_code,
  -- fixed values: status codes
  case watching_status when 1 then 'Watching' when 2 then 'Completed' when 3 then 'On Hold'
       when 4 then 'Dropped' when 6 then 'Plan to Watch' else 'Unknown' end as status,
  watched_episodes
from raw_list_entries
"""

PIECES["stg_item_text"] = """
select "MAL_ID" as item_id, "Name" as name, try_cast("Score" as double) as score,
  "Genres" as tags, "sypnopsis" as text,
  coalesce("sypnopsis" <> '' and not starts_with("sypnopsis", 'No synopsis'), false) as has_text,
  length("sypnopsis") as text_length,
  case when trim("sypnopsis") <> '' and not starts_with("sypnopsis", 'No synopsis')
       then len(string_split(trim("sypnopsis"), ' ')) else 0 end as text_words
from raw_item_text
"""


def _rating_stats(key: str, count: str) -> str:
    return f"""
select {key}, count(*) as {count}, avg(rating) as avg_rating, median(rating) as median_rating,
  stddev_samp(rating) as stddev_rating, min(rating) as min_rating, max(rating) as max_rating,
  cast(sum(if(rating >= 8, 1, 0)) as double) / count(*) as high_rating_ratio,
  cast(sum(if(rating <= 4, 1, 0)) as double) / count(*) as low_rating_ratio,
  count(distinct item_id) as unique_items_rated
from stg_ratings group by {key}
"""


def _status(label: str) -> str:
    return f"cast(sum(if(status = '{label}', 1, 0)) as bigint)"


def _status_profile(key: str) -> str:
    return f"""
select {key}, count(*) as n, {_status('Completed')} as n_completed,
  {_status('Watching')} as n_watching, {_status('Dropped')} as n_dropped,
  {_status('On Hold')} as n_on_hold, {_status('Plan to Watch')} as n_plan,
  cast(sum(watched_episodes) as bigint) as n_episodes
from stg_list_entries group by {key}
"""


PIECES["rated_items"] = _rating_stats("item_id", "rating_count")
PIECES["rated_users"] = _rating_stats("user_id", "total_ratings")
PIECES["listed_items"] = _status_profile("item_id")
PIECES["listed_users"] = _status_profile("user_id")

PIECES["item_stats"] = """
select i.item_id, i.name, i.type, i.tags, i.source_material, i.source_category, i.makers,
  i.score as community_score, i.followers, i.favorites, i.start_year, i.season, i.episodes,
  i.is_digital_native,
  case when place >= 0.99 then 'Top 1%' when place >= 0.95 then 'Top 5%'
       when place >= 0.90 then 'Top 10%' when place >= 0.50 then 'Upper Half'
       else 'Lower Half' end as followers_tier,
  r.rating_count, r.avg_rating, r.median_rating, r.stddev_rating, r.min_rating, r.max_rating,
  r.high_rating_ratio, r.low_rating_ratio,
  l.n as total_list_count, l.n_completed as completed_users, l.n_watching as watching_users,
  l.n_dropped as dropped_users, l.n_on_hold as on_hold_users, l.n_plan as plan_to_watch_users,
  cast(l.n_completed as double) / nullif(l.n, 0) as completion_rate,
  cast(l.n_dropped as double) / nullif(l.n, 0) as drop_rate,
  cast(l.n_plan as double) / nullif(l.n, 0) as plan_rate,
  r.rating_count is not null as has_ratings
from (select *, percent_rank() over (order by followers asc nulls last) as place from stg_items) i
left join rated_items r using (item_id)
left join listed_items l using (item_id)
"""

PIECES["user_top_tags"] = """
select user_id, tags from (
  select user_id, tags, row_number() over (partition by user_id order by n desc, tags) as place
  from (select r.user_id, i.tags, count(*) as n
        from stg_ratings r join stg_items i using (item_id)
        where i.tags <> 'Unknown' group by all))
where place = 1
"""

PIECES["user_profiles"] = """
select r.user_id, r.total_ratings, r.avg_rating, r.median_rating, r.stddev_rating, r.min_rating,
  r.max_rating, r.high_rating_ratio, r.low_rating_ratio, r.unique_items_rated,
  l.n as total_list_entries, l.n_completed as completed_count, l.n_watching as watching_count,
  l.n_dropped as dropped_count, l.n_plan as plan_to_watch_count,
  cast(l.n_completed as double) / nullif(l.n, 0) as user_completion_rate,
  cast(l.n_dropped as double) / nullif(l.n, 0) as user_drop_rate,
  l.n_episodes as total_watched_episodes, t.tags as most_watched_tags,
  case when place >= 0.99 then 'Power' when place >= 0.90 then 'Active'
       when place >= 0.50 then 'Regular' else 'Casual' end as user_tier
from (select *, percent_rank() over (order by total_ratings) as place from rated_users) r
left join listed_users l using (user_id)
left join user_top_tags t using (user_id)
"""

PIECES["listed_tags"] = """
select * from (
  select item_id, start_year, community_score, followers, followers_tier, rating_count, avg_rating,
    completion_rate, drop_rate, trim(unnest(string_split(tags, ','))) as tag
  from item_stats where tags <> 'Unknown')
where tag <> ''
"""

PIECES["tag_metrics"] = """
select tag, count(distinct item_id) as item_count,
  avg(community_score) as avg_community_score, avg(avg_rating) as avg_user_rating,
  cast(sum(followers) as bigint) as total_followers, avg(followers) as avg_followers,
  avg(completion_rate) as avg_completion_rate, avg(drop_rate) as avg_drop_rate,
  min(start_year) as earliest_year, max(start_year) as latest_year,
  avg(rating_count) as avg_rating_count, cast(sum(rating_count) as bigint) as total_ratings,
  cast(sum(if(start_year >= 2015, 1, 0)) as double) / count(*) as recent_ratio,
  cast(sum(if(followers_tier in ('Top 1%', 'Top 5%', 'Top 10%'), 1, 0)) as double) / count(*) as popular_ratio
from listed_tags group by tag having count(distinct item_id) >= 10
"""

PIECES["content"] = """
select s.item_id, s.name, s.type, s.tags, s.source_material, s.source_category, s.makers,
  s.start_year, s.season, s.episodes, s.is_digital_native, s.community_score, s.avg_rating,
  s.median_rating, s.stddev_rating, s.high_rating_ratio, s.low_rating_ratio, s.followers,
  s.followers_tier, s.favorites, s.rating_count, s.completion_rate, s.drop_rate, s.plan_rate,
  s.completed_users, s.dropped_users, s.watching_users, t.has_text, t.text_words, s.has_ratings,
  rank() over (order by s.community_score desc nulls last) as score_rank,
  rank() over (order by s.followers desc nulls last) as popularity_rank,
  rank() over (order by s.completion_rate desc nulls last) as completion_rank,
  rank() over (order by s.rating_count desc nulls last) as engagement_rank,
  cast(0.4 as double) * ((s.community_score - 1) / 9)
    + cast(0.3 as double) * coalesce(s.completion_rate, 0)
    + cast(0.2 as double) * (ln(greatest(s.followers, 1)) / ln(2600000))
    + cast(0.1 as double) * (1 - coalesce(s.drop_rate, 0)) as performance_score
from item_stats s left join stg_item_text t using (item_id)
"""

PIECES["users"] = """
select user_id, user_tier, total_ratings, unique_items_rated, total_list_entries,
  total_watched_episodes, avg_rating, stddev_rating, median_rating, high_rating_ratio,
  low_rating_ratio, completed_count, watching_count, dropped_count, plan_to_watch_count,
  user_completion_rate, user_drop_rate, most_watched_tags,
  case when avg_rating >= 8.5 then 'Generous' when avg_rating >= 7 then 'Moderate'
       when avg_rating >= 5.5 then 'Critical' else 'Very Critical' end as rating_tendency,
  case when unique_items_rated >= 9 then 'Explorer'
       when unique_items_rated >= 6 then 'Regular Viewer'
       when unique_items_rated >= 3 then 'Selective' else 'Newcomer' end as viewing_diversity,
  case when user_drop_rate >= 0.3 then 'High Dropper'
       when user_drop_rate >= 0.1 then 'Moderate Dropper'
       else 'Committed Viewer' end as drop_tendency,
  cast(total_ratings as double) / nullif(total_list_entries, 0) as rating_engagement_ratio
from user_profiles
"""

PIECES["tag_years"] = """
select tag, start_year, count(*) as item_count, avg(community_score) as avg_score
from listed_tags where start_year >= 2000 group by tag, start_year
"""

PIECES["tag_windows"] = """
select tag,
  avg(if(start_year between 2015 and 2019, item_count, null)) as recent_avg_count,
  avg(if(start_year between 2015 and 2019, avg_score, null)) as recent_avg_score,
  avg(if(start_year between 2010 and 2014, item_count, null)) as prev_avg_count,
  avg(if(start_year between 2010 and 2014, avg_score, null)) as prev_avg_score
from tag_years group by tag
"""

PIECES["tags"] = """
select *, case when count_growth_rate > 0.3 then 'Growing'
               when count_growth_rate < -0.2 then 'Declining' else 'Stable' end as trend_category
from (
  select tag, item_count, avg_community_score, avg_user_rating, total_followers, avg_followers,
    avg_completion_rate, avg_drop_rate, total_ratings, recent_ratio, popular_ratio,
    recent_avg_count, prev_avg_count,
    case when prev_avg_count > 0
         then (recent_avg_count - prev_avg_count) / prev_avg_count end as count_growth_rate,
    case when prev_avg_score > 0 then recent_avg_score - prev_avg_score end as score_change,
    cast(0.3 as double) * recent_ratio + cast(0.3 as double) * ((avg_community_score - 1) / 9)
      + cast(0.2 as double) * popular_ratio
      + cast(0.2 as double) * avg_completion_rate as tag_health_score
  from tag_metrics left join tag_windows using (tag))
"""


def sql(select: str, *, doubles: str = "") -> str:
    """A statement with the pieces it needs; the columns in ``doubles`` are cut to 6 decimals."""
    body = select.strip()
    if doubles:
        cut = ", ".join(f"round({c}, 6) as {c}" for c in doubles.split())
        body = f"select * replace ({cut}) from ({body})"
    # ties but for the last bits of a mean are taken as ties, as on the Spark side
    body = re.sub(r"round\(((?:avg\()?\w+\)?), (\d)\)", r"round(round(\1, 9), \2)", body)
    needed: list[str] = []

    def visit(text: str) -> None:
        words = set(re.findall(r"[a-z_]+", text))
        for name, piece in PIECES.items():
            if name in words and name not in needed and _reads(text, name):
                visit(piece)
                if name not in needed:
                    needed.append(name)

    visit(body)
    ctes = ",\n".join(f"{name} as ({PIECES[name].strip()})" for name in needed)
    return f"with {ctes}\n{body}" if needed else body


def _reads(text: str, name: str) -> bool:
    return re.search(rf"(?:\bfrom|\bjoin|,)\s+\(?{name}\b", text) is not None
