"""DuckDB SQL for data tests, metrics, the dictionary and the comparison of results."""

from __future__ import annotations

from oracle.dictionary import TABLES as DICTIONARY
from oracle.tables import PIECES


def _check(table: str, column: str, check: str, failing: str) -> str:
    return (f"select '{table}' as table_name, '{column}' as column_name, '{check}' as check_name, "
            f"n as failing_rows, n = 0 as passed from (select count(*) as n from {failing})")


_UNIQUE = [_check(t, c, "unique", f"(select {c} from {t} where {c} is not null group by {c} "
                                  "having count(*) > 1)")
           for t, c in (("stg_items", "item_id"), ("stg_item_text", "item_id"),
                        ("item_stats", "item_id"), ("user_profiles", "user_id"),
                        ("tag_metrics", "tag"), ("content", "item_id"), ("users", "user_id"),
                        ("tags", "tag"))]
_NOT_NULL = [_check(t, c, "not_null", f"{t} where {c} is null")
             for t, c in (("stg_items", "item_id"), ("stg_items", "name"),
                          ("stg_ratings", "user_id"), ("stg_ratings", "item_id"),
                          ("stg_ratings", "rating"), ("stg_list_entries", "user_id"),
                          ("stg_list_entries", "item_id"), ("stg_item_text", "item_id"),
                          ("item_stats", "item_id"), ("user_profiles", "user_id"),
                          ("tag_metrics", "tag"), ("content", "item_id"), ("users", "user_id"),
                          ("tags", "tag"))]
_ACCEPTED = [
    _check("stg_items", "type", "accepted_values", "stg_items where type not in "
           "('TV', 'OVA', 'Movie', 'Special', 'ONA', 'Music', 'Unknown')"),
    _check("stg_list_entries", "status", "accepted_values", "stg_list_entries where status not in "
           "('Watching', 'Completed', 'On Hold', 'Dropped', 'Plan to Watch', 'Unknown')"),
]
_ORPHANS = [_check(t, c, "relationships",
                   f"{t} where {c} is not null and {c} not in (select {c} from {p})")
            for t, p, c in (("item_stats", "stg_items", "item_id"),
                            ("content", "item_stats", "item_id"),
                            ("users", "user_profiles", "user_id"),
                            ("tags", "tag_metrics", "tag"))]
_RANGES = ("select 'content' as table_name, 'rates and scores' as column_name, "
           "'valid_ranges' as check_name, n as failing_rows, n = 0 as passed from ("
           "select cast(sum(if(completion_rate not between 0 and 1, 1, 0) "
           "+ if(drop_rate not between 0 and 1, 1, 0) "
           "+ if(performance_score not between 0 and 1, 1, 0) "
           "+ if(community_score not between 1 and 10, 1, 0)) as bigint) as n from content)")
_CROSS = _check("item_stats", "rating_count", "at_most_total_list_count",
                "item_stats where rating_count > total_list_count")

CHECKS: dict[str, tuple[str, str]] = {
    "quality_unique": (" union all ".join(_UNIQUE), ""),
    "quality_not_null": (" union all ".join(_NOT_NULL), ""),
    "quality_accepted": (" union all ".join(_ACCEPTED), ""),
    "quality_orphans": (" union all ".join(_ORPHANS), ""),
    "quality_ranges": (_RANGES, ""),
    "quality_cross_column": (_CROSS, ""),
    "quality_all": (" union all ".join(
        _UNIQUE + _NOT_NULL + _ACCEPTED + _ORPHANS + [_RANGES, _CROSS]), ""),
}

METRICS: dict[str, tuple[str, str]] = {
    f"metric_{name}": (f"select {by}, {value} as {name} from {source} group by {by}", name)
    for name, value, source, by in (
        ("avg_score", "avg(community_score)", "content", "type"),
        ("completion_rate", "avg(if(status = 'Completed', 1.0, 0.0))", "stg_list_entries",
         "item_id"),
        ("drop_rate", "avg(if(status = 'Dropped', 1.0, 0.0))", "stg_list_entries", "item_id"),
        ("performance_score", "avg(performance_score)", "content", "source_category"),
        ("high_rating_ratio", "avg(if(rating >= 8, 1.0, 0.0))", "stg_ratings", "item_id"),
        ("low_rating_ratio", "avg(if(rating <= 4, 1.0, 0.0))", "stg_ratings", "item_id"),
        ("total_ratings", "count(*)", "stg_ratings", "user_id"),
        ("user_avg_rating", "avg(rating)", "stg_ratings", "user_id"),
        ("user_completion_rate", "avg(if(status = 'Completed', 1.0, 0.0))", "stg_list_entries",
         "user_id"),
        ("rating_engagement_ratio",
         "cast(sum(total_ratings) as double) / sum(total_list_entries)", "users", "user_tier"),
        ("tag_item_count", "count(distinct item_id)", "listed_tags", "tag"),
        ("tag_health_score",
         "cast(0.3 as double) * avg(if(start_year >= 2015, 1.0, 0.0)) "
         "+ cast(0.3 as double) * ((avg(community_score) - 1) / 9) "
         "+ cast(0.2 as double) * avg(if(followers_tier in ('Top 1%', 'Top 5%', 'Top 10%'), 1.0, 0.0)) "
         "+ cast(0.2 as double) * avg(completion_rate)", "listed_tags", "tag"),
    )
}
METRICS["metric_total_ratings"] = (METRICS["metric_total_ratings"][0], "")
METRICS["metric_tag_item_count"] = (METRICS["metric_tag_item_count"][0], "")
METRICS["metric_count_growth_rate"] = ("""select tag,
      case when prev_avg_count > 0
           then (recent_avg_count - prev_avg_count) / prev_avg_count end as count_growth_rate
    from tag_windows""", "count_growth_rate")


def _dictionary() -> str:
    parts = []
    for table, entries in DICTIONARY.items():
        for column, (kind, meaning, values) in entries.items():
            odd = "0"
            if values:
                listed = ", ".join(f"'{v}'" for v in values)
                odd = f"count(*) filter (where {column} not in ({listed}))"
            parts.append(
                f"select '{table}' as table_name, '{column}' as column_name, "
                f"'{kind}' as column_type, true as as_declared, "
                f"'{meaning.replace(chr(39), chr(39) * 2)}' as meaning, "
                f"'{', '.join(values)}' as allowed, count(*) as row_count, "
                f"count(*) - count({column}) as null_count, cast({odd} as bigint) "
                f"as unlisted_count from {table}"
            )
    return " union all ".join(parts)


PIECES["answers"] = """
select o_orderkey % 40 as q, o_orderkey // 40 as row_no, o_custkey as customer,
  o_orderpriority as priority, o_orderstatus as status, o_totalprice as total from orders
"""
PIECES["given"] = """
select 'plain' as mode, q, if(q % 7 = 3, row_no + 1 - 2 * (row_no % 2), row_no) as row_no,
  if(q % 8 = 5, customer + 1, customer) as customer, if(q % 6 = 2, null, priority) as priority,
  status, if(q % 4 = 0, total * cast(1.2 as double), total * cast(1.01 as double)) as total,
  q % 6 <> 2 as has_priority
from answers where not (q % 5 = 1 and row_no % 3 = 2)
union all
select 'guided', q, row_no, customer, priority, status,
  if(q % 8 = 0, total * cast(1.2 as double), total), true
from answers where not (q % 10 = 1 and row_no % 3 = 2)
"""
PIECES["shapes"] = """
select mode, q, max(given_rows) = max(rows) as row_match, bool_and(has_priority) as col_match,
  max(given_rows) = max(rows) and bool_and(has_priority) as structure_match,
  cast(if(bool_and(has_priority), 4, 3) as bigint) as common_columns
from (select mode, q, count(*) as given_rows, bool_and(has_priority) as has_priority
      from given group by mode, q)
join (select q, count(*) as rows from answers group by q) using (q)
group by mode, q
"""
PIECES["first_rows"] = """
select g.mode, g.q, (if(g.customer = a.customer, 1, 0) + if(g.status = a.status, 1, 0)
    + if(g.has_priority and g.priority = a.priority, 1, 0)
    + if(abs(a.total - g.total) < abs(a.total) * cast(0.05 as double), 1, 0))
    >= if(g.has_priority, 4, 3) * 0.5 as first_row_match
from given g join answers a using (q, row_no) where row_no = 0
"""
PIECES["paired"] = """
select g.mode, g.q, (if(g.customer = e.customer, 1, 0) + if(g.status = e.status, 1, 0)
    + if(g.has_priority and g.priority = e.priority, 1, 0)
    + if(if(e.total = 0, g.total = 0, abs(e.total - g.total) < abs(e.total) * cast(0.05 as double)),
         1, 0)) >= if(g.has_priority, 4, 3) * 0.5 as agrees
from (select mode, q, has_priority, customer, priority, status, round(total, 2) as total,
        row_number() over (partition by mode, q order by customer, priority, status,
          round(total, 2), row_no) as place
      from given) g
join (select mode, q, s.has_priority, customer, priority, status, round(total, 2) as total,
        row_number() over (partition by mode, q order by customer,
          if(s.has_priority, priority, null), status, round(total, 2), row_no) as place
      from answers join (select mode, q, bool_and(has_priority) as has_priority from given
                         group by mode, q) s using (q)) e
  using (mode, q, place)
where (mode, q) in (select mode, q from shapes where row_match)
"""
PIECES["agreement"] = """
select mode, q, count(*) as rows_compared, count(*) filter (where agrees) as rows_agreeing,
  avg(if(agrees, 1, 0)) >= 0.5 as result_match from paired group by mode, q
"""
PIECES["attempt_log"] = """
select if((o_orderkey // 40) % 2 = 0, 'plain', 'guided') as mode, o_orderkey % 40 as q,
  case (o_orderkey % 40) % 3 when 0 then 'easy' when 1 then 'medium' else 'hard' end as difficulty,
  ['content', 'users', 'tags', 'trends', 'comparison'][(o_orderkey % 40) % 5 + 1] as category,
  case o_orderkey % 17 when 0 then 'Parser Error: syntax error at or near "' || o_orderpriority || '"'
    when 1 then 'Catalog Error: Table with that name not found' when 2 then 'no such column: total'
    when 3 then 'Cannot JOIN on a missing key' when 4 then 'Conversion Error: could not CAST the value'
    when 5 then 'Binder Error: ambiguous reference' when 6 then 'Out of time'
    when 7 then 'Binder Error: column of that type not found' end as message,
  ['syntax_error', 'wrong_table', 'wrong_column', 'wrong_join', 'type_error', 'binder_error',
   'other_error', 'wrong_column'][o_orderkey % 17 + 1] as error_type
from orders
"""
PIECES["outcome_log"] = """
select l.mode, l.difficulty, l.category, l.error_type, l.message is null as success,
  l.message is null and s.structure_match as structure_match,
  l.message is null and coalesce(a.result_match, false) as result_match
from attempt_log l left join shapes s using (mode, q) left join agreement a using (mode, q)
"""

_QUERY = "'Q' || lpad(cast(q as varchar), 2, '0') as query_id"
_COUNTS = """count(*) as total, count(*) filter (where success) as execution_success,
      count(*) filter (where structure_match) as structure_match,
      count(*) filter (where result_match) as result_match"""
_MEASURES = (("execution_success", "success"), ("structure_match", "structure_match"),
             ("result_match", "result_match"))


def _rate(flag: str, mode: str) -> str:
    return f"round(avg(if({flag}, 1, 0)) filter (where mode = '{mode}') * 10000) / 10000"


COMPARISONS: dict[str, tuple[str, str]] = {
    "compare_structure": (
        f"select mode, {_QUERY}, row_match, col_match, structure_match, "
        "common_columns from shapes", ""),
    "compare_first_row": (f"select mode, {_QUERY}, first_row_match from first_rows", ""),
    "compare_result": (
        f"select mode, {_QUERY}, rows_compared, rows_agreeing, result_match from agreement", ""),
    "compare_verdicts": (f"""select mode, {_QUERY}, row_match, col_match, structure_match,
          coalesce(first_row_match, false) as first_row_match,
          coalesce(result_match, false) as result_match, common_columns
        from shapes left join first_rows using (mode, q) left join agreement using (mode, q)""", ""),
    # 0: both empty, 1: nothing expected, 2: nothing returned, 3: failed
    "compare_few_rows": (f"""select mode, {_QUERY}, q % 4 = 0 as row_match, q % 4 <> 3 as col_match,
          q % 4 = 0 as structure_match, false as first_row_match, false as result_match,
          cast(if(q % 4 = 3, 0, 4) as bigint) as common_columns
        from (select distinct mode, q from given)""", ""),
    "error_labels": ("""select message, error_type, count(*) as attempt_count
        from attempt_log group by message, error_type""", ""),
    "rates_by_mode": (f"""select mode, {_COUNTS},
          avg(if(success, 1, 0)) as execution_success_rate,
          avg(if(structure_match, 1, 0)) as structure_match_rate,
          avg(if(result_match, 1, 0)) as result_match_rate
        from outcome_log group by mode""", ""),
    "rates_by_level": (f"""select mode, 'difficulty' as level, difficulty as value, {_COUNTS}
        from outcome_log group by mode, difficulty
        union all
        select mode, 'category', category, {_COUNTS} from outcome_log group by mode, category""", ""),
    "error_counts": ("""select mode, error_type, count(*) as attempt_count from outcome_log
        where not success group by mode, error_type""", ""),
    "mode_difference": (" union all ".join(
        f"""select '{name}_rate' as measure, {_rate(flag, 'plain')} as base_rate,
          {_rate(flag, 'guided')} as other_rate,
          {_rate(flag, 'guided')} - {_rate(flag, 'plain')} as change from outcome_log"""
        for name, flag in _MEASURES), "change"),
}
COMPARISONS["rates_by_mode"] = (
    "select * replace (round(execution_success_rate, 4) as execution_success_rate, "
    "round(structure_match_rate, 4) as structure_match_rate, "
    f"round(result_match_rate, 4) as result_match_rate) from ({COMPARISONS['rates_by_mode'][0]})",
    "")

CHECKS["dictionary_content"] = (_dictionary(), "")
