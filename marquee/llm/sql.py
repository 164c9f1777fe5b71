"""DuckDB SQL of the operators that SQL can express, written apart from the Spark code."""

from __future__ import annotations

_HASH = "('0x' || substr(md5('{name}|' || key), 1, 13))::bigint"


def _draw(name: str, weight: float) -> str:
    return f"-ln(({_HASH.format(name=name)} + 0.5) / 4503599627370496.0) / {weight}"


def _first(children: dict[int, float], name: str) -> str:
    """The child of smallest draw."""
    pairs = ", ".join(
        f"{{'draw': {_draw(f'{name}{child}', weight)}, 'child': {child}}}"
        for child, weight in children.items()
    )
    return f"list_sort([{pairs}])[1].child"


# two regions of two racks of two shards; the ninth shard is a region of weight 1
_RACK = "case region " + " ".join(
    f"when {r} then " + _first({0: 2.0, 1: 2.0}, f"region {r} rack ") for r in (0, 1)) + " end"
_SHARD = "case " + " ".join(
    f"when region = {r} and rack = {k} then "
    + _first({4 * r + 2 * k: 1.0, 4 * r + 2 * k + 1: 1.0}, f"region {r} rack {k} shard ")
    for r in (0, 1) for k in (0, 1)) + " end"

HASH_TREE = f"""
with recursive bytes as (
  select n, 0 as step, n::bigint as c from range(256) r(n)
  union all
  select n, step + 1, if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1) from bytes where step < 8
),
crc_table as (select list(c order by n) as t from bytes where step = 8),
texts as (
  select doc_id, coalesce(cast(doc_id as varchar), 'null') as key, encode(coalesce(text, '')) as text
  from documents
),
summed as (
  select doc_id, key, octet_length(text) + 1 as size,
    xor(list_reduce(
      list_prepend(4294967295::bigint, list_transform(
        regexp_extract_all(hex(text), '..'), lambda x: ('0x' || x)::bigint)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) as text_crc32
  from texts, crc_table
),
regions as (
  select *, {_first({0: 4.0, 1: 4.0}, "region ")} as region,
    {_first({0: 4.0, 1: 4.0, 2: 1.0}, "region ")} as grown_region
  from summed
),
racks as (select *, {_RACK} as rack from regions),
shards as (select *, {_SHARD} as shard from racks)
select doc_id, cast(size as bigint) as size, cast(text_crc32 as bigint) as text_crc32, 'key' as law,
  cast(region as integer) as region, cast(rack as integer) as rack, cast(shard as integer) as shard,
  cast(if(grown_region = 2, 8, shard) as integer) as grown_shard,
  row_number() over (partition by shard order by md5(concat_ws('|', key, size, text_crc32, 'key', region,
    rack, shard, if(grown_region = 2, 8, shard)))) - 1 as slot
from shards
"""

NEAR_VECTORS = """
with recursive vectors as (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v,
    coalesce(vec_id is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0, false) as usable
  from embeddings
),
links as (
  select a.vec_id as a, b.vec_id as b from vectors a join vectors b
    on a.usable and b.usable and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.95
),
reached as (
  select vec_id as node, vec_id as root from vectors where usable
  union
  select b, root from reached join links on a = node
),
roots as (select node, min(root) as root from reached group by node),
degrees as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0) as n_links, coalesce(root, vec_id) as component_id,
  coalesce(vec_id = coalesce(root, vec_id), false) as kept
from vectors left join roots on node = vec_id left join degrees on a = vec_id
"""

ALL = {"op1_projection_forest": NEAR_VECTORS, "op6_hash_tree": HASH_TREE}
