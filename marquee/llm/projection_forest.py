"""Embedding near-duplicates by a forest of random-projection trees.

Every tree splits the unit vectors by their projection on a random direction, one direction per tree and
level, at the median of the node's projections.  Vectors whose projection lies within a margin of the
cut go to both sides, so that near pairs are seldom parted; the margin is half the standard deviation
of the difference that a pair just at the threshold has on a random direction.  Vectors are compared
within leaves, in double precision, and pairs at or above the threshold are links.

The upper levels of the cuts are fitted on a bounded sample of vectors, all vectors descend them, and
leaves that are still too large are split further in Spark rounds, by quantiles over all their rows.
Splits are judged three levels at a time: where they would leave too large a part of the comparisons to
do, because the vectors lie within the margin of one another, none of the three is made and the cluster
is one leaf, compared whole, in blocks.  So the leaf rows of a vector stay few however large its cluster.
All trees find about the same clusters; vectors that an earlier tree's cluster has compared already meet
only the rest of a later one.  A pair that shares several leaves counts in the first of them alone: each
row carries the earlier leaves that it is in.  A leaf hands on, per vector, its number of links and one
linked partner in the leaf's own components, never the pairs, so results grow with the rows.

Equal vectors are one vector with a count; they link with one another without being compared.

Defined results: vectors that are NULL, empty, zero, or hold NULL or non-finite components link with
nothing (0 links, their own component); rows without vec_id link as others do, but name no component, so
one that reaches no vec_id has none; vectors of different lengths do not link; rows that repeat a vector
are vectors of their own; vectors under one id are one node; an empty table gives no rows; only the two
named columns are read, whatever others are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import components, keep

THRESHOLD = 0.95
TREES = 8
LEAF_ROWS = 512
MOST_LEAF_ROWS = 2048
SAMPLE_ROWS = 16_384
# a sample node is split down to this many rows
LEAST_SAMPLE = 48
# so many levels of splits are made only if no more than this share of the comparisons is left to do
LEVELS = 3
USELESS = 0.45
MARGIN = 0.5

# leaf numbers: the tree, then the path from the root, 1 and a bit per level
TREE_SHIFT = 48
# deeper leaves are compared whole: their path must not run into the tree's bits
DEEPEST = TREE_SHIFT - 2 - LEVELS


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; the largest component is divided out first, so that squares stay finite."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _direction(tree: int, level: int, size: int, seed: int) -> np.ndarray:
    direction = np.random.default_rng((seed, tree, level, size)).normal(size=size)
    return direction / np.linalg.norm(direction)


class Forest:
    """The fitted cuts of the upper levels: leaf number -> value, for vectors of one size."""

    def __init__(self, sample: np.ndarray, total: int, threshold: float, trees: int, leaf_rows: int,
                 seed: int = 11):
        self.size, self.trees, self.seed = sample.shape[1], trees, seed
        self.margin = MARGIN * np.sqrt(2 - 2 * threshold) / np.sqrt(self.size)
        self.cuts: dict[int, float] = {}
        share = total / max(len(sample), 1)
        small = max(LEAST_SAMPLE, leaf_rows / share)
        for tree in range(trees):
            waiting = [(tree << TREE_SHIFT | 1, np.arange(len(sample)))]
            while waiting:
                node, inside = waiting.pop()
                if len(inside) <= small or level(node) > DEEPEST:
                    continue
                cuts, below = self._tried(node, inside, sample, small)
                if sum(len(rows) ** 2 for _, rows in below) <= USELESS * len(inside) ** 2:
                    self.cuts |= cuts
                    waiting += below

    def _tried(self, node: int, inside: np.ndarray, sample: np.ndarray, small: float) -> tuple[dict, list]:
        """Cuts of up to LEVELS levels below a node, and the nodes that they end in with their rows."""
        cuts, below = {}, [(node, inside)]
        for _ in range(LEVELS):
            above, below = below, []
            for upper, rows in above:
                if len(rows) <= small:
                    below.append((upper, rows))
                    continue
                at = sample[rows] @ self.direction(upper)
                cuts[upper] = cut = float(np.median(at))
                below += [(child(upper, 0), rows[at <= cut + self.margin]),
                          (child(upper, 1), rows[at >= cut - self.margin])]
        return cuts, below

    def direction(self, node: int) -> np.ndarray:
        return _direction(node >> TREE_SHIFT, level(node), self.size, self.seed)

    def leaves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs of unit vectors."""
        rows, found = [], []
        for tree in range(self.trees):
            waiting = [(tree << TREE_SHIFT | 1, np.arange(len(vectors)))]
            projected: dict[int, np.ndarray] = {}
            while waiting:
                node, inside = waiting.pop()
                if node not in self.cuts:
                    rows.append(inside)
                    found.append(np.full(len(inside), node, np.int64))
                    continue
                depth = level(node)
                if depth not in projected:
                    projected[depth] = vectors @ self.direction(node)
                at = projected[depth][inside]
                for side, chosen in ((0, at <= self.cuts[node] + self.margin),
                                     (1, at >= self.cuts[node] - self.margin)):
                    if chosen.any():
                        waiting.append((child(node, side), inside[chosen]))
        return np.concatenate(rows), np.concatenate(found)


def level(node: int) -> int:
    return (node & (1 << TREE_SHIFT) - 1).bit_length() - 1


def child(node: int, side: int) -> int:
    mask = (1 << TREE_SHIFT) - 1
    return node & ~mask | (node & mask) << 1 | side


def _usable(vector: str) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _halves(placed: DataFrame, vectors: DataFrame, forest: Forest) -> DataFrame:
    """Rows (rep, leaf, origin) one level deeper, every leaf cut at its median."""
    @F.pandas_udf("double")
    def projection(leaves: pd.Series, arrays: pd.Series) -> pd.Series:
        out = np.zeros(len(leaves))
        rows = unit(np.array(arrays.tolist(), float))
        numbers = leaves.to_numpy()
        for leaf in np.unique(numbers):
            chosen = numbers == leaf
            out[chosen] = rows[chosen] @ forest.direction(int(leaf))
        return pd.Series(out)

    at = keep(
        placed.join(vectors, "rep").select("rep", "leaf", "origin", projection("leaf", "vector").alias("at")),
        "projections",
    )
    cuts = at.groupBy("leaf").agg(F.percentile_approx("at", 0.5, 10_000).alias("cut"))
    sides = F.array_compact(F.array(
        F.when(F.col("at") <= F.col("cut") + forest.margin, F.lit(0)),
        F.when(F.col("at") >= F.col("cut") - forest.margin, F.lit(1)),
    ))
    path = F.lit((1 << TREE_SHIFT) - 1)
    tree = F.col("leaf").bitwiseAND(F.lit(~((1 << TREE_SHIFT) - 1)))
    deeper = tree.bitwiseOR(F.shiftleft(F.col("leaf").bitwiseAND(path), 1)).bitwiseOR(F.col("side"))
    return at.join(cuts, "leaf").select("rep", "leaf", "origin", F.explode(sides).alias("side")).select(
        "rep", deeper.alias("leaf"), "origin"
    )


def _split_large(placed: DataFrame, vectors: DataFrame, forest: Forest, most: int) -> DataFrame:
    """Split leaves of more than ``most`` rows, LEVELS levels at a time, until all are small or clusters."""
    done: DataFrame | None = None

    def finished(rows: DataFrame) -> DataFrame:
        return rows if done is None else done.unionByName(rows)

    while True:
        sizes = placed.groupBy("leaf").agg(F.count("*").alias("rows"))
        large = keep(sizes.filter(F.col("rows") > most), "large-leaves")
        if not large.limit(1).count():
            return finished(placed)
        done = keep(finished(placed.join(large, "leaf", "left_anti")), "leaves")
        start = keep(placed.join(large, "leaf").select("rep", "leaf", F.col("leaf").alias("origin")), "leaves")
        below = start
        for _ in range(LEVELS):
            again = below.groupBy("leaf").agg(F.count("*").alias("rows")).filter(F.col("rows") > most)
            again = keep(again.select("leaf"), "large-leaves")
            cut = _halves(below.join(again, "leaf"), vectors, forest)
            below = keep(below.join(again, "leaf", "left_anti").unionByName(cut), "halves")
        left = below.groupBy("origin", "leaf").agg(F.count("*").cast("double").alias("below"))
        left = left.groupBy("origin").agg(F.sum(F.col("below") * F.col("below")).alias("left"))
        depth = F.length(F.regexp_replace(
            F.bin(F.col("leaf").bitwiseAND(F.lit((1 << TREE_SHIFT) - 1))), "^0+", "")) - 1
        whole = left.join(large.withColumnRenamed("leaf", "origin"), "origin").filter(
            F.col("left") > F.lit(USELESS) * F.col("rows") * F.col("rows")
        ).select("origin")
        deep = large.filter(depth > DEEPEST).select(F.col("leaf").alias("origin"))
        whole = keep(whole.unionByName(deep).distinct(), "clusters")
        done = keep(finished(start.join(whole, "origin", "left_semi").select("rep", "leaf")), "leaves")
        placed = keep(below.join(whole, "origin", "left_anti").select("rep", "leaf"), "leaves")


def _shared(earlier: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Which pairs of the rows are both in some earlier leaf."""
    together = np.zeros((len(rows), len(rows)), bool)
    sizes = [len(earlier[r]) for r in rows]
    if not sum(sizes):
        return together
    owner = np.repeat(np.arange(len(rows)), sizes)
    codes, where, counts = np.unique(
        np.concatenate([earlier[r] for r in rows]), return_inverse=True, return_counts=True
    )
    wanted = np.flatnonzero(counts > 1)
    place = np.full(len(codes), -1)
    place[wanted] = np.arange(len(wanted))
    column = place[where]
    owner, column = owner[column >= 0], column[column >= 0]
    for at in range(0, len(wanted), 512):
        here = (column >= at) & (column < at + 512)
        member = np.zeros((len(rows), 512), np.float32)
        member[owner[here], column[here] - at] = 1
        together |= (member @ member.T) > 0
    return together


def _labels(linked: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches over links."""
    label = np.arange(len(linked))
    around = linked | np.eye(len(linked), dtype=bool)
    while True:
        lower = np.where(around, label[None, :], len(linked)).min(axis=1)
        lower = np.minimum(lower, lower[lower])
        if (lower == label).all():
            return label
        label = lower


def compare_leaf(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(rep, partner, links) of one leaf, or of two blocks of a large one.

    Rows come sorted by rep.  links adds up the counts of linked vectors, over pairs that first meet
    here; partner is the smallest rep that links reach within the group.
    """
    group = group.sort_values("rep")
    reps = group["rep"].to_numpy()
    vectors = unit(np.array(group["vector"].tolist(), float))
    linked = vectors @ vectors.T >= threshold
    np.fill_diagonal(linked, False)
    block = group["block"].to_numpy()
    if group["low"].iloc[0] != group["high"].iloc[0]:  # pairs inside a block belong to that block's own group
        linked &= block[:, None] != block[None, :]
    rows = np.flatnonzero(linked.any(axis=1))
    if not len(rows):
        return pd.DataFrame({"rep": [], "partner": [], "links": []}).astype("int64")
    linked = linked[np.ix_(rows, rows)]
    earlier = [np.asarray(e, np.int64) for e in group["earlier"]]
    counted = linked & ~_shared(earlier, rows)
    copies = group["copies"].to_numpy()[rows]
    return pd.DataFrame({
        "rep": reps[rows], "partner": reps[rows][_labels(linked)],
        "links": counted @ copies.astype(np.int64),
    })


def _links(vectors: DataFrame, size: int, threshold: float, trees: int, leaf_rows: int, most: int,
           sample_rows: int) -> DataFrame:
    """(rep, partner, links) rows of all leaves, for vectors (rep, copies, vector) of one size."""
    total = vectors.count()
    sample = (
        vectors.orderBy(F.xxhash64("vector"), "rep").limit(sample_rows).select("vector").toPandas()
    )
    forest = Forest(unit(np.array(sample["vector"].tolist(), float).reshape(-1, size)), total,
                    threshold, trees, leaf_rows)

    def descend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                rows, leaves = forest.leaves(unit(np.array(batch["vector"].tolist(), float)))
                yield pd.DataFrame({"rep": batch["rep"].to_numpy()[rows], "leaf": leaves})

    placed = keep(vectors.select("rep", "vector").mapInPandas(descend, "rep long, leaf long"), "leaves")
    placed = _split_large(placed, vectors, forest, most)
    sizes = placed.groupBy("leaf").agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)
    of_row = placed.join(sizes.withColumn("large", F.col("rows") > most), "leaf")
    whole = keep(of_row.groupBy("rep").agg(
        F.sort_array(F.collect_set(F.struct("leaf", "large"))).alias("leaves")
    ), "leaves-of-a-vector")
    one = whole.select("rep", "leaves", F.explode("leaves").alias("at")).select(
        "rep", F.col("at.leaf").alias("leaf"), F.col("at.large").alias("large"),
        F.transform(F.filter("leaves", lambda x: x["leaf"] < F.col("at.leaf")), lambda x: x["leaf"])
        .alias("earlier"),
        # the first cluster of an earlier tree that holds the vector
        F.get(F.filter("leaves", lambda x: x["large"] & (
            F.shiftright(x["leaf"], TREE_SHIFT) < F.shiftright(F.col("at.leaf"), TREE_SHIFT))), F.lit(0))["leaf"]
        .alias("home"),
    )
    clusters = one.filter("large")
    homes = clusters.filter("home is not null").groupBy("leaf", "home").agg(F.count("*").alias("rows"))
    homes = homes.filter(F.col("rows") > most)  # smaller ones are compared like rows without a home
    blocked = keep(clusters.join(homes.withColumnRenamed("rows", "known"), ["leaf", "home"], "left").select(
        "rep", "leaf", "earlier", F.when(F.col("known").isNotNull(), F.col("home")).alias("home"),
    ), "clusters")
    parts = blocked.groupBy("leaf", "home").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks"))
    parts = keep(parts.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct(
        F.coalesce("home", F.lit(-1).cast("long")).alias("home"), "blocks"))).alias("parts")), "blocks")
    # blocks are numbered over the parts of a leaf, whose number is bounded by its rows over ``most``
    here = F.coalesce("home", F.lit(-1).cast("long"))
    before = F.aggregate(F.filter("parts", lambda x: x["home"] < here), F.lit(0), lambda a, x: a + x["blocks"])
    own = F.filter("parts", lambda x: x["home"] == here)[0]["blocks"]
    in_all = F.aggregate("parts", F.lit(0), lambda a, x: a + x["blocks"])
    numbered = blocked.join(parts, "leaf").select(
        "rep", "leaf", "earlier", here.alias("home"), before.alias("before"), own.alias("own"),
        in_all.alias("in_all"),
    ).withColumn("block", F.col("before") + F.pmod(F.xxhash64("rep"), F.col("own")).cast("int"))
    # all pairs with a home in common are compared there already
    known = (F.col("home") >= 0) & F.col("other").between(F.col("before"), F.col("before") + F.col("own") - 1)
    met = numbered.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("in_all") - 1))).filter(~known)
    alone = one.filter("not large").select("rep", "leaf", "earlier", F.lit(0).alias("block"),
                                           F.lit(0).alias("low"), F.lit(0).alias("high"))
    work = alone.unionByName(met.select(
        "rep", "leaf", "earlier", "block", F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
    )).join(vectors, "rep")
    return work.groupBy("leaf", "low", "high").applyInPandas(
        lambda group: compare_leaf(group, threshold), "rep long, partner long, links long"
    )


def near_duplicates(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD,
    trees: int = TREES, leaf_rows: int = LEAF_ROWS, most: int = MOST_LEAF_ROWS,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    every = rows.select(F.col(key).alias("vec_id"), F.col(vector).alias("vector")).withColumn(
        "usable", _usable("vector")
    )
    good = every.filter("usable")
    # numbers of vectors are given once, while the table is written
    numbered = keep(
        good.groupBy("vector").agg(F.min("vec_id").alias("name"), F.count("*").alias("copies"))
        .withColumn("rep", F.monotonically_increasing_id()), "vectors"
    )
    vectors = numbered.drop("name")
    sizes = [r[0] for r in vectors.select(F.size("vector")).distinct().collect()]
    found = None
    for size in sorted(sizes):
        part = vectors.filter(F.size("vector") == size)
        part = _links(part, size, threshold, trees, leaf_rows, most, sample_rows)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.select("rep", F.col("rep").alias("partner"), F.col("copies").alias("links"))
    found = keep(found, "leaf-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    edges = found.select(F.col("rep").alias("a"), F.col("partner").alias("b"))
    # vectors that share an id are one node
    several = good.groupBy("vec_id").count().filter("count > 1 and vec_id is not null").select("vec_id")
    shared = good.select("vec_id", "vector").join(several, "vec_id").join(
        numbered.select("vector", "rep"), "vector").select("vec_id", "rep").distinct()
    first = shared.groupBy("vec_id").agg(F.min("rep").alias("b"))
    groups = components(edges.unionByName(
        shared.join(first, "vec_id").select(F.col("rep").alias("a"), "b")
    )).withColumnRenamed("node", "rep")
    placed = keep(
        numbered.join(links, "rep", "left").join(groups, "rep", "left")
        .select("vector", "name", F.coalesce("component", "rep").alias("component"),
                (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "components"
    )
    names = placed.groupBy("component").agg(F.min("name").alias("component_id"))
    of_vector = placed.drop("name").join(names, "component").drop("component")
    linked = good.select("vec_id", "vector").join(of_vector, "vector").select(
        "vec_id", "n_links", "component_id"
    )
    alone = every.filter("not usable").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )
