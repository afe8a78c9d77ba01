"""Hierarchical clustering of all groups at once: average, single, complete or weighted linkage.

Groups of up to ``LOCAL_ITEMS`` items are clustered whole, one task each: their
distance matrix has a bounded size. Larger groups are clustered by Spark in rounds
that merge every pair of clusters which are nearest neighbours of each other. Both take
equal distances in the order of the clusters' numbers and compute heights from the same
whole-number sums, so they give the same tree. Larger groups under single linkage take a minimum
spanning tree over distance blocks, which gives the same clusters at every height.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .blocks import BLOCK, from_blocks, row_vectors, unfold, with_ends

LOCAL_ITEMS = 2048
UNIT = 2.0**40
METHODS = ("average", "single", "complete", "weighted")

# The cut heights tried when none is given.
CUT_HEIGHTS = tuple(float(h) for h in np.linspace(0.1, 0.99, 35))

_MERGE = "g {g}, into int, gone int, height double, size int"


def distance_units(d: Column) -> Column:
    """A distance in whole units of 2 ** -40, so that sums do not depend on their order."""
    return F.round(d * F.lit(UNIT)).cast("long")


def average_linkage(distance: np.ndarray) -> np.ndarray:
    return linkage(distance, "average")


def linkage(distance: np.ndarray, method: str) -> np.ndarray:
    """Merges ``(into, gone, height, size)`` of a full distance matrix, in whole units. The pair at the smallest
    distance merges, of equal ones the first by its two numbers; a cluster keeps the smaller number.
    The distance of a merged cluster is the mean over all item pairs, the smallest, the largest, or
    the mean of its two parts' distances. Every row knows its nearest later cluster, so that a
    merge only looks again at rows that pointed to either of its two."""
    check_method(method)
    n = len(distance)
    value = np.rint(np.asarray(distance, float) * UNIT)
    if method != "weighted":
        value = value.astype(np.int64)
    update = {"average": np.add, "single": np.minimum, "complete": np.maximum, "weighted": lambda x, y: (x + y) / 2}[method]
    size, count = np.ones(n, np.int64), np.ones(n, np.int64)  # count: items that a mean runs over
    alive = np.ones(n, bool)
    merges = np.empty((max(n - 1, 0), 4))
    near, gap = np.zeros(n, np.int64), np.full(n, np.inf)

    def look(a: int) -> None:
        later = np.flatnonzero(alive[a + 1 :]) + a + 1
        gap[a] = np.inf
        if len(later):
            d = heights(value[a, later], count[a] * count[later])
            k = int(d.argmin())
            near[a], gap[a] = later[k], d[k]

    for a in range(n - 1):
        look(a)
    for step in range(n - 1):
        into = int(gap.argmin())
        gone, height = int(near[into]), gap[into]
        value[into] = update(value[into], value[gone])
        value[:, into] = value[into]
        size[into] += size[gone]
        if method == "average":
            count[into] = size[into]
        alive[gone], gap[gone] = False, np.inf
        merges[step] = into, gone, height, size[into]
        before = np.flatnonzero(alive[:gone])
        for a in before[(near[before] == into) | (near[before] == gone)].tolist():
            look(a)
        look(into)
        # an earlier cluster may now be nearer to the merged one than to its own nearest
        before = before[(before < into) & (near[before] != into)]
        d = heights(value[before, into], count[before] * count[into])
        closer = (d < gap[before]) | ((d == gap[before]) & (into < near[before]))
        gap[before[closer]], near[before[closer]] = d[closer], into
    return merges


def check_method(method: str) -> None:
    if method not in METHODS:
        raise ValueError(f"unknown linkage {method!r}")


def heights(total: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Mean distances from sums in whole units."""
    return total / pairs.astype(float) / UNIT


def cut_labels(merges: np.ndarray, n: int, height: float) -> np.ndarray:
    """Smallest member of the cluster of each item when merges up to ``height`` apply."""
    owner = np.arange(n)
    for into, gone in merges[merges[:, 2] <= height, :2].astype(int):
        owner[gone] = into
    # follow the absorbing clusters; each is a smaller number, so an ascending pass settles all
    for i in range(n):
        owner[i] = owner[owner[i]]
    return owner


def flat_clusters(
    distance: np.ndarray, min_size: int, cut: float | None, heights: Sequence[float] = CUT_HEIGHTS, method: str = "average"
) -> np.ndarray:
    """Labels of a full distance matrix at ``cut``, or at the first of ``heights`` that has
    the most clusters of ``min_size`` items."""
    return flat_labels(linkage(distance, method), len(distance), min_size, cut, heights)


def flat_labels(merges: np.ndarray, n: int, min_size: int, cut: float | None, heights: Sequence[float] = CUT_HEIGHTS) -> np.ndarray:
    """The labels that a tree gives at ``cut``, or at the height that ``flat_clusters`` chooses."""

    def usable(height: float) -> int:
        return int(np.sum(np.bincount(cut_labels(merges, n, height)) >= max(min_size, 1)))

    if cut is None:
        cut = max(heights, key=usable)
    return cut_labels(merges, n, cut)


def _clusters_local(pairs: DataFrame, min_size: int, cut: float | None, method: str) -> DataFrame:
    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        items = np.unique(np.concatenate([pdf["a"].to_numpy(), pdf["b"].to_numpy()]))
        a, b = np.searchsorted(items, pdf["a"]), np.searchsorted(items, pdf["b"])
        full = np.zeros((len(items), len(items)))
        full[a, b] = full[b, a] = pdf["s"].to_numpy() / UNIT
        labels = flat_clusters(full, min_size, cut, method=method)
        return pd.DataFrame({"g": pdf["g"].iloc[0], "r": items, "cluster": items[labels]})

    return pairs.groupBy("g").applyInPandas(cluster, f"g {pairs.schema['g'].dataType.simpleString()}, r int, cluster int")


def clusters(
    pairs: DataFrame, items: DataFrame, min_size: int, cut: float | None = None, local_items: int = LOCAL_ITEMS, method: str = "average"
) -> DataFrame:
    """``g, r, cluster`` for the items ``g, r`` of all groups; a cluster is named by its
    smallest item. ``pairs`` holds ``g, a, b, d`` for all a < b. Without a ``cut`` each
    group takes the grid height with the most clusters of ``min_size`` items."""
    check_method(method)
    pairs = pairs.select("g", "a", "b", distance_units(F.col("d")).alias("s"))
    return _by_size(
        items,
        local_items,
        lambda small: _clusters_local(pairs if small is None else pairs.join(small, "g", "left_semi"), min_size, cut, method),
        lambda small: _clusters_in_rounds(pairs.join(small, "g", "left_anti"), items.join(small, "g", "left_anti"), min_size, cut, method),
    )


def block_clusters(
    distance: DataFrame, items: DataFrame, min_size: int, cut: float | None = None, local_items: int = LOCAL_ITEMS, method: str = "average"
) -> DataFrame:
    """The same from distance blocks; features that are left out there take no part. Groups of up to
    ``local_items`` come whole into a task, as blocks. Larger ones never leave the blocks under single
    linkage; the other methods unfold their pairs."""
    check_method(method)

    def large(small: DataFrame) -> DataFrame:
        rest, members = distance.join(small, "g", "left_anti"), items.join(small, "g", "left_anti")
        if method == "single":
            return _tree_labels(spanning_tree(rest, members), members, min_size, cut)
        pairs = unfold(rest, "d").select("g", "a", "b", distance_units(F.col("d")).alias("s"))
        return _clusters_in_rounds(pairs, members, min_size, cut, method)

    return _by_size(
        items,
        local_items,
        lambda small: _blocks_local(distance if small is None else distance.join(small, "g", "left_semi"), min_size, cut, method),
        large,
    )


def _by_size(items: DataFrame, local_items: int, near: Callable, far: Callable) -> DataFrame:
    """Clusters of the groups by either way; an item that neither names is a cluster."""
    sizes = materialise(items.groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    if (sizes.agg(F.max("n")).first()[0] or 0) <= local_items:
        found = near(None)
    else:
        small = sizes.where(F.col("n") <= local_items).select("g")
        found = near(small).unionByName(far(small))
    return items.select("g", "r").join(found, ["g", "r"], "left").select(
        "g", "r", F.coalesce("cluster", "r").alias("cluster")
    )


def _blocks_local(distance: DataFrame, min_size: int, cut: float | None, method: str) -> DataFrame:
    block = BLOCK

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        nf = int(pdf["nf"].iloc[0])
        full = np.empty((nf, nf))
        for p, q, raw in zip(pdf["p"], pdf["q"], pdf["mat"]):
            at = slice(p * block, min((p + 1) * block, nf)), slice(q * block, min((q + 1) * block, nf))
            full[at] = np.frombuffer(raw).reshape(full[at].shape)
            full[at[1], at[0]] = full[at].T
        items = np.flatnonzero(~np.isnan(full.diagonal()))
        labels = flat_clusters(full[np.ix_(items, items)], min_size, cut, method=method)
        return pd.DataFrame({"g": pdf["g"].iloc[0], "r": items.astype(np.int32), "cluster": items[labels].astype(np.int32)})

    kind = distance.schema["g"].dataType.simpleString()
    return distance.groupBy("g").applyInPandas(cluster, f"g {kind}, r int, cluster int")


def _clusters_in_rounds(pairs: DataFrame, items: DataFrame, min_size: int, cut: float | None, method: str) -> DataFrame:
    merges = materialise(_merge_rounds(pairs, method))
    at = best_cut(merges, min_size) if cut is None else items.select("g", F.lit(float(cut)).alias("cut")).distinct()
    return cut_tree(merges, items.select("g", "r"), at)


def spanning_tree(distance: DataFrame, items: DataFrame) -> DataFrame:
    """``g, a, b, s``: the minimum spanning tree of each group, over distance blocks; of equal distances, in
    whole units, the pair of smaller numbers comes first. In each round every component takes
    its shortest way out (Boruvka), so the number of components falls by half at least. A round reads the
    blocks once; what leaves them is an edge for each component that a block meets."""
    kind = distance.schema["g"].dataType.simpleString()

    def ways_out(m, row, rows, columns):
        p, q = (np.full(n, np.nan) if row[f"c_{end}"] is None else np.frombuffer(row[f"c_{end}"])[:n] for end, n in zip("pq", m.shape))
        closed = np.isnan(m) | (p[:, None] == q[None, :])
        if row["p"] == row["q"]:
            closed |= rows[:, None] >= columns[None, :]
        s = np.where(closed, np.inf, np.rint(m * UNIT))
        for owner, axis in ((p, 1), (q, 0)):
            best, other = s.min(axis=axis), s.argmin(axis=axis)
            at = np.flatnonzero(np.isfinite(best))
            a, b = (rows[at], columns[other[at]]) if axis else (rows[other[at]], columns[at])
            order = np.lexsort((b, a, best[at], owner[at]))
            first = order[np.unique(owner[at][order], return_index=True)[1]]
            if len(first):
                yield {"c": owner[at][first].astype(np.int32), "s": best[at][first].astype(np.int64), "a": a[first].astype(np.int32), "b": b[first].astype(np.int32)}

    def join_up(labels: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        at = {int(r): int(c) for r, c in zip(labels["r"], labels["c"])}
        owner = {c: c for c in at.values()}

        def find(c: int) -> int:
            while owner[c] != c:
                owner[c] = c = owner[owner[c]]
            return c

        for a, b in zip(edges["a"], edges["b"]):
            low, high = sorted((find(at[int(a)]), find(at[int(b)])))
            owner[high] = low
        return labels.assign(c=[find(int(c)) for c in labels["c"]])

    labels = materialise(items.select("g", "r", F.col("r").cast("int").alias("c")))
    tree: list[DataFrame] = []
    while True:
        ways = from_blocks(with_ends(distance, row_vectors(labels, ["c"])), ways_out, "c int, s bigint, a int, b int")
        best = ways.groupBy("g", "c").agg(F.min(F.struct("s", "a", "b")).alias("e"))
        found = materialise(best.select("g", "e.a", "e.b", "e.s").distinct())
        tree.append(found)
        if found.isEmpty():
            return materialise(_union(tree))
        joined = labels.groupBy("g").cogroup(found.groupBy("g")).applyInPandas(join_up, f"g {kind}, r int, c int")
        labels = materialise(joined)


def _tree_labels(tree: DataFrame, items: DataFrame, min_size: int, cut: float | None) -> DataFrame:
    """Clusters of single linkage from the edges of the tree: one row an item in a task of the group."""

    def label(edges: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        r = np.sort(members["r"].to_numpy())
        edges = edges.sort_values(["s", "a", "b"])
        owner, size, merges = np.arange(len(r)), np.ones(len(r), np.int64), []

        def find(i: int) -> int:
            while owner[i] != i:
                owner[i] = i = owner[owner[i]]
            return i

        for a, b, s in zip(np.searchsorted(r, edges["a"]), np.searchsorted(r, edges["b"]), edges["s"]):
            into, gone = sorted((find(a), find(b)))
            owner[gone] = into
            size[into] += size[gone]
            merges.append((into, gone, s / UNIT, size[into]))
        labels = flat_labels(np.array(merges, float).reshape(-1, 4), len(r), min_size, cut)
        return pd.DataFrame({"g": members["g"].iloc[0], "r": r.astype(np.int32), "cluster": r[labels].astype(np.int32)})

    kind = items.schema["g"].dataType.simpleString()
    members = items.select("g", "r")
    return tree.groupBy("g").cogroup(members.groupBy("g")).applyInPandas(
        lambda edges, rows: label(edges, rows) if len(rows) else pd.DataFrame({"g": [], "r": [], "cluster": []}), f"g {kind}, r int, cluster int"
    )


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _merge_rounds(pairs: DataFrame, method: str = "average") -> DataFrame:
    """The same merges by rounds of mutual nearest neighbours, in the same order of distance
    and numbers; ``s`` sums item distances in whole units, or is what another method makes of them.
    All methods here never bring a merged cluster nearer than its parts were, which the rounds rest on."""
    mean = method == "average"
    if method == "weighted":
        pairs = pairs.withColumn("s", F.col("s").cast("double"))
    update = {"average": F.sum, "single": F.min, "complete": F.max, "weighted": F.avg}[method]("s").alias("s")
    open_pairs = materialise(pairs.select("g", "a", "b", "s", F.lit(1).alias("na"), F.lit(1).alias("nb")))
    rounds: list[DataFrame] = []
    while not open_pairs.isEmpty():
        edges = open_pairs.select(
            "g",
            F.struct((F.col("s") / (F.col("na") * F.col("nb").cast("double") if mean else F.lit(1.0)) / UNIT).alias("d"), "a", "b", "na", "nb").alias("e"),
        )
        ends = edges.select("g", F.explode(F.array("e.a", "e.b")).alias("c"), "e")
        nearest = ends.groupBy("g", "c").agg(F.min("e").alias("e"))
        mutual = nearest.groupBy("g", "e").count().where(F.col("count") == 2)
        found = materialise(
            mutual.select(
                "g",
                F.col("e.a").alias("into"),
                F.col("e.b").alias("gone"),
                F.col("e.d").alias("height"),
                (F.col("e.na") + F.col("e.nb")).alias("size"),
            )
        )
        rounds.append(found)
        if len(rounds) > 20:  # keep the final union short
            rounds = [materialise(_union(rounds))]
        # each cluster under its new number and size
        moved = found.select("g", "size", F.col("into").alias("to"), F.explode(F.array("into", "gone")).alias("c"))
        renamed = open_pairs
        for end in ("a", "b"):
            side = moved.select("g", F.col("c").alias(end), F.col("to").alias(f"_{end}"), F.col("size").alias(f"_n{end}"))
            renamed = renamed.join(side, ["g", end], "left")
        a, b = F.coalesce("_a", "a"), F.coalesce("_b", "b")
        na, nb = F.coalesce("_na", "na"), F.coalesce("_nb", "nb")
        swapped = renamed.select(
            "g",
            F.least(a, b).alias("a"),
            F.greatest(a, b).alias("b"),
            "s",
            F.when(a <= b, na).otherwise(nb).alias("na"),
            F.when(a <= b, nb).otherwise(na).alias("nb"),
        )
        open_pairs = materialise(
            swapped.where(F.col("a") != F.col("b"))
            .groupBy("g", "a", "b")
            .agg(update, F.first("na").alias("na"), F.first("nb").alias("nb"))
        )
    if not rounds:
        return pairs.sparkSession.createDataFrame([], _MERGE.format(g=pairs.schema["g"].dataType.simpleString()))
    return _union(rounds)


def best_cut(merges: DataFrame, min_size: int, heights: Sequence[float] = CUT_HEIGHTS) -> DataFrame:
    """``g, cut``: the first height with the most clusters of at least ``min_size`` items.

    A cluster exists from its merge until the next merge of its number, or until it is
    absorbed; the clusters of a height are those whose span covers it."""
    if min_size <= 1:  # every item counts, so the lowest height has the most
        return merges.select("g").distinct().select("g", F.lit(float(heights[0])).alias("cut"))
    events = merges.select("g", F.col("into").alias("c"), "height", "size")
    starts = Window.partitionBy("g", "c").orderBy("height", "size")
    absorbed = merges.select("g", F.col("gone").alias("c"), F.col("height").alias("_absorbed"))
    spans = (
        events.withColumn("_next", F.lead("height").over(starts))
        .where(F.col("size") >= min_size)
        .join(absorbed, ["g", "c"], "left")
        .withColumn("until", F.coalesce("_next", "_absorbed", F.lit(float("inf"))))
    )
    grid = F.array(*[F.lit(h) for h in heights])
    hits = (
        spans.select("g", F.explode(F.filter(grid, lambda h: (h >= F.col("height")) & (h < F.col("until")))).alias("h"))
        .groupBy("g", "h")
        .count()
        .groupBy("g")
        .agg(F.max(F.struct("count", (-F.col("h")).alias("_h"))).alias("_best"))
        .select("g", (-F.col("_best._h")).alias("_cut"))
    )
    groups = merges.select("g").distinct()
    return groups.join(hits, "g", "left").select("g", F.coalesce("_cut", F.lit(float(heights[0]))).alias("cut"))


def cut_tree(merges: DataFrame, items: DataFrame, cut: DataFrame) -> DataFrame:
    """``g, r, cluster`` for the items ``g, r``: the smallest item number of the cluster
    at the height ``g, cut``. Pointers to the absorbing cluster are doubled until stable."""
    low = merges.join(cut, "g").where(F.col("height") <= F.col("cut"))
    points = materialise(
        items.join(low.select("g", F.col("gone").alias("r"), "into"), ["g", "r"], "left").select(
            "g", "r", F.coalesce("into", "r").alias("cluster")
        )
    )
    while True:
        ahead = points.select("g", F.col("r").alias("cluster"), F.col("cluster").alias("_next"))
        jumped = materialise(
            points.join(ahead, ["g", "cluster"]).select(
                "g", "r", F.col("_next").alias("cluster"), (F.col("_next") != F.col("cluster")).alias("_moved")
            )
        )
        points = jumped.drop("_moved")
        if jumped.where("_moved").isEmpty():
            return points


def number_clusters(labels: DataFrame, min_size: int) -> DataFrame:
    """``g, r, module``: clusters of at least ``min_size`` items numbered from 1 in the
    order of their first item; the rest is module 0."""
    sizes = labels.groupBy("g", "cluster").count().where(F.col("count") >= min_size)
    numbered = sizes.select(
        "g", "cluster", F.row_number().over(Window.partitionBy("g").orderBy("cluster")).alias("_module")
    )
    return labels.join(numbered, ["g", "cluster"], "left").select(
        "g", "r", F.coalesce("_module", F.lit(0)).alias("module")
    )
