"""Co-expression networks: adjacency, scale-free fit, topological overlap, modules."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .blocks import ends, from_blocks, map_blocks, row_sums, row_vectors, self_product, unfold, with_ends
from .clustering import LOCAL_ITEMS, block_clusters, clusters, number_clusters
from .correlation import FeatureMatrix

_EPS = 2.220446049250313e-16


def _strength(r: np.ndarray, signed: bool) -> np.ndarray:
    return (1 + r) / 2 if signed else np.abs(r)


def _own(m: np.ndarray, row: dict, value: float) -> np.ndarray:
    """The block with a value on the diagonal, but for features that are left out."""
    if row["p"] == row["q"]:
        at = np.flatnonzero(~np.isnan(m.diagonal()))
        m[at, at] = value
    return m


def leave_out(blocks: DataFrame, gone: DataFrame) -> DataFrame:
    """Blocks without the features ``g, r``: NaN in their rows and columns."""
    marked = with_ends(blocks, row_vectors(gone.withColumn("gone", F.lit(1.0)), ["gone"]))

    def blank(m: np.ndarray, row: dict) -> np.ndarray:
        p, q = ends(row, "gone", m)
        return np.where((p == 1)[:, None] | (q == 1)[None, :], np.nan, m)

    return map_blocks(marked, blank)


def adjacency(corr: DataFrame, power: float, signed: bool = True) -> DataFrame:
    """Blocks of ((1 + r) / 2) ** power, or |r| ** power for an unsigned network; 0 for a feature and itself."""
    return map_blocks(corr, lambda m, row: _own(_strength(m, signed) ** float(power), row, 0.0))


def connectivity(adj: DataFrame) -> DataFrame:
    """``g, r, k``: summed weight of each feature's edges."""
    return row_sums(adj, lambda m: [m], ["k"])


def scale_free_fit(degrees: DataFrame, keys: Sequence[str], n_bins: int = 20) -> DataFrame:
    """``keys, signed_r2, mean_connectivity``: R squared of log p(k) on log k over
    equally wide bins, with the sign of the slope; 0 with fewer than three usable bins."""
    keys = list(keys)
    spread = degrees.groupBy(*keys).agg(
        F.min("k").alias("_low"), F.max("k").alias("_high"), F.avg("k").alias("mean_connectivity")
    )
    width = (F.col("_high") - F.col("_low")) / n_bins
    bins = (
        degrees.join(spread, keys)
        .where((F.col("_high") > F.col("_low")) & (F.col("_high") > 0))
        .withColumn("bin", F.least(F.floor((F.col("k") - F.col("_low")) / width), F.lit(n_bins - 1)))
        .groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.first(F.col("_low") + (F.col("bin") + 0.5) * width).alias("centre"))
        .where(F.col("centre") > 0)
    )
    total = F.sum("n").over(Window.partitionBy(*keys))
    logs = bins.select(*keys, F.log10("centre").alias("x"), F.log10(F.col("n") / total).alias("y"))
    fits = logs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_bins"), F.regr_slope("y", "x").alias("_slope"), F.regr_r2("y", "x").alias("_r2"), F.var_pop("y").alias("_vy")
    )
    signed = F.when((F.col("_bins") >= 3) & (F.col("_vy") > 0), F.signum("_slope") * F.col("_r2")).otherwise(0.0)
    return spread.join(fits, keys, "left").select(
        *keys, F.coalesce(signed, F.lit(0.0)).alias("signed_r2"), "mean_connectivity"
    )


def soft_threshold_table(corr: DataFrame, powers: Sequence[int] | None = None, signed: bool = True) -> DataFrame:
    """``g, power, signed_r2, mean_connectivity`` for each candidate power. All powers of
    a feature are summed in one pass over the pairs."""
    powers = list(powers or range(1, 21))
    names = [f"p{p}" for p in powers]
    sums = row_sums(corr, lambda m: [_strength(m, signed) ** float(p) for p in powers], names)
    entries = F.array(*[F.struct(F.lit(p).alias("power"), F.col(n).alias("k")) for p, n in zip(powers, names)])
    degrees = sums.select("g", "r", F.inline(entries))
    return scale_free_fit(degrees, ["g", "power"])


def _overlap(m: np.ndarray, row: dict) -> np.ndarray:
    """Overlap from shared neighbours ``m``, direct links ``own`` and connectivities ``k``."""
    link = np.frombuffer(row["own"]).reshape(m.shape)
    bottom = np.minimum.outer(*ends(row, "k", m)) + 1 - link
    bottom[bottom == 0] = _EPS
    return _own(np.clip((m + link) / bottom, 0.0, 1.0), row, 1.0)


def topological_overlap(adj: DataFrame) -> DataFrame:
    """Blocks of shared neighbours and direct link over the smaller connectivity. The shared
    neighbours are the matrix times itself; it never becomes pairs. ``adj`` is read twice."""
    return map_blocks(with_ends(self_product(adj), row_vectors(connectivity(adj), ["k"])), _overlap)


def overlap_bounds(adj: DataFrame) -> DataFrame:
    """``g, p, q, bound``: no overlap of the two blocks' features is above ``bound``, but for a feature's with itself.

    With |i, k| the length of feature i's links into block k, two features share at most the sum
    of |i, k| |j, k| over all k; and neither more than the connectivity of one times the largest link of the other."""

    def own(m, row, rows, columns):
        alive = ~np.isnan(m)
        m = np.where(alive, m, 0.0)
        diagonal = row["p"] == row["q"]
        for at, k, values, there in ((row["p"], row["q"], m, alive), (row["q"], row["p"], m.T, alive.T)):
            used = there.any(axis=1)
            if used.any():
                sums = values.sum(axis=1)[used]
                yield {"i": [at], "k": [k], "length": [np.sqrt((values**2).sum(axis=1)).max()], "top": [values.max()], "low": [sums.min()], "high": [sums.max()]}
            if diagonal:
                break

    parts = materialise(from_blocks(adj, own, "i int, k int, length double, top double, low double, high double"))
    # sums of smallest and largest partial sums bound the connectivities
    rows = parts.groupBy("g", "i").agg(F.sum("low").alias("low"), F.sum("high").alias("high"), F.max("top").alias("most"))
    left = parts.select("g", F.col("i").alias("p"), "k", F.col("length").alias("_a"))
    right = parts.select("g", F.col("i").alias("q"), "k", F.col("length").alias("_b"))
    shared = left.join(right, ["g", "k"]).where("p <= q").groupBy("g", "p", "q").agg(F.sum(F.col("_a") * F.col("_b")).alias("shared"))
    for end in "pq":
        shared = shared.join(rows.select("g", F.col("i").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("low", "high", "most")]), ["g", end])
    links = parts.select("g", F.col("i").alias("p"), F.col("k").alias("q"), F.col("top").alias("link"))
    most = F.least("shared", F.col("high_p") * F.col("most_q"), F.col("high_q") * F.col("most_p"))
    # of two links between 0 and 1, the overlap grows with the direct one
    bottom = F.greatest(F.least("low_p", "low_q") + 1 - F.col("link"), F.lit(0.0))
    bound = F.when(bottom > 0, F.least((most + F.col("link")) / bottom, F.lit(1.0))).otherwise(1.0)
    return shared.join(links, ["g", "p", "q"]).select("g", "p", "q", (bound * (1 + 1e-9)).alias("bound"))


def overlap_edges(adj: DataFrame, threshold: float) -> DataFrame:
    """``g, a, b, tom`` of the pairs with an overlap above ``threshold``. Block pairs whose bound is no
    larger are never multiplied, and only the edges become rows."""
    wanted = overlap_bounds(adj).where(F.col("bound") > threshold).select("g", "p", "q")
    found = map_blocks(with_ends(self_product(adj, wanted), row_vectors(connectivity(adj), ["k"])), _overlap)
    return unfold(found, "tom", threshold)


def detect_modules(
    tom: DataFrame,
    features: DataFrame,
    min_module_size: int = 30,
    cut_height: float | None = None,
    local_items: int = LOCAL_ITEMS,
    linkage_method: str = "average",
) -> DataFrame:
    """``g, r, module`` by clustering on 1 - overlap; module 0 holds features of clusters below
    ``min_module_size``. Without a ``cut_height`` the first of a grid that gives the most modules is
    taken per group. ``linkage_method``: average, single, complete or weighted."""
    distance = map_blocks(tom, lambda m, row: 1 - m)
    labels = block_clusters(distance, features, min_module_size, cut_height, local_items, linkage_method)
    return materialise(number_clusters(labels, min_module_size))


# Vectors that the iteration for large modules carries along, and edge of its covariance blocks.
_PANEL, _EDGE = 12, 256
# Components whose weights agree to this share count as equal.
_EQUAL = 1e-9


def _start(r: np.ndarray) -> np.ndarray:
    """An uneven vector over feature numbers, not orthogonal to sign-balanced components."""
    return 1.0 + (np.asarray(r, np.int64) * 2654435761 % 1009) / 1009.0


def _leading(values: np.ndarray, vectors: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The component that stands for all of equal leading weight: the direction of ``start`` in
    the space they span, with a positive sum (or first entry, where the sum vanishes)."""
    top = vectors[:, values >= values.max() * (1 - _EQUAL) - np.finfo(float).tiny]
    u = top @ (top.T @ start)
    u /= np.linalg.norm(u) or 1.0
    total = u.sum()
    if abs(total) <= 1e-9 * len(u) ** 0.5:
        total = u[np.argmax(np.abs(u) > 1e-9)]
    return -u if total < 0 else u


def _loading_frame(g, module, items: np.ndarray, u: np.ndarray, scale: float, trace: float) -> pd.DataFrame:
    return pd.DataFrame(
        {"g": g, "module": module, "r": items, "loading": u, "scale": max(scale, 0.0), "explained": scale / trace if trace > 0 else 0.0}
    )


def _pair_entries(cov: DataFrame, spread: DataFrame, member: DataFrame) -> DataFrame:
    a = member.select("g", F.col("r").alias("a"), "module", "n")
    b = member.select("g", F.col("r").alias("b"), F.col("module").alias("_mb"))
    inner = cov.join(a, ["g", "a"]).join(b, ["g", "b"]).where(F.col("module") == F.col("_mb"))
    inner = inner.select("g", "module", "n", "a", "b", "cov")
    own = member.join(spread, ["g", "r"]).select(
        "g", "module", "n", F.col("r").alias("a"), F.col("r").alias("b"), F.col("spread").alias("cov")
    )
    return inner.unionByName(own)


def _block_entries(cov: DataFrame, member: DataFrame) -> DataFrame:
    """``g, module, n, a, b, cov`` for a <= b within a module, the only entries that leave the blocks."""
    vectors = row_vectors(member.select("g", "r", "module", "n"), ["module", "n"])

    def inside(m, row, rows, columns):
        (p, q), (n, _) = ends(row, "module", m), ends(row, "n", m)
        keep = p[:, None] == q[None, :]  # NaN, for no module, equals nothing
        if row["p"] == row["q"]:
            keep &= rows[:, None] <= columns[None, :]
        i, j = np.nonzero(keep)
        if len(i):
            yield {
                "module": p[i].astype(np.int32),
                "n": n[i].astype(np.int64),
                "a": rows[i].astype(np.int32),
                "b": columns[j].astype(np.int32),
                "cov": m[i, j],
            }

    return from_blocks(with_ends(cov, vectors), inside, "module int, n bigint, a int, b int, cov double")


def module_loadings(cov: DataFrame, spread: DataFrame, modules: DataFrame, local_items: int = LOCAL_ITEMS) -> DataFrame:
    """``g, module, r, loading, scale, explained``: first principal component of each
    module of two or more features, signed so that it goes with the module's mean.

    The component is the leading eigenvector of the members' covariance: ``scale`` is
    its eigenvalue and ``explained`` its share of the trace. Of equal leading components the one
    nearest to a fixed vector is meant. Modules of up to ``local_items`` features are
    solved one per task, larger ones by block products under the same rule."""
    member = modules.where(F.col("module") > 0)
    sizes = member.groupBy("g", "module").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    member = member.join(sizes, ["g", "module"])
    entries = _block_entries(cov, member) if "mat" in cov.columns else _pair_entries(cov, spread, member)
    schema = f"g {cov.schema['g'].dataType.simpleString()}, module int, r int, loading double, scale double, explained double"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        items = np.unique(pdf["a"].to_numpy().tolist() + pdf["b"].to_numpy().tolist())
        full = np.zeros((len(items), len(items)))
        i, j = np.searchsorted(items, pdf["a"]), np.searchsorted(items, pdf["b"])
        full[i, j] = full[j, i] = pdf["cov"].to_numpy()
        values, vectors = np.linalg.eigh(full)
        u = _leading(values, vectors, _start(items))
        return _loading_frame(pdf["g"].iloc[0], pdf["module"].iloc[0], items, u, float(values[-1]), float(np.trace(full)))

    if (sizes.agg(F.max("n")).first()[0] or 0) <= local_items:
        return materialise(entries.groupBy("g", "module").applyInPandas(solve, schema))
    entries = materialise(entries)
    small = entries.where(F.col("n") <= local_items).groupBy("g", "module").applyInPandas(solve, schema)
    return materialise(small.unionByName(_block_loadings(entries.where(F.col("n") > local_items), schema)))


def _block_loadings(entries: DataFrame, schema: str, tolerance: float = 1e-9, rounds: int = 200) -> DataFrame:
    """Leading components of large modules by subspace iteration.

    The covariance stays in square blocks; a panel of a few vectors, as long as the module,
    is multiplied by all of them at once, and one task per module then turns it to the best
    vectors it spans. A module is done when its leading residual is small; one that is not after
    ``rounds`` is an error, since its answer would only be near the component."""
    keys = ["g", "module"]
    kind = entries.schema["g"].dataType.simpleString()
    both = F.array(
        F.struct(F.col("a").alias("i"), F.col("b").alias("j")), F.struct(F.col("b").alias("i"), F.col("a").alias("j"))
    )
    placed = entries.select(*keys, F.inline(both), "cov").select(
        *keys, "i", "j", "cov", F.floor(F.col("i") / _EDGE).cast("int").alias("p"), F.floor(F.col("j") / _EDGE).cast("int").alias("q")
    )

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        dense = np.zeros((_EDGE, _EDGE))
        dense[pdf["i"] % _EDGE, pdf["j"] % _EDGE] = pdf["cov"]
        return pdf.iloc[[0]][[*keys, "p", "q"]].assign(mat=[dense.tobytes()])

    head = f"g {kind}, module int"
    blocks = materialise(placed.groupBy(*keys, "p", "q").applyInPandas(block, f"{head}, p int, q int, mat binary"))

    def begin(pdf: pd.DataFrame) -> pd.DataFrame:
        items = np.sort(pdf["r"].to_numpy())
        rng = np.random.default_rng(0)
        panel = np.column_stack([_start(items), rng.normal(size=(len(items), min(_PANEL, len(items)) - 1))])
        return _panel_rows(pdf["g"].iloc[0], pdf["module"].iloc[0], items, np.linalg.qr(panel)[0], np.zeros(1), False)

    def turn(panel: pd.DataFrame, product: pd.DataFrame) -> pd.DataFrame:
        if not len(panel):
            return panel
        items = np.concatenate([np.frombuffer(x, np.int64) for x in panel["items"]])
        width = int(panel["width"].iloc[0])
        before = np.concatenate([np.frombuffer(x).reshape(-1, width) for x in panel["mat"]])
        if panel["done"].iloc[0]:
            return panel
        after = np.zeros_like(before)
        at = {int(i): k for k, i in enumerate(items)}
        for q, raw in zip(product["p"], product["mat"]):
            rows = np.frombuffer(raw).reshape(_EDGE, width)
            own = [(at[i], i - q * _EDGE) for i in range(q * _EDGE, (q + 1) * _EDGE) if i in at]
            if own:
                here, there = map(list, zip(*own))
                after[here] += rows[there]
        values, mix = np.linalg.eigh(before.T @ after)
        best, image = before @ mix[:, ::-1], after @ mix[:, ::-1]
        values = values[::-1]
        left = np.linalg.norm(image[:, 0] - values[0] * best[:, 0])
        if left <= tolerance * max(abs(values[0]), 1e-300):
            return _panel_rows(panel["g"].iloc[0], panel["module"].iloc[0], items, best, values, True)
        return _panel_rows(panel["g"].iloc[0], panel["module"].iloc[0], items, np.linalg.qr(image)[0], values, False)

    shape = f"{head}, q int, items binary, mat binary, width int, weights binary, done boolean"
    member = entries.select(*keys, F.explode(F.array("a", "b")).alias("r")).distinct()
    panel = materialise(member.groupBy(*keys).applyInPandas(begin, shape))

    def multiply(batches):
        for pdf in batches:
            out = []
            for mat, items, raw, q, width in zip(pdf["mat"], pdf["items"], pdf["panel"], pdf["q"], pdf["width"]):
                rows = np.zeros((_EDGE, width))
                rows[np.frombuffer(items, np.int64) - q * _EDGE] = np.frombuffer(raw).reshape(-1, width)
                out.append((np.frombuffer(mat).reshape(_EDGE, _EDGE) @ rows).tobytes())
            yield pdf[[*keys, "p"]].assign(mat=out)

    for _ in range(rounds):
        if panel.where("not done").isEmpty():
            break
        open_ = panel.where("not done").select(*keys, "q", "items", F.col("mat").alias("panel"), "width")
        product = blocks.join(open_, [*keys, "q"]).mapInPandas(multiply, f"{head}, p int, mat binary")
        panel = materialise(panel.groupBy(*keys).cogroup(product.groupBy(*keys)).applyInPandas(turn, shape))

    left = [tuple(r) for r in panel.where("not done").select(*keys).distinct().take(5)]
    if left:
        raise ArithmeticError(f"the leading components of {left} are too close together to tell apart in {rounds} rounds")

    trace = entries.where(F.col("a") == F.col("b")).groupBy(*keys).agg(F.sum("cov").alias("trace"))

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        items = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["items"]])
        vectors = np.concatenate([np.frombuffer(x).reshape(-1, int(w)) for x, w in zip(pdf["mat"], pdf["width"])])
        values = np.frombuffer(pdf["weights"].iloc[0])
        u = _leading(values, vectors, _start(items))
        return _loading_frame(pdf["g"].iloc[0], pdf["module"].iloc[0], items, u, float(values[0]), float(pdf["trace"].iloc[0]))

    return panel.join(trace, keys).groupBy(*keys).applyInPandas(finish, schema)


def _panel_rows(g, module, items: np.ndarray, panel: np.ndarray, weights: np.ndarray, done: bool) -> pd.DataFrame:
    """The panel of a module cut by blocks of features."""
    q = items // _EDGE
    rows = [np.flatnonzero(q == b) for b in np.unique(q)]
    return pd.DataFrame(
        {
            "g": g,
            "module": module,
            "q": np.unique(q).astype(np.int32),
            "items": [items[k].astype(np.int64).tobytes() for k in rows],
            "mat": [np.ascontiguousarray(panel[k]).tobytes() for k in rows],
            "width": np.int32(panel.shape[1]),
            "weights": weights.tobytes(),
            "done": done,
        }
    )


def eigengenes(matrix: FeatureMatrix, loadings: DataFrame) -> DataFrame:
    """``g, module, chunk, pos, score``: the component's value at every observation."""
    weight = loadings.select("g", "module", "r", "loading")
    sums = matrix.cells.join(weight, ["g", "r"]).groupBy("g", "module", "chunk", "pos").agg(
        F.sum(F.col("loading") * F.col("v")).alias("_s")
    )
    centre = (
        matrix.features.join(weight, ["g", "r"])
        .groupBy("g", "module")
        .agg(F.sum(F.col("loading") * F.col("total") / F.col("n_obs")).alias("_c"))
    )
    places = matrix.observations.select("g", "chunk", "pos").join(centre, "g")
    return places.join(sums, ["g", "module", "chunk", "pos"], "left").select(
        "g", "module", "chunk", "pos", (F.coalesce("_s", F.lit(0.0)) - F.col("_c")).alias("score")
    )


def merge_modules(
    cov: DataFrame, loadings: DataFrame, modules: DataFrame, merge_cut: float = 0.75, local_items: int = LOCAL_ITEMS, signed: bool = False
) -> DataFrame:
    """Join modules whose eigengenes correlate, positively or (unless ``signed``) negatively: average
    linkage on 1 - |r|, or 1 - r, cut at 1 - ``merge_cut``. Two eigengenes' product is the covariance of
    their members weighted by both loadings, so no eigengene has to be formed."""
    weights = loadings.where(F.col("scale") > 0).select("g", "r", F.col("module").alias("m"), (F.col("loading") / F.sqrt("scale")).alias("u"))

    def between(m, row, rows, columns):
        """Products of the loadings of the modules that meet in a block, each pair of features once."""
        (mp, mq), (up, uq) = ends(row, "m", m), ends(row, "u", m)
        i, j = np.flatnonzero(~np.isnan(mp)), np.flatnonzero(~np.isnan(mq))
        if not len(i) or not len(j):
            return
        (left, x), (right, y) = np.unique(mp[i], return_inverse=True), np.unique(mq[j], return_inverse=True)
        product = np.zeros((len(left), len(j)))
        np.add.at(product, x, up[i, None] * m[np.ix_(i, j)] * uq[None, j])
        total = np.zeros((len(left), len(right)))
        np.add.at(total.T, y, product.T)
        keep = left[:, None] < right[None, :] if row["p"] == row["q"] else left[:, None] != right[None, :]
        i, j = np.nonzero(keep)
        if len(i):
            ends_ = left[i].astype(np.int32), right[j].astype(np.int32)
            yield {"a": np.minimum(*ends_), "b": np.maximum(*ends_), "product": total[i, j]}

    products = from_blocks(with_ends(cov, row_vectors(weights, ["m", "u"])), between, "a int, b int, product double")
    pairs = materialise(products.groupBy("g", "a", "b").agg((1 - (F.sum("product") if signed else F.abs(F.sum("product")))).alias("d")))
    if pairs.isEmpty():
        return modules
    listed = loadings.select("g", F.col("module").alias("r")).distinct()
    target = clusters(pairs, listed, 1, 1.0 - merge_cut, local_items).select("g", F.col("r").alias("module"), "cluster")
    merged = modules.join(target, ["g", "module"], "left").select(
        "g", "r", F.when(F.col("module") > 0, F.coalesce("cluster", "module")).alias("cluster")
    )
    # consecutive numbers again, by the first feature of each module
    first = merged.where(F.col("cluster").isNotNull()).groupBy("g", "cluster").agg(F.min("r").alias("_first"))
    numbered = first.select("g", "cluster", F.row_number().over(Window.partitionBy("g").orderBy("_first")).alias("_n"))
    return materialise(
        merged.join(numbered, ["g", "cluster"], "left").select("g", "r", F.coalesce("_n", F.lit(0)).alias("module"))
    )


def module_membership(loadings: DataFrame, spread: DataFrame, modules: DataFrame) -> DataFrame:
    """``g, r, module, kme, explained``: correlation of a feature with its own eigengene;
    null for features without a module."""
    fitted = loadings.join(spread, ["g", "r"]).select(
        "g", "r", F.try_divide(F.sqrt("scale") * F.col("loading"), F.sqrt("spread")).alias("kme"), "explained"
    )
    return modules.join(fitted, ["g", "r"], "left").select("g", "r", "module", "kme", "explained")
