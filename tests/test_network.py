import numpy as np
import pandas as pd
import pytest

from ostinato.operators import correlation as corr_module
from ostinato.operators import blocks as block_module
from ostinato.operators import clustering as cluster_module
from ostinato.operators import network as net
from ostinato.operators.blocks import fold, gram, unfold
from ostinato.operators.clustering import CUT_HEIGHTS, METHODS, average_linkage, block_clusters, clusters, cut_labels, flat_clusters, linkage
from ostinato.operators.correlation import correlation, feature_matrix, redundant_features
from ostinato.plans.network import NetworkAnalyzer, NetworkResults

WELLS = {"g1": ["A", "B"], "g2": ["C"]}


def make_table():
    """Two wells with two antiphase blocks of features, one small well, gaps and dead features."""
    rng = np.random.default_rng(0)
    rows = []
    for g, wells in WELLS.items():
        for w in wells:
            n = 24 if g == "g1" else 16
            t = np.arange(n)
            base = np.cos(2 * np.pi * t / 12)
            for i in range(12):
                y = (base if i < 6 else -base) + rng.normal(0, 0.35, n)
                rows += [(g, w, float(a), f"f{i:02d}", float(b)) for a, b in zip(t, y) if not (i == 3 and a % 5 == 0)]
            for i in range(4):
                rows += [(g, w, float(a), f"n{i}", float(b)) for a, b in zip(t, rng.normal(size=n))]
            rows += [(g, w, float(a), "dead", 4.0) for a in t]
            if w != "B":  # one well lacks this feature
                rows += [(g, w, float(a), "only", float(b)) for a, b in zip(t, rng.normal(size=n))]
    return pd.DataFrame(rows, columns=["g", "well", "t", "feature", "v"])


@pytest.fixture(scope="module")
def table():
    return make_table()


@pytest.fixture(scope="module")
def dense(table):
    """Feature matrices by pandas: z-scores per well side by side, missing cells 0."""
    out = {}
    for g, part in table.groupby("g"):
        z = part.copy()
        by = part.groupby(["well", "feature"])["v"]
        sd = by.transform("std")
        z["v"] = ((part["v"] - by.transform("mean")) / sd).where(sd != 0)
        wide = z.pivot(index="feature", columns=["well", "t"], values="v").sort_index()
        keep = wide.var(axis=1, ddof=0) > 0
        out[g] = wide[keep].fillna(0.0)
    return out


@pytest.fixture(scope="module")
def frame(spark, table):
    return spark.createDataFrame(table).repartition(4)


@pytest.fixture(scope="module", params=["small", "blocked"])
def matrix(request, frame):
    # small blocks, so that products are summed over several blocks and chunks
    patch = pytest.MonkeyPatch()
    if request.param == "blocked":
        for name, value in {"BLOCK": 5, "CHUNK": 8, "CHUNKS_PER_TASK": 2, "TILE": 2, "DEPTH": 1}.items():
            patch.setattr(block_module, name, value)
        patch.setattr(cluster_module, "BLOCK", 5)
        patch.setattr(corr_module, "CHUNK", 8)
    yield feature_matrix(frame, "g", "well", "t", "feature", "v")
    patch.undo()


def full(pairs, matrix, column, diagonal):
    names = {(r.g, r.r): r.feature for r in matrix.features.collect()}
    out = {}
    if "mat" in pairs.columns:
        pairs = unfold(pairs, column)
    for (g,), part in pairs.toPandas().groupby(["g"]):
        items = sorted(n for (h, _), n in names.items() if h == g)
        m = pd.DataFrame(np.nan, items, items)
        for a, b, v in zip(part["a"], part["b"], part[column]):
            m.loc[names[g, a], names[g, b]] = m.loc[names[g, b], names[g, a]] = v
        np.fill_diagonal(m.values, diagonal)
        out[g] = m
    return out


def brute_corr(x, method):
    if method == "pearson":
        return np.corrcoef(x)
    if method == "spearman":
        return np.corrcoef(pd.DataFrame(x.T).rank().to_numpy().T)
    d = x - np.median(x, axis=1, keepdims=True)
    mad = np.median(np.abs(d), axis=1, keepdims=True)
    u = d / (9 * mad)
    v = d * np.where(np.abs(u) < 1, (1 - u**2) ** 2, 0)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v @ v.T


def test_assembly(matrix, dense):
    rows = matrix.features.toPandas()
    for g, want in dense.items():
        part = rows[rows["g"] == g].sort_values("r")
        assert part["feature"].tolist() == want.index.tolist() and part["r"].tolist() == list(range(len(want)))
        np.testing.assert_allclose(part["squares"], (want**2).sum(axis=1), rtol=1e-9)
    assert {r.g: r.n_obs for r in matrix.sizes.collect()} == {g: d.shape[1] for g, d in dense.items()}
    assert {(r.g, r.feature) for r in matrix.dropped.collect()} == {("g1", "dead"), ("g2", "dead")}
    assert matrix.observations.groupBy("g", "chunk", "pos").count().where("count > 1").isEmpty()


@pytest.mark.parametrize("method", ["pearson", "spearman", "bicor"])
def test_correlation(matrix, dense, method):
    got = full(correlation(matrix, method), matrix, "r", 1.0)
    for g, d in dense.items():
        want = brute_corr(d.to_numpy(), method)
        np.fill_diagonal(want, 1.0)
        np.testing.assert_allclose(got[g], want, atol=1e-9)


@pytest.mark.parametrize("method", ["spearman", "bicor"])
def test_correlation_of_large_groups(matrix, dense, method, monkeypatch):
    monkeypatch.setattr(corr_module, "GROUP_ROWS", 10)
    got = full(correlation(matrix, method), matrix, "r", 1.0)
    want = brute_corr(dense["g1"].to_numpy(), method)
    np.fill_diagonal(want, 1.0)
    np.testing.assert_allclose(got["g1"], want, atol=1e-9)


def brute_tom(a):
    k = a.sum(axis=1)
    low = np.minimum(k[:, None], k[None, :])
    tom = (a @ a + a) / (low + 1 - a)
    np.fill_diagonal(tom, 1.0)
    return np.clip(tom, 0, 1)


@pytest.mark.parametrize("signed", [True, False])
def test_overlap(matrix, dense, signed):
    adj = net.adjacency(correlation(matrix), 3, signed)
    got = full(net.topological_overlap(adj), matrix, "tom", 1.0)
    for g, d in dense.items():
        r = brute_corr(d.to_numpy(), "pearson")
        a = ((1 + r) / 2) ** 3 if signed else np.abs(r) ** 3
        np.fill_diagonal(a, 0.0)
        np.testing.assert_allclose(got[g], brute_tom(a), atol=1e-9)


def test_soft_threshold_table(matrix, dense):
    got = {(r.g, r.power): r for r in net.soft_threshold_table(correlation(matrix), [1, 4]).collect()}
    for g, d in dense.items():
        for power in (1, 4):
            a = ((1 + brute_corr(d.to_numpy(), "pearson")) / 2) ** power
            np.fill_diagonal(a, 0.0)
            k = a.sum(axis=1)
            hist, edges = np.histogram(k, bins=20)
            mid = (edges[:-1] + edges[1:]) / 2
            ok = (hist > 0) & (mid > 0)
            x, y = np.log10(mid[ok]), np.log10(hist[ok] / hist[ok].sum())
            slope, start = np.polyfit(x, y, 1)
            total = np.sum((y - y.mean()) ** 2)
            r2 = np.sign(slope) * (1 - np.sum((y - slope * x - start) ** 2) / total) if total > 0 else 0.0
            assert got[g, power].mean_connectivity == pytest.approx(k.mean())
            assert got[g, power].signed_r2 == pytest.approx(r2, abs=1e-9)


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.85, 0.999])
def test_redundant_features(matrix, dense, threshold):
    names = {(r.g, r.r): r.feature for r in matrix.features.collect()}
    got = {(r.g, names[r.g, r.r]): names[r.g, r.representative] for r in redundant_features(correlation(matrix), threshold).collect()}
    want = {}
    for g, d in dense.items():
        r, items, taken = np.abs(brute_corr(d.to_numpy(), "pearson")), d.index.tolist(), set()
        for i in range(len(items)):
            if i in taken:
                continue
            for j in range(i + 1, len(items)):
                if j not in taken and r[i, j] > threshold:
                    want[g, items[j]] = items[i]
                    taken.add(j)
    assert got == want


# -- clustering


def slow_linkage(d):
    """Merge the closest pair again and again; distances are means over all item pairs."""
    groups = {i: [i] for i in range(len(d))}
    out = []
    while len(groups) > 1:
        height, a, b = min((d[np.ix_(groups[a], groups[b])].mean(), a, b) for a in groups for b in groups if a < b)
        groups[a] += groups.pop(b)
        out.append((height, sorted(groups[a])))
    return out


def distances(n, seed):
    p = np.random.default_rng(seed).normal(size=(n, 3))
    return np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))


@pytest.mark.parametrize("n,seed", [(2, 0), (7, 1), (25, 2)])
def test_average_linkage(n, seed):
    d = distances(n, seed)
    merges = average_linkage(d)
    want = slow_linkage(d)
    np.testing.assert_allclose(np.sort(merges[:, 2]), [h for h, _ in want])
    for height, members in want:
        labels = cut_labels(merges, n, height * (1 + 1e-9))
        assert len(set(labels[members])) == 1


def pair_frame(spark, groups):
    rows = [(g, a, b, float(d[a, b])) for g, d in groups.items() for a in range(len(d)) for b in range(a + 1, len(d))]
    items = [(g, i) for g, d in groups.items() for i in range(len(d))]
    return spark.createDataFrame(rows, "g string, a int, b int, d double"), spark.createDataFrame(items, "g string, r int")


@pytest.mark.parametrize("cut,limit", [(None, 6), (0.5, 0)])
def test_rounds_equal_local_clusters(spark, cut, limit):
    groups = {"x": distances(12, 3) / 4, "y": distances(5, 4) / 4, "single": np.zeros((1, 1))}
    pairs, items = pair_frame(spark, groups)
    local, rounds = [
        clusters(pairs, items, 2, cut, local_items=n).toPandas().sort_values(["g", "r"], ignore_index=True) for n in (100, limit)
    ]
    pd.testing.assert_frame_equal(local, rounds)
    for g in ("x", "y"):
        assert local[local["g"] == g]["cluster"].tolist() == flat_clusters(groups[g], 2, cut).tolist()


@pytest.mark.parametrize("seed", range(4))
def test_ties_give_one_tree(spark, seed):
    """Equal distances merge in the order of their numbers, whichever path a group takes."""
    rng = np.random.default_rng(seed)
    groups = {}
    for g in ("x", "y"):
        d = rng.integers(1, 4, (9, 9)) / 4
        groups[g] = np.triu(d, 1) + np.triu(d, 1).T
    pairs, items = pair_frame(spark, groups)
    for cut in (None, 0.5, 0.55):
        local, rounds = [
            clusters(pairs, items, 2, cut, local_items=n).toPandas().sort_values(["g", "r"], ignore_index=True) for n in (100, 2)
        ]
        pd.testing.assert_frame_equal(local, rounds)


def slow_merges(d, method):
    """Merge the closest pair again and again under a linkage's own distance; equal ones by number."""
    apart = {(a, b): d[a, b] for a in range(len(d)) for b in range(a + 1, len(d))}
    alive, size, out = set(range(len(d))), [1] * len(d), []
    get = lambda a, b: apart[min(a, b), max(a, b)]
    while len(alive) > 1:
        height, a, b = min((get(a, b), a, b) for a in alive for b in alive if a < b)
        alive.remove(b)
        for c in alive - {a}:
            x, y = get(a, c), get(b, c)
            mean = (size[a] * x + size[b] * y) / (size[a] + size[b])
            apart[min(a, c), max(a, c)] = {"average": mean, "single": min(x, y), "complete": max(x, y), "weighted": (x + y) / 2}[method]
        size[a] += size[b]
        out.append((a, b, height, size[a]))
    return np.array(out, float)


@pytest.mark.parametrize("method", METHODS)
@pytest.mark.parametrize("ties", [False, True])
def test_linkages(method, ties):
    for seed in range(6):
        d = distances(17, seed)
        if ties:  # whole numbers, so that means are exact
            d = np.triu(np.random.default_rng(seed).integers(1, 5, (17, 17)).astype(float), 1)
            d = d + d.T
        if ties and method == "average":
            continue  # test_ties_give_one_tree has them in whole-number sums
        np.testing.assert_allclose(linkage(d, method), slow_merges(d, method))
    with pytest.raises(ValueError):
        linkage(d, "ward?")


@pytest.mark.parametrize("method", METHODS)
def test_linkage_in_rounds(spark, method):
    rng = np.random.default_rng(8)
    tied = np.triu(rng.integers(1, 4, (8, 8)) / 4.0, 1)
    groups = {"x": distances(11, 3) / 4, "tied": tied + tied.T, "y": distances(4, 4) / 4, "single": np.zeros((1, 1))}
    pairs, items = pair_frame(spark, groups)
    cut = None if method in ("average", "complete") else 0.4
    local, rounds, blocks, far = [
        f.toPandas().sort_values(["g", "r"], ignore_index=True)
        for f in (
            clusters(pairs, items, 2, cut, 100, method),
            clusters(pairs, items, 2, cut, 6, method),
            block_clusters(fold(pairs, items, "d"), items, 2, cut, 100, method),
            block_clusters(fold(pairs, items, "d"), items, 2, cut, 6, method),
        )
    ]
    for other in (rounds, blocks, far):
        pd.testing.assert_frame_equal(local, other)
    want = flat_clusters(groups["x"], 2, cut, method=method)
    assert local[local["g"] == "x"]["cluster"].tolist() == want.tolist()


def test_spanning_tree_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(block_module, "BLOCK", 5)
    monkeypatch.setattr(cluster_module, "BLOCK", 5)
    rng = np.random.default_rng(2)
    d = np.triu(rng.integers(1, 9, (33, 33)) / 8.0, 1)
    pairs, items = pair_frame(spark, {"x": d + d.T, "two": distances(2, 1)})
    tree = cluster_module.spanning_tree(fold(pairs, items, "d"), items).toPandas()
    # Kruskal in the same order
    owner, want = list(range(33)), set()
    for s, a, b in sorted((d[a, b], a, b) for a in range(33) for b in range(a + 1, 33)):
        if owner[a] != owner[b]:
            want.add((a, b))
            owner = [min(owner[a], owner[b]) if o in (owner[a], owner[b]) else o for o in owner]
    part = tree[tree["g"] == "x"]
    assert set(zip(part["a"], part["b"])) == want and len(tree) == 33
    one, many = [
        block_clusters(fold(pairs, items, "d"), items, 2, None, n, "single").toPandas().sort_values(["g", "r"], ignore_index=True)
        for n in (100, 1)
    ]
    pd.testing.assert_frame_equal(one, many)


def test_edges_above_a_threshold_leave_blocks_out(spark, monkeypatch):
    """Three separate groups of features: bounds leave out the blocks between them, and no edge."""
    for name, value in {"BLOCK": 6, "TILE": 1, "DEPTH": 1}.items():
        monkeypatch.setattr(block_module, name, value)
    rng = np.random.default_rng(3)
    n = 18
    a = np.zeros((n, n))
    for k in range(3):
        at = slice(6 * k, 6 * k + 6)
        a[at, at] = rng.uniform(0.5, 0.9, (6, 6))
    a = np.triu(a + rng.uniform(0, 0.004, (n, n)), 1)
    a = a + a.T
    pairs, items = pair_frame(spark, {"x": a})
    adj = fold(pairs, items, "d")
    bounds = {(r.p, r.q): r.bound for r in net.overlap_bounds(adj).collect()}
    tom = brute_tom(a)
    np.fill_diagonal(tom, 0)
    assert len(bounds) == 6
    for (p, q), bound in bounds.items():
        assert tom[6 * p : 6 * p + 6, 6 * q : 6 * q + 6].max() <= bound
    assert {k for k, v in bounds.items() if v > 0.3} == {(0, 0), (1, 1), (2, 2)}
    for threshold in (0.3, 0.001):
        got = {(r.a, r.b): r.tom for r in net.overlap_edges(adj, threshold).collect()}
        want = {(i, j): tom[i, j] for i in range(n) for j in range(i + 1, n) if tom[i, j] > threshold}
        assert got.keys() == want.keys()
        for k in want:
            assert got[k] == pytest.approx(want[k], abs=1e-12)


def test_cut_scan_takes_the_first_best_height():
    d = distances(24, 3) / 4
    merges = average_linkage(d)
    counts = [np.sum(np.unique(cut_labels(merges, 24, h), return_counts=True)[1] >= 3) for h in CUT_HEIGHTS]
    best = CUT_HEIGHTS[int(np.argmax(counts))]
    assert flat_clusters(d, 3, None).tolist() == cut_labels(merges, 24, best).tolist()


# -- modules


def component(x):
    c = x - x.mean(axis=1, keepdims=True)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    score = vt[0] * s[0]
    if np.corrcoef(score, c.mean(axis=0))[0, 1] < 0:
        score = -score
    return score, s[0] ** 2 / np.sum(s**2)


@pytest.fixture(scope="module")
def analyzed(spark, frame):
    pm = spark.createDataFrame([(w, g) for g, ws in WELLS.items() for w in ws], "well string, line string")
    analyzer = NetworkAnalyzer(min_module_size=4, soft_power=3, redundancy_threshold=0.999)
    assembled = analyzer.assemble(frame, "well", "t", "feature", "v", pm, "line")
    return analyzer, assembled, analyzer.analyze(assembled, edge_threshold=0.05)


def slow_modules(x, power, min_size):
    """The whole chain on one dense matrix, by its definitions."""
    a = ((1 + brute_corr(x, "pearson")) / 2) ** power
    np.fill_diagonal(a, 0.0)
    d = 1 - brute_tom(a)
    merges = slow_linkage(d)

    def parts(height):
        found = [{i} for i in range(len(d))]
        for h, members in merges:
            if h <= height:
                found = [f for f in found if not f & set(members)] + [set(members)]
        return [f for f in found if len(f) >= min_size]

    best = max(CUT_HEIGHTS, key=lambda h: len(parts(h)))
    modules = parts(best)
    if len(modules) > 1:
        eigen = np.array([component(x[sorted(m)])[0] for m in modules])
        e = 1 - np.abs(np.corrcoef(eigen))
        groups = [{i} for i in range(len(modules))]
        for h, members in slow_linkage(e):
            if h <= 0.25:
                groups = [g for g in groups if not g & set(members)] + [set(members)]
        modules = [set().union(*[modules[i] for i in g]) for g in groups]
    return {frozenset(m) for m in modules}


def test_modules(analyzed, dense):
    rows = analyzed[2].modules.toPandas()
    for g, d in dense.items():
        part = rows[(rows["group_key"] == g) & (rows["module_id"] > 0)]
        got = {frozenset(d.index.get_indexer(p["feature"])) for _, p in part.groupby("module_id")}
        assert got == slow_modules(d.to_numpy(), 3, 4) and got
        assert sorted(part["module_id"].unique()) == list(range(1, len(got) + 1))
    assert len(rows) == sum(len(d) for d in dense.values())


def test_eigengenes_and_membership(analyzed, dense):
    modules = analyzed[2].modules.toPandas()
    scores = analyzed[2].eigengenes.toPandas()
    for (g, m), part in modules[modules["module_id"] > 0].groupby(["group_key", "module_id"]):
        x = dense[g].loc[part["feature"]]
        score, explained = component(x.to_numpy())
        got = scores[(scores["group_key"] == g) & (scores["feature"] == f"Module_{m}")].set_index(["well", "timepoint"])["value"]
        np.testing.assert_allclose(got.loc[list(x.columns)], score, atol=1e-7)
        np.testing.assert_allclose(part["variance_explained"], explained, rtol=1e-9)
        np.testing.assert_allclose(part["kME"], [np.corrcoef(row, score)[0, 1] for row in x.to_numpy()], atol=1e-7)
    assert modules[modules["module_id"] == 0]["kME"].isna().all()


def test_edges(analyzed, dense):
    edges = analyzed[2].edges.toPandas()
    for g, d in dense.items():
        a = ((1 + brute_corr(d.to_numpy(), "pearson")) / 2) ** 3
        np.fill_diagonal(a, 0.0)
        tom = brute_tom(a)
        i, j = np.triu_indices(len(d), 1)
        want = {(d.index[a], d.index[b]): tom[a, b] for a, b in zip(i, j) if tom[a, b] > 0.05}
        part = edges[edges["group_key"] == g]
        got = dict(zip(zip(part["feature_a"], part["feature_b"]), part["weight"]))
        assert got.keys() == want.keys()
        for k in want:
            assert got[k] == pytest.approx(want[k], abs=1e-9)


@pytest.mark.parametrize("kind", ["near", "equal", "equal_many"])
def test_leading_component_at_any_size(spark, kind):
    """Near and equal leading weights have one answer, whichever path a module takes."""
    rng = np.random.default_rng(5)
    n = 30
    values = np.r_[2.0, {"near": 1.98, "equal": 2.0, "equal_many": 2.0}[kind], np.linspace(0.4, 0.05, n - 2)]
    if kind == "equal_many":
        values[:5] = 2.0
    q = np.linalg.qr(rng.normal(size=(n, n)))[0]
    full = q @ np.diag(values) @ q.T
    numbers = np.sort(rng.choice(600, n, replace=False)).tolist()
    rows = [("g", numbers[a], numbers[b], float(full[a, b])) for a in range(n) for b in range(a + 1, n)]
    cov = spark.createDataFrame(rows, "g string, a int, b int, cov double")
    spread = spark.createDataFrame([("g", r, float(full[k, k])) for k, r in enumerate(numbers)], "g string, r int, spread double")
    modules = spark.createDataFrame([("g", r, 1) for r in numbers], "g string, r int, module int")
    near, far = [
        net.module_loadings(cov, spread, modules, local_items=limit).toPandas().sort_values("r", ignore_index=True) for limit in (100, 2)
    ]
    np.testing.assert_allclose(near["scale"], 2.0, rtol=1e-9)
    for c in ("loading", "scale", "explained"):
        np.testing.assert_allclose(near[c], far[c], rtol=1e-7, atol=1e-7)


def test_no_component_without_convergence(spark):
    n = 20
    rows = [("g", 1, n, a, b, float(1 / (1 + abs(a - b)))) for a in range(n) for b in range(a, n)]
    entries = spark.createDataFrame(rows, "g string, module int, n long, a int, b int, cov double")
    schema = "g string, module int, r int, loading double, scale double, explained double"
    with pytest.raises(ArithmeticError, match="too close together"):
        net._block_loadings(entries, schema, rounds=1)


def test_large_modules_by_blocks(analyzed):
    _, assembled, _ = analyzed
    chosen = assembled.matrix.features.where("feature like 'f%'").selectExpr("g", "r", "cast(1 + (r % 2) as int) as module")
    frames = [
        net.module_loadings(assembled.cov, assembled.spread, chosen, local_items=limit).toPandas().sort_values(["g", "module", "r"], ignore_index=True)
        for limit in (100, 2)
    ]
    for c in ("loading", "scale", "explained"):
        np.testing.assert_allclose(frames[0][c], frames[1][c], rtol=1e-6, atol=1e-8)


def test_merge_keeps_unlike_modules(analyzed, dense):
    _, assembled, _ = analyzed
    modules = assembled.matrix.features.where("g = 'g1'").selectExpr(
        "g", "r", "cast(case when feature < 'f03' then 1 when feature < 'f06' then 2 when feature like 'n%' then 3 else 0 end as int) as module"
    )
    loadings = net.module_loadings(assembled.cov, assembled.spread, modules)
    merged = net.merge_modules(assembled.cov, loadings, modules)
    got = {r.r: r.module for r in merged.collect()}
    names = {r.r: r.feature for r in assembled.matrix.features.where("g = 'g1'").collect()}
    by_name = {names[r]: m for r, m in got.items()}
    assert by_name["f00"] == by_name["f04"] == 1 and by_name["n0"] == 2 and by_name["f10"] == 0


def test_signed_merge_keeps_antiphase_modules(analyzed):
    _, assembled, _ = analyzed
    modules = assembled.matrix.features.where("g = 'g1'").selectExpr(
        "g", "r", "cast(case when feature < 'f06' then 1 when feature like 'f%' then 2 else 0 end as int) as module"
    )
    loadings = net.module_loadings(assembled.cov, assembled.spread, modules)
    either, same = [
        {r.r: r.module for r in net.merge_modules(assembled.cov, loadings, modules, signed=signed).collect()} for signed in (False, True)
    ]
    assert set(either.values()) == {0, 1} and set(same.values()) == {0, 1, 2}


def test_power_is_required(analyzed):
    with pytest.raises(ValueError):
        NetworkAnalyzer().analyze(analyzed[1])


def test_wells_alone_and_redundancy(spark, frame, tmp_path):
    copy = frame.where("feature = 'f00'").selectExpr("g", "well", "t", "'z_copy' as feature", "2 * v + 1 as v")
    analyzer = NetworkAnalyzer(min_module_size=4, soft_power=3)
    assembled = analyzer.assemble(frame.unionByName(copy), "well", "t", "feature", "v")
    found = {(r.group_key, r.feature, r.representative_feature) for r in assembled.redundant.collect()}
    assert found == {(w, "z_copy", "f00") for w in "ABC"}
    assert assembled.features.where("feature = 'z_copy'").isEmpty()
    assert set(analyzer.pick_soft_threshold(assembled, [1, 2]).toPandas()["group_key"]) == set("ABC")
    results = analyzer.analyze(assembled)
    results.save(str(tmp_path / "net"))
    again = NetworkResults.load(spark, str(tmp_path / "net"))
    assert again.modules.count() == assembled.features.count()


def test_duplicate_cells_are_refused(spark):
    rows = [("g", "A", float(t), f, float(t * t % 5 + k)) for t in range(12) for k, f in enumerate(("x", "y"))]
    for repeated in (rows[:1], [("g", "A", 0.0, "x", None)]):
        frame = spark.createDataFrame(rows + repeated, "g string, well string, t double, feature string, v double")
        build = lambda: feature_matrix(frame, "g", "well", "t", "feature", "v")  # noqa: B023, E731
        if repeated[0][-1] is None:  # an empty cell beside a value is no second value
            assert build().cells.count() == 24
        else:
            with pytest.raises(Exception, match="twice at one timepoint"):
                gram(build().cells).collect()


def test_unknown_correlation(analyzed):
    with pytest.raises(ValueError):
        correlation(analyzed[1].matrix, "pearsn")


def test_source_is_computed_once(spark):
    rng = np.random.default_rng(4)
    rows = [("g", w, float(t), f, float(rng.normal())) for w in "AB" for t in range(30) for f in "xyz"]
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    schema = "g string, well string, t double, feature string, v double"
    feature_matrix(spark.createDataFrame(rows, schema).mapInPandas(look, schema), "g", "well", "t", "feature", "v")
    assert seen.value == len(rows)


def test_chunks_of_narrow_groups_are_packed_together(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(2, 3, 700))
    v[0, 1, 100:140] = 0  # two chunks without a value of this feature ...
    v[1, :, 200:300] = 0  # ... and five of a group without any
    rows = [(g, r, 3, 700, k // 20, k % 20, float(v[i, r, k])) for i, g in enumerate("ab") for r in range(3) for k in range(700) if v[i, r, k]]
    cells = spark.createDataFrame(rows, "g string, r int, nf int, n_obs long, chunk int, pos int, v double").repartition(3)
    found = {row.g: row for row in gram(cells).collect()}
    for i, g in enumerate("ab"):
        assert np.allclose(np.frombuffer(found[g].mat).reshape(3, 3), v[i] @ v[i].T)
        assert np.allclose(np.frombuffer(found[g].sum_p), v[i].sum(axis=1)) and found[g].n_obs == 700
