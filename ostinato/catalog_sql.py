"""The queries of the catalog in plain SQL over the same tables, as a second opinion.

Formulas are spelled out rather than shared with the Spark side: residuals are summed
row by row, ranks and rolling means use SQL windows, matrix products are joins."""

from __future__ import annotations

MEASURES = "l_quantity, l_extendedprice, l_discount, l_tax"

_MONTH = "(year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1"

CELLS = f"""
cells AS (SELECT l_suppkey AS well, CAST({_MONTH} AS INTEGER) AS tp, {MEASURES} FROM lineitem),
long AS (SELECT * FROM (UNPIVOT cells ON {MEASURES} INTO NAME feature VALUE value))"""

MONTHLY = f"""{CELLS},
monthly AS (SELECT well, tp, feature, avg(value) AS mean FROM long GROUP BY well, tp, feature)"""

PLATEMAP = """
platemap AS (SELECT s_suppkey AS well, r_name AS region, n_name AS nation, 6.0::DOUBLE + 3.0::DOUBLE * (s_suppkey % 3) AS cycle
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

HOURLY = """
hourly AS (SELECT event_type, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts) AS hour, avg(value) AS mean
  FROM events GROUP BY ALL)"""

STATS = ("mean", "median", "stddev", "q0", "q10", "q25", "q50", "q75", "q90", "q100")


def _summary(keys: str, source: str) -> str:
    quantiles = ", ".join(
        f"quantile_cont(value, {p}) AS {n}"
        for n, p in (("q0", 0), ("q10", 0.1), ("q25", 0.25), ("q50", 0.5), ("q75", 0.75), ("q90", 0.9), ("q100", 1))
    )
    return (
        f"SELECT {keys}, feature, avg(value) AS mean, median(value) AS median, stddev_samp(value) AS stddev, "
        f"{quantiles} FROM {source} GROUP BY {keys}, feature"
    )


def _by_scale(c: str, feature: str = "feature") -> str:
    return f"CASE WHEN {feature} = 'l_extendedprice' THEN round({c}, 6) ELSE round({c}, 8) END + 0.0"


def _stats(keys: str, source: str) -> str:
    return f"SELECT {keys}, feature, " + ", ".join(f"{_by_scale(s)} AS {s}" for s in STATS) + f" FROM {source}"


def _detrend(source: str, keys: str, stats: tuple[str, ...], out: str, window: int = 9) -> str:
    """CTEs that subtract the twice averaged signal."""
    half = (window - 1) // 2
    over = f"(PARTITION BY {keys} ORDER BY tp ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"

    def smooth(c: str) -> str:
        return f"CASE WHEN count({c}) OVER {over} = {window} THEN avg({c}) OVER {over} END"

    one = ", ".join(f"{smooth(s)} AS {s}_1" for s in stats)
    two = ", ".join(f"{smooth(s + '_1')} AS {s}_2" for s in stats)
    clean = ", ".join(f"{s} - {s}_2 AS {s}" for s in stats)
    full = " AND ".join(f"{s} IS NOT NULL" for s in stats if s != "stddev")
    return f"""
{out}_1 AS (SELECT *, {one} FROM {source}),
{out}_2 AS (SELECT *, {two} FROM {out}_1),
{out} AS (SELECT * FROM (SELECT {keys}, tp, {clean} FROM {out}_2) WHERE {full})"""


def _fit(source: str, keys: str, period: str, t: str = "tp", y: str = "mean") -> str:
    """CTEs ending in ``fit``: cosinor of every series, residuals summed in a second pass."""
    on = " AND ".join(f"p.{k} = c.{k}" for k in keys.split(", "))
    pk = ", ".join(f"p.{k}" for k in keys.split(", "))
    return f"""
points AS (SELECT {keys}, {t} AS t, {y} AS y, {period} AS period,
    cos(2 * pi() * {t} / {period}) AS c, sin(2 * pi() * {t} / {period}) AS s FROM {source}),
moments AS (SELECT {keys}, count(*) AS n, avg(y) AS my, avg(c) AS mc, avg(s) AS ms, var_pop(c) AS cc, var_pop(s) AS ss,
    covar_pop(c, s) AS cs, covar_pop(y, c) AS yc, covar_pop(y, s) AS ys, min(y) AS low, max(y) AS high
    FROM points GROUP BY {keys}),
slopes AS (SELECT *, (yc * ss - ys * cs) / (cc * ss - cs * cs) AS a, (ys * cc - yc * cs) / (cc * ss - cs * cs) AS b
    FROM moments WHERE n > 3 AND cc * ss - cs * cs > 1e-12 AND (low <> 0 OR high <> 0)),
coef AS (SELECT *, my - a * mc - b * ms AS m FROM slopes),
squares AS (SELECT {pk}, max(p.period) AS period, max(c.n) AS n, max(c.m) AS m, max(c.a) AS a, max(c.b) AS b,
    sum(power(p.y - c.m - c.a * p.c - c.b * p.s, 2)) AS ss1, sum(power(p.y - c.my, 2)) AS ss0
    FROM points p JOIN coef c ON {on} GROUP BY {pk}),
fit AS (SELECT {keys}, period, m AS baseline, sqrt(a * a + b * b) AS amplitude,
    CASE WHEN atan2(b, a) < 0 THEN atan2(b, a) + 2 * pi() ELSE atan2(b, a) END AS phase,
    power(ss1 / ss0, (n - 3) / 2.0) AS p_value, ((ss0 - ss1) / 2) / (ss1 / (n - 3)) AS f_stat, ss1, ss0 FROM squares)"""


_FIT_COLUMNS = """well, feature, 'mean' AS stat, round(baseline, 4) + 0.0 AS baseline, round(amplitude, 4) + 0.0 AS amplitude,
  round(phase, 5) + 0.0 AS phase, round(phase / (2 * pi()) * period, 5) + 0.0 AS phase_hours, round(p_value, 8) + 0.0 AS p_value,
  round(f_stat, 5) + 0.0 AS f_stat, round(ln(ss1), 6) + 0.0 AS log_ss_model, round(ln(ss0), 6) + 0.0 AS log_ss_null"""

_BH = "least(1, min(p_value * m / r) OVER (PARTITION BY {g} ORDER BY p_value DESC, r DESC ROWS UNBOUNDED PRECEDING))"


def _ranked(source: str, group: str) -> str:
    part = f"PARTITION BY {group}" if group else ""
    return f"""
ranked AS (SELECT *, row_number() OVER ({part} ORDER BY p_value) AS r, count(*) OVER ({part}) AS m FROM {source})"""


def _corrected(expr: str, group: str = "region", more: str = "") -> str:
    """Correction of the monthly cosinor p-values; ``expr`` may use p_value, r and m."""
    return f"""WITH {MONTHLY}, {PLATEMAP}, {_fit("monthly", "well, feature", "12")},
joined AS (SELECT fit.well, feature, p_value, region FROM fit LEFT JOIN platemap USING (well)),
{_ranked("joined", group)}{more}
SELECT well, feature, region, round({expr}, 7) + 0.0 AS p_adjusted FROM {"final" if more else "ranked"}"""


def _up(expr: str) -> str:
    return f"least(1, min({expr}) OVER (PARTITION BY region ORDER BY p_value DESC, r DESC ROWS UNBOUNDED PRECEDING))"


def _down(expr: str) -> str:
    return f"least(1, max({expr}) OVER (PARTITION BY region ORDER BY p_value, r ROWS UNBOUNDED PRECEDING))"


def _two_stage(spread: float) -> str:
    more = f""",
first AS (SELECT *, {_up("p_value * m / r")} AS bh FROM ranked),
hits AS (SELECT region, count(*) FILTER (WHERE bh <= 0.05 / {spread}) AS hit, max(m) AS tests FROM first GROUP BY region),
final AS (SELECT first.*, least(1, bh * {spread} * CASE WHEN hit IN (0, tests) THEN 1 ELSE (tests - hit) * 1.0 / tests END) AS adj
  FROM first JOIN hits USING (region))"""
    return _corrected("adj", more=more)


_HOMMEL = """,
subset AS (SELECT a.region, s.s AS s, min(s.s * a.p_value / (a.r - (a.m - s.s))) AS simes
  FROM ranked a, LATERAL (SELECT unnest(range(2, a.m + 1)) AS s) s WHERE a.r > a.m - s.s GROUP BY a.region, s.s),
final AS (SELECT a.well, a.feature, a.region, least(1, greatest(max(a.p_value),
    max(CASE WHEN s.s >= a.m - a.r + 1 THEN simes ELSE least(s.s * a.p_value, simes) END))) AS adj
  FROM ranked a JOIN subset s USING (region) GROUP BY a.well, a.feature, a.region)"""

EMBEDDED = """
raw AS (SELECT CAST(label AS VARCHAR) AS label, vec_id, unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
z AS (SELECT label, vec_id, printf('d%02d', dim) AS dim,
    (x - avg(x) OVER w) / stddev_samp(x) OVER w AS z FROM raw WINDOW w AS (PARTITION BY label, dim))"""


def _pairs(value: str) -> str:
    """CTE ``r``: correlation of column ``value`` of frame ``x`` for all dimension pairs."""
    return f"""
r AS (SELECT a.label, a.dim AS a, b.dim AS b, corr(a.{value}, b.{value}) AS r FROM x a JOIN x b
  ON a.label = b.label AND a.vec_id = b.vec_id AND a.dim < b.dim GROUP BY a.label, a.dim, b.dim)"""


PEARSON = f"{EMBEDDED}, x AS (SELECT * FROM z), {_pairs('z')}"
_PAIR = "label, a AS feature_a, b AS feature_b"


def _adjacent(weight: str) -> str:
    return f"""WITH {PEARSON} SELECT {_PAIR}, round({weight}, 6) + 0.0 AS w FROM r"""


def _both(weight: str) -> str:
    return f"both_ways AS (SELECT label, a AS i, b AS j, {weight} AS w FROM r UNION ALL SELECT label, b, a, {weight} FROM r)"


_DCT = f"""{MONTHLY}, {PLATEMAP},
numbered AS (SELECT well, feature, region, mean AS x, row_number() OVER s - 1 AS i, count(*) OVER (PARTITION BY well, feature) AS n
  FROM monthly JOIN platemap USING (well) WINDOW s AS (PARTITION BY well, feature ORDER BY tp)),
spectrum AS (SELECT well, feature, region, k, 2.0 * n / k AS period,
    abs(sum(x * cos(pi() * (2 * i + 1) * k / (2.0 * n)))) * sqrt(2.0 / n) AS amplitude
  FROM numbered, LATERAL (SELECT unnest(range(1, n)) AS k) WHERE 2 * n >= 6 * k AND 2 * n <= 24 * k GROUP BY well, feature, region, n, k),
best AS (SELECT well, feature, region, period AS detected_period FROM spectrum
  QUALIFY row_number() OVER (PARTITION BY well, feature ORDER BY amplitude DESC, k) = 1)"""


def _savgol(window: int, order: int) -> str:
    """Weights of the local polynomial by its normal equations, as a VALUES list."""
    import numpy as np

    x = np.arange(window) - window // 2
    basis = np.vander(x, order + 1, increasing=True).astype(float)
    weights = basis @ np.linalg.solve(basis.T @ basis, basis.T)
    return ", ".join(f"({p}, {q}, {weights[p, q]!r}::DOUBLE)".replace("np.float64(", "").replace(")::", "::") for p in range(window) for q in range(window))


# The monthly means with gaps in one measure and series of zeros, or of nothing, in another.
PATCHY = f"""{MONTHLY},
patchy AS (SELECT well, tp, feature, CASE WHEN feature = 'l_discount' AND well % 10 = 0 THEN 0
    WHEN feature = 'l_tax' AND (well + tp) % 7 = 0 OR feature = 'l_discount' AND well % 10 = 1 THEN NULL ELSE round(mean, 8) END AS mean FROM monthly)"""


def _scores(periods: str, source: str = "monthly") -> str:
    """CTEs ending in ``scores``: Kendall S of every series with every reference cosine."""
    return f"""{PATCHY},
numbered AS (SELECT well, feature, tp, round(mean, 8) AS x, row_number() OVER s - 1 AS i, count(*) OVER (PARTITION BY well, feature) AS n
  FROM {source} WINDOW s AS (PARTITION BY well, feature ORDER BY tp)),
waves AS (SELECT n, period, lag_index, i, cos(i * (2 * 3.1416::DOUBLE / period) + lag_index * (2 * 3.1416::DOUBLE / period) / 2) AS wave
  FROM (SELECT DISTINCT n FROM numbered), (SELECT unnest([{periods}]) AS period),
  LATERAL (SELECT unnest(range(period)) AS lag_index), LATERAL (SELECT unnest(range(n)) AS i)),
ref AS (SELECT *, row_number() OVER (PARTITION BY n, period, lag_index ORDER BY wave) AS rank FROM waves),
patterns AS (SELECT a.n, a.period, a.lag_index, a.i, b.i AS j, sign(a.rank - b.rank) AS c FROM ref a
  JOIN ref b ON a.n = b.n AND a.period = b.period AND a.lag_index = b.lag_index AND a.i > b.i),
pairs AS (SELECT a.well, a.feature, a.n, a.i, b.i AS j, sign(a.x - b.x) AS x FROM numbered a
  JOIN numbered b ON a.well = b.well AND a.feature = b.feature AND a.i > b.i),
scores AS (SELECT well, feature, n, period, lag_index, CAST(coalesce(sum(x * c), 0) AS BIGINT) AS s
  FROM pairs JOIN patterns USING (n, i, j) GROUP BY well, feature, n, period, lag_index)"""


# The null distribution is built order by order from inversion counts; its table is read half a
# step above the score, and one step behind in the upper half if the number of pairs is even.
_JTK = f"""WITH RECURSIVE {_scores("6, 9, 12")},
inversions(size, k, p) AS (SELECT 1, 0, 1.0::DOUBLE UNION ALL
  (SELECT size + 1, CAST(k + j AS INTEGER), sum(p) / (size + 1) FROM inversions, LATERAL (SELECT unnest(range(size + 1)) AS j)
   WHERE size < (SELECT max(n) FROM numbered) GROUP BY size, k + j)),
survival AS (SELECT size AS n, k, sum(p) OVER (PARTITION BY size ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS sv
  FROM inversions WHERE size IN (SELECT DISTINCT n FROM numbered)),
places AS (SELECT *, n * (n - 1) // 2 AS top, (abs(s) + n * (n - 1) // 2 + 1) // 2 AS lo, (abs(s) + n * (n - 1) // 2 + 2) // 2 AS hi FROM scores),
levels AS (SELECT *, lo - CASE WHEN top % 2 = 0 AND lo > top // 2 THEN 1 ELSE 0 END AS llo,
    hi - CASE WHEN top % 2 = 0 AND hi > top // 2 THEN 1 ELSE 0 END AS lhi FROM places),
raw AS (SELECT l.*, CASE WHEN s = 0 THEN 1 WHEN abs(s) >= top THEN 0 ELSE a.sv + coalesce(b.sv, 0) END AS p_value FROM levels l
  LEFT JOIN survival a ON a.n = l.n AND a.k = l.llo LEFT JOIN survival b ON b.n = l.n AND b.k = l.lhi),
adjusted AS (SELECT *, least(1, p_value * count(*) OVER w) AS adj FROM raw WINDOW w AS (PARTITION BY well, feature)),
tied AS (SELECT *, CASE WHEN s < 0 THEN -1 ELSE 1 END AS side FROM adjusted QUALIFY adj = min(adj) OVER (PARTITION BY well, feature)),
cycles AS (SELECT well, feature, period, i, x FROM numbered, (SELECT unnest([6, 9, 12]) AS period) WHERE i < n // period * period),
centre AS (SELECT a.well, a.feature, a.period, median((a.x + b.x) / 2) AS c FROM cycles a JOIN cycles b
  ON a.well = b.well AND a.feature = b.feature AND a.period = b.period AND a.i >= b.i GROUP BY a.well, a.feature, a.period),
facing AS (SELECT t.well, t.feature, t.period, t.lag_index, d.i, t.side * sqrt(2) * (d.x - c.c) * sign(v.wave) AS z FROM tied t
  JOIN cycles d ON d.well = t.well AND d.feature = t.feature AND d.period = t.period
  JOIN centre c ON c.well = t.well AND c.feature = t.feature AND c.period = t.period
  JOIN waves v ON v.n = t.n AND v.period = t.period AND v.lag_index = t.lag_index AND v.i = d.i),
amplitudes AS (SELECT a.well, a.feature, a.period, a.lag_index, median((a.z + b.z) / 2) AS amplitude FROM facing a JOIN facing b
  ON a.well = b.well AND a.feature = b.feature AND a.period = b.period AND a.lag_index = b.lag_index AND a.i >= b.i
  GROUP BY a.well, a.feature, a.period, a.lag_index),
best AS (SELECT t.*, amplitude FROM tied t JOIN amplitudes USING (well, feature, period, lag_index)
  QUALIFY row_number() OVER (PARTITION BY well, feature ORDER BY amplitude DESC, period, lag_index) = 1),
base AS (SELECT a.well, a.feature, median((a.x + b.x) / 2) AS baseline FROM numbered a JOIN numbered b
  ON a.well = b.well AND a.feature = b.feature AND a.i >= b.i GROUP BY a.well, a.feature),
refit AS (SELECT well, feature, var_pop(c) AS cc, var_pop(s) AS ss, covar_pop(c, s) AS cs, covar_pop(x, c) AS yc, covar_pop(x, s) AS ys, var_pop(x) AS yy,
    avg(x) AS my, avg(c) AS mc, avg(s) AS ms, (max(tp) - min(tp)) / any_value(period)::DOUBLE AS cycles
  FROM (SELECT m.well, m.feature, m.x, m.tp, b.period, cos(2 * pi() * m.tp / b.period) AS c, sin(2 * pi() * m.tp / b.period) AS s FROM numbered m
    JOIN best b ON m.well = b.well AND m.feature = b.feature) GROUP BY well, feature),
slopes AS (SELECT *, (yc * ss - ys * cs) / (cc * ss - cs * cs) AS a, (ys * cc - yc * cs) / (cc * ss - cs * cs) AS b FROM refit),
found AS (SELECT *, my - a * mc - b * ms AS m, (period + (1 - side) * period / 4.0::DOUBLE - lag_index / 2.0::DOUBLE) % period AS lag,
    CASE WHEN atan2(b, a) < 0 THEN atan2(b, a) + 2 * pi() ELSE atan2(b, a) END AS phase
  FROM best JOIN base USING (well, feature) JOIN slopes USING (well, feature))"""

_JTK_TABLE = f"""{_JTK}
SELECT well, feature, round(p_value, 8) + 0.0 AS p_value, round(adj, 8) + 0.0 AS jtk_corrected_p, period::DOUBLE AS period,
  lag AS jtk_phase_hours,
  round(greatest(0, amplitude), 5) + 0.0 AS jtk_amplitude, round(abs(s) / top, 8) + 0.0 AS tau, round(baseline, 10) + 0.0 AS jtk_baseline,
  round(m, 5) + 0.0 AS lsq_baseline, round(sqrt(a * a + b * b), 5) + 0.0 AS lsq_amplitude, round(phase / (2 * pi()) * period, 5) + 0.0 AS lsq_phase_hours,
  round(cycles, 7) + 0.0 AS lsq_n_cycles, round((a * yc + b * ys) / yy, 7) + 0.0 AS lsq_r_squared
FROM found"""


def _clear(c: str) -> str:
    return f"CASE WHEN feature = 'l_extendedprice' THEN round({c} + 1.7e-9::DOUBLE, 6) ELSE round({c} + 1.7e-9::DOUBLE, 8) END + 0.0"


_JTK_CURVES = f"""{_JTK}
SELECT well, feature, CAST(i AS INTEGER) AS place,
  {_clear("baseline + greatest(0, amplitude) * cos(2 * pi() * (tp - lag) / period)")} AS jtk_fitted,
  {_clear("m + a * cos(2 * pi() * tp / period) + b * sin(2 * pi() * tp / period)")} AS lsq_fitted
FROM numbered JOIN found USING (well, feature)"""

_REDUNDANT = """WITH RECURSIVE {pearson},
near AS (SELECT label, CAST(substr(a, 2) AS INTEGER) AS i, list(CAST(substr(b, 2) AS INTEGER)) AS js FROM r WHERE abs(r) > 0.4 GROUP BY label, a),
walk(label, i, taken, claims) AS (SELECT DISTINCT label, -1, []::INTEGER[], []::INTEGER[] FROM r UNION ALL
  SELECT w.label, w.i + 1, list_concat(w.taken, c.fresh), c.fresh FROM walk w LEFT JOIN near n ON n.label = w.label AND n.i = w.i + 1,
  LATERAL (SELECT CASE WHEN n.js IS NULL OR list_contains(w.taken, w.i + 1) THEN []::INTEGER[]
    ELSE list_filter(n.js, lambda j: NOT list_contains(w.taken, j)) END AS fresh) c WHERE w.i < 63)
SELECT label, printf('d%02d', unnest(claims)) AS feature, printf('d%02d', i) AS representative_feature FROM walk"""


# Direct sums: at every time the signal is multiplied with the wavelet shifted there.
_WAVELET = f"""WITH {HOURLY},
numbered AS (SELECT event_type, hour, mean - avg(mean) OVER w AS x, var_pop(mean) OVER w AS variance,
    row_number() OVER (PARTITION BY event_type ORDER BY hour) - 1 AS i FROM hourly WINDOW w AS (PARTITION BY event_type)),
axis AS (SELECT k, 12 + k * 36.0::DOUBLE / 199 AS period, (2 * pi() + sqrt(2 + 4 * pi() * pi())) * (12 + k * 36.0::DOUBLE / 199) / (4 * pi()) AS scale
  FROM (SELECT unnest(range(200)) AS k)),
size AS (SELECT max(i) + 1 AS longest FROM numbered),
lags AS (SELECT unnest(range(1 - (SELECT longest FROM size), (SELECT longest FROM size))) AS lag),
waves AS (SELECT k, list(exp(-0.5 * power(lag / scale, 2)) * cos(2 * pi() * lag / scale) / (power(pi(), 0.25) * sqrt(scale)) ORDER BY lag DESC) AS re,
    list(exp(-0.5 * power(lag / scale, 2)) * sin(2 * pi() * lag / scale) / (power(pi(), 0.25) * sqrt(scale)) ORDER BY lag DESC) AS im
  FROM axis, lags GROUP BY k),
signals AS (SELECT event_type, list(x ORDER BY i) AS xs, count(*) AS n FROM numbered GROUP BY event_type),
spectrum AS MATERIALIZED (SELECT a.event_type, a.i, a.hour, a.variance, w.k,
    list_inner_product(w.re[longest - a.i:longest - a.i + n - 1], xs) AS re,
    list_inner_product(w.im[longest - a.i:longest - a.i + n - 1], xs) AS im
  FROM numbered a JOIN signals USING (event_type), waves w, size),
powers AS (SELECT s.*, period, scale, (re * re + im * im) / variance AS power FROM spectrum s JOIN axis USING (k)),
ridge AS (SELECT event_type, 'events' AS name, CAST(hour AS INTEGER) AS time, period AS periods, i,
    CASE WHEN atan2(im, re) < 0 THEN atan2(im, re) + 2 * pi() ELSE atan2(im, re) END AS phase,
    sqrt(re * re + im * im) * sqrt(2 / scale) / power(pi(), 0.25) AS amplitude, power
  FROM powers QUALIFY row_number() OVER (PARTITION BY event_type, i ORDER BY power DESC, k) = 1),
fourier AS (SELECT event_type, 'events' AS name, k, any_value(period) AS period, avg(power) AS power FROM powers GROUP BY event_type, k)"""


def _wavelet(metrics: str, tail: str) -> str:
    return f"{_WAVELET} SELECT {metrics} {tail}"


#: What a linkage makes of the item distances u between two clusters; w is an item's weight in its cluster.
_LINKAGES = {"average": "sum(u)::DOUBLE / count(*)", "single": "min(u)::DOUBLE", "complete": "max(u)::DOUBLE", "weighted": "sum(x.w * y.w * u)"}


def _tree(name: str, items: str, dist: str, linkage: str = "average") -> str:
    """CTE ``name``: every state of the clustering of ``items`` (g, item) under whole-number
    distances ``dist`` (g, i, j, u, both ways); ties by the clusters' numbers."""
    return f"""
{name}(g, step, height, item, cluster, w) AS (SELECT g, 0, -1.0::DOUBLE, item, item, 1.0::DOUBLE FROM {items} UNION ALL
  SELECT c.g, c.step + 1, b.best.d, c.item, CASE WHEN c.cluster = b.best.cb THEN b.best.ca ELSE c.cluster END,
    CASE WHEN c.cluster IN (b.best.ca, b.best.cb) THEN c.w / 2 ELSE c.w END
  FROM {name} c JOIN (SELECT g, min({{'d': d, 'ca': ca, 'cb': cb}}) AS best FROM (
      SELECT x.g, x.cluster AS ca, y.cluster AS cb, {_LINKAGES[linkage]} / power(2.0::DOUBLE, 40) AS d
      FROM {name} x JOIN {name} y ON x.g = y.g AND x.cluster < y.cluster JOIN {dist} e ON e.g = x.g AND e.i = x.item AND e.j = y.item
      GROUP BY x.g, x.cluster, y.cluster) GROUP BY g) b ON b.g = c.g)"""


def _network(source: str, size: int, power: int, merge: float = 0.25, linkage: str = "average") -> str:
    """CTEs of a module analysis of ``source`` (g, obs, feature, z)."""
    units = "CAST(round({d} * power(2.0::DOUBLE, 40)) AS BIGINT)"

    def loadings(tag: str, labels: str) -> str:
        return f"""
inside_{tag} AS (SELECT c.g, a.module, c.i, c.j, c.cov FROM cov c JOIN {labels} a ON a.g = c.g AND a.item = c.i
  JOIN {labels} b ON b.g = c.g AND b.item = c.j AND a.module = b.module WHERE a.module > 0),
squared_{tag}(g, module, i, j, m, round) AS (SELECT g, module, i, j, cov / sum(cov * cov) OVER (PARTITION BY g, module), 0 FROM inside_{tag} UNION ALL
  SELECT g, module, i, j, m / sqrt(sum(m * m) OVER (PARTITION BY g, module)), round FROM (
    SELECT a.g, a.module, a.i, b.j, sum(a.m * b.m) AS m, any_value(a.round) + 1 AS round FROM squared_{tag} a JOIN squared_{tag} b
      ON a.g = b.g AND a.module = b.module AND a.j = b.i WHERE a.round < 22 GROUP BY a.g, a.module, a.i, b.j)),
raw_{tag} AS (SELECT g, module, i AS item, sum(m) AS u FROM squared_{tag} WHERE round = 22 GROUP BY g, module, i),
load_{tag} AS (SELECT g, module, item, u / sqrt(sum(u * u) OVER w) * sign(sum(u) OVER w) AS u FROM raw_{tag} WINDOW w AS (PARTITION BY g, module)),
scale_{tag} AS (SELECT s.*, ev / trace AS explained FROM (SELECT c.g, c.module, sum(a.u * b.u * c.cov) AS ev, sum(CASE WHEN c.i = c.j THEN c.cov END) AS trace
  FROM inside_{tag} c JOIN load_{tag} a ON a.g = c.g AND a.module = c.module AND a.item = c.i
  JOIN load_{tag} b ON b.g = c.g AND b.module = c.module AND b.item = c.j GROUP BY c.g, c.module) s)"""
    # the leading component is what the matrix, squared again and again, makes of ones
    return f"""
sized AS (SELECT g, count(DISTINCT obs) AS n FROM {source} GROUP BY g),
useful AS (SELECT g, feature, dense_rank() OVER (PARTITION BY g ORDER BY feature) - 1 AS item, sum(z) AS total FROM {source} GROUP BY g, feature HAVING var_pop(z) > 0),
spots AS (SELECT s.g, item, obs, z FROM {source} s JOIN useful u ON u.g = s.g AND u.feature = s.feature WHERE z IS NOT NULL),
dots AS (SELECT a.g, a.item AS i, b.item AS j, sum(a.z * b.z) AS dot FROM spots a JOIN spots b ON a.g = b.g AND a.obs = b.obs GROUP BY a.g, a.item, b.item),
cov AS (SELECT p.g, p.item AS i, q.item AS j, coalesce(dot, 0) / n - p.total * q.total / n / n AS cov FROM useful p JOIN useful q ON p.g = q.g
  JOIN sized t ON t.g = p.g LEFT JOIN dots d ON d.g = p.g AND d.i = p.item AND d.j = q.item),
corr AS (SELECT c.g, c.i, c.j, c.cov / sqrt(a.cov * b.cov) AS r FROM cov c JOIN cov a ON a.g = c.g AND a.i = c.i AND a.j = c.i
  JOIN cov b ON b.g = c.g AND b.i = c.j AND b.j = c.j WHERE c.i <> c.j),
links AS (SELECT g, i, j, power((1 + r) / 2, {power}) AS w FROM corr),
degrees AS (SELECT g, i, sum(w) AS k FROM links GROUP BY g, i),
paths AS (SELECT x.g, x.i, y.i AS j, sum(x.w * y.w) AS l FROM links x JOIN links y ON x.g = y.g AND x.j = y.j AND x.i <> y.i GROUP BY x.g, x.i, y.i),
tom AS (SELECT e.g, e.i, e.j, least(greatest((coalesce(s.l, 0) + e.w) / (least(p.k, q.k) + 1 - e.w), 0), 1) AS tom FROM links e
  LEFT JOIN paths s ON s.g = e.g AND s.i = e.i AND s.j = e.j JOIN degrees p ON p.g = e.g AND p.i = e.i JOIN degrees q ON q.g = e.g AND q.i = e.j),
apart AS (SELECT g, i, j, {units.format(d="(1 - tom)")} AS u FROM tom),
listed AS (SELECT g, item FROM useful),
{_tree("tree", "listed", "apart", linkage).strip()},
grid AS (SELECT k, 0.1::DOUBLE + k * (0.99::DOUBLE - 0.1::DOUBLE) / 34 AS h FROM (SELECT unnest(range(35)) AS k)),
levels AS (SELECT g, k, max(step) AS step FROM (SELECT DISTINCT g, step, height FROM tree), grid WHERE height <= h GROUP BY g, k),
found AS (SELECT l.g, l.k, l.step, t.cluster, count(*) AS n FROM levels l JOIN tree t ON t.g = l.g AND t.step = l.step GROUP BY ALL),
chosen AS (SELECT g, step FROM (SELECT g, k, any_value(step) AS step, count(*) FILTER (WHERE n >= {size}) AS many FROM found GROUP BY g, k)
  QUALIFY row_number() OVER (PARTITION BY g ORDER BY many DESC, k) = 1),
first_labels AS (SELECT t.g, t.item, CASE WHEN count(*) OVER (PARTITION BY t.g, t.cluster) >= {size} THEN t.cluster END AS c FROM tree t JOIN chosen USING (g, step)),
parts AS (SELECT g, item, CASE WHEN c IS NULL THEN 0 ELSE dense_rank() OVER (PARTITION BY g ORDER BY c NULLS LAST) END AS module FROM first_labels),
{loadings("one", "parts").strip()},
alike AS (SELECT c.g, a.module AS i, b.module AS j, 1 - abs(sum(a.u * b.u * c.cov) / sqrt(any_value(x.ev * y.ev))) AS d FROM cov c
  JOIN load_one a ON a.g = c.g AND a.item = c.i JOIN load_one b ON b.g = c.g AND b.item = c.j AND a.module <> b.module
  JOIN scale_one x ON x.g = a.g AND x.module = a.module JOIN scale_one y ON y.g = b.g AND y.module = b.module GROUP BY c.g, a.module, b.module),
near AS (SELECT g, i, j, {units.format(d="d")} AS u FROM alike),
mods AS (SELECT DISTINCT g, module AS item FROM parts WHERE module > 0),
{_tree("joins", "mods", "near").strip()},
target AS (SELECT g, item AS module, cluster FROM joins WHERE height <= {merge} QUALIFY step = max(step) OVER (PARTITION BY g)),
regrouped AS (SELECT p.g, p.item, t.cluster, min(p.item) OVER (PARTITION BY p.g, t.cluster) AS first FROM parts p LEFT JOIN target t USING (g, module)),
labels AS (SELECT g, item, CASE WHEN cluster IS NULL THEN 0 ELSE dense_rank() OVER (PARTITION BY g ORDER BY CASE WHEN cluster IS NOT NULL THEN first END NULLS LAST) END AS module FROM regrouped),
{loadings("two", "labels").strip()},
members AS (SELECT l.g, u.feature, l.module, sqrt(s.ev) * d.u / sqrt(v.cov) AS kme, s.explained FROM labels l JOIN useful u USING (g, item)
  LEFT JOIN load_two d ON d.g = l.g AND d.item = l.item LEFT JOIN scale_two s ON s.g = l.g AND s.module = l.module
  LEFT JOIN cov v ON v.g = l.g AND v.i = l.item AND v.j = l.item),
scores AS (SELECT o.g, o.obs, d.module, coalesce(sum(d.u * c.z), 0) - sum(d.u * u.total) / any_value(n) AS score
  FROM (SELECT DISTINCT g, obs FROM {source}) o JOIN sized USING (g) JOIN load_two d ON d.g = o.g JOIN useful u ON u.g = o.g AND u.item = d.item
  LEFT JOIN spots c ON c.g = o.g AND c.obs = o.obs AND c.item = d.item GROUP BY o.g, o.obs, d.module)"""


def _modules(linkage: str = "average") -> str:
    source = "source AS (SELECT label AS g, vec_id AS obs, dim AS feature, z FROM z)"
    return f"""WITH RECURSIVE {EMBEDDED}, {source},{_network("source", 3, 2, linkage=linkage)}"""


def _linked(linkage: str) -> str:
    return f"{_modules(linkage)} SELECT g AS label, feature, module FROM parts JOIN useful USING (g, item)"


_MODULES = _modules()


def _eigengene_rhythm() -> str:
    clean = _detrend("monthly", "well, feature", ("mean",), "clean")
    return f"""WITH RECURSIVE {MONTHLY}, {PLATEMAP}, {clean},
source AS (SELECT region AS g, {{'well': well, 'tp': tp}} AS obs, feature, (mean - avg(mean) OVER w) / nullif(stddev_samp(mean) OVER w, 0) AS z
  FROM clean JOIN platemap USING (well) WINDOW w AS (PARTITION BY well, feature)),{_network("source", 2, 1)},
eigen AS (SELECT obs.well AS well, obs.tp AS tp, 'Module_' || module AS feature, score AS value FROM scores),
{_fit("eigen", "well, feature", "12", y="value")}, {_ranked("fit", "")}
SELECT {_FIT_COLUMNS.replace("'mean'", "'eigengene'")}, round({_BH.format(g="1")}, 8) + 0.0 AS p_adjusted FROM ranked"""


def catalog_sql() -> dict[str, str]:
    means = _detrend("monthly", "well, feature", ("mean",), "clean")
    return {
        "cell_summary": f"WITH {CELLS}, stats AS ({_summary('well, tp', 'long')}) {_stats('well, tp', 'stats')}",
        "cell_summary_multikey": f"""WITH cells AS (SELECT l_returnflag, l_linestatus, CAST({_MONTH} AS INTEGER) AS tp, {MEASURES} FROM lineitem),
long AS (SELECT * FROM (UNPIVOT cells ON {MEASURES} INTO NAME feature VALUE value)),
stats AS ({_summary("l_returnflag, l_linestatus, tp", "long")}) {_stats("l_returnflag, l_linestatus, tp", "stats")}""",
        "detrend_two_pass": f"""WITH {CELLS}, stats AS ({_summary("well, tp", "long")}),
{_detrend("stats", "well, feature", STATS, "clean")} {_stats("well, tp", "clean")}""",
        "retrieve_wells": "SELECT DISTINCT l_suppkey AS well FROM lineitem",
        "zscore_per_well": f"""WITH {MONTHLY} SELECT well, tp, feature,
round((mean - avg(mean) OVER w) / stddev_samp(mean) OVER w, 6) + 0.0 AS z FROM monthly WINDOW w AS (PARTITION BY well, feature)""",
        "cosinor_fit": f"WITH {MONTHLY}, {_fit('monthly', 'well, feature', '12')} SELECT {_FIT_COLUMNS} FROM fit",
        "cosinor_time_range": f"""WITH {MONTHLY}, ranged AS (SELECT * FROM monthly WHERE tp BETWEEN 12 AND 59),
{_fit("ranged", "well, feature", "12")} SELECT {_FIT_COLUMNS} FROM fit""",
        "cosinor_multiperiod": f"""WITH {MONTHLY}, {PLATEMAP}, timed AS (SELECT * FROM monthly JOIN platemap USING (well)),
{_fit("timed", "well, feature", "cycle")}, joined AS (SELECT fit.*, region FROM fit LEFT JOIN platemap USING (well)),
{_ranked("joined", "region")}
SELECT {_FIT_COLUMNS}, period, region, round({_BH.format(g="region")}, 8) + 0.0 AS p_adjusted FROM ranked""",
        "detrended_significant": f"""WITH {MONTHLY}, {PLATEMAP}, {means}, {_fit("clean", "well, feature", "12")},
joined AS (SELECT fit.*, region, nation FROM fit LEFT JOIN platemap USING (well)), {_ranked("joined", "region")},
adjusted AS (SELECT *, {_BH.format(g="region")} AS adj FROM ranked)
SELECT {_FIT_COLUMNS}, region, nation, round(adj, 8) + 0.0 AS p_adjusted FROM adjusted WHERE adj <= 0.9""",
        "cosinor_fitted_long": f"""WITH hours AS (SELECT event_type, 'value' AS feature, hour(ts) AS tp, avg(value) AS mean FROM events GROUP BY ALL),
{_fit("hours", "event_type, feature", "24")}
SELECT p.event_type, p.feature, CAST(p.t AS INTEGER) AS hour, round(c.m + c.a * p.c + c.b * p.s, 6) + 0.0 AS fitted
FROM points p JOIN coef c ON p.event_type = c.event_type AND p.feature = c.feature""",
        "cosinor_overlay": f"""WITH {MONTHLY}, shifted AS (SELECT well, feature, tp + 6 AS tp, mean FROM monthly),
{_fit("shifted", "well, feature", "12")}
SELECT p.well, p.feature, round(p.t::DOUBLE, 6) AS hours, {_by_scale("p.y", "p.feature")} AS value,
  {_by_scale("c.m + c.a * p.c + c.b * p.s", "p.feature")} AS fitted
FROM points p JOIN coef c ON p.well = c.well AND p.feature = c.feature""",
        "bh_global": _corrected(_BH.format(g="1"), group=""),
        "bh_grouped": _corrected(_BH.format(g="region")),
        "bonferroni": _corrected("least(1, p_value * m)"),
        "sidak": _corrected("1 - power(1 - p_value, m)"),
        "holm": _corrected(_down("p_value * (m - r + 1)")),
        "holm_sidak": _corrected(_down("1 - power(1 - p_value, m - r + 1)")),
        "hochberg": _corrected(_up("p_value * (m - r + 1)")),
        "fdr_by": _corrected(_up("p_value * m / r * list_sum(list_transform(range(1, m + 1), lambda i: 1.0::DOUBLE / i))")),
        "hommel": _corrected("adj", more=_HOMMEL),
        "fdr_two_stage_bh": _two_stage(1.0),
        "fdr_two_stage_bky": _two_stage(1.05),
        "platemap_left_join": f"""WITH {MONTHLY}, {PLATEMAP} SELECT region, nation, count(*) AS n, round(avg(mean), 3) AS mean
FROM monthly LEFT JOIN (SELECT * FROM platemap WHERE region <> 'ASIA') USING (well) GROUP BY region, nation""",
        "platemap_inner_join": f"""WITH {MONTHLY}, {PLATEMAP} SELECT region, feature, count(*) AS n, round(avg(mean), 3) AS mean
FROM monthly JOIN (SELECT * FROM platemap WHERE region <> 'ASIA') USING (well) GROUP BY region, feature""",
        "feature_with_platemap": f"""WITH {MONTHLY}, {PLATEMAP} SELECT well, tp, feature, round(mean, 8) AS mean, region, nation, cycle
FROM monthly LEFT JOIN platemap USING (well) WHERE feature = 'l_quantity'""",
        "assembled_matrix": f"""WITH {MONTHLY}, {PLATEMAP}, z AS (SELECT well, tp, feature,
(mean - avg(mean) OVER w) / stddev_samp(mean) OVER w AS z FROM monthly WINDOW w AS (PARTITION BY well, feature)),
named AS (SELECT * FROM z JOIN platemap USING (well)),
obs AS (SELECT region, count(DISTINCT (well, tp)) AS n_obs FROM named GROUP BY region)
SELECT region, feature, any_value(n_obs) AS n_obs, round(sum(z), 4) + 0.0 AS total, round(sum(z * z), 4) + 0.0 AS squares
FROM named JOIN obs USING (region) GROUP BY region, feature HAVING var_pop(z) > 0""",
        "sonar_pivot": f"""WITH {CELLS}, yearly AS (SELECT well, feature, tp // 12 AS y, median(value) AS v FROM long GROUP BY ALL)
SELECT well, feature, {", ".join(f"round(max(CASE WHEN y = {y} THEN v END), 4) + 0.0 AS y{y}" for y in range(7))}
FROM yearly GROUP BY well, feature""",
        "well_names": """SELECT n_nationkey, chr(64 + n_regionkey + 1) || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') AS well_name,
n_nationkey * 0.5::DOUBLE AS hours FROM nation""",
        "grid_hours": """WITH steps AS (SELECT epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-01-01') AS s FROM events)
SELECT round_even(s / 3600.0::DOUBLE / 0.5, 0) * 0.5::DOUBLE AS hour, count(*) AS n FROM steps GROUP BY 1""",
        "timepoint_gaps": f"""WITH {HOURLY}, steps AS (SELECT event_type, hour, lag(hour) OVER (PARTITION BY event_type ORDER BY hour) AS prev FROM hourly)
SELECT event_type, CAST(prev AS INTEGER) AS after_hour, CAST(hour AS INTEGER) AS before_hour, CAST(hour - prev - 1 AS INTEGER) AS n_missing,
array_to_string(range(prev + 1, hour), ',') AS missing_hours FROM steps WHERE hour - prev > 1""",
        "harmony_clean": """SELECT chr(CAST(64 + l_suppkey % 16 + 1 AS INTEGER)) || lpad(CAST(l_partkey % 24 + 1 AS VARCHAR), 2, '0') AS "WellName",
(l_linenumber - 1) * 0.5::DOUBLE AS "Timepoint", CAST(l_orderkey AS VARCHAR) AS "Order",
CASE WHEN l_quantity BETWEEN 3 AND 45 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS "Area" FROM lineitem""",
        "report_rows": """SELECT 'u' || user_id AS file, 'B1' AS barcode, event_type AS well, round(value * 100)::DOUBLE AS signal, event_id AS event
FROM events""",
        "report_times": """WITH first AS (SELECT user_id, min(ts) AS t FROM events GROUP BY user_id)
SELECT 'u' || user_id AS file, round_even(date_sub('second', (SELECT min(t) FROM first), t) / 3600.0::DOUBLE / 0.5, 0) * 0.5::DOUBLE AS hour FROM first""",
        "cosinor_heatmap": f"""WITH {MONTHLY}, {_fit("monthly", "well, feature", "12")}, {_ranked("fit", "")},
adjusted AS (SELECT *, {_BH.format(g="1")} AS adj FROM ranked)
SELECT well, feature, round(amplitude, 4) + 0.0 AS amplitude, round(phase, 5) + 0.0 AS phase, round(degrees(phase), 4) + 0.0 AS phase_degrees,
round(adj, 8) + 0.0 AS p_adjusted FROM adjusted WHERE adj <= 0.9""",
        "dct_periods": f"""WITH {_DCT} SELECT well AS "Well", region || ' | ' || feature AS group_label, round(detected_period, 6) + 0.0 AS detected_period
FROM best""",
        "dct_group_summary": f"""WITH {_DCT} SELECT region, feature, region || ' | ' || feature AS group_label, round(avg(detected_period), 6) + 0.0 AS mean_period,
round(median(detected_period), 6) + 0.0 AS median_period, round(stddev_pop(detected_period), 6) + 0.0 AS std_period, count(*) AS n_replicates
FROM best GROUP BY region, feature""",
        "dct_amplitude_profile": f"""WITH {_DCT} SELECT region, feature, round(period, 6) + 0.0 AS period, round(avg(amplitude), 4) + 0.0 AS mean_amplitude,
round(stddev_pop(amplitude), 4) + 0.0 AS std_amplitude FROM spectrum GROUP BY region, feature, spectrum.period""",
        "period_histogram": f"""WITH {_DCT}, ends AS (SELECT feature, min(detected_period) AS low, max(detected_period) AS high,
median(detected_period) AS median FROM best GROUP BY feature),
binned AS (SELECT feature, low, high, median, CAST(least(floor((detected_period - low) / ((high - low) / 20)), 19) AS INTEGER) AS bin
FROM best JOIN ends USING (feature))
SELECT feature, bin, count(*) AS n, round(any_value(low + bin * ((high - low) / 20)), 6) + 0.0 AS bin_start, round(any_value(median), 6) + 0.0 AS median
FROM binned GROUP BY feature, bin""",
        "wavelet_ridge": _wavelet(
            "event_type, name, time, " + ", ".join(f"round({c}, 5) + 0.0 AS {c}" for c in ("periods", "phase", "amplitude", "power")),
            ", round(phase / (2 * pi()) * periods, 5) + 0.0 AS phase_hours FROM ridge",
        ),
        "wavelet_power": _wavelet(
            "event_type, round(period, 6) + 0.0 AS period, count(*) AS n, round(min(power), 6) + 0.0 AS low, round(max(power), 6) + 0.0 AS high",
            "FROM powers GROUP BY event_type, powers.period",
        ),
        "wavelet_fourier": _wavelet("event_type, name, round(period, 6) AS period, round(power, 6) AS power", "FROM fourier"),
        "wavelet_summary": _wavelet(
            "event_type, 'events' AS name, "
            + ", ".join(
                f"round({f}({c}), 5) + 0.0 AS {n}_{m}"
                for m, c in (("period", "periods"), ("amplitude", "amplitude"))
                for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("median", "median"))
            ),
            """, round(max(CASE WHEN i = size // 2 THEN phase END), 5) + 0.0 AS mid_phase, round(any_value(peak), 5) + 0.0 AS peak_fourier_period
FROM ridge JOIN (SELECT event_type, arg_max(period, power) AS peak FROM fourier GROUP BY event_type) USING (event_type)
JOIN (SELECT event_type, count(*) AS size FROM numbered GROUP BY event_type) USING (event_type) GROUP BY event_type""",
        ),
        "ridge_group_stats": _wavelet(
            "name, time, "
            + ", ".join(
                f"round({f}({c}), 5) + 0.0 AS {m}_{n}"
                for m, c in (("periods", "periods"), ("amplitude", "amplitude"), ("phase_hours", "phase / (2 * pi()) * periods"))
                for n, f in (("mean", "avg"), ("std", "stddev_samp"))
            ),
            "FROM ridge GROUP BY name, time",
        ),
        "savgol": f"""WITH {HOURLY}, w(p, q, weight) AS (VALUES {_savgol(13, 3)}),
numbered AS (SELECT event_type, hour, mean, row_number() OVER s - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n
  FROM hourly WINDOW s AS (PARTITION BY event_type ORDER BY hour)),
placed AS (SELECT *, least(greatest(i - 6, 0), n - 13) AS start FROM numbered)
SELECT a.event_type, a.hour::INTEGER AS hour, round(sum(b.mean * w.weight), 6) + 0.0 AS smoothed FROM placed a
JOIN w ON w.p = a.i - a.start JOIN placed b ON b.event_type = a.event_type AND b.i = a.start + w.q GROUP BY a.event_type, a.hour""",
        "hodges_lehmann": f"""WITH {PATCHY} SELECT a.well, a.feature, round(coalesce(median((a.mean + b.mean) / 2), 0) + 1.7e-9::DOUBLE, 7) + 0.0 AS location
FROM patchy a JOIN patchy b ON a.well = b.well AND a.feature = b.feature AND a.tp >= b.tp GROUP BY a.well, a.feature""",
        "kendall_scores": f"""WITH {_scores("6, 12", "patchy")}
SELECT well, feature, CAST(period AS INTEGER) AS period, CAST(lag_index AS INTEGER) AS lag_index, s FROM scores""",
        "jtk": _JTK_TABLE,
        "jtk_curves": _JTK_CURVES,
        "modules_single": _linked("single"),
        "modules_complete": _linked("complete"),
        "modules_weighted": _linked("weighted"),
        "modules": f"{_MODULES} SELECT g AS group_key, feature, module AS module_id FROM members",
        "module_membership": f"""{_MODULES} SELECT g AS group_key, feature, module AS module_id, round(kme, 6) + 0.0 AS "kME",
round(explained, 6) + 0.0 AS variance_explained FROM members""",
        "eigengenes": f"""{_MODULES} SELECT g AS group_key, g AS well, obs AS timepoint, 'Module_' || module AS feature,
round(score, 6) + 0.0 AS value FROM scores""",
        "network_edges": f"""{_MODULES} SELECT a.feature AS feature_a, b.feature AS feature_b, round(tom, 6) + 0.0 AS weight, t.g AS group_key
FROM tom t JOIN useful a ON a.g = t.g AND a.item = t.i JOIN useful b ON b.g = t.g AND b.item = t.j WHERE t.i < t.j AND tom > 0.1""",
        "eigengene_rhythm": _eigengene_rhythm(),
        "redundant_features": _REDUNDANT.format(pearson=PEARSON),
        "pearson_corr": f"WITH {PEARSON} SELECT {_PAIR}, round(r, 6) + 0.0 AS r FROM r",
        "spearman_corr": f"""WITH {EMBEDDED}, x AS (SELECT label, vec_id, dim,
rank() OVER (PARTITION BY label, dim ORDER BY z) + (count(*) OVER (PARTITION BY label, dim, z) - 1) / 2.0::DOUBLE AS v FROM z),
{_pairs("v")} SELECT {_PAIR}, round(r, 6) + 0.0 AS r FROM r""",
        "bicor_corr": f"""WITH {EMBEDDED}, centred AS (SELECT label, vec_id, dim, z - median(z) OVER (PARTITION BY label, dim) AS d FROM z),
scaled AS (SELECT *, d / (9 * median(abs(d)) OVER (PARTITION BY label, dim)) AS u FROM centred),
weighed AS (SELECT label, vec_id, dim, d * CASE WHEN abs(u) < 1 THEN power(1 - u * u, 2) ELSE 0 END AS v FROM scaled),
x AS (SELECT label, vec_id, dim, v / sqrt(sum(v * v) OVER (PARTITION BY label, dim)) AS v FROM weighed)
SELECT a.label, a.dim AS feature_a, b.dim AS feature_b, round(sum(a.v * b.v), 6) + 0.0 AS r
FROM x a JOIN x b ON a.label = b.label AND a.vec_id = b.vec_id AND a.dim < b.dim GROUP BY a.label, a.dim, b.dim""",
        "adjacency_signed": _adjacent("power((1 + r) / 2, 6)"),
        "adjacency_unsigned": _adjacent("power(abs(r), 6)"),
        "connectivity": f"""WITH {PEARSON}, {_both("power((1 + r) / 2, 6)")}
SELECT label, i AS feature, round(sum(w), 6) + 0.0 AS k FROM both_ways GROUP BY label, i""",
        "scale_free_table": f"""WITH {PEARSON}, {_both("(1 + r) / 2")},
degrees AS (SELECT label, power, i, sum(power(w, power)) AS k FROM both_ways, (SELECT unnest(range(1, 21)) AS power) GROUP BY label, power, i),
ends AS (SELECT label, power, min(k) AS low, max(k) AS high, avg(k) AS mean_k FROM degrees GROUP BY label, power),
bins AS (SELECT label, power, low + (b + 0.5::DOUBLE) * (high - low) / 20 AS centre, count(*) AS n FROM (
    SELECT label, power, low, high, least(floor((k - low) / ((high - low) / 20)), 19) AS b FROM degrees JOIN ends USING (label, power))
  GROUP BY label, power, low, high, b),
logs AS (SELECT label, power, log10(centre) AS x, log10(n / sum(n) OVER (PARTITION BY label, power)) AS y FROM bins WHERE centre > 0),
fits AS (SELECT label, power, CASE WHEN count(*) >= 3 AND var_pop(y) > 0 THEN sign(regr_slope(y, x)) * regr_r2(y, x) ELSE 0 END AS r2
  FROM logs GROUP BY label, power)
SELECT label, CAST(power AS INTEGER) AS power, round(r2, 6) + 0.0 AS signed_r2, round(mean_k, 6) + 0.0 AS mean_connectivity FROM ends JOIN fits USING (label, power)""",
        "tom_edges": f"""WITH {PEARSON}, {_both("power((1 + r) / 2, 2)")},
degree AS (SELECT label, i, sum(w) AS k FROM both_ways GROUP BY label, i),
shared AS (SELECT x.label, x.i AS a, y.i AS b, sum(x.w * y.w) AS l FROM both_ways x JOIN both_ways y
  ON x.label = y.label AND x.j = y.j AND x.i < y.i GROUP BY x.label, x.i, y.i),
tom AS (SELECT s.label, s.a, s.b, (s.l + e.w) / (least(p.k, q.k) + 1 - e.w) AS tom FROM shared s
  JOIN both_ways e ON e.label = s.label AND e.i = s.a AND e.j = s.b
  JOIN degree p ON p.label = s.label AND p.i = s.a JOIN degree q ON q.label = s.label AND q.i = s.b)
SELECT {_PAIR}, round(tom, 6) + 0.0 AS weight FROM tom WHERE tom > 0.29""",
    }
