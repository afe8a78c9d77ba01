"""Every operator as a query over the sample tables.

Roles: a supplier is a well and the month of shipping its timepoint; the line item
measures are the features of the cells in it. Supplier, nation and region are the
platemap. Events are plate reads by hour, day or user. The dimensions of an embedding
are features whose observations are the vectors of a label.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalar import plate_hours, snap_to_grid, to_double, well_name
from .operators import network as net
from .operators.blocks import unfold
from .operators.correlation import correlation, feature_matrix, redundant_features, zscore
from .operators.cosinor import CosinorDetection, fitted_long
from .operators.damped import DampedCosinorDetection
from .operators.dct import best_periods, dct_spectrum
from .operators.detrend import denoise_detrend
from .operators.jtk import EmpiricalJTK, JTKCycle, hodges_lehmann, kendall_scores
from .operators.multitest import adjust_pvalues
from .operators.plots import CosinorFrames, period_histogram
from .operators.series import map_series
from .operators.summarize import STATS, cells_long, summarize_cells
from .operators.wavelet import WaveletAnalyzer, ridge_group_stats, savgol
from .plans.dct import dct_periods
from .plans.detect import (
    detect,
    detect_cosinor_multiperiod,
    feature_with_platemap,
    fit_series,
    join_platemap,
    time_range,
)
from .plans.network import NetworkAnalyzer
from .plans.preprocess import clean_signal
from .session import materialise
from .sources.envision import data_lines, timepoint_gaps, timepoints
from .sources.harmony import clean_objects
from .sources.results import distinct_wells
from .sources.sonar import pivot_times

MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
YEAR = 12.0


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def by_scale(c: str) -> Column:
    """Prices to six digits, the small measures to eight."""
    return F.when(F.col("feature") == "l_extendedprice", rounded(c, 6)).otherwise(rounded(c, 8))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cells(spark: SparkSession, folder: str) -> DataFrame:
    month = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
    return table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("well"), month.alias("tp"), *MEASURES)


def platemap(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        table(spark, folder, "supplier")
        .join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
        .select(
            F.col("s_suppkey").alias("well"),
            F.col("r_name").alias("region"),
            F.col("n_name").alias("nation"),
            (6.0 + 3.0 * (F.col("s_suppkey") % 3)).alias("cycle"),
        )
    )


def monthly(spark: SparkSession, folder: str) -> DataFrame:
    """Mean of every measure per well and month."""
    means = cells(spark, folder).groupBy("well", "tp").agg(*[F.avg(c).alias(c) for c in MEASURES])
    return cells_long(means, ["well", "tp"], MEASURES).withColumnRenamed("value", "mean")


def patchy(spark: SparkSession, folder: str) -> DataFrame:
    """The monthly means with gaps in one measure and series of zeros in another."""
    gap = (F.col("feature") == "l_tax") & ((F.col("well") + F.col("tp")) % 7 == 0)
    zero = (F.col("feature") == "l_discount") & (F.col("well") % 10 == 0)
    lost = (F.col("feature") == "l_discount") & (F.col("well") % 10 == 1)
    mean = F.when(zero, 0.0).when(~(gap | lost), F.round("mean", 8))  # equal on paper, equal in both engines
    return monthly(spark, folder).withColumn("mean", mean)


def detrended(spark: SparkSession, folder: str) -> DataFrame:
    return denoise_detrend(monthly(spark, folder), ["well"], "tp")


def daily_users(spark: SparkSession, folder: str) -> DataFrame:
    day = F.datediff("ts", F.lit("2024-01-01").cast("date"))
    daily = table(spark, folder, "events").groupBy("user_id", day.alias("day")).agg(F.avg("value").alias("value"))
    return daily.unpivot(["user_id", "day"], ["value"], "feature", "mean")


def hourly_types(spark: SparkSession, folder: str) -> DataFrame:
    hour = F.datediff("ts", F.lit("2024-01-01").cast("date")) * 24 + F.hour("ts")
    return table(spark, folder, "events").groupBy("event_type", hour.alias("hour")).agg(F.avg("value").alias("mean"))


def dimensions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("label").cast("string").alias("label"),
        "vec_id",
        F.posexplode("embedding").alias("dim", "_x"),
    ).select("label", "vec_id", F.format_string("d%02d", F.col("dim")).alias("dim"), F.col("_x").cast("double").alias("value"))


def embedding_matrix(spark: SparkSession, folder: str):
    return feature_matrix(dimensions(spark, folder), "label", "label", "vec_id", "dim", "value")


# -- summaries and detrending


def _stats(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, "feature", *[by_scale(s).alias(s) for s in STATS])


def cell_summary(spark, folder):
    return _stats(summarize_cells(cells(spark, folder), ["well"], "tp"), ["well", "tp"])


def cell_summary_multikey(spark, folder):
    month = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
    items = table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", month.alias("tp"), *MEASURES)
    return _stats(
        summarize_cells(items, ["l_returnflag", "l_linestatus"], "tp"), ["l_returnflag", "l_linestatus", "tp"]
    )


def detrend_two_pass(spark, folder):
    return _stats(clean_signal(cells(spark, folder), ["well"], "tp", window_size=8), ["well", "tp"])


def retrieve_wells(spark, folder):
    return distinct_wells(cells(spark, folder), "well")


def zscore_per_well(spark, folder):
    scored = zscore(monthly(spark, folder), ["well", "feature"], "mean")
    return scored.select("well", "tp", "feature", rounded("z").alias("z"))


# -- cosinor


def _cosinor(df: DataFrame, detector=None, period_col=None) -> DataFrame:
    detector = detector or CosinorDetection(period=YEAR, fitted=False)
    return fit_series(df, detector, "well", "feature", "tp", "mean", "mean", period_col)


def _cosinor_columns(fits: DataFrame, *more: str) -> DataFrame:
    return fits.select(
        "well",
        "feature",
        "stat",
        rounded("baseline", 4).alias("baseline"),
        rounded("amplitude", 4).alias("amplitude"),
        rounded("phase", 5).alias("phase"),
        rounded("phase_hours", 5).alias("phase_hours"),
        rounded("p_value", 8).alias("p_value"),
        rounded("f_stat", 5).alias("f_stat"),
        rounded(F.ln("ss_model")).alias("log_ss_model"),
        rounded(F.ln("ss_null")).alias("log_ss_null"),
        *more,
    )


def cosinor_fit(spark, folder):
    return _cosinor_columns(_cosinor(monthly(spark, folder)))


def cosinor_time_range(spark, folder):
    return _cosinor_columns(_cosinor(time_range(monthly(spark, folder), "tp", 12, 59)))


def cosinor_multiperiod(spark, folder):
    found = detect_cosinor_multiperiod(
        spark, monthly(spark, folder), platemap(spark, folder), "cycle", "well", "feature", "tp", "mean", "mean",
        correction_group=["region"], fitted=False,
    )
    return _cosinor_columns(found.results, "period", "region", rounded("p_adjusted", 8).alias("p_adjusted"))


def detrended_significant(spark, folder):
    found = detect(
        spark, detrended(spark, folder), platemap(spark, folder), "well", "feature", "tp", "mean", "mean",
        correction_group=["region"], detector=CosinorDetection(period=YEAR, fitted=False),
    )
    return _cosinor_columns(
        found.significant(alpha=0.9), "region", "nation", rounded("p_adjusted", 8).alias("p_adjusted")
    )


def cosinor_fitted_long(spark, folder):
    hours = (
        table(spark, folder, "events")
        .groupBy("event_type", F.hour("ts").alias("hour"))
        .agg(F.avg("value").alias("mean"))
        .withColumn("feature", F.lit("value"))
    )
    fits = fit_series(hours, CosinorDetection(), "event_type", "feature", "hour", "mean", "mean")
    curve = fitted_long(fits.select("event_type", "feature", "fitted"), range(24), "hour", "value")
    return curve.select("event_type", "feature", F.col("hour").cast("int").alias("hour"), rounded("fitted").alias("fitted"))


def cosinor_overlay(spark, folder):
    found = detect(
        spark, monthly(spark, folder), platemap(spark, folder), "well", "feature", "tp", "mean", "mean",
        detector=CosinorDetection(period=YEAR, time_offset=6),
    )
    return CosinorFrames(found).fit_overlay().select(
        "well", "feature", rounded("hours").alias("hours"), by_scale("value").alias("value"), by_scale("fitted").alias("fitted")
    )


def damped_cosinor(spark, folder):
    fits = _cosinor(monthly(spark, folder), DampedCosinorDetection(period=YEAR))
    return _cosinor_columns(fits, rounded("damping_lambda", 6).alias("damping_lambda"), F.size("fitted").alias("points"))


# -- multiple testing


def _corrected(method: str, group: list[str] | None = None):
    def query(spark, folder):
        fits = materialise(_cosinor(monthly(spark, folder)).select("well", "feature", "p_value"))
        joined = join_platemap(fits, platemap(spark, folder), "well")
        out = adjust_pvalues(joined, method, group)
        return out.select("well", "feature", "region", rounded("p_adjusted", 7).alias("p_adjusted"))

    return query


# -- joins and reshaping


def platemap_left_join(spark, folder):
    few = platemap(spark, folder).where(F.col("region") != "ASIA")
    joined = join_platemap(monthly(spark, folder), few, "well")
    return joined.groupBy("region", "nation").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg("mean"), 3).alias("mean")
    )


def platemap_inner_join(spark, folder):
    few = platemap(spark, folder).where(F.col("region") != "ASIA")
    return monthly(spark, folder).join(few, "well").groupBy("region", "feature").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg("mean"), 3).alias("mean")
    )


def feature_metadata(spark, folder):
    merged = feature_with_platemap(spark, monthly(spark, folder), platemap(spark, folder), "well", "l_quantity")
    return merged.select("well", "tp", "feature", rounded("mean", 8).alias("mean"), "region", "nation", "cycle")


def assembled_matrix(spark, folder):
    """Wells of a region side by side; a cell a well lacks counts as zero."""
    named = monthly(spark, folder).join(platemap(spark, folder).select("well", "region"), "well")
    matrix = feature_matrix(named, "region", "well", "tp", "feature", "mean")
    return matrix.features.select(
        F.col("g").alias("region"), "feature", "n_obs", rounded("total", 4).alias("total"), rounded("squares", 4).alias("squares")
    )


def sonar_pivot(spark, folder):
    yearly = cells(spark, folder).withColumn("tp", F.floor(F.col("tp") / 12).cast("int"))
    stats = summarize_cells(yearly, ["well"], "tp")
    wide = pivot_times(stats, ["well", "feature"], "tp", "median")
    times = [c for c in wide.columns if c not in ("well", "feature")]
    return wide.select("well", "feature", *[rounded(F.col(f"`{t}`"), 4).alias(f"y{t}") for t in times])


def well_names(spark, folder):
    return table(spark, folder, "nation").select(
        "n_nationkey",
        well_name(F.col("n_regionkey") + 1, F.col("n_nationkey") + 1).alias("well_name"),
        plate_hours(F.col("n_nationkey") + 1, 0.5).alias("hours"),
    )


def grid_hours(spark, folder):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))
    return table(spark, folder, "events").groupBy(snap_to_grid(seconds / 3600.0, 0.5).alias("hour")).agg(
        F.count(F.lit(1)).alias("n")
    )


def gaps(spark, folder):
    found = timepoint_gaps(hourly_types(spark, folder), ["event_type"], "hour", 1.0)
    return found.select(
        "event_type",
        "after_hour",
        "before_hour",
        "n_missing",
        F.concat_ws(",", F.transform("missing_hours", lambda h: h.cast("int").cast("string"))).alias("missing_hours"),
    )


def harmony_clean(spark, folder):
    """Line items as objects seen on a plate, all columns as text."""
    text = [
        (F.col("l_suppkey") % 16 + 1).alias("Row"),
        (F.col("l_partkey") % 24 + 1).alias("Column"),
        F.col("l_linenumber").alias("Timepoint"),
        F.col("l_orderkey").alias("Order"),
        F.when(F.col("l_quantity") > 45, "NA").when(F.col("l_quantity") < 3, "").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("Area"),
        F.col("l_tax").alias("X"),
    ]
    objects = table(spark, folder, "lineitem").select(*text)
    return clean_objects(objects.select(*[F.col(c).cast("string").alias(c) for c in objects.columns]), "Timepoint", 0.5)


def _reports(spark, folder):
    """A plate-reader report for each user: its file, and when it was measured."""
    users = table(spark, folder, "events").groupBy("user_id").agg(F.min("ts").alias("measured"))
    return users.select(F.concat(F.lit("u"), "user_id").alias("file"), "measured")


def _report_lines(spark, folder):
    """A row for each line of these reports: a preamble, a line for each event, and a tail."""
    cents = F.round(F.col("value") * 100).cast("long").cast("string")
    line = F.concat_ws(",", "user_id", F.lit(" =\"\"B1 "), "event_type", F.lit("100"), F.lit("0.5"), cents, "event_id")
    head = ("Plate information", "Plate,Barcode,Measurement date", "", "Results", "Plate,Barcode,Well,Flashes/Time,MeasTime,Signal,Event")
    tail = ("", "Basic assay information", "9,after,the,end")

    def number(part, place):
        return F.struct(F.lit(part).alias("part"), place.cast("long").alias("place")).alias("number")

    events = table(spark, folder, "events").select(F.concat(F.lit("u"), "user_id").alias("file"), number(1, F.col("event_id")), line.alias("line"))
    around = F.array(*[F.struct(number(p, F.lit(k)), F.lit(t).alias("line")) for p, part in ((0, head), (2, tail)) for k, t in enumerate(part)])
    return _reports(spark, folder).select("file", F.inline(around)).union(events)


def report_rows(spark, folder):
    cell = [F.get("cells", F.lit(i)) for i in range(7)]
    return data_lines(_report_lines(spark, folder)).select(
        "file", cell[1].alias("barcode"), cell[2].alias("well"), to_double(cell[5]).alias("signal"), cell[6].cast("long").alias("event")
    )


def report_times(spark, folder):
    return timepoints(_reports(spark, folder), 0.5).select("file", "hour")


def cosinor_heatmap(spark, folder):
    found = detect(
        spark, monthly(spark, folder), platemap(spark, folder), "well", "feature", "tp", "mean", "mean",
        detector=CosinorDetection(period=YEAR, fitted=False),
    )
    cells_ = CosinorFrames(found).summary(0.9)
    return cells_.select(
        "well", "feature", rounded("amplitude", 4).alias("amplitude"), rounded("phase", 5).alias("phase"),
        rounded("phase_degrees", 4).alias("phase_degrees"), rounded("p_adjusted", 8).alias("p_adjusted"),
    )


# -- spectra


def _dct(spark, folder):
    named = monthly(spark, folder).join(platemap(spark, folder).select("well", "region"), "well")
    return dct_periods(named, "well", "tp", "mean", ["region", "feature"], 1.0, (6, 24))


def dct_well_periods(spark, folder):
    return _dct(spark, folder)[0].select("Well", "group_label", rounded("detected_period").alias("detected_period"))


def dct_group_summary(spark, folder):
    wells, groups, _ = _dct(spark, folder)
    return groups.select(
        "region",
        "feature",
        "group_label",
        *[rounded(c).alias(c) for c in ("mean_period", "median_period", "std_period")],
        "n_replicates",
    )


def dct_amplitude_profile(spark, folder):
    return _dct(spark, folder)[2].select(
        "region",
        "feature",
        rounded("period").alias("period"),
        rounded("mean_amplitude", 4).alias("mean_amplitude"),
        rounded("std_amplitude", 4).alias("std_amplitude"),
    )


def _wavelet(spark, folder):
    reads = hourly_types(spark, folder).withColumn("name", F.lit("events"))
    return WaveletAnalyzer((12, 48), 1.0).analyze(reads, "name", "event_type", "mean", "hour")


_RIDGE = ("periods", "phase", "amplitude", "power", "phase_hours")


def wavelet_ridge(spark, folder):
    ridge = _wavelet(spark, folder).ridge
    return ridge.select("event_type", "name", F.col("time").cast("int").alias("time"), *[rounded(c, 5).alias(c) for c in _RIDGE])


def wavelet_power(spark, folder):
    """Range of the power of every period over time."""
    reads = hourly_types(spark, folder).withColumn("name", F.lit("events"))
    power = WaveletAnalyzer((12, 48), 1.0).power(reads, "name", "event_type", "mean", "hour")
    return power.groupBy("event_type", rounded("period").alias("period")).agg(
        F.count(F.lit(1)).alias("n"), rounded(F.min("power")).alias("low"), rounded(F.max("power")).alias("high")
    )


def wavelet_fourier(spark, folder):
    fourier = _wavelet(spark, folder).fourier
    return fourier.select("event_type", "name", rounded("period").alias("period"), rounded("power").alias("power"))


def wavelet_summary(spark, folder):
    summary = _wavelet(spark, folder).summary
    numbers = [c for c in summary.columns if c not in ("event_type", "name")]
    return summary.select("event_type", "name", *[rounded(c, 5).alias(c) for c in numbers])


def ridge_stats(spark, folder):
    metrics = ["periods", "amplitude", "phase_hours"]
    stats = ridge_group_stats(_wavelet(spark, folder).ridge, "name", "time", metrics)
    numbers = [f"{m}_{s}" for m in metrics for s in ("mean", "std")]
    return stats.select("name", F.col("time").cast("int").alias("time"), *[rounded(c, 5).alias(c) for c in numbers])


def savgol_smooth(spark, folder):
    smooth = savgol(hourly_types(spark, folder), ["event_type"], "hour", "mean")
    return smooth.select("event_type", "hour", rounded("smoothed").alias("smoothed"))


# -- rank-based detection


def location(spark, folder):
    found = map_series(patchy(spark, folder), ["well", "feature"], "tp", "mean", lambda t, v: hodges_lehmann(v), "location")
    return found.select("well", "feature", rounded(F.col("location") + 1.7e-9, 7).alias("location"))


def kendall(spark, folder):
    return kendall_scores(patchy(spark, folder), ["well", "feature"], "tp", "mean", [6, 12])


def _jtk(spark, folder):
    # means that are equal on paper must tie in both engines
    means = monthly(spark, folder).withColumn("mean", F.round("mean", 8))
    return _cosinor(means, JTKCycle([6, 9, 12]))


def jtk_curves(spark, folder):
    fits = _jtk(spark, folder)
    points = fits.select("well", "feature", F.posexplode(F.arrays_zip("jtk_fitted", "lsq_fitted")).alias("place", "p"))

    def clear(c: str) -> Column:
        """Rounded where a mean of two rounded values does not lie just between two results."""
        price = rounded(F.col(f"p.{c}") + 1.7e-9, 6)
        return F.when(F.col("feature") == "l_extendedprice", price).otherwise(rounded(F.col(f"p.{c}") + 1.7e-9, 8)).alias(c)

    return points.select("well", "feature", "place", clear("jtk_fitted"), clear("lsq_fitted"))


def jtk(spark, folder):
    return _jtk(spark, folder).select(
        "well",
        "feature",
        rounded("p_value", 8).alias("p_value"),
        rounded("jtk_corrected_p", 8).alias("jtk_corrected_p"),
        "period",
        "jtk_phase_hours",
        rounded("jtk_amplitude", 5).alias("jtk_amplitude"),
        rounded("tau", 8).alias("tau"),
        rounded("jtk_baseline", 10).alias("jtk_baseline"),
        rounded("lsq_baseline", 5).alias("lsq_baseline"),
        rounded("lsq_amplitude", 5).alias("lsq_amplitude"),
        rounded("lsq_phase_hours", 5).alias("lsq_phase_hours"),
        rounded("lsq_n_cycles", 7).alias("lsq_n_cycles"),
        rounded("lsq_r_squared", 7).alias("lsq_r_squared"),
    )


def ejtk(spark, folder):
    users = daily_users(spark, folder)
    fits = fit_series(users, EmpiricalJTK([6, 7, 8], interval=24.0), "user_id", "feature", "day", "mean", "mean")
    return fits.drop("jtk_fitted", "lsq_fitted")


def _dct_all(spark, folder):
    keys = ["well", "feature"]
    return best_periods(dct_spectrum(monthly(spark, folder), keys, "tp", "mean", 1.0, (6, 24)), keys)


def periods_found(spark, folder):
    return period_histogram(_dct_all(spark, folder), ["feature"], "detected_period").select(
        "feature", "bin", "n", rounded("bin_start").alias("bin_start"), rounded("median").alias("median")
    )


# -- networks


def _named_pairs(matrix, pairs: DataFrame, value: str, out: str, digits: int = 6) -> DataFrame:
    if "mat" in pairs.columns:
        pairs = unfold(pairs, value)
    for end in ("a", "b"):
        names = matrix.features.select("g", F.col("r").alias(end), F.col("feature").alias(f"feature_{end}"))
        pairs = pairs.join(names, ["g", end])
    return pairs.select(F.col("g").alias("label"), "feature_a", "feature_b", rounded(value, digits).alias(out))


def _correlated(method: str):
    def query(spark, folder):
        matrix = embedding_matrix(spark, folder)
        return _named_pairs(matrix, correlation(matrix, method), "r", "r")

    return query


def _adjacent(signed: bool):
    def query(spark, folder):
        matrix = embedding_matrix(spark, folder)
        return _named_pairs(matrix, net.adjacency(correlation(matrix), 6, signed), "w", "w")

    return query


def connectivity(spark, folder):
    matrix = embedding_matrix(spark, folder)
    degrees = net.connectivity(net.adjacency(correlation(matrix), 6))
    return degrees.join(matrix.features, ["g", "r"]).select(F.col("g").alias("label"), "feature", rounded("k").alias("k"))


def scale_free_table(spark, folder):
    table_ = net.soft_threshold_table(correlation(embedding_matrix(spark, folder)))
    return table_.select(
        F.col("g").alias("label"), "power", rounded("signed_r2").alias("signed_r2"), rounded("mean_connectivity").alias("mean_connectivity")
    )


def tom_edges(spark, folder):
    matrix = embedding_matrix(spark, folder)
    adj = materialise(net.adjacency(correlation(matrix), 2))
    return _named_pairs(matrix, net.overlap_edges(adj, 0.29), "tom", "weight")


def _linked(method: str):
    def query(spark, folder):
        matrix = embedding_matrix(spark, folder)
        tom = materialise(net.topological_overlap(materialise(net.adjacency(correlation(matrix), 2))))
        found = net.detect_modules(tom, matrix.features, 3, linkage_method=method)
        return found.join(matrix.features, ["g", "r"]).select(F.col("g").alias("label"), "feature", "module")

    return query


def redundant(spark, folder):
    matrix = embedding_matrix(spark, folder)
    found = redundant_features(correlation(matrix), 0.4)
    names = matrix.features.select("g", "r", "feature")
    return found.join(names, ["g", "r"]).join(
        names.withColumnsRenamed({"r": "representative", "feature": "representative_feature"}), ["g", "representative"]
    ).select(F.col("g").alias("label"), "feature", "representative_feature")


def _network(spark, folder):
    analyzer = NetworkAnalyzer(min_module_size=3, soft_power=2)
    return analyzer.analyze_all(dimensions(spark, folder), "label", "vec_id", "dim", "value")


def modules(spark, folder):
    return _network(spark, folder).modules.select("group_key", "feature", "module_id")


def module_membership(spark, folder):
    found = _network(spark, folder).modules
    return found.select(
        "group_key", "feature", "module_id", rounded("kME").alias("kME"), rounded("variance_explained").alias("variance_explained")
    )


def module_eigengenes(spark, folder):
    found = _network(spark, folder).eigengenes
    return found.select("group_key", "well", "timepoint", "feature", rounded("value").alias("value"))


def network_edges(spark, folder):
    return _network(spark, folder).edges.withColumn("weight", rounded("weight"))


def eigengene_rhythm(spark, folder):
    """Eigengenes of the regions' measures, taken straight into detection."""
    named = detrended(spark, folder)
    analyzer = NetworkAnalyzer(min_module_size=2, soft_power=1)
    found = analyzer.analyze_all(named, "well", "tp", "feature", "mean", platemap(spark, folder), "region")
    fits = fit_series(found.eigengenes, CosinorDetection(period=YEAR, fitted=False), "well", "feature", "timepoint", "value", "eigengene")
    adjusted = adjust_pvalues(materialise(fits), "fdr_bh")
    return _cosinor_columns(adjusted, rounded("p_adjusted", 8).alias("p_adjusted"))


def catalog() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    region = ["region"]
    return {
        "cell_summary": cell_summary,
        "cell_summary_multikey": cell_summary_multikey,
        "detrend_two_pass": detrend_two_pass,
        "retrieve_wells": retrieve_wells,
        "zscore_per_well": zscore_per_well,
        "cosinor_fit": cosinor_fit,
        "cosinor_time_range": cosinor_time_range,
        "cosinor_multiperiod": cosinor_multiperiod,
        "detrended_significant": detrended_significant,
        "cosinor_fitted_long": cosinor_fitted_long,
        "cosinor_overlay": cosinor_overlay,
        "damped_cosinor": damped_cosinor,
        "bh_global": _corrected("fdr_bh"),
        "bh_grouped": _corrected("fdr_bh", region),
        "bonferroni": _corrected("bonferroni", region),
        "sidak": _corrected("sidak", region),
        "holm": _corrected("holm", region),
        "holm_sidak": _corrected("holm-sidak", region),
        "hochberg": _corrected("simes-hochberg", region),
        "fdr_by": _corrected("fdr_by", region),
        "hommel": _corrected("hommel", region),
        "fdr_two_stage_bh": _corrected("fdr_tsbh", region),
        "fdr_two_stage_bky": _corrected("fdr_tsbky", region),
        "platemap_left_join": platemap_left_join,
        "platemap_inner_join": platemap_inner_join,
        "feature_with_platemap": feature_metadata,
        "assembled_matrix": assembled_matrix,
        "sonar_pivot": sonar_pivot,
        "well_names": well_names,
        "grid_hours": grid_hours,
        "timepoint_gaps": gaps,
        "harmony_clean": harmony_clean,
        "report_rows": report_rows,
        "report_times": report_times,
        "cosinor_heatmap": cosinor_heatmap,
        "dct_periods": dct_well_periods,
        "dct_group_summary": dct_group_summary,
        "dct_amplitude_profile": dct_amplitude_profile,
        "period_histogram": periods_found,
        "wavelet_ridge": wavelet_ridge,
        "wavelet_power": wavelet_power,
        "wavelet_fourier": wavelet_fourier,
        "wavelet_summary": wavelet_summary,
        "ridge_group_stats": ridge_stats,
        "savgol": savgol_smooth,
        "hodges_lehmann": location,
        "kendall_scores": kendall,
        "jtk": jtk,
        "jtk_curves": jtk_curves,
        "ejtk": ejtk,
        "pearson_corr": _correlated("pearson"),
        "spearman_corr": _correlated("spearman"),
        "bicor_corr": _correlated("bicor"),
        "adjacency_signed": _adjacent(True),
        "adjacency_unsigned": _adjacent(False),
        "connectivity": connectivity,
        "scale_free_table": scale_free_table,
        "tom_edges": tom_edges,
        "redundant_features": redundant,
        "modules": modules,
        "modules_single": _linked("single"),
        "modules_complete": _linked("complete"),
        "modules_weighted": _linked("weighted"),
        "module_membership": module_membership,
        "eigengenes": module_eigengenes,
        "network_edges": network_edges,
        "eigengene_rhythm": eigengene_rhythm,
    }
