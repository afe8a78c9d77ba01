"""EnVision plate-reader exports: one small report per timepoint, parsed in Spark SQL."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import ENVISION_NULLS, null_tokens, snap_to_grid
from .tables import write_tsv

log = logging.getLogger(__name__)

# Cells that mark the header of the data section, and the date format.
DATA_HEADERS = ("Plate", "Barcode", "Well")
DATE_FORMAT = "M/d/yyyy h:mm:ss a"

# Columns a formatted table does without. A repeated or empty header
# carries the suffix ``_duplicated_`` and its count.
DROPPED = (
    "MeasTime",
    "CalcResultI_duplicated_0",
    "Signal_duplicated_0",
    "MeasTime_duplicated_0",
    "_duplicated_0",
    "_duplicated_1",
    "",
    "Barcode",
    "Flashes/Time",
    "Plate",
)


def _cells(line):
    return F.transform(F.split(line, ","), lambda c: F.regexp_replace(F.trim(c), '=""', ""))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """One row per report: ``file``, ``measured`` and its ``lines``. A report covers one
    plate at one time, so a whole one fits a row."""
    text = spark.read.text(str(path), wholetext=True).select(
        F.col("_metadata.file_path").alias("file"),
        F.transform(F.split("value", "\r\n|\n|\r"), lambda line: F.trim(line)).alias("lines"),
    )
    names, values = _cells(F.get("lines", F.lit(1))), _cells(F.get("lines", F.lit(2)))
    at = F.array_position(names, F.lit("Measurement date"))
    stamp = F.get(values, (at - 1).cast("int"))
    parsed = F.coalesce(
        F.try_to_timestamp(stamp, F.lit(DATE_FORMAT)),
        F.raise_error(F.concat(F.lit("no measurement date in "), F.col("file"))).cast("timestamp"),
    )
    return text.withColumn("measured", parsed)


def timepoints(reports: DataFrame, sampling_interval: float = 1.0) -> DataFrame:
    """``file, measured, hour``: hours since the first report, on the sampling grid."""
    first = reports.agg(F.min("measured").alias("_t0"))
    hours = F.timestamp_diff("SECOND", F.col("_t0"), F.col("measured")) / F.lit(3600.0)
    return (
        reports.select("file", "measured")
        .crossJoin(F.broadcast(first))  # one row
        .select("file", "measured", snap_to_grid(hours, sampling_interval).alias("hour"))
    )


def timepoint_gaps(times: DataFrame, keys: Sequence[str], time_col: str, interval: float) -> DataFrame:
    """Consecutive timepoints more than one interval apart, with the hours in between."""
    series = Window.partitionBy(*keys).orderBy(time_col)
    step = F.lit(float(interval))
    gap = times.withColumn("after_hour", F.lag(time_col).over(series)).where(
        F.col(time_col) - F.col("after_hour") > step
    )
    count = F.ceil((F.col(time_col) - F.col("after_hour")) / step).cast("int") - 1
    return gap.select(
        *keys,
        "after_hour",
        F.col(time_col).alias("before_hour"),
        F.transform(F.sequence(F.lit(1), count), lambda i: F.col("after_hour") + i * step).alias("missing_hours"),
        count.alias("n_missing"),
    )


def header_names(header: str) -> list[str]:
    """Column names of a header line; repeats are numbered from 0."""
    seen: dict[str, int] = {}
    out = []
    for name in (c.strip().replace('=""', "") for c in header.split(",")):
        if name in seen:
            out.append(f"{name}_duplicated_{seen[name]}")
            seen[name] += 1
        else:
            out.append(name)
            seen[name] = 0
    return out


def data_rows(reports: DataFrame) -> DataFrame:
    """data_lines of reports that are a row each."""
    return data_lines(reports.select("file", F.posexplode("lines").alias("number", "line")))


def data_lines(lines: DataFrame) -> DataFrame:
    """``file, header, cells``: the lines below the data header whose first cell is a
    number, up to the first that is not. ``lines`` has a row for each line: ``file``,
    ``number`` (anything that orders the lines of a file) and ``line``; no report is gathered."""
    is_header = F.forall(F.array(*[F.lit(h) for h in DATA_HEADERS]), lambda h: F.array_contains(_cells("line"), h))
    heads = lines.groupBy("file").agg(F.min(F.when(is_header, F.struct("number", "line"))).alias("_head"))
    heads = heads.select(
        "file",
        F.coalesce("_head", F.raise_error(F.concat(F.lit("no data header in "), F.col("file")))).alias("_head"),
    )
    below = lines.join(heads, "file").filter(F.col("number") > F.col("_head.number"))
    is_data = F.trim(F.split("line", ",")[0]).rlike("^[0-9]+$")
    stops = below.filter(~is_data).groupBy("file").agg(F.min("number").alias("_stop"))
    kept = below.join(stops, "file", "left").filter(F.col("_stop").isNull() | (F.col("number") < F.col("_stop")))
    return kept.select("file", F.col("_head.line").alias("header"), _cells("line").alias("cells"))


def parse_reports(spark: SparkSession, path: str, sampling_interval: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Data of all reports with their ``Timepoint``, and the timepoints themselves."""
    reports = read_reports(spark, path)
    times = timepoints(reports, sampling_interval)
    rows = data_rows(reports)
    headers = [r.header for r in rows.select("header").distinct().limit(2).collect()]
    if len(headers) != 1:
        raise ValueError("the reports do not share one data header" if headers else f"no data rows in {path}")
    names = header_names(headers[0])
    lacking = [c for c in DROPPED if c not in names]
    if lacking:
        raise ValueError(f"the reports lack the expected columns {lacking}")
    keep = [
        null_tokens(F.get("cells", F.lit(i)), ENVISION_NULLS).alias(n) for i, n in enumerate(names) if n not in DROPPED
    ]
    data = rows.select("file", *keep).join(times.select("file", F.col("hour").alias("Timepoint")), "file")
    return data.drop("file"), times


def format_envision(spark: SparkSession, in_dir: str, out_path: str, sampling_interval: float = 1.0) -> DataFrame:
    """Write all reports of ``in_dir`` as one TSV; returns the gaps between them."""
    data, times = parse_reports(spark, in_dir, sampling_interval)
    write_tsv(data.orderBy("Timepoint", "Well"), out_path)
    named = times.withColumn("_all", F.lit(1))
    gaps = timepoint_gaps(named.select("_all", "hour").distinct(), ["_all"], "hour", sampling_interval).drop("_all")
    stem = F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1)
    files = times.groupBy("hour").agg(F.max(stem).alias("last"), F.min(stem).alias("first"))
    out = (
        gaps.join(files.select(F.col("hour").alias("after_hour"), F.col("last").alias("after_file")), "after_hour")
        .join(files.select(F.col("hour").alias("before_hour"), F.col("first").alias("before_file")), "before_hour")
        .select("after_file", "before_file", "after_hour", "before_hour", "missing_hours", "n_missing")
    )
    log.info("gaps between reports: %d", out.count())
    return out
