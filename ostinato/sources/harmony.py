"""Harmony exports: per-object tables below a preamble, made ready for analysis."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import HARMONY_NULLS, clean_header, null_tokens, plate_hours, well_name
from .tables import write_tsv

# Columns that say where an object was seen, not what it looks like.
DROPPED = (
    "Row",
    "Column",
    "Field",
    "Object No",
    "X",
    "Y",
    "Bounding Box",
    "Position X [um]",
    "Position Y [um]",
    "Compound",
    "Concentration",
    "Cell Type",
    "Cell Count",
)
PREFIX = "Objects_Population - "
SKIPPED = ("PlateResults.txt", "PlateResult.txt")


@dataclass(frozen=True)
class HarmonyFile:
    path: str
    dataset: str
    object_type: str


def list_files(spark: SparkSession, root: str) -> list[HarmonyFile]:
    """Object tables two levels below ``root``; hidden and plate-level files are skipped."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{root}/*/*")
    system = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for status in system.globStatus(pattern) or []:
        name, parent = status.getPath().getName(), status.getPath().getParent().getName()
        if status.isFile() and not name.startswith(".") and name not in SKIPPED:
            stem = name.rsplit(".", 1)[0] if "." in name[1:] else name
            found.append(HarmonyFile(status.getPath().toString(), parent, stem.replace(PREFIX, "")))
    return sorted(found, key=lambda f: f.path)


def read_objects(spark: SparkSession, path: str, header_row_index: int = 9) -> DataFrame:
    """Object table as text columns with cleaned names.

    The preamble is read on its own (a handful of lines); the rest stays a splittable
    text scan, which leaves out as many lines from the start of the file's first block.
    """
    lines = spark.read.text(path)
    head = [r.value for r in lines.take(header_row_index + 1)]
    if len(head) <= header_row_index:
        raise ValueError(f"{path} has no header at line {header_row_index}")
    names = [clean_header(c) for c in head[header_row_index].strip().split("\t")]
    if len(set(names)) != len(names):
        raise ValueError(f"{path} repeats a column name")
    # the block at 0 is the longest of one file, so it comes first in the first partition,
    # whose rows are numbered from 0
    placed = lines.select("value", F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    data = placed.where((F.col("_block") > 0) | (F.col("_line") > header_row_index))
    cells = F.split("value", "\t")
    return data.select(*[F.get(cells, F.lit(i)).alias(n) for i, n in enumerate(names)])


def clean_objects(objects: DataFrame, timepoint_col: str, sampling_interval: float) -> DataFrame:
    """``WellName`` first, positional columns dropped, timepoints in hours."""
    cells = objects.select(*[null_tokens(F.col(f"`{c}`"), HARMONY_NULLS).alias(c) for c in objects.columns])
    hours = plate_hours(F.col(f"`{timepoint_col}`"), sampling_interval)
    rest = [
        hours.alias(c) if c == timepoint_col else F.col(f"`{c}`")
        for c in objects.columns
        if c not in DROPPED and c != "WellName"
    ]
    return cells.select(well_name(F.col("Row"), F.col("Column")).alias("WellName"), *rest)


def _empty_folder(spark: SparkSession, folder: str, inputs: list[str]) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(folder))
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    full = system.makeQualified(path).toString().rstrip("/") + "/"
    if any(p.startswith(full) for p in inputs):
        raise ValueError(f"{folder} holds the input")
    system.delete(path, True)
    system.mkdirs(path)


def process_harmony(
    spark: SparkSession,
    root: str,
    out_dir: str,
    timepoint_col: str,
    sampling_interval: float,
    header_row_index: int = 9,
    intermediate_dir: str | None = None,
    replace_dir: bool = False,
) -> dict[str, dict[str, str]]:
    """Write ``{dataset}._.{object}.analysis_ready.tsv`` for every object table, and the
    unchanged tables too if an ``intermediate_dir`` is given. ``replace_dir`` empties
    ``out_dir`` first; else other tables in it stay."""
    files = list_files(spark, root)
    if replace_dir:
        _empty_folder(spark, out_dir, [f.path for f in files])
    written: dict[str, dict[str, str]] = {}
    for file in files:
        objects = read_objects(spark, file.path, header_row_index)
        stem = f"{file.dataset}._.{file.object_type}"
        if intermediate_dir is not None:
            write_tsv(objects, f"{intermediate_dir}/{stem}.formatted.txt")
        target = f"{out_dir}/{stem}.analysis_ready.tsv"
        write_tsv(clean_objects(objects, timepoint_col, sampling_interval), target)
        written.setdefault(file.dataset, {})[file.object_type] = target
    return written
