"""Tab-separated cell tables, platemaps, and file sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import CELL_NULLS, to_double


def as_frame(spark: SparkSession, data: DataFrame | str) -> DataFrame:
    return data if isinstance(data, DataFrame) else spark.read.parquet(str(data))


def read_text_table(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Every column as text; null tokens differ by reader and are mapped afterwards."""
    return spark.read.csv(str(path), sep=sep, header=True, nullValue="\u0000", emptyValue="")


def read_cells(spark: SparkSession, path: str, well_cols: Sequence[str], timepoint_col: str) -> DataFrame:
    """Per-cell table: keys, and every other column as a double feature."""
    raw = read_text_table(spark, path)
    keys = [*well_cols, timepoint_col]
    missing = [k for k in keys if k not in raw.columns]
    if missing:
        raise ValueError(f"{path} lacks the column {', '.join(missing)}")
    return raw.select(
        *[F.col(f"`{c}`") for c in well_cols],
        to_double(F.col(f"`{timepoint_col}`")).alias(timepoint_col),
        *[to_double(F.col(f"`{c}`"), CELL_NULLS).alias(c) for c in raw.columns if c not in keys],
    )


def read_platemap(spark: SparkSession, platemap: DataFrame | str) -> DataFrame:
    """Well metadata: a frame as it is, or a CSV, parquet or Excel file."""
    if isinstance(platemap, DataFrame):
        return platemap
    path = str(platemap)
    if path.endswith(".xlsx"):
        from .xlsx import read_xlsx

        return read_xlsx(spark, path)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.csv(path, header=True, inferSchema=True)


def write_table(df: DataFrame, path: str) -> None:
    """Parquet or CSV by the suffix of ``path``."""
    path = str(path)
    if path.endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    elif path.endswith(".csv"):
        df.write.mode("overwrite").csv(path, header=True)
    elif path.endswith((".tsv", ".txt")):
        write_tsv(df, path)
    else:
        raise ValueError(f"{path}: the output must end in .parquet, .csv, .tsv or .txt")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(str(path), sep="\t", header=True, emptyValue="")
