"""Small helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Characters of text that one vectorised step handles at once (a longer text goes alone).
STEP = 1_500_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a parquet table in the shared checkpoint folder: read by column, and not recomputed
    when executors are lost."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str = "_found") -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def learnable(id_column: str = "doc_id") -> Column:
    """True for rows that labels may be learned from; the rest is held out."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 5 != 0


def steps(texts: Iterable[str | None], limit: int = STEP) -> Iterator[tuple[int, list[str]]]:
    """Consecutive runs of texts (null as empty) of bounded total size, each with the index of its first."""
    first, size, run = 0, 0, []
    for k, text in enumerate(texts):
        text = text or ""
        if run and size + len(text) > limit:
            yield first, run
            first, size, run = k, 0, []
        run.append(text)
        size += len(text)
    if run:
        yield first, run


def batch_steps(batch: pa.RecordBatch, text: str, limit: int = STEP) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The rows of an Arrow batch in runs of bounded text size."""
    for first, run in steps(batch.column(text).to_pylist(), limit):
        yield batch.slice(first, len(run)), run


def with_columns(rows: pa.RecordBatch, keep: list[str], **more) -> pa.RecordBatch:
    """The named columns of ``rows`` and new ones beside them."""
    columns = {name: rows.column(name) for name in keep}
    columns |= {name: v if isinstance(v, pa.Array) else pa.array(v) for name, v in more.items()}
    return pa.RecordBatch.from_pydict(columns)
