"""Column expressions with the semantics the readers and formatters need."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 6.283185307179586

# Null tokens of each reader.
CELL_NULLS = ("NaN", "nan", "NA", "N/A", "")
HARMONY_NULLS = ("", "NA", "NaN", "nan", "NULL")
ENVISION_NULLS = ("", "NA")


def null_tokens(col: Column, tokens: Iterable[str]) -> Column:
    return F.when(~col.isin(*tokens), col)


def to_double(col: Column, tokens: Iterable[str] = CELL_NULLS) -> Column:
    """Text to double; null tokens, unreadable text and NaN become null."""
    return nan_to_null(null_tokens(col, tokens).try_cast("double"))


def nan_to_null(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def strip(col: Column) -> Column:
    """Strip every kind of white space; SQL ``trim`` only takes spaces."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def zfill(col: Column, width: int) -> Column:
    """Pad with zeros on the left; longer text is kept, unlike ``lpad``."""
    return F.when(F.length(col) < width, F.lpad(col, width, "0")).otherwise(col)


def well_name(row: Column, column: Column) -> Column:
    """Plate position as text: row 2, column 3 is ``B03``."""
    return F.concat(F.char(F.lit(64) + row.cast("long")), zfill(column.cast("long").cast("string"), 2))


def snap_to_grid(hours: Column, step: float) -> Column:
    """Nearest multiple of ``step``, halves to the even one."""
    return F.bround(hours / F.lit(float(step))) * F.lit(float(step))


def plate_hours(timepoint: Column, interval: float) -> Column:
    """One-based timepoint index to hours since the start."""
    return ((timepoint.cast("double") - 1) * F.lit(float(interval))).cast("double")


def adjusted_time(t: Column, interval: float = 1.0, offset: float = 0.0, start_index: float = 0.0) -> Column:
    """Hours of a timepoint under an experiment's offset, first index and interval."""
    return F.lit(float(offset)) + (t.cast("double") - F.lit(float(start_index))) * F.lit(float(interval))


def clean_header(name: str) -> str:
    """Plain ASCII column name: µ as u, ² as 2, ³ as 3, accents dropped."""
    plain = name.translate(str.maketrans({"µ": "u", "μ": "u", "²": "2", "³": "3"}))
    plain = unicodedata.normalize("NFKD", plain).encode("ascii", "ignore").decode("ascii")
    return plain.strip().strip("_")


def label(cols: Iterable[str], separator: str = " | ") -> Column:
    """Joined text of several columns in which a null shows as ``None``."""
    return F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in cols])
