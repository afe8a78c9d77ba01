"""Symmetric feature x feature matrices of all groups as frames of square blocks.

A group of F features is cut into blocks of ``BLOCK`` features. A frame holds a row
``g, p, q, nf, mat`` for every block pair p <= q: ``nf`` features in the group, and the
entries as doubles, row by row. Entries of features that a caller has left out are
NaN. Products, element-wise steps and sums over rows stay in this form from the first
product to the last; rows per pair are written only where a caller asks for pairs. The
memory of a task depends on the block size alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

BLOCK = 256  # features per block
CHUNK = 1024  # observations per chunk
CHUNKS_PER_TASK = 8
TILE = 4  # blocks along the edge of a tile of a matrix product, and ...
DEPTH = 8  # ... blocks that one task adds up
BROADCAST_BYTES = 64 << 20

_KEYS = ["g", "p", "q", "nf"]


def _head(frame: DataFrame) -> str:
    return f"g {frame.schema['g'].dataType.simpleString()}, p int, q int, nf int"


def _entries(row: dict, block: int, name: str = "mat") -> np.ndarray:
    rows, columns = (min(block, row["nf"] - block * row[end]) for end in "pq")
    return np.frombuffer(row[name]).reshape(rows, columns)


def _raw(entries: np.ndarray) -> bytes:
    return np.ascontiguousarray(entries, float).tobytes()


def ends(row: dict, name: str, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of a vector over features that belong to the rows and the columns of a block."""
    return tuple(
        np.full(n, np.nan) if row[f"{name}_{end}"] is None else np.frombuffer(row[f"{name}_{end}"])[:n] for end, n in zip("pq", m.shape)
    )


def gram(cells: DataFrame) -> DataFrame:
    """Inner products of all feature pairs, with ``n_obs``, ``sum_p, sum_q`` and ``square_p,
    square_q``: each end's sums and sums of squares.

    ``cells`` holds ``g`` (group), ``r`` (row index from 0), ``nf`` and ``n_obs`` (rows and observations
    of the group), ``chunk`` and ``pos`` (observation chunk, and place below ``CHUNK`` in it) and
    ``v``; absent cells are zero, and a place that occurs twice is an error."""
    block, head = BLOCK, _head(cells.select("g"))
    kind = cells.schema["g"].dataType.simpleString()

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bi, nf = key[1].as_py(), key[2].as_py()
        rows = min(block, nf - block * bi)
        row, chunk, pos = (table[c].to_numpy() for c in ("r", "chunk", "pos"))
        first, stride = int(chunk.min()), int(pos.max()) + 1
        place = (chunk - first) * stride + pos
        length = int(place.max()) + 1
        at = row % block * length + place
        if np.bincount(at).max() > 1:
            raise ValueError("a well has a feature twice at one timepoint")
        dense = np.zeros((rows, length))
        dense.ravel()[at] = table["v"].to_numpy()
        chunks = np.unique(chunk)
        widths = [int(pos[chunk == c].max()) + 1 for c in chunks]
        mats = [_raw(dense[:, x : x + w]) for x, w in zip((chunks - first) * stride, widths)]
        g, bi, nf, n_obs = (pa.repeat(k, len(chunks)) for k in key[:4])
        columns = [g, bi, pa.array(chunks, pa.int32()), nf, n_obs, pa.array(widths, pa.int32()), pa.array(mats, pa.binary())]
        return pa.table(columns, names=["g", "bi", "chunk", "nf", "n_obs", "width", "mat"])

    # a narrow group's chunks are packed several at a time, up to the size of one of a full block
    run = F.floor(F.col("chunk") / F.greatest(F.lit(1), F.floor(F.lit(block) / F.col("nf")))).cast("int")
    packed = (
        cells.select(
            "g",
            F.floor(F.col("r") / block).cast("int").alias("bi"),
            F.col("nf").cast("int").alias("nf"),
            F.col("n_obs").cast("bigint").alias("n_obs"),
            run.alias("run"),
            F.col("r").cast("int").alias("r"),
            F.col("chunk").cast("int").alias("chunk"),
            F.col("pos").cast("int").alias("pos"),
            F.col("v").cast("double").alias("v"),
        )
        .groupBy("g", "bi", "nf", "n_obs", "run")
        .applyInArrow(pack, f"g {kind}, bi int, chunk int, nf int, n_obs bigint, width int, mat binary")
    )
    blocks = F.ceil(F.col("nf") / block).cast("int")
    placed = (
        packed.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("p", F.least("bi", "other"))
        .withColumn("q", F.greatest("bi", "other"))
        .withColumn("part", F.floor(F.col("chunk") / CHUNKS_PER_TASK).cast("int"))
    )
    names = ("mat", "sum_p", "sum_q", "square_p", "square_q")
    schema = f"{head}, n_obs bigint, " + ", ".join(f"{n} binary" for n in names)

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        p, q, nf = int(first["p"]), int(first["q"]), int(first["nf"])
        rows, columns = min(block, nf - p * block), min(block, nf - q * block)
        total, sums, squares = np.zeros((rows, columns)), [np.zeros(rows), np.zeros(columns)], [np.zeros(rows), np.zeros(columns)]
        mats = {
            (int(bi), int(chunk)): np.frombuffer(raw).reshape(-1, width)
            for bi, chunk, width, raw in zip(pdf["bi"], pdf["chunk"], pdf["width"], pdf["mat"])
        }
        for (bi, chunk), m in mats.items():
            for end, at in enumerate((p, q)):
                if bi == at:
                    sums[end] += m.sum(axis=1)
                    squares[end] += (m * m).sum(axis=1)
            if bi == p and (q, chunk) in mats:
                right = mats[q, chunk]
                width = min(m.shape[1], right.shape[1])
                total += m[:, :width] @ right[:, :width].T
        out = dict(zip(names, map(_raw, (total, *sums, *squares))))
        return pdf.iloc[[0]][[*_KEYS, "n_obs"]].assign(**{n: [v] for n, v in out.items()})

    if (cells.agg(F.max("chunk")).first()[0] or 0) < CHUNKS_PER_TASK:  # nothing is left to add up
        return placed.groupBy("g", "p", "q").applyInPandas(multiply, schema)
    products = placed.groupBy("g", "p", "q", "part").applyInPandas(multiply, schema)
    return _added(products, ["n_obs"], names, schema)


def _added(products: DataFrame, keep: Sequence[str], names: Sequence[str], schema: str) -> DataFrame:
    """Sum the parts of each block pair, one after the other; a null part counts for nothing."""
    keys = [*_KEYS, *keep]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, totals = None, dict.fromkeys(names)
        for pdf in batches:
            for name in names:
                for raw in pdf[name]:
                    if raw is not None:
                        totals[name] = np.frombuffer(raw) if totals[name] is None else totals[name] + np.frombuffer(raw)
            head = pdf.iloc[[0]][keys] if head is None and len(pdf) else head
        if head is not None:
            yield head.assign(**{n: [None if t is None else t.tobytes()] for n, t in totals.items()})

    return products.groupBy("g", "p", "q").applyInPandas(add, schema)


def map_blocks(blocks: DataFrame, f: Callable[[np.ndarray, dict], np.ndarray]) -> DataFrame:
    """Blocks with the entries ``f(m, row)`` in the place of ``m``; ``row`` holds all columns."""
    block = BLOCK

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[_KEYS].assign(mat=[_raw(f(_entries(row, block), row)) for row in pdf.to_dict("records")])

    return blocks.mapInPandas(work, f"{_head(blocks)}, mat binary")


def from_blocks(blocks: DataFrame, f: Callable[..., Iterable[dict]], columns: str) -> DataFrame:
    """``g`` and ``columns`` of the column sets that ``f(m, row, rows, columns)`` yields for each
    block; ``rows`` and ``columns`` number its features in the group."""
    block = BLOCK
    names = ["g", *[c.split()[0] for c in columns.split(", ")]]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                m = _entries(row, block)
                for found in f(m, row, row["p"] * block + np.arange(m.shape[0]), row["q"] * block + np.arange(m.shape[1])):
                    out = pd.DataFrame(found)
                    out["g"] = row["g"]
                    yield out[names]

    kind = blocks.schema["g"].dataType.simpleString()
    return blocks.mapInPandas(work, f"g {kind}, {columns}")


def row_vectors(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``g, p`` and a vector per column over the features ``g, r`` of each block; NaN where a feature is absent."""
    block, kind = BLOCK, rows.schema["g"].dataType.simpleString()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.iloc[[0]][["g", "p"]]
        for c in columns:
            v = np.full(block, np.nan)
            v[pdf["r"].to_numpy() % block] = pdf[c].to_numpy(float)
            out = out.assign(**{c: [v.tobytes()]})
        return out

    placed = rows.select("g", "r", F.floor(F.col("r") / block).cast("int").alias("p"), *columns)
    return placed.groupBy("g", "p").applyInPandas(pack, f"g {kind}, p int, " + ", ".join(f"{c} binary" for c in columns))


def with_ends(blocks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Blocks with the vectors of their rows and columns, suffixed ``_p`` and ``_q``."""
    columns = [c for c in vectors.columns if c not in ("g", "p")]
    vectors = materialise(vectors)
    small = vectors.count() * len(columns) * BLOCK * 8 <= BROADCAST_BYTES
    for end in "pq":
        side = vectors.select("g", F.col("p").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])
        blocks = blocks.join(F.broadcast(side) if small else side, ["g", end], "left")
    return blocks


def unfold(blocks: DataFrame, name: str, over: float | None = None) -> DataFrame:
    """``g, a, b`` and the entry, for a < b and entries that are not NaN (and above ``over``)."""

    def pairs(m, row, rows, columns):
        keep = ~np.isnan(m) if over is None else m > over
        if row["p"] == row["q"]:
            keep &= rows[:, None] < columns[None, :]
        i, j = np.nonzero(keep)
        if len(i):
            yield {"a": rows[i].astype(np.int32), "b": columns[j].astype(np.int32), name: m[i, j]}

    return from_blocks(blocks, pairs, f"a int, b int, {name} double")


def fold(pairs: DataFrame, features: DataFrame, name: str, diagonal: float = 0.0) -> DataFrame:
    """Blocks of pairs ``g, a, b`` a < b with an entry each, over the features ``g, r``; absent pairs are
    ``diagonal``, and numbers that no feature has are left out."""
    block, head = BLOCK, _head(pairs)
    sizes = features.groupBy("g").agg((F.max("r") + 1).cast("int").alias("nf"))
    own = features.select("g", F.col("r").alias("a"), F.col("r").alias("b"), F.lit(float(diagonal)).alias(name))
    spread = pairs.select("g", "a", "b", name).unionByName(own).join(sizes, "g")
    at = lambda c: F.floor(F.col(c) / block).cast("int")
    count = F.ceil(F.col("nf") / block).cast("int")
    every = sizes.select("g", "nf", F.explode(F.sequence(F.lit(0), count - 1)).alias("p")).withColumn("q", F.explode(F.sequence("p", count - 1)))
    spread = every.join(spread.drop("nf").withColumns({"p": at("a"), "q": at("b")}), ["g", "p", "q"], "left")

    def dense(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        rows, columns = (min(block, int(row["nf"]) - block * int(row[end])) for end in "pq")
        m = np.full((rows, columns), diagonal)
        there = pdf[pdf["a"].notna()]
        i, j = there["a"].to_numpy(int) % block, there["b"].to_numpy(int) % block
        m[i, j] = there[name].to_numpy()
        if row["p"] == row["q"]:
            m[j, i] = there[name].to_numpy()
        return pdf.iloc[[0]][_KEYS].assign(mat=[_raw(m)])

    return spread.select(*_KEYS, "a", "b", name).groupBy("g", "p", "q").applyInPandas(dense, f"{head}, mat binary")


def row_sums(blocks: DataFrame, f: Callable[[np.ndarray], list[np.ndarray]], names: Sequence[str]) -> DataFrame:
    """``g, r`` and sums over the whole rows of the matrices ``f(m)``, one a name, without the
    diagonal; features that are left out have no row and count as zero in others."""

    def parts(m, row, rows, columns):
        inside = ~np.isnan(m)
        own = row["p"] == row["q"]
        if own:
            alive = np.flatnonzero(inside.diagonal())
            inside = inside & (rows[:, None] != columns[None, :])
        else:
            alive = np.flatnonzero(inside.any(axis=1))
        values = [np.where(inside, x, 0.0) for x in f(np.where(inside, m, 0.0))]
        yield {"r": rows[alive].astype(np.int32)} | {n: x.sum(axis=1)[alive] for n, x in zip(names, values)}
        if not own:
            alive = np.flatnonzero(inside.any(axis=0))
            yield {"r": columns[alive].astype(np.int32)} | {n: x.sum(axis=0)[alive] for n, x in zip(names, values)}

    partial = from_blocks(blocks, parts, "r int, " + ", ".join(f"{n} double" for n in names))
    return partial.groupBy("g", "r").agg(*[F.sum(n).alias(n) for n in names])


def self_product(blocks: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The product of a symmetric matrix with itself, and the matrix beside it as ``own``. NaN
    counts as zero in the product. ``wanted`` (``g, p, q``) names the block pairs to compute.

    Blocks go to the tiles of ``TILE`` x ``TILE`` block pairs that need them, so that a block is
    sent once for each row of tiles instead of once for each block; a task adds up ``DEPTH`` blocks."""
    block, tile, depth = BLOCK, TILE, DEPTH
    kind = blocks.schema["g"].dataType.simpleString()

    def mirror(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["g", "p", "q", "nf", "mat"]].rename(columns={"p": "i", "q": "k"})
            for row in pdf[pdf["p"] < pdf["q"]].to_dict("records"):
                yield pd.DataFrame({"g": row["g"], "i": [row["q"]], "k": [row["p"]], "nf": [row["nf"]], "mat": [_raw(_entries(row, block).T)]})

    strips = blocks.mapInPandas(mirror, f"g {kind}, i int, k int, nf int, mat binary").withColumns(
        {"t": F.floor(F.col("i") / tile).cast("int"), "part": F.floor(F.col("k") / depth).cast("int")}
    )
    tiles = F.ceil(F.ceil(F.col("nf") / block) / tile).cast("int")
    placed = strips.withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    placed = placed.withColumns({"low": F.least("t", "other"), "high": F.greatest("t", "other")})
    if wanted is not None:
        at = [F.floor(F.col(c) / tile).cast("int").alias(n) for c, n in (("p", "low"), ("q", "high"))]
        listed = wanted.groupBy("g", *at).agg(F.collect_list(F.struct("p", "q")).alias("asked"))  # at most TILE * TILE
        placed = placed.join(listed, ["g", "low", "high"])
    else:
        placed = placed.withColumn("asked", F.expr("cast(null as array<struct<p: int, q: int>>)"))

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high, nf = (int(pdf[c].iloc[0]) for c in ("low", "high", "nf"))
        asked = pdf["asked"].iloc[0]
        asked = None if asked is None else {(int(x["p"]), int(x["q"])) for x in asked}
        length = lambda b: min(block, nf - b * block)
        raw = {(int(i), int(k)): np.frombuffer(m).reshape(length(int(i)), length(int(k))) for i, k, m in zip(pdf["i"], pdf["k"], pdf["mat"])}
        zero = {at: np.nan_to_num(m) for at, m in raw.items()}
        depths = sorted({k for _, k in raw})
        rows = sorted({i for i, _ in raw})
        out = []
        for p in (i for i in rows if i // tile == low):
            for q in (j for j in rows if j // tile == high and j >= p):
                if asked is None or (p, q) in asked:
                    total = sum((zero[p, k] @ zero[q, k].T for k in depths), np.zeros((length(p), length(q))))
                    out.append((p, q, total.tobytes(), _raw(raw[p, q]) if (p, q) in raw else None))
        found = pd.DataFrame(out, columns=["p", "q", "mat", "own"])
        return found.assign(g=pdf["g"].iloc[0], nf=nf)[[*_KEYS, "mat", "own"]]

    schema = f"{_head(blocks)}, mat binary, own binary"
    columns = ["g", "nf", "i", "k", "mat", "low", "high", "part", "asked"]
    products = placed.select(*columns).groupBy("g", "low", "high", "part").applyInPandas(multiply, schema)
    if (blocks.agg(F.max("nf")).first()[0] or 0) <= block * depth:  # nothing is left to add up
        return products
    return _added(products, [], ["mat", "own"], schema)
