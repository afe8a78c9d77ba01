"""Packing of documents into training sequences by a configuration linear program."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import gathered, materialise
from .common import batch_steps, free_name
from .tokens import text_ids


def cut_documents(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 0,
    with_ids: bool = True,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per piece of a document: doc_id, piece, start, length, ids_crc32, and with ``with_ids``
    ids (little-endian bytes).

    A document is its ids and ``end_id``; null is empty, so it has one id. Only documents over
    ``capacity`` ids are cut. ``tokenizer`` is the path of the file, present on every executor.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = text_ids(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for rows, texts in batch_steps(batch, "text"):
                row, piece, parts = [], [], []
                for k, ids in enumerate(encode(texts)):
                    ids += last
                    cuts = [ids[i : i + 4 * capacity] for i in range(0, len(ids), 4 * capacity)] if len(ids) > 4 * capacity else [ids]
                    row += [k] * len(cuts)
                    piece += range(len(cuts))
                    parts += cuts
                more = {"ids": pa.array(parts, pa.binary())} if with_ids else {}
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": rows.column("doc_id").take(pa.array(row, pa.int32())),
                        "piece": pa.array(piece, pa.int32()),
                        "start": pa.array([capacity * p for p in piece], pa.int64()),
                        "length": pa.array([len(x) // 4 for x in parts], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(x) for x in parts], pa.int64()),
                    }
                    | more
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        work, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    )


class _Knapsack:
    """Best worth of a sequence's content for given prices, and the content that has it."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.lengths, self.capacity = lengths, capacity

    def solve(self, price: np.ndarray) -> None:
        best, take = np.zeros(self.capacity + 1), np.full(self.capacity + 1, -1)
        lengths = self.lengths
        for room in range(int(lengths[0]), self.capacity + 1):
            fits = np.searchsorted(lengths, room, "right")
            worth = price[:fits] + best[room - lengths[:fits]]
            k = int(worth.argmax())
            best[room], take[room] = worth[k], k
        self.take = take.tolist()

    def pattern(self, first: int) -> dict[int, int]:
        """Index of length to count, of the best content beside one piece of the given length."""
        content, room = {first: 1}, self.capacity - int(self.lengths[first])
        while room > 0 and (k := self.take[room]) >= 0:
            content[k] = content.get(k, 0) + 1
            room -= int(self.lengths[k])
        return content


def fractional_patterns(
    lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int, rate: float = 2.0
) -> list[tuple[dict[int, int], float]]:
    """A near-optimal solution of the configuration program: least total amount of patterns whose
    pieces cover ``counts``. Prices start at the lengths; every round prices patterns by one
    knapsack table, buys for each length what it lacks of this round's share, and multiplies
    prices down where a length has more than its share by now, up where it has less."""
    price, have = lengths / capacity, np.zeros(len(lengths))
    table, bought = _Knapsack(lengths, capacity), {}
    for step in range(1, rounds + 1):
        table.solve(price)
        share = counts * step / rounds
        for k in range(len(lengths) - 1, -1, -1):
            if (lack := share[k] - have[k]) > 1e-9:
                content = table.pattern(k)
                # no pattern may be bought for more than its scarcest length still lacks overall
                amount = lack / content[k]
                for j, a in content.items():
                    have[j] += a * amount
                key = tuple(sorted(content.items()))
                bought[key] = bought.get(key, 0.0) + amount
        price *= np.exp(-rate * np.clip((have - share) / counts, -1, 1) / rounds**0.5)
        price *= lengths.dot(counts) / capacity / price.dot(counts)
    return [(dict(key), amount) for key, amount in bought.items()]


def _best_fit(lengths: np.ndarray, counts: np.ndarray, bins: list[list]) -> list[list]:
    """Put the given counts, longest first, where they leave the least room, many equal bins at a
    time. A bin class is [content, number of bins, room]."""
    by_room: dict[int, list[list]] = {}
    for b in bins:
        by_room.setdefault(b[2], []).append(b)
    capacity = max(b[2] + sum(int(lengths[j]) * a for j, a in b[0].items()) for b in bins) if bins else 0
    for k in range(len(lengths) - 1, -1, -1):
        left, size = int(counts[k]), int(lengths[k])
        for room in sorted(r for r in by_room if r >= size):
            while left and by_room[room]:
                content, n, _ = by_room[room].pop()
                each = min(room // size, left)
                used = min(n, left // each)
                if used < n:
                    by_room[room].append([content, n - used, room])
                filled = dict(content)
                filled[k] = filled.get(k, 0) + each
                by_room.setdefault(room - each * size, []).append([filled, used, room - each * size])
                left -= used * each
            if not left:
                break
        if left:
            each = capacity // size
            if left // each:
                by_room.setdefault(capacity - each * size, []).append([{k: each}, left // each, capacity - each * size])
            if left % each:
                room = capacity - left % each * size
                by_room.setdefault(room, []).append([{k: left % each}, 1, room])
    return [b for r in by_room.values() for b in r]


def packing_plan(histogram: dict[int, int], capacity: int = 2048, rounds: int = 24) -> list[tuple[dict[int, int], int]]:
    """Contents (length to count) and how many sequences have each; covers the histogram exactly.

    The fractional solution of the configuration program is rounded, as far as the counts allow: once up,
    and down if that misses the volume bound; the plan of fewer sequences is returned. Only pieces
    that the rounded patterns leave over are put by best fit, into these sequences first. The work
    depends on the number of different lengths only.
    """
    if not histogram:
        return []
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[n] for n in lengths.tolist()], np.int64)
    patterns = sorted(fractional_patterns(lengths, counts, capacity, rounds), key=lambda x: (-x[1], sorted(x[0].items())))
    plans = []
    for rounded in (math.ceil, math.floor):
        left, bins = counts.copy(), [[{}, 0, capacity]]  # an empty class carries the capacity into best fit
        for content, amount in patterns:
            n = min(rounded(amount), *(int(left[j]) // a for j, a in content.items()))
            if n > 0:
                for j, a in content.items():
                    left[j] -= n * a
                bins.append([content, n, capacity - sum(int(lengths[j]) * a for j, a in content.items())])
        plans.append(_best_fit(lengths, left, bins))
        if sum(n for _, n, _ in plans[-1]) == -(-int(lengths.dot(counts)) // capacity):
            break
    best = min(plans, key=lambda p: sum(n for _, n, _ in p))
    return [({int(lengths[j]): a for j, a in content.items()}, n) for content, n, _ in best if n]


def _slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first ordinal, pieces a sequence, first sequence, offset)."""
    slots: dict[int, list] = {}
    given: dict[int, int] = {}
    base = 0
    for content, n in plan:
        offset = 0
        for size, a in sorted(content.items(), reverse=True):
            slots.setdefault(size, []).append((given.get(size, 0), a, base, offset))
            given[size] = given.get(size, 0) + a * n
            offset += a * size
        base += n
    return {size: np.array(rows, np.int64) for size, rows in slots.items()}


def pack(pieces: DataFrame, capacity: int = 2048, rounds: int = 24, spread: int = 16, share: int = 500_000) -> DataFrame:
    """Add sequence_id and offset to rows that have doc_id, piece and length (1 to ``capacity``).

    Only the histogram of lengths, at most ``capacity`` numbers, reaches the driver. Pieces of
    one length are interchangeable: each gets an ordinal among them, and the plan says which
    ordinals lie in which sequence. Ordinals are counted within hashed parts of a length (at
    least ``spread``, more where there would be over ``share`` rows a part), so that a length that
    many pieces have is spread. An empty table gives an empty one.
    """
    total = pieces.count()
    part, rank, base, ordinal = (free_name(pieces, name) for name in ("_part", "_rank", "_before", "_ordinal"))
    parts = max(spread, -(-total // share))
    rows = pieces.withColumn(part, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    sizes = materialise(gathered(rows.groupBy("length", part).count(), total))
    histogram = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("count")).collect()}  # at most capacity rows
    slots = pieces.sparkSession.sparkContext.broadcast(_slots(packing_plan(histogram, capacity, rounds)))
    before = sizes.withColumn(
        base, F.sum("count").over(Window.partitionBy("length").orderBy(part)) - F.col("count")
    ).drop("count")
    within = Window.partitionBy("length", part).orderBy("doc_id", "piece")
    numbered = (
        rows.withColumn(rank, F.row_number().over(within) - 1)
        .join(before, ["length", part])
        .withColumn(ordinal, F.col(rank) + F.col(base))
        .drop(rank, base, part)
    )
    names = [c for c in numbered.columns if c != ordinal]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("length").to_numpy()
            place_of = batch.column(ordinal).to_numpy()
            sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for n in np.unique(size).tolist():
                at = np.flatnonzero(size == n)
                table = slots.value[n]
                hit = table[np.searchsorted(table[:, 0], place_of[at], "right") - 1]
                place = place_of[at] - hit[:, 0]
                sequence[at] = hit[:, 2] + place // hit[:, 1]
                offset[at] = hit[:, 3] + place % hit[:, 1] * n
            yield pa.RecordBatch.from_pydict(
                {c: batch.column(c) for c in names} | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}
            )

    schema = numbered.drop(ordinal).withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    return numbered.mapInArrow(work, schema.schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, **names: str) -> DataFrame:
    """Cut and pack; per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialise(cut_documents(docs, tokenizer, capacity, with_ids=False, **names))
    return pack(pieces, capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
