"""Removal of repeated byte strings by prefix-free parsing.

Every string of ``length`` bytes is cut at its trigger, the ``width``-byte string in it with the smallest
rolling hash (of equal ones the first), so that equal strings have the same trigger at the same place
wherever they occur. The strings of a text that share a trigger start next to each other; the bytes
they cover are a phrase. Phrases are the dictionary: equal ones are reduced to the first, and a phrase
whose trigger no other phrase has needs no further look. The suffixes of the remaining phrases, cut to
``length`` bytes, are brought into corpus order trigger by trigger, and neighbours that agree on
``length`` bytes are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps

U = np.uint64
#: Bytes that one vectorised step looks at, so that its arrays stay in a processor's cache.
CHUNK = 250_000
#: A null id stands for the smallest number.
NULL_ID = -(2**63)
FIRST, LAST = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def rolling(raw: np.ndarray, width: int, base: np.uint64 = FIRST) -> np.ndarray:
    """Mixed polynomial hash of every ``width``-byte string, from those of half the width."""
    n = len(raw) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    power, piece, done = base, (raw.astype(U) + U(1)) * U(0x9E3779B97F4A7C15), 0
    piece ^= piece >> U(29)
    result, k = np.zeros(n, U), 1
    with np.errstate(over="ignore"):
        while k <= width:
            if width & k:  # the string so far, then this piece
                result = result * power + piece[done : done + n]
                done += k
            if 2 * k <= width:
                piece = piece[:-k] * power + piece[k:]
                power = power * power
            k *= 2
        result ^= result >> U(32)
        result *= LAST
        result ^= result >> U(32)
    return result


def first_smallest(values: np.ndarray, reach: int) -> np.ndarray:
    """For every run of ``reach`` values the place of the smallest, of equal ones the first."""
    place, k = np.arange(len(values), dtype=np.int32), 1
    while 2 * k <= reach:
        later = values[k:] < values[:-k]
        values, place = np.where(later, values[k:], values[:-k]), np.where(later, place[k:], place[:-k])
        k *= 2
    if r := reach - k:
        place = np.where(values[r:] < values[:-r], place[r:], place[:-r])
    return place


def phrases(texts: list[bytes], length: int, width: int) -> tuple[np.ndarray, ...]:
    """For each phrase: index of the text, start, number of strings, place of the trigger in it, hash
    of the trigger, hash of the phrase. Strings never cross texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    whole = b"".join(texts)
    raw = np.frombuffer(whole, np.uint8)
    if len(raw) < length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U),) * 2
    hashes = rolling(raw, width)
    trigger = first_smallest(hashes, length - width + 1)
    n = len(trigger)
    end = np.cumsum(sizes)
    text = np.repeat(np.arange(len(texts)), sizes)[:n]
    whole_in = np.arange(n) + length <= end[text]
    fresh = np.ones(n, bool)
    fresh[1:] = (trigger[1:] != trigger[:-1]) | (text[1:] != text[:-1])
    edge = np.append(np.flatnonzero(fresh | ~whole_in), n)
    start = np.flatnonzero(fresh & whole_in)
    count = edge[np.searchsorted(edge, start, "right")] - start
    at = trigger[start].astype(np.int64) - start
    digest = xxhash.xxh3_64_intdigest
    stop = (start + count + (length - 1)).tolist()
    content = np.array([digest(whole[a:b]) for a, b in zip(start.tolist(), stop, strict=True)], U)
    begin = (end - sizes)[text[start]]
    # the place of the trigger is part of what equal phrases have in common
    return text[start], start - begin, count, at, hashes[start + at], content ^ at.astype(U)


def union(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the given intervals."""
    if not len(start):
        return start, stop
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    fresh = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
    return start[fresh], reach[np.append(fresh[1:], len(start)) - 1]


def _rows(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {c: pa.array(v.view(np.int64) if getattr(v, "dtype", None) == U else v) for c, v in columns.items()}
    )


def _spread(doc: np.ndarray) -> np.ndarray:
    """A key that spreads rows which only pass through an exchange."""
    with np.errstate(over="ignore"):
        return doc.astype(np.int64).view(U) * FIRST


def _parse(length: int, width: int):
    """Phrases of all texts as (k, s, doc, a, b): hashes of trigger and phrase, id, start, and number of
    strings and trigger place in one number. A phrase that a batch has before is known to go; its bytes
    are a row with the end as negative b."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            texts = batch.column("text").to_pylist()
            order = np.argsort(ids, kind="stable")
            parts = []
            for first, run in steps([texts[k] for k in order], CHUNK):
                text, *rest = phrases([t.encode() for t in run], length, width)
                if len(text):
                    parts.append((ids[order[first + text]], *rest))
            if not parts:
                continue
            doc, a, n, at, k, s = (np.concatenate(x) for x in zip(*parts, strict=True))
            with np.errstate(over="ignore"):
                sort = np.argsort(k * LAST ^ s, kind="stable")  # then by id and start
            same = np.zeros(len(k), bool)
            same[1:] = (k[sort][1:] == k[sort][:-1]) & (s[sort][1:] == s[sort][:-1])
            first = sort[np.maximum.accumulate(np.where(same, 0, np.arange(len(k))))]
            again = np.zeros(len(k), bool)
            again[sort] = same & ((doc[first] != doc[sort]) | (a[first] != a[sort]))
            copy = np.zeros(len(k), bool)
            copy[sort] = same
            new = ~copy
            yield _rows(k=k[new], s=s[new], doc=doc[new], a=a[new], b=(n << 16 | at)[new])
            if again.any():
                yield from _removed(doc[again], a[again], (a + n + (length - 1))[again])

    return work


def _removed(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows for removed bytes, merged where they touch in a run of rows of one text."""
    order = np.lexsort([start, doc])
    doc, start, stop = doc[order], start[order], stop[order]
    fresh = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > stop[:-1]))
    at = np.flatnonzero(fresh)
    reach = np.maximum.reduceat(stop, at)
    key = _spread(doc[at])
    yield _rows(k=key, s=np.zeros(len(at), np.int64), doc=doc[at], a=start[at], b=-reach)


def _dictionary(length: int):
    """From phrases sorted by (k, s, doc, a): bytes that go because their phrase has come before, and
    the first of each phrase whose trigger other phrases have too. Only the last row is remembered."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_, several = None, False, False  # last first; whether it may yet be told; its trigger has others
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in ("k", "s", "doc", "a", "b")]
            gone = rows[4] < 0
            if gone.any():
                yield _rows(doc=rows[2][gone], a=rows[3][gone], b=rows[4][gone])
            rows = [x[~gone] for x in rows]
            if not len(rows[0]):
                continue
            if held is not None:
                rows = [np.append(h, x) for h, x in zip(held, rows, strict=True)]
            k, s, doc, a, b = rows
            fresh_k = np.append(True, k[1:] != k[:-1])
            fresh = fresh_k | np.append(True, s[1:] != s[:-1])
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(k)), 0))
            go = (doc != doc[first]) | (a != a[first])
            yield _rows(doc=doc[go], a=a[go], b=-(a[go] + (b[go] >> 16) + (length - 1)))
            group = np.cumsum(fresh_k) - 1
            kinds = np.bincount(group, fresh).astype(np.int64)
            if held is not None and several:
                kinds[0] += 1
            tell = fresh & (kinds[group] > 1)
            if held is not None and not open_:
                tell[0] = False
            yield _rows(doc=doc[tell], a=a[tell], b=b[tell])
            several = bool(kinds[-1] > 1)
            open_ = not several
            held = [x[first[-1] : first[-1] + 1] for x in rows]

    return work


def _suffixes(length: int, width: int, classes: int = 2):
    """From texts and what is known of them: merged removed bytes, and the open phrases by class of
    suffix. The strings of a class have their trigger within a range of places, so that they share a
    stretch of bytes, whose hash is the key under which they meet; ``blob`` has the bytes they cover."""
    side = length - width
    edges = np.linspace(0, side + 1, classes + 1).astype(int).tolist()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            ids = batch.column("doc").to_pylist()
            for doc, text, marks in zip(ids, batch.column("text").to_pylist(), batch.column("marks").to_pylist(), strict=True):
                raw = (text or "").encode()
                gone = np.array([(m["a"], -m["b"]) for m in marks if m["b"] < 0], np.int64).reshape(-1, 2)
                spread = (doc * 0x9E3779B97F4A7C15) % 2**64 - 2**63
                for a, b in zip(*(x.tolist() for x in union(gone[:, 0], gone[:, 1])), strict=True):
                    out.append((spread, doc, a, -b, None))
                for m in marks:
                    if m["b"] < 0:
                        continue
                    n, at = m["b"] >> 16, m["b"] & 0xFFFF
                    trigger = m["a"] + at
                    for c in range(classes):
                        low, high = edges[c], edges[c + 1] - 1
                        i, j = max(low, at - n + 1), min(high, at)
                        # of several texts under one id, a shorter one may end before
                        if i <= j and trigger - i + length <= len(raw):
                            shared = raw[trigger - low : trigger + width + side - high]
                            key = xxhash.xxh3_64_intdigest(shared, c) - 2**63
                            out.append((key, doc, trigger - j, j - i + 1, raw[trigger - j : trigger - i + length]))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_pydict(
                {c: pa.array(v, pa.int64()) for c, v in zip(("k", "doc", "a", "b"), columns[:4], strict=True)}
                | {"blob": pa.array(columns[4], pa.binary())}
            )

    return work


def _order(length: int, most: int):
    """From class rows sorted by (k, doc, a): strings that also start earlier. The suffixes of a class are
    sorted together; a class of over ``most`` rows sends its strings on by their own hash instead."""

    def strings(rows: list) -> tuple[np.ndarray, ...]:
        k, doc, a, b, blobs = rows
        sizes = np.array([len(x) for x in blobs], np.int64)
        hashes = rolling(np.frombuffer(b"".join(blobs), np.uint8), length, LAST)
        begin = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(k)), b)
        within = np.arange(len(row)) - np.repeat(np.cumsum(b) - b, b)
        return k[row], hashes[begin[row] + within], doc[row], a[row] + within

    def solve(rows: list) -> Iterator[pa.RecordBatch]:
        k = rows[0]
        size = np.bincount(np.cumsum(np.append(True, k[1:] != k[:-1])) - 1)
        many = np.repeat(size > 1, size)
        if many.any():
            k, s, doc, a = strings([x[many] for x in rows])
            order = np.lexsort([a, doc, s, k])
            k, s, doc, a = k[order], s[order], doc[order], a[order]
            fresh = np.append(True, (k[1:] != k[:-1]) | (s[1:] != s[:-1]))
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(k)), 0))
            go = (doc != doc[first]) | (a != a[first])
            if go.any():
                yield from _removed(doc[go], a[go], a[go] + length)

    def send(rows: list) -> Iterator[pa.RecordBatch]:
        k, s, doc, a = strings(rows)
        yield _rows(k=k, s=s, doc=doc, a=a, b=np.ones(len(k), np.int64))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot = None, None
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in ("k", "doc", "a", "b")]
            gone = rows[3] < 0
            if gone.any():
                doc = rows[1][gone]
                yield _rows(k=_spread(doc), s=np.zeros(len(doc), np.int64), doc=doc, a=rows[2][gone], b=rows[3][gone])
            keep = np.flatnonzero(~gone)
            blobs = np.empty(len(keep), object)
            blobs[:] = batch.column("blob").take(pa.array(keep)).to_pylist()
            rows = [*(x[keep] for x in rows), blobs]
            if hot is not None:
                n = int((rows[0] == hot).sum())
                if n:
                    yield from send([x[:n] for x in rows])
                rows = [x[n:] for x in rows]
                if len(rows[0]):
                    hot = None
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
                held = None
            if not len(rows[0]):
                continue
            last = int(np.flatnonzero(rows[0] == rows[0][-1])[0])  # the last class may go on in the next batch
            if last:
                yield from solve([x[:last] for x in rows])
            held = [x[last:] for x in rows]
            if len(held[0]) > most:
                hot = held[0][0]
                yield from send(held)
                held = None
        if held is not None:
            yield from solve(held)

    return work


def _merge(length: int):
    """From strings sorted by (k, s, doc, a): those that also start earlier, as removed bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in ("k", "s", "doc", "a", "b")]
            gone = rows[4] < 0
            yield _rows(doc=rows[2][gone], a=rows[3][gone], b=rows[4][gone])
            rows = [x[~gone] for x in rows]
            if not len(rows[0]):
                continue
            if held is not None:
                rows = [np.append(h, x) for h, x in zip(held, rows, strict=True)]
            k, s, doc, a, _ = rows
            fresh = np.append(True, (k[1:] != k[:-1]) | (s[1:] != s[:-1]))
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(k)), 0))
            go = (doc != doc[first]) | (a != a[first])
            yield _rows(doc=doc[go], a=a[go], b=-(a[go] + length))
            held = [x[first[-1] : first[-1] + 1] for x in rows]

    return work


def repeated_bytes(texts: DataFrame, length: int = 100, width: int = 24, most: int = 20_000) -> DataFrame:
    """(doc, marks): per text with repeats, the byte intervals a to -b of strings that also start earlier.

    ``texts`` has doc (long) and text, and is dealt out by doc. Rows that meet under one key are
    streamed in sorted order and never gathered: of each trigger or string only the first is remembered.
    """
    mark = F.struct("a", "b")
    parsed = texts.mapInArrow(_parse(length, width), "k bigint, s bigint, doc bigint, a bigint, b bigint")
    known = parsed.repartition("k").sortWithinPartitions("k", "s", "doc", "a")
    known = known.mapInArrow(_dictionary(length), "doc bigint, a bigint, b bigint")
    marks = known.groupBy("doc").agg(F.collect_list(mark).alias("marks"))  # no more than the text has bytes
    open_ = texts.join(marks, "doc").mapInArrow(
        _suffixes(length, width), "k bigint, doc bigint, a bigint, b bigint, blob binary"
    )
    ordered = open_.repartition("k").sortWithinPartitions("k", "doc", "a")
    ordered = ordered.mapInArrow(_order(length, most), "k bigint, s bigint, doc bigint, a bigint, b bigint")
    merged = ordered.repartition("k", "s").sortWithinPartitions("k", "s", "doc", "a")
    merged = merged.mapInArrow(_merge(length), "doc bigint, a bigint, b bigint")
    return merged.groupBy("doc").agg(F.collect_list(mark).alias("marks"))


def _kept(text: str | None, marks: list[dict] | None) -> tuple[bytes, int, int]:
    """The remaining bytes, the size of the text, and the number of removed runs."""
    raw = (text or "").encode()
    if not marks:
        return raw, len(raw), 0
    gone = np.array([(m["a"], -m["b"]) for m in marks], np.int64)
    start, stop = union(gone[:, 0], np.minimum(gone[:, 1], len(raw)))
    start, stop = start[start < stop].tolist(), stop[start < stop].tolist()
    kept = b"".join(raw[a:b] for a, b in zip([0, *stop], [*start, len(raw)], strict=True))
    return kept, len(raw), len(start)


def remove_repeats(
    docs: DataFrame, length: int = 100, width: int = 24, digests: bool = False, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, and kept (binary; with ``digests`` kept_sha256).

    Removed is every byte of a ``length``-byte string that also starts earlier: under a smaller id, or
    in the same text at a smaller start. Null text is empty; ids are whole numbers, null the smallest.
    Rows with one id are one document: equal rows have equal results, and of different texts under
    one id each loses what any of them loses at the same place.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # dealt out once; the parse, the look at open phrases and the result all read this exchange
    texts = rows.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), "text").repartition("doc")
    found = texts.join(repeated_bytes(texts, length, width), "doc", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist(), strict=True)
            results = [_kept(t, m) for t, m in rows]
            if digests:
                kept = pa.array([hashlib.sha256(r[0]).hexdigest() for r in results], pa.string())
            else:
                kept = pa.array([r[0] for r in results], pa.binary())
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc"),
                    "n_bytes": pa.array([r[1] for r in results], pa.int64()),
                    "n_removed": pa.array([r[1] - len(r[0]) for r in results], pa.int64()),
                    "n_spans": pa.array([r[2] for r in results], pa.int64()),
                    "kept": kept,
                }
            )

    kind = "string" if digests else "binary"
    result = found.mapInArrow(work, f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept {kind}")
    own = F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).cast(docs.schema[doc_id].dataType)
    result = result.withColumn("doc_id", own)
    return result.withColumnRenamed("kept", "kept_sha256") if digests else result
