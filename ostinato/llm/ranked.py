"""Ranked lexical search: documents of an item grouped by the set of its terms that they hold.

In each block of documents an item's matches become bit masks, one bit a term. Documents of equal
mask form a group, whose best possible score follows from the mask alone. Groups are
evaluated by falling bound until no group left can reach the best scores found so far.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, materialise
from .common import STEP

#: Every byte but digits, letters and those of non-ASCII characters separates; A-Z are lower-cased.
TERM_BYTES = bytes(
    b | 0x20 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
#: Bytes of items that are searched together; each such block passes over the documents once.
ITEM_BYTES = 4_000_000


def terms(text: str | bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII characters, as UTF-8."""
    raw = b"" if text is None else text.encode() if isinstance(text, str) else text
    return raw.translate(TERM_BYTES).split()


def _postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Per document: doc_id, n (its terms with repeats), and, as 32-bit numbers, the vocabulary's
    terms in it (ascending) and how often each occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    size = len(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            first = 0
            while first < len(texts):
                last, room = first, STEP
                while last < len(texts) and (last == first or room > 0):
                    room -= len(texts[last] or b"")
                    last += 1
                lists = [terms(t) for t in texts[first:last]]
                lengths = np.array([len(x) for x in lists], np.int64)
                found = np.concatenate([np.fromiter(map(get, x, repeat(-1)), np.int64, len(x)) for x in lists])
                places = np.repeat(np.arange(len(lists)), lengths) * size + found
                places, counts = np.unique(places[found >= 0], return_counts=True)
                ends = np.searchsorted(places, np.arange(1, len(lists) + 1) * size) * 4
                which, often = (places % max(size, 1)).astype("<u4").tobytes(), counts.astype("<u4").tobytes()
                cuts = list(zip([0, *ends.tolist()], ends.tolist()))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(first, last - first),
                        "n": pa.array(lengths),
                        "terms": pa.array([which[a:b] for a, b in cuts], pa.binary()),
                        "counts": pa.array([often[a:b] for a, b in cuts], pa.binary()),
                    }
                )
                first = last

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(work, f"doc_id {kind}, n bigint, terms binary, counts binary")


def _numbers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").astype(np.int64)


def _statistics(postings: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, their terms with repeats, and documents by term of the vocabulary."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2, np.int64)
        for batch in batches:
            lengths = batch.column("n").to_numpy()
            total[size] += np.count_nonzero(lengths)
            total[size + 1] += lengths.sum()
            total[:size] += np.bincount(_numbers(batch.column("terms")), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"place": pa.array(seen, pa.int64()), "n": pa.array(total[seen])})

    counts = postings.select("n", "terms").mapInArrow(work, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n"))
    total = np.zeros(size + 2, np.int64)
    for r in counts.collect():  # at most the vocabulary of a block of items
        total[r.place] = r.n
    return int(total[size]), int(total[size + 1]), total[:size]


class _Block:
    """Postings of a block of documents, by document and by term, with what each occurrence is worth."""

    def __init__(self, batch: pa.RecordBatch, documents: int, length: int, size: int):
        raw = batch.column("terms").to_pylist()
        self.starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])]).astype(np.int64)
        self.term = np.frombuffer(b"".join(raw), "<u4").astype(np.int64)
        tf = _numbers(batch.column("counts"))
        m = 100 - 50 + 50 * batch.column("n").to_numpy() * documents // max(length, 1)
        self.count = len(raw)
        doc = np.repeat(np.arange(self.count), np.diff(self.starts))
        self.worth = 1_000_000_000 * tf // (1000 * tf + 20 * m[doc])
        order = np.argsort(self.term, kind="stable")
        self.by_term = doc[order]
        self.term_starts = np.searchsorted(self.term[order], np.arange(size + 1))
        self.most = np.zeros(size, np.int64)
        np.maximum.at(self.most, self.term, self.worth)
        # places of documents in the order of their ids, null first
        self.ids = batch.column("doc_id")
        self.rank = np.empty(self.count, np.int64)
        self.rank[pc.sort_indices(self.ids, null_placement="at_start").to_numpy()] = np.arange(self.count)

    def masks(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents that hold any of the terms, and a row of 64-bit words for each: which ones."""
        bits = np.zeros((self.count, -(-len(wanted) // 64)), np.uint64)
        for k, t in enumerate(wanted.tolist()):
            bits[self.by_term[self.term_starts[t] : self.term_starts[t + 1]], k // 64] |= np.uint64(1 << k % 64)
        docs = np.flatnonzero(bits.any(axis=1))
        return docs, bits[docs]

    def scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Exact scores of documents with at least one posting."""
        sizes = self.starts[docs + 1] - self.starts[docs]
        begins = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) + np.repeat(self.starts[docs] - begins, sizes)
        return np.add.reduceat(weight[self.term[at]] * self.worth[at], begins)


def best_of_block(block: _Block, wanted: np.ndarray, weights: np.ndarray, weight: np.ndarray, keep: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, how many were evaluated) of the block's best for an item, at most ``keep``;
    scores below ``least`` need not be found. ``weight`` has the item's weights at their terms."""
    docs, bits = block.masks(wanted)
    if not len(docs):
        return docs, docs, 0
    if bits.shape[1] == 1:
        groups, group = np.unique(bits[:, 0], return_inverse=True)
        groups = groups[:, None]
    else:
        groups, group = np.unique(bits, axis=0, return_inverse=True)
    held = np.unpackbits(np.ascontiguousarray(groups, "<u8").view(np.uint8), axis=1, bitorder="little")[:, : len(wanted)]
    bound = held.astype(np.int64) @ (weights * block.most[wanted])
    falling = np.argsort(-bound, kind="stable")
    # documents in the order of their groups
    place = np.empty(len(falling), np.int64)
    place[falling] = np.arange(len(falling))
    order = np.argsort(place[group.ravel()], kind="stable")
    ends = np.cumsum(np.bincount(place[group.ravel()], minlength=len(falling)))
    bound, docs = bound[falling], docs[order]
    taken, taken_docs, done, step = docs[:0], docs[:0], 0, max(keep, 64)
    while done < len(ends):
        # groups that can still matter, about ``step`` documents at a time; equal bounds may still tie
        reach = int(np.searchsorted(-bound, -least, "right"))
        if done >= reach:
            break
        first = int(ends[done - 1]) if done else 0
        upto = min(reach, max(done + 1, int(np.searchsorted(ends, first + step))))
        part = docs[first : int(ends[upto - 1])]
        taken = np.concatenate([taken, block.scores(part, weight)])
        taken_docs = np.concatenate([taken_docs, part])
        done, step = upto, step * 2
        if len(taken) > keep:
            least = max(least, int(np.partition(taken, len(taken) - keep)[len(taken) - keep]))
    evaluated = len(taken)
    good = np.flatnonzero((taken > 0) & (taken >= least))
    good = good[np.lexsort((block.rank[taken_docs[good]], -taken[good]))][:keep]
    return taken_docs[good], taken[good], evaluated


def _id_order(found: tuple) -> tuple:
    score, doc_id = found
    return -score, doc_id is not None, 0 if doc_id is None else doc_id


def _search(postings: DataFrame, items: list[list[int]], size: int, keep: int) -> DataFrame:
    """item (its number), score, doc_id: the best of every task."""
    documents, length, holding = _statistics(postings, size)
    values = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in holding.tolist()], np.int64)
    shared = postings.sparkSession.sparkContext.broadcast((values, [np.array(t, np.int64) for t in items]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, items = shared.value
        best: list[list[tuple]] = [[] for _ in items]
        weight = np.zeros(size, np.int64)
        kind = None
        for batch in batches:
            if not len(batch):
                continue
            block = _Block(batch, documents, length, size)
            kind = block.ids.type
            for k, wanted in enumerate(items):
                if not len(wanted):
                    continue
                weight[wanted] = values[wanted]
                least = best[k][-1][0] if len(best[k]) == keep else 1
                docs, scores, _ = best_of_block(block, wanted, values[wanted], weight, keep, least)
                weight[wanted] = 0
                if len(docs):
                    named = zip(scores.tolist(), block.ids.take(pa.array(docs)).to_pylist())
                    best[k] = sorted([*best[k], *named], key=_id_order)[:keep]
        if kind is not None:
            flat = [(k, s, d) for k, found in enumerate(best) for s, d in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in flat], pa.int32()),
                    pa.array([x[1] for x in flat], pa.int64()),
                    pa.array([x[2] for x in flat], kind),
                ],
                ["item", "score", "doc_id"],
            )

    kind = postings.schema["doc_id"].dataType.simpleString()
    return postings.mapInArrow(work, f"item int, score bigint, doc_id {kind}")


def ranked_search(
    docs: DataFrame, items: DataFrame, keep: int = 50, item_bytes: int = ITEM_BYTES, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text"
) -> DataFrame:
    """Per item its ``keep`` best documents of score above 0: item_id, rank (from 1), doc_id, score.

    A term's weight and a document's score are whole numbers, as named in ``_search`` and ``_Block``;
    equal scores go by ascending id, null first. Null texts have no terms; items without a term in any
    document give no rows; rows that repeat an id are documents, or items, of their own. Items are
    searched in blocks of about ``item_bytes`` of text, which bounds what is broadcast; each block
    passes over all documents. A task returns at most ``keep`` documents an item, and these are
    merged in two steps.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    items = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    blocks = 1 + (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // item_bytes
    if blocks > 1:
        ensure_checkpoint_dir(spark)
        items = materialise(items.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(blocks))))
    results = []
    for b in range(blocks):
        rows = (items.filter(F.col("part") == b) if blocks > 1 else items).select("item_id", "text").collect()
        vocabulary: dict[bytes, int] = {}
        wanted = [sorted({vocabulary.setdefault(t, len(vocabulary)) for t in terms(r.text)}) for r in rows]
        postings = materialise(_postings(docs, vocabulary))
        found = _search(postings, wanted, len(vocabulary), keep)
        parts = math.isqrt(postings.rdd.getNumPartitions()) + 1
        found = found.withColumn("part", F.spark_partition_id() % parts)
        first = F.asc_nulls_first("doc_id")
        for keys in (["item", "part"], ["item"]):
            within = Window.partitionBy(*keys).orderBy(F.desc("score"), first)
            found = found.withColumn("rank", F.row_number().over(within)).filter(F.col("rank") <= keep)
        names = spark.createDataFrame(list(enumerate(r.item_id for r in rows)), f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        results.append(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return out


RANKED_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), s AS (
  SELECT count(*)::BIGINT AS docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0
), u AS (
  SELECT doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d
), p AS (
  SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM u WHERE term IN (SELECT term FROM i) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, docs
), r AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total))))::BIGINT AS score
  FROM i JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id
), o AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50
"""
