"""SimHash near-duplicates through a hierarchical index in Gray order."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import batch_steps, free_name, with_columns
from .graph import components

BITS, BLOCK = 64, 8


def shingle_hashes(text: str, width: int = 3, seed: int = 42) -> np.ndarray:
    """Hash of each shingle; A-Z is lower-cased, words are separated by ``[\\x20\\x09-\\x0D]``;
    fewer words than ``width`` make one shingle, none make none."""
    words = text.encode().lower().split()
    if not words:
        return np.array([], np.uint64)
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(whole, seed)], np.uint64)
    stop = ends[width - 1 :].tolist()
    start = [0, *(ends[: len(words) - width] + 1).tolist()]
    return np.array([digest(whole[i:j], seed) for i, j in zip(start, stop, strict=True)], np.uint64)


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """64-bit majority of the shingles' hashes; a text without words has zero."""
    return majority(shingle_hashes(text, width, seed))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; zero without hashes."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    major = 2 * bits.sum(0, dtype=np.int64) > len(hashes)
    return int(np.packbits(major, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) per row, fp as a signed 64-bit number; null text counts as empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in batch_steps(batch, "text"):
                fps = np.array([fingerprint(t, width) for t in texts], np.uint64)
                yield with_columns(rows, ["doc_id"], fp=pa.array(fps.view(np.int64)))

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        work, f"doc_id {kind}, fp bigint"
    )


def _gray_rank(code: np.ndarray) -> np.ndarray:
    for shift in (1, 2, 4, 8):
        code = code ^ (code >> np.uint64(shift))
    return code


def _free_bits(fp: np.ndarray, mask: np.ndarray, free: list[tuple[int, int]]) -> np.ndarray:
    """The 16 bits that the mask of each row leaves open, one block after the other."""
    high = np.array([BLOCK * i for i, _ in free], np.uint64)[mask]
    low = np.array([BLOCK * j for _, j in free], np.uint64)[mask]
    byte = np.uint64(255)
    return ((fp >> high) & byte) << np.uint64(8) | ((fp >> low) & byte)


def _links(group: np.ndarray, code: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group whose codes differ in at most ``most`` bits.

    Rows are in Gray order within their group, so rows with a common prefix are neighbours.
    Four levels of nodes share ever longer prefixes. Pairs of nodes descend together; a pair
    goes, with all rows below it, as soon as its accumulated differences exceed the limit.
    """
    edges = np.flatnonzero(np.diff(group, prepend=-1))
    nodes = edges
    left = right = np.arange(len(nodes))
    spent = np.zeros(len(nodes), np.int64)
    for level in (12, 8, 4, 0):
        prefix = code >> np.uint64(level)
        new = np.diff(group, prepend=-1) != 0
        new[1:] |= prefix[1:] != prefix[:-1]
        children = np.flatnonzero(new)
        first = np.searchsorted(children, nodes)
        count = np.diff(np.append(first, len(children)))
        size = count[left] * count[right]
        pair = np.repeat(np.arange(len(left)), size)
        within = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
        wide = count[right][pair]
        a = first[left][pair] + within // wide
        b = first[right][pair] + within % wide
        differ = np.bitwise_count((prefix[children[a]] ^ prefix[children[b]]) & np.uint64(15))
        total = spent[pair] + differ
        keep = (total <= most) & (a <= b)
        left, right, spent, nodes = a[keep], b[keep], total[keep], children
    apart = left != right
    return nodes[left[apart]], nodes[right[apart]]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row connected to each of n rows."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(jump := root[root], root):
            root = jump
        if np.array_equal(before, root):
            return root


def near_links(fps: DataFrame, fp: str = "fp", most: int = 2) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints with at most ``most`` (0 to 2) differing bits.

    Two such fingerprints differ in at most two of eight blocks, so each of the 28 ways to leave
    two blocks open files every fingerprint under its other 48 bits, an upper node of shared masked
    bits. A node has at most 2**16 distinct fingerprints, whatever the input. Within a node the
    Gray-ordered index finds the pairs, and only a tree over each connected set leaves the task.
    """
    if not 0 <= most <= 2:
        raise ValueError("most is 0, 1 or 2")
    free = list(combinations(range(BITS // BLOCK), 2))
    masks = [~((255 << BLOCK * i) | (255 << BLOCK * j)) & (2**BITS - 1) for i, j in free]
    signed = [m - 2**BITS if m >= 2**63 else m for m in masks]
    filed = (
        fps.select(F.col(fp).alias("fp"))
        .distinct()
        .select("fp", F.posexplode(F.array(*map(F.lit, signed))).alias("mask", "bits"))
        .select("mask", F.col("fp").bitwiseAND(F.col("bits")).alias("shared"), "fp")
        .repartition("mask", "shared")
        .sortWithinPartitions("mask", "shared")
    )

    def solve(mask: np.ndarray, shared: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(np.diff(shared, prepend=shared[:1]).astype(bool) | np.diff(mask, prepend=mask[:1]).astype(bool))
        size = np.bincount(group)[group]
        mask, group, fp = mask[size > 1], group[size > 1], fp[size > 1].view(np.uint64)
        code = _free_bits(fp, mask, free)
        order = np.lexsort([_gray_rank(code), group])
        group, code, fp = group[order], code[order], fp[order]
        a, b = _links(group, code, most) if len(group) else (group, group)
        root = _forest(len(fp), a, b)
        own = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_pydict(
            {"a": pa.array(fp[own].view(np.int64)), "b": pa.array(fp[root[own]].view(np.int64))}
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in ("mask", "shared", "fp")]
            if rest is not None:
                rows = [np.concatenate(x) for x in zip(rest, rows, strict=True)]
            mask, shared, _ = rows
            if not len(mask):
                continue
            last = int(np.flatnonzero((mask == mask[-1]) & (shared == shared[-1]))[0])  # it may go on in the next batch
            rest = [x[last:] for x in rows]
            if last:
                yield solve(*(x[:last] for x in rows))
        if rest is not None:
            yield solve(*rest)

    return filed.mapInArrow(work, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, most: int = 2, width: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) per row; component_id is the smallest id that links reach.

    Null texts count as empty; texts without words share fingerprint zero and are linked like any
    other. Null ids are ignored in the minimum. Repeated rows and ids stay. Equal fingerprints are
    reduced to one before anything is compared, so groups of copies cost nothing more.
    """
    prints = materialise(fingerprints(docs, width, doc_id, text))
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(near_links(prints, "fp", most))
    known = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    known = materialise(known)
    smallest = known.groupBy("root").agg(F.min("first").alias("component_id"))
    found = known.join(smallest, "root").select("fp", "component_id")
    return prints.join(found, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how: int) -> DataFrame:
    """The documents with the smallest id of their component, with all their columns."""
    found = near_duplicates(docs, doc_id=doc_id, text=text, **how)
    name = free_name(docs)
    stays = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name))
    return docs.join(stays.distinct(), F.col(doc_id).eqNullSafe(F.col(name)), "left_semi")
