"""Exact duplicates by a tree merge of sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import free_name

#: White space that two equal texts may differ in: ``[\x20\x09-\x0D]``.
BLANKS = "[ \\t\\n\\x0B\\f\\r]+"


def normalised(text: Column | str = "text") -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def exact_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fan: int = 16, rounds: int = 2
) -> DataFrame:
    """Group texts that are equal after white space is deleted; null counts as empty.

    Every row belongs to one of ``fan ** rounds`` leaf runs by a hash of its id, so that a
    group of any size is spread evenly. A leaf run reduces each digest to its best row and its
    count; in every round ``fan`` neighbouring runs exchange and merge these sorted entries,
    until one run is left. What the root knows then returns along the same tree, and no join
    key ever has more than ``fan`` entries on one side and a leaf's share of rows on the other.
    An entry is verified by a second 64-bit hash and the length of the text beside the SHA-256.

    Of equal texts the one with the most code points stays, then the smallest id. A null id
    counts as smallest. Rows that repeat the id of the row that stays, with the same length,
    stay as well. Returns a row per input row: the id, keep_id, group_size, kept, text_sha256,
    n_points; other columns of the input play no part.
    """
    norm = F.col("norm")
    runs = fan**rounds
    entry = ["text_sha256", "check", "n_norm"]
    leaves = materialise(  # the texts are read once
        docs.select(
            F.col(doc_id).alias("doc_id"),
            normalised(text).alias("norm"),
            F.length(F.coalesce(F.col(text), F.lit(""))).alias("n_points"),
        )
        .select(
            "doc_id",
            "n_points",
            F.sha2(norm, 256).alias("text_sha256"),
            F.xxhash64(norm).alias("check"),
            F.length(norm).alias("n_norm"),
            F.pmod(F.xxhash64("doc_id"), F.lit(runs)).alias("run"),
        )
    )
    level = leaves.groupBy(*entry, "run").agg(
        F.min(F.struct((-F.col("n_points")).alias("short"), "doc_id")).alias("best"), F.count("*").alias("size")
    )
    tree = [level]
    for _ in range(rounds):
        level = (
            level.withColumn("run", F.floor(F.col("run") / fan))
            .groupBy(*entry, "run")
            .agg(F.min("best").alias("best"), F.sum("size").alias("size"))
        )
        tree.append(level)
    known = tree.pop()
    while tree:  # each run learns the outcome from the run that it was merged into
        known = known.withColumnRenamed("run", "parent")
        below = tree.pop().drop("best", "size").withColumn("parent", F.floor(F.col("run") / fan))
        known = below.join(known, [*entry, "parent"]).drop("parent")
    return leaves.join(known, [*entry, "run"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("n_points") == -F.col("best.short"))).alias("kept"),
        "text_sha256",
        "n_points",
    )


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; repeated rows of one id stay or go together."""
    name = free_name(docs)
    kept = exact_duplicates(docs, doc_id, text).filter("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, F.col(doc_id).eqNullSafe(F.col(name)), "left_semi")
