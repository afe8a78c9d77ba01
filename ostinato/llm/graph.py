"""Connected components of a large graph in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import gathered, materialise


def components(links: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """(node, root) for every node that a link names; root is the component's smallest node.

    Every round hooks each tree onto the smallest root that a link of any of its members leads
    to, then shortens paths; the number of rounds grows with the logarithm of the component.
    Messages to a root are reduced before they are shuffled. Loops and repeated or reversed
    links are harmless; links with a null end are dropped; an empty table gives an empty one.
    ``rows`` is the number of links, if it is known; tables of few rows are kept in few files.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    both = ends.union(ends.select("v", "u")).distinct()
    both = materialise(both if rows is None else gathered(both, 2 * rows))
    rows = both.count()
    label = materialise(gathered(both.groupBy("u").agg(F.least("u", F.min("v")).alias("root")), rows))
    while True:
        heard = both.join(label.select(F.col("u").alias("v"), F.col("root").alias("other")), "v")
        hook = heard.groupBy("u").agg(F.min("other").alias("other")).join(label, "u").filter("other < root")
        target = hook.groupBy("root").agg(F.min("other").alias("target"))
        hooked = label.join(target, "root", "left").select("u", F.coalesce("target", "root").alias("root"))
        hooked = materialise(gathered(hooked, rows))
        if hooked.exceptAll(label).isEmpty():
            return label.withColumnsRenamed({"u": "node"})
        for _ in range(2):
            up = hooked.select(F.col("u").alias("root"), F.col("root").alias("above"))
            hooked = hooked.join(up, "root").select("u", F.col("above").alias("root"))
        label = materialise(gathered(hooked, rows))
