"""Connected components by label propagation with pointer jumping; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): the root is the smallest node of its component.

    Each round takes the least root among a node's neighbours, then the root's own root, so long chains shrink
    fast and a star needs two rounds. A hub's links are combined before the shuffle.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct())
    roots = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root")))
    while True:
        near = both.join(roots, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("least"))
        hooked = roots.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("old"), F.least("root", "least").alias("root"))
        # A root's own least root is a root for all who point to it.
        of_root = hooked.select(F.col("node").alias("r"), F.col("root").alias("next"))
        after = stored(hooked.join(of_root, F.col("root") == F.col("r"), "left").select("node", "old", F.coalesce("next", "root").alias("root")))
        if after.where(F.col("old") != F.col("root")).isEmpty():
            return after.select("node", "root")
        roots = after.select("node", "root")
