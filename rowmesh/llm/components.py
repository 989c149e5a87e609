"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(links: DataFrame) -> DataFrame:
    """links(a long, b long), in any direction and with repeats: (node, root), root being the least node of the component.

    Each round lets every node, and the root that it had, take the least root
    among its neighbours, then follows roots one step further. Links and labels
    stay in tables; the driver sees a count per round. A link of a node with itself, or
    one that repeats, adds nothing; a null end is no node. No links give no rows.
    """
    both = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("l"))
    edges = written(both.select(F.col("l.a").alias("u"), F.col("l.b").alias("v")).where("u <> v").distinct(), "edges")
    roots = written(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")).withColumnRenamed("u", "node"), "roots")
    while True:
        mine = roots.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        theirs = roots.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        seen = edges.join(theirs, "v").groupBy("u").agg(F.min("rv").alias("least")).join(mine, "u")
        offers = seen.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.least("ru", "least").alias("root")), F.struct(F.col("ru").alias("node"), F.least("ru", "least").alias("root")))).alias("o"))
        hooked = offers.groupBy(F.col("o.node").alias("node")).agg(F.min("o.root").alias("root"))
        further = hooked.select(F.col("node").alias("root"), F.col("root").alias("next"))
        now = written(hooked.join(further, "root", "left").select("node", F.least("root", F.coalesce("next", "root")).alias("root")), "roots")
        before = roots.withColumnRenamed("root", "old")
        changed = now.join(before, "node").where("root <> old").limit(1).count()
        roots = now
        if not changed:
            return roots
