"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import keep


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): the smallest id it is connected to.

    Each step only groups by one end with the minimum of the other, so a hub's rows combine before the shuffle and are
    never gathered. Every round is written to the shared folder; rounds grow with the logarithm of the longest chain.
    """
    edges = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), label)
    seen = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        # large star: larger neighbours hang on the least one
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: smaller neighbours, and the id itself, hang on the least one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = keep(small.where("u <> v").distinct(), label)
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == seen or now[0] == 0:
            break
        seen = now
    star = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return star.unionAll(edges.select("v").distinct().join(star.select(F.col("id").alias("v")), "v", "left_anti").select("v", F.col("v").alias("c")))
