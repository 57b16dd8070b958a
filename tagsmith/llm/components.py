"""Connected components by alternating large and small stars, as joins and aggregates: no node's neighbours are ever
gathered in one place, and each round is kept in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsmith.llm.common import write_table


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a and b, long, in any order, repeats and loops allowed. Returns node and root, the smallest node of its
    component, for every node that has an edge to another."""
    e = write_table(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    state = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state or now[0] == 0:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = tuple(now)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that the join is a stage of its own, in which Spark can split a node with many neighbours
        least = write_table(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = write_table(large, "large")
        least = write_table(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a")
        small = small.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        e = write_table(small.distinct(), "stars")
