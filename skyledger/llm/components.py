"""Connected components of a link table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.store import keep


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each linked node with the smallest node that it can reach.

    Every round hangs the larger neighbours of a node below its smallest neighbour
    and then the smaller ones likewise, so long chains halve. Only minima by key and
    joins on keys are used; a node with very many links is aggregated before the
    shuffle and its rows are split by the join. Stops when nothing changes.
    """
    edges = keep(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    mark = fingerprint(edges)
    while True:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = keep(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        last, mark = mark, fingerprint(small)
        if mark == last:
            return small.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
                small.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        edges = small


def fingerprint(edges: DataFrame) -> tuple:
    """Number of distinct edges and two hashes of their set."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())
