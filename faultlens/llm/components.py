"""Connected components by alternating large and small stars, on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultlens.sources.stage import stage


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first())


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links(a, b) -> (node, component): the smallest node reachable, for each node that has a link.

    Rows with a null end or a == b are ignored; repeated and reversed rows are harmless. The minimum of each
    neighbourhood is a partial aggregation and is written before it is joined back, so that both join sides
    are plain exchanges and a node with very many links is split by adaptive execution. The number of
    rounds grows with the logarithm of a component's size; no links reach the driver.
    """
    links = links.filter("a <> b")
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = _fingerprint(edges)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "low")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))  # few per node: each has one row per larger centre
        down = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(down.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = _fingerprint(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
