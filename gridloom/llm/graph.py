"""Connected components of links as DataFrames, by rounds of least-label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """links (a, b), any direction. (node, root) for every node of a link, root the least node it can reach.

    Alternates hooking each node's larger neighbours, then all its neighbours, to the least one it knows. Map-side
    minima keep a node with very many links from gathering in one task. Each round is cut to the checkpoint folder.
    """
    pairs = cut(links.select(F.greatest("a", "b").alias("n"), F.least("a", "b").alias("r")).where("n <> r").distinct())
    before = _digest(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("r").alias("n"), F.col("n").alias("r")))
        least = both.groupBy("n").agg(F.min("r").alias("m")).select("n", F.least("n", "m").alias("m"))
        larger = both.where("r > n").join(least, "n").select(F.col("r").alias("n"), F.col("m").alias("r"))  # large star
        stars = larger.where("n <> r").distinct()
        least = stars.groupBy("n").agg(F.min("r").alias("m"))
        smaller = stars.join(least, "n").select(F.explode(F.array(F.struct("n", F.col("m").alias("r")), F.struct(F.col("r").alias("n"), F.col("m").alias("r")))).alias("x")).select("x.*")  # small star
        after = cut(smaller.where("n <> r").distinct())
        digest = _digest(after)
        if digest == before:
            return after.select(F.col("n").alias("node"), F.col("r").alias("root")).unionByName(after.select(F.col("r").alias("node"), F.col("r").alias("root")).distinct())
        pairs, before = after, digest


def _digest(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("n", "r")), F.bit_xor(F.xxhash64("r", F.lit(1), "n"))).first())
