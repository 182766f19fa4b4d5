"""Connected components: least reachable node by alternating star contraction, reachability in trees and its closure."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.plans.lineage import cut


#: Edges that a task joins at once before the rounds.
BLOCK = 100_000


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b). (node, root) for every end of an edge, root the least node reachable.

    Edges are dealt by ranges of their ends, and each task joins blocks of them by itself. Only the roots of nodes that lie in
    several blocks go on to the rounds, so where near nodes have near numbers (cells, runs) these see few rows. No order is needed.
    """
    proper = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")
    kind = dict(proper.dtypes)["a"]
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = cut(proper.repartitionByRange(n, "a", "b").mapInArrow(_joined, f"node {kind}, root {kind}"))
    least = own.groupBy("node").agg(F.min("root").alias("least"), F.max("root").alias("most"))
    links = own.join(least.where("least <> most").select("node", "least"), "node").select(F.col("root").alias("a"), F.col("least").alias("b"))
    tops = contracted(links).select(F.col("node").alias("least"), "root")
    return least.join(tops, "least", "left").select("node", F.coalesce("root", "least").alias("root"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of each block of edges by itself."""

    def keys(column: pa.Array) -> list:
        if pa.types.is_struct(column.type):
            return list(zip(*map(keys, column.flatten()), strict=True))
        return [(x is not None, x) for x in column.to_pylist()] if column.null_count else column.to_pylist()

    def joined(block: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = pa.concat_arrays([b.column(k) for k in (0, 1) for b in block])
        names = keys(ends)
        place = {x: k for k, x in enumerate(names)}
        up = {k: k for k in place.values()}

        def find(k: int) -> int:
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        half = len(names) // 2
        for x, y in zip(names[:half], names[half:], strict=True):
            a, b = find(place[x]), find(place[y])
            if a != b:
                low, high = (a, b) if names[a] < names[b] else (b, a)
                up[high] = low
        nodes = list(up)
        return pa.RecordBatch.from_arrays([ends.take(pa.array(nodes, pa.int64())), ends.take(pa.array([find(k) for k in nodes], pa.int64()))], ["node", "root"])

    block, size = [], 0
    for batch in batches:
        block.append(batch)
        size += batch.num_rows
        if size >= BLOCK:
            yield joined(block)
            block, size = [], 0
    if size:
        yield joined(block)


def contracted(edges: DataFrame) -> DataFrame:
    """What ``components`` gives, by large-star and small-star contraction: about log(n) rounds however long the chains.

    Minima are combined before each shuffle, so a node with very many edges doesn't gather in one task; every round is cut to
    the checkpoint folder.
    """
    pairs = cut(edges.select(F.greatest("a", "b").alias("n"), F.least("a", "b").alias("r")).where("n <> r").distinct())
    known = _sum(pairs)
    while known[0]:
        both = pairs.unionByName(pairs.select(F.col("r").alias("n"), F.col("n").alias("r")))
        least = both.groupBy("n").agg(F.min("r").alias("m")).select("n", F.least("n", "m").alias("m"))
        hooked = both.where("r > n").join(least, "n").select(F.col("r").alias("n"), F.col("m").alias("r")).distinct()
        least = hooked.groupBy("n").agg(F.min("r").alias("m"))
        pointed = hooked.join(least, "n").select(F.explode(F.array(F.struct(F.col("n").alias("n"), F.col("m").alias("r")), F.struct(F.col("r").alias("n"), F.col("m").alias("r")))).alias("x")).select("x.*")
        after = cut(pointed.where("n <> r").distinct())
        if known == (known := _sum(after)):
            tops = after.select(F.col("r").alias("node"), F.col("r").alias("root")).distinct()
            return after.select(F.col("n").alias("node"), F.col("r").alias("root")).unionByName(tops)
        pairs = after
    return pairs.select(F.col("n").alias("node"), F.col("r").alias("root"))


def _sum(pairs: DataFrame) -> tuple:
    """Of distinct pairs, so that no two cancel out."""
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("n", "r")), F.bit_xor(F.xxhash64("r", "n"))).first())


def ancestors(links: DataFrame) -> DataFrame:
    """links (child, parent). (node, ancestor, steps) for each proper ancestor, steps the fewest; a node on a cycle is among its own ancestors.

    Each round doubles the steps that are covered, so a chain of n takes log2(n) rounds, until none adds a pair.
    """
    known = cut(links.where("parent is not null").select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("steps")).distinct())
    pairs, reach = known.count(), 1
    while True:  # the last ``reach`` steps of a longer way are one of the pairs that far apart
        longer = known.join(known.where(F.col("steps") == reach).select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next"), F.col("steps").alias("more")), "ancestor")
        longer = longer.select("node", F.col("next").alias("ancestor"), (F.col("steps") + F.col("more")).alias("steps"))
        known = cut(known.unionByName(longer).groupBy("node", "ancestor").agg(F.min("steps").alias("steps")))
        reach *= 2
        if pairs == (pairs := known.count()):
            return known


def with_above(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """links (child, parent), seeds (node): (node) for each seed and each of their ancestors, without the closure's pairs.

    A round adds what lies as many steps above as all rounds before have covered, and doubles those steps. Where a child has
    one parent, as in a tree, no table has more rows than links and seeds; a chain of n takes log2(n) rounds. A round that adds
    none is the last, on cycles too: nothing new lies just past the steps that were covered.
    """
    leap = cut(links.where("parent is not null").select(F.col("child").alias("node"), F.col("parent").alias("up")).distinct())
    found = cut(seeds.select("node").distinct())
    n = found.count()
    while True:
        found = cut(found.union(found.join(leap, "node").select("up")).distinct())
        if n == (n := found.count()):
            return found
        leap = cut(leap.join(leap.select(F.col("node").alias("up"), F.col("up").alias("next")), "up").select("node", F.col("next").alias("up")).distinct())
