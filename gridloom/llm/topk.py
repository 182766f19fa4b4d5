"""Exact top-k search by inner product: the threshold algorithm over sorted per-dimension lists.

Components become floor(scale * x) as integers. Candidates are dealt into blocks by hashed row, queries into groups, and
each pair of a block and a group is one run of rows in one task: first the block's candidates, of which the lists are
built once (for each dimension the rows in order of that component), then the group's queries as a stream, so a task
holds one block and one batch of queries. A query reads all its dimensions' lists in step from the end that its sign
favours and scores each row when it is first seen, and no other. It stops when no unseen row can enter: such a row has
every component behind the list's last read value and a norm up to the largest unseen one, and the largest inner product
under both (not of the components alone, which is the classic, looser bound) is below the k-th score. An equal one
could enter by its id, so equality reads on. Once every row has been seen there is nothing left to read. Block results
are merged to the k best of each query.

What is shuffled: each candidate once for each group of ``QUERIES`` queries, each query once for each block of
``CANDIDATES`` rows.

Nulls and odd input: vectors that are null, empty, or hold a null or non-finite component, and rows with a null id, take
no part; vectors are only compared with those of as many components; equal scores go by smaller id; repeated (id,
vector) rows count once, a repeated id with other vectors is a candidate for each of them, and as a query has the k best scores of any; a query has
as many rows as there are candidates, if fewer than k; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ship, table

K = 20
CANDIDATES = 1 << 13
QUERIES = 1 << 13
EXACT = float(2**53)
SLACK = 1e-9


class Lists:
    """A block of candidates with its sorted per-dimension lists. ``read`` counts the rows that the last query scored."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        """vectors: whole numbers as floats; exact integers where products pass 2**53."""
        by_id = np.argsort(ids, kind="stable")
        self.ids, rows = ids[by_id], np.ascontiguousarray(vectors[by_id], np.float64)
        self.most = float(np.abs(rows).max(initial=0.0))
        up = np.argsort(rows, axis=0, kind="stable").T.astype(np.int32)
        self.order = np.ascontiguousarray(np.stack([up, up[:, ::-1]]))  # from the least component on, from the largest on
        self.rows = {np.float64: rows}
        self.norms = np.linalg.norm(rows, axis=1) * (1 + SLACK)
        self.seen, self.mark = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        self.read = 0

    def kind(self, most: float):
        """The number type in which scores of queries with components up to ``most`` are exact."""
        largest = most * self.most * self.rows[np.float64].shape[1]
        kind = np.float32 if largest < 2.0**24 else np.float64 if largest < EXACT else object
        if kind not in self.rows:
            rows = self.rows[np.float64]
            self.rows[kind] = np.array([[int(x) for x in r] for r in rows], object) if kind is object else rows.astype(kind)
        return kind

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the k best rows with another id, best first."""
        n, dims = len(self.ids), np.flatnonzero(query)
        rows = self.rows[self.kind(float(np.abs(query).max(initial=0)))]
        exact = query.astype(rows.dtype) if rows.dtype != object else np.array([int(x) for x in query], object)
        weights = np.abs(query[dims]).astype(np.float64)
        side = (query[dims] > 0).astype(np.int8)
        seen, mark = self.seen, self.mark
        seen[:] = False
        own = slice(np.searchsorted(self.ids, query_id, "left"), np.searchsorted(self.ids, query_id, "right"))
        seen[own] = True  # never its own
        left = n - (own.stop - own.start)
        self.read = 0
        top, scores = np.zeros(0, np.int64), np.zeros(0, rows.dtype)
        depth = 0
        while left:
            upto = min(n, max(2 * k, 64, depth * 3 // 2))
            mark[:] = False
            mark[self.order[side, dims, depth:upto] if len(dims) else slice(depth, upto)] = True
            mark &= ~seen
            fresh = np.flatnonzero(mark)
            depth = upto
            if len(fresh):
                seen[fresh] = True
                left -= len(fresh)
                self.read += len(fresh)
                top = np.concatenate([top, fresh])
                scores = np.concatenate([scores, rows[fresh] @ exact])
                if len(top) > k:
                    edge = np.sort(scores)[-k] if rows.dtype == object else np.partition(scores, len(scores) - k)[len(scores) - k]
                    near = np.flatnonzero(scores >= edge)
                    near = near[np.lexsort((top[near], -scores[near]))][:k]
                    top, scores = top[near], scores[near]
            if left and len(top) >= k and len(dims):
                last = self.rows[np.float64][self.order[side, dims, depth - 1], dims]
                if float(scores.min()) > ceiling(weights, np.where(side, last, -last), float(self.norms[~seen].max())):
                    break
        rank = np.lexsort((top, -scores))
        return top[rank], scores[rank]


def ceiling(weights: np.ndarray, last: np.ndarray, norm: float) -> float:
    """The largest inner product of the positive weights with a vector of components up to ``last`` and of that norm or less, rounded up.

    It has components min(last, t * weight) for the t that gives it the norm, or ``last`` itself if that is short enough.
    """
    plain = float(weights @ last)
    room = norm * norm
    if float(last @ last) > room:
        by = np.argsort(last / weights)
        held, free = np.cumsum(last[by] ** 2), np.cumsum((weights[by] ** 2)[::-1])[::-1]
        sums = np.cumsum(weights[by] * last[by])
        t = last[by] / weights[by]
        # With t at the k-th ratio the first k components are at their last value and the others at t * weight.
        size = np.where(t > 0, held + t * t * np.append(free[1:], 0.0), held)
        k = int(np.argmax((size > room) & (t > 0))) if ((size > room) & (t > 0)).any() else len(by)
        before = held[k - 1] if k else 0.0
        if k < len(by):
            done = sums[k - 1] if k else 0.0
            plain = min(plain, float(done + np.sqrt(max(room - before, 0.0) * free[k])))
    return plain + SLACK * (abs(plain) + float(weights @ np.abs(last)))


def _integers(column: pa.Array, width: int, scale: float) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * flat).reshape(-1, width)


def _once(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without repeated (id, vector) rows."""
    by = np.argsort(ids, kind="stable")
    again = np.flatnonzero(ids[by][1:] == ids[by][:-1])
    if not len(again):
        return ids, rows
    met: set = set()
    gone = np.zeros(len(ids), bool)
    for i in by[np.union1d(again, again + 1)]:
        gone[i] = (key := (ids[i], rows[i].tobytes())) in met
        met.add(key)
    return ids[~gone], rows[~gone]


def _searcher(k: int, scale: float):
    """Rows (part, width, asks, vec_id, v) sorted by the first four: each run's candidates, then its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, rows, lists = None, [], [], None
        for batch in batches:
            part, width, asks = (batch.column(c).to_numpy() for c in ("part", "width", "asks"))
            edges = np.flatnonzero(np.diff(part, prepend=part[:1] - 1) | np.diff(width, prepend=width[:1]) | np.diff(asks, prepend=asks[:1]))
            for start, stop in zip(edges, np.append(edges[1:], len(part)), strict=True):
                if at != (part[start], width[start]):
                    at, ids, rows, lists = (part[start], width[start]), [], [], None
                piece = batch.slice(start, stop - start)
                vec_ids, vectors = piece.column("vec_id").to_numpy(), _integers(piece.column("v"), int(width[start]), scale)
                if not asks[start]:
                    ids.append(vec_ids)
                    rows.append(vectors)
                    continue
                if lists is None and ids:
                    lists = Lists(*_once(np.concatenate(ids), np.concatenate(rows)))
                if lists is None:
                    continue
                out: list[list[np.ndarray]] = [[], [], []]
                for query_id, query in zip(vec_ids, vectors, strict=True):
                    top, scores = lists.best(query_id, query, k)
                    for column, x in zip(out, (np.full(len(top), query_id), lists.ids[top], scores.astype(np.int64)), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], ["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, is_query, k: int = K, scale: float = 64.0, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """vectors: vec_id long, embedding array. query_id, rank, vec_id, score for each query (rows where is_query)."""
    spark = vectors.sparkSession
    ship(spark)
    sound = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    )
    n, asked = sound.agg(F.count("*"), F.count_if("asks")).first()
    n_c, n_q = -(-n // candidates) or 1, -(-asked // queries) or 1
    group = lambda m: F.pmod(F.xxhash64("vec_id", "v"), F.lit(m))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<long>"))
    row = lambda part, asks: (part.alias("part"), F.size("v").alias("width"), F.lit(asks).alias("asks"), "vec_id", "v")
    blocks = sound.withColumn("g", every(n_q)).select(*row(F.col("g") * n_c + group(n_c), 0))
    asking = sound.where("asks").dropDuplicates(["vec_id", "v"]).withColumn("b", every(n_c)).select(*row(group(n_q) * n_c + F.col("b"), 1))
    parts = max(n_c * n_q, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = blocks.unionByName(asking).repartition(parts, "part").sortWithinPartitions("part", "width", "asks", "vec_id")
    found = dealt.mapInArrow(_searcher(k, scale), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
