"""Token counts: an exact histogram of encoded lengths whose suffix sums answer every context limit.

``lengths`` encodes whole texts (null: empty, 0 tokens) without a shuffle. ``histogram`` has one row for each distinct
length. ``suffix_sums`` adds, for a limit equal to that length, how many documents reach it, the tokens in all, and the
tokens left when each document is cut to the limit; between two rows these are linear in the limit, so ``at_limits``
answers any limit and ``quantiles`` any share of the documents. The sums run over blocks of ``BLOCK`` lengths first and
then inside each block, so no task gathers more than one block's distinct lengths or the (few) block totals.

Ties and repeated rows count as often as they occur; an empty table gives an empty histogram; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens
from .common import cut, ship, table

BLOCK = 1024


def lengths(docs: DataFrame, paths: tuple[str, str] | None = None, by: str | None = None) -> DataFrame:
    """n_tokens (and by, if named) for each document."""
    ship(docs.sparkSession)
    paths = paths or tokens.default_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = pa.array([len(tokens.encode(x or "", paths)) for x in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], counts], [*b.schema.names[1:], "n_tokens"])

    kept = docs.select("text", *([by] if by else []))
    head = f"`{by}` {dict(kept.dtypes)[by]}, " if by else ""
    return kept.mapInArrow(run, f"{head}n_tokens long")


def histogram(counted: DataFrame) -> DataFrame:
    return counted.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """n_tokens, n_docs, docs_at_least, docs_at_most, total_tokens, tokens_at_least, truncated_total."""
    hist = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    tokens_ = F.col("n_docs") * F.col("n_tokens")
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum(tokens_).alias("bt"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("bd").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("bd").over(whole).alias("all_docs"),
        F.sum("bt").over(whole).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    found = hist.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        (F.sum("n_docs").over(inside) + F.col("docs_after")).alias("docs_at_least"),
        (F.sum(tokens_).over(inside) + F.col("tokens_after")).alias("tokens_at_least"),
        "all_docs",
        "total_tokens",
    )
    return found.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        (F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")).alias("docs_at_most"),
        "total_tokens",
        "tokens_at_least",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")).alias("truncated_total"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """For each limit: documents longer than it or as long, and the total when all are cut to it."""
    asked = sums.sparkSession.createDataFrame([(int(x),) for x in limits], "context_limit long")
    longer = F.col("n_tokens") >= F.col("context_limit")
    found = asked.join(F.broadcast(asked).join(sums, F.lit(True)).groupBy("context_limit").agg(
        F.coalesce(F.sum(F.when(longer, F.col("n_docs"))), F.lit(0)).alias("docs_at_least"),
        F.sum(F.col("n_docs") * F.least("n_tokens", "context_limit")).alias("truncated_total"),
    ), "context_limit", "left")
    return found.fillna(0)


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """For each share q the smallest length that at least q of the documents don't exceed."""
    asked = sums.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    total = F.col("docs_at_most") + F.col("docs_at_least") - F.col("n_docs")
    return (
        F.broadcast(asked)
        .join(sums, F.col("docs_at_most") >= F.ceil(F.col("share") * total))
        .groupBy("share")
        .agg(F.min("n_tokens").alias("n_tokens"))
    )


def op3(spark, sf_dir: str) -> DataFrame:
    return suffix_sums(cut(histogram(lengths(table(spark, sf_dir, "documents")))))
