"""The corpus pipeline: quality, line dedup, near duplicates, packing; each stage's result is written and read again.

Each stage works on whatever the one before kept. Documents with a score below a half go; later equal or nearly equal lines
go (one edit from 16 characters, two from 40), and with them documents of which only blank lines are left; of each group of
near copies the row with the least doc_id stays; the rest is packed.

Nulls and odd input: a null text counts as empty where texts are scored and packed, and has no lines and no near copy; an
empty text scores as the sample's share of good rows; a null doc_id stays a row (in line dedup the first of all, in a group
of near copies the last); equal rows tie and one of them stays, if they have any word; an empty table gives empty results;
further columns are kept up to the last stage, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import shared_folder
from gridloom.llm.jaccard import keep_first
from gridloom.llm.line_dedup import drop_lines
from gridloom.llm.packing import pack_stage
from gridloom.llm.quality import keep_good

STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", keep_first),
    ("packing", pack_stage),
]

#: The first and the last stage (a fitted classifier, a tokenizer) can't be said in SQL; tests compare each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; all but the last result go through Parquet in the shared folder.

    A stage's folder goes as soon as the next one's is written; the last stage reads its own when the result is used, so
    that one stays until the shared folder is cleaned.
    """
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                _remove(spark, f"{folder}/{k - 1}")
    return docs


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
