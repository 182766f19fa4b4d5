"""Cutting lineage for loops, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where that is unset and all runs on this machine (tests), else an error."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="gridloom-")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the folder that all executors share, and read it from there.

    A checkpoint keeps its plan's estimated size, and a join's is the product of its sides', so in loops the number's digits
    double with each join until the driver is busy with nothing else; the result starts anew instead.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    done = df.checkpoint(eager=True)
    held = done._jdf
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(held.queryExecution().toRdd(), held.schema(), False), df.sparkSession)
