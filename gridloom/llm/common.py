"""What the text operators share: reading tables, shipping code, cutting lineage."""

from __future__ import annotations

import contextlib
import hashlib
import re
import tempfile
import zipfile
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_gridloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    files = sorted(root.rglob("*.py"))
    digest = hashlib.sha256(b"".join(p.read_bytes() for p in files)).hexdigest()[:12]
    to = Path(tempfile.mkdtemp()) / f"gridloom_{digest}.zip"
    with zipfile.ZipFile(to, "w") as out:
        for p in files:
            out.write(p, p.relative_to(root.parent))
    context.addPyFile(str(to))
    context._gridloom_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where that is unset and all runs on this machine (tests), else an error."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="gridloom-")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the folder that all executors share, and read it from there."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    out = df.checkpoint(eager=True)
    tidy(df.sparkSession)
    return out


def tidy(spark: SparkSession) -> None:
    """Give back what the plans so far have left in the driver, if over a fifth of its heap is taken.

    Else the heap grows with the plans' garbage, broadcasts and shuffles stay until the collector happens to run, and what
    the JVM's compilers and threads have freed stays with the C library. Nothing that is still referred to goes.
    """
    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() - heap.freeMemory() <= heap.maxMemory() // 5:
        return
    jvm.java.lang.System.gc()
    with contextlib.suppress(Py4JError, StopIteration):  # not every JVM has this command
        new = spark.sparkContext._gateway.new_array
        args = new(jvm.java.lang.Object, 4)
        args[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        args[1] = "systemTrimNativeHeap"
        # By way of the public interface: the server's own class can't be called from outside its module.
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


def marked(ids: DataFrame, column: str, name: str = "__hit"):
    """Adds to a DataFrame whether its ``column`` may be in ids: a bitmap of at most 64 MB, so that no row is shuffled."""
    power = min(max(15, (16 * max(ids.count(), 1) - 1).bit_length()), 29)
    slot = F.pmod(F.xxhash64(column), F.lit(1 << power))
    blocks = cut(ids.select(slot.alias("__slot")).groupBy(F.shiftright("__slot", 15).alias("__block")).agg(F.bitmap_construct_agg(F.col("__slot").bitwiseAND(32767)).alias("__bits")))
    bit = F.expr("shiftright(int(conv(hex(substring(__bits, int(shiftright(__slot & 32767, 3)) + 1, 1)), 16, 10)), int(__slot & 7)) & 1 = 1")
    return lambda df: df.withColumn("__slot", slot).withColumn("__block", F.shiftright("__slot", 15)).join(F.broadcast(blocks), "__block", "left").withColumn(name, F.coalesce(bit, F.lit(False))).drop("__slot", "__block", "__bits")


def hashed_bits(ids: DataFrame, column: str, n_rows: int, most_bits: int = 1 << 29) -> tuple[bytes, int]:
    """A bitmap of the hashed values of a long column: (bits, log2 of their number).

    16 bits a row, at most ``most_bits`` (64 MB), whatever the input; a full bitmap only filters less.
    Spark builds it in blocks of 4 kB, and the driver joins those.
    """
    power = min(max(15, (16 * max(n_rows, 1) - 1).bit_length()), most_bits.bit_length() - 1)
    slot = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(1 << power))
    blocks = (
        ids.select(slot.alias("slot"))
        .select(F.shiftright("slot", 15).alias("block"), F.col("slot").bitwiseAND(32767).alias("bit"))
        .groupBy("block")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .collect()
    )
    out = bytearray((1 << power) // 8)
    for block, bits in blocks:
        out[block * 4096 : block * 4096 + len(bits)] = bits
    return bytes(out), power




def xxhash64_long(x: int, seed: int = 42) -> int:
    """Spark's xxhash64 of one long, unsigned."""
    import xxhash

    return xxhash.xxh64_intdigest((x & (2**64 - 1)).to_bytes(8, "little"), seed)
