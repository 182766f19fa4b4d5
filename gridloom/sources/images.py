"""PNG folders as layers and cells. Layered documents come as one table row a layer; no decoder for them is available."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_folder(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """path, name, length of the .png and .psd files (any case), by path; names with Auto-Save are passed over if recursive."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "length")
    last = F.element_at(F.split("path", "/"), -1)
    files = files.where(F.lower(last).rlike(r"\.(png|psd)$"))
    if recursive:
        files = files.where(~F.contains("path", F.lit("Auto-Save")))
    name = F.replace(F.element_at(F.split(last, r"\."), 1), F.lit("%20"), F.lit(" "))
    return files.withColumn("name", name).orderBy("path")


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    return files.join(known.select("name"), "name", "left_anti")


def cells(images: DataFrame, threshold: int = 1) -> DataFrame:
    """Rows of Spark's image source (struct ``image``) as path, x, y, r, g, b, a; cells below the alpha threshold are left out.

    Decoded rows arrive as blue, green, red, alpha (or grey); each image is unpacked in the task that read it.
    """
    flat = images.select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")
    schema = pa.schema([("path", pa.string()), *((c, pa.int32()) for c in ("x", "y", "r", "g", "b", "a"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h, w, n = row["height"], row["width"], row["nChannels"]
                if h <= 0 or w <= 0:
                    continue
                pixels = np.frombuffer(row["data"], np.uint8).reshape(h, w, n)
                for top in range(0, h, 256):
                    part = pixels[top : top + 256].reshape(-1, n).astype(np.int32)
                    b, g, r = (part[:, 0],) * 3 if n == 1 else (part[:, 0], part[:, 1], part[:, 2])
                    a = part[:, 3] if n == 4 else np.full(len(part), 255, np.int32)
                    keep = a >= threshold
                    at = np.flatnonzero(keep)
                    yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * len(at)), *(pa.array(x.astype(np.int32)) for x in (at % w, at // w + top, r[keep], g[keep], b[keep], a[keep]))], schema=schema)

    return flat.mapInArrow(run, "path string, x int, y int, r int, g int, b int, a int")


def load_images(spark: SparkSession, folder: str, threshold: int = 128) -> DataFrame:
    return cells(spark.read.format("image").option("dropInvalid", "true").load(folder), threshold)


def load_documents(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Layers (path, x0, y0, x1, y1: the box of what isn't fully transparent) and their cells in that box; empty layers are dropped."""
    from gridloom.operators import grid

    found = load_images(spark, folder, 1)
    box = grid.bounding_box(found, by=["path"])
    return box, grid.crop(found, box, ["path"])
