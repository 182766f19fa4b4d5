"""python -m gridloom IMAGE_FOLDER OUTPUT: trace the PNG images of a folder to JSON or SVG."""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="gridloom", description=__doc__)
    parser.add_argument("input", help="a folder of PNG images")
    parser.add_argument("output", help="a folder for the texts")
    parser.add_argument("--format", choices=("json", "svg"), default="json")
    parser.add_argument("--scale", type=int, default=1)
    parser.add_argument("--max-colors", type=int, default=8)
    parser.add_argument("--tolerance", type=float, default=0.5)
    parser.add_argument("--size", type=int, nargs=2, default=(512, 512), metavar=("WIDTH", "HEIGHT"))
    found = parser.parse_args(argv)

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from gridloom.plans.trace import Settings, trace
    from gridloom.sources import images, sinks

    spark = SparkSession.builder.appName("gridloom").getOrCreate()
    cells = images.load_images(spark, found.input, 1).withColumnRenamed("path", "image")
    paths = trace(cells, Settings(scale=found.scale, max_colors=found.max_colors, tolerance=found.tolerance))
    named = F.element_at(F.split("image", "/"), -1)
    paths = paths.select(named.alias("doc"), F.lit("layer").alias("layer"), F.lit(0).alias("z"), F.col("place").alias("group"), "color", F.col("ring").alias("path"), "start", "cubics")
    if found.format == "json":
        sinks.write_documents(sinks.documents_json(paths, 1.0), "json", found.output)
    else:
        sinks.write_documents(sinks.documents_svg(paths, 1.0, *found.size), "svg", found.output)


if __name__ == "__main__":
    main()
