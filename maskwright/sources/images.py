"""Image files as rows, and images for the wire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .png import decode_png


def read_images(spark: SparkSession, path: str, names: str = "*.png") -> DataFrame:
    """path and png of every image file in a folder and those below it, by their names."""
    return spark.read.format("binaryFile").option("pathGlobFilter", names).option("recursiveFileLookup", True).load(path).select("path", F.col("content").alias("png"))


def decoded(images: DataFrame) -> DataFrame:
    """images (path, png) with width, height and rgba; null for what can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, raw in zip(b["path"], b["png"], strict=True):
                try:
                    img = decode_png(bytes(raw))
                    out.append((path, img.shape[1], img.shape[0], img.tobytes()))
                except (ValueError, TypeError, IndexError):
                    out.append((path, None, None, None))
            yield pd.DataFrame(out, columns=["path", "width", "height", "rgba"])

    return images.select("path", "png").mapInPandas(run, "path string, width int, height int, rgba binary")


def data_url(png: Column) -> Column:
    return F.concat(F.lit("data:image/png;base64,"), F.base64(png))
