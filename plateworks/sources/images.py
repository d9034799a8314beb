"""Pictures as scanline tables through Spark's image source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scanlines(spark: SparkSession, folder: str) -> DataFrame:
    """One row per image line: path, y, px (its grey values) and problem (null).

    Grey pictures are taken as they are, of pictures with an alpha channel the colours. An undecodable file gives one row
    with problem UNDECODABLE, a picture of another kind one with UNSUPPORTED; y and px are null there. The source
    decodes to 8 bits and applies neither orientation nor colour conversion. Only the bytes of a line travel with its row.
    """
    image = F.col("image")
    depth, width, height = image["nChannels"], image["width"], image["height"]
    pictures = spark.read.format("image").load(folder)
    problem = F.when((height < 1) | (width < 1) | (depth < 1), "UNDECODABLE").when(~depth.isin(1, 3, 4), "UNSUPPORTED")
    rows = F.when(problem.isNull(), F.transform(F.sequence(F.lit(0), height - 1), lambda y: F.substring(image["data"], y * width * depth + 1, width * depth)))
    lines = pictures.select(image["origin"].alias("path"), depth.alias("depth"), problem.alias("problem"), F.posexplode_outer(rows).alias("y", "line"))

    def gray(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for depth, line in zip(batch.column("depth").to_pylist(), batch.column("line").to_pylist()):
                px = None if line is None else np.frombuffer(line, np.uint8).reshape(-1, depth).astype(float)
                # the source's order is blue, green, red
                out.append(None if px is None else px[:, 0] if depth == 1 else (px[:, 2] * 299 + px[:, 1] * 587 + px[:, 0] * 114) / 1000)
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("y").cast(pa.int64()), pa.array(out, pa.list_(pa.float64())), batch.column("problem")], ["path", "y", "px", "problem"])

    return lines.mapInArrow(gray, "path string, y long, px array<double>, problem string")
