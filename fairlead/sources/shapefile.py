"""ESRI shapefile polygons as a Spark data source, one partition for each file.

The `.shp` layout is public: a 100-byte header, then records of a big-endian header (number, length in 16-bit
words) and little-endian content; shape type 5 is a polygon (15 and 25 carry extra values that are skipped). Files
are read by Spark's binaryFile source, so any store that Spark reads will do.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairlead.functions.tables import ship

POLYGONS = (5, 15, 25)
RING = "path string, shape long, ring int, is_outer boolean, pts array<struct<x:double,y:double>>"


def records(data: bytes) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(record number, rings as arrays of x and y) of each polygon; other shapes are skipped."""
    if len(data) < 100 or struct.unpack(">i", data[:4])[0] != 9994:
        raise ValueError("not a shapefile")
    at = 100
    while at + 8 <= len(data):
        number, words = struct.unpack_from(">2i", data, at)
        at += 8
        if at + 2 * words > len(data):
            raise ValueError("the shapefile is cut short")
        if struct.unpack_from("<i", data, at)[0] in POLYGONS:
            parts, points = struct.unpack_from("<2i", data, at + 36)
            start = np.frombuffer(data, "<i4", parts, at + 44)
            xy = np.frombuffer(data, "<f8", 2 * points, at + 44 + 4 * parts).reshape(-1, 2)
            yield number, np.split(xy, start[1:])
        at += 2 * words


def clockwise(ring: np.ndarray) -> bool:
    """Outer rings run clockwise."""
    x, y = ring[:, 0], ring[:, 1]
    return float(np.sum((np.roll(x, -1) - x) * (np.roll(y, -1) + y))) > 0


def write(path: str, shapes: list[list[list[tuple[float, float]]]]) -> None:
    """A small .shp file of polygons, for fixtures."""
    body = b""
    for number, rings in enumerate(shapes, 1):
        xy = np.array([p for ring in rings for p in ring], "<f8")
        starts = np.cumsum([0] + [len(r) for r in rings[:-1]]).astype("<i4")
        content = struct.pack("<i4d2i", 5, *xy.min(axis=0), *xy.max(axis=0), len(rings), len(xy)) + starts.tobytes() + xy.tobytes()
        body += struct.pack(">2i", number, len(content) // 2) + content
    with open(path, "wb") as out:
        out.write(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8) + body)


def read_rings(spark: SparkSession, path: str) -> DataFrame:
    """RING rows of all *.shp files of a folder, or of one file; an error if there is none."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.shp").load(path).select("path", "content")
    if files.select("path").isEmpty():
        raise FileNotFoundError(f"no .shp files in {path}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                rows = [(name, number, i, clockwise(ring), [{"x": x, "y": y} for x, y in ring.tolist()]) for number, rings in records(content) for i, ring in enumerate(rings)]
                points = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
                kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), points]
                columns = zip(*rows, strict=True) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "shape", "ring", "is_outer", "pts"])

    return files.mapInArrow(run, RING)


def polygon_numbers(rings: DataFrame, shape: str | list[str], order: str, is_outer: str) -> DataFrame:
    """rings with poly, the running count of outer rings in their shape; rings before the first outer one are dropped."""
    run = F.sum(F.col(is_outer).cast("int")).over(Window.partitionBy(shape).orderBy(order))
    return rings.withColumn("poly", run).where("poly > 0")


def read_land(spark: SparkSession, path: str) -> DataFrame:
    """(path, shape, poly, rings): polygons with their exterior first. Nothing is clipped, on purpose."""
    numbered = polygon_numbers(read_rings(spark, path), ["path", "shape"], "ring", "is_outer")
    return numbered.groupBy("path", "shape", "poly").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "pts"))), lambda r: r["pts"]).alias("rings"))
