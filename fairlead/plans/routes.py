"""Batches of route requests: a DataFrame in, a DataFrame out, answered on the JVM; single searches in Arrow kernels.

The chart (nodes, adjacency and coast) is broadcast: for routes one copy for each executor, for the Arrow kernels one for each
Python worker. Its bytes are reckoned from counted rows before any is collected: a chart over MOST_BYTES is refused with an error
that says so. It takes NODE_BYTES a node, EDGE_BYTES a directed edge and COAST_BYTES a coast segment, on a grid with 8 neighbours
about 0.1 GB for a million nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.functions import geo
from fairlead.functions.tables import ship
from fairlead.operators import kernel
from fairlead.operators.grid import QuadGrid
from fairlead.operators.router import router

MOST_BYTES = 4 << 30
NODE_BYTES, EDGE_BYTES, COAST_BYTES = 34, 8, 88


def snap_rule(grid: QuadGrid, levels: range) -> kernel.SnapRule:
    edge = {level: grid.base / 2**level * geo.DEGREE_NM / 2 for level in levels}
    most = {level: 15 if level <= levels[0] + 1 else 20 for level in levels}
    return kernel.SnapRule(edge, most)


def chart(nodes: DataFrame, edges: DataFrame, coast: DataFrame) -> kernel.Chart:
    """nodes(node_id, cell, lat, lon, shore_q), edges(src, dst, weight_cnm) both ways, coast(x1, y1, x2, y2)."""
    size = nodes.count() * NODE_BYTES + edges.count() * EDGE_BYTES + coast.count() * COAST_BYTES
    if size > MOST_BYTES:
        raise ValueError(f"the chart takes {size} bytes in each worker; at most {MOST_BYTES} are broadcast")
    columns = ["cell", "lat", "lon", "shore_q", *(["main"] if "main" in nodes.columns else [])]
    n = nodes.orderBy("node_id").select(*columns).toArrow()
    e = edges.select("src", "dst", "weight_cnm").orderBy("src", "dst").toArrow()
    c = coast.select("x1", "y1", "x2", "y2").toArrow()

    def column(table: pa.Table, name: str, kind: type) -> np.ndarray:
        return table[name].to_numpy().astype(kind, copy=False)

    offsets, target, weight = kernel.adjacency(n.num_rows, *(column(e, x, np.int32) for x in ("src", "dst", "weight_cnm")))
    main = column(n, "main", bool) if "main" in columns else np.ones(n.num_rows, bool)
    rows = np.stack([column(c, x, np.float32) for x in ("x1", "y1", "x2", "y2")], axis=1)  # the stored coast is single precision
    return kernel.Chart(column(n, "cell", np.int64), column(n, "lat", float), column(n, "lon", float), column(n, "shore_q", np.uint8), main, offsets, target, weight, kernel.Coast(rows))


def route(spark: SparkSession, requests: DataFrame, held: kernel.Chart, grid: QuadGrid, rule: kernel.SnapRule) -> DataFrame:
    """requests(req_id, from_lat, from_lon, to_lat, to_lon, shore_buffer_nm) with result (null if there is no way) and error.

    Errors: 400 for a position or buffer out of range, 404 for no way. Requests to one goal that follow each other share estimates.
    """
    asked = requests.selectExpr("cast(req_id AS long) AS req_id", *(f"cast({c} AS double) AS {c}" for c in ("from_lat", "from_lon", "to_lat", "to_lon")), "coalesce(cast(shore_buffer_nm AS double), 0D) AS shore_buffer_nm")
    good = F.lit(True)
    for c, limit in (("from_lat", 90.0), ("to_lat", 90.0), ("from_lon", 180.0), ("to_lon", 180.0)):
        good = good & F.coalesce(F.col(c).between(-limit, limit), F.lit(False))
    asked = asked.withColumn("valid", good & geo.valid_buffer("shore_buffer_nm"))
    ends = ("from_lat", "from_lon", "to_lat", "to_lon", "shore_buffer_nm")
    found = asked.withColumn("result", F.when(F.col("valid"), router(spark, held, grid, rule)(*ends)))
    error = F.when(~F.col("valid"), "400").when(F.col("result").isNull(), "404")
    return found.select("req_id", *ends, "result", error.alias("error"))


def response(routed: DataFrame) -> DataFrame:
    """req_id, status and the JSON body of each answer: distances to a tenth of a mile, geometry as GeoJSON."""
    geometry = F.struct(F.lit("LineString").alias("type"), F.col("result.coordinates").alias("coordinates"))
    body = F.struct(geo.round_tenth("result.distance_nm").alias("distance_nm"), F.col("result.raw_hops").alias("raw_hops"), F.col("result.smooth_hops").alias("smooth_hops"), F.col("result.land_legs").alias("land_legs"), F.col("shore_buffer_nm"), geometry.alias("geometry"))
    why = F.struct(F.when(F.col("error") == "400", "position or shore buffer out of range").otherwise("no route found").alias("error"))
    return routed.select("req_id", F.coalesce("error", F.lit("200")).cast("int").alias("status"), F.when(F.col("error").isNull(), F.to_json(body)).otherwise(F.to_json(why)).alias("body"))


def info(nodes: DataFrame, edges: DataFrame, version: int = 3) -> DataFrame:
    """One row: format version, nodes, directed edges."""
    return nodes.agg(F.count("*").alias("num_nodes")).crossJoin(edges.agg(F.count("*").alias("num_edges"))).select(F.lit(version).alias("version"), "num_nodes", "num_edges")


def searched(spark: SparkSession, pairs: DataFrame, held: kernel.Chart, buffer_nm: float = 0.0) -> DataFrame:
    """pairs(start, goal) with path, the node ids of a cheapest way (null if there is none), and cost_cnm, its weights in hundredths."""
    ship(spark)
    shared = spark.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, costs = [], []
            for start, goal in zip(batch["start"].to_pylist(), batch["goal"].to_pylist(), strict=True):
                found = kernel.search(shared.value, start, goal, buffer_nm, exact=True)
                paths.append(found and found[0])
                costs.append(found and sum(round(float(w[t == b][0]) * 100) for a, b in pairwise(found[0]) for t, w in [shared.value.neighbors(a)]))
            yield pa.RecordBatch.from_arrays([batch["start"], batch["goal"], pa.array(paths, pa.list_(pa.int32())), pa.array(costs, pa.int64())], names=["start", "goal", "path", "cost_cnm"])

    return pairs.select(F.col("start").cast("int"), F.col("goal").cast("int")).mapInArrow(run, "start int, goal int, path array<int>, cost_cnm long")


def smoothed(spark: SparkSession, paths: DataFrame, coast: kernel.Coast, buffer_nm: float = 0.0) -> DataFrame:
    """paths(path_id, pts array<struct<x, y>>) with kept (indices of the points kept), land (kept legs that cross land) and water_nm."""
    ship(spark)
    shared = spark.sparkContext.broadcast(coast)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pts in batch["pts"].to_pylist():
                line = [(p["x"], p["y"]) for p in pts]
                q = [min(255, int(shared.value.point_nm(*p) / geo.SHORE_UNIT_NM)) for p in line] if buffer_nm > 0 else [255] * len(line)
                kept, land = kernel.smooth(line, q, shared.value, buffer_nm)
                out.append((kept, land, kernel.water_nm([line[i] for i in kept], land)))
            kept, land, water = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch["path_id"], pa.array(kept, pa.list_(pa.int32())), pa.array(land, pa.list_(pa.int32())), pa.array(water, pa.float64())], names=["path_id", "kept", "land", "water_nm"])

    return paths.select(F.col("path_id").cast("long"), "pts").mapInArrow(run, "path_id long, kept array<int>, land array<int>, water_nm double")


def costs_from(spark: SparkSession, starts: DataFrame, held: kernel.Chart) -> DataFrame:
    """(start, node_id, cost_cnm): exact least costs from each of starts(start) to all nodes, in whole hundredths."""
    ship(spark)
    shared = spark.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import heapq

        chart = shared.value
        weights = np.round(chart.weight.astype(float) * 100).astype(np.int64)
        for batch in batches:
            for start in batch["start"].to_pylist():
                cost, queue = {start: 0}, [(0, start)]
                while queue:
                    d, node = heapq.heappop(queue)
                    if d > cost[node]:
                        continue
                    for other, w in zip(chart.neighbors(node)[0].tolist(), weights[chart.offsets[node] : chart.offsets[node + 1]].tolist(), strict=True):
                        if d + w < cost.get(other, 1 << 62):
                            cost[other] = d + w
                            heapq.heappush(queue, (d + w, other))
                yield pa.RecordBatch.from_arrays([pa.array([start] * len(cost), pa.int32()), pa.array(list(cost), pa.int32()), pa.array(list(cost.values()))], names=["start", "node_id", "cost_cnm"])

    return starts.select(F.col("start").cast("int")).mapInArrow(run, "start int, node_id int, cost_cnm long")
