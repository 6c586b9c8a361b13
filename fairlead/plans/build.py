"""From land polygons to a stored routing graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.functions import geo
from fairlead.functions.tables import Scratch
from fairlead.operators import graph, spatial
from fairlead.operators.cascade import Cascade, cascade_cells
from fairlead.operators.subtract import DryLand, Land
from fairlead.sources import graph_store


def coastline(land: DataFrame) -> DataFrame:
    """(seg_id, pts): all rings, exteriors and holes, cut to polylines of at most 256 points."""
    lines = land.select("poly_id", F.posexplode("rings").alias("ring", "points")).select("poly_id", "ring", F.posexplode(geo.chunks("points")).alias("chunk", "pts"))
    return lines.select(F.struct("poly_id", "ring", "chunk").alias("seg_id"), "pts")


def chunk_points(points: DataFrame, line: str, i: str, most: int = 256) -> DataFrame:
    """points of polylines (i from 0) with the chunk they belong to; a chunk's last point is the next one's first. No polyline is held as an array."""
    step = most - 1
    own = F.expr(f"div({i}, {step})")
    chunks = F.when((F.col(i) % step == 0) & (F.col(i) > 0), F.array(own - 1, own)).otherwise(F.array(own))
    last = points.groupBy(line).agg(F.max(i).alias("last"))
    return points.withColumn("chunk", F.explode(chunks)).join(last, line).where(F.col("chunk") * step < F.col("last")).drop("last")


def build(spark: SparkSession, land: DataFrame, config: Cascade, passages: DataFrame | None = None, box: tuple[float, float, float, float] | None = None, water: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges (both ways) and coast of land(poly_id, rings); each stage is written before the next.

    water(poly_id, rings) is taken off the land, and the stored coast runs along what is left.
    """
    scratch, grid = Scratch(spark), config.grid
    water = None if water is None else scratch.keep(water, "water")
    solid = Land(spatial.land_shapes(land), spatial.coast_edges(land)) if water is None else DryLand(land, water)
    solid.shapes, solid.coast = scratch.keep(solid.shapes, "shapes"), scratch.keep(solid.coast, "coast")
    cells = scratch.keep(cascade_cells(spark, solid, config, passages, box), "cells")
    edges = scratch.keep(graph.graph_edges(cells, solid, grid), "edges")
    labels = graph.component_labels(spark, cells, edges)
    cells, edges = graph.prune(cells, edges, graph.main_component(labels))
    coast = solid.coast
    nodes = scratch.keep(graph.nodes_of(cells, graph.shore_distance(cells, coast, grid), grid), "nodes")
    return nodes, graph.edge_rows(edges, nodes), coast


def run(spark: SparkSession, land: DataFrame, path: str, config: Cascade, **how) -> list[str]:
    """Builds and stores a graph; returns its faults, which should be none."""
    nodes, edges, coast = build(spark, land, config, **how)
    graph_store.save(spark, path, nodes, edges, coast)
    return graph_store.faults(*graph_store.load(spark, path, check=False)[:2])
