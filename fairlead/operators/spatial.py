"""Spatial joins as equi-joins on cover cells.

Spark has no spatial index, so both sides list the square cells (of a given size in degrees) that their boxes
touch, meet on equal cells and are then tested exactly. A pair that shares several cells is kept in one of them
only: that which holds the lower left corner of the boxes' intersection. Nothing is deduplicated by a shuffle, and
whether a side is broadcast is left to Spark's size estimates.

Shapes are `edges`: arrays of structs (x1, y1, x2, y2) with all rings' edges, holes included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.functions import geo

COVER = 2.0


def cover(df: DataFrame, box: str, size: float = COVER, reach: float | Column = 0.0) -> DataFrame:
    """df once for each cover cell (cx, cy) that its box, widened by reach, touches."""
    def cells(low: str, high: str) -> Column:
        return F.sequence(F.floor((F.col(f"{box}.{low}") - reach) / size), F.floor((F.col(f"{box}.{high}") + reach) / size))

    return df.withColumn("cx", F.explode(cells("x0", "x1"))).withColumn("cy", F.explode(cells("y0", "y1")))


def box_join(left: DataFrame, right: DataFrame, size: float = COVER, reach: float | Column = 0.0) -> DataFrame:
    """Pairs of left (box column lbox) and right (rbox) whose closed boxes meet, the left widened by reach."""
    wide = left.withColumn("lbox", F.struct((F.col("lbox.x0") - reach).alias("x0"), (F.col("lbox.y0") - reach).alias("y0"), (F.col("lbox.x1") + reach).alias("x1"), (F.col("lbox.y1") + reach).alias("y1")))
    pairs = cover(wide, "lbox", size).join(cover(right, "rbox", size), ["cx", "cy"]).where(geo.boxes_meet("lbox", "rbox"))
    corner = [F.floor(F.greatest(F.col(f"lbox.{n}"), F.col(f"rbox.{n}")) / size) for n in ("x0", "y0")]
    return pairs.where((F.col("cx") == corner[0]) & (F.col("cy") == corner[1])).drop("cx", "cy")


def land_shapes(land: DataFrame) -> DataFrame:
    """land(poly_id, rings) with rbox and edges; rings[0] is the exterior, the others are holes."""
    edges = F.flatten(F.transform("rings", geo.ring_edges))
    return land.select("poly_id", geo.box_of(F.element_at("rings", 1)).alias("rbox"), edges.alias("edges"))


def coast_edges(land: DataFrame) -> DataFrame:
    """(x1, y1, x2, y2) of all rings, with rbox."""
    edges = land.select(F.explode("rings").alias("ring")).select(F.explode(geo.ring_edges("ring")).alias("e")).select("e.*")
    return edge_boxes(edges)


def edge_boxes(edges: DataFrame) -> DataFrame:
    box = F.struct(F.least("x1", "x2").alias("x0"), F.least("y1", "y2").alias("y0"), F.greatest("x1", "x2").alias("x1"), F.greatest("y1", "y2").alias("y1"))
    return edges.withColumn("rbox", box)


def point_box(x: str, y: str) -> Column:
    return F.struct(F.col(x).alias("x0"), F.col(y).alias("y0"), F.col(x).alias("x1"), F.col(y).alias("y1"))


def in_land(points: DataFrame, shapes: DataFrame, key: str, size: float = COVER) -> DataFrame:
    """Keys of points(key, x, y) strictly inside some land polygon; a point on a boundary is water."""
    pairs = box_join(points.select(key, "x", "y", point_box("x", "y").alias("lbox")), shapes, size)
    return pairs.where(geo.strictly_inside("x", "y", F.col("edges"))).select(key).distinct()


def is_water(points: DataFrame, shapes: DataFrame, key: str, size: float = COVER) -> DataFrame:
    """points that lie in no land polygon."""
    return points.join(in_land(points, shapes, key, size), key, "left_anti")


def cell_shapes(cells: DataFrame, grid, key: str = "cell") -> DataFrame:
    """cells with lbox and cell_edges; a cell that reaches past the seam stands there twice, shifted."""
    ring = F.explode(geo.seam_copies(grid.ring(key))).alias("cell_ring")
    return cells.select("*", ring).select(*cells.columns, geo.box_of("cell_ring").alias("lbox"), geo.ring_edges("cell_ring").alias("cell_edges"))


def touching_land(cells: DataFrame, shapes: DataFrame, grid, key: str = "cell", size: float = COVER) -> DataFrame:
    """Keys of cells that share a point with some land polygon."""
    pairs = box_join(cell_shapes(cells.select(key), grid, key), shapes, size)
    return pairs.where(geo.areas_meet("cell_edges", "edges")).select(key).distinct()


def inside_land(cells: DataFrame, shapes: DataFrame, grid, key: str = "cell", size: float = COVER) -> DataFrame:
    """Keys of cells that one land polygon contains."""
    pairs = box_join(cell_shapes(cells.select(key), grid, key), shapes, size)
    return pairs.where(geo.area_holds("edges", "cell_edges")).select(key).distinct()


def crossing(segments: DataFrame, coast: DataFrame, key: str, size: float = COVER) -> DataFrame:
    """Keys of segments(key, lon1, lat1, lon2, lat2) that meet the coast (touching counts); split at the seam first."""
    parts = segments.select(key, F.explode(geo.split_at_seam("lon1", "lat1", "lon2", "lat2")).alias("s"))
    parts = parts.select(key, F.col("s.x1").alias("sx1"), F.col("s.y1").alias("sy1"), F.col("s.x2").alias("sx2"), F.col("s.y2").alias("sy2"))
    box = F.struct(F.least("sx1", "sx2").alias("x0"), F.least("sy1", "sy2").alias("y0"), F.greatest("sx1", "sx2").alias("x1"), F.greatest("sy1", "sy2").alias("y1"))
    pairs = box_join(parts.withColumn("lbox", box), coast, size)
    return pairs.where(geo.segments_meet(("sx1", "sy1", "sx2", "sy2"), ("x1", "y1", "x2", "y2"))).select(key).distinct()


def coast_distance_deg(points: DataFrame, coast: DataFrame, key: str, radius: float, size: float = COVER) -> DataFrame:
    """key and d, the planar distance in degrees to the coast within a box of radius round points(key, x, y); null if none."""
    asked = points.select(key, "y", "x", F.explode(geo.seam_shifts("x", "x", radius)).alias("shift"))
    asked = asked.withColumn("x", F.col("x") + F.col("shift")).withColumn("lbox", point_box("x", "y"))
    pairs = box_join(asked, coast, size, reach=radius)
    least = pairs.groupBy(key).agg(F.min(geo.point_segment("x", "y", "x1", "y1", "x2", "y2")).alias("d"))
    return points.select(key).join(least, key, "left")


def coast_distance_nm(points: DataFrame, coast: DataFrame, key: str, cap: float = geo.SHORE_CAP_NM, size: float = COVER) -> DataFrame:
    """key and d, nautical miles to the coast in the point's local frame, at most cap."""
    cos = geo.cos_lat("y")
    asked = points.select(key, "x", "y", F.explode(geo.seam_shifts("x", "x", geo.lon_reach(cap, cos))).alias("shift")).withColumn("x", F.col("x") + F.col("shift"))
    reach = F.struct((F.col("x") - geo.lon_reach(cap, cos)).alias("x0"), (F.col("y") - cap / geo.DEGREE_NM).alias("y0"), (F.col("x") + geo.lon_reach(cap, cos)).alias("x1"), (F.col("y") + cap / geo.DEGREE_NM).alias("y1"))
    pairs = box_join(asked.withColumn("lbox", reach), coast, size)
    (ax, ay), (bx, by) = geo.to_frame("x1", "y1", "x", "y", cos), geo.to_frame("x2", "y2", "x", "y", cos)
    least = pairs.groupBy(key).agg(F.min(geo.point_segment(F.lit(0.0), F.lit(0.0), ax, ay, bx, by)).alias("d"))
    return points.select(key).join(least, key, "left").select(key, F.least(F.coalesce("d", F.lit(cap)), F.lit(cap)).alias("d"))


def segment_distance_nm(segments: DataFrame, coast: DataFrame, key: str, cap: float = geo.SHORE_CAP_NM, size: float = COVER) -> DataFrame:
    """key and d, nautical miles between segments(key, lon1, lat1, lon2, lat2) and the coast in the segment's middle frame, at most cap; 0 if they meet."""
    parts = segments.select(key, F.explode(geo.split_at_seam("lon1", "lat1", "lon2", "lat2")).alias("s")).select(key, "s.*").toDF(key, "sx1", "sy1", "sx2", "sy2")
    middle = (F.col("sy1") + F.col("sy2")) / 2
    cos = geo.cos_lat(middle)
    shifts = geo.seam_shifts(F.least("sx1", "sx2"), F.greatest("sx1", "sx2"), geo.lon_reach(cap, cos))
    asked = parts.withColumn("shift", F.explode(shifts)).withColumns({"sx1": F.col("sx1") + F.col("shift"), "sx2": F.col("sx2") + F.col("shift")})
    reach, up = geo.lon_reach(cap, cos), cap / geo.DEGREE_NM
    box = F.struct((F.least("sx1", "sx2") - reach).alias("x0"), (F.least("sy1", "sy2") - up).alias("y0"), (F.greatest("sx1", "sx2") + reach).alias("x1"), (F.greatest("sy1", "sy2") + up).alias("y1"))
    pairs = box_join(asked.withColumn("lbox", box), coast, size)
    def frame(x, y):
        return geo.to_frame(x, y, (F.col("sx1") + F.col("sx2")) / 2, middle, cos)

    d = geo.segment_segment((*frame("sx1", "sy1"), *frame("sx2", "sy2")), (*frame("x1", "y1"), *frame("x2", "y2")))
    least = pairs.groupBy(key).agg(F.min(d).alias("d"))
    return segments.select(key).join(least, key, "left").select(key, F.least(F.coalesce("d", F.lit(cap)), F.lit(cap)).alias("d"))
