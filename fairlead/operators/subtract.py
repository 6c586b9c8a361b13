"""Land minus water without clipping polygons: membership and the boundary that is left, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.functions import geo
from fairlead.operators import spatial


def dry_points(points: DataFrame, land: DataFrame, water: DataFrame, key: str, size: float = spatial.COVER) -> DataFrame:
    """Keys of points(key, x, y) strictly inside land and neither in water nor on its edge."""
    inside = points.join(spatial.in_land(points, land, key, size), key, "left_semi")
    pairs = spatial.box_join(inside.select(key, "x", "y", spatial.point_box("x", "y").alias("lbox")), water, size)
    wet = pairs.where(geo.covers_point("x", "y", F.col("edges"))).select(key).distinct()
    return inside.join(wet, key, "left_anti").select(key)


def _cut_at_meetings(edges: DataFrame, other: DataFrame, size: float) -> DataFrame:
    """edges(id, x1, y1, x2, y2) cut where they meet edges of other."""
    pairs = spatial.box_join(edges.withColumnRenamed("rbox", "lbox"), other.selectExpr("x1 AS ox1", "y1 AS oy1", "x2 AS ox2", "y2 AS oy2", "rbox"), size)
    dx, dy, ex, ey = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("ox2") - F.col("ox1"), F.col("oy2") - F.col("oy1")
    cross = dx * ey - dy * ex
    t = F.when(cross != 0, ((F.col("ox1") - F.col("x1")) * ey - (F.col("oy1") - F.col("y1")) * ex) / cross)
    cuts = pairs.where(geo.segments_meet(("x1", "y1", "x2", "y2"), ("ox1", "oy1", "ox2", "oy2"))).select("id", t.alias("t")).where("t > 0 AND t < 1")
    at = cuts.groupBy("id").agg(F.array_sort(F.collect_set("t")).alias("ts"))
    whole = edges.join(at, "id", "left").withColumn("ts", F.concat(F.array(F.lit(0.0)), F.coalesce("ts", F.array().cast("array<double>")), F.array(F.lit(1.0))))
    parts = whole.select("id", "x1", "y1", "x2", "y2", F.explode(F.arrays_zip(F.slice("ts", F.lit(1), F.size("ts") - 1).alias("a"), F.slice("ts", F.lit(2), F.size("ts") - 1).alias("b"))).alias("p"))
    def at_t(n, p):
        return (F.col(f"{n}1") + (F.col(f"{n}2") - F.col(f"{n}1")) * F.col(f"p.{p}")).alias(f"{n}{'1' if p == 'a' else '2'}")

    return parts.select("id", at_t("x", "a"), at_t("y", "a"), at_t("x", "b"), at_t("y", "b")).dropDuplicates(["x1", "y1", "x2", "y2"]).withColumn("piece", F.struct("x1", "y1", "x2", "y2"))


def boundary(land_edges: DataFrame, water_edges: DataFrame, land: DataFrame, water: DataFrame, size: float = spatial.COVER) -> DataFrame:
    """(x1, y1, x2, y2, rbox) of what bounds land minus water: land's edges outside water, and water's edges inside land."""
    def numbered(e):
        return e.withColumn("id", F.struct("x1", "y1", "x2", "y2"))

    def middles(e):
        return e.withColumns({"x": (F.col("x1") + F.col("x2")) / 2, "y": (F.col("y1") + F.col("y2")) / 2})

    shore = middles(_cut_at_meetings(numbered(land_edges), water_edges, size))
    banks = middles(_cut_at_meetings(numbered(water_edges), land_edges, size))
    outside = shore.join(spatial.in_land(shore.select("piece", "x", "y"), water, "piece", size), "piece", "left_anti")
    inside = banks.join(spatial.in_land(banks.select("piece", "x", "y"), land, "piece", size), "piece", "left_semi")
    return spatial.edge_boxes(outside.select("x1", "y1", "x2", "y2").unionByName(inside.select("x1", "y1", "x2", "y2")))


def envelope_counts(land: DataFrame, water: DataFrame) -> DataFrame:
    """One row: land polygons, those whose box meets the common box of the water, and water polygons; of (poly_id, rings) each."""
    def boxes(df):
        return df.select(geo.box_of(F.element_at("rings", 1)).alias("b")).select("b.*")

    common = boxes(water).agg(F.struct(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).alias("common"), F.count("*").alias("n_water"))
    each = boxes(land).select(F.struct("x0", "y0", "x1", "y1").alias("own")).join(F.broadcast(common))
    return each.agg(F.count("*").alias("n_land"), F.count_if(geo.boxes_meet("own", "common")).alias("n_meeting"), F.max("n_water").alias("n_water"))


class Land:
    """What the cascade and the edges ask of land."""

    def __init__(self, shapes: DataFrame, coast: DataFrame):
        self.shapes, self.coast = shapes, coast

    def touching(self, cells: DataFrame, grid) -> DataFrame:
        return spatial.touching_land(cells, self.shapes, grid)

    def inside(self, cells: DataFrame, grid) -> DataFrame:
        return spatial.inside_land(cells, self.shapes, grid)

    def holding(self, points: DataFrame, key: str) -> DataFrame:
        return spatial.in_land(points, self.shapes, key)


class DryLand(Land):
    """Land minus water, by its boundary and by membership of points.

    A cell touches it if the boundary meets the cell or the cell's centre is dry; a cell lies inside it if its centre is
    dry and the boundary doesn't meet it. A cell whose edge runs along the boundary counts as touching only.
    """

    def __init__(self, land: DataFrame, water: DataFrame):
        shapes, self.water = spatial.land_shapes(land), spatial.land_shapes(water)
        super().__init__(shapes, boundary(spatial.coast_edges(land), spatial.coast_edges(water), shapes, self.water))

    def _meeting(self, cells: DataFrame, grid) -> DataFrame:
        pairs = spatial.box_join(spatial.cell_shapes(cells.select("cell"), grid), self.coast)
        end = geo.covers_point("x1", "y1", F.col("cell_edges"))
        cross = F.exists("cell_edges", lambda e: geo.segments_meet((F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")), (e["x1"], e["y1"], e["x2"], e["y2"])))
        return pairs.where(end | cross).select("cell").distinct()

    def _dry(self, cells: DataFrame, grid) -> DataFrame:
        center = cells.select("cell", grid.center("cell").alias("c")).select("cell", F.col("c.lon").alias("x"), F.col("c.lat").alias("y"))
        return dry_points(center, self.shapes, self.water, "cell")

    def touching(self, cells: DataFrame, grid) -> DataFrame:
        return self._meeting(cells, grid).unionByName(self._dry(cells, grid)).distinct()

    def inside(self, cells: DataFrame, grid) -> DataFrame:
        return self._dry(cells, grid).join(self._meeting(cells, grid), "cell", "left_anti")

    def holding(self, points: DataFrame, key: str) -> DataFrame:
        return dry_points(points, self.shapes, self.water, key)
