"""The adaptive grid: cells of open water, finer towards the coast.

A fixed number of rounds, one for each level, each written to the shared folder: a level's cells that are far from
the coast and free of land are kept, the others give way to their children, of which those wholly in land go (but
for those whose centre lies in a passage corridor). On the leaf level only cells free of land are kept; leaf
cells in passage zones are refined further, up to the passage's own level; those wholly in land go, as cells of this
grid lie within their parents and theirs would too.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.functions import geo
from fairlead.functions.tables import Scratch
from fairlead.operators import spatial
from fairlead.operators.subtract import Land
from fairlead.operators.grid import QuadGrid


@dataclass(frozen=True)
class Cascade:
    """Thresholds in degrees of the levels above the leaf level, and the level on which zones are looked up.

    By default the whole globe, from 1 degree down to 1/1024. The survey's thresholds belong to a grid whose cells shrink by the
    square root of 7 a level; each level here takes that of the finest survey level whose cells, by area, are no smaller.
    """

    thresholds: tuple[tuple[int, float], ...] = ((0, 0.30), (1, 0.30), (2, 0.15), (3, 0.05), (4, 0.05), (5, 0.025), (6, 0.012), (7, 0.012), (8, 0.005), (9, 0.002))
    leaf: int = 10
    zone: int = 3
    grid: QuadGrid = field(default_factory=QuadGrid)


PLANET = Cascade()


def coast_clearance(cells: DataFrame, coast: DataFrame, grid: QuadGrid, radius: float) -> DataFrame:
    """(cell, d): least distance in degrees from a cell's centre and corners to the coast within the radius; null if none."""
    center = grid.center("cell")
    points = F.concat(F.array(F.struct(center["lon"].alias("x"), center["lat"].alias("y"))), grid.ring("cell"))
    asked = cells.select("cell", F.posexplode(points).alias("i", "p")).select("cell", F.struct("cell", "i").alias("point"), "p.*")
    cover = min(max(spatial.COVER, radius), max(4 * radius, 0.1))  # fine levels meet only the edges near them
    d = spatial.coast_distance_deg(asked, coast, "point", radius, cover)
    return d.groupBy(F.col("point.cell").alias("cell")).agg(F.min("d").alias("d"))


def classify(cells: DataFrame, land: Land, grid: QuadGrid, threshold: float, radius: float) -> DataFrame:
    """cells with `far` (beyond the threshold) and `touches` (land, asked only of far cells) and `keep`."""
    clear = coast_clearance(cells, land.coast, grid, threshold + radius)
    asked = cells.join(clear, "cell").withColumn("far", F.coalesce(F.col("d") > threshold, F.lit(True)))
    touch = land.touching(asked.where("far"), grid).withColumn("touches", F.lit(True))
    return asked.join(touch, "cell", "left").withColumn("touches", F.coalesce("touches", ~F.col("far"))).withColumn("keep", F.col("far") & ~F.col("touches"))


def in_corridor(cells: DataFrame, passages: DataFrame, grid: QuadGrid) -> DataFrame:
    """Cells whose centre lies in a passage's corridor, edges included."""
    center = cells.select("cell", grid.center("cell").alias("c")).select("cell", F.col("c.lon").alias("x"), F.col("c.lat").alias("y"))
    boxes = passages.selectExpr("struct(min_lon AS x0, min_lat AS y0, max_lon AS x1, max_lat AS y1) AS rbox")
    return spatial.box_join(center.withColumn("lbox", spatial.point_box("x", "y")), boxes).select("cell").distinct()


def children_of(refine: DataFrame, land: Land, grid: QuadGrid, passages: DataFrame | None) -> DataFrame:
    """Children of cells; where the parent touches land, those wholly in land go unless a corridor holds their centre."""
    touch = land.touching(refine, grid)
    free = refine.join(touch, "cell", "left_anti").select(F.explode(grid.children("cell")).alias("cell"))
    near = touch.select(F.explode(grid.children("cell")).alias("cell"))
    buried = land.inside(near, grid)
    if passages is not None:
        buried = buried.join(in_corridor(buried, passages, grid), "cell", "left_anti")
    return free.unionByName(near.join(buried, "cell", "left_anti"))


def zones(passages: DataFrame, grid: QuadGrid, level: int) -> DataFrame:
    """(zone, leaf): zone-level cells that a corridor meets, with the finest leaf level asked for."""
    size = grid.base / 2**level
    def span(a: str, b: str, low: float, n: int):
        return F.explode(F.sequence(F.greatest(F.floor((F.col(a) - low) / size), F.lit(0)), F.least(F.floor((F.col(b) - low) / size), F.lit((n << level) - 1))))

    inside = passages.where((F.col("max_lon") >= grid.x0) & (F.col("min_lon") < grid.x0 + grid.nx * grid.base) & (F.col("max_lat") >= grid.y0) & (F.col("min_lat") < grid.y0 + grid.ny * grid.base))
    cells = inside.withColumn("ix", span("min_lon", "max_lon", grid.x0, grid.nx)).withColumn("iy", span("min_lat", "max_lat", grid.y0, grid.ny))
    return cells.groupBy(grid.pack(level, F.col("ix"), F.col("iy")).alias("zone")).agg(F.max("leaf_resolution").cast("int").alias("leaf"))


def split_zones(cells: DataFrame, zone_leaf: DataFrame, grid: QuadGrid, level: int) -> tuple[DataFrame, DataFrame]:
    """(cells in zones, with leaf) and the others."""
    size = grid.size(grid.level("cell")) / (grid.base / 2**level)
    zone = grid.pack(level, F.floor(grid.ix("cell") * size), F.floor(grid.iy("cell") * size)).alias("zone")
    both = cells.select("cell", zone).join(zone_leaf, "zone", "left")
    return both.where("leaf IS NOT NULL").select("cell", "leaf"), both.where("leaf IS NULL").select("cell")


def cascade_cells(spark: SparkSession, land: Land, config: Cascade, passages: DataFrame | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(cell) of the navigable grid, each once."""
    grid, scratch = config.grid, Scratch(spark)
    base = config.thresholds[0][0] if config.thresholds else config.leaf
    now = grid.all_cells(spark, base, box)
    now = now.join(land.inside(now, grid), "cell", "left_anti")
    kept = []
    for level, threshold in config.thresholds:
        radius = grid.base / 2**level * 0.75  # a little over half a diagonal
        judged = scratch.keep(classify(now, land, grid, threshold, radius), f"level{level}")
        kept.append(judged.where("keep").select("cell"))
        now = scratch.keep(children_of(judged.where("NOT keep").select("cell"), land, grid, passages), f"children{level}")
    special = None
    if passages is not None:
        zone_leaf = zones(passages, grid, config.zone).where(F.col("leaf") > config.leaf)
        special, now = split_zones(now, zone_leaf, grid, config.zone)
        special = scratch.keep(special.join(land.inside(special, grid), "cell", "left_anti"), "zones")
    kept.append(now.join(land.touching(now, grid), "cell", "left_anti"))
    level = config.leaf
    while special is not None and not special.isEmpty():
        touch = land.touching(special.select("cell"), grid)
        kept.append(special.join(touch, "cell", "left_anti").select("cell"))
        level += 1
        finer = special.join(touch, "cell", "left_semi").where(F.col("leaf") >= level)
        finer = scratch.keep(finer.select(F.explode(grid.children("cell")).alias("cell"), "leaf"), f"finer{level}")
        special = scratch.keep(finer.join(land.inside(finer, grid), "cell", "left_anti"), f"zone{level}")
    out = kept[0]
    for part in kept[1:]:
        out = out.unionByName(part)
    return out.dropDuplicates(["cell"])
