"""Nearest cells of positions by rings, as an equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.functions import geo
from fairlead.operators.grid import QuadGrid


def nearest_in_rings(points: DataFrame, cells: DataFrame, grid: QuadGrid, level: int, rings: int) -> DataFrame:
    """(k, cell, nm) for points(k, x, y): among cells of a level, the closest of the first ring that holds any; ties go to the lower cell."""
    home = points.select("k", "x", "y", grid.at(level, "x", "y").alias("home")).where("home IS NOT NULL")

    def ring(r: int):
        return F.transform(grid.ring_cells("home", r) if r else F.array("home"), lambda c: F.struct(F.lit(r).alias("ring"), c.alias("cell")))

    around = F.concat(*(ring(r) for r in range(rings + 1)))
    near = home.select("k", "x", "y", F.explode(around).alias("c")).select("k", "x", "y", "c.ring", "c.cell").join(cells.select("cell"), "cell")
    center = grid.center("cell")
    nm = geo.haversine_nm("y", "x", center["lat"], center["lon"])
    best = near.groupBy("k").agg(F.min(F.struct("ring", F.round(nm, 6).alias("rounded"), "cell", nm.alias("nm"))).alias("best"))
    return best.select("k", "best.cell", "best.nm")
