"""A quadtree grid of cells as column expressions.

A cell id packs (level, ix, iy) into a BIGINT that sorts by level, then column, then row. Level 0 has nx by ny
cells of `base` degrees from (x0, y0); each level halves them. Columns wrap round the globe if nx * base is 360.
Everything that reads cells goes through this class, so another grid can stand in for it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.functions.geo import C, col

SHIFT = 26
MASK = (1 << SHIFT) - 1


@dataclass(frozen=True)
class QuadGrid:
    x0: float = -180.0
    y0: float = -90.0
    base: float = 1.0
    nx: int = 360
    ny: int = 180

    @property
    def wraps(self) -> bool:
        return self.nx * self.base == 360.0

    def pack(self, level: C, ix: Column, iy: Column) -> Column:
        level = F.lit(level) if isinstance(level, int) else col(level)
        return F.shiftleft(level.cast("long"), 2 * SHIFT).bitwiseOR(F.shiftleft(ix.cast("long"), SHIFT)).bitwiseOR(iy.cast("long"))

    def level(self, cell: C) -> Column:
        return F.shiftright(col(cell), 2 * SHIFT).cast("int")

    def ix(self, cell: C) -> Column:
        return F.shiftright(col(cell), SHIFT).bitwiseAND(F.lit(MASK).cast("long"))

    def iy(self, cell: C) -> Column:
        return col(cell).bitwiseAND(F.lit(MASK).cast("long"))

    def size(self, level: Column) -> Column:
        return F.lit(self.base) / F.pow(F.lit(2.0), level)

    @cache  # an expression takes many calls to the JVM to build
    def box(self, cell: str) -> Column:
        size = self.size(self.level(cell))
        x, y = self.x0 + self.ix(cell) * size, self.y0 + self.iy(cell) * size
        return F.struct(x.alias("x0"), y.alias("y0"), (x + size).alias("x1"), (y + size).alias("y1"))

    @cache
    def center(self, cell: str) -> Column:
        box = self.box(cell)
        return F.struct(((box["y0"] + box["y1"]) / 2).alias("lat"), ((box["x0"] + box["x1"]) / 2).alias("lon"))

    @cache
    def ring(self, cell: str) -> Column:
        """The cell's corners, counter-clockwise, not closed."""
        b = self.box(cell)
        return F.array(*(F.struct(b[x].alias("x"), b[y].alias("y")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))))

    def at(self, level: int, lon: C, lat: C) -> Column:
        """The cell of a position; null outside the grid."""
        size = self.base / 2**level
        ix, iy = F.floor((col(lon) - self.x0) / size), F.floor((col(lat) - self.y0) / size)
        inside = (ix >= 0) & (ix < self.nx << level) & (iy >= 0) & (iy < self.ny << level)
        return F.when(inside, self.pack(level, ix, iy))

    def parent(self, cell: C, up: int = 1) -> Column:
        return self.pack(self.level(cell) - up, F.shiftright(self.ix(cell), up), F.shiftright(self.iy(cell), up))

    @cache
    def children(self, cell: str) -> Column:
        ix, iy = self.ix(cell) * 2, self.iy(cell) * 2
        return F.array(*(self.pack(self.level(cell) + 1, ix + i, iy + j) for i in (0, 1) for j in (0, 1)))

    @cache
    def ring_cells(self, cell: str, k: int) -> Column:
        """Cells at exactly k steps (all around, corners too) that lie in the grid."""
        steps = [(i, j) for i in range(-k, k + 1) for j in range(-k, k + 1) if max(abs(i), abs(j)) == k]
        level, ix, iy = self.level(cell), self.ix(cell), self.iy(cell)
        nx, ny = (F.lit(n).cast("long") * F.pow(F.lit(2), level).cast("long") for n in (self.nx, self.ny))

        def one(i: int, j: int) -> Column:
            x, y = F.pmod(ix + i, nx) if self.wraps else ix + i, iy + j
            return F.when((x >= 0) & (x < nx) & (y >= 0) & (y < ny), self.pack(level, x, y))

        return F.filter(F.array(*(one(i, j) for i, j in steps)), lambda c: c.isNotNull())

    @cache
    def neighbors(self, cell: str) -> Column:
        return self.ring_cells(cell, 1)

    def all_cells(self, spark: SparkSession, level: int = 0, box: tuple[float, float, float, float] | None = None) -> DataFrame:
        """(cell) of every cell of a level, or of those that meet a box (min_lon, min_lat, max_lon, max_lat)."""
        nx, ny, size = self.nx << level, self.ny << level, self.base / 2**level
        lo_x, lo_y, hi_x, hi_y = 0, 0, nx - 1, ny - 1
        if box:
            lo_x, hi_x = (min(max(int((v - self.x0) // size), 0), nx - 1) for v in (box[0], box[2]))
            lo_y, hi_y = (min(max(int((v - self.y0) // size), 0), ny - 1) for v in (box[1], box[3]))
        wide, high = hi_x - lo_x + 1, hi_y - lo_y + 1
        return spark.range(wide * high).select(self.pack(level, F.expr(f"id div {high}") + lo_x, F.col("id") % high + lo_y).alias("cell"))
