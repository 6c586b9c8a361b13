"""From cells to a routing graph: nodes, edges, the main component and shore distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairlead.functions import geo
from fairlead.functions.tables import Scratch
from fairlead.operators import spatial
from fairlead.operators.components import components
from fairlead.operators.grid import QuadGrid
from fairlead.operators.subtract import Land


def same_level_edges(cells: DataFrame, grid: QuadGrid) -> DataFrame:
    """(a, b), a < b, of neighbouring cells of one level."""
    near = cells.select(F.col("cell").alias("a"), F.explode(grid.neighbors("cell")).alias("cell")).where("a < cell")
    return near.join(cells, "cell").select("a", F.col("cell").alias("b"))


def cross_level_edges(cells: DataFrame, grid: QuadGrid) -> DataFrame:
    """(a, b), a < b, of a cell and its parent or a neighbour of its parent, one level up; cells two levels apart aren't linked."""
    base = cells.where(grid.level("cell") > 0).select("cell", grid.parent("cell").alias("up"))
    near = base.select(F.col("cell").alias("b"), F.explode(F.array_union(F.array("up"), grid.neighbors("up"))).alias("cell"))
    return near.join(cells, "cell").select(F.least("b", "cell").alias("a"), F.greatest("b", "cell").alias("b"))


def with_positions(edges: DataFrame, grid: QuadGrid) -> DataFrame:
    a, b = grid.center("a"), grid.center("b")
    return edges.select("a", "b", a["lat"].alias("lat1"), a["lon"].alias("lon1"), b["lat"].alias("lat2"), b["lon"].alias("lon2"))


def graph_edges(cells: DataFrame, land: Land, grid: QuadGrid) -> DataFrame:
    """(a, b, weight_cnm), each pair once: links whose middle is water, weighed by distance in hundredths of a mile."""
    every = same_level_edges(cells, grid).unionByName(cross_level_edges(cells, grid)).dropDuplicates(["a", "b"])
    placed = with_positions(every, grid)
    middles = placed.withColumns({"x": geo.mid_lon("lon1", "lon2"), "y": (F.col("lat1") + F.col("lat2")) / 2, "link": F.struct("a", "b")})
    wet = middles.join(land.holding(middles, "link"), "link", "left_anti")
    return wet.select("a", "b", geo.quantize_weight(geo.haversine_nm("lat1", "lon1", "lat2", "lon2")).alias("weight_cnm"))


def symmetric(edges: DataFrame) -> DataFrame:
    """(src, dst, weight_cnm), both ways."""
    return edges.selectExpr("a AS src", "b AS dst", "weight_cnm").unionByName(edges.selectExpr("b AS src", "a AS dst", "weight_cnm"))


def component_labels(spark: SparkSession, cells: DataFrame, edges: DataFrame) -> DataFrame:
    """(cell, component) of every cell; a cell without edges is a component."""
    found = components(spark, edges.select("a", "b")).withColumnRenamed("node", "cell")
    return cells.select("cell").join(found, "cell", "left").select("cell", F.coalesce("component", "cell").alias("component"))


def main_component(labels: DataFrame) -> DataFrame:
    """Cells of the largest component, at a tie that with the least cell."""
    sizes = labels.groupBy("component").agg(F.count("*").alias("n"), F.min("cell").alias("least"))
    main = sizes.agg(F.max_by("component", F.struct("n", -F.col("least"))).alias("component"))
    return labels.join(main, "component", "left_semi").select("cell")


def prune(cells: DataFrame, edges: DataFrame, main: DataFrame) -> tuple[DataFrame, DataFrame]:
    return cells.join(main, "cell", "left_semi"), edges.join(main.withColumnRenamed("cell", "a"), "a", "left_semi")


def shore_distance(cells: DataFrame, coast: DataFrame, grid: QuadGrid) -> DataFrame:
    """(cell, shore_q): units of 0.02 nm from a cell's centre to the coast, 255 for 5.1 nm or more."""
    center = cells.select("cell", grid.center("cell").alias("c")).select("cell", F.col("c.lon").alias("x"), F.col("c.lat").alias("y"))
    return spatial.coast_distance_nm(center, coast, "cell").select("cell", geo.quantize_shore("d").alias("shore_q"))


def dense_ids(cells: DataFrame) -> DataFrame:
    """(cell, node_id): places in ascending order of cell. Ranges of cells are written with their number; a cell's place is
    the number of cells in the ranges before (one row for each range) and its rank within its own."""
    spark = cells.sparkSession
    ranged = Scratch(spark).keep(cells.select("cell").repartitionByRange("cell").withColumn("part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("cell"))
    return ranged.withColumn("rank", rank).join(F.broadcast(before), "part").select("cell", (F.col("before") + F.col("rank") - 1).cast("int").alias("node_id"))


def finest_level(cells: DataFrame, grid: QuadGrid) -> DataFrame:
    """One row: the finest level of any cell, which bounds the levels to link."""
    return cells.agg(F.max(grid.level("cell")).alias("level"))


def nodes_of(cells: DataFrame, shore: DataFrame, grid: QuadGrid) -> DataFrame:
    """(node_id, cell, res, lat, lon, shore_q)."""
    center = grid.center("cell")
    return dense_ids(cells).join(shore, "cell").select("node_id", "cell", grid.level("cell").cast("tinyint").alias("res"), center["lat"].alias("lat"), center["lon"].alias("lon"), F.col("shore_q").cast("smallint").alias("shore_q"))


def edge_rows(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, weight_cnm) by node id, both ways."""
    ids = nodes.select("cell", "node_id")
    one = edges.join(ids.selectExpr("cell AS a", "node_id AS src"), "a").join(ids.selectExpr("cell AS b", "node_id AS dst"), "b").select("src", "dst", "weight_cnm")
    return one.unionByName(one.selectExpr("dst AS src", "src AS dst", "weight_cnm"))
