"""The routing graph as Parquet tables, with a version and checks on the way in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 4  # 4: cells of the planet's grid
NODES = "node_id int, cell long, res tinyint, lat double, lon double, shore_q smallint"
EDGES = "src int, dst int, weight_cnm int"
COAST = "x1 float, y1 float, x2 float, y2 float"


def save(spark: SparkSession, path: str, nodes: DataFrame, edges: DataFrame, coast: DataFrame) -> None:
    """Sorted for locality and compression; the coast in single precision."""
    def write(df, name):
        return df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")

    write(nodes.repartitionByRange("cell").sortWithinPartitions("cell"), "nodes")
    write(edges.repartitionByRange("src").sortWithinPartitions("src", "dst"), "edges")
    write(coast.select(*(F.col(c).cast("float").alias(c) for c in ("x1", "y1", "x2", "y2"))), "coast")
    write(spark.createDataFrame([("fairlead graph", VERSION)], "kind string, version int").coalesce(1), "_meta")


def load(spark: SparkSession, path: str, check: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and coast; an error for another version or a broken graph."""
    meta = spark.read.parquet(f"{path}/_meta").first()
    if meta is None or meta["kind"] != "fairlead graph" or meta["version"] != VERSION:
        raise ValueError(f"{path} isn't a version {VERSION} graph. Rebuild required")
    nodes, edges, coast = (spark.read.schema(s).parquet(f"{path}/{n}") for n, s in (("nodes", NODES), ("edges", EDGES), ("coast", COAST)))
    if check and (wrong := faults(nodes, edges)):
        raise ValueError("; ".join(wrong))
    return nodes, edges, coast


def faults(nodes: DataFrame, edges: DataFrame) -> list[str]:
    """What breaks the graph's rules: dense ids in strictly ascending cell order, ends that exist, positive weights."""
    ordered = nodes.agg(F.count("*").alias("n"), F.count_distinct("cell").alias("cells"), F.count_distinct("node_id").alias("ids"), F.min("node_id").alias("low"), F.max("node_id").alias("high"), F.count_if(~F.col("lat").between(-90, 90) | (F.col("cell") < 0)).alias("odd")).first()
    out = []
    if ordered.n and (ordered.cells != ordered.n or ordered.ids != ordered.n or ordered.low != 0 or ordered.high != ordered.n - 1):
        out.append("node ids or cells aren't dense and distinct")
    if ordered.odd:
        out.append(f"{ordered.odd} nodes have no valid cell")
    following = nodes.select((F.col("node_id") + 1).alias("node_id"), F.col("cell").alias("before"))
    if not nodes.join(following, "node_id").where("before >= cell").isEmpty():
        out.append("cells don't ascend with node ids")
    ends = edges.select(F.col("src").alias("node_id")).unionByName(edges.select(F.col("dst").alias("node_id"))).distinct()
    if not ends.join(nodes, "node_id", "left_anti").isEmpty():
        out.append("edges end outside the graph")
    if not edges.where("weight_cnm <= 0 OR weight_cnm > 65535 OR src = dst").isEmpty():
        out.append("edges have weights out of range")
    return out
