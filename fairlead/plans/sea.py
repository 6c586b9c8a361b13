"""A synthetic sea on the driver's tables, and routing tables built on it.

Land: a rectangle for each nation, a thin island and a ring island round a lagoon; all corners are exact binary
fractions. Pins: a position for each customer key. The sea is the same at every scale factor; pins grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.functions.tables import Scratch, load
from fairlead.operators import graph, spatial
from fairlead.operators.cascade import Cascade, cascade_cells
from fairlead.operators.grid import QuadGrid
from fairlead.operators.subtract import Land

CONFIG = Cascade(thresholds=((0, 4.0), (1, 2.0)), leaf=2, zone=0, grid=QuadGrid(-176.0, -72.0, 4.0, 88, 36))
GRID = CONFIG.grid
EXTRA = ((100, -120.25, -40.0, -119.75, -20.0), (101, 84.0, -8.0, 104.0, -6.0), (102, 84.0, 10.0, 104.0, 12.0), (103, 84.0, -6.0, 86.0, 10.0), (104, 102.0, -6.0, 104.0, 10.0))
_built: dict[tuple[str, str, str], DataFrame] = {}


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(poly_id, x0, y0, x1, y1)."""
    own = load(spark, sf_dir, "nation").selectExpr("cast(n_nationkey AS int) AS poly_id", "n_regionkey AS r", "-170D + 70 * (n_nationkey % 5) AS x0", "-66D + 28 * (n_nationkey div 5) AS y0")
    own = own.selectExpr("poly_id", "x0", "y0", "x0 + 20 + 4 * r AS x1", "y0 + 10 + 2 * r AS y1")
    return own.unionByName(spark.createDataFrame(EXTRA, "poly_id int, x0 double, y0 double, x1 double, y1 double"))


def land(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(poly_id, rings)."""
    corners = F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))))
    return rectangles(spark, sf_dir).select("poly_id", F.array(corners).alias("rings"))


def pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, x, y) for each customer."""
    return load(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "((c_custkey * 91) % 1392) / 4D - 174 AS x", "((c_custkey * 37) % 552) / 4D - 69 AS y")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, lon1, lat1, lon2, lat2): from each pin a few degrees on."""
    return pins(spark, sf_dir).selectExpr("k", "x AS lon1", "y AS lat1", "x + (k * 7 % 41 - 20) / 4D AS lon2", "y + (k * 11 % 37 - 18) / 4D AS lat2")


def _once(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A table built once for each application and input."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _built:
        _built[key] = Scratch(spark).keep(make(), name)
    return _built[key]


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.land_shapes(land(spark, sf_dir))


def coast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.coast_edges(land(spark, sf_dir))


def solid(spark: SparkSession, sf_dir: str) -> Land:
    kept = (_once(spark, sf_dir, "sea-shapes", lambda: shapes(spark, sf_dir)), _once(spark, sf_dir, "sea-coast", lambda: coast(spark, sf_dir)))
    return Land(*kept)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "sea-cells", lambda: cascade_cells(spark, solid(spark, sf_dir), CONFIG))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "sea-edges", lambda: graph.graph_edges(cells(spark, sf_dir), solid(spark, sf_dir), GRID))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "sea-labels", lambda: graph.component_labels(spark, cells(spark, sf_dir), edges(spark, sf_dir)))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make():
        main = graph.main_component(labels(spark, sf_dir))
        return graph.nodes_of(main, graph.shore_distance(main, coast(spark, sf_dir), GRID), GRID)

    return _once(spark, sf_dir, "sea-nodes", make)


def edge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "sea-edge-rows", lambda: graph.edge_rows(edges(spark, sf_dir), nodes(spark, sf_dir)))
