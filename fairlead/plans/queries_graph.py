"""Queries over the cascade, the graph and routes on the synthetic sea."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fairlead.functions import geo
from fairlead.functions.tables import load
from fairlead.operators import cascade, graph
from fairlead.plans import build, routes, sea
from fairlead.plans.queries_geo import HAVERSINE, LAND, PINS

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _level(n: int, threshold: float) -> str:
    s = 4.0 / 2**n
    points = [(f"(x + {a * s})", f"(y + {b * s})") for a, b in ((0.5, 0.5), (0, 0), (1, 0), (1, 1), (0, 1))]
    def away(p):
        dx, dy = f"greatest(x0 - {p[0]}, {p[0]} - x1, 0.0)", f"greatest(y0 - {p[1]}, {p[1]} - y1, 0.0)"
        return f"sqrt({dx} * {dx} + {dy} * {dy})"

    far = f"(SELECT min(least({', '.join(map(away, points))})) FROM land) > {threshold}"
    touch = f"EXISTS (SELECT 1 FROM land WHERE x0 <= x + {s} AND x1 >= x AND y0 <= y + {s} AND y1 >= y)"
    return f"""j{n} AS (SELECT ix, iy, x, y, {far} AND NOT {touch} AS keep FROM c{n}),
c{n + 1} AS (SELECT * FROM (SELECT ix * 2 + i AS ix, iy * 2 + j AS iy, x + i * {s / 2} AS x, y + j * {s / 2} AS y FROM j{n}, range(2) a(i), range(2) b(j) WHERE NOT keep) c
  WHERE NOT EXISTS (SELECT 1 FROM land WHERE x0 <= x AND x1 >= x + {s / 2} AND y0 <= y AND y1 >= y + {s / 2}))"""


CASCADE = f"""{LAND},
c0 AS (SELECT * FROM (SELECT ix, iy, -176.0::double + 4 * ix AS x, -72.0::double + 4 * iy AS y FROM range(88) a(ix), range(36) b(iy)) c WHERE NOT EXISTS (SELECT 1 FROM land WHERE x0 <= x AND x1 >= x + 4 AND y0 <= y AND y1 >= y + 4)),
{_level(0, 4.0)}, {_level(1, 2.0)},
cells AS MATERIALIZED (SELECT (level::bigint << 52) + (ix::bigint << 26) + iy AS cell, level, ix::bigint AS ix, iy::bigint AS iy, x + s / 2 AS lon, y + s / 2 AS lat FROM (
  SELECT 0 AS level, 4.0::double AS s, ix, iy, x, y FROM j0 WHERE keep UNION ALL SELECT 1, 2.0, ix, iy, x, y FROM j1 WHERE keep
  UNION ALL SELECT 2, 1.0, ix, iy, x, y FROM c2 WHERE NOT EXISTS (SELECT 1 FROM land WHERE x0 <= x + 1 AND x1 >= x AND y0 <= y + 1 AND y1 >= y)) k)"""
SAME = """same AS (SELECT p.cell AS a, q.cell AS b FROM cells p, range(-1, 2) i(di), range(-1, 2) j(dj), cells q WHERE q.level = p.level AND q.ix = p.ix + di AND q.iy = p.iy + dj AND p.cell < q.cell)"""
CROSS = """crossed AS (SELECT DISTINCT least(p.cell, q.cell) AS a, greatest(p.cell, q.cell) AS b FROM cells p, range(-1, 2) i(di), range(-1, 2) j(dj), cells q WHERE q.level = p.level - 1 AND q.ix = p.ix // 2 + di AND q.iy = p.iy // 2 + dj)"""
EDGES = f"""{SAME}, {CROSS},
placed AS (SELECT a, b, p.lat AS lat1, p.lon AS lon1, q.lat AS lat2, q.lon AS lon2 FROM (SELECT * FROM same UNION SELECT * FROM crossed) e JOIN cells p ON a = p.cell JOIN cells q ON b = q.cell),
edges AS MATERIALIZED (SELECT a, b, greatest(1, floor((({HAVERSINE.format('lat1', 'lat2', 'lon1', 'lon2')})::float * 100::float)::double + 0.5)::int) AS weight_cnm FROM placed
  WHERE NOT EXISTS (SELECT 1 FROM land WHERE (lon1 + lon2) / 2 > x0 AND (lon1 + lon2) / 2 < x1 AND (lat1 + lat2) / 2 > y0 AND (lat1 + lat2) / 2 < y1)),
both_ways AS (SELECT a AS src, b AS dst, weight_cnm FROM edges UNION ALL SELECT b, a, weight_cnm FROM edges)"""
LABELS = """labels(cell, component) USING KEY (cell) AS (SELECT cell, cell FROM cells UNION
  SELECT e.dst, min(l.component) FROM labels l JOIN both_ways e ON e.src = l.cell JOIN recurring.labels r ON r.cell = e.dst WHERE l.component < r.component GROUP BY e.dst)"""


@query(f"WITH {CASCADE} SELECT cell, level FROM cells")
def cascade_cells(spark, sf_dir):
    return sea.cells(spark, sf_dir).select("cell", sea.GRID.level("cell").alias("level"))


@query(f"WITH {CASCADE} SELECT level, count(*) AS n FROM cells GROUP BY 1")
def tier_counts(spark, sf_dir):
    return sea.cells(spark, sf_dir).groupBy(sea.GRID.level("cell").alias("level")).agg(F.count("*").alias("n"))


@query(f"WITH {CASCADE}, {SAME} SELECT a, b FROM same")
def edges_same_level(spark, sf_dir):
    return graph.same_level_edges(sea.cells(spark, sf_dir), sea.GRID)


@query(f"WITH {CASCADE}, {CROSS} SELECT a, b FROM crossed")
def edges_cross_level(spark, sf_dir):
    return graph.cross_level_edges(sea.cells(spark, sf_dir), sea.GRID).dropDuplicates(["a", "b"])


@query(f"WITH {CASCADE}, {EDGES} SELECT a, b, weight_cnm FROM edges")
def graph_edges(spark, sf_dir):
    return sea.edges(spark, sf_dir)


@query(f"WITH RECURSIVE {CASCADE}, {EDGES}, {LABELS} SELECT component, count(*) AS n FROM labels GROUP BY 1")
def component_sizes(spark, sf_dir):
    return sea.labels(spark, sf_dir).groupBy("component").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {CASCADE}, {EDGES}, {LABELS} SELECT cell FROM labels WHERE component = (SELECT component FROM labels GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)")
def main_component(spark, sf_dir):
    return graph.main_component(sea.labels(spark, sf_dir))


EDGE_OF = "(VALUES (0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0)) s(a, b, c, d)"


@query(f"""WITH {CASCADE}, d AS (SELECT cell, min(sqrt(pow(60 * greatest(cos(radians(lat)), 0.01) * greatest(x0 - lon, lon - x1, 0.0), 2) + pow(60 * greatest(y0 - lat, lat - y1, 0.0), 2))) AS nm FROM cells, land GROUP BY 1)
SELECT cell, least(255, greatest(0, floor(least(nm, 5.1) / 0.02::double + 1e-9)))::int AS shore_q FROM d""")
def node_shore_distance(spark, sf_dir):
    return graph.shore_distance(sea.cells(spark, sf_dir), sea.coast(spark, sf_dir), sea.GRID)


CORRIDORS = "(SELECT r_name AS name, -170{d} + 67 * r_regionkey AS min_lon, -60{d} + 21 * r_regionkey AS min_lat, -150{d} + 67 * r_regionkey AS max_lon, -50{d} + 23 * r_regionkey AS max_lat, r_regionkey + 4 AS leaf_resolution FROM region UNION ALL SELECT concat(r_name, ' II'), -165{d} + 67 * r_regionkey, -58{d} + 21 * r_regionkey, -140{d} + 67 * r_regionkey, -52{d} + 23 * r_regionkey, 9 - r_regionkey FROM region)"


def corridors(spark, sf_dir):
    load(spark, sf_dir, "region").createOrReplaceTempView("fairlead_region")
    return spark.sql(f"SELECT * FROM {CORRIDORS.format(d='D')}".replace("FROM region", "FROM fairlead_region"))


@query(f"""WITH p AS {CORRIDORS.format(d='.0::double')}, c AS (SELECT (ix << 26) + iy AS zone, -176.0::double + 4 * ix AS x, -72.0::double + 4 * iy AS y FROM range(88) a(ix), range(36) b(iy))
SELECT zone, max(leaf_resolution)::int AS leaf FROM c JOIN p ON floor((min_lon + 176) / 4) <= (x + 176) / 4 AND floor((max_lon + 176) / 4) >= (x + 176) / 4 AND floor((min_lat + 72) / 4) <= (y + 72) / 4 AND floor((max_lat + 72) / 4) >= (y + 72) / 4 GROUP BY 1""")
def zone_leaf_resolution(spark, sf_dir):
    return cascade.zones(corridors(spark, sf_dir), sea.GRID, 0)


@query(f"""WITH {CASCADE}, p AS {CORRIDORS.format(d='.0::double')} SELECT cell FROM cells WHERE EXISTS (SELECT 1 FROM p WHERE lon BETWEEN min_lon AND max_lon AND lat BETWEEN min_lat AND max_lat)""")
def cells_in_corridor(spark, sf_dir):
    return cascade.in_corridor(sea.cells(spark, sf_dir), corridors(spark, sf_dir), sea.GRID)


@query(f"""WITH {CASCADE}, {PINS}, near AS (SELECT k, cell, greatest(abs(ix - floor(x + 176)), abs(iy - floor(y + 72))) AS ring, {HAVERSINE.format('y', 'lat', 'x', 'lon')} AS nm
  FROM pins JOIN cells ON level = 2 AND abs(ix - floor(x + 176)) <= 3 AND abs(iy - floor(y + 72)) <= 3),
first AS (SELECT *, min(ring) OVER (PARTITION BY k) AS least FROM near)
SELECT k, cell, round(nm, 6) AS nm FROM (SELECT k, cell, nm, row_number() OVER (PARTITION BY k ORDER BY round(nm, 6), cell) AS r FROM first WHERE ring = least) t WHERE r = 1""")
def snap_nearest(spark, sf_dir):
    """Leaf cells of rings 0 to 3 round each pin; of the first ring with any, the closest."""
    from fairlead.operators.snap import nearest_in_rings

    found = nearest_in_rings(sea.pins(spark, sf_dir), sea.cells(spark, sf_dir), sea.GRID, 2, 3)
    return found.select("k", "cell", F.round("nm", 6).alias("nm"))


@query(f"""WITH RECURSIVE {CASCADE}, {EDGES}, cost(cell, c) USING KEY (cell) AS (SELECT min(cell), 0::bigint FROM cells UNION
  SELECT e.dst, min(p.c + e.weight_cnm) FROM cost p JOIN both_ways e ON e.src = p.cell LEFT JOIN recurring.cost r ON r.cell = e.dst WHERE r.c IS NULL OR p.c + e.weight_cnm < r.c GROUP BY e.dst)
SELECT cell, c::bigint AS cost_cnm FROM cost""")
def sssp_costs(spark, sf_dir):
    """Least costs from the least cell of the main component (which is the least cell of all) to every cell of it."""
    nodes = sea.nodes(spark, sf_dir)
    held = routes.chart(nodes, sea.edge_rows(spark, sf_dir), sea.coast(spark, sf_dir))
    costs = routes.costs_from(spark, nodes.where("node_id = 0").selectExpr("node_id AS start"), held)
    return costs.join(nodes.select("node_id", "cell"), "node_id").select("cell", "cost_cnm")


def requests(spark, sf_dir):
    """From each customer's pin to the supplier's pin of the same key, modulo the number of suppliers."""
    ends = load(spark, sf_dir, "supplier").selectExpr("s_suppkey AS s", "((s_suppkey * 53 + 7) % 1392) / 4D - 174 AS to_lon", "((s_suppkey * 29 + 3) % 552) / 4D - 69 AS to_lat")
    n = ends.agg(F.count("*").alias("n"))
    pins = sea.pins(spark, sf_dir).join(F.broadcast(n)).selectExpr("k AS req_id", "y AS from_lat", "x AS from_lon", "pmod(k, n) AS s", "(k % 3) * 1.5D AS shore_buffer_nm")
    return pins.join(ends, "s").select("req_id", "from_lat", "from_lon", "to_lat", "to_lon", "shore_buffer_nm")


def routed(spark, sf_dir):
    held = routes.chart(sea.nodes(spark, sf_dir), sea.edge_rows(spark, sf_dir), sea.coast(spark, sf_dir))
    asked = requests(spark, sf_dir).repartitionByRange(4 * spark.sparkContext.defaultParallelism, "to_lat", "to_lon", "req_id").sortWithinPartitions("to_lat", "to_lon", "req_id")
    return routes.route(spark, asked, held, sea.GRID, routes.snap_rule(sea.GRID, range(3)))


@query()
def route_distance(spark, sf_dir):
    r = routed(spark, sf_dir)
    return r.select("req_id", "error", F.round("result.distance_nm", 6).alias("distance_nm"), "result.raw_hops", "result.smooth_hops", F.size("result.land_legs").alias("n_land_legs"))


@query()
def route_response(spark, sf_dir):
    return routes.response(routed(spark, sf_dir))


@query(f"WITH RECURSIVE {CASCADE}, {EDGES}, {LABELS}, main AS (SELECT cell FROM labels WHERE component = (SELECT component FROM labels GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)) SELECT 3 AS version, (SELECT count(*) FROM main) AS num_nodes, (SELECT count(*) FROM both_ways WHERE src IN (SELECT cell FROM main)) AS num_edges")
def graph_info(spark, sf_dir):
    return routes.info(sea.nodes(spark, sf_dir), sea.edge_rows(spark, sf_dir))


@query(f"""WITH {CASCADE} SELECT cell, '{{"type":"Feature","properties":{{"layer":"hex-res-' || level || '","color":"' || CASE WHEN level <= 3 THEN '#0088ff' END || '"}},"geometry":{{"type":"Polygon","coordinates":[['
  || array_to_string(list_transform([[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]], lambda c: format('[{{:.6f}},{{:.6f}}]', lon + (c[1] - 0.5) * 4 / (1 << level), lat + (c[2] - 0.5) * 4 / (1 << level))), ',') || ']]}}}}' AS feature FROM cells WHERE lon BETWEEN -60 AND 60 AND lat BETWEEN -30 AND 30""")
def geojson_cells(spark, sf_dir):
    from fairlead.sources.geojson import cell_features

    center = sea.GRID.center("cell")
    inside = sea.cells(spark, sf_dir).where(center["lon"].between(-60, 60) & center["lat"].between(-30, 30))
    return cell_features(inside, sea.GRID)


@query("""WITH p AS (SELECT l_orderkey AS seg, row_number() OVER (PARTITION BY l_suppkey % 7 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i, l_suppkey % 7 AS line, (l_partkey % 1440) / 4.0::double - 180 AS x, (l_suppkey % 720) / 4.0::double - 90 AS y FROM lineitem),
c AS (SELECT line, list({'x': x, 'y': y} ORDER BY i) AS pts, count(*) AS n FROM p GROUP BY 1),
s AS (SELECT line, n, unnest(range(0, n - 1, 255)) AS start, pts FROM c)
SELECT line, start // 255 AS chunk, len(list_slice(pts, start + 1, start + 256)) AS n_points, pts[start + 1].x AS first_x, pts[least(start + 256, n)].y AS last_y FROM s""")
def coastline_chunks(spark, sf_dir):
    items = load(spark, sf_dir, "lineitem")
    line = F.col("l_suppkey") % 7
    i = F.row_number().over(Window.partitionBy(line).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    points = items.select(line.alias("line"), (i - 1).cast("long").alias("i"), ((F.col("l_partkey") % 1440) / 4.0 - 180).alias("x"), ((F.col("l_suppkey") % 720) / 4.0 - 90).alias("y"))
    cut = build.chunk_points(points, "line", "i").groupBy("line", "chunk")
    return cut.agg(F.count("*").alias("n_points"), F.min_by("x", "i").alias("first_x"), F.max_by("y", "i").alias("last_y"))


@query(f"""WITH {PINS}, w AS (SELECT k, x, y, lead(x) OVER (PARTITION BY k % 10 ORDER BY k) AS x2, lead(y) OVER (PARTITION BY k % 10 ORDER BY k) AS y2 FROM pins)
SELECT k % 10 AS line, round(sum({HAVERSINE.format('y', 'y2', 'x', 'x2')}), 5) AS nm, count(*) AS legs FROM w WHERE x2 IS NOT NULL GROUP BY 1""")
def path_lengths(spark, sf_dir):
    """Sum of the legs between consecutive points."""
    order = Window.partitionBy(F.col("k") % 10).orderBy("k")
    legs = sea.pins(spark, sf_dir).select((F.col("k") % 10).alias("line"), "x", "y", F.lead("x").over(order).alias("x2"), F.lead("y").over(order).alias("y2")).where("x2 IS NOT NULL")
    return legs.groupBy("line").agg(F.round(F.sum(geo.haversine_nm("y", "x", "y2", "x2")), 5).alias("nm"), F.count("*").alias("legs"))
