"""Queries over node ids, adjacency, search, smoothing, answers, layers and files, with the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from fairlead.functions import geo
from fairlead.functions.tables import load, shared_dir, ship
from fairlead.operators import cascade, graph, kernel, spatial, subtract
from fairlead.plans import bench, build, passages, routes, sea
from fairlead.plans.queries_geo import COAST, HAVERSINE, LAND, PINS, SEGMENTS, meet
from fairlead.plans.queries_graph import CASCADE, CORRIDORS, EDGES, corridors
from fairlead.sources import archive, geojson, graph_store, shapefile

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


#: The main component is the open sea: all cells but those of the lagoon (component_sizes checks the components themselves).
IDS = f"""WITH RECURSIVE {CASCADE}, {EDGES},
ids AS MATERIALIZED (SELECT cell, (row_number() OVER (ORDER BY cell) - 1)::int AS node_id FROM cells WHERE NOT (lon BETWEEN 86 AND 102 AND lat BETWEEN -6 AND 10))"""


def chart(spark, sf_dir) -> kernel.Chart:
    return routes.chart(sea.nodes(spark, sf_dir), sea.edge_rows(spark, sf_dir), sea.coast(spark, sf_dir))


@query(f"{IDS} SELECT node_id, cell, level::int AS res, lat, lon FROM ids JOIN cells USING (cell)")
def node_positions(spark, sf_dir):
    return sea.nodes(spark, sf_dir).select("node_id", "cell", F.col("res").cast("int").alias("res"), "lat", "lon")


@query(f"{IDS} SELECT s.node_id AS src, t.node_id AS dst, weight_cnm FROM both_ways e JOIN ids s ON e.src = s.cell JOIN ids t ON e.dst = t.cell")
def edges_by_node(spark, sf_dir):
    return sea.edge_rows(spark, sf_dir)


@query(f"{IDS} SELECT s.node_id, count(*) AS degree, string_agg(t.node_id || ':' || weight_cnm, ',' ORDER BY t.node_id) AS links FROM both_ways e JOIN ids s ON e.src = s.cell JOIN ids t ON e.dst = t.cell GROUP BY 1")
def adjacency_lists(spark, sf_dir):
    """Each node's neighbours as the search reads them from the offset arrays."""
    ship(spark)
    held = spark.sparkContext.broadcast(chart(spark, sf_dir))

    def run(batches):
        for batch in batches:
            near = [held.value.neighbors(n) for n in batch["node_id"].to_pylist()]
            links = [",".join(f"{t}:{round(float(x) * 100)}" for t, x in zip(targets.tolist(), weights, strict=True)) for targets, weights in near]
            yield pa.RecordBatch.from_arrays([batch["node_id"], pa.array([len(t) for t, _ in near], pa.int64()), pa.array(links)], names=["node_id", "degree", "links"])

    return sea.nodes(spark, sf_dir).select("node_id").mapInArrow(run, "node_id int, degree long, links string").where("degree > 0")


@query(f"""{IDS}, cost(cell, c) USING KEY (cell) AS (SELECT min(cell), 0::bigint FROM ids UNION
  SELECT e.dst, min(p.c + e.weight_cnm) FROM cost p JOIN both_ways e ON e.src = p.cell LEFT JOIN recurring.cost r ON r.cell = e.dst WHERE r.c IS NULL OR p.c + e.weight_cnm < r.c GROUP BY e.dst)
SELECT n_nationkey, ids.cell AS goal, c::bigint AS cost_cnm, 0::int AS first FROM nation JOIN ids ON node_id = (n_nationkey * 431 + 17) % (SELECT count(*) FROM ids) JOIN cost ON cost.cell = ids.cell""")
def search_costs(spark, sf_dir):
    """Costs of the paths that the search returns, from node 0 to a node for each nation."""
    nodes = sea.nodes(spark, sf_dir)
    goals = load(spark, sf_dir, "nation").select("n_nationkey", ((F.col("n_nationkey") * 431 + 17) % nodes.count()).cast("int").alias("goal"))
    found = routes.searched(spark, goals.select(F.lit(0).alias("start"), "goal"), chart(spark, sf_dir)).dropDuplicates(["goal"])
    found = goals.join(found, "goal").where("path[size(path) - 1] = goal")
    return found.join(nodes.selectExpr("node_id AS goal", "cell"), "goal").selectExpr("n_nationkey", "cell AS goal", "cost_cnm", "path[0] AS first")


@query(f"""{IDS}, g AS (SELECT cell, (ix::int // (1 << level)) // 8 AS col FROM ids JOIN cells USING (cell))
SELECT col::bigint AS col, count(*) AS n FROM g GROUP BY 1""")
def nodes_by_cell_lookup(spark, sf_dir):
    """Cells of the chart found again by the snapper's search of sorted cells."""
    ship(spark)
    held = spark.sparkContext.broadcast(chart(spark, sf_dir))

    def run(batches):
        snap = kernel.Snapper(held.value, sea.GRID, routes.snap_rule(sea.GRID, range(3)))
        for batch in batches:
            cells = batch["cell"].to_numpy()
            found = snap.nodes(cells)
            yield pa.RecordBatch.from_arrays([pa.array(held.value.cell[found])], names=["cell"])

    cells = sea.cells(spark, sf_dir).select("cell").mapInArrow(run, "cell long")
    column = F.floor(sea.GRID.ix("cell") / F.pow(F.lit(2.0), sea.GRID.level("cell")) / 8)
    return cells.groupBy(column.alias("col")).agg(F.count("*").alias("n"))


CLEAR = f"""WITH RECURSIVE {LAND}, {COAST}, {PINS}, path AS (SELECT (k - 1) // 12 AS path, (k - 1) % 12 AS i, x, y FROM pins), size AS (SELECT path, max(i) AS last FROM path GROUP BY 1),
raw AS (SELECT a.path, a.i, b.i AS j, a.x AS px, a.y AS py, b.x AS qx, b.y AS qy, CASE WHEN a.x > 0 THEN 180.0::double ELSE -180.0::double END AS edge FROM path a JOIN path b ON a.path = b.path AND a.i < b.i),
cut AS (SELECT *, py + (qy - py) * ((edge - px) / (qx + 2 * edge - px)) AS my FROM raw),
part AS (SELECT path, i, j, px AS ax, py AS ay, qx AS bx, qy AS by_ FROM raw WHERE abs(px - qx) <= 180 UNION ALL SELECT path, i, j, px, py, edge, my FROM cut WHERE abs(px - qx) > 180 UNION ALL SELECT path, i, j, -edge, my, qx, qy FROM cut WHERE abs(px - qx) > 180),
shut AS (SELECT DISTINCT path, i, j FROM part JOIN coast ON {meet(("ax", "ay"), ("bx", "by_"), ("cx", "cy"), ("dx", "dy"))}),
sight AS MATERIALIZED (SELECT raw.path, raw.i, raw.j, shut.path IS NULL AS clear FROM raw LEFT JOIN shut ON raw.path = shut.path AND raw.i = shut.i AND raw.j = shut.j),
probe AS (SELECT s.path, s.i, step, least(s.i + (1 << step), z.last) AS j FROM (SELECT DISTINCT path, i FROM sight) s JOIN size z USING (path), range(5) r(step)),
blocked AS (SELECT p.path, p.i, min(step) AS step, min(j) AS blocked FROM probe p JOIN sight USING (path, i, j) WHERE NOT clear GROUP BY 1, 2),
near(path, i, low, blocked, seen) AS (SELECT path, i, greatest(CASE WHEN step > 0 THEN i + (1 << (step - 1)) ELSE i END, i + 1), blocked, CASE WHEN step > 0 THEN i + (1 << (step - 1)) ELSE i END FROM blocked
  UNION ALL SELECT n.path, n.i, CASE WHEN clear THEN j ELSE low END, CASE WHEN clear THEN blocked ELSE j END, CASE WHEN clear THEN j ELSE seen END FROM near n JOIN sight s ON s.path = n.path AND s.i = n.i AND s.j = (n.low + n.blocked) // 2 WHERE n.blocked - n.low > 1),
hop AS (SELECT s.path, s.i, CASE WHEN s.clear THEN z.last ELSE n.low END AS j, s.clear OR n.seen > s.i AS sure FROM sight s JOIN size z ON s.path = z.path AND s.j = z.last LEFT JOIN near n ON n.path = s.path AND n.i = s.i AND n.blocked - n.low <= 1),
walk(path, n, i, j, sure) AS (SELECT path, 0, i, j, sure FROM hop WHERE i = 0 UNION ALL SELECT w.path, n + 1, h.i, h.j, h.sure FROM walk w JOIN hop h ON h.path = w.path AND h.i = w.j),
legs AS (SELECT w.*, NOT sure AND NOT s.clear AS land, {HAVERSINE.format('a.y', 'b.y', 'a.x', 'b.x')} AS nm FROM walk w JOIN sight s ON s.path = w.path AND s.i = w.i AND s.j = w.j JOIN path a ON a.path = w.path AND a.i = w.i JOIN path b ON b.path = w.path AND b.i = w.j)"""


def _paths(spark, sf_dir):
    return sea.pins(spark, sf_dir).groupBy(F.floor((F.col("k") - 1) / 12).alias("path_id")).agg(F.array_sort(F.collect_list(F.struct("k", "x", "y"))).alias("pts")).where("size(pts) > 2")


@query(f"""{CLEAR} SELECT path AS path_id, '0,' || string_agg(j, ',' ORDER BY n) AS kept, coalesce(string_agg(n, ',' ORDER BY n) FILTER (land), '') AS land, round(sum(CASE WHEN land THEN 0 ELSE nm END), 5) AS water_nm
FROM legs WHERE path IN (SELECT path FROM size WHERE last > 1) GROUP BY 1""")
def smoothed_paths(spark, sf_dir):
    """Paths of twelve pins each, smoothed: points kept, legs over land, and length on water."""
    coast = kernel.Coast(sea.coast(spark, sf_dir).select("x1", "y1", "x2", "y2").toPandas().to_numpy())
    found = routes.smoothed(spark, _paths(spark, sf_dir), coast)
    return found.selectExpr("path_id", "array_join(kept, ',') AS kept", "array_join(land, ',') AS land", "round(water_nm, 5) AS water_nm")


DIRECT = f"""WITH {LAND}, {COAST}, {SEGMENTS}, open AS (SELECT *, {HAVERSINE.format('ay', 'by_', 'ax', 'bx')} AS nm FROM segs WHERE NOT EXISTS (SELECT 1 FROM coast WHERE {meet(("ax", "ay"), ("bx", "by_"), ("cx", "cy"), ("dx", "dy"))}))"""


def _direct(spark, sf_dir):
    asked = sea.segments(spark, sf_dir).selectExpr("k AS req_id", "lat1 AS from_lat", "lon1 AS from_lon", "lat2 AS to_lat", "lon2 AS to_lon", "0D AS shore_buffer_nm")
    return routes.route(spark, asked, chart(spark, sf_dir), sea.GRID, routes.snap_rule(sea.GRID, range(3))).where("result.smooth_hops = 2")


@query(f"""{DIRECT} SELECT k AS req_id, 200 AS status, '{{"distance_nm":' || (floor(nm * 10 + 0.5) / 10)::varchar || ',"raw_hops":2,"smooth_hops":2,"land_legs":[],"shore_buffer_nm":0.0,"geometry":{{"type":"LineString","coordinates":[['
  || ax::varchar || ',' || ay::varchar || '],[' || bx::varchar || ',' || by_::varchar || ']]}}}}' AS body FROM open""")
def direct_responses(spark, sf_dir):
    """Bodies of the answers to short requests; those whose line is clear are sailed directly."""
    return routes.response(_direct(spark, sf_dir))


BAD = "CASE o_orderkey % 7 WHEN 0 THEN '91.5' WHEN 1 THEN '-90' WHEN 2 THEN 'NaN' WHEN 3 THEN '' WHEN 4 THEN '5.01' WHEN 5 THEN '4.99' ELSE '0' END"


@query(f"SELECT o_orderkey AS k, coalesce(try_cast({BAD} AS double) BETWEEN 0 AND 5 AND NOT isnan(try_cast({BAD} AS double)), false) AS good FROM orders")
def parse_buffers(spark, sf_dir):
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), geo.valid_buffer(F.expr(f"try_cast({BAD} AS double)")).alias("good"))


@query("""SELECT b.name AS box, count(*) AS n FROM (VALUES ('all', -180.0, -90.0, 180.0, 90.0), ('dev', -5.0, 48.0, 10.0, 62.0), ('east', 90.0, -10.0, 110.0, 10.0)) b(name, x0, y0, x1, y1)
JOIN (SELECT r_name AS name, -170.0::double + 67 * r_regionkey AS min_lon, -60.0::double + 21 * r_regionkey AS min_lat, -150.0::double + 67 * r_regionkey AS max_lon, -50.0::double + 23 * r_regionkey AS max_lat FROM region) p ON min_lon <= x1 AND max_lon >= x0 AND min_lat <= y1 AND max_lat >= y0 GROUP BY 1""")
def passages_in_boxes(spark, sf_dir):
    """Corridors that meet a box, given as a preset's name or as four numbers."""
    found = corridors(spark, sf_dir).where("name NOT LIKE '% II'")
    out = None
    for name, text in (("all", "-180,-90,180,90"), ("dev", "dev"), ("east", "90, -10, 110, 10")):
        one = passages.overlapping(found, passages.parse_box(text)).groupBy(F.lit(name).alias("box")).agg(F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {LAND} SELECT poly_id, '{{"type":"Feature","properties":{{"layer":"coastline","stroke":"#ff0000","stroke-width":1.5}},"geometry":{{"type":"LineString","coordinates":['
  || array_to_string(list_transform([[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]], lambda c: format('[{{:.6f}},{{:.6f}}]', c[1], c[2])), ',') || ']}}}}' AS feature FROM land""")
def coastline_features(spark, sf_dir):
    """The coast of all polygons as GeoJSON lines."""
    return geojson.coast_features(build.coastline(sea.land(spark, sf_dir))).select("seg_id.poly_id", "feature")


PARTS = """WITH p AS (SELECT user_id, event_id AS i, value, event_id % 5 = 0 AS land FROM events), r AS (SELECT *, coalesce(sum(land::int) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS raw FROM p),
g AS (SELECT user_id, raw, string_agg(format('[{:.6f},{:.6f}]', value, value / 2), ',' ORDER BY i) AS pts, count(*) AS n FROM r GROUP BY 1, 2 HAVING count(*) >= 2),
s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY raw) AS span, count(*) OVER (PARTITION BY user_id) AS n_spans FROM g)"""


@query(f"""{PARTS} SELECT 'r' || user_id AS name, '{{"type":"Feature","properties":{{"name":"r' || user_id || CASE WHEN n_spans > 1 THEN ' (part ' || span || '/' || n_spans || ')' ELSE '' END || '","distance_nm":"12.5","category":"'
  || CASE WHEN user_id % 2 = 0 THEN 'passage","stroke":"#0000ff' ELSE 'sailing","stroke":"#0088ff' END || '","stroke-width":3,"stroke-opacity":0.8,"land_legs":[1]' || CASE WHEN n_spans > 1 THEN ',"part":' || span || ',"parts":' || n_spans ELSE '' END
  || '}},"geometry":{{"type":"LineString","coordinates":[' || pts || ']}}}}' AS feature FROM s
UNION ALL SELECT 'r' || user_id, '{{"type":"Feature","properties":{{"name":"r' || user_id || ' (' || which || ')","marker-color":"' || color || '","marker-size":"small","marker-symbol":"circle"}},"geometry":{{"type":"Point","coordinates":[' || format('{{:.6f}},{{:.6f}}', user_id + dx, 2.0::double) || ']}}}}'
FROM (SELECT DISTINCT user_id FROM events) u, (VALUES ('start', '#00cc00', 0.0::double), ('end', '#ff0000', 0.5::double)) m(which, color, dx)""")
def route_features(spark, sf_dir):
    """Lines between land legs, and markers, as GeoJSON features."""
    points = load(spark, sf_dir, "events").selectExpr("user_id", "event_id AS i", "value AS x", "value / 2 AS y", "event_id % 5 = 0 AS land")
    named = bench.water_spans(points, "user_id").selectExpr("concat('r', user_id) AS name", "span", "n_spans", "pts", "12.5D AS distance_nm", "user_id % 2 = 0 AS passage", "array(1) AS land_legs")
    ends = points.select("user_id").distinct().selectExpr("concat('r', user_id) AS name", "2D AS from_lat", "cast(user_id AS double) AS from_lon", "2D AS to_lat", "user_id + 0.5D AS to_lon")
    return geojson.route_features(named, ends)


@query("SELECT o_orderkey AS k, format('{:,}', o_orderkey * 12347) AS text, CASE WHEN o_custkey % 50 > 0 THEN floor(log2(o_custkey % 50))::int END AS log FROM orders")
def count_texts(spark, sf_dir):
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), geo.count_text(F.col("o_orderkey") * 12347).alias("text"), geo.whole_log2(F.col("o_custkey") % 50).alias("log"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS text FROM events")
def utc_texts(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", geo.utc_text("ts").alias("text"))


@query(f"WITH {CASCADE} SELECT max(level)::int AS level FROM cells")
def finest_level(spark, sf_dir):
    return graph.finest_level(sea.cells(spark, sf_dir), sea.GRID)


@query(f"""WITH {LAND}, w AS (SELECT min(x) AS x0, min(y) AS y0, max(x) + 0.25 AS x1, max(y) + 0.25 AS y1, count(*) AS n_water FROM (SELECT ((s_suppkey * 53 + 7) % 320) / 4.0::double - 60 AS x, ((s_suppkey * 29 + 3) % 160) / 4.0::double - 20 AS y FROM supplier) s)
SELECT count(*) AS n_land, count(*) FILTER (land.x0 <= w.x1 AND land.x1 >= w.x0 AND land.y0 <= w.y1 AND land.y1 >= w.y0) AS n_meeting, max(n_water) AS n_water FROM land, w""")
def envelope_counts(spark, sf_dir):
    """Land polygons, those whose box meets the common box of the water, and water polygons."""
    at = load(spark, sf_dir, "supplier").selectExpr("s_suppkey AS poly_id", "((s_suppkey * 53 + 7) % 320) / 4D - 60 AS x", "((s_suppkey * 29 + 3) % 160) / 4D - 20 AS y")
    corners = F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in ((0, 0), (0.25, 0), (0.25, 0.25), (0, 0.25), (0, 0))))
    return subtract.envelope_counts(sea.land(spark, sf_dir), at.select("poly_id", F.array(corners).alias("rings")))


@query(f"WITH {LAND} SELECT row_number() OVER (ORDER BY poly_id) AS shape, 1::bigint AS poly, 5 AS n_points, x0, y0, x1, y1 FROM land")
def shapefile_land(spark, sf_dir):
    """The sea's rectangles as a zipped shapefile, unpacked into the shared folder and read back."""
    rows = sea.rectangles(spark, sf_dir).orderBy("poly_id").collect()
    with tempfile.TemporaryDirectory() as own:
        shapefile.write(f"{own}/land.shp", [[[(r.x0, r.y0), (r.x0, r.y1), (r.x1, r.y1), (r.x1, r.y0), (r.x0, r.y0)]] for r in rows])
        with zipfile.ZipFile(f"{own}/land.zip", "w") as z:
            z.write(f"{own}/land.shp", "some/folder/land.shp")
        raw = (archive.unpack(f"{own}/land.zip", f"{own}/land") / "land.shp").read_bytes()
    path = f"{shared_dir(spark)}/fairlead/shp-{uuid.uuid4().hex}"
    archive.put(spark, f"{path}/land.shp", raw)
    land = shapefile.read_land(spark, path)
    box = geo.box_of(F.element_at("rings", 1))
    return land.select("shape", "poly", F.size(F.element_at("rings", 1)).alias("n_points"), box.alias("b")).selectExpr("shape", "poly", "n_points", "b.x0", "b.y0", "b.x1", "b.y1")


@query(f"""{IDS} SELECT 'nodes' AS kind, count(*) AS n, sum(node_id)::bigint AS check_sum FROM ids UNION ALL SELECT 'edges', count(*), sum(weight_cnm)::bigint FROM both_ways WHERE src IN (SELECT cell FROM ids)
UNION ALL SELECT 'coast', 4 * count(*), 0 FROM (SELECT 1 FROM nation UNION ALL SELECT 1 FROM range(5)) l UNION ALL SELECT 'faults', 0, 0 UNION ALL SELECT 'faults of a broken graph', 3, 0""")
def stored_graph(spark, sf_dir):
    """The graph written, read back and checked; and the faults of one that lacks a node."""
    path = f"{shared_dir(spark)}/fairlead/graph-{uuid.uuid4().hex}"
    graph_store.save(spark, path, sea.nodes(spark, sf_dir), sea.edge_rows(spark, sf_dir), sea.coast(spark, sf_dir))
    nodes, edges, coast = graph_store.load(spark, path)
    out = nodes.agg(F.lit("nodes").alias("kind"), F.count("*").alias("n"), F.sum("node_id").alias("check_sum"))
    out = out.unionByName(edges.agg(F.lit("edges").alias("kind"), F.count("*").alias("n"), F.sum("weight_cnm").alias("check_sum")))
    out = out.unionByName(coast.agg(F.lit("coast").alias("kind"), F.count("*").alias("n"), F.lit(0).cast("long").alias("check_sum")))
    broken = graph_store.faults(nodes.where("node_id <> 5"), edges.unionByName(edges.limit(1).selectExpr("src", "dst", "0 AS weight_cnm")))
    return out.unionByName(spark.createDataFrame([("faults", len(graph_store.faults(nodes, edges)), 0), ("faults of a broken graph", len(broken), 0)], "kind string, n long, check_sum long"))


@query(f"""WITH {CASCADE}, p AS {CORRIDORS.format(d='.0::double')}, z AS (SELECT ix, iy, max(leaf_resolution)::int AS leaf FROM (SELECT ix, iy, -176.0::double + 4 * ix AS x, -72.0::double + 4 * iy AS y FROM range(88) a(ix), range(36) b(iy)) c
  JOIN p ON floor((min_lon + 176) / 4) <= (x + 176) / 4 AND floor((max_lon + 176) / 4) >= (x + 176) / 4 AND floor((min_lat + 72) / 4) <= (y + 72) / 4 AND floor((max_lat + 72) / 4) >= (y + 72) / 4 GROUP BY 1, 2)
SELECT cell, leaf FROM cells LEFT JOIN z ON z.ix = cells.ix // (1 << level) AND z.iy = cells.iy // (1 << level)""")
def zone_of_cells(spark, sf_dir):
    """Each cell with the leaf level of the zone that holds it, null outside of zones."""
    cells = sea.cells(spark, sf_dir).select("cell")
    within, outside = cascade.split_zones(cells, cascade.zones(corridors(spark, sf_dir), sea.GRID, 0), sea.GRID, 0)
    return within.unionByName(outside.select("cell", F.lit(None).cast("int").alias("leaf")))


@query("""WITH s AS (SELECT s_suppkey AS k, ((s_suppkey * 91) % 80) / 4.0::double + 170 AS x, ((s_suppkey * 37) % 552) / 4.0::double - 69 AS y, (s_suppkey % 9) / 2.0::double + 0.5 AS w FROM supplier),
v AS (SELECT k, x, x + w AS x1, y FROM s UNION ALL SELECT k, x - 360, x + w - 360, y FROM s WHERE x + w > 180)
SELECT k, count(*) AS copies, min(x) AS low, max(x1) AS high FROM v GROUP BY 1""")
def seam_copies(spark, sf_dir):
    """Boxes that reach past the 180th meridian, with their copies on its other side."""
    at = load(spark, sf_dir, "supplier").selectExpr("s_suppkey AS k", "((s_suppkey * 91) % 80) / 4D + 170 AS x", "((s_suppkey * 37) % 552) / 4D - 69 AS y", "(s_suppkey % 9) / 2D + 0.5D AS w")
    ring = F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in ((F.lit(0.0), 0), (F.col("w"), 0), (F.col("w"), 1), (F.lit(0.0), 1))))
    boxes = at.select("k", F.explode(geo.seam_copies(ring)).alias("r")).select("k", geo.box_of("r").alias("b"))
    return boxes.groupBy("k").agg(F.count("*").alias("copies"), F.min("b.x0").alias("low"), F.max("b.x1").alias("high"))


@query(f"""WITH {LAND}, p AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 179.75::double - (s_suppkey % 13) / 8.0::double ELSE -179.75::double + (s_suppkey % 11) / 8.0::double END AS x, ((s_suppkey * 37) % 552) / 4.0::double - 69 AS y FROM supplier),
c AS (SELECT 179.5::double AS cx, -60.0::double AS y0, 60.0::double AS y1 UNION ALL SELECT -179.25::double, -60, 60)
SELECT k, round(min(sqrt(dx * dx + dy * dy)), 9) AS d FROM (SELECT k, least(abs(x - cx), 360 - abs(x - cx)) AS dx, greatest(y0 - y, y - y1, 0.0) AS dy FROM p, c) t WHERE dx <= 2 AND dy <= 2 GROUP BY 1""")
def seam_retry(spark, sf_dir):
    """Distances to two lines beside the 180th meridian, also across it."""
    at = load(spark, sf_dir, "supplier").selectExpr("s_suppkey AS k", "IF(s_suppkey % 2 = 0, 179.75D - (s_suppkey % 13) / 8D, -179.75D + (s_suppkey % 11) / 8D) AS x", "((s_suppkey * 37) % 552) / 4D - 69 AS y")
    coast = spatial.edge_boxes(spark.createDataFrame([(179.5, -60.0, 179.5, 60.0), (-179.25, -60.0, -179.25, 60.0)], "x1 double, y1 double, x2 double, y2 double"))
    return spatial.coast_distance_deg(at, coast, "k", 2.0).where("d IS NOT NULL").select("k", F.round("d", 9).alias("d"))


@query(f"WITH {CASCADE} SELECT cell, lon - 2.0 / (1 << level) AS west, lat - 2.0 / (1 << level) AS south, lon + 2.0 / (1 << level) AS east, lat + 2.0 / (1 << level) AS north, 4 AS corners FROM cells")
def cell_polygons(spark, sf_dir):
    cells = sea.cells(spark, sf_dir)
    ring = geo.unwrapped(sea.GRID.ring("cell"))
    return cells.select("cell", geo.box_of(ring).alias("b"), F.size(ring).alias("corners")).selectExpr("cell", "b.x0 AS west", "b.y0 AS south", "b.x1 AS east", "b.y1 AS north", "corners")


@query("""SELECT name, '| ' || name || ' | ' || format('{:.1f}nm', nm) || ' | ' || lo || 'us | ' || format('{:.1f}ms', mid / 1000.0::double) || ' | ' || format('{:.1f}ms', mid / 1000.0::double) || ' | ' || format('{:.2f}s', hi / 1000000.0::double) || ' | 12>3 |' AS line
FROM (SELECT n_name AS name, n_nationkey * 100.5::double AS nm, 7 + n_nationkey AS lo, 1300 + 2 * n_nationkey AS mid, 3000000 + n_nationkey AS hi FROM nation) n""")
def bench_report(spark, sf_dir):
    stats = load(spark, sf_dir, "nation").selectExpr("n_name AS name", "n_nationkey * 100.5D AS distance_nm", "cast(7 + n_nationkey AS long) AS min_us", "cast(1300 + 2 * n_nationkey AS long) AS p50_us", "cast(1300 + 2 * n_nationkey AS long) AS p95_us", "cast(3000000 + n_nationkey AS long) AS max_us", "12 AS raw_hops", "3 AS smooth_hops")
    return bench.markdown(stats)
