"""Queries over scalar geometry, predicates and spatial joins, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairlead.functions import geo
from fairlead.functions.tables import load
from fairlead.operators import spatial
from fairlead.plans import sea

QUERIES, SQL = {}, {}

LAND = """land AS (SELECT n_nationkey AS poly_id, -170.0::double + 70 * (n_nationkey % 5) AS x0, -66.0::double + 28 * (n_nationkey // 5) AS y0,
  -150.0::double + 70 * (n_nationkey % 5) + 4 * n_regionkey AS x1, -56.0::double + 28 * (n_nationkey // 5) + 2 * n_regionkey AS y1 FROM nation
  UNION ALL SELECT * FROM (VALUES (100, -120.25::double, -40.0::double, -119.75::double, -20.0::double), (101, 84, -8, 104, -6), (102, 84, 10, 104, 12), (103, 84, -6, 86, 10), (104, 102, -6, 104, 10)) v)"""
PINS = "pins AS (SELECT c_custkey AS k, ((c_custkey * 91) % 1392) / 4.0::double - 174 AS x, ((c_custkey * 37) % 552) / 4.0::double - 69 AS y FROM customer)"
SEGMENTS = f"{PINS}, segs AS (SELECT k, x AS ax, y AS ay, x + (k * 7 % 41 - 20) / 4.0::double AS bx, y + (k * 11 % 37 - 18) / 4.0::double AS by_ FROM pins)"
COAST = "coast AS (SELECT x0 AS cx, y0 AS cy, x1 AS dx, y0 AS dy FROM land UNION ALL SELECT x1, y0, x1, y1 FROM land UNION ALL SELECT x1, y1, x0, y1 FROM land UNION ALL SELECT x0, y1, x0, y0 FROM land)"


def turn(a, b, p):
    return f"sign(({b[0]} - {a[0]}) * ({p[1]} - {a[1]}) - ({b[1]} - {a[1]}) * ({p[0]} - {a[0]}))"


def boxed(p, a, b):
    return f"({p[0]} BETWEEN least({a[0]}, {b[0]}) AND greatest({a[0]}, {b[0]}) AND {p[1]} BETWEEN least({a[1]}, {b[1]}) AND greatest({a[1]}, {b[1]}))"


def meet(a, b, c, d):
    s = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
    return f"(({s[0]} * {s[1]} < 0 AND {s[2]} * {s[3]} < 0) OR ({s[0]} = 0 AND {boxed(c, a, b)}) OR ({s[1]} = 0 AND {boxed(d, a, b)}) OR ({s[2]} = 0 AND {boxed(a, c, d)}) OR ({s[3]} = 0 AND {boxed(b, c, d)}))"


def to_segment(p, a, b):
    dx, dy = f"({b[0]} - {a[0]})", f"({b[1]} - {a[1]})"
    t = f"(CASE WHEN {dx} * {dx} + {dy} * {dy} > 0 THEN least(1.0, greatest(0.0, (({p[0]} - {a[0]}) * {dx} + ({p[1]} - {a[1]}) * {dy}) / ({dx} * {dx} + {dy} * {dy}))) ELSE 0.0 END)"
    return f"sqrt(({p[0]} - {a[0]} - {t} * {dx}) * ({p[0]} - {a[0]} - {t} * {dx}) + ({p[1]} - {a[1]} - {t} * {dy}) * ({p[1]} - {a[1]} - {t} * {dy}))"


HAVERSINE = "2 * 3440.065 * asin(least(1.0, sqrt(sin(radians({1} - {0}) / 2) * sin(radians({1} - {0}) / 2) + cos(radians({0})) * cos(radians({1})) * sin(radians({3} - {2}) / 2) * sin(radians({3} - {2}) / 2))))"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


PAIRS = "((c_custkey * 13 + 5) % 1392) / 4{d} - 174 AS x2, ((c_custkey * 17 + 3) % 552) / 4{d} - 69 AS y2"


@query(f"WITH {PINS}, p AS (SELECT c_custkey AS k, {PAIRS.format(d='.0::double')} FROM customer) SELECT k, round({HAVERSINE.format('y', 'y2', 'x', 'x2')}, 6) AS nm FROM pins JOIN p USING (k)")
def haversine_pairs(spark, sf_dir):
    two = load(spark, sf_dir, "customer").selectExpr("((c_custkey * 91) % 1392) / 4D - 174 AS x", "((c_custkey * 37) % 552) / 4D - 69 AS y", "c_custkey AS k", *PAIRS.format(d="D").split(", "))
    return two.select("k", F.round(geo.haversine_nm("y", "x", "y2", "x2"), 6).alias("nm"))


@query("SELECT c_custkey AS k, least(255, greatest(0, floor(c_acctbal / 1000 / 0.02::double + 1e-9)))::int AS shore_q FROM customer")
def quantize_shore(spark, sf_dir):
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), geo.quantize_shore(F.col("c_acctbal") / 1000).alias("shore_q"))


@query("SELECT o_orderkey AS k, CASE WHEN nm > 0 THEN greatest(1, floor((nm * 100::float)::double + 0.5)::int) ELSE 0 END AS weight_cnm FROM (SELECT o_orderkey, ((o_totalprice / 1000) % 655)::float AS nm FROM orders)")
def quantize_weight(spark, sf_dir):
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), geo.quantize_weight((F.col("o_totalprice") / 1000) % 655).alias("weight_cnm"))


@query("""WITH b AS (SELECT c_custkey AS k, (c_custkey % 70 - 10) / 10.0::double AS nm, (c_custkey * 37) % 256 AS d FROM customer),
q AS (SELECT *, CASE WHEN nm > 0 THEN least(255, greatest(1, ceil(nm / 0.02::double - 1e-9)))::int END AS buffer_q FROM b)
SELECT k, coalesce(buffer_q, 0) AS buffer_q, round(CASE WHEN buffer_q IS NOT NULL AND d < buffer_q THEN 1 + 15 * (1 - d / buffer_q::double) ELSE 1.0::double END, 9) AS factor FROM q""")
def penalty_factor(spark, sf_dir):
    b = load(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "(c_custkey % 70 - 10) / 10D AS nm", "(c_custkey * 37) % 256 AS d").withColumn("buffer_q", geo.quantize_buffer("nm"))
    return b.select("k", F.coalesce("buffer_q", F.lit(0)).alias("buffer_q"), F.round(geo.penalty_factor("buffer_q", "d"), 9).alias("factor"))


SEAM = "SELECT c_custkey AS k, ((c_custkey * 91) % 1441) / 4{d} - 180 AS lon1, ((c_custkey * 37) % 552) / 4{d} - 69 AS lat1, ((c_custkey * 57 + 11) % 1441) / 4{d} - 180 AS lon2, ((c_custkey * 17 + 3) % 552) / 4{d} - 69 AS lat2 FROM customer"


def _seam(spark, sf_dir):
    load(spark, sf_dir, "customer").createOrReplaceTempView("fairlead_customer")
    return spark.sql(SEAM.format(d="D").replace("FROM customer", "FROM fairlead_customer"))


@query(f"""WITH s AS ({SEAM.format(d='.0::double')}), m AS (SELECT k, CASE WHEN abs(lon1 - lon2) > 180 THEN (greatest(lon1, lon2) + least(lon1, lon2) + 360) / 2 ELSE (lon1 + lon2) / 2 END AS mid FROM s)
SELECT k, round(mid - floor((mid + 180) / 360) * 360, 9) AS mid_lon FROM m""")
def wrap_midpoint(spark, sf_dir):
    return _seam(spark, sf_dir).select("k", F.round(geo.mid_lon("lon1", "lon2"), 9).alias("mid_lon"))


@query(f"""WITH s AS ({SEAM.format(d='.0::double')}), e AS (SELECT *, CASE WHEN lon1 > 0 THEN 180.0::double ELSE -180.0::double END AS edge FROM s),
c AS (SELECT *, abs(lon1 - lon2) > 180 AS cut, lat1 + (lat2 - lat1) * ((edge - lon1) / (lon2 + 2 * edge - lon1)) AS lat FROM e)
SELECT k, 0 AS part, lon1 AS x1, lat1 AS y1, CASE WHEN cut THEN edge ELSE lon2 END AS x2, round(CASE WHEN cut THEN lat ELSE lat2 END, 9) AS y2 FROM c
UNION ALL SELECT k, 1, -edge, round(lat, 9), lon2, lat2 FROM c WHERE cut""")
def split_antimeridian(spark, sf_dir):
    parts = _seam(spark, sf_dir).select("k", F.posexplode(geo.split_at_seam("lon1", "lat1", "lon2", "lat2")).alias("part", "s"))
    return parts.select("k", "part", "s.x1", F.when(F.col("part") == 1, F.round("s.y1", 9)).otherwise(F.col("s.y1")).alias("y1"), "s.x2", F.when(F.col("part") == 0, F.round("s.y2", 9)).otherwise(F.col("s.y2")).alias("y2"))


TEXTS = "SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN concat(' ', c_custkey % 100, '.5 , ', c_custkey % 200 - 100, ' ') WHEN 1 THEN 'abc,def' WHEN 2 THEN '1,2,3' WHEN 3 THEN concat(c_custkey % 91, ',-', c_custkey % 181) ELSE '' END AS t FROM customer"


@query(f"""WITH t AS ({TEXTS}), p AS (SELECT k, try_cast(trim(string_split(t, ',')[1]) AS double) AS lat, try_cast(trim(string_split(t, ',')[2]) AS double) AS lon, len(string_split(t, ',')) = 2 AS two FROM t)
SELECT k, CASE WHEN good THEN lat END AS lat, CASE WHEN good THEN lon END AS lon FROM (SELECT *, two AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AS good FROM p)""")
def parse_positions(spark, sf_dir):
    load(spark, sf_dir, "customer").createOrReplaceTempView("fairlead_customer")
    return spark.sql(TEXTS.replace("FROM customer", "FROM fairlead_customer")).select("k", geo.parse_position("t").alias("p")).select("k", "p.lat", "p.lon")


@query(f"WITH {LAND}, {PINS} SELECT k, NOT EXISTS (SELECT 1 FROM land WHERE x > x0 AND x < x1 AND y > y0 AND y < y1) AS water FROM pins")
def point_in_water(spark, sf_dir):
    points = sea.pins(spark, sf_dir)
    return points.join(spatial.in_land(points, sea.shapes(spark, sf_dir), "k").withColumn("land", F.lit(True)), "k", "left").select("k", F.col("land").isNull().alias("water"))


CELLS0 = "c AS (SELECT (ix << 26) + iy AS cell, -176.0::double + 4 * ix AS cx, -72.0::double + 4 * iy AS cy FROM range(88) a(ix), range(36) b(iy))"


@query(f"WITH {LAND}, {CELLS0} SELECT cell FROM c WHERE EXISTS (SELECT 1 FROM land WHERE x0 <= cx + 4 AND x1 >= cx AND y0 <= cy + 4 AND y1 >= cy)")
def cells_touch_land(spark, sf_dir):
    return spatial.touching_land(sea.GRID.all_cells(spark), sea.shapes(spark, sf_dir), sea.GRID)


@query(f"WITH {LAND}, {CELLS0} SELECT cell FROM c WHERE EXISTS (SELECT 1 FROM land WHERE x0 <= cx AND x1 >= cx + 4 AND y0 <= cy AND y1 >= cy + 4)")
def cells_inside_land(spark, sf_dir):
    return spatial.inside_land(sea.GRID.all_cells(spark), sea.shapes(spark, sf_dir), sea.GRID)


A, B, CC, D = ("ax", "ay"), ("bx", "by_"), ("cx", "cy"), ("dx", "dy")


@query(f"WITH {LAND}, {COAST}, {SEGMENTS} SELECT k FROM segs WHERE EXISTS (SELECT 1 FROM coast WHERE {meet(A, B, CC, D)})")
def segment_crosses_coast(spark, sf_dir):
    return spatial.crossing(sea.segments(spark, sf_dir), sea.coast(spark, sf_dir), "k")


@query(f"""WITH {LAND}, {COAST}, {PINS} SELECT k, round(min({to_segment(("x", "y"), CC, D)}), 9) AS d FROM pins LEFT JOIN coast
ON least(cx, dx) <= x + 6 AND greatest(cx, dx) >= x - 6 AND least(cy, dy) <= y + 6 AND greatest(cy, dy) >= y - 6 GROUP BY k""")
def point_coast_distance_deg(spark, sf_dir):
    return spatial.coast_distance_deg(sea.pins(spark, sf_dir), sea.coast(spark, sf_dir), "k", 6.0, 6.0).select("k", F.round("d", 9).alias("d"))


def _frame(p, ref, cos):
    return f"(({p[0]} - {ref[0]}) * 60 * {cos})", f"(({p[1]} - {ref[1]}) * 60)"


COS = "greatest(cos(radians(y)), 0.01)"


@query(f"""WITH {LAND}, {COAST}, {PINS}, j AS (SELECT k, {to_segment(("0.0", "0.0"), _frame(CC, ("x", "y"), COS), _frame(D, ("x", "y"), COS))} AS d FROM pins, coast)
SELECT k, round(least(300.0, min(d)), 6) AS d FROM j GROUP BY k""")
def point_coast_distance_nm(spark, sf_dir):
    return spatial.coast_distance_nm(sea.pins(spark, sf_dir), sea.coast(spark, sf_dir), "k", 300.0, 8.0).select("k", F.round("d", 6).alias("d"))


MID = ("((ax + bx) / 2)", "((ay + by_) / 2)")
MCOS = f"greatest(cos(radians({MID[1]})), 0.01)"
FA, FB, FC, FD = ((f"f{p[0]}", f"f{p[1]}") for p in (A, B, CC, D))
FRAMED = ", ".join(f"{e} AS {n}" for p, q in ((A, FA), (B, FB), (CC, FC), (D, FD)) for e, n in zip(_frame(p, MID, MCOS), q, strict=True))


@query(f"""WITH {LAND}, {COAST}, {SEGMENTS}, f AS (SELECT k, {FRAMED} FROM segs, coast),
j AS (SELECT k, CASE WHEN {meet(FA, FB, FC, FD)} THEN 0.0::double ELSE least({to_segment(FA, FC, FD)}, {to_segment(FB, FC, FD)}, {to_segment(FC, FA, FB)}, {to_segment(FD, FA, FB)}) END AS d FROM f)
SELECT k, round(least(120.0, min(d)), 6) AS d FROM j GROUP BY k""")
def segment_coast_distance_nm(spark, sf_dir):
    return spatial.segment_distance_nm(sea.segments(spark, sf_dir), sea.coast(spark, sf_dir), "k", 120.0, 4.0).select("k", F.round("d", 6).alias("d"))


@query(f"WITH {LAND}, {COAST}, {SEGMENTS} SELECT k, NOT EXISTS (SELECT 1 FROM coast WHERE {meet(A, B, CC, D)}) AS direct FROM segs")
def direct_line_routes(spark, sf_dir):
    asked = sea.segments(spark, sf_dir)
    return asked.join(spatial.crossing(asked, sea.coast(spark, sf_dir), "k").withColumn("blocked", F.lit(True)), "k", "left").select("k", F.col("blocked").isNull().alias("direct"))


BOXES = "SELECT o_orderkey AS k, ((o_orderkey * 91) % 1392) / 4{d} - 174 AS bx0, ((o_orderkey * 37) % 552) / 4{d} - 69 AS by0, ((o_orderkey * 91) % 1392) / 4{d} - 174 + o_orderkey % 7 AS bx1, ((o_orderkey * 37) % 552) / 4{d} - 69 + o_orderkey % 5 AS by1 FROM orders"


@query(f"WITH {LAND}, b AS ({BOXES.format(d='.0::double')}) SELECT k, poly_id FROM b JOIN land ON x0 <= bx1 AND x1 >= bx0 AND y0 <= by1 AND y1 >= by0")
def polygon_box_overlap(spark, sf_dir):
    load(spark, sf_dir, "orders").createOrReplaceTempView("fairlead_orders")
    boxes = spark.sql(BOXES.format(d="D").replace("FROM orders", "FROM fairlead_orders")).selectExpr("k", "struct(bx0 AS x0, by0 AS y0, bx1 AS x1, by1 AS y1) AS lbox")
    return spatial.box_join(boxes, sea.shapes(spark, sf_dir).select("poly_id", "rbox"), 8.0).select("k", "poly_id")


LAKES = "lakes AS (SELECT r_regionkey AS lake, -168.0::double + 70 * r_regionkey AS wx0, -64.0::double + 28 * r_regionkey AS wy0, -160.0::double + 70 * r_regionkey AS wx1, -60.0::double + 28 * r_regionkey AS wy1 FROM region)"


@query(f"""WITH {LAND}, {LAKES}, {PINS} SELECT k, EXISTS (SELECT 1 FROM land WHERE x > x0 AND x < x1 AND y > y0 AND y < y1)
AND NOT EXISTS (SELECT 1 FROM lakes WHERE x >= wx0 AND x <= wx1 AND y >= wy0 AND y <= wy1) AS dry FROM pins""")
def land_minus_water(spark, sf_dir):
    from fairlead.operators.subtract import dry_points

    lakes = load(spark, sf_dir, "region").selectExpr("r_regionkey AS r").selectExpr("cast(r AS int) AS poly_id", "-168D + 70 * r AS x0", "-64D + 28 * r AS y0", "-160D + 70 * r AS x1", "-60D + 28 * r AS y1")
    corners = F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))))
    water = spatial.land_shapes(lakes.select("poly_id", F.array(corners).alias("rings")))
    points = sea.pins(spark, sf_dir)
    dry = dry_points(points, sea.shapes(spark, sf_dir), water, "k").withColumn("dry", F.lit(True))
    return points.join(dry, "k", "left").select("k", F.coalesce("dry", F.lit(False)).alias("dry"))
