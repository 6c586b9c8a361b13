"""Queries over benchmark statistics, polylines, rings, tags and text forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fairlead.functions import geo
from fairlead.functions.tables import load
from fairlead.plans import bench

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


STATS = "s AS (SELECT event_type AS name, list_sort(list(us)) AS v, count(*) AS n FROM (SELECT event_type, floor(value * 1000)::bigint AS us, user_id FROM events) t {where} GROUP BY 1)"
AT = "v[least(n * {p} // 100, n - 1) + 1]"


def _timings(spark, sf_dir):
    return load(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.floor(F.col("value") * 1000).cast("long").alias("us"), "user_id")


@query(f"WITH {STATS.format(where='')} SELECT name, v[1] AS min_us, {AT.format(p=50)} AS p50_us, {AT.format(p=95)} AS p95_us, v[n] AS max_us FROM s")
def bench_percentiles(spark, sf_dir):
    return bench.statistics(_timings(spark, sf_dir), "name", "us")


@query(f"""WITH {STATS.format(where='')}, cur AS (SELECT name, {AT.format(p=50)} AS p50_us FROM s), {STATS.format(where="WHERE user_id % 3 = 0 AND event_type <> 'click'").replace('s AS', 'b AS', 1)}, base AS (SELECT name, {AT.format(p=50)} AS base_us FROM b)
SELECT name, p50_us, coalesce(base_us, -1) AS base_us, round(coalesce(change, 0.0), 9) AS change, CASE WHEN base_us IS NULL THEN 'NEW' WHEN change > 0.1 THEN 'REGRESSION' WHEN change < -0.1 THEN 'IMPROVED' ELSE 'OK' END AS status
FROM (SELECT name, p50_us, base_us, (p50_us - base_us) / base_us::double AS change FROM cur LEFT JOIN base USING (name)) j""")
def bench_compare(spark, sf_dir):
    rows = _timings(spark, sf_dir)
    base = bench.statistics(rows.where("user_id % 3 = 0 AND name <> 'click'"), "name", "us")
    out = bench.compare(bench.statistics(rows, "name", "us"), base)
    return out.select("name", "p50_us", F.coalesce("base_us", F.lit(-1)).alias("base_us"), F.round(F.coalesce("change", F.lit(0.0)), 9).alias("change"), "status")


@query("""WITH p AS (SELECT user_id, event_id AS i, event_id % 5 = 0 AS land FROM events), r AS (SELECT user_id, i, coalesce(sum(land::int) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS raw FROM p),
g AS (SELECT user_id, raw, min(i) AS first_i, max(i) AS last_i, count(*) AS n FROM r GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY raw) AS span, count(*) OVER (PARTITION BY user_id) AS n_spans, first_i, last_i, n AS n_points FROM g""")
def water_spans(spark, sf_dir):
    points = load(spark, sf_dir, "events").selectExpr("user_id", "event_id AS i", "value AS x", "value AS y", "event_id % 5 = 0 AS land")
    spans = bench.water_spans(points, "user_id")
    return spans.select("user_id", F.col("span").cast("long").alias("span"), "n_spans", F.element_at("pts", 1)["i"].alias("first_i"), F.element_at("pts", -1)["i"].alias("last_i"), F.size("pts").cast("long").alias("n_points"))


@query("""WITH r AS (SELECT l_suppkey AS shape, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS ring, l_returnflag <> 'N' AS outer_ FROM lineitem),
g AS (SELECT shape, ring, sum(outer_::int) OVER (PARTITION BY shape ORDER BY ring) AS poly FROM r)
SELECT shape, poly::bigint AS poly, count(*) - 1 AS holes, min(ring) AS first_ring FROM g WHERE poly > 0 GROUP BY 1, 2""")
def ring_grouping(spark, sf_dir):
    """Each outer ring starts a polygon; the inner rings that follow are its holes, those before any outer ring are dropped."""
    from fairlead.sources.shapefile import polygon_numbers

    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    rings = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("shape"), F.row_number().over(order).alias("ring"), (F.col("l_returnflag") != "N").alias("is_outer"))
    numbered = polygon_numbers(rings, "shape", "ring", "is_outer")
    return numbered.groupBy("shape", "poly").agg((F.count("*") - 1).alias("holes"), F.min("ring").cast("long").alias("first_ring"))


@query("SELECT k, CASE WHEN us < 1000 THEN us || 'us' WHEN us < 1000000 THEN format('{:.1f}ms', us / 1000.0::double) ELSE format('{:.2f}s', us / 1000000.0::double) END AS text FROM (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 997 WHEN 1 THEN o_orderkey % 9973 * 100 + 25 ELSE o_orderkey % 9973 * 1000000 + 130000 END AS us FROM orders) t")
def time_texts(spark, sf_dir):
    us = F.expr("CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 997 WHEN 1 THEN o_orderkey % 9973 * 100 + 25 ELSE o_orderkey % 9973 * 1000000 + 130000 END")
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), us.alias("us")).select("k", geo.time_text("us").alias("text"))


@query("SELECT o_orderkey AS k, floor(abs(o_totalprice) * 10 + 0.5) / 10 * sign(o_totalprice) AS tenth FROM orders")
def round_tenths(spark, sf_dir):
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), geo.round_tenth("o_totalprice").alias("tenth"))


@query("""WITH w AS (SELECT event_id, value, user_id FROM events)
SELECT event_id, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS least FROM w""")
def span_minimum(spark, sf_dir):
    frame = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-7, 0)
    return load(spark, sf_dir, "events").select("event_id", F.min("value").over(frame).alias("least"))


@query("""SELECT event_id FROM events WHERE event_id % 3 <> 0 AND event_type IN ('view', 'click')""")
def tag_filter(spark, sf_dir):
    """natural=water and a listed water tag; rows without the tag are left out."""
    from fairlead.sources.geojson import water_of

    tags = F.create_map(F.lit("natural"), F.when(F.col("event_id") % 3 != 0, "water").otherwise("wood"), F.lit("water"), F.col("event_type"))
    return water_of(load(spark, sf_dir, "events").select("event_id", tags.alias("properties")), ["view", "click"]).select("event_id")


@query("""WITH l AS (SELECT l_orderkey AS k, bool_or((l_partkey % 1440) / 4.0 - 180 BETWEEN -175 AND -140 AND (l_suppkey % 720) / 4.0 - 90 BETWEEN -89 AND -70) AS inside FROM lineitem GROUP BY 1) SELECT k AS seg_id FROM l WHERE inside""")
def any_vertex_clip(spark, sf_dir):
    from fairlead.sources.geojson import clip_lines

    point = F.struct(((F.col("l_partkey") % 1440) / 4.0 - 180).alias("x"), ((F.col("l_suppkey") % 720) / 4.0 - 90).alias("y"))
    lines = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("seg_id")).agg(F.collect_list(point).alias("pts"))
    return clip_lines(lines, (-175.0, -89.0, -140.0, -70.0)).select("seg_id")
