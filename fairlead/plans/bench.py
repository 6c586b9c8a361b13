"""Route benchmarks: statistics, comparison with a baseline, and reports."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairlead.functions import geo
from fairlead.operators import kernel

#: Name, from (lat, lon), to (lat, lon).
ROUTES = (
    ("English Channel", 51.11, 1.32, 50.97, 1.86),
    ("Aegean Hop", 36.85, 28.28, 36.44, 28.23),
    ("Strait of Gibraltar", 36.13, -5.35, 35.79, -5.81),
    ("Baltic Crossing", 60.14, 24.97, 59.45, 24.76),
    ("Balearic Sea", 39.55, 2.64, 41.37, 2.18),
    ("Florida Strait", 24.55, -81.79, 23.15, -82.35),
    ("Malacca Route", 1.26, 103.86, 7.88, 98.38),
    ("Tasman Sea", -33.86, 151.28, -36.83, 174.78),
    ("South Atlantic", -33.92, 18.43, -22.91, -43.16),
    ("North Atlantic", 40.65, -74.03, 50.89, -1.39),
    ("Suez Canal", 29.50, 32.85, 31.50, 32.00),
    ("Panama Canal", 8.80, -79.45, 9.40, -80.05),
    ("Kiel Canal", 54.40, 10.20, 54.25, 9.10),
    ("Corinth Canal", 37.95, 22.95, 37.88, 23.05),
    ("Bosphorus", 40.85, 28.90, 41.35, 29.15),
    ("Dardanelles", 40.50, 26.72, 40.00, 26.15),
    ("Malacca Strait", 1.30, 103.90, 1.15, 103.45),
    ("Singapore Strait", 1.30, 103.80, 1.22, 104.20),
    ("Messina Strait", 38.30, 15.65, 38.05, 15.67),
    ("Dover Strait", 51.15, 1.30, 50.85, 1.75),
)
REGRESSION = 0.10


def statistics(timings: DataFrame, by: str, us: str) -> DataFrame:
    """min, p50, p95 and max of each group's timings: the value at trunc(n * percent / 100) of the sorted ones, without interpolation.

    Equal timings are counted first, before the shuffle; no group is held as an array.
    """
    counts = timings.groupBy(F.col(by).alias("by"), F.col(us).alias("us")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("by").orderBy("us"))
    ranked = counts.withColumn("upto", upto).join(timings.groupBy(F.col(by).alias("by")).agg(F.count(us).alias("all")), "by")

    def at(percent: int) -> Column:
        return F.min(F.when(F.col("upto") > F.least(F.floor(F.col("all") * F.lit(percent) / 100), F.col("all") - 1), F.col("us")))

    found = ranked.where("us IS NOT NULL").groupBy("by").agg(F.min("us").alias("min_us"), at(50).alias("p50_us"), at(95).alias("p95_us"), F.max("us").alias("max_us"))
    return found.withColumnRenamed("by", by)


def compare(current: DataFrame, baseline: DataFrame, same_buffer: bool | Column = True) -> DataFrame:
    """current(name, p50_us) against baseline(name, p50_us): change and NEW, REGRESSION, IMPROVED, OK, or N/A if the shore buffers differ."""
    both = current.select("name", "p50_us").join(baseline.select("name", F.col("p50_us").alias("base_us")), "name", "left")
    change = (F.col("p50_us") - F.col("base_us")) / F.col("base_us")
    same = same_buffer if isinstance(same_buffer, Column) else F.lit(same_buffer)
    status = F.when(F.col("base_us").isNull(), "NEW").when(~same, "N/A").when(F.col("change") > REGRESSION, "REGRESSION").when(F.col("change") < -REGRESSION, "IMPROVED").otherwise("OK")
    return both.withColumn("change", change).withColumn("status", status)


def timed(chart: kernel.Chart, snap, routes=ROUTES, iterations: int = 50, warm: int = 3, buffer_nm: float = 0.0) -> list[dict]:
    """Timings of each route that can be sailed, one after another on one thread: snap, search and smoothing."""
    out = []
    for name, *ends in routes:
        result = kernel.route(chart, snap, *ends, buffer_nm)
        if result is None:
            continue
        for _ in range(warm):
            kernel.route(chart, snap, *ends, buffer_nm)
        for _ in range(iterations):
            began = time.perf_counter_ns()
            kernel.route(chart, snap, *ends, buffer_nm)
            out.append({"name": name, "us": (time.perf_counter_ns() - began) // 1000, **{k: result[k] for k in ("distance_nm", "raw_hops", "smooth_hops")}})
    return out


def run(spark: SparkSession, chart: kernel.Chart, snap, **how) -> DataFrame:
    """name, distance_nm, raw_hops, smooth_hops, min_us, p50_us, p95_us, max_us."""
    rows = spark.createDataFrame(timed(chart, snap, **how), "name string, us long, distance_nm double, raw_hops int, smooth_hops int")
    return statistics(rows, "name", "us").join(rows.dropDuplicates(["name"]).drop("us"), "name")


def markdown(stats: DataFrame) -> DataFrame:
    """(name, line): a table row for each route."""
    cells = [F.col("name"), F.format_string("%.1fnm", "distance_nm"), *(geo.time_text(f"{p}_us") for p in ("min", "p50", "p95", "max")), F.format_string("%d>%d", "raw_hops", "smooth_hops")]
    return stats.select("name", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def as_json(stats: DataFrame, **about) -> DataFrame:
    """(name, json)."""
    fields = [F.struct(*(F.lit(v).alias(k) for k, v in about.items())).alias("run")] if about else []
    return stats.select("name", F.to_json(F.struct(*stats.columns, *fields)).alias("json"))


def water_spans(points: DataFrame, by: str) -> DataFrame:
    """points(by, i, x, y, land: the leg from this point on crosses land) as (by, span, n_spans, pts): spans between land legs of at least two points."""
    order = Window.partitionBy(by).orderBy("i")
    span = F.coalesce(F.sum(F.col("land").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = points.withColumn("raw_span", span).groupBy(by, "raw_span").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("pts")).where(F.size("pts") >= 2)
    return spans.withColumns({"span": F.row_number().over(Window.partitionBy(by).orderBy("raw_span")), "n_spans": F.count("*").over(Window.partitionBy(by))}).drop("raw_span")
