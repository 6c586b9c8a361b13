"""python -m fairlead build | route | geojson | bench: thin entry points over the plans."""

from __future__ import annotations

import argparse


def main() -> None:
    parser = argparse.ArgumentParser(prog="fairlead")
    sub = parser.add_subparsers(dest="what", required=True)
    b = sub.add_parser("build", help="land polygons (.shp) to a graph")
    b.add_argument("shapefile")
    b.add_argument("graph")
    b.add_argument("--bbox")
    b.add_argument("--water", help="folder of <passage>-water.geojson, for each passage with canal water that meets the box")
    r = sub.add_parser("route", help="requests (Parquet) to answers (Parquet)")
    r.add_argument("graph")
    r.add_argument("requests")
    r.add_argument("out")
    g = sub.add_parser("geojson", help="a graph's cells as a FeatureCollection")
    g.add_argument("graph")
    g.add_argument("out")
    g.add_argument("--bbox")
    n = sub.add_parser("bench", help="times the published routes")
    n.add_argument("graph")
    n.add_argument("--iterations", type=int, default=50)
    n.add_argument("--shore-buffer", type=float, default=0.0)
    n.add_argument("--json", action="store_true")
    args = parser.parse_args()

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from fairlead.operators import kernel
    from fairlead.operators.cascade import PLANET
    from fairlead.plans import bench, build, passages, routes
    from fairlead.sources import geojson, graph_store, shapefile

    spark, config = SparkSession.builder.getOrCreate(), PLANET
    grid, levels = config.grid, range(max(passages.LEVELS.values()) + 1)
    if args.what == "build":
        land = shapefile.read_land(spark, args.shapefile).select(F.struct("path", "shape", "poly").alias("poly_id"), "rings")
        box = passages.parse_box(args.bbox) if args.bbox else None
        found = passages.of_planet(spark, box)
        faults = build.run(spark, land, args.graph, config, passages=found, box=box, water=passages.canal_water(spark, found, args.water))
        raise SystemExit("; ".join(faults) or 0)
    nodes, edges, coast = graph_store.load(spark, args.graph)
    if args.what == "geojson":
        box = passages.parse_box(args.bbox) if args.bbox else (-180.0, -90.0, 180.0, 90.0)
        inside = nodes.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
        geojson.write_collection(geojson.cell_features(inside.select("cell"), grid).select("feature"), args.out)
        return
    chart, rule = routes.chart(nodes, edges, coast), routes.snap_rule(grid, levels)
    if args.what == "route":
        routes.response(routes.route(spark, spark.read.parquet(args.requests), chart, grid, rule)).write.parquet(args.out)
        return
    stats = bench.run(spark, chart, kernel.Snapper(chart, grid, rule), iterations=args.iterations, buffer_nm=args.shore_buffer)
    for row in (bench.as_json(stats, iterations=args.iterations) if args.json else bench.markdown(stats)).collect():
        print(row[1])


if __name__ == "__main__":
    main()
