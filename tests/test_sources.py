"""Shapefiles, GeoJSON, graph tables, components and the cascade's special zones."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairlead.functions import geo
from fairlead.operators import cascade, graph, spatial, subtract
from fairlead.operators.components import components
from fairlead.operators.grid import QuadGrid
from fairlead.plans import bench
from fairlead.sources import geojson, graph_store, shapefile


def box(x0, y0, x1, y1):
    return [(x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0)]


def land_of(spark, *polygons):
    rows = [(i, [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]) for i, rings in enumerate(polygons)]
    return spark.createDataFrame(rows, "poly_id int, rings array<array<struct<x:double,y:double>>>")


def solid(land):
    return subtract.Land(spatial.land_shapes(land), spatial.coast_edges(land))


def test_shapefile(spark, tmp_path):
    hole = box(2, 2, 3, 3)[::-1]
    shapefile.write(f"{tmp_path}/b.shp", [[box(0, 0, 10, 10), hole, box(20, 0, 30, 10)]])
    shapefile.write(f"{tmp_path}/a.shp", [[box(50, 50, 60, 60)]])
    got = sorted((r.path.rsplit("/")[-1], r.poly, len(r.rings)) for r in shapefile.read_land(spark, str(tmp_path)).collect())
    assert got == [("a.shp", 1, 1), ("b.shp", 1, 2), ("b.shp", 2, 1)]
    with pytest.raises(ValueError):
        list(shapefile.records(b"no shapefile"))
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        shapefile.read_land(spark, f"{tmp_path}/none")


def test_geojson(spark, tmp_path):
    square = [[0, 0], [0, 1], [1, 1], [0, 0]]
    features = [
        ({"natural": "water", "water": "lake"}, {"type": "Polygon", "coordinates": [square, [[0, 0], [1, 1]]]}),
        ({"natural": "water", "water": "pond"}, {"type": "MultiPolygon", "coordinates": [[square], [[[0, 0], [1]]]]}),
        ({"natural": "water"}, {"type": "Point", "coordinates": [1, 2]}),
    ]
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": p, "geometry": g} for p, g in features]}
    (tmp_path / "w.json").write_text(json.dumps(doc))
    got = geojson.read_polygons(spark, f"{tmp_path}/w.json")
    assert sorted(len(r.rings) for r in got.collect()) == [1, 1]
    assert [r.rings[0][0].x for r in geojson.water_of(got, ["lake"]).collect()] == [0.0]
    lines = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 2.0)]), (2, [(5.0, 5.0)])], "seg_id int, pts array<struct<x:double,y:double>>")
    geojson.write_collection(geojson.coast_features(lines).unionByName(geojson.coast_features(lines.withColumn("seg_id", F.col("seg_id") + 5))).select("feature"), f"{tmp_path}/out")
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert len(json.loads(text)["features"]) == 2


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2060)] + [(5000, 5000)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = {r.node: r.component for r in components(spark, spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_graph_store(spark, tmp_path):
    grid = QuadGrid(0.0, 0.0, 1.0, 4, 4)
    cells = grid.all_cells(spark)
    edges = graph.graph_edges(cells, solid(land_of(spark, [box(1.2, 1.2, 1.4, 1.4)])), grid)
    assert edges.count() == 42  # 24 straight and 18 diagonal
    nodes = graph.nodes_of(cells, graph.shore_distance(cells, spatial.coast_edges(land_of(spark, [box(1.2, 1.2, 1.4, 1.4)])), grid), grid)
    rows = graph.edge_rows(edges, nodes)
    coast = spatial.coast_edges(land_of(spark, [box(1.2, 1.2, 1.4, 1.4)]))
    graph_store.save(spark, str(tmp_path), nodes, rows, coast)
    again = graph_store.load(spark, str(tmp_path))
    assert [x.count() for x in again] == [16, 84, 4]
    assert "edges end outside the graph" in graph_store.faults(again[0].where("node_id < 15"), again[1])
    assert graph_store.faults(again[0].withColumn("cell", -F.col("cell")), again[1])
    spark.createDataFrame([("fairlead graph", 2)], "kind string, version int").write.mode("overwrite").parquet(f"{tmp_path}/_meta")
    with pytest.raises(ValueError, match="Rebuild"):
        graph_store.load(spark, str(tmp_path))


def test_prune(spark):
    cells = spark.createDataFrame([(i,) for i in range(6)], "cell long")
    edges = spark.createDataFrame([(0, 1, 5), (2, 3, 5), (3, 4, 5)], "a long, b long, weight_cnm int")
    labels = graph.component_labels(spark, cells, edges)
    kept, left = graph.prune(cells, edges, graph.main_component(labels))
    assert sorted(r.cell for r in kept.collect()) == [2, 3, 4] and left.count() == 2
    tie = spark.createDataFrame([(5, 5), (6, 5), (1, 1), (2, 1)], "cell long, component long")
    assert sorted(r.cell for r in graph.main_component(tie).collect()) == [1, 2]


def test_zones(spark):
    config = cascade.Cascade(thresholds=((0, 1.0),), leaf=1, zone=0, grid=QuadGrid(0.0, 0.0, 2.0, 6, 6))
    land = land_of(spark, [box(3.1, 0.5, 3.9, 11.5)], [box(4.1, 0.5, 4.9, 11.5)])  # a channel 0.2 wide
    plain = {r.cell for r in cascade.cascade_cells(spark, solid(land), config).collect()}
    passages = spark.createDataFrame([("p", 3.5, 4.0, 4.5, 6.0, 5)], "name string, min_lon double, min_lat double, max_lon double, max_lat double, leaf_resolution int")
    found = {r.cell for r in cascade.cascade_cells(spark, solid(land), config, passages).collect()}
    fine = {c for c in found if c >> 52 > 1}
    assert plain <= found and fine and max(c >> 52 for c in found) == 5
    grid = config.grid
    centers = spark.createDataFrame([(c,) for c in fine], "cell long").select(grid.box("cell").alias("b")).collect()
    assert any(4.0 - 0.2 <= r.b.x0 and r.b.x1 <= 4.1 for r in centers)


def test_predicates(spark):
    holed = land_of(spark, [box(0, 0, 10, 10), box(4, 4, 6, 6)[::-1]])
    shapes = spatial.land_shapes(holed)
    points = spark.createDataFrame([(0, 1.0, 1.0), (1, 5.0, 5.0), (2, 0.0, 5.0), (3, 4.0, 5.0), (4, 11.0, 1.0)], "k int, x double, y double")
    assert sorted(r.k for r in spatial.in_land(points, shapes, "k").collect()) == [0]
    grid = QuadGrid(-2.0, -2.0, 1.0, 14, 14)
    cells = grid.all_cells(spark)
    inside = {(r.b.x0, r.b.y0) for r in spatial.inside_land(cells, shapes, grid).select(grid.box("cell").alias("b")).collect()}
    assert inside == {(x, y) for x in range(10) for y in range(10) if not (4 <= x < 6 and 4 <= y < 6)}
    touch = {(r.b.x0, r.b.y0) for r in spatial.touching_land(cells, shapes, grid).select(grid.box("cell").alias("b")).collect()}
    assert touch == {(x, y) for x in range(-1, 11) for y in range(-1, 11)}


def test_seam(spark):
    coast = spatial.edge_boxes(spark.createDataFrame([(179.98, -0.5, 179.98, 0.5)], "x1 double, y1 double, x2 double, y2 double"))
    points = spark.createDataFrame([(0, -179.99, 0.0), (1, 0.0, 0.0)], "k int, x double, y double")
    deg = {r.k: r.d for r in spatial.coast_distance_deg(points, coast, "k", 0.05).collect()}
    assert deg[0] == pytest.approx(0.03) and deg[1] is None
    nm = {r.k: r.d for r in spatial.coast_distance_nm(points, coast, "k").collect()}
    assert nm[0] == pytest.approx(1.8) and nm[1] == 5.1
    walls = spatial.edge_boxes(spark.createDataFrame([(179.95, -1.0, 179.95, 1.0), (0.0, -1.0, 0.0, 1.0)], "x1 double, y1 double, x2 double, y2 double"))
    asked = spark.createDataFrame([(0, 179.9, 0.0, -179.9, 0.0), (1, 170.0, 0.0, 175.0, 0.0)], "k int, lon1 double, lat1 double, lon2 double, lat2 double")
    assert [r.k for r in spatial.crossing(asked, walls, "k").collect()] == [0]


def test_boundary(spark):
    land, water = land_of(spark, [box(0, 0, 10, 10)]), land_of(spark, [box(4, -1, 6, 11)])
    left = subtract.boundary(spatial.coast_edges(land), spatial.coast_edges(water), spatial.land_shapes(land), spatial.land_shapes(water))
    length = sum(abs(r.x2 - r.x1) + abs(r.y2 - r.y1) for r in left.collect())
    assert length == pytest.approx(2 * (2 * 4 + 2 * 10))


def test_scalars(spark):
    one = spark.range(1)
    row = one.select(
        *(geo.quantize_shore(F.lit(v)).alias(f"s{i}") for i, v in enumerate((0.0, 0.019, 0.02, 0.199, 5.1, 99.0, -1.0))),
        *(geo.quantize_buffer(F.lit(v)).alias(f"b{i}") for i, v in enumerate((0.0, -1.0, 0.1, 0.001, 99.0, 0.14))),
        *(geo.quantize_weight(F.lit(v)).alias(f"w{i}") for i, v in enumerate((0.004, 186.0, 0.0))),
        geo.mid_lon(F.lit(179.95), F.lit(-179.95)).alias("m"),
        geo.haversine_nm(F.lit(0.0), F.lit(10.0), F.lit(0.0), F.lit(-80.0)).alias("h"),
        geo.round_tenth(F.lit(0.25)).alias("t"),
    ).first()
    assert list(row[:7]) == [0, 0, 1, 9, 255, 255, 0] and list(row[7:13]) == [None, None, 5, 1, 255, 7] and list(row[13:16]) == [1, 18600, 0]
    assert abs(row.m) == 180 and row.h == pytest.approx(geo.EARTH_NM * math.pi / 2, abs=1e-6) and row.t == 0.3
    with pytest.raises(Exception, match="too long"):
        one.select(geo.quantize_weight(F.lit(655.36)).alias("w")).collect()
    texts = spark.createDataFrame([("-12.5,131",), ("  7 ,\t-0.25 ",), ("-90,180",), ("north,east",), ("4;5",), ("4,5,6",), ("",), ("1,NaN",), ("0,180.5",), (None,)], "t string")
    assert [r.p is not None for r in texts.select(geo.parse_position("t").alias("p")).collect()] == [True] * 3 + [False] * 7


def test_bench(spark):
    rows = spark.createDataFrame([("a", v) for v in range(10)], "name string, us long")
    assert tuple(bench.statistics(rows, "name", "us").first())[1:] == (0, 5, 9, 9)
    def p50(v):
        return spark.createDataFrame([("r", v)], "name string, p50_us long")

    assert bench.compare(p50(2000), p50(1000)).first().status == "REGRESSION"
    assert bench.compare(p50(2000), p50(1000), same_buffer=False).first().status == "N/A"
    assert bench.compare(p50(1010), p50(1000)).first().status == "OK"
    assert bench.compare(p50(1010), p50(1000).where("false")).first().status == "NEW"


def test_canal(spark):
    """A canal through an island: cells in it are water, those beside it aren't."""
    config = cascade.Cascade(thresholds=((0, 1.0), (1, 0.5)), leaf=2, zone=0, grid=QuadGrid(0.0, 0.0, 2.0, 6, 6))
    land, water = land_of(spark, [box(2.0, 2.0, 10.0, 10.0)]), land_of(spark, [box(5.25, 1.0, 6.75, 11.0)])
    dry = subtract.DryLand(land, water)
    dry.shapes, dry.coast, dry.water = dry.shapes.cache(), dry.coast.cache(), dry.water.cache()
    cells = cascade.cascade_cells(spark, dry, config)
    boxes = [r.b for r in cells.select(config.grid.box("cell").alias("b")).collect()]
    across = sorted((b.x0, b.x1) for b in boxes if b.y0 == 6.0 and b.x1 - b.x0 == 0.5 and 2 <= b.x0 < 10)
    assert across == [(5.5, 6.0), (6.0, 6.5)]
    wet = {r.cell for r in cascade.cascade_cells(spark, solid(land), config).collect()}
    assert not [r for r in cells.select("cell", config.grid.box("cell").alias("b")).collect() if r.cell in wet and 5.25 < r.b.x0 < 6.5 and 2.5 < r.b.y0 < 9]
