"""Builds, archives, streams, and every query against its SQL on the smallest tables."""

import json
import sys
import zipfile
from pathlib import Path

import pytest

from fairlead.__main__ import main
from fairlead.operators import graph, spatial
from fairlead.operators.cascade import PLANET, Cascade
from fairlead.operators.grid import QuadGrid
from fairlead.operators.subtract import Land
from fairlead.plans import build, passages, registry, routes
from fairlead.sources import archive, graph_store, shapefile
from fairlead.streaming import routes as stream

DATA = Path("/root/testdata/sf0.001")


def box(x0, y0, x1, y1):
    return [{"x": x, "y": y} for x, y in ((x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0))]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("graph"))
    config = Cascade(thresholds=((0, 1.0),), leaf=1, zone=0, grid=QuadGrid(0.0, 0.0, 2.0, 8, 8))
    land = spark.createDataFrame([(1, [box(6.5, 2.5, 9.5, 13.5)]), (2, [box(1.2, 1.2, 1.8, 1.8)])], "poly_id int, rings array<array<struct<x:double,y:double>>>")
    assert build.run(spark, land, path, config) == []
    assert build.coastline(land).count() == 2
    return path, config


def test_route(spark, built, tmp_path):
    path, config = built
    chart = routes.chart(*graph_store.load(spark, path))
    rule = routes.snap_rule(config.grid, range(2))
    asked = spark.createDataFrame([(1, 8.0, 4.0, 8.0, 12.0, 0.0), (2, 1.0, 3.0, 3.0, 3.0, 0.0), (3, 95.0, 0.0, 1.0, 1.0, 0.0), (4, 8.0, 4.0, 8.0, 12.0, 5.1), (5, 8.0, 4.0, 8.0, 12.0, None)], stream.REQUESTS)
    got = {r.req_id: r for r in routes.route(spark, asked, chart, config.grid, rule).collect()}
    assert got[1].error is None and got[1].result.land_legs == [] and got[1].result.distance_nm > 8 * 59
    assert got[1].result.coordinates[0] == [4.0, 8.0] and got[1].result.coordinates[-1] == [12.0, 8.0]
    assert got[2].result.raw_hops == 2 and got[3].error == "400" and got[4].error == "400" and got[5].result == got[1].result
    asked.coalesce(1).write.parquet(f"{tmp_path}/in")
    query = stream.answer(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", chart, config.grid, rule)
    query.awaitTermination(120)
    assert sorted((r.req_id, r.status) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, 200), (2, 200), (3, 400), (4, 400), (5, 200)]


def test_default_grid(spark):
    """Open ocean at the equator, at the seam and at a pole, on the default grid: every edge can be stored."""
    config, none = Cascade(), spark.createDataFrame([], "poly_id int, rings array<array<struct<x:double,y:double>>>")
    land = Land(spatial.land_shapes(none), spatial.coast_edges(none))
    grid = config.grid
    cells = grid.all_cells(spark).where(grid.ix("cell").isin(0, 359) & (grid.iy("cell") == 90))  # two, across the seam
    for where in ((0.1, 0.1, 3.9, 2.9), (10.1, 88.5, 12.5, 89.9)):  # 4 x 3 and 3 x 2
        cells = cells.unionByName(grid.all_cells(spark, box=where))
    edges = graph.graph_edges(cells, land, grid)
    assert edges.count() == 1 + 29 + 11 and edges.agg({"weight_cnm": "max"}).first()[0] < 9000


def test_archive(tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("deep/a.shp", b"1")
    assert [p.name for p in archive.unpack(f"{tmp_path}/z.zip", f"{tmp_path}/land").iterdir()] == ["a.shp"]
    (tmp_path / "bad.zip").write_bytes((tmp_path / "z.zip").read_bytes()[:40])
    with pytest.raises(zipfile.BadZipFile):
        archive.unpack(f"{tmp_path}/bad.zip", f"{tmp_path}/other")
    assert not (tmp_path / "other").exists()
    assert archive.ensure(f"{tmp_path}/z.zip").exists()
    with pytest.raises(FileNotFoundError):
        archive.ensure(f"{tmp_path}/none")


def test_passages(spark):
    found = passages.passages(spark)
    assert found.count() == 14 and passages.overlapping(found, passages.parse_box("dev-small")).count() == 1
    assert passages.parse_box("1,2,3,4") == (1, 2, 3, 4)
    with pytest.raises(ValueError):
        passages.parse_box("1,2")


def test_planet(spark):
    grid = PLANET.grid
    assert grid.wraps and grid.all_cells(spark).count() == 64_800 and PLANET.thresholds[-1] == (PLANET.leaf - 1, 0.002)
    at = spark.createDataFrame([(179.9, 80.5), (-179.9, 80.5), (0.0, -89.9)], "x double, y double").select(grid.at(0, "x", "y").alias("cell"))
    cells = at.select("cell", grid.neighbors("cell").alias("near")).collect()
    assert cells[1].cell in cells[0].near and cells[0].cell in cells[1].near and cells[2].cell is not None


def test_canal_water(spark, tmp_path):
    def feature(kind, ring):
        return {"type": "Feature", "properties": {"natural": "water", "water": kind}, "geometry": {"type": "Polygon", "coordinates": [[[p["x"], p["y"]] for p in ring]]}}

    found = passages.of_planet(spark, (9.0, 53.0, 11.0, 55.0))
    assert [(r.name, r.leaf_resolution) for r in found.collect()] == [("Kiel Canal", 15)]
    with pytest.raises(ValueError, match="kiel-canal-water.geojson"):
        passages.canal_water(spark, found, None)
    (tmp_path / "kiel-canal-water.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature("canal", box(9.1, 53.9, 9.2, 54.0)), feature("pond", box(9.1, 53.9, 9.2, 54.0)), feature("canal", box(8.0, 53.9, 9.0, 54.0))]}))
    assert [r.rings[0][0].x for r in passages.canal_water(spark, found, str(tmp_path)).collect()] == [9.1]
    assert passages.canal_water(spark, passages.of_planet(spark, (22.9, 37.8, 23.1, 38.0)), None) is None


def test_build_command(spark, tmp_path, monkeypatch):
    """A channel of 0.0004 degrees in the corridor of the Corinth Canal is in the graph that the command builds."""
    land = [[[(p["x"], p["y"]) for p in box(*b)]] for b in ((22.97, 37.91, 22.9848, 37.93), (22.9852, 37.91, 23.0, 37.93))]
    shapefile.write(f"{tmp_path}/land.shp", land)
    monkeypatch.setattr(sys, "argv", ["fairlead", "build", f"{tmp_path}/land.shp", f"{tmp_path}/graph", "--bbox", "22.93,37.87,23.04,37.97"])
    with pytest.raises(SystemExit) as end:
        main()
    assert end.value.code in (0, None)
    nodes = graph_store.load(spark, f"{tmp_path}/graph")[0]
    inside = nodes.where("lon > 22.9848 AND lon < 22.9852 AND lat > 37.911 AND lat < 37.929").groupBy("res").count().collect()
    assert inside and {r.res for r in inside} <= {12, 13, 14, 15}
    assert nodes.selectExpr("min(res) = 0 OR min(res) = 1 AS far", "max(res) AS finest").first() == (True, 15)


@pytest.mark.skipif(not DATA.exists(), reason="the tables aren't here")
def test_queries(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    queries, wrong = registry.queries(), []
    for name, sql in registry.oracle_sql().items():
        ours = queries[name](spark, str(DATA)).toPandas()
        theirs = con.sql(sql).df()
        columns = sorted(ours.columns)
        if columns != sorted(theirs.columns) or sorted(map(repr, ours[columns].astype(object).itertuples(index=False, name=None))) != sorted(map(repr, theirs[columns].astype(object).itertuples(index=False, name=None))):
            wrong.append(name)
    assert wrong == []
