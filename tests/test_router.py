"""Routes answered on the JVM, against kernel.route on the same chart."""

import json
import math

import numpy as np
import pytest

from fairlead.operators import kernel
from fairlead.operators.grid import QuadGrid
from fairlead.plans import queries_graph, routes
from fairlead.streaming import routes as stream

GRID = QuadGrid(x0=-180.0, y0=-90.0, base=4.0, nx=90, ny=45)
LOCAL = QuadGrid(x0=-30.0, y0=-12.0, base=3.0, nx=20, ny=9)
RULE = kernel.SnapRule({0: 120.0, 1: 60.0}, {0: 15, 1: 20})
PARTIAL = kernel.SnapRule({0: 120.0, 1: 60.0}, {0: 6}, first_rings=1, last_rings=9)


def sea(grid, columns, rows, coast, rng):
    """Some cells of two levels, linked to those about; some links, and some of the main component, are missing."""
    keep = [(level, ix, iy) for level in (0, 1) for ix in (x * 2**level + i for x in columns for i in range(2**level)) for iy in (y * 2**level + i for y in rows for i in range(2**level)) if rng.uniform() < (0.3, 0.5)[level]]
    cells = sorted({level << 52 | ix << 26 | iy for level, ix, iy in keep})
    size = [grid.base / 2 ** (c >> 52) for c in cells]
    lon = np.array([grid.x0 + ((c >> 26 & (1 << 26) - 1) + 0.5) * s for c, s in zip(cells, size, strict=True)])
    lat = np.array([grid.y0 + ((c & (1 << 26) - 1) + 0.5) * s for c, s in zip(cells, size, strict=True)])
    n = len(cells)
    far = kernel.haversine(lat[:, None], lon[:, None], lat, lon) if n else np.zeros((0, 0))
    src, dst = np.nonzero(np.triu(far < 400, 1) & (rng.uniform(size=(n, n)) < 0.7))
    weight = np.round(far[src, dst] * 100).astype(int)
    coast = kernel.Coast(np.asarray(coast, np.float32))
    offsets, target, cost = kernel.adjacency(n, np.concatenate([src, dst]), np.concatenate([dst, src]), np.tile(weight, 2))
    shore = np.array([min(255, int(coast.point_nm(x, y) / kernel.SHORE_UNIT_NM)) for x, y in zip(lon.tolist(), lat.tolist(), strict=True)], np.uint8)
    return kernel.Chart(np.array(cells, np.int64), lat, lon, shore, rng.uniform(size=n) < 0.95, offsets, target, cost, coast)


def shores(rng, n, low, high, long):
    at = rng.uniform(low, high, (n, 2))
    out = np.hstack([at, at + rng.uniform(-long, long, (n, 2))])
    out[:, [0, 2]] = np.where(out[:, [0, 2]] > 180, out[:, [0, 2]] - 360, out[:, [0, 2]])
    return out[np.abs(out[:, 0] - out[:, 2]) < 180]


def agree(spark, chart, grid, rule, low, high, rng, n=150):
    """Answers, the requests without a way among them, are kernel.route's; returns these."""
    ends = rng.uniform(low * 2, high * 2, (n, 4))
    ends[:, [0, 2]] = np.where(ends[:, [0, 2]] > 180, ends[:, [0, 2]] - 360, ends[:, [0, 2]])
    ends[n // 2 :, 2:] = ends[n // 2, 2:]  # one goal
    asked = [(i, float(b), float(a), float(d), float(c), (0.0, 1.5, 5.0)[i % 3]) for i, (a, b, c, d) in enumerate(ends.tolist())]
    snap = kernel.Snapper(chart, grid, rule)
    want = [kernel.route(chart, snap, *r[1:]) for r in asked]
    got = {r.req_id: r for r in routes.route(spark, spark.createDataFrame(asked, stream.REQUESTS).coalesce(2), chart, grid, rule).collect()}
    for i, w in enumerate(want):
        g = got[i].result
        assert (g is None, got[i].error) == (w is None, "404" if w is None else None)
        if w:
            assert (g.raw_hops, g.smooth_hops, g.coordinates, g.land_legs) == (w["raw_hops"], w["smooth_hops"], w["coordinates"], w["land_legs"])
            assert math.isclose(g.distance_nm, w["distance_nm"], rel_tol=1e-12, abs_tol=1e-9)
    assert len(got) == n
    return want


@pytest.mark.parametrize(("n", "long"), [(12, 6.0), (400, 0.7)])  # with more than Coast.FEW by buckets
def test_against_the_kernel(spark, n, long):
    rng = np.random.default_rng(n)
    low, high = (164.0, -14.0), (196.0, 14.0)  # across the seam
    chart = sea(GRID, [*range(86, 90), *range(4)], range(19, 26), shores(rng, n, low, high, long), rng)
    want = agree(spark, chart, GRID, RULE, low, high, rng)
    assert any(w is None for w in want) or max(w["raw_hops"] for w in want) > 4
    assert sum(bool(w and w["land_legs"]) for w in want) and sum(bool(w and w["raw_hops"] > 3) for w in want) > 20
    low, high = (-30.0, -12.0), (30.0, 15.0)  # a grid with edges, some ways missing
    chart = sea(LOCAL, range(0, 20, 2), range(9), shores(rng, n, low, high, long), rng)
    agree(spark, chart, LOCAL, PARTIAL, low, high, rng)


def test_without_nodes_or_coast(spark):
    rng = np.random.default_rng(1)
    low, high = (-30.0, -12.0), (30.0, 15.0)
    wall = [(0.0, -90.0, 0.0, 90.0)]
    assert None in agree(spark, sea(LOCAL, [], [], wall, rng), LOCAL, RULE, low, high, rng, 20)
    assert None not in agree(spark, sea(LOCAL, range(20), range(9), np.zeros((0, 4)), rng), LOCAL, RULE, low, high, rng, 20)


@pytest.fixture
def sea_of_test(spark, monkeypatch):
    """The named queries get this chart and these requests."""
    rng = np.random.default_rng(2)
    chart = sea(queries_graph.sea.GRID, range(0, 88, 8), range(0, 36, 6), [(0.0, -60.0, 0.0, 60.0)], rng)
    asked = [(i, i % 90 - 45.0, i % 170 - 85.0, i % 3 * 10.0, i % 4 * 20.0, 0.0) for i in range(400)]
    monkeypatch.setattr(routes, "chart", lambda *_: chart)
    for table in ("nodes", "edge_rows", "coast"):
        monkeypatch.setattr(queries_graph.sea, table, lambda *_: None)
    monkeypatch.setattr(queries_graph, "requests", lambda *_: spark.createDataFrame(asked, stream.REQUESTS))
    return chart, asked


def on_the_jvm(found):
    plan = found._jdf.queryExecution().executedPlan().toString()
    return "Python" not in plan and "InArrow" not in plan


def test_route_distance_stays_on_the_jvm(spark, sea_of_test):
    """No request passes through Python, and those to one goal follow each other."""
    found = queries_graph.route_distance(spark, "")
    assert on_the_jvm(found)
    goals = [[(r.to_lat, r.to_lon) for r in part] for part in queries_graph.routed(spark, "").select("to_lat", "to_lon").rdd.glom().collect()]
    assert all(part == sorted(part) for part in goals) and sum(map(len, goals)) == 400 == found.count()


def test_route_response_stays_on_the_jvm(spark, sea_of_test):
    """No request passes through Python, and the bodies are those of kernel.route."""
    chart, asked = sea_of_test
    found = queries_graph.route_response(spark, "")
    assert on_the_jvm(found)
    snap, got = kernel.Snapper(chart, queries_graph.sea.GRID, routes.snap_rule(queries_graph.sea.GRID, range(3))), {r.req_id: r for r in found.collect()}
    assert len(got) == len(asked) and {r.status for r in got.values()} == {200, 404}
    for r in asked:
        w, body = kernel.route(chart, snap, *r[1:]), json.loads(got[r[0]].body)
        if w is None:
            assert got[r[0]].status == 404 and body == {"error": "no route found"}
            continue
        assert abs(body.pop("distance_nm") - w["distance_nm"]) < 0.0501
        assert body == {"raw_hops": w["raw_hops"], "smooth_hops": w["smooth_hops"], "land_legs": w["land_legs"], "shore_buffer_nm": 0.0, "geometry": {"type": "LineString", "coordinates": w["coordinates"]}}
