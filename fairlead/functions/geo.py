"""Geometry as column expressions: no function here leaves the JVM.

Coordinates are degrees. Functions that take positions name them (lat, lon); planar functions take (x, y) with x
the longitude. Distances are nautical miles unless the name says degrees.
"""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
EARTH_NM = 3440.065
SHORE_UNIT_NM = 0.02
SHORE_CAP_NM = 5.1
PENALTY = 15.0
DEGREE_NM = 60.0
LEAST_COS = 0.01
LARGEST_WEIGHT_NM = 655.35

C = Column | str | float | int


def col(x: C) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def haversine_nm(lat1: C, lon1: C, lat2: C, lon2: C) -> Column:
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2.0)
    return F.asin(F.least(F.lit(1.0), F.sqrt(a))) * (2 * EARTH_NM)


def quantize_shore(nm: C) -> Column:
    """Units of 0.02 nm, rounded down, 0 to 255."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(col(nm) / SHORE_UNIT_NM + 1e-9))).cast("int")


def quantize_buffer(nm: C) -> Column:
    """A requested buffer in units of 0.02 nm, rounded up, 1 to 255; null for none (zero, negative or NaN)."""
    nm = col(nm)
    return F.when((nm > 0) & ~F.isnan(nm), F.least(F.lit(255), F.greatest(F.lit(1), F.ceil(nm / SHORE_UNIT_NM - 1e-9))).cast("int"))


def quantize_weight(nm: C) -> Column:
    """Hundredths of a nautical mile, half away from zero, at least 1 if positive; an error above the range. Single precision, as stored."""
    nm = col(nm).cast("float")
    return (
        F.when(nm > F.lit(LARGEST_WEIGHT_NM).cast("float"), F.raise_error(F.concat(F.lit(f"an edge is too long to store (at most {LARGEST_WEIGHT_NM} nm): "), nm.cast("string"))).cast("int"))
        .when(nm > 0, F.greatest(F.lit(1), F.floor((nm * F.lit(100).cast("float")).cast("double") + 0.5).cast("int")))
        .otherwise(0)
    )


def penalty_factor(buffer_q: C, shore_q: C) -> Column:
    """Factor on an edge's weight for a target cell shore_q units from shore."""
    buffer_q, shore_q = col(buffer_q), col(shore_q)
    near = 1 + PENALTY * (1 - shore_q.cast("double") / buffer_q)
    return F.when(buffer_q.isNotNull() & (shore_q < buffer_q), near).otherwise(1.0)


def wrap_lon(lon: C) -> Column:
    """Into [-180, 180)."""
    lon = col(lon)
    return lon - F.floor((lon + 180.0) / 360.0) * 360.0


def mid_lon(lon1: C, lon2: C) -> Column:
    """The middle of the shorter way round."""
    lon1, lon2 = col(lon1), col(lon2)
    shifted = F.when(lon1 < lon2, lon1 + 360.0).otherwise(lon1), F.when(lon2 < lon1, lon2 + 360.0).otherwise(lon2)
    return wrap_lon(F.when(F.abs(lon1 - lon2) > 180.0, (shifted[0] + shifted[1]) / 2).otherwise((lon1 + lon2) / 2))


def split_at_seam(lon1: C, lat1: C, lon2: C, lat2: C) -> Column:
    """An array of one or two segments (x1, y1, x2, y2) that stay on one side of the 180th meridian."""
    lon1, lat1, lon2, lat2 = map(col, (lon1, lat1, lon2, lat2))
    edge = F.when(lon1 > 0, 180.0).otherwise(-180.0)
    t = (edge - lon1) / (lon2 + 2 * edge - lon1)
    lat = lat1 + (lat2 - lat1) * t

    def part(*xs):
        return F.struct(*(x.cast("double").alias(n) for x, n in zip(xs, ("x1", "y1", "x2", "y2"), strict=True)))

    return F.when(F.abs(lon1 - lon2) > 180.0, F.array(part(lon1, lat1, edge, lat), part(-edge, lat, lon2, lat2))).otherwise(F.array(part(lon1, lat1, lon2, lat2)))


def seam_shifts(lon_min: C, lon_max: C, reach: C) -> Column:
    """Shifts under which a query box must be asked: 0, and -360 past +180 or else +360 past -180."""
    lon_min, lon_max, reach = map(col, (lon_min, lon_max, reach))
    return F.when(lon_max + reach > 180.0, F.array(F.lit(0.0), F.lit(-360.0))).when(lon_min - reach < -180.0, F.array(F.lit(0.0), F.lit(360.0))).otherwise(F.array(F.lit(0.0)))


def unwrapped(ring: C, x: str = "x", y: str = "y") -> Column:
    """A ring whose longitudes follow each other by less than 180 degrees, from its first point on."""
    ring = col(ring)
    first = F.element_at(ring, 1)[x]
    return F.transform(ring, lambda p: F.struct((p[x] + F.when(p[x] - first > 180.0, -360.0).when(p[x] - first < -180.0, 360.0).otherwise(0.0)).alias(x), p[y].alias(y)))


def shifted(ring: C, dx: C, x: str = "x", y: str = "y") -> Column:
    return F.transform(col(ring), lambda p: F.struct((p[x] + col(dx)).alias(x), p[y].alias(y)))


def seam_copies(ring: Column) -> Column:
    """A ring, and its copy on the other side of the seam if it reaches past 180 degrees."""
    low, high = F.array_min(F.transform(ring, lambda p: p["x"])), F.array_max(F.transform(ring, lambda p: p["x"]))
    return F.when(high > 180.0, F.array(ring, shifted(ring, -360.0))).when(low < -180.0, F.array(ring, shifted(ring, 360.0))).otherwise(F.array(ring))


def cos_lat(lat: C) -> Column:
    return F.greatest(F.cos(F.radians(col(lat))), F.lit(LEAST_COS))


def lon_reach(nm: C, cos: C) -> Column:
    """Degrees of longitude that nm spans."""
    return col(nm) / DEGREE_NM / col(cos)


def point_segment(px: C, py: C, ax: C, ay: C, bx: C, by: C) -> Column:
    """Planar distance from a point to a segment; a segment of no length counts as its point."""
    px, py, ax, ay, bx, by = map(col, (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * dx + (py - ay) * dy) / length))).otherwise(0.0)
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def side(ax: C, ay: C, bx: C, by: C, px: C, py: C) -> Column:
    """Sign of the turn from a over b to p."""
    ax, ay, bx, by, px, py = map(col, (ax, ay, bx, by, px, py))
    return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def within_box(px: C, py: C, ax: C, ay: C, bx: C, by: C) -> Column:
    px, py, ax, ay, bx, by = map(col, (px, py, ax, ay, bx, by))
    return px.between(F.least(ax, bx), F.greatest(ax, bx)) & py.between(F.least(ay, by), F.greatest(ay, by))


def segments_meet(a: tuple[C, C, C, C], b: tuple[C, C, C, C]) -> Column:
    """Closed segments share a point."""
    (ax, ay, bx, by), (cx, cy, dx, dy) = a, b
    s1, s2 = side(ax, ay, bx, by, cx, cy), side(ax, ay, bx, by, dx, dy)
    s3, s4 = side(cx, cy, dx, dy, ax, ay), side(cx, cy, dx, dy, bx, by)
    touch = [(s1, cx, cy, ax, ay, bx, by), (s2, dx, dy, ax, ay, bx, by), (s3, ax, ay, cx, cy, dx, dy), (s4, bx, by, cx, cy, dx, dy)]
    return ((s1 * s2 < 0) & (s3 * s4 < 0)) | reduce(Column.__or__, [(s == 0) & within_box(*rest) for s, *rest in touch])


def segment_segment(a: tuple[C, C, C, C], b: tuple[C, C, C, C]) -> Column:
    """Planar distance between segments, 0 if they meet."""
    ends = [point_segment(*a[:2], *b), point_segment(*a[2:], *b), point_segment(*b[:2], *a), point_segment(*b[2:], *a)]
    return F.when(segments_meet(a, b), 0.0).otherwise(F.least(*ends))


def to_frame(x: C, y: C, ref_x: C, ref_y: C, cos: C) -> tuple[Column, Column]:
    """Nautical miles east and north of a reference."""
    return (col(x) - col(ref_x)) * DEGREE_NM * col(cos), (col(y) - col(ref_y)) * DEGREE_NM


def ring_edges(ring: C) -> Column:
    """A closed ring's edges as structs (x1, y1, x2, y2); a ring that isn't closed is closed."""
    ring = col(ring)
    nexts = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    edges = F.zip_with(ring, nexts, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    return F.filter(edges, lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))


def on_ring(px: C, py: C, edges: Column) -> Column:
    px, py = col(px), col(py)
    return F.exists(edges, lambda e: (side(e["x1"], e["y1"], e["x2"], e["y2"], px, py) == 0) & within_box(px, py, e["x1"], e["y1"], e["x2"], e["y2"]))


def odd_crossings(px: C, py: C, edges: Column) -> Column:
    """Whether a ray from the point crosses an odd number of edges."""
    px, py = col(px), col(py)
    hits = F.filter(edges, lambda e: ((e["y1"] > py) != (e["y2"] > py)) & (px < (e["x2"] - e["x1"]) * (py - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]))
    return F.size(hits) % 2 == 1


def strictly_inside(px: C, py: C, edges: Column) -> Column:
    return odd_crossings(px, py, edges) & ~on_ring(px, py, edges)


def covers_point(px: C, py: C, edges: Column) -> Column:
    return odd_crossings(px, py, edges) | on_ring(px, py, edges)


def edges_meet(one: Column, two: Column) -> Column:
    def tup(e):
        return tuple(e[n] for n in ("x1", "y1", "x2", "y2"))

    return F.exists(one, lambda a: F.exists(two, lambda b: segments_meet(tup(a), tup(b))))


def edges_cross(one: Column, two: Column) -> Column:
    """Some edges cross in their interiors."""

    def proper(a, b):
        s1, s2 = (side(a["x1"], a["y1"], a["x2"], a["y2"], b[f"x{i}"], b[f"y{i}"]) for i in (1, 2))
        s3, s4 = (side(b["x1"], b["y1"], b["x2"], b["y2"], a[f"x{i}"], a[f"y{i}"]) for i in (1, 2))
        return (s1 * s2 < 0) & (s3 * s4 < 0)

    return F.exists(one, lambda a: F.exists(two, lambda b: proper(a, b)))


@cache  # these expressions take many calls to the JVM to build
def areas_meet(one_name: str, two_name: str) -> Column:
    """Two areas, given by columns of all their edges, share a point (touching counts)."""
    one, two = F.col(one_name), F.col(two_name)
    a, b = F.element_at(one, 1), F.element_at(two, 1)
    return edges_meet(one, two) | odd_crossings(a["x1"], a["y1"], two) | odd_crossings(b["x1"], b["y1"], one)


@cache
def area_holds(outer_name: str, inner_name: str) -> Column:
    """The outer area contains the inner one, whose edges may lie on its boundary."""
    outer, inner = F.col(outer_name), F.col(inner_name)
    mid = F.element_at(inner, 1)
    return (
        F.forall(inner, lambda e: covers_point(e["x1"], e["y1"], outer) & covers_point((e["x1"] + e["x2"]) / 2, (e["y1"] + e["y2"]) / 2, outer))
        & ~edges_cross(outer, inner)
        & ~F.exists(outer, lambda e: strictly_inside(e["x1"], e["y1"], inner))
        & mid.isNotNull()
    )


def chunks(points: C, most: int = 256) -> Column:
    """A polyline cut to at most `most` points, neighbours sharing one."""
    points = col(points)
    starts = F.sequence(F.lit(1), F.greatest(F.size(points) - 1, F.lit(1)), F.lit(most - 1))
    return F.when(F.size(points) >= 2, F.transform(starts, lambda i: F.slice(points, i, most))).otherwise(F.array().cast("array<array<struct<x:double,y:double>>>"))


def box_of(points: C) -> Column:
    points = col(points)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def boxes_meet(a: str, b: str) -> Column:
    """Closed boxes of struct columns a and b overlap."""
    return (F.col(f"{a}.x0") <= F.col(f"{b}.x1")) & (F.col(f"{a}.x1") >= F.col(f"{b}.x0")) & (F.col(f"{a}.y0") <= F.col(f"{b}.y1")) & (F.col(f"{a}.y1") >= F.col(f"{b}.y0"))


def round_tenth(x: C) -> Column:
    """Half away from zero on the double itself."""
    x = col(x)
    return F.signum(x) * F.floor(F.abs(x) * 10 + 0.5) / 10


def parse_position(text: C) -> Column:
    """`lat,lon` to a struct (lat, lon); null unless it is two finite numbers in range, which rejects NaN and infinities on purpose."""
    parts = F.split(col(text), ",", -1)
    lat, lon = (F.trim(F.get(parts, F.lit(i))).try_cast("double") for i in (0, 1))
    good = (F.size(parts) == 2) & lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0) & ~F.isnan(lat) & ~F.isnan(lon)
    return F.when(good, F.struct(lat.alias("lat"), lon.alias("lon")))


def valid_buffer(nm: C) -> Column:
    return F.coalesce(col(nm).between(0.0, 5.0) & ~F.isnan(col(nm)), F.lit(False))


def time_text(us: C) -> Column:
    """Microseconds as us, ms or s."""
    us = col(us)
    return F.when(us < 1000, F.format_string("%dus", us.cast("long"))).when(us < 1_000_000, F.format_string("%.1fms", us / 1e3)).otherwise(F.format_string("%.2fs", us / 1e6))


def count_text(n: C) -> Column:
    """A whole number with thousands separators."""
    return F.format_number(col(n).cast("long"), 0)


def utc_text(at: C) -> Column:
    """A time of a UTC session as ISO text, to the second."""
    return F.date_format(col(at), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def whole_log2(n: C) -> Column:
    """The exponent of the largest power of two up to n; null below 1."""
    n = col(n).cast("long")
    return F.when(n >= 1, F.length(F.bin(n)) - 1)
