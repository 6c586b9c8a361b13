"""GeoJSON in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.operators.grid import QuadGrid

#: Colours by level, up to and including.
COLORS = ((3, "#0088ff"), (5, "#00cc00"), (7, "#ffaa00"), (8, "#00ffff"))
LAST_COLOR = "#ff00ff"
GEOMETRY = "struct<type:string,coordinates:string>"


def position(x: Column, y: Column) -> Column:
    return F.format_string("[%.6f,%.6f]", x, y)


def line_text(points: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(points, lambda p: position(p["x"], p["y"])), ","), F.lit("]"))


def color(level: Column) -> Column:
    out = F.when(level <= COLORS[0][0], COLORS[0][1])
    for most, name in COLORS[1:]:
        out = out.when(level <= most, name)
    return out.otherwise(LAST_COLOR)


def feature(properties: Column, kind: str, coordinates: Column) -> Column:
    return F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(f',"geometry":{{"type":"{kind}","coordinates":'), coordinates, F.lit("}}"))


def cell_features(cells: DataFrame, grid: QuadGrid) -> DataFrame:
    """(cell, feature): a closed polygon with layer and colour by level."""
    ring, level = grid.ring("cell"), grid.level("cell")
    closed = F.concat(ring, F.slice(ring, 1, 1))
    properties = F.concat(F.lit('{"layer":"hex-res-'), level.cast("string"), F.lit('","color":"'), color(level), F.lit('"}'))
    return cells.select("cell", feature(properties, "Polygon", F.concat(F.lit("["), line_text(closed), F.lit("]"))).alias("feature"))


def coast_features(lines: DataFrame) -> DataFrame:
    """lines(seg_id, pts) as (seg_id, feature); lines of fewer than two points are left out."""
    return lines.where(F.size("pts") >= 2).select("seg_id", feature(F.lit('{"layer":"coastline","stroke":"#ff0000","stroke-width":1.5}'), "LineString", line_text(F.col("pts"))).alias("feature"))


def route_features(spans: DataFrame, ends: DataFrame) -> DataFrame:
    """(name, feature): a line for each of spans(name, span, n_spans, pts, distance_nm, passage, land_legs), named as part i of n if there
    are several, and two markers for each of ends(name, from_lat, from_lon, to_lat, to_lon)."""
    several = F.col("n_spans") > 1
    label = F.when(several, F.format_string("%s (part %d/%d)", "name", "span", "n_spans")).otherwise(F.col("name"))
    given = {"name": label, "distance_nm": F.format_string("%.1f", "distance_nm"), "category": F.when(F.col("passage"), "passage").otherwise("sailing"), "stroke": F.when(F.col("passage"), "#0000ff").otherwise("#0088ff"), "stroke-width": F.lit(3), "stroke-opacity": F.lit(0.8), "land_legs": F.col("land_legs"), "part": F.when(several, F.col("span")), "parts": F.when(several, F.col("n_spans"))}
    lines = spans.select("name", feature(F.to_json(F.struct(*(v.alias(k) for k, v in given.items()))), "LineString", line_text(F.col("pts"))).alias("feature"))
    for which, color_of, lon, lat in (("start", "#00cc00", "from_lon", "from_lat"), ("end", "#ff0000", "to_lon", "to_lat")):
        marker = F.to_json(F.struct(F.concat("name", F.lit(f" ({which})")).alias("name"), F.lit(color_of).alias("marker-color"), F.lit("small").alias("marker-size"), F.lit("circle").alias("marker-symbol")))
        lines = lines.unionByName(ends.select("name", feature(marker, "Point", position(F.col(lon), F.col(lat))).alias("feature")))
    return lines


def clip_lines(lines: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Lines with any vertex in the box (min_lon, min_lat, max_lon, max_lat)."""
    return lines.where(F.exists("pts", lambda p: p["x"].between(box[0], box[2]) & p["y"].between(box[1], box[3])))


def write_collection(features: DataFrame, path: str) -> None:
    """One text file holding a FeatureCollection: features are numbered in place and written in order by one sorted task."""
    rows = features.select(F.lit(1).alias("o"), "feature").unionByName(features.sparkSession.createDataFrame([(0, '{"type":"FeatureCollection","features":['), (2, "]}")], "o int, feature string"))
    ordered = rows.coalesce(1).sortWithinPartitions("o", "feature").withColumn("n", F.monotonically_increasing_id())
    ordered.select(F.when((F.col("o") == 1) & (F.col("n") > 1), F.concat(F.lit(","), "feature")).otherwise(F.col("feature")).alias("value")).write.mode("overwrite").text(path)


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """(properties, poly_id, rings) of the polygons of FeatureCollections; see polygons()."""
    schema = f"features array<struct<properties:map<string,string>,geometry:{GEOMETRY}>>"
    found = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return polygons(found.select("f.properties", "f.geometry"))


def polygons(features: DataFrame) -> DataFrame:
    """(properties, rings) of features(properties, geometry<type, coordinates as JSON text>).

    Polygons and the members of multi-polygons; positions of fewer than two numbers, holes of fewer than three
    positions and polygons whose exterior has fewer than three are left out.
    """
    many = "array<array<array<array<double>>>>"
    one = F.when(F.col("geometry.type") == "Polygon", F.array(F.from_json("geometry.coordinates", "array<array<array<double>>>"))).when(F.col("geometry.type") == "MultiPolygon", F.from_json("geometry.coordinates", many))
    members = features.select("properties", F.explode(one).alias("raw"))
    good = F.transform("raw", lambda ring: F.transform(F.filter(ring, lambda p: F.size(p) >= 2), lambda p: F.struct(F.element_at(p, 1).alias("x"), F.element_at(p, 2).alias("y"))))
    kept = members.select("properties", good.alias("rings")).where((F.size("rings") > 0) & (F.size(F.get("rings", F.lit(0))) >= 3))
    return kept.select("properties", F.filter("rings", lambda ring, i: (i == 0) | (F.size(ring) >= 3)).alias("rings"))


def water_of(features: DataFrame, tags: list[str]) -> DataFrame:
    """Features tagged natural=water whose water tag is listed; a missing tag is not."""
    return features.where((F.col("properties")["natural"] == "water") & F.coalesce(F.col("properties")["water"].isin(*tags), F.lit(False)))
