"""Canals and straits that are refined beyond the leaf level, and named boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.functions import geo
from fairlead.sources import geojson

SCHEMA = "name string, min_lon double, min_lat double, max_lon double, max_lat double, leaf_resolution int, water_types array<string>"

#: Name, corridor (min_lon, min_lat, max_lon, max_lat), leaf resolution, water tags.
PASSAGES = (
    ("Suez Canal", 32.20, 29.85, 32.65, 31.32, 11, []),
    ("Panama Canal", -79.95, 8.88, -79.50, 9.42, 13, ["lock", "reservoir", "lake", "river"]),
    ("Kiel Canal", 9.05, 53.85, 10.20, 54.40, 13, ["lock", "reservoir", "lake", "river", "canal"]),
    ("Corinth Canal", 22.94, 37.88, 23.03, 37.96, 13, []),
    ("Bosphorus", 28.95, 40.95, 29.20, 41.28, 10, []),
    ("Dardanelles", 26.10, 39.95, 26.75, 40.50, 10, []),
    ("Malacca Strait", 103.35, 1.10, 103.90, 1.40, 10, []),
    ("Singapore Strait", 103.70, 1.15, 104.35, 1.30, 10, []),
    ("Messina Strait", 15.55, 38.05, 15.70, 38.35, 10, []),
    ("Dover Strait", 1.15, 50.85, 1.70, 51.20, 10, []),
    ("Houston Ship Channel", -95.30, 29.30, -94.70, 29.80, 12, ["lock", "reservoir", "lake", "river", "canal"]),
    ("Cape Cod Canal", -70.65, 41.72, -70.48, 41.79, 12, ["lock", "reservoir", "lake", "river", "canal"]),
    ("Chesapeake-Delaware Canal", -75.85, 39.40, -75.55, 39.60, 12, ["lock", "reservoir", "lake", "river", "canal"]),
    ("Welland Canal", -79.30, 42.85, -79.15, 43.25, 13, ["lock", "reservoir", "lake", "river", "canal"]),
)
#: Level of the planet's grid for each leaf resolution: the coarsest whose cells, by area, are no larger.
LEVELS = {10: 10, 11: 12, 12: 13, 13: 15}
#: min_lon, min_lat, max_lon, max_lat.
BOXES = {"dev": (-5.0, 48.0, 10.0, 62.0), "dev-small": (-1.0, 50.0, 3.0, 52.0), "marmaris": (27.5, 36.0, 30.0, 37.0)}


def passages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PASSAGES, SCHEMA)


def overlapping(found: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Passages whose corridor meets a box."""
    return found.where((F.col("min_lon") <= box[2]) & (F.col("max_lon") >= box[0]) & (F.col("min_lat") <= box[3]) & (F.col("max_lat") >= box[1]))


def of_planet(spark: SparkSession, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Passages, or those whose corridor meets a box, with levels of the planet's grid as leaf resolution."""
    found = passages(spark) if box is None else overlapping(passages(spark), box)
    levels = F.create_map(*(F.lit(x) for pair in LEVELS.items() for x in pair))
    return found.withColumn("leaf_resolution", levels[F.col("leaf_resolution")])


def canal_water(spark: SparkSession, found: DataFrame, folder: str | None) -> DataFrame | None:
    """(poly_id, rings) of the tagged water whose box meets its passage's corridor; None if no passage has tags.

    Each passage with tags has a FeatureCollection `<name>-water.geojson` in the folder (an extract of natural=water); a
    missing one is an error, so no canal is lost in silence.
    """
    out = None
    for p in found.where(F.size("water_types") > 0).orderBy("name").collect():
        name = f"{p.name.lower().replace(' ', '-')}-water.geojson"
        if folder is None:
            raise ValueError(f"{p.name} needs canal water: a folder with {name}")
        water = geojson.water_of(geojson.read_polygons(spark, f"{folder}/{name}"), p.water_types)
        corridor = F.struct(*(F.lit(v).alias(n) for n, v in (("x0", p.min_lon), ("y0", p.min_lat), ("x1", p.max_lon), ("y1", p.max_lat))))
        near = water.withColumns({"box": geo.box_of(F.element_at("rings", 1)), "corridor": corridor}).where(geo.boxes_meet("box", "corridor"))
        near = near.select(F.struct(F.lit(p.name).alias("passage"), F.xxhash64("rings").alias("shape")).alias("poly_id"), "rings")
        out = near if out is None else out.unionByName(near)
    return out


def parse_box(text: str) -> tuple[float, float, float, float]:
    """A preset's name, or `min_lon,min_lat,max_lon,max_lat`."""
    if text in BOXES:
        return BOXES[text]
    parts = [float(x) for x in text.split(",")]
    if len(parts) != 4:
        raise ValueError(f"a box is one of {sorted(BOXES)} or four numbers: {text}")
    return tuple(parts)
