"""kernel.route on the JVM: Router.java, compiled by the Janino that Spark ships with, as a function of columns."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql.classic.column import Column as JvmColumn
from pyspark.sql.classic.column import _to_java_column, _to_seq
from pyspark.sql.types import StructType

from fairlead.functions import geo
from fairlead.operators import kernel
from fairlead.operators.grid import QuadGrid

RESULT = "distance_nm double, raw_hops int, smooth_hops int, coordinates array<array<double>>, land_legs array<int>"
SOURCE = Path(__file__).with_name("Router.java")


def compiled(spark: SparkSession):
    """The driver's Router class; its bytes are given to the executors once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "fairlead_router", None) is None:
        compiler = context._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(context._jsc.sc().getClass().getClassLoader())
        compiler.cook(SOURCE.read_text())
        with zipfile.ZipFile(Path(tempfile.mkdtemp(prefix="fairlead-jar-")) / "fairlead-router.jar", "w") as out:
            for name, code in compiler.getBytecodes().items():
                out.writestr(f"{name.replace('.', '/')}.class", bytes(code))
        context._jsc.addJar(out.filename)
        context.fairlead_router = compiler.getClassLoader().loadClass("fairlead.Router")
    return context.fairlead_router


def arrays(chart: kernel.Chart, grid: QuadGrid, rule: kernel.SnapRule) -> list[np.ndarray]:
    """What Router.open() expects, in its order."""
    coast = chart.coast
    settings = [geo.EARTH_NM, geo.DEGREE_NM, geo.LEAST_COS, geo.PENALTY, geo.SHORE_UNIT_NM, kernel.BUCKET, coast.FEW, grid.x0, grid.y0, grid.base, grid.nx, grid.ny, grid.wraps, rule.first_rings, rule.skip, rule.enough_nm, rule.last_rings]
    levels = [(level, rule.edge_nm[level], rule.most_rings.get(level, -1)) for level in sorted(rule.edge_nm, reverse=True)]
    typed = ((chart.cell, "i8"), (chart.lat, "f8"), (chart.lon, "f8"), (np.asarray(chart.shore_q).astype("u1").view("i1"), "i1"), (chart.main, "i1"), (chart.offsets, "i4"), (chart.target, "i4"), (chart.weight, "f4"), (coast.seg, "f8"), (coast.keys, "i8"), (coast.rows, "i4"), (settings, "f8"), (levels, "f8"))
    return [np.ascontiguousarray(a, f"<{kind}").ravel() for a, kind in typed]


def arrays_file(path: str, found: list[np.ndarray]) -> None:
    with open(path, "wb") as out:
        for a in found:
            out.write(f"{a.dtype.kind}{a.dtype.itemsize}".encode() + len(a).to_bytes(8, "little"))
            a.tofile(out)


def router(spark: SparkSession, chart: kernel.Chart, grid: QuadGrid, rule: kernel.SnapRule) -> Callable[..., Column]:
    """A function of five columns of doubles, from_lat, from_lon, to_lat, to_lon and the buffer, that gives RESULT; null if there is no way."""
    context = spark.sparkContext
    function = compiled(spark).newInstance()
    with tempfile.TemporaryDirectory(prefix="fairlead-chart-") as folder:
        arrays_file(f"{folder}/arrays", arrays(chart, grid, rule))
        function.hold(context._jsc.broadcast(function.read(f"{folder}/arrays")))
    kind = spark._jsparkSession.parseDataType(StructType.fromDDL(RESULT).json())
    routed = function.function(kind)
    return lambda *columns: JvmColumn(routed.apply(_to_seq(context, columns, _to_java_column)))
