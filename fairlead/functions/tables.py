"""Reading input tables and keeping intermediate ones."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession

ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
ARROW_ROWS = 500
PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Gives this package's source to the executors' Python, once for each Spark context.

    Texts may be long, so Arrow batches are kept to ARROW_ROWS rows unless the session says otherwise.
    """
    context = spark.sparkContext
    if spark.conf.get(ROWS_SETTING) == "10000":
        spark.conf.set(ROWS_SETTING, ARROW_ROWS)
    if getattr(context, "fairlead_shipped", False):
        return
    with zipfile.ZipFile(Path(tempfile.mkdtemp(prefix="fairlead-src-")) / "fairlead.zip", "w") as out:
        for path in PACKAGE.rglob("*.py"):
            out.write(path, path.relative_to(PACKAGE.parent))
    context.addPyFile(out.filename)
    context.fairlead_shipped = True


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only a local session, as in tests, gets one of our own."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not re.match(r"local(\[.*)?$", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if getattr(shared_dir, "own", None) is None:
        shared_dir.own = f"file://{tempfile.mkdtemp(prefix='fairlead-')}"
    return shared_dir.own


class Scratch:
    """Tables written to the shared folder, to cut lineage: a lost executor costs no more than the running step.

    keep() writes and rereads; free() deletes those that the caller no longer reads. Shuffle files of the
    steps before are released at each keep(), by asking the driver's JVM to collect its garbage. A result read lazily still
    needs the tables it was made from: who has written it elsewhere deletes them by sweep(), with a mark() set before.
    """

    made: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark, self.paths = spark, {}
        Scratch.made.append(self)

    @staticmethod
    def mark() -> int:
        return len(Scratch.made)

    @staticmethod
    def sweep(mark: int) -> None:
        """Deletes all tables of those made since the mark."""
        for scratch in Scratch.made[mark:]:
            scratch.free()
        del Scratch.made[mark:]

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/fairlead/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        self.paths[name] = path
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names or tuple(self.paths):
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
