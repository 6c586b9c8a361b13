"""Route requests as a stream: each micro-batch is answered like a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from fairlead.operators import kernel
from fairlead.operators.grid import QuadGrid
from fairlead.plans import routes

REQUESTS = "req_id long, from_lat double, from_lon double, to_lat double, to_lon double, shore_buffer_nm double"


def answer(spark: SparkSession, source: str, out: str, checkpoint: str, chart: kernel.Chart, grid: QuadGrid, rule: kernel.SnapRule, **trigger) -> StreamingQuery:
    """Reads requests from Parquet files that appear in source and writes answers to out, each batch once.

    A batch's folder is named by its number and overwritten if the batch is run again, so a restart repeats nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        routes.response(routes.route(spark, batch, chart, grid, rule)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    asked = spark.readStream.schema(REQUESTS).parquet(source)
    return asked.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
