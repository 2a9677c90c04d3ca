"""Extension: the stateless operators work on streams as they are; windowed counts with watermarks for event tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.coding import CodeFrame
from ..session import shared_dir


def read_stream(spark: SparkSession, directory: str, table: str) -> DataFrame:
    """A table of parquet files as a stream; its schema is read once, and files that arrive later are picked up."""
    schema = spark.read.parquet(f"{directory}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{directory}/{table}.parquet*")


def _timed(events: DataFrame, time_col: str) -> DataFrame:
    """Rows with a time, as the instant that event-time operators need; plain times are taken in the session's zone."""
    return events.filter(F.col(time_col).isNotNull()).withColumn(time_col, F.col(time_col).cast("timestamp"))


def tumbling(events: DataFrame, time_col: str, key_col: str, value_col: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window_start, key, n, total) of tumbling windows; rows later than the watermark are left out by the engine."""
    w = F.window(time_col, width)
    g = _timed(events, time_col).withWatermark(time_col, late).groupBy(w.alias("w"), key_col)
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum(value_col).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), key_col, "n", "total")


def sliding(events: DataFrame, time_col: str, key_col: str, width: str = "2 hours", step: str = "1 hour", late: str = "1 day") -> DataFrame:
    w = F.window(time_col, width, step)
    return _timed(events, time_col).withWatermark(time_col, late).groupBy(w.alias("w"), key_col).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), key_col, "n")


def sessions(events: DataFrame, time_col: str, key_col: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(key, session_start, n): sessions that end after a gap."""
    w = F.session_window(time_col, gap)
    return _timed(events, time_col).withWatermark(time_col, late).groupBy(w.alias("w"), key_col).agg(F.count(F.lit(1)).alias("n")).select(key_col, F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n")


def coded(answers: DataFrame, frame: CodeFrame, text_col: str) -> DataFrame:
    """A stream of answers with their codes: a projection, without state."""
    return answers.withColumn("codes", frame.expression(F.col(text_col)))


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, into a table of the shared folder, and reads it.

    In append mode windows come out when the watermark passes them; complete results need mode "complete", kept in memory of the sink
    only for small results.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/openweave-stream-{uuid.uuid4().hex}"
    if mode == "complete":
        last: list[str] = []

        def keep(batch: DataFrame, number: int) -> None:
            path = f"{base}/out-{number}"
            batch.write.mode("overwrite").parquet(path)
            last[:] = [path]

        q = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(last[0]) if last else spark.createDataFrame([], stream.schema)
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
