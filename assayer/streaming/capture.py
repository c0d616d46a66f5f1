"""Captured traffic as a stream: the same rules, with a watermark and one signal for each id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import fixed
from assayer.functions.text import host_only

WINDOW = "30 seconds"


def unexpected_hosts(capture: DataFrame) -> DataFrame:
    """Hosts outside the allow-list, row by row, for a batch or a stream."""
    host = F.when(F.col("kind") == "connect", F.col("host")).otherwise(host_only("host"))
    return capture.where(F.col("kind").isin("http", "connect")).withColumn("host", host).where((F.col("host") != "") & ~F.col("host").isin(*fixed.ALLOWED_HOSTS))


def once(stream: DataFrame, keys: list[str], delay: str = WINDOW, ts: str = "ts") -> DataFrame:
    """First row of each key; state older than the delay is dropped."""
    marked = stream.withWatermark(ts, delay)
    return marked.dropDuplicatesWithinWatermark(keys) if stream.isStreaming else stream.dropDuplicates(keys)


def windowed(stream: DataFrame, keys: list[str], size: str = WINDOW, delay: str = WINDOW, ts: str = "ts") -> DataFrame:
    """Rows of each key in tumbling windows of event time."""
    rows = stream.withWatermark(ts, delay) if stream.isStreaming else stream
    return rows.groupBy(F.window(ts, size).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def planted_values(capture: DataFrame, canaries: DataFrame) -> DataFrame:
    """(run_id, package, seq, host, name) of requests that carry a planted value: a stream (or batch) of traffic joined with the table of values."""
    from assayer.operators.detonation import leaks

    return leaks(capture, canaries).select("run_id", "package", "seq", "host", "name")


def run_state(capture: DataFrame) -> DataFrame:
    """State of each run so far: records by kind, hosts outside the allow-list, last record; one row a run, updated as records come."""
    host = F.when(F.col("kind") == "connect", F.col("host")).otherwise(host_only("host"))
    unknown = F.col("kind").isin("http", "connect") & (host != "") & ~host.isin(*fixed.ALLOWED_HOSTS)
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in ("http", "connect", "blocked")]
    return capture.groupBy("run_id").agg(*kinds, F.array_sort(F.collect_set(F.when(unknown, host))).alias("unknown_hosts"), F.max("seq").alias("last_seq"))


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return its result as a table."""
    spark = stream.sparkSession
    out = f"{checkpoint}/{name}/out"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{checkpoint}/{name}/state").outputMode(mode).trigger(availableNow=True).start()
    else:
        q = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", f"{checkpoint}/{name}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
