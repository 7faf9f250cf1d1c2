"""Structured Streaming over event files: windows, sessions, first occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import scratch


def event_stream(spark: SparkSession, folder: str, name: str, ts: str = "ts") -> DataFrame:
    """A stream over the files of a table (one file, or a folder of parts), with ``ts`` as a timestamp."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    read = spark.readStream.schema(schema)
    # a table that is one file is found by name in its folder; one that is a folder is read itself
    single = not spark.read.parquet(f"{folder}/{name}.parquet").select(F.input_file_name().alias("f")).where(F.regexp_extract("f", r"([^/]+)/[^/]+$", 1) == f"{name}.parquet").limit(1).collect()
    stream = read.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if single else read.parquet(f"{folder}/{name}.parquet")
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed_counts(events: DataFrame, keys: list[str], *, ts: str = "ts", size: str = "1 day", late: str = "2 days", value: str = "value") -> DataFrame:
    """Counts and totals by tumbling window; rows later than the watermark are left out."""
    by = events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), *keys)
    return by.agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(18,2)")).alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, keys: list[str], *, ts: str = "ts", gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """Sessions of a key: runs of rows less than ``gap`` apart."""
    by = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys)
    return by.agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), *keys, "n")


def first_seen(events: DataFrame, keys: list[str], *, ts: str = "ts", late: str = "2 days") -> DataFrame:
    """One row a key within the watermark, for exactly-once feeds from sources that repeat rows."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def closed(stream: DataFrame, ts: str = "ts") -> DataFrame:
    """The stream with one more row, far in the future and null but for ``ts``: with it the watermark passes all the others."""
    spark = stream.sparkSession
    end = scratch(spark, "end-of-stream")
    row = [F.lit("2200-01-01").cast(f.dataType).alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema]
    spark.range(1).select(*row).write.parquet(end)
    return stream.union(spark.readStream.schema(stream.schema).parquet(end))


#: The state store that keyed state with timers needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> None:
    """Streams started from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now and reads back what came out.

    Each batch of a complete stream replaces the result; an appending one is written by
    the file sink, which commits each batch once.
    """
    spark = stream.sparkSession
    out, checkpoint = scratch(spark, name), scratch(spark, f"{name}-checkpoint")
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    else:
        query = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
