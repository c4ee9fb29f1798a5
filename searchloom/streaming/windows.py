"""Continuous daily metrics over arriving search rows, and the run-to-end helper for streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchloom.functions.dates import utc_wall
from searchloom.functions.numbers import clean, ratio
from searchloom.session import scratch_path


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The store that keyed state needs, for streams started inside; the session's own setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def daily_metrics(rows: DataFrame, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Clicks, impressions, ratio and weighted position per page and day.

    Rows later than the watermark are dropped by Spark. In append mode a day is emitted once it is complete; ``run_windows_to_end``
    also gives the days still open when the input ends.
    """
    ranked = F.col("position").isNotNull() & (F.col("impressions") > 0)
    weight = F.when(ranked, F.col("impressions"))
    sums = (
        rows.withWatermark("ts", delay)
        .groupBy(F.window("ts", width).alias("w"), "page")
        .agg(
            F.sum("clicks").alias("clicks"),
            F.sum("impressions").alias("impressions"),
            F.count("*").alias("rows"),
            F.sum(F.col("position") * weight).alias("_pos"),
            F.sum(weight).alias("_weight"),
        )
    )
    return sums.select(
        utc_wall(F.col("w.start")).cast("date").cast("string").alias("day"),
        "page",
        "clicks",
        "impressions",
        "rows",
        clean(ratio(F.col("clicks"), F.col("impressions"))).alias("ctr"),
        clean(ratio(F.col("_pos"), F.col("_weight"))).alias("position"),
    )


def read_table_stream(spark: SparkSession, folder: str, name: str, max_files: int = 64) -> DataFrame:
    """A parquet table as a stream; ``max_files`` bounds what one trigger takes."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", f"{name}*.parquet")
        .option("maxFilesPerTrigger", max_files)
        .parquet(folder)
    )


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Process all available input into a parquet table in the shared folder and read it."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    writer = (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/data")
        .option("checkpointLocation", f"{path}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
    )
    with keyed_state(spark):
        writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def run_timed_to_end(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], name: str, time: str = "ts") -> DataFrame:
    """Process all available input of a transformation that waits for its watermark, then let the clock pass everything that still waits.

    ``transform`` gets ``stream`` with a column ``end_mark``. After all input a row with the mark and a far time arrives in a folder of its own, and the
    same query goes on from its checkpoint; only its marked row is younger than what was read before.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    marked = stream.withColumn("end_mark", F.lit(False))
    kind = stream.schema[time].dataType
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema.fields if f.name != time]
    mark = spark.range(1).select(*blank, F.lit("9999-12-01 00:00:00").cast(kind).alias(time), F.lit(True).alias("end_mark"))
    mark = mark.select(*marked.columns)
    mark.limit(0).write.parquet(f"{path}/marks")
    marks = spark.readStream.schema(mark.schema).parquet(f"{path}/marks")
    out = transform(marked.unionByName(marks))

    def run() -> None:
        writer = out.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/checkpoint")
        with keyed_state(spark):
            writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()

    run()
    mark.write.mode("append").parquet(f"{path}/marks")
    run()
    return spark.read.schema(out.schema).parquet(f"{path}/data")


def run_windows_to_end(stream: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Process all available input of a windowed aggregation, the windows still open at its end included.

    Every trigger writes the windows it changed under its number in the shared folder; a repeated trigger overwrites its own. The last
    state of each window, known by ``keys``, is the result.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, name)

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/data/batch={batch}")

    query = (
        stream.writeStream.foreachBatch(keep)
        .option("checkpointLocation", f"{path}/checkpoint")
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/data")
    values = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in values]).select(*stream.columns)
