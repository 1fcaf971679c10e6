"""Event streams: windows, sessions and duplicates with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"


def source(spark: SparkSession, folder: str, glob: str, schema) -> DataFrame:
    """New Parquet files of a folder. Parquet timestamps without zone are cast, since watermarks need instants."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)
    naive = [f.name for f in rows.schema if f.dataType.typeName() == "timestamp_ntz"]
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in naive})


def counts(events: DataFrame, at: str, by: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events per window and kind; rows more than ``late`` behind are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, at: str, user: str, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), user).agg(F.count("*").alias("n"))


def unique(events: DataFrame, at: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first of equal keys within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def drain(stream: DataFrame, name: str, mode: str, checkpoint: str, idle: bool = True) -> DataFrame:
    """Runs a stream over what is there now and returns the result as a table beside its checkpoint, with the rows of
    earlier runs from there. A batch that is repeated replaces its own rows; in ``complete`` mode the last batch has them
    all. Without ``idle`` no batch runs that has no input: states with a lifetime would ask for one after another."""
    out, spark = f"{checkpoint}-rows", stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={0 if mode == 'complete' else number}")

    before = spark.conf.get(_IDLE)
    spark.conf.set(_IDLE, str(idle).lower())  # a stream takes the settings that hold when it starts
    try:
        run = stream.writeStream.foreachBatch(write).queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_IDLE, before)
    run.awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{out}/batch=*")
