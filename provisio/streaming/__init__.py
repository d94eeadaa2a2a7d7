"""Structured Streaming: file ingest with de-duplication, and windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provisio.sources import new_path


def ingest(spark: SparkSession, path: str, schema, key: str, ts: str = "ts", late: str = "45 minutes", files: int = 1) -> DataFrame:
    """Files of a folder, a few per trigger; repeats of a key within the watermark go; the sink is a Parquet table, exactly once by its checkpoint."""
    out = new_path(spark, "stream")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    q = rows.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.schema(schema).parquet(out)


def windowed_counts(spark: SparkSession, path: str, schema, group: str, width: str = "1 day", ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Counts and sums per window and group in update mode; each batch replaces the groups it touched in the result."""
    out = new_path(spark, "windows")
    agg = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path).withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), group).agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    flat = agg.select(F.col("w.start").alias("start"), group, "n", "v")

    def save(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(out)

    q = flat.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    found = spark.read.parquet(out)
    return found.groupBy("start", group).agg(F.max_by(F.struct("n", "v"), "batch").alias("x")).select("start", group, "x.n", "x.v")
