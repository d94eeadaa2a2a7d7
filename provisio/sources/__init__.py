"""Scans, sinks and normalisers of landed files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share. Where it is unset, one of our own in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    there = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not there.isDefined():
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="provisio-"))
        there = spark.sparkContext._jsc.sc().getCheckpointDir()
    return there.get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, so that what reads it more than once doesn't make it again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scan_pipe(spark: SparkSession, path: str, columns: Sequence[str], optional: Sequence[str] = (), header_map: dict[str, str] | None = None) -> DataFrame:
    """Quote-aware pipe-delimited text with a header; newlines may stand inside quotes; a ragged row is an error.
    Headers are renamed; missing required columns raise, missing optional ones are null. Land it as Parquet once: such a file is one task."""
    df = spark.read.csv(path, sep="|", quote='"', escape='"', multiLine=True, header=True, encoding="UTF-8", mode="FAILFAST")
    for old, new in (header_map or {}).items():
        df = df.withColumnRenamed(old, new)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.withColumns({c: F.lit(None).cast("string") for c in optional if c not in df.columns})


def scan_tolerant(spark: SparkSession, path: str, columns: Sequence[str], header: bool = True) -> DataFrame:
    """The same without failing: rows that don't parse keep their text in _bad."""
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in columns), T.StructField("_bad", T.StringType())])
    read = spark.read.option("columnPruning", False)  # else a row is only checked as far as it is asked for
    return read.csv(path, sep="|", quote='"', header=header, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in order."""
    return df.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def fullest(df: DataFrame, keys: Sequence[str], tie: Sequence[Column]) -> DataFrame:
    """Of rows with one key, that with most filled fields."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in df.columns), F.lit(0))
    return newest(df, keys, [F.desc(filled), *tie])


def merged_cache(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert: new rows win over old ones of the same key; of several in one load, the greatest by the other columns in order."""
    rest = [F.desc_nulls_last(c) for c in old.columns if c not in keys]
    both = old.withColumn("__load", F.lit(0)).unionByName(new.withColumn("__load", F.lit(1)), allowMissingColumns=True)
    return newest(both, keys, [F.desc("__load"), *rest]).drop("__load")


def trade_flows(df: DataFrame) -> DataFrame:
    """Months as yyyy-MM, codes without .0, upper-case countries, numbers with 0 for none; codes must be 2 to 10 digits."""
    number = lambda c: F.coalesce(F.expr(f"try_cast({c} as double)"), F.lit(0.0))
    out = df.select(F.replace(F.col("month"), F.lit("."), F.lit("-")).alias("month"), F.regexp_replace("hs_code", r"\.0$", "").alias("hs_code"), F.upper(F.trim("country_code")).alias("country_code"), number("value").alias("value"), number("weight").alias("weight"))
    return out.where(F.col("hs_code").rlike(r"^\d{2,10}$") & (F.col("value") >= 0))


def prices(df: DataFrame, low: str, high: str) -> DataFrame:
    """Positive prices of named factors within dates."""
    p = F.expr("try_cast(price as double)")
    return df.withColumn("price", p).where((F.col("price") > 0) & (F.trim("factor") != "") & F.col("date").between(F.lit(low).cast("date"), F.lit(high).cast("date")))


def visible_text(c: Column) -> Column:
    """Markup, scripts and styles off; white space collapsed."""
    bare = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def guarded_write(df: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    """Refuses to replace an existing table by an empty one."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    if exists and df.limit(1).isEmpty():
        raise ValueError(f"{path} exists and the new result has no rows")
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition).parquet(path)
