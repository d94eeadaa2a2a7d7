"""Monthly facts laid out so that reads skip what they don't want: a folder for each month, rows clustered by key within it.

A range of months prunes folders, a range of keys prunes row groups by their statistics, and a table of wanted keys narrows the range to what it
spans before it meets the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_GROUP_BYTES = 32 << 20


def store(df: DataFrame, path: str, month: str, key: str, files_a_month: int = 1, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Each month's rows go to so many files by ranges of the key, so a file and its row groups span few keys."""
    ranged = df.repartitionByRange(F.col(month), F.col(key)) if files_a_month > 1 else df.repartition(F.col(month))
    ranged.sortWithinPartitions(month, key).write.option("parquet.block.size", row_group_bytes).option("compression", "zstd").partitionBy(month).parquet(path)


def read(spark: SparkSession, path: str, columns: Sequence[str], month: str, first: str, last: str, key: str, wanted: DataFrame | None = None) -> DataFrame:
    """columns of the months from first to last, of all keys or of those in wanted (a column of the key's name)."""
    rows = spark.read.parquet(path).where(F.col(month).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    if wanted is None:
        return rows.select(*columns)
    span = wanted.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
    rows = rows.where(F.col(key).between(F.lit(span["low"]), F.lit(span["high"])))
    return rows.join(wanted.select(key).distinct(), key, "left_semi").select(*columns)


def scanned(df: DataFrame) -> dict[str, int]:
    """Of a frame that was run: files, partitions and rows that its scans read, by the plan's own metrics."""
    found: dict[str, int] = {}

    def walk(node) -> None:
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if name.endswith("QueryStage"):
            return walk(node.plan())
        if name.startswith("Scan"):
            metrics = node.metrics()
            for ours, theirs in (("files", "numFiles"), ("partitions", "numPartitions"), ("rows", "numOutputRows")):
                if metrics.contains(theirs):
                    found[ours] = found.get(ours, 0) + metrics.apply(theirs).value()
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))
        return None

    walk(df._jdf.queryExecution().executedPlan())
    return found
