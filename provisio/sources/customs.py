"""Customs replies as XML files: a header that says whether the reply counts, and items.

The same files are read twice, by the reply and by its items, tied by the file's path. A file that isn't a whole reply, or whose code isn't good, gives no
rows, whatever items it has; it is reported with the reason instead of failing the job. Spark doesn't list files of no bytes, so they have no report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provisio.sources import stored

# Good result codes, and the tags of an item with their column and default.
GOOD = ("00", "0", "NORMAL_CODE")
TAGS = {
    "year": ("month", ""), "hsCd": ("hs_code", None), "hsCode": ("hs_code_other", None), "statCd": ("country_code", None), "statCdCntnKor1": ("country_name", ""), "expWgt": ("export_weight", "0"), "expDlr": ("export_value", "0"), "impWgt": ("import_weight", "0"), "impDlr": ("import_value", "0"), "balPayments": ("balance", "0"),
}
NUMBERS = ("export_weight", "export_value", "import_weight", "import_value", "balance")


def scan(spark: SparkSession, path: str, country: str = "ALL", endpoint: str = "", pattern: str = "*") -> tuple[DataFrame, DataFrame]:
    """(flows, reports). flows: month, hs_code, country_code, country_name, five numbers (null where a text isn't one), endpoint and file. reports: file, status (ok, empty, refused or broken), reason and items, a row per file."""
    xml = lambda tag, schema: spark.read.format("xml").options(rowTag=tag, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", recursiveFileLookup="true", pathGlobFilter=pattern).schema(schema).load(path)
    file = F.col("_metadata.file_path").alias("file")
    replies = xml("response", "header struct<resultCode:string,resultMsg:string>, _bad string").select(file, F.trim("header.resultCode").alias("code"), F.trim("header.resultMsg").alias("message"), F.col("_bad").isNotNull().alias("bad"))
    replies = stored(replies, "customs-replies").groupBy("file").agg(F.count("*").alias("replies"), F.max("bad").alias("bad"), F.min("code").alias("code"), F.min("message").alias("message"))
    text = ", ".join(f"{t} string" for t in TAGS)
    items = stored(xml("item", f"{text}, _bad string").select(file, F.col("_bad").isNotNull().alias("bad"), *(F.trim(t).alias(n) for t, (n, _) in TAGS.items())), "customs-items")
    counts = items.groupBy("file").agg(F.count_if(~F.col("bad")).alias("items"), F.max("bad").alias("bad_items"))
    every = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter=pattern).load(path).select(F.col("path").alias("file"), "length")
    tie = lambda c: F.regexp_replace(c, "^file:/+", "/")  # noqa: E731  (paths come with one slash or three)
    replies, counts, every = (df.withColumn("file", tie(F.col("file"))) for df in (replies, counts, every))
    j = every.join(replies, "file", "left").join(counts, "file", "left").withColumn("items", F.coalesce("items", F.lit(0)))
    broken = (F.coalesce("replies", F.lit(0)) != 1) | F.coalesce("bad", F.lit(False)) | F.coalesce("bad_items", F.lit(False))
    code = F.coalesce("code", F.lit("00"))
    status = F.when(broken, "broken").when(~code.isin(*GOOD), "refused").when(F.col("items") == 0, "empty").otherwise("ok")
    reason = F.when(broken, "no whole reply").when(~code.isin(*GOOD), F.concat(F.lit("resultCode="), code, F.lit(": "), F.coalesce("message", F.lit("")))).otherwise("")
    reports = j.select("file", status.alias("status"), reason.alias("reason"), "items")
    filled = lambda n, default: F.when(F.coalesce(F.col(n), F.lit("")) != "", F.col(n)).otherwise(F.lit(default)).alias(n)
    rows = items.withColumn("file", tie(F.col("file"))).join(reports.where("status = 'ok'").select("file"), "file", "left_semi")
    hs = F.coalesce(F.when(F.col("hs_code") != "", F.col("hs_code")), F.col("hs_code_other"), F.lit("")).alias("hs_code")
    numbers = [F.expr(f"try_cast(coalesce(nullif({n}, ''), '0') as double)").alias(n) for n in NUMBERS]
    return rows.select(filled("month", ""), hs, filled("country_code", country), filled("country_name", ""), *numbers, F.lit(endpoint).alias("endpoint"), "file"), reports
