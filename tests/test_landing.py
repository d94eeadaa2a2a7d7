"""Pruned reads by the scan's own metrics, publishing that a killed job can't break, customs replies that fail one by one."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from provisio.sources import customs, facts, publish


def test_reads_prune_folders_files_and_row_groups(spark, tmp_path):
    rows = spark.range(60_000).select(F.expr("add_months(date'2020-01-01', cast(id % 6 as int))").alias("month"), (F.col("id") % 1000).alias("key"), F.rand(1).alias("v"), F.lit("x" * 40).alias("w"))
    path = str(tmp_path / "facts")
    facts.store(rows, path, "month", "key", row_group_bytes=1 << 15)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        every = facts.read(spark, path, ["month", "key", "v"], "month", "2020-01-01", "2020-06-01", "key")
        assert len(every.collect()) == 60_000
        whole = facts.scanned(every)
        wanted = spark.createDataFrame([(5,), (17,), (17,), (5000,)], "key long").where("key < 100")
        few = facts.read(spark, path, ["month", "key", "v"], "month", "2020-02-01", "2020-03-01", "key", wanted)
        found = few.collect()
        got = facts.scanned(few)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = rows.where("month between '2020-02-01' and '2020-03-01' and key in (5, 17)").count()
    assert len(found) == want > 0
    assert whole["rows"] == 60_000 and whole["partitions"] == 6 and got["partitions"] == 2 and got["files"] < whole["files"]
    assert got["rows"] < whole["rows"] / 6  # row groups of other keys weren't read
    assert "w" not in facts.read(spark, path, ["v"], "month", "2020-01-01", "2020-01-01", "key").columns


def test_readers_keep_the_old_version_until_the_switch(spark, tmp_path):
    path = str(tmp_path / "out")
    one, two = (spark.createDataFrame([(k, float(k)) for k in range(n)], "k int, v double") for n in (3, 5))
    with pytest.raises(FileNotFoundError):
        publish.published(spark, path, "rows")
    publish.publish(spark, path, {"rows": publish.Part(one), "report": publish.Part(one, "json"), "flat": publish.Part(one, "csv")})
    aside = publish.staged(spark, path, {"rows": publish.Part(two), "report": publish.Part(two, "json"), "flat": publish.Part(two, "csv")})
    # a job that is killed here has written everything and published nothing
    kinds = (("rows", "parquet"), ("report", "json"), ("flat", "csv"))
    assert [publish.published(spark, path, n, k, "k int, v double").count() for n, k in kinds] == [3, 3, 3]
    publish.switched(spark, path, aside)
    assert [publish.published(spark, path, n, k, "k int, v double").count() for n, k in kinds] == [5, 5, 5]


def test_what_fails_its_checks_is_not_published(spark, tmp_path):
    path = str(tmp_path / "out")
    good = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    publish.publish(spark, path, {"rows": publish.Part(good)})
    for bad, say in (
        (good.limit(0), "has no rows"), (good.unionByName(good), "share"), (spark.createDataFrame([(None, 1.0)], good.schema), "null in"), (spark.createDataFrame([("a", -1.0)], good.schema), "negative"), (spark.createDataFrame([("a", None)], good.schema), "missing"), (good.drop("v"), "missing columns"),
    ):
        with pytest.raises(ValueError, match=say):
            publish.publish(spark, path, {"rows": publish.Part(bad, "parquet", [publish.required(["k", "v"]), publish.keyed(["k"]), publish.measured(["v"])])})
        assert publish.published(spark, path, "rows").count() == 2
    assert len([n for _, n in publish.Files(spark, path).folders(path) if n.startswith("v-")]) == 1
    for _ in range(4):
        publish.publish(spark, path, {"rows": publish.Part(good)}, keep=3)
    names = [n for _, n in publish.Files(spark, path).folders(path)]
    assert len(names) == 3 and publish.current(spark, path) in names


def test_customs_replies(spark, tmp_path):
    item = "<item><year>2024.01</year><hsCd>3001</hsCd><expDlr>-</expDlr><impWgt></impWgt><impDlr>5</impDlr></item>"
    reply = lambda code, items: f"<response><header><resultCode>{code}</resultCode><resultMsg>told</resultMsg></header><body><items>{items}</items></body></response>"
    for name, text in {"ok": reply("00", item * 3), "bare": f"<response><body><items>{item}</items></body></response>", "refused": reply("22", item), "empty": reply("NORMAL_CODE", ""), "html": "<html><p>down", "cut": reply("00", item * 2)[:-40], "twice": reply("00", item) * 2}.items():
        (tmp_path / f"{name}.xml").write_text(text)
    rows, reports = customs.scan(spark, str(tmp_path), "KR", "totals", "*.xml")
    told = {r.file.rsplit("/", 1)[1][:-4]: (r.status, r.reason) for r in reports.collect()}
    assert told == {"ok": ("ok", ""), "bare": ("ok", ""), "refused": ("refused", "resultCode=22: told"), "empty": ("empty", ""), **{n: ("broken", "no whole reply") for n in ("html", "cut", "twice")}}
    got = rows.collect()
    assert len(got) == 4 and {r.file.rsplit("/", 1)[1] for r in got} == {"ok.xml", "bare.xml"}
    assert (got[0].month, got[0].hs_code, got[0].country_code, got[0].country_name, got[0].export_weight, got[0].export_value, got[0].import_weight, got[0].import_value, got[0].endpoint) == ("2024.01", "3001", "KR", "", 0.0, None, 0.0, 5.0, "totals")
