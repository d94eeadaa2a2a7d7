"""The query on the report of a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from provisio.operators import runreport as op
from provisio.plans import bindings as b
from provisio.plans import risk, signals
from provisio.registry import query

SIGNALS = ["demand_risk", "base_supply", "supply_risk", "total_risk"]
STEPS = [("scores_rows = 0", "no_scores"), ("quality_block > 0", "hold"), ("scores_silent <> '' OR quality_review > 0", "review")]
_SILENT = ", ".join(f"CASE WHEN NOT coalesce(bool_or({s} <> 0), FALSE) THEN '{s}' END" for s in SIGNALS)


@query("rsk_run_sections", f"""WITH {risk.FUSE}, {signals.AUDIT}, sx AS (SELECT count(*) AS scores_rows, count(DISTINCT stock_item_key) AS scores_items, count(*) FILTER (total_risk >= 0.3) AS scores_alerts, count(*) FILTER (supply_risk > base_supply) AS scores_raised, concat_ws(';', {_SILENT}) AS scores_silent FROM fu),
qx AS (SELECT count(*) AS quality_rows, count(DISTINCT p_partkey) AS quality_items, count(*) FILTER (quality_status = 'PASS') AS quality_pass, count(*) FILTER (quality_status = 'REVIEW') AS quality_review, count(*) FILTER (quality_status = 'BLOCK') AS quality_block FROM au),
vx AS (SELECT count(*) AS claims_rows, count(DISTINCT p_brand || '/' || p_name) AS claims_items, string_agg(DISTINCT 'v' || CAST(p_partkey % 3 AS INTEGER), ';' ORDER BY 'v' || CAST(p_partkey % 3 AS INTEGER)) AS claims_versions FROM part)
SELECT *, CASE WHEN scores_rows = 0 THEN 'no_scores' WHEN quality_block > 0 THEN 'hold' WHEN scores_silent <> '' OR quality_review > 0 THEN 'review' ELSE 'released' END AS run_state FROM sx, qx, vx""")  # fmt: skip
def sections(spark, sf):
    scores, quality = risk.fused(spark, sf), signals.records(spark, sf)
    items = b.table(spark, sf, "part").select(F.concat("p_brand", F.lit("/"), "p_name").alias("item"), F.concat(F.lit("v"), (F.col("p_partkey") % 3).cast("int")).alias("version"))
    status = {s.lower(): F.col("quality_status") == s for s in ("PASS", "REVIEW", "BLOCK")}
    return op.report([
        op.section("scores", scores, "stock_item_key", {"alerts": F.col("total_risk") >= 0.3, "raised": F.col("supply_risk") > F.col("base_supply")}), op.spoken("scores", scores, SIGNALS),
        op.section("quality", quality, "p_partkey", status), op.section("claims", items, "item", {}), op.versions("claims", items, "version"),
    ], STEPS)
