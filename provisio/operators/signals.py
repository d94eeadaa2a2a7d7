"""News cascade and item matching, ten trade components and their weights, and the rules that supply-risk records must keep."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provisio.functions import clip, flags, ladder

# Fixed values. Branches of the cascade in order: cue words (those of the given texts), event type, direction, demand code, material code.
NEGATION = ["tible"]
BRANCHES = [
    ("disease", ["aning", "enlich"], "demand_increase", "up", "D1", None), ("resin", ["oument"], "supply_decrease", "up", None, "M1"), ("film", ["eneux"], "supply_decrease", "up", None, "M2"), ("rubber", ["erlich"], "supply_decrease", "up", None, "M3"),
    ("steel", ["erber"], "supply_decrease", "up", None, "M4"), ("paper", ["erheit"], "supply_decrease", "up", None, "M5"), ("relief", ["eauch"], "price", "down", None, "M1"), ("naphtha", ["oiaux"], "price", "up", None, "M6"),
    ("export", ["tionti", "anelle"], "supply_decrease", "up", None, "M7"), ("logistics", ["eresnt"], "logistics", "up", None, None), ("factory", ["thoned"], "supply_decrease", "up", None, None), ("conflict", ["therha", "onment"], "conflict", "up", None, None),
    ("policy", ["tiing", "ndble"], "policy", "flat", None, None),
]
CUES = [*NEGATION, *(w for b in BRANCHES for w in b[1])]
NOT_LETTERS = "[^a-zà-ÿ]+"
SOURCES = [("src1[0-9]", "agency"), ("src[0-2]$", "official"), ("src[3-5]$", "trade_press"), ("src[6-7]$", "journal"), ("src8$", "blog")]
ALIASES = {"demand_increase": "DEMAND_UP", "supply_decrease": "SUPPLY_DOWN", "price": "PRICE"}


def cascaded(df: DataFrame, text: str) -> DataFrame:
    """branch, event_type, direction, severity, confidence, demand_code, material_code and the cue words found; a negation beside other cues leaves no event.

    The words of a text are looked up once; every branch reads the short list of cues.
    """
    cues = lambda ws: F.array(*(F.lit(w) for w in ws))
    out = df.withColumn("cues", F.array_sort(F.array_intersect(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), NOT_LETTERS), cues(CUES))))
    hit = [F.arrays_overlap("cues", cues(b[1])) for b in BRANCHES]
    negated = F.arrays_overlap("cues", cues(NEGATION)) & (F.size("cues") > 1)
    pick = lambda k, default: F.when(negated, F.lit(default)).otherwise(ladder([(h, F.lit(b[k])) for h, b in zip(hit, BRANCHES, strict=True)], default))
    out = out.withColumns({"negated": negated, "branch": pick(0, "none"), "event_type": pick(2, "none"), "direction": pick(3, "flat"), "demand_code": pick(4, None), "material_code": pick(5, None)})
    n = F.size("cues")
    completeness = sum(((c).cast("double") for c in (F.col("event_type") != "none", F.col("direction") != "flat", F.col("demand_code").isNotNull(), F.col("material_code").isNotNull(), n > 1)), F.lit(0.0)) / 5
    severity = F.when(F.col("event_type") == "none", 0.0).otherwise(ladder([(n >= 3, 0.9), (n == 2, 0.7)], 0.4))
    return out.withColumns({"severity": severity, "completeness": completeness, "confidence": 0.7 * (0.6 + 0.1 * F.least(n, F.lit(3))) + 0.3 * completeness})


def matched_items(articles: DataFrame, items: DataFrame) -> DataFrame:
    """articles (article_id, event_type, cues, demand_code, material_code) x items (item, term, material_code, demand_code, weight): (article_id, item, tier, weight).

    A term in the text counts first, then the demand code, then the material code; an event that meets no item goes to all supplies.
    Each tier is an equality join, and of several ways from an article to an item the first tier stays, with its largest weight.
    """
    a = articles.where("event_type <> 'none'")
    tiers = [
        (1, "term", a.select("article_id", F.explode("cues").alias("k")).join(items.select("item", "weight", F.col("term").alias("k")), "k")),
        (2, "demand", a.where("demand_code is not null").select("article_id", F.col("demand_code").alias("k")).join(items.select("item", "weight", F.col("demand_code").alias("k")), "k")),
        (3, "material", a.where("material_code is not null").select("article_id", F.col("material_code").alias("k")).join(items.select("item", "weight", F.col("material_code").alias("k")), "k")),
    ]
    met = None
    for rank, name, rows in tiers:
        one = rows.select("article_id", "item", F.lit(rank).alias("rank"), F.lit(name).alias("tier"), "weight")
        met = one if met is None else met.unionByName(one)
    best = met.groupBy("article_id", "item").agg(F.min(F.struct("rank", (-F.col("weight")).alias("w"), "tier")).alias("x")).select("article_id", "item", "x.tier", (-F.col("x.w")).alias("weight"))
    rest = a.select("article_id").join(best.select("article_id").distinct(), "article_id", "left_anti").select("article_id", F.lit("SUPPLY_WIDE").alias("item"), F.lit("wide").alias("tier"), F.lit(0.5).alias("weight"))
    return best.unionByName(rest)


def identified(df: DataFrame, source: str, event: str) -> DataFrame:
    """source_type by the first pattern of the source's name, the event's other name, and an article id: the given one, or a hash of date, source and title."""
    alias = ladder([(F.col(event) == k, v) for k, v in ALIASES.items()], F.upper(event))
    made = F.concat(F.lit("ART-"), F.substring(F.sha2(F.concat_ws("|", F.col("date").cast("string"), source, "title"), 256), 1, 16))
    given = F.trim(F.coalesce(F.col("given_id").cast("string"), F.lit("")))
    return df.withColumns({"source_type": ladder([(F.col(source).rlike(p), v) for p, v in SOURCES], "other"), "event_alias": alias, "article_key": F.when(given != "", given).otherwise(made)})


# ---- trade

COMPONENTS = ("volume_decline", "net_import_decline", "interruption", "price_increase", "volume_volatility", "price_volatility", "concentration", "supplier_decline", "net_exposure", "export_surge")
THRESHOLDS = {"volume_decline": 0.3, "net_import_decline": 0.3, "interruption": 3.0, "price_increase": 0.25, "volume_volatility": 0.5, "price_volatility": 0.3, "concentration": 0.3, "supplier_decline": 0.3, "export_surge": 0.5}


def ten_components(df: DataFrame) -> DataFrame:
    """df has the totals, windows, shares and changes of a year of each month and code; adds a risk for each component (0 where unknown), whether it could be computed, the mean and how much was known."""
    c, t = F.col, THRESHOLDS
    above = lambda x, k: F.when(x.isNotNull(), clip(F.greatest(x, F.lit(0.0)) / t[k], 0, 1))
    values = {
        "volume_decline": above(-c("import_weight_yoy"), "volume_decline"), "net_import_decline": above(-c("net_volume_yoy"), "net_import_decline"),
        "interruption": F.when((c("import_weight") > 0) | c("prior_positive"), clip(c("zero_streak") / t["interruption"], 0, 1)).otherwise(0.0), "price_increase": above(c("unit_value_yoy"), "price_increase"),
        "volume_volatility": clip(c("volume_cv") / t["volume_volatility"], 0, 1), "price_volatility": clip(c("price_vol") / t["price_volatility"], 0, 1),
        "concentration": F.when(c("coverage") >= 0.5, clip((F.greatest("top1", "hhi") - t["concentration"]) / (1 - t["concentration"]), 0, 1)), "supplier_decline": above(-c("suppliers_yoy"), "supplier_decline"),
        "net_exposure": clip(F.coalesce(F.try_divide(F.greatest(c("import_value") - c("export_value"), F.lit(0.0)), c("import_value")), F.lit(0.0)), 0, 1), "export_surge": above(c("export_weight_yoy"), "export_surge"),
    }
    out = df.withColumns({f"{k}_known": v.isNotNull() for k, v in values.items()} | {k: F.coalesce(v, F.lit(0.0)) for k, v in values.items()})
    known = sum((F.col(f"{k}_known").cast("double") for k in COMPONENTS), F.lit(0.0))
    return out.withColumns({"trade_score": sum((F.col(k) for k in COMPONENTS), F.lit(0.0)) / len(COMPONENTS), "trade_confidence": known / len(COMPONENTS)})


def volume_windows(totals: DataFrame) -> DataFrame:
    """volume_cv and price_vol over six months, for three at least."""
    w = W.partitionBy("hs_code").orderBy("month")
    six = w.rowsBetween(-5, 0)
    step = F.when(F.col("unit_value") > 0, F.ln("unit_value")) - F.when(F.lag("unit_value").over(w) > 0, F.ln(F.lag("unit_value").over(w)))
    rows = totals.withColumn("__d", step)
    cv = F.when(F.count("import_weight").over(six) >= 3, F.try_divide(F.stddev_pop("import_weight").over(six), F.avg("import_weight").over(six)))
    return rows.withColumns({"volume_cv": cv, "price_vol": F.when(F.count("__d").over(six) >= 3, F.stddev_pop("__d").over(six))}).drop("__d")


def distribution_weights(df: DataFrame, prior: dict[str, float]) -> DataFrame:
    """component, availability, mean_correlation (of absolute rank correlations with the others), spread, raw, share and weight: a row per component.

    Ten numbers and a ten by ten matrix reach the driver, whatever the table's size.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    names = list(prior)
    known = df.agg(*(F.avg(F.col(f"{k}_known").cast("double")).alias(f"a_{k}") for k in names), *(F.stddev_pop(k).alias(f"s_{k}") for k in names)).first()
    matrix = np.abs(Correlation.corr(VectorAssembler(inputCols=names, outputCol="v").transform(df.select(*names)), "v", "spearman").first()[0].toArray())
    spread = np.array([known[f"s_{k}"] or 0.0 for k in names])
    rows = []
    for i, k in enumerate(names):
        others = np.delete(matrix[i], i)
        others = others[np.isfinite(others)]
        mean = float(others.mean()) if len(others) else 1.0
        raw = prior[k] * (0.5 + known[f"a_{k}"]) * (0.5 + min(max(1 - mean, 0.05), 1.0)) * (0.5 + min(max(spread[i] / (spread.max() or 1.0), 0.05), 1.0))
        rows.append([k, float(known[f"a_{k}"]), mean, float(spread[i]), float(raw)])
    total = sum(r[4] for r in rows)
    weights = floored([r[4] for r in rows])
    return df.sparkSession.createDataFrame([(*r, r[4] / total, w) for r, w in zip(rows, weights, strict=True)], "component string, availability double, mean_correlation double, spread double, raw double, share double, weight double")


def floored(raw: Sequence[float], least: float = 0.03) -> list[float]:
    """Shares of raw of at least `least` each, the others in proportion to raw.

    The smallest shares take the floor. How many: the fewest for which the next one, scaled to the mass that is left, is no less than the floor.
    """
    v = np.maximum(np.asarray(raw, float), 0.0)
    n = len(v)
    order = np.argsort(v, kind="stable")
    rising = v[order]
    tails = np.cumsum(rising[::-1])[::-1]
    if not n or not tails[0] or n * least > 1:
        return [1 / n] * n
    mass = 1 - least * np.arange(n)
    m = int(np.argmax(mass * rising >= least * tails))
    out = np.full(n, least)
    out[order[m:]] = mass[m] * rising[m:] / tails[m]
    return out.tolist()


# ---- rules for supply-risk records. Conditions are SQL over the record's columns; a null counts as not broken.

LEVELS = ("NORMAL", "WATCH", "WARNING", "CRITICAL")
Z = (1.28, 1.65, 1.96, 2.33)
MULTIPLIER = (1.0, 1.1, 1.25, 1.5)
VERSION = "v3"
RULES = [
    ("SR001", "BLOCK", "level_rank >= 0 and level_rank <> expected_rank"), ("SR002", "BLOCK", "demand_axis and level_rank > 0"), ("SR003", "REVIEW", "unmapped"), ("SR004", "BLOCK", "level_rank = 3 and level_source <> 'approved_critical_override'"),
    ("SR005", "REVIEW", f"coalesce(policy_version, '') <> '{VERSION}'"), ("SR006", "REVIEW", "z >= 0 and abs(z - z_expected) > 1e-6"), ("SR007", "REVIEW", "multiplier >= 0 and abs(multiplier - multiplier_expected) > 1e-6"),
    ("SR008", "BLOCK", "ss >= 0 and mean_daily >= 0 and sd >= 0 and lead >= 0 and abs(ss - ss_expected) > 1e-6"), ("SR009", "BLOCK", "rop >= 0 and mean_daily >= 0 and sd >= 0 and lead >= 0 and abs(rop - rop_expected) > 1e-6"),
    ("SR010", "BLOCK", "z < 0 or multiplier < 0 or mean_daily < 0 or sd < 0 or lead < 0 or ss < 0 or rop < 0"), ("SR011", "REVIEW", "(ss is not null or rop is not null) and (mean_daily is null or sd is null or lead is null)"),
    ("SR012", "REVIEW", "event_level = level and level_rank <> expected_rank"), ("SR016", "BLOCK", "method like '%level_based%' and policy_applied and risk_buffer > 0"), ("SR017", "REVIEW", "rate_unit <> 'per_day' or sd_unit <> 'per_sqrt_day'"),
    ("SR018", "REVIEW", "legacy"), ("SR019", "REVIEW", "demand_axis"), ("SR020", "BLOCK", "level_rank < 0 and level <> ''"), ("SR021", "BLOCK", "level = '' or policy_version is null or z is null or multiplier is null"),
]
CRITICAL_SHARE, CRITICAL_STOCK_SHARE = 0.2, 0.4


def audited(records: DataFrame, key: str, codes: str) -> DataFrame:
    """records with issues (rule names in order; SR013 where one set of codes has several levels) and quality_status, the gravest action."""
    levels = records.where("level_rank >= 0").groupBy(codes).agg((F.min("level") < F.max("level")).alias("__split"))
    j = records.join(levels, codes, "left")
    broken = [(F.coalesce(F.expr(cond), F.lit(False)), rule, action) for rule, action, cond in RULES] + [(F.coalesce("__split", F.lit(False)), "SR013", "REVIEW")]
    any_of = lambda kind: sum((b.cast("int") for b, _, a in broken if a == kind), F.lit(0)) > 0
    out = j.withColumn("issues", flags([(b, r) for b, r, _ in sorted(broken, key=lambda x: x[1])]))
    return out.withColumn("quality_status", ladder([(any_of("BLOCK"), "BLOCK"), (any_of("REVIEW"), "REVIEW")], "PASS")).drop("__split")


def release(audit: DataFrame) -> DataFrame:
    """One row: counts by status, the dataset's rules (SR014, SR015), and whether the batch may go out."""
    critical = F.col("level_rank") == 3
    g = audit.agg(F.count("*").alias("rows"), *(F.count_if(F.col("quality_status") == s).alias(s.lower()) for s in ("PASS", "REVIEW", "BLOCK")), F.avg(F.when(F.col("level_rank") >= 0, critical.cast("double"))).alias("critical_share"),
                  F.try_divide(F.sum(F.when(critical & (F.col("ss") > 0), F.col("ss")).otherwise(0.0)), F.sum(F.when(F.col("ss") > 0, F.col("ss")).otherwise(0.0))).alias("critical_stock_share"))
    issues = F.array_join(flags([(F.col("critical_share") > CRITICAL_SHARE, "SR014"), (F.col("critical_stock_share") > CRITICAL_STOCK_SHARE, "SR015")]), ";")
    return g.withColumn("dataset_issues", issues).withColumn("release", ladder([((F.col("block") > 0) | (F.col("dataset_issues") != ""), "HOLD"), (F.col("review") > 0, "REVIEW")], "RELEASE"))


def defaults(df: DataFrame, wanted: dict[str, Column]) -> DataFrame:
    """df with each wanted column, from its default where it is missing or null."""
    return df.withColumns({n: F.coalesce(F.col(n), v) if n in df.columns else v for n, v in wanted.items()})
