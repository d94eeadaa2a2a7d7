"""From approved items to exposed materials: supply levels by policy rows, ingredients, fallback groups, candidates and their report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provisio.functions import first_filled, ladder, last_wins, split_codes, truthy
from provisio.operators import contracts

#: What the operators give as states, in their order of precedence.
PRIORITIES = ("blocked_supply_policy_review", "blocked_family_conflict", "high", "normal")
CANDIDATE = ("raw_material_meta_code", "material_review_status", "material_confidence", "material_evidence_tier", "material_evidence_reference", "official_claim")
POLICY = ("supply_level", "supply_z", "lead_time_multiplier", "level_source", "canonical_codes", "ignored_codes", "unmapped_codes", "policy_needs_review")


def approved(*columns: str) -> Column:
    """Whether all the states read approved, in any case; null does not."""
    out = F.lit(True)
    for c in columns:
        out = out & (F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))) == "approved")
    return out


def listed(c: Column) -> Column:
    """Aggregate: all distinct values but null, sorted and joined by ;."""
    return F.array_join(F.array_sort(F.collect_set(c)), ";")


def supply_policy(df: DataFrame, codes: str, rules: DataFrame, levels: Sequence[tuple[str, float, float]], proofs: Sequence[str] = (), review: str | None = None, stored: str | None = None) -> DataFrame:
    """df with the highest supply level of each row's ;-joined codes, and how it came about.

    rules (code, canonical, axis, level): supply codes raise the level, those of any other axis are noted as ignored, those without a rule are
    unmapped and call for review, as having no code does. An axis of event has no canonical code. levels are (level, z, multiplier), lowest first;
    the first is the default. If all proofs are true and review is approved, the last one stands. stored is a level that is compared: one that
    differs sets level_mismatch (LOW reads as the first level; MEDIUM and HIGH read as the last but one).
    Rules meet the distinct code texts only, so a text that many rows share is no hot key of the rule join."""
    contracts.unique(contracts.filled(rules, ["code", "axis"]), ["code"], "rule code")
    names = [n for n, _, _ in levels]
    texts = df.select(F.col(codes).alias("__text")).where(F.size(split_codes(F.col(codes))) > 0).distinct()
    long = texts.withColumn("__raw", F.explode(split_codes(F.col("__text")))).join(rules.select(F.col("code").alias("__raw"), "canonical", "axis", "level"), "__raw", "left")
    supply, known = F.col("axis") == "supply", F.col("axis").isNotNull()
    rank = ladder([(F.col("level") == n, i) for i, n in enumerate(names)])
    told = long.groupBy("__text").agg(
        F.coalesce(F.max(F.when(supply, rank)), F.lit(0)).alias("__rank"), listed(F.when(known & (F.col("axis") != "event"), first_filled(F.col("canonical"), F.col("__raw")))).alias("canonical_codes"),
        listed(F.when(known & ~supply, F.col("__raw"))).alias("ignored_codes"), listed(F.when(~known, F.col("__raw"))).alias("unmapped_codes"), F.bool_or(supply).alias("__supply"), F.bool_or(known).alias("__known"),
    )
    j = df.join(told.withColumnRenamed("__text", "__told"), F.col(codes) == F.col("__told"), "left")
    critical = F.lit(bool(proofs))
    for p in proofs:
        critical = critical & truthy(F.col(p))
    critical = critical & approved(review) if review else critical
    rank = F.when(critical, len(levels) - 1).otherwise(F.coalesce("__rank", F.lit(0)))
    at = lambda i: F.element_at(F.array(*(F.lit(lv[i]) for lv in levels)), rank + 1)
    none = F.col("__told").isNull()
    source = ladder([(critical, "approved_critical_override"), (none, "default_missing_code"), (~F.col("__known"), "default_unmapped_code"), ((F.col("ignored_codes") != "") & ~F.coalesce("__supply", F.lit(False)), "non_supply_axis_only")], "meta_code")
    blank = {c: F.coalesce(c, F.lit("")) for c in ("canonical_codes", "ignored_codes", "unmapped_codes")}
    out = j.withColumns({"supply_level": at(0), "supply_z": at(1), "lead_time_multiplier": at(2), "level_source": source, "policy_needs_review": none | (F.coalesce("unmapped_codes", F.lit("")) != ""), **blank})
    if stored:
        s = F.upper(F.trim(F.coalesce(F.col(stored), F.lit(""))))
        s = ladder([(s == "LOW", names[0]), (s.isin("MEDIUM", "HIGH"), names[-2])], s)
        out = out.withColumn("level_mismatch", (s != "") & (s != F.col("supply_level")))
    return out.drop("__told", "__rank", "__supply", "__known")


def attached_ingredients(items: DataFrame, enrichment: DataFrame, key: str = "representative_item_id") -> DataFrame:
    """items, whose ingredient columns an approved row of enrichment (key, ingredient_code, ingredient_name, review_status) overwrites.

    Rows without a code, or without approval, leave an item as it is; columns that items lack start empty. A key that repeats on either side
    is an error. The number of rows stays."""
    e = enrichment.where(approved("review_status")).select(key, F.trim("ingredient_code").alias("__code"), F.col("ingredient_name").alias("__name"))
    targets = {"ingredient_ids": F.col("__code"), "ingredient_names": F.col("__name"), "ingredient_source": F.lit("approved_ingredient_dataset"), "material_match_readiness": F.lit("verified_ingredient_ready")}
    base = items.withColumns({c: F.lit("") for c in targets if c not in items.columns})
    has = F.coalesce(F.col("__code"), F.lit("")) != ""
    return contracts.joined(base, e, [key], validate="one_to_one").withColumns({c: F.when(has, v).otherwise(F.col(c)) for c, v in targets.items()}).drop("__code", "__name")


def fallback_groups(master: DataFrame, groups: DataFrame, least: int) -> DataFrame:
    """master (drug_code, ingredient_code, several, usage_division, drug_kind) with a group to pool with: tier 1 is its ingredient, if it has only that
    and at least so many drugs share it; 2 its usage and kind; 3 its item group in groups (drug_code, item_group); 0 none.

    Sizes are counted and joined back, not counted in a window, so no task holds the drugs of one ingredient."""
    code = F.when(F.trim("ingredient_code") != "", F.col("ingredient_code"))
    alone = ~F.coalesce("several", F.lit(True))
    sizes = master.where(alone & code.isNotNull()).groupBy("ingredient_code").agg(F.count("*").alias("ingredient_drugs")).where(F.col("ingredient_drugs") >= least)
    j = contracts.joined(master.join(sizes, "ingredient_code", "left"), groups.select("drug_code", "item_group"), ["drug_code"])
    usage, kind, group = (F.coalesce(c, F.lit("")) for c in ("usage_division", "drug_kind", "item_group"))
    steps = [(alone & F.col("ingredient_drugs").isNotNull(), 1, F.concat(F.lit("ING:"), code)), ((usage != "") | (kind != ""), 2, F.concat(F.lit("USE:"), usage, F.lit("/"), kind)), (group != "", 3, F.concat(F.lit("GRP:"), group))]
    return j.select(*master.columns, ladder([(c, t) for c, t, _ in steps], 0).alias("tier"), ladder([(c, g) for c, _, g in steps], "UNASSIGNED").alias("group_id"))


def medical(df: DataFrame, classes: DataFrame, medical_words: str, promotional: str, code: str = "material_code", name: str = "name", evidence: str = "has_ingredient") -> DataFrame:
    """df with is_medical and the step that decided. classes (code, kind) says what a material code tells: hard ones aren't medical,
    guard ones only with a medical word in the name, open ones (no code is open too) not with a promotional word and no medical one.
    Ingredient evidence wins over all; whatever no step reaches is medical. Words are patterns, matched in any case; a null name has none."""
    j = contracts.joined(df.withColumn("__code", F.col(code)), classes.select(F.col("code").alias("__code"), F.col("kind").alias("__kind")), ["__code"])
    text = F.coalesce(F.col(name), F.lit(""))
    word, promo = text.rlike(f"(?iu){medical_words}"), text.rlike(f"(?iu){promotional}")
    kind = F.when(F.col("__code").isNull(), "open").otherwise(F.coalesce("__kind", F.lit("")))
    steps = [(F.coalesce(F.col(evidence), F.lit(False)), True, "ingredient"), (kind == "hard", False, "hard_code"), ((kind == "guard") & ~word, False, "guard_without_word"), ((kind == "open") & promo & ~word, False, "promotional_word")]
    return j.select(*df.columns, ladder([(c, v) for c, v, _ in steps], True).alias("is_medical"), ladder([(c, s) for c, _, s in steps], "default").alias("medical_step"))


def single_representatives(alias: DataFrame) -> DataFrame:
    """alias (local_item_key, representative_item_id): the keys of exactly one representative; nulls don't count."""
    g = alias.where("local_item_key IS NOT NULL AND representative_item_id IS NOT NULL").groupBy("local_item_key").agg(F.min("representative_item_id").alias("representative_item_id"), F.max("representative_item_id").alias("__last"))
    return g.where(F.col("representative_item_id") == F.col("__last")).drop("__last")


def candidates(classified: DataFrame, alias: DataFrame, items: DataFrame, claims: DataFrame, factors: DataFrame) -> DataFrame:
    """A row per approved local item and raw material of its representative, with eligibility and review priority.

    classified (local_item_key, item_family_id, review_status, ...); alias as in single_representatives; items (representative_item_id, selected_family_id,
    raw_material_meta_codes, material_review_status, material_confidence, material_evidence_tier, raw_material_evidence and what supply_policy adds);
    claims (representative_item_id, raw_material_meta_code, evidence_source, evidence_field, evidence_url, identity_review_status, material_review_status);
    factors (raw_material_meta_code, market_factor_id). An approved claim makes the material approved and verified. Eligible is an approved material with
    a market factor whose representative's family, if it has one, is the item's. Keys that repeat on a one-side are errors; blank factors don't count.

    Claims, factors and policy meet representatives and codes; local items, of which a representative may have any number, are joined last,
    and those without a material are never shuffled further. The order of rows is left to the writer."""
    contracts.required(classified, ["local_item_key", "item_family_id", "review_status"])
    contracts.required(items, ["representative_item_id", "selected_family_id", "raw_material_meta_codes", *POLICY])
    pair = ["representative_item_id", "raw_material_meta_code"]
    local = contracts.unique(classified.where(approved("review_status")), ["local_item_key"], "local_item_key")
    contracts.unique(items, ["representative_item_id"], "representative_item_id")
    sure = contracts.unique(claims.where(approved("identity_review_status", "material_review_status")), pair, "claim")
    parts = [F.when(F.trim(c) != "", F.trim(c)) for c in ("evidence_source", "evidence_field", "evidence_url")]
    sure = sure.select(*pair, F.concat_ws(" | ", *parts).alias("__reference"))
    known = factors.where(F.trim("market_factor_id") != "").select("raw_material_meta_code", F.trim("market_factor_id").alias("f")).distinct()
    known = known.groupBy("raw_material_meta_code").agg(listed(F.col("f")).alias("market_factor_ids"), F.count("*").alias("market_factor_count"))
    long = items.withColumn("raw_material_meta_code", F.explode(split_codes(F.col("raw_material_meta_codes")))).join(sure, pair, "left").join(known, "raw_material_meta_code", "left")
    claimed = F.col("__reference").isNotNull()
    long = long.withColumns({
        "official_claim": claimed, "material_review_status": F.when(claimed, "approved").otherwise(F.col("material_review_status")), "material_confidence": F.when(claimed, "verified").otherwise(F.col("material_confidence")),
        "material_evidence_tier": F.when(claimed, "official_product_material").otherwise(F.col("material_evidence_tier")), "material_evidence_reference": F.coalesce("__reference", "raw_material_evidence", F.lit("")),
        "market_factor_ids": F.coalesce("market_factor_ids", F.lit("")), "market_factor_count": F.coalesce("market_factor_count", F.lit(0)),
    })
    j = local.join(single_representatives(alias), "local_item_key").join(long.select("representative_item_id", "selected_family_id", *CANDIDATE, "market_factor_ids", "market_factor_count", *POLICY), "representative_item_id")
    selected = F.trim(F.coalesce("selected_family_id", F.lit("")))
    conflict = (selected != "") & ~F.col("selected_family_id").eqNullSafe(F.col("item_family_id"))
    has = F.col("market_factor_count") > 0
    j = j.withColumns({"family_conflict": conflict, "operational_risk_eligible": approved("material_review_status") & ~conflict & has})
    return j.withColumn("review_priority", last_wins([(F.lit(True), "normal"), (has, "high"), (F.col("family_conflict"), "blocked_family_conflict"), (F.coalesce("policy_needs_review", F.lit(True)), "blocked_supply_policy_review")])).drop("review_status")


def candidate_report(classified: DataFrame, found: DataFrame) -> DataFrame:
    """One row of counts on candidates, and why none is eligible, if so. Items are counted by two grouped passes, without a distinct count of its own each."""
    count = lambda c: F.count_if(c)
    item = found.groupBy("local_item_key").agg(
        F.count("*").alias("n"), count(F.col("official_claim")).alias("claims"), count(F.col("market_factor_count") > 0).alias("covered"), count(approved("material_review_status")).alias("materials"),
        count(F.col("family_conflict")).alias("conflicts"), count(F.col("policy_needs_review")).alias("reviews"), count(F.col("unmapped_codes") != "").alias("unmapped"), count(F.col("operational_risk_eligible")).alias("eligible"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    got = item.agg(
        total("n").alias("candidate_count"), F.count("*").alias("candidate_items"), total("claims").alias("official_claims"), total("covered").alias("factor_covered"), total("materials").alias("approved_materials"), total("conflicts").alias("family_conflicts"),
        total("reviews").alias("policy_reviews"), count(F.col("reviews") > 0).alias("policy_review_items"), total("unmapped").alias("unmapped"), count(F.col("unmapped") > 0).alias("unmapped_items"), total("eligible").alias("eligible"),
    )
    all_ = classified.where(approved("review_status")).agg(F.count("*").alias("approved_classifications"))
    both = all_.unionByName(got, allowMissingColumns=True)
    both = both.agg(*(F.sum(n).alias(n) for n in both.columns))
    c = F.col
    blocked = ladder([(c("approved_classifications") == 0, "no_approved_classification"), (c("candidate_count") == 0, "no_material_candidates_for_approved_classifications"), (c("eligible") == 0, "material_candidates_require_review")])
    return both.withColumn("blocked_reason", F.coalesce(blocked, F.lit("")))
