"""Evidence on items: product pages read and checked, candidates by the standing of their source, parent concepts of items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provisio.functions import blank_to_null, first_filled, ladder
from provisio.operators import contracts
from provisio.operators.items import clean_name

UNSEEN = r"(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<noscript\b.*?(?:</noscript\s*>|\z)|<!--.*?(?:-->|\z)"
TAG = r"</?[a-zA-Z!?][^<>]*>"
HEADING = r"(?is)<h1\b[^<>]*>(.*?)(?:</h1\s*>|\z)"
# What the references stand for; the ampersand comes last.
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def token(c: Column) -> Column:
    """Lower-case letters and digits of a text in its compatibility form; null has none."""
    return F.regexp_replace(F.lower(clean_name(c)), r"[^0-9a-z\x{AC00}-\x{D7A3}]+", "")


def _shown(c: Column) -> Column:
    out = F.regexp_replace(c, TAG, " ")
    for ref, sign in REFERENCES:
        out = F.replace(out, F.lit(ref), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def page_records(pages: DataFrame, code: str, html: str, unwanted: str, exact: Sequence[str] = ()) -> DataFrame:
    """pages with source_item_name, visible_text and problem.

    The name is the longest first-level heading, the first of equals, that neither holds the unwanted text nor is one of exact; the text is what is
    shown, in single spaces, without scripts, styles, what stands in their absence, comments and markup. problem is no_heading, no_code (the text doesn't hold the code,
    or there is no code) or blank; a page with a problem is no evidence. Null html is an empty page. An element that isn't closed reaches to the end, so any page takes time in proportion to its length."""
    body = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), UNSEEN, " ")
    heads = F.transform(F.regexp_extract_all(body, F.lit(HEADING), 1), _shown)
    heads = F.filter(heads, lambda h: (h != "") & ~h.contains(unwanted) & ~h.isin(*exact) if exact else (h != "") & ~h.contains(unwanted))
    best = F.array_max(F.transform(heads, lambda h, i: F.struct(F.length(h).alias("n"), (-i).alias("i"), h.alias("h"))))
    out = pages.withColumns({"source_item_name": F.coalesce(best["h"], F.lit("")), "visible_text": _shown(body)})
    has = F.coalesce(F.col("visible_text").contains(blank_to_null(F.col(code))), F.lit(False))
    return out.withColumn("problem", ladder([(F.col("source_item_name") == "", "no_heading"), (~has, "no_code")], ""))


def page_targets(worklist: DataFrame, suggestions: DataFrame, basis: str, pattern: str, address: str) -> DataFrame:
    """Rows of worklist (representative_item_id, strength, ...) whose suggestion (representative_item_id, family_name, family_basis, evidence_note) has the basis and a note
    in which pattern's group finds an id: that id, the page's address (with {} for the id), the family's token without bracketed parts, and the strengths' tokens."""
    s = suggestions.where(F.col("family_basis") == basis).withColumn("item_seq", F.regexp_extract("evidence_note", pattern, 1)).where("item_seq <> ''")
    j = worklist.join(contracts.unique(s, ["representative_item_id"], "suggestion"), "representative_item_id")
    before, after = address.split("{}")
    parts = F.split(F.coalesce("strength", F.lit("")), ";")
    # A strength at a time would need a call of the Unicode step for each: the joined text is normal at once, as ; is no part of a token.
    strengths = F.filter(F.transform(F.split(F.lower(clean_name(F.array_join(parts, ";"))), ";"), lambda x: F.regexp_replace(x, r"[^0-9a-z\x{AC00}-\x{D7A3}]+", "")), lambda x: x != "")
    return j.withColumns({"source_url": F.concat(F.lit(before), F.col("item_seq"), F.lit(after)), "family_token": token(F.regexp_replace("family_name", r"\([^)]*\)", "")), "strength_tokens": F.array_join(strengths, ";")})


def candidates(items: DataFrame, suggestions: DataFrame, dictionary: DataFrame, official: DataFrame, hosts: DataFrame, pattern: str) -> DataFrame:
    """Items that need outside evidence (representative_item_id, attribute_parse_status, ...) with the address in their suggestion's note, its source's tier, states and a confidence.

    Verified (0.98): the dictionary (source_url, verification_status) has the address verified, or the id that pattern's group finds in it is one of official (item_seq).
    Other addresses: 0.65 where hosts (host, tier) names an official tier for the host, else 0.45 as a secondary reference; none: 0. Hosts are compared whole, in any case.
    An item has at most one suggestion; more are an error. Repeated rows of dictionary and official change nothing; a null note has no address."""
    need = items.where(F.col("attribute_parse_status") == "needs_external_match")
    j = contracts.joined(need, suggestions.select("representative_item_id", "evidence_note"), ["representative_item_id"], validate="one_to_one")
    j = j.withColumn("evidence_url", F.rtrim(F.regexp_extract("evidence_note", r"https?://[^\s;]+", 0), F.lit(".,)")))
    url = F.when(F.col("evidence_url") != "", F.col("evidence_url"))
    j = j.withColumns({"__url": url, "__seq": blank_to_null(F.regexp_extract(url, pattern, 1)), "source_domain": F.coalesce(F.lower(F.regexp_extract(url, r"^https?://([^/?#]*)", 1)), F.lit("")), "evidence_url": F.coalesce(url, F.lit(""))})
    sure = dictionary.where(F.col("verification_status").isin("verified_official", "verified_multi_source")).select(F.col("source_url").alias("__url")).distinct().withColumn("__sure", F.lit(True))
    cached = official.select(F.col("item_seq").cast("string").alias("__seq")).distinct().withColumn("__cached", F.lit(True))
    tiers = contracts.unique(hosts.select(F.lower("host").alias("source_domain"), "tier"), ["source_domain"], "host")
    j = j.join(sure, "__url", "left").join(cached, "__seq", "left").join(tiers, "source_domain", "left")
    verified, there = F.col("__sure").isNotNull() | F.col("__cached").isNotNull(), F.col("__url").isNotNull()
    tier = F.coalesce("tier", F.when(F.col("source_domain") != "", "secondary_reference"), F.lit("not_searched"))
    steps = lambda a, b, c, d: ladder([(verified, a), (there & tier.startswith("official_"), b), (there, c)], d)
    waits = ("candidate_unverified",) * 2
    return j.select(
        *need.columns, F.coalesce("evidence_note", F.lit("")).alias("evidence_note"), "evidence_url", "source_domain", tier.alias("source_tier"), steps("verified_official", *waits, "not_searched").alias("verification_status"),
        steps("verified_dictionary_ready", *("web_candidate_needs_review",) * 2, "search_required").alias("candidate_status"), steps(0.98, 0.65, 0.45, 0.0).alias("candidate_confidence"), F.when(verified, "dictionary_ready").otherwise("needs_review").alias("review_status"),
    )


def parent_concepts(items: DataFrame, families: DataFrame, parents: DataFrame, rules: Sequence[tuple[str, str, str]], open_: Sequence[str] = ("UNSPECIFIED_ITEM", "MATERIAL_UNSPECIFIED")) -> DataFrame:
    """items (representative_item_id, name, family, family_name, family_source, subtype, specification, unit, ...) with their parent concept and the key to forecast by.

    A known family decides (not blank, not one of open_): its parent in families (family, parent), else itself; the parent's name is that of parents (parent, parent_name), else the family's, else the parent's id.
    Otherwise the first of rules (parent, name, pattern) that is found in the name's token does, else none: UNRESOLVED_PARENT. Blank parts of the key read UNSPECIFIED_...; null is blank."""
    family = blank_to_null(F.col("family"))
    j = items.withColumn("__family", F.when(~family.isin(*open_), family))
    j = contracts.joined(j, families.select(F.col("family").alias("__family"), F.col("parent").alias("__parent")), ["__family"])
    j = j.withColumn("__parent", F.coalesce("__parent", "__family"))
    j = contracts.joined(j, parents.select(F.col("parent").alias("__parent"), F.col("parent_name").alias("__name")), ["__parent"]).withColumn("concept_match_key", token(F.col("name")))
    known = F.col("__parent").isNotNull()
    found = [(F.col("concept_match_key").rlike(p), i, n) for i, n, p in rules]
    j = j.withColumns({
        "parent_concept_id": F.when(known, F.col("__parent")).otherwise(ladder([(c, i) for c, i, _ in found], "UNRESOLVED_PARENT")),
        "parent_concept_name": F.when(known, first_filled(F.col("__name"), F.col("family_name"), F.col("__parent"))).otherwise(ladder([(c, n) for c, _, n in found], "UNRESOLVED")),
    })
    source = ladder([(known & F.col("family_source").eqNullSafe("name_rule"), "name_rule_family"), (known, "structured_family"), (F.col("parent_concept_id") != "UNRESOLVED_PARENT", "concept_dictionary")], "unresolved")
    part = lambda c, n: F.coalesce(blank_to_null(F.col(c)), F.lit(f"UNSPECIFIED_{n}"))
    key = F.concat_ws("::", "parent_concept_id", part("subtype", "SUBTYPE"), part("specification", "SPEC"), part("unit", "UNIT"))
    return j.withColumns({"parent_concept_source": source, "forecast_grouping_key": key}).drop("__family", "__parent", "__name")


def concept_totals(rows: DataFrame) -> DataFrame:
    """Children, occurrences and usage of each parent concept; amounts that are no numbers count as 0; name and source are those of the smallest id."""
    number = lambda c: F.coalesce(F.expr(f"try_cast({c} AS double)"), F.lit(0.0))
    first = lambda c: F.min_by(c, "representative_item_id").alias(c)
    return rows.groupBy("parent_concept_id").agg(first("parent_concept_name"), first("parent_concept_source"), F.count("*").alias("child_count"), F.sum(number("occurrence_count")).alias("occurrence_count"), F.sum(number("usage_sum")).alias("usage_sum"))
