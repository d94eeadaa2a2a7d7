"""Queries on product pages, evidence candidates and parent concepts. Both engines make the inputs by the same expressions."""

from __future__ import annotations

from provisio.operators import evidence as op
from provisio.plans import bindings as b
from provisio.registry import query

PAGES = """pg AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'P' || page_id ELSE regexp_extract(html, '<title>([^ <]+)', 1) END AS item_seq, CASE page_id % 7 WHEN 1 THEN replace(html, '<h1', '<h2') WHEN 2 THEN '<h1>Product <b>details</b> of everything that is shown on this page and on others and of much more, which is no name of a product</h1>' || html
  WHEN 3 THEN '<H1 class=x>About</H1>' || replace(html, '<h1', '<h3') WHEN 4 THEN NULL ELSE html END AS html FROM {pages})"""
_UNSEEN = r"(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<noscript\b.*?(?:</noscript\s*>|\z)|<!--.*?(?:-->|\z)"


def _shown(c: str) -> str:
    c = f"regexp_replace({c}, '</?[a-zA-Z!?][^<>]*>', ' ', 'g')"
    for ref, sign in op.REFERENCES:
        c = f"replace({c}, '{ref}', '{sign.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


@query("src_evidence_records", "WITH " + PAGES.format(pages="pages") + f""", bo AS (SELECT *, regexp_replace(coalesce(html, ''), '{_UNSEEN}', ' ', 'g') AS body FROM pg), he AS (SELECT page_id, item_seq, html, {_shown('body')} AS visible_text, list_filter(list_transform(regexp_extract_all(body, '(?is)<h1\\b[^<>]*>(.*?)(?:</h1\\s*>|\\z)', 1), lambda x: {_shown('x')}), lambda h: h <> '' AND NOT contains(h, 'details of everything') AND h <> 'About') AS hs FROM bo),
na AS (SELECT *, coalesce(list_reduce(list_prepend('', hs), lambda a, x: CASE WHEN length(x) > length(a) THEN x ELSE a END), '') AS source_item_name FROM he) SELECT page_id, item_seq, sha256(visible_text) AS text_sha256, source_item_name, CASE WHEN source_item_name = '' THEN 'no_heading' WHEN item_seq = '' OR NOT contains(visible_text, trim(item_seq)) THEN 'no_code' ELSE '' END AS problem FROM na""")  # fmt: skip
def records(spark, sf):
    pages = spark.sql(f"WITH {PAGES} SELECT * FROM pg", pages=b.table(spark, sf, "pages"))
    return op.page_records(pages, "item_seq", "html", "details of everything", ["About"]).selectExpr("page_id", "item_seq", "sha2(visible_text, 256) AS text_sha256", "source_item_name", "problem")


WORK = """wi AS (SELECT CAST(p_partkey AS BIGINT) AS representative_item_id, p_name AS name, CASE WHEN p_partkey % 6 < 4 THEN 'needs_external_match' WHEN p_partkey % 6 = 4 THEN 'parsed' END AS attribute_parse_status, CASE WHEN p_partkey % 3 = 0 THEN p_size || ' MG; ;10-mL' WHEN p_partkey % 3 = 1 THEN '' END AS strength FROM {part}),
sg AS (SELECT CAST(p_partkey AS BIGINT) AS representative_item_id, p_type || ' (' || p_brand || ')' AS family_name, CASE WHEN p_partkey % 2 = 0 THEN 'web_search' ELSE 'name_literal' END AS family_basis, CASE CAST(p_partkey % 9 AS INTEGER) WHEN 0 THEN 'see https://records.example/view?itemSeq=' || CAST(p_partkey AS INTEGER) || ').' WHEN 1 THEN 'https://Records.example/x,;http://other.example' WHEN 2 THEN 'on http://blog.example/a and more' WHEN 3 THEN 'no address' WHEN 4 THEN NULL WHEN 5 THEN 'https://maker.example/' || p_type ELSE '' END AS evidence_note FROM {part} WHERE p_partkey % 10 <> 7),
di AS (SELECT 'https://maker.example/' || p_type AS source_url, CASE WHEN p_type = 'PROMO' THEN 'verified_official' WHEN p_type = 'SMALL' THEN 'verified_multi_source' ELSE 'candidate' END AS verification_status FROM {part}),
of AS (SELECT CAST(p_partkey AS INTEGER) AS item_seq FROM {part} WHERE p_partkey % 4 = 0)"""
HOSTS = [("records.example", "official_regulator"), ("Maker.example", "official_manufacturer"), ("agency.example", "official_public_agency")]
PATTERN = r"itemSeq=([0-9]+)"


def made(spark, sf, name, text=WORK):
    return spark.sql(f"WITH {text} SELECT * FROM {name}", part=b.table(spark, sf, "part"))


@query("src_evidence_targets", "WITH " + WORK.format(part="part") + f""", x AS (SELECT wi.*, family_name, family_basis, evidence_note, regexp_extract(evidence_note, '{PATTERN}', 1) AS item_seq FROM wi JOIN sg USING (representative_item_id) WHERE family_basis = 'web_search')
SELECT *, 'https://records.example/view?itemSeq=' || item_seq || '&full' AS source_url, lower(regexp_extract(family_name, '[A-Z]+')) AS family_token, CASE WHEN coalesce(strength, '') = '' THEN '' ELSE replace(lower(split_part(strength, ';', 1)), ' ', '') || ';10ml' END AS strength_tokens FROM x WHERE item_seq <> ''""")  # fmt: skip
def targets(spark, sf):
    return op.page_targets(made(spark, sf, "wi"), made(spark, sf, "sg"), "web_search", PATTERN, "https://records.example/view?itemSeq={}&full")


@query("itm_evidence_candidates", "WITH " + WORK.format(part="part") + """, x AS (SELECT wi.*, coalesce(evidence_note, '') AS evidence_note, rtrim(regexp_extract(coalesce(evidence_note, ''), 'https?://[^\\s;]+'), '.,)') AS evidence_url FROM wi LEFT JOIN sg USING (representative_item_id) WHERE attribute_parse_status = 'needs_external_match'),
y AS (SELECT *, lower(regexp_extract(evidence_url, '^https?://([^/?#]*)', 1)) AS source_domain, evidence_url IN (SELECT source_url FROM di WHERE verification_status <> 'candidate') OR regexp_extract(evidence_url, 'itemSeq=([0-9]+)', 1) IN (SELECT CAST(item_seq AS VARCHAR) FROM of) AS sure FROM x),
z AS (SELECT *, CASE source_domain WHEN 'records.example' THEN 'official_regulator' WHEN 'maker.example' THEN 'official_manufacturer' WHEN '' THEN 'not_searched' ELSE 'secondary_reference' END AS source_tier FROM y)
SELECT * EXCLUDE (sure), CASE WHEN sure THEN 'verified_official' WHEN evidence_url <> '' THEN 'candidate_unverified' ELSE 'not_searched' END AS verification_status, CASE WHEN sure THEN 'verified_dictionary_ready' WHEN evidence_url <> '' THEN 'web_candidate_needs_review' ELSE 'search_required' END AS candidate_status,
  CASE WHEN sure THEN 0.98 WHEN evidence_url = '' THEN 0.0 WHEN source_tier LIKE 'official%' THEN 0.65 ELSE 0.45 END::DOUBLE AS candidate_confidence, CASE WHEN sure THEN 'dictionary_ready' ELSE 'needs_review' END AS review_status FROM z""")  # fmt: skip
def evidence_candidates(spark, sf):
    hosts = spark.createDataFrame(HOSTS, "host string, tier string")
    return op.candidates(made(spark, sf, "wi"), made(spark, sf, "sg"), made(spark, sf, "di"), made(spark, sf, "of"), hosts, PATTERN)


CONCEPTS = """ci AS (SELECT CAST(p_partkey AS BIGINT) AS representative_item_id, upper(p_name) || ' #' || p_size AS name, CASE CAST(p_partkey % 5 AS INTEGER) WHEN 0 THEN p_type WHEN 1 THEN 'UNSPECIFIED_ITEM' WHEN 2 THEN ' ' WHEN 3 THEN NULL ELSE p_brand END AS family, CASE WHEN p_partkey % 4 < 2 THEN 'family of ' || p_brand WHEN p_partkey % 4 = 2 THEN '' END AS family_name,
  CASE WHEN p_partkey % 3 = 0 THEN 'name_rule' WHEN p_partkey % 3 = 1 THEN 'structured' END AS family_source, CASE WHEN p_partkey % 7 < 5 THEN p_type ELSE '' END AS subtype, CASE WHEN p_partkey % 7 < 3 THEN p_size || 'mm' END AS specification, CASE WHEN p_partkey % 2 = 0 THEN 'EA' ELSE ' ' END AS unit, CASE WHEN p_partkey % 8 = 3 THEN 'many' ELSE '' || p_size END AS occurrence_count, CASE WHEN p_partkey % 9 > 0 THEN CAST(p_size * 2.5 AS DOUBLE) END AS usage_sum FROM {part})"""
RULES = [("FASTENER", "Fasteners", "gear|bolt"), ("FLAT", "Flat parts", "ring[0-9]|plate"), ("TOOL", "Tools", "anvil|gear")]
_CONCEPTS = """cf AS (SELECT *, CASE WHEN trim(family) NOT IN ('', 'UNSPECIFIED_ITEM') THEN trim(family) END AS f, regexp_replace(lower(name), '[^0-9a-z]+', '', 'g') AS concept_match_key FROM ci), cp AS (SELECT *, CASE f WHEN 'PROMO' THEN 'GIFT' WHEN 'SMALL' THEN 'SIZED' WHEN 'LARGE' THEN 'SIZED' ELSE f END AS p, CASE WHEN regexp_matches(concept_match_key, 'gear|bolt') THEN 1 WHEN regexp_matches(concept_match_key, 'ring[0-9]|plate') THEN 2 WHEN regexp_matches(concept_match_key, 'anvil') THEN 3 ELSE 4 END AS r FROM cf),
co AS (SELECT * EXCLUDE (f, p, r), coalesce(p, ['FASTENER', 'FLAT', 'TOOL', 'UNRESOLVED_PARENT'][r]) AS parent_concept_id, CASE WHEN p IS NULL THEN ['Fasteners', 'Flat parts', 'Tools', 'UNRESOLVED'][r] WHEN p = 'SIZED' THEN 'Sized items' ELSE coalesce(nullif(family_name, ''), p) END AS parent_concept_name, CASE WHEN p IS NULL THEN CASE WHEN r < 4 THEN 'concept_dictionary' ELSE 'unresolved' END WHEN family_source = 'name_rule' THEN 'name_rule_family' ELSE 'structured_family' END AS parent_concept_source FROM cp),
ck AS (SELECT *, parent_concept_id || '::' || coalesce(nullif(trim(subtype), ''), 'UNSPECIFIED_SUBTYPE') || '::' || coalesce(nullif(trim(specification), ''), 'UNSPECIFIED_SPEC') || '::' || coalesce(nullif(trim(unit), ''), 'UNSPECIFIED_UNIT') AS forecast_grouping_key FROM co)"""


def concepts(spark, sf):
    families = spark.createDataFrame([("PROMO", "GIFT"), ("SMALL", "SIZED"), ("LARGE", "SIZED")], "family string, parent string")
    return op.parent_concepts(made(spark, sf, "ci", CONCEPTS), families, spark.createDataFrame([("SIZED", "Sized items")], "parent string, parent_name string"), RULES)


@query("itm_concept_rows", "WITH " + CONCEPTS.format(part="part") + f", {_CONCEPTS} SELECT * FROM ck")
def concept_rows(spark, sf):
    return concepts(spark, sf)


@query("itm_concept_totals", "WITH " + CONCEPTS.format(part="part") + f", {_CONCEPTS} SELECT parent_concept_id, arg_min(parent_concept_name, representative_item_id) AS parent_concept_name, arg_min(parent_concept_source, representative_item_id) AS parent_concept_source, count(*) AS child_count, sum(coalesce(TRY_CAST(occurrence_count AS DOUBLE), 0)) AS occurrence_count, sum(coalesce(usage_sum, 0)) AS usage_sum FROM ck GROUP BY 1")
def concept_sums(spark, sf):
    return op.concept_totals(concepts(spark, sf))
