"""Evidence: what a page must show, the standing of sources, parents of items."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from provisio.registry import QUERIES  # isort: skip  (plans are imported through it)
from provisio.operators import evidence as op
from provisio.plans import evidence as pl

SF = "/root/testdata/sf0.01"


def read(spark, html, code="77"):
    df = spark.createDataFrame([(code, html)], "item_seq string, html string")
    return op.page_records(df, "item_seq", "html", "Details of", ["About"]).first()


@pytest.mark.parametrize(("html", "name", "text", "problem"), [
    ("<h1>Nova <b>tab</b></h1><p>No.&nbsp;77 &amp;lt;", "Nova tab", "Nova tab No. 77 &lt;", ""),
    ("<h1>A</h1><H1 class='x'>Longer</H1><h1>Details of all the things</h1><h1>About</h1> 77", "Longer", "A Longer Details of all the things About 77", ""),
    ("<h1>one</h1><h1>two</h1>77", "one", "one two 77", ""),
    ("<h1>About</h1>77", "", "About 77", "no_heading"),
    ("<script>77</script><h1>x</h1><!-- 77 -->", "x", "x", "no_code"),
    ("<script><h1>x</h1></script>77", "", "77", "no_heading"),
    ("77 <h1>open <i>heading", "open heading", "77 open heading", ""),
    ("<h1>x</h1> 77 <style> p", "x", "x 77", ""),
    ("3 < 4 <h1>x</h1>77", "x", "3 < 4 x 77", ""),
    ("", "", "", "no_heading"), (None, "", "", "no_heading"),
])
def test_pages(spark, html, name, text, problem):
    r = read(spark, html)
    assert (r.source_item_name, r.visible_text, r.problem) == (name, text, problem)


def test_a_page_without_a_code_is_no_evidence(spark):
    assert {read(spark, "<h1>x</h1>", c).problem for c in (None, "", " ")} == {"no_code"}


@pytest.mark.parametrize("run", ["<h1", "<h1>", "<!--", "<script>", "<a b='", "&amp;", "< ", "</"])
def test_long_pages_take_their_length(spark, run):
    began = time.time()
    assert read(spark, "<h1>x</h1>77" + run * (1_000_000 // len(run))).source_item_name
    assert time.time() - began < 20


def sourced(spark, note, status="candidate", seq="5"):
    items = spark.createDataFrame([(1, "needs_external_match"), (2, "parsed"), (3, None)], "representative_item_id long, attribute_parse_status string")
    notes = spark.createDataFrame([(1, note)], "representative_item_id long, evidence_note string")
    known = spark.createDataFrame([("http://k.example/a", status)] * 2, "source_url string, verification_status string")
    official = spark.createDataFrame([(seq,), (seq,)], "item_seq string")
    rows = op.candidates(items, notes, known, official, spark.createDataFrame(pl.HOSTS, "host string, tier string"), pl.PATTERN).collect()
    assert len(rows) == 1 and rows[0].representative_item_id == 1
    return rows[0]


@pytest.mark.parametrize(("note", "url", "tier", "status", "confidence"), [
    ("see (https://Maker.example/a).", "https://Maker.example/a", "official_manufacturer", "web_candidate_needs_review", 0.65),
    ("http://sub.maker.example/a;b", "http://sub.maker.example/a", "secondary_reference", "web_candidate_needs_review", 0.45),
    ("http://k.example/a,", "http://k.example/a", "secondary_reference", "web_candidate_needs_review", 0.45),
    ("http://x.example?itemSeq=5", "http://x.example?itemSeq=5", "secondary_reference", "verified_dictionary_ready", 0.98),
    ("itemSeq=5", "", "not_searched", "search_required", 0.0),
    ("", "", "not_searched", "search_required", 0.0),
    (None, "", "not_searched", "search_required", 0.0),
])
def test_standing_of_sources(spark, note, url, tier, status, confidence):
    r = sourced(spark, note)
    assert (r.evidence_url, r.source_tier, r.candidate_status, r.candidate_confidence) == (url, tier, status, confidence)


def test_verified_addresses(spark):
    assert [sourced(spark, "http://k.example/a", s).review_status for s in ("verified_official", "verified_multi_source", "candidate")] == ["dictionary_ready", "dictionary_ready", "needs_review"]


def parent(spark, **more):
    names = ["name", "family", "family_name", "family_source", "subtype", "specification", "unit"]
    row = spark.createDataFrame([(1, *(more.get(n) for n in names))], "representative_item_id long, " + ", ".join(f"{n} string" for n in names))
    families = spark.createDataFrame([("LANCET_A", "LANCET")], "family string, parent string")
    r = op.parent_concepts(row, families, spark.createDataFrame([("LANCET", "Lancets")], "parent string, parent_name string"), [("BOX", "Boxes", "needle.*box"), ("NEEDLE", "Needles", "needle")]).first()
    return r.parent_concept_id, r.parent_concept_name, r.parent_concept_source, r.forecast_grouping_key


def test_parents(spark):
    tail = "::UNSPECIFIED_SUBTYPE::UNSPECIFIED_SPEC::UNSPECIFIED_UNIT"
    assert parent(spark, family="LANCET_A", family_name="x", name="needle") == ("LANCET", "Lancets", "structured_family", "LANCET" + tail)
    assert parent(spark, family=" OTHER ", family_name="Other things", family_source="name_rule", unit="EA") == ("OTHER", "Other things", "name_rule_family", "OTHER::UNSPECIFIED_SUBTYPE::UNSPECIFIED_SPEC::EA")
    assert parent(spark, family="OTHER", family_name=" ") == ("OTHER", "OTHER", "structured_family", "OTHER" + tail)
    assert parent(spark, family="UNSPECIFIED_ITEM", name="Ｎeedle (BOX) 3", subtype="s", specification="m") == ("BOX", "Boxes", "concept_dictionary", "BOX::s::m::UNSPECIFIED_UNIT")
    assert parent(spark, family="", name="need-le")[:3] == ("NEEDLE", "Needles", "concept_dictionary")
    assert parent(spark, name=None) == ("UNRESOLVED_PARENT", "UNRESOLVED", "unresolved", "UNRESOLVED_PARENT" + tail)


def test_strength_tokens_keep_their_order(spark):
    work = spark.createDataFrame([(1, "5 ｍg;; 10-mL ; -"), (2, None)], "representative_item_id long, strength string")
    notes = spark.createDataFrame([(1, "Nova (10T) Tab", "web", "a itemSeq=9"), (2, None, "web", "itemSeq=8"), (3, "x", "web", "itemSeq=7")], "representative_item_id long, family_name string, family_basis string, evidence_note string")
    got = {r.representative_item_id: (r.item_seq, r.source_url, r.family_token, r.strength_tokens) for r in op.page_targets(work, notes, "web", pl.PATTERN, "u?{}").collect()}
    assert got[1] == ("9", "u?9", "novatab", "5mg;10ml") and got[2][3] == "" and set(got) == {1, 2}


def test_every_state_occurs_in_the_tables(spark):
    states = lambda name, c: {r[0] for r in QUERIES[name](spark, SF).select(c).distinct().collect()}
    assert states("src_evidence_records", "problem") == {"", "no_heading", "no_code"}
    assert states("itm_evidence_candidates", "candidate_status") == {"verified_dictionary_ready", "web_candidate_needs_review", "search_required"}
    assert states("itm_evidence_candidates", "candidate_confidence") == {0.98, 0.65, 0.45, 0.0}
    assert states("itm_concept_rows", "parent_concept_source") == {"structured_family", "name_rule_family", "concept_dictionary", "unresolved"}
    totals = QUERIES["itm_concept_totals"](spark, SF)
    assert totals.agg(F.sum("child_count")).first()[0] == spark.read.parquet(f"{SF}/part.parquet").count()
