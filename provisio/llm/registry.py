"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from provisio.llm import decontam, filteraudit, fingerprint, html_extract, langid, media, pieces, pii, quality, search, simhash, urlfilter, warc

QUERIES = {
    "op1_main_text": html_extract.query,
    "op2_arc_to_warc": warc.query,
    "op3_media_sequences": media.query,
    "op4_sampled_pieces": pieces.query,
    "op5_site_quality": quality.query,
    "op6_anchored_pii": pii.query,
    "op7_url_models": urlfilter.query,
    "op8_language": langid.query,
    "op9_simhash_pigeonring": simhash.query,
    "op10_prefix_decontamination": decontam.query,
    "op11_term_owner_search": search.query,
    "op12_removal_ranks": filteraudit.query,
    "op13_scaled_fingerprints": fingerprint.query,
}
SQL = {
    "op2_arc_to_warc": warc.SQL,
    "op10_prefix_decontamination": decontam.SQL,
    "op11_term_owner_search": search.SQL,
    "op12_removal_ranks": filteraudit.SQL,
}
