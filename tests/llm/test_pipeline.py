"""The pipeline against its stages' brute-force rules."""

from __future__ import annotations

import corpus_pipeline
from provisio.llm import pieces, pii, quality
from tests.llm.test_text_operators import brute_fingerprint, brute_hits

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "pieces"]


def test_pipeline_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = quality.judged(docs, labels, docs.columns).where(quality.ACCEPTED).collect()
    fps = [brute_fingerprint(r.text) for r in kept]
    group = list(range(len(kept)))
    for _ in kept:  # labels settle in at most that many rounds
        new = [min(group[j] for j in range(len(kept)) if (fps[i] ^ fps[j]).bit_count() <= 4) for i in range(len(kept))]
        new = [new[g] for g in new]
        if new == group:
            break
        group = new
    least = {}
    for r, g in zip(kept, group, strict=True):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    anchors, want = pii.automaton(), {}
    for r, g in zip(kept, group, strict=True):
        n, hit, _ = brute_hits(r.text, items)
        if least[g] == r.doc_id and not (hit > 0 and 20 * hit >= n):
            want[r.doc_id] = pii.redact(r.text, anchors)
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.text for r in got} == want
    lattice = pieces.Lattice.load(pieces.default_model())
    assert all(r.decoded_ok and lattice.decode(r.pieces) == r.text for r in got[:50])


def test_stages_on_odd_rows(spark, make):
    docs = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "some words here", "en", "s", 15), (3, "some words here", "en", "s", 15), (4, "some words here", "en", "s", 15), (None, "some words here", "en", "s", 15)]
    sf = make(documents=docs, extra=True)
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, rows, sf).columns == rows.columns, name
    last = corpus_pipeline.STAGES[-1][1](spark, rows, sf)
    assert set(last.columns) == {*rows.columns, "pieces", "decoded_ok"}
    got = sorted((str(r.doc_id), r.pieces, r.decoded_ok) for r in last.collect())
    assert len(got) == len(docs) and all(r[2] for r in got) and got[0][:2] == ("1", None) and got[1][:2] == ("2", []) and got[2] == got[3]
    from provisio.llm import simhash

    left = simhash.stage(spark, rows, sf).collect()
    assert sorted(str(r.doc_id) for r in left) == ["1", "3", "None"]
    empty = make()
    assert corpus_pipeline.run(spark, empty).count() == 0
