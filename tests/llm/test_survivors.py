"""Near-duplicate groups keep one row each, whatever their doc_ids."""

from __future__ import annotations

from provisio.llm import simhash


def test_survivors_are_chosen_by_group_and_not_by_doc_id(spark, make):
    a, b, c, d = ("seven small boats left the harbour at dawn", "a ledger of medicines counted twice a month", "no rain fell over the western hills this year", "every valve is tested before the pump may run")
    docs = [(1, a), (3, b), (3, a), (3, c), (4, c), (4, c), (None, d), (None, d), (None, b), (None, b)]
    left = simhash.stage(spark, spark.read.parquet(f"{make(documents=docs)}/documents.parquet"), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in left) == sorted([(1, a), (3, b), (3, c), (0, d), (0, b)])
