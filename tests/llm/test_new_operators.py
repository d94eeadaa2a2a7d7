"""Ranked search, filter audit and scaled fingerprints against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from provisio.llm import decontam, filteraudit, fingerprint, registry, search

ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "word"), (4, "word"), (None, "no id here"), (6, "héllo wörld 日本 😀 ▁ \x00 end"), (7, "long " * 30000), (8, "x" * 5000)]


# ---- op11


def brute_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute_ranks(docs, items, top=50):
    counted = [(d, Counter(brute_terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n, length = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in counted:
            m = 50 + (50 * c.total() * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(brute_terms(text)) & c.keys())
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(str(item), rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((str(r.item_id), r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = ["the", "of"] * 30 + ["a"] * 15 + [f"w{k}" for k in range(40)] * 2 + [f"rare{k}" for k in range(80)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(k, say(rng.choice([0, 1, 5, 30, 200]))) for k in range(400)] + [(1000 + k, "The same w1, rare2: text") for k in range(70)] + [(None, "w1 rare2"), *ODD, (3000, "W3 w3 W3")]
    rng.shuffle(docs)
    return docs, [(k, say(rng.choice([1, 4, 30]))) for k in range(12)] + [(50, None), (51, "!!"), (52, "w1 rare2"), (52, "absent w7"), (None, "w3"), (53, "héllo 日本"), (54, "the the of")]


def test_search_equals_brute_force(spark, make, corpus):
    docs, items = corpus
    sf = make(documents=docs, benchmark=items, extra=True)
    got = found(registry.QUERIES["op11_term_owner_search"](spark, sf))
    assert got == brute_ranks(docs, items)


@pytest.mark.parametrize(("top", "block", "owners"), [(3, 7, 1), (3, 7, 6), (5, 50, 3), (1000, 20, 4)])
def test_any_blocks_and_owners_give_the_same_ranks(spark, corpus, top, block, owners):
    docs, items = corpus
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert found(search.ranked(*frames, top=top, block_docs=block, owners=owners)) == brute_ranks(docs, items, top)


def test_items_of_many_bundles_and_a_full_filter(spark, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(search, "BUNDLE", 3)
    monkeypatch.setattr(search, "Filter", lambda hashes: decontam.Filter(hashes, 64))
    frames = spark.createDataFrame(docs[:150], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert found(search.ranked(*frames, top=4, block_docs=40)) == brute_ranks(docs[:150], items, 4)


def test_what_cannot_win_is_left_behind():
    import pyarrow as pa

    posting = pa.table(
        {"block": [0], "bundle": [0], "weight": [9000], "slots": pa.array([[0]], pa.list_(pa.int32())), "ahead": pa.array([[10]], pa.list_(pa.int64())), "ords": pa.array([list(range(100))], pa.list_(pa.int32())), "tfs": pa.array([[9] * 2 + [1] * 98], pa.list_(pa.int32())), "sizes": pa.array([[10] * 100], pa.list_(pa.int32()))}
    )
    nothing = pa.table({"block": pa.array([], pa.int64()), "bundle": pa.array([], pa.int64()), "slot": pa.array([], pa.int32()), "ords": pa.array([], pa.list_(pa.int32())), "scores": pa.array([], pa.list_(pa.int64()))})
    carried = search._visit(False, 1000, 10000, 2)(nothing, posting)
    assert carried["ords"].to_pylist() == [[0, 1]]
    posting = posting.set_column(4, "ahead", pa.array([[9000]], pa.list_(pa.int64())))
    assert len(search._visit(False, 1000, 10000, 2)(nothing, posting)["ords"][0]) == 100


def test_terms_in_segments(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB1é .\n") for _ in range(rng.randint(0, 90))) for _ in range(300)] + [" " + "x" * 50 + " y", "x" * 70]
    monkeypatch.setattr(search, "SEGMENT", 9)
    for t in texts:
        assert search.terms(t.encode()) == Counter(w.encode() for w in brute_terms(t)), t


def test_search_of_nothing(spark, make):
    query = registry.QUERIES["op11_term_owner_search"]
    assert query(spark, make()).count() == 0
    assert query(spark, make(documents=[(1, None), (2, "..")], benchmark=[(1, "word")])).count() == 0
    assert query(spark, make(documents=[(1, "word")])).count() == 0


# ---- op12


def brute_audit(docs, labels):
    good, toxic, smallest = defaultdict(bool), defaultdict(bool), {}
    for d, q, t in labels:
        if d is not None:
            good[d] |= q == 1
            toxic[d] |= t == 1
    for d, text, *_ in docs:
        if d is not None:
            smallest[text or ""] = min(d, smallest.get(text or "", d))
    rows = []
    for d, text, _, source, _ in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > smallest[t]}
        rows.append((source or "", fails, good[d] if d is not None else False, toxic[d] if d is not None else False))
    out = []
    for part in {r[0] for r in rows}:
        own, lines, shapley = [r for r in rows if r[0] == part], [], Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, ever = [r for r in left if r[1][f]], [r for r in own if r[1][f]]
                left = [r for r in left if not r[1][f]]
                shapley[f] += len(gone)
                lines.append((part, "".join(order), step, len(left), len(gone), len(ever) - len(gone), sum(sum(r[1].values()) == 1 for r in ever), sum(r[2] for r in gone), sum(r[3] for r in gone), f))
        out += [(*x[:9], shapley[x[9]]) for x in lines]
    return sorted(out)


def audited(df):
    return sorted((r.part, r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect())


def test_audit_equals_brute_force(spark, make):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(60)] + ["HEAD", "a#b", "x"]
    texts = [" ".join(rng.choice(words[: rng.choice([10, 60, 63])]) for _ in range(rng.choice([3, 49, 50, 51, 90]))) for _ in range(40)] + [None, "", " \t"]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), "en", rng.choice(["s0", "s0", "s1", "", None]), 0) for _ in range(150)] + [(500 + k, texts[0], "en", "hot", 0) for k in range(60)] + [(d, t, "en", "odd", 0) for d, t in ODD]
    labels = [(rng.choice([None, *range(80)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(90)]
    got = audited(registry.QUERIES["op12_removal_ranks"](spark, make(documents=docs, labels=labels, extra=True)))
    assert got == brute_audit(docs, labels)
    assert len(got) == 600 * len({d[3] or "" for d in docs})


def test_audit_of_nothing_and_of_the_edges(spark, make):
    assert registry.QUERIES["op12_removal_ranks"](spark, make()).count() == 0
    bits = lambda t: spark.createDataFrame([(t,)], "text string").select(filteraudit.failures(F.col("text"))).first()[0]
    fifty = " ".join(f"w{k}" for k in range(50))
    assert bits(fifty) == 0 and bits(fifty[:-4]) == 1
    assert bits(" ".join(f"w{k % 65}" for k in range(100))) == 0 and bits(" ".join(f"w{k % 64}" for k in range(100))) == 2
    assert bits("A" * 5 + "a" * 95) & 4 == 0 and bits("A" * 6 + "a" * 94) & 4 == 4 and bits("É" * 6 + "a" * 94) & 4 == 0
    assert [bits(c) & 8 for c in "#$%&*|@-"] == [8] * 6 + [0, 0]


def test_min_plus_steps():
    orders, removed, redundant = filteraudit.audit(np.array([0, 0b101]), np.array([[10], [3]]), 3)
    k = [tuple(o) for o in orders].index((1, 2, 0))
    assert removed[k, :, 0].tolist() == [0, 3, 0] and redundant[k].tolist() == [0, 0, 3]
    assert removed[:, :, 0].sum() == 6 * 3


# ---- op13


def test_fingerprints_estimate_likeness_and_containment():
    rng = random.Random(4)
    whole = [f"w{rng.randrange(50_000)}" for _ in range(20_000)]
    cut = lambda a, b: " ".join(whole[a:b]).encode()
    long, part, half = fingerprint.sketches([cut(0, 20_000), cut(5_000, 6_000), cut(10_000, 20_000)])
    assert fingerprint.containment(part, long) == 1.0
    assert fingerprint.likeness(long, half) == pytest.approx(0.5, abs=0.03)
    assert len(long) == pytest.approx(20_000 * fingerprint.FRACTION, rel=0.06)
    first = fingerprint.sketches([cut(0, 10_000)])[0]
    both = fingerprint.merged(first, half)
    assert fingerprint.containment(both, long) == 1.0 and len(np.setdiff1d(long, both)) <= 4  # only shingles across the cut
    assert np.array_equal(fingerprint.read_back(fingerprint.written_as(long)), long)


def test_sketches_keep_what_is_below_the_bound_or_the_least():
    texts = [b"", b"!!", b"One two", b"one  TWO", b"a b c d e", b"a b c d e f", *(f"x{k} y{k} z{k} u v".encode() for k in range(200))]
    got = fingerprint.sketches(texts)
    assert len(got[0]) == len(got[1]) == 0 and np.array_equal(got[2], got[3])
    sizes = [len(g) for g in got[6:]]
    assert set(sizes) == {1}
    below = sum(g[0] < fingerprint.bound() for g in got[6:])
    assert below == pytest.approx(200 * fingerprint.FRACTION, abs=16)
    whole = fingerprint.sketches(texts, fraction=0.999999)
    for a, b in zip(got, whole, strict=True):
        kept = b[b < fingerprint.bound()]
        assert np.array_equal(a, kept if len(kept) else b[:1])
    assert all(np.array_equal(fingerprint.sketches([t])[0], g) for t, g in zip(texts, got, strict=True))


def brute_rows(docs):
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), (d[1] or "").encode()))
    out = []
    for k, (d, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + following[:n]
        a, b, c = (fingerprint.sketches([x.encode()])[0] for x in (t, edited, following))
        like = lambda x, y: 1.0 if not len(x) + len(y) else len({*x.tolist()} & {*y.tolist()}) / len({*x.tolist()} | {*y.tolist()})
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprint.written_as(a), fingerprint.written_as(b), like(a, b), like(a, c)))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [10, 7, 1, 4096])
def test_fingerprint_rows_equal_brute_force(spark, make, monkeypatch, rows):
    rng = random.Random(rows)
    texts = [" ".join(rng.choice(["é", "b", "c,", "日本", "e😀"]) for _ in range(rng.choice([0, 1, 4, 30, 80]))) for _ in range(30)]
    docs = [(k * 3, rng.choice(texts)) for k in range(60)] + [(9, "tie"), (9, "a tie"), (None, "last one"), (None, None)] + ODD
    rng.shuffle(docs)
    read = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((tuple(r) for r in fingerprint.placed(read, rows).mapInArrow(fingerprint._compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").collect()), key=str)
    assert got == brute_rows(docs)
    if rows == 10:
        own = registry.QUERIES["op13_scaled_fingerprints"](spark, make(documents=docs, extra=True)).collect()
        assert sorted(map(tuple, own), key=str) == brute_rows(docs)


def test_fingerprints_of_one_row_of_nulls_and_of_nothing(spark, make):
    query = registry.QUERIES["op13_scaled_fingerprints"]
    assert query(spark, make()).count() == 0
    for docs in ([(5, "only one text here now")], [(None, "a"), (None, "b"), (None, "b")]):
        assert sorted((tuple(r) for r in query(spark, make(documents=docs)).collect()), key=str) == brute_rows(docs)


def test_group_sketches_merge(spark):
    docs = [("a", " ".join(f"w{k}" for k in range(400))), ("a", " ".join(f"w{k}" for k in range(300, 700))), ("b", " ".join(f"w{k}" for k in range(100, 300))), ("c", "tiny text"), ("c", "tiny text"), ("d", None)]
    rows = fingerprint.group_sketches(spark.createDataFrame(docs, "name string, text string"), "name")
    got = defaultdict(set)
    for r in rows.collect():
        assert r.hash not in got[r.name]
        got[r.name].add(r.hash)
    for name in "abcd":
        want = fingerprint.merged(*fingerprint.sketches([(t or "").encode() for n, t in docs if n == name]))
        assert got[name] == set(want.view(np.int64).tolist())
    shares = {(r.name, r.other): r.contained for r in fingerprint.group_containments(rows, rows, "name").collect()}
    assert shares["b", "a"] == 1.0 and shares["a", "b"] < 0.5 and ("c", "a") not in shares
