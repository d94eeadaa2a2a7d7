"""Pieces, PII, SimHash, decontamination, language and quality against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from provisio.llm import decontam, langid, pieces, pii, quality, registry, simhash

ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "word"), (4, "word"), (None, "no id here"), (6, "héllo wörld 日本 😀 ▁ \x00 end"), (7, "long " * 30000), (8, "x" * 5000)]


def rows(df, key="doc_id"):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def lattice():
    return pieces.Lattice.load(pieces.default_model())


# ---- op4


def test_sampled_frequencies_follow_the_lattice(lattice):
    word, paths = " anthe", []

    def walk(at, own):
        if at == len(word):
            paths.append(tuple(own))
        for end in range(at + 1, len(word) + 1):
            if word[at:end] in lattice.pieces:
                walk(end, [*own, lattice.pieces[word[at:end]]])

    walk(0, [])
    weight = np.array([math.exp(sum(lattice.logp[k] for k in p)) for p in paths])
    n = 30000
    ids, sizes = lattice.encode([word[1:]] * n, np.arange(n))
    seen = Counter(tuple(x.tolist()) for x in np.split(ids, np.cumsum(sizes)[:-1]))
    assert set(seen) <= set(paths)
    assert max(abs(seen[p] / n - w) for p, w in zip(paths, weight / weight.sum(), strict=True)) < 0.012


def test_long_chunks_use_the_same_weights(lattice, monkeypatch):
    texts = ["thereandthe", "inging", "日本xx"]
    short = lattice.encode(texts * 50, np.arange(150))
    lattice.forget()
    monkeypatch.setattr(pieces, "LONG", 0)
    long = lattice.encode(texts * 50, np.arange(150))
    lattice.forget()
    assert np.array_equal(short[0], long[0]) and np.array_equal(short[1], long[1])


def test_same_row_same_pieces_in_any_batch(lattice, sample):
    texts = [d["text"] for d in sample["documents"]][:40]
    keys = np.arange(40)
    whole, n = lattice.encode(texts, keys)
    lattice.forget()
    alone = [lattice.encode([t], keys[k : k + 1])[0] for k, t in enumerate(texts)]
    assert np.array_equal(whole, np.concatenate(alone)) and n.tolist() == [len(a) for a in alone]


def test_decoding_is_lossless_and_known_to_the_public_library(lattice, sample):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    texts = [t or "" for _, t in ODD] + [d["text"] for d in sample["documents"]]
    ids, n = lattice.encode(texts, np.arange(len(texts)))
    for t, own in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert lattice.decode(own) == t
        if "▁" not in t and "\0" not in t and t.strip():
            assert sp.decode(own.tolist()) == t


def test_pieces_query_cases(spark, make):
    got = registry.QUERIES["op4_sampled_pieces"](spark, make(documents=ODD, extra=True)).collect()
    assert len(got) == len(ODD) and all(r.lossless for r in got)
    assert [r.n_pieces for r in got if r.doc_id == 1] == [None] and [r.n_pieces for r in got if r.doc_id == 2] == [0]
    assert len({r.pieces_sha256 for r in got if r.doc_id == 4}) == 1
    assert registry.QUERIES["op4_sampled_pieces"](spark, make()).count() == 0


# ---- op6

EMAIL, IP, CARD, PHONE = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    keep = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.group().split(".")),
        "card": lambda m: 16 <= len(digits(m)) <= 19 and sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits(m)))) % 10 == 0,
        "phone": lambda m: 8 <= len(digits(m)) <= 15,
    }
    return [(k, m.start(), m.end()) for k, p in zip(pii.BASE, (EMAIL, IP, CARD, PHONE), strict=True) for m in p.finditer(text or "") if keep[k](m)]


def test_base_spans_equal_the_expressions(sample):
    anchors, rng = pii.automaton(), random.Random(3)
    made = ["".join(rng.choice("ab@@..+-_% 0123459()\n") for _ in range(rng.randint(0, 60))) for _ in range(6000)]
    made += ["1.2.3.4.5.6.7.8 256.1.1.1 00000300.1.1.1 010.0.0.1", "a@b.c@d.e x@y..z @q.r a@b@c.d é@b.co", "4111 1111 1111 1111 4111-1111-1111-1111-9", "+1 (555) 123-4567 +12 +1 2345678 +4912345678901234"]
    for t in [*made, *(d["text"] for d in sample["documents"])]:
        assert [s for s in pii.spans(t, anchors) if s[0] in pii.BASE] == brute_spans(t), t


def test_added_kinds_and_redaction():
    anchors = pii.automaton()
    t = "see https://user@site.example.org:80/x, IBAN: DE89370400440532013000. token = \"ab12cd34\" mail me@x.org"
    kinds = {k: t[a:b] for k, a, b in pii.spans(t, anchors)}
    assert kinds["address"] == "https://user@site.example.org:80" and "DE89370400440532013000" in t and {"email", "account"} <= set(kinds)
    out = pii.redact(t, anchors)
    assert "me@x.org" not in out and "DE8937" not in out and "ab12cd34" not in out and "<EMAIL>" in out
    assert pii.redact(None, anchors) is None and pii.redact("clean text 12", anchors) == "clean text 12"


def test_added_kinds_keep_their_boundaries():
    anchors = pii.automaton()
    found = lambda t: [(k, t[a:b]) for k, a, b in pii.spans(t, anchors) if k in ("address", "account")]
    for text, want in (
        ("see https://a.org, and (https://b.org). end", [("address", "https://a.org"), ("address", "https://b.org")]),
        ("[ftp://me:pw@host/x] http://1.2.3.4:8080/ http://1.2.3.400/ http://localhost/ s3://bucket", [("address", "ftp://me:pw@host"), ("address", "http://1.2.3.4:8080")]),
        ("http://a.org:99999/x http://a.org: then", [("address", "http://a.org"), ("address", "http://a.org")]),
        ("account2024summary and the token 2024-01-15 expired", []),
        ("User ID: ab123456, Api_Key=\"Zx81kk22\" pass", [("account", "ab123456"), ("account", "Zx81kk22")]),
        ("iban of DE89 3704 0044 0532 0130 00 now", [("account", "DE89 3704 0044 0532 0130 00")]),
        ("IBAN DE89 3704 0044 0532 0130 01", []),
        ("SSN 123-45-6789, ssn: 000-45-6789, SSN is 987-65-4321", [("account", "123-45-6789")]),
        ("Konto Nr. 1234567 and compte 12 and passport no. X1234567.", [("account", "1234567"), ("account", "X1234567")]),
        ("the secret of 20 years; password = hunter2024!", [("account", "hunter2024")]),
        ("a subtoken=abcd12345 İ my_token=abcd12345", [("account", "abcd12345")]),
        ("TOKEN!! =!! \"9c8b45435718dcc700c1\"", [("account", "9c8b45435718dcc700c1")]),
    ):
        assert found(text) == want, text


def test_pii_query(spark, make):
    docs = [*ODD, (9, "write a.b@c.de or +49 30 1234567 from 10.0.0.1")]
    got = {(r.doc_id, r.spans): r for r in registry.QUERIES["op6_anchored_pii"](spark, make(documents=docs, extra=True)).collect()}
    r = next(r for r in got.values() if r.doc_id == 9)
    base = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(docs[-1][1]))
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == (1, 1, 0, 1, hashlib.sha256(base.encode()).hexdigest())
    assert next(r for r in got.values() if r.doc_id == 1).base_sha256 == hashlib.sha256(b"").hexdigest()


# ---- op9


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(sample):
    for t in [None, "", " \x0b ", "A b", "É A\u00a0b c d e", *(d["text"] for d in sample["documents"][:60])]:
        assert simhash.fingerprint(None if t is None else t.encode()) == brute_fingerprint(t)


def test_components_equal_brute_force(spark, make, sample):
    rng = random.Random(5)
    texts = [d["text"] for d in sample["documents"]][:120]
    near = []
    for t in texts[:40]:
        w = t.split()
        near += [" ".join(w[:-1]), " ".join([*w, "more"]), t]
    base = " ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(400)).split()
    for _ in range(60):  # a dense group of near copies
        w = list(base)
        w[rng.randrange(400)] = "q"
        near.append(" ".join(w))
    docs = [*ODD, *((100 + k, t) for k, t in enumerate([*texts, *near]))]
    got = registry.QUERIES["op9_simhash_pigeonring"](spark, make(documents=docs, extra=True)).collect()
    fps = [brute_fingerprint(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 4:
            parent[root(a)] = root(b)
    least = {}
    for k, (d, _) in enumerate(docs):
        if d is not None:
            least[root(k)] = min(least.get(root(k), d), d)
    want = sorted((str(d), f"{fps[k]:016x}", str(least.get(root(k)))) for k, (d, _) in enumerate(docs))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_links_of_close_fingerprints(spark, monkeypatch):
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:60]:
        for n in (1, 2, 3, 4, 5):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(64), n)))
    fps = sorted(fps)
    for block in (4096, 3):  # small blocks exercise the dealing of hot buckets
        monkeypatch.setattr(simhash, "BLOCK", block)
        df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
        found = {(r.u & (1 << 64) - 1, r.v & (1 << 64) - 1) for r in simhash.links(df).collect()}
        assert all((a ^ b).bit_count() <= 4 for a, b in found)
        parent = {f: f for f in fps}

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in found:
            parent[root(a)] = root(b)
        assert all(root(a) == root(b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 4)


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, 101), (200, 200)]
    got = {r.u: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[k] == 1 for k in range(2, 61)) and got[101] == 100


def test_simhash_of_nothing(spark, make):
    assert registry.QUERIES["op9_simhash_pigeonring"](spark, make()).count() == 0


# ---- op10


def brute_hits(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    doc, hit, found = split(text), set(), set()
    for i, t in items:
        own = split(t)
        size = min(13, len(own))
        windows = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
        for p in range(len(doc) - size + 1 if windows else 0):
            if tuple(doc[p : p + size]) in windows:
                hit |= set(range(p, p + size))
                found.add(str(i))
    return len(doc), len(hit), sorted(found)


def test_decontamination_equals_brute_force(spark, make):
    rng = random.Random(2)
    vocabulary = ["the", "of", "a"] * 5 + [f"w{k}" for k in range(30)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, say(rng.choice([1, 3, 12, 13, 14, 40]))) for k in range(25)] + [(30, None), (31, "!!"), (32, "the the the the the the the the the the the the the the"), (7, say(20))]
    docs = [(k, " ".join([say(rng.randint(0, 60)), (rng.choice(items)[1] or "").upper().replace(" ", ", "), say(rng.randint(0, 60))])) for k in range(120)] + ODD + [(500, "the " * 40)]
    got = registry.QUERIES["op10_prefix_decontamination"](spark, make(documents=docs, benchmark=items, extra=True)).collect()
    want = []
    for d, t in docs:
        n, h, ids = brute_hits(t, items)
        want.append((str(d), n, h, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), h > 0 and 20 * h >= n))
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted(want)


def test_decontamination_with_a_full_filter_and_of_nothing(spark, make):
    items = [(k, f"alpha beta gamma delta {k}") for k in range(30)]
    docs = spark.createDataFrame([(1, "x alpha beta gamma delta 3 alpha beta gamma delta 4 y"), (2, "alpha beta")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for bits in (decontam.FILTER_BITS, 64):  # 64 bits let nearly all shingles through to the join
        rows, found = decontam.matches(docs, bench, bits)
        (m,) = found.collect()
        assert (m.n_hit, m["items"]) == (10, ["3", "4"])
        assert [(r.doc_id, r.n_words, r.digest == m.digest) for r in rows.orderBy("doc_id").collect()] == [(1, 12, True), (2, 2, False)]
    sf = make(documents=ODD)
    got = registry.QUERIES["op10_prefix_decontamination"](spark, sf).collect()
    assert len(got) == len(ODD) and not any(r.contaminated for r in got)


def test_decontamination_of_one_repeated_word(spark):
    docs = spark.createDataFrame([(1, "w " * 4000), (2, "w " * 12), (3, "v " + "w " * 13)], "doc_id long, text string")
    bench = spark.createDataFrame([("a", "w " * 2000), ("b", "w " * 13), ("c", "w " * 12)], "item_id string, text string")
    rows, found = decontam.matches(docs, bench)
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in rows.join(found, "digest").collect()}
    assert got == {1: (4000, 4000, ["a", "b", "c"]), 2: (12, 12, ["c"]), 3: (14, 13, ["a", "b", "c"])}


def test_word_grid_in_segments(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "Bc", "é!", "x" * 30]) for _ in range(rng.randint(0, 60))).encode() for _ in range(20)] + [b"", b"..", b"word"]
    whole = decontam.Grid(texts)
    for k, t in enumerate(texts):
        own = [w for w in t.translate(decontam.WORD_BYTES).split()]
        assert whole.n_words[k] == len(own) and whole.text(whole.bounds[k], whole.bounds[k + 1]) == b" ".join(own)
    first, hashed = whole.hashes(3)
    by_text = {}
    for p, h in zip(first, hashed, strict=True):
        assert by_text.setdefault(whole.text(p, p + 3), h) == h
    assert len(set(by_text.values())) == len(by_text)
    monkeypatch.setattr(decontam, "SEGMENT_BYTES", 100)
    again, same = whole.hashes(3)
    assert np.array_equal(first, again) and np.array_equal(hashed, same)


# ---- op8, op5


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [r for r in registry.QUERIES["op8_language"](spark, sf).collect() if r.held_out]
    assert len(got) > 150 and sum(truth[r.doc_id] == r.lang_pred for r in got) / len(got) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def plain_buckets(text):
    """The buckets of all 2- and 3-grams, in plain integers."""
    c = [32, 32, *(ord(x.lower()[0]) if x.isalpha() else 32 for x in text), 32, 32]
    mask = (1 << 32) - 1

    def bucket(h, m):
        h = (h ^ (h >> 15)) & mask
        return (h * m & mask) >> 16

    out = []
    for k in range(len(c) - 2):
        two = (c[k] * 0x9E3779B1 + c[k + 1] * 0x85EBCA77) & mask
        out += [bucket(two, 0x2C1B3C6D), bucket((two + c[k + 2] * 0xC2B2AE3D) & mask, 0x297A2D39)]
    return out


def plain_prediction(docs, text):
    """Multinomial naive Bayes by its definition."""
    counts, n = {}, Counter()
    for d, t, lang in docs:
        if d is None or t is None or lang is None or zlib.crc32(str(d).encode()) % 5 == 0:
            continue
        n[lang] += 1
        counts.setdefault(lang, Counter()).update(plain_buckets(t))
    if not any(x.isalpha() for x in text or "") or not n:
        return "und", 0.0
    own = plain_buckets(text)
    score = {k: math.log(n[k] / sum(n.values())) + sum(math.log((c[b] + 0.5) / (c.total() + 0.5 * 65536)) for b in own) for k, c in counts.items()}
    best = min(score, key=lambda k: (-score[k], k))
    return best, 1 / sum(math.exp(v - score[best]) for v in score.values())


@pytest.mark.parametrize("most", [64, 2])
def test_language_scores_equal_plain_sums(spark, make, monkeypatch, most):
    monkeypatch.setattr(langid, "LANGUAGES", most)
    monkeypatch.setattr(langid, "HELD_CHARS", 50)
    rng = random.Random(1)
    made = [(k, " ".join(rng.choice(w.split()) for _ in range(rng.randint(0, 8))), lang) for k, (lang, w) in enumerate([("en", "the cat dog and"), ("de", "die Katze Hund und"), ("fr", "le chat chien et"), ("es", "el gato perro y"), ("it", "il gatto CANE e"), ("xx", "ÄÖ 日本 😀 𝒜b"), ("yy", "ÄÖ 日本 😀 𝒜b")] * 12)]
    docs = [*made, (None, "the cat", "en"), (901, None, "en"), (902, "the", None), (903, "12 34", "en"), (904, "zzz", "en"), (904, "zzz", "en")]
    sf = make(documents=[(d, t, lang, "s", 0) for d, t, lang in docs])
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    models = langid.learned(rows, most)
    assert len(models) == (1 if most == 64 else 4)
    got = langid.identified(rows, models).collect()
    want = [(str(d), *plain_prediction(docs, t)) for d, t, _ in docs]
    assert sorted((str(r.doc_id), r.lang_pred, round(r.score, 9)) for r in got) == sorted((d, lang, round(s, 9)) for d, lang, s in want)


def test_language_cases(spark, make):
    got = registry.QUERIES["op8_language"](spark, make(documents=[*ODD, (11, "12 34 !!")], extra=True)).collect()
    assert len(got) == len(ODD) + 1
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3, 11)} == {"und"} and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert registry.QUERIES["op8_language"](spark, make()).count() == 0


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = {r.doc_id: r for r in quality.judged(docs, labels.where("doc_id % 3 <> 0"), ["doc_id"]).collect()}
    held = labels.where("doc_id % 3 = 0").collect()
    assert sum((found[r.doc_id]["__px_good"] >= 0.5) == (r.quality == 1) for r in held) / len(held) > 0.95
    clean = [r for r in held if r.quality == 1 and not r.toxic]
    assert sum(found[r.doc_id]["__px_toxic"] < 0.5 for r in clean) / len(clean) > 0.97


def plain_posteriors(rows):
    """rows (host, path, x): each row's posterior by the docstring's rules, in plain Python."""
    p = [1 / (1 + math.exp(-x)) for _, _, x in rows]

    def summed(key):
        k, n = Counter(), Counter()
        for r, own in zip(rows, p, strict=True):
            k[key(r)] += own
            n[key(r)] += 1
        return k, n

    def strength(k, n, prior):
        spread = sum(n[g] * (k[g] / n[g] - prior(g)) ** 2 for g in n)
        noise = sum(prior(g) * (1 - prior(g)) for g in n)
        scale = sum(n[g] * prior(g) * (1 - prior(g)) for g in n)
        rho = max((spread - noise) / max(scale - noise, 1e-9), 1e-4)
        return min(max(1 / rho - 1, 1.0), 10_000.0)

    rate = (sum(p) + 0.5) / (len(p) + 1)
    hk, hn = summed(lambda r: r[0])
    hs = strength(hk, hn, lambda g: rate)
    mean = {h: (hk[h] + hs * rate) / (hn[h] + hs) for h in hn}
    pk, pn = summed(lambda r: r[:2])
    ps = strength(pk, pn, lambda g: mean[g[0]])
    out = []
    for (h, q, x), own in zip(rows, p, strict=True):
        m = (max(pk[h, q] - own, 0) + ps * mean[h]) / (pn[h, q] - 1 + ps)
        out.append(1 / (1 + math.exp(-(x + math.log(m / (1 - m)) - math.log(rate / (1 - rate))))))
    return out


@pytest.mark.parametrize("most", [100_000, 1])
def test_posteriors_equal_plain_sums(spark, monkeypatch, most):
    monkeypatch.setattr(quality, "SITES_BROADCAST", most)
    rng = random.Random(6)
    rows = [(h, q, rng.gauss(mu, 1.5), rng.gauss(-mu, 1)) for h, q, mu, n in (("a", "x", 1, 80), ("a", "y", -1, 60), ("b", "x", 2, 40), ("c", "z", -3, 1), ("", "", 0, 3), ("d", "x", 0, 2)) for _ in range(n)]
    rows += rows[:3]
    own = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, host string, path string, x double, z double")
    both = [F.col("x"), F.col("z")]
    site, rates = quality.sites(own.select("host", "path", F.array(*(1 / (1 + F.exp(-c)) for c in both)).alias("p")))
    got = quality.posterior(own, site, rates, both, ["gx", "gz"]).orderBy("k").collect()
    assert len(got) == len(rows)
    for column, at in (("gx", 2), ("gz", 3)):
        assert [r[column] for r in got] == pytest.approx(plain_posteriors([(r[0], r[1], r[at]) for r in rows]))


def test_sparse_sites_shrink(spark):
    rows = [("big", "a", [0.9])] * 200 + [("big", "b", [0.1])] * 200 + [("tiny", "a", [0.0])]
    site, (rate,) = quality.sites(spark.createDataFrame(rows, "host string, path string, p array<double>"), 1)
    means = {(r.host, r.path): (r.k[0] + r.strength[0] * r["mean"][0]) / (r.n + r.strength[0]) for r in site.collect()}
    assert means["big", "a"] > 0.85 and means["big", "b"] < 0.15 and 0.0 < means["tiny", "a"] < rate


def test_labels_given_twice(spark):
    docs = spark.createDataFrame([(k, "good words here" if k % 2 else "bad stuff there") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(k, 1 - k % 2, 0) for k in range(0, 40, 7)] + [(1, None, 0)], "doc_id long, quality int, toxic int")
    first, again = (quality.fitted(docs, x)[0] for x in (labels, labels.orderBy(F.desc("quality"))))
    assert np.array_equal(first.words, again.words) and np.array_equal(first.beta, again.beta)
    assert len(quality.fitted(docs, labels, most=5)) == 2


def test_quality_cases(spark, make):
    got = registry.QUERIES["op5_site_quality"](spark, make(documents=ODD, labels=[(4, 1, 0), (7, 0, None)], extra=True)).collect()
    assert len(got) == len(ODD) and all(0 <= r.good <= 1 and 0 <= r.toxic <= 1 for r in got)
    assert registry.QUERIES["op5_site_quality"](spark, make()).count() == 0
