"""Url models count every context exactly, however many there are."""

from __future__ import annotations

import random
from collections import Counter
from math import log

import pytest

from provisio.llm import urlfilter as uf


def brute(trained, urls):
    pairs, contexts = (Counter(), Counter()), (Counter(), Counter())

    def strings(u):
        padded = b"\0" * uf.ORDER + u
        return [[padded[i - k : i + 1] for k in range(uf.ORDER + 1)] for i in range(uf.ORDER, len(padded))]

    for u, y in trained:
        for s in strings(u):
            for g in s:
                pairs[y][g] += 1
                contexts[y][len(g), g[:-1]] += 1
    out = []
    for u in urls:
        total = 0.0
        for s in strings(u):
            p = [1 / 256, 1 / 256]
            for g in s:
                p = [(pairs[y][g] + uf.STRENGTH * p[y]) / (contexts[y][len(g), g[:-1]] + uf.STRENGTH) for y in (0, 1)]
            total += log(p[0]) - log(p[1])
        out.append(total / max(len(u), 1))
    return out


def test_scores_are_those_of_exact_counts(spark):
    r = random.Random(5)
    made = [(f"http://h{k % 9}.net/{r.getrandbits(110):x}?{'ab'[k % 2]}={r.randrange(10**6)}".encode(), k % 2) for k in range(4000)]
    assert len({g for u, _ in made for g in uf.grams([u])[0].tolist()}) > 1 << 16
    urls = [u for u, _ in made[3000:]] + [b"", b"x", "é/ü".encode(), made[0][0], made[0][0]]
    model = uf.learned(spark.createDataFrame(made[:3000], "url binary, label int"))
    assert model.scores(urls) == pytest.approx(brute(made[:3000], urls), abs=1e-9)


def brute_cut(rows):
    """The best balanced accuracy over all thresholds half-way between hundredths, the middle one of the best."""
    sizes = [sum(y == k for y, _ in rows) for k in (0, 1)]
    if not all(sizes):
        return 0.0
    grid = [(k - 0.5) / 100 for k in range(-uf.BINS, uf.BINS + 1)]
    at = [(y, max(-uf.BINS, min(uf.BINS, round_half_up(x * 100))) / 100) for y, x in rows]
    right = [sum(y == 0 and x >= t for y, x in at) / sizes[0] + sum(y == 1 and x < t for y, x in at) / sizes[1] for t in grid]
    best = [k for k, v in enumerate(right) if v >= max(right) - 1e-12]
    return grid[best[len(best) // 2]]


def round_half_up(x):
    return int(abs(x) + 0.5) * (1 if x >= 0 else -1)


def test_threshold_is_the_best_cut(spark):
    r = random.Random(8)
    for spread, shift in ((0.5, 0.3), (0.02, 0.0), (30.0, 5.0), (0.5, -2.0)):
        rows = [(k % 3 == 0, r.gauss(-shift if k % 3 == 0 else shift, spread)) for k in range(300)]
        rows = [(int(y), round(x, 4) + 0.00003) for y, x in rows] + [(0, 0.10003), (1, 0.10003)]
        assert uf.cut(spark.createDataFrame(rows, "label int, llr double")) == pytest.approx(brute_cut(rows))
    assert uf.cut(spark.createDataFrame([(1, 0.5)], "label int, llr double")) == 0.0 and uf.cut(spark.createDataFrame([], "label int, llr double")) == 0.0


def test_very_long_urls_and_scores_at_the_threshold(spark):
    pages = [(k, f"http://a{k % 7}.example.org/{'es' if k % 2 else 'x'}/{k}") for k in range(300)] + [(1000, "http://z.net/" + "ab/" * 200_000), (1001, "http://z.net/1"), (1001, "http://z.net/1"), (1002, None)]
    got = uf.judged(spark.createDataFrame(pages, "page_id long, url string")).collect()
    assert len(got) == len(pages) and {r.page_id: len(r.path or "") for r in got}[1000] == 600_001
    assert len({(r.verdict, r.llr) for r in got if r.page_id == 1001}) == 1
    one = uf.judged(spark.createDataFrame([(k, f"http://b.org/{k}") for k in range(20)] + [(99, "http://else.net/")], "page_id long, url string")).collect()
    assert {r.llr for r in one} == {0.0} and all(r.verdict == "allow" for r in one)  # one class: every score is 0, and so is the threshold
