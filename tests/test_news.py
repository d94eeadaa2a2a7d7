"""The news chain: every article counts, and sums that never pair articles with items equal those that do."""

from __future__ import annotations

import datetime
import math
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from provisio.operators import items as it
from provisio.operators import newschain as op
from provisio.operators import signals as sg
from provisio.registry import QUERIES, SQL
from tests.test_queries import rows

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string"
NEWS = ["src_news_normalise", "news_event_classifier", "news_novelty_recency", "news_article_scores", "news_saturating_monthly", "news_supply_wide", "news_factor_volatility"]


def test_every_url_stays_and_the_first_of_a_repeat(spark):
    docs = spark.createDataFrame([(k, f"text {k}", "en", "src") for k in range(2000)] + [(7, "text 7", "en", "src")], DOCS)
    got = it.normalized_news(it.news(docs)).collect()
    assert sorted(r.article_id for r in got) == list(range(2000)) and {r.url for r in got} == {f"http://src.example/{k}" for k in range(2000)}
    again = spark.createDataFrame([(1, "b", "2024-01-02"), (2, "a", "2024-01-01"), (3, "c", "2024-01-01")], "article_id long, title string, day string").selectExpr("article_id", "title", "cast(day as date) AS date", "'u' AS url", "'s' AS source")
    assert [r.title for r in it.normalized_news(again, ["title"]).collect()] == ["a"]


@pytest.mark.parametrize("name", NEWS)
def test_news_query_matches_sql_over_more_documents(spark, name):
    con = duckdb.connect()
    for t in ("documents", "lineitem", "part", "supplier", "orders", "nation"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    assert "% 900" not in SQL[name] and rows(QUERIES[name](spark, SF).toPandas()) == rows(con.execute(SQL[name]).fetchdf())


def test_no_query_cuts_documents():
    assert not [n for n in QUERIES if n.endswith("_whole")] and not [n for n, s in SQL.items() if "doc_id % 900" in s]


def brute(articles, mapping, weights):
    """All pairs: (month, item, bucket) -> sum of scores, confidences and event types."""
    mean = lambda ws: math.exp(sum(map(math.log, ws)) / 10) if min(ws) > 0 else 0.0
    kept = [a for a in articles if a["bucket"] and a["direction"] != "down"]
    clusters = Counter((a["date"], a["event_type"], a["country"], a["material_code"]) for a in kept)
    has = {(p, c) for p, c, *_ in mapping}
    out = defaultdict(lambda: [0.0, 0.0, 0, set()])
    for a in kept:
        if a["event_type"] == "demand_increase" and ("demand", a["demand_code"]) in has:
            path, code = "demand", a["demand_code"]
        elif ("material", a["material_code"]) in has:
            path, code = "material", a["material_code"]
        elif ("name", a["branch"]) in has:
            path, code = "name", a["branch"]
        elif a["event_type"] in op.SUPPLY_WIDE and a["material_code"] is None:
            path, code = "wide", op.ALL_ITEMS
        else:
            continue
        age = ((a["date"].replace(day=28) + datetime.timedelta(days=4)).replace(day=1) - datetime.timedelta(days=1) - a["date"]).days
        own = [op.EVENT_WEIGHT.get(a["event_type"], 0.3), a["severity"], a["confidence"], op.SOURCE_WEIGHT.get(a["source_type"], 0.5), weights.get(a["country"], 0.5), math.exp(-math.log(2) * age / op.HALF_LIFE.get(a["event_type"], 30.0)), clusters[a["date"], a["event_type"], a["country"], a["material_code"]] ** -0.5]
        for p, c, item, weight, exposure, term, _ in [*mapping, ("wide", op.ALL_ITEMS, op.ALL_ITEMS, 1.0, None, None, True)]:
            if (p, c) == (path, code):
                near = 1.0 if term in a["cues"] else op.RELEVANCE[path]
                exposed = 0.6 if exposure is None else 0.3 + 0.7 * min(max(exposure, 0), 1)
                cell = out[a["date"].replace(day=1), item, a["bucket"]]
                cell[0] += mean([*own, near, weight, exposed])
                cell[1] += a["confidence"]
                cell[2] += 1
                cell[3].add(a["event_type"])
    return out


def test_sums_without_pairs_equal_those_of_all_pairs(spark):
    rng = random.Random(11)
    cues = [w for b in sg.BRANCHES for w in b[1]]
    words = [*cues * 3, *sg.NEGATION, *(a for a, _ in op.COUNTRIES), "plain", "words"]
    docs = [(k, rng.choice([None, "", *(" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(30))]), rng.choice(["src0", "src3", "src8", "src12", "x"]), datetime.date(2024, 1 + k % 3, 1 + k % 4)) for k in range(500)]
    items = [(f"i{k}", f"M{k % 9}; M{k % 4};M1", rng.choice([None, "", "D1"]), rng.choice(["factory", "policy", "none", None]), rng.choice([0.0, 0.3, 1.0]), rng.choice([None, -1.0, 0.5, 2.0]), rng.choice([None, *cues[:3]]), k % 2 == 0) for k in range(12)] + [("i1", "M1", None, None, 0.9, 1.0, cues[5], True), ("i2", None, "D1", None, 0.7, None, cues[0], True), ("i3", None, "D1", "factory", 0.4, 0.5, None, False)]
    news = spark.createDataFrame(docs, "article_id long, text string, source string, date date")
    mapping = spark.createDataFrame(items, "item string, material_codes string, demand_codes string, related_material string, weight double, exposure double, term string, approved boolean")
    weights = {"us": 0.9, "de": 0.0}
    country = spark.createDataFrame(list(weights.items()), "country string, country_weight double")
    paths = op.mapping_paths(mapping)
    articles = op.articles(news, "text")
    got = {(r.month, r["item"], r.bucket): (r.score, r.conf, r.n, set(r.events)) for r in op.item_months(*op.events(articles, country, paths), paths).collect()}
    want = brute([r.asDict() for r in articles.collect()], [tuple(r) for r in paths.collect()], weights)
    assert got.keys() == want.keys() and len(got) > 30 and len({k[2] for k in got}) == 3
    for key, (score, conf, n, events) in want.items():
        assert got[key][0] == pytest.approx(score, abs=1e-9) and got[key][1] == pytest.approx(conf) and got[key][2:] == (n, events), key
    final = op.item_news_risk(news, "text", mapping, country)
    assert final.where(F.col("item") == op.ALL_ITEMS).count() == 0 and final.where("total_news_risk > 1 or supply_news_risk < 0 or confidence > 1").count() == 0
    assert op.item_news_risk(news.limit(0), "text", mapping, country).count() == 0


def test_plan_has_no_row_for_an_article_and_an_item(spark):
    text = QUERIES["news_saturating_monthly"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "article_id" not in text and "cues" not in text  # articles are summed before what is planned here
