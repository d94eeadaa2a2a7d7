"""Texts that are made to be hard: malformed hosts, unclosed markup, runs without an end."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from provisio.llm import dom, pieces, pii


def addresses(text, anchors):
    return [text[a:b] for k, a, b in pii.spans(text, anchors) if k == "address"]


def test_hosts_that_end_in_a_digit():
    anchors = pii.automaton()
    for text, want in (
        ("see http://server.node1/x ok", ["http://server.node1"]), ("ftp://www.example.co1 end", ["ftp://www.example.co1"]), ("http://db.prod2:8080/a", ["http://db.prod2:8080"]),
        ("http://1.2.3.400/ http://1.2.3.99999999999/ http://0001.2.3.4/", ["http://0001.2.3.4"]), ("http://1.2.3/ http://a.1/ http://1.2.3.4.5/ http://[::1]/ http://.1/ http://-.9", []),
        ("http://a.org:00000080/ http://a.org:99999999999999999999/", ["http://a.org:00000080", "http://a.org"]), ("(http://a.org/)) [http://b.org]] http://c.org)))", ["http://a.org", "http://b.org", "http://c.org"]),
    ):
        assert addresses(text, anchors) == want, text


def test_random_hosts_and_cues_never_fail():
    anchors, rng = pii.automaton(), random.Random(17)
    parts = ["http", "://", "a", "b1", "node9", "1", "255", "256", ".", ".", ":", "@", "-", "[", "]", "(", ")", "/", "é", "²", "٣", " ", "token", "iban", "ssn", "login", "user id", "=", ": ", "DE89", "+49", "\n", "x" * 9, "12345678"]
    for _ in range(100_000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 12)))
        found = pii.spans(text, anchors)
        for kind, a, b in found:
            assert kind in pii.KINDS and 0 <= a < b <= len(text)
        marked, at = pii.redact(text, anchors), 0
        for k in range(len(text)):  # what no span covers stays, in order
            if not any(a <= k < b for _, a, b in found):
                at = marked.index(text[k], at) + 1


@pytest.mark.parametrize("unit", ["http://)", ")", "token/", "login/", "://a", "+1", "a@", "1.", "1-", "iban ", "secret key is ", "user_id:", "+1(", "http://u@", "token="])
def test_a_text_of_one_run_takes_linear_time(unit):
    anchors, text = pii.automaton(), unit * (1_000_000 // len(unit))
    began = time.process_time()
    pii.redact("http://" + text, anchors)
    assert time.process_time() - began < 6  # a quadratic reader takes minutes


@pytest.mark.parametrize("unit", ["<a b='", "<b ", "<!--", "<script>", "<b>", "<a", "</x>", "<p>", "<a b=\"'", "</", "<"])
def test_markup_without_an_end_takes_linear_time(unit):
    source = unit * (1_000_000 // len(unit))
    began = time.process_time()
    dom.Page(source)
    assert time.process_time() - began < 12


def test_deep_elements_are_closed_in_linear_time():
    began = time.process_time()
    dom.Page("<p><td>" + "<b>" * 100_000 + "<hr>" * 100_000 + "</x>" * 100_000)
    assert time.process_time() - began < 12


def test_tags_end_outside_quotes():
    for source, want in (
        ("<a b='>'>x", [("open", "a", {"b": ">"}), ("text", "x", "")]),
        ("<a b='>x", [("open", "a", {"b": ">x"}), ("text", "x", "")]),
        ("<a ' <b> ' x", [("text", "<a ' ", ""), ("open", "b", {}), ("text", " ' x", "")]),
        ("a < b <c", [("text", "a < b <c", "")]),
        ("<a \"<b>\" </i x", [("text", "<a \"", ""), ("open", "b", {}), ("text", "\" ", "")]),
        ("x<!-- y", [("text", "x", "")]),
    ):
        got = list(dom.events(source))
        assert [e[:2] for e in got] == [e[:2] for e in want], source


def test_a_long_text_without_a_space_takes_linear_time():
    lattice, rng = pieces.Lattice.load(pieces.default_model()), random.Random(2)
    line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(400_000))
    began = time.process_time()
    ids, n = lattice.encode([line], np.array([7]))
    assert time.process_time() - began < 16 and lattice.decode(ids) == line


def test_the_labelled_sample_is_bounded_in_bytes(spark):
    from provisio.llm import quality

    docs = spark.createDataFrame([(k, f"good words number{k} here" if k % 2 else f"bad thing{k} !! # $") for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    whole, same, few, none = (quality.fitted(docs, labels, ("quality",), most_bytes=b)[0] for b in (1 << 28, 60 * (2 * 5 + 72), 500, 0))
    assert np.array_equal(whole.beta, same.beta) and not np.array_equal(whole.beta, few.beta) and none.words.sum() == 0


def test_probabilities_at_the_edge(spark):
    from provisio.llm import quality

    rows = spark.createDataFrame([(1, 0.5, 0.49999), (2, 0.5, 0.5), (3, 0.49999, 0.0), (4, 1.0, 0.0), (5, None, 0.0)], "k int, __px_good double, __px_toxic double")
    assert [r.k for r in rows.where(quality.ACCEPTED).orderBy("k").collect()] == [1, 4]
