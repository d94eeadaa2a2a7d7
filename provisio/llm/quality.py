"""Quality by hierarchical empirical Bayes.

A logistic model, fitted on a sample of labelled documents that is bounded in rows (LABELLED) and bytes (FIT_BYTES), gives each document's own evidence.
Hosts and paths get posteriors by grouped sums of that evidence over all documents: the global rate is
the prior of hosts, a host's posterior mean is the prior of its paths, and both priors have a strength
(in documents) estimated from the spread of the groups by the method of moments. Sparse sites thus stay near
the global rate. A document's log odds are its own plus what its path's posterior (without itself) differs
from the global rate. Two heads are fitted: good quality and toxic; a document is accepted when it is
rather good than not and rather not toxic.

Documents here have no url: host is source, path is lang. Both heads share one grouped pass and one join.
Sites join back by broadcast while there are at most SITES_BROADCAST of them, else by a shuffled join on salted keys.

Defined results: a null or empty text has the evidence of no words and only its model's intercept and site.
Null host or path count as the empty string. Without labels of both classes the model says the prior rate.
Repeated rows count each time; a document that is labelled several times has the rounded mean of its labels. A
probability of exactly EDGE is good for quality and toxic for toxicity. Very long texts are read whole. An empty table
gives an empty result. Only doc_id, text, source and lang are read, whatever other columns there are; labels with a null
label don't count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provisio.llm.common import Sent, table, written

LABELLED = 20_000  # the bound of the labelled sample: in documents
FIT_BYTES = 1 << 28  # and in bytes of their words
BUCKETS = 1 << 16
SITES_BROADCAST = 100_000
SALTS = 64
EDGE = 0.5
WORDS = re.compile(r"[^\W\d_]+")
DENSE = ("bias", "symbols", "upper", "bars", "shouts", "stutter", "variety", "length", "digits")
SYMBOL_BYTES = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,'\"-()")


def dense(text: str, words: list[str]) -> list[float]:
    """Numbers of a text's form; shares are of its length or word count, scaled to about 0..3."""
    data = text.encode("utf-8", "replace")
    n, m = max(1, len(data)), max(1, len(words))
    symbols = n - len(data.translate(None, SYMBOL_BYTES)) if data else 0
    upper = sum(map(str.isupper, words)) / m
    stutter = sum(map(str.__eq__, words, words[1:])) / m
    variety = len(set(words)) / m if m > 30 else 1.0
    return [1.0, min(3.0, 20 * symbols / n), 3 * upper * (m > 3), min(3.0, 20 * data.count(b" | ") / n), min(3.0, 20 * data.count(b"!!") / n), 3 * stutter, 3 * (1 - variety), np.log1p(m) / 6, min(3.0, 10 * (n - len(data.translate(None, b"0123456789"))) / n)]


class Hasher:
    """Words to buckets; what was hashed is kept up to a bound."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        known, out = self.known, set()
        if len(known) > 200_000:
            known.clear()
        for w in set(words):
            b = known.get(w)
            if b is None:
                b = known[w] = xxhash.xxh32_intdigest(w.lower().encode("utf-8", "replace")) % BUCKETS
            out.add(b)
        return np.fromiter(out, np.int64, len(out))


def features(text: str | None, hasher: Hasher) -> tuple[list[float], np.ndarray]:
    text = text or ""
    words = WORDS.findall(text)
    return dense(text, words), hasher(words)


def _shares(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A weight for each bag of words (flat, end to end): 1 over the number of bags with the same three smallest hashes, so that
    copies and most near copies of a text count about once."""
    mixed = (np.arange(BUCKETS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    ends = np.cumsum(sizes)
    sketch = [tuple(np.sort(mixed[flat[e - n : e]])[:3].tolist()) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    size = Counter(sketch)
    return np.array([1.0 / size[k] for k in sketch])


class Model:
    """Logistic regression over form features and the presence of hashed words.

    Words that tell the classes apart (a two-proportion score over SCORE) enter a fit with an absolute-value
    penalty, which leaves few of them; those are fitted once more with a tenth of it. Both are
    accelerated proximal gradient steps on the bounded sample.
    """

    SCORE = 3.5

    def __init__(self, forms: np.ndarray, flat: np.ndarray, sizes: np.ndarray, share: np.ndarray, y: np.ndarray, steps: int = 150):
        """A row of forms and a bag of sizes words (flat, end to end) for each text, with its weight and label."""
        self.beta, self.words = np.zeros(len(DENSE)), np.zeros(BUCKETS)
        rate = float((share @ y + 1) / (share.sum() + 2)) if len(y) else 0.5
        self.beta[0] = np.log(rate / (1 - rate))
        if not 0 < y.sum() < len(y):
            return
        total = share.sum()
        row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        count = [np.bincount(flat, weights=(share * (y == k))[row], minlength=BUCKETS) for k in (0, 1)]
        n = [float((share * (y == k)).sum()) for k in (0, 1)]
        pooled = (count[0] + count[1]) / total
        z = (count[1] / n[1] - count[0] / n[0]) / np.sqrt(np.maximum(pooled * (1 - pooled) * (1 / n[0] + 1 / n[1]), 1e-12))
        penalty = max(4e-4, 1.5 / total)
        for strength in (penalty, penalty / 10):
            chosen = np.flatnonzero((np.abs(z) > self.SCORE) & (count[0] + count[1] >= 3) if strength == penalty else self.words != 0)
            self.words[:] = 0
            place = np.full(BUCKETS, -1)
            place[chosen] = np.arange(len(chosen))
            used = place[flat] >= 0
            self._fit(forms, row[used], place[flat[used]], len(chosen), y, share / total, strength, steps, chosen)

    def _fit(self, forms, row, col, n_words, y, share, strength, steps, chosen) -> None:
        d = forms.shape[1]

        def odds(b: np.ndarray) -> np.ndarray:
            return forms @ b[:d] + np.bincount(row, weights=b[d:][col], minlength=len(y))

        def gradient(r: np.ndarray) -> np.ndarray:
            return np.concatenate([forms.T @ r, np.bincount(col, weights=r[row], minlength=n_words)])

        v = np.ones(d + n_words)
        for _ in range(12):  # the largest curvature, by power iteration
            v = gradient(share * odds(v))
            size = np.linalg.norm(v)
            v /= size
        rate = 1 / (0.25 * size * 1.05)
        b = np.concatenate([self.beta, np.zeros(n_words)])
        ahead, t = b.copy(), 1.0
        for _ in range(steps * (1 if strength > 2e-4 else 2)):
            p = 1 / (1 + np.exp(-np.clip(odds(ahead), -30, 30)))
            new = ahead - rate * gradient(share * (p - y))
            new[d:] = np.sign(new[d:]) * np.maximum(np.abs(new[d:]) - rate * strength, 0)
            after = (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead, b, t = new + (t - 1) / after * (new - b), new, after
        self.beta, self.words[chosen] = b[:d], b[d:]

    def __call__(self, form: list[float], own: np.ndarray) -> float:
        return float(np.clip(np.dot(self.beta, form) + self.words[own].sum(), -20, 20))


def fitted(docs: DataFrame, labels: DataFrame, heads: tuple[str, ...] = ("quality", "toxic"), most: int = LABELLED, most_bytes: int = FIT_BYTES) -> list[Model]:
    """A model for each label column, on the most labelled documents of smallest hash (of one doc_id, those of smallest text digest), as far as they have most_bytes at most."""
    own = [F.col(h).cast("double").alias(h) for h in heads]
    labels = labels.select(F.col("doc_id").alias("__px_id"), *own).dropna().groupBy("__px_id").agg(*(F.round(F.avg(h)).alias(h) for h in heads))
    sample = labels.orderBy(F.xxhash64("__px_id"), "__px_id").limit(most)
    rows = docs.select(F.col("doc_id").alias("__px_id"), "text").join(F.broadcast(sample), "__px_id").select(F.xxhash64("__px_id").alias("h"), F.md5(F.col("text").cast("binary")).alias("d"), "text", *heads)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            found = [features(t, hasher) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([f for f, _ in found], pa.list_(pa.float64())), pa.array([np.sort(w).astype("<u2").tobytes() for _, w in found], pa.binary()), *b.columns[3:]], ["h", "d", "form", "words", *heads])

    found = rows.mapInArrow(bags, f"h long, d string, form array<double>, words binary, {', '.join(f'{h} double' for h in heads)}")
    order = [F.col(c) for c in ("h", "d", *heads)]
    size = F.sum(F.length("words").cast("long") + 8 * len(DENSE)).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))  # over at most LABELLED rows
    got = found.orderBy(*order).limit(most).withColumn("__px_size", size).where(F.col("__px_size") <= most_bytes).orderBy(*order).drop("h", "d", "__px_size").toArrow()
    n = got.num_rows
    forms = got.column("form").combine_chunks().flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, len(DENSE)))
    bags_ = got.column("words").to_pylist()
    sizes = np.fromiter((len(w) // 2 for w in bags_), np.int64, n)
    flat = np.frombuffer(b"".join(bags_), "<u2")
    y = [got.column(h).to_numpy() for h in heads]
    del got, bags_
    share = _shares(flat, sizes)
    return [Model(forms, flat, sizes, share, own) for own in y]


def evidence(docs: DataFrame, models: list[Model], text: Column) -> Column:
    """array<double>: each head's log odds."""
    sent = Sent(docs.sparkSession, models)

    @F.arrow_udf("array<double>")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher, known = Hasher(), sent.get()
        for texts in parts:
            found = (features(t.as_py(), hasher) for t in texts)
            yield pa.array([[m(f, w) for m in known] for f, w in found], pa.list_(pa.float64()))

    return score(text)


def _strengths(groups: DataFrame, heads: int) -> list[float]:
    """groups: n, k and prior mean p of each head. Documents that the prior of a level is worth, from how far groups' rates spread beyond sampling noise."""
    wanted = [F.sum("n").alias("n")]
    for i in range(heads):
        n, p = F.col("n"), F.col("p")[i]
        wanted += [F.sum(n * (F.col("k")[i] / n - p) ** 2).alias(f"spread{i}"), F.sum(p * (1 - p)).alias(f"noise{i}"), F.sum(n * p * (1 - p)).alias(f"scale{i}")]
    r = groups.agg(*wanted).first()
    out = []
    for i in range(heads):
        spread, noise, scale = r[f"spread{i}"], r[f"noise{i}"], r[f"scale{i}"]
        # E[n (r - p)^2] = p (1 - p) (1 + (n - 1) rho), rho = 1 / (strength + 1)
        out.append(float(np.clip(1 / max((spread - noise) / max(scale - noise, 1e-9), 1e-4) - 1, 1.0, 10_000.0)) if scale else 1.0)
    return out


def _array(columns: list[Column]) -> Column:
    return F.array(*(F.lit(c) if isinstance(c, float) else c for c in columns))


def sites(scored: DataFrame, heads: int = 2) -> tuple[DataFrame, list[float]]:
    """scored: host, path, p (an array with each head's probability). (host, path, n, and of each head in arrays k, the prior mean and the strength of the path's own posterior), and the global rates."""
    sums = lambda column: [F.sum(column[i]).alias(f"k{i}") for i in range(heads)]
    ks = F.array(*(F.col(f"k{i}") for i in range(heads))).alias("k")
    paths = written(scored.groupBy("host", "path").agg(*sums(F.col("p")), F.count("*").alias("n")).select("host", "path", ks, "n"), "paths")
    hosts = written(paths.groupBy("host").agg(*sums(F.col("k")), F.sum("n").alias("n")).select("host", ks, "n"), "hosts")
    total = hosts.agg(*sums(F.col("k")), F.sum("n").alias("n")).first()
    rates = [float((total[f"k{i}"] or 0.0) + 0.5) / float((total["n"] or 0) + 1) for i in range(heads)]
    strength = _strengths(hosts.withColumn("p", _array(rates)), heads)
    hosts = hosts.select("host", _array([(F.col("k")[i] + strength[i] * rates[i]) / (F.col("n") + strength[i]) for i in range(heads)]).alias("mean"))
    both = written(paths.join(hosts, "host"), "paths-of-hosts")
    return both.withColumn("strength", _array(_strengths(both.withColumn("p", F.col("mean")), heads))), rates


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def posterior(rows: DataFrame, site: DataFrame, rates: list[float], own: list[Column], into: list[str]) -> DataFrame:
    """rows (host, path, ...) with the posterior probabilities from own log odds and the site without the row itself."""
    site = site.select("host", "path", F.col("k").alias("__px_k"), F.col("n").alias("__px_n"), F.col("mean").alias("__px_mean"), F.col("strength").alias("__px_s"))
    if site.limit(SITES_BROADCAST + 1).count() <= SITES_BROADCAST:
        met = rows.join(F.broadcast(site), ["host", "path"], "left")
    else:
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__px_salt")
        met = rows.withColumn("__px_salt", (F.rand(1) * SALTS).cast("int")).join(site.select("*", salt), ["host", "path", "__px_salt"], "left")
    out = {}
    for i, (x, rate, name) in enumerate(zip(own, rates, into, strict=True)):
        p, s = 1 / (1 + F.exp(-x)), F.col("__px_s")[i]
        k, n = F.greatest(F.col("__px_k")[i] - p, F.lit(0.0)), F.greatest(F.col("__px_n") - 1, F.lit(0))
        mean = F.least(F.greatest((k + s * F.col("__px_mean")[i]) / (n + s), F.lit(1e-6)), F.lit(1 - 1e-6))
        out[name] = 1 / (1 + F.exp(-(x + _logit(mean) - _logit(F.lit(rate)))))
    return met.withColumns(out).drop("__px_k", "__px_n", "__px_mean", "__px_s", "__px_salt")


def _sited(docs: DataFrame, host: str, path: str) -> DataFrame:
    return docs.withColumns({c: F.coalesce(F.col(name).cast("string"), F.lit("")) if name in docs.columns else F.lit("") for c, name in (("__px_host", host), ("__px_path", path))})


def judged(docs: DataFrame, labels: DataFrame, keep: list[str], host: str = "source", path: str = "lang") -> DataFrame:
    """The columns keep of docs with __px_good and __px_toxic (posterior probabilities), a row per row of docs."""
    models = fitted(docs, labels)
    scored = _sited(docs, host, path).withColumn("__px_x", evidence(docs, models, docs["text"]))
    # written once, as the sums and the result both read it
    own = written(scored.select(F.struct(*(F.col(c) for c in keep)).alias("__px_row"), F.col("__px_host").alias("host"), F.col("__px_path").alias("path"), "__px_x"), "evidence")
    x = [F.col("__px_x")[i] for i in range(len(models))]
    site, rates = sites(own.select("host", "path", F.array(*(1 / (1 + F.exp(-c)) for c in x)).alias("p")), len(models))
    met = posterior(own, written(site, "sites"), rates, x, ["__px_good", "__px_toxic"])
    return met.select("__px_row.*", "__px_good", "__px_toxic")


ACCEPTED = f"__px_good >= {EDGE} and __px_toxic < {EDGE}"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, good, toxic (posterior probabilities), accepted: a row per document."""
    found = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return found.select("doc_id", F.col("__px_good").alias("good"), F.col("__px_toxic").alias("toxic"), F.expr(ACCEPTED).alias("accepted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return judged(docs, table(spark, sf_dir, "labels"), docs.columns).where(ACCEPTED).select(*docs.columns)
