"""Document quality by hierarchical empirical Bayes.

Evidence of a document is the log likelihood ratio of a logistic regression over features whose
rate differs clearly between labelled classes. Sites (source) and paths in a site (source and language) get posterior
rates: grouped sums of document probabilities, shrunk toward the global rate and the site's rate by
as many pseudo-documents as the spread between sites, and between paths, calls for.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import discard, materialize, slices, texts, widened

#: Labelled documents that the evidence is fitted on at most, taken by a hash of doc_id.
SAMPLE_ROWS = 8_000
#: A feature counts if this share of the labelled documents, and so many at least, have it, and
#: its z score is at least this.
MIN_SHARE, MIN_DOCUMENTS, MIN_Z = 0.002, 5, 6.0
BROADCAST_PATHS = 100_000  # rows of path rates that are broadcast at most; more are joined
STRENGTH = (1.0, 1000.0)  # bounds of the pseudo-documents of a prior
_STRIP = "\"'()[]{}<>.,;:!?"
_WORD_CACHE: dict[str, tuple[str, ...]] = {}


def _word_features(word: str) -> tuple[str, ...]:
    """What one token tells: the lower-cased word, its first letters, marks stuck to it."""
    bare = word.strip(_STRIP).lower()
    if bare.isalpha():
        return (f"w:{bare}", f"p4:{bare[:4]}", f"p5:{bare[:5]}") if len(bare) > 4 else (f"w:{bare}",)
    if bare:
        tail = bare.lstrip("".join(c for c in set(bare) if c.isalnum()))
        return (f"m:{tail[-3:]}",) if tail and not tail[-1].isalnum() else (f"x:{bare[:12]}",) if len(bare) <= 12 else ("x:long",)
    return (f"m:{word[-3:]}",) if word else ()


def word_features(word: str) -> tuple[str, ...]:
    known = _WORD_CACHE.get(word)
    if known is None:
        if len(_WORD_CACHE) > 100_000:
            _WORD_CACHE.clear()
        known = _WORD_CACHE[word] = _word_features(word)
    return known


def shape_features(text: str, words: list[str], own: set[str]) -> list[str]:
    """Shape of a whole text, in bands."""
    if not words:
        return ["s:empty"]
    n, distinct = len(words), len(own)
    size = n.bit_length() - 1
    plain = sum(w.strip(_STRIP).isalpha() for w in own) / distinct
    repeats = sum(map(eq, words, words[1:])) / n
    return [f"s:words{size}", f"s:plain{int(plain * 10)}", f"s:distinct{min(size, 8)}.{int(distinct / n * 8)}", f"s:repeats{int(repeats * 10)}", f"s:length{int(min(len(text) / n, 30) / 2)}"]


def features(text: str) -> set[str]:
    words = text.split()
    own = set(words)
    out = set().union(*map(word_features, own)) if own else set()
    return out | set(shape_features(text, words, own))


class Evidence:
    """Weights (good quality, toxic) of the chosen features, base rates, evidence of no feature."""

    def __init__(self, weights: dict[str, tuple[float, float]], good_rate: float, toxic_rate: float, base: tuple[float, float]):
        self.weights, self.good_rate, self.toxic_rate, self.base = weights, good_rate, toxic_rate, base
        self.words: dict[str, tuple[str, ...]] = {}

    def score(self, text: str) -> tuple[float, float]:
        words = text.split()
        own = set(words)
        hit: set[str] = set()
        cache = self.words
        for w in own:
            known = cache.get(w)
            if known is None:
                if len(cache) > 200_000:
                    cache.clear()
                known = cache[w] = tuple(f for f in _word_features(w) if f in self.weights)
            if known:
                hit.update(known)
        hit.update(f for f in shape_features(text, words, own) if f in self.weights)
        return self.base[0] + sum(self.weights[f][0] for f in hit), self.base[1] + sum(self.weights[f][1] for f in hit)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Evidence:
    """Fit on at most sample_rows labelled documents; features are counted by grouped sums.

    Labels without doc_id or any value are left out; of several labels of a document the least
    quality and the most toxic count. No labels give no evidence and even rates.
    """
    named = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), F.col("toxic").cast("int"))
    taken = named.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).dropna().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # at most sample_rows narrow rows
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(taken), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, toxic, every = Counter(), Counter(), Counter()
        for b in slices(batches):
            for t, q, x in zip(texts(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()):
                own = features(t) | {""}
                every.update(own)
                bad.update(own if q < 1 else ())
                toxic.update(own if x > 0 else ())
        _WORD_CACHE.clear()  # the worker lives on
        names = list(every)
        yield pa.record_batch([pa.array(names, pa.string())] + [pa.array([c[f] for f in names], pa.int64()) for c in (every, bad, toxic)], names=["feature", "n", "bad", "toxic"])

    counts = rows.select("doc_id", "text", "quality", "toxic").mapInArrow(count, "feature string, n long, bad long, toxic long")
    sums = materialize(counts.groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("n", "bad", "toxic"))), "features")
    total = tuple(sums.where("feature = ''").select("n", "bad", "toxic").first() or (0, 0, 0))
    # bounded by the sample: each of these is in a MIN_SHARE of its documents
    frequent = sums.where((F.col("n") >= max(MIN_DOCUMENTS, MIN_SHARE * total[0])) & (F.col("feature") != "")).collect()
    discard(sums)

    def clear(n: int, k: int, n_class: int) -> bool:
        """Whether a feature's rate in a class is clearly another than in the rest."""
        rest = total[0] - n_class
        if not n_class or not rest:
            return False
        p, a, b = n / total[0], k / n_class, (n - k) / rest
        spread = np.sqrt(max(p * (1 - p), 1 / total[0]) * (1 / n_class + 1 / rest))
        return abs(a - b) / spread >= MIN_Z and max(a, b) > 3 * min(a, b)

    chosen = sorted(r.feature for r in frequent if (clear(r.n, r.bad, total[1]) or clear(r.n, r.toxic, total[2])))
    index = {f: i for i, f in enumerate(chosen)}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            hits = [sorted(index[f] for f in features(t) if f in index) for t in texts(b.column(1))]
            yield pa.record_batch([b.column(2), b.column(3), pa.array(hits, pa.list_(pa.int32()))], names=["quality", "toxic", "hits"])
        _WORD_CACHE.clear()

    # narrow rows of at most sample_rows documents
    sample = rows.select("doc_id", "text", "quality", "toxic").mapInArrow(found, "quality int, toxic int, hits array<int>").collect() if chosen else []
    row = np.repeat(np.arange(len(sample)), [len(r.hits) for r in sample])
    column = np.array([i for r in sample for i in r.hits], np.int64)
    fits = [_logistic(row, column, np.array(y, float), len(chosen)) for y in ([r.quality > 0 for r in sample], [r.toxic > 0 for r in sample])]
    weights = {f: (float(fits[0][0][i]), float(fits[1][0][i])) for i, f in enumerate(chosen)}
    rates = 1 - (total[1] + 1) / (total[0] + 2), (total[2] + 1) / (total[0] + 2)
    return Evidence(weights, *rates, tuple(float(f[1] - np.log(r / (1 - r))) for f, r in zip(fits, rates)))


def _logistic(row: np.ndarray, column: np.ndarray, y: np.ndarray, n: int, penalty: float = 0.3, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of a penalised logistic regression on yes/no features, by accelerated
    gradient steps scaled by how many documents have each feature."""
    w, momentum, bias, drift = np.zeros(n), np.zeros(n), 0.0, 0.0
    if not len(y):
        return w, bias
    scale = penalty + 0.25 * np.bincount(column, minlength=n) * max(1.0, len(column) / len(y))
    for k in range(rounds):
        ahead, b = w + k / (k + 3) * momentum, bias + k / (k + 3) * drift
        miss = y - 1 / (1 + np.exp(-np.clip(b + np.bincount(row, weights=ahead[column], minlength=len(y)), -30, 30)))
        momentum = ahead + (np.bincount(column, weights=miss[row], minlength=n) - penalty * ahead) / scale - w
        drift = b + miss.sum() / (0.25 * len(y) * max(1.0, len(column) / len(y)) + 1) - bias
        w, bias = w + momentum, bias + drift
    return w, bias


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _rates(scored: DataFrame, evidence: Evidence) -> DataFrame:
    """site, path and the shrunk rates of good and toxic documents of each path.

    Sums by path first, then by site: a site with most of the rows is added up where they lie.
    """
    out = scored.groupBy("site", "path").agg(F.count("*").alias("n"), F.sum("p_good").alias("good"), F.sum("p_toxic").alias("toxic"))
    sites = out.groupBy("site").agg(*(F.sum(c).alias(f"site_{c}") for c in ("n", "good", "toxic")))
    both = out.join(sites, "site")
    spread = sites.select(*(F.struct(F.sum(f"site_{c}").alias("s"), F.sum("site_n").alias("n"), F.sum(F.pow(F.col(f"site_{c}") / F.col("site_n"), 2) * F.col("site_n")).alias("q")).alias(c) for c in ("good", "toxic")))
    within = both.select(*(F.struct(F.sum(F.col("n") * F.pow(F.col(c) / F.col("n") - F.col(f"site_{c}") / F.col("site_n"), 2)).alias("q"), F.sum("n").alias("n")).alias(f"path_{c}") for c in ("good", "toxic")))
    (total,), (inner,) = spread.collect() or [None], within.collect() or [None]
    for c in ("good", "toxic"):
        n = total[c].n or 0
        mean = min(max(total[c].s / n, 1e-3), 1 - 1e-3) if n else evidence.good_rate
        between = total[c].q / n - mean**2 if n else 0
        inside = inner[f"path_{c}"].q / n if n else 0
        strength = [min(max(mean * (1 - mean) / max(v, 1e-9) - 1, STRENGTH[0]), STRENGTH[1]) for v in (between, inside)]
        both = both.withColumn(f"{c}_site", (strength[0] * mean + F.col(f"site_{c}")) / (strength[0] + F.col("site_n")))
        both = both.withColumn(f"{c}_path", (strength[1] * F.col(f"{c}_site") + F.col(c)) / (strength[1] + F.col("n")))
    return both.select("site", "path", "good_site", "good_path", "toxic_site", "toxic_path")


def _scored(docs: DataFrame, evidence: Evidence) -> DataFrame:
    """docs with site, path, evidence of good quality and of toxicity."""
    held = docs.sparkSession.sparkContext.broadcast((evidence.weights, evidence.good_rate, evidence.toxic_rate, evidence.base))  # as many weights as fit() chose features
    new = ["e_good", "e_toxic"]
    at = docs.columns.index("text")
    built: list[Evidence] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            built.append(Evidence(*held.value))
        for b in slices(batches):
            s = [built[0].score(t) for t in texts(b.column(at))]
            yield pa.record_batch([*b.columns, pa.array([x[0] for x in s], pa.float64()), pa.array([x[1] for x in s], pa.float64())], names=[*b.schema.names, *new])

    return docs.mapInArrow(run, widened(docs, "e_good double, e_toxic double"))


_NEW = ("e_good", "e_toxic", "site", "path", "p_good", "p_toxic", "good_site", "good_path", "toxic_site", "toxic_path", "quality_posterior", "toxic_posterior", "rejected")


def classify(docs: DataFrame, labels: DataFrame, keep_text: bool = True) -> DataFrame:
    """Columns of docs with the posteriors of document, site and path, and rejected.

    A document is rejected if its quality posterior is under 0.5 or its toxic posterior over 0.5.
    Null and empty texts have the evidence of an empty text; null source or lang is a site or path
    of its own. Columns with the new names are replaced; repeated rows stay. Scored rows are written
    once, so that no text is scored twice.
    """
    docs = docs.drop(*_NEW)
    evidence = fit(docs, labels)
    place = {"site": F.coalesce(F.col("source").cast("string"), F.lit("")), "path": F.coalesce(F.col("lang").cast("string"), F.lit(""))}
    base = {"p_good": _sigmoid(F.col("e_good") + _logit(F.lit(evidence.good_rate))), "p_toxic": _sigmoid(F.col("e_toxic") + _logit(F.lit(evidence.toxic_rate)))}
    scored = _scored(docs, evidence).withColumns(place).withColumns(base)
    scored = materialize(scored if keep_text else scored.drop("text"), "scores")
    rates = materialize(_rates(scored, evidence), "rates")
    full = scored.join(F.broadcast(rates) if rates.count() <= BROADCAST_PATHS else rates, ["site", "path"])
    good = _sigmoid(F.col("e_good") + _logit(F.col("good_path")))
    toxic = _sigmoid(F.col("e_toxic") + _logit(F.col("toxic_path")))
    out = full.withColumn("quality_posterior", good).withColumn("toxic_posterior", toxic)
    return out.withColumn("rejected", (F.col("quality_posterior") < 0.5) | (F.col("toxic_posterior") > 0.5)).select(*(c for c in docs.columns if keep_text or c != "text"), *_NEW)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of docs that are not rejected, unchanged."""
    return classify(docs, labels).where(~F.col("rejected")).select(*docs.columns)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, site, path, the probabilities and posteriors of every row, rounded, and rejected. Odd
    rows as in classify()."""
    c = classify(docs.select("doc_id", "source", "lang", "text"), labels, keep_text=False)
    return c.select(F.col("doc_id").cast("long").alias("doc_id"), "site", "path", *(F.round(x, 6).alias(x) for x in ("p_good", "p_toxic", "good_site", "good_path", "toxic_site", "toxic_path", "quality_posterior", "toxic_posterior")), "rejected")
