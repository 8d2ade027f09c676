"""Toxicity by a chain of sparse logistic models (operator 4).

Two categories in order, `poor` (quality 0) and `toxic`; the second model also takes the first one's probability, in training from
out-of-fold predictions. Features are the words of a text and, for words that are inflected, their first 4, 5 and 6 letters. Models are fitted on at most
SAMPLE labelled rows, chosen by hash; the FEATURES most telling ones go in, an L1 penalty leaves few, and those are fitted again without it,
so that few labels give no weight to chance words and the weights kept are whole.

All documents are scored over their whole text by DataFrame functions. Null or empty texts hold no word and get the intercept's probability;
labels that contradict one another for a doc_id count as poor, as toxic; rows with null labels or ids are not learned from; without labels of both
classes a model predicts the base rate; repeated rows repeat; an empty table gives an empty result; extra columns stay, but for
`p_poor`, `p_toxic` and `is_toxic`, which are overwritten, and names that start with `_tox`, which are taken.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, table, text_or_empty, written

SAMPLE, FEATURES, L1, L2, LEAST, FOLDS, THRESHOLD = 6000, 1500, 0.3, 1e-4, 3, 3, 0.5
STEMS = (4, 5, 6)


@dataclass
class Linear:
    bias: float = 0.0
    weights: dict[int, float] = field(default_factory=dict)
    earlier: float = 0.0

    def predict(self, rows: list[np.ndarray], earlier: np.ndarray) -> np.ndarray:
        z = np.array([self.bias + sum(self.weights.get(int(w), 0.0) for w in r) for r in rows]) + self.earlier * earlier
        return 1 / (1 + np.exp(-z))

    def column(self, words: Column, earlier: Column) -> Column:
        z = F.lit(float(self.bias)) + F.lit(float(self.earlier)) * earlier
        if self.weights:
            known = F.array(*[F.lit(w) for w in self.weights])
            values = F.create_map(*[F.lit(x) for kv in self.weights.items() for x in kv])
            z = z + F.aggregate(F.array_intersect(words, known), F.lit(0.0), lambda s, w: s + F.element_at(values, w))
        return 1 / (1 + F.exp(-z))


def words_of(text: Column) -> Column:
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != ""))
    stem = lambda w, k: F.when(F.length(w) >= k, F.xxhash64(F.substring(w, 1, k), F.lit(k)))
    return F.array_distinct(F.array_compact(F.flatten(F.transform(words, lambda w: F.array(F.xxhash64(w), *[stem(w, k) for k in STEMS])))))


def fit(rows: list[np.ndarray], y: np.ndarray, earlier: np.ndarray, steps: int = 300) -> Linear:
    n, base = len(y), (y.sum() + 0.5) / (len(y) + 1)
    out = Linear(float(np.log(base / (1 - base))))
    if n == 0 or y.min() == y.max():
        return out
    at = np.repeat(np.arange(n), [len(r) for r in rows])
    vocab, col = np.unique(np.concatenate(rows), return_inverse=True)
    if len(vocab) == 0:
        return out
    k = len(vocab)
    mul = lambda v: np.bincount(at, v[col], n) + v[k] + v[k + 1] * earlier
    tmul = lambda r: np.concatenate([np.bincount(col, r[at], k), [r.sum(), (r * earlier).sum()]])
    v = np.ones(k + 2)
    for _ in range(12):
        v = tmul(mul(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 4 * n / (norm * 1.1)

    def descend(w: np.ndarray, on: np.ndarray, l1: float, l2: float) -> np.ndarray:
        """Accelerated proximal steps over the features `on`; the intercept and the earlier probability are free."""
        free = np.concatenate([on, [True, True]])
        cut, shrink = np.concatenate([np.full(k, step * l1), [0, 0]]), np.concatenate([np.full(k, l2), [0, 0]])
        z, t = w.copy(), 1.0
        for _ in range(steps):
            g = (tmul(1 / (1 + np.exp(-mul(z))) - y) / n + shrink * z) * free
            new = z - step * g
            new = np.sign(new) * np.maximum(np.abs(new) - cut, 0)
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            z, w, t = new + (t - 1) / t2 * (new - w), new, t2
        return w

    w = np.zeros(k + 2)
    w[k] = out.bias
    w = descend(w, np.ones(k, bool), L1 / n**0.5, 0.0)  # chance words fade with the root of the rows
    w = descend(w, np.abs(w[:k]) > 1e-6, 0.0, L2)
    return Linear(float(w[k]), {int(v): float(x) for v, x in zip(vocab, w[:k]) if abs(x) > 1e-6}, float(w[k + 1]))


def telling(words: DataFrame, sample: DataFrame, label: str) -> DataFrame:
    """w: the FEATURES words whose share of rows with the label is farthest from the whole's, in standard deviations."""
    whole = sample.agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("p"))
    per = words.groupBy("w").agg(F.count(F.lit(1)).alias("df"), F.sum(label).alias("pos")).filter(F.col("df") >= LEAST).crossJoin(F.broadcast(whole))  # one row
    spread = F.sqrt(F.col("df") * F.col("p") * (1 - F.col("p")) * (1 - F.col("df") / (F.col("n") + 1)) + 1e-9)
    return per.withColumn("gain", F.abs(F.col("pos") - F.col("df") * F.col("p")) / spread).filter("gain > 0").orderBy(F.desc("gain"), "w").limit(FEATURES).select("w")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Linear, Linear]:
    """The models of `poor` and `toxic`. The driver gets the telling words of the sample alone, twice FEATURES at most, and which rows hold them."""
    labels = labels.filter("doc_id is not null and quality is not null and toxic is not null")
    labels = labels.groupBy("doc_id").agg((1 - F.min("quality")).cast("double").alias("poor"), F.max("toxic").cast("double").alias("toxic"))
    labels = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    got = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id").groupBy("doc_id", "poor", "toxic").agg(F.max("text").alias("text"))
    got = written(got.select("doc_id", words_of(text_or_empty()).alias("w"), "poor", "toxic"), "toxicity-sample")
    words = got.select("doc_id", F.explode("w").alias("w"), "poor", "toxic")
    vocab = written(telling(words, got, "poor").union(telling(words, got, "toxic")).distinct(), "toxicity-words")
    held = words.join(F.broadcast(vocab), "w").groupBy("doc_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    got_rows = got.select("doc_id", "poor", "toxic").join(held, "doc_id", "left").collect()
    forget(got, vocab)
    got = sorted(got_rows, key=lambda r: r["doc_id"])
    rows = [np.array(r["w"] or [], np.int64) for r in got]
    poor, toxic = np.array([r["poor"] for r in got]), np.array([r["toxic"] for r in got])
    none, oof = np.zeros(len(got)), np.zeros(len(got))
    fold = np.arange(len(got)) % FOLDS
    for f in range(FOLDS if len(got) else 0):
        a, b = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        oof[b] = fit([rows[i] for i in a], poor[a], none[a]).predict([rows[i] for i in b], none[b])
    return fit(rows, poor, none), fit(rows, toxic, oof)


def score(docs: DataFrame, models: tuple[Linear, Linear]) -> DataFrame:
    """docs with p_poor, p_toxic (0 to 1) and is_toxic."""
    docs = docs.withColumn("_tox_words", words_of(text_or_empty()))
    docs = docs.withColumn("p_poor", models[0].column(F.col("_tox_words"), F.lit(0.0)))
    docs = docs.withColumn("p_toxic", models[1].column(F.col("_tox_words"), F.col("p_poor")))
    return docs.withColumn("is_toxic", F.col("p_toxic") > THRESHOLD).drop("_tox_words")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "p_poor", "p_toxic", "is_toxic")
