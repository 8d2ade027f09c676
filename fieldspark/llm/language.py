"""Language by sparse multinomial logistic regression on TF-IDF character n-grams (operator 8).

Training: at most PER_LANG documents of each language, chosen by hash, from those with crc32(doc_id) mod 3 other than 1; document frequencies
come from all such documents. FTRL with elastic net fits the weights, a fifth of the sample sets the temperature. The driver gets the sample's
n-gram counts, at most DIM a row, and holds DIM weights for each language.

Texts without a letter (null and empty too) are `und` with score 0; no usable training row makes every text `und`; very long texts are taken
whole; repeated rows repeat, in training too; of languages equally likely the first by name is predicted; an empty table gives an empty
result; extra columns stay, but for `lang_pred` and `score`, which are overwritten, and `_g`, which is taken.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

BITS, PER_LANG, EPOCHS, SALTS = 14, 600, 3, 32
DIM = 1 << BITS
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-4
PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_letters: list[np.ndarray] = []


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1- to 3-grams and their counts; runs of other characters count as one blank."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    ok = _letters[0][c]
    if not ok.any():
        return np.zeros(0, np.int64), np.zeros(0)
    c = np.where(ok, c, 32)
    c = np.concatenate([[32], c[ok | np.roll(ok, 1)], [32]]).astype(np.uint64)
    h, ids = np.zeros(len(c), np.uint64), []
    for n in range(3):
        h = h[:len(c) - n] * PRIMES[2] + (c[n:] + np.uint64(1)) * PRIMES[n]
        ids.append(((h ^ (h >> np.uint64(29))) * PRIMES[0] >> np.uint64(64 - BITS)).astype(np.int64))
    count = np.bincount(np.concatenate(ids), minlength=DIM)
    at = np.flatnonzero(count)
    return at, count[at].astype(float)


def weighed(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and TF-IDF values of unit length."""
    v = (1 + np.log(n)) * idf[at] if len(at) else n
    return at, v / max(np.linalg.norm(v), 1e-12)


def frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(DIM + 1, np.int64), 0
        for b in batches:
            for t in b["text"]:
                df[grams(t)[0]] += 1
                n += 1
        df[DIM] = n
        at = np.flatnonzero(df)
        yield pd.DataFrame({"i": at, "n": df[at]})

    out = np.zeros(DIM + 1)
    for r in texts.mapInPandas(partial, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        out[r["i"]] = r["n"]
    return int(out[DIM]), out[:DIM]


def ftrl(rows: list, y: np.ndarray, k: int) -> np.ndarray:
    z, s, w = np.zeros((DIM, k)), np.zeros((DIM, k)), np.zeros((DIM, k))
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            za, sa = z[at], s[at]
            wa = np.where(np.abs(za) <= L1, 0, -(za - np.sign(za) * L1) / ((BETA + np.sqrt(sa)) / ALPHA + L2))
            p = v @ wa
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = v[:, None] * p
            z[at] = za + g - (np.sqrt(sa + g * g) - np.sqrt(sa)) / ALPHA * wa
            s[at] = sa + g * g
    np.copyto(w, np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(s)) / ALPHA + L2)))
    return w


def train(docs: DataFrame, per_lang: int = PER_LANG):
    """(languages, idf, weights, temperature) from rows (doc_id, text, lang)."""
    rows = docs.filter("lang is not null and text is not null and doc_id is not null")
    n, df = frequencies(rows.select("text"))
    idf = np.log((1 + n) / (1 + df)) + 1
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    ids = rows.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(SALTS)).alias("salt"))
    for by in (["lang", "salt"], ["lang"]):  # a part of each language first, so that a frequent one is many tasks
        ids = ids.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("r") <= per_lang)
    some = rows.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "text", "lang")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [grams(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang": b["lang"], "at": [g[0] for g in got], "n": [g[1] for g in got]})

    got = some.mapInPandas(counted, "doc_id long, lang string, at array<long>, n array<double>").collect()
    got.sort(key=lambda r: (r["doc_id"], r["lang"], len(r["at"]), r["at"], r["n"]))
    langs = sorted({r["lang"] for r in got})
    x = [weighed(np.array(r["at"], np.int64), np.array(r["n"], float), idf) for r in got]
    y = np.array([langs.index(r["lang"]) for r in got], int)
    held = np.arange(len(x)) % 5 == 4
    w = ftrl([a for a, h in zip(x, held) if not h], y[~held], len(langs)) if langs else np.zeros((DIM, 0))
    logits = [v @ w[at] for (at, v), h in zip(x, held) if h]

    def loss(t):
        return sum(np.log(np.exp((z - z.max()) / t).sum()) - (z[c] - z.max()) / t for z, c in zip(logits, y[held]))

    return langs, idf, w, min(np.geomspace(0.05, 5, 40), key=loss) if logits else 1.0


def predict(docs: DataFrame, model) -> DataFrame:
    """docs with lang_pred and score."""
    langs, idf, w, temperature = model
    shared = docs.sparkSession.sparkContext.broadcast((langs, idf.astype(np.float32), w.astype(np.float32), float(temperature)))

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def guess(texts: pd.Series) -> pd.DataFrame:
        langs, idf, w, t = shared.value
        out = []
        for text in texts:
            at, v = weighed(*grams(text), idf)
            if not len(at) or not langs:
                out.append(("und", 0.0))
                continue
            z = (v @ w[at]) / t
            p = np.exp(z - z.max())
            out.append((langs[int(z.argmax())], float(p.max() / p.sum())))
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    return docs.withColumn("_g", guess("text")).select(*[c for c in docs.columns if c not in ("lang_pred", "score")], "_g.lang_pred", "_g.score")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = train(docs.filter(~out))
    return predict(docs.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "text"), model).drop("text")
