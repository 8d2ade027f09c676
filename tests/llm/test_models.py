"""Fingerprints, toxicity, language and the pipeline: brute force, held-out accuracy, odd rows."""
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldspark.llm import fingerprints, language, secrets, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def edited(texts):
    """Each text with the last quarter replaced by the first as many characters of the next one."""
    nexts = texts[1:] + texts[:1]
    return [t[:len(t) - len(t) // 4] + n[:len(t) // 4] for t, n in zip(texts, nexts)]


def test_op3_against_brute_force(spark, tmp_path):
    r = random.Random(3)
    words = [f"w{i}" for i in range(800)]
    texts = [" ".join(r.choices(words, k=n)) for n in (400, 300, 3, 6, 4000)] + ["", None, "é☃ \U0001f9ff x", "same text here", "same text here"]
    ids = [5, 9, 2, 40, 41, 7, 100, 101, 102, 103]
    spark.createDataFrame([(i, t, "mine") for i, t in zip(ids, texts)], "doc_id long, text string, part string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x["doc_id"]: x for x in fingerprints.op3_fingerprints(spark, f"file://{tmp_path}").collect()}
    order = sorted(zip(ids, [t or "" for t in texts]))
    plain = [t for _, t in order]
    bags = lambda t: set(zip(*[t.lower().split()[k:] for k in range(5)])) or {t}
    like = lambda a, b: len(bags(a) & bags(b)) / len(bags(a) | bags(b))
    for (i, t), e, n in zip(order, edited(plain), plain[1:] + plain[:1]):
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert (got[i]["fingerprint"] == "") == (not t) and 0 <= got[i]["near_next"] <= 1
        if len(t) > 100:
            assert got[i]["near_edited"] == pytest.approx(like(t, e), abs=0.13) and got[i]["near_next"] == pytest.approx(like(t, n), abs=0.13)
    assert got[102]["fingerprint"] == got[103]["fingerprint"] and got[102]["near_next"] == 1.0


def test_fingerprint_likeness_is_unbiased(spark):
    rows = []
    for i in range(120):
        words = [f"a{i}x{j}" for j in range(300)]
        rows.append((" ".join(words), " ".join(words[:200] + [f"b{i}x{j}" for j in range(100)])))
    docs = spark.createDataFrame(rows, "a string, b string")
    got = docs.select(fingerprints.likeness(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))).alias("s")).agg(F.avg("s")).first()[0]
    assert got == pytest.approx(196 / 396, abs=0.015)


def test_with_next_of_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "n"), (1, "a"), (1, "a"), (2, "b"), (None, "m")], "doc_id long, text string")
    got = fingerprints.with_next(docs, ["text"], parts=3)
    assert got.count() == 5 and {x["next_text"] for x in got.filter("doc_id = 2").collect()} <= {"n", "m"}
    assert fingerprints.with_next(docs.limit(0), ["text"]).count() == 0


STEMS = ["lorg", "vantu", "trelk"]


def toxic_corpus(n, seed):
    """Texts of chance words; toxic ones hold some of three plain words or inflections of three stems."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(r.choices("aeioubcdfgst", k=r.randrange(3, 9))) for _ in range(r.randrange(40, 160))]
        bad = r.random() < 0.12
        if bad:
            for _ in range(r.randrange(1, 4)):
                word = r.choice(["vile", "rotten", "nasty"]) if r.random() < 0.5 else r.choice(STEMS) + "".join(r.choices("aeioust", k=r.randrange(1, 5)))
                words[r.randrange(len(words))] = word.title() if r.random() < 0.3 else word
        out.append((i, " ".join(words), int(bad), int(r.random() < 0.8)))
    return out


def test_toxicity_of_held_out_rows(spark):
    rows = toxic_corpus(2400, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    labels = [(i, q, b) for i, _, b, q in rows if i < 1800] + [(0, 1, 1), (0, 0, 0), (None, 1, 1), (5, None, 1)]
    models = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {x["doc_id"]: x for x in toxicity.score(docs, models).collect()}
    held = [(got[i]["is_toxic"], b) for i, _, b, _ in rows if i >= 1800]
    assert sum(p for p, b in held if b) >= 0.9 * sum(b for _, b in held)
    assert sum(p for p, b in held if not b) <= 0.01 * len(held)
    words = docs.filter("doc_id < 50").select("doc_id", toxicity.words_of(F.col("text")).alias("w")).collect()
    poor = models[0].predict([np.array(x["w"]) for x in words], np.zeros(len(words)))
    toxic = models[1].predict([np.array(x["w"]) for x in words], poor)
    assert [got[x["doc_id"]]["p_toxic"] for x in words] == pytest.approx(toxic.tolist())


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (None, "a b", "z")], "doc_id long, text string, p_toxic string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels))
    assert got.columns == ["doc_id", "text", "p_toxic", "p_poor", "is_toxic"] and got.count() == 3
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0


def sentences(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    parts = {"p": ["ta", "ko", "mi", "re"], "q": ["schu", "ung", "eit", "ver"], "r": ["ção", "inh", "lho", "os"]}[lang]
    return [" ".join("".join(r.choices(parts, k=r.randrange(1, 4))) for _ in range(r.randrange(2, 30))) for _ in range(n)]


def test_language_of_held_out_rows_and_of_texts_without_letters(spark, tmp_path):
    rows = [(t, lang) for lang in "pqr" for t in sentences(lang, 120, 1)] + [(None, "p"), ("", "q"), ("123 !?", "r")] + [("ta ko mi", None)]
    rows = [(i, t, lang) for i, (t, lang) in enumerate(rows)]
    rows += [rows[0], (None, "schuung eitver", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = language.op8_language(spark, f"file://{tmp_path}").collect()
    assert len(got) == len(rows)
    by = {x["doc_id"]: x for x in got}
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(360))
    held = [(by[i]["lang_pred"], lang) for i, _, lang in rows[:360] if by[i]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (360, 361, 362)) and by[None]["lang_pred"] == "q"


def test_language_keeps_columns_and_takes_nothing_from_nothing(spark):
    docs = spark.createDataFrame([(1, "abc", "mine")], "doc_id long, text string, lang_pred string")
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    got = language.predict(docs, language.train(empty)).collect()
    assert [(x["lang_pred"], x["score"]) for x in got] == [("und", 0.0)]


def test_pipeline_against_brute_force(spark, tmp_path):
    """Toxic rows go, of equal and of near texts one stays, secrets are masked, what is left is packed whole."""
    rows = toxic_corpus(500, 4)
    r = random.Random(9)
    clean = [t for _, t, b, _ in rows if not b]
    texts = [t for _, t, _, _ in rows]
    long = " ".join(f"u{r.randrange(9999)}" for _ in range(150)).split()
    near = " ".join(long[:70] + ["other"] + long[71:])
    extra = [clean[0], clean[0] + " ", " ".join(long), near, None, "", "the password: abcdefghijkl123 here"]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts + extra)]
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, q, b) for i, _, b, q in rows if i < 450], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    got = {x["doc_id"]: x for x in out}
    assert len(out) == len(got)
    n, first = len(texts), next(i for i, _, b, _ in rows if not b)
    kept_bad = sum(i in got for i, _, b, _ in rows if b)
    assert kept_bad <= 0.1 * sum(b for _, _, b, _ in rows)
    copies = {first, n, n + 1}
    assert len(copies & set(got)) == 1 and n + 1 in got  # the longest of equal texts
    assert sum(i in got for i, _, b, _ in rows if not b and i != first) >= 0.99 * (len(clean) - 1)
    assert len({n + 2, n + 3} & set(got)) == 1 and len({n + 4, n + 5} & set(got)) == 1
    assert got[n + 6]["text"] == "the [assign] here" and got[n + 6]["n_tokens"] > 3
    assert {x["bucket"] - x["n_tokens"] - x["padding"] for x in out} == {0}


def test_redact_keeps_null_texts_and_needs_no_n_chars(spark):
    docs = spark.createDataFrame([(1, None), (2, "token=abcdefghijklmno9 x")], "doc_id long, text string")
    assert [x["text"] for x in secrets.redact(docs).orderBy("doc_id").collect()] == [None, "[assign] x"]
    assert secrets.scan(docs.limit(0)).count() == 0
