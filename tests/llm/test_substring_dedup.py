import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fieldspark.llm import substring_dedup
from fieldspark.llm.substring_dedup import WINDOW


def brute(texts):
    """(words, removed, kept) of each text, by all windows."""
    docs = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for t in texts]
    count = Counter(tuple(d[i:i + WINDOW]) for d in docs for i in range(len(d) - WINDOW + 1))
    out = []
    for d in docs:
        gone = {j for i in range(len(d) - WINDOW + 1) if count[tuple(d[i:i + WINDOW])] > 1 for j in range(i, i + WINDOW)}
        out.append((len(d), len(gone), " ".join(w for i, w in enumerate(d) if i not in gone)))
    return out


def corpus(seed, n):
    r = random.Random(seed)
    fresh = lambda k: [f"w{r.randrange(10**6)}é" for _ in range(k)]
    passages = [fresh(r.randrange(30, 90)) for _ in range(6)] + [["x"] * 60, ["a", "b"] * 40, fresh(34), fresh(35), fresh(36)]
    texts = [None, "", "\n \t", "one", " ".join(fresh(34)), " ".join(["z"] * 35), " ".join(["q"] * 36)]
    for _ in range(n):
        words = []
        for _ in range(r.randrange(1, 6)):
            p = r.choice(passages)
            a = r.randrange(0, 12)
            words += fresh(r.randrange(30)) + (p[a:len(p) - r.randrange(0, 12)] if r.random() < 0.5 else p)
        texts.append(r.choice((" ", "\n", " \t\x0b")).join(words))
    long = fresh(3000)
    return texts + [" ".join(long), " ".join(fresh(5) + long[:1500] + ["other"] + long[1500:]), texts[-1], texts[-1], texts[-2]]


def answers(spark, tmp_path, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, n_words int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = substring_dedup.op13_substring_dedup(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted(str((x[0], n, k, sha(t))) for x, (n, k, t) in zip(rows, brute(texts)))
    return sorted(str(tuple(x)) for x in got.collect()), want


@pytest.mark.parametrize("group", [2000, 6, 1])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, group):
    """Also where nearly every group is too large and is split."""
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    got, want = answers(spark, tmp_path, corpus(group, 120))
    assert got == want and sum(", 0, " not in x for x in got) > 80


def test_null_and_repeated_ids(spark, tmp_path):
    texts = corpus(9, 20)
    ids = [None if i % 3 == 0 else -1 if i % 3 == 1 else i % 5 for i in range(len(texts))]
    got, want = answers(spark, tmp_path, texts, ids)
    assert got == want


def test_pieces_of_long_documents_have_the_anchors_of_the_whole(monkeypatch):
    r = random.Random(1)
    texts = [" ".join(r.choice("abc") + str(r.randrange(9)) for _ in range(n)) for n in (1000, 20, 35, 36, 400)]

    def found():
        out = []
        for lot in substring_dedup.lots(iter(texts)):
            sizes = [len(w) for _, _, w in lot]
            begins = np.concatenate([[0], np.cumsum(sizes)])
            memo = substring_dedup.Hashes()
            at, lo, hi, gram = substring_dedup.anchors(np.array([memo[w] for _, _, ws in lot for w in ws], np.uint64), np.repeat(begins[1:], sizes))
            k = np.searchsorted(begins, at, "right") - 1
            for x, i, a, b, g in zip(at, k, lo, hi, gram):
                out += [(lot[i][0], int(x - begins[i] + lot[i][1]), int(o), int(g)) for o in range(a, b + 1)]
        return sorted(out)

    whole = found()
    assert len(whole) == sum(max(0, len(t.split()) - WINDOW + 1) for t in texts)
    monkeypatch.setattr(substring_dedup, "LOT", 100)
    assert found() == whole


def test_spans_columns_and_nothing(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"a b {passage} c", 7), (2, f"{passage} d", 8)], "doc_id long, text string, spans int").withColumnRenamed("spans", "extra")
    got = {x["doc_id"]: x for x in substring_dedup.drop_repeats(docs).collect()}
    assert got[1]["kept"] == "a b c" and [tuple(s) for s in got[1]["spans"]] == [(2, 42)] and got[1]["extra"] == 7 and got[2]["kept"] == "d"
    assert substring_dedup.drop_repeats(docs.limit(0)).count() == 0


def test_forests_are_small_whatever_the_batch(monkeypatch):
    """A forest takes ROWS suffixes and the rest of the last group, though a batch brings many more."""
    seen, forest = [], substring_dedup.forest
    monkeypatch.setattr(substring_dedup, "forest", lambda group, *more: seen.append(len(group)) or forest(group, *more))
    n, span = 12_000, " ".join(f"w{i}" for i in range(WINDOW))
    batch = pa.RecordBatch.from_pydict({
        "group": np.arange(n) // 3, "lo": np.full(n, 5, np.int32), "hi": np.full(n, 5, np.int32), "copies": np.ones(n, np.int64), "span": [span] * n, "same": np.arange(n)})
    out = pa.Table.from_batches(list(substring_dedup._grown(iter([batch, batch.slice(0, 0)]))))
    assert out.num_rows == n == sum(seen) and set(out["mask"].to_pylist()) == {1} and max(seen) <= 5000 + substring_dedup.GROUP


def test_remembered_words_take_little_memory():
    tracemalloc.start()
    memo = substring_dedup.Hashes()
    for i in range(400_000):
        memo[f"word{i:07}".encode()]
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert size < 40e6


def test_query_hands_python_small_batches(spark, tmp_path, monkeypatch):
    """The batches of the query's own steps are small, and the session's setting is as before."""
    name, seen, written = "spark.sql.execution.arrow.maxRecordsPerBatch", [], substring_dedup.written
    monkeypatch.setattr(substring_dedup, "written", lambda *a: seen.append((a[1], int(spark.conf.get(name)))) or written(*a))
    got, want = answers(spark, tmp_path, corpus(3, 20))
    assert got == want and {"substring-anchors", "substring-spans", "substring-result"} <= {x for x, _ in seen} and max(n for _, n in seen) <= 512
    assert spark.conf.get(name) == "10000"
