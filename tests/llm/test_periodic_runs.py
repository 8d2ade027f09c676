import hashlib
import random
import re
import zlib

import pytest

from fieldspark.llm import periodic_runs
from fieldspark.llm.periodic_runs import Lot


def brute(words, least, exponent):
    """All runs by trying every period."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= (exponent - 1) * q and j + q - i >= least:
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, size, q) for (s, size), q in found.items())


def by_document(docs, least, exponent):
    lot = Lot(docs)
    out = [[] for _ in docs]
    for s, size, q in lot.runs(least, exponent):
        d = max(i for i in range(len(docs)) if lot.starts[i] <= s and docs[i])
        out[d].append((s - int(lot.starts[d]), size, q))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_runs_of_random_words(seed):
    r = random.Random(seed)
    docs = []
    for _ in range(120):
        kind, n = r.randrange(4), r.randrange(0, 120)
        if kind == 0:
            words = [r.choice("ab") for _ in range(n)]
        elif kind == 1:
            words = [r.choice("abcd") for _ in range(n)]
        elif kind == 2:  # nested and broken repetitions
            words = []
            while len(words) < n:
                base = [r.choice("abc") for _ in range(r.randrange(1, 7))]
                words += (base * r.randrange(1, 8))[:r.randrange(1, 40)]
        else:  # a stretch with repetitions inside, copied with overlaps
            base = [r.choice("ab") for _ in range(r.randrange(1, 30))] + ["x"] * r.randrange(0, 9)
            words = base * r.randrange(1, 5) + [r.choice("ab")] + base
        docs.append(words)
    for least, exponent in ((3, 3), (24, 3), (8, 4)):
        assert by_document(docs, least, exponent) == [brute(d, least, exponent) for d in docs]


def test_runs_of_fibonacci_words_and_of_one_word():
    a, b = ["a"], ["a", "b"]
    for _ in range(10):
        a, b = b, b + a
    for words in (b, ["x"] * 500, (["x"] * 40 + ["y"]) * 6, (["a", "b"] * 20 + ["c"]) * 9):
        assert by_document([words], 3, 3) == [brute(words, 3, 3)]


def test_a_very_long_periodic_text():
    r = random.Random(2)
    base = [str(r.randrange(10**9)) for _ in range(20_000)]
    words = [str(r.randrange(10**9)) for _ in range(5_000)] + base * 3 + base[:77] + ["end"] + ["a", "b"] * 30_000
    assert Lot([words]).runs() == [(5_000, 60_077, 20_000), (65_078, 60_000, 2)]


def altered(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def expected(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    words = words if doc_id is None else altered(doc_id, words)
    runs = brute(words, 24, 3)
    drop = {i for s, size, q in runs for i in range(s + q, s + size)}
    top = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda x: (x[0], x[2])))), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_query_equals_brute_force(spark, tmp_path, monkeypatch):
    r = random.Random(5)
    texts = [None, "", " \n", "one", "a b   c" * 40, "x\x1cy " * 30, "a b\tc\nd\x0be\x0cf\r" * 20]
    for _ in range(250):
        words = [r.choice("abcdefgh") + r.choice("xyzé𝄞") for _ in range(r.randrange(150))]
        at = r.randrange(len(words) + 1)
        texts.append(r.choice((" ", "\n", " \t ")).join(words[:at] + words[at:at + r.randrange(1, 9)] * r.randrange(12) + words[at:]))
    rows = [(i, t, 1, "r") for i, t in enumerate(texts)] + [(None, "a " * 50, 1, "r"), (30, texts[30], 2, "s"), (30, texts[31], 2, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, n_words int, runs string").write.parquet(str(tmp_path / "documents.parquet"))
    got = periodic_runs.op12_periodic_runs(spark, str(tmp_path))
    columns = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert got.columns == list(columns)
    got.write.parquet(str(tmp_path / "out"))
    got = sorted(map(str, (tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).collect())))
    assert got == sorted(str(expected(x[0], x[1])) for x in rows)
    assert sum("None" not in x for x in got) > 60


def test_other_columns_stay_and_nothing_gives_nothing(spark):
    docs = spark.createDataFrame([(1, "a b " * 20 + "c", 9)], "doc_id long, text string, extra int")
    got = periodic_runs.periodic_runs(docs)
    assert got.columns == ["doc_id", "text", "extra", *periodic_runs.ADDED]
    row = got.first()
    assert (row["extra"], row["n_words"], row["collapsed"]) == (9, 41, "a b c") and [tuple(x) for x in row["runs"]] == [(0, 40, 2)]
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
