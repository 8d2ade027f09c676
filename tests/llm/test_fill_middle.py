import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from fieldspark.llm import fill_middle

TEXTS = [
    None, "", "a", " ", "ab cd", "a\n\nb", "é𝄞x𝄞𝄞 ß", "𝄞", "x𝄞", "has <P> inside", "has <S>", "<M>", "<", "<P", "P>", "a<b>c", "$", "line\n", "\r\n", "tail ", "Zz9zZ", "\x00\x01", "cóte",
    "word " * 3000, "x" * 40_000]


def expected(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_query_equals_brute_force_and_restores(spark, tmp_path):
    r = random.Random(3)
    texts = TEXTS + ["".join(r.choice("aB <>PSM\n.é𝄞") for _ in range(r.randrange(40))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(None, "null id, one two"), (7, texts[7]), (7, "another text of id 7")]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, n_units int, form string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = fill_middle.op11_fill_middle(spark, str(tmp_path)).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted((str(i), *map(str, expected(i, t)[:4]), sha(expected(i, t)[4]), sha(t or "")) for i, t in rows)
    assert sorted((str(x["doc_id"]), *[str(x[c]) for c in ("n", "form", "prefix_chars", "middle_chars")], x["output_sha256"], x["restored_sha256"]) for x in got) == want
    assert {x["form"] for x in got} == {"plain", "psm", "spm"}


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(fill_middle.SQL)
    got = fill_middle.op11_fill_middle(spark, sf)
    assert sorted(map(str, (tuple(x[c] for c in want.columns) for x in got.collect()))) == sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("grammar, regex", [
    (fill_middle.LETTERS, r"[A-Za-z]+|[^A-Za-z]"), (fill_middle.WORDS, r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+"), (fill_middle.CHARACTERS, r"[\s\S]"),
    (fill_middle.Units(("a-z", "0-9")), r"[a-z]+|[0-9]+|[^a-z0-9]")])
def test_every_grammar_splits_as_its_tokens(spark, grammar, regex):
    rows = spark.createDataFrame([(t,) for t in TEXTS if t is not None], "text string").withColumn("u", fill_middle.units_of(F.col("text"), grammar))
    assert all(x["u"] == re.findall(regex, x["text"]) for x in rows.collect())


def test_other_columns_stay_and_nothing_gives_nothing(spark):
    docs = spark.createDataFrame([(1, "a b", 9)], "doc_id long, text string, extra int")
    got = fill_middle.fill_middle(docs)
    assert got.columns == ["doc_id", "text", "extra", *fill_middle.ADDED] and got.first()["extra"] == 9
    assert fill_middle.fill_middle(docs.limit(0)).count() == 0
