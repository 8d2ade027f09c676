import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from fieldspark.llm import piece_scan, token_counts


@pytest.fixture(scope="module", params=[True, False], ids=["split", "whole"])
def pieces(request):
    """With and without the places that every path passes."""
    return piece_scan.Pieces(token_counts.model_bytes(), request.param)


@pytest.fixture(scope="module")
def library():
    return token_counts.library(token_counts.model_bytes())


ODD = ["", " ", "a", "Hello  world 日本語 \x00 x", "ünïcode ☃ \U0001f9ff", "thequickbrownfoxjumpsoverthelazydog", "a▁b", "<s>x</s>", "tab\tline\n", "        x         "]
ALPHABETS = ["abcdethe ", "internationalisation of 日本☃ ", "  a▁b", "aab", "   ", "0123 .,;:!?-_/=+", "ünïcodé ß éàç", "<s></s>\n\t\x00"]


@pytest.mark.parametrize("text", ODD)
def test_equals_the_library(pieces, library, text):
    ids = list(pieces.encode([text])[0])
    assert ids == library.encode(text)
    assert pieces.decode(np.array(ids, np.int32)) == text.replace("▁", " ") == library.decode(ids)


def scanned(pieces, text, chunk):
    """Ids and score by chunks, without Spark."""
    parts = list(piece_scan.chunks_of(pieces, text, chunk))
    ms, out = [pieces.matrix(*p) for p in parts], None
    for m in ms:
        out = m if out is None else piece_scan.product(out, m)
    ends = [(o, v) for o, v in zip(out[1], out[2][0]) if o % (pieces.longest + 1) == 0 and v > piece_scan.NONE]
    assert len(ends) == 1
    rows = pd.DataFrame({"uid": 0, "idx": range(len(ms)), "ins": [m[0] for m in ms], "outs": [m[1] for m in ms], "m": [m[2].ravel() for m in ms]})
    states = piece_scan.spread(pd.DataFrame({"s_in": [0], "s_out": [ends[0][0]]}), rows)
    return [i for p, a, b in zip(parts, states["s_in"], states["s_out"]) for i in pieces.ids(*p, a, b)], ends[0][1]


@pytest.mark.parametrize("chunk", range(1, 21))
def test_ids_do_not_depend_on_the_chunks(pieces, library, chunk):
    r = random.Random(chunk)
    for alphabet in ALPHABETS:
        for _ in range(6):
            text = "".join(r.choice(alphabet) for _ in range(r.randrange(1, 90)))
            ids, score = scanned(pieces, text, chunk)
            assert ids == library.encode(text) and score == pytest.approx(pieces.score(ids))


@pytest.mark.parametrize("text", ["the☃en", "ab\U0001f9ff in", "tin can", "aaaaa", "日本語のx"])
def test_one_path_alone_is_left(pieces, library, text):
    """Of all ways to cut a text into pieces one has neighbours that stay as they are when merged alone."""
    s = piece_scan.marked(text)

    def every(i, h):
        if i == len(s):
            yield []
        for j in pieces.ends(s, i):
            if pieces.follows(s[h:i], s[i:j]):
                yield from (pieces.ids_of(s[i:j]) + more for more in every(j, i))

    assert list(every(0, 0)) == [library.encode(text)]


def test_product_is_associative():
    r = np.random.default_rng(3)
    at = np.arange(5)
    a, b, c = ((at, at, np.where(r.random((5, 5)) < 0.3, -np.inf, r.integers(-9, 9, (5, 5)))) for _ in range(3))
    left, right = piece_scan.product(piece_scan.product(a, b), c), piece_scan.product(a, piece_scan.product(b, c))
    assert all((x == y).all() for x, y in zip(left, right))


def test_chunks_in_spark(spark, library, monkeypatch):
    r = random.Random(5)
    texts = [None, *ODD] + ["".join(r.choice("abcde the日☃ ") for _ in range(n)) for n in (5, 15, 16, 17, 200, 900)] + ["x" * 300]
    rows = [(i, t, "extra", "taken") for i, t in enumerate(texts)] + [(16, texts[16], "extra", "taken")]
    monkeypatch.setattr(piece_scan, "FAN", 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string, uid string, ids string")
    got = piece_scan.decode(piece_scan.encode(docs, chunk=16)).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x["ids"] == (library.encode(x["text"]) if x["text"] else []) and x["decoded"] == (x["text"] or "").replace("▁", " ") and x["uid"] == "extra"
    assert piece_scan.encode(docs.limit(0)).count() == 0


def test_null_ids_give_null(spark):
    rows = spark.createDataFrame([([305], 1), (None, 2), ([], 3), ([2], 4)], "ids array<int>, k int")
    text = token_counts.library(token_counts.model_bytes()).id_to_piece(305).replace("▁", " ").removeprefix(" ")
    assert {x["k"]: x["decoded"] for x in piece_scan.decode(rows).collect()} == {1: text, 2: None, 3: "", 4: ""}


def test_op1_gives_the_ids_of_the_library(spark, tmp_path, library):
    """Texts longer than a chunk, with and without a break, are scanned."""
    r = random.Random(7)
    texts = [None, *ODD, "the tin can", "  two  blanks ", "word " * 3] + ["".join(r.choice("abcde the日☃ ") for _ in range(n)) for n in (50, 900)]
    texts += ["".join(r.choice(a) for _ in range(piece_scan.CHUNK * 2 + 99)) for a in ("abcdethe日☃", "abcde the日☃ ")]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x["doc_id"]: x for x in piece_scan.op1_piece_scan(spark, f"file://{tmp_path}").collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text) if text else []
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and got[i]["n_tokens"] == len(ids)
        assert got[i]["round_trip"] or "\x00" in text


def test_each_chunk_is_merged_once(pieces, library):
    """What lies between the places that every path passes is not merged again when a chunk is traced back."""
    text = "the quick brown fox, 日本 ☃ jumps over  the lazy dog and " * 6 + "end"
    parts = pieces.without_middles(list(piece_scan.chunks_of(pieces, text, 100)))
    assert all(at < 0 for *_, at, _ in parts) or pieces.split and sum(len(s) for s, *_ in parts) < len(text)
    pieces.words.of = None  # nothing may ask for a word again
    try:
        ms, out = [pieces.matrix(*p) for p in parts], None
        for m in ms:
            out = m if out is None else piece_scan.product(out, m)
        end = next(o for o, v in zip(out[1], out[2][0]) if o % (pieces.longest + 1) == 0 and v > piece_scan.NONE)
        rows = pd.DataFrame({"uid": 0, "idx": range(len(ms)), "ins": [m[0] for m in ms], "outs": [m[1] for m in ms], "m": [m[2].ravel() for m in ms]})
        states = piece_scan.spread(pd.DataFrame({"s_in": [0], "s_out": [end]}), rows)
        got = [i for (s, start, n, at, middle), a, b in zip(parts, states["s_in"], states["s_out"]) for i in pieces.ids(s, start, n, a, b, at, middle)]
    finally:
        pieces.words = piece_scan.Pieces(token_counts.model_bytes(), pieces.split).words
    assert got == library.encode(text)


def test_words_are_merged_in_small_parts():
    """Many lists of ids alive at once make Python's collector pass over them again and again."""
    asked = []

    class Model:
        def piece_to_id(self, piece):
            return 7

        def encode(self, words, num_threads):
            asked.append(len(words))
            return [[len(w)] for w in words]

    words = ["", *(f"w{i}" for i in range(2000))]
    assert list(token_counts.ids_of_words(Model(), words)) == [[7], *([len(w)] for w in words[1:])] and max(asked) <= 256


@pytest.mark.parametrize("ids_of", [[0xC3], [0xC3, 0x41], [0xE6, 0x97, 0xA5, 0x0A, 0x80], [0x0A, 0xF0, 0x9F, 0x0A, 0x0A], [0x00, 0xC3, 0xA9]])
def test_bytes_decode_as_the_library_decodes_them(pieces, library, ids_of):
    back = {b: i for i, b in pieces.bytes.items()}
    ids = [305, *(back[b] for b in ids_of), 305]
    assert pieces.decode(ids, False) == pieces.shown[305] + bytes(ids_of).decode("utf-8", "replace") + pieces.shown[305]
