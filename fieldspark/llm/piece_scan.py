"""SentencePiece encoding and decoding by a max-plus scan (operator 1).

Of all ways to cut a text into pieces, the library's merges give the one in which every two neighbours stay as they are when the
two alone are merged; a piece that does not survive alone never occurs. So a path over pieces is weighed by the sum of its
pieces' scores, minus infinity where two neighbours would merge otherwise, and one path alone, the library's, is left.

Texts of up to CHUNK code points are encoded at once. Longer ones are cut anywhere into chunks. The state at a cut is the piece that covers
the character before it (how far back it starts, how far on it ends), so a chunk is a matrix of scores from each state that the
text allows at its start to each at its end. Matrices are combined in max-plus, FAN at a time, level by level; the states at all
cuts follow on the way down, and every chunk is then traced back on its own. As the path is unique, ids do not depend on the chunks.
Where no piece holds a word mark after another character, every path passes there: between such places the library merges
pre-tokens, which are remembered, and only the ends of a chunk are walked; what is between them goes on as ids, merged once, and not as text.

Characters without a piece become their bytes and score `miss`, once. Null and empty texts have no ids and score 0; repeated rows and
ids repeat; an empty table gives an empty result; extra columns stay, but for `ids`, `score` and names that start with
`_scan`, which are taken.
"""
from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty, written
from .token_counts import LOT, MARK, MEMO, PRE, Words, ids_of_words, library, lots, model_bytes, plain_pieces, pre_tokens, splittable

CHUNK, FAN = 1 << 14, 256
NONE = -np.inf
MATRIX = "uid long, idx long, ins array<int>, outs array<int>, m array<double>"
STATES = "uid long, idx long, s_in int, s_out int"
INTS = pa.list_(pa.int32())
CHUNKS = pa.schema({"uid": pa.int64(), "idx": pa.int64(), "s": pa.string(), "start": pa.int32(), "n": pa.int32(), "at": pa.int32(), "middle": INTS, "ins": INTS, "outs": INTS, "m": pa.list_(pa.float64())})


class Pieces:
    def __init__(self, model: bytes, split: bool | None = None):
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto.FromString(model)
        self.sp = sp = library(model)
        m.normalizer_spec.add_dummy_prefix = False
        self.bare = library(m.SerializeToString())
        n, plain = sp.get_piece_size(), plain_pieces(sp)
        self.text = [sp.id_to_piece(i) for i in range(n)]
        alone = self.bare.encode([self.text[i].replace(MARK, " ") for i in plain])
        self.known = {self.text[i]: i for i, ids in zip(plain, alone) if ids == [i]}
        self.bytes = {i: int(self.text[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.miss = min(sp.get_score(i) for i in plain) - 10
        value = [sp.get_score(i) for i in range(n)]
        for i, b in self.bytes.items():  # a character without a piece counts once, at its first byte
            value[i] = self.miss if b & 0xC0 != 0x80 else 0.0
        self.value = np.array(value)
        self.longest = max(map(len, self.known))
        self.prefixes = {p[:k] for p in self.known for k in range(1, len(p) + 1)}
        self.split = splittable(model) if split is None else split
        self.words = Words(lambda new: [array("i", ids).tobytes() for ids in ids_of_words(self.sp, new)])
        self.pairs: dict[tuple[str, str], bool] = {}
        silent = {i for i in range(n) if sp.is_control(i)}
        self.shown = ["" if i in silent else " ⁇ " if sp.is_unknown(i) else t.replace(MARK, " ") for i, t in enumerate(self.text)]
        for i, b in self.bytes.items():
            if b < 0x80:  # a character by itself, whatever stands beside it
                self.shown[i] = chr(b)
        self.part = np.array([self.bytes.get(i, 0) >= 0x80 for i in range(n)])

    def score(self, ids) -> float:
        return float(self.value[ids].sum()) if len(ids) else 0.0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.split:
            return [np.array(ids, np.int32) for ids in self.sp.encode(texts, num_threads=1)]
        return [np.frombuffer(b"".join(ids), np.int32) for ids in self.words.values_of([pre_tokens(t) if t else [] for t in texts])]

    def ids_of(self, piece: str) -> list[int]:
        i = self.known.get(piece)
        return self.bare.encode(piece.replace(MARK, " ")) if i is None else [i]

    def follows(self, a: str, b: str) -> bool:
        """Whether pieces a, b stay as they are when merged alone; anything follows nothing."""
        if not a:
            return True
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            got = self.pairs[a, b] = self.bare.encode((a + b).replace(MARK, " ")) == self.ids_of(a) + self.ids_of(b)
        return got

    def ends(self, s: str, i: int) -> Iterator[int]:
        """Where pieces that start at i end; any single character is one."""
        for j in range(i + 1, len(s) + 1):
            piece = s[i:j]
            if j == i + 1 or piece in self.known:
                yield j
            if piece not in self.prefixes:
                return

    def walk(self, s: str, h: int, i: int, stop: int) -> dict[int, tuple[int, float]]:
        """From the piece s[h:i], place: (where its last piece starts, score of what starts at i and after); pieces start before stop."""
        at = {i: (h, 0.0)}
        for i in range(i, stop):
            if i in at:
                h, score = at[i]
                for j in self.ends(s, i):
                    if j not in at and self.follows(s[h:i], s[i:j]):
                        at[j] = i, score + self.score(self.ids_of(s[i:j]))
        return at

    def back(self, s: str, walked: dict, start: int, last: int, end: int) -> list[int]:
        """Ids of the pieces from start to the piece s[last:end]."""
        out = []
        while end > start:
            out.append(self.ids_of(s[last:end]))
            end = last
            last = walked[end][0]
        return [i for ids in reversed(out) for i in ids]

    def between(self, stretches: list[str]) -> list[np.ndarray]:
        """Ids of stretches, each between two places that every path passes."""
        words = [s[1:].split(MARK) if s and MARK * 2 not in s and s[-1] != MARK else [p[1:] for p in PRE.findall(s)] for s in stretches]
        return [np.frombuffer(b"".join(ids), np.int32) for ids in self.words.values_of(words)]

    def passes(self, s: str, start: int, end: int) -> tuple[int, int] | None:
        """First and last place after start and before end that every path passes."""
        first = re.compile(f"(?<=[^{MARK}]){MARK}").search(s, start + 1, end) if self.split else None
        if not first:
            return None
        at = s.rfind(MARK, 0, end)
        while s[at - 1] == MARK:
            at -= 1
        return first.start(), at

    def states(self, s: str, at: int) -> list[int]:
        """Codes of the pieces that cover the character before a cut; 0 at the start of a text."""
        if at == 0:
            return [0]
        width = self.longest + 1
        return sorted((at - i) * width + j - at for i in range(max(0, at - self.longest), at) for j in self.ends(s, i) if j >= at)

    def without_middles(self, chunks: list[tuple[str, int, int]]) -> list[tuple[str, int, int, int, np.ndarray]]:
        """(s, start, n, at, ids) of chunks: without what lies between the first and the last place that every path passes, its ids, and where it was; -1 for none."""
        cuts = [self.passes(s, start, start + n) for s, start, n in chunks]
        ids = iter(self.between([s[c[0]:c[1]] for (s, _, _), c in zip(chunks, cuts) if c]))
        return [(s[:c[0]] + s[c[1]:], start, n - c[1] + c[0], c[0], next(ids)) if c else (s, start, n, -1, np.zeros(0, np.int32)) for (s, start, n), c in zip(chunks, cuts)]

    def matrix(self, s: str, start: int, n: int, at: int | None = None, middle: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """States in, states out and the scores from each to each, for n characters of s from start; s has more around them."""
        if at is None:
            s, start, n, at, middle = self.without_middles([(s, start, n)])[0]
        width, end = self.longest + 1, start + n
        ins, rows = self.states(s, start), []
        outs_of = lambda at: {(end - i) * width + j - end: v for j, (i, v) in at.items() if i < end <= j}
        if at >= 0:
            mid, tail = self.score(middle), outs_of(self.walk(s, at, at, end))
        for code in ins:
            h, i = start - code // width, start + code % width
            if i >= end and code:
                rows.append({(end - h) * width + i - end: 0.0})
            elif at >= 0:
                head = self.walk(s, h, i, at).get(at)
                rows.append({o: head[1] + mid + v for o, v in tail.items()} if head else {})
            else:
                rows.append(outs_of(self.walk(s, h, i, end)))
        outs = sorted({o for r in rows for o in r})
        return np.array(ins), np.array(outs), np.array([[r.get(o, NONE) for o in outs] for r in rows])

    def ids(self, s: str, start: int, n: int, s_in: int, s_out: int, at: int | None = None, middle: np.ndarray | None = None) -> list[int]:
        """Ids of the pieces that start in the chunk, given the states at its ends."""
        if at is None:
            s, start, n, at, middle = self.without_middles([(s, start, n)])[0]
        width, end = self.longest + 1, start + n
        h, i = start - s_in // width, start + s_in % width
        last, stop = end - s_out // width, end + s_out % width
        if last < start:
            return []
        if at < 0:
            return self.back(s, self.walk(s, h, i, end), i, last, stop)
        head, tail = self.walk(s, h, i, at), self.walk(s, at, at, end)
        return self.back(s, head, i, head[at][0], at) + middle.tolist() + self.back(s, tail, at, last, stop)

    def decode(self, ids, begins: bool = True) -> str:
        """The text of ids; where a text begins with them, without the blank set before it. A character's bytes stay together in a chunk, so chunks decode apart."""
        ids = np.asarray(ids, np.int32)
        first, part = " " if begins else "", self.part[ids]
        if not part.any():
            return "".join(map(self.shown.__getitem__, ids.tolist())).removeprefix(first)
        out, run = [], bytearray()
        for i, is_part in zip(ids.tolist(), part.tolist()):
            if is_part:
                run.append(self.bytes[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(self.shown[i])
        out.append(run.decode("utf-8", "replace"))
        return "".join(out).removeprefix(first)


@lru_cache(1)
def pieces_of(model: bytes, split: bool) -> Pieces:
    """Made once in a worker process, which serves many tasks."""
    return Pieces(model, split)


def marked(text: str | None) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def chunks_of(pieces: Pieces, text: str, chunk: int) -> Iterator[tuple[str, int, int]]:
    """(s, start, n): n characters from start of s, with as many around them as a piece may have."""
    s = marked(text)
    for at in range(0, len(s), chunk):
        n, lead = min(chunk, len(s) - at), min(at, pieces.longest)
        yield s[at - lead:at + n + pieces.longest], lead, n


def product(a: tuple, b: tuple) -> tuple:
    """Max-plus product of (ins, outs, matrix); states that b lacks lead nowhere."""
    have = np.isin(a[1], b[0])
    left, right = a[2][:, have], b[2][np.searchsorted(b[0], a[1][have])]
    return a[0], b[1], (left[:, :, None] + right[None, :, :]).max(axis=1, initial=NONE)


def _unpacked(row) -> tuple:
    ins, outs = np.asarray(row.ins), np.asarray(row.outs)
    return ins, outs, np.asarray(row.m, float).reshape(len(ins), len(outs))


def combined(rows: pd.DataFrame) -> pd.DataFrame:
    """One matrix for up to FAN neighbours."""
    out = None
    for row in rows.sort_values("idx").itertuples():
        out = _unpacked(row) if out is None else product(out, _unpacked(row))
    return pd.DataFrame({"uid": [rows["uid"].iloc[0]], "idx": [rows["g"].iloc[0]], "ins": [out[0]], "outs": [out[1]], "m": [out[2].ravel()]})


def spread(group: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """The states of a group's two ends give those of its members."""
    rows = rows.sort_values("idx")
    ms, at, before = [_unpacked(r) for r in rows.itertuples()], None, []
    for ins, outs, m in ms:
        v = np.where(ins == group["s_in"].iloc[0], 0.0, NONE) if at is None else np.array([at.get(i, NONE) for i in ins])
        before.append(v)
        at = dict(zip(outs.tolist(), (v[:, None] + m).max(axis=0)))
    states = [int(group["s_out"].iloc[0])]
    for v, (ins, outs, m) in zip(reversed(before), reversed(ms)):
        states.append(int(ins[(v + m[:, np.searchsorted(outs, states[-1])]).argmax()]))
    states.reverse()
    return pd.DataFrame({"uid": rows["uid"].to_numpy(), "idx": rows["idx"].to_numpy(), "s_in": states[:-1], "s_out": states[1:]})


def _long(docs: DataFrame, model: bytes, chunk: int, split: bool) -> DataFrame:
    """uid, ids, score and back (what the ids decode to, chunk by chunk) of rows (uid, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, held, size = pieces_of(model, split), [], 0

        def batch() -> pa.RecordBatch:
            short = pieces.without_middles([x[2:] for x in held])
            columns = [*list(zip(*held))[:2], *zip(*short), *zip(*[(a, b, m.ravel()) for a, b, m in (pieces.matrix(*x) for x in short)])]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, CHUNKS.types)], schema=CHUNKS)

        for b in batches:
            for uid, text in zip(b["uid"].to_pylist(), b["text"]):
                for k, x in enumerate(chunks_of(pieces, text.as_py(), chunk)):
                    held.append((uid, k, *x))
                    size += x[2]
                    if size >= LOT:
                        yield batch()
                        held, size = [], 0
        if held:
            yield batch()

    def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = pieces_of(model, split)
        for b in batches:
            ids = [np.array(pieces.ids(*x), np.int32) for x in zip(b["s"], b["start"], b["n"], b["s_in"], b["s_out"], b["at"], b["middle"])]
            shown = [pieces.decode(i, k == 0) for i, k in zip(ids, b["idx"])]
            yield pd.DataFrame({"uid": b["uid"], "idx": b["idx"], "ids": ids, "score": [pieces.score(i) for i in ids], "back": shown})

    width = Pieces(model, split).longest + 1
    kinds = "uid long, idx long, s string, start int, n int, at int, middle array<int>, ins array<int>, outs array<int>, m array<double>"
    chunks = written(docs.mapInArrow(cut, kinds), "scan-chunks", "zstd")
    levels = [chunks.select("uid", "idx", "ins", "outs", "m")]
    while (levels[-1].agg(F.max("idx")).first()[0] or 0) > 0:
        up = levels[-1].withColumn("g", F.floor(F.col("idx") / FAN)).groupBy("uid", "g").applyInPandas(lambda p: combined(p), MATRIX)
        levels.append(written(up, "scan-level"))
    # a text begins in state 0 and ends with the one piece that reaches its end
    states = levels[-1].select("uid", "idx", F.lit(0).alias("s_in"), F.explode(F.arrays_zip("outs", "m")).alias("x"))
    states = states.filter((F.col("x.outs") % width == 0) & (F.col("x.m") > NONE)).select("uid", "idx", "s_in", F.col("x.outs").alias("s_out"))
    for rows in reversed(levels[:-1]):
        rows = rows.withColumn("g", F.floor(F.col("idx") / FAN))
        states = states.groupBy("uid", "idx").cogroup(rows.groupBy("uid", "g")).applyInPandas(lambda g, r: spread(g, r), STATES)
        states = written(states, "scan-states")
    parts = chunks.drop("ins", "outs", "m").join(states, ["uid", "idx"]).mapInPandas(back, "uid long, idx long, ids array<int>, score double, back string")
    whole = parts.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("idx", "ids", "back"))).alias("x"), F.sum("score").alias("score"))
    return whole.select("uid", F.flatten("x.ids").alias("ids"), "score", F.array_join("x.back", "").alias("back"))


def encode(docs: DataFrame, model: bytes | None = None, chunk: int = CHUNK, back: str | None = None) -> DataFrame:
    """docs with ids (array<int>), the library's own, and score (double); with the name `back`, a column of what the ids decode to, made in the same pass."""
    model = model or model_bytes()
    split = splittable(model)

    @F.arrow_udf("struct<ids:array<int>,score:double,back:string>")
    def at_once(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = pieces_of(model, split)
        for texts in batches:
            ids, scores, shown = [np.zeros(0, np.int32)], [], []
            for got in (got for lot in lots(t.as_py() for t in texts) for got in pieces.encode(lot)):
                ids.append(got)
                scores.append(pieces.score(got))
                shown.append(pieces.decode(got) if back else None)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(list(map(len, ids))), pa.int32()), pa.array(np.concatenate(ids)))
            yield pa.StructArray.from_arrays([lists, pa.array(scores, pa.float64()), pa.array(shown, pa.string())], ["ids", "score", "back"])

    is_long = F.length(text_or_empty()) >= chunk
    names = [c for c in docs.columns if c not in ("ids", "score", back)]
    more = ["_scan.ids", "_scan.score"] + ([F.col("_scan.back").alias(back)] if back else [])
    short = docs.filter(~is_long).withColumn("_scan", at_once("text")).select(*names, *more)
    long = written(docs.filter(is_long).select(*names).withColumn("_scan_uid", F.monotonically_increasing_id()), "scan-long", "zstd")
    got = _long(long.select(F.col("_scan_uid").alias("uid"), "text"), model, chunk, split).withColumnRenamed("uid", "_scan_uid")
    got = got.withColumnRenamed("back", back) if back else got.drop("back")
    return short.unionByName(long.join(got, "_scan_uid").select(*short.columns))


def decode(rows: DataFrame, model: bytes | None = None, name: str = "decoded") -> DataFrame:
    """Rows with ids, and their text in the column `name`; null ids give null."""
    model = model or model_bytes()
    split = splittable(model)

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = pieces_of(model, split)
        for lists in batches:
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)))
            out = [pieces.decode(flat[a:b]) for a, b in zip(ends, ends[1:])]
            yield pa.array(out, pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))

    return rows.withColumn(name, text("ids"))


def op1_piece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, score, ids_sha256 (ids in decimal, comma-joined) and round_trip: decoding gives the text, word marks read as blanks."""
    docs = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), back="decoded")
    ids = F.array_join("ids", ",")
    return docs.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "score", F.sha2(ids, 256).alias("ids_sha256"),
        (F.col("decoded") == F.translate(text_or_empty(), MARK, " ")).alias("round_trip"))
