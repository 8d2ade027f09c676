"""Substring dedup by prefix-partitioned suffix trees (operator 13).

A window is WINDOW consecutive words of one document; a word goes when a window over it occurs anywhere else too. Windows hang on a part of the suffixes:

1. Of the WINDOW - KEY + 1 stretches of KEY words inside a window the one with the least hash, the first of equal ones, is the window's anchor. It depends on the
   window's words alone, so equal windows have it at the same offset, and neighbouring windows share it. A suffix is kept per anchor, about one
   in fourteen, with the words that its windows span; one whose first KEY words occur nowhere else is dropped before any text moves.
2. Suffixes are split into groups by a prefix: the words that all windows of a range of offsets share. At first the range is all offsets and the
   prefix the KEY words of the anchor. A group of more than GROUP different suffixes has its range cut in half, which makes the prefix longer, until
   groups are small; a range of one offset has the whole window as its prefix, so that all its members are equal and are counted, never gathered.
3. In each group the tree of the suffixes from the anchor on is built level by level, and one of the words before the anchor, backwards. A window of offset o
   repeats when the node at depth WINDOW - o of the one and the node at depth o of the other share two leaves: they are the deep nodes, and
   their windows side by side make the maximal repeats.
4. Windows that repeat go back to their documents and become spans of words.

Words are compared as words; hashes only bring together what may be equal. Words are runs of characters other than ASCII blanks. Null and empty texts have no
words; rows that repeat an id and text repeat each other; documents of any length are read in pieces; ids may be null or repeat; an empty
table gives an empty result; other columns stay, but those named in ADDED are overwritten and names that start with `_sub_` are taken.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SALTS, cleaned, dealt, forget, salt_of, salts_used, small_batches, table, text_or_empty, written

WINDOW, KEY, GROUP = 35, 8, 2000
OFFSETS = WINDOW - KEY + 1
LOT, ROWS, MEMO, PLACE = 1 << 17, 5000, 1 << 17, 24  # words of a lot, suffixes of a forest, words remembered, bits of a place in a lot
ADDED = ("n_words", "n_removed", "spans", "kept")
ID = ["_sub_id", "_sub_hash"]
ODD = 0x9E3779B97F4A7C15


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes are split at ASCII blanks alone


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def anchors(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, least and greatest offset of its windows, hash of its KEY words) of the anchors of words with these hashes; `ends` of their documents."""
    n = len(hashes)
    if n < WINDOW:
        return (np.zeros(0, np.int64),) * 4
    power = lambda b: np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n - 1, b, np.uint64))])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power(ODD))])
    key = mixed((sums[KEY:] - sums[:-KEY]) * power(pow(ODD, -1, 1 << 64))[:n - KEY + 1])
    low = np.uint64((1 << PLACE) - 1)
    least, width = key & ~low | np.arange(len(key), dtype=np.uint64), 1
    while width * 2 <= OFFSETS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < OFFSETS:
        least = np.minimum(least[:width - OFFSETS], least[OFFSETS - width:])
    start = np.flatnonzero(np.arange(len(least)) + WINDOW <= ends[:len(least)])
    at = (least[start] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(at))[:len(first)] - 1
    at, begin, end = at[first], start[first], start[last]
    return at, at - end, at - begin, key[at].view(np.int64)


def lots(texts: Iterator[str | None]) -> Iterator[list[tuple[int, int, list[bytes]]]]:
    """(row, first word, words) of documents, long ones in pieces whose windows are apart, up to about LOT words at a time."""
    held, n = [], 0
    for row, text in enumerate(texts):
        words = words_of(text)
        for a in range(0, max(1, len(words) - WINDOW + 1), LOT):
            held.append((row, a, words[a:a + LOT + WINDOW - 1]))
            n += len(held[-1][2])
            if n >= LOT:
                yield held
                held, n = [], 0
    if held:
        yield held


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = Hashes()
    for b in batches:
        for lot in lots(t.as_py() for t in b["text"]):
            sizes = np.array([len(w) for _, _, w in lot])
            begins = np.concatenate([[0], np.cumsum(sizes)])
            hashes = np.fromiter((memo[w] for _, _, words in lot for w in words), np.uint64, begins[-1])
            at, lo, hi, gram = anchors(hashes, np.repeat(begins[1:], sizes))
            piece = np.searchsorted(begins, at, "right") - 1
            rows, firsts = np.array([r for r, _, _ in lot]), np.array([a for _, a, _ in lot])
            owner = pa.array(rows[piece])
            yield pa.RecordBatch.from_arrays(
                [b[ID[0]].take(owner), b[ID[1]].take(owner), pa.array(at - begins[piece] + firsts[piece], pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(gram, pa.int64())],
                [*ID, "at", "lo", "hi", "gram"])


def _spanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words that the windows of every suffix span."""
    kind = {**{c: pa.int64() for c in ID}, "at": pa.int64(), "lo": pa.int32(), "hi": pa.int32(), "gram": pa.int64(), "span": pa.string()}
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kind.values())], list(kind))

    for b in batches:
        for own, other, text, found in zip(b[ID[0]].to_pylist(), b[ID[1]].to_pylist(), b["text"], b["found"]):
            words = words_of(text.as_py())
            for x in found.as_py():
                at, lo, hi = x["at"], x["lo"], x["hi"]
                held.append((own, other, at, lo, hi, x["gram"], b" ".join(words[at - hi:at - lo + WINDOW]).decode()))
                if len(held) >= ROWS:
                    yield batch()
                    held.clear()
    if held:
        yield batch()


def _ids(*parts: np.ndarray) -> np.ndarray:
    """Dense numbers for equal tuples."""
    out = parts[0]
    for p in parts[1:]:
        out = np.unique(out * (int(p.max()) + 1) + p, return_inverse=True)[1]
    return out


def forest(group: np.ndarray, lo: np.ndarray, hi: np.ndarray, copies: np.ndarray, spans: list[bytes]) -> np.ndarray:
    """A bit per window of each suffix, from its first: whether it repeats within the suffix's group."""
    rows = [s.split() for s in spans]
    code: dict[bytes, int] = {}
    flat = np.array([code.setdefault(w, len(code) + 1) for r in rows for w in r], np.int64)
    begin = np.concatenate([[0], np.cumsum([len(r) for r in rows])])[:-1] + hi
    word = lambda step, there: np.where(there, flat[np.clip(begin + step, 0, len(flat) - 1)], 0)
    after, before = [group], [group]
    for depth in range(WINDOW):
        after.append(_ids(after[-1], word(depth, depth < WINDOW - lo)))
    for depth in range(OFFSETS - 1):
        before.append(_ids(before[-1], word(-1 - depth, depth < hi)))
    out = np.zeros(len(rows), np.int64)
    for o in range(OFFSETS):
        own = np.flatnonzero((lo <= o) & (o <= hi))
        if len(own):
            node = _ids(after[WINDOW - o][own], before[o][own])
            leaves = np.bincount(node, copies[own])
            out[own] |= np.where(leaves[node] > 1, np.int64(1) << (hi[own] - o), 0)
    return out


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group, with the windows that repeat (`mask`), where there is one. Groups are small, and many are one forest."""

    def marked(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        number = lambda c: t[c].to_numpy().astype(np.int64)
        key = number("group")
        mask = forest(np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])), number("lo"), number("hi"), number("copies"), [s.as_py().encode() for s in t["span"]])
        out = t.drop_columns(["group", "copies", "span", "lo"]).append_column("mask", pa.array(mask))
        yield from out.filter(pa.array(mask != 0)).combine_chunks().to_batches()

    held = None
    for b in (b.slice(a, ROWS) for b in batches for a in range(0, b.num_rows, ROWS)):
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        key = t["group"].to_numpy()
        last = int(np.argmax(key == key[-1])) if len(key) >= ROWS else 0  # the last group may go on
        yield from marked(t.slice(0, last))
        held = t.slice(last)
    if held is not None:
        yield from marked(held)


def _trees(suffixes: DataFrame, carried: str) -> DataFrame:
    """hi, mask and the columns `carried` of suffixes (group, lo, hi, copies, span) of which a window repeats in its group."""
    names = [c.split()[0] for c in carried.split(", ")]
    rows = suffixes.select("group", "lo", "hi", "copies", "span", *names).repartition("group").sortWithinPartitions("group")
    return rows.mapInArrow(_grown, f"hi int, {carried}, mask long")


ROOT = ["root", "root_same", "root_hi"]


def _halves(level: DataFrame) -> DataFrame:
    """Suffixes of groups (a, b: their range of offsets) in groups of half the range each, under the longer prefix."""
    mid = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    parts = F.array(F.struct(F.col("a").alias("a"), mid.alias("b")), F.struct((mid + 1).alias("a"), F.col("b").alias("b")))
    out = level.withColumn("r", F.explode(parts)).withColumn("lo2", F.greatest("lo", "r.a")).withColumn("hi2", F.least("hi", "r.b")).filter("lo2 <= hi2")
    words = F.split("span", " ")
    cut = lambda start, n: F.array_join(F.slice(words, start.cast("int"), n.cast("int")), " ")
    out = out.withColumn("prefix", cut(F.col("hi") - F.col("r.a") + 1, WINDOW - F.col("r.b") + F.col("r.a")))
    out = out.withColumn("span", cut(F.col("hi") - F.col("hi2") + 1, WINDOW + F.col("hi2") - F.col("lo2")))
    return out.select(*ROOT, F.xxhash64("group", "r.a", "r.b", "prefix").alias("group"), F.col("r.a").alias("a"), F.col("r.b").alias("b"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), "span", "copies", "salt")


def _counted(rows: DataFrame, copies) -> DataFrame:
    """Equal suffixes of a group as one: group, same, lo, hi, span, copies and the salts of their rows."""
    return rows.groupBy("group", "same", "lo", "hi", "span").agg(copies.alias("copies"), salts_used().alias("salts"))


def _repeating(suffixes: DataFrame) -> DataFrame:
    """Windows that repeat (ID, at, hi, mask) of suffixes (ID, at, lo, hi, group, same, salt, span): equal ones are counted and go on as one, groups that stay large are split further."""
    roots = written(_counted(suffixes, F.count(F.lit(1))), "substring-roots", "zstd")
    cleaned(suffixes.sparkSession)
    level = roots.select(F.col("group").alias("root"), F.col("same").alias("root_same"), F.col("hi").alias("root_hi"), "group", "same", F.lit(0).alias("a"), F.lit(OFFSETS - 1).alias("b"), "lo", "hi", "span", "copies")
    level, each, out, deals = level.withColumn("salt", salt_of("same")), roots, None, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    while True:
        each = each.withColumn("salt", salt_of("same"))
        large = written(each.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP).select("group"), "substring-large", "zstd")
        none_large = large.isEmpty()
        small = each if none_large else each.join(large.withColumn("salt", deals), ["group", "salt"], "left_anti")
        masks = _trees(small.withColumn("own", F.col("group")), "own long, same long, salts long").drop("hi").withColumnRenamed("own", "group")
        if out is None:  # the roots themselves
            out = masks.select(F.col("group").alias("root"), F.col("same").alias("root_same"), "mask")
        else:
            out = out.unionByName(level.join(dealt(masks), ["group", "same", "salt"]).select("root", "root_same", F.expr("shiftleft(mask, root_hi - hi)").alias("mask")))
        if none_large:
            break
        level = _halves(level.join(large.withColumn("salt", deals), ["group", "salt"], "left_semi"))
        level = written(level.withColumn("same", F.xxhash64("span", "hi")), "substring-level", "zstd")
        each = written(_counted(level, F.sum("copies")), "substring-each", "zstd")
    whole = out.groupBy("root", "root_same").agg(F.bit_or("mask").alias("mask")).withColumnsRenamed({"root": "group", "root_same": "same"})
    return suffixes.join(dealt(roots.select("group", "same", "salts").join(whole, ["group", "same"])), ["group", "same", "salt"]).select(*ID, "at", "hi", "mask")


def identified(docs: DataFrame) -> DataFrame:
    """docs with what tells rows apart: equal rows, and rows of no id and -1, have equal texts and so equal spans."""
    return docs.withColumn(ID[0], F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))).withColumn(ID[1], F.xxhash64(text_or_empty()))


def repeats(rows: DataFrame) -> DataFrame:
    """ID and windows (array of start and mask: a bit per window from there that repeats) of rows (ID, text) with any."""
    text = rows.select(*ID, "text")
    all_ = text.mapInArrow(_anchored, ", ".join(f"{c} long" for c in ID) + ", at long, lo int, hi int, gram long").withColumn("salt", salt_of(*ID, "at"))
    all_ = written(all_, "substring-anchors", "zstd")
    twice = all_.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), salts_used().alias("salts")).filter("n > 1")
    again = all_.join(dealt(twice), ["gram", "salt"])
    again = again.groupBy(*ID).agg(F.collect_set(F.struct("at", "lo", "hi", "gram")).alias("found"))
    spanned = text.join(again, ID).mapInArrow(_spanned, ", ".join(f"{c} long" for c in ID) + ", at long, lo int, hi int, gram long, span string")
    spanned = spanned.withColumnRenamed("gram", "group").withColumn("same", F.xxhash64("span", "hi")).withColumn("salt", salt_of(*ID, "at"))
    spanned = written(spanned, "substring-spans", "zstd")
    forget(all_)
    cleaned(rows.sparkSession)
    found = _repeating(spanned)
    windows = found.groupBy(*ID).agg(F.collect_set(F.struct((F.col("at") - F.col("hi")).alias("start"), "mask")).alias("windows"))
    windows = written(windows, "substring-windows", "zstd")
    forget(spanned)
    cleaned(rows.sparkSession)
    return windows


def _left(words: list[bytes], windows: list[dict] | None) -> tuple[list[bytes], list[tuple[int, int]]]:
    """The words that stay, and the spans that go."""
    if not windows:
        return words, []
    start, mask = np.array([w["start"] for w in windows]), np.array([w["mask"] for w in windows])
    row, bit = np.nonzero(mask[:, None] >> np.arange(OFFSETS) & 1)
    at = start[row] + bit
    cover = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + WINDOW, minlength=len(words) + 1)
    gone = np.cumsum(cover)[:-1] > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    return [w for w, g in zip(words, gone.tolist()) if not g], list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """docs with n_words, n_removed, spans (array of start and end, in words) of what repeats, and kept, the other words joined by a space."""
    rows = identified(docs.drop(*ADDED))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf("struct<n_words:long,n_removed:long,spans:array<struct<start:long,end:long>>,kept:string>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, windows in batches:
            got = []
            for t, w in zip(texts, windows):
                words = words_of(t.as_py())
                kept, spans = _left(words, w.as_py())
                got.append((len(words), len(words) - len(kept), [{"start": a, "end": b} for a, b in spans], b" ".join(kept).decode()))
            columns = list(zip(*got)) or [[]] * 4
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), kind, pa.string()))], list(ADDED))

    out = rows.join(repeats(rows), ID, "left").withColumn("_sub_cut", cut("text", "windows"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ADDED], *[F.col("_sub_cut")[c].alias(c) for c in ADDED])


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with small_batches(spark):
        out = drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
        return written(out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")), "substring-result", "zstd")
