"""Periodic runs of words by longest previous factors (operator 12).

A run is a stretch of words with smallest period q, at least `exponent` (3 or more) times q and `least` words long, that neither neighbour extends. Documents
are worked on in lots of about LOT words, with numpy over a whole lot:

1. Ranks of all stretches of 1, 2, 4, ... words, by doubling; only places that are not alone in their class are sorted again. A word of one document is
   never equal to one of another, so a lot is as good as its documents. The last ranks give the suffix array, all of them the LCPs.
2. Longest previous factors, by taking suffixes out of the suffix array from the last place to the first. Only factors of two words and more count, so
   suffixes without a neighbour that shares two words are left out. They give the blocks of the Lempel-Ziv factorisation.
3. Main's extensions: a run that touches the start b of a block has (exponent - 1) * q less than the words of this block and the one before, and
   either word b or word b - q - 1 is equal to the word q further on. Each such pair is extended both ways by the ranks.
4. All other runs lie strictly inside a block, so they are copies of runs inside its earlier occurrence: runs are kept in buckets by their start, and
   a block copies those of its source from left to right, the copies among them where both overlap.

Words are runs of characters other than ASCII blanks. Null and empty texts have no words and no runs; repeated rows give repeated results; a document
of any length is one lot at least; of runs of equal exponent the first, then the one of the shortest period is the top; an empty table gives
an empty result; other columns stay, but those named in ADDED are overwritten.
"""
from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, text_or_empty

LEAST, EXPONENT, LOT = 24, 3, 1 << 18
ADDED = ("n_words", "runs", "collapsed")
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def codes_of(words: list) -> list[int]:
    """Equal numbers for equal words."""
    last = dict(zip(words, range(len(words))))
    return [last[w] for w in words]


class Lot:
    """The words of several documents as one sequence; no stretch of one equals a stretch of another."""

    def __init__(self, docs: list[list]):
        sizes = np.array([len(d) for d in docs], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.n = n = int(self.starts[-1])
        codes = np.empty(n, np.int64)
        for at, d in zip(self.starts, docs):
            codes[at:at + len(d)] = codes_of(d)
        self.ends = np.repeat(self.starts[1:], sizes)  # of each place's document
        self.ranks = self._doubled(codes + np.repeat(self.starts[:-1], sizes))

    def _doubled(self, codes: np.ndarray) -> list[np.ndarray]:
        """ranks[p][i]: the place of the class of the 2 ** p words from i in sorted order; the last entry is no place."""
        n = self.n
        order = np.argsort(codes)
        ranks = [self._placed(codes[order], order, np.zeros(n, np.int64), np.arange(n))]
        active = np.arange(n)
        while True:
            now = ranks[-1]
            active = active[np.bincount(now[:n], minlength=1)[now[active]] > 1] if n else active
            if not len(active):
                return ranks
            on = active + (1 << len(ranks) - 1)
            inside = on < self.ends[active]
            second = np.where(inside, now[np.where(inside, on, n)] + 1, 0)
            key = now[active] * (n + 2) + second
            order = np.argsort(key)
            new = now.copy()
            base = now[active][order]
            head = np.concatenate([[True], base[1:] != base[:-1]])
            new[:n] = self._placed(key[order], active[order], new[:n], base + np.arange(len(base)) - np.maximum.accumulate(np.where(head, np.arange(len(base)), 0)))[:n]
            ranks.append(new)

    @staticmethod
    def _placed(key: np.ndarray, at: np.ndarray, into: np.ndarray, place: np.ndarray) -> np.ndarray:
        """`into` with the first place of their class for the places `at`, whose keys are sorted; and a last entry for none."""
        out = np.append(into, -1)
        if len(key):
            first = np.concatenate([[True], key[1:] != key[:-1]])
            out[at] = place[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
        return out

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j > i are equal."""
        out = np.zeros(len(i), np.int64)
        for p in range(len(self.ranks) - 1, -1, -1):
            r = self.ranks[p]
            out += (r[np.minimum(i + out, self.n)] == r[np.minimum(j + out, self.n)]).astype(np.int64) << p
        return out

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words that end before i and before j > i are equal."""
        out = np.zeros(len(i), np.int64)
        for p in range(len(self.ranks) - 1, -1, -1):
            r, a, b = self.ranks[p], i - out - (1 << p), j - out - (1 << p)
            out += ((a >= 0) & (r[np.maximum(a, 0)] == r[np.maximum(b, 0)])).astype(np.int64) << p
        return out

    def factors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, source) by place: where a stretch of two words and more occurs earlier, its greatest length and such an occurrence."""
        n, none = self.n, np.zeros(0, np.int64)
        if len(self.ranks) < 2:
            return none, none, none
        array = np.empty(n, np.int64)
        array[self.ranks[-1][:n]] = np.arange(n)
        two = self.ranks[1][array]
        near = np.flatnonzero(two[1:] == two[:-1]) + 1  # suffixes that share two words with the one before them
        if not len(near):
            return none, none, none
        lcp = np.zeros(n + 1, np.int64)
        lcp[near] = self.forward(array[near - 1], array[near])
        nodes = np.flatnonzero((lcp[:-1] > 0) | (lcp[1:] > 0))
        at, common = array[nodes], lcp[nodes].tolist() + [0]
        m = len(nodes)
        before, after, places = list(range(-1, m)), list(range(1, m + 2)), at.tolist() + [-1]
        length, source = [0] * m, [0] * m
        for r in np.argsort(-at).tolist():  # before[0] is -1 and after[m - 1] is m: no suffix, with nothing in common
            p, q = before[r], after[r]
            a, b = common[r], common[q]
            if a >= b:
                length[r], source[r] = a, places[p]
                common[q] = b
            else:
                length[r], source[r] = b, places[q]
                common[q] = a
            after[p] = q
            before[q] = p
        length, source = np.array(length), np.array(source)
        order = np.flatnonzero(length > 1)
        order = order[np.argsort(at[order])]
        return at[order], length[order], source[order]

    def blocks(self) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Starts of all blocks of the factorisation, and (start, length, source) of those of two words and more."""
        long, free = [], 0
        for b, size, source in zip(*(x.tolist() for x in self.factors())):
            if b >= free:
                long.append((b, size, source))
                free = b + size
        inner = np.zeros(self.n + 1, np.int64)
        for b, size, _ in long:
            inner[b + 1] += 1
            inner[b + size] -= 1
        return np.flatnonzero(np.cumsum(inner)[:self.n] == 0), long

    def touching(self, starts: np.ndarray, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, period) of the runs that touch the start of a block or the end of a document."""
        edges = np.union1d(starts, self.starts)
        low = np.concatenate([edges[:1], edges[:-1]])  # starts and ends of documents are edges, so the block before is in the document that ends or goes on here
        high = np.where(np.isin(edges, self.starts), edges, np.append(edges[1:], self.n))  # at a document's end there is no next block
        most = np.maximum(high - low - 1, 0) // (exponent - 1)
        b = np.repeat(edges, most)
        q = np.arange(len(b)) - np.repeat(np.cumsum(most) - most, most) + 1
        word = self.ranks[0]
        found = []
        for x in (b, b - q - 1):
            ok = (x >= 0) & (x + q < self.n)
            ok[ok] = word[x[ok]] == word[x[ok] + q[ok]]
            i, p = x[ok], q[ok]
            start, end = i - self.backward(i, i + p), i + self.forward(i, i + p) + p
            whole = end - start >= exponent * p
            found.append((start[whole], end[whole], p[whole]))
        start, end, period = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        first = np.ones(len(start), bool)
        first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])  # a stretch is a run of its smallest period
        return start[first], end[first], period[first]

    def runs(self, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs by start, then period; exponent is 3 at least."""
        starts, long = self.blocks()
        start, end, period = self.touching(starts, exponent)
        keep = end - start >= least
        buckets: dict[int, list[tuple[int, int]]] = {}
        for s, e, q in zip(start[keep].tolist(), end[keep].tolist(), period[keep].tolist()):
            buckets.setdefault(s, []).append((q, e))
        filled = sorted(buckets)
        for b, size, source in long:
            if size < least + 2 or not filled:
                continue
            shift, k = b - source, bisect_right(filled, source)
            while k < len(filled) and filled[k] < source + size:
                s = filled[k]
                k += 1
                for q, e in list(buckets[s]):
                    if e < source + size and (q, e + shift) not in buckets.get(s + shift, ()):
                        if s + shift not in buckets:
                            buckets[s + shift] = []
                            insort(filled, s + shift)
                        buckets[s + shift].append((q, e + shift))
        return [(s, e - s, q) for s in filled for q, e in sorted(buckets[s])]


def lots_of(texts: Iterator[str | None]) -> Iterator[list[list[bytes]]]:
    """Words of the texts, in lists of documents of about LOT words."""
    held, n = [], 0
    for t in texts:
        words = (t or "").encode("utf-8", "surrogatepass").split()  # bytes are split at ASCII blanks alone
        held.append(words)
        n += len(words)
        if n >= LOT:
            yield held
            held, n = [], 0
    if held:
        yield held


def examined(docs: list[list[bytes]], least: int, exponent: int) -> Iterator[tuple[int, list[tuple[int, int, int]], str]]:
    """(words, runs, text without repetitions) of each document."""
    lot = Lot(docs)
    runs = lot.runs(least, exponent)
    drop = np.zeros(lot.n + 1, np.int64)
    for s, size, q in runs:
        drop[s + q] += 1
        drop[s + size] -= 1
    dropped, at = np.cumsum(drop) > 0, [s for s, _, _ in runs]
    for a, words in zip(lot.starts.tolist(), docs):
        n = len(words)
        own = runs[bisect_left(at, a):bisect_left(at, a + n)]
        if own:
            words = [w for w, out in zip(words, dropped[a:a + n].tolist()) if not out]
        yield n, [(s - a, size, q) for s, size, q in own], b" ".join(words).decode("utf-8", "replace")


def periodic_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT, text: str = "text") -> DataFrame:
    """docs with n_words, runs (start, length, period in words, by start, then period) and collapsed: the words left when each run keeps its first period only, joined by a space."""
    if exponent < 3:
        raise ValueError("the exponent is 3 at least")
    kinds = {"n_words": pa.int64(), "runs": pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), "collapsed": pa.string()}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [x for lot in lots_of(t.as_py() for t in b[text]) for x in examined(lot, least, exponent)]
            new = [n for n, _, _ in rows], [[dict(zip(("start", "length", "period"), r)) for r in runs] for _, runs, _ in rows], [t for _, _, t in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, k) for c, k in zip(new, kinds.values())]], [*b.schema.names, *kinds])

    rows = docs.drop(*ADDED)
    schema = T.StructType([*rows.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(find, schema)


def top_run(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; ties go to the smallest start, then period."""
    best = F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    return F.when(F.size(runs) > 0, best)


def looped(doc_id: Column, text: Column) -> Column:
    """The text, or for one document in ten, by crc32 of its id, its words with everything after a drawn one replaced by a repetition of a stretch from there."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def altered(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.element_at(w, (a + (i - a) % p + 1).cast("int")))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), tail), " ")

    loop = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, altered(w)).otherwise(text))[0]
    return F.when(h % 10 == 0, loop).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", looped(F.col("doc_id"), text_or_empty()).alias("text"))
    out = periodic_runs(docs).withColumn("top", top_run(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    milli = F.expr("1000 * top.length div top.period")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", milli.alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
