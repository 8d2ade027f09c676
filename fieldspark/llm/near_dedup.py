"""Near duplicates by BagMinHash (operator 6).

A document is the multiset of its five-word shingles. Equal word sequences collapse to one representative first. For each shingle and each dyadic
range of weights a Poisson process, seeded by both, yields points (time, component, weight level); points above the shingle's weight are thinned
away, and a component keeps its earliest time, so two signatures agree with the probability of the weighted Jaccard likeness. BANDS of ROWS
components give buckets. Every candidate is verified by exact multiset overlap, whose links' components are the classes:

1. In every bucket all are compared with the least representative; the links' components are the first classes.
2. In buckets that still hold several classes, of up to SMALL members, each two of different classes are compared, but for those whose
   likeness to the least one differs by more than a link allows (1 - likeness is a metric).
3. Larger ones are dealt to blocks of bounded size, the members of the class that weighs most apart from the others. Each two blocks meet
   once in a task, but for two of that class, and only links that join classes leave it. So a bucket's work grows with its members times
   those outside its largest class, whatever the size of that class, no pair becomes a row, and no class is torn.

Texts of fewer than five words are one shingle; null and empty texts are copies of one another; texts without
letters or digits are copies only where equal; repeated rows repeat; null doc_id sorts last;
a doc_id may be null or repeated, for texts are told apart by their words; very long texts are taken whole; an empty table gives an empty
result; extra columns are ignored by `near_dedup` and kept by `drop_near` (but for names that start with `_near`, which are taken).
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt, forget, let, salt_of, salts_used, small_batches, table, text_or_empty, written
from .exact_dedup import one_per
from .fingerprints import shingles, word_hashes

BANDS, ROWS, SMALL, LIKE = 32, 5, 32, 0.8
M, LOT, SLOTS, BLOCK, LEAST, STEP = BANDS * ROWS, 1 << 17, 1 << 21, 400_000, 256, 4096
PROFILE = "doc_id long, text_hash long, key binary, n int, bands array<long>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(hashes: np.ndarray, doc: np.ndarray, weights: np.ndarray, docs: int) -> np.ndarray:
    """M times for each of `docs` documents; (doc, hash) are distinct, `weights` positive integers."""
    sig = np.full(docs * M, np.inf)
    if len(hashes) == 0:
        return sig.reshape(docs, M)
    parts = []
    for k in range(int(weights.max() - 1).bit_length() + 1):  # weights (0,1], (1,2], (2,4], ...
        low = 0 if k == 0 else 1 << (k - 1)
        on = weights > low
        parts.append((_mix(_mix(hashes[on]) + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)), doc[on], np.full(on.sum(), low), np.full(on.sum(), max(low, 1)), weights[on]))
    seed, doc, low, size, weight = (np.concatenate(x) for x in zip(*parts))
    t, step = np.zeros(len(seed)), 1
    while len(seed):
        block = min(64, max(1, LOT // len(seed)))
        r = _mix(seed[:, None] + np.arange(step, step + block, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03))
        times = -np.log(((r >> np.uint64(11)).astype(float) + 0.5) / 2.0**53) / size[:, None]
        times[:, 0] += t
        np.cumsum(times, axis=1, out=times)
        q = _mix(r)
        at = doc[:, None] * M + (q % np.uint64(M)).astype(np.int64)
        ok = low[:, None] + 1 + ((q >> np.uint64(20)) % size[:, None].astype(np.uint64)).astype(np.int64) <= weight[:, None]
        np.minimum.at(sig, at[ok], times[ok])
        t, step = times[:, -1], step + block
        live = t < sig.reshape(docs, M).max(axis=1)[doc]
        seed, doc, low, size, weight, t = (x[live] for x in (seed, doc, low, size, weight, t))
    return sig.reshape(docs, M)


def signature(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """M times of one document."""
    return signatures(np.asarray(hashes, np.uint64), np.zeros(len(hashes), np.int64), np.asarray(weights, np.int64), 1)[0]


def counted(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, hash) and how often each occurs, by doc and hash."""
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    return hashes[at], doc[at], np.diff(np.append(at, len(hashes)))


def lots(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Hashes, their document's number and the number of documents, for as many documents at a time as hold about LOT hashes."""
    size = np.diff(lists.offsets.to_numpy())
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(size)
    i = 0
    while i < len(size):
        start = ends[i] - size[i]
        j = max(i + 1, int(np.searchsorted(ends, start + LOT, side="right")))
        yield flat[start:ends[j - 1]], np.repeat(np.arange(j - i), size[i:j]), j - i
        i = j


def banded(bands: int, rows: int) -> Callable:
    """Rows (doc_id, text_hash, key, s) to rows of PROFILE: s gives its number of shingles and a hash per band, none for no shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, out = b.column("s"), []
            for flat, doc, docs in lots(s):
                bits = signatures(*counted(flat, doc), docs).view(np.uint64)
                h = np.empty((docs, bands), np.uint64)
                for i in range(bands):
                    h[:, i] = _mix(np.full(docs, i + 1, np.uint64))
                    for k in range(i * rows, (i + 1) * rows):
                        h[:, i] = _mix(h[:, i] ^ bits[:, k])
                out.append(h)
            n = np.diff(s.offsets.to_numpy())
            full = np.concatenate(out)[n > 0] if out else np.zeros((0, bands), np.uint64)
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(full.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), b.column("key"), pa.array(n, pa.int32()), lists], ["doc_id", "text_hash", "key", "n", "bands"])

    return run


def bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rep, s) to (rep, n, bag, codes): shingles made distinct by their number of occurrence, so that set overlap is multiset overlap, and their low halves."""
    for b in batches:
        out = []
        for flat, doc, _ in lots(b.column("s")):
            h, _, w = counted(flat, doc)
            nth = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            out.append(_mix(np.repeat(h, w) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        bags = np.concatenate(out) if out else np.zeros(0, np.uint64)
        ends = b.column("s").offsets.to_numpy()
        ends = pa.array(ends - ends[0], pa.int32())
        codes = pa.array((bags & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))
        n = pa.array(np.diff(ends.to_numpy()), pa.int32())
        yield pa.RecordBatch.from_arrays([b.column("rep"), n, pa.ListArray.from_arrays(ends, pa.array(bags.view(np.int64))), pa.ListArray.from_arrays(ends, codes)], ["rep", "n", "bag", "codes"])


def _key(words: Column) -> Column:
    """Equal for equal word sequences; for texts without words (no letter or digit), for equal texts."""
    text = text_or_empty()
    return F.unhex(F.sha2(F.when(F.size(words) > 0, F.array_join(words, ",")).when(text == "", "").otherwise(F.concat(F.lit("text:"), text)), 256))


def key_of() -> Column:
    return let(word_hashes(text_or_empty()), _key)


def profiled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key, salt) of every row, and of every key: rep (a number), rep_id (its least doc_id), n, bands, and the row whose text it takes."""
    both = let(word_hashes(text_or_empty()), lambda w: F.struct(_key(w).alias("key"), shingles(w).alias("s")))
    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_hash"), both.alias("p")).select("doc_id", "text_hash", "p.key", "p.s")
    with small_batches(docs.sparkSession):
        rows = written(rows.mapInArrow(banded(BANDS, ROWS), PROFILE).withColumn("salt", salt_of("doc_id", "text_hash")), "near-profiles")
    some = F.first(F.struct(F.col("doc_id").alias("at_id"), "text_hash", "n", "bands")).alias("at")
    reps = rows.groupBy("key").agg(F.min("doc_id").alias("rep_id"), salts_used().alias("salts"), some)
    return rows, written(reps.select("key", "rep_id", "salts", "at.*").withColumn("rep", F.monotonically_increasing_id()), "near-reps")


def met(reps: DataFrame) -> DataFrame:
    """bucket, rep, n, a (the bucket's least rep), met (its size) for buckets of two and more."""
    left = reps.select("rep", "n", F.explode("bands").alias("bucket")).withColumn("salt", salt_of("rep"))
    sizes = left.groupBy("bucket").agg(F.count(F.lit(1)).alias("met"), F.min("rep").alias("a"), salts_used().alias("salts")).filter("met > 1")
    return written(left.join(dealt(sizes), ["bucket", "salt"]), "near-met")


def bags_of(docs: DataFrame, reps: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep, n, bag, codes of the wanted reps, from the text of the row that each took.

    Texts whose hash falls in none of SLOTS that wanted ones take are not shuffled; the broadcast holds at most SLOTS numbers."""
    at = written(reps.select("rep", "at_id", F.col("text_hash").alias("at_hash")).join(wanted, "rep", "left_semi"), "near-at")
    slot = lambda c: F.pmod(F.col(c), F.lit(SLOTS)).cast("int").alias("slot")
    texts = docs.select("doc_id", "text", F.xxhash64(text_or_empty()).alias("text_hash"))
    texts = texts.withColumn("slot", slot("text_hash")).join(F.broadcast(at.select(slot("at_hash")).distinct()), "slot", "left_semi")
    texts = texts.join(at, (F.col("text_hash") == F.col("at_hash")) & F.col("doc_id").eqNullSafe(F.col("at_id")))
    bags = texts.select("rep", shingles(word_hashes(text_or_empty())).alias("s")).mapInArrow(bagged, "rep long, n int, bag array<long>, codes array<int>")
    with small_batches(docs.sparkSession):
        bags = written(bags.groupBy("rep").agg(F.first(F.struct("n", "bag", "codes")).alias("b")).select("rep", "b.*"), "near-bags")  # a row may repeat
    forget(at)
    return bags


def compared(pairs: DataFrame, bags: DataFrame, codes: str) -> DataFrame:
    """a, b, na, nb and how many codes each distinct pair (a, b) shares; a hot `a` is spread by salts."""
    pairs = pairs.select("a", "b", salt_of("b").alias("salt"))
    side = lambda x: bags.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col(codes).alias(f"bag_{x}"))
    left = pairs.select("a", "salt").distinct().join(side("a"), "a")
    both = pairs.join(side("b"), "b").join(left, ["a", "salt"])
    return both.select("a", "b", "na", "nb", F.size(F.array_intersect("bag_a", "bag_b")).alias("common"))


def scored(pairs: DataFrame, bags: DataFrame, like: float) -> DataFrame:
    """Of the pairs those that may be so alike, with lo and hi, bounds of their likeness, by the halves of their shingles' hashes.

    Halves of different hashes are equal now and then: as a Poisson number of mean na * nb / 2**32, which passes 3 + 6 means in no one of 10**15 pairs."""
    out = compared(pairs, bags, "codes").withColumn("slack", 3 + F.col("na").cast("double") * F.col("nb") * (6 / 2**32))
    of = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c / (F.col("na") + F.col("nb") - c)))
    most = F.least(F.least("na", "nb").cast("double"), F.col("common") + F.col("slack"))
    out = out.withColumn("lo", of(F.col("common") - F.col("slack"))).withColumn("hi", of(most))
    return out.filter(F.col("hi") >= like - 1e-9).select("a", "b", "lo", "hi")


def settled(pairs: DataFrame, bags: DataFrame, like: float) -> DataFrame:
    """Links (a, b) among scored pairs: those surely so alike, and those that are by the whole hashes."""
    close = compared(pairs.filter((F.col("lo") < like + 1e-9) & (F.col("hi") >= like - 1e-9)), bags, "bag")
    exact = close.filter(F.col("common") >= like * (F.col("na") + F.col("nb") - F.col("common")))
    return pairs.filter(F.col("lo") >= like + 1e-9).select("a", "b").unionByName(exact.select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """node, class: least node of its component, by spreading minima and jumping."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("salt", salt_of("a"))
    both = written(both, "near-edges")
    used = written(both.groupBy("b").agg(salts_used().alias("salts")), "near-used")
    label = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("class")), "near-label")
    while True:
        of = dealt(used.join(label.select(F.col("a").alias("b"), F.col("class").alias("c")), "b"))
        near = both.join(of, ["b", "salt"]).groupBy("a").agg(F.min("c").alias("c"))
        new = label.join(near, "a").select("a", F.least("class", "c").alias("new"), F.col("class").alias("old"))
        jump = label.select(F.col("a").alias("new"), F.col("class").alias("far"))
        new = written(new.join(jump, "new", "left").select("a", F.least("new", "far").alias("class"), "old"), "near-label")
        forget(label)
        done = new.filter("class <> old").isEmpty()
        label = new.select("a", "class")
        label.kept_at = new.kept_at
        if done:
            forget(both, used)
            return label


def mixed(rows: DataFrame, label: DataFrame) -> DataFrame:
    """The rows, with their class, of buckets that hold several classes."""
    rows = rows.join(label.select(F.col("a").alias("rep"), "class"), "rep", "left").withColumn("class", F.coalesce("class", "rep"))
    several = rows.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), salts_used().alias("salts")).filter("lo < hi")
    return rows.join(dealt(several.select("bucket", "salts")), ["bucket", "salt"])


def similar_size(x: str, y: str, like: float) -> Column:
    return F.least(x, y) >= F.greatest(x, y) * like - 1e-9


def within(rows: DataFrame, known: DataFrame, like: float) -> DataFrame:
    """Pairs of different classes in small buckets; those of the bucket's least rep are known, as is how like it the others are, where that matters."""
    rows = rows.filter(F.col("rep") != F.col("a")).join(known.withColumnRenamed("b", "rep"), ["a", "rep"], "left")
    low = 2 * like - 1  # or less
    rows = rows.withColumn("lo", F.coalesce("lo", F.lit(0.0))).withColumn("hi", F.coalesce("hi", F.lit(low)))
    groups = rows.groupBy("bucket").agg(F.collect_list(F.struct("rep", "n", "class", "lo", "hi")).alias("m"))
    pairs = groups.select(F.explode("m").alias("x"), "m").select("x", F.explode("m").alias("y")).filter((F.col("x.rep") < F.col("y.rep")) & (F.col("x.class") != F.col("y.class")))
    near = F.greatest(F.col("x.lo") - F.col("y.hi"), F.col("y.lo") - F.col("x.hi")) <= 1 - like + 1e-9
    return pairs.filter(similar_size("x.n", "y.n", like) & near).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def _joins(rows: pd.DataFrame, like: float) -> pd.DataFrame:
    """Links between classes of block i and block j, as many as join what links join."""
    first, second = (rows[rows["side"] == k] for k in (0, 1))
    if rows["i"].iloc[0] == rows["j"].iloc[0]:
        second = first
    none = pd.DataFrame({"a": np.array([], np.int64), "b": np.array([], np.int64)})
    if not len(first) or not len(second):
        return none
    sizes = [b["bag"].map(len).to_numpy() for b in (first, second)]
    flat = [np.concatenate(b["bag"].to_numpy()) for b in (first, second)]
    shared = np.intersect1d(*flat)
    if not len(shared):
        return none
    at = [np.minimum(np.searchsorted(shared, f), len(shared) - 1) for f in flat]
    on = [shared[a] == f for a, f in zip(at, flat)]
    owner = [np.repeat(np.arange(len(n)), n)[o] for n, o in zip(sizes, on)]
    at = [a[o] for a, o in zip(at, on)]
    common = np.zeros((len(first), len(second)), np.float32)  # whole numbers below 2**24 are exact in single precision
    for x in range(0, len(shared), STEP):
        part = [np.zeros((len(n), min(STEP, len(shared) - x)), np.float32) for n in sizes]
        for m, a, w in zip(part, at, owner):
            pick = (a >= x) & (a < x + STEP)
            m[w[pick], a[pick] - x] = 1
        common += part[0] @ part[1].T
    whole = sizes[0][:, None] + sizes[1][None, :] - common.astype(np.float64)
    kinds = [b["class"].to_numpy() for b in (first, second)]
    x, y = np.nonzero((common >= like * whole) & (kinds[0][:, None] != kinds[1][None, :]))
    up: dict[int, int] = {}

    def root(c: int) -> int:
        while (far := up.get(c, c)) != c:
            up[c] = c = up.get(far, far)
        return c

    keep = []
    for k, (c, d) in enumerate(zip(kinds[0][x].tolist(), kinds[1][y].tolist())):
        c, d = root(c), root(d)
        if c != d:
            up[c] = d
            keep.append(k)
    return pd.DataFrame({"a": first["rep"].to_numpy()[x[keep]], "b": second["rep"].to_numpy()[y[keep]]})


def by_blocks(rows: DataFrame, bags: DataFrame, like: float) -> DataFrame:
    """Links (a, b) that join classes within large buckets, for rows (bucket, rep, n, class, salt)."""
    weight = F.sum(F.greatest("n", F.lit(LEAST))).alias("w")
    per = rows.groupBy("bucket", "class").agg(weight, salts_used().alias("salts"))
    per = per.groupBy("bucket").agg(F.max(F.struct("w", "class")).alias("top"), F.sum("w").alias("w"), F.bit_or("salts").alias("salts"))
    blocks = lambda w: F.greatest(F.lit(1), F.ceil(w / BLOCK)).cast("int")
    per = per.select("bucket", "salts", F.col("top.class").alias("main"), blocks(F.col("top.w")).alias("t"), blocks(F.col("w") - F.col("top.w")).alias("r"))
    rows = rows.join(dealt(per), ["bucket", "salt"]).withColumn("is_main", F.col("class") == F.col("main"))
    deal = lambda n: F.pmod(F.xxhash64("rep", F.lit(7)), F.col(n)).cast("int")
    rows = rows.withColumn("own", F.when(F.col("is_main"), deal("t")).otherwise(F.col("t") + deal("r")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(F.col("is_main"), F.col("t")).otherwise(F.lit(0)), F.col("t") + F.col("r") - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "class")
    return rows.join(bags.select("rep", "bag"), "rep").groupBy("bucket", "i", "j").applyInPandas(lambda g: _joins(g, like), "a long, b long").distinct()


def classes(docs: DataFrame, reps: DataFrame, like: float) -> DataFrame:
    """a, class for every rep that is like another."""
    rows = met(reps)
    bags = bags_of(docs, reps, rows.select("rep").distinct())
    star = rows.filter(F.col("rep") != F.col("a")).select("a", F.col("rep").alias("b"), F.col("n").alias("nb")).distinct()
    star = star.join(reps.select(F.col("rep").alias("a"), F.col("n").alias("na")), "a").filter(similar_size("na", "nb", 2 * like - 1))
    known = written(scored(star, bags, 2 * like - 1), "near-scored")
    label = components(written(settled(known, bags, like), "near-links"))
    joined = lambda links: components(label.select("a", F.col("class").alias("b")).filter("a <> b").unionByName(links))
    todo = written(mixed(rows.filter("met > 2"), label), "near-mixed")
    forget(rows)
    links = written(settled(scored(within(todo.filter(F.col("met") <= SMALL), known, like), bags, like), bags, like), "near-links")
    if not links.isEmpty():
        label = joined(links)
    forget(links, known)
    large = written(mixed(todo.filter(F.col("met") > SMALL).drop("class"), label), "near-large")
    forget(todo)
    links = written(by_blocks(large, bags, like), "near-links")
    if not links.isEmpty():
        label = joined(links)
    forget(links, large, bags)
    return label


def decided(docs: DataFrame, like: float = LIKE) -> DataFrame:
    """near_dedup with the key of each row's words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, reps = profiled(docs)
    label = classes(docs, reps, like).withColumnRenamed("a", "rep").withColumn("salt", salt_of("rep"))
    named = label.join(reps.select("rep", "rep_id", "key"), "rep")
    heads = named.groupBy("class").agg(F.min(F.struct(F.col("rep_id").isNull(), "rep_id", "key", "rep")).alias("head"), salts_used().alias("salts"))
    heads = label.join(dealt(heads), ["class", "salt"]).select("rep", F.col("head.rep_id").alias("head_id"), F.col("head.rep").alias("head"))
    per = reps.select("key", "rep", "rep_id", "salts").join(heads, "rep", "left")
    out = rows.select("doc_id", "key", "salt").join(dealt(per), ["key", "salt"])
    own = F.coalesce("head", "rep") == F.col("rep")
    return out.select(
        "doc_id", F.when(own, F.col("rep_id")).otherwise(F.col("head_id")).alias("class_id"), F.col("rep_id").alias("rep"),
        (own & F.col("doc_id").eqNullSafe(F.col("rep_id"))).alias("kept"), "key")


def near_dedup(docs: DataFrame, like: float = LIKE) -> DataFrame:
    """doc_id, class_id (least doc_id of its class), rep (least doc_id of those with the same words), kept, for every row."""
    return decided(docs, like).drop("key")


def drop_near(docs: DataFrame) -> DataFrame:
    """One document of each group stays, the one with the least doc_id; columns as given."""
    kept = decided(docs).filter("kept").groupBy(F.col("doc_id").alias("_near_id"), F.col("key").alias("_near_key")).agg(F.count(F.lit(1)).alias("_near_copies"))
    kept = written(kept, "near-kept")
    rows = docs.withColumn("_near_words", key_of())
    rows = rows.join(kept, (F.col("_near_words") == F.col("_near_key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_near_id")))
    out = rows.filter("_near_copies = 1").select(*docs.columns)
    if kept.filter("_near_copies > 1").isEmpty():
        return out
    return out.unionByName(one_per(rows.filter("_near_copies > 1").select(*docs.columns, "_near_words"), "_near_words").select(*docs.columns))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
