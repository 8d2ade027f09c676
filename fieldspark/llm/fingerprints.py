"""One-permutation MinHash with optimal densification and packed low bits (operator 3; DataFrame functions only).

Each five-word shingle is hashed once; its top bits name the bin, the bin keeps its least hash. An empty bin copies the filled bin
that comes first in its own random order of bins (2-universal, so equal for equal sets). LOW bits per bin are stored as hex;
likeness corrects the share of equal bins for chance. A text of fewer than five words is one shingle; an empty text (or null)
has the empty fingerprint, like only to itself, as has a text without letters or digits. Very long texts are taken whole; repeated rows
repeat; rows of null doc_id come first; extra columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, table, text_or_empty

BIN_BITS, WORDS = 7, 5
BINS, SHIFT = 1 << BIN_BITS, 63 - BIN_BITS


def word_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def shingles(words: Column, n: int = WORDS) -> Column:
    """Hashes of n consecutive words, as many as there are."""
    return let(words, lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[w[i + j] for j in range(n)])))
               .when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<long>")))


def _bins(hashes: Column) -> Column:
    """The least hash of every filled bin, sorted: neighbours in sorted order that change bin."""
    positive = F.array_sort(F.transform(hashes, lambda h: F.shiftrightunsigned(h, 1)))
    return let(positive, lambda a: F.filter(a, lambda x, i: (i == 0) | (F.shiftright(x, SHIFT) != F.shiftright(F.get(a, i - 1), SHIFT))))


def fingerprint(text: Column) -> Column:
    """Hex, two digits a bin."""
    low = lambda x: x.bitwiseAND(F.lit(255)).cast("long")
    entry = lambda b, v: F.shiftleft(b.cast("long"), 8).bitwiseOR(v)
    filled = lambda m: F.transform(m, lambda x: F.shiftright(x, SHIFT).cast("int"))
    pick = lambda j, m: F.array_min(F.transform(m, lambda x: F.xxhash64(j, F.shiftright(x, SHIFT)).bitwiseAND(F.lit(-256)).bitwiseOR(low(x))))
    empty = lambda m: F.array_except(F.sequence(F.lit(0), F.lit(BINS - 1)), filled(m))
    whole = lambda m: F.array_sort(F.concat(F.transform(m, lambda x: entry(F.shiftright(x, SHIFT), low(x))), F.transform(empty(m), lambda j: entry(j, low(pick(j, m))))))
    return let(_bins(shingles(word_hashes(text))), lambda m: F.when(F.size(m) == 0, F.lit("")).otherwise(
        F.array_join(F.transform(whole(m), lambda e: F.lpad(F.lower(F.hex(low(e))), 2, "0")), "")))


def likeness(a: Column, b: Column) -> Column:
    same = lambda x, y: F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.substring(x, i * 2 + 1, 2) == F.substring(y, i * 2 + 1, 2)))
    chance = 1 / 256
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(F.greatest(F.lit(0.0), (same(a, b) / BINS - chance) / (1 - chance)))


RANGE = 4096


def with_next(docs: DataFrame, cols: list[str], parts: int | None = None) -> DataFrame:
    """Each row with `next_<col>` of the next row by doc_id, the first after the last: a window per range of ids, joined at the seams.

    Ranges hold about RANGE rows, up to 2,000 ranges, whose cuts the driver holds. Null ids come first, dealt by their columns' hashes; equal ids go by
    the hash too."""
    if parts is None:
        parts = max(1, min(2_000, docs.count() // RANGE))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10000).alias("q")).first()["q"] or []
    bounds = F.array(*[F.lit(int(q)).cast("long") for q in sorted(set(cuts))]) if cuts else F.array().cast("array<long>")
    nulls = -1 - F.pmod(F.xxhash64(*cols), F.lit(parts)).cast("int")
    rows = docs.withColumn("part", F.when(F.col("doc_id").isNull(), nulls).otherwise(F.size(F.filter(bounds, lambda q: q < F.col("doc_id")))))
    following = F.struct(*cols)
    ordered = Window.partitionBy("part").orderBy("doc_id", F.xxhash64(*cols))
    out = rows.withColumn("next", F.lead(following).over(ordered))
    firsts = rows.groupBy("part").agg(F.min_by(following, F.struct("doc_id", F.xxhash64(*cols))).alias("first"))  # one row per range
    seams = firsts.select("part", F.coalesce(F.lead("first").over(Window.orderBy("part")), F.first("first").over(Window.orderBy("part"))).alias("seam"))
    out = out.join(seams, "part").withColumn("next", F.coalesce("next", "seam"))
    return out.select(*docs.columns, *[F.col(f"next.{c}").alias(f"next_{c}") for c in cols])


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    docs = with_next(docs.withColumn("fingerprint", fingerprint(F.col("text"))), ["text", "fingerprint"])
    n = F.length("text")
    k = F.floor(n / 4).cast("int")
    docs = docs.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col("next_text"), F.lit(1), k)))
    docs = docs.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return docs.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
