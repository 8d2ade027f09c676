"""Secret scan with dictionary-primed zstandard novelty (operator 10).

Base patterns find assignments, access keys and hex strings. Beyond them, long unbroken strings in a sensitive context are
compressed with the surrounding text and common identifiers as dictionary; those that stay incompressible, by the byte or beside
random strings of their own alphabet and length, are reported as `novel`, but for strings that read as joined words or whose marks part words and numbers. Of a string that
holds a base span, what lies outside it is tested, where it has LONG's 20 characters. Offsets are code points of the whole text, end exclusive.

Null text is empty and has no spans; very long texts and strings are taken whole; repeated rows give repeated results; an empty table
gives an empty result; other columns stay, but `scan` overwrites `secrets`; `redact` keeps null texts and sets n_chars where there is one.
"""
from __future__ import annotations

import random
import re
import string
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LONG = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
SENSITIVE = "api_?keys?|keys?|secrets?|tokens?|passw(?:or)?ds?|pwd|passphrase|credentials?|auth|authorization|authentication|private|bearer"
# a whole word, a part between underscores and digits, or a part of a camelCase name: not "keyboard" or "author"
CONTEXT = re.compile(rf"(?<![A-Za-z])(?i:{SENSITIVE})(?![a-z])|(?<=[a-z])(?:Keys?|Secrets?|Tokens?|Passw(?:or)?d|Credentials?|Auth|Authorization)(?![a-z])", re.A)
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
PARTS, SHORT = re.compile(r"[+/_=-]+"), 4
PLAIN = re.compile(r"\d+|\d+T\d+|[a-z]{1,11}|[A-Z]{1,11}|[A-Z][a-z]{1,10}|[A-Za-z]{1,3}\d{1,8}", re.A)
IDENTIFIERS = b"configuration authorization password private_key access_token client_secret session_id username environment connection https://www.example.com/ function return import public static string "
AROUND, MIN_NOVELTY, MIN_RATIO, LEAST = 200, 0.75, 0.93, 20
D, L, U = string.digits, string.ascii_lowercase, string.ascii_uppercase
ALPHABETS = (D, D + "ABCDEF", D + "abcdef", U, L, U + "234567", L + "234567", D + U, D + L, U + L, D + U + L)
MARKS = "+/_=-"
WORD, NO_VOWEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])"), re.compile(r"[^aeiouy]+")
SPAN = "array<struct<kind:string,start:int,end:int>>"


def novelty(candidate: str, around: str) -> float:
    """Marginal compressed bytes per byte of the candidate, given its surroundings."""
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + around.encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    c = zstandard.ZstdCompressor(level=19, dict_data=primed, write_content_size=False)
    return (len(c.compress(candidate.encode())) - len(c.compress(b""))) / len(candidate)


@lru_cache(4096)
def random_cost(alphabet: str, n: int) -> float:
    """Novelty of random strings of the alphabet, on average."""
    r = random.Random(f"{alphabet} {n}")
    tries = 8 if n <= 1024 else 2
    return sum(novelty("".join(r.choices(alphabet, k=n)), "") for _ in range(tries)) / tries


def alphabet_of(candidate: str) -> str:
    """The least usual alphabet that holds the candidate, with the marks it uses; padding at the end does not count."""
    used = set(candidate.rstrip("="))
    marks = "".join(sorted(used & set(MARKS)))
    return next(a for a in ALPHABETS if used - set(marks) <= set(a)) + marks


def wordy(candidate: str) -> bool:
    """Whether it reads as words, joined by marks or capitals, with few digits: compression cannot tell unusual words from chance letters."""
    words = [w for w in WORD.findall(candidate) if len(w) > 1]
    letters = "".join(words).lower()
    if not words or len(letters) < 0.7 * len(candidate) or sum(c.isdigit() for c in candidate) > 0.15 * len(candidate) or len(letters) < 4 * len(words):
        return False
    return sum(c in "aeiouy" for c in letters) >= 0.28 * len(letters) and all(len(run) <= 5 for w in words for run in NO_VOWEL.findall(w.lower()))


def structured(candidate: str) -> bool:
    """Whether marks cut it into parts that are all words of one case, numbers or short: paths, addresses, dates, models, versions, UUIDs. Parts of a random string mix letters and digits."""
    if UUID.fullmatch(candidate):
        return True
    parts = [p for p in PARTS.split(candidate) if p]
    return len(parts) > 2 and all(len(p) <= SHORT or PLAIN.fullmatch(p) or wordy(p) for p in parts)


def is_novel(candidate: str, around: str) -> bool:
    if wordy(candidate) or structured(candidate):
        return False
    value = novelty(candidate, around)
    return value >= MIN_NOVELTY or value >= MIN_RATIO * random_cost(alphabet_of(candidate), len(candidate))


def outside(s: int, e: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Parts of [s, e) outside the sorted spans."""
    out = []
    for a, b in taken:
        if a < e and s < b:
            out.append((s, a))
            s = b
    return [(a, b) for a, b in (*out, (s, e)) if b - a >= LEAST]


def spans_of(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    taken, at = sorted(s[1:] for s in found), 0
    for m in LONG.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        near = at
        while near < len(taken) and taken[near][0] < m.end():
            near += 1
        for s, e in outside(*m.span(), taken[at:near]):
            if CONTEXT.search(text, max(0, m.start() - 60), s) and is_novel(text[s:e], text[max(0, s - AROUND):s] + text[e:e + AROUND]):
                found.append(("novel", s, e))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _spans(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"kind": k, "start": s, "end": e} for k, s, e in spans_of(t)])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column `secrets`: the spans found."""
    return docs.withColumn("secrets", F.pandas_udf(_spans, SPAN)(F.col(text)))


def _redacted(texts: pd.Series) -> pd.Series:
    def one(t):
        at, out = 0, []
        for k, s, e in spans_of(t):
            if e > at:
                out += [t[at:max(at, s)], f"[{k}]"]
                at = e
        return t if not out else "".join(out) + t[at:]
    return texts.map(one, na_action="ignore")


def redact(docs: DataFrame) -> DataFrame:
    """Every document stays; secrets in its text are replaced by their kind and n_chars, if there is one, follows."""
    out = docs.withColumn("text", F.pandas_udf(_redacted, "string")(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents")).select("doc_id", "secrets")
    n = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(text(F.filter("secrets", lambda s: s["kind"] != "novel")), 256).alias("base_sha256"), text(F.col("secrets")).alias("spans"), n("novel"))
