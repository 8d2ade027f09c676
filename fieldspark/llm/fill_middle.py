"""Fill-in-middle transformation by lookaround splitting (operator 11; DataFrame functions only).

A unit grammar names classes of characters that hold together in runs and leaves all others to stand alone. Two neighbours are parted unless
both are of one run class, so the grammar becomes a regex that matches no character, only places between neighbours: after a lone
character, and after a character of a run class before one that is not of it. `split` at these places loses nothing, its pieces are the units.
An empty text has no place and no unit; split would give one empty piece, so its count is set apart.

Each document is cut after two units drawn from the hash of a seed and its id, and written as prefix, suffix, middle (psm) or suffix, prefix, middle
(spm) between markers, or left plain: by lot, when it is empty, or when it holds a marker. Without markers inside, splitting at them gives the parts
back. Null text counts as empty, a null id as no digits; repeated rows give repeated results; long texts are cut whole; an empty table gives an
empty result; other columns stay, but those named in ADDED are overwritten and names that start with `_fim_` are taken.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

MARKS = ("<P>", "<S>", "<M>")
ADDED = ("n_units", "form", "prefix", "middle", "suffix", "output")


@dataclass(frozen=True)
class Units:
    """Character classes (the inside of brackets, apart from one another) whose runs are units; any other character is one alone, or, if `joined`, a run of others is."""
    runs: tuple[str, ...] = ()
    joined: bool = False

    def boundary(self) -> str:
        """The regex of the places between units. Each choice looks back at a whole character, so no place lies within a surrogate pair."""
        held = "".join(self.runs)
        others = f"(?<=[^{held}])" if held else r"(?<=[\s\S])"
        return "|".join([others + (f"(?=[{held}])" if self.joined else r"(?!\z)"), *[f"(?<=[{c}])(?=[^{c}])" for c in self.runs]])


LETTERS = Units(("A-Za-z",))
WORDS = Units((r"\x20\x09-\x0D",), True)  # runs of blanks, runs of others
CHARACTERS = Units()


def units_of(text: Column, grammar: Units = LETTERS) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, grammar.boundary(), -1))


def lots(doc_id: Column, seed: int, n: int = 4) -> list[Column]:
    """n unsigned 32-bit numbers, the groups of eight digits of the sha256 of `seed:id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def fill_middle(docs: DataFrame, grammar: Units = LETTERS, seed: int = 1, plain_from: int = 90, spm_below: int = 20, key: str = "doc_id") -> DataFrame:
    """docs with n_units, form (plain, psm or spm), prefix, middle, suffix (null if plain) and output."""
    text = text_or_empty()
    out = docs.drop(*ADDED).withColumns({f"_fim_{i}": h for i, h in enumerate(lots(F.col(key), seed))}).withColumn("_fim_units", units_of(text, grammar))
    out = out.withColumn("n_units", F.size("_fim_units").cast("long"))
    cut = lambda i: (F.col(f"_fim_{i}") % (F.col("n_units") + 1)).cast("int")
    marked = F.lit(False)
    for m in MARKS:
        marked = marked | text.contains(m)
    form = F.when((F.col("n_units") == 0) | marked | (F.col("_fim_2") % 100 >= plain_from), "plain").when(F.col("_fim_3") % 100 < spm_below, "spm").otherwise("psm")
    out = out.withColumns({"form": form, "_fim_a": F.least(cut(0), cut(1)), "_fim_b": F.greatest(cut(0), cut(1))})
    part = lambda start, n: F.when(F.col("form") != "plain", F.array_join(F.slice("_fim_units", start, n), ""))
    a, b = F.col("_fim_a"), F.col("_fim_b")
    out = out.withColumns({"prefix": part(F.lit(1), a), "middle": part(a + 1, b - a), "suffix": part(b + 1, F.size("_fim_units") - b)})
    p, s, m = (F.lit(x) for x in MARKS)
    psm, spm = F.concat(p, "prefix", s, "suffix", m, "middle"), F.concat(s, "suffix", p, "prefix", m, "middle")
    out = out.withColumn("output", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(text))
    return out.drop(*[c for c in out.columns if c.startswith("_fim_")])


def restored(output: Column, form: Column) -> Column:
    """The text that an output and its form stand for; the markers' letters tell its parts."""
    parts = F.split(output, "|".join(MARKS), -1)
    first, second, middle = parts[1], parts[2], parts[3]
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c, name: F.sha2(c, 256).alias(name)
    return out.select(
        "doc_id", F.col("n_units").alias("n"), "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        sha(F.col("output"), "output_sha256"), sha(restored(F.col("output"), F.col("form")), "restored_sha256"))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text,'') AS text, sha256(concat('1:', CAST(doc_id AS VARCHAR))) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u, CAST(concat('0x',h[1:8]) AS BIGINT) AS h1, CAST(concat('0x',h[9:16]) AS BIGINT) AS h2, CAST(concat('0x',h[17:24]) AS BIGINT) AS h3, CAST(concat('0x',h[25:32]) AS BIGINT) AS h4 FROM t),
f AS (SELECT *, len(u) AS n, least(h1%(len(u)+1), h2%(len(u)+1)) AS a, greatest(h1%(len(u)+1), h2%(len(u)+1)) AS b,
  CASE WHEN text='' OR contains(text,'<P>') OR contains(text,'<S>') OR contains(text,'<M>') OR h3%100>=90 THEN 'plain' WHEN h4%100<20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1:a],'') AS pre, array_to_string(u[a+1:b],'') AS mid, array_to_string(u[b+1:n],'') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form<>'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form<>'plain' THEN length(mid) END AS middle_chars,
sha256(CASE form WHEN 'psm' THEN concat('<P>',pre,'<S>',suf,'<M>',mid) WHEN 'spm' THEN concat('<S>',suf,'<P>',pre,'<M>',mid) ELSE text END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""
