"""Token counts with the whole-token shortcut (operator 5).

Offline, once on the driver: a vocabulary string that encodes alone as one token is proved whole, and the model is proved to
be splittable, that is, no piece holds a word mark after another character, the normaliser changes nothing and no string is matched
before merging; then a text falls into independent pre-tokens at every such place. Whole pre-tokens count one; the rest are
merged by the library, up to MEMO of them remembered per task. A model that is not splittable has the library encode whole texts.

Null and empty texts have no tokens; repeated rows repeat; very long texts are taken whole; an empty table gives an empty result;
extra columns stay, but `n_tokens` is overwritten.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MARK = "▁"
PRE = re.compile(f"{MARK}+[^{MARK}]*")
MODEL, LIMIT, MEMO, LONGEST, LOT, PART = "piece_bpe_32k.model", 4096, 100_000, 64, 1 << 20, 256


def library(model: bytes):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor()
    sp.LoadFromSerializedProto(model)
    return sp


def plain_pieces(sp) -> list[int]:
    return [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]


def splittable(model: bytes) -> bool:
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto.FromString(model)
    n = m.normalizer_spec
    same = n.name == "identity" and n.add_dummy_prefix and not n.remove_extra_whitespaces and not n.normalization_rule_tsv
    own = any(p.type == proto.ModelProto.SentencePiece.USER_DEFINED for p in m.pieces)
    sp = library(model)
    return same and not own and not any(re.search(f"[^{MARK}]{MARK}", sp.id_to_piece(i)) for i in plain_pieces(sp))


def whole_words(model: bytes) -> list[str]:
    """Words (pieces without their first mark) that encode alone as one token."""
    sp = library(model)
    words = [p[1:] for p in map(sp.id_to_piece, plain_pieces(sp)) if p.startswith(MARK) and len(p) > 1]
    return [w for w, ids in zip(words, sp.encode([w.replace(MARK, " ") for w in words])) if len(ids) == 1]


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text that is not empty, each without its first mark."""
    text = text.replace(MARK, " ")
    if text[0] == " " or text[-1] == " " or "  " in text:
        return [p[1:] for p in PRE.findall(MARK + text.replace(" ", MARK))]
    return text.split(" ")


class Words(dict):
    """What `of` gives for pre-tokens, asked for many at a time; short ones are remembered, up to MEMO."""

    def __init__(self, of: Callable[[list[str]], list], known=()):
        super().__init__(known)
        self.of = of

    def values_of(self, lists: list[list[str]]) -> list[list]:
        new = [w for w in set().union(*lists) if w not in self]
        self.update(zip(new, self.of(new)))
        out = [list(map(self.__getitem__, words)) for words in lists]
        full = len(self) > MEMO
        for w in new:
            if full or len(w) >= LONGEST:
                del self[w]
        return out


def lots(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Texts (null as empty) in lists of about LOT characters."""
    lot, size = [], 0
    for text in texts:
        lot.append(text or "")
        size += len(lot[-1])
        if size >= LOT:
            yield lot
            lot, size = [], 0
    yield lot


def ids_of_words(sp, words: list[str]) -> Iterator[list[int]]:
    """Ids of pre-tokens given without their first mark; PART at a time, for with more lists alive Python's collector would pass over them again and again."""
    mark = [sp.piece_to_id(MARK)]
    for at in range(0, len(words), PART):
        part = words[at:at + PART]
        yield from (ids if w else mark for w, ids in zip(part, sp.encode([w.replace(MARK, " ") for w in part], num_threads=1)))


class Counts:
    def __init__(self, model: bytes, split: bool | None = None, whole: list[str] | None = None):
        self.sp = library(model)
        self.split = splittable(model) if split is None else split
        known = dict.fromkeys(whole_words(model) if whole is None else whole, 1)
        self.words = Words(lambda new: list(map(len, ids_of_words(self.sp, new))), known)

    def counts(self, texts: list[str]) -> list[int]:
        if not self.split:
            return [len(ids) for ids in self.sp.encode(texts, num_threads=1)]
        return list(map(sum, self.words.values_of([pre_tokens(t) if t else [] for t in texts])))

    def count(self, text: str) -> int:
        return self.counts([text])[0]


def model_bytes(path: str | None = None) -> bytes:
    """The model file (about half a MB) travels with the job."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    with open(path, "rb") as f:
        return f.read()


def count_tokens(docs: DataFrame, model: bytes | None = None) -> DataFrame:
    """docs with n_tokens (long)."""
    model = model or model_bytes()
    split, whole = splittable(model), whole_words(model)

    @F.arrow_udf("long")
    def n_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counts = Counts(model, split, whole)
        for texts in batches:
            yield pa.array([n for lot in lots(t.as_py() for t in texts) for n in counts.counts(lot)], pa.int64())

    return docs.withColumn("n_tokens", n_tokens("text"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
