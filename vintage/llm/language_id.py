"""Language identification by prediction with partial matching (PPM).

For each language a tree of byte contexts up to ORDER bytes long holds how
often each byte followed. A byte costs -log2 of its probability in the longest
context seen, or of the escape from there (method C) to the next shorter one,
down to 1/256. All 256 bytes and all contexts of the sample count. Statistics
are frozen after training: a language keeps the cost of each string seen and
of each context's escape in sorted arrays, 12 bytes or so for each distinct
string of its sample. The distinct strings of many texts are looked up once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintage.llm import common

ORDER = 3
FOLDS, HELD_OUT = 5, 0
#: Documents to learn from for each language, at most.
TRAIN_DOCS = 2_000
#: Occurrences that make a context count: one.
LEAST_CONTEXT = 1
UNDETERMINED = "und"

PAD = b"\n" * ORDER
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


@dataclass
class Tree:
    """Costs in bits after the contexts of one language."""

    strings: list[np.ndarray]  # by order: context and byte, big-endian, ascending
    costs: list[np.ndarray]  # of each string's last byte
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]  # of each context

    @classmethod
    def grow(cls, codes: np.ndarray, counts: np.ndarray) -> Tree:
        """From the (ORDER + 1)-byte strings seen and their counts, by method C."""
        out: tuple[list, list, list, list] = ([], [], [], [])
        for order in range(ORDER + 1):
            own, place = np.unique(codes.astype(np.int64) & (1 << 8 * (order + 1)) - 1, return_inverse=True)
            seen = np.bincount(place, counts, len(own))
            contexts, of = np.unique(own >> 8, return_inverse=True)
            kinds, sums = np.bincount(of), np.bincount(of, seen)
            for column, values in zip(out, (own, np.log2((sums + kinds)[of] / seen), contexts, np.log2((sums + kinds) / kinds))):
                column.append(values.astype(np.int64 if values.dtype.kind == "i" else np.float32))
        return cls(*out)

    def cost(self, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Bits of the last byte of each string of ORDER + 1 bytes."""
        if order < 0:
            return np.full(len(codes), 8.0, np.float32)
        own = codes & (1 << 8 * (order + 1)) - 1
        at, seen = _find(self.strings[order], own)
        out = np.zeros(len(codes), np.float32)
        out[seen] = self.costs[order][at[seen]]
        rest = np.flatnonzero(~seen)
        if len(rest):
            below, known = _find(self.contexts[order], own[rest] >> 8)
            escape = np.zeros(len(rest), np.float32)
            escape[known] = self.escapes[order][below[known]]
            out[rest] = escape + self.cost(codes[rest], order - 1)
        return out


def _find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each number asked for in ascending keys."""
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


_SLOTS = 1 << 20


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 32-bit codes, and the place of each code among them: as np.unique, but sorting only what meets in a slot."""
    slots = ((codes * np.uint32(0x9E3779B1)) >> np.uint32(12)).astype(np.int64)
    table = np.zeros(_SLOTS, np.int32)
    table[slots] = np.arange(len(codes), dtype=np.int32)
    rep = table[slots]
    same = codes[rep] == codes
    mark = np.zeros(len(codes), bool)
    mark[rep] = True  # each is its own representative
    place = (np.cumsum(mark) - 1)[rep]
    rest, code = np.unique(codes[~same], return_inverse=True)
    place[~same] = int(mark.sum()) + code
    return np.r_[codes[mark], rest], place


@dataclass
class Model:
    languages: list[str]
    trees: list[Tree]

    @classmethod
    def fit(cls, grams: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
        """grams: for each language the (ORDER + 1)-byte strings seen, big-endian in 32 bits, and their counts."""
        languages = sorted(grams)
        return cls(languages, [Tree.grow(*grams[name]) for name in languages])

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        out = np.zeros((len(texts), len(self.languages)))
        full = [k for k, t in enumerate(texts) if t]
        if not full:
            return out
        b = np.frombuffer(b"".join(PAD + texts[k] for k in full), np.uint8).astype(np.uint32)
        sizes = np.array([len(texts[k]) for k in full])
        starts = np.cumsum(sizes + ORDER) - (sizes + ORDER)
        # Strings that end in a text's padding are no one's.
        inside = np.ones(len(b) - ORDER, bool)
        for s in starts[1:].tolist():
            inside[s - ORDER : s] = False
        codes, place = _distinct((b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:])[inside])
        wide = codes.astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        for k, tree in enumerate(self.trees):
            out[full, k] = np.add.reduceat(tree.cost(wide)[place], begins, dtype=np.float64)
        return out

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
        """The language of the shortest code, and its share when each language weighs 2^-bits."""
        known = [t if t and _has_letter(t) else b"" for t in texts]
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        bits = self.code_lengths(known)
        best = bits.argmin(1)
        weight = np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000))
        score = np.where([bool(t) for t in known], 1 / weight.sum(1), 0.0)
        return [self.languages[b] if t else UNDETERMINED for b, t in zip(best, known)], score


def _has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def train(docs: DataFrame, per_language: int = TRAIN_DOCS) -> Model:
    """Learn from at most per_language documents of each language outside the held-out fold, chosen by a hash of the id.

    What reaches the driver is the sample's distinct 4-byte strings and their counts.
    """
    usable = docs.where("text IS NOT NULL AND lang IS NOT NULL AND length(text) > 0").where(common.crc_of_id() % FOLDS != HELD_OUT)
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, int(min(1.0, per_language / n) * (1 << 30))).otherwise(share)
    sample = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share).select("text", "lang")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.bounded(batches, "text"):
            texts, langs = common.byte_list(batch.column(0)), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                codes = []
                for text, own in zip(texts, langs):
                    if own == lang:
                        b = np.frombuffer(PAD + text, np.uint8).astype(np.uint32)
                        codes.append(b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:])
                found, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(found.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counted = sample.mapInArrow(grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return Model.fit({lang: (own["gram"].to_numpy(np.uint32), own["n"].to_numpy()) for lang, own in counted.groupby("lang")})


def language_id(docs: DataFrame, per_language: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row a document.

    Null texts and texts without a letter are und with score 0; equal code
    lengths give the first language by name; nothing to learn from makes all
    und. Repeated ids keep their rows; extra columns are not looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, per_language))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.bounded(batches, "text", 1 << 20):
            found, score = sent.value.predict(common.byte_list(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, lang_pred string, score double")
    return scored.select("doc_id", (common.crc_of_id() % FOLDS == HELD_OUT).alias("held_out"), "lang_pred", "score")
