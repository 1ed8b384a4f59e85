"""Quality classifier: nearest neighbours among labelled latent-semantic vectors.

A text is a bag of terms: pairs of neighbouring byte classes (letters, digits
as one class, capitals as one, each ASCII sign on its own) and a few terms for
repetition. Counts are damped and weighted by rarity, projected on the leading
singular vectors of the labelled sample, and normalised. Every document's
vector is compared with every labelled vector, exactly, in blocks; the most
similar vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintage.llm import common

#: Labelled rows to fit on, at most.
TRAIN_ROWS = 3_000
RANK = 48
NEIGHBOURS = 15
#: Documents compared with all labelled vectors at once.
ROWS = 128
#: Similarities that differ by no more are equal.
TIE = 1e-6
THRESHOLD = 0.7
HELD_OUT = 2
FOLDS = 4

CLASSES = 64
#: Quarters of a text's lines, and of its three-word windows, that repeat earlier ones: a term each, of a fixed weight.
REPEATS = 8
REPEAT_WEIGHT = 12.0
LEAST_REPEATED = 0.05
TERMS = CLASSES * CLASSES + REPEATS


def _class_table() -> np.ndarray:
    """Byte to class: 0 control, 1 blank, 2 newline, 3 digit, 4 capital, 5 beyond ASCII, 6..31 letters, 32.. signs."""
    table = np.zeros(256, np.uint8)
    table[0x20], table[0x0A] = 1, 2
    table[ord("0") : ord("9") + 1], table[ord("A") : ord("Z") + 1], table[0x80:] = 3, 4, 5
    table[ord("a") : ord("z") + 1] = np.arange(6, 32)
    signs = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
    table[signs] = np.arange(32, 32 + len(signs)).clip(max=63)
    return table


TABLE = _class_table()


def term_counts(text: bytes | None) -> np.ndarray:
    """Counts of all TERMS as a share of the text, damped."""
    out = np.zeros(TERMS, np.float32)
    if not text:
        return out
    kinds = TABLE[np.frombuffer(text, np.uint8)].astype(np.int32)
    if len(kinds) > 1:
        pairs = np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=CLASSES * CLASSES)
        out[: CLASSES * CLASSES] = np.log1p(pairs * (1000.0 / len(kinds)))
    words = text.split()
    for k, units in enumerate(([x for x in text.split(b"\n") if x.strip()], list(zip(words, words[1:], words[2:])))):
        share = 1 - len(set(units)) / len(units) if len(units) > 3 else 0
        if share > LEAST_REPEATED:
            out[CLASSES * CLASSES + 4 * k + min(3, int(share * 4))] = REPEAT_WEIGHT
    return out


@dataclass
class Model:
    weights: np.ndarray  # rarity of each term
    axes: np.ndarray  # TERMS x rank
    vectors: np.ndarray  # labelled rows x rank, of length 1 or 0
    labels: np.ndarray
    neighbours: int = NEIGHBOURS

    @classmethod
    def fit(cls, counts: np.ndarray, labels: np.ndarray, rank: int = RANK, neighbours: int = NEIGHBOURS) -> Model:
        """Truncated SVD by a fixed random sketch and two power steps."""
        n = len(counts)
        weights = np.log((1 + n) / (1 + (counts > 0).sum(0))).astype(np.float32) + 0.1
        weighted = _unit(counts * weights)
        rank = min(rank, max(1, n))
        sketch = np.random.default_rng(11).standard_normal((counts.shape[1], rank + 8)).astype(np.float32)
        found = weighted @ sketch
        for _ in range(2):
            found = weighted @ (weighted.T @ np.linalg.qr(found)[0])
        basis = np.linalg.qr(found)[0]
        _, _, right = np.linalg.svd(basis.T @ weighted, full_matrices=False)
        axes = np.ascontiguousarray(right[:rank].T, np.float32)
        return cls(weights, axes, _unit(weighted @ axes), np.asarray(labels, np.float32), neighbours)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest; without any similar row, the share in the sample."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        similar = _unit(_unit(counts * self.weights) @ self.axes) @ self.vectors.T
        k = min(self.neighbours, len(self.labels))
        last = np.partition(similar, len(self.labels) - k, axis=1)[:, len(self.labels) - k, None]
        # Rows as similar as the last neighbour, copies of one text above all, share its place among the neighbours.
        above, level = similar > last + TIE, np.abs(similar - last) <= TIE
        part = (k - above.sum(1)) / level.sum(1)
        near, other = np.where(above, np.maximum(similar, 0), 0), np.where(level, np.maximum(similar, 0), 0)
        total = near.sum(1, dtype=np.float64) + part * other.sum(1, dtype=np.float64)
        good = self.labels > 0.5
        share = (near[:, good].sum(1, dtype=np.float64) + part * other[:, good].sum(1, dtype=np.float64)) / np.maximum(total, 1e-12)
        return np.where(total > 1e-9, share.clip(0, 1), float(self.labels.mean()))


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most rows labelled documents outside the held-out fold, chosen by a hash of the id."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(common.crc_of_id() % FOLDS != HELD_OUT).select("doc_id", "quality")
    n = known.count()
    if n > rows:
        known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.bounded(batches, "text"):
            counts = [term_counts(t).astype(np.float16).tobytes() for t in common.byte_list(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.binary())], ["doc_id", "quality", "counts"])

    # Broadcast: rows ids at most.
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", F.col("quality").cast("int"))
    found = common.map_batches(texts, vectors, "doc_id long, quality int, counts binary").collect()
    found = sorted(found, key=lambda r: (r["doc_id"], r["counts"]))
    counts = np.array([np.frombuffer(r["counts"], np.float16) for r in found], np.float32).reshape(len(found), TERMS)
    return Model.fit(counts, np.array([r["quality"] == 1 for r in found]))


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The keep columns of docs with score and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.bounded(batches, "scored_text", 4 << 20):
            texts, scores = common.byte_list(batch.column(0)), []
            for at in range(0, len(texts), ROWS):
                scores.append(sent.value.score(np.array([term_counts(t) for t in texts[at : at + ROWS]])))
            found = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays([batch.column(k + 1) for k in range(len(keep))] + [pa.array(found, pa.float64()), pa.array((found >= THRESHOLD).astype(np.int32))], [*keep, "score", "predicted"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["score double", "predicted int"])
    return common.map_batches(docs.select(F.col("text").alias("scored_text"), *keep), rows, schema)


def quality_classifier(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted: one row a document.

    Null and empty texts have no terms and get the sample's share of label 1.
    Rows as similar as the last of the neighbours share its place alike.
    Repeated ids keep their rows. Without labels every score is 0.5.
    """
    scored = score(docs, train(docs, labels, rows), "doc_id")
    return scored.select("doc_id", (common.crc_of_id() % FOLDS == HELD_OUT).alias("held_out"), "score", "predicted")
