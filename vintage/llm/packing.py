"""Best-fit packing of pieces into sequences by exact complements.

The plan is made on the histogram of piece lengths alone, at most capacity
counts whatever the corpus is: take the longest length left, look for one, two
or three available lengths that exactly fill its gap (indexes of single, pair
and triple sums), else put the longest length that fits and look again. Each
pattern found is used as often as the counts allow. Pieces then find their
place from their length and their rank among the pieces of that length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintage.llm import common, tokens

CAPACITY = 2048


class SumIndex:
    """Which lengths, pair sums and triple sums the available pieces make."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self._refresh()

    def _refresh(self) -> None:
        self.has = self.counts > 0
        self.pairs = np.convolve(self.has, self.has) > 0

    def consume(self, pattern: Counter, times: int) -> None:
        gone = False
        for length, need in pattern.items():
            self.counts[length] -= need * times
            gone |= self.counts[length] == 0
        if gone:
            self._refresh()

    def _pair(self, total: int, used: Counter) -> tuple[int, int] | None:
        """Two lengths that sum to total, the longest first, as far as counts beyond used allow."""
        firsts = np.arange((total + 1) // 2, total)
        for a in firsts[self.has[firsts] & self.has[total - firsts]][::-1].tolist():
            if self.free(Counter([a, total - a]), used):
                return a, total - a
        return None

    def free(self, wanted: Counter, used: Counter) -> bool:
        return all(self.counts[x] >= n + used[x] for x, n in wanted.items())

    def fill(self, gap: int, used: Counter) -> list[int] | None:
        """One, two or three lengths that sum to gap exactly."""
        if self.free(Counter([gap]), used):
            return [gap]
        if gap >= 2 and self.pairs[gap] and (pair := self._pair(gap, used)):
            return list(pair)
        if gap >= 3:
            firsts = np.arange(1, gap - 1)
            for a in firsts[self.has[firsts] & self.pairs[gap - firsts]][::-1].tolist():
                if self.free(Counter([a]), used) and (pair := self._pair(gap - a, used + Counter([a]))):
                    return [a, *pair]
        return None

    def longest_within(self, gap: int, used: Counter) -> int | None:
        for a in np.flatnonzero(self.has[: gap + 1])[::-1].tolist():
            if self.free(Counter([a]), used):
                return a
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one sequence) and how many sequences use each."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        counts[length] += n
    index, patterns = SumIndex(counts), []
    longest = capacity
    while True:
        while longest and not counts[longest]:
            longest -= 1
        if not longest:
            return patterns
        pattern, gap = [longest], capacity - longest
        used = Counter(pattern)
        while gap:
            more = index.fill(gap, used)
            if more is None:
                one = index.longest_within(gap, used)
                if one is None:
                    break
                more = [one]
            pattern += more
            used.update(more)
            gap -= sum(more)
        times = min(int(counts[x]) // n for x, n in used.items())
        patterns.append((tuple(pattern), times))
        index.consume(used, times)


def _runs(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """For each run of ranks of a length: length, first rank, first sequence, offset; sorted by length and rank."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, taken[length], sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    rows.sort()
    return tuple(np.array([r[k] for r in rows], np.int64) for k in range(4))


def cut(n_ids: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only a document over capacity is cut, its first piece takes the remainder."""
    if n_ids <= capacity:
        return [(0, n_ids)]
    first = n_ids % capacity
    return [(0, first)] * (first > 0) + [(s, capacity) for s in range(first, n_ids, capacity)]


def tokenized_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of docs (doc_id, text; null: empty): doc_id, piece, start, length, ids_crc32 (and ids), and part, the task that made them."""
    vocabulary = vocabulary or tokens.default_vocabulary()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.bounded(batches, "text", tokens.BATCH_BYTES):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokens.documents_ids(vocabulary, batch.column(1).to_pylist())):
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, k, start, length, tokens.crc(own), own)[: len(names)])
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return common.map_batches(docs.select("doc_id", "text"), pieces, schema, encodes=True).withColumn("part", F.spark_partition_id())


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (a stored table with length and part, the storing task) with sequence_id and offset in place of part.

    Lengths are from 1 to capacity. An empty table stays empty. Ranks among
    pieces of a length come from counts by (part, length), so that a length
    that a third of the pieces have is ranked by many tasks. What reaches the
    driver is the histogram: capacity counts at most; the plan sent back holds
    a bounded number of runs for each length.
    """
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    lengths, lows, sequences, offsets = _runs(plan(histogram, capacity))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = lengths << 44 | lows
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            at = np.searchsorted(keys, length << 44 | rank, "right") - 1
            kept = [k for k, name in enumerate(batch.schema.names) if name != "rank"]
            columns = [batch.column(k) for k in kept] + [pa.array(sequences[at] + rank - lows[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays(columns, [batch.schema.names[k] for k in kept] + ["sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = [c for c in ("doc_id", "piece") if c in pieces.columns] or ["length"]
    ranked = pieces.withColumn("local", F.row_number().over(Window.partitionBy("part", "length").orderBy(*order)))
    ranked = ranked.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("local") - 1).drop("part", "base", "local")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("rank").schema)
    return common.map_batches(ranked, places, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids), one row a piece.

    Every document has a piece: an empty or null text is the end id alone.
    Equal and null doc_ids keep a row each. Extra columns are ignored.
    """
    pieces = common.written(tokenized_pieces(docs, vocabulary, capacity, with_ids), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    return pack(pieces, capacity).select(*columns)
