"""Benchmark decontamination by a positional inverted index.

The corpus is indexed in segments of whole documents. A segment lays its
documents' words on one line of positions, a free place between documents, and
stores for every word the ascending positions it has there. A phrase is found
by taking its rarest word's positions, moved back by the word's offset, and
intersecting them with the other words' lists from rare to frequent; a
proximity match by searching each word's list around the rarest one's. All
phrases of a block of test items go through a segment at once, those out that
have a word the segment lacks. Test items come in blocks of bounded size, one
after the other, so neither the driver nor a task ever holds them all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintage.llm import common

WINDOW = 10
SEGMENT_BYTES = 4 << 20
#: Bytes of test text searched at once.
BLOCK_BYTES = 4 << 20
#: Positions of rarest words looked at together.
CANDIDATES = 1 << 18
#: Bytes of a word compared at once; longer ones are told apart one by one.
NEAR = 24

#: Words after lower-casing A-Z, in UTF-8: digits, a-z and all bytes beyond ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

INDEX_SCHEMA = "segment long, doc_ids array<long>, n_words array<long>, terms binary, counts binary, positions binary"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*b"0123456789", *b"abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)]] = True
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def words(text: bytes | str | None) -> list[bytes]:
    if not text:
        return []
    return WORD.findall((text.encode() if isinstance(text, str) else text).lower())


def windows(item: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All windows of size words; of fewer words, but not none, the whole."""
    if not item:
        return []
    return [tuple(item[k : k + size]) for k in range(max(1, len(item) - size + 1))]


def _word_lists(texts: list[bytes | None]) -> tuple[list[int], list[bytes], np.ndarray, np.ndarray]:
    """(words of each text, different words, how often each occurs, their places, word by word): places count all texts' words and one free place after each text."""
    raw = b"\0".join([t or b"" for t in texts]) + bytes(NEAR + 1)
    n = len(raw) - NEAR
    data = _LOWER[np.frombuffer(raw, np.uint8)]
    inside = _IN_WORD[data[:n]]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.r_[0, edges]
    at, ends = edges[::2], edges[1::2]
    firsts = np.cumsum([0] + [len(t or b"") + 1 for t in texts])
    document = np.searchsorted(firsts, at, "right") - 1
    n_words = np.bincount(document, minlength=len(texts))[: len(texts)]
    if not len(at):
        return n_words.tolist(), [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = ends - at
    long_words: dict[bytes, int] = {}
    rest = np.zeros(len(at), np.uint64)
    text = data.tobytes()
    for k in np.flatnonzero(size > NEAR).tolist():
        rest[k] = long_words.setdefault(text[at[k] : ends[k]], len(long_words) + 1)
    near = [np.ndarray((len(data) - 7,), "<u8", data.data, 0, (1,))[at + 8 * k] & _KEEP[np.clip(size - 8 * k, 0, 8)] for k in range(NEAR // 8)]
    parts = [*near, rest]
    key = sum((w * m for w, m in zip(parts, _MIX)), size.astype(np.uint64))
    key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    for _ in range(2):
        new = np.r_[True, np.zeros(len(order) - 1, bool)]
        for w in parts:
            sorted_ = w[order]
            new[1:] |= sorted_[1:] != sorted_[:-1]
        if int(new.sum()) == 1 + int((key[order][1:] != key[order][:-1]).sum()):
            break
        order = np.lexsort(parts)  # two words of one key
        key = np.zeros(len(order), np.uint64)
        key[order] = np.cumsum(np.r_[True, np.any([w[order][1:] != w[order][:-1] for w in parts], axis=0)])
    cuts = np.flatnonzero(new)
    terms = [text[a:b] for a, b in zip(at[order[cuts]].tolist(), ends[order[cuts]].tolist())]
    return n_words.tolist(), terms, np.diff(cuts, append=len(order)), (np.arange(len(at)) + document)[order]


class Segment:
    """Postings of one segment: the different words, how often each occurs, and their positions, word by word."""

    def __init__(self, doc_ids: list, n_words: list[int], terms: list[bytes], counts: np.ndarray, positions: np.ndarray):
        self.doc_ids, self.n_words = doc_ids, np.array(n_words, np.int64)
        self.terms, self.counts, self.positions = terms, counts, positions
        self.cuts = np.cumsum(counts) - counts
        self.number = {t: k for k, t in enumerate(terms)}
        # A place stays free between documents, so that no phrase crosses from one into the next.
        self.bases = (np.cumsum(self.n_words + 1) - (self.n_words + 1)).astype(np.int64)

    @classmethod
    def index(cls, doc_ids: list, texts: list[bytes | None], terms: set[bytes] | None = None) -> Segment:
        """Index texts: every word, or with terms those only."""
        n_words, found, counts, positions = _word_lists(texts)
        if terms is not None:
            kept = np.array([t in terms for t in found], bool)
            positions, counts = positions[np.repeat(kept, counts)], counts[kept]
            found = [t for t, k in zip(found, kept) if k]
        return cls(doc_ids, n_words, found, counts, positions)

    def row(self) -> tuple[list, list, bytes, bytes, bytes]:
        """doc_ids, n_words, terms, counts and positions as they are stored: words hold no line end, positions are steps from one to the next."""
        steps = np.diff(self.positions, prepend=0)
        steps[self.cuts] = self.positions[self.cuts]
        return self.doc_ids, self.n_words.tolist(), b"\n".join(self.terms), self.counts.astype("<u4").tobytes(), steps.astype("<u4").tobytes()

    @classmethod
    def load(cls, doc_ids: list, n_words: list[int], terms: bytes, counts: bytes, positions: bytes) -> Segment:
        n = np.frombuffer(counts, "<u4").astype(np.int64)
        upto = np.cumsum(np.frombuffer(positions, "<u4"), dtype=np.int64)
        starts = np.cumsum(n) - n
        before = np.r_[0, upto][starts]
        return cls(doc_ids, n_words, terms.split(b"\n") if len(n) else [], n, upto - np.repeat(before, n))

    def phrase(self, phrase: tuple[bytes, ...]) -> np.ndarray:
        """Positions at which the words of phrase follow one another."""
        return self.matches(Phrases([("", phrase)]))[1]

    def near(self, terms: tuple[bytes, ...], within: int) -> np.ndarray:
        """Positions of the rarest of terms in a document around which each other term stands at most within words away."""
        return self.matches(Phrases([("", tuple(dict.fromkeys(terms)))]), within)[1]

    def matches(self, phrases: Phrases, within: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position) of all exact matches, or with within of the rarest words around which all the others stand."""
        number = np.array([self.number.get(t, -1) for t in phrases.terms] + [-1], np.int64)
        words = number[phrases.words]
        pad = phrases.words < 0
        alive = np.flatnonzero(((words >= 0) | pad).all(1))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if len(alive):
            words, pad = words[alive], pad[alive]
            frequent = np.where(pad, np.iinfo(np.int64).max, self.counts[words])
            by = np.argsort(frequent, axis=1, kind="stable")  # offsets from rare to frequent
            ranked = np.take_along_axis(np.where(pad, -1, words), by, 1)
            sizes = self.counts[ranked[:, 0]]
            # One ascending line of (word, position) for the words asked for.
            asked = np.unique(ranked[ranked >= 0])
            line = np.repeat(asked << 40, self.counts[asked]) + self.positions[_ranges(self.cuts[asked], self.counts[asked])]
            ends = np.cumsum(sizes)
            a = 0
            while a < len(alive):
                b = max(a + 1, int(np.searchsorted(ends, ends[a] - sizes[a] + CANDIDATES, "right")))
                own = np.repeat(np.arange(a, b), sizes[a:b])
                place = self.positions[_ranges(self.cuts[ranked[a:b, 0]], sizes[a:b])]
                if within is None:
                    place = place - by[own, 0]
                for k in range(1, ranked.shape[1]):
                    word = ranked[own, k]
                    if within is None:
                        key = (word << 40) + place + by[own, k]
                        at = np.searchsorted(line, key)
                        kept = (word < 0) | (line[np.minimum(at, len(line) - 1)] == key)
                    else:
                        document = self.document(place)
                        low = np.maximum(place - within, self.bases[document])
                        high = np.minimum(place + within, self.bases[document] + self.n_words[document] - 1)
                        kept = (word < 0) | (np.searchsorted(line, (word << 40) + low, "left") < np.searchsorted(line, (word << 40) + high, "right"))
                    own, place = own[kept], place[kept]
                    if not len(own):
                        break
                found.append((alive[own], place))
                a = b
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        own, place = (np.concatenate(c) for c in zip(*found))
        return own, place

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bases, positions, "right") - 1


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] places, then those of the next."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Phrases:
    """Different phrases of a block of test items as rows of word numbers, and the items that hold each."""

    def __init__(self, phrases: list[tuple[str, tuple[bytes, ...]]]):
        by_phrase: dict[tuple[bytes, ...], set[str]] = {}
        for name, phrase in phrases:
            if phrase:
                by_phrase.setdefault(phrase, set()).add(name)
        number: dict[bytes, int] = {}
        width = max(map(len, by_phrase), default=1)
        self.words = np.full((len(by_phrase), width), -1, np.int32)
        for k, phrase in enumerate(by_phrase):
            self.words[k, : len(phrase)] = [number.setdefault(w, len(number)) for w in phrase]
        self.terms, self.names = list(number), [sorted(x) for x in by_phrase.values()]
        self.sizes = (self.words >= 0).sum(1)


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of docs (doc_id, text): a row a segment, postings of every word."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        for batch in common.bounded(batches, "text", SEGMENT_BYTES):
            row = Segment.index(batch.column(0).to_pylist(), common.byte_list(batch.column(1))).row()
            kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([task << 32 | made], pa.int64()), *(pa.array([x], t) for x, t in zip(row, kinds))], ["segment", "doc_ids", "n_words", "terms", "counts", "positions"])
            made += 1

    return common.written(common.map_batches(docs.select("doc_id", "text"), segments, INDEX_SCHEMA), "postings")


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint spans that cover the same places."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > reach[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(starts) - 1]
    return starts[new], reach[last]


FOUND_SCHEMA = "segment long, place int, names array<string>, near array<string>, starts array<long>, ends array<long>"


def search(index: DataFrame, phrases: list[tuple[str, tuple[bytes, ...]]], within: int | None = None) -> DataFrame:
    """Matches of phrases (name, words) in index: a row for each document row that has one.

    segment, place (in it), names (of the phrases found exactly, in order,
    once each), starts and ends (disjoint spans of the words they cover) and,
    with within, near: names of the phrases whose words all stand at most that
    many words around the rarest of them.
    """
    sent = index.sparkSession.sparkContext.broadcast(Phrases(phrases))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        asked = sent.value

        def named(segment: Segment, own: np.ndarray, place: np.ndarray) -> dict[int, list[str]]:
            both = np.unique(np.stack([segment.document(place), own], 1), axis=0) if len(own) else ()
            out: dict[int, set[str]] = {}
            for d, k in both.tolist() if len(both) else ():
                out.setdefault(d, set()).update(asked.names[k])
            return {d: sorted(x) for d, x in out.items()}

        for batch in batches:
            for k in range(batch.num_rows):
                number, *stored = (c[k].as_py() for c in batch.columns)
                segment = Segment.load(*stored)
                own, place = segment.matches(asked)
                exact, spans = named(segment, own, place), {}
                close = named(segment, *segment.matches(asked, within)) if within is not None else {}
                if len(own):
                    a, b = _merged(place, place + asked.sizes[own])
                    # Spans that touch may belong to two documents only with the free place between, which no span covers.
                    d = segment.document(a)
                    cuts = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
                    for x, y in zip(cuts, [*cuts[1:], len(d)]):
                        base = segment.bases[d[x]]
                        spans[int(d[x])] = ((a[x:y] - base).tolist(), (b[x:y] - base).tolist())
                hit = sorted({*exact, *close})
                if hit:
                    columns = [[number] * len(hit), hit, [exact.get(d, []) for d in hit], [close.get(d, []) for d in hit], *([spans.get(d, ([], []))[side] for d in hit] for side in (0, 1))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["segment", "place", "names", "near", "starts", "ends"])

    return common.map_batches(index, rows, FOUND_SCHEMA)


def _covered(spans: Column) -> Column:
    """Places that sorted spans cover."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("upto"))
    step = lambda acc, s: F.struct((acc["total"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], acc["upto"]))).alias("total"), F.greatest(s["end"], acc["upto"]).alias("upto"))
    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["total"])


def blocks_of(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The test items (id as text, null: empty; text) in blocks of at most limit bytes or one item, read one partition at a time."""
    block, size = [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text")).toLocalIterator():
        if size and size + len(row["text"]) > limit:
            yield block
            block, size = [], 0
        block.append((row["item"], row["text"]))
        size += len(row["text"])
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES, within: int | None = None) -> DataFrame:
    """For each row of docs: segment, place, doc_id, n_words, names (items with a window in it), near (with within: items whose windows' words all stand near) and spans (hit words).

    The index is built once and searched with one block of test items after
    the other; what each block finds is kept in the shared folder.
    """
    spark = docs.sparkSession
    index = build_index(docs)
    path = common.scratch_path(spark, "matches")
    spark.createDataFrame([], FOUND_SCHEMA).write.parquet(path)
    for block in blocks_of(benchmark, block_bytes):
        search(index, [(item, w) for item, text in block for w in windows(words(text), size)], within).write.mode("append").parquet(path)
    spans = F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end"))
    meet = lambda c: F.flatten(F.collect_list(c)).alias(c)
    found = spark.read.schema(FOUND_SCHEMA).parquet(path).withColumn("spans", spans).groupBy("segment", "place").agg(meet("names"), meet("near"), meet("spans"))
    rows = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("place", "d")).select("segment", "place", "d.doc_ids", "d.n_words")
    joined = rows.withColumnRenamed("doc_ids", "doc_id").join(found, ["segment", "place"], "left")
    names = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))).alias(c)
    return joined.select("segment", "place", "doc_id", "n_words", names("names"), names("near"), F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row for each row of docs.

    Null and empty texts have no words; repeated ids keep a row each. Items
    of one id count once; a null id is the empty text. Without test items
    nothing is hit.
    """
    found = matches(docs, benchmark, size, block_bytes)
    found = found.select("doc_id", "n_words", _covered(F.col("spans")).alias("n_hit"), F.col("names").alias("items"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
