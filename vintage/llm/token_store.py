"""Token-ID output: concatenated id arrays with Elias-Fano document boundaries.

A file holds one shard: the documents of a range of ids, in ascending order.

    8 bytes  magic "VTOKENS2"
    u32 x 6  shard partition, shard number in it, bytes an id (2 or 4), low bits an end, low bits a doc_id, documents without a doc_id (m, the first ones)
    u64 x 2  documents (n), ids (u)
    i64, u64 smallest doc_id, largest less smallest (v)
    ends     Elias-Fano: n values up to u, ids up to and with each document
    doc_ids  Elias-Fano: n - m values up to v, doc_id less the smallest
    ids      u of them

An Elias-Fano sequence of n values up to u, l low bits each:

    low      the values' low bits, packed
    high     unary: value i sets bit (value >> l) + i of n + (u >> l) + 1 bits
    select   u32 place of every 64th set bit of high

It costs 2 + log2(u / n) bits a value and no 64-bit table; select() finds any
of its values from a sample and a popcount scan of a few bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vintage.llm import common, tokens

MAGIC = b"VTOKENS2"
HEADER = struct.Struct("<8s6I2QqQ")
SELECT_STEP = 64
SHARD_IDS = 4_000_000
SHARD_DOCUMENTS = 1 << 18
#: Bytes of a text by which rows of one doc_id are ordered.
HEAD_BYTES = 32
#: Place of the k-th set bit of each byte.
_PLACES = np.array([([b for b in range(8) if x >> b & 1] + [8] * 8)[:8] for x in range(256)], np.int64)


class EliasFano:
    """A monotone sequence of n integers up to u."""

    def __init__(self, n: int, u: int, low_bits: int, low: np.ndarray, high: np.ndarray, select: np.ndarray):
        self.n, self.u, self.l, self.low, self.high, self.samples = n, u, low_bits, low, high, select

    @staticmethod
    def low_width(n: int, u: int) -> int:
        return max(0, (u // n).bit_length() - 1) if n else 0

    @classmethod
    def sizes(cls, n: int, u: int, l: int) -> tuple[int, int, int]:
        return (n * l + 7) // 8, (n + (u >> l) + 8) // 8, (n + SELECT_STEP - 1) // SELECT_STEP * 4

    @classmethod
    def build(cls, values: np.ndarray, u: int) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        l = cls.low_width(n, u)
        low_size, high_size, _ = cls.sizes(n, u, l)
        bits = ((values[:, None] >> np.arange(l, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
        low = np.packbits(bits, bitorder="little") if l and n else np.zeros(0, np.uint8)
        places = (values >> np.uint64(l)).astype(np.int64) + np.arange(n)
        unary = np.zeros(high_size * 8, np.uint8)
        unary[places] = 1
        assert len(low) == low_size
        return cls(n, u, l, low, np.packbits(unary, bitorder="little"), places[::SELECT_STEP].astype("<u4"))

    def to_bytes(self) -> bytes:
        return self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_buffer(cls, data, n: int, u: int, l: int) -> tuple[EliasFano, int]:
        a, b, c = cls.sizes(n, u, l)
        part = lambda at, size, kind: np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at)
        return cls(n, u, l, part(0, a, np.uint8), part(a, b, np.uint8), part(a + b, c, "<u4")), a + b + c

    def select(self, i) -> np.ndarray:
        """The i-th values, for a number or an array of numbers."""
        i = np.asarray(i, np.int64)
        at = self.samples[i // SELECT_STEP].astype(np.int64)
        left = np.array(i % SELECT_STEP)
        byte = at >> 3
        value = self.high[byte] & (0xFF << (at & 7) & 0xFF).astype(np.uint8)
        open_ = np.ones(i.shape, bool)
        while True:
            ones = np.bitwise_count(value).astype(np.int64)
            open_ &= ones <= left
            if not open_.any():
                break
            left -= np.where(open_, ones, 0)
            byte = byte + open_
            value = np.where(open_, self.high[np.minimum(byte, len(self.high) - 1)], value)
        high = (byte * 8 + _PLACES[value, left] - i).astype(np.uint64) << np.uint64(self.l)
        first, low = i * self.l, np.zeros(i.shape, np.uint64)
        for k in range(self.l):
            bit = first + k
            low |= (self.low[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(np.uint64) << np.uint64(k)
        return high | low

    def values(self) -> np.ndarray:
        """All values at once."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.l)
        if not self.l or not self.n:
            return high
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.l].reshape(self.n, self.l).astype(np.uint64)
        return high | (bits << np.arange(self.l, dtype=np.uint64)).sum(1, dtype=np.uint64)


def encode_shard(partition: int, number: int, doc_ids: list[int | None], pieces: list[np.ndarray]) -> bytes:
    """The bytes of one shard from its documents' ids, each given as an array; doc_ids ascend, None first."""
    n = len(doc_ids)
    ends = np.cumsum([len(p) for p in pieces], dtype=np.uint64) if n else np.zeros(0, np.uint64)
    u = int(ends[-1]) if n else 0
    ids = np.concatenate(pieces) if n else np.zeros(0, "<u2")
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    known = [d for d in doc_ids if d is not None]
    least, v = (known[0], known[-1] - known[0]) if known else (0, 0)
    # Differences of 64-bit numbers, unsigned.
    above = np.array(known, np.int64).view(np.uint64) - np.array([least], np.int64).view(np.uint64)
    boundaries, names = EliasFano.build(ends, u), EliasFano.build(above, v)
    head = HEADER.pack(MAGIC, partition, number, width, boundaries.l, names.l, n - len(known), n, u, least, v)
    return head + boundaries.to_bytes() + names.to_bytes() + ids.astype(f"<u{width}").tobytes()


def decode_shard(data: bytes) -> tuple[int, int, list[int | None], EliasFano, np.ndarray]:
    """(partition, number, doc_ids, ends, ids) of a shard; bytes after its end are ignored."""
    view = memoryview(data)
    if len(view) < HEADER.size or bytes(view[: len(MAGIC)]) != MAGIC:
        raise ValueError("not a token shard")
    _, partition, number, width, end_bits, id_bits, nulls, n, u, least, v = HEADER.unpack_from(view)
    ends, used = EliasFano.from_buffer(view[HEADER.size :], n, u, end_bits)
    at = HEADER.size + used
    names, used = EliasFano.from_buffer(view[at:], n - nulls, v, id_bits)
    known = (names.select(np.arange(n - nulls)) + np.array([least], np.int64).view(np.uint64)).view(np.int64)
    return partition, number, [None] * nulls + known.tolist(), ends, np.frombuffer(view, f"<u{width}", u, at + used)


def _cuts(docs: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """Partitions for rows without a doc_id, and the doc_ids up to which the others but the last reach; a frequent one stands several times."""
    fractions = [k / n for k in range(1, n)]
    found = docs.agg(F.count("*").alias("rows"), F.count("doc_id").alias("known"), F.percentile_approx("doc_id", fractions, max(10_000, 20 * n)).alias("cuts") if fractions else F.array().alias("cuts")).first()
    if not found["known"]:
        return n, np.zeros(0, np.int64)
    nulls = -(-n * (found["rows"] - found["known"]) // found["rows"])
    return nulls, np.array(found["cuts"], np.int64)


def write(docs: DataFrame, path: str, vocabulary: str | None = None, shard_ids: int = SHARD_IDS) -> None:
    """Encode every text of docs (doc_id, text; null: empty) and write shard files below path.

    Texts are encoded where they are read, and their ids dealt by ranges of
    doc_id and sorted, so that (partition, number) orders shards as their
    documents' ids. Nulls come first. Rows of one doc_id are ordered by the
    first bytes of their texts; if they fill several partitions, they are
    dealt over those by a hash of the text. An empty table gives no shard.
    Memory: one shard of shard_ids ids and one document.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or tokens.default_vocabulary()
    n = common.partitions(spark)
    nulls, cuts = _cuts(docs, n)
    kind = tokens.id_kind(vocabulary)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.bounded(batches, "text", tokens.BATCH_BYTES):
            texts = batch.column(1).to_pylist()
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            doc_ids = batch.column(0).fill_null(0).to_numpy()
            low, high = np.searchsorted(cuts, doc_ids, "left"), np.searchsorted(cuts, doc_ids, "right")
            dealt = np.where(known, nulls + low, 0)
            for k in np.flatnonzero(np.where(known, high - low, nulls) > 1).tolist():
                dealt[k] += zlib.crc32((texts[k] or "").encode()) % int(high[k] - low[k] if known[k] else nulls)
            heads = [None if t is None else t[:HEAD_BYTES].encode()[:HEAD_BYTES] for t in texts]
            ids = [np.append(own, tokens.END_ID).astype(kind).tobytes() for own in tokens.encoder(vocabulary).batch(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(dealt.astype(np.int32)), batch.column(0), pa.array(heads, pa.binary()), pa.array(ids, pa.binary())], ["dealt", "doc_id", "head", "ids"])
            common.give_back()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        partition, number, ids, pieces, size = None, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([encode_shard(partition, number, ids, pieces)], pa.binary())], ["shard"])

        for batch in batches:
            for own, doc_id, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if ids and (own != partition or size >= shard_ids or len(ids) >= SHARD_DOCUMENTS):
                    yield flush()
                    number, ids, pieces, size = number + 1, [], [], 0
                partition = own
                ids.append(doc_id)
                pieces.append(np.frombuffer(piece.as_buffer(), kind).copy())
                size += len(pieces[-1])
        if ids:
            yield flush()

    rows = docs.select("doc_id", "text").mapInArrow(encoded, "dealt int, doc_id long, head binary, ids binary")
    rows = rows.repartitionById(nulls + len(cuts) + 1, F.col("dealt")).sortWithinPartitions("dealt", "doc_id", "head", F.length("ids"), F.crc32("ids"))
    # One row a file. The text writer puts a string's bytes down as they are, UTF-8 or not; the round trips in the tests would notice if it did not.
    rows.select("dealt", "doc_id", "ids").mapInArrow(shards, "shard binary").select(F.col("shard").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """The documents of the shard files below path: shard place, doc_id, start, n_tokens, ids_crc32 (and ids).

    start counts the ids of all documents before, over all shards. The files
    are read once; what they say of their documents is a table in the shared folder.
    """
    schema = "shard_partition int, shard_number int, place int, doc_id long, local_start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in batches:
            for content in batch.column(0):
                buffer = content.as_buffer()
                if not buffer.size:
                    continue
                partition, number, doc_ids, boundaries, ids = decode_shard(buffer)
                n = len(doc_ids)
                ends = boundaries.select(np.arange(n)).astype(np.int64)
                starts = np.r_[0, ends[:-1]].astype(np.int64)
                wide = memoryview(ids.astype("<u4")).cast("B")
                own = [wide[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
                columns = [pa.array([partition] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(ends - starts), pa.array([tokens.crc(w) for w in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array([bytes(w) for w in own], pa.binary())] * with_ids, [x.split()[0] for x in schema.split(", ")])

    files = spark.read.format("binaryFile").load(path)
    rows = common.written(files.select("content").mapInArrow(documents, schema), "token-documents")
    # A row a shard: the running sum over shards is small whatever the documents are.
    totals = rows.groupBy("shard_partition", "shard_number").agg(F.sum("n_tokens").alias("shard_ids"))
    before = Window.orderBy("shard_partition", "shard_number").rowsBetween(Window.unboundedPreceding, -1)
    shards = totals.select("shard_partition", "shard_number", F.coalesce(F.sum("shard_ids").over(before), F.lit(0)).alias("shard_start"))
    joined = rows.join(shards, ["shard_partition", "shard_number"])
    return joined.select("shard_partition", "shard_number", "place", "doc_id", (F.col("shard_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_binary(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write docs in the file format to the shared folder and read them back: one row a document.

    doc_id, start, n_tokens, ids_crc32. Null or empty texts hold the end id
    alone; equal doc_ids each keep their row; an empty table gives no rows.
    The files go when they have been read.
    """
    path = common.scratch_path(docs.sparkSession, "token-store")
    write(docs, path, vocabulary)
    found = read(docs.sparkSession, path).select("doc_id", "start", "n_tokens", "ids_crc32")
    common.drop_path(docs.sparkSession, path)
    return found
