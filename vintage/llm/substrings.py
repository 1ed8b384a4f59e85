"""Suffix-array deduplication of repeated byte strings across documents.

A byte goes if a LENGTH-byte string that covers it also starts in a document
with a smaller id. The suffix order is never built over the whole corpus at
once: it is built bucket by bucket, and only where documents share something.

1. Of every LENGTH-byte string the gram with the least hash is its anchor.
   Equal strings have equal anchors at equal places, so strings can only be
   equal below one anchor hash: a suffix bucket.
2. Buckets of anchors (no text yet) show which anchors other documents have,
   and which of them in an equal context, the bytes of all strings around.
   An equal context in a smaller document settles all those strings.
3. For the rest the contexts of a bucket come together, one of each kind, and
   their suffixes are sorted: by their first bytes, long ties by the ranks of
   the suffixes at the sample positions of a difference cover, which are
   computed first. Neighbours with LENGTH equal bytes are repeats.
4. Documents take the spans out.

What crosses the network: about 16 bytes for one position in 18, the contexts
at the edges of shared passages, and the texts once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintage.llm import common

LENGTH = 50
GRAM = 16
#: Grams in a string; an anchor's strings start up to REACH bytes before it.
REACH = LENGTH - GRAM
WIDTH = REACH + LENGTH
#: Bytes of text whose anchors are found at once; memory is about 40 times as much.
CHUNK_BYTES = 512 << 10
BLOCK_BYTES = 16 << 20
#: Anchors of a bucket that are sorted together, those of one hash at least.
TOGETHER = 200_000

#: Bytes of text for each task at least, where that makes more tasks than spark.sql.shuffle.partitions.
TASK_BYTES = 64 << 20

#: A difference cover: every residue is a difference of two of its members, modulo PERIOD.
PERIOD = 13
COVER = (0, 1, 3, 9)
PREFIX = 16
ROW = 7 * PERIOD  # a context's row, whole periods wide

LAST = (1 << 63) - 1
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_LOW48 = np.uint64((1 << 48) - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M3
    return h ^ (h >> np.uint64(29))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the GRAM bytes from each position on; data has GRAM bytes more than positions."""
    n = len(data) - GRAM
    words = np.ndarray((n + 8,), "<u8", data.data, 0, (1,))
    return _mix(words[:n] * _M1 + (words[8 : n + 8] ^ _M2) * _M2)


def anchors(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, position in data) of the anchors of documents laid end to end in data, whose sizes are given."""
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(ends) else 0
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.r_[data[:n], np.zeros(GRAM, np.uint8)]
    # Hash above, place below: the least of a window is its least hash, the leftmost of equal ones.
    least = (gram_hashes(padded) >> np.uint64(24) << np.uint64(24)) | np.arange(n, dtype=np.uint64)
    span = 1
    while span * 2 <= REACH + 1:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < REACH + 1:
        rest = REACH + 1 - span
        least = np.minimum(least[:-rest], least[rest:])
    document = np.repeat(np.arange(len(sizes)), sizes)
    inside = document[: n - LENGTH + 1] == document[LENGTH - 1 :]
    places = (least[: n - LENGTH + 1][inside] & np.uint64((1 << 24) - 1)).astype(np.int64)
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    places = places[np.r_[True, places[1:] != places[:-1]]]
    return document[places], places


def context_rows(data: np.ndarray, places: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The WIDTH bytes around each place, the place at REACH, zero outside its document (starts to ends); bytes before and from the place on."""
    padded = np.r_[np.zeros(REACH, np.uint8), data, np.zeros(ROW, np.uint8)]
    rows = np.ndarray((len(padded) - ROW + 1, ROW), np.uint8, padded.data, 0, (1, 1))[places]
    left, right = np.minimum(places - starts, REACH), np.minimum(ends - places, LENGTH)
    rows[:, WIDTH:] = 0
    for k in np.flatnonzero((left < REACH) | (right < LENGTH)).tolist():
        rows[k, : REACH - left[k]] = 0
        rows[k, REACH + right[k] :] = 0
    return rows, left, right


def context_hashes(rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(rows), 88), np.uint8)
    wide[:, :WIDTH] = rows[:, :WIDTH]
    words = wide.view("<u8")
    h = (left * 64 + right).astype(np.uint64) * _M2
    for k in range(words.shape[1]):
        h = _mix(h * _M1 + words[:, k])
    return h


def _columns(*arrays: np.ndarray) -> bytes:
    """Arrays of one length in a compressed blob; each is told by decode's kinds."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _decode(blob: bytes, kinds: str) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 31)
    n, at, out = len(data) // np.dtype([(str(k), t) for k, t in enumerate(kinds.split())]).itemsize, 0, []
    for kind in kinds.split():
        out.append(np.frombuffer(data, kind, n, at).copy())  # each can go by itself
        at += out[-1].nbytes
    return out


def _six(values: np.ndarray) -> np.ndarray:
    """The low 48 bits, six bytes each."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).ravel().view("V6")


def _from_six(values: np.ndarray) -> np.ndarray:
    out = np.zeros((len(values), 8), np.uint8)
    out[:, :6] = values.view(np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _split(keys: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray]]:
    """(key, where in order, order) for each distinct key; order keeps equal keys in their order."""
    order = np.argsort(keys, kind="stable")
    own = keys[order]
    cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else []
    for a, b in zip(cuts, [*cuts[1:], len(own)]):
        yield int(own[a]), slice(int(a), int(b)), order


def _blobs(names: list[str], rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names)


def block_of(order: np.ndarray, n_blocks: int) -> np.ndarray:
    """The block of each document by its order number and tag XORed, as pmod(xxhash64(order), n_blocks) in SQL."""
    own, code = np.unique(order, return_inverse=True)
    hashed = [int.from_bytes(xxhash.xxh64_digest(int(o).to_bytes(8, "little", signed=True), 42), "big", signed=True) % n_blocks for o in own.tolist()]
    return np.array(hashed, np.int64)[code] if len(own) else np.zeros(0, np.int64)


def bucket_of(grams: np.ndarray, n_blocks: int) -> np.ndarray:
    """The bucket of each anchor hash, however many there are."""
    return ((grams * _M2) >> np.uint64(8)).astype(np.int64) % n_blocks


# Tags are whole hashes ("<i8") where ids repeat, else zeros ("u1").
ENTRY = "V6 V6 <i8 {} <u4"  # anchor hash, context hash, order, tag, position
FLAG = "<i8 {} <u4 u1"  # order, tag, position, state
SETTLED, OPEN, START = 1, 2, 3
CONTEXT = f"<u8 <i8 {{}} <u4 u1 u1 V{ROW}"  # anchor hash, order, tag, position, bytes before, bytes from there, context


def shared_anchors(grams: np.ndarray, contexts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The state of each anchor of a bucket: 0, SETTLED (a smaller document has its context) or OPEN (another context under its hash must be compared)."""
    by = np.lexsort((order, contexts, grams))
    g, c, o = grams[by], contexts[by], order[by]
    new_gram = np.r_[True, g[1:] != g[:-1]]
    new_context = new_gram | np.r_[True, c[1:] != c[:-1]]
    gram_starts, context_starts = np.flatnonzero(new_gram), np.flatnonzero(new_context)
    of_gram, of_context = np.cumsum(new_gram) - 1, np.cumsum(new_context) - 1
    kinds = np.add.reduceat(new_context.astype(np.int64), gram_starts)
    shared = np.minimum.reduceat(o, gram_starts) != np.maximum.reduceat(o, gram_starts)
    settled = o > o[context_starts][of_context]
    state = np.where(settled, SETTLED, np.where((shared & (kinds > 1))[of_gram], OPEN, 0))
    out = np.zeros(len(by), np.uint8)
    out[by] = state
    return out


def _words(rows: np.ndarray, at: int, n: int) -> list[np.ndarray]:
    """Bytes at..at + n of each row as big-endian numbers, the least significant key first for lexsort."""
    out = []
    for k in range(at, at + n, 8):
        piece = np.zeros((len(rows), 8), np.uint8)
        own = rows[:, k : min(k + 8, at + n)]
        piece[:, : own.shape[1]] = own
        out.append(piece.view(">u8").ravel().astype(np.uint64))
    return out[::-1]


def cover_ranks(rows: np.ndarray) -> dict[int, np.ndarray]:
    """For each sample offset (residue in COVER) the rank of the rows' suffixes from there on.

    From the right: a suffix is its first PERIOD bytes and the suffix a period
    further, whose rank is known.
    """
    ranks: dict[int, np.ndarray] = {}
    zero = np.zeros(len(rows), np.int64)
    for offset in range(ROW - 1, -1, -1):
        if offset % PERIOD in COVER:
            keys = [ranks.get(offset + PERIOD, zero), *_words(rows, offset, PERIOD)]
            by = np.lexsort(keys)
            new = np.zeros(len(rows), bool)
            for k in keys:
                new[1:] |= k[by][1:] != k[by][:-1]
            ranks[offset] = np.empty(len(rows), np.int64)
            ranks[offset][by] = np.cumsum(new)
    return ranks


def repeated_starts(grams: np.ndarray, order: np.ndarray, left: np.ndarray, right: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset) of the suffixes of contexts whose first LENGTH bytes a smaller document has under the same anchor hash."""
    ranks = cover_ranks(rows)
    found_rows, found_offsets = [], []
    for t in range(REACH + 1):
        # All contexts have their anchor at one offset, so a bucket's suffixes share a residue and a way to the cover.
        step = next(d for d in range(PERIOD) if (t + d) % PERIOD in COVER)
        own = np.flatnonzero((t >= REACH - left) & (t + LENGTH <= REACH + right))
        if len(own) < 2:
            continue
        g, text = grams[own], rows[own]
        by = np.lexsort([ranks[t + step][own], *_words(text, t, PREFIX), g])
        own, g, text = own[by], g[by], text[by, t : t + LENGTH]
        new = np.r_[True, (g[1:] != g[:-1]) | (text[1:] != text[:-1]).any(1)]
        starts = np.flatnonzero(new)
        first = np.minimum.reduceat(order[own], starts)[np.cumsum(new) - 1]
        again = order[own] > first
        found_rows.append(own[again])
        found_offsets.append(np.full(int(again.sum()), t))
    return (np.concatenate(found_rows), np.concatenate(found_offsets)) if found_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _gathered(batches: Iterator[pa.RecordBatch], kinds: str) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The arrays of each key's blobs together; rows come sorted by key."""
    key, held = None, []

    def together() -> list[np.ndarray]:
        # One column after the other, the pieces of those before are gone.
        columns = [list(c) for c in zip(*held)]
        held.clear()
        return [np.concatenate(columns.pop(0)) for _ in range(len(columns))]

    for batch in batches:
        for k, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            if k != key and held:
                yield key, together()
            key = k
            held.append(_decode(blob.as_buffer(), kinds))
    if held:
        yield key, together()


def _document_columns(left: pa.Table) -> Iterator[tuple[int, int, int | None, bytes]]:
    order, tag, doc_id = (left.column(c).to_pylist() for c in ("ord", "tag", "doc_id"))
    for k, chunk in enumerate(left.column("text").cast(pa.binary())):
        yield order[k], tag[k], doc_id[k], chunk.as_py() or b""


def _flags_by_document(right: pa.Table, mark_kind: str) -> dict[tuple[int, int], list[np.ndarray]]:
    blobs = [_decode(b, FLAG.format(mark_kind)) for b in right.column("blob").to_pylist()]
    if not blobs:
        return {}
    order, tag, place, state = (np.concatenate(c) for c in zip(*blobs))
    by = np.lexsort((place, tag, order))
    order, tag, place, state = order[by], tag[by], place[by], state[by]
    cuts = np.flatnonzero(np.r_[True, (order[1:] != order[:-1]) | (tag[1:] != tag[:-1])])
    return {(int(order[a]), int(tag[a])): [place[a:b].astype(np.int64), state[a:b]] for a, b in zip(cuts, [*cuts[1:], len(order)])}


def _bucket_states(grams: np.ndarray, contexts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """shared_anchors of a bucket, whose hashes are six bytes each: by their last byte in parts, each hash whole."""
    low = grams.view(np.uint8).reshape(-1, 6)[:, 0]
    n, out = min(256, max(1, len(low) // TOGETHER)), np.zeros(len(low), np.uint8)
    for part in range(n):
        own = np.flatnonzero(low % n == part)
        if len(own):
            out[own] = shared_anchors(_from_six(grams[own]), _from_six(contexts[own]), order[own])
    return out


def removed_spans(size: int, places: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed runs of a document: starts and ends."""
    if size < LENGTH or not len(places):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    settled = states == SETTLED
    starts = np.where(settled, np.maximum(places - REACH, 0), places)
    ends = np.where(settled, np.minimum(places, size - LENGTH), places) + LENGTH
    by = np.argsort(starts, kind="stable")
    starts, reach = starts[by], np.maximum.accumulate(ends[by])
    new = np.r_[True, starts[1:] > reach[:-1]]
    return starts[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(starts) - 1]]


def repeats(docs: DataFrame, *keep: str, with_text: bool = False) -> DataFrame:
    """doc_id, the keep columns, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining text, without characters cut in two): a row for each row of docs.

    Null and empty texts have no bytes. Rows of one doc_id are neither the
    smaller; null ids come after all others. Texts under LENGTH bytes lose nothing.
    """
    spark = docs.sparkSession
    n = common.partitions(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks, n = max(n, -(-total // BLOCK_BYTES)), max(n, -(-total // TASK_BYTES))
    repeated_ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0
    # Rows that share an id are told apart by a hash of their text.
    tag = F.xxhash64("text") if repeated_ids else F.lit(0).cast("long")
    mark_kind = "<i8" if repeated_ids else "u1"
    order = F.coalesce("doc_id", F.lit(LAST))
    texts = docs.select(order.alias("ord"), tag.alias("tag"), "text")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        size = 0

        def dealt() -> Iterator[pa.RecordBatch]:
            columns = [list(c) for c in zip(*found)]
            found.clear()
            bucket, *columns = [np.concatenate(columns.pop(0)) for _ in range(len(columns))]
            out, held = [], 0
            for key, s, by in _split(bucket):
                out.append((key, _columns(*(c[by[s]] for c in columns))))
                held += len(out[-1][1])
                if held >= common.ARROW_BYTES:
                    yield _blobs(["bucket", "blob"], out)
                    out, held = [], 0
            if out:
                yield _blobs(["bucket", "blob"], out)

        for batch in common.bounded(batches, "text", min(CHUNK_BYTES, BLOCK_BYTES)):
            own, tags, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), common.byte_list(batch.column(2))
            more = sum(len(t or b"") for t in texts)
            if found and size + more > BLOCK_BYTES:
                yield from dealt()
                size = 0
            size += more
            for ids, marks, offset, goes_on, sizes, data in _pieces(own, tags, texts):
                at, places = anchors(data, sizes)
                if not len(places):
                    continue
                ends = np.cumsum(sizes)
                starts = ends - sizes
                rows, left, right = context_rows(data, places, starts[at], ends[at])
                padded = np.r_[data, np.zeros(GRAM, np.uint8)]
                grams = _mix(_load(padded, places) * _M1 + (_load(padded, places + 8) ^ _M2) * _M2)
                # At the cut of a very long document the neighbouring part has the full context.
                whole = ((offset[at] == 0) | (left == REACH)) & (~goes_on[at] | (right == LENGTH))
                at, places, grams, contexts = at[whole], places[whole], grams[whole], context_hashes(rows, left, right)[whole]
                found.append((bucket_of(grams, n_blocks).astype(np.int32), _six(grams), _six(contexts), ids[at].astype("<i8"), marks[at].astype(mark_kind), (places - starts[at] + offset[at]).astype("<u4")))
        if found:
            yield from dealt()

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flagged(grams: np.ndarray, contexts: np.ndarray, ids: np.ndarray, marks: np.ndarray, places: np.ndarray) -> list[tuple[int, bytes]]:
            state = _bucket_states(grams, contexts, ids)
            kept = np.flatnonzero(state)
            ids, marks, places, state = ids[kept], marks[kept], places[kept], state[kept]
            by = np.lexsort((places, ids))
            ids, marks, places, state = ids[by], marks[by], places[by], state[by]
            return [(key, _columns(ids[o[s]], marks[o[s]], places[o[s]], state[o[s]])) for key, s, o in _split(block_of(ids ^ marks, n_blocks))]

        for _, columns in _gathered(batches, ENTRY.format(mark_kind)):
            found = flagged(*columns)
            del columns  # before the next bucket is gathered
            if found:
                yield _blobs(["block", "blob"], found)

    buckets = common.map_batches(texts, entries, "bucket long, blob binary").repartition(n, "bucket").sortWithinPartitions("bucket")
    flags = common.written(common.map_batches(buckets, states, "block long, blob binary"), "anchors")

    def contexts_of(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted, found = _flags_by_document(right, mark_kind), []
        for own, mark, _, text in _document_columns(left):
            if (own, mark) in wanted:
                places, state = wanted.pop((own, mark))
                places = places[state == OPEN]
                if len(places):
                    data = np.frombuffer(text, np.uint8)
                    rows, before, after = context_rows(data, places, np.zeros(len(places), np.int64), np.full(len(places), len(data)))
                    grams = _mix(_load(data, places) * _M1 + (_load(data, places + 8) ^ _M2) * _M2)
                    found.append((grams, np.full(len(places), own), np.full(len(places), mark), places, before, after, rows))
        out = []
        if found:
            grams, ids, marks, places, before, after, rows = (np.concatenate(c) for c in zip(*found))
            rows = np.ascontiguousarray(rows)
            for key, s, o in _split(bucket_of(grams, n_blocks)):
                k = o[s]
                out.append((key, _columns(grams[k], ids[k].astype("<i8"), marks[k].astype(mark_kind), places[k].astype("<u4"), before[k].astype(np.uint8), after[k].astype(np.uint8), rows[k])))
        return pa.Table.from_batches([_blobs(["bucket", "blob"], out)])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (grams, ids, marks, places, before, after, rows) in _gathered(batches, CONTEXT.format(mark_kind)):
            rows = np.ascontiguousarray(rows).view(np.uint8).reshape(-1, ROW)
            by = np.argsort(grams, kind="stable")
            own = grams[by]
            cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            # Some suffix buckets at a time, each whole.
            ends = [*cuts[1:], len(own)]
            a = 0
            out: list[tuple[np.ndarray, ...]] = []
            for b, nxt in zip(ends, [*ends[1:], None]):
                if nxt is not None and nxt - a <= 50_000:
                    continue
                k = by[a:b]
                row, offset = repeated_starts(grams[k], ids[k], before[k].astype(np.int64), after[k].astype(np.int64), rows[k])
                out.append((ids[k][row], marks[k][row], places[k][row].astype(np.int64) - REACH + offset))
                a = b
            found_ids, found_marks, starts = (np.concatenate(c) for c in zip(*out))
            if len(starts):
                state = np.full(len(starts), START, np.uint8)
                yield _blobs(["block", "blob"], [(key, _columns(found_ids[o[s]], found_marks[o[s]], starts[o[s]].astype("<u4"), state[o[s]])) for key, s, o in _split(block_of(found_ids ^ found_marks, n_blocks))])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    extra = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    schema = "doc_id long" + f", {extra}" * bool(keep) + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        known, out = _flags_by_document(right, mark_kind), []
        none = [np.zeros(0, np.int64), np.zeros(0, np.uint8)]
        for own, mark, doc_id, text in _document_columns(left):
            places, state = known.get((own, mark), none)
            used = state != OPEN
            starts, ends = removed_spans(len(text), places[used], state[used])
            pieces, at = [], 0
            for a, b in zip(starts.tolist(), ends.tolist()):
                pieces.append(text[at:a])
                at = b
            kept = b"".join([*pieces, text[at:]])
            out.append((doc_id, len(text), len(text) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
        types = [pa.int64()] * 4 + [pa.string(), pa.string()]
        columns = [pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
        table = pa.table(dict(zip(names, columns)))
        for k, c in enumerate(keep):
            table = table.add_column(1 + k, c, left.column(f"keep_{k}"))
        return table

    # With the tag, rows that share an id are dealt over the blocks.
    block = F.pmod(F.xxhash64(F.col("ord").bitwiseXOR(F.col("tag"))), F.lit(n_blocks)).alias("block")
    kept = (F.col(c).alias(f"keep_{k}") for k, c in enumerate(keep))
    dealt = docs.select(order.alias("ord"), tag.alias("tag"), "doc_id", "text", *kept).select(block, "*")
    # Both look at the texts in the same blocks: one exchange serves both.
    around = common.map_groups(dealt, flags, "block", contexts_of, "bucket long, blob binary")
    starts = common.map_batches(around.repartition(n, "bucket").sortWithinPartitions("bucket"), compared, "block long, blob binary")
    return common.map_groups(dealt, flags.unionByName(starts), "block", cut, schema)


def _load(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on."""
    return np.ndarray((len(data) - 7,), "<u8", data.data, 0, (1,))[places]


def _pieces(ids: np.ndarray, marks: np.ndarray, texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, ...]]:
    """Documents laid end to end in pieces of at most 2^23 bytes: ids, marks, each part's offset, whether its document goes on, its size, the bytes.

    A longer document goes in parts that overlap, so that every string is
    whole in one of them and its anchors have their full context.
    """
    most, overlap = 1 << 23, 2 * WIDTH
    parts: list[tuple[int, int, bytes, bool]] = []
    size = 0

    def piece() -> tuple[np.ndarray, ...]:
        at = np.array([p[0] for p in parts])
        return ids[at], marks[at], np.array([p[1] for p in parts]), np.array([p[3] for p in parts]), np.array([len(p[2]) for p in parts]), np.frombuffer(b"".join(p[2] for p in parts), np.uint8)

    for k, text in enumerate(texts):
        if not text or len(text) < LENGTH:
            continue
        for start in range(0, max(1, len(text) - overlap), most - overlap) if len(text) > most else (0,):
            part = text[start : start + most]
            if parts and size + len(part) > most:
                yield piece()
                parts, size = [], 0
            parts.append((k, start, part, start + len(part) < len(text)))
            size += len(part)
    if parts:
        yield piece()
