"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 4 bits agree in at least 4 of
their 8 byte positions. The index lists fingerprints by the values at three
positions; its 20 triples of positions are such that any four positions hold
one of them, so every such pair meets in a list. For the pairs of a list the
shared positional bytes are tallied, pairs under 4 are out, and the rest is
verified bit by bit. Lists give spanning links, not all pairs: a list longer
than a block is compared block against block by several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintage.llm import common, graph

SHINGLE = 4
SEED = 42
DISTANCE = 4
BYTES = 8
LEAST_SHARED = BYTES - DISTANCE
#: Fingerprints of a list that one task compares with as many others.
BLOCK = 2048


def _triples() -> list[tuple[int, ...]]:
    """Triples of the 8 positions of which any 4 positions hold one: groups of 3, 3 and 2 in a ring, three of a group or two of one and one of the next."""
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    out = []
    for t in combinations(range(BYTES), 3):
        g = sorted(group[p] for p in t)
        two = next((x for x in set(g) if g.count(x) >= 2), None)
        if two is not None and (g.count(two) == 3 or (two + 1) % 3 in g):
            out.append(t)
    return out


TRIPLES = _triples()


#: Bytes of a text whose shingles are held at once.
TEXT_BYTES = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0d]")


def shingle_hashes(text: bytes | None) -> list[int]:
    """XXH64 of the space-joined word shingles, repeats included; fewer words: of the whole sequence; none: nothing."""
    words = text.lower().split() if text else []
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return [digest(line, SEED)]
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    return [digest(line[a : b - 1], SEED) for a, b in zip(starts, starts[SHINGLE:])]


def _ones(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little").sum(0, dtype=np.int64)


def _most(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(hashes: list[int]) -> int:
    """Bits set in over half the hashes, as an unsigned integer."""
    return _most(_ones(hashes), len(hashes)) if hashes else 0


def text_fingerprint(text: bytes | None) -> int:
    """The fingerprint of a whole text; a long one goes in parts that share the words of a shingle, so memory is bounded."""
    if not text or len(text) <= TEXT_BYTES:
        return fingerprint(shingle_hashes(text))
    ones, n, carried, at = np.zeros(8 * BYTES, np.int64), 0, [], 0
    while at < len(text):
        blank = _BLANK.search(text, at + TEXT_BYTES)
        end = blank.start() if blank else len(text)
        words = carried + text[at:end].split()
        if len(words) >= SHINGLE:
            hashes = shingle_hashes(b" ".join(words))
            ones, n = ones + _ones(hashes), n + len(hashes)
            words = words[1 - SHINGLE :]
        carried, at = words, end
    return _most(ones, n) if n else fingerprint(shingle_hashes(b" ".join(carried)))


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """The keep columns of docs with fp, the fingerprint of the text as a signed long."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.bounded(batches, "text"):
            found = np.array([text_fingerprint(t) for t in common.byte_list(batch.column(0))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(k + 1) for k in range(len(keep))] + [pa.array(found)], [*keep, "fp"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return common.map_batches(docs.select("text", *keep), rows, ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["fp long"]))


def spanning_links(lists: np.ndarray, fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, smallest of its component) that span what the pairs within each list connect; lists is sorted."""
    own, code = np.unique(fps, return_inverse=True)
    bits = fps.view(np.uint64)
    shares = np.stack([(bits >> np.uint64(8 * p) & np.uint64(255)).astype(np.uint8) for p in range(BYTES)])
    label = np.arange(len(own))
    last = np.searchsorted(lists, lists, "right") - 1
    left, right, held = [], [], 0

    def merge() -> None:
        nonlocal label, left, right, held
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            label = common.union_find(len(own), np.r_[a, np.arange(len(own))], np.r_[b, label])
        left, right, held = [], [], 0

    alive, step = np.arange(len(lists)), 1
    while len(alive := alive[alive + step <= last[alive]]):
        other = alive + step
        open_ = label[code[alive]] != label[code[other]]
        a, b = alive[open_], other[open_]
        tally = sum((shares[p][a] == shares[p][b]).astype(np.uint8) for p in range(BYTES)) if len(a) else np.zeros(0, np.uint8)
        enough = tally >= LEAST_SHARED
        a, b = a[enough], b[enough]
        near = np.bitwise_count(bits[a] ^ bits[b]) <= distance
        left.append(code[a[near]])
        right.append(code[b[near]])
        held += int(near.sum())
        if held > 200_000 or step % 64 == 0:
            merge()
        step += 1
    merge()
    linked = label != np.arange(len(own))
    return own[linked], own[label[linked]]


def links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (u, v) between the distinct fingerprints of nodes (fp) that span the near ones."""
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    value = lambda t: sum((byte(p) * (1 << 8 * k) for k, p in enumerate(t)), F.lit(0))
    keys = F.array(*((F.lit(k << 24) + value(t)).cast("int") for k, t in enumerate(TRIPLES)))
    entries = nodes.select("fp", F.explode(keys).alias("list"))
    sizes = entries.groupBy("list").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    members = entries.join(sizes, "list").withColumn("blocks", blocks).withColumn("mine", mine)
    # A list of several blocks: each block meets each, two at a time.
    members = members.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("list", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"), "fp")
    dealt = members.repartition(common.partitions(nodes.sparkSession), "list", "i", "j").sortWithinPartitions("list", "i", "j")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def found(data: np.ndarray) -> pa.RecordBatch:
            new = np.r_[True, (data[1:, :3] != data[:-1, :3]).any(1)]
            u, v = spanning_links(np.cumsum(new), np.ascontiguousarray(data[:, 3]))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1))
            size += batch.num_rows
            if size >= 100_000:
                data = np.concatenate(held)
                cut = int(np.argmax((data[:, :3] == data[-1, :3]).all(1)))  # the last list may go on
                if cut:
                    yield found(data[:cut])
                held = [data[cut:]]
                size = len(data) - cut
        if size:
            yield found(np.concatenate(held))

    return common.map_batches(dealt, rows, "u long, v long")


def classes(docs: DataFrame, *keep: str, block: int = BLOCK) -> DataFrame:
    """The keep columns of docs with fp and root: rows whose fingerprints are linked, by any number of steps, share a root."""
    marked = common.written(fingerprints(docs, *keep), "fingerprints")
    nodes = common.written(marked.select("fp").distinct(), "nodes")
    roots = graph.components(links(nodes, block)).withColumnRenamed("node", "fp")
    # Fingerprints that are linked to none are their own root.
    return marked.join(roots, "fp", "left").select(*keep, "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint, component_id: one row for each row of docs.

    Texts whose fingerprints differ in at most DISTANCE bits are linked;
    component_id is the smallest doc_id reachable, the own one included (null
    only where all ids are null). Null and blank texts have fingerprint zero
    and are linked like any other; repeated rows keep a row each.
    """
    marked = common.written(fingerprints(docs, "doc_id"), "fingerprints")
    nodes = common.written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = graph.components(links(nodes, block))
    labelled = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = labelled.join(smallest, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
