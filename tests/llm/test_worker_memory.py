"""What a Python worker and the batches on their way to it hold at most."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from vintage.llm import common, packing, quality_classifier, simhash, substrings, tokens


@pytest.mark.parametrize("operator", [simhash.fingerprints, packing.tokenized_pieces, substrings.repeats, lambda d: quality_classifier.score(d, None)])
def test_batches_to_python_are_bounded_by_bytes(spark, operator):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('ten bytes ', 1000) AS text")
    spark.conf.set(key, "64m")
    operator(docs.limit(1))
    found = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert sum(r["n"] for r in found) >= 30_000_000 and max(r["n"] for r in found) < common.ARROW_BYTES + 20_000
    spark.conf.set(key, "1m")
    operator(docs.limit(1))
    assert spark.conf.get(key) == "1m"


def test_tasks_that_encode_nothing_drop_the_encoders(spark):
    class Plan:
        sparkSession = spark

        def mapInArrow(self, rows, schema):
            return list(rows(iter(())))

    tokens.encoder(tokens.default_vocabulary())
    common.map_batches(Plan(), lambda batches: batches, "n long", encodes=True)
    assert tokens._encoders
    common.map_batches(Plan(), lambda batches: batches, "n long")
    assert not tokens._encoders


def test_bounded_deals_rows_anew():
    draw = np.random.default_rng(7)
    sizes = [*draw.integers(0, 40, 500).tolist(), 300, 0, 0, 250, *[0] * (2 * common.MOST_ROWS), 5]
    texts = [None if s == 7 else "x" * s for s in sizes]
    whole = pa.RecordBatch.from_pydict({"n": range(len(texts)), "text": texts})
    for step in (1, 3, 170, len(texts)):
        found = list(common.bounded((whole.slice(a, step) for a in range(0, min(len(texts), 530 * step), step)), "text", 100))
        assert [x for b in found for x in b.column(0).to_pylist()] == list(range(min(len(texts), 530 * step)))
        held = [sum(len(t or "") for t in b.column(1).to_pylist()) for b in found]
        assert all(h <= 100 or b.num_rows == 1 for h, b in zip(held, found)) and max(b.num_rows for b in found) <= common.MOST_ROWS
        assert sum(h < 50 for h in held) < 10
    assert list(common.bounded(iter([whole.slice(0, 0)]), "text", 100)) == []


def test_a_bucket_is_held_once():
    kinds, n = substrings.ENTRY.format("u1"), 40_000
    draw = np.random.default_rng(8)
    columns = lambda: [np.frombuffer(draw.bytes(n * np.dtype(k).itemsize), k) for k in kinds.split()]
    blobs = [substrings._columns(*columns()) for _ in range(12)]
    batches = [pa.RecordBatch.from_arrays([pa.array([key] * 4), pa.array(blobs[4 * key : 4 * key + 4])], ["bucket", "blob"]) for key in range(3)]
    bucket = 4 * n * sum(np.dtype(k).itemsize for k in kinds.split())
    tracemalloc.start()
    try:
        for key, found in substrings._gathered(iter(batches), kinds):
            assert b"".join(c[:n].tobytes() for c in found) == b"".join(c.tobytes() for c in substrings._decode(blobs[4 * key], kinds))
            assert tracemalloc.get_traced_memory()[0] < 1.4 * bucket
            del found
            tracemalloc.reset_peak()
            assert tracemalloc.get_traced_memory()[0] < 0.6 * bucket
    finally:
        tracemalloc.stop()


def test_parts_of_a_bucket_have_the_states_of_the_whole(monkeypatch):
    monkeypatch.setattr(substrings, "TOGETHER", 50)
    draw = np.random.default_rng(9)
    grams, contexts, order = (draw.integers(0, most, 3000, dtype=np.int64) for most in (900, 3, 40))
    six = [substrings._six(x.astype(np.uint64)) for x in (grams * 0x9E3779B1, contexts)]
    wanted = substrings.shared_anchors(substrings._from_six(six[0]), substrings._from_six(six[1]), order)
    assert substrings._bucket_states(*six, order).tolist() == wanted.tolist() and len(set(wanted.tolist())) == 3
