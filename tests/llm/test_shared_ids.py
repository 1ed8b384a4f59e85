"""Rows without an id whose text hashes agree in their low bits."""

import random

import xxhash
from test_text_operators import brute_repeats

from vintage.llm import substrings


def test_rows_without_id_that_share_31_bits_of_their_hash(spark):
    draw = random.Random(1)
    letters = lambda n: "".join(draw.choices("abcdefghijklmnop", k=n))
    passage, other = letters(80), letters(200)
    low = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) % (1 << 31)
    with_passage = {low(t): t for t in (f"{k} {passage} tail" for k in range(150_000))}
    pair = next((with_passage[low(t)], t) for t in (f"{other} {k}" for k in range(150_000)) if low(t) in with_passage)
    rows = [(1, passage), *((None, t) for t in pair)]
    found = substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in found), key=str) == brute_repeats(rows)


def test_rows_without_id_are_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 4000)
    draw = random.Random(2)
    rows = [(None, "".join(draw.choices("abcdef ", k=300))) for _ in range(200)] + [(7, "x" * 70)]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string"))
        seen = found.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sum(seen) == 201 and max(seen) < 150
