"""Texts encoded together, and files dealt by frequent ids, against the library and plain sorting."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from vintage.llm import token_store, tokens

PATH = tokens.default_vocabulary()


def library_ids(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("cache", [30, 100_000])
def test_batches_equal_the_library(cache):
    draw = random.Random(21)
    bits = ["a", "Foo", "é", "÷", "×", "à", "ß漢", " ", " ", "  ", "   ", "\n", "\n\n", "\r\n", "\r", "\t", "\xa0", " ", "—", "1", "²", "'s", "'", "don't", ".", ",", "!!", "***", "<|endoftext|>", "\x00", "\x1c", "\x85", "😀", "_", "Ġ", "longwordwithoutanend" * 2]
    texts = ["".join(draw.choices(bits, k=draw.randint(0, 14))) for _ in range(4000)] + ["", None, " ", "\n", "a" * 5000, "word " * 3000, "naïve, été. " * 300]
    encoder, wanted = tokens.WordEncoder(PATH, cache_words=cache), library_ids(texts)
    for at in range(0, len(texts), 170):
        assert [x.tolist() for x in encoder.batch(texts[at : at + 170])] == wanted[at : at + 170]


def test_select_equals_all_values():
    draw = np.random.default_rng(3)
    for n, most in ((1, 0), (3, 1 << 62), (700, 5), (700, 1 << 40)):
        values = np.sort(draw.integers(0, most, n, endpoint=True).astype(np.uint64))
        u = int(values[-1])
        ef, _ = token_store.EliasFano.from_buffer(token_store.EliasFano.build(values, u).to_bytes(), n, u, token_store.EliasFano.low_width(n, u))
        assert ef.select(np.arange(n)).tolist() == values.tolist() and int(ef.select(n - 1)) == u


def test_shards_of_extreme_ids():
    ids = [None, None, -(1 << 63), -5, 0, (1 << 63) - 1]
    data = token_store.encode_shard(3, 1, ids, [np.array([k, 0], "<u2") for k in range(6)])
    partition, number, found, ends, flat = token_store.decode_shard(data + b"\n")
    assert (partition, number, found) == (3, 1, ids) and ends.select(np.arange(6)).tolist() == [2, 4, 6, 8, 10, 12] and len(flat) == 12
    with pytest.raises(ValueError):
        token_store.decode_shard(b"something else")


def test_frequent_ids_fill_several_partitions(spark):
    draw = random.Random(5)
    rows = [(None, f"null {k}") for k in range(60)] + [(7, f"seven {k}") for k in range(80)] + [(k, f"own {k}") for k in range(60)]
    draw.shuffle(rows)
    found = token_store.token_binary(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).orderBy("start").collect()
    ids = [r["doc_id"] for r in found]
    assert ids == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert [r["start"] for r in found] == np.r_[0, np.cumsum([r["n_tokens"] for r in found])[:-1]].tolist()
    assert sorted(r["ids_crc32"] for r in found) == sorted(tokens.crc(tokens.document_ids(PATH, t)) for _, t in rows)
    nulls, cuts = token_store._cuts(spark.createDataFrame(rows, "doc_id long, text string"), 8)
    assert nulls >= 2 and cuts.tolist().count(7) >= 2
