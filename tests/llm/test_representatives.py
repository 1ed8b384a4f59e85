"""Which document of a group stays, and fingerprints of long texts."""

import random

import corpus_pipeline
from test_text_operators import brute_fingerprint

from vintage.llm import simhash


def test_the_smallest_id_stays_whatever_other_rows_share(spark):
    draw = random.Random(2)
    words = lambda n: " ".join("".join(draw.choices("abcdefghij", k=6)) for _ in range(n))
    copy, rows = words(60), []
    rows += [(k, copy) for k in range(10, 20)]
    rows += [(99, words(50)), (99, words(50)), (None, words(50)), (None, copy), (7, words(40))]
    same = words(30)
    rows += [(55, same), (55, same)]
    draw.shuffle(rows)
    docs = spark.createDataFrame([(i, t, None, None, 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    kept = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()), key=str)
    assert [i for i, t in kept if t == copy] == [10]
    assert sorted((i for i, _ in kept), key=str) == sorted([10, 99, 99, None, 7, 55], key=str)


def test_fingerprints_of_long_texts_go_in_parts(monkeypatch):
    monkeypatch.setattr(simhash, "TEXT_BYTES", 40)
    draw = random.Random(6)
    for _ in range(60):
        text = "".join(draw.choices(["Word ", "of", "  ", "\n", "Éa ", "x" * 50 + " "], k=draw.randint(0, 60)))
        assert simhash.text_fingerprint(text.encode()) == brute_fingerprint(text)
