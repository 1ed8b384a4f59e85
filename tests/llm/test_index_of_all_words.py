"""The index of every word: long and colliding words, proximity through the stored index, several blocks."""

import random

from vintage.llm import decontamination as d


def test_word_lists_equal_plain_ones():
    draw = random.Random(3)
    bits = ["a", "B", "été", "x" * 24, "x" * 25, "X" * 25 + "y", " ", "  ", ".", "\n", "-", "\x00", "7", "漢"]
    for _ in range(200):
        texts = [None if draw.random() < 0.1 else "".join(draw.choices(bits, k=draw.randint(0, 20))).encode() for _ in range(draw.randint(0, 6))]
        segment = d.Segment.index(list(range(len(texts))), texts)
        again = d.Segment.load(*segment.row())
        base, wanted = 0, {}
        for t in texts:
            for k, w in enumerate(d.words(t)):
                wanted.setdefault(w, []).append(base + k)
            base += len(d.words(t)) + 1
        for s in (segment, again):
            assert {t: s.positions[c : c + n].tolist() for t, c, n in zip(s.terms, s.cuts, s.counts)} == wanted
            assert s.n_words.tolist() == [len(d.words(t)) for t in texts]


def test_words_of_one_key_stay_apart(monkeypatch):
    monkeypatch.setattr(d, "_MIX", [d.np.uint64(0)] * 4)  # words of one size have one key
    segment = d.Segment.index([1], [b"ab cd ab ef cd ab"])
    assert {t: segment.positions[c : c + n].tolist() for t, c, n in zip(segment.terms, segment.cuts, segment.counts)} == {b"ab": [0, 2, 5], b"cd": [1, 4], b"ef": [3]}


def test_exact_and_near_matches_through_the_stored_index(spark):
    draw = random.Random(8)
    texts = [" ".join(draw.choices("abcdefg", k=draw.randint(0, 30))) for _ in range(40)]
    items = [(k, " ".join(draw.choices("abcdefgh", k=draw.randint(1, 3)))) for k in range(25)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    for block in (1 << 20, 5):
        found = d.matches(docs, spark.createDataFrame(items, "item_id long, text string"), 3, block, within=2).collect()
        assert len(found) == len(texts)
        for r in found:
            own = texts[r["doc_id"]].split()
            exact = sorted(str(k) for k, t in items if any(own[p : p + len(t.split())] == t.split() for p in range(len(own))))
            assert r["names"] == exact
            # The rarest word is the segment's; around another one a match is one too.
            assert set(r["near"]) <= {str(k) for k, t in items if any(set(t.split()) <= set(own[max(0, p - 2) : p + 3]) for p in range(len(own)))}
            assert set(r["near"]) >= {str(k) for k, t in items if any(own[p : p + len(t.split())] == t.split() for p in range(len(own)))}
