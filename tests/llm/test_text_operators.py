"""Tokens, packing, decontamination, SimHash and repeats against brute force, with awkward rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vintage.llm import decontamination, graph, packing, simhash, substrings, token_store, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, block long, bucket string, fp string, list int, segment string, ord int, tag string, part int"


def docs(spark, rows):
    """(doc_id, text) with the other columns null or clashing with inner names."""
    return spark.createDataFrame([(i, t, None, "s", 0, 1, "b", "f", 1, "s", 1, "t", 1) for i, t in rows], SCHEMA)


def corpus(seed=1, n=60):
    """Random texts with copies, near copies, shared passages, blanks, nulls, ties and a long one."""
    draw = random.Random(seed)
    word = lambda: draw.choice(["the", "of", "and", "Straße", "été", "a1", "x"]) + draw.choice(["", "ing", "ed", "ß", "9"]) + draw.choice(["", "", ",", "."])
    text = lambda k: " ".join(word() for _ in range(k))
    passage, out = text(25), []
    for k in range(n):
        kind = k % 6
        t = text(draw.randint(0, 80))
        if kind == 1 and out:
            t = draw.choice(out)[1]
        elif kind == 2:
            t = text(8) + " " + passage + "\n" + text(5)
        elif kind == 3 and out and (base := draw.choice(out)[1]):
            ws = base.split(" ")
            ws[draw.randrange(len(ws))] = word()
            t = " ".join(ws)
        out.append((k, t))
    out += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "a" * 400), (n + 4, "a" * 300 + "b"), (3, "repeated id " * 10), (3, "repeated id " * 10), (None, passage), (None, "no id"), (n + 5, text(6000))]
    return out


def test_word_encoder_equals_the_library():
    from tokenizers import Tokenizer

    path = tokens.default_vocabulary()
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    draw = random.Random(2)
    bits = ["a", "Foo", "é", "ß漢", " ", "  ", "\n", "\r", "\t", "1", "²", "'s", "'", ".", ",", "!!", " ", "<|endoftext|>", "\x00", "\x1c", "😀", "_", "don't"]
    texts = ["".join(draw.choices(bits, k=draw.randint(0, 14))) for _ in range(3000)]
    small = tokens.WordEncoder(path, cache_words=50)
    for t, e in zip(texts, whole.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(small.encode(t), "<u4").tolist() == e.ids


def test_elias_fano():
    draw = random.Random(4)
    for n in (0, 1, 5, 64, 65, 1000):
        values = np.cumsum([draw.randint(0, 300) for _ in range(n)])
        u = int(values[-1]) if n else 0
        ef, _ = token_store.EliasFano.from_buffer(token_store.EliasFano.build(values, u).to_bytes(), n, u, token_store.EliasFano.low_width(n, u))
        assert ef.values().tolist() == values.tolist() == [ef.select(i) for i in range(n)]


def test_token_store_round_trip(spark):
    rows = corpus()
    found = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_store.token_binary(docs(spark, rows)).collect()), key=str)
    ids = {k: tokens.document_ids(tokens.default_vocabulary(), t) for k, (_, t) in enumerate(rows)}
    order = sorted(ids, key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, rows[k][1] is not None, (rows[k][1] or "").encode()))
    start, wanted = 0, []
    for k in order:
        wanted.append((start, rows[k][0], len(ids[k]) // 4, zlib.crc32(ids[k])))
        start += len(ids[k]) // 4
    assert found == sorted(wanted, key=str)
    assert token_store.token_binary(docs(spark, [])).count() == 0


def test_small_shards_and_ids(spark, tmp_path):
    rows = corpus(3)
    token_store.write(docs(spark, rows), str(tmp_path / "t"), shard_ids=100)
    back = token_store.read(spark, str(tmp_path / "t"), with_ids=True).orderBy("start").collect()
    assert [r["n_tokens"] for r in back] == [len(r["ids"]) // 4 for r in back] and [r["start"] for r in back] == np.r_[0, np.cumsum([r["n_tokens"] for r in back])[:-1]].tolist()


def test_plan_fills_gaps_exactly():
    assert packing.plan({10: 1, 4: 1, 6: 1}, 10) == [((10,), 1), ((6, 4), 1)]
    assert packing.plan({5: 1, 1: 1, 2: 2}, 10) == [((5, 2, 2, 1), 1)]
    draw = random.Random(5)
    for _ in range(30):
        sizes = {draw.randint(1, 64): draw.randint(1, 30) for _ in range(draw.randint(1, 40))}
        plan = packing.plan(sizes, 64)
        used: dict = {}
        for pattern, times in plan:
            assert sum(pattern) <= 64
            for x in pattern:
                used[x] = used.get(x, 0) + times
        assert used == sizes
    with pytest.raises(ValueError):
        packing.plan({65: 1}, 64)


def test_packing_covers_every_document(spark):
    rows = corpus(6)
    found = packing.pack_documents(docs(spark, rows).repartition(5), capacity=128).collect()
    wanted = []
    for i, t in rows:
        ids = tokens.document_ids(tokens.default_vocabulary(), t)
        n = len(ids) // 4
        cuts = [0] + list(range(n % 128 or 128, n + 1, 128)) if n > 128 else [0, n]
        wanted += [(i, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda x: str(x)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found), key=key) == sorted(wanted, key=key)
    by: dict = {}
    for r in found:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        ends = 0
        for at, n in sorted(places):
            assert at == ends
            ends += n
        assert ends <= 128
    assert packing.pack_documents(docs(spark, [])).count() == 0


def brute_hits(rows, items, size=10):
    pattern = decontamination.WORD
    ws = lambda t: pattern.findall((t or "").encode().lower())
    out = []
    for i, t in rows:
        own, hit, names = ws(t), set(), set()
        for name, text in items:
            it = ws(text)
            for k in range(max(1, len(it) - size + 1) if it else 0):
                w = it[k : k + size]
                for p in range(len(own) - len(w) + 1):
                    if own[p : p + len(w)] == w:
                        hit.update(range(p, p + len(w)))
                        names.add("" if name is None else str(name))
        out.append((i, len(own), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontamination_by_brute_force(spark):
    rows = corpus(7)
    ws = [t for _, t in rows if t and len(t.split()) > 20]
    items = [(10, " ".join(ws[0].split()[2:15])), (9, ws[1].upper()), (2, "the ofing"), (None, ws[2]), (5, None), (6, ""), (9, "été"), (11, " ".join(ws[0].split()[2:15]))]
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, segment int")
    wanted = brute_hits(rows, items)
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    for block in (1 << 20, 60):
        found = decontamination.decontaminate(docs(spark, rows).repartition(3), benchmark, block_bytes=block)
        assert sorted((tuple(r[c] for c in cols) for r in found.collect()), key=str) == wanted
    assert decontamination.decontaminate(docs(spark, rows), benchmark.limit(0)).where("contaminated").count() == 0
    assert decontamination.decontaminate(docs(spark, []), benchmark).count() == 0


def test_proximity():
    segment = decontamination.Segment.index([1, 2], [b"x a b c y", b"c a"], None)
    assert segment.document(segment.near((b"a", b"c"), 2)).tolist() == [0, 1]
    assert segment.near((b"x", b"y"), 3).tolist() == [] and segment.near((b"x", b"y"), 4).tolist() == [0]


def test_triples_meet_every_four_positions():
    from itertools import combinations

    assert len(simhash.TRIPLES) == 20
    assert all(any(set(t) <= set(four) for t in simhash.TRIPLES) for four in combinations(range(8), 4))


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = lowered.encode().split()
    shingles = [b" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    root = list(range(len(ids)))
    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4 and root[a] != root[b]:
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    return [min((ids[k] for k in range(len(ids)) if root[k] == r and ids[k] is not None), default=None) for r in root]


def test_simhash_by_brute_force(spark):
    rows = corpus(8, 90)
    prints = [brute_fingerprint(t) for _, t in rows]
    wanted = sorted(zip([i for i, _ in rows], ["%016x" % p for p in prints], brute_components([i for i, _ in rows], prints)), key=str)
    for block in (2, 2048):
        found = simhash.near_duplicates(docs(spark, rows).repartition(3), block).collect()
        assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found), key=str) == wanted
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_links_within_a_dense_ball(spark):
    """A chain of fingerprints, 4 bits a step, in lists of several blocks."""
    draw, now, prints = random.Random(9), 0, []
    for _ in range(150):
        for b in draw.sample(range(64), 4):
            now ^= 1 << b
        prints += [now, now ^ (1 << draw.randrange(64))]
    prints = list(dict.fromkeys(prints))
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    roots = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in graph.components(simhash.links(nodes, 4)).collect()}
    groups = lambda label: sorted(sorted(p for p in prints if label[p] == x) for x in set(label.values()))
    brute = dict(zip(prints, brute_components(prints, prints)))
    assert groups({p: roots.get(p, p) for p in prints}) == groups(brute)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (7, 7)], "u long, v long")
    found = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    assert found == {**{k: 0 for k in range(1, 201)}, 501: 500}


def brute_repeats(rows):
    last = (1 << 63) - 1
    first: dict = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            first[s] = min(first.get(s, last), last if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < (last if i is None else i):
                gone[k : k + 50] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.r_[False, gone].astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [10, 11])
def test_repeats_by_brute_force(spark, seed):
    rows = corpus(seed, 70)
    draw = random.Random(seed)
    base = "".join(draw.choice("abcdefgh ") for _ in range(300))
    # Passages of just under, exactly and just over the length, cut at odd places; periodic texts.
    for k, n in enumerate((48, 49, 50, 51, 52, 75, 120)):
        at = draw.randrange(0, 150)
        rows.append((200 + k, "".join(draw.choice("xyz") for _ in range(30)) + base[at : at + n] + "".join(draw.choice("uvw") for _ in range(30))))
    rows += [(300, base), (199, "ab" * 90), (301, "c" + "ab" * 80), (302, base[:50]), (303, base[250:])]
    draw.shuffle(rows)
    found = substrings.repeats(docs(spark, rows).repartition(3)).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in found), key=str) == brute_repeats(rows)


def test_repeats_of_nothing(spark):
    assert substrings.repeats(docs(spark, [])).count() == 0
    kept = substrings.repeats(docs(spark, [(1, "é" * 60), (2, "x" + "é" * 60 + "y")]), "lang", "block", with_text=True).orderBy("doc_id").collect()
    assert [r["kept"] for r in kept] == ["é" * 60, "xy"] and kept[0]["block"] == 1


def test_parts_of_very_long_texts_have_all_anchors():
    draw = np.random.default_rng(3)
    text = draw.integers(97, 107, (1 << 23) + 4000, dtype=np.uint8)
    whole = substrings.anchors(text, np.array([len(text)]))[1].tolist()
    found = set()
    for _, _, offset, goes_on, sizes, data in substrings._pieces(np.array([1]), np.array([0]), [text.tobytes()]):
        _, places = substrings.anchors(data, sizes)
        left, right = np.minimum(places, 34), np.minimum(len(data) - places, 50)
        keep = ((offset[0] == 0) | (left == 34)) & (~goes_on[0] | (right == 50))
        found |= set((places[keep] + offset[0]).tolist())
    assert found >= set(whole)


def test_suffix_order_of_a_bucket():
    """Cover ranks order the contexts' suffixes as plain sorting does."""
    draw = np.random.default_rng(5)
    rows = np.zeros((40, substrings.ROW), np.uint8)
    rows[:, : substrings.WIDTH] = draw.integers(97, 99, (40, substrings.WIDTH))
    rows[20:] = rows[:20]
    rows[20:30, 70] = 120
    for offset, rank in substrings.cover_ranks(rows).items():
        plain = [r[offset:].tobytes() for r in rows]
        assert [plain[k] for k in np.argsort(rank, kind="stable")] == sorted(plain)
        assert len(set(rank.tolist())) == len(set(plain))
