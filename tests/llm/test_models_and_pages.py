"""Language ID, classifier, rules, HTML extraction, WARC and the pipeline."""

import gzip
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vintage.llm import common, html_extract, language_id, quality_classifier, quality_rules, warc

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"  # more than a score of held-out labels


def table(spark, name):
    return common.table(spark, SF, name)


def test_languages_held_out_and_awkward_rows(spark):
    docs = table(spark, "documents")
    odd = spark.createDataFrame([(None, None, "en", "s", 0), (9001, "", "de", "s", 0), (9002, "123 !?", None, "s", 0), (9003, "漢字", None, "s", 0), (1, "the and of the", "en", "s", 0)], docs.schema)
    found = language_id.language_id(docs.unionByName(odd)).collect()
    assert len(found) == docs.count() + 5
    by = {r["doc_id"]: r for r in found}
    assert by[9001]["lang_pred"] == by[9002]["lang_pred"] == by[None]["lang_pred"] == "und" and by[9002]["score"] == 0
    assert by[9003]["lang_pred"] != "und" and all(0 <= r["score"] <= 1 for r in found)
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held) > 0
    assert {r["lang_pred"] for r in language_id.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_code_lengths_equal_a_plain_ppm():
    """Method C, contexts of three to no bytes, written out."""
    texts = {"a": b"abracadabra abra cad " * 6, "b": b"banana bandana ban " * 6}
    grams = {}
    for name, t in texts.items():
        b = language_id.PAD + t
        c = Counter(int.from_bytes(b[k : k + 4], "big") for k in range(len(t)))
        grams[name] = (np.array(list(c), np.uint32), np.array(list(c.values())))
    model = language_id.Model.fit(grams)
    asked = b"abra bandana xyz!\nban"

    def plain(name):
        b, counts = language_id.PAD + texts[name], [Counter() for _ in range(4)]
        for k in range(3, len(b)):
            for order in range(4):
                counts[order][b[k - order : k + 1]] += 1
        both = Counter()
        for t in texts.values():
            padded = language_id.PAD + t
            for k in range(3, len(padded)):
                both[padded[k - 3 : k]] += 1

        def p(context, byte):
            follow = {s[-1]: n for s, n in counts[len(context)].items() if s[:-1] == context}
            if len(context) == 3 and both[context] < language_id.LEAST_CONTEXT:
                follow = {}
            below = p(context[1:], byte) if context else 1 / 256
            if not follow:
                return below
            total = sum(follow.values()) + len(follow)
            return follow[byte] / total if byte in follow else len(follow) / total * below

        padded = language_id.PAD + asked
        return -sum(np.log2(p(padded[k - 3 : k], padded[k])) for k in range(3, len(padded)))

    assert model.code_lengths([asked])[0] == pytest.approx([plain("a"), plain("b")], rel=1e-3)


def test_classifier_held_out(spark):
    docs, labels = common.table(spark, LARGER, "documents"), common.table(spark, LARGER, "labels")
    odd = spark.createDataFrame([(None, None, None, None, None), (9001, "", "de", "s", 0)], docs.schema)
    found = quality_classifier.quality_classifier(docs.unionByName(odd), labels).collect()
    assert len(found) == docs.count() + 2 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.9 * len(held) > 0
    assert {r["score"] for r in quality_classifier.quality_classifier(docs.limit(3), labels.limit(0)).collect()} == {0.5}


def test_blocked_votes_equal_plain_ones():
    draw = np.random.default_rng(1)
    counts = draw.random((60, quality_classifier.TERMS)).astype(np.float32) * (draw.random((60, quality_classifier.TERMS)) < 0.02)
    model = quality_classifier.Model.fit(counts, draw.random(60) < 0.5, rank=8, neighbours=5)
    asked = counts[:7] + 0.01
    unit = lambda x: x / np.linalg.norm(x)
    for row, score in zip(asked, model.score(asked)):
        similar = [float(unit(unit(row * model.weights) @ model.axes) @ v) for v in model.vectors]
        near = sorted(range(60), key=lambda k: -similar[k])[:5]
        weights = [max(similar[k], 0) for k in near]
        assert score == pytest.approx(sum(w * model.labels[k] for w, k in zip(weights, near)) / sum(weights), abs=1e-4)


def brute_statistics(text):
    import re

    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(ws[k : k + 3]) for k in range(len(ws) - 2)]
    hit = {p for k, w in enumerate(windows) if windows.count(w) > 1 for p in range(k, k + 3)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_statistics_by_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, "documents").where("n_chars < 4000").collect()]
    rows += [(None, None), (9001, ""), (9002, " \n \t"), (9003, "a a a a"), (9004, "x\x1cy z\x85 w"), (9005, "l\nl\n\nl \nl"), (1, "é ß\x0b漢")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((tuple(r) for r in quality_rules.with_statistics(docs, "doc_id").select("doc_id", *quality_rules.STATISTICS[:5]).collect()), key=str)
    assert found == sorted(((i, *brute_statistics(t)) for i, t in rows), key=str)


def test_rules_find_thresholds_and_mean_the_same_in_spark(spark):
    draw = np.random.default_rng(2)
    columns = {"x": draw.random(3000), "y": draw.random(3000), "z": draw.random(3000)}
    good = ~(((columns["x"] > 0.8) & (columns["y"] <= 0.5)) | (columns["z"] > 0.95))
    rules = quality_rules.learn(columns, good)
    rejected = np.zeros(3000, bool)
    for rule in rules:
        rejected |= quality_rules.covers(rule, columns, 3000)
    assert (rejected == ~good).mean() > 0.98 and len(quality_rules.describe(rules)) == len(rules) + 1
    frame = spark.createDataFrame([tuple(float(v) for v in r) for r in zip(*columns.values())], "x double, y double, z double")
    assert [r["k"] for r in frame.select(quality_rules.verdict(rules).alias("k")).collect()] == (~rejected).tolist()
    assert quality_rules.learn(columns, np.ones(3000, bool)) == [] and quality_rules.learn({"x": np.zeros(0)}, np.zeros(0, bool)) == []


def test_rules_keep_the_good(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    found = quality_rules.quality_rules(docs, labels).join(labels, "doc_id").where("NOT base_failed").toPandas()
    assert found.loc[found.quality == 1, "kept"].mean() > 0.97
    assert quality_rules.quality_rules(docs.limit(0), labels).count() == 0


PAGES = {
    "plain": ("<html><body><nav><a href=/>Home</a></nav><article><h1>T &amp; t</h1><p>One  two\n three.<br>four<p><b>Five</b> six, seven eight nine.</article><footer>c 2020 All rights</footer>", "T & t\nOne two three. four\nFive six, seven eight nine."),
    "classes": ('<div class="header"><a href=/>Site</a></div><div class="post-content"><h1>Head</h1><p>First words, of the story here.</p><div class="ad-slot">Buy now</div><p>Second words of it, and more of them.</p></div><div id="comments"><p>Reader says no.</p></div><div class="sidebar"><ul><li><a href=/x>x</a></li></ul></div>', "Head\nFirst words, of the story here.\nSecond words of it, and more of them."),
    "script": ('<body><header><h1>Site name</h1></header><main><p>Text, of the page.</p><script>var t="</p><p>no";</script><style>p{}</style><form><input name=q><button>Go</button></form><p>More text, of the page.</p></main><div class="cookie-notice">We use cookies.</div>', "Text, of the page.\nMore text, of the page."),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    source, wanted = PAGES[name]
    assert html_extract.trained().texts([source])[0] == wanted


def test_extraction_of_awkward_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p"), (4, "u", "no markup at all"), (4, "u", "</div></p><b><i>x</b>"), (5, "u", "<a href='>" * 200), (6, "u", "<div>" * 3000 + "deep")]
    found = html_extract.extract(spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, text int")).collect()
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    assert {r["text"] for r in found if r["page_id"] in (1, 2)} == {""}
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_extraction_of_generated_pages_held_out():
    draw, model, same = random.Random(99), html_extract.trained(), 0
    for _ in range(150):
        source = html_extract.training_page(draw)
        page = html_extract.parse(source)
        same += model.texts([source])[0] == "\n".join(t for node, t in page.texts if page.label[node])
    assert same >= 135


def test_decoding_is_the_best_consistent_one():
    from itertools import product

    draw = np.random.default_rng(7)
    parent = [-1, 0, 0, 1, 1, 2]
    allowed = {(0, 0), (0, 1), (1, 1), (1, 2), (2, 2)}
    for _ in range(50):
        m = draw.normal(0, 3, 6)
        value = lambda s: sum(-np.logaddexp(0, -m[k]) if s[k] == 1 else -np.logaddexp(0, m[k]) for k in range(1, 6))
        best = max((s for s in product(range(3), repeat=6) if s[0] == 0 and all((s[parent[k]], s[k]) in allowed for k in range(1, 6))), key=value)
        assert value(html_extract.decode(parent, m)) == pytest.approx(value(best))


def test_warc_by_brute_force(spark):
    long = "<p>" + "é" * 80
    rows = [(5, "http://a/x?q=1", long), (2, "http://b/", long), (2, "http://b/", long), (9, None, long), (1, "u", "short"), (3, "u", "short"), (4, None, None), (None, "http://c/", long), (6, "http://d/\r\nX: y", "a\r\n\r\nWARC/1.1\r\n" * 20), (7, "", "")]
    found = warc.warc_round_trip(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")).collect()
    wanted = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and h == long and i != 2
        wanted.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", 2 if again else None))
    assert sorted((tuple(r) for r in found), key=str) == sorted(wanted, key=str)
    assert warc.warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_reading_of_foreign_archives(spark, tmp_path):
    record = lambda kind, rid, block, *more: "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", *more, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    body = b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\nhello"
    data = record("warcinfo", "<i>", b"software: x\r\n") + record("response", "<r>", body) + record("request", "<q>", b"GET / HTTP/1.1\r\n\r\n", "WARC-Concurrent-To: <r>")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(data[:200]) + gzip.compress(data[200:]))
    rows = warc.assemble(warc.read(spark, str(tmp_path))).collect()
    assert len(rows) == 1 and rows[0]["response"]["payload_bytes"] == 5 and rows[0]["request"]["record_id"] == "<q>" and rows[0]["metadata"] is None


def test_pipeline_by_stages(spark):
    from test_text_operators import brute_components, brute_fingerprint, brute_hits, brute_repeats

    docs = table(spark, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = corpus_pipeline.classify(spark, docs, SF)
    assert kept.columns == docs.columns
    good = {r["doc_id"] for r in quality_classifier.quality_classifier(docs, table(spark, "labels")).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept.collect()} == good
    ids = sorted(good)
    first = brute_components(ids, [brute_fingerprint(rows[i]["text"]) for i in ids])
    single = [i for i, c in zip(ids, first) if i == c]
    kept = common.written(corpus_pipeline.drop_near_copies(spark, kept, SF), "test")
    assert sorted(r["doc_id"] for r in kept.collect()) == single and kept.columns == docs.columns
    cut = common.written(corpus_pipeline.cut_repeats(spark, kept, SF), "test")
    assert cut.columns == docs.columns and cut.schema == kept.schema
    removed = {r[0]: r[1] - r[2] for r in brute_repeats([(i, rows[i]["text"]) for i in single])}
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert all(removed[i] - 6 <= len(t.encode()) <= removed[i] for i, t in texts.items())
    items = [(r["item_id"], r["text"]) for r in table(spark, "benchmark").collect()]
    clean = [r[0] for r in brute_hits(list(texts.items()), items) if not r[-1]]
    left = corpus_pipeline.decontaminate(spark, cut, SF)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(clean) and left.columns == docs.columns
    packed = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in packed.collect()} == set(clean)


def test_pipeline_stages_tell_rows_without_ids_apart(spark):
    long = "word " * 80
    docs = spark.createDataFrame([(None, long, None, None, 1), (None, long + "x", None, None, 1), (None, "other text altogether here " * 9, None, None, 1), (1, "one", "en", "s", 3), (1, "two words", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars int")
    assert corpus_pipeline.drop_near_copies(spark, docs, SF).count() == 4
    assert corpus_pipeline.decontaminate(spark, docs, SF).count() == 5
    assert corpus_pipeline.cut_repeats(spark, docs, SF).count() == 5
