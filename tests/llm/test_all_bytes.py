"""Language trees over all byte values and all contexts: several scripts, rare contexts, against a plain table."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from vintage.llm import language_id

SCRIPTS = {"el": "αβγδεζηθικλμνξοπρστυφχψω", "ru": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "ja": "".join(chr(0x3041 + k) for k in range(80)), "en": "abcdefghijklmnopqrstuvwxyz", "ko": "".join(chr(0xAC00 + 97 * k) for k in range(90))}


def grams(text):
    b = language_id.PAD + text
    c = Counter(int.from_bytes(b[k : k + 4], "big") for k in range(len(text)))
    return np.array(list(c), np.uint32), np.array(list(c.values()))


def plain_bits(sample, asked):
    padded, seen = language_id.PAD + sample, [Counter() for _ in range(4)]
    follow: dict = {}
    for k in range(3, len(padded)):
        for order in range(4):
            follow.setdefault(padded[k - order : k], Counter())[padded[k]] += 1

    def p(context, byte):
        below = p(context[1:], byte) if context else 1 / 256
        own = follow.get(context)
        if not own:
            return below
        total = sum(own.values()) + len(own)
        return own[byte] / total if byte in own else len(own) / total * below

    b = language_id.PAD + asked
    return -sum(math.log2(p(b[k - 3 : k], b[k])) for k in range(3, len(b)))


def test_code_lengths_of_many_scripts_are_exact():
    draw = random.Random(4)
    text = lambda letters, n: "".join(draw.choice(letters + "  ") for _ in range(n)).encode()
    samples = {name: text(letters, 1500) for name, letters in SCRIPTS.items()}
    assert len({b for t in samples.values() for b in t}) > 95
    model = language_id.Model.fit({name: grams(t) for name, t in samples.items()})
    asked = [text(letters, 60) for letters in SCRIPTS.values()] + [bytes(range(256)).decode("latin1").encode(), b"x", b""]
    found = model.code_lengths(asked)
    for row, t in zip(found, asked):
        assert row.tolist() == pytest.approx([plain_bits(samples[name], t) for name in model.languages], rel=1e-5)
    assert model.predict(asked[:5])[0] == list(SCRIPTS)


def test_distinct_codes_equal_unique():
    draw = np.random.default_rng(1)
    for n, most in ((1, 5), (5000, 40), (300_000, 1 << 32)):
        codes = draw.integers(0, most, n, dtype=np.uint32)
        own, place = language_id._distinct(codes)
        assert (own[place] == codes).all() and len(own) == len(np.unique(codes))
