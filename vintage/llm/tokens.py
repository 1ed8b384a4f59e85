"""Tokenisation with a bounded cache of encoded words.

The vocabulary is a byte-level BPE whose pre-tokeniser never lets a token span
the place before a single blank or line end next to a non-blank character, so
texts are encoded segment by segment, exactly: a word with the blank or line
end before it. The segments of many texts are told apart at once by their
bytes, each different one is looked up once, and most come from the cache. The
words that don't are merged by the library's model, many in one call: only a
word's first letter stands for a blank, and no merge has that letter behind a
word's letters, so the words keep apart.
"""

from __future__ import annotations

import re
import zlib
from array import array
from operator import attrgetter

import numpy as np

from vintage.llm import common

END_ID = 0
END = END_ID.to_bytes(4, "little")
CACHE_WORDS = 300_000
#: Bytes of text encoded together; memory is about 25 times as much.
BATCH_BYTES = 2 << 20

#: Blanks other than " " and line ends next to a blank, or blanks at the end: the pre-tokeniser's pattern sees to such a text.
_ODD = re.compile(r"[^\S \n]\s|\s[^\S \n]|\s\s\Z")
_SPLIT = re.compile(r"(?= \S)")
#: A word of Latin letters behind a blank; others are left to the pre-tokeniser's own pattern.
_WORD = re.compile(" [A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+").fullmatch
#: Words that go through the library's model in one call.
TOGETHER = 256
#: Bytes of a segment that tell it apart from others in one look.
NEAR = 24
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
#: Kinds of bytes: 1 ASCII letter, 2 beyond ASCII, 3 blank or line end, 4 other blanks or their first byte, else 0.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[0x80:] = 2
_KIND[[0x20, 0x0A]] = 3
_KIND[[9, 11, 12, 13, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3]] = 4
#: Second bytes of the blanks that begin with 0xC2 or above.
_SECOND = np.zeros(256, bool)
_SECOND[[0x85, 0xA0, 0x9A, 0x80, 0x81]] = True
_id = attrgetter("id")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(spare)) for b in range(256)}


class WordEncoder:
    """batch(texts), ids(text): the library's own encoding of whole texts, as numbers and as little-endian unsigned 32-bit bytes.

    The file's added tokens are found in a text, as the library does unless
    told otherwise; to encode() their strings are ordinary text. Memory is
    bounded: of cache_words entries the recent ones are kept when as many new
    have come.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merge = self.library.model.tokenize
        added = self.library.get_added_tokens_decoder()
        self.added = {t.content: array("I", [k]).tobytes() for k, t in added.items()}
        # Tokens that take blanks around them, or whole words or normalised text only, are left to the library.
        self.plain = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split
        self.parts = regex.compile(public_tokenizers.PATTERN).findall
        self.letters = _byte_letters()
        blank = self.letters[0x20]
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.opens[[k for t, k in vocabulary.items() if t.startswith(blank)]] = True
        # Words merge apart in one call if no token has a word's letters and then a blank.
        byte = {ord(c): b for b, c in self.letters.items()}
        whole = lambda part: _WORD(" " + part.translate(byte).encode("latin1").decode("utf-8", "replace"))
        self.together = not any(t[0] != blank or any(map(whole, t.split(blank)[1:-1])) for t in vocabulary if blank in t[1:])
        self.limit = cache_words
        self.words: dict[str, bytes] = {}  # segment: its ids
        self.before: dict[str, bytes] = {}

    def _letters(self, text: str) -> str:
        """The text's bytes in the vocabulary's letters."""
        return text.encode().decode("latin1").translate(self.letters)

    def _piece(self, letters: str) -> bytes:
        """The ids of what the pre-tokeniser leaves whole, in the vocabulary's letters."""
        return array("I", map(_id, self.merge(letters))).tobytes()

    def _any(self, text: str) -> bytes:
        return b"".join([self._piece(self._letters(p)) for p in self.parts(text)])

    def _merged(self, words: list[str]) -> list[bytes]:
        """The ids of each of some words of letters behind a blank."""
        ids = self._piece(self._letters("".join(words)))
        starts = np.flatnonzero(self.opens[np.frombuffer(ids, "<u4")]) if self.together else ()
        if len(starts) != len(words):
            return [self._piece(self._letters(w)) for w in words]
        cuts = [*(starts * 4).tolist(), len(ids)]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def _cached(self, segments: list[str]) -> list[bytes]:
        """The ids of each segment."""
        if len(self.words) > self.limit:
            self.before, self.words = self.words, {}
        found = list(map(self.words.get, segments))
        missing = [k for k, ids in enumerate(found) if ids is None]
        words = []
        for k in missing:
            segment = segments[k]
            ids = self.before.get(segment)
            if ids is None:
                if _WORD(segment):
                    words.append(k)
                    continue
                ids = self._any(segment)
            found[k] = ids
        for at in range(0, len(words), TOGETHER):
            some = words[at : at + TOGETHER]
            for k, ids in zip(some, self._merged([segments[k] for k in some])):
                found[k] = ids
        self.words.update((segments[k], found[k]) for k in missing)
        return found

    def _joined(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts without odd blanks, and how many each has; no text is empty."""
        sizes = np.array([len(t) for t in texts])
        raw = b"".join([*texts, bytes(NEAR)])
        data, n = np.frombuffer(raw, np.uint8), len(raw) - NEAR
        kind = _KIND[data[:n]]
        blank = kind == 3
        # Of several blanks all but the last are one segment, the last begins the word behind it.
        begins = blank.copy()
        begins[1:-1] &= ~(blank[:-2] & blank[2:])
        # Where a word's letters end, signs and digits begin.
        letter = kind == 1
        accent = np.flatnonzero(data[: n - 1] == 0xC3)
        accent = accent[(data[accent + 1] != 0x97) & (data[accent + 1] != 0xB7)]
        letter[accent + 1] = True
        begins[1:] |= letter[:-1] & (kind[1:] == 0)
        firsts = np.cumsum(sizes) - sizes
        begins[firsts] = True
        at = np.flatnonzero(begins)
        size = np.diff(at, append=n)
        near = [np.ndarray((n + NEAR - 7,), "<u8", raw, 0, (1,))[at + 8 * k] & _KEEP[np.clip(size - 8 * k, 0, 8)] for k in range(NEAR // 8)]
        key = sum((w * m for w, m in zip(near, _MIX)), size.astype(np.uint64))
        order = np.argsort(key ^ key >> np.uint64(31))
        # Neighbours that differ are different segments, longer ones count as such unseen; the same one twice does no harm.
        new = size[order] > NEAR
        new[:1] = True
        for w in (*near, size):
            sorted_ = w[order]
            new[1:] |= sorted_[1:] != sorted_[:-1]
        reps = order[new]
        code = np.empty(len(at), np.int64)
        code[order] = np.cumsum(new) - 1
        pool = self._cached([raw[a:b].decode() for a, b in zip(at[reps].tolist(), (at + size)[reps].tolist())])
        lengths = np.fromiter(map(len, pool), np.int64, len(pool)) >> 2
        ids, own = np.frombuffer(b"".join(pool), "<u4"), lengths[code]
        # Each segment's place in the pool, spread over its ids.
        places = np.repeat((np.cumsum(lengths) - lengths)[code] - (np.cumsum(own) - own), own)
        places += np.arange(len(places))
        return ids[places], np.add.reduceat(own, np.searchsorted(at, firsts))

    def _even(self, texts: list[str]) -> np.ndarray:
        """Which of some texts, none of them empty, have no odd blanks."""
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(raw) + b"\0", np.uint8)
        rare = np.flatnonzero(_KIND[data[:-1]] == 4)
        rare = rare[(data[rare] < 0x80) | _SECOND[data[rare + 1]]]
        ends = np.cumsum([len(t) for t in raw])
        out = np.array([not t[-2:].isspace() or len(t) < 2 for t in texts])
        for k in np.unique(np.searchsorted(ends, rare, "right")).tolist():
            out[k] = not _ODD.search(texts[k])
        return out

    def _plain(self, text: str) -> bytes:
        return b"".join(self._cached(_SPLIT.split(text)))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        return self._plain(text) if _ODD.search(text) else self._joined([text.encode()])[0].tobytes()

    def ids(self, text: str | None) -> bytes:
        if not text or not any(t in text for t in self.added):
            return self.encode(text)
        if not self.plain:
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join([self.added[p] if k % 2 else self.encode(p) for k, p in enumerate(self.at_added(text))])

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        easy = [k for k, t in enumerate(texts) if t and not any(a in t for a in self.added)]
        if easy:
            easy = np.array(easy)[self._even([texts[k] for k in easy])].tolist()
        out: list[np.ndarray | None] = [None] * len(texts)
        if easy:
            ids, counts = self._joined([texts[k].encode() for k in easy])
            ends = np.cumsum(counts).tolist()
            for k, a, b in zip(easy, [0, *ends], ends):
                out[k] = ids[a:b]
        return [np.frombuffer(self.ids(t), "<u4") if own is None else own for t, own in zip(texts, out)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def forget() -> None:
    """Drop this worker's encoders and their caches: a task that encodes nothing has no use for them."""
    _encoders.clear()
    common.give_back()


def id_kind(path: str) -> str:
    """The narrowest array kind that holds the vocabulary's ids."""
    return "<u2" if encoder(path).library.get_vocab_size() <= 1 << 16 else "<u4"


def document_ids(path: str, text: str | None) -> bytes:
    """The ids of a document, end id last, as little-endian unsigned 32-bit bytes."""
    return encoder(path).ids(text) + END


def documents_ids(path: str, texts: list[str | None]) -> list[bytes]:
    """document_ids of each of some texts, whose memory the caller bounds."""
    return [ids.tobytes() + END for ids in encoder(path).batch(texts)]


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)
