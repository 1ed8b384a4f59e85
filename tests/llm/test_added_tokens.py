"""Ids of texts that hold the vocabulary's added tokens, against the unmodified library."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from vintage.llm import packing, token_store, tokens

PATH = tokens.default_vocabulary()
END = "<|endoftext|>"


def library_ids(texts):
    return [[*e.ids, tokens.END_ID] for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_document_ids_equal_the_unmodified_library():
    draw = random.Random(12)
    bits = ["a", "Foo", "é", "漢", " ", "  ", "\n", "1", "'s", ".", END, END, "<|endof", "text|>", "<|ENDOFTEXT|>", "😀"]
    texts = ["hello <|endoftext|> world", END, END * 2, "", None] + ["".join(draw.choices(bits, k=draw.randint(0, 12))) for _ in range(3000)]
    assert [np.frombuffer(tokens.document_ids(PATH, t), "<u4").tolist() for t in texts] == library_ids(texts)


def test_store_and_packing_hold_added_tokens(spark):
    rows = [(1, f"one {END} two"), (2, "three"), (3, END), (4, f"{END}four  {END}\n")]
    ids = library_ids([t for _, t in rows])
    crcs = [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stored = token_store.token_binary(docs).orderBy("start").collect()
    starts = np.r_[0, np.cumsum([len(x) for x in ids])[:-1]].tolist()
    assert [(r["start"], r["n_tokens"], r["ids_crc32"]) for r in stored] == list(zip(starts, map(len, ids), crcs))
    packed = packing.pack_documents(docs).orderBy("doc_id").collect()
    assert [(r["length"], r["ids_crc32"]) for r in packed] == list(zip(map(len, ids), crcs))
