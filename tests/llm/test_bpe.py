import os

import numpy as np
import pytest

from inkwell.llm.bpe import TOKENIZERS, Encoder, encode_corpus, encoder

PATH = f"{TOKENIZERS}/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files here")

TEXTS = [
    "", " ", "\n\n  \n", "it's we'll they'd 'tis ''s 's's I'M", "a  b   c\t\td 　e ", "x" * 700,
    "日本語の文書を読む。索引……", "नमस्ते दुनिया", "ภาษาไทยไม่มีช่องว่าง", "<|endoftext|> is text", "é 👩‍💻 ​",
    "12345 67.89 v1.2", "\r\n\r\nword\r\n", "aaaaaaaaaaaaaaaa", "\x00\x1c\x1d end", "unbelievably antidisestablishmentarianism",
]


def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_equals_the_public_library():
    offsets, ids = Encoder(PATH).encode(TEXTS)
    got = [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]
    assert got == reference()(TEXTS)


def test_random_mixtures():
    rng = np.random.default_rng(3)
    signs = list(" '\n\tabcdstrelvm.,!12é中の文กาनि") + ["'s", "  ", "the", "ing"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 60))) for _ in range(800)]
    offsets, ids = encoder(PATH).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == reference()(texts)


def test_merging_side_by_side_equals_one_by_one():
    rng = np.random.default_rng(5)
    words = [bytes(rng.choice(list(b"abcdeinorst \xe4\xb8\xad"), rng.integers(1, 40))) for _ in range(500)]
    bpe = encoder(PATH).bpe
    assert [x.tolist() for x in bpe.exact_many(words)] == [bpe.exact(w) for w in words]


def test_nulls_extra_columns_repeats_and_empty_tables(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "hello world", "z"), (3, "hello world", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in encode_corpus(df).collect())
    assert got == [(1, []), (2, []), (3, [31373, 995]), (3, [31373, 995])]
    assert encode_corpus(df.limit(0)).count() == 0
