"""Pieces of texts that are encoded once: finer cuts and a bounded memory change no ids."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from noticelake.llm import encoding, packing

BPE = public_tokenizers.path("byte_bpe_50k.json")


def plain(texts):
    tokenizer = Tokenizer.from_file(BPE)
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def encoded(encoder, texts, **kw):
    return [x.tolist() for _, ids, n in encoder.encode(pa.array(texts, pa.string()), **kw) for x in np.split(ids, np.cumsum(n)[:-1])]


def odd_texts(n):
    rng = random.Random(7)
    some = ["a", "Zq", "don't", "we'RE", "'s", "'", ".", "!!", ",", "<", "|", ">", "<|endoftext|>", "endoftext", "\n", "\n\n", "\r\n", "\t", " ", "  ", "7", "42", "é", "ñ", "日本", " ", " ", "\x1f", "́", "😀", "_", "x.y"]
    return ["".join(rng.choice(some) for _ in range(rng.randrange(30))) for _ in range(n)]


@pytest.mark.parametrize("most", [10**6, 40, 0])
def test_cut_texts_equal_whole_texts(most):
    texts = [*odd_texts(3000), None, "", "\n", "x\n", "\nx", "x\ny", "x.\n\ny", "<|endoftext|", "a<|endoftext|>b.", "word\n <|endoftext|>"]
    encoder = encoding.Encoder(BPE)
    for some in (texts, texts[::-1], texts[:7] + ["new words. new, words!\nnew"], [], [None]):
        assert encoded(encoder, some, most=most) == plain(some)
        assert len(encoder.slots) <= most and encoder.held == int(encoder.lengths[: len(encoder.slots)].sum())


def test_a_word_is_encoded_once_whatever_sign_follows():
    encoder = encoding.Encoder(BPE)
    encoded(encoder, ["a word. a word, a word! a word; a word)\na word"])
    assert sorted(encoder.slots) == [b"\na", b" a", b" word", b"!", b")", b",", b".", b";", b"a"]


def test_packing_reads_the_same_ids():
    texts = odd_texts(1500)
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array(texts), pa.array([None] * 1500, pa.int64())], names=["doc_id", "text", "prompt"])
    got = list(packing._encoded(batch, BPE, (9).to_bytes(4, "little"), 50))
    assert [(d, np.frombuffer(ids, "<u4").tolist()) for d, ids, _ in got] == [(d, [*ids, 9]) for d, ids in enumerate(plain(texts))]
