"""The language stage has an effect on what follows: its language replaces the given one, and sequences hold one language."""

import random
import zlib

import public_tokenizers
import pytest

import corpus_pipeline
from noticelake.llm import packing

SF = "/root/testdata/sf0.01"
BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_found_language_is_passed_on(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = [k for k in range(10**6, 10**6 + 99) if zlib.crc32(str(k).encode()) % 4 == 2][:3]  # not learnt from
    texts = [docs.filter(f"lang = '{lang}' and n_chars > 1000").orderBy("doc_id").first()["text"] for lang in ("en", "fr", "de")]
    other = [(k, t, lang, "s", len(t)) for k, t, lang in zip(held, texts, [None, "en", "es"], strict=True)]
    out = corpus_pipeline.language_id(spark, docs.unionByName(spark.createDataFrame(other, DOCS)), SF)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["lang"] for r in out.select("doc_id", "lang").collect()}
    assert [got[k] for k in held] == ["en", "fr", "de"] and set(got.values()) == {"de", "en", "es", "fr"}


@pytest.mark.parametrize("most", [4096, 300])
def test_sequences_of_one_language(spark, monkeypatch, most):
    monkeypatch.setattr(packing, "POOLED", most)
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice("abcdefg") * rng.randrange(1, 9) for _ in range(rng.randrange(300))), rng.choice(["de", "en", None, f"l{k % 40}"])) for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    lang = {k: v for k, _, v in rows}
    one, whole = {}, {}
    pieces = packing.pack_documents(docs, BPE, group="lang").collect()
    for r in pieces:
        one.setdefault(r["sequence_id"], set()).add(lang[r["doc_id"]])
        whole.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
        whole.setdefault(("sequence", r["sequence_id"]), []).append((r["offset"], r["length"], None))
    assert len(one) > 44 and all(len(x) == 1 for x in one.values())
    for key, parts in whole.items():
        at = 0
        for start, length, total in sorted(parts):
            assert start == at
            at += length
        assert at == total if total else at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    assert len([k for k in whole if not isinstance(k, tuple)]) == len(rows)
