"""Stages of the pipeline on copies: near copies reach near dedup whole, repeated rows and texts do no harm."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from noticelake.llm import lang_kernel, line_templates, minhash

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def test_near_copies_reach_near_dedup(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    linked = minhash.near_duplicates(docs).filter("not kept").select("doc_id").collect()
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    first = {}
    for d in sorted(texts):
        first.setdefault(texts[d], d)
    near = {r["doc_id"] for r in linked if first[texts[r["doc_id"]]] == r["doc_id"]}  # no exact copies
    line_templates.line_stage(docs).write.parquet(str(tmp_path / "lines"))
    kept = minhash.drop_near_duplicates(spark.read.parquet(str(tmp_path / "lines")))
    left = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert len(near) >= 10 and len(near & left) <= len(near) // 10


def test_lines_of_unrelated_documents_still_go(spark):
    own = lambda i: "\n".join(f"text {i} tells of matter {i * 7 + k} and {w} alone" for k, w in enumerate(("rain", "snow", "wind")))
    line = "this very sentence stands in two documents that have nothing else in common"
    body = "\n".join(" ".join(f"{w}{k}" for k in "abcdefghijklmno") for w in ("one", "two", "three", "four", "five", "six"))
    rows = [(1, f"{own(1)}\n{line}"), (2, f"{own(2)}\n{line}"), (3, f"{body}\n{line}"), (4, f"{body}\nslightly other end"), (None, "no id at all"), (5, None), (6, "")]
    got = {r["doc_id"]: r["text"] for r in line_templates.line_stage(frame(spark, rows)).collect()}
    assert line in got[1] and line not in got[2] and line not in got[3]
    assert got[4] == f"{body}\nslightly other end" and body in got[3]
    assert got[None] == "no id at all" and got[5] is None


def test_near_dedup_of_repeated_rows(spark):
    a, b = "one two three four five six seven eight nine", "ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [(1, a), (1, a), (1, a), (None, a), (None, b), (None, b), (2, a), (3, b + " x"), (3, "something else is written here by us"), (4, "something else is written here by us"), (5, None), (5, None), (6, ""), (7, "")]
    got = sorted(((r["doc_id"], r["text"]) for r in minhash.drop_near_duplicates(frame(spark, rows)).collect()), key=str)
    texts = [t for _, t in got]
    assert texts.count(a) == 1 and (1, a) in got
    assert texts.count(b) + texts.count(b + " x") == (2 if len(got) == 7 else 1)
    assert texts.count("something else is written here by us") == 1 and (4, "something else is written here by us") in got
    assert texts.count(None) == 1 and texts.count("") == 2
    assert minhash.drop_near_duplicates(frame(spark, [])).count() == 0


def test_near_dedup_of_columns_with_inner_names(spark):
    docs = frame(spark, [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "other words")]).selectExpr("*", "7 AS _gone", "8 AS _row")
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"], r["_gone"], r["_row"]) for r in kept.collect()) == [(1, 7, 8), (3, 7, 8)]


def test_language_of_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copies = frame(spark, [(10**6 + i, "la la la lo li lu") for i in range(5000)]).withColumn("lang", F.lit("xx"))
    model = lang_kernel.fit(docs.unionByName(copies))
    assert model.langs == ["de", "en", "es", "fr", "xx"] and np.isfinite(model.weights).all()
    rows = lang_kernel.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("lang is not null and lang_pred != 'und'").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.99 * len(rows)
    assert lang_kernel.predict(copies.limit(3), model).first()["lang_pred"] == "xx"


def test_language_kernel_brute_force(spark):
    rng = np.random.default_rng(4)
    words = {"aa": ["bolo", "kama", "tiri", "sofa"], "bb": ["xenk", "wurz", "qual", "dryg"]}
    rows = [(i, " ".join(rng.choice(words[c], 12)), c) for i, c in enumerate(["aa", "bb"] * 20)]
    model = lang_kernel.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), landmarks=10)
    texts = sorted({t for _, t, _ in rows})

    def grams(text):
        raw = text.encode()
        return {raw[i : i + g] for g in (1, 2, 3) for i in range(len(raw) - g + 1)}

    def kernel(a, b):  # of presence vectors, as long as no two n-grams share a bucket
        return len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b)))

    found = lang_kernel.presence(*lang_kernel.utf8(pa.array(texts)))
    unit = lang_kernel.normalised(found)
    assert np.allclose(unit @ unit.T, [[kernel(a, b) for b in texts] for a in texts], atol=0.02)
    marks = lang_kernel._unpacked(model.marks)
    m = marks / np.sqrt(marks.sum(axis=1, keepdims=True))
    values, vectors = np.linalg.eigh((m @ m.T).astype(float))
    keep = values > 1e-6 * values.max()
    phi = (unit @ m.T) @ (vectors[:, keep] / np.sqrt(values[keep]))
    lang = dict((t, c) for _, t, c in rows)
    y = np.array([[lang[t] == c for c in ("aa", "bb")] for t in texts], float)
    w = (y / y.sum(axis=0)).sum(axis=1) * len(y) / 2
    z = np.hstack([phi, np.ones((len(phi), 1))])
    penalty = np.diag([lang_kernel.RIDGE] * phi.shape[1] + [1e-6])
    want = z @ np.linalg.solve((z.T * w) @ z + penalty, (z.T * w) @ y)
    assert np.allclose(lang_kernel.scores(model, pa.array(texts)), want, atol=2e-3)


def test_language_without_labels(spark):
    model = lang_kernel.fit(spark.createDataFrame([(1, "some text", None), (2, "12", "en")], "doc_id long, text string, lang string"))
    assert model.langs == [] and lang_kernel.predict(spark.createDataFrame([(1, "a")], "doc_id long, text string"), model).first()["lang_pred"] == "und"


@pytest.mark.parametrize("n", [1, 3])
def test_fewer_texts_of_many_languages(spark, monkeypatch, n):
    monkeypatch.setattr(lang_kernel, "MOST", 6 * n)
    rows = [(i, f"{'abcdef'[i % 6] * 5} {i} words", f"l{i % 6}") for i in range(120)]
    assert len(lang_kernel._sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 300)) == 6 * n
