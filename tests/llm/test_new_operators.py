"""Hard negatives, directly addressable token ids and shared-term search against SQL and brute force, with awkward rows."""

import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
import check
from noticelake.llm import encoding, hard_negatives, id_codes, shared_search

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_shared_search"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry_points.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(check.norm(v) for v in r) for r in df.select(*cols).collect())
    rel = con.execute(entry_points.oracle_sql()[name])
    order = sorted(range(len(rel.description)), key=lambda i: rel.description[i][0])
    assert [rel.description[i][0] for i in order] == cols
    assert got and got == sorted(tuple(check.norm(r[i]) for i in order) for r in rel.fetchall())


# ---- hard negatives ---------------------------------------------------------------------------


def brute_negatives(rows, anchor):
    """Python integers all the way; ``rows`` are (vec_id, vector, label)."""
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    own = [(i, [clip(math.floor(256 * x)) if abs(256 * x) < float("inf") else clip(int(math.copysign(2**70, x))) for x in v], y) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    late = lambda i: (i is None, i or 0)
    out = []
    for a, (ai, av, ay) in enumerate(own):
        if ai is None or not anchor(ai):
            continue
        met = [(clip(sum(x * y for x, y in zip(av, v, strict=True))), i, y) for b, (i, v, y) in enumerate(own) if b != a and len(v) == len(av)]
        met.sort(key=lambda m: (-m[0], late(m[1])))
        for ps, pi, _ in [m for m in met if m[2] == ay][:5]:
            fit = [m for m in met if m[2] != ay and 30 * ps <= 100 * m[0] <= 90 * ps][:10]
            out += [(ai, pi, r + 1, i, ps, s) for r, (s, i, _) in enumerate(fit)]
    return sorted(out, key=str)


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS rid", "'x' AS q", "2 AS slot", "3 AS anchor")
    return sorted((tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0, **kw).collect()), key=str)


def test_hard_negatives_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "TILE", (3, 16))
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    monkeypatch.setattr(hard_negatives, "ROWS", 60)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(i * 10, (centres[i % 6] + 0.3 * rng.normal(size=8)).tolist(), int(rng.integers(0, 3))) for i in range(240)]
    rows += [(7000 + i, rows[5][1], 1) for i in range(60)]  # one vector many times
    rows += [(100, rows[3][1], 2), (100, rows[3][1], 2)]  # repeated ids and rows
    assert mined(spark, rows) == brute_negatives(rows, lambda i: i % 100 == 0)
    assert mined(spark, rows, references=0) == mined(spark, rows)


def test_hard_negatives_awkward_rows(spark):
    big, nan, inf = 1e300, float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 1), (None, [1.0, 1.5], 1), (3, [0.5, 1.0], 2), (None, [0.5, 1.0], 3), (100, [0.0, 0.0], 1), (200, None, 1), (300, [nan, 1.0], 1), (400, [1.0, None], 1), (500, [inf, 0.0], 1),
        (600, [1.0, 1.0], None), (700, [], 1), (701, [], 1), (702, [], 2), (800, [1.0], 1), (900, [big, 1.0], 1), (901, [big, -big], 2), (902, [1e16, 3.0], 1), (903, [5e15, 3.0], 2), (1000, [-1.0, -2.0], 4), (1001, [1.0, 0.0], 4),
    ]
    assert mined(spark, rows) == brute_negatives(rows, lambda i: i % 100 == 0)
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0], 1)]) == []


def test_bounds_hold_every_score():
    rng = np.random.default_rng(8)
    q = np.concatenate([rng.integers(-400, 400, (60, 12)), rng.integers(-3, 3, (30, 12)), np.zeros((1, 12), int)])
    q = np.concatenate([q, q[:20], -q[:20], 3 * q[:20]])
    refs = q[[0, 5, 61]] / np.linalg.norm(q[[0, 5, 61]], axis=1)[:, None]
    norm, angle = hard_negatives.angles(q.astype(float), refs)
    low, high = hard_negatives.bounds(norm, angle, norm, angle)
    exact = hard_negatives.scores(q, q)
    assert (low <= exact).all() and (exact <= high).all()
    assert (high - low).min() < 50  # rows along a reference are bounded tightly


# ---- token ids -----------------------------------------------------------------------------------

TEXTS = [
    "", None, " ", "plain words here", "plain words here", "two  spaces", "end ", " begin", "tab\t and\nlines \n\n x", "a  b 　c", "it's <|endoftext|> we'll", "日本 語 text", "é" * 900, "x" * 5000, "q w " * 4000, "\x85 \x1f z",
]


def test_encoder_equals_whole_texts():
    tok = Tokenizer.from_file(BPE)
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("ab Z9\t\n é '!") for _ in range(rng.randrange(40))) for _ in range(600)]
    want = [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for _ in range(2):  # the second time from memory
        got = []
        for _, ids, n in encoding.encoder(BPE).encode(pa.array(texts, pa.string())):
            got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == want


def test_code_file_random_access():
    rng = np.random.default_rng(2)
    for ids in (rng.integers(0, 2**32, 5000), rng.integers(0, 200, 700), rng.integers(0, 50257, 1536), np.array([7]), np.array([70000] * 512), rng.integers(250, 260, 512 * 3 + 1)):
        cuts = np.sort(rng.integers(0, len(ids) + 1, 3))
        lengths = np.diff(np.concatenate([[0], cuts, [len(ids)]]))
        codes = id_codes.CodeFile(id_codes.file_bytes([5, None, -3, 2**40], lengths, ids.astype(np.uint32)))
        assert codes.tokens == len(ids) and codes.doc_ids.tolist() == [5, 0, -3, 2**40] and codes.nulls.tolist() == [False, True, False, False]
        places = rng.integers(0, len(ids), 300)
        assert np.array_equal(codes.at(places), ids[places])
        assert np.array_equal(codes.at(np.arange(len(ids))), ids)
        for _ in range(30):
            a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
            assert np.array_equal(codes.span(a, b), ids[a:b])
        assert np.array_equal(np.concatenate([codes.document(k) for k in range(4)]), ids)
    with pytest.raises(IndexError):
        codes.at([len(ids)])
    with pytest.raises(ValueError):
        id_codes.CodeFile(b"something else entirely")


def test_ids_round_trip(spark):
    tok = Tokenizer.from_file(BPE)
    rng = random.Random(9)
    texts = [(rng.randrange(90), t) for t in TEXTS] + [(None, "no id"), (None, None), (3, "same id"), (3, "same id"), (3, "other text")]
    texts += [(i, " ".join(str(rng.randrange(10**6)) for _ in range(rng.randrange(60)))) for i in range(100, 200)] + [(500, "again and again")] * 80
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS part", "'x' AS path", "2 AS start", "3 AS tokens")
    files = id_codes.write_ids(df, BPE, file_tokens=700).cache()
    rows = id_codes.read_ids(files, with_ids=True).collect()
    want = Counter((d, tuple([*tok.encode(t or "", add_special_tokens=False).ids, 2])) for d, t in texts)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == want
    assert all(r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows)
    rows.sort(key=lambda r: r["start"])
    assert [r["doc_id"] if r["doc_id"] is not None else -1 for r in rows] == sorted(d if d is not None else -1 for d, _ in texts)
    flat = [x for r in rows for x in r["ids"]]
    assert [r["start"] for r in rows] == (np.cumsum([r["n_tokens"] for r in rows]) - [r["n_tokens"] for r in rows]).tolist()
    assert files.count() > 4 and files.agg(F.sum("tokens")).first()[0] == len(flat)
    places = [rng.randrange(len(flat)) for _ in range(200)] + [0, 0, len(flat) - 1]
    asked = spark.createDataFrame([(p,) for p in [*places, None, -1, len(flat)]], "place long")
    assert sorted(map(tuple, id_codes.ids_at(files, asked, step=500).collect())) == sorted((p, flat[p]) for p in places)


def test_ids_of_no_documents(spark):
    files = id_codes.write_ids(spark.createDataFrame([], "doc_id long, text string"), BPE)
    assert files.count() == 0 and id_codes.read_ids(files).count() == 0


def test_ids_query(spark):
    tok = Tokenizer.from_file(BPE)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    start, want = 0, []
    for d in sorted(docs):
        ids = [*tok.encode(docs[d] or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, entry_points.queries()["op12_id_codes"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


# ---- shared-term search ---------------------------------------------------------------------------

TERM = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_search(docs, items, top=50):
    terms = [TERM.findall((t or "").translate(LOW)) for _, t in docs]
    n_docs, total = sum(1 for t in terms if t), sum(map(len, terms))
    df = Counter(t for own in terms for t in set(own))
    out = []
    for k, text in items:
        found = []
        for (d, _), own in zip(docs, terms, strict=True):
            tf = Counter(own)
            m = 50 + 50 * len(own) * n_docs // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in set(TERM.findall((text or "").translate(LOW))) if tf[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(k, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:top])]
    return sorted(out, key=str)


def ranked(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS terms", "2 AS score", "3 AS item")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS terms", "2 AS doc_id")
    return sorted(map(tuple, shared_search.search(d, i, **kw).collect()), key=str)


def test_search_brute_force(spark):
    rng = random.Random(6)
    term = lambda: f"w{int(rng.paretovariate(0.6)) % 80}"
    docs = [(i, " ".join(term() for _ in range(rng.randrange(1, 60)))) for i in range(150)]
    docs += [(None, "W1 w2,w3"), (None, "w1 w2 w3"), (7, "w1 w2 w3"), (7, "w1 w2 w3"), (900, None), (901, ""), (902, " ?! "), (903, "É é ÉÀ w5é")] + [(1000 + i, "w1 w2 w9 w9") for i in range(70)]
    items = [(i, " ".join(term() for _ in range(rng.randrange(1, 30)))) for i in range(25)] + [(3, "w1 w1 w2"), (None, "w1 é w3"), (50, None), (51, "..."), (52, "unheard"), (3, "w1 w1 w2")]
    assert ranked(spark, docs, items) == brute_search(docs, items)
    assert ranked(spark, docs, items, slots=40, top=3) == brute_search(docs, items, 3)


def test_search_of_nothing(spark):
    assert ranked(spark, [], [(1, "a b")]) == []
    assert ranked(spark, [(1, "a b")], []) == []
    assert ranked(spark, [(1, None), (2, "--")], [(1, "a")]) == []


def test_plan_sums_each_item():
    rng = random.Random(1)
    for _ in range(30):
        sets = [rng.sample([f"t{i}" for i in range(40)], rng.randrange(0, 25)) for _ in range(rng.randrange(1, 20))]
        shared = shared_search.plan(sets)
        holds = [{t} for t in shared.terms]
        for a, b in shared.sums.tolist():
            assert not holds[a] & holds[b]
            holds.append(holds[a] | holds[b])
        ends = [*shared.first[1:].tolist(), len(shared.parts)]
        for item, lo, hi in zip(shared.items.tolist(), shared.first.tolist(), ends, strict=True):
            parts = [holds[n] for n in shared.parts[lo:hi].tolist()]
            assert set().union(*parts) == set(sets[item]) and sum(map(len, parts)) == len(sets[item])
        assert set(shared.items.tolist()) == {i for i, s in enumerate(sets) if s}
        assert len(shared.sums) + len(shared.parts) <= sum(map(len, sets))


def test_large_numbers_stay_exact():
    n = np.array([10**6, 3 * 10**10])
    got = shared_search.impacts(np.array([3, 10**8]), np.array([2, 9]), n, 10**10, 7 * 10**12)
    assert got.tolist() == [w * (10**9 * tf // (1000 * tf + 20 * (50 + 50 * int(x) * 10**10 // (7 * 10**12)))) for tf, w, x in zip([3, 10**8], [2, 9], n, strict=True)]
