"""Templates of leaves that one task counts and of those that are dealt by token are the same."""

import random

import pytest

from noticelake.llm import line_templates

DOCS = "doc_id long, text string"


def lines(seed, n=400):
    rng = random.Random(seed)
    fields = lambda: " ".join(rng.choice(["on", "at", "by", f"u{rng.randrange(50)}", rng.choice("abcdefghijkl")]) for _ in range(rng.randrange(5)))
    return [(rng.randrange(n // 2) if rng.random() < 0.98 else None, "\n".join(f"{rng.choice(['Posted by', '7 3', 'see the'])} {fields()}".strip() for _ in range(rng.randrange(1, 5)))) for _ in range(n)]


def dropped(spark, rows, wide):
    got = line_templates.drop_recurring_lines(spark.createDataFrame(rows, DOCS), cleaned="left", wide=wide)
    return sorted(((r["doc_id"], r["left"], r["n_lines"], r["n_dropped"]) for r in got.collect()), key=str)


def plain(rows):
    """The same by loops, without exact lines."""
    held, found = {}, []
    for d, text in rows:
        for pos, line in enumerate(text.split("\n")):
            u = line.split()
            m = ["<*>" if any(c.isdigit() for c in t) else t for t in u]
            t = m if m.count("<*>") * 100 <= len(u) * 30 else u
            if len(t) >= 3:
                found.append((d, text, pos, (len(t), *t[:4]), tuple(t)))
                held.setdefault((len(t), *t[:4]), {}).setdefault(tuple(t), set()).add(d)
    docs = {}
    for f in found:
        leaf = held[f[3]]
        fixed = tuple((i, x) for i, x in enumerate(f[4]) if x != "<*>" and sum(len(ds) for o, ds in leaf.items() if o[i] == x) >= 3)
        docs.setdefault((f[3], fixed if len(fixed) * 100 >= len(f[4]) * 70 else f[4]), []).append(f)
    gone = set()
    for fs in docs.values():
        ids = {f[0] for f in fs}
        first = min((d for d in ids if d is not None), default=None)
        if len(ids) >= 3:
            gone |= {f[:3] for f in fs if f[0] != first}
    out = []
    for d, text in rows:
        ls = text.split("\n")
        left = [x for i, x in enumerate(ls) if (d, text, i) not in gone]
        out.append((d, "\n".join(left), len(ls), len(ls) - len(left)))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [0, 5, 20_000])
def test_large_and_small_leaves(spark, monkeypatch, most):
    monkeypatch.setattr(line_templates, "MAX_LEAF", most)
    rows = lines(1)
    want = plain(rows)
    assert sum(r[3] for r in want) > 100 and dropped(spark, rows, False) == want


def test_large_leaves_of_the_whole_job(spark, monkeypatch):
    rows = lines(2)
    want = dropped(spark, rows, True)
    monkeypatch.setattr(line_templates, "MAX_LEAF", 0)
    assert dropped(spark, rows, True) == want


def test_tokens_of_a_small_leaf_are_not_shuffled(spark):
    one = spark.createDataFrame([(1, 1, "a b c", 3)], "leaf long, line long, s string, docs long").repartition("leaf")
    plan = line_templates._templates(one, 2, together=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_COL" in plan
