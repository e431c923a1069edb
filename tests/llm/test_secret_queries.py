"""Trigram queries follow from the patterns, and spans of a text with very many matches are found in one go."""

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from noticelake.llm import secret_scan
from noticelake.llm.secret_scan import RULES, Rule

OTHERS = [
    r"(?:abc|def(?:gh|ij)+)x?[0-9]{2,}key", r"a{3,}b", r"(foo|ba[rz]){2}qux", r"(?i:Straw)[a-z]+Berry", r"^id-(?=\d)\d+$", r"x.y.z", r"(ab?c?d){1,3}efg",
    r"(secret|[a-z]{40})", r"k(?:[0-9]|[a-f])-tail", r"(?:a|bcd)?efg", r"[^a]bcd",
]


def holds(rule, text):
    query = secret_scan.trigram_query(rule)
    own = text.lower() if secret_scan.any_case(rule) else text
    return query is None or any(all(t in own for t in group) for group in query)


@pytest.mark.parametrize("pattern", [r.pattern for r in RULES] + OTHERS)
def test_every_match_satisfies_the_query(pattern):
    rule = Rule("x", pattern)

    @settings(max_examples=150, deadline=None, database=None)
    @given(st.from_regex(re.compile(pattern, re.ASCII)))
    def run(text):
        assert holds(rule, text)

    run()


def test_queries_of_patterns():
    query = lambda p: secret_scan.trigram_query(Rule("x", p))
    assert query("AKIA[A-Z0-9]+") == [["AKI", "KIA"]]
    assert query("[0-9a-f]{32,}") is None and query("(secret|[a-z]{40})") is None and query("ab") is None and query("a.*c") is None
    assert query("-----BEGIN [A-Z ]*PRIVATE KEY-----") == [sorted({x[i : i + 3] for x in ("-----BEGIN ", "PRIVATE KEY-----") for i in range(len(x) - 2)})]
    assert query("(?i)Token[:=]") == sorted([sorted(["tok", "oke", "ken", "en:"]), sorted(["tok", "oke", "ken", "en="])])
    assert query("gh[ps]_x+") == [["gh" + c, "h" + c + "_"] if "gh" + c < "h" + c + "_" else ["h" + c + "_", "gh" + c] for c in "ps"]
    assert query("(?:abc|def)?ghi") == [["ghi"]]
    assert not holds(Rule("x", "gh[ps]_x+"), "ghq_x") and holds(Rule("x", "(?i)Token[:=]"), "a tOKEN=")


def test_many_matches_in_one_text(spark):
    one = "0123456789abcdef" * 2
    text = " é ".join([one] * 40_000)
    docs = spark.createDataFrame([(1, text), (2, "token=12345678 " * 3_000)], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r for r in secret_scan.find_secrets(docs).collect()}
    assert time.time() - began < 60
    assert got[1]["n_hex"] == 40_000 and got[1]["spans"] == ",".join(f"hex:{35 * i}:{35 * i + 32}" for i in range(40_000))
    assert got[2]["n_assign"] == 3_000 and got[2]["spans"] == ",".join(f"assign:{15 * i}:{15 * i + 14}" for i in range(3_000))
