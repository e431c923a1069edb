"""Line dedup in its wide form, and items of every window size, against plain versions."""

import random
import re

from noticelake.llm import decontaminate, line_templates


def test_short_and_two_document_lines(spark):
    names = ["Ada", "Bea", "Cem", "Dov"]
    rows = [(i, f"Posted by {n} on Monday at noon today\nPage {i} of 12\n{n}{n} wrote it") for i, n in enumerate(names)]
    rows += [(10, "a line that stands in two documents\nOK"), (11, "a  line that stands in two documents \nOK"), (12, "OK\n---"), (13, "---"), (14, "---"), (15, None), (16, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_templates.drop_recurring_lines(docs, cleaned="clean", wide=True).collect()}
    assert got[0]["clean"] == rows[0][1] and got[0]["n_dropped"] == 0
    for i in (1, 2, 3):  # the page line holds two numbers among four tokens
        assert "Page" not in got[i]["clean"]
        assert f"{names[i]}{names[i]} wrote it" == got[i]["clean"]
    assert got[10]["clean"] == rows[4][1]
    assert got[11]["clean"] == "" and got[11]["n_dropped"] == 2  # white space counts as one blank, OK stands in three
    assert got[12]["clean"] == "---" and got[13]["clean"] == "---" and got[14]["clean"] == "---"  # no letter, no digit
    assert got[15]["clean"] is None and got[15]["n_lines"] == 0 and got[16]["clean"] == ""


def test_windows_of_every_size(spark):
    rng = random.Random(7)
    word = lambda: rng.choice("abcdefg")
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 14, 6, 9])]
    docs = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([0, 1, 2, 3, 5, 8, 13, 21, 34, 55, 400])]
    docs += [(100 + i, f"x y {t} z") for i, t in items]
    spelt = lambda t: re.findall(r"[0-9a-z]+", t)
    want = set()
    for item, text in items:
        w = spelt(text)
        size = min(len(w), 10)
        grams = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
        for doc, body in docs:
            b = spelt(body)
            want |= {(doc, s, size, item) for s in range(len(b) - size + 1) if tuple(b[s : s + size]) in grams}
    own = spark.createDataFrame(docs, "doc_id long, text string")
    hits = decontaminate.window_hits(own, spark.createDataFrame(items, "item_id long, text string"))
    got = [(r["doc_id"], r["start"], r["size"], r["item_id"]) for r in hits.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert len({n for _, _, n, _ in want}) == 10
