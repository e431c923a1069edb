"""Articles with lists, quotes, tables, plain and deeply nested blocks come out whole; what is around them does not."""

import random

import pandas as pd
import pytest

from noticelake.llm import html_blocks

PAGES = "/root/testdata/sf0.01/pages.parquet"
TEXT = "The council met on Tuesday and agreed to repair the old bridge over the river before winter."
NAV = "<nav><ul><li><a href=/>Home</a></li><li><a href=/news>News</a></li><li><a href=/about>About</a></li></ul></nav>"
FOOT = "<footer><p>© 2024 All rights reserved</p></footer>"


@pytest.fixture(scope="module")
def net():
    """Fitted on as many pages as the query's."""
    return html_blocks.fit_pages(sorted(pd.read_parquet(PAGES)["html"].dropna())[: html_blocks.SAMPLE])


def lines(net, page):
    blocks = html_blocks.leaf_blocks(page)
    return [b.text for b, p in zip(blocks, net.label([html_blocks.features(blocks)])[0], strict=True) if p >= 0.5]


def test_lists_quotes_and_tables(net):
    body = f"<h1>Bridge to be repaired</h1><p>One. {TEXT}</p><p>Two. {TEXT}</p><p>Three. {TEXT}</p><ul><li>Stone work first</li><li>Then the railing</li></ul><p>Four. {TEXT}</p><blockquote>It had to be done, said the mayor.</blockquote><table><tr><td>Cost in all</td></tr></table>"
    want = ["Bridge to be repaired", f"One. {TEXT}", f"Two. {TEXT}", f"Three. {TEXT}", "Stone work first", "Then the railing", f"Four. {TEXT}", "It had to be done, said the mayor.", "Cost in all"]
    assert lines(net, f"<html><body><article>{body}</article>{NAV}{FOOT}</body></html>") == want
    assert lines(net, f"<html><body>{NAV}<article>{body}</article>{FOOT}</body></html>") == want


@pytest.mark.parametrize("n", [1, 2, 5])
def test_plain_blocks(net, n):
    page = f"<html><body>{NAV}<article><h1>Bridge to be repaired</h1>" + "".join(f"<div>{k}. {TEXT}</div>" for k in range(n)) + f"</article>{FOOT}</body></html>"
    assert lines(net, page) == ["Bridge to be repaired", *(f"{k}. {TEXT}" for k in range(n))]


@pytest.mark.parametrize("depth", [0, 1, 10, 60, 500])
def test_deep_nesting(net, depth):
    article = "<article>" + "".join(f"<p>{k}. {TEXT}</p>" for k in range(5)) + "</article>"
    page = f"<html><body>{NAV}" + "<div>" * depth + article + "</div>" * depth + f"{FOOT}</body></html>"
    assert lines(net, page) == [f"{k}. {TEXT}" for k in range(5)]
    inside = f"<html><body>{NAV}<article>" + "<div>" * depth + "".join(f"<p>{k}. {TEXT}</p>" for k in range(5)) + "</div>" * depth + f"</article>{FOOT}</body></html>"
    assert lines(net, inside) == [f"{k}. {TEXT}" for k in range(5)]


def test_end_tags_reach_any_depth():
    for depth in (1, 63, 64, 70, 5000):
        blocks = html_blocks.leaf_blocks("<article>" + "<div>" * depth + "text</article><nav>menu</nav><footer>foot</footer>")
        assert [tuple(b.path)[:1] for b in blocks] == [("article",), ("nav",), ("footer",)], depth
    assert [b.path for b in html_blocks.leaf_blocks("</div>a</p>")] == [()]


def test_held_out_layouts():
    """Every second page is fitted; the others, rewritten with another seed, are judged."""
    pages = sorted(pd.read_parquet(PAGES)["html"].dropna())
    net = html_blocks.fit_pages(pages[::2])
    rng = random.Random(20261)
    kept = lost = let_in = out = 0
    for page in pages[1::2]:
        blocks = html_blocks.leaf_blocks(page)
        labels = html_blocks.weak_labels(blocks)
        if not labels.any():
            continue
        made, want = html_blocks.rewritten(blocks, labels, rng)
        have = net.label([html_blocks.features(made)])[0] >= 0.5
        for b, w, h in zip(made, want, have, strict=True):
            n = len(b.text)
            kept, lost, let_in, out = kept + n * bool(w and h), lost + n * bool(w and not h), let_in + n * bool(h and not w), out + n * bool(not h and not w)
    print("article kept", kept / (kept + lost), "of other text let in", let_in / (let_in + out))
    assert kept >= 0.98 * (kept + lost) and let_in <= 0.02 * (kept + lost)
