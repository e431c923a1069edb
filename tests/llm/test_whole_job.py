"""Cases in which an operator once did less than the whole job."""

import random

import numpy as np
import pytest

from noticelake.llm import html_blocks, kneser_ney, lang_kernel, line_templates

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], DOCS)


def stage_texts(spark, texts):
    return {r["doc_id"]: r["text"] for r in line_templates.line_stage(frame(spark, texts)).collect()}


def own(k):
    return " ".join(f"{c}{'abcdefgh'[k]}{c}" for c in "lmnopqrst")


def test_fields_in_the_first_tokens_and_short_numbered_lines(spark):
    names = ["Ada", "Berta", "Cleo", "Dora", "Edna"]
    got = stage_texts(spark, [(k, f"{own(k)}\nPosted by {n} on Monday at noon\nPage {k} of 12\n{k} 4{k} 5 {k}7") for k, n in enumerate(names)])
    assert "Posted by Ada" in got[0] and "Page 0 of 12" in got[0]
    assert all(got[k] == f"{own(k)}\n{k} 4{k} 5 {k}7" for k in range(1, 5))


def test_exact_lines_in_two_documents_and_short_lines(spark):
    twice, script = " ".join(f"p{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)), "今日は学校の図書館で新しい本を読みました。"
    more = " ".join(f"q{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(70))  # so that document 4 is no near copy of document 0
    texts = [(0, f"{own(0)}\n{more}\n{twice}\nRead more\n}}\nOnce"), (1, f"{own(1)}\nRead  more\n}}\n{script}"), (2, f"{own(2)}\n {twice}\nRead more\n}}\nTwice\n\n"), (3, f"{own(3)}\n{script}\nTwice"), (4, f"{twice}")]
    got = stage_texts(spark, texts)
    assert got == {0: texts[0][1], 1: f"{own(1)}\n}}\n{script}", 2: f"{own(2)}\n}}\nTwice\n\n", 3: f"{own(3)}\nTwice"}


def test_first_document_of_a_template_keeps_its_copy(spark):
    note = lambda k: f"Posted by user{k} on day {k} of the month at noon"
    got = stage_texts(spark, [(k, f"{own(k)}\n{note(k // 2)}") for k in range(6)] + [(6, f"{own(6)}\n{note(0)}")])
    assert got == {0: f"{own(0)}\n{note(0)}"} | {k: own(k) for k in range(1, 7)}


@pytest.mark.parametrize("langs", [["de", "en", "es", "fr"], ["en", "fr"]])
def test_junk_and_unlearned_languages_are_rejected(spark, langs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text is not null")
    docs = docs.filter(docs.lang.isin(langs))
    held = ~lang_kernel.in_training(docs.doc_id)
    model = lang_kernel.fit(docs.filter(~held))
    rng = random.Random(4)
    junk = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(n))
    odd = [junk(20), junk(2000), "Мальчик пошёл с сестрой на рынок, и они купили хлеб, сыр и несколько яблок на ужин.", "今日は学校の図書館で新しい本を読みました。"]
    odd += ["Poika meni sisarensa kanssa torille ja he ostivat leipää, juustoa ja muutaman omenan illallista varten, koska ystävät tulevat tänään heille syömään."]
    assert lang_kernel.keep_known(frame(spark, list(enumerate(odd))), model).count() == 0
    clean = frame(spark, [(0, "the and of the"), (1, "les de la que"), (2, "The boy went to the market with his sister and they bought bread.")])
    assert lang_kernel.keep_known(clean, model).count() == 3
    assert lang_kernel.keep_known(docs.filter(held), model).count() >= 0.98 * docs.filter(held).count()


def test_labeller_reads_a_long_page_whole():
    net = html_blocks.Labeller(html_blocks.PATH_DIM + html_blocks.WORD_DIM + html_blocks.EXTRA)
    pages = [html_blocks.features(html_blocks.leaf_blocks("<main>" + "".join(f"<p>Line {k * k} of it.</p>" for k in range(n)) + "</main>")) for n in (3000, 0, 1, 399, 400, 401, 900)]
    for page, got in zip(pages, net.label(pages), strict=True):
        want = net.forward(page[None], np.ones((1, len(page)), np.float32))[0][0] if len(page) else np.zeros(0)
        assert got.shape == want.shape and np.allclose(got, want, atol=1e-5)
    # the state of the first block is still there behind the first window
    long = np.zeros((1000, pages[0].shape[1]), np.float32)
    net.p["cf"][: net.hidden] = 30
    other = long.copy()
    other[0] = 3
    assert abs(net.label([long])[0][-1] - net.label([other])[0][-1]) > 1e-4


def test_whole_tag_paths():
    deep = "<article class=story>" + "<div>" * 40 + "deep" + "</div>" * 40 + "</article>"
    assert {"article", ".story"} <= set(html_blocks.leaf_blocks(deep)[0].path) and html_blocks.weak_labels(html_blocks.leaf_blocks(deep)).all()
    many = "<div class='" + " ".join(f"c{k}" for k in range(30)) + " comment'>x</div>"
    assert ".comment" in html_blocks.leaf_blocks(many)[0].path
    assert [b.text for b in html_blocks.leaf_blocks("<div title=\"a > " + "b " * 3000 + "\">x</div>")] == ["x"]
    blocks = html_blocks.leaf_blocks("<div class=a>x" * 20_000)
    x = html_blocks.features(blocks)
    assert len(blocks) == 20_000 and len(blocks[-1].path) == 40_000 and np.isfinite(x).all()
    plain = [html_blocks.Block(tuple(b.path), b.text, b.linked) for b in blocks[:50]]
    assert np.allclose(html_blocks.page_features([plain])[0][:, : html_blocks.PATH_DIM], x[:50, : html_blocks.PATH_DIM], atol=1e-4)


def test_failed_read_of_a_model_fails(spark, monkeypatch):
    model = kneser_ney.train(frame(spark, [(0, "a b c a b"), (1, "b c a")]))
    token = np.zeros(2, np.int64)
    kneser_ney._log_probabilities(model, token, token)

    def broken(*_):
        raise OSError("I/O error")

    known = kneser_ney.mapped
    monkeypatch.setattr(kneser_ney, "mapped", lambda root, name, dtype: broken() if name.startswith(("contexts", "pairs")) else known(root, name, dtype))
    with pytest.raises(OSError, match="I/O"):
        kneser_ney._log_probabilities(model, token, token)
    with pytest.raises(FileNotFoundError):
        known(model.root, "contexts-none", np.uint32)
