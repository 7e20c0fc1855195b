import html
import re

import numpy as np
import pytest

from cohortlens.llm import page_text as pt
from cohortlens.llm.block_labeller import BATCH, Blocks, Labeller, Page
from tests.llm.conftest import listed


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return pt.sample_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@pytest.fixture(scope="module")
def labeller(texts):
    return pt.trained(texts)


def article(page):
    """Main text of the given pages, which all have it in one article of headings and paragraphs."""
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    parts = (re.sub("<[^>]*>", "", p.replace("<br>", " ")) for p in re.split("</?(?:p|h1)>", inner))
    blocks = (" ".join(html.unescape(p).split()) for p in parts)
    return "\n".join(b for b in blocks if b)


def test_given_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = pt.query(spark, sf_dir)
    assert [(n, t) for n, t in found.dtypes] == [
        ("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")
    ]
    rows = {r.page_id: r for r in found.collect()}
    expected = {r.page_id: article(r.html) for r in pages.collect()}
    assert rows.keys() == expected.keys()
    assert sum(rows[i].text == text for i, text in expected.items()) >= 0.98 * len(expected)
    assert all(r.n_chars == len(r.text) for r in rows.values())


def test_pages_of_other_seeds(labeller, texts):
    """Held-out random pages: precision and recall of blocks."""
    rng, right, wrong, missed = np.random.default_rng(1234), 0, 0, 0
    for _ in range(200):
        page = Page(rng, texts)
        blocks = pt.Leaves.of("".join(page.html))
        assert len(blocks) == len(page.labels)
        kept, truth = labeller.label(Blocks.of([pt.described(blocks)]))[0], np.array(page.labels, bool)
        right, wrong, missed = right + (kept & truth).sum(), wrong + (kept & ~truth).sum(), missed + (~kept & truth).sum()
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97


PAGE = """<html><head><title>No</title></head><body><div id="top"><a href=/>Site</a></div>
<div class="menu"><a href=a>One</a><a href=b>Two</a></div><div class="cookie-notice">We use cookies <button>OK</button></div>
<div class="post"><h1>Headline  here</h1><div class="entry"><p>First paragraph of the story, quite long &eacute; full of
words.<p>Second<br>paragraph &amp; more.<div class="ad-box">Buy our things now!</div><p>Third <b>para</b>graph ends it.</div></div>
<form><label>Newsletter</label><input><textarea>type</textarea></form><script>var p = "<p>no</p>";</script>
<div id="comments"><h3>2 comments</h3><div class="comment"><p>I disagree with this long article, and tell you why.</p></div></div>
<aside>Related: other story</aside><footer>&copy; 2020 Site</footer></body></html>"""


def test_a_page_without_semantic_tags(spark, labeller):
    frame = spark.createDataFrame([(1, "u", PAGE)], "page_id long, url string, html string")
    assert pt.main_text(frame, labeller).first().text.split("\n") == [
        "Headline here", "First paragraph of the story, quite long é full of words.", "Second paragraph & more.",
        "Third paragraph ends it.",
    ]


def test_odd_pages(spark, labeller):
    ddl = "page_id long, url string, html string, text string, row string, n_chars int"
    long = "<article>" + "<p>A paragraph of a very long page.</p>" * 6000
    pages = [
        (1, "u", None), (2, None, ""), (None, "u", "<p>Some words of a page."), (3, "u", "<div></p></td><<<&#x;<p"),
        (4, "u", "no markup at all, only words."), (5, "u", long), (5, "u", long), (6, "u", "<nav><a>Home</a></nav>"),
        (7, "u", "<article><p>one two &lt;b&gt; &am</p></article>"),
    ]
    frame = spark.createDataFrame([(*p, "t", "r", 1) for p in pages], ddl)
    found = listed(pt.main_text(frame, labeller), "page_id", "url", "text")
    assert len(found) == 9
    by_id = {i: t for i, _, t in found}
    assert by_id[1] == by_id[2] == by_id[6] == ""
    assert by_id[5].count("\n") == 5999 and by_id[7] == "one two <b> &am"
    assert listed(pt.extracted(frame.where("page_id = 1")), "page_id", "text") == [(1, "")]
    assert pt.extracted(frame.where("page_id = 99")).count() == 0


def test_blocks_and_paths():
    blocks = pt.Leaves.of('<ul class="mainMenu x1"><li><a>One two</a><li>Three</ul><td>a<td>b<p>c<div>d</div>e')
    assert [(text, linked) for _, text, linked in blocks] == [
        ("One two", 2), ("Three", 0), ("a", 0), ("b", 0), ("c", 0), ("d", 0), ("e", 0)
    ]
    assert blocks[0][0] == ("<ul", "main", "menu", "x", "1", "<li") == blocks[1][0]


def test_labels_do_not_depend_on_the_batch(labeller, texts):
    rng = np.random.default_rng(7)
    pages = [pt.described(pt.Leaves.of("".join(Page(rng, texts).html))) for _ in range(BATCH)] + [[]]
    together = labeller.label(Blocks.of(pages))
    for page, kept in zip(pages, together, strict=True):
        assert (labeller.label(Blocks.of([page]))[0] == kept).all()


def test_gradients(texts):
    """Against differences of the loss, for some weights of each kind."""
    rng = np.random.default_rng(2)
    pages = [pt.described(pt.Leaves.of("".join(Page(rng, texts).html))) for _ in range(3)]
    blocks = Blocks.of(pages)
    truth = rng.integers(0, 2, sum(map(len, pages))).astype(float)
    labeller = Labeller.drawn(1)
    _, found = labeller.gradients(blocks, truth)
    for weights, gradient in zip(labeller.weights(), found, strict=True):
        for at in np.argsort(-np.abs(gradient).ravel())[:3]:
            place, losses = np.unravel_index(at, weights.shape), []
            for step in (1e-5, -2e-5):
                weights[place] += step
                losses.append(labeller.gradients(blocks, truth)[0])
            weights[place] += 1e-5
            assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(gradient[place], rel=1e-3, abs=1e-8)
