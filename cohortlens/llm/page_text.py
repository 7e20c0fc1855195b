"""Main text of web pages: blocks in page order, labelled by a bidirectional LSTM.

A page is read as its leaf blocks, the texts between tags that begin or end a block, each with the path of
open elements around it. The labeller sees the path's parts (tags, words of class, id and role), all words of
the block, and a few plain numbers, and labels each block with the whole page in view. Blocks that it takes
for main text are joined. It learns from pages that are put together at random from texts of a bounded
sample of the table, with the parts that pages have; there the label of each block is known.
"""

from __future__ import annotations

import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.block_labeller import BATCH, PATHS, WORDS, Blocks, Labeller, Page, train
from cohortlens.llm.common import by_text, drawn, ship_code, table

# Pages whose texts the training pages are made of, at most, and the longest that are drawn.
SAMPLE_PAGES = 200
SAMPLE_CHARS = 100_000
TRAIN_PAGES = 1_600
SEED = 23

# Elements of HTML by what they do to a text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("head title script style noscript template svg iframe object select textarea datalist".split())
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption"
    " figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre"
    " section summary table tbody td tfoot th thead tr ul".split()
)
# A start tag ends open elements of these kinds, up to the next container.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^\W\d_]+")


class Leaves(HTMLParser):
    """Collects the blocks of a page: path parts, text, words in links."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[tuple[str, ...], str, int]] = []
        self._open: list[tuple[str, tuple[str, ...]]] = []
        self._hidden = 0
        self._links = 0
        self._text: list[str] = []
        self._path: tuple[str, ...] = ()
        self._linked = 0

    @classmethod
    def of(cls, page: str) -> list[tuple[tuple[str, ...], str, int]]:
        leaves = cls()
        leaves.feed(page)
        leaves.close()
        leaves._flush()
        return leaves.blocks

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            self.blocks.append((self._path, text, self._linked))
        self._text, self._linked = [], 0

    def _pop(self, upto: int) -> None:
        for tag, _ in self._open[upto:]:
            self._hidden -= tag in HIDDEN
            self._links -= tag == "a"
        del self._open[upto:]

    def _end(self, tags: set[str], stop: set[str]) -> None:
        """Close the open elements of these kinds that are inside the innermost container."""
        last = None
        for at in range(len(self._open) - 1, -1, -1):
            if self._open[at][0] in stop:
                break
            if self._open[at][0] in tags:
                last = at
        if last is not None:
            self._pop(last)

    def handle_starttag(self, tag, attrs) -> None:
        if tag in VOID:
            if tag == "br" and not self._hidden:
                self._text.append(" ")
            elif tag == "hr":
                self._flush()
            return
        if tag == "body":
            self._pop(next((i for i, (t, _) in enumerate(self._open) if t == "head"), len(self._open)))
        if tag in BLOCK:
            self._flush()
            self._end({"p"}, {"td", "th", "li", "table", "button", "article", "section", "div", "blockquote"})
            if tag in ENDS:
                self._end(*ENDS[tag])
        self._hidden += tag in HIDDEN
        self._links += tag == "a"
        self._open.append((tag, _parts(tag, attrs)))

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)  # a slash ends void elements only

    def handle_endtag(self, tag) -> None:
        if tag in BLOCK:
            self._flush()
        for at in range(len(self._open) - 1, -1, -1):
            if self._open[at][0] == tag:
                self._pop(at)
                return

    def handle_data(self, data) -> None:
        if self._hidden:
            return
        if not self._path_known():
            if not data.strip():
                return
            self._path = tuple(part for _, parts in self._open for part in parts)
        self._text.append(data)
        if self._links:
            self._linked += len(data.split())

    def _path_known(self) -> bool:
        return any(t.strip() for t in self._text)


def _parts(tag: str, attrs) -> tuple[str, ...]:
    """The tag, and the words of its names."""
    if tag not in BLOCK:
        return ()
    parts = [f"<{tag}"]
    for name, value in attrs:
        if name in ("class", "id", "role", "itemprop") and value:
            parts += [word.lower() for word in NAME.findall(value)]
        elif name == "hidden" or name == "style" and value and "none" in value.replace(" ", "").split("display:")[-1][:4]:
            parts.append("hidden")
    return tuple(parts)


_path_buckets: dict[str, int] = {}
_word_buckets: dict[str, int] = {}


def _bucket(part: str, size: int, known: dict[str, int]) -> int:
    found = known.get(part)
    if found is None:
        if len(known) > 200_000:
            known.clear()
        found = known[part] = zlib.crc32(part.encode("utf-8", "surrogatepass")) % size
    return found


def described(blocks: list[tuple[tuple[str, ...], str, int]]) -> list[tuple[list[int], list[int], list[float]]]:
    """What the labeller reads of each block of a page."""
    out = []
    for i, (path, text, linked) in enumerate(blocks):
        words = text.split()
        # The innermost element counts twice, as itself and as a part of the path.
        leaf = next((p for p in reversed(path) if p[0] == "<"), "<")
        parts = [_bucket(p, PATHS, _path_buckets) for p in (*path, f"leaf{leaf}")]
        low = [_bucket(w, WORDS, _word_buckets) for w in text.lower().split()]
        plain = [
            min(np.log1p(len(words)) / 4, 2.0), linked / len(words), float(text[-1] in ".!?…:;"),
            float(leaf[1:] in HEADINGS), i / len(blocks), min(len(blocks) / 50, 2.0),
        ]
        out.append((parts, low or [0], plain))
    return out


def trained(texts: list[str]) -> Labeller:
    """A labeller that has learned from random pages of these texts; the same on each run."""
    rng = np.random.default_rng(SEED)
    pages, labels = [], []
    for _ in range(TRAIN_PAGES):
        page = Page(rng, texts)
        blocks = Leaves.of("".join(page.html))
        if len(blocks) == len(page.labels):
            pages.append(described(blocks))
            labels.append(page.labels)
    return train(pages, labels).single()


def sample_texts(pages: DataFrame) -> list[str]:
    """Texts of the blocks of at most ``SAMPLE_PAGES`` pages, the same on each run."""
    rows = pages.select("page_id", F.col("html").alias("text"))
    few = drawn(rows.where((F.length("text") > 0) & (F.length("text") <= SAMPLE_CHARS)), SAMPLE_PAGES, "page_id", "text")

    def work(texts: list[str]) -> list:
        return [pa.array([[t for _, t, _ in Leaves.of(page)] for page in texts], pa.list_(pa.string()))]

    found = by_text(few, work, "blocks array<string>", keep=("page_id",)).collect()
    texts = sorted({t for row in found for t in row.blocks})
    return texts or ["some text of a page that has no other words"]


def main_text(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """``page_id``, ``url`` and ``text``: the blocks of main text in page order, one a line.

    Character references are decoded, white space inside a block becomes one blank. Null and empty pages, and
    pages without main text, give the empty string. Broken markup never fails: elements that are
    not closed end with the page. Repeated rows and null ids are each worked on by themselves, pages of any length
    whole. Columns with other names are not looked at. An empty table gives no rows.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("text"),
    )
    ship_code(pages.sparkSession)

    def work(texts: list[str]) -> list:
        blocks = [Leaves.of(page) for page in texts]
        order = sorted(range(len(texts)), key=lambda i: len(blocks[i]))
        out = [""] * len(texts)
        for start in range(0, len(order), BATCH):
            group = order[start : start + BATCH]
            labels = labeller.label(Blocks.of([described(blocks[i]) for i in group]))
            for i, keep in zip(group, labels, strict=True):
                out[i] = "\n".join(text for (_, text, _), yes in zip(blocks[i], keep, strict=True) if yes)
        return [pa.array(out, pa.string())]

    return by_text(rows, work, "text string", keep=("page_id", "url"))


def extracted(pages: DataFrame) -> DataFrame:
    """``main_text`` by a labeller that is trained on texts of the table."""
    ship_code(pages.sparkSession)
    return main_text(pages, trained(sample_texts(pages)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extracted(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
