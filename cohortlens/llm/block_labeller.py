"""A bidirectional LSTM in numpy that labels each block of a page, and the pages that it learns from.

A block is read as the mean vector of its hashed path parts, the mean vector of its hashed words, and a few
plain numbers. Both directions run over all blocks of the page, so each label depends on the whole page.
"""

from __future__ import annotations

import html
from dataclasses import dataclass, fields

import numpy as np

PATHS, WORDS = 1024, 1024  # hashed vectors of path parts, and of words
PATH_SIZE, WORD_SIZE, PLAIN = 16, 6, 6
HIDDEN = 12
# Pages that go through the network together.
BATCH = 32


@dataclass
class Blocks:
    """Pages as padded sequences: indexes of path parts and words of all blocks in a row, and plain numbers."""

    paths: np.ndarray
    path_ends: np.ndarray
    words: np.ndarray
    word_ends: np.ndarray
    plain: np.ndarray  # block, PLAIN
    lengths: np.ndarray  # blocks of each page

    @classmethod
    def of(cls, pages: list[list[tuple[list[int], list[int], list[float]]]]) -> Blocks:
        """From pages of blocks: buckets of path parts, buckets of words, plain numbers."""
        every = [block for page in pages for block in page]

        def flat(lists):
            lengths = np.fromiter(map(len, lists), np.int64, len(lists))
            values = np.fromiter((v for one in lists for v in one), np.int64, int(lengths.sum()))
            return values, np.cumsum(lengths)

        paths, path_ends = flat([b[0] for b in every])
        words, word_ends = flat([b[1] for b in every])
        plain = np.array([b[2] for b in every], np.float32).reshape(-1, PLAIN)
        return cls(paths, path_ends, words, word_ends, plain, np.array([len(p) for p in pages], np.int64))


def _means(table: np.ndarray, index: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mean row of ``table`` for each run of ``index``; runs are never empty."""
    starts = np.concatenate([[0], ends[:-1]])
    return np.add.reduceat(table[index], starts, axis=0) / (ends - starts)[:, None].astype(table.dtype)


def _spread(shape, index: np.ndarray, ends: np.ndarray, gradient: np.ndarray) -> np.ndarray:
    """Gradient by the table's rows, given that by the means."""
    sizes = np.diff(ends, prepend=0)
    out = np.zeros(shape)
    np.add.at(out, index, np.repeat(gradient / sizes[:, None], sizes, axis=0))
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


@dataclass
class Labeller:
    """Weights. Gates are in the order input, forget, output, candidate; [0] reads on, [1] reads back."""

    paths: np.ndarray
    words: np.ndarray
    inputs: np.ndarray
    states: np.ndarray
    bias: np.ndarray
    out: np.ndarray  # 2, HIDDEN
    base: np.ndarray

    @classmethod
    def drawn(cls, seed: int) -> Labeller:
        rng = np.random.default_rng(seed)
        size = PATH_SIZE + WORD_SIZE + PLAIN
        draw = lambda scale, *shape: rng.normal(0, scale, shape)
        bias = np.zeros((2, 1, 1, 4 * HIDDEN))
        bias[..., HIDDEN : 2 * HIDDEN] = 1.0
        return cls(
            draw(0.5, PATHS, PATH_SIZE), draw(0.1, WORDS, WORD_SIZE),
            draw(size**-0.5, 2, 1, size, 4 * HIDDEN), draw(HIDDEN**-0.5, 2, HIDDEN, 4 * HIDDEN), bias,
            draw(0.3, 2, HIDDEN), np.zeros(1),
        )

    def weights(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def single(self) -> Labeller:
        """The same in single precision, to label with."""
        return Labeller(*(w.astype(np.float32) for w in self.weights()))

    def _run(self, blocks: Blocks):
        """Logits (page, place), and what the way back needs."""
        x = np.concatenate(
            [_means(self.paths, blocks.paths, blocks.path_ends), _means(self.words, blocks.words, blocks.word_ends),
             blocks.plain.astype(self.paths.dtype)], axis=1,
        )
        pages, steps = len(blocks.lengths), int(blocks.lengths.max())
        place = np.arange(steps)
        real = place < blocks.lengths[:, None]
        padded = np.zeros((pages, steps, x.shape[1]), x.dtype)
        padded[real] = x
        # The place that the way back reads at each step; padding comes last in both directions.
        turned = np.where(real, blocks.lengths[:, None] - 1 - place, place)
        rows = np.arange(pages)[:, None]
        both = np.stack([padded, padded[rows, turned]])
        z = both @ self.inputs + self.bias
        h = np.zeros((steps + 1, 2, pages, HIDDEN), x.dtype)
        c = np.zeros_like(h)
        gates = np.empty((steps, 2, pages, 4 * HIDDEN), x.dtype)
        for t in range(steps):
            g = gates[t]
            np.matmul(h[t], self.states, out=g)
            g += z[:, :, t]
            g[..., : 3 * HIDDEN] = _sigmoid(g[..., : 3 * HIDDEN])
            g[..., 3 * HIDDEN :] = np.tanh(g[..., 3 * HIDDEN :])
            i, f, o, new = (g[..., k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
            c[t + 1] = f * c[t] + i * new
            h[t + 1] = o * np.tanh(c[t + 1])
        scores = np.einsum("tkph,kh->kpt", h[1:], self.out)
        logits = scores[0] + scores[1][rows, turned] + self.base
        return logits, (both, h, c, gates, real, turned, rows)

    def label(self, blocks: Blocks) -> list[np.ndarray]:
        """Per page whether each block is main text."""
        if not blocks.lengths.sum():
            return [np.zeros(0, bool) for _ in blocks.lengths]
        logits, _ = self._run(blocks)
        return [row[:n] > 0 for row, n in zip(logits, blocks.lengths, strict=True)]

    def gradients(self, blocks: Blocks, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss of all blocks, and its gradients by all weights, going back through the steps."""
        logits, (both, h, c, gates, real, turned, rows) = self._run(blocks)
        p = _sigmoid(logits[real])
        loss = -np.log(np.where(labels, p, 1 - p) + 1e-12).mean()
        d_logits = np.zeros_like(logits)
        d_logits[real] = (p - labels) / len(labels)
        d_scores = np.stack([d_logits, d_logits[rows, turned]])
        d_out = np.einsum("kpt,tkph->kh", d_scores, h[1:])
        d_states, d_z = np.zeros_like(self.states), np.empty_like(gates)
        d_h, d_c = np.zeros_like(h[0]), np.zeros_like(h[0])
        for t in range(len(gates) - 1, -1, -1):
            d_h += d_scores[:, :, t, None] * self.out[:, None]
            i, f, o, new = (gates[t][..., k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
            tanh = np.tanh(c[t + 1])
            d_c += d_h * o * (1 - tanh**2)
            d_z[t] = np.concatenate(
                [d_c * new * i * (1 - i), d_c * c[t] * f * (1 - f), d_h * tanh * o * (1 - o), d_c * i * (1 - new**2)],
                axis=2,
            )
            d_states += h[t].transpose(0, 2, 1) @ d_z[t]
            d_h = d_z[t] @ self.states.transpose(0, 2, 1)
            d_c = d_c * f
        d_z = d_z.transpose(1, 2, 0, 3)
        d_inputs = np.einsum("kptx,kptz->kxz", both, d_z)[:, None]
        d_both = d_z @ self.inputs.transpose(0, 1, 3, 2)
        d_x = (d_both[0] + d_both[1][rows, turned])[real]
        d_paths = _spread(self.paths.shape, blocks.paths, blocks.path_ends, d_x[:, :PATH_SIZE])
        d_words = _spread(
            self.words.shape, blocks.words, blocks.word_ends, d_x[:, PATH_SIZE : PATH_SIZE + WORD_SIZE]
        )
        d_bias = d_z.sum((1, 2))[:, None, None]
        return loss, [d_paths, d_words, d_inputs, d_states, d_bias, d_out, d_logits.sum(keepdims=True).ravel()]


def train(pages: list[list], labels: list[list[int]], epochs: int = 10, rate: float = 0.02, seed: int = 11) -> Labeller:
    """Fit to pages of blocks and the label of each block, with Adam; the same on each run."""
    labeller, rng = Labeller.drawn(seed), np.random.default_rng(seed)
    first, second = ([np.zeros_like(w) for w in labeller.weights()] for _ in range(2))
    known = [i for i, page in enumerate(pages) if page]
    turn, turns = 0, epochs * -(-len(known) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(known)
        for start in range(0, len(order), BATCH):
            rows = order[start : start + BATCH]
            truth = np.concatenate([np.array(labels[i], float) for i in rows])
            _, found = labeller.gradients(Blocks.of([pages[i] for i in rows]), truth)
            norm = np.sqrt(sum((g**2).sum() for g in found))
            step = rate * (1 - turn / turns)
            turn += 1
            for w, g, m, v in zip(labeller.weights(), found, first, second, strict=True):
                g = g * min(1.0, 1.0 / (norm + 1e-12))
                m += 0.1 * (g - m)
                v += 0.01 * (g**2 - v)
                w -= step * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return labeller


# -- pages to learn from -----------------------------------------------------------------

# Names that pages give to their parts, as a choice of classes and ids; parts of names are read by themselves.
CONTENT = (
    "content article post entry story main body text page single blog article-body post-content entry-content"
    " articleBody main-content content-body story-text prose markdown rich-text article__text hentry post-body"
    " mainContent page-content news-item read"
).split()
PARTS = {
    "nav": "nav menu navbar topnav navigation main-menu site-nav breadcrumb breadcrumbs tabs toolbar pagination pager"
    " links skip-links toc categories nav-list menu-item".split(),
    "header": "header masthead site-header top-bar banner branding logo page-header topbar site-title tagline".split(),
    "footer": "footer site-footer bottom foot copyright colophon legal page-footer credits footer-links imprint".split(),
    "aside": "sidebar side aside widget widget-area rail right-col secondary related recommended popular trending tags"
    " archive more-stories teaser see-also share social sharing share-buttons follow author-box related-posts".split(),
    "notice": "notice cookie cookie-banner cookie-consent consent gdpr alert alert-info message disclaimer popup modal"
    " overlay announcement paywall cookie-notice site-notice flash privacy-notice".split(),
    "ad": "ad ads advert advertisement ad-slot ad-container sponsored sponsor promo promotion adsense banner-ad dfp"
    " outbrain taboola commercial ad-unit advertising".split(),
    "form": "form search search-form login newsletter subscribe signup contact-form search-box registration".split(),
    "comments": "comments comment comment-list commentlist replies reply responses discussion disqus_thread respond"
    " user-comments reader-comments comment-body comment-text feedback guestbook".split(),
}
PHRASES = {
    "nav": "Home|About|About us|Contact|News|Sport|Login|Next|Previous|More|Archive|Start|Accueil|Inicio|Über uns".split("|"),
    "header": "Welcome|Our site|The daily news|Skip to content|Search|Magazin".split("|"),
    "footer": "© 2024 All rights reserved.|Privacy policy|Terms of use|Impressum|Powered by|Contact us|Sitemap".split("|"),
    "aside": "Related articles|Most read|Share this|Follow us|Tags|You may also like|Recent posts|Popular".split("|"),
    "notice": "We use cookies to improve this site.|Accept|By continuing you agree to our privacy policy.|"
    "Please enable JavaScript.|Diese Seite verwendet Cookies.|Subscribe to read on.".split("|"),
    "ad": "Advertisement|Sponsored|Buy now|Special offer: save 50 % today!|Anzeige|Publicité|Shop now".split("|"),
    "form": "Search|Your name|E-mail|Send|Subscribe to our newsletter|Submit|Password|Leave a reply".split("|"),
    "comments": "Comments|3 comments|Reply|Leave a comment|Great article, thanks!|I don't agree.|Kommentare|posted on 3 May".split("|"),
}


class Page:
    """A page that is put together at random, with a label for each block in it."""

    def __init__(self, rng: np.random.Generator, texts: list[str]) -> None:
        self.rng, self.texts = rng, texts
        self.html: list[str] = []
        self.labels: list[int] = []
        self._make()

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def pick(self, values):
        return values[int(self.rng.integers(len(values)))]

    def text(self) -> str:
        words = self.pick(self.texts).split()
        n = int(self.pick([1, 2, 5, 12, 30, 80]))
        start = int(self.rng.integers(max(1, len(words) - n)))
        return " ".join(words[start : start + n])

    def block(self, tag: str, text: str, label: int, inner: str = "{}") -> None:
        closing = "" if tag in ("p", "li") and self.chance(0.2) else f"</{tag}>"
        self.html.append(f"<{tag}>{inner.format(html.escape(text))}{closing}")
        self.labels.append(label)

    def named(self, names: list[str]) -> str:
        """Attributes: a class, an id, both, with further names, or none."""
        name, more = self.pick(names), self.pick(["", "", " clearfix", " col-md-8", " container", " box"])
        return self.pick([f' class="{name}{more}"', f' class="{name}{more}"', f' id="{name}"', f' id="{name}" class="x{more}"'])

    def part(self, kind: str) -> None:
        """Something that isn't main text."""
        own = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        tag = own if own and self.chance(0.5) else self.pick(["div", "div", "section", "ul" if kind == "nav" else "div"])
        bare = tag == own and self.chance(0.5)
        self.html.append(f"<{tag}{'' if bare else self.named(PARTS[kind])}>")
        if kind == "nav":
            listed = tag == "ul" or self.chance(0.7)
            self.html.append("<ul>" if listed and tag != "ul" else "")
            for _ in range(int(self.rng.integers(2, 10))):
                words = self.pick(PHRASES[kind]) if self.chance(0.4) else " ".join(self.text().split()[: self.pick([1, 1, 3])])
                self.block("li" if listed else "div", words, 0, '<a href="/x">{}</a>')
            self.html.append("</ul>" if listed and tag != "ul" else "")
        else:
            most = 7 if kind == "comments" else 4
            for _ in range(int(self.rng.integers(1, most))):
                words = self.pick(PHRASES[kind]) if self.chance(0.45) else self.text()
                inner = '<a href="/x">{}</a>' if kind in ("aside", "footer") and self.chance(0.4) else "{}"
                shape = self.pick(["p", "p", "div", "h3", "li", "own"])
                if kind == "comments" and self.chance(0.4):
                    wrap = self.pick(["div", "article", "li"])
                    self.html.append(f"<{wrap}{self.named(PARTS[kind])}>")
                    self.block("p", words, 0, inner)
                    self.html.append(f"</{wrap}>")
                elif shape == "own":
                    self.html.append(f"<div>{inner.format(html.escape(words))}</div>")
                    self.labels.append(0)
                elif kind == "form" and self.chance(0.5):
                    self.block("label", words, 0, "<div>{}</div><input name=q>")
                else:
                    self.block(shape, words, 0, inner)
        self.html.append(f"</{tag}>")

    def body(self) -> None:
        if self.chance(0.85):
            header = self.chance(0.15)
            self.html.append("<header>" if header else "")
            self.block("h1", " ".join(self.text().split()[:12]), 1)
            self.html.append("</header>" if header else "")
        for _ in range(int(self.rng.integers(1, 14))):
            shape = self.pick(["p"] * 9 + ["h2", "blockquote", "div", "list", "pre", "td"])
            inner = self.pick(["{}"] * 6 + ["<b>{}</b>", "<b>{}<br>", "<em>{}</em> ", "<span>{}</span>", '<a href="/x">{}</a>'])
            if shape == "list":
                self.html.append("<ul>")
                for _ in range(int(self.rng.integers(1, 5))):
                    self.block("li", self.text(), 1, inner)
                self.html.append("</ul>")
            elif shape == "td":
                self.html.append("<table><tr>")
                self.block("td", self.text(), 1)
                self.html.append("</tr></table>")
            elif shape == "h2":
                self.block("h2", " ".join(self.text().split()[:8]), 1)
            else:
                self.block(shape, self.text(), 1, inner)
            if self.chance(0.04):
                self.part(self.pick(["ad", "aside", "form", "notice"]))

    def _make(self) -> None:
        self.html.append("<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>")
        outer = [f"<div{self.named(['wrapper', 'container', 'site', 'root', 'app', 'layout', 'page'])}>" for _ in range(int(self.rng.integers(3)))]
        self.html += outer
        for kind, p in (("notice", 0.25), ("header", 0.5), ("nav", 0.8), ("ad", 0.5), ("form", 0.2), ("aside", 0.25)):
            if self.chance(p):
                self.part(kind)
        tag = self.pick(["article"] * 4 + ["main", "div", "div", "div", "section", "td"])
        bare = tag in ("article", "main") and self.chance(0.6) or self.chance(0.08)
        wrap = self.chance(0.3)
        self.html.append("<main>" if wrap else "")
        self.html.append("<table><tr>" if tag == "td" else "")
        self.html.append(f"<{tag}{'' if bare else self.named(CONTENT)}>")
        inside = self.chance(0.25)
        if inside:
            self.html.append(f"<div{self.named(CONTENT)}>")
        self.body()
        self.html.append("</div>" if inside else "")
        if self.chance(0.15):
            self.part(self.pick(["comments", "aside", "form"]))
        self.html.append(f"</{tag}>" + ("</tr></table>" if tag == "td" else "") + ("</main>" if wrap else ""))
        for kind, p in (("comments", 0.4), ("aside", 0.35), ("form", 0.2), ("ad", 0.2), ("notice", 0.1), ("footer", 0.8)):
            if self.chance(p):
                self.part(kind)
        self.html.append("</div>" * len(outer) + ("</body></html>" if self.chance(0.9) else ""))
