"""Personal data: base patterns, and what a character-level BiLSTM-CRF finds beside them.

The tagger is trained in numpy on windows of a bounded sample of texts, labelled by the base spans. Whole
texts are cut into overlapping windows, decoded, and put together again: in an overlap the labels of the
window whose edge is farther away hold, and spans that cross from one window into the next become one. What
the tagger finds is added where it touches no base span and has the form of its kind.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import tagger as tg
from cohortlens.llm.common import by_text, documents, drawn, table

KINDS = tg.KINDS
# Texts with and without base spans that the tagger is trained on, at most of each.
TRAIN_TEXTS = 600
TRAIN_CHARS = 20_000
TRAIN_WINDOW = 96
# Training windows, at most.
TRAIN_WINDOWS = 1_500
WINDOW = 512
OVERLAP = 64
# Windows that are decoded together.
TOGETHER = 1_024

# -- base spans --------------------------------------------------------------------------

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ANY_DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Goes by the @ signs, so a long run of characters without one costs nothing."""
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            done = domain.end()
        at = text.find("@", max(done, at + 1))
    return found


def ips(text: str) -> list[tuple[int, int]]:
    """Four parts at a time of each dotted run of numbers."""
    found = []
    for run in DOTTED.finditer(text):
        start, parts = run.start(), run.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                found.append((start, end))
            start = end + 1
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _is_card(text: str) -> bool:
    digits = NOT_DIGIT.sub("", text)
    return 16 <= len(digits) <= 19 and luhn(digits)


def _is_phone(text: str) -> bool:
    return 8 <= len(NOT_DIGIT.sub("", text)) <= 15


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind, leftmost and non-overlapping; matches that fail are dropped."""
    if not ANY_DIGIT.search(text):
        return [emails(text), [], [], []]
    return [
        emails(text),
        ips(text),
        [m.span() for m in CARD.finditer(text) if _is_card(m.group())],
        [m.span() for m in PHONE.finditer(text) if _is_phone(m.group())],
    ]


# -- spans of the tagger -----------------------------------------------------------------

# Forms of spans that the tagger may add: spelled-out signs, other separators, no country code.
AT, DOT = r" ?(?:@|[\[(]at[\])]) ?", r" ?(?:\.|[\[(]dot[\])]) ?"
FORMS = (
    re.compile(rf"[\w.%+-]+{AT}[\w-]+(?:{DOT}[\w-]+)+", re.ASCII),
    re.compile(r"(?:[0-9]{1,3}(?: ?[.:] ?|\[\.\])){3}[0-9]{1,3}"),
    re.compile(r"[0-9](?:[ ./-]{0,2}[0-9]){12,18}"),
    re.compile(r"\+?(?:[0-9]+|\([0-9]+\))(?:[ ./-]{1,2}(?:[0-9]+|\([0-9]+\)))+"),
)


def _has_form(kind: int, text: str) -> bool:
    if not FORMS[kind].fullmatch(text):
        return False
    if kind == 1:
        return all(int(p) <= 255 for p in re.findall("[0-9]+", text))
    digits = NOT_DIGIT.sub("", text)
    if kind == 2:
        return luhn(digits)
    # Dates have up to eight digits.
    return kind == 0 or 9 <= len(digits) <= 15


def altered(kind: int, span: str, rng: np.random.Generator) -> str:
    """A base span as people write it to be read by people alone, or without its usual signs."""
    pick = lambda *ways: ways[int(rng.integers(len(ways)))]
    if kind == 0:
        at, dot = pick((" (at) ", " (dot) "), (" [at] ", " [dot] "), (" @ ", " . "), ("(at)", "."), ("[at]", "."), (" [at] ", "."))
        name, host = span.rsplit("@", 1)
        return f"{name}{at}{host.replace('.', dot)}"
    if kind == 1:
        return span.replace(".", pick(" . ", "[.]", ":", " ."))
    digits = NOT_DIGIT.sub("", span)
    if kind == 2:
        return pick(".", "/", "  ", " - ")[:2].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    first = len(digits) % 3 or 3
    parts = [digits[:first], *(digits[i : i + 3] for i in range(first, len(digits), 3))]
    if len(parts) > 1 and rng.random() < 0.4:
        parts[int(rng.integers(2))] = f"({parts[0]})" if rng.random() < 0.5 else f"({parts[1]})"
    return pick("", "", "+") + pick(" ", "-", ".", "/", " - ")[:2].join(parts)


def window_starts(length: int) -> list[int]:
    """Starts of windows that cover a text, each ``OVERLAP`` before the end of the last one."""
    if length <= 0:
        return []
    return list(range(0, max(1, length - OVERLAP), WINDOW - OVERLAP))


def labelled(tagger: tg.Tagger, texts: list[str]) -> list[np.ndarray]:
    """Labels of all characters of each text, put together from its windows."""
    coded = [tg.classes(t) for t in texts]
    windows = [(i, s) for i, c in enumerate(coded) for s in window_starts(len(c))]
    # Windows of about one length go together.
    windows.sort(key=lambda w: min(WINDOW, len(coded[w[0]]) - w[1]))
    labels = [np.zeros(len(c), np.uint8) for c in coded]
    for at in range(0, len(windows), TOGETHER):
        some = windows[at : at + TOGETHER]
        steps = max(min(WINDOW, len(coded[i]) - s) for i, s in some)
        x = np.full((len(some), steps), tg.PAD, np.uint8)
        for row, (i, s) in zip(x, some, strict=True):
            part = coded[i][s : s + steps]
            row[: len(part)] = part
        best = tagger.decode(np.ascontiguousarray(x.T))
        if not best.any():
            continue
        for column, (i, s) in enumerate(some):
            found = best[:, column]
            if not found.any():
                continue
            # Half of each overlap goes to either window.
            low = s + (OVERLAP // 2 if s else 0)
            last = s + WINDOW >= len(coded[i])
            high = len(coded[i]) if last else s + WINDOW - OVERLAP // 2
            labels[i][low:high] = found[low - s : high - s]
    return labels


def added_spans(
    text: str, labels: np.ndarray, base: list[list[tuple[int, int]]]
) -> list[list[tuple[int, int]]]:
    """Runs of one label that have the form of their kind and touch no base span.

    An address is followed to the end of its form.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in KINDS]
    if not labels.any():
        return out
    taken = np.zeros(len(text), bool)
    for spans in base:
        for start, end in spans:
            taken[start:end] = True
    cuts = np.flatnonzero(np.diff(labels)) + 1
    edges = [0, *cuts.tolist(), len(labels)]
    for start, end in zip(edges, edges[1:], strict=False):
        kind = int(labels[start]) - 1
        if kind < 0:
            continue
        part = text[start:end]
        end -= len(part) - len(part.rstrip(" .,;:-("))
        start += len(part) - len(part.lstrip(" .,;:-)"))
        if kind == 0 and (whole := FORMS[0].match(text, start)) is not None:
            end = max(end, whole.end())  # a last part that the tagger left off
        beside = (start > 0 and text[start - 1].isalnum()) or (
            end < len(text) and text[end].isalnum()
        )
        if start < end and not beside and not taken[start:end].any():
            if _has_form(kind, text[start:end]):
                out[kind].append((start, end))
    return out


# -- training ----------------------------------------------------------------------------


def training_windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Windows around base spans, each as it stands and altered, and half as many others, all labelled.

    What is used is drawn at random from all windows, so no kind and no part of the texts comes first.
    """
    rng = np.random.default_rng(11)
    hits: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in KINDS]
    misses = []

    def window(text: str, base: list[list[tuple[int, int]]], around: int | None):
        coded, marks = tg.classes(text), np.zeros(len(text), np.int64)
        for kind, spans in enumerate(base, 1):
            for start, end in spans:
                marks[start:end] = kind
        short = max(0, TRAIN_WINDOW - len(coded))
        coded, marks = np.pad(coded, (0, short), constant_values=tg.PAD), np.pad(marks, (0, short))
        room = len(coded) - TRAIN_WINDOW
        low = int(rng.integers(0, room + 1))
        if around is not None:
            low = int(np.clip(around - rng.integers(4, TRAIN_WINDOW - 4), 0, room))
        return coded[low : low + TRAIN_WINDOW], marks[low : low + TRAIN_WINDOW]

    for text in texts:
        base = base_spans(text)
        for kind, spans in enumerate(base):
            for start, end in spans:
                hits[kind].append(window(text, base, start))
                # The text around the span alone, so that no other span is out of place.
                other = altered(kind, text[start:end], rng)
                before, after = text[max(0, start - TRAIN_WINDOW) : start], text[end : end + TRAIN_WINDOW]
                if not any(map(any, (base_spans(before), base_spans(after)))):
                    place = [[] for _ in KINDS]
                    place[kind].append((len(before), len(before) + len(other)))
                    hits[kind].append(window(before + other + after, place, len(before)))
        misses.append(window(text, base, None))
    each = max(1, 2 * TRAIN_WINDOWS // 3 // len(KINDS))
    some = [found[i] for found in hits for i in rng.permutation(len(found))[:each]]
    if not some:
        return np.zeros((0, TRAIN_WINDOW), np.uint8), np.zeros((0, TRAIN_WINDOW), np.int64)
    some += [misses[i] for i in rng.permutation(len(misses))[: max(1, len(some) // 2)]]
    return np.array([x for x, _ in some]), np.array([y for _, y in some])


def trained(docs: DataFrame) -> tg.Tagger:
    """Train on at most ``TRAIN_TEXTS`` texts with a digit or an @ and as many others, chosen by hash.

    Texts of more than ``TRAIN_CHARS`` characters are not trained on; what is tagged later is all texts.
    """
    rows = documents(docs).where(F.length("text").between(1, TRAIN_CHARS)).select("text")
    sample = drawn(rows, TRAIN_TEXTS, "text", by="text RLIKE '[0-9@]'").collect()
    # In an order of their own, as rows of equal hashes are not told apart.
    texts = sorted((r.text for r in sample), key=lambda t: (not ANY_DIGIT.search(t), t))
    return tg.train(*training_windows(texts))


# -- Spark -------------------------------------------------------------------------------


def _listed(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(
        f"{kind}:{start}:{end}"
        for kind, found in zip(KINDS, spans, strict=True)
        for start, end in sorted(found)
    )


def tagged(docs: DataFrame, tagger: tg.Tagger) -> DataFrame:
    """Base spans and all spans of each whole text, as ``kind:start:end`` in code points."""

    def work(texts: list[str]) -> list:
        labels = labelled(tagger, texts)
        counts: list[list[int]] = [[] for _ in KINDS]
        base_shas, spans, added = [], [], []
        for text, marks in zip(texts, labels, strict=True):
            base = base_spans(text)
            more = added_spans(text, marks, base)
            for kind, found in zip(counts, base, strict=True):
                kind.append(len(found))
            base_shas.append(hashlib.sha256(_listed(base).encode()).hexdigest())
            spans.append(_listed([a + b for a, b in zip(base, more, strict=True)]))
            added.append(sum(map(len, more)))
        return [
            *(pa.array(c, pa.int64()) for c in counts),
            pa.array(base_shas),
            pa.array(spans),
            pa.array(added, pa.int64()),
        ]

    return by_text(
        documents(docs),
        work,
        "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, "
        "spans string, n_added bigint",
    )


def personal_data(docs: DataFrame) -> DataFrame:
    """Personal data of every whole text: numbers of base spans, their digest, and all spans.

    Null texts count as empty and have no spans. Rows are tagged one by one; repeated rows get
    equal results, null ids and other columns change nothing. A table without base spans gives
    a tagger that adds none; an empty table gives no rows.
    """
    return tagged(docs, trained(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
