"""Toxicity scores from gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of a fixed lexicon and of learned stems, how near its hits stand to a
second person, rates of capitals, of punctuation and of obfuscated words. The stems, the trees and the
calibration come from a sample of labelled rows of at most ``TRAIN_ROWS``; all texts are then scored.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import by_text, documents, drawn, staged, table, text_hash

# Labelled rows that the stems, the trees and the calibration are fitted on, at most.
TRAIN_ROWS = 20_000
# Learned stems: beginnings of words of these lengths that are in at least this share of the toxic
# sample and this many of its texts, and this much more often than in the rest. There are at most
# 1 / STEM_SHARE times as many as a toxic text of the sample has on average.
STEMS = (4, 5, 6)
STEM_SHARE, STEM_TEXTS, STEM_LIFT = 0.03, 5, 20.0
# Distinct words whose kind a Python worker remembers.
REMEMBERED = 200_000
TREES, DEPTH, BINS, RATE, LEAST, SHRINK = 60, 3, 32, 0.15, 10, 1.0
FOLDS = 4
THRESHOLD = 0.7
# A hit counts as aimed at someone if a second person stands within so many words.
NEAR = 5

# Common insults, and words of the second person, in the corpus' languages.
INSULTS = frozenset(
    """
    asshole bastard bitch clown coward creep cretin crap damn degenerate dimwit disgusting dumb
    dumbass fool freak fuck fucking garbage hate hideous idiot idiotic idiots imbecile jerk kill
    lame liar loser losers lowlife lunatic maggot moron moronic morons parasite pathetic pervert
    pig psycho rat retard scum scumbag shit shut sick stupid sucker swine trash ugly useless
    vermin weirdo worthless wretch
    abschaum arschloch blöd dumm dummkopf erbärmlich hässlich idioten schwachkopf trottel
    versager wertlos widerlich
    abruti connard crétin débile imbécile minable ordure pathétique salaud stupide
    asqueroso basura cabrón despreciable escoria estúpido idiota imbécil inútil payaso patético
    """.split()
)
SECOND_PERSON = frozenset(
    """
    you your yours yourself yourselves u ur ya
    du dich dir dein deine deinen deiner ihr euch euer
    tu toi te ton ta tes vous votre vos
    tú ti tus usted ustedes vosotros vuestro
    """.split()
)
# Signs that stand in for letters.
STAND_INS = str.maketrans("013457@$!*", "oieastasi*")

WORD = re.compile(r"[^\W\d_]+")
MASKED = re.compile(r"[^\W_]*[^\W\d_][0-9@$!*]+[^\W_][\w@$!*]*")
SHOUTED = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
DRAWN_OUT = re.compile(r"([^\W\d_])\1\1|[!?]{2,}")
UPPER, DIGITS = string.ascii_uppercase.encode(), string.digits.encode()
LETTERS = string.ascii_letters.encode()
POINTS = b"\"'(),-./:;"

FEATURES = (
    "insults", "learned", "log_insults", "log_learned", "distinct_hits", "second_person",
    "aimed", "masked_hits", "masked", "capitals", "shouted", "exclamations", "questions",
    "points", "digits", "drawn_out",
)


class Lexicon(dict):
    """Kind of each word: 1 for an insult, 2 for a word with a learned stem, 0 for others."""

    def __init__(self, learned: frozenset[str]) -> None:
        super().__init__()
        self.learned = learned

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        stem = any(word[:k] in self.learned for k in STEMS)
        self[word] = kind = 1 if word in INSULTS else 2 if stem else 0
        return kind


@cache
def lexicon(learned: frozenset[str]) -> Lexicon:
    """One for each Python worker."""
    return Lexicon(learned)


def features(text: str, learned: frozenset[str]) -> list[float]:
    """The dense features of one whole text, in the order of ``FEATURES``; an empty text has zeros."""
    low, raw = text.lower(), text.encode()
    words = WORD.findall(low)
    n, size = max(1, len(words)), max(1, len(raw))
    known = lexicon(learned)
    kinds = [known[w] for w in words]
    insults, new = kinds.count(1), kinds.count(2)
    hits = [i for i, kind in enumerate(kinds) if kind] if insults or new else []
    aimed = sum(
        not SECOND_PERSON.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1]) for i in hits
    )
    count = lambda signs: len(raw) - len(raw.translate(None, signs))
    masked = MASKED.findall(low) if count(DIGITS + b"@$!*") else []
    unmasked = sum(_unmasked(m) for m in masked)
    letters = max(1, count(LETTERS))
    return [
        insults / n,
        new / n,
        np.log1p(insults),
        np.log1p(new),
        len({words[i] for i in hits}),
        sum(map(words.count, SECOND_PERSON)) / n if hits else 0.0,
        aimed / n,
        unmasked / n,
        len(masked) / n,
        count(UPPER) / letters,
        len(SHOUTED.findall(text)) / n,
        count(b"!") / size,
        count(b"?") / size,
        count(POINTS) / size,
        count(DIGITS) / size,
        len(DRAWN_OUT.findall(low)) / n,
    ]


def _unmasked(word: str) -> bool:
    """Whether a masked word is an insult once its signs are read as letters."""
    plain = word.translate(STAND_INS)
    if "*" not in plain:
        return plain.rstrip("i") in INSULTS or plain in INSULTS
    pattern = re.compile("".join("." if c == "*" else re.escape(c) for c in plain))
    return any(pattern.fullmatch(insult) for insult in INSULTS)


# -- trees and calibration ---------------------------------------------------------------


@dataclass
class Model:
    """Trees as arrays of nodes: feature (-1 in leaves), threshold, value; node i has 2i+1 and 2i+2."""

    learned: frozenset[str]
    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    margins: np.ndarray = field(default_factory=lambda: np.array([0.0]))
    scores: np.ndarray = field(default_factory=lambda: np.array([0.0]))

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for feature, threshold, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                split = feature[node]
                right = x[np.arange(len(x)), np.maximum(split, 0)] > threshold[node]
                node = np.where(split < 0, node, 2 * node + 1 + right)
            total += value[node]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated score from 0 to 1, rising with the margin."""
        if not len(x):
            return np.zeros(0)
        return np.clip(np.interp(self.margin(x), self.margins, self.scores), 0.0, 1.0)


def grow_tree(x: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray):
    """One tree on binned features by Newton gains; ``x`` holds bin numbers."""
    nodes = 2 ** (DEPTH + 1) - 1
    feature, threshold, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
    node = np.zeros(len(x), int)
    for at in range(nodes):
        rows = np.flatnonzero(node == at)
        if not len(rows):
            continue
        g, h = grad[rows].sum(), hess[rows].sum()
        value[at] = -RATE * g / (h + SHRINK)
        if at >= 2**DEPTH - 1 or len(rows) < 2 * LEAST:
            continue
        best = (1e-6, -1, -1)
        for f in range(x.shape[1]):
            bins = x[rows, f]
            left_g = np.cumsum(np.bincount(bins, grad[rows], BINS))[:-1]
            left_h = np.cumsum(np.bincount(bins, hess[rows], BINS))[:-1]
            left_n = np.cumsum(np.bincount(bins, minlength=BINS))[:-1]
            gain = (
                left_g**2 / (left_h + SHRINK)
                + (g - left_g) ** 2 / (h - left_h + SHRINK)
                - g**2 / (h + SHRINK)
            )
            gain[(left_n < LEAST) | (len(rows) - left_n < LEAST)] = -np.inf
            cut = int(np.argmax(gain))
            if gain[cut] > best[0]:
                best = (gain[cut], f, cut)
        _, f, cut = best
        if f >= 0 and cut < len(edges[f]):
            feature[at], threshold[at] = f, edges[f][cut]
            node[rows] = 2 * at + 1 + (x[rows, f] > cut)
    return feature, threshold, value


def isotonic(margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean margin and mean label of the blocks, both rising.

    Each block's mean is drawn a little towards the mean of all, so a block of few rows is not certain.
    """
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # labels, rows, sum of margins
    for m, y in zip(margin[order].tolist(), label[order].tolist(), strict=True):
        blocks.append([y, 1.0, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    prior = float(label.mean())
    return (
        np.array([m / n for _, n, m in blocks]),
        np.array([(y + 0.5 * prior) / (n + 0.5) for y, n, _ in blocks]),
    )


def boosted(x: np.ndarray, y: np.ndarray, learned: frozenset[str]) -> Model:
    """Trees fitted on all rows, without calibration."""
    edges = []
    for column in x.T:
        more = column[column > column.min()]
        cuts = np.unique(np.quantile(more, np.linspace(0, 1, BINS - 1))) if len(more) else more
        edges.append((np.concatenate([[column.min()], cuts[:-1]]) + cuts) / 2 if len(cuts) else cuts)
    binned = np.column_stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)])
    share = y.mean()
    model = Model(learned, float(np.log(share / (1 - share))))
    margin = np.full(len(y), model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        tree = grow_tree(binned, edges, p - y, p * (1 - p))
        model.trees.append(tree)
        margin += Model(learned, 0.0, [tree]).margin(x)
    return model


def fit(x: np.ndarray, y: np.ndarray, learned: frozenset[str]) -> Model:
    """Trees on all rows, calibrated on margins that trees without the row's fold give.

    With no rows or one class only, the score is the share of toxic rows.
    """
    if not len(y) or y.min() == y.max():
        return Model(learned, 0.0, scores=np.array([float(y.mean()) if len(y) else 0.0]))
    # Each class is dealt out over the folds in turn.
    fold = np.zeros(len(y), int)
    for label in (0, 1):
        fold[y == label] = np.arange((y == label).sum()) % FOLDS
    model = boosted(x, y, learned)
    margin = model.margin(x)
    for part in range(FOLDS):
        rest = fold != part
        if 0 < y[rest].sum() < rest.sum():
            margin[~rest] = boosted(x[rest], y[rest], learned).margin(x[~rest])
    model.margins, model.scores = isotonic(margin, y)
    return model


# -- Spark -------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``rows`` different labelled texts outside the held-out third, the same on each run.

    They are chosen by a hash of the text, so a text is in it once, however often it or its id is
    repeated; it counts as toxic if any label of a row outside the held-out third says so. Null texts
    count as empty.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    texts = documents(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("text_hash", text_hash())
    different = (
        texts.select("doc_id", "text_hash")
        .join(known, "doc_id")
        .groupBy("text_hash")
        .agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    )
    # At most ``rows`` rows of three numbers. Rows that are equal in id and text are still repeated.
    chosen = F.broadcast(drawn(staged(different), rows, "text_hash"))
    return texts.join(chosen, ["doc_id", "text_hash"]).dropDuplicates(["text_hash"]).drop("text_hash")


def learned_stems(sample: DataFrame) -> frozenset[str]:
    """Stems of the toxic sample that the rest hardly has, counted by texts.

    Of stems that begin with another one, the shorter is kept.
    """
    totals = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return frozenset()

    def work(texts: list[str]) -> list:
        found = (set(WORD.findall(t.lower())) for t in texts)
        stems = [list({w[:k] for w in words for k in STEMS if len(w) >= k}) for words in found]
        return [pa.array(stems, pa.list_(pa.string()))]

    counts = (
        by_text(sample, work, "stems array<string>", keep=("toxic",))
        .select("toxic", F.explode("stems").alias("stem"))
        .groupBy("stem")
        .agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    )
    share, rest = F.col("toxic") / totals[1], (F.col("clean") + 1) / totals[0]
    found = (
        counts.where(share >= F.greatest(F.lit(STEM_SHARE), STEM_LIFT * rest))
        .where(F.col("toxic") >= STEM_TEXTS)
        .collect()
    )
    stems = {r.stem for r in found}
    return frozenset(s for s in stems if not any(s[:k] in stems for k in STEMS if k < len(s)))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on the sample's features, at most ``rows`` times 16 numbers on the driver."""
    sample = staged(training_sample(docs, labels, rows))
    learned = learned_stems(sample)

    def work(texts: list[str]) -> list:
        return [pa.array([features(t, learned) for t in texts], pa.list_(pa.float64()))]

    found = by_text(sample, work, "x array<double>", keep=("doc_id", "toxic")).orderBy(
        F.xxhash64("doc_id"), "doc_id", "x"
    ).collect()
    x = np.array([r.x for r in found], float).reshape(len(found), len(FEATURES))
    return fit(x, np.array([r.toxic for r in found], float), learned)


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the score of each whole text; null texts are scored as empty ones."""

    def work(texts: list[str]) -> list:
        x = np.array([features(t, model.learned) for t in texts], float)
        return [pa.array(model.score(x.reshape(len(texts), len(FEATURES))), pa.float64())]

    return by_text(docs, work, "score double", keep=keep)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of every document, by a model fitted on labelled rows outside the held-out third.

    Nothing but the text enters a score. Null texts count as empty; repeated rows get the same
    score; without usable labels all scores are 0. Other columns are not looked at. An
    empty table gives no rows.
    """
    model = train(docs, labels)
    return scored(documents(docs), model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
