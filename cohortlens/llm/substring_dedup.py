"""Removal of passages that an earlier document has, found by automata of repeated phrases.

1. One pass over all texts hashes every window of 50 words and keeps, per window, the smallest
   hash of its phrases of 16 words (its anchor). Equal windows have equal anchors.
2. Windows whose anchor occurs in more than one text are hashed; those that occur in two documents
   are confirmed, and belong to the document with the smallest id.
3. Anchors of confirmed windows are dealt into shards. Each shard compiles an Aho-Corasick automaton of
   its anchors' phrases, as the document that owns them has them, and streams every passage that has
   one of its anchors, by pass 1, through it. Around each occurrence of a phrase, the windows that
   belong to a smaller document are marked; their words are removed.

All windows with one anchor meet in one shard, and a passage goes to the shards of its anchors only, so the
work grows with the repeated text. Equal texts are worked on once: from the second on, all windows
start in a smaller document.
"""

from __future__ import annotations

import hashlib
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import by_text, documents, slices, staged, table
from cohortlens.session import lookup

WINDOW = 50
PHRASE = 16
# Confirmed windows in a shard, about; its automaton holds a phrase for every 15 or so.
SHARD_WINDOWS = 200_000
# Bytes of passages that one copy of a shard's automaton reads.
SHARD_BYTES = 24 << 20

# Odd multipliers of the two hashes of a window; the inverse of each undoes a shift. Words have a hash of their
# own for each, so that texts made to defeat one sum do not defeat both, nor words that defeat a sum of letters.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@cache
def _powers(multiplier: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a multiplier and of its inverse modulo 2^64."""
    base = np.full(size, multiplier, np.uint64)
    inverse = np.full(size, pow(multiplier, -1, 1 << 64), np.uint64)
    base[0] = inverse[0] = 1
    return np.cumprod(base), np.cumprod(inverse)


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, multiplier: int) -> np.ndarray:
    """Mixed hash of ``values[start:end]``, wherever it stands."""
    size = 1 << max(10, int(len(values)).bit_length())
    powers, inverses = _powers(multiplier, size)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers[: len(values)])])
    found = (sums[ends] - sums[starts]) * inverses[starts]
    found ^= found >> np.uint64(31)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    return found ^ (found >> np.uint64(29))


class Words:
    """A text as its words, each with a hash, and their phrases and windows."""

    def __init__(self, text: str) -> None:
        self.words = text.encode().split()
        self.joined = b" ".join(self.words)
        lengths = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths

    def __len__(self) -> int:
        return len(self.words)

    def between(self, start: int, end: int) -> str:
        """Words from ``start`` up to ``end``, with single blanks."""
        return self.joined[self.starts[start] : self.ends[end - 1]].decode()

    def hashes(self, multiplier: int = MULTIPLIERS[0]) -> np.ndarray:
        """XXH64 of each word, seeded by the multiplier."""
        digest = xxhash.xxh64_intdigest
        return np.fromiter((digest(word, multiplier) for word in self.words), np.uint64, len(self.words))

    def phrases(self) -> np.ndarray:
        """Hash of the 16 words from each place on."""
        return _spans(self.hashes(), PHRASE)

    def anchors(self) -> np.ndarray:
        """Smallest hash of the phrases in each window."""
        low = self.phrases()
        width, wanted = 1, WINDOW - PHRASE + 1
        while 2 * width <= wanted:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = wanted - width
        return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low

    def windows(self) -> list[np.ndarray]:
        """Two hashes of each window."""
        return [_spans(self.hashes(m), WINDOW, m) for m in MULTIPLIERS]


def _spans(hashes: np.ndarray, width: int, multiplier: int = MULTIPLIERS[1]) -> np.ndarray:
    starts = np.arange(max(0, len(hashes) - width + 1))
    return _ranges(hashes, starts, starts + width, multiplier)


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


# -- 1. anchors --------------------------------------------------------------------------


def described(docs: DataFrame) -> DataFrame:
    """Per row: number of words, SHA-256 of the words, and the distinct anchors of its windows."""

    def work(texts: list[str]) -> list:
        n_words, shas, anchors = [], [], []
        for text in texts:
            words = Words(text)
            n_words.append(len(words))
            shas.append(hashlib.sha256(words.joined).digest())
            found = np.unique(words.anchors()) if len(words) >= WINDOW else np.zeros(0, np.uint64)
            anchors.append(found.view(np.int64))
        offsets = np.concatenate([[0], np.cumsum([len(a) for a in anchors])]).astype(np.int32)
        values = np.concatenate([*anchors, np.zeros(0, np.int64)])
        return [
            pa.array(n_words, pa.int64()),
            pa.array(shas, pa.binary()),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
        ]

    rows = documents(docs).withColumn("text_hash", F.xxhash64("text"))
    return by_text(
        rows, work, "n_words bigint, sha binary, anchors array<bigint>", keep=("doc_id", "text_hash")
    )


def recurring(first: DataFrame) -> DataFrame:
    """Per text (``sha``), those of its anchors that other texts have too."""
    anchors = first.select("sha", "first_id", F.explode("anchors").alias("anchor"))
    often = anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    often = staged(often)  # the join then has a shuffle of its own, in which a common anchor can be split
    return (
        anchors.join(often, "anchor")
        .groupBy("sha", "first_id")
        .agg(F.collect_list("anchor").alias("anchors"))  # as many as the text has, at most
    )


# -- 2. repeated windows -----------------------------------------------------------------


def confirmed(candidates: DataFrame) -> DataFrame:
    """Windows that occur in two documents: two hashes, the anchor, and the smallest document."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                words = Words(batch["text"][i].as_py())
                anchors = words.anchors().view(np.int64)
                at = np.isin(anchors, np.array(batch["anchors"][i].as_py(), np.int64))
                high, low = words.windows()
                doc_id = np.full(int(at.sum()), batch["first_id"][i].as_py(), np.int64)
                columns = [_longs(high[at]), _longs(low[at]), pa.array(anchors[at]), pa.array(doc_id)]
                yield pa.RecordBatch.from_arrays(columns, names=["high", "low", "anchor", "doc_id"])

    windows = candidates.select("first_id", "text", "anchors").mapInArrow(
        run, "high bigint, low bigint, anchor bigint, doc_id bigint"
    )
    return (
        windows.groupBy("high", "low", "anchor")
        .agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
        .where("owner < last")
        .drop("last")
    )


# -- 3. occurrences ----------------------------------------------------------------------

PASSAGES = "anchor bigint, sha binary, first_id bigint, place int, words string"
PASSAGES_ARROW = pa.schema(
    [("anchor", pa.int64()), ("sha", pa.binary()), ("first_id", pa.int64()),
     ("place", pa.int32()), ("words", pa.string())]
)


def passages(candidates: DataFrame, owned: DataFrame) -> DataFrame:
    """Where texts have anchors of confirmed windows: the words that all windows with the anchor cover.

    The document that owns the first of an anchor's windows gives the phrase itself (``sha`` is null
    there); windows of smaller documents can only be in the others.
    """
    least = owned.groupBy("anchor").agg(F.min("owner").alias("least"))
    wanted = (
        candidates.select("sha", "first_id", F.explode("anchors").alias("anchor"))
        .join(least, "anchor")
        .where("least <= first_id")
        .groupBy("sha")
        .agg(F.collect_list(F.struct("anchor", (F.col("least") == F.col("first_id")).alias("own"))).alias("wanted"))
    )

    def run(batches):
        for batch in chain.from_iterable(map(slices, batches)):
            out: dict[str, list] = {name: [] for name in PASSAGES_ARROW.names}

            def add(*values):
                for name, value in zip(PASSAGES_ARROW.names, values, strict=True):
                    out[name].append(value)  # noqa: B023

            for i in range(batch.num_rows):
                words = Words(batch["text"][i].as_py())
                sha, first_id = batch["sha"][i].as_py(), batch["first_id"][i].as_py()
                own = {w["anchor"]: w["own"] for w in batch["wanted"][i].as_py()}
                anchors = words.anchors().view(np.int64)
                starts = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
                ends = np.append(starts[1:], len(anchors))
                phrases = None
                for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
                    anchor = int(anchors[start])
                    if own.get(anchor) is False:
                        add(anchor, sha, first_id, start, words.between(start, end - 1 + WINDOW))
                    elif own.pop(anchor, False):
                        if phrases is None:
                            phrases = words.phrases().view(np.int64)
                        at = start + int(np.argmax(phrases[start : start + WINDOW - PHRASE + 1] == anchor))
                        add(anchor, None, first_id, None, words.between(at, at + PHRASE))
            yield pa.RecordBatch.from_pydict(out, schema=PASSAGES_ARROW)

    return (
        candidates.select("sha", "first_id", "text")
        .join(wanted, "sha")
        .mapInArrow(run, PASSAGES)
    )


class PhraseAutomaton:
    """Finds the windows of a shard in passages."""

    def __init__(
        self, phrases: list[str], high: np.ndarray, low: np.ndarray, owners: np.ndarray
    ) -> None:
        order = np.lexsort((low, high))
        self.high, self.low, self.owners = high[order], low[order], owners[order]
        self.automaton = ahocorasick.Automaton()
        for phrase in phrases:
            self.automaton.add_word(f" {phrase} ", True)
        self.automaton.make_automaton()

    def spans(self, doc_id: int, text: str) -> list[tuple[int, int]]:
        """Runs of words that windows of smaller documents cover."""
        if not len(self.automaton):
            return []
        joined = f" {text} "
        ends = [end for end, _ in self.automaton.iter(joined)]
        if not ends:
            return []
        words = Words(text)
        # Windows that hold an occurrence of a phrase; ``last`` is the phrase's last word.
        blanks = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le"), np.uint32) == 32)
        last = np.searchsorted(blanks, ends) - 1
        near = np.zeros(len(words) + 1, np.int64)
        np.add.at(near, np.maximum(last - WINDOW + 1, 0), 1)
        np.add.at(near, last - PHRASE + 2, -1)
        at = np.flatnonzero(np.cumsum(near)[: len(words) - WINDOW + 1] > 0)
        high, low = (hashes[at].view(np.int64) for hashes in words.windows())
        found = self._owned(high, low) < doc_id
        spans: list[tuple[int, int]] = []
        for start in at[found].tolist():
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], start + WINDOW)
            else:
                spans.append((start, start + WINDOW))
        return spans

    def _owned(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Owner of each window, or more than any id where there is none."""
        owner = np.full(len(high), np.iinfo(np.int64).max)
        at = np.searchsorted(self.high, high)
        left = np.arange(len(high))
        while len(left):
            left = left[at[left] < len(self.high)]
            left = left[self.high[at[left]] == high[left]]
            same = self.low[at[left]] == low[left]
            owner[left[same]] = self.owners[at[left[same]]]
            left = left[~same]
            at[left] += 1
        return owner


SPANS = "sha binary, starts array<int>, stops array<int>"
SPANS_ARROW = pa.schema(
    [("sha", pa.binary()), ("starts", pa.list_(pa.int32())), ("stops", pa.list_(pa.int32()))]
)


def occurrences(found: DataFrame, owned: DataFrame, shards: int) -> DataFrame:
    """Spans of texts that windows of smaller documents cover, one row per passage.

    A shard with many passages is copied, and its passages are spread over the copies by text.
    """
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int")
    texts = found.where("sha IS NOT NULL").withColumn("shard", shard)
    copies = F.ceil(F.sum(F.octet_length("words")) / SHARD_BYTES).cast("int")
    crowded = texts.groupBy("shard").agg(copies.alias("copies")).where("copies > 1")
    crowded = lookup(staged(crowded))
    part = F.coalesce(F.pmod(F.xxhash64("sha"), F.col("copies")), F.lit(0)).cast("int")
    asked = (
        texts.join(crowded, "shard", "left")
        .withColumn("part", part)
        .select("shard", "part", "sha", "first_id", "place", "words")
    )
    phrases = found.where("sha IS NULL").select(
        shard.alias("shard"), F.col("words").alias("phrase"), *(F.lit(None).cast("bigint").alias(c) for c in ("high", "low", "owner"))
    )
    windows = owned.select(shard.alias("shard"), F.lit(None).cast("string").alias("phrase"), "high", "low", "owner")
    held = (
        phrases.union(windows)
        .join(crowded, "shard", "left")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)))
        .drop("copies")
    )

    def find(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: dict[str, list] = {"sha": [], "starts": [], "stops": []}
        if asked.num_rows and held.num_rows:
            windows = held.filter(held["high"].is_valid())
            high, low, owner = (windows[c].to_numpy() for c in ("high", "low", "owner"))
            phrases = held["phrase"].drop_null().unique().to_pylist()
            automaton = PhraseAutomaton(phrases, high, low, owner)
            columns = [asked[c].to_pylist() for c in ("sha", "first_id", "place", "words")]
            for sha, first_id, place, words in zip(*columns, strict=True):
                spans = automaton.spans(first_id, words)
                if spans:
                    out["sha"].append(sha)
                    out["starts"].append([place + a for a, _ in spans])
                    out["stops"].append([place + b for _, b in spans])
        return pa.table(out, schema=SPANS_ARROW)

    return asked.groupBy("shard", "part").cogroup(held.groupBy("shard", "part")).applyInArrow(
        find, SPANS
    )


def removed(candidates: DataFrame, spans: DataFrame) -> DataFrame:
    """Per text with spans: words removed, and SHA-256 and text of the words kept."""
    joined = spans.groupBy("sha").agg(
        F.flatten(F.collect_list("starts")).alias("starts"),
        F.flatten(F.collect_list("stops")).alias("stops"),
    )

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {"sha": [], "n_removed": [], "kept_sha": [], "kept_text": []}
            for i in range(batch.num_rows):
                words = batch["text"][i].as_py().encode().split()
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, batch["starts"][i].as_py(), 1)
                np.add.at(cover, batch["stops"][i].as_py(), -1)
                keep = np.cumsum(cover)[:-1] == 0
                kept = b" ".join([words[j] for j in np.flatnonzero(keep)])
                out["sha"].append(batch["sha"][i].as_py())
                out["n_removed"].append(len(words) - int(keep.sum()))
                out["kept_sha"].append(hashlib.sha256(kept).digest())
                out["kept_text"].append(kept.decode())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out["sha"], pa.binary()),
                    pa.array(out["n_removed"], pa.int64()),
                    pa.array(out["kept_sha"], pa.binary()),
                    pa.array(out["kept_text"], pa.string()),
                ],
                names=list(out),
            )

    return (
        candidates.select("sha", "text")
        .join(joined, "sha")
        .mapInArrow(run, "sha binary, n_removed bigint, kept_sha binary, kept_text string")
        .dropDuplicates(["sha"])
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: its words, how many are removed, and the words that are left, hashed.

    A word is removed if a window of 50 words around it also starts in a document with a smaller id.
    Null and empty texts have no words; texts under 50 words lose none. Rows with a null id lose
    nothing and take nothing from others; rows that share an id take nothing from each other, and
    rows that are equal in both get equal results. ``kept_text`` is given where something but
    not all is removed, and null elsewhere. Columns other than id and text are not looked at. An empty
    table gives no rows.
    """
    rows = staged(described(docs))
    long_enough = rows.where((F.col("n_words") >= WINDOW) & F.col("doc_id").isNotNull())
    first = long_enough.groupBy("sha").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("row"), F.first("anchors").alias("anchors")
    )
    first = first.select(
        "sha",
        F.col("row.doc_id").alias("first_id"),
        F.col("row.text_hash").alias("first_hash"),
        "anchors",
    )
    chosen = recurring(first).join(first.select("sha", "first_hash"), "sha")
    texts = documents(docs).where("doc_id IS NOT NULL")
    candidates = staged(
        texts.join(
            chosen,
            (F.col("doc_id") == F.col("first_id")) & (F.xxhash64("text") == F.col("first_hash")),
        ).select("sha", "first_id", "text", "anchors")
    )
    owned = staged(confirmed(candidates))
    shards = 1 + owned.count() // SHARD_WINDOWS
    found = staged(passages(candidates, owned))
    cut = removed(candidates, occurrences(found, owned, shards))
    nothing = hashlib.sha256(b"").hexdigest()
    copy = (F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= WINDOW)
    copy = F.coalesce(copy, F.lit(False))
    known = F.col("doc_id").isNotNull()
    return (
        rows.drop("anchors", "text_hash")
        .join(first.select("sha", "first_id"), "sha", "left")
        .join(cut, "sha", "left")
        .select(
            "doc_id",
            "n_words",
            F.when(copy, F.col("n_words"))
            .otherwise(F.when(known, F.coalesce("n_removed", F.lit(0))).otherwise(0))
            .cast("long")
            .alias("n_removed"),
            F.when(copy, F.lit(nothing))
            .otherwise(F.lower(F.hex(F.when(known, F.coalesce("kept_sha", "sha")).otherwise(F.col("sha")))))
            .alias("kept_sha256"),
            F.when(known & ~copy, F.col("kept_text")).alias("kept_text"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept_text")
