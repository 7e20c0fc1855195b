"""Runs of repeated words, found online by catchers over dyadic blocks.

Words are appended one by one. Each time a block of 2^k words is completed, at a place that is a multiple
of its size, a catcher is set up for it: it follows the appended words by Knuth-Morris-Pratt and reports
where the block occurs again q words later, with 2^k <= q < 2^(k+1). Equal words at distance q around the
block are then compared backwards at once and forwards with each appended word. As soon as they
make up q words there is a square; squares that follow each other with the same period are one run, which
ends at the first word that differs.

A run of at least 4 periods of q holds such a block and its second occurrence after the run's first
q words, and there each word's last occurrence is at most q words back. So a block needs a catcher only
if each of its words occurred within twice the block's size before, which is known when the block is completed.
At most two catchers a level are open at once, so n words take n log n steps at most, whatever they are.
While a run goes on whose period is no longer than the block, the block's catcher sleeps: if the run
outlasts it, no other period can be found there (two periods that overlap by their sum have a common
divisor as period). If the run ends before, the catcher catches up on the words it has missed.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import by_text, documents, table

# Runs that count: so many words, and so many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4

FAR = 1 << 62


class Catcher:
    """Follows appended words until a block's second occurrences with its periods are past."""

    __slots__ = ("start", "block", "fallback", "state", "until")

    def __init__(self, words: list, start: int, size: int) -> None:
        self.start = start
        self.block = block = words[start : start + size]
        self.until = start + 3 * size - 1  # no occurrence with a period of this level ends later
        self.fallback = fallback = [0] * (size + 1)
        k = 0
        for i in range(1, size):
            while k and block[i] != block[k]:
                k = fallback[k]
            if block[i] == block[k]:
                k += 1
            fallback[i + 1] = k
        self.state = 0

    def follow(self, word) -> bool:
        """Whether the block ends with this word."""
        block, k = self.block, self.state
        while k and block[k] != word:
            k = self.fallback[k]
        if block[k] == word:
            k += 1
        if k == len(block):
            self.state = self.fallback[k]
            return True
        self.state = k
        return False


class Runs:
    """All runs of at least four periods of the words appended so far."""

    def __init__(self) -> None:
        self.words: list = []
        self._last: dict = {}  # word: its last place
        self._most: list[int] = []  # level: farthest last occurrence of the left block that waits for its right one
        self._catchers: list[Catcher] = []
        self._open: dict[int, int] = {}  # period: start of the equal words that go on
        self._asleep: dict[int, dict[int, deque[int]]] = {}  # period: block size: starts of its last blocks
        self._found: dict[tuple[int, int], int] = {}  # start and end of a run: its period

    def append(self, word) -> None:
        words = self.words
        t = len(words)
        words.append(word)
        back = t - self._last.get(word, -FAR)
        self._last[word] = t
        if self._open:
            self._go_on(t, word)
        if self._catchers:
            self._advance(t, word)
        self._complete(t + 1, back)

    def _go_on(self, t: int, word) -> None:
        words = self.words
        for q in [q for q in self._open if words[t - q] != word]:
            self._close(q, t)
        # What woke up may have found equal words that do not go on either.
        for q in [q for q in self._open if words[t - q] != word]:
            self._close(q, t)

    def _close(self, q: int, end: int) -> None:
        start = self._open.pop(q)
        if end - start >= 2 * q:
            # A multiple of the smallest period has the same first and last word.
            self._found[start, end] = min(q, self._found.get((start, end), q))
        for size, starts in self._asleep.pop(q, {}).items():
            for block in starts:
                if block + 3 * size - 1 > end:
                    self._wake(block, size, end)

    def _wake(self, block: int, size: int, end: int) -> None:
        catcher = Catcher(self.words, block, size)
        self._catchers.append(catcher)
        words, before = self.words, set(self._open)
        for t in range(block + size, end):
            for q in [q for q in self._open if q not in before and words[t - q] != words[t]]:
                self._close(q, t)
            if catcher.follow(words[t]):
                self._catch(block, t + 1 - size)

    def _advance(self, t: int, word) -> None:
        done = False
        for catcher in self._catchers:
            if catcher.follow(word):
                self._catch(catcher.start, t + 1 - len(catcher.block))
            done |= catcher.until <= t + 1
        if done:
            self._catchers = [c for c in self._catchers if c.until > t + 1]

    def _catch(self, first: int, second: int) -> None:
        """The same block at two places: equal words that start there or before, and still go on."""
        q = second - first
        known = self._open
        if q in known and known[q] <= first:
            return
        if any(q % p == 0 and start <= first for p, start in known.items()):
            return  # a multiple of the period of a run that goes on
        words, start = self.words, first
        while start and words[start - 1] == words[start - 1 + q]:
            start -= 1
        known[q] = start

    def _set_up(self, block: int, size: int) -> None:
        for p, start in self._open.items():
            if p <= size and start <= block:
                self._asleep.setdefault(p, {}).setdefault(size, deque(maxlen=3)).append(block)
                return
        self._catchers.append(Catcher(self.words, block, size))

    def _complete(self, n: int, back: int) -> None:
        """Blocks that end before place ``n``, smallest first: two halves make up the next."""
        most, size, level = self._most, 1, 0
        while True:
            if back < 2 * size:
                self._set_up(n - size, size)
            if level == len(most):
                most.append(back)
                return
            if not n & size:  # a right half: with the one that waits it is a block of the next level
                if most[level] > back:
                    back = most[level]
                size, level = 2 * size, level + 1
                continue
            most[level] = back
            return

    def all(self) -> list[tuple[int, int, int]]:
        """Start, length and smallest period of each run so far, by start, then period."""
        found, end = dict(self._found), len(self.words)
        for q, start in self._open.items():
            if end - start >= 2 * q:
                found[start, end] = min(q, found.get((start, end), q))
        return sorted(
            ((start, stop - start, q) for (start, stop), q in found.items()
             if stop - start >= max(LEAST_WORDS, LEAST_PERIODS * q)),
            key=lambda run: (run[0], run[2]),
        )


def runs_of(words: list) -> list[tuple[int, int, int]]:
    runs = Runs()
    append = runs.append
    for word in words:
        append(word)
    return runs.all()


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words outside runs, and of each run its first period; a word goes if any run says so."""
    if not runs:
        return words
    kept, at = [], 0
    for start, stop in sorted((start + q, start + length) for start, length, q in runs):
        if start > at:
            kept += words[at:start]
        at = max(at, stop)
    return kept + words[at:]


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
RUNS_ARROW = pa.list_(
    pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per document: its ``runs`` by start, then period, and the text ``collapsed``.

    A run is a longest stretch of words that are equal to those q words before, of at least 6 words and 4
    periods, q being its smallest period. The collapsed text has the words that no run repeats, joined by
    one blank. Words are what ASCII white space separates. Null and empty texts have no words and
    no runs. Rows with null ids and repeated rows are each worked on by themselves. A text of any length is
    read word by word with memory for its words. Columns other than id and text are not looked at. An
    empty table gives no rows.
    """

    def work(texts: list[str]) -> list:
        runs, kept = [], []
        for text in texts:
            words = text.encode().split()
            found = runs_of(words)
            runs.append([dict(zip(("start", "length", "period"), run, strict=True)) for run in found])
            kept.append(b" ".join(collapsed(words, found)).decode())
        return [pa.array(runs, RUNS_ARROW), pa.array(kept, pa.string())]

    return by_text(documents(docs), work, f"runs {RUNS}, collapsed string")


# -- the query ---------------------------------------------------------------------------


def planted(docs: DataFrame) -> DataFrame:
    """One text in ten, chosen by the checksum of its id, with its end replaced by repetitions.

    From word a on, words are the original ones from a on, p at a time. Rows with null ids and texts
    without words stay as they are.
    """
    rows = documents(docs).withColumn("h", F.crc32(F.col("doc_id").cast("string")))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = F.when(F.col("h") % 10 == 0, words)
    g = F.floor(F.col("h") / 10)
    rows = rows.withColumn("w", chosen).withColumn("g", g).withColumn("n", F.size("w"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn(
        "p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    )
    repeated = F.concat(
        F.slice("w", F.lit(1), F.col("a")),
        F.transform(
            F.sequence(F.lit(0), F.col("n") - F.col("a") - 1),
            lambda i: F.element_at("w", (F.col("a") + i % F.col("p") + 1).cast("int")),
        ),
    )
    text = F.when(F.col("a").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"))


def _ahead(x: Column, y: Column) -> Column:
    """Order of runs by exact exponent, largest first, then start, then period."""
    more = x["length"] * y["period"] - y["length"] * x["period"]
    order = F.coalesce(
        *(F.nullif(F.signum(d), F.lit(0.0)) for d in (-more, x["start"] - y["start"], x["period"] - y["period"]))
    )
    return F.coalesce(order, F.lit(0.0)).cast("int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(table(spark, sf_dir, "documents")))
    best = F.get(F.array_sort("runs", _ahead), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
