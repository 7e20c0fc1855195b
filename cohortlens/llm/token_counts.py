"""Token counts by byte-pair merging with a heap of pairs and a linked list of symbols.

A pretoken of n symbols (bytes) loses one symbol with each merge, so its count is n minus the number
of merges; no identifiers are made. Vocabulary, merges and special tokens are read from the
tokenizer's file.
"""

from __future__ import annotations

import heapq
import json
from functools import cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm.common import by_text, documents, table

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
# Distinct pieces, and pretokens, whose counts a Python worker remembers (about 150 bytes each);
# beyond it, it starts anew.
REMEMBERED = 800_000
# A longer piece is counted but not remembered.
LONG = 100


@cache
def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the files of byte-level vocabularies.

    Printable bytes stand for themselves, the others are numbered from 256 on.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Counter:
    """Counts tokens of texts as the tokenizer of a byte-level BPE file does."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        letters = byte_letters()
        to_bytes = lambda token: bytes(letters[c] for c in token)
        merges = described["model"]["merges"]
        pairs = (pair if isinstance(pair, list) else pair.split(" ") for pair in merges)
        # Symbols are numbers: bytes, and 256 + rank for what a merge makes.
        symbols = {bytes([b]): b for b in range(256)}
        self.ranks: dict[int, int] = {}
        for rank, (a, b) in enumerate(pairs):
            left, right = to_bytes(a), to_bytes(b)
            self.ranks[symbols[left] << 16 | symbols[right]] = rank
            symbols[left + right] = 256 + rank
        self.pretokens = regex.compile(public_tokenizers.PATTERN)
        special = sorted((t["content"] for t in described["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.known: dict[str, int | None] = {}
        self.counted: dict[str, int] = {}

    def merged(self, symbols: bytes) -> int:
        """Symbols left after all merges of one pretoken.

        The heap holds ranks and places of adjacent pairs as one number each, so the lowest rank
        and then the leftmost place comes first. A place whose pair has changed since is passed by.
        """
        n, ranks = len(symbols), self.ranks
        ids = list(symbols)
        heap = [
            rank << 32 | i
            for i in range(n - 1)
            if (rank := ranks.get(ids[i] << 16 | ids[i + 1])) is not None
        ]
        if not heap:
            return n
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        merges = 0
        while heap:
            top = pop(heap)
            i, rank = top & 0xFFFFFFFF, top >> 32
            j = after[i]
            if j < 0 or ids[i] < 0 or ranks.get(ids[i] << 16 | ids[j]) != rank:
                continue
            merges += 1
            ids[i], ids[j] = own, _ = 256 + rank, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (rank := ranks.get(own << 16 | ids[k])) is not None:
                    push(heap, rank << 32 | i)
            h = before[i]
            if h >= 0 and (rank := ranks.get(ids[h] << 16 | own)) is not None:
                push(heap, rank << 32 | h)
        return n - merges

    def plain(self, text: str) -> int:
        """Tokens of a text without special tokens, pretoken by pretoken."""
        total, counted = 0, self.counted
        for pretoken in self.pretokens.findall(text):
            found = counted.get(pretoken)
            if found is None:
                found = self.merged(pretoken.encode())
                if len(pretoken) <= LONG:
                    if len(counted) >= REMEMBERED:
                        counted.clear()
                    counted[pretoken] = found
            total += found
        return total

    def piece(self, piece: str) -> int | None:
        """Tokens of a blank and the piece after it; None if the blank may belong elsewhere."""
        if not piece or piece[0].isspace() or piece[-1].isspace():
            found = None
        else:
            found = self.plain(" " + piece)
        if len(piece) <= LONG:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = found
        return found

    def line(self, text: str) -> int:
        """Tokens of a text without special tokens.

        A single blank between other characters starts a pretoken, so the text can be counted
        piece by piece there. Pieces that touch more white space are counted with their
        neighbours.
        """
        if not text:
            return 0
        known, total = self.known, 0
        first, *pieces = text.split(" ")
        # The first piece has no blank before it.
        open_: list[str] | None = [first]
        for piece in pieces:
            found = known.get(piece, -1)
            if found == -1:
                found = self.piece(piece)
            if found is None:
                # Goes on with what is open, or opens anew with its blank.
                if open_ is None:
                    open_ = [""]
                open_.append(piece)
            elif open_ is None:
                total += found
            elif open_[-1] and not open_[-1][-1].isspace():
                total += self.plain(" ".join(open_)) + found
                open_ = None
            else:
                open_.append(piece)
        if open_ is not None:
            total += self.plain(" ".join(open_))
        return total

    def count(self, text: str) -> int:
        """Tokens of a text; the strings of special tokens count as one token each."""
        if self.special is None:
            return self.line(text)
        total, at = 0, 0
        for match in self.special.finditer(text):
            total += self.line(text[at : match.start()]) + 1
            at = match.end()
        return total + self.line(text[at:])


@cache
def counter(path: str) -> Counter:
    """One for each Python worker."""
    return Counter(path)


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """Bytes and tokens of every whole text, and whether the tokens exceed ``limit``.

    ``tokenizer`` names a byte-level BPE file of the public tokenizers, or is a path that all
    executors can read. A null text counts as empty, with 0 tokens. Rows are counted one by one, so
    repeated rows, null ids and other columns change nothing; an empty table gives no rows.
    """
    path = tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer)

    def work(texts: list[str]) -> list:
        tokens = [counter(path).count(t) for t in texts]
        return [
            pa.array([len(t.encode()) for t in texts], pa.int64()),
            pa.array(tokens, pa.int64()),
            pa.array([n > limit for n in tokens], pa.bool_()),
        ]

    return by_text(
        documents(docs), work, "n_bytes bigint, n_tokens bigint, over_limit boolean"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
