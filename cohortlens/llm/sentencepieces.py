"""SentencePiece encoding and decoding by a streaming Viterbi search.

Position by position, the search keeps for each reachable boundary the piece that ends there and
where it starts (the back-pointer). No piece is longer than ``longest`` characters, so only that many
positions can still be extended; as soon as the back-pointer paths of all of them run through one
boundary, the ids up to it are final and are handed out, and the window moves on.

The vocabulary at hand is a merge vocabulary (byte-pair encoding, with bytes for unknown
characters). Its encoding is not the path with the best sum of scores, but the one path on
which every two neighbours stay apart when their characters are merged by themselves. A path to a
boundary survives only if its last two pieces pass that test, so each boundary keeps at most one
piece, and the result is that of the sentencepiece library.
"""

from __future__ import annotations

import heapq
import re
from array import array
from functools import cache
from itertools import pairwise

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm.common import by_text, documents, table

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
# Distinct words that a Python worker remembers, in two generations (about 200 bytes each), and pairs
# of pieces (about 130 bytes each).
REMEMBERED = 300_000
# A longer word is not remembered.
LONG = 60
# Characters that are no piece are numbered from here on.
UNKNOWN = 1 << 24
# Letters and digits with the marks before them, and runs of other characters.
RUNS = re.compile(f"{BLANK}*[^\\W_]+|[\\W_]+")


class Pieces:
    """The vocabulary of a model file, and encoding and decoding with it."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        self.texts: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            text = b""
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                text = bytes([int(piece[3:5], 16)])
            elif model.is_unknown(i):
                self.unknown = i
                text = " ⁇ ".encode()
            elif not model.is_control(i) and not model.is_unused(i):
                self.ids[piece] = i
                self.scores[piece] = model.get_score(i)
                text = piece.replace(BLANK, " ").encode()
            self.texts.append(text)
        # Pieces that merging their own characters does not give are never the result.
        self.ids = {p: i for p, i in self.ids.items() if self.merged(p) == [p]}
        self.names = {i: p for p, i in self.ids.items()}
        self.ending = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.ending.add_word(piece, i << 8 | len(piece))
        self.ending.make_automaton()
        self.longest = max(map(len, self.ids))
        # If marks only ever start pieces, no piece crosses into a new word; if no piece holds a letter
        # or digit beside another character but marks, none crosses from one kind to the other.
        self.words = not any(BLANK in p.lstrip(BLANK) for p in self.ids)
        self.runs = not any(
            a.isalnum() != b.isalnum() for p in self.ids for a, b in pairwise(p.lstrip(BLANK))
        )
        self.known: dict[str, bytes] = {}
        self.former: dict[str, bytes] = {}
        self.apart: dict[int, bool] = {}

    # -- the test of neighbours ----------------------------------------------------------

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best pair again and again, leftmost first."""
        parts: list[str | None] = list(text)
        n = len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap: list = []

        def offer(i: int, j: int) -> None:
            pair = parts[i] + parts[j]
            if pair in self.scores:
                heapq.heappush(heap, (-self.scores[pair], i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j < 0 or parts[i] != left or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                offer(i, after[j])
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p is not None]

    def _test(self, left: int, right: int) -> bool:
        """Whether two pieces stay apart when their characters are merged by themselves."""
        pair = [self._piece(left), self._piece(right)]
        found = self.merged("".join(pair)) == pair
        if len(self.apart) >= REMEMBERED:
            self.apart.clear()
        self.apart[left << 32 | right] = found
        return found

    def _piece(self, number: int) -> str:
        return self.names[number] if number < UNKNOWN else chr(number - UNKNOWN)

    # -- the search ----------------------------------------------------------------------

    def _extend(self, text: str, last: list[int], starts: list[int]) -> None:
        """Add the boundaries up to the end of ``text``: the piece that ends there, its start.

        An automaton of all pieces gives those that end at a boundary. Every boundary is reached by one
        path or, inside a merge, by none (-1).
        """
        apart, begin = self.apart, max(0, len(last) - self.longest)
        done = len(last) - 1
        for at, value in self.ending.iter(text, begin):
            if at < done:
                continue
            while len(last) <= at:
                self._lone(text, last, starts)
            start = at + 1 - (value & 0xFF)
            before = last[start]
            if before < 0:
                continue
            piece = value >> 8
            if before:
                fits = apart.get(before << 32 | piece)
                if fits is None:
                    fits = self._test(before, piece)
                if not fits:
                    continue
            last.append(piece)
            starts.append(start)
            done = at + 1
        while len(last) <= len(text):
            self._lone(text, last, starts)

    def _lone(self, text: str, last: list[int], starts: list[int]) -> None:
        """The boundary after a character at which no piece ends, or none that fits.

        A character that is no piece is one by itself, numbered from ``UNKNOWN`` on.
        """
        start = len(last) - 1
        before, piece = last[start], UNKNOWN + ord(text[start])
        fits = before >= 0 and text[start] not in self.ids
        if fits and before:
            known = self.apart.get(before << 32 | piece)
            fits = self._test(before, piece) if known is None else known
        last.append(piece if fits else -1)
        starts.append(start)

    def stream(self, characters):
        """Yield lists of numbers of pieces that are final, for an iterable of strings.

        What lies before the boundary on which all paths agree has been handed out; only
        the last final piece stays, as the neighbour of the next one.
        """
        text, last, starts = "", [0], [0]
        for more in characters:
            text += more
            self._extend(text, last, starts)
            if len(text) < 4 * self.longest:
                continue
            final = self._agreed(starts, last, len(text) + 1 - self.longest)
            cut = starts[final] if final else 0
            if cut > 0:
                yield self._path(last, starts, cut)
                text = text[cut:]
                last, starts = last[cut:], [s - cut for s in starts[cut:]]
                last[0] = 0
                # Only the kept final piece begins here; its test has been passed.
                for i in range(1, final - cut):
                    last[i] = -1
        yield self._path(last, starts, len(text))

    @staticmethod
    def _agreed(starts: list[int], last: list[int], lasting: int) -> int:
        """Last boundary that the paths of all boundaries from ``lasting`` on run through."""
        paths = {i for i in range(lasting, len(last)) if last[i] >= 0}
        while len(paths) > 1:
            end = max(paths)
            paths.remove(end)
            paths.add(starts[end])
        return paths.pop() if paths else 0

    @staticmethod
    def _path(last: list[int], starts: list[int], at: int) -> list[int]:
        found = []
        while at > 0:
            found.append(last[at])
            at = starts[at]
        return found[::-1]

    # -- encoding and decoding -----------------------------------------------------------

    def _word(self, word: str) -> bytes:
        """Ids of a word that ``known`` does not hold, as little-endian int32; run by run of letters or
        others, if no piece crosses from one to the other."""
        packed = self.former.get(word)
        if packed is None:
            runs = RUNS.findall(word) if self.runs else (word,)
            if len(runs) > 1:
                packed = b"".join([self.known.get(r) or self._word(r) for r in runs])
            else:
                packed = self._searched(word)
        if len(word) <= LONG:
            if len(self.known) >= REMEMBERED:
                # Words that still occur come back from the former ones.
                self.former, self.known = self.known, {}
            self.known[word] = packed
        return packed

    def _searched(self, word: str) -> bytes:
        parts = (word[i : i + self.longest] for i in range(0, len(word), self.longest))
        found = [piece for final in self.stream(parts) for piece in final]
        ids: list[int] = []
        for piece in found:
            if piece < UNKNOWN:
                ids.append(piece)
            elif self.bytes:
                ids.extend(self.bytes[b] for b in chr(piece - UNKNOWN).encode())
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return array("i", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian int32.

        White space is kept: a blank becomes the blank mark, and one mark is put before the text.
        Words begin with their marks, and no piece holds a mark after another character, so all
        paths agree where a word begins: the stream commits there, and the ids of a word that it has
        met before are looked up. A run of blanks belongs to the word after it.
        """
        if not text:
            return b""
        if not self.words:
            return self._searched(BLANK + text.replace(" ", BLANK))
        found, marks = [], BLANK
        for word in text.replace(BLANK, " ").split(" "):
            if not word:
                marks += BLANK
                continue
            word = marks + word
            marks = BLANK
            found.append(self.known.get(word) or self._word(word))
        if len(marks) > 1:
            found.append(self._word(marks[1:]))
        return b"".join(found)

    def decode(self, ids: bytes) -> str:
        """Text of ids; the mark that was put before the text goes."""
        texts = self.texts
        found = b"".join([texts[i] for i in np.frombuffer(ids, "<i4").tolist()])
        return found.removeprefix(b" ").decode("utf-8", "replace")


@cache
def pieces(path: str) -> Pieces:
    """One for each Python worker."""
    return Pieces(path)


def model_path(model: str) -> str:
    return model if "/" in model else public_tokenizers.path(model)


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Ids of every whole text, their number, and whether decoding them gives the text back.

    ``model`` names a model of the public tokenizers, or is a path that all executors can read. A null
    text counts as empty and has no ids. A blank mark in a text is read as a blank, as the
    library does, so such a text decodes to one with a blank (``round_trip`` compares with that).
    Rows are encoded one by one; repeated rows, null ids and other columns change nothing.
    """
    path = model_path(model)

    def work(texts: list[str]) -> list:
        coder = pieces(path)
        ids = [coder.encode(t) for t in texts]
        lengths = np.array([len(i) // 4 for i in ids], np.int32)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        values = np.frombuffer(b"".join(ids), "<i4")
        same = [
            coder.decode(i) == t.replace(BLANK, " ") for i, t in zip(ids, texts, strict=True)
        ]
        return [
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32())),
            pa.array(lengths, pa.int32()),
            pa.array(same, pa.bool_()),
        ]

    return by_text(documents(docs), work, "ids array<int>, n_ids int, round_trip boolean")


def decoded(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """Texts of ``ids``; null ids give a null text."""
    path = model_path(model)

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            texts = [
                None if row is None else pieces(path).decode(np.array(row, "<i4").tobytes())
                for row in ids.to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"]
            )

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
