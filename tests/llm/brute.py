"""Plain versions of the operators, in Python over lists of (doc_id, text)."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import xxhash

WHITE = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def id_order(doc_id):
    return (doc_id is None, doc_id or 0)


def exact_groups(docs):
    """(doc_id, keep_id, group_size, text_sha256) of each row."""
    groups = defaultdict(list)
    for doc_id, text in docs:
        text = text or ""
        digest = hashlib.sha256(WHITE.sub("", text).encode()).hexdigest()
        groups[digest].append((-len(text), id_order(doc_id), doc_id))
    return [
        (doc_id, min(rows)[2], len(rows), digest)
        for digest, rows in groups.items()
        for _, _, doc_id in rows
    ]


def fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_groups(docs, fps=None):
    """(doc_id, fingerprint, component_id) of each row, by comparing all pairs of fingerprints."""
    fps = fps or [fingerprint(text) for _, text in docs]
    distinct = np.array(sorted(set(fps)), np.uint64)
    root = list(range(len(distinct)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, fp in enumerate(distinct):
        near = np.flatnonzero(np.bitwise_count(distinct ^ fp) <= 4)
        for j in near.tolist():
            a, b = sorted((top(i), top(j)))
            root[b] = a
    at = {int(fp): top(i) for i, fp in enumerate(distinct)}
    first = {}
    for (doc_id, _), fp in zip(docs, fps, strict=True):
        if doc_id is not None:
            first[at[fp]] = min(first.get(at[fp], doc_id), doc_id)
    return [
        (doc_id, f"{fp:016x}", first.get(at[fp]))
        for (doc_id, _), fp in zip(docs, fps, strict=True)
    ]


def without_repeats(docs, width=50):
    """(doc_id, n_words, n_removed, kept_sha256) of each row."""
    texts = [(doc_id, WORD.findall(text or "")) for doc_id, text in docs]
    first = {}
    for doc_id, words in texts:
        if doc_id is None:
            continue
        for i in range(len(words) - width + 1):
            window = tuple(words[i : i + width])
            first[window] = min(first.get(window, doc_id), doc_id)
    out = []
    for doc_id, words in texts:
        gone = set()
        for i in range(len(words) - width + 1) if doc_id is not None else ():
            if first[tuple(words[i : i + width])] < doc_id:
                gone.update(range(i, i + width))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(text):
    """Spans of email, ip, card and phone, straight from the patterns."""
    text = text or ""

    def digits(m):
        return re.sub("[^0-9]", "", m.group())

    def luhn(d):
        doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(d))]
        return sum(n // 10 + n % 10 for n in doubled) % 10 == 0

    return [
        [m.span() for m in EMAIL.finditer(text)],
        [m.span() for m in IP.finditer(text) if max(map(int, m.group().split("."))) <= 255],
        [
            m.span()
            for m in CARD.finditer(text)
            if 16 <= len(digits(m)) <= 19 and luhn(digits(m))
        ],
        [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15],
    ]


def crc(text):
    return zlib.crc32((text or "").encode())


def nearest(vectors, queries, k=10):
    """(query_id, rank, vec_id, score), exactly; ``vectors`` is a dict of usable vectors."""
    ids = np.array(sorted(vectors))
    matrix = np.array([vectors[i] for i in ids.tolist()], float)
    out = []
    for query in queries:
        score = np.sqrt(((matrix - np.array(vectors[query], float)) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, score)).tolist() if ids[i] != query][:k]
        out += [(query, r, int(ids[i]), float(score[i])) for r, i in enumerate(order, 1)]
    return out


def runs(words):
    """(start, length, period) of each run of at least 6 words and 4 periods, comparing at every distance."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        start = None
        for t in range(q, len(words) + 1):
            if t < len(words) and words[t] == words[t - q]:
                start = t - q if start is None else start
            elif start is not None:
                if t - start >= max(6, 4 * q):
                    found.setdefault((start, t), q)
                start = None
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def runs_digest(doc_id, text):
    """The row of op11 for one document."""
    words = WORD.findall(text or "")
    h, n = crc(str(doc_id)), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = runs(words)
    best = min(found, key=lambda r: (Fraction(-r[1], r[2]), r[0], r[2]), default=(None, None, None))
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in found)),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )
