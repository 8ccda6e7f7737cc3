"""Periodic runs of words by the branching-tandem test on an enhanced suffix array.

For the word sequence of a document (words are ``[^\\x20\\x09-\\x0D]+``, equal
when their text is equal) the suffix array comes from prefix doubling in numpy;
the rank table of every doubling step is kept, so the longest common prefix of
any two suffixes is a vectorised binary lifting, and the LCP array is that of
neighbours in the suffix array.  A stack walk over the LCP array visits every
LCP interval with its child intervals, building no tree nodes.  In an interval
of depth L each suffix p of a child other than the largest is tested: if
ISA[p + L] lies in the interval but in another child, a square of period L
starts at p and cannot be moved right (it is branching); if ISA[p - L] lies in
the largest child, the same holds for p - L.  Every run ends in such a square
at its smallest period, so each run is found from one: a square whose root has
a smaller period (checked by LCP queries for the prime divisors of L) is left
out, and the others are rotated left as far as the words repeat (LCP of the
reversed sequence) and so become runs.  The work is O(n log n) per document
apart from the doubling, in one task per document row; no shuffle is needed.

The dealt damage comes first: with h = crc32 of the decimal id and g = h // 10,
a document with h % 10 == 0 and n > 0 words repeats its words from a = g % n
with period p = 1 + (n - a) // (3 + g % 8).

Defined cases: a null text has no words, no runs, and the digests of empty
texts; a null ``doc_id`` is not damaged (it has no decimal form); repeated rows
give equal results; texts of any length are taken whole.  Runs are stretches of
length >= ``max(MIN_WORDS, MIN_EXPONENT * q)``, q the smallest period.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from capweave.llm.tables import ship_package

MIN_WORDS = 6
MIN_EXPONENT = 4
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
MADE = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def damaged(words: list[str], doc_id: int | None) -> list[str]:
    """The dealt repetition of the words from a = g % n on, for ids with h % 10 == 0."""
    n = len(words)
    if doc_id is None or n == 0:
        return words
    h = zlib.crc32(str(int(doc_id)).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _doubling(s: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of ``s`` (dense symbols, ending in a unique least one) and the ranks of all suffixes
    after each step."""
    n = len(s)
    rank = s.astype(np.int64)
    ranks, k = [rank], 1
    while rank.max() < n - 1:
        after = np.zeros(n, dtype=np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        ranks.append(rank)
        k *= 2
    return np.argsort(rank), ranks


def _lcp(ranks: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Longest common prefix of the suffixes at x and y, by binary lifting over the rank tables."""
    n = len(ranks[0])
    length = np.zeros(len(x), dtype=np.int64)
    for j in range(len(ranks) - 1, -1, -1):
        xi, yi = x + length, y + length
        ok = (xi < n) & (yi < n) & (x != y)
        idx = np.nonzero(ok)[0]
        same = ranks[j][xi[idx]] == ranks[j][yi[idx]]
        length[idx[same]] += 1 << j
    return length


def _squares(sa: np.ndarray, isa: np.ndarray, lcp: np.ndarray) -> list[tuple[int, int]]:
    """Branching squares (start, period) from the LCP intervals and their children."""
    n = len(sa)
    found: list[tuple[int, int]] = []
    stack: list[list] = [[0, 0, []]]  # depth, left bound, child intervals
    sa, isa, lcp = sa.tolist(), isa.tolist(), lcp.tolist()
    for k in range(1, n + 1):
        depth = lcp[k] if k < n else 0
        lb, last = k - 1, None
        while depth < stack[-1][0]:
            top = stack.pop()
            _test(top[0], top[1], k - 1, top[2], sa, isa, found)
            lb, last = top[1], (top[1], k - 1)
            if depth <= stack[-1][0]:
                stack[-1][2].append(last)
                last = None
        if depth > stack[-1][0]:
            stack.append([depth, lb, [last] if last else []])
    return found


def _test(depth: int, lb: int, rb: int, inner: list[tuple[int, int]], sa: list, isa: list, found: list) -> None:
    """The branching-tandem test in one interval: members of the smaller children look ``depth`` away."""
    n = len(sa)
    if not inner:  # children are single suffixes: the first counts as the largest
        for k in range(lb + 1, rb + 1):
            p = sa[k]
            q = p + depth
            if q < n and lb <= isa[q] <= rb and isa[q] != k:
                found.append((p, depth))
            r = p - depth
            if r >= 0 and isa[r] == lb:
                found.append((r, depth))
        return
    children, at = [], lb
    for start, end in inner:  # in order of their left bounds
        children.extend((i, i) for i in range(at, start))
        children.append((start, end))
        at = end + 1
    children.extend((i, i) for i in range(at, rb + 1))
    starts = [c[0] for c in children]
    largest = max(range(len(children)), key=lambda c: children[c][1] - children[c][0])
    for c, (start, end) in enumerate(children):
        if c == largest:
            continue
        for k in range(start, end + 1):
            p = sa[k]
            q = p + depth
            if q < n:
                iq = isa[q]
                if lb <= iq <= rb and bisect.bisect_right(starts, iq) - 1 != c:
                    found.append((p, depth))
            r = p - depth
            if r >= 0:
                ir = isa[r]
                if lb <= ir <= rb and bisect.bisect_right(starts, ir) - 1 == largest:
                    found.append((r, depth))


def _prime_factors(n: int) -> list[int]:
    out, d = [], 2
    while d * d <= n:
        if n % d == 0:
            out.append(d)
            while n % d == 0:
                n //= d
        d += 1
    if n > 1:
        out.append(n)
    return out


def runs_of(words: list[str]) -> list[tuple[int, int, int]]:
    """All runs (start, length, smallest period) of a word sequence, by start, then period."""
    n = len(words)
    if n < 2:
        return []
    ids = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64) + 1
    sa, ranks = _doubling(np.append(ids, 0))
    isa = np.empty_like(sa)
    isa[sa] = np.arange(len(sa))
    neighbours = np.zeros(len(sa), dtype=np.int64)
    neighbours[1:] = _lcp(ranks, sa[:-1], sa[1:])
    squares = _squares(sa, isa, neighbours)
    if not squares:
        return []
    found = np.array(sorted(set(squares)), dtype=np.int64)
    start, period = found[:, 0], found[:, 1]
    # a root that repeats a shorter word (period L / r for a prime r): the run of that period is found by itself
    which, shorter = [], []
    for i, length in enumerate(period.tolist()):
        for r in _prime_factors(length):
            which.append(i)
            shorter.append(length // r)
    primitive = np.ones(len(found), dtype=bool)
    if which:
        which, shorter = np.array(which), np.array(shorter)
        repeats = _lcp(ranks, start[which], start[which] + shorter) >= period[which] - shorter
        primitive[which[repeats]] = False
    start, period = start[primitive], period[primitive]
    # rotate left as far as the words repeat: common suffix of the words before p and before p + L
    _, back = _doubling(np.append(ids[::-1], 0))
    left = np.zeros(len(start), dtype=np.int64)
    inside = start > 0
    left[inside] = _lcp(back, n - start[inside], n - start[inside] - period[inside])
    first = start - np.minimum(left, start)
    length = start + 2 * period - first
    keep = length >= np.maximum(MIN_WORDS, MIN_EXPONENT * period)
    out = set(zip(first[keep].tolist(), length[keep].tolist(), period[keep].tolist()))
    return sorted(out, key=lambda r: (r[0], r[2]))


def digest(words: list[str]) -> dict:
    """The contract's columns for one (damaged) word sequence."""
    runs = runs_of(words)
    listing = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for s, length, q in runs:
        gone[s + q] += 1
        gone[s + length] -= 1
    kept = np.cumsum(gone[:-1]) == 0
    collapsed = " ".join(w for w, k in zip(words, kept) if k)
    best = None
    if runs:
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))
        ties = [r for r in runs if r[1] * best[2] == best[1] * r[2]]
        best = min(ties, key=lambda r: (r[0], r[2]))
    return {
        "n_runs": len(runs),
        "start": best[0] if best else None,
        "length": best[1] if best else None,
        "period": best[2] if best else None,
        "exponent_milli": 1000 * best[1] // best[2] if best else None,
        "runs_sha256": hashlib.sha256(listing.encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(collapsed.encode()).hexdigest(),
    }


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for doc_id, text in zip(frame["doc_id"], frame["text"]):
            key = None if pd.isna(doc_id) else int(doc_id)
            words = damaged(_WORD.findall(text) if isinstance(text, str) else [], key)
            rows.append({"doc_id": key, **digest(words)})
        yield pd.DataFrame(rows, columns=["doc_id", "n_runs", "start", "length", "period", "exponent_milli",
                                          "runs_sha256", "collapsed_sha256"]).astype(
            {"n_runs": "int64", "start": "Int64", "length": "Int64", "period": "Int64", "exponent_milli": "Int64",
             "doc_id": "Int64"}
        )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): doc_id and the contract's run columns."""
    ship_package(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(_batches, f"doc_id long, {MADE}")
