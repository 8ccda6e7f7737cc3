"""Runs from the suffix-array test against runs found by trying every period, and defined cases."""

import hashlib
import random
import zlib

import pytest

from capweave.llm import runs
from tests.llm.helpers import docs, with_odd_columns, words_of


def smallest_period(w):
    fail, k = [0] * len(w), 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = fail[k - 1]
        if w[i] == w[k]:
            k += 1
        fail[i] = k
    return len(w) - fail[-1]


def brute(w):
    n, out = len(w), set()
    for q in range(1, n):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if smallest_period(w[s:e]) == q and e - s >= max(6, 4 * q):
                out.add((s, e - s, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(40))
def test_against_every_period(seed):
    draw = random.Random(seed)
    alphabet = draw.choice([1, 2, 3, 5])
    w = [f"w{draw.randrange(alphabet)}" for _ in range(draw.randrange(0, 120))]
    if w and seed % 3 == 0:
        a, p = draw.randrange(len(w)), draw.randrange(1, 6)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    assert runs.runs_of(w) == brute(w)


def test_damage_and_digests():
    w = ["a", "b", "c", "d", "e", "f", "g", "h"] * 2
    doc = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    hurt = runs.damaged(list(w), doc)
    h = zlib.crc32(str(doc).encode())
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    assert hurt == w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    assert runs.damaged(list(w), doc + 1 if zlib.crc32(str(doc + 1).encode()) % 10 else doc + 2) == w
    d = runs.digest(["x", "y"] * 5 + ["z"])
    assert (d["n_runs"], d["start"], d["length"], d["period"], d["exponent_milli"]) == (1, 0, 10, 2, 5000)
    assert d["runs_sha256"] == hashlib.sha256(b"0,10,2\n").hexdigest()
    assert d["collapsed_sha256"] == hashlib.sha256(b"x y z").hexdigest()
    empty = runs.digest([])
    assert empty["n_runs"] == 0 and empty["start"] is None
    assert empty["runs_sha256"] == empty["collapsed_sha256"] == hashlib.sha256(b"").hexdigest()


def test_best_run_ties():
    w = ["a"] * 8 + ["b"] + ["c"] * 8
    d = runs.digest(w)
    assert (d["n_runs"], d["start"], d["length"], d["period"]) == (2, 0, 8, 1)


def test_long_single_word_run():
    w = ["a"] * 20_000 + ["b", "c"] * 3_000
    got = runs.runs_of(w)
    assert got == [(0, 20_000, 1), (20_000, 6_000, 2)]


def test_query_rows(spark):
    rows = [(1, "x y " * 6), (None, None), (2, ""), (2, ""), (3, "one two three")]
    df = with_odd_columns(docs(spark, rows))
    got = sorted(runs.periodic_runs(df).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert len(got) == 5
    assert got[0].doc_id is None and got[0].n_runs == 0
    one = [r for r in got if r.doc_id == 1][0]
    assert (one.n_runs, one.start, one.length, one.period) == (1, 0, 12, 2)
    assert runs.periodic_runs(docs(spark, [])).count() == 0
