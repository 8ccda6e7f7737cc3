import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from capweave.llm import near_dup as N
from capweave.llm.queries import QUERIES
from tests.llm.helpers import docs, jaccard, sentence, with_odd_columns


def classes(df):
    found = N.classes(df).select(N.id_of(F.col("key")).alias("i"), N.id_of(F.col("class")).alias("c"), "links").collect()
    return {r.i: (r.c, r.links) for r in found}


def changed(draw, text, n):
    w = text.split()
    for at in draw.sample(range(len(w)), n):
        w[at] = f"x{draw.randrange(10**6)}"
    return " ".join(w)


def roots(ids, linked):
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("paired", [2, N.PAIRED])
def test_classes_equal_brute_force(spark, monkeypatch, paired):
    """Also with buckets of more than two documents treated as large."""
    monkeypatch.setattr(N, "PAIRED", paired)
    draw = random.Random(7)
    texts = []
    for _ in range(12):
        base = sentence(draw, 200, 50_000)
        texts += [changed(draw, base, draw.choice([0, 1, 2, 3])) for _ in range(draw.randrange(1, 7))]
        texts += [changed(draw, base, 30)]  # far off
    texts += [sentence(draw, 60, 50_000) for _ in range(30)]
    draw.shuffle(texts)
    rows = list(enumerate(texts))
    got = classes(docs(spark, rows))
    sure = [(a, b) for a, b in combinations(range(len(texts)), 2) if jaccard(texts[a], texts[b]) >= 0.84]
    possible = [(a, b) for a, b in combinations(range(len(texts)), 2) if jaccard(texts[a], texts[b]) >= 0.76]
    least, most = roots(range(len(texts)), sure), roots(range(len(texts)), possible)
    assert all(got[a][0] == got[b][0] for a, b in sure)
    assert all(most[a] == most[got[a][0]] for a in got) and all(c <= a for a, (c, _) in got.items())
    assert len({c for c, _ in got.values()}) <= len(set(least.values()))


def test_samples_agree_as_often_as_the_weighted_similarity_says():
    draw = np.random.default_rng(1)
    keys = np.sort(draw.choice(1 << 40, 300, replace=False))
    weight = draw.uniform(0.5, 3, 300)
    hits = total = 0
    for trial in range(60):
        a, b = keys + trial, (keys + trial)[60:]
        wa, wb = weight, weight[60:] * draw.choice([1.0, 1.5], 240)
        both = np.minimum(wa[60:], wb).sum()
        total += both / (wa[:60].sum() + np.maximum(wa[60:], wb).sum())
        one = N.sample(np.concatenate([a, b]), np.log(np.concatenate([wa, wb])).astype(np.float32), np.array([0, 300]))
        hits += (one[0] == one[1]).mean()
    assert abs(hits - total) / 60 < 0.03


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(99)] + [("x", "y")], "a string, b string")
    assert {(r.node, r.root) for r in N.components(edges).collect()} == {(f"{i:03}", "000") for i in range(1, 100)} | {("y", "x")}


def test_odd_rows(spark):
    long = sentence(random.Random(3), 30_000)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, " a "), (6, "a b"), (7, long), (8, long + " z"), (8, long + " z"), (None, "a b"), (9, "q"), (9, "r")]
    frame = with_odd_columns(docs(spark, rows))
    found = N.classes(frame)
    got = sorted((r.i or 0, r.c or 0) for r in found.select(N.id_of(F.col("key")).alias("i"), N.id_of(F.col("class")).alias("c")).collect())
    assert got == [(0, 0), (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 0), (7, 7), (8, 7), (8, 7), (9, 9), (9, 9)]
    kept = N.survivors(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "a b"), (1, ""), (4, "a"), (7, long), (9, "q"), (9, "r")]
    assert N.survivors(frame.limit(0)).count() == 0


@pytest.mark.parametrize("block", [16, N.BLOCK])
def test_a_chain_of_copies_of_copies_in_one_bucket_stays_in_one_class(spark, monkeypatch, block):
    """Each document is like the next one only, and the last band alone brings them together."""
    monkeypatch.setattr(N, "BLOCK", block)
    draw = random.Random(8)
    texts = [sentence(draw, 60, 50_000)]
    while len(texts) < 200:
        words = texts[-1].split()
        words[(7 * len(texts)) % 50 + 5] = f"x{len(texts)}"
        texts.append(" ".join(words))
    texts += [sentence(draw, 60, 50_000) for _ in range(20)]
    keys = [b"%04d" % i for i in draw.sample(range(10_000), len(texts))]
    bands = [[*(i * N.BANDS + k for k in range(N.BANDS - 1)), -1] for i in range(len(texts))]
    signed = spark.createDataFrame([(k, b, bytes(N._SAMPLES)) for k, b in zip(keys, bands)], "rep binary, bands array<bigint>, sig binary")
    frame = spark.createDataFrame(list(zip(keys, texts)), "key binary, text string")
    made = N.links(signed, frame, spark.sparkContext.broadcast(np.ones(N.BUCKETS, dtype=np.float32)))
    got = [(keys.index(bytes(r.a)), keys.index(bytes(r.b))) for r in made.collect()]
    near = {(a, b) for a, b in combinations(range(len(texts)), 2) if jaccard(texts[a], texts[b]) >= N.SIMILARITY}
    assert {(min(p), max(p)) for p in got} <= near and len(got) == len(set(got))
    assert roots(range(len(texts)), got) == roots(range(len(texts)), near)
    assert near == {(i, i + 1) for i in range(199)}


def test_the_query_gives_no_count_that_depends_on_the_bucket_size(spark, sf_dir):
    assert QUERIES["op10_near_duplicates"](spark, sf_dir).columns == ["doc_id", "class_id"]


def test_a_crowded_bucket_hands_on_no_more_links_than_join_it(spark, monkeypatch):
    """Copies with many changes of their own agree in most samples but are unlike: no row is made for each pair."""
    monkeypatch.setattr(N, "BLOCK", 32)
    draw = random.Random(5)
    base = sentence(draw, 150, 50_000).split()
    texts = []
    for i in range(150):
        words = list(base)
        for k in draw.sample(range(150), 1 + i % 14):
            words[k] = f"x{i}-{k}"
        texts.append(" ".join(words))
    keys = [b"%04d" % i for i in draw.sample(range(10_000), len(texts))]
    signed = spark.createDataFrame([(k, [*(i * N.BANDS + b for b in range(N.BANDS - 1)), -1], bytes(N._SAMPLES)) for i, k in enumerate(keys)], "rep binary, bands array<bigint>, sig binary")
    frame = spark.createDataFrame(list(zip(keys, texts)), "key binary, text string")
    verified = []
    check = N._verified
    monkeypatch.setattr(N, "_verified", lambda pairs, *rest: verified.append(pairs.count()) or check(pairs, *rest))
    made = N.links(signed, frame, spark.sparkContext.broadcast(np.ones(N.BUCKETS, dtype=np.float32)))
    got = [(keys.index(bytes(r.a)), keys.index(bytes(r.b))) for r in made.collect()]
    near = {(a, b) for a, b in combinations(range(len(texts)), 2) if jaccard(texts[a], texts[b]) >= N.SIMILARITY}
    assert sum(verified) < len(texts)
    assert {(min(p), max(p)) for p in got} <= near
    assert roots(range(len(texts)), got) == roots(range(len(texts)), near)
