"""The backoff automaton against the interpolated model computed directly, and defined cases."""

import math
import random
import zlib
from collections import Counter

import pytest

from capweave.llm import lm_score
from tests.llm.helpers import docs, with_odd_columns, words_of

D, S, ORDER = lm_score.DISCOUNT, lm_score.SMOOTH, lm_score.ORDER


def toks(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return words_of(low) + ["\n"]


def plain(rows):
    """Per row: (n_tokens, n_known, N, base, score) by the recursive interpolated formula."""
    train = [toks(t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10 != 0]
    grams = Counter()
    for t in train:
        p = [""] * (ORDER - 1) + t
        for i in range(ORDER - 1, len(p)):
            for n in range(ORDER):
                grams[tuple(p[i - n : i + 1])] += 1
    uni = {g[0]: c for g, c in grams.items() if len(g) == 1}
    N, V = sum(uni.values()), len(uni)
    ctx_total, ctx_types = Counter(), Counter()
    for g, c in grams.items():
        if len(g) > 1:
            ctx_total[g[:-1]] += c
            ctx_types[g[:-1]] += 1

    def prob(h, w):
        if not h:
            return (uni.get(w, 0) + S) / (N + S * (V + 1))
        lower = prob(h[1:], w)
        if h not in ctx_total:
            return lower
        return max(grams.get(h + (w,), 0) - D, 0) / ctx_total[h] + D * ctx_types[h] / ctx_total[h] * lower

    out = []
    for _, text in rows:
        t = toks(text)
        p = [""] * (ORDER - 1) + t
        base = sum(math.log10((uni.get(w, 0) + S) / (N + S * (V + 1))) for w in t)
        score = sum(math.log10(prob(tuple(p[i - ORDER + 1 : i]), p[i])) for i in range(ORDER - 1, len(p)))
        out.append((len(t), sum(w in uni for w in t), N, base, score))
    return out


def run(spark, rows):
    df = lm_score.score(docs(spark, rows).select("doc_id", "text"))
    got = df.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    return sorted(got, key=lambda r: (r.doc_id if r.doc_id is not None else -1, r.n_tokens))


def test_against_direct_model(spark):
    draw = random.Random(7)
    rows = [(i, " ".join(f"W{draw.randrange(12)}" for _ in range(draw.randrange(0, 30)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "w1 w1 w1 w1"), (63, "w1 w1 w1 w1")]
    want = dict(zip(range(len(rows)), plain(rows)))
    for r in run(spark, rows):
        n, k, N, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, k, N)
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert r.score == pytest.approx(score, rel=1e-9, abs=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)


def test_defined_cases(spark):
    assert lm_score.score(docs(spark, []).select("doc_id", "text")).count() == 0
    rows = [(None, "x y"), (None, "x y"), (3, None)]
    got = run(spark, rows)
    assert len(got) == 3
    assert [r.n_tokens for r in got] == [3, 3, 1]
    assert all(r.held_out is False for r in got)
    odd = with_odd_columns(docs(spark, [(1, "a b"), (2, "b a")]))
    out = lm_score.score(odd.withColumn("base_score", odd.doc_id).withColumn("_tk", odd.doc_id))
    assert out.count() == 2 and out.columns.count("base_score") == 1


def test_long_text_whole(spark):
    text = " ".join(f"w{i % 97}" for i in range(30_000))
    got = run(spark, [(1, text), (2, "w1 w2")])
    assert got[0].n_tokens == 30_001


def stored(spark):
    """Bytes of shuffle files that the executor holds, and their names."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    found = [files.apply(i) for i in range(files.size())]
    return {f.getName(): f.length() for f in found if f.getName().startswith("shuffle_")}


def test_disk_per_token(spark):
    draw = random.Random(3)
    rows = [(i, " ".join(f"w{int(draw.paretovariate(0.6))}" for _ in range(500))) for i in range(1_000)]
    frame = docs(spark, rows).select("doc_id", "text").repartition(2).cache()
    frame.count()
    before = stored(spark)
    done = lm_score.score(frame).collect()
    made = sum(size for name, size in stored(spark).items() if name not in before)
    frame.unpersist()
    assert sum(r.n_tokens for r in done) == 501_000
    assert 0 < made < 24 * 501_000  # 13.6 bytes a token; with a row for every token it was 219


def in_process(monkeypatch, rows, tasks, buckets):
    """The rounds without Spark: (doc_id, n_tokens, n_known, N, base, score) of each row."""
    from types import SimpleNamespace

    import pyarrow as pa
    from pyspark.sql.types import BooleanType, DoubleType, LongType, StructType

    asked = []
    for task in range(tasks):
        own = rows[task::tasks]
        held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in own]
        batch = pa.record_batch([pa.array([i for i, _ in own], pa.int64()), pa.array([t for _, t in own], pa.string()), pa.array(held)], ["doc_id", "text", "held_out"])
        monkeypatch.setattr(lm_score, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: task)))
        asked += lm_score._asking("text", "held_out", buckets)(batch.slice(at, 7) for at in range(0, len(own), 7))
    asked = pa.Table.from_batches(asked)

    def grouped(table):
        return {k: table.filter(pa.compute.equal(table.column("target"), k)) for k in set(table.column("target").to_pylist())}

    def sent(function, *tables):
        by_key = [grouped(t) for t in tables]
        none = asked.slice(0, 0)
        return pa.concat_tables(function((pa.scalar(k),), *(g.get(k, none) for g in by_key)) for k in set().union(*by_key))

    followers = sent(lm_score._followers, asked, sent(lm_score._holders, asked))
    schema = StructType().add("doc_id", LongType()).add("held_out", BooleanType())
    for name in lm_score.MADE[1:]:
        schema = schema.add(name, DoubleType() if name.endswith("score") else LongType())
    done = sent(lm_score._scoring(schema), asked, sent(lm_score._totals, asked, followers))
    blocks = len({k for k in asked.column("target").to_pylist() if k < 0})
    return blocks, done.select(["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]).to_pylist()


def test_many_blocks_and_ranges(monkeypatch):
    for name, value in (("BLOCK_TOKENS", 60), ("SORTED", 32), ("SLICE", 8), ("SENT_BYTES", 500)):
        monkeypatch.setattr(lm_score, name, value)
    draw = random.Random(5)
    rows = [(i, " ".join(f"W{int(draw.paretovariate(0.7))}" for _ in range(draw.randrange(0, 25)))) for i in range(150)]
    rows += [(i, "the same line in many texts") for i in range(150, 190)] + [(190, None), (191, ""), (192, "x" * 200)]
    blocks, got = in_process(monkeypatch, rows, 3, 5)
    assert blocks > 6
    want = plain(rows)
    assert sorted(r["doc_id"] for r in got) == list(range(len(rows)))
    for r in got:
        n, k, N, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, k, N)
        assert r["base_score"] == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert r["score"] == pytest.approx(score, rel=1e-9, abs=1e-9)


def test_packed_numbers():
    import numpy as np

    draw = np.random.default_rng(1)
    for size in (0, 1, 3, 5_000):
        arrays = [draw.integers(0, 1 << bits, size, dtype=np.uint64) for bits in (1, 9, 31, 48, 63)]
        arrays += [np.zeros(size, dtype=np.uint32), np.ones(size, dtype=np.uint8)]
        back = lm_score.unpacked(memoryview(lm_score.packed(*arrays)))
        assert len(back) == len(arrays)
        for a, b in zip(arrays, back):
            assert np.array_equal(a, b)


def test_other_columns_stay(spark):
    from pyspark.sql import functions as F

    frame = docs(spark, [(i, f"a b {i}") for i in range(30)])
    frame = frame.withColumn("at", F.timestamp_seconds(F.col("doc_id") * 86_400)).withColumn("list", F.array(F.col("doc_id"), F.lit(None)))
    frame = frame.withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang"))).withColumn("n", F.col("doc_id").cast("decimal(20,3)"))
    kept = ["doc_id", "lang", "source", "n_chars", "at", "list", "n"]
    got = lm_score.score(frame)
    assert got.columns == [*kept, "held_out", "n_tokens", "n_known", "base_score", "score", "train_tokens"]
    assert sorted(got.select(*kept).collect()) == sorted(frame.select(*kept).collect())
