import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from capweave.llm import toxicity as T
from tests.llm.helpers import docs, sentence, with_odd_columns

BAD = ["vile", "rotten", "filthy", "nasty", "crooked"]


def corpus(n=1500, seed=1):
    draw, rows, marks = random.Random(seed), [], []
    for i in range(n):
        words, toxic = sentence(draw, draw.randrange(5, 200), 5000).split(), draw.random() < 0.12
        if toxic:
            for _ in range(draw.randrange(1, 4)):
                words.insert(draw.randrange(len(words)), draw.choice(BAD) + draw.choice(["", ".", ","]))
        rows.append((i, " ".join(words)))
        if i % 2:
            marks.append((i, int(toxic)))
    return rows, marks


def test_held_out_accuracy_and_inputs(spark):
    rows, marks = corpus()
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = {r.doc_id: r for r in T.toxicity(docs(spark, rows), labels).collect()}
    held = [(got[i], y) for i, y in marks if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(r.held_out for r, _ in held) and sum(r.held_out for r in got.values()) == sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in got)
    right = sum(r.predicted == y for r, y in held)
    assert right / len(held) > 0.97 and all(0 <= r.score <= 1 and r.predicted == (r.score >= T.THRESHOLD) for r in got.values())
    # Held-out labels play no part in a score.
    other = labels.withColumn("toxic", F.when(T.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in T.toxicity(docs(spark, rows), other).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in got.items())


def test_the_risk_estimator_learns_without_negatives():
    import numpy as np

    draw = np.random.default_rng(2)
    known = np.sort(draw.choice(1 << 40, 60, replace=False).astype(np.uint64))

    def side(n, share):
        toxic = draw.random(n) < share
        text = np.repeat(np.arange(n), 6)
        pick = np.where(np.repeat(toxic, 6) & (draw.random(n * 6) < 0.5), draw.integers(0, 5, n * 6), draw.integers(5, 60, n * 6))
        packed = np.unique(text * 64 + pick)
        return (packed // 64, known[packed % 64], n), toxic

    (p, _), (u, toxic) = side(400, 1.0), side(2000, 0.2)
    hashes, w, b = T.fit(p, u, 0.2)
    assert set(hashes) <= set(known[:5]) and (w > 0).all()
    z = np.bincount(u[0], np.where(np.isin(u[1], hashes), 3.0, 0.0), u[2])
    assert abs((1 / (1 + np.exp(-(np.bincount(u[0], [dict(zip(hashes, w)).get(h, 0) for h in u[1]], u[2]) + b)))).mean() - 0.2) < 0.01
    assert ((z > 0) == toxic).mean() > 0.95


def test_odd_rows(spark):
    rows, marks = corpus(300)
    rows += [(1001, None), (1002, ""), (1003, " \n"), (None, "vile"), (1004, "vile " * 30_000), (5, "again")]
    frame = with_odd_columns(docs(spark, rows)).drop("score", "predicted", "held_out")
    labels = spark.createDataFrame([*marks, (1, None), (None, 1), (99_999, 1), (5, 1), (5, 0)], "doc_id long, toxic int")
    out = T.toxicity(frame, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    empty = {r.score for r in out if r.doc_id in (1001, 1002, 1003)}
    assert len(empty) == 1
    for none in (labels.limit(0), labels.filter("toxic = 0")):
        assert {r.predicted for r in T.toxicity(frame, none).collect()} == {0}
    assert T.toxicity(frame.limit(0), labels).count() == 0


def test_features_hold_little_memory_at_a_time():
    """Workers of several operators live side by side in an executor, so each may only hold a chunk's numbers."""
    import tracemalloc

    import pyarrow as pa

    texts = pa.array([sentence(random.Random(3), 2000, 5000)] * 600)
    assert texts.nbytes > 6 << 20
    tracemalloc.start()
    found = sum(n for _, n, _, _ in T.features(texts, T.flags_of(np.zeros(0, dtype=np.uint64))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 600 and peak < 100e6, peak
