import numpy as np
from pyspark.sql import functions as F

from capweave.llm import ann


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def nearest(x, ids, q, k=10):
    d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
    return [(int(ids[i]), d[i]) for i in order]


def test_recall_ranks_and_scores(spark):
    draw = np.random.default_rng(1)
    centres = draw.standard_normal((30, 16))
    x = (centres[draw.integers(0, 30, 4000)] + 0.4 * draw.standard_normal((4000, 16))).astype(np.float32)
    ids = draw.permutation(4000) * 3
    got = ann.search(frame(spark, [(int(i), v.tolist()) for i, v in zip(ids, x)]), F.col("vec_id") % 100 == 0).collect()
    wide, hits = x.astype(np.float64), 0
    queries = [q for q in ids if q % 100 == 0]
    for q in queries:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        want = nearest(wide, ids, q)
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert all(abs(r.score - np.sqrt(((wide[ids == q][0] - wide[ids == r.vec_id][0]) ** 2).sum())) < 1e-12 for r in mine)
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        hits += len({v for v, _ in want} & {r.vec_id for r in mine})
    assert hits / (10 * len(queries)) >= 0.95


def test_small_parts_and_one_vector_in_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART", 50)
    monkeypatch.setattr(ann, "QUERIES", 3)
    draw = np.random.default_rng(2)
    x = draw.standard_normal((900, 8))
    x[300:600] = x[300]
    x = x.astype(np.float32)
    got = ann.search(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]), F.col("vec_id") % 10 == 0).collect()
    mine = sorted((r for r in got if r.query_id == 310), key=lambda r: r["rank"])
    assert [(r.vec_id, r.score) for r in mine] == [(300 + i, 0.0) for i in range(10)]


def test_the_walk_finds_the_lists_that_a_scan_finds():
    draw = np.random.default_rng(3)
    centre, queries = draw.standard_normal((200, 12)), draw.standard_normal((50, 12))
    away = np.sqrt(((queries[:, None] - centre) ** 2).sum(2))
    want = set(zip(*np.nonzero(away <= away.min(1, keepdims=True) * (1 + ann.PRUNE))))
    got = set(zip(*ann.nearby_lists(queries, centre, ann.graph(centre))))
    assert len(got & want) / len(want) > 0.98 and len(got - want) <= 0.05 * len(want)


def test_recall_without_clusters(spark):
    draw = np.random.default_rng(5)
    x = draw.standard_normal((4000, 16)).astype(np.float32)
    got = ann.search(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]), F.col("vec_id") % 40 == 0).collect()
    wide, ids = x.astype(np.float64), np.arange(4000)
    found = {(r.query_id, r.vec_id) for r in got}
    want = {(int(q), v) for q in ids[::40] for v, _ in nearest(wide, ids, q)}
    assert len(found) == len(want) == 1000 and len(found & want) >= 950


def test_lists_needed_hold_the_neighbours(monkeypatch):
    monkeypatch.setattr(ann, "REPLICAS", 1)
    centre = np.array([[0.0], [10.0], [20.0], [30.0]])
    asked, none = np.array([[1.0]]), np.zeros(0, dtype=int)
    near = np.array([[0.5], [9.0], [21.0]])
    trial = np.zeros(3, dtype=int)
    assert ann.lists_needed(asked, none, none, trial, near, centre) == 3
    assert ann.lists_needed(asked, np.array([0]), np.array([2]), trial, near, centre) == 2
    assert ann.lists_needed(asked, none, none, trial[:0], near[:0], centre) == 0


def test_lists_are_balanced():
    draw = np.random.default_rng(4)
    sample = np.concatenate([0.01 * draw.standard_normal((3000, 4)) + 5, draw.standard_normal((500, 4))])
    centre = ann.fit(sample, 40)
    size = np.bincount(ann._squared(sample, centre).argmin(1), minlength=len(centre))
    assert size.max() <= 4 * len(sample) / 40


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0]), (100, [0.0, 0.0]), (200, None), (300, [float("nan"), 1.0]), (400, [1.0, None]), (500, []), (600, [1.0]),
        (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [float("inf"), 0.0]), (None, [1.0, 0.0]), (700, [1.0, 1.0]),
    ]
    vectors = frame(spark, rows).selectExpr("*", "'mine' AS v", "1 AS list", "1 AS part", "2 AS block", "0.5 AS score")
    got = ann.search(vectors, F.col("vec_id") % 100 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [
        (0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 700, 1.0), (700, 1, 1, 0.0), (700, 2, 2, 0.0), (700, 3, 0, 1.0),
    ]
    assert ann.search(vectors.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.search(vectors.filter("vec_id = 0"), F.col("vec_id") % 100 == 0).count() == 0
