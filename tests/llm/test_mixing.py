import random

from pyspark.sql import functions as F

from capweave.llm import mixing as M
from tests.llm.helpers import docs, sentence, with_odd_columns


def filled(sizes, weights=M.WEIGHTS, cap=M.MAX_EPOCHS):
    """Targets by clamping and sharing again, source by source."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    over, total = set(), sum(sizes)
    while True:
        left = total - sum(cap * sizes[i] for i in over)
        free = [i for i in range(len(sizes)) if i not in over]
        share = {i: left * weight[i] / sum(weight[j] for j in free) for i in free}
        new = {i for i in free if share[i] > cap * sizes[i]}
        if not new:
            return [float(cap * sizes[i]) if i in over else share[i] for i in range(len(sizes))]
        over |= new


def test_targets_and_words_taken(spark):
    draw = random.Random(1)
    rows = []
    for k, n in enumerate([400, 3, 60, 1, 90, 12, 30]):
        rows += [(1000 * k + i, sentence(draw, draw.randrange(1, 60)), f"s{k}") for i in range(n)]
    got = M.mix(docs(spark, rows)).withColumn("source", F.concat(F.lit("s"), F.floor(F.col("doc_id") / 1000))).collect()
    sizes = [sum(len(t.split()) for _, t, s in rows if s == f"s{k}") for k in range(7)]
    want = filled(sizes)
    for k in range(7):
        mine = [r for r in got if r.source == f"s{k}"]
        assert all(abs(r.target - want[k]) < 1e-6 and r.source_size == sizes[k] for r in mine)
        assert abs(sum(r.taken for r in mine) - want[k]) <= max(r.size for r in mine)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got) and len(got) == len(rows)
    again = M.mix(docs(spark, rows[::-1]).repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_the_mix_repeats_documents_as_often_as_it_takes_them(spark):
    draw = random.Random(2)
    rows = [(i, sentence(draw, 20), "a" if i < 90 else "b" if i < 96 else None) for i in range(100)]
    frame = docs(spark, rows)
    plan = {r.doc_id: r.taken // r["size"] for r in M.mix(frame).collect()}
    copies = {r.doc_id: r["count"] for r in M.mixed(frame).groupBy("doc_id").count().collect()}
    assert copies == {k: v for k, v in plan.items() if v}


def test_odd_rows(spark):
    rows = [(1, None, "a"), (1, "x y", "a"), (1, "x y", "a"), (None, "z", None), (2, "", "b"), (3, " \t\n", "b"), (4, "q " * 5000, "\U0001F600"), (5, "k l m", "￿")]
    frame = with_odd_columns(docs(spark, rows)).drop("size", "target", "taken")
    got = M.mix(frame)
    assert got.count() == len(rows) and got.filter("taken < 0 OR taken > 3 * size").count() == 0
    by_source = {r.source_size: r.target for r in got.collect()}
    # By code point: a, b, U+FFFF, U+1F600, then null.
    assert by_source[0] == 0.0 and by_source[1] <= 3 and abs(sum({s: t for s, t in by_source.items()}.values()) - 5008) < 1e-6
    assert M.mixed(frame).columns == frame.columns
    assert M.mix(frame.limit(0)).count() == 0 and M.mixed(frame.limit(0)).count() == 0
