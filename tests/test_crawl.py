import random

import pytest
from pyspark.sql import functions as F

from capweave.functions.urls import hop_cost, surt
from capweave.operators import crawl
from capweave.sources import sample_site as S

EDGE = "src_surt string, src_url string, surt string, url string, cost int"


def frame(spark, edges):
    return spark.createDataFrame([(a, f"u:{a}", b, f"u:{b}", c) for a, b, c in edges], EDGE)


def seeds(spark, *keys):
    return spark.createDataFrame([(k, f"u:{k}") for k in keys], "surt string, url string")


def shortest(edges, start, max_hops, closed=()):
    best, frontier = {s: (0, 0) for s in start}, set(start)
    while frontier:
        found = {}
        for a, b, c in edges:
            if a in frontier and not (a in closed and a not in start):
                d = (best[a][0] + c, best[a][1] + 1)
                if d[0] <= max_hops and d < min(best.get(b, (99, 0)), found.get(b, (99, 0))):
                    found[b] = d
        best.update(found)
        frontier = set(found)
    return best


def reached(df):
    return {r["surt"]: (r["hops"], r["steps"]) for r in df.collect()}


def random_edges(seed, n=40, m=90):
    rnd = random.Random(seed)
    hub = [("n0", f"n{i}", i % 2) for i in range(1, 15)]
    return hub + [(f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}", rnd.randrange(2)) for _ in range(m)]


@pytest.mark.parametrize("small,heavy", [(20_000, 1_000_000), (0, 1_000_000), (20_000, 5), (0, 5)])
def test_reach_equals_brute_force(spark, monkeypatch, small, heavy):
    monkeypatch.setattr(crawl, "_SMALL_FRONTIER", small)
    monkeypatch.setattr(crawl, "_STRIDES", 3)
    edges = random_edges(7)
    got = reached(crawl.reach(frame(spark, edges), seeds(spark, "n0", "n30"), 1, heavy_rows=heavy))
    assert got == shortest(edges, ["n0", "n30"], 1)


def test_resume_does_not_expand_stored_keys(spark):
    edges = [("s", "a", 0), ("a", "b", 0), ("s", "c", 0), ("c", "d", 1), ("b", "s", 0)]
    stored = seeds(spark, "a", "s")
    got = reached(crawl.reach(frame(spark, edges), seeds(spark, "s"), 1, stored=stored))
    assert got == shortest(edges, ["s"], 1, closed={"a", "s"}) and "b" not in got


def test_round_limit_is_loud(spark, monkeypatch):
    monkeypatch.setattr(crawl, "_SMALL_FRONTIER", 0)
    chain = [(f"n{i}", f"n{i + 1}", 0) for i in range(6)]
    with pytest.raises(crawl.RoundLimit):
        crawl.reach(frame(spark, chain), seeds(spark, "n0"), 0, max_rounds=3)


def test_tree_leads_back_to_seeds(spark):
    edges = random_edges(3) + [("n1", "n2", 0), ("n2", "n1", 0)]
    df, start = frame(spark, edges), seeds(spark, "n0")
    found = crawl.reach(df, start, 2)
    tree = {r["surt"]: r for r in crawl.discovery_tree(df, found, start).collect()}
    best = shortest(edges, ["n0"], 2)
    assert {k: (r["hops"], r["steps"]) for k, r in tree.items()} == best
    for key in tree:
        for _ in range(len(tree)):
            key = tree[key]["parent_surt"]
        assert key == "n0"


def test_reach_of_the_sample_site(spark, sf_dir):
    pages = S.read_pages(spark, sf_dir).withColumn("url", S.normalize_url(F.col("url")))
    a, b = pages.select("page_id", "url"), pages.select("page_id", "url")
    edges = (
        S.link_edges(pages)
        .join(a.toDF("src_page", "src_url"), "src_page")
        .join(b.toDF("dst_page", "url"), "dst_page")
        .select(
            F.col("src_page").cast("string").alias("src_surt"),
            "src_url",
            F.col("dst_page").cast("string").alias("surt"),
            "url",
            hop_cost(F.col("src_url"), F.col("url")).alias("cost"),
        )
    ).persist()
    start = pages.filter("page_id = 0").select(F.col("page_id").cast("string").alias("surt"), "url")
    counts = [crawl.reach(edges, start, hops).count() for hops in range(4)]
    assert counts == [1, 8, 21, 28]
    assert pages.select(surt(F.col("url"))).distinct().count() == 49


def test_rounds_leave_out_keys_that_lead_nowhere(spark, monkeypatch):
    """Such keys are most of a site: each gets its distance in one pass after the rounds."""
    edges = [(f"n{i}", f"n{i + 1}", 0) for i in range(4)] + [(f"n{i}", f"leaf{i}-{k}", k % 2) for i in range(4) for k in range(30)]
    edges += edges[:3]
    moved, write = [], crawl._written
    monkeypatch.setattr(crawl, "_written", lambda df, label: (lambda made: moved.append(made[1]) or made)(write(df, label)))
    got = reached(crawl.reach(frame(spark, edges), seeds(spark, "n0", "leaf3-1"), 1))
    assert got == shortest(edges, ["n0", "leaf3-1"], 1)
    assert len(got) == 4 + 1 + 4 * 30 and sum(moved) <= 6
