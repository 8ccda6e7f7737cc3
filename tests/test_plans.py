"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from capweave.operators import archive as A
from capweave.operators import audit, crawl, store
from capweave.operators.extract import extract_links, resolve_links
from capweave.operators.ordering import ordered, with_rank
from capweave.operators.rules import dispatch
from capweave.operators.scratch import materialize
from capweave.operators.skew import pick
from capweave.plans import catalogue as C
from capweave.sources import sample_site as S


@pytest.fixture(scope="module")
def captures(spark, sf_dir):
    return materialize(S.captures(spark, sf_dir), "captures")


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def read_columns(text):
    return set(re.findall(r"(\w+):", " ".join(re.findall(r"ReadSchema: struct<(.*)>", text))))


def test_metadata_queries_leave_bodies_unread(captures):
    for df in (
        store.scan_metadata(captures),
        store.latest_keys(captures),
        audit.capture_counts(captures),
        dispatch(captures.drop("body"), C._config().rules),
    ):
        assert "body" not in read_columns(plan(df))
    assert read_columns(plan(store.latest_keys(captures))) == {"surt", "fetched_at", "capture_id"}


def test_filters_reach_the_scan(captures):
    assert "PushedFilters: [IsNotNull(status), EqualTo(status,200)]" in plan(captures.filter("status = 200"))


def test_routing_and_extraction_do_not_shuffle(captures):
    for df in (
        dispatch(captures, C._config().rules),
        resolve_links(extract_links(captures, C._config().rules, C._extractors())),
        A.records(captures),
    ):
        assert "Exchange" not in plan(df) and "Join" not in plan(df) and "Python" not in plan(df)


def test_counts_are_combined_before_the_shuffle(captures):
    assert plan(store.latest_keys(captures)).count("partial_max") > 0
    assert plan(audit.capture_counts(captures)).count("partial_count") > 0


def test_rank_has_no_single_partition_step(captures):
    ranked = with_rank(ordered(captures.select("surt", "fetched_at", "capture_id"), A.ORDER))
    assert "SinglePartition" not in plan(ranked) and "Window" not in plan(ranked)
    blocks = A.block_summary(
        A.cdx_blocks(ranked.drop("rank").withColumn("line", F.col("surt")))
    )
    assert "SinglePartition" not in plan(blocks)


def test_no_query_pairs_everything_with_everything(spark, sf_dir):
    for name in ("latest_capture", "body_lookup", "url_lookup", "unseen_frontier", "pages_extra", "all_links"):
        text = plan(C.CATALOGUE[name](spark, sf_dir))
        assert "CartesianProduct" not in text and "NestedLoopJoin" not in text, name


def test_host_edges_shuffle_once(captures):
    edges = crawl.crawl_edges(resolve_links(extract_links(captures, C.HTML_RULES)))
    assert len(re.findall(r"^\(\d+\) Exchange$", plan(crawl.host_edges(edges)), re.M)) == 1


def test_rows_that_are_not_wanted_are_not_shuffled(captures):
    ids = captures.select("capture_id").limit(3)
    picked = pick(captures, ids, "capture_id")
    assert picked.columns == captures.columns and picked.count() == 3
    joins = re.findall("Join .*", picked.select("capture_id", "body")._jdf.queryExecution().optimizedPlan().toString())
    assert ["getbit" in j for j in joins] == [False, True]  # the map comes before the join with the ids
    ids = captures.select("capture_id").filter("capture_id < '8'")
    assert sorted(pick(captures, ids, "capture_id").select("capture_id").collect()) == sorted(ids.collect())
    assert pick(captures, ids.limit(0), "capture_id").count() == 0
    assert "getbit" in plan(store.latest(captures)) and "getbit" in plan(store.distinct_bodies(captures))
    assert "getbit" in plan(store.append_new(captures.limit(5), captures))


def test_links_are_found_once_in_the_plan(spark, sf_dir):
    text = plan(C.CATALOGUE["all_links"](spark, sf_dir))
    assert text.count("<(?:!--") == 1
