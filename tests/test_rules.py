from pyspark.sql import functions as F

from capweave.functions.markup import html_links
from capweave.operators import extract as X
from capweave.operators.rules import Rule, dispatch
from capweave.plans.session import ship_package
from capweave.sources import sample_site as S
from capweave.sources.config import parse_config

SCHEMA = (
    "capture_id string, surt string, url string, hops int, "
    "headers array<struct<name:string,value:string>>, body binary"
)


def capture(ident, url, kind, body):
    headers = [("Content-Type", kind)] if kind else []
    return (ident, f"key-{ident}", url, 0, headers, body.encode())


def frame(spark, *rows):
    return spark.createDataFrame([capture(*r) for r in rows], SCHEMA)


def test_config():
    cfg = parse_config(
        """
        [general]
        max_hops = 3
        [http]
        timeout = "100s"
        [ratelimiter]
        n = 60
        per = "second"
        [scripts.zz]
        filter = { mime_types = ["text/html"] }
        [scripts.aa]
        filter = { url_pattern = '/\\d+$' }
        extractor = "css"
        """
    )
    assert cfg.max_hops == 3 and cfg.max_body_length is None and cfg.quota == (60, "second")
    assert [(r.name, r.extractor, r.url_pattern, r.mime_types) for r in cfg.rules] == [
        ("aa", "css", "/\\d+$", ()),
        ("zz", "zz", None, ("text/html",)),
    ]


def test_capture_goes_to_every_matching_rule(spark):
    df = frame(
        spark,
        ("1", "http://a/12", "text/html", ""),
        ("2", "http://a/x", "text/html; charset=utf-8", ""),
        ("3", "http://a/12", None, ""),
        ("4", "http://a/12", "image/png", ""),
    )
    rules = [
        Rule("number", "x", r"/\d+$", ("text/html",)),
        Rule("html", "x", None, ("text/*",)),
        Rule("none", "x", None, ()),
    ]
    got = sorted((r["capture_id"], r["rule"]) for r in dispatch(df, rules).collect())
    assert got == [("1", "html"), ("1", "number"), ("2", "html"), ("3", "html"), ("3", "none"), ("3", "number")]


def test_extract_and_resolve(spark):
    df = frame(
        spark,
        ("1", "http://a.com/d/", "text/html", '<a href="x?q=1">1</a><a href="mailto:z@z"><a href="http://b.com">'),
        ("2", "http://a.com/s.css", "text/css", "a{b:url(i.png)}"),
    )
    rules = [Rule("h", "html", None, ("text/html",)), Rule("c", "css", None, ("text/css",))]
    links = X.resolve_links(X.extract_links(df, rules))
    got = sorted((r["rule"], r["pos"], r["url"], r["surt"], r["cross_host"], r["hops"]) for r in links.collect())
    assert got == [
        ("c", 0, "http://a.com/i.png", "com,a)/i.png", False, 0),
        ("h", 0, "http://a.com/d/x?q=1", "com,a)/d/x?q=1", False, 0),
        ("h", 2, "http://b.com/", "com,b)/", True, 1),
    ]
    assert X.within_hops(links, 0).count() == 2


def test_python_extractor_sees_header_and_bytes(spark):
    ship_package(spark)
    df = frame(spark, ("1", "http://a.com/", None, "päge")).select(
        "*",
        F.lit("http://s/").alias("discovered_in"),
        F.lit(200).alias("status"),
        F.lit("HTTP/1.1").alias("http_version"),
        F.lit(None).cast("string").alias("remote_addr"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("fetched_at"),
    )
    known = X.Extractors()
    known.add_python("mine", lambda header, body: [f"/{header['id']}/{header['status']}/{len(body)}"])
    got = X.extract_links(df, [Rule("r", "mine", None, ("x/y",))], known).collect()
    assert [(r["rule"], r["raw"]) for r in got] == [("r", "/1/200/5")]


def test_patterns_merge_equal_links(spark):
    text = "@parts<h1|h2|h1>as css; @pic(\\u002Fp\\u002F1.png)"
    specs = [
        X.PatternSpec("asset", r"@parts<([^<>]*)>as (css|js);", "/z/{value}.{suffix}", r"([^|]+)"),
        X.PatternSpec("pic", r"@pic\(([^()]*)\)", "//i.com{value}"),
    ]
    row = spark.createDataFrame([(text,)], "t string").select(X.pattern_extractor(specs)(F.col("t"))).first()[0]
    assert [(r["kind"], r["raw"]) for r in row] == [
        ("asset", "/z/h1.css"), ("asset", "/z/h2.css"), ("pic", "//i.com/p/1.png"),
    ]


def test_subresources_keep_missing(spark):
    links = spark.createDataFrame(
        [("1", "script", "k1"), ("1", "script", "gone"), ("2", "a", "k1")], "capture_id string, kind string, surt string"
    )
    stored = spark.createDataFrame([("t", "k1", 200, b"x")], "capture_id string, surt string, status int, body binary")
    for heavy in (1_000_000, 0):
        got = X.subresources(links, stored, ("script",), heavy_rows=heavy).collect()
        assert sorted((r["surt"], r["target_id"]) for r in got) == [("gone", None), ("k1", "t")]


def test_no_rules_give_no_links(spark):
    assert X.extract_links(frame(spark, ("1", "http://e.com/", "text/html", "<a href=x>")), []).count() == 0


def test_a_target_is_resolved_once(spark):
    links = X.extract_links(frame(spark, ("1", "http://e.com/", "text/html", "<a href=x>")), [Rule("r", "html", None, ("text/html",))])
    plan = X.resolve_links(links)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("%2e%2e") == X.resolve_links(links).select("url")._jdf.queryExecution().optimizedPlan().toString().count("%2e%2e")
    assert not [line for line in plan.splitlines() if "Filter" in line and "%2e%2e" in line]
