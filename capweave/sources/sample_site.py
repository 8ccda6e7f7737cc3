"""A crawled site derived from the test tables.

``pages`` gives the documents and ``events`` the fetches.  Everything is a pure
function of those two tables, so the same rows can be rebuilt in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capweave.functions.urls import host_of, normalize_url, surt

_NEIGHBOURS = 4096  # pages per block within which "next page of the host" looks
_HEADER_TYPE = "array<struct<name:string,value:string>>"
_VERSIONS = ["HTTP/0.9", "HTTP/1.0", "HTTP/1.1", "HTTP/2.0", "HTTP/3.0"]


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def link_edges(pages: DataFrame) -> DataFrame:
    """(src_page, dst_page): two pages by arithmetic and the next page of the host."""
    n = pages.count()
    near = Window.partitionBy("_host", F.expr(f"page_id div {_NEIGHBOURS}")).orderBy("page_id")
    following = F.lead("page_id").over(near)
    by_rule = [F.expr(f"(3 * page_id + 1) % {n}"), F.expr(f"(5 * page_id + 2) % {n}")]
    return (
        pages.select("page_id", host_of(F.lower("url")).alias("_host"))
        .withColumn("_next", following)
        .select(
            F.col("page_id").alias("src_page"),
            F.explode(F.array_distinct(F.array_compact(F.array(*by_rule, F.col("_next"))))).alias("dst_page"),
        )
    )


_MARK = "§"


def _numbered(template: str) -> Column:
    return F.replace(F.lit(template), F.lit(_MARK), F.col("page_id").cast("string"))


# Markup added to every page; "§" stands for the page number.
HEAD = (
    '<link rel="stylesheet" href="/style/§.css"><script src="/js/§.js"></script>'
    "<style>.b§{background:url(/bg/§.png)}.i{background:url(data:image/gif;base64,R0lGOD)}</style>"
    "<script>/* @edition(r§) @pic(/leaf/p§.png) @pic(\\u002Fleaf\\u002Fq§.jpg) @parts<x§|y§|x§>as js; */</script>"
)
FOOT = (
    '<img alt="" src="img/../i/§.png?a=1&amp;b=2"><!-- <a href="/hidden/§">no</a> -->'
    "<A HREF=/loud/§>x</A><a class=\"q\" href='?page=§'>q</a><a href=\"#top\">top</a>"
    '<a href="//cdn.example.com/p/./§">c</a><a href="mailto:a@example.com">m</a><a href="">e</a>'
)
STYLESHEET = (
    "@import url(\"/css/base.css\");.a§{background:url('/bg/§a.png')}"
    ".b§{background:url(../bg/§b.png)}.c§{background:url(data:image/png;base64,iVBORw0)}"
)


def site(pages: DataFrame) -> DataFrame:
    """Documents and stylesheets: (page_id, url, content_type, text)."""
    targets = pages.select(F.col("page_id").alias("dst_page"), F.col("url").alias("dst_url"))
    # At most three links per page, so the list per group is bounded.
    linked = (
        link_edges(pages)
        .join(targets, "dst_page")
        .groupBy("src_page")
        .agg(F.array_sort(F.collect_list(F.struct("dst_page", "dst_url"))).alias("_to"))
        .withColumnRenamed("src_page", "page_id")
    )
    anchors = F.array_join(
        F.transform("_to", lambda t: F.concat(F.lit('<a href="'), t["dst_url"], F.lit('">next</a>'))), ""
    )
    documents = pages.join(linked, "page_id", "left").select(
        "page_id",
        normalize_url(F.col("url")).alias("url"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.concat(
            F.replace(F.col("html"), F.lit("</head>"), F.concat(_numbered(HEAD), F.lit("</head>"))),
            _numbered(FOOT),
            F.coalesce(anchors, F.lit("")),
        ).alias("text"),
    )
    return documents.unionByName(stylesheets(pages))


def stylesheets(pages: DataFrame) -> DataFrame:
    origin = F.regexp_extract(normalize_url(F.col("url")), "^https?://[^/?#]*", 0)
    return pages.select(
        "page_id",
        F.concat(origin, F.lit("/style/"), F.col("page_id"), F.lit(".css")).alias("url"),
        F.lit("text/css").alias("content_type"),
        _numbered(STYLESHEET).alias("text"),
    )


def _uuid(text: Column) -> Column:
    return F.regexp_replace(F.md5(text), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def _headers(content_type: Column) -> Column:
    server = F.struct(F.lit("Server").alias("name"), F.lit("sample").alias("value"))
    kind = F.struct(F.lit("Content-Type").alias("name"), content_type.alias("value"))
    return F.when(content_type.isNull(), F.array(server)).otherwise(F.array(kind, server)).cast(_HEADER_TYPE)


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is one fetch: of a document, of a stylesheet, or a failure.

    Columns a query does not read are pruned together with the joins' wide
    payload, so metadata queries read no page text.
    """
    pages, events = read_pages(spark, sf_dir), read_events(spark, sf_dir)
    n = pages.count()
    is_css, is_error = F.col("event_type") == "purchase", F.col("event_type") == "error"
    fetch = events.withColumn("page_id", F.col("event_id") % n).withColumn(
        "content_type",
        F.when(is_css, "text/css").when(~is_error, "text/html; charset=utf-8"),
    ).withColumn("_kind", F.when(is_css, "text/css").otherwise("text/html; charset=utf-8"))
    text = site(pages).withColumnRenamed("content_type", "_kind")
    got = fetch.join(text, ["page_id", "_kind"])
    return _as_captures(
        got.withColumn("text", F.when(is_error, F.lit("")).otherwise(F.col("text"))),
        key=F.concat(F.lit("capture-"), F.col("event_id")),
        at=F.col("ts"),
        number=F.col("event_id"),
        status=F.when(is_error, 500).otherwise(200),
        remote=F.when(
            F.col("user_id") % 10 != 0,
            F.concat(
                F.lit("10.0."), F.expr("user_id div 256"), F.lit("."), F.col("user_id") % 256, F.lit(":443")
            ),
        ),
    )


def site_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One successful capture of every document and stylesheet."""
    rows = site(read_pages(spark, sf_dir))
    return _as_captures(
        rows,
        key=F.concat(F.lit("site-"), F.col("content_type"), F.lit("-"), F.col("page_id")),
        at=F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"),
        number=F.lit(0),
        status=F.lit(200),
        remote=F.lit(None).cast("string"),
    )


def _as_captures(
    rows: DataFrame, key: Column, at: Column, number: Column, status: Column, remote: Column
) -> DataFrame:
    body = F.encode(F.col("text"), "UTF-8")
    version = F.element_at(F.array(*[F.lit(v) for v in _VERSIONS]), (number % 5 + 1).cast("int"))
    return rows.select(
        _uuid(key).alias("capture_id"),
        surt(F.col("url")).alias("surt"),
        "url",
        F.col("url").alias("discovered_in"),
        (number % 4).cast("int").alias("hops"),
        at.alias("fetched_at"),
        status.cast("int").alias("status"),
        version.alias("http_version"),
        _headers(F.col("content_type")).alias("headers"),
        remote.alias("remote_addr"),
        body.alias("body"),
        F.sha2(body, 256).alias("body_digest"),
    )
