"""The registered queries: each operator over the derived site."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capweave.functions import http as H
from capweave.functions import markup as M
from capweave.functions.urls import surt
from capweave.operators import archive as A
from capweave.operators import audit, crawl, store
from capweave.operators import extract as X
from capweave.operators.ordering import ordered, with_rank
from capweave.operators.rules import Rule, dispatch, filter_by_rule
from capweave.operators.scratch import materialize, scratch_path
from capweave.plans.export import export_package
from capweave.plans.replay import replay
from capweave.plans.session import ship_package
from capweave.sources import sample_site as S
from capweave.sources import snapshots, store_files
from capweave.sources.config import parse_config
from capweave.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
CATALOGUE: dict[str, Query] = {}

# Parameters shared with the SQL twins of the queries.
MAX_HOPS = 1
SEED_MARK = "utm_source=feed"  # pages announced in a feed are the seeds
BODY_LIMIT = 4000
FILE_THRESHOLD = 1_000_000
RATE = ("minute", 1)
CONFIG = """
[general]
max_hops = 1

[http]
timeout = "100s"
max_body_length = 4000

[ratelimiter]
n = 1
per = "minute"

[scripts.links]
filter = { mime_types = ["text/css"] }
extractor = "css"

[scripts.page_rule]
filter = { mime_types = ["text/html"], url_pattern = '/\\d+$' }
extractor = "patterns"

[scripts.scrape_html]
filter = { mime_types = ["text/html"] }
extractor = "html"
"""
# The sample site's own conventions: a list of parts after "@parts", and pictures after "@pic".
PATTERNS = (
    X.PatternSpec("part", r"@parts<([^<>]*)>as (css|js);", "/parts/{value}.{suffix}", item=r"([^|]+)"),
    X.PatternSpec("picture", r"@pic\(([^()]*)\)", "//img.example.com{value}"),
)
TEMPLATES = ("/leaf/{page}", "/leaf/{page}/at-{edition}/text.json", "/leaf/{page}/at-{edition}/notes.json")
TEMPLATE_FIELDS = {"page": ("url", r"/(\d+)"), "edition": ("text", r"@edition\(([^()]+)\)")}
HTML_RULES = (Rule("scrape_html", "html", None, ("text/html",)), Rule("links", "css", None, ("text/css",)))


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    CATALOGUE[fn.__name__] = run
    return fn


def _config():
    return parse_config(CONFIG)


def _replay_config():
    """No size limit and the two plain rules."""
    return replace(_config(), max_body_length=None, rules=HTML_RULES)


def _extractors() -> X.Extractors:
    known = X.Extractors()
    known.add("patterns", X.pattern_extractor(PATTERNS))
    return known


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.seed_urls(_raw_seeds(spark, sf_dir))


def _raw_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    announced = S.read_pages(spark, sf_dir).filter(F.contains("url", F.lit(SEED_MARK)))
    return announced.select(F.col("url").alias("raw_url"))


def _entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.crawl_info(_seeds(spark, sf_dir), _config().as_json)


def _site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(S.site_captures(spark, sf_dir))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.extract_links(_site(spark, sf_dir), HTML_RULES)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.crawl_edges(X.resolve_links(_links(spark, sf_dir)))


# Store


@query
def capture_scan(spark, sf_dir):
    scanned = store.scan_metadata(S.captures(spark, sf_dir))
    return scanned.select(
        "capture_id", "surt", "url", "discovered_in", "hops", "status", "http_version", "remote_addr",
        H.rfc3339_time(F.col("fetched_at")).alias("fetched_at"),
        F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit("="), h["value"])), ";").alias("headers"),
    )


@query
def latest_capture(spark, sf_dir):
    now = store.latest(S.captures(spark, sf_dir))
    return now.select("surt", "capture_id", "url", "status", "body_digest")


@query
def body_dedup(spark, sf_dir):
    return store.duplicate_bodies(S.captures(spark, sf_dir))


@query
def body_lookup(spark, sf_dir):
    captures = S.captures(spark, sf_dir)
    # The bodies of failed fetches are not kept, so those captures find none.
    # Written down, as the addresses are read several times and each reading would hash every body.
    narrow = materialize(captures.select("capture_id", "status", "body_digest"), "addresses")
    kept = F.col("status") == 200
    bodies = store.distinct_bodies(captures.filter(kept), narrow.filter(kept))
    found = store.attach_bodies(narrow, bodies)
    return found.select("capture_id", F.octet_length("body").cast("long").alias("body_bytes"))


@query
def url_lookup(spark, sf_dir):
    pages = S.read_pages(spark, sf_dir)
    requests = pages.select(
        F.col("page_id").alias("request_id"),
        F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "^http://", "https://www7."))
        .when(F.col("page_id") % 3 == 1, F.concat("url", F.lit("#part")))
        .otherwise(F.concat(F.regexp_extract("url", "^https?://[^/]*", 0), F.lit("/style/"), "page_id", F.lit(".css")))
        .alias("request_url"),
    )
    stored = store.latest(S.captures(spark, sf_dir)).select("surt", "capture_id", "status")
    return store.lookup(requests, stored).select("request_id", "surt", "capture_id", "status")


@query
def no_clobber_append(spark, sf_dir):
    captures = S.captures(spark, sf_dir)
    old, new = captures.filter("hops < 2"), captures.filter("hops >= 2")
    return store.append_new(old, new).select("surt", "capture_id", "status")


@query
def stored_captures(spark, sf_dir):
    captures = S.captures(spark, sf_dir)
    root = scratch_path(spark, "store")
    store_files.write_store(captures.filter("hops = 0"), root)
    store_files.append_store(captures.filter("hops > 0"), root)
    found = store.attach_bodies(store_files.read_index(spark, root), store_files.read_bodies(spark, root))
    return found.select("surt", "capture_id", "status", F.octet_length("body").cast("long").alias("body_bytes"))


@query
def store_snapshots(spark, sf_dir):
    """Three snapshots of one store: seeds' captures, all captures with seeds replaced, failed keys deleted.

    Every version is read back after the last commit, so each reader sees only its own snapshot.
    """
    captures = S.captures(spark, sf_dir)
    root = scratch_path(spark, "versioned-store")
    first = snapshots.write(captures.filter("hops <= 1"), root, crawl=_entry_points(spark, sf_dir))
    second = snapshots.write(captures, root, mode="no_clobber", seeds=_seeds(spark, sf_dir))
    third = snapshots.delete(spark, root, captures.filter("status <> 200").select("surt"))
    read = [
        snapshots.read_index(spark, root, v).select(F.lit(v).alias("version"), "surt", "capture_id", "status")
        for v in (first, second, third)
    ]
    return read[0].unionByName(read[1]).unionByName(read[2])


@query
def store_crawl_info(spark, sf_dir):
    """Crawl info written with the first snapshot and read back from the last."""
    root = scratch_path(spark, "versioned-store")
    snapshots.write(S.captures(spark, sf_dir).filter("hops = 0"), root, crawl=_entry_points(spark, sf_dir))
    last = snapshots.delete(spark, root, _seeds(spark, sf_dir).select("surt"))
    info = snapshots.read_crawl_info(spark, root, last)
    return info.select(
        "entry_point", F.get_json_object("config", "$.general.max_hops").cast("int").alias("max_hops"),
        F.lit(last).alias("version"),
    )


@query
def seed_invalidate(spark, sf_dir):
    kept = store.invalidate(store.scan_metadata(S.captures(spark, sf_dir)), _seeds(spark, sf_dir))
    return kept.select("capture_id", "surt")


@query
def entry_points(spark, sf_dir):
    return _entry_points(spark, sf_dir).select(
        "entry_point", F.get_json_object("config", "$.general.max_hops").cast("int").alias("max_hops")
    )


@query
def capture_versions(spark, sf_dir):
    return store.versions(S.captures(spark, sf_dir)).select("surt", "capture_id", "version")


@query
def unseen_frontier(spark, sf_dir):
    frontier = X.within_hops(X.resolve_links(_links(spark, sf_dir)), MAX_HOPS).withColumn(
        "discovered_in", F.col("src_url")
    )
    return store.unseen(frontier, _site(spark, sf_dir)).select("surt", "url", "discovered_in", "hops")


# URL, header and record functions


@query
def surt_key(spark, sf_dir):
    raw = S.read_pages(spark, sf_dir).select(
        "page_id",
        F.explode(
            F.array(
                F.col("url"),
                F.concat(
                    F.regexp_replace("url", "[?#].*$", ""),
                    F.lit("?D="), F.col("page_id"), F.lit("&CC=Ab+c&EE&a=%C3%9C&cc="), F.col("page_id"), F.lit("#x"),
                ),
                F.regexp_replace("url", "^https?://([^/]*)", "https://www3.$1:8443"),
            )
        ).alias("raw_url"),
    )
    return raw.withColumn("url", S.normalize_url(F.col("raw_url"))).select(
        "page_id", "url", surt(F.col("url")).alias("surt")
    )


@query
def seeds(spark, sf_dir):
    url, page = F.col("url"), F.col("page_id")
    raw = S.read_pages(spark, sf_dir).select(
        F.when(page % 4 == 0, F.concat(F.lit("  "), url, F.lit("\n")))
        .when(page % 4 == 1, F.regexp_replace(url, "^https?://", ""))
        .when(page % 4 == 2, F.regexp_replace(url, "^https?://", "HTTP://"))
        .otherwise(F.concat(F.lit("ftp://"), page))
        .alias("raw_url")
    )
    return store.seed_urls(raw)


@query
def resolve_links(spark, sf_dir):
    return X.resolve_links(_links(spark, sf_dir)).select("src_url", "kind", "pos", "raw", "url", "surt")


@query
def hop_count(spark, sf_dir):
    resolved = X.resolve_links(_links(spark, sf_dir))
    return resolved.select("src_surt", "kind", "pos", "url", "cross_host", "hops")


@query
def mime_of(spark, sf_dir):
    return S.captures(spark, sf_dir).select("capture_id", H.mime(F.col("headers")).alias("mime"))


@query
def mime_range_match(spark, sf_dir):
    kind = H.mime(F.col("headers"))
    ranges = F.split(F.element_at(F.array(F.lit("text/html"), F.lit("text/*,image/png"), F.lit("image/*"), F.lit("*/*")), F.col("hops") + 1), ",")
    return S.captures(spark, sf_dir).select(
        "capture_id",
        H.mime_in(kind, ranges).alias("by_column"),
        H.mime_matches(kind, ("text/css", "image/*")).alias("by_config"),
        H.mime_matches(kind, ()).alias("by_empty"),
    )


@query
def block_digest(spark, sf_dir):
    return A.records(S.captures(spark, sf_dir)).select("capture_id", "digest")


@query
def capture_times(spark, sf_dir):
    at = F.col("fetched_at")
    return S.captures(spark, sf_dir).select(
        "capture_id", H.cdx_time(at).alias("cdx_time"), H.rfc3339_time(at).alias("rfc3339_time")
    )


@query
def warc_protocol(spark, sf_dir):
    return S.captures(spark, sf_dir).select(
        "capture_id", "http_version", H.protocol_label(F.col("http_version")).alias("protocol"),
        H.ip_of(F.col("remote_addr")).alias("ip"),
    )


@query
def http_block(spark, sf_dir):
    head = H.http_head(F.col("http_version"), F.col("status"), F.col("headers"))
    block = H.http_block(F.col("http_version"), F.col("status"), F.col("headers"), F.col("body"))
    return S.captures(spark, sf_dir).select(
        "capture_id", head.alias("head"), F.octet_length(block).cast("long").alias("block_length")
    )


# Filters


@query
def rule_filter(spark, sf_dir):
    rule = next(r for r in _config().rules if r.name == "page_rule")
    return filter_by_rule(S.captures(spark, sf_dir), rule).select("capture_id", "url")


@query
def rule_dispatch(spark, sf_dir):
    return dispatch(S.captures(spark, sf_dir), _config().rules).select("capture_id", "rule")


@query
def max_hops_filter(spark, sf_dir):
    kept = X.within_hops(X.resolve_links(_links(spark, sf_dir)), 0)
    return kept.select("src_surt", "kind", "pos", "url", "hops")


@query
def body_limit(spark, sf_dir):
    kept, failed = store.split_by_size(S.captures(spark, sf_dir), _config().max_body_length)
    none = F.lit(None).cast("string").alias("error")
    return kept.select("capture_id", none).unionByName(failed.select("capture_id", "error"))


@query
def error_counts(spark, sf_dir):
    _, failed = store.split_by_size(S.captures(spark, sf_dir), _config().max_body_length)
    return audit.error_counts(failed)


# Link extraction


@query
def html_links(spark, sf_dir):
    found = X.extract_column(_site(spark, sf_dir), M.html_links)
    return found.filter(F.col("kind") != "style").select("url", "kind", "pos", "raw")


@query
def style_links(spark, sf_dir):
    found = X.extract_column(_site(spark, sf_dir), M.html_links)
    return found.filter(F.col("kind") == "style").select("url", "pos", "raw")


@query
def css_links(spark, sf_dir):
    sheets = _site(spark, sf_dir).filter(H.mime(F.col("headers")) == "text/css")
    return X.extract_column(sheets, M.css_url_links).select("url", "pos", "raw")


@query
def all_links(spark, sf_dir):
    found = X.extract_links(S.captures(spark, sf_dir), _config().rules, _extractors())
    return found.groupBy("surt", "rule", "kind", "raw").agg(F.count("*").alias("links"))


@query
def pattern_links(spark, sf_dir):
    found = X.extract_column(_site(spark, sf_dir), X.pattern_extractor(PATTERNS))
    return X.resolve_links(found).select("src_url", "kind", "url")


@query
def template_links(spark, sf_dir):
    found = X.template_links(_site(spark, sf_dir), TEMPLATE_FIELDS, TEMPLATES)
    return X.resolve_links(found).select("src_url", "pos", "url")


@query
def subresource_join(spark, sf_dir):
    stored = store.latest(S.captures(spark, sf_dir))
    resolved = X.resolve_links(_links(spark, sf_dir))
    return X.subresources(resolved, stored, ("link", "script")).select(
        "src_url", "kind", "url", "target_id", "target_status",
        F.octet_length("target_body").cast("long").alias("target_bytes"),
    )


@query
def custom_extractor(spark, sf_dir):
    def first_words(header: dict, body: bytes):
        """A user's own code: one URL per stylesheet import, with the page's hops."""
        for piece in body.split(b'@import url("')[1:]:
            yield piece.split(b'"')[0].decode() + f"?hops={header['url']['hops']}"

    known = X.Extractors()
    known.add_python("imports", first_words)
    rules = [Rule("imports", "imports", None, ("text/css",))]
    return X.resolve_links(X.extract_links(_site(spark, sf_dir), rules, known)).select("src_url", "rule", "pos", "url")


# Counts and audits


@query
def capture_counts(spark, sf_dir):
    return audit.capture_counts(S.captures(spark, sf_dir))


@query
def rate_audit(spark, sf_dir):
    n, per = _config().quota
    return audit.fetch_rate(S.captures(spark, sf_dir), per, n)


# Crawl


@query
def host_edges(spark, sf_dir):
    return crawl.host_edges(_edges(spark, sf_dir))


@query
def crawl_reach(spark, sf_dir):
    found = crawl.reach(_edges(spark, sf_dir), _seeds(spark, sf_dir), MAX_HOPS)
    return found.select("surt", "hops")


@query
def crawl_resume(spark, sf_dir):
    stored = _site(spark, sf_dir).filter(F.col("url").startswith("https:"))
    return crawl.reach(_edges(spark, sf_dir), _seeds(spark, sf_dir), MAX_HOPS, stored=stored).select("surt", "hops")


@query
def discovery_tree(spark, sf_dir):
    edges, start = materialize(_edges(spark, sf_dir), "links"), _seeds(spark, sf_dir)
    tree = crawl.discovery_tree(edges, crawl.reach(edges, start, MAX_HOPS), start)
    return tree.select("surt", "parent_surt", "discovered_in", "hops", "steps")


@query
def archive_replay(spark, sf_dir):
    done = replay(S.site_captures(spark, sf_dir), _raw_seeds(spark, sf_dir), _replay_config())
    return done.archived.select("surt", "hops", "discovered_in", "capture_id")


# Export


def _index(spark, sf_dir) -> DataFrame:
    """Index rows of all captures; lengths are those before compression.

    Written down, since sorting samples its input and would hash the bodies twice.
    """
    return materialize(A.records(S.captures(spark, sf_dir)).drop("record"), "index")


@query
def export_order(spark, sf_dir):
    keys = S.captures(spark, sf_dir).select("surt", "fetched_at", "capture_id")
    return with_rank(ordered(keys, A.ORDER)).select("capture_id", "rank")


@query
def warc_records(spark, sf_dir):
    made = A.records(S.captures(spark, sf_dir))
    return made.select("capture_id", F.sha2("record", 256).alias("record_sha"), F.col("raw_length").alias("length"))


@query
def warc_packed(spark, sf_dir):
    made = A.pack(store.latest(S.captures(spark, sf_dir)))
    record = A.unpacked()(F.col("record_gz"))
    return made.select("capture_id", "digest", F.sha2(record, 256).alias("record_sha"))


@query
def warc_rotation(spark, sf_dir):
    placed = A.place_by_floor(_index(spark, sf_dir), "raw_length", FILE_THRESHOLD)
    return placed.select("capture_id", "file_no", "filename")


@query
def warc_offsets(spark, sf_dir):
    placed = A.place_by_floor(_index(spark, sf_dir), "raw_length", FILE_THRESHOLD)
    return placed.select("capture_id", "offset", F.col("raw_length").alias("length"))


@query
def warc_file_sizes(spark, sf_dir):
    placed = A.place_by_floor(_index(spark, sf_dir), "raw_length", FILE_THRESHOLD)
    return A.file_sizes(placed, "raw_length")


def _lines(spark, sf_dir) -> DataFrame:
    placed = A.place_by_floor(_index(spark, sf_dir), "raw_length", FILE_THRESHOLD)
    return placed.withColumn("line", A.cdx_line(F.col("filename"), F.col("offset"), F.col("raw_length")))


@query
def cdxj_lines(spark, sf_dir):
    return _lines(spark, sf_dir).select("line")


@query
def cdx_blocks(spark, sf_dir):
    return A.cdx_blocks(_lines(spark, sf_dir)).select("capture_id", "rank", "block")


@query
def zipnum_index(spark, sf_dir):
    return A.block_summary(A.cdx_blocks(_lines(spark, sf_dir)))


@query
def zipnum_blocks(spark, sf_dir):
    blocks = materialize(A.with_block_offsets(A.compressed_blocks(A.cdx_blocks(_lines(spark, sf_dir)))), "blocks")
    text = A.unpacked()(F.col("payload"))
    before = F.coalesce(F.sum("length").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocks.withColumn("text", text).select(
        "block",
        F.col("surt").alias("first_surt"),
        F.regexp_count(F.decode("text", "UTF-8"), F.lit("\n")).cast("bigint").alias("lines"),
        F.sha2("text", 256).alias("text_sha"),
        (F.col("offset") == before).alias("in_place"),
    )


@query
def pages_main(spark, sf_dir):
    return _pages(spark, sf_dir, True)


@query
def pages_extra(spark, sf_dir):
    return _pages(spark, sf_dir, False)


def _pages(spark, sf_dir, main: bool) -> DataFrame:
    split = A.split_pages(store.scan_metadata(S.captures(spark, sf_dir)), _entry_points(spark, sf_dir))
    lines = split[0 if main else 1].select(A.page_line().alias("line"))
    return spark.range(1).select(A.page_header(main).alias("line")).unionByName(lines)


@query
def package_manifest(spark, sf_dir):
    now = store.latest(S.captures(spark, sf_dir))
    return export_package(now, _entry_points(spark, sf_dir), scratch_path(spark, "package"), FILE_THRESHOLD)


def package_contents(spark: SparkSession, root: str, entries: DataFrame) -> DataFrame:
    """Every file of an export read back: its path, bytes, whether size and digest are those listed, and its content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # A path below the root; attempt files and listings are no part of the package.
    below = F.regexp_extract("path", r"/((?:archive|indexes|pages)/[^/]+)$", 1)
    read = files.withColumn("path", below).filter("path <> ''").select("path", "content")
    joined = entries.join(read, "path", "left")
    sound = (F.octet_length("content") == F.col("bytes")) & (F.concat(F.lit("sha256:"), F.sha2("content", 256)) == F.col("hash"))
    return joined.select("path", F.coalesce(sound, F.lit(False)).alias("sound"), "content")


@query
def package_check(spark, sf_dir):
    """A package written twice into one folder and read back: items and whether all agrees, by kind of file."""
    now = materialize(store.latest(S.captures(spark, sf_dir)), "captures")
    root = scratch_path(spark, "package")
    points = _entry_points(spark, sf_dir)
    export_package(now, points, root, FILE_THRESHOLD // 4)
    entries = materialize(export_package(now, points, root, FILE_THRESHOLD // 2), "entries")
    files = package_contents(spark, root, entries)
    kind = F.regexp_extract("path", r"([a-zA-Z]+)-?[0-9]*\.(warc\.gz|cdx\.gz|idx|jsonl)$", 1)
    kind = F.when(F.col("path").endswith(".warc.gz"), "archive").when(F.col("path").endswith(".cdx.gz"), "lines").when(
        F.col("path").endswith(".idx"), "blocks").otherwise(kind)
    packed = F.col("path").endswith(".gz")
    plain = F.when(packed, A.unpacked()(F.when(packed, F.col("content")))).otherwise(F.col("content"))
    text = F.make_valid_utf8(plain.cast("string"))
    items = F.when(kind == "archive", F.regexp_count(text, F.lit("(?m)^WARC-Record-ID: "))).otherwise(F.regexp_count(text, F.lit("\n")))
    counted = files.select(kind.alias("kind"), items.alias("items"), "sound")
    return counted.groupBy("kind").agg(F.sum("items").cast("bigint").alias("items"), F.bool_and("sound").alias("sound"))


# Streaming


def _arrivals(spark, sf_dir, captures: DataFrame) -> DataFrame:
    """The captures as a folder of files that a stream picks up a few at a time.

    Eight files at least where there are as many rows, written where the rows are: no body is shuffled for it.
    """
    path = scratch_path(spark, "arrivals")
    rows = max(1, -(-captures.count() // 8))
    captures.write.option("maxRecordsPerFile", rows).parquet(path)
    files = len(spark.read.schema(captures.schema).parquet(path).inputFiles())
    return jobs.read_captures(spark, path, captures.schema, files_per_trigger=max(1, -(-files // 3)))


def _finished(stream) -> None:
    stream.awaitTermination()


@query
def stream_links(spark, sf_dir):
    links = jobs.discover_links(_arrivals(spark, sf_dir, _site(spark, sf_dir)), HTML_RULES, MAX_HOPS)
    out = scratch_path(spark, "stream-links")
    _finished(jobs.write_stream(links, out, scratch_path(spark, "state")))
    return spark.read.schema(links.schema).parquet(out).select("src_surt", "kind", "pos", "url", "surt", "hops")


@query
def stream_first_seen(spark, sf_dir):
    narrow = S.captures(spark, sf_dir).select("capture_id", "surt")
    out = scratch_path(spark, "stream-first")
    _finished(jobs.write_stream(jobs.first_seen(_arrivals(spark, sf_dir, narrow)), out, scratch_path(spark, "state")))
    return spark.read.schema("surt string").parquet(out)


@query
def stream_unseen(spark, sf_dir):
    narrow = S.captures(spark, sf_dir).select("capture_id", "surt")
    out = scratch_path(spark, "stream-unseen")
    _finished(jobs.store_unseen(_arrivals(spark, sf_dir, narrow), out, scratch_path(spark, "state")))
    return jobs.read_store(spark, out, "surt string, run string, batch long").select("surt")


@query
def stream_latest(spark, sf_dir):
    captures = S.captures(spark, sf_dir)
    out = scratch_path(spark, "stream-latest")
    _finished(jobs.store_latest(_arrivals(spark, sf_dir, captures), out, scratch_path(spark, "state")))
    return jobs.read_latest(spark, out, captures.schema).select("surt", "capture_id", "url", "status", "body_digest")


def _span(captures) -> str:
    """A lateness that allows for captures in any order of time."""
    low, high = captures.agg(F.min("fetched_at"), F.max("fetched_at")).first()
    return f"{int((high - low).total_seconds()) + 1 if low else 0} seconds"


@query
def stream_rate(spark, sf_dir):
    narrow = S.captures(spark, sf_dir).select("capture_id", "fetched_at")
    n, per = _config().quota
    out = scratch_path(spark, "stream-rate")
    # The files arrive in no order of time, so the watermark allows for the whole span.
    arrivals = _arrivals(spark, sf_dir, narrow)
    _finished(jobs.store_rates(arrivals, per, n, _span(narrow), out, scratch_path(spark, "state")))
    return jobs.read_rates(spark, out)
