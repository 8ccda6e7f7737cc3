"""Archive records, their index, and page lists.

Bodies are packed where they are read and written down once.  Everything that
needs order works on narrow rows (key, time, id, lengths); the packed records
themselves move once, to the task that writes their file.
"""

from __future__ import annotations

import gzip
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capweave.functions.http import (
    cdx_time,
    digest,
    http_block,
    mime,
    rfc3339_time,
    warc_head,
    warc_record,
)
from capweave.operators.ordering import ordered, with_rank, with_running_start
from capweave.operators.scratch import materialize
from capweave.operators.skew import key_join

# Sizes, levels and names of the package format.
WARC_THRESHOLD = 1_000_000_000
WARC_LEVEL = 5
CDX_BLOCK_LINES = 1000
CDX_LEVEL = 9
PAGE_FORMAT = "json-pages-1.0"
MAIN_PAGES = ("entrypoint-pages", "main pages!")
EXTRA_PAGES = ("extra-pages", "crawled pages")

ORDER = ("surt", "fetched_at", "capture_id")
BLOCKS_PER_INDEX_FILE = 10_000
PAGES_PER_FILE = 1_000_000
_SORTABLE_TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"
_KEEP_NULLS = {"ignoreNullFields": "false"}


# Bytes of results that a Python worker holds before it hands them on.
RESULT_BYTES = 8 << 20


def in_slices(values: Iterable[bytes | None], make: Callable[[bytes], bytes]) -> Iterator[pd.Series]:
    """``make`` of each value in pieces of about RESULT_BYTES: a batch of small members can hold very much text."""
    made: list[bytes | None] = []
    size = 0
    for value in values:
        made.append(None if value is None else make(value))
        size += len(made[-1] or b"")
        if size >= RESULT_BYTES:
            yield pd.Series(made, dtype=object)
            made, size = [], 0
    if made:
        yield pd.Series(made, dtype=object)


def gzip_member(level: int):
    """Arrow function that makes one gzip member per value, the same on every run."""

    @F.pandas_udf("binary")
    def compress(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield from in_slices(values, lambda v: gzip.compress(v, level, mtime=0))

    return compress


def unpacked():
    """Arrow function that gives the content of one gzip member per value."""

    @F.pandas_udf("binary")
    def decompress(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield from in_slices(values, gzip.decompress)

    return decompress


def records(captures: DataFrame) -> DataFrame:
    """Uncompressed archive record of each capture with the values the index needs."""
    return (
        captures.withColumn(
            "_block",
            http_block(F.col("http_version"), F.col("status"), F.col("headers"), F.col("body")),
        )
        .withColumn("digest", digest(F.col("_block")))
        .withColumn(
            "_head",
            warc_head(
                F.col("url"),
                F.col("fetched_at"),
                F.col("capture_id"),
                F.col("remote_addr"),
                F.col("http_version"),
                F.col("digest"),
                F.octet_length("_block"),
            ),
        )
        .select(
            "capture_id",
            "surt",
            "url",
            "fetched_at",
            "status",
            mime(F.col("headers")).alias("mime"),
            "digest",
            warc_record(F.col("_head"), F.col("_block")).alias("record"),
        )
        .withColumn("raw_length", F.octet_length("record").cast("long"))
    )


def pack(captures: DataFrame, level: int = WARC_LEVEL) -> DataFrame:
    """Records as gzip members, with their stored length."""
    packed = records(captures).withColumn("record_gz", gzip_member(level)(F.col("record")))
    return packed.drop("record").withColumn("length", F.octet_length("record_gz").cast("long"))


def file_name(number: Column) -> Column:
    return F.format_string("%05d.warc.gz", number)


def place_by_floor(index: DataFrame, size: str, threshold: int) -> DataFrame:
    """File and offset of each record: a record belongs to the file its global
    start falls in.

    This is the rule of rotation.  It looks at the running total of all records
    before, so it gives the same files for any partitioning and needs no
    sequential pass; a file ends with the first record that reaches a multiple
    of the threshold.
    """
    started = with_running_start(ordered(index, ORDER), size)
    numbered = started.withColumn("file_no", F.expr(f"start div {threshold}"))
    first = F.min("start").over(Window.partitionBy("file_no"))
    return numbered.withColumn("offset", F.col("start") - first).withColumn(
        "filename", file_name(F.col("file_no"))
    )


# First keys of files that are searched at once.
FILES_PER_GROUP = 512


def order_text() -> Column:
    """The global order as one string that sorts like ORDER; no key holds the
    separator."""
    return F.concat_ws("\0", F.col("surt"), F.date_format("fetched_at", _SORTABLE_TIME), F.col("capture_id"))


def locate(packed: DataFrame, placed: DataFrame) -> DataFrame:
    """Add its archive file to each packed record.

    A file holds a contiguous range of the global order, so its name follows
    from where the record sorts between the first records of the files.  These
    are searched in two levels: the first keys of groups of files are a short
    list in the plan, and the files of a group come from a table with one row
    per group, so the wide rows are not shuffled for it.
    """
    first = placed.filter(F.col("offset") == 0).select(order_text().alias("key"), "filename", "file_no")
    grouped = with_rank(ordered(first, ["key"])).withColumn("group", F.expr(f"rank div {FILES_PER_GROUP}"))
    file = F.struct("key", "filename", "file_no")
    files = materialize(grouped.groupBy("group").agg(F.array_sort(F.collect_list(file)).alias("files")), "files")
    starts = files.select("group", F.col("files")[0]["key"].alias("key")).orderBy("group").collect()
    # A string that the optimizer folds into an array literal.
    keys = F.split(F.lit("\n".join(r["key"] for r in starts)), "\n")

    def last_not_after(sorted_keys: Column, key: Column) -> Column:
        return F.size(F.filter(sorted_keys, lambda k: k <= key))

    found = F.element_at("files", last_not_after(F.col("files")["key"], F.col("_key")))
    return (
        packed.withColumn("_key", order_text())
        .withColumn("group", (last_not_after(keys, F.col("_key")) - 1).cast("bigint"))
        .join(files, "group")
        .withColumn("_file", found)
        .select(*packed.columns, "_file.filename", "_file.file_no")
    )


def file_sizes(placed: DataFrame, size: str = "length") -> DataFrame:
    return placed.groupBy("filename").agg(F.sum(size).alias("bytes"), F.count("*").alias("records"))


def cdx_line(filename: Column, offset: Column, length: Column) -> Column:
    block = F.struct(
        F.col("url"),
        F.col("digest"),
        F.col("mime"),
        filename.alias("filename"),
        offset.alias("offset"),
        length.alias("length"),
        F.col("status"),
    )
    return F.concat_ws(" ", F.col("surt"), cdx_time(F.col("fetched_at")), F.to_json(block, _KEEP_NULLS))


def cdx_blocks(placed: DataFrame, lines: int = CDX_BLOCK_LINES) -> DataFrame:
    """Add global rank and index block to a table from :func:`ordered`."""
    return with_rank(placed).withColumn("block", F.expr(f"rank div {lines}"))


def block_summary(blocked: DataFrame) -> DataFrame:
    """First key and time, lines and text bytes of each index block."""
    return (
        blocked.groupBy("block")
        .agg(
            F.min(F.struct("rank", "surt", "fetched_at")).alias("_first"),
            F.count("*").alias("lines"),
            F.sum(F.octet_length("line") + 1).alias("bytes"),
        )
        .select(
            "block",
            F.col("_first.surt").alias("first_surt"),
            cdx_time(F.col("_first.fetched_at")).alias("first_time"),
            "lines",
            "bytes",
        )
    )


def compressed_blocks(blocked: DataFrame) -> DataFrame:
    """Gzip each block of lines and find its place in its index file.

    A block holds a fixed number of lines, so gathering it is bounded.
    """
    text = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "line"))),
            lambda r: F.concat(r["line"], F.lit("\n")),
        ),
        "",
    )
    blocks = (
        blocked.groupBy("block")
        .agg(F.min(F.struct("rank", "surt", "fetched_at")).alias("_first"), F.encode(text, "UTF-8").alias("_text"))
        .select(
            "block",
            F.col("_first.surt").alias("surt"),
            F.col("_first.fetched_at").alias("fetched_at"),
            gzip_member(CDX_LEVEL)(F.col("_text")).alias("payload"),
        )
        .withColumn("length", F.octet_length("payload").cast("long"))
        .withColumn("digest", digest(F.col("payload")))
        .withColumn("shard", F.expr(f"block div {BLOCKS_PER_INDEX_FILE}"))
    )
    return blocks


def with_block_offsets(blocks: DataFrame) -> DataFrame:
    """Start of each block in its index file; a file holds a bounded number of blocks."""
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return blocks.withColumn("offset", F.sum("length").over(within) - F.col("length"))


def index_line() -> Column:
    block = F.struct("offset", "length", "digest", "filename")
    return F.concat_ws(" ", F.col("surt"), cdx_time(F.col("fetched_at")), F.to_json(block, _KEEP_NULLS))


def page_line() -> Column:
    return F.to_json(
        F.struct(
            F.col("capture_id").alias("id"), F.col("url"), rfc3339_time(F.col("fetched_at")).alias("ts")
        )
    )


def page_header(main: bool) -> Column:
    ident, title = MAIN_PAGES if main else EXTRA_PAGES
    return F.to_json(
        F.struct(F.lit(PAGE_FORMAT).alias("format"), F.lit(ident).alias("id"), F.lit(title).alias("title"))
    )


def split_pages(captures: DataFrame, entry_points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(main, extra): captures whose key is an entry point, and all others."""
    keys = entry_points.select(F.col("entry_point").alias("surt"))
    main, extra = (key_join(captures, keys, "surt", "capture_id", how) for how in ("left_semi", "left_anti"))
    return main, extra
