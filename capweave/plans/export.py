"""Export of captures to a package: archive files, index, page lists, manifest."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capweave.operators import archive as A
from capweave.operators.ordering import ordered, with_rank
from capweave.operators.scratch import materialize
from capweave.sources.files import listing, new_export, write_files

# The package profile.
PROFILE = "data-package"
PACKAGE_VERSION = "1.1.1"
SOFTWARE = "capweave"


def _bytes(text: Column) -> Column:
    return F.encode(F.concat(text, F.lit("\n")), "UTF-8")


def _numbered(stem: str, suffix: str, number: Column) -> Column:
    return F.format_string(f"{stem}-%05d{suffix}", number)


def _file_rows(df: DataFrame, folder: str, name: Column, slot: Column, seq: Column, payload: Column) -> DataFrame:
    """Rows for the file sink; ``slot`` is a number of the file, ``seq`` one within it."""
    return df.select(
        F.concat(F.lit(f"{folder}/"), name).alias("name"),
        slot.cast("bigint").alias("slot"),
        F.lpad(seq.cast("string"), 20, "0").alias("seq"),
        payload.alias("payload"),
    )


def export_package(
    captures: DataFrame,
    entry_points: DataFrame,
    root: str,
    threshold: int = A.WARC_THRESHOLD,
) -> DataFrame:
    """Write the package under ``root`` and return its file entries.

    ``captures`` should be current captures, see ``store.latest``; with a whole
    history every capture is exported.  Files of every kind are numbered from 0,
    whatever the size of the package; the manifest lists them.
    """
    # Offsets and bytes must come from one run, so records are written down first.
    packed = materialize(A.pack(captures), "packed")
    placed = materialize(with_rank(A.place_by_floor(packed.drop("record_gz"), "length", threshold)), "placed")
    rows = _archive_rows(packed, placed)
    for more in (*_index_rows(placed), *_page_rows(placed, entry_points)):
        rows = rows.unionByName(more)
    export = new_export()
    write_files(rows, root, export, slots=placed.filter(F.col("offset") == 0).count() + 4)
    entries = listing(captures.sparkSession, root, export)
    write_files(_manifest_rows(entries), root, f"{export}-manifest")
    return entries


def _archive_rows(packed: DataFrame, placed: DataFrame) -> DataFrame:
    return A.locate(packed.select(*A.ORDER, "record_gz"), placed).select(
        F.concat(F.lit("archive/"), "filename").alias("name"),
        F.col("file_no").alias("slot"),
        A.order_text().alias("seq"),
        F.col("record_gz").alias("payload"),
    )


def _index_rows(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    lines = placed.withColumn("line", A.cdx_line(F.col("filename"), F.col("offset"), F.col("length")))
    blocks = materialize(A.compressed_blocks(A.cdx_blocks(lines)), "blocks")
    shard, name = F.col("shard"), _numbered("index", ".cdx.gz", F.col("shard"))
    located = A.with_block_offsets(blocks.drop("payload")).withColumn("filename", name)
    return (
        _file_rows(blocks, "indexes", name, shard, F.col("block"), F.col("payload")),
        _file_rows(located, "indexes", _numbered("index", ".idx", shard), shard + 1, F.col("block"), _bytes(A.index_line())),
    )


def _page_rows(placed: DataFrame, entry_points: DataFrame) -> list[DataFrame]:
    """Page lists: a page stands in the list that its place in the global order gives, behind a head."""
    made = []
    spark = placed.sparkSession
    for main, rows in zip((True, False), A.split_pages(placed, entry_points)):
        rows = rows.withColumn("list", F.expr(f"rank div {A.PAGES_PER_FILE}"))
        name, slot = _numbered("pages" if main else "extraPages", ".jsonl", F.col("list")), F.col("list") + (2 if main else 3)
        heads = rows.select("list").unionByName(spark.range(1).withColumnRenamed("id", "list")).distinct()
        made.append(_file_rows(heads, "pages", name, slot, F.lit(0), _bytes(A.page_header(main))))
        made.append(_file_rows(rows, "pages", name, slot, F.col("rank") + 1, _bytes(A.page_line())))
    return made


def _manifest_rows(entries: DataFrame) -> DataFrame:
    """``datapackage.json``: one row per file between a fixed head and tail, so
    the list is written by a task and not gathered on the driver."""
    created = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    head = (
        f'{{"profile":"{PROFILE}","wacz_version":"{PACKAGE_VERSION}",'
        f'"software":"{SOFTWARE}","created":"{created}","resources":['
    )
    ranked = ordered(entries, ["path"], 1)
    body = ranked.select(
        F.col("place").alias("seq"),
        F.concat(
            F.when(F.col("place") == 0, F.lit("")).otherwise(F.lit(",")),
            F.to_json(F.struct("name", "path", "hash", "bytes")),
        ).alias("text"),
    )
    ends = entries.sparkSession.createDataFrame([(-1, head), (1 << 62, "]}")], "seq long, text string")
    return body.unionByName(ends).select(
        F.lit("datapackage.json").alias("name"), F.lit(0).alias("slot"), "seq", _bytes(F.col("text")).alias("payload")
    )
