"""Sink that joins byte payloads into named files.

Used for every file of an export package.  Rows carry a name, the number of the
task slot that writes it, a value to sort by and a payload; the rows of one name
must reach one task in order, which :func:`write_files` arranges.  A task writes
files under a name of its own attempt and reports their digests.  The commit
only notes which attempts count; a second job moves these files to their places,
each in a task, and lists them.  Moving again what is moved already changes
nothing, so a failed or repeated task leaves no trace in the package.

Every export has an id of its own.  Its listing holds its files only, so what an earlier
export into the same folder left behind is in no later manifest.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from capweave.operators.scratch import is_local

SCHEMA = "name string, payload binary"
LISTING = "_files"
LISTING_SCHEMA = "name string, path string, hash string, bytes bigint"
_PENDING_SCHEMA = "attempt string, path string, hash string, bytes bigint"
_FORMAT = "capweave_files"
_MOVED_PER_TASK = 8
#: Names of file systems that differ between Spark and Arrow.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str, str, int]]  # (attempt name, name, hash, bytes)


def arrow_uri(path: str) -> str:
    """The path as Arrow names it."""
    scheme, mark, rest = path.partition(":/")
    if not mark or "/" in scheme:
        return path
    # Hadoop writes file:/x where Arrow wants file:///x.
    return f"{_SCHEMES.get(scheme, scheme)}:/{rest}" if rest.startswith("/") else f"{_SCHEMES.get(scheme, scheme)}:///{rest}"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(arrow_uri(path)) if "://" in arrow_uri(path) else (fs.LocalFileSystem(), path)


class _FilesWriter(DataSourceWriter):
    def __init__(self, root: str, export: str) -> None:
        self.root, self.export = root, export

    def write(self, rows: Iterator) -> WriterCommitMessage:
        filesystem, root = _filesystem(self.root)
        done: list[tuple[str, str, str, int]] = []
        folder = f"{LISTING}/{self.export}/tmp-{uuid.uuid4().hex}"
        name, out, sha, size = None, None, None, 0

        def close():
            if out is not None:
                out.close()
                done.append((f"{folder}/{len(done)}", name, sha.hexdigest(), size))

        filesystem.create_dir(f"{root}/{folder}", recursive=True)
        for row in rows:
            if row.name != name:
                close()
                name, sha, size = row.name, hashlib.sha256(), 0
                out = filesystem.open_output_stream(f"{root}/{folder}/{len(done)}")
            out.write(row.payload)
            sha.update(row.payload)
            size += len(row.payload)
        close()
        return _Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        filesystem, root = _filesystem(self.root)
        with filesystem.open_output_stream(f"{root}/{LISTING}/{self.export}/pending-{uuid.uuid4().hex}.json") as out:
            for message in messages:
                for attempt, name, hexdigest, size in message.files if message else []:
                    entry = {"attempt": attempt, "path": name, "hash": f"sha256:{hexdigest}", "bytes": size}
                    out.write((json.dumps(entry) + "\n").encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Attempt files stay in the listing folder, where no reader looks."""


class FilesDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return _FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _FilesWriter(self.options["path"], self.options["export"])


def new_export() -> str:
    return uuid.uuid4().hex


def write_files(rows: DataFrame, root: str, export: str, slots: int = 1) -> None:
    """Write (name, slot, seq, payload) rows as files under ``root``.

    All rows of a name have the same slot; ``slots`` is about the number of names, and
    consecutive numbers go to different tasks.
    """
    spark = rows.sparkSession
    if "://" not in arrow_uri(root) and not is_local(spark):
        raise ValueError(f"{root} is a folder of each machine's own; give it with its file system, such as s3a://")
    spark.dataSource.register(FilesDataSource)
    step = new_export()
    (
        rows.select("name", "slot", "seq", "payload")
        .repartitionById(max(slots, 1), F.pmod(F.col("slot"), F.lit(max(slots, 1))).cast("int"))
        .sortWithinPartitions("name", "seq")
        .select("name", "payload")
        .write.format(_FORMAT)
        .option("path", root)
        .option("export", f"{export}/{step}")
        .mode("append")
        .save()
    )
    _move(spark, root, f"{LISTING}/{export}/{step}")


def _move(spark: SparkSession, root: str, folder: str) -> None:
    """Bring the files that the commit noted in ``folder`` to their places and list them."""
    pending = spark.read.schema(_PENDING_SCHEMA).option("pathGlobFilter", "pending-*.json").json(f"{root}/{folder}")
    count = pending.count()

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileType

        filesystem, base = _filesystem(root)
        for batch in batches:
            for row in batch.itertuples(index=False):
                filesystem.create_dir(f"{base}/{row.path}".rpartition("/")[0], recursive=True)
                if filesystem.get_file_info(f"{base}/{row.attempt}").type != FileType.NotFound:
                    filesystem.move(f"{base}/{row.attempt}", f"{base}/{row.path}")
            yield pd.DataFrame(
                {"name": batch.path.str.rpartition("/")[2], "path": batch.path, "hash": batch.hash, "bytes": batch.bytes}
            )

    tasks = max(1, -(-count // _MOVED_PER_TASK))
    moved = pending.repartition(tasks).mapInPandas(move, LISTING_SCHEMA)
    moved.write.mode("overwrite").json(f"{root}/{folder}/listed")


def listing(spark: SparkSession, root: str, export: str) -> DataFrame:
    """Name, path, digest and size of every file of an export."""
    return (
        spark.read.schema(LISTING_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "part-*.json")
        .json(f"{root}/{LISTING}/{export}")
    )
