"""A versioned capture store: Parquet pieces and a log of snapshots.

Layout under the store's root (any Hadoop file system the cluster shares)::

    index/<piece>/    METADATA_COLUMNS and body_digest
    bodies/<piece>/   body_digest, body
    removed/<piece>/  surt: keys deleted by that snapshot
    crawl/<piece>/    config, entry_point
    _log/<n>.json     snapshot n: for every table, its pieces and the version that added each

A writer writes its pieces into new folders, never into existing ones, and
then commits by creating the next log file with ``overwrite = false``; if
another writer took that version first, :class:`CommitConflict` is raised and
nothing is visible.  A reader resolves a version once and reads only the pieces
it lists, so commits made later never change what it sees.

Deletes are merged on read: an index row added at version v is live in
snapshot s unless a ``removed`` piece added at version r, v < r <= s, holds its
key.  So keys deleted at r may be stored again later (seeds are replaced that
way), and deleting costs one small piece, not a rewrite of the index.  The
anti join on the key is a shuffle join; no side is broadcast, as deleted keys
may be many.

Modes of :func:`write`: ``overwrite`` starts a snapshot with only the new
pieces (old ones stay on disk for readers of old versions until
:func:`vacuum`); ``no_clobber`` keeps stored keys, except the given seeds,
which are deleted in the same snapshot and stored anew from the incoming
captures.  Crawl info (configuration and entry points) is a piece of its own;
a snapshot holds the latest one written.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from capweave.operators.scratch import materialize
from capweave.operators.store import METADATA_COLUMNS, append_new, distinct_bodies, latest

TABLES = ("index", "bodies", "removed", "crawl")


class CommitConflict(RuntimeError):
    """Another writer committed the version this writer meant to make."""


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions of the store, oldest first; empty for a store not yet written."""
    fs, log = _path(spark, f"{root}/_log")
    if not fs.exists(log):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(log)]
    return sorted(int(n[: -len(".json")]) for n in names if n.endswith(".json") and n[: -len(".json")].isdigit())


def snapshot(spark: SparkSession, root: str, version: int | None = None) -> dict | None:
    """The snapshot of ``version`` (the latest if None), or None for an empty store."""
    if version is None:
        known = versions(spark, root)
        if not known:
            return None
        version = known[-1]
    fs, path = _path(spark, f"{root}/_log/{version}.json")
    stream = fs.open(path)
    try:
        reader = spark.sparkContext._jvm.java.io.BufferedReader(
            spark.sparkContext._jvm.java.io.InputStreamReader(stream, "UTF-8")
        )
        text = "\n".join(iter(reader.readLine, None))
    finally:
        stream.close()
    return json.loads(text)


def _commit(spark: SparkSession, root: str, parent: dict | None, added: dict, clear: bool) -> int:
    version = (parent["version"] if parent else 0) + 1
    pieces = {t: ([] if clear or not parent else list(parent["pieces"][t])) for t in TABLES}
    schemas = dict(parent["schemas"]) if parent and not clear else {}
    for table, (path, schema) in added.items():
        if table == "crawl":
            pieces["crawl"] = []
        pieces[table].append({"path": path, "version": version})
        schemas[table] = schema
    body = json.dumps({"version": version, "parent": parent["version"] if parent else None, "pieces": pieces,
                       "schemas": schemas})
    fs, path = _path(spark, f"{root}/_log/{version}.json")
    try:
        stream = fs.create(path, False)
    except Exception as error:  # the file exists: the version is taken
        raise CommitConflict(f"version {version} of {root} was committed by another writer") from error
    try:
        stream.write(bytearray(body.encode()))
    finally:
        stream.close()
    return version


def _piece(df: DataFrame, root: str, table: str) -> tuple[str, str]:
    path = f"{root}/{table}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path, df.schema.json()


def _read(spark: SparkSession, snap: dict, table: str) -> DataFrame | None:
    pieces = snap["pieces"][table] if snap else []
    if not pieces:
        return None
    schema = StructType.fromJson(json.loads(snap["schemas"][table]))
    parts = [spark.read.schema(schema).parquet(p["path"]).withColumn("_v", F.lit(p["version"])) for p in pieces]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_index(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """Live index rows of a snapshot: added pieces less keys deleted after them."""
    snap = snapshot(spark, root, version)
    index = _read(spark, snap, "index")
    if index is None:
        raise FileNotFoundError(f"no index in {root} at version {version}")
    removed = _read(spark, snap, "removed")
    if removed is not None:
        gone = removed.select(F.col("surt").alias("_gone"), F.col("_v").alias("_at"))
        index = index.join(gone, (F.col("surt") == F.col("_gone")) & (F.col("_at") > F.col("_v")), "left_anti")
    return index.drop("_v")


def read_bodies(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    bodies = _read(spark, snapshot(spark, root, version), "bodies")
    if bodies is None:
        raise FileNotFoundError(f"no bodies in {root} at version {version}")
    return bodies.drop("_v")


def read_crawl_info(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """Configuration and entry points of the snapshot, None where none was written."""
    crawl = _read(spark, snapshot(spark, root, version), "crawl")
    return None if crawl is None else crawl.drop("_v")


def write(
    captures: DataFrame,
    root: str,
    mode: str = "overwrite",
    seeds: DataFrame | None = None,
    crawl: DataFrame | None = None,
) -> int:
    """Store the current capture of each key; returns the committed version.

    ``no_clobber``: keys stored already stay, but keys of ``seeds`` (a ``surt``
    column) are deleted in this snapshot and stored anew from ``captures``.
    """
    if mode not in ("overwrite", "no_clobber"):
        raise ValueError(f"unknown mode {mode!r}")
    spark = captures.sparkSession
    parent = snapshot(spark, root)
    added = {}
    if mode == "overwrite" or parent is None:
        # Written down: bodies and index both read it, and each reading would look for the winners anew.
        current = materialize(latest(captures), "current")
        bodies = distinct_bodies(current)
    else:
        stored = read_index(spark, root, parent["version"])
        if seeds is not None:
            replaced = seeds.select("surt").distinct().join(stored.select("surt"), "surt", "left_semi")
            added["removed"] = _piece(replaced, root, "removed")
            removed_now = spark.read.parquet(added["removed"][0])
            stored = stored.join(removed_now, "surt", "left_anti")
        current = materialize(append_new(stored, captures), "current")
        known = read_bodies(spark, root, parent["version"]).select("body_digest")
        bodies = distinct_bodies(current).join(known, "body_digest", "left_anti")
    # bodies first: an index row never points at a body that is not written
    added["bodies"] = _piece(bodies, root, "bodies")
    index = current.select(*METADATA_COLUMNS, "body_digest")
    added["index"] = _piece(index.repartitionByRange("surt", "capture_id").sortWithinPartitions("surt"), root, "index")
    if crawl is not None:
        added["crawl"] = _piece(crawl.select("config", "entry_point"), root, "crawl")
    return _commit(spark, root, parent, added, clear=mode == "overwrite")


def delete(spark: SparkSession, root: str, keys: DataFrame) -> int:
    """Delete every stored capture of the keys (a ``surt`` column); returns the committed version."""
    parent = snapshot(spark, root)
    if parent is None:
        raise FileNotFoundError(f"no store at {root}")
    return _commit(spark, root, parent, {"removed": _piece(keys.select("surt").distinct(), root, "removed")}, False)


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Remove pieces that none of the last ``keep`` snapshots lists, and older logs; returns removed paths.

    Readers of the removed versions fail afterwards; readers of kept ones are undisturbed.
    """
    known = versions(spark, root)
    kept = known[-keep:] if keep > 0 else []
    live = {p["path"] for v in kept for t in TABLES for p in snapshot(spark, root, v)["pieces"][t]}
    gone = []
    for table in TABLES:
        fs, folder = _path(spark, f"{root}/{table}")
        if not fs.exists(folder):
            continue
        for status in fs.listStatus(folder):
            path = f"{root}/{table}/{status.getPath().getName()}"
            if path not in live:
                fs.delete(status.getPath(), True)
                gone.append(path)
    for v in known:
        if v not in kept:
            fs, path = _path(spark, f"{root}/_log/{v}.json")
            fs.delete(path, False)
    return gone
