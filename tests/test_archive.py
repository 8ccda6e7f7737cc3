import gzip
import hashlib
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from capweave.operators import archive as A
from capweave.operators import scratch, store
from capweave.operators.scratch import materialize, scratch_path
from capweave.plans.catalogue import _entry_points
from capweave.plans.export import export_package
from capweave.plans.session import ship_package
from capweave.sources import files
from capweave.sources import sample_site as S


def sized(spark, n=2000):
    rows = [(f"{i:05}", (i * 37) % 101 + (5000 if i % 97 == 0 else 1)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "capture_id string, length long").select(
        F.col("capture_id").alias("surt"), F.lit(0).alias("fetched_at"), "capture_id", "length"
    )


@pytest.mark.parametrize("threshold", [1, 333, 100_000])
def test_rotation_is_the_same_for_any_partitioning(spark, threshold):
    rows, df = sized(spark)
    start, first, want = 0, {}, []
    for ident, size in rows:
        number = start // threshold
        want.append((ident, f"{number:05}.warc.gz", start - first.setdefault(number, start)))
        start += size
    for parts in (1, 4, 40):
        placed = A.place_by_floor(df.repartition(parts), "length", threshold)
        assert sorted((r["capture_id"], r["filename"], r["offset"]) for r in placed.collect()) == want


@pytest.mark.parametrize("group", [1, 3, 512])
def test_records_find_their_files(spark, monkeypatch, group):
    ship_package(spark)
    monkeypatch.setattr(A, "FILES_PER_GROUP", group)
    rows = [(f"{i:05}", "hot" if i % 3 else f"k{i % 7}", (i * 37) % 101 + 1) for i in range(1500)]
    packed = spark.createDataFrame(rows, "capture_id string, surt string, length long").select(
        "capture_id", "surt", F.timestamp_seconds(F.col("length")).cast("timestamp_ntz").alias("fetched_at"), "length"
    )
    placed = materialize(A.place_by_floor(packed, "length", 3000), "placed")
    want = {r["capture_id"]: r["filename"] for r in placed.collect()}
    located = A.locate(packed, placed)
    assert {r["capture_id"]: r["filename"] for r in located.collect()} == want and len(want) == 1500
    # The wide side stays where it is: only the small table of files travels.
    text = located._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text


@pytest.fixture(scope="module")
def package(spark, sf_dir):
    ship_package(spark)
    captures = materialize(store.latest(S.captures(spark, sf_dir)), "captures")
    points = _entry_points(spark, sf_dir)
    root = scratch_path(spark, "package")
    export_package(captures, points, root, threshold=5_000)  # an earlier export into the same folder
    entries = export_package(captures, points, root, threshold=20_000).collect()
    return captures, points, root, entries


def read(root, path):
    with open(f"{root}/{path}", "rb") as f:
        return f.read()


def test_manifest_matches_files(package):
    _, _, root, entries = package
    assert len(entries) > 5
    for e in entries:
        data = read(root, e["path"])
        assert e["bytes"] == len(data) and e["hash"] == "sha256:" + hashlib.sha256(data).hexdigest()
    manifest = json.loads(read(root, "datapackage.json"))
    assert manifest["profile"] == "data-package"
    assert [r["path"] for r in manifest["resources"]] == sorted(e["path"] for e in entries)


def test_index_points_at_records(package):
    captures, _, root, _ = package
    index = read(root, "indexes/index-00000.cdx.gz")
    lines = gzip.decompress(index).decode().splitlines()
    keys = [tuple(line.split(" ")[:2]) for line in lines]
    assert keys == sorted(keys) and len(lines) == captures.count()
    bodies = {r["url"]: bytes(r["body"]) for r in captures.select("url", "body").collect()}
    for line in lines:
        block = json.loads(line.split(" ", 2)[2])
        assert list(block) == ["url", "digest", "mime", "filename", "offset", "length", "status"]
        data = read(root, f"archive/{block['filename']}")
        record = gzip.decompress(data[block["offset"] : block["offset"] + block["length"]])
        head, _, http = record.partition(b"\r\n\r\n")
        assert http.endswith(b"\r\n\r\n")
        http = http[:-4]
        fields = dict(h.split(": ", 1) for h in head.decode().split("\r\n")[1:])
        assert fields["WARC-Target-URI"] == block["url"]
        assert fields["WARC-Block-Digest"] == block["digest"] == "sha256:" + hashlib.sha256(http).hexdigest()
        assert int(fields["Content-Length"]) == len(http)
        assert http.partition(b"\r\n\r\n")[2] == bodies[block["url"]]


def test_block_index(package):
    _, _, root, _ = package
    index = read(root, "indexes/index-00000.cdx.gz")
    for line in read(root, "indexes/index-00000.idx").decode().splitlines():
        key, time, block = line.split(" ", 2)
        block = json.loads(block)
        piece = index[block["offset"] : block["offset"] + block["length"]]
        assert block["digest"] == "sha256:" + hashlib.sha256(piece).hexdigest()
        assert gzip.decompress(piece).decode().startswith(f"{key} {time} ")


def test_page_lists(package):
    captures, points, root, _ = package
    main = [json.loads(x) for x in read(root, "pages/pages-00000.jsonl").decode().splitlines()]
    extra = [json.loads(x) for n in sorted(e["path"] for e in package[3] if "extraPages" in e["path"])
             for x in read(root, n).decode().splitlines()]
    assert main[0] == {"format": "json-pages-1.0", "id": "entrypoint-pages", "title": "main pages!"}
    assert extra[0] == {"format": "json-pages-1.0", "id": "extra-pages", "title": "crawled pages"}
    keys = {r["entry_point"] for r in points.collect()}
    want = {r["capture_id"]: r["surt"] in keys for r in captures.select("capture_id", "surt").collect()}
    got = {p["id"]: True for p in main[1:]} | {p["id"]: False for p in extra[1:]}
    assert got == want
    assert all(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}Z", p["ts"]) for p in main[1:])


def test_results_are_handed_on_in_slices(spark, monkeypatch):
    monkeypatch.setattr(A, "RESULT_BYTES", 1000)
    packed = [gzip.compress(bytes(300)), None, *[gzip.compress(bytes([i]) * 600) for i in range(10)]]
    slices = list(A.in_slices(packed, gzip.decompress))
    assert max(sum(len(v or b"") for v in s) for s in slices) <= 1600 and len(slices) == 5
    assert [v for s in slices for v in s] == [v if v is None else gzip.decompress(v) for v in packed]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(packed)], "i int, v binary").coalesce(1)
    back = rows.select("i", A.unpacked()(F.col("v")).alias("v"), A.gzip_member(9)(F.encode(F.col("i").cast("string"), "UTF-8")).alias("z"))
    for r in back.collect():
        assert r.v == (None if packed[r.i] is None else gzip.decompress(packed[r.i])) and gzip.decompress(r.z) == str(r.i).encode()


def test_arrow_names_of_file_systems():
    assert files.arrow_uri("s3a://bucket/x") == "s3://bucket/x"
    assert files.arrow_uri("hdfs://host/x") == "hdfs://host/x"
    assert files.arrow_uri("/x") == "/x"


def test_the_shared_folder_is_named_with_its_file_system(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(files, "is_local", lambda _: False)
    for n, given in enumerate((f"{tmp_path}", f"file:{tmp_path}", f"file://{tmp_path}")):
        root = scratch.qualified(spark, given)
        assert root == f"file://{tmp_path}"
        rows = spark.createDataFrame([(f"d/{n}", 0, "0", b"x")], "name string, slot long, seq string, payload binary")
        files.write_files(rows, root, files.new_export())
        assert read(root.removeprefix("file://"), f"d/{n}") == b"x"
    assert files.arrow_uri("file:/x") == "file:///x" and files.arrow_uri("/x:/y") == "/x:/y"


def test_a_folder_of_the_machine_is_refused_on_a_cluster(spark, monkeypatch):
    monkeypatch.setattr(files, "is_local", lambda _: False)
    rows = spark.createDataFrame([("a", 0, "0", b"x")], "name string, slot long, seq string, payload binary")
    with pytest.raises(ValueError):
        files.write_files(rows, "/tmp/x", files.new_export())


def test_moving_again_changes_nothing(spark):
    root = scratch_path(spark, "moves")
    rows = spark.createDataFrame([(f"d/{i}", i, "0", bytes([i])) for i in range(20)], "name string, slot long, seq string, payload binary")
    export = files.new_export()
    files.write_files(rows, root, export, 7)
    before = sorted(files.listing(spark, root, export).collect())
    folder = next(p for p in os.listdir(f"{root}/{files.LISTING}/{export}") if not p.startswith("."))
    files._move(spark, root, f"{files.LISTING}/{export}/{folder}")
    assert sorted(files.listing(spark, root, export).collect()) == before and len(before) == 20
    assert all(read(root, f"d/{i}") == bytes([i]) for i in range(20))
