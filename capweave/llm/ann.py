"""Approximate nearest neighbours with balanced posting lists.

Centroids are fitted to a bounded sample; a list that would be too long is given more
centroids.  Every vector of the table goes to its nearest list and, if it lies near a boundary,
to all of at most ``REPLICAS`` lists that are hardly farther (within ``REPLICATE``), as in SPANN (Chen and
others, 2021).  Queries find their lists by a best-first search in a graph that joins each
centroid with its neighbours and is held in memory; lists farther than the nearest by a ratio of
``1 + PRUNE`` are pruned, but for those that are needed to have as many candidates as are asked
for.  Within the lists distances are exact, in double precision.

How many lists that takes depends on the vectors: ``TRIALS`` of the queries are first compared with every row, and
every query searches as many of its nearest lists, besides those of the walk, as hold ``RECALL`` of the true
neighbours of these.

Lists are shuffled in parts of about ``PART`` vectors and their queries in parts of about ``QUERIES``, so
a vector that makes up a third of the table is no larger group than others.

The sample is of ``SAMPLE`` rows at most, in hashed order, and there are ``CENTROIDS`` centroids at most; both go
through the driver.  All rows are indexed.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do vectors
of another length than most (the longest of the most frequent lengths counts); rows with a null id are left out.  A row
repeated with the same id and vector counts once.  Ties go to the smaller id.  With fewer
candidates than asked for all are returned; without any, and of an empty table, nothing is returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capweave.llm.tables import first_by_hash, materialize, ship_package

SAMPLE = 30_000
CENTROIDS = 2_048
ROUNDS = 10
REPLICAS = 8
REPLICATE = 0.06
PRUNE = 0.2
NEIGHBOURS = 24
PART = 2_048
QUERIES = 512
#: Queries whose true neighbours are sought, and the share of these neighbours that the lists searched must hold.
TRIALS = 256
RECALL = 0.98
#: A list may hold so many times the mean of the sample before it is split.
BALANCE = 2.0


def valid(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.col(column).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    made = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))
    made = made.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & sound)
    sizes = made.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return made.filter(F.size("v") == sizes[0].d) if sizes else made


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T)


def fit(sample: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """Centroids by k-means on the sample; long lists are split between two."""
    distinct = np.unique(sample, axis=0)
    n = max(1, min(n, len(distinct)))
    draw = np.random.default_rng(seed)
    centre = distinct[draw.choice(len(distinct), n, replace=False)]
    for turn in range(ROUNDS):
        near = _squared(sample, centre).argmin(1)
        size = np.bincount(near, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, near, sample)
        centre = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centre)
        long = np.flatnonzero(size > BALANCE * len(sample) / n)
        if turn < ROUNDS - 2 and len(long):  # one more centroid beside each long list, where a list is empty or there is room
            spread = sample.std(0) * 0.1
            more = centre[long] + draw.standard_normal((len(long), centre.shape[1])) * spread
            centre = np.concatenate([centre[size > 0], more])[: CENTROIDS]
    return centre


def graph(centre: np.ndarray) -> np.ndarray:
    """Neighbours of each centroid, itself left out."""
    k = min(NEIGHBOURS, len(centre) - 1)
    away = _squared(centre, centre)
    np.fill_diagonal(away, np.inf)
    return np.argsort(away, axis=1, kind="stable")[:, :k]


def nearby_lists(queries: np.ndarray, centre: np.ndarray, links: np.ndarray, prune: float = PRUNE) -> tuple[np.ndarray, np.ndarray]:
    """(query, list): a best-first walk in the graph for all queries side by side, then pruning by distance ratio.

    A walk starts at a few centroids and goes on from whatever lies within the ratio of the best so far.
    """
    n, c = len(queries), len(centre)
    away = np.full((n, c), np.inf)
    open_ = np.zeros((n, c), dtype=bool)
    starts = np.arange(0, c, max(1, int(c**0.5)))
    away[:, starts] = np.sqrt(_squared(queries, centre[starts]))
    open_[:, starts] = True
    done = np.zeros((n, c), dtype=bool)
    while True:
        best = away.min(1, keepdims=True)
        q, at = np.nonzero(open_ & ~done & (away <= best * (1 + prune)))
        if not len(q):
            break
        done[q, at] = True
        if links.shape[1]:
            seen = np.zeros((n, c), dtype=bool)
            seen[np.repeat(q, links.shape[1]), links[at].ravel()] = True
            q, at = np.nonzero(seen & ~open_)
            away[q, at] = np.sqrt(np.maximum(0, ((queries[q] - centre[at]) ** 2).sum(1)))
            open_[q, at] = True
    return np.nonzero(away <= away.min(1, keepdims=True) * (1 + prune))


def lists_of(vectors: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vector, list, whether it is the nearest): the lists that hold each vector."""
    away = np.sqrt(_squared(vectors, centre))
    k = min(REPLICAS, len(centre))
    first = np.argpartition(away, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(away, first, 1)
    row, place = np.nonzero(near <= near.min(1, keepdims=True) * (1 + REPLICATE))
    lists = first[row, place]
    return row, lists, lists == first[np.arange(len(first)), near.argmin(1)][row]


def _listed(vectors: DataFrame, shared) -> DataFrame:
    """(list, vec_id, v): each vector in its lists."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = shared.value[0]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                row, lists, own = lists_of(_matrix(some.column("v")), centre)  # own: once for each vector
                columns = [pa.array(lists.astype(np.int32)), pa.array(own), *(some.column(c).take(pa.array(row)) for c in ("vec_id", "v"))]
                yield pa.RecordBatch.from_arrays(columns, ["list", "own", "vec_id", "v"])

    return vectors.select("vec_id", "v").mapInArrow(assign, "list int, own boolean, vec_id bigint, v array<double>")


def enough_lists(queries: np.ndarray, centre: np.ndarray, row: np.ndarray, place: np.ndarray, size: np.ndarray, need: int):
    """(query, list) with more lists, nearest first, for queries whose lists hold fewer than ``need`` vectors of their own."""
    short = np.flatnonzero(np.bincount(row, size[place], len(queries)) < need)
    if not len(short):
        return row, place
    order = np.argsort(_squared(queries[short], centre), axis=1, kind="stable")
    held = np.cumsum(size[order], axis=1)
    at, nth = np.nonzero(held - size[order] < need)  # up to the list that makes it enough
    pairs = np.stack([np.concatenate([row, short[at]]), np.concatenate([place, order[at, nth]])])
    return tuple(np.unique(pairs, axis=1))


def first_lists(queries: np.ndarray, centre: np.ndarray, row: np.ndarray, place: np.ndarray, least: int):
    """(query, list) with the ``least`` nearest lists of every query among them."""
    least = min(least, len(centre))
    if not least:
        return row, place
    near = np.argpartition(_squared(queries, centre), least - 1, axis=1)[:, :least]
    pairs = np.stack([np.concatenate([row, np.repeat(np.arange(len(queries)), least)]), np.concatenate([place, near.ravel()])])
    return tuple(np.unique(pairs, axis=1))


def _true_neighbours(table: DataFrame, asked: np.ndarray, own: np.ndarray, k: int) -> pa.Table:
    """(trial, v) of the ``k`` nearest rows to each trial query, from a comparison with every row.

    A task keeps the nearest of its own rows only, so it sends ``k`` rows for each query.
    """
    shared = table.sparkSession.sparkContext.broadcast((asked, own))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, own = shared.value
        n, d = asked.shape
        score, ids, held = np.zeros((n, 0)), np.zeros((n, 0), np.int64), np.zeros((n, 0, d))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                x, new = _matrix(some.column("v")), some.column("vec_id").to_numpy(zero_copy_only=False)
                away = np.sqrt(_squared(asked, x))
                away[own[:, None] == new[None]] = np.inf
                both, had = np.concatenate([score, away], axis=1), score.shape[1]
                keep = np.argpartition(both, k - 1, axis=1)[:, :k] if both.shape[1] > k else np.tile(np.arange(both.shape[1]), (n, 1))
                old, rows = keep < had, np.arange(n)[:, None].repeat(keep.shape[1], 1)
                kept = np.empty((*keep.shape, d))
                kept[old] = held[rows[old], keep[old]]
                kept[~old] = x[keep[~old] - had]
                ids = np.take_along_axis(np.concatenate([ids, np.tile(new, (n, 1))], axis=1), keep, 1)
                score, held = np.take_along_axis(both, keep, 1), kept
        row, place = np.nonzero(np.isfinite(score))
        if len(row):
            flat = pa.array(held[row, place].ravel())
            v = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * d), flat)
            columns = [pa.array(row.astype(np.int32)), pa.array(ids[row, place]), pa.array(score[row, place]), v]
            yield pa.RecordBatch.from_arrays(columns, ["trial", "vec_id", "score", "v"])

    found = table.select("vec_id", "v").mapInArrow(nearest, "trial int, vec_id bigint, score double, v array<double>")
    place = F.row_number().over(Window.partitionBy("trial").orderBy("score", "vec_id"))
    return found.withColumn("place", place).filter(F.col("place") <= k).select("trial", "v").toArrow()


def lists_needed(asked: np.ndarray, row: np.ndarray, place: np.ndarray, trial: np.ndarray, near: np.ndarray, centre: np.ndarray) -> int:
    """How many of its nearest lists a query must search for ``RECALL`` of the true neighbours ``near`` of the queries ``trial``,
    if the lists (``row``, ``place``) are searched in any case."""
    if not len(near):
        return 0
    away = _squared(asked, centre)
    order = np.empty(away.shape, dtype=np.int64)
    np.put_along_axis(order, np.argsort(away, axis=1, kind="stable"), np.arange(1, len(centre) + 1)[None], 1)
    order[row, place] = 0
    vector, lists, _ = lists_of(near, centre)
    least = np.full(len(near), len(centre))
    np.minimum.at(least, vector, order[trial[vector], lists])
    return int(np.sort(least)[int(np.ceil(RECALL * len(near))) - 1])


def _asked(queries: DataFrame, shared, size: np.ndarray, need: int, least: int) -> DataFrame:
    """(list, query_id, v): each query with the lists it searches."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, links = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                asked = _matrix(some.column("v"))
                row, place = enough_lists(asked, centre, *nearby_lists(asked, centre, links), size, need)
                row, place = first_lists(asked, centre, row, place, least)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(place.astype(np.int32)), some.column("vec_id").take(pa.array(row)), some.column("v").take(pa.array(row))],
                    ["list", "query_id", "v"],
                )

    return queries.select("vec_id", "v").mapInArrow(choose, "list int, query_id bigint, v array<double>")


def _parts_of(table: DataFrame, size: int) -> Column:
    """Number of parts for ``list``, from the lengths of the lists (CENTROIDS rows at most)."""
    counts = {r.list: r["count"] for r in table.groupBy("list").count().collect()}
    pairs = F.array(*[F.lit(-(-counts.get(i, 0) // size) or 1) for i in range(max(counts, default=0) + 1)])
    return F.coalesce(F.get(pairs, F.col("list")), F.lit(1))


def search(vectors: DataFrame, is_query: Column, k: int = 10, lists: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found for each row for which ``is_query`` (of vec_id) holds."""
    spark = vectors.sparkSession
    ship_package(spark)
    table = materialize(valid(vectors).dropDuplicates(["vec_id", "v"]), "vectors")
    n = table.count()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    order = F.xxhash64("vec_id", F.lit(3))
    chosen = first_by_hash(table, order, SAMPLE).select("v").toArrow()
    centre = fit(_matrix(chosen.column("v")), min(CENTROIDS, lists or max(4, round(n**0.5))))
    shared = spark.sparkContext.broadcast((centre, graph(centre)))
    posted = materialize(_listed(table, shared), "postings")
    size = np.zeros(len(centre), dtype=np.int64)
    for r in posted.filter("own").groupBy("list").count().collect():  # CENTROIDS rows at most
        size[r.list] = r["count"]
    queries = table.filter(is_query)
    some = first_by_hash(queries, order, TRIALS).select("vec_id", "v").toArrow()
    least = 0
    if some.num_rows:
        trial, links = _matrix(some.column("v")), shared.value[1]
        near = _true_neighbours(table, trial, some.column("vec_id").to_numpy(), k)
        # With its own row among them, k + 1 vectors leave k others.
        row, place = enough_lists(trial, centre, *nearby_lists(trial, centre, links), size, k + 1)
        least = lists_needed(trial, row, place, near.column("trial").to_numpy(), _matrix(near.column("v")), centre)
    asked = materialize(_asked(queries, shared, size, k + 1, least), "asked")
    parts, blocks = _parts_of(posted, PART), _parts_of(asked, QUERIES)
    # Every part of a list meets every block of its queries once.
    left = posted.drop("own").withColumn("part", F.pmod(F.xxhash64("vec_id"), parts)).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    right = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), blocks)).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    key = ["list", "part", "block"]
    left, right = (x.withColumns({"part": F.col("part").cast("int"), "block": F.col("block").cast("int")}) for x in (left, right))

    def compare(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if vectors.num_rows and queries.num_rows:
            x, ids = _matrix(vectors.column("v")), vectors.column("vec_id").to_numpy()
            q, own = _matrix(queries.column("v")), queries.column("query_id").to_numpy()
            about = _squared(q, x)
            about[own[:, None] == ids[None]] = np.inf
            top = min(k, x.shape[0]) - 1
            slack = np.partition(about, top, axis=1)[:, top] * (1 + 1e-9) + 1e-9
            row, place = np.nonzero((about <= slack[:, None]) & np.isfinite(about))
            score = np.sqrt(((q[row] - x[place]) ** 2).sum(1))
            order = np.lexsort((ids[place], score, row))
            row, place, score = row[order], place[order], score[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            use = nth < k
            out.append((own[row[use]], ids[place[use]], score[use]))
        a, b, c = out[0] if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, "query_id bigint, vec_id bigint, score double")
    # Replicas of a vector share a rank, so they do not push others out.
    rank = F.dense_rank().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    best = near.withColumn("rank", rank).filter(F.col("rank") <= k).dropDuplicates(["query_id", "rank"])
    return best.select("query_id", "rank", "vec_id", "score")
