"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A document is the multiset of its five-word shingles; a shingle weighs its count
times a damped inverse document frequency.  Improved consistent weighted sampling
(Ioffe, 2010) draws ``BANDS * ROWS`` samples of it such that two documents agree in
a sample with a probability equal to their weighted Jaccard similarity.  Documents
that agree in all rows of a band are candidates, those whose samples agree too
rarely for the threshold are set aside, and the rest are verified on their whole
texts.  Classes are the connected components of the verified links.

Large buckets take two steps.  In a bucket of more than ``PAIRED`` documents all are
verified against one pivot, the document that shares its buckets with most others.  A
pair whose documents are in one component by then says nothing new.  Of the others none
is left out: where a bucket still holds several components, each document outside the
largest one meets all documents of other components, in blocks of ``BLOCK`` documents.
Texts go to the blocks once, and a pair of blocks compares its documents by their samples and
those that agree often enough by their whole texts.  It hands on one link for each two
components it joins, so no table has a row for each pair.

Document frequencies are counted over all documents in ``BUCKETS`` hash buckets, less the mean
load of a bucket, so the table that is broadcast has a fixed size.  The factor lies
between 1 and ``1 + DAMPING``: it steers the samples away from common passages, but keeps
the similarity of a large group of near copies close to the plain one.

Defined cases: a null text is empty; documents with the same words in the same
order are copies of each other, those without any word too; a text of one to four
words is one shingle.  A null id joins a class like any other and is the least.
Rows with the same id are told apart by their texts.  An empty table gives an
empty result.  Of the input only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capweave.llm.tables import id_key, materialize, ship_package, text_of
from capweave.llm.words import Words, chunks, mixed, shingles

SIMILARITY = 0.8
BANDS = 12
ROWS = 4
BUCKETS = 1 << 18
DAMPING = 0.25
PAIRED = 16
#: Documents of a crowded bucket that are compared in one place with as many others.
BLOCK = 512
#: Bits of the table that tells which texts pairs may need.
FLAGS = 1 << 24
#: Least share of samples in which a pair must agree to be verified: four and a half
#: standard deviations below the threshold.
AGREEMENT = 26

_SAMPLES = BANDS * ROWS
_TABLE = 1 << 14


def _draws() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) for r, and logarithms of another such variable for c."""
    p = (np.arange(_TABLE) + 0.5) / _TABLE
    x = np.linspace(1e-6, 40, 400_000)
    gamma = np.interp(p, 1 - np.exp(-x) * (1 + x), x)
    return gamma.astype(np.float32), np.log(gamma).astype(np.float32)


_R, _LOG_C = _draws()
_SALT = mixed(np.arange(1, _SAMPLES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def sample(key: np.ndarray, log_weight: np.ndarray, head: np.ndarray) -> np.ndarray:
    """One row of 64-bit samples for each document; ``head`` holds the place of its first shingle."""
    out = np.empty((len(head), _SAMPLES), dtype=np.uint64)
    place = np.arange(len(key), dtype=np.uint64)
    seed = key.astype(np.uint64)
    for k in range(_SAMPLES):
        bits = (seed ^ _SALT[k]) * np.uint64(0xBF58476D1CE4E5B9)
        bits ^= bits >> np.uint64(29)
        bits *= np.uint64(0x94D049BB133111EB)
        r = _R[(bits >> np.uint64(50)).astype(np.int32)]
        log_c = _LOG_C[(bits >> np.uint64(36)).astype(np.int32) & (_TABLE - 1)]
        beta = ((bits >> np.uint64(12)).astype(np.uint32) >> np.uint32(8)).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(log_weight / r + beta)
        log_a = log_c - r * (t - beta + 1)
        # The least value of each document with its place: positive floats sort like their bits, and
        # equal values go to the lesser shingle.
        packed = (log_a + np.float32(256)).view(np.uint32).astype(np.uint64) << np.uint64(32) | place
        first = (np.minimum.reduceat(packed, head) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        out[:, k] = mixed(seed[first] * np.uint64(31) + t[first].astype(np.int64).astype(np.uint64))
    return out


def _batches(column: str, batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for at, words in chunks(batch.column(column)):
            yield batch, at, words


def document_frequency(texts: DataFrame) -> np.ndarray:
    """Estimated number of texts with a shingle, by hash bucket of the shingle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for _, _, words in _batches("text", batches):
            total += np.bincount(shingles(words)[1] % BUCKETS, minlength=BUCKETS)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(total[full])], ["bucket", "n"])

    parts = texts.select("text").mapInArrow(count, "bucket int, n bigint")
    found = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows at most
    made = np.zeros(BUCKETS, dtype=np.float64)
    made[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return np.maximum(1.0, made - made.sum() / BUCKETS)


def weights(frequency: np.ndarray, n: int) -> np.ndarray:
    """The damped inverse document frequency of each bucket, from 1 to 1 + DAMPING."""
    idf = np.log((1.0 + n) / (1.0 + np.minimum(frequency, n))) / np.log(2.0 + n)
    return (1.0 + DAMPING * idf).astype(np.float32)


def weighted_jaccard(left: pa.Array, right: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Similarity of texts that stand side by side."""
    out = np.zeros(len(left))
    step = 512
    for at in range(0, len(left), step):
        sides = []
        for texts in (left.slice(at, step), right.slice(at, step)):
            found = [(t + base, s, c) for base, w in chunks(texts) for t, s, c in [shingles(w)]]
            text, key, count = (np.concatenate(x) for x in zip(*found))
            sides.append(((text.astype(np.uint64) << np.uint64(48)) | key.astype(np.uint64), key, count))
        (a, key_a, count_a), (b, key_b, count_b) = sides
        n = len(left.slice(at, step))
        owner = lambda x: (x >> np.uint64(48)).astype(np.int64)
        size = np.bincount(owner(a), count_a * idf[key_a % BUCKETS], n) + np.bincount(owner(b), count_b * idf[key_b % BUCKETS], n)
        both, in_a, in_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        common = np.minimum(count_a[in_a], count_b[in_b]) * idf[key_a[in_a] % BUCKETS]
        shared = np.bincount(owner(both), common, n) if len(both) else np.zeros(n)
        out[at : at + n] = np.divide(shared, size - shared, out=np.zeros(n), where=size > shared)
    return out


def content(words: Words) -> np.ndarray:
    """128 bits of the words in order for each text, as two columns; zero for a text without words."""
    out = np.zeros((words.n, 2), dtype=np.uint64)
    hashed = words.hashes()
    some = np.flatnonzero(words.count)
    if len(some):
        place = mixed((np.arange(len(hashed)) - np.repeat(words.first[:-1], words.count)).astype(np.uint64))
        head = words.first[some]
        out[some, 0] = np.add.reduceat(mixed(hashed ^ place), head)
        out[some, 1] = np.add.reduceat(mixed(hashed * np.uint64(0xD1B54A32D192ED03) + place), head)
    return out


def _signatures(texts: DataFrame, idf) -> DataFrame:
    """(key, words, bands, sig) of each text: digest of its words, key of each band, a byte of each sample.

    ``bands`` and ``sig`` are null for a text without words.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, words in _batches("text", batches):
            text, key, count = shingles(words)
            samples = np.zeros((words.n, _SAMPLES), dtype=np.uint64)
            if len(text):
                head = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
                weight = count * idf.value[key % BUCKETS]
                samples[text[head]] = sample(key, np.log(weight).astype(np.float32), head)
            bands = samples.reshape(words.n, BANDS, ROWS)
            joined = np.zeros((words.n, BANDS), dtype=np.uint64)
            for r in range(ROWS):
                joined = mixed(joined * np.uint64(0x100000001B3) + bands[:, :, r])
            sig = (samples & np.uint64(255)).astype(np.uint8)
            none = pa.array(words.count == 0)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(joined.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
            same = pa.array([x.tobytes() for x in content(words)], pa.binary())
            signs = pa.array([x.tobytes() for x in sig], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").slice(at, words.n), same, pc.if_else(none, None, lists), pc.if_else(none, None, signs)],
                ["key", "words", "bands", "sig"],
            )

    return texts.select("key", "text").mapInArrow(sign, "key binary, words binary, bands array<bigint>, sig binary")


def _agree(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose samples agree often enough, without the samples."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, _SAMPLES) for c in ("sa", "sb"))
            keep = pa.array((a == b).sum(axis=1) >= AGREEMENT)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    return pairs.select("a", "b", "sa", "sb").mapInArrow(check, "a binary, b binary")


def _verified(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """The pairs of ``pairs`` with a weighted Jaccard similarity of at least SIMILARITY."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = pa.array(weighted_jaccard(batch.column("ta"), batch.column("tb"), idf.value) >= SIMILARITY)
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    left = texts.select(F.col("key").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("tb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInArrow(verify, "a binary, b binary")


def _marked(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``texts`` (key, text) whose key may be among ``keys``; all that are stay.

    A table of ``FLAGS`` bits by hash of the key, whatever the number of keys, so that most texts
    that no pair needs are left out before they are shuffled.
    """
    at = F.pmod(F.xxhash64("key"), F.lit(FLAGS))
    word = keys.select(at.alias("at")).groupBy(F.expr("at div 64").alias("w"))
    found = word.agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 AS int))")).alias("b")).toArrow()  # FLAGS / 64 rows at most
    made = np.zeros(FLAGS // 64, dtype=np.int64)
    made[found.column("w").to_numpy()] = found.column("b").to_numpy()
    flags = texts.sparkSession.sparkContext.broadcast(np.unpackbits(made.view(np.uint8), bitorder="little").view(bool))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["key", "text"]).filter(pa.array(flags.value[batch.column("at").to_numpy()]))

    return texts.select("key", "text", at.alias("at")).mapInArrow(choose, "key binary, text string")


def _blocks(crowded: DataFrame, root: DataFrame) -> DataFrame:
    """(bucket, x, y, own, rep, comp): documents of buckets with several components, dealt to pairs of blocks.

    Documents outside the bucket's largest component have blocks of their own, which come first.  These
    meet every block, the others only them: x is always one of the first.
    """
    known = crowded.select("bucket", "rep", "n").join(root, crowded.rep == root.node, "left")
    known = materialize(known.select("bucket", "rep", "n", F.coalesce("root", "rep").alias("comp")), "crowd")
    parts = known.groupBy("bucket", "comp").agg(F.count("*").alias("size"))
    main = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.max(F.struct("size", "comp")).alias("m"))
    main = main.filter("parts > 1").select("bucket", F.col("m.comp").alias("main"), F.col("m.size").alias("size"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    placed = known.join(main, "bucket").withColumn("minor", F.col("comp") != F.col("main"))
    placed = placed.withColumn("minors", blocks(F.col("n") - F.col("size"))).withColumn("majors", blocks(F.col("size")))
    spread = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    own = F.when(F.col("minor"), spread(F.col("minors"))).otherwise(F.col("minors") + spread(F.col("majors")))
    last = F.when(F.col("minor"), F.col("minors") + F.col("majors")).otherwise(F.col("minors")) - 1
    dealt = placed.select("bucket", "rep", "comp", own.alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    return dealt.select("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "rep", "comp")


def _alike(left: tuple, right: tuple, idf: np.ndarray, n: int) -> np.ndarray:
    """Weighted Jaccard similarity of one text with ``n`` others.

    ``left``: its shingles, their counts and its weight; ``right``: shingles in order, with text and count, and weights.
    """
    key, count, size = left
    keys, text, counts, sizes = right
    low = np.searchsorted(keys, key)
    many = np.searchsorted(keys, key, side="right") - low
    at = np.arange(many.sum()) + np.repeat(low - np.cumsum(many) + many, many)
    common = np.minimum(np.repeat(count, many), counts[at]) * np.repeat(idf[key % BUCKETS], many)
    shared = np.bincount(text[at], common, n) if len(at) else np.zeros(n)
    total = size + sizes
    return np.divide(shared, total - shared, out=np.zeros(n), where=total > shared)


def _across(dealt: DataFrame, idf) -> DataFrame:
    """Verified links (a, b) across components, as many as join the components that a pair of blocks joins."""

    def compare(table: pa.Table) -> pa.Table:
        own, first, other = table.column("own").to_numpy(), table.column("x")[0].as_py(), table.column("y")[0].as_py()
        rep = table.column("rep").to_pylist()
        comp = np.unique(np.array(table.column("comp").to_pylist(), dtype=object), return_inverse=True)[1]
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, _SAMPLES)
        texts = table.column("text").combine_chunks()
        left, right = np.flatnonzero(own == first), np.flatnonzero(own == other)
        weight = idf.value
        mine = {}
        for at, words in chunks(texts.take(pa.array(left))):
            text, key, count = shingles(words)
            bounds = np.searchsorted(text, np.arange(words.n + 1))
            size = np.bincount(text, count * weight[key % BUCKETS], words.n)
            for k in range(words.n):
                mine[int(left[at + k])] = key[bounds[k] : bounds[k + 1]], count[bounds[k] : bounds[k + 1]], size[k]
        joined = comp.copy()  # the component of each document, with what this pair of blocks has joined
        a, b = [], []
        for at, words in chunks(texts.take(pa.array(right))):
            some = right[at : at + words.n]
            text, key, count = shingles(words)
            size = np.bincount(text, count * weight[key % BUCKETS], words.n)
            order = np.argsort(key, kind="stable")
            theirs = key[order], text[order], count[order], size
            for i in left:
                apart = np.flatnonzero(joined[some] != joined[i])
                apart = apart[(sig[some[apart]] == sig[i]).sum(axis=1) >= AGREEMENT]
                if not len(apart):
                    continue
                near = apart[_alike(mine[int(i)], theirs, weight, words.n)[apart] >= SIMILARITY]
                for j in some[near]:
                    if joined[j] != joined[i]:
                        a.append(min(rep[i], rep[j]))
                        b.append(max(rep[i], rep[j]))
                        joined[joined == joined[j]] = joined[i]
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return dealt.groupBy("bucket", "x", "y").applyInArrow(compare, "a binary, b binary").distinct()


def links(signed: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """Verified links (a, b) between distinct documents: all in small buckets, in others enough to join what is alike.

    ``signed`` has (rep, bands, sig) of one document for each content, ``texts`` (key, text) of all.
    """
    # A bucket is named by a hash of its band.
    signs = signed.filter("sig IS NOT NULL").select("rep", "bands", "sig")
    member = signs.select("rep", F.posexplode("bands").alias("band", "bucket"))
    member = member.select("rep", F.xxhash64("band", "bucket").alias("bucket"))
    sizes = member.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    inside = materialize(member.join(sizes, "bucket"), "members")
    # The pivot is the document that shares its buckets with most others: in a group of copies of one
    # text, with changes of their own, that is the one with the fewest changes.
    crowded = inside.filter(F.col("n") > PAIRED)
    crowd = crowded.withColumn("crowd", F.sum("n").over(Window.partitionBy("rep")))  # a row for each bucket of a document
    central = F.max(F.struct("crowd", F.xxhash64("rep").alias("o"), "rep")).alias("p")
    pivots = crowd.groupBy("bucket").agg(central).select("bucket", F.col("p.rep").alias("pivot"))
    pivots = materialize(pivots.join(signs.select(F.col("rep").alias("pivot"), F.col("sig").alias("ps")), "pivot"), "pivots")
    # Samples join the documents that share a bucket with another only.
    small = inside.filter(F.col("n") <= PAIRED).join(signs.select("rep", "sig"), "rep")
    left = small.select("bucket", F.col("rep").alias("a"), F.col("sig").alias("sa"))
    right = small.select("bucket", F.col("rep").alias("b"), F.col("sig").alias("sb"))
    paired = left.join(right, "bucket").filter("a < b").select("a", "b", "sa", "sb")
    # A document meets the same pivot in most of its buckets, and its samples join it once for each pivot.
    large = crowded.join(pivots, "bucket").filter("rep <> pivot").select("rep", "pivot", "ps").dropDuplicates(["rep", "pivot"])
    starred = large.join(signs.select("rep", "sig"), "rep").select(
        F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"), F.col("sig").alias("sa"), F.col("ps").alias("sb")
    )
    # Documents that meet in several buckets are compared once.
    seen = materialize(_agree(paired.unionByName(starred).dropDuplicates(["a", "b"])), "candidates")
    # The texts of all that are compared here or in blocks.
    ends = seen.select(F.explode(F.array("a", "b")).alias("key"))
    ends = materialize(ends.unionByName(crowded.select(F.col("rep").alias("key"))).distinct(), "needed")
    needed = materialize(_marked(texts, ends).join(ends, "key", "left_semi").dropDuplicates(["key"]), "texts")
    found = materialize(_verified(seen, needed, idf), "links")
    if not crowded.limit(1).count():
        return found
    dealt = materialize(_blocks(crowded, components(found)), "blocks")
    if not dealt.limit(1).count():
        return found
    # The samples and the text of a document join it once, and go with it to its blocks.
    cast = dealt.groupBy("rep").agg(F.collect_list(F.struct("bucket", "x", "y", "own", "comp")).alias("c"))
    cast = cast.join(signs.select("rep", "sig"), "rep").join(needed.select(F.col("key").alias("rep"), "text"), "rep")
    cast = cast.select("rep", "sig", "text", F.explode("c").alias("c")).select("rep", "sig", "text", "c.*")
    return found.unionByName(materialize(_across(cast, idf), "across"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of the component of each node of ``edges`` (a, b).

    Alternates large-star and small-star steps (Kiveris and others, 2014) until a step changes nothing.
    A step needs one number from the executors, and no step gathers a neighbourhood in one task.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        low = materialize(low, "least")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "large-star")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        tied = large.join(low, "u")
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = materialize(small.filter("u <> v").distinct(), "small-star")
        total = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == total:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = total


def key_of(doc_id: str = "doc_id", text: str = "text") -> Column:
    """16 bytes that sort like the id and tell texts of the same id apart."""
    number = F.hex(id_key(doc_id).bitwiseXOR(F.lit(-(1 << 63))))
    return F.unhex(F.concat(F.lpad(number, 16, "0"), F.lpad(F.hex(F.xxhash64(text_of(text))), 16, "0")))


def id_of(key: Column) -> Column:
    """The id in a key; null for the key of a null id."""
    half = F.lit(str(1 << 63)).cast("decimal(20,0)")
    number = F.conv(F.hex(F.substring(key, 1, 8)), 16, 10).cast("decimal(20,0)") - half
    return F.nullif(number, -half).cast("bigint")


def classes(docs: DataFrame) -> DataFrame:
    """(key, class, links) for each row of ``docs``.

    ``key`` is that of :func:`key_of`; ``class`` is the least key of the document's class and
    ``links`` the number of links to documents with other words that were verified: all in small
    buckets, in crowded ones only as many as join the class.
    """
    spark = docs.sparkSession
    ship_package(spark)
    keyed = docs.select(key_of().alias("key"), text_of().alias("text"))
    idf = spark.sparkContext.broadcast(weights(document_frequency(keyed), docs.count()))
    signed = materialize(_signatures(keyed, idf), "signatures")
    # One document stands for all with the same words; equal contents meet by partial sums.
    first = signed.groupBy("words").agg(F.min(F.struct(F.col("key").alias("rep"), "bands", "sig")).alias("f"))
    first = materialize(first.select("words", "f.*"), "copies")
    made = links(first, keyed, idf)
    root = components(made)
    degree = made.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    known = materialize(root.join(degree, "node", "full_outer"), "classes")
    named = first.join(known, first.rep == known.node, "left").select(
        "words", F.coalesce("root", "rep").alias("class"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links")
    )
    return signed.select("key", "words").join(materialize(named, "named"), "words").select("key", "class", "links")


def survivors(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: a row of the class's least document."""
    least = classes(docs).filter(F.col("key") == F.col("class")).select(F.col("key").alias("_nd_key")).distinct()
    kept = docs.withColumn("_nd_key", key_of()).join(least, "_nd_key", "left_semi")
    return kept.dropDuplicates(["_nd_key"]).drop("_nd_key")
