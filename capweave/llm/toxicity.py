"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents and unlabelled ones train linear classifiers in numpy
with the non-negative risk estimator (Kiryo and others, 2017): the risk of the
unlabelled documents as negatives, less the share that the class prior says the
positives have in it, is held at zero or above.  Labels of 0 are used once, for the class
prior; their texts take no part as negatives.

Features of a text are its distinct words and the first four to six bytes of
each, in lower case, as hashes of ``HASH_BITS`` bits, of which those that stand out in the
training sample get a weight.  Only text is read: no label,
language, source or id is an input of a score.

The training rows are a bounded sample in hashed order: at most ``POSITIVES`` toxic documents
for all ``MEMBERS`` classifiers and at most ``UNLABELLED`` others for each, trained in tasks of
their own.  Their weights are averaged.  The class prior is counted over all labelled rows of
the training part, and the bias is set so that the unlabelled documents score it on average.

Defined cases: a null text is empty; a text without words has the score of the
bias alone; an id that several label rows mark is toxic if one of them says so; label rows without a document
or with a null mark are passed over; without any toxic document in the training part all scores are the prior (0 where
there is no label at all).  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capweave.llm.tables import first_by_hash, materialize, ship_package
from capweave.llm.words import chunks, mixed, span_hashes

HASH_BITS = 44
#: Bits of a hash that a table of flags looks at before the exact search.
FLAG_BITS = 22
PREFIXES = (4, 5, 6)
MEMBERS = 3
POSITIVES = 3000
UNLABELLED = 6000
#: Texts of the training sample whose features are taken at a time.
PIECE = 500
#: A feature gets a weight if so many toxic documents of the sample have it, if it is so many times as
#: frequent among them as among the unlabelled, and if that is so many standard deviations from chance.
SUPPORT = 4
LIFT = 3.0
DEVIATIONS = 5.0
STEPS = 200
RATE = 0.1
SHRINK = 1e-4
THRESHOLD = 0.3

# Bytes that belong to words: letters, digits and everything beyond ASCII.
_WORD_BYTE = np.full(256, 0x20, dtype=np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _WORD_BYTE[_b] = _b


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


_HASH = np.uint64((1 << HASH_BITS) - 1)
_FLAG = np.uint64((1 << FLAG_BITS) - 1)


def features(texts: pa.Array, flags: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(texts before, texts, text, hash): the distinct features of pieces of a column, of those only that ``flags`` lets pass."""
    lowered = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    if isinstance(lowered, pa.ChunkedArray):
        lowered = lowered.combine_chunks()
    if not len(lowered):
        return
    offsets = np.frombuffer(lowered.buffers()[1], dtype=np.int64)[lowered.offset : lowered.offset + len(lowered) + 1]
    body = lowered.buffers()[2]
    data = _WORD_BYTE[np.frombuffer(body, dtype=np.uint8)] if body else np.zeros(0, dtype=np.uint8)
    plain = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(lowered), [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(data)]
    ).view(pa.large_string())
    for at, words in chunks(plain):
        text = np.repeat(np.arange(words.n, dtype=np.uint64), words.count)
        found = []
        for size in (None, *PREFIXES):
            cut = words.end if size is None else np.minimum(words.end, words.start + size)
            h = mixed(span_hashes(words.data, words.start, cut) + np.uint64(size or 0)) & _HASH
            use = slice(None) if flags is None else flags[h & _FLAG]
            found.append((text[use] << np.uint64(HASH_BITS)) | h[use])
        packed = np.unique(np.concatenate(found))
        yield at, words.n, (packed >> np.uint64(HASH_BITS)).astype(np.int64), packed & _HASH


def fit(positive: tuple[np.ndarray, np.ndarray, int], unlabelled: tuple[np.ndarray, np.ndarray, int], prior: float):
    """(hashes, weights, bias).  Each side is (text, hash, number of texts), every pair of text and hash once."""
    known, support = np.unique(positive[1], return_counts=True)
    place = lambda h: np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
    there = known[place(unlabelled[1])] == unlabelled[1] if len(known) else np.zeros(len(unlabelled[1]), dtype=bool)
    u_count = np.bincount(place(unlabelled[1])[there], minlength=len(known))
    p_rate, u_rate = support / positive[2], (u_count + 0.5) / (unlabelled[2] + 1)
    chance = np.sqrt(u_rate * (1 / positive[2] + 1 / unlabelled[2]))
    used = known[(support >= SUPPORT) & (p_rate >= LIFT * u_rate) & (p_rate - u_rate >= DEVIATIONS * chance)]
    sides = []
    for text, h, n in (positive, unlabelled):
        at = np.minimum(np.searchsorted(used, h), max(len(used) - 1, 0))
        keep = used[at] == h if len(used) else np.zeros(len(h), dtype=bool)
        sides.append((text[keep], at[keep], n))
    w, bias = np.zeros(len(used)), np.log(prior / (1 - prior))
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)

    def margin(side):
        return np.bincount(side[0], w[side[1]], side[2]) + bias

    def pull(side, slope):  # gradient of a mean over texts
        return np.append(np.bincount(side[1], slope[side[0]], len(used)), slope.sum()) / side[2]

    squash = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    loss = lambda z: np.logaddexp(0, z)
    p, u = sides
    for step in range(1, STEPS + 1):
        zp, zu = margin(p), margin(u)
        gain = prior * pull(p, -squash(-zp))
        rest = pull(u, squash(zu)) - prior * pull(p, squash(zp))
        negative = loss(zu).mean() - prior * loss(zp).mean()
        slope = gain + rest if negative >= 0 else -rest
        slope[:-1] += SHRINK * w
        m = 0.9 * m + 0.1 * slope
        v = 0.999 * v + 0.001 * slope**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1]
        bias -= move[-1]
    # The bias at which the mean score of the unlabelled texts is the class prior.
    bare = margin(u) - bias
    low, high = -60.0, 60.0
    for _ in range(60):
        bias = (low + high) / 2
        low, high = (low, bias) if squash(bare + bias).mean() > prior else (bias, high)
    return used, w, bias


def flags_of(hashes: np.ndarray) -> np.ndarray:
    """Flags that rule out most other hashes."""
    flags = np.zeros(1 << FLAG_BITS, dtype=bool)
    flags[hashes & _FLAG] = True
    return flags


class Model:
    """Hashes in order with their weights, the bias, and flags that rule out most other hashes."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        self.hashes, self.weights, self.bias = hashes, weights, bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.empty(len(texts))
        for at, n, text, h in features(texts, flags_of(self.hashes)):
            z = np.full(n, self.bias)
            if len(self.hashes):
                place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                hit = self.hashes[place] == h
                z += np.bincount(text[hit], self.weights[place[hit]], n)
            out[at : at + n] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return out


def mean_of(members: list[tuple[np.ndarray, np.ndarray, float]]) -> Model:
    hashes, place = np.unique(np.concatenate([h for h, _, _ in members]), return_inverse=True)
    total = np.bincount(place, np.concatenate([w for _, w, _ in members]), len(hashes))
    return Model(hashes, total / len(members), float(np.mean([b for _, _, b in members])))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The mean of the members, from the training part of ``labels`` and from ``docs``."""
    ship_package(docs.sparkSession)
    none = (np.zeros(0, dtype=np.uint64), np.zeros(0))
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    marks = marks.groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    n, toxic = marks.agg(F.count("*"), F.count_if("toxic")).first()
    if not toxic:
        return Model(*none, -40.0)
    prior = min(max(toxic / n, 1e-4), 0.5)
    texts = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")
    order = F.xxhash64("doc_id", F.lit(11))
    # Choose by id first; texts are read for the chosen ones only.
    known = texts.select("doc_id").join(marks.filter("toxic"), "doc_id").select("doc_id", F.lit(1).alias("side"))
    other = texts.select("doc_id").filter(~held_out()).join(labels.select("doc_id"), "doc_id", "left_anti")
    other = other.select("doc_id", F.lit(0).alias("side"))
    some = [first_by_hash(x.distinct(), order, k) for x, k in ((known, POSITIVES), (other, UNLABELLED * MEMBERS))]
    chosen = materialize(some[0].unionByName(some[1]), "chosen")
    rows = texts.join(F.broadcast(chosen), "doc_id")  # POSITIVES + MEMBERS * UNLABELLED rows at most

    def learn(table: pa.Table) -> pa.Table:
        sides, known = [], None
        for side in (1, 0):
            part = table.filter(pc.equal(table.column("side"), side)).column("text")
            texts, hashes = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.uint64)]
            flags = None if known is None else flags_of(known)
            for begin in range(0, len(part), PIECE):  # only a piece of the texts is held in lower case
                for at, _, t, h in features(part.slice(begin, PIECE), flags):
                    if known is not None and len(known):  # of the unlabelled, only what a weight can go to
                        use = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
                        t, h = t[use], h[use]
                    texts.append((t + (begin + at)).astype(np.int32))
                    hashes.append(h)
            texts, hashes = np.concatenate(texts), np.concatenate(hashes)
            if known is None:
                known, support = np.unique(hashes, return_counts=True)
                known = known[support >= SUPPORT]
                if len(known):  # nor can a weight go to what few toxic texts have
                    use = known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes
                    texts, hashes = texts[use], hashes[use]
            sides.append((texts, hashes, len(part)))
        made = [fit(*sides, prior)] if sides[0][2] and sides[1][2] else []
        return pa.table(
            {
                "h": pa.array([x[0].tobytes() for x in made], pa.binary()),
                "w": pa.array([x[1].tobytes() for x in made], pa.binary()),
                "b": pa.array([float(x[2]) for x in made], pa.float64()),
            }
        )

    every, own = F.sequence(F.lit(0), F.lit(MEMBERS - 1)), F.array(F.pmod(F.shiftright("o", 7), F.lit(MEMBERS)).cast("int"))
    members = rows.withColumn("member", F.explode(F.when(F.col("side") == 1, every).otherwise(own)))
    made = members.groupBy("member").applyInArrow(learn, "h binary, w binary, b double").collect()  # MEMBERS rows
    found = [(np.frombuffer(r.h, dtype=np.uint64), np.frombuffer(r.w), r.b) for r in made]
    return mean_of(found) if found else Model(*none, float(np.log(prior / (1 - prior))))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``; a column of that name in ``docs`` is replaced."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(texts))

    return docs.withColumn("score", score("text"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with held_out, score and predicted."""
    done = scored(docs, train(docs, labels))
    return done.withColumn("held_out", held_out()).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
