"""Language-model scoring by a weighted backoff automaton, in blocks that ask for their n-grams.

Training texts are cut into tokens (words of A-Z lower-cased text, then one end
token).  Their n-grams up to ``ORDER`` are counted over the whole training part,
with no pruning, so what the model holds grows with the corpus.  The smoothed
model is absolute discounting interpolated with the order below, put in backoff
form: every context seen in training is a *state*; every n-gram seen in training
is an *arc* from its context state with its full probability; every state but the
empty one has a *failure arc* to the state of its context less the first token,
weighted by the mass ``DISCOUNT * distinct followers / count`` left for unseen
followers.  The empty state gives every token the add-``SMOOTH`` unigram
probability, with one more type for all words never seen.

A text is scored by one left-to-right traversal: the state is the longest
suffix of the history that is a state; a token with no arc from the state
follows failure arcs (adding their log weights) until one has it, and the log10
probabilities of all tokens add up.  The state at a token is fixed by the
``ORDER - 1`` tokens before it, so the walk's step is computed once for every
distinct ``ORDER``-gram of a block of texts, and every token looks up its step.

No row is made for a token.  Texts are gathered in blocks of some ``BLOCK_TOKENS``
tokens, and what tasks send each other are packed arrays, in three rounds:

1. A block sends its distinct n-grams of every order, as sorted 63-bit hashes with
   their training counts, to *buckets* (ranges of hashes), and the numbers of its
   words to itself.  Hashes of n-grams are spread evenly however often one occurs,
   and a block names an n-gram once, so no bucket is crowded by a common n-gram.
2. A bucket names, for every n-gram seen in training, one block that has it there.
   A block adds up how many followers of each of its contexts it was named for and
   sends that: over all blocks this is the number of distinct followers, as every
   arc is added by one block only, and a common context gets a number from each block.
3. A bucket adds up counts and followers of its n-grams and answers every block, for
   its n-grams in their order.  As a context occurs as often as it is followed, its
   count is that of the n-gram.  The block computes arcs, failure arcs and the walk.

All of a round's messages go through one exchange by bucket or block; later rounds
read the exchange of the first again.  No table of the model is broadcast or in
one place, as it grows with the corpus.  N-grams are matched by their hashes.

Defined cases: a null text is empty and has one token, the end; repeated rows
are scored alike and all count in training; a null ``doc_id`` trains (as for the
toxicity split); an empty training part gives N = V = 0, every base and model
term is log10(1) = 0.  The start of a text is a context of ``ORDER - 1`` start
markers, which are never tokens.  Extra input columns but the text are kept by
:func:`score`.
"""

from __future__ import annotations

import ctypes
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructType

from capweave.llm.tables import ship_package
from capweave.llm.words import Words, chunks, mixed, span_hashes

ORDER = 3
DISCOUNT = 0.75
SMOOTH = 0.1
HELD_OUT_MOD = 10
MADE = ("held_out", "n_tokens", "n_known", "base_score", "score", "train_tokens")
#: Tokens of a block, and a chunk of texts more: arrays of 8 bytes a token, some six at the peak.
BLOCK_TOKENS = 3 << 20
#: Bytes of text that a bucket counts the n-grams of, and the least number of buckets.
BUCKET_BYTES = 8 << 20
LEAST_BUCKETS = 64
#: N-grams that are worked out at a time, and that are sorted at a time.
SLICE = 1 << 17
SORTED = 1 << 19
#: Bytes of messages that are handed on at once.
SENT_BYTES = 8 << 20

_MESSAGE = "target bigint, sender bigint, body binary"
_SENT = pa.schema([("target", pa.int64()), ("sender", pa.int64()), ("body", pa.binary())])
_SEEDED = np.random.default_rng(20241105)
_PLACE = _SEEDED.integers(1, 1 << 63, ORDER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Tokens that no word is: they stand for the hash of a word.
_END, _START = _SEEDED.integers(1, 1 << 63, 2, dtype=np.uint64)
_HELD = np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += np.uint8(32)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the decimal id is 0 modulo ``HELD_OUT_MOD``; a null id trains."""
    hashed = F.crc32(F.col(doc_id).cast("string").cast("binary")) % HELD_OUT_MOD == 0
    return F.coalesce(hashed, F.lit(False))


def _give_back() -> None:
    """Freed memory goes back to the system, where the C library can do that: a worker lives on, and others need the memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 as bytes: equal places of the numbers lie together.

    The highest places are compressed, each alone, down to the first that does not get smaller.
    """
    codec, parts = pa.Codec("zstd", compression_level=1), []
    for a in arrays:
        width = (int(a.max(initial=0)).bit_length() + 7) // 8
        planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize)[:, :width].T)
        small: list[bytes] = []
        while len(small) < width and len(body := codec.compress(planes[width - 1 - len(small)], asbytes=True)) < len(a):
            small.append(body)
        sizes = [len(body) for body in small]
        parts += [struct.pack(f"<IBB{len(small)}I", len(a), width, len(small), *sizes), *small, planes[: width - len(small)].tobytes()]
    return b"".join(parts)


def unpacked(body: pa.Buffer | memoryview) -> list[np.ndarray]:
    """The arrays of :func:`packed`, of 1, 2, 4 or 8 bytes a number."""
    codec, out, at = pa.Codec("zstd"), [], 0
    view = memoryview(body)
    while at < len(view):
        n, width, small = struct.unpack_from("<IBB", view, at)
        sizes = struct.unpack_from(f"<{small}I", view, at + 6)
        at += 6 + 4 * small
        whole = next(x for x in (1, 2, 4, 8) if x >= width)
        planes = np.zeros((n, whole), dtype=np.uint8)
        for k, size in enumerate(sizes):
            planes[:, width - 1 - k] = np.frombuffer(codec.decompress(view[at : at + size], decompressed_size=n), dtype=np.uint8)
            at += size
        raw = n * (width - small)
        planes[:, : width - small] = np.frombuffer(view[at : at + raw], dtype=np.uint8).reshape(width - small, n).T
        at += raw
        out.append(planes.view(f"<u{whole}").reshape(n))
    return out


class Lists:
    """What buckets say of the n-grams of a block, order by order, put together in the order of their keys."""

    def __init__(self, by_bucket: list[np.ndarray]) -> None:
        self._rest = by_bucket

    def next(self, cut: np.ndarray) -> np.ndarray:
        sizes = np.diff(cut).tolist()
        found = np.concatenate([x[:n] for x, n in zip(self._rest, sizes, strict=True)])
        if len(found) != cut[-1]:
            raise ValueError("a block was cut otherwise when it was read again")
        self._rest = [x[n:] for x, n in zip(self._rest, sizes)]
        return found


def _slices(n: int) -> Iterator[slice]:
    return (slice(at, min(at + SLICE, n)) for at in range(0, n, SLICE))


def _edges(buckets: int) -> np.ndarray:
    """The least key of every bucket but the first."""
    return np.array([(i << 63) // buckets for i in range(1, buckets)], dtype=np.uint64)


@dataclass
class Grams:
    """Distinct n-grams of one order in a block, sorted by hash."""

    cut: np.ndarray  # where those of each bucket begin, and the end of the last
    key: np.ndarray | None = None  # 63-bit hash
    count: np.ndarray | None = None  # times in training texts
    place: np.ndarray | None = None  # of one occurrence
    index: np.ndarray | None = None  # for every place, that of its n-gram here


def distinct(flagged: np.ndarray, buckets: int, keys: bool = False, places: bool = False) -> Grams:
    """N-grams from their hashes, whose lowest bit says that the text is held out; by ranges of hashes, to hold less at a time.

    ``keys``: with keys and counts.  ``places``: with places and index.
    """
    found, edges = Grams(np.zeros(buckets + 1, dtype=np.int64)), _edges(buckets)
    if places:
        found.index = np.empty(len(flagged), dtype=np.int32)
    key, count, place = [], [], []
    ranges = max(1, -(-len(flagged) // SORTED))
    for r in range(ranges):
        inside = flagged >= np.uint64((r << 64) // ranges)
        if r + 1 < ranges:
            inside &= flagged < np.uint64(((r + 1) << 64) // ranges)
        at = np.flatnonzero(inside).astype(np.int32)
        ordered = flagged[at]
        if places:
            order = np.argsort(ordered)
            ordered, at = ordered[order], at[order]
            del order
        else:
            ordered.sort()
        trained = ~ordered & _HELD
        ordered >>= np.uint64(1)
        new = np.ones(len(ordered), dtype=bool)
        new[1:] = ordered[1:] != ordered[:-1]
        start = np.flatnonzero(new)
        if places:
            place.append(at[start])
            found.index[at] = np.cumsum(new, dtype=np.int32) + np.int32(found.cut[-1] - 1)
        if keys:
            count.append(np.add.reduceat(trained, start).astype(np.uint32) if len(start) else np.zeros(0, dtype=np.uint32))
        ordered = ordered[start]
        found.cut += np.append(np.concatenate([[0], np.searchsorted(ordered, edges)]), len(ordered))
        if keys:
            key.append(ordered)
    if keys:
        found.key = np.concatenate(key)
        del key, ordered
        found.count = np.concatenate(count)
    if places:
        found.place = np.concatenate(place)
    return found


@dataclass
class Block:
    """Texts by the numbers of their words.  Behind the places of all tokens there is one place a text for its start."""

    names: np.ndarray  # hash of each word number
    words: np.ndarray  # word numbers, text behind text, without the end tokens
    length: np.ndarray  # words of each text
    held: np.ndarray  # of each text: 1 if it is held out

    def __post_init__(self) -> None:
        size = self.length.astype(np.int64) + 1
        self.n = int(size.sum())
        self.first = np.cumsum(size) - size
        self.last = self.first + size - 1

    def grams(self, buckets: int, keys: bool = False, places: bool = False) -> Iterator[Grams]:
        """The distinct n-grams of orders 1 to ``ORDER``; below ``ORDER`` the start markers are among them."""
        token = np.empty(self.n + len(self.first), dtype=np.uint64)
        inside = np.ones(self.n, dtype=bool)
        inside[self.last] = False
        token[: self.n][inside] = self.names[self.words]
        del inside
        token[self.last] = _END
        token[self.n :] = _START
        held = np.concatenate([np.repeat(self.held, self.length.astype(np.int64) + 1), self.held])
        total = np.zeros(len(token), dtype=np.uint64)
        for k in range(ORDER):
            if k:
                for own in reversed([*_slices(self.n - 1)]):
                    token[own.start + 1 : own.stop + 1] = token[own]
                token[self.first] = _START
            for own in _slices(len(token)):
                total[own] += token[own] * _PLACE[k]
            flagged = total if k == ORDER - 1 else np.empty_like(total)
            for own in _slices(len(flagged)):
                flagged[own] = mixed(total[own]) & ~_HELD | held[own]
            if k == ORDER - 1:
                del token, total
                flagged = flagged[: self.n]
            found = distinct(flagged, buckets, keys, places)
            del flagged
            yield found
            del found

    def before(self) -> np.ndarray:
        """For the place of each token the place before it: that of its context."""
        to = np.arange(-1, self.n - 1, dtype=np.int32)
        to[self.first] = np.arange(self.n, self.n + len(self.first))
        return to


_START_KEY = (mixed(np.array([_START]) * _PLACE[0]) >> np.uint64(1))[0]


def _messages(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_MESSAGE`` in batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size >= SENT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), _SENT.types)], schema=_SENT)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), _SENT.types)], schema=_SENT)


def _table(rows: Iterator[tuple[int, int, bytes]]) -> pa.Table:
    return pa.Table.from_batches(_messages(rows), _SENT)


def _received(table: pa.Table) -> tuple[list[int], list[pa.Scalar]]:
    """Senders and bodies of messages by sender."""
    senders = table.column("sender").to_pylist()
    bodies = table.column("body")
    order = sorted(range(len(senders)), key=senders.__getitem__)
    return [senders[i] for i in order], [bodies[i] for i in order]


def _home(block: int) -> int:
    """The target that is the block itself; those from 0 on are buckets."""
    return -1 - block


def _asked(block: int, it: Block, rest: bytes, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """Round 1: a block keeps its texts and the columns besides, and sends its n-grams to their buckets."""
    numbers = packed(it.names, it.words, it.length, it.held)
    yield _home(block), block, struct.pack("<q", len(numbers)) + numbers + rest
    del numbers, rest
    orders = [(grams.key, grams.count, grams.cut) for grams in it.grams(buckets, keys=True)]
    for q in range(buckets):
        own = [(key[cut[q] : cut[q + 1]], count[cut[q] : cut[q + 1]]) for key, count, cut in orders]
        steps = np.concatenate([np.diff(key, prepend=np.uint64(0)) for key, _ in own])  # steps have fewer bytes than keys
        yield q, block, packed(steps, np.concatenate([count for _, count in own]), np.array([len(key) for key, _ in own]))


def _restored(body: pa.Scalar) -> tuple[Block, pa.Table]:
    view = memoryview(body.as_buffer())
    (n,) = struct.unpack_from("<q", view)
    names, words, length, held = unpacked(view[8 : 8 + n])
    return Block(names, words, length, held), pa.ipc.open_stream(pa.py_buffer(view[8 + n :])).read_all()


class _Gathered:
    """Texts on their way to a block; the columns besides are copied, as a batch would keep its texts in memory."""

    def __init__(self, schema: pa.Schema) -> None:
        self.size = 0
        self._hashes, self._lengths, self._held = [], [], []
        self._sink = pa.BufferOutputStream()
        self._rest = pa.ipc.new_stream(self._sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))

    def add(self, words: Words, rest: pa.RecordBatch, held: pa.Array) -> None:
        self._hashes.append(span_hashes(_LOWER[words.data], words.start, words.end) & ~_HELD)
        self._lengths.append(words.count.astype(np.uint32))
        self._held.append(held.to_numpy(zero_copy_only=False).astype(np.uint8))
        self._rest.write_batch(rest)
        self.size += words.n + len(self._hashes[-1])

    def block(self) -> tuple[Block, bytes]:
        """The block and the other columns of its rows; the texts are used up."""
        self._rest.close()
        hashed = np.concatenate(self._hashes)
        self._hashes.clear()
        words = distinct(hashed, 1, keys=True, places=True)
        del hashed
        common = np.argsort(words.count)[::-1]  # the first numbers for common words, so that high bytes are mostly 0
        number = np.empty(len(common), dtype=np.uint32)
        number[common] = np.arange(len(common), dtype=np.uint32)
        names = (words.key << _HELD)[common]
        block = Block(names, number[words.index], np.concatenate(self._lengths), np.concatenate(self._held))
        return block, self._sink.getvalue().to_pybytes()


def _asking(text: str, flag: str, buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, gathered = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            others = batch.drop_columns([text])
            for at, words in chunks(batch.column(text)):
                gathered = gathered or _Gathered(others.schema)
                gathered.add(words, others.slice(at, words.n), batch.column(flag).slice(at, words.n))
                if gathered.size >= BLOCK_TOKENS:
                    yield from _messages(_asked(block, *gathered.block(), buckets))
                    block, gathered = block + 1, None
                    _give_back()
        if gathered:
            yield from _messages(_asked(block, *gathered.block(), buckets))
            _give_back()

    return ask


def _questions(bodies: list[pa.Scalar]) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """By order: keys and counts of each block."""
    out: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER)]
    for body in bodies:
        steps, counts, sizes = unpacked(body.as_buffer())
        at = 0
        for lists, n in zip(out, sizes.tolist()):
            lists.append((np.cumsum(steps[at : at + n], dtype=np.uint64), counts[at : at + n]))
            at += n
    return out


def _holders(key: tuple[pa.Scalar], asked: pa.Table) -> pa.Table:
    """Round 2, in a bucket: a bit for every n-gram above order 1 that a block asked for, 1 in one of the blocks that train it."""
    bucket = key[0].as_py()
    if bucket < 0:
        return _SENT.empty_table()
    _give_back()
    senders, bodies = _received(asked)
    flags: list[list[np.ndarray]] = [[] for _ in senders]
    for lists in _questions(bodies)[1:]:
        keys, counts = (np.concatenate(x) for x in zip(*lists))
        trained = np.flatnonzero(counts)
        one = np.zeros(len(keys), dtype=np.uint8)
        one[trained[np.unique(keys[trained], return_index=True)[1]]] = 1
        at = 0
        for out, (own, _) in zip(flags, lists):
            out.append(one[at : at + len(own)])
            at += len(own)
    return _table((_home(s), bucket, packed(np.packbits(np.concatenate(out)))) for s, out in zip(senders, flags))


def _followers(key: tuple[pa.Scalar], state: pa.Table, holders: pa.Table) -> pa.Table:
    """Round 2, in a block: how many followers of each of its contexts it was named for, to their buckets."""
    if key[0].as_py() >= 0:
        return _SENT.empty_table()
    _give_back()
    (block,), (body,) = _received(state)
    it, _ = _restored(body)
    buckets, bodies = _received(holders)
    flags = Lists([np.unpackbits(unpacked(x.as_buffer())[0]) for x in bodies])
    parts: list[list[np.ndarray]] = [[] for _ in buckets]
    context, above, before = None, None, it.before()
    for k, grams in enumerate(it.grams(len(buckets), places=True), 1):
        if k > 1:
            place = grams.place[flags.next(grams.cut).view(bool)]
            place = place[place < it.n]  # start markers follow nothing
            n = np.zeros(above[-1], dtype=np.uint32)
            for own in _slices(len(place)):
                np.add.at(n, context[before[place[own]]], np.uint32(1))
            for q, part in enumerate(parts):
                part.append(n[above[q] : above[q + 1]])
        context, above = grams.index, grams.cut
        del grams
    return _table((q, block, packed(np.concatenate(part))) for q, part in zip(buckets, parts))


def _totals(key: tuple[pa.Scalar], asked: pa.Table, followers: pa.Table) -> pa.Table:
    """Round 3, in a bucket: counts and followers over all blocks, for every n-gram that a block asked for."""
    bucket = key[0].as_py()
    if bucket < 0:
        return _SENT.empty_table()
    _give_back()
    senders, bodies = _received(asked)
    same, named = _received(followers)
    if senders != same:
        raise ValueError("blocks were numbered otherwise when they were read again")
    parts: list[tuple[list[np.ndarray], list[np.ndarray]]] = [([], []) for _ in senders]
    rest = [unpacked(body.as_buffer())[0] for body in named]
    sums = None
    for k, lists in enumerate(_questions(bodies), 1):
        keys, counts = (np.concatenate(x) for x in zip(*lists))
        found, index = np.unique(keys, return_inverse=True)
        of = [np.bincount(index, counts, len(found)).astype(np.uint64)]
        if k == 1:
            seen = (of[0] > 0) & (found != _START_KEY)
            sums = np.array([of[0][seen].sum(), np.count_nonzero(seen)], dtype=np.uint64)
        if k < ORDER:
            n = np.concatenate([x[: len(own)] for x, (own, _) in zip(rest, lists)])
            rest = [x[len(own) :] for x, (own, _) in zip(rest, lists)]
            of.append(np.bincount(index, n, len(found)).astype(np.uint64))
        at = 0
        for part, (own, _) in zip(parts, lists):
            for out, x in zip(part, of):
                out.append(x[index[at : at + len(own)]])
            at += len(own)
    return _table((_home(s), bucket, packed(sums, *map(np.concatenate, part))) for s, part in zip(senders, parts))


def walked(it: Block, n_train: int, v_train: int, counts: Lists, followers: Lists, buckets: int) -> dict[str, np.ndarray]:
    """The automaton's walk over the texts of a block: a value a text for each column.

    ``counts`` and ``followers`` are those of :meth:`Block.grams`, over all training texts.
    """
    denominator = n_train + SMOOTH * (v_train + 1)
    before, summed = it.before(), {}
    context = lp = count = follow = None
    add = lambda x: np.add.reduceat(x[: it.n], it.first)
    for k, grams in enumerate(it.grams(buckets, places=True), 1):
        lower, above, count = lp, count, counts.next(grams.cut)
        lp = np.empty(len(count))
        for own in _slices(len(lp)):
            c = count[own].astype(np.float64)
            if k == 1:
                # the empty state has an arc for every word, and one for all others
                lp[own] = np.log10((c + SMOOTH) / denominator)
                continue
            place = np.minimum(grams.place[own], it.n - 1)  # start markers are never walked to
            state, low = context[before[place]], lower[context[place]]
            total, types = above[state].astype(np.float64), follow[state]
            with np.errstate(divide="ignore", invalid="ignore"):
                fail = np.log10(DISCOUNT * types / total)
                arc = np.log10((c - DISCOUNT) / total + np.power(10.0, fail + low))
            lp[own] = np.where(c > 0, arc, np.where(total > 0, fail + low, low))
        if k == 1:
            summed["n_known"] = add((count > 0)[grams.index].astype(np.int64))
            summed["base_score"] = add(lp[grams.index])
        follow = followers.next(grams.cut) if k < ORDER else None
        context = grams.index
        del grams
    summed["score"] = add(lp[context])
    return summed | {"n_tokens": it.length.astype(np.int64) + 1, "train_tokens": np.full(len(it.length), n_train, dtype=np.int64)}


def _scoring(schema: StructType):
    """Round 3, in a block: the columns besides the text, with those that are made."""

    def walk(key: tuple[pa.Scalar], state: pa.Table, answers: pa.Table) -> pa.Table:
        result = to_arrow_schema(schema)
        if key[0].as_py() >= 0:
            return result.empty_table()
        _give_back()
        it, rest = _restored(_received(state)[1][0])
        sums, counts, followers = zip(*(unpacked(body.as_buffer()) for body in _received(answers)[1]))  # by bucket, so by key
        n_train, v_train = (sum(int(x[i]) for x in sums) for i in (0, 1))
        made = walked(it, n_train, v_train, Lists([*counts]), Lists([*followers]), len(sums))
        columns = [rest.column(f.name) if f.name in rest.column_names else pa.array(made[f.name]) for f in result]
        return pa.Table.from_arrays(columns, names=result.names).cast(result)

    return walk


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds ``held_out, n_tokens, n_known, train_tokens, base_score, score`` to every row of ``docs``.

    Input columns with these names or names that begin with ``_`` are left out.
    """
    ship_package(docs.sparkSession)
    docs = docs.drop(*[c for c in docs.columns if c in MADE or (c.startswith("_") and c not in (doc_id, text))])
    keyed = docs.withColumn("held_out", held_out(doc_id))
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    asked = keyed.mapInArrow(_asking(text, "held_out", buckets), _MESSAGE).groupBy("target")
    holders = asked.applyInArrow(_holders, _MESSAGE).groupBy("target")
    followers = asked.cogroup(holders).applyInArrow(_followers, _MESSAGE).groupBy("target")
    totals = asked.cogroup(followers).applyInArrow(_totals, _MESSAGE).groupBy("target")
    schema = keyed.drop(text).schema
    for name in MADE[1:]:
        schema = schema.add(name, DoubleType() if name.endswith("score") else LongType())
    return asked.cogroup(totals).applyInArrow(_scoring(schema), schema)
