"""Byte-level BPE encoding and decoding with a public vocabulary of ranks.

A text is split by the tokenizer's pattern, and each piece, called a word here, is merged
by rank.  The merges are a fold of Spark higher-order functions over the bytes of a word, each
byte as its token id: in each step the adjacent pair whose joined bytes have the least rank
becomes one.  The rank map is a scalar subquery, keyed by pairs of ids.  It is a table of
slots, each pair in one of two places given by its remainders, so one look-up reads two
slots whatever the size of the vocabulary.

Distinct words are folded, not occurrences.  Words are counted over all texts; the most frequent,
at most ``COMMON`` of those that occur twice, are folded once, and their ids go to the tasks as a table of bounded
size, in parts by ranges of hashes: the driver has one part at a time.  Other words are folded by the same expression, once for each text that holds them.
Where the bound falls changes the speed, never a result.

Words of a whole Arrow batch are found in numpy, from the class of each code point, and looked up by
a 64-bit hash together with their length.

Defined cases: a null text is empty and has no ids; strings of special tokens are ordinary
text; ids beyond the vocabulary, null ids and null lists have no bytes.  The operators make
the columns ``ids`` and ``decoded``; columns of these names in the input are replaced, all others
stay.  Repeated rows are encoded alike; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from capweave.llm.tables import materialize, ship_package, text_of
from capweave.llm.words import mixed

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
COMMON = 1 << 20
#: Longer words are left to the texts that hold them, so that the table is bounded in bytes.
LONGEST = 64
#: Words in a part of the table, about.
PART_WORDS = 1 << 16
CHUNK_CHARS = 1 << 19
_SHIFT = 18  # bits of a token id
_NONE = (1 << _SHIFT) - 1  # no token
_RANK = 63 - _SHIFT  # where the rank begins in an entry of the fold; the place in the word lies between it and the id
_LAST = 256  # behind the bytes of a word
_SLOTS = 256 * (_LAST + 1)


@cache
def read_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


# The rank map.


def _primes(above: int) -> tuple[int, int]:
    found: list[int] = []
    n = above | 1
    while len(found) < 2:
        if all(n % d for d in range(3, int(n**0.5) + 1, 2)):
            found.append(n)
        n += 2
    return found[0], found[1]


@cache
def _pair_table(path: str) -> tuple[int, int, np.ndarray]:
    """(two moduli, table): the begin of a word by two bytes, then a slot for each pair of ids that joins to a token.

    The first ``256 * 257`` entries have the id of a byte and the rank that it has with the next, ``_LAST`` if there
    is none, as an entry of the fold has them. A slot has the pair above its rank.
    """
    ranks = read_ranks(path)
    if max(ranks.values()) >= _NONE:
        raise ValueError(f"ids of {path} take more than {_SHIFT} bits")
    pairs = {}
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if left is not None and right is not None:
                pairs[(left << _SHIFT) | right] = rank
    room = max(1000, len(pairs) * 2)
    while True:
        p, q = _primes(room)
        slot: dict[int, int] = {}
        for key in pairs:
            at, turns = key % p, 0
            while key is not None and turns < 1000:  # whoever is displaced goes to its other place
                key, slot[at] = slot.get(at), key
                if key is not None:
                    at = key % q if at == key % p else key % p
                turns += 1
            if key is not None:
                break
        else:
            break
        room = room * 3 // 2
    table = np.full(_SLOTS + q, -1, dtype=np.int64)
    for a in range(256):
        for b in range(_LAST + 1):
            rank = ranks.get(bytes([a, b]), _NONE) if b < _LAST else _NONE
            table[a * (_LAST + 1) + b] = rank << _RANK | ranks[bytes([a])]
    for at, key in slot.items():
        table[_SLOTS + at] = key << _SHIFT | pairs[key]
    return p, q, table


def rank_table(spark: SparkSession, path: str = RANKS) -> Column:
    """The table as a scalar subquery: a plan with the numbers themselves is described in millions of characters."""
    made = spark.createDataFrame(pa.table({"t": pa.array([_pair_table(path)[2]])}))
    return materialize(made, "ranks").scalar()


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(word: Column, table: Column, path: str = RANKS) -> Column:
    """Ids of a word given as its bytes and ``_LAST`` behind them: a fold of ranked merges.

    ``table`` is the column of :func:`rank_table`, as the variable of a lambda. The state has a number for each
    token: the rank that it has with the next token, its place in the word, and its id. So the least number is the
    leftmost pair of the least rank. Entries before and behind the word join with nothing.
    """
    p, q, _ = _pair_table(path)
    low, none = F.lit((1 << _RANK) - 1), F.lit(_NONE << _RANK)
    edge = F.array(F.lit((_NONE << _RANK) | ((1 << _RANK) - 1)))

    def id_of(entry: Column) -> Column:
        return entry.bitwiseAND(F.lit(_NONE))

    def with_rank(entry: Column, after: Column) -> Column:
        """An entry that has no rank yet, with the one that it has with the id behind it."""

        def rank(key: Column) -> Column:
            one, two = (F.get(table, (key % F.lit(m)).cast("int") + F.lit(_SLOTS)) for m in (p, q))
            return (
                F.when(F.shiftright(one, _SHIFT) == key, id_of(one))
                .when(F.shiftright(two, _SHIFT) == key, id_of(two))
                .otherwise(F.lit(_NONE).cast("bigint"))
            )

        return F.shiftleft(_let(F.shiftleft(id_of(entry), _SHIFT).bitwiseOR(after), rank), _RANK).bitwiseOR(entry)

    def step(state: Column, _: Column) -> Column:
        def joined(i: Column) -> Column:
            best = F.get(state, i - 1)
            made = F.shiftright(best, _RANK)
            place = best.bitwiseAND(F.lit(((1 << _RANK) - 1) & ~_NONE))
            pair = F.array(
                with_rank(F.get(state, i - 2).bitwiseAND(low), made),
                with_rank(place.bitwiseOR(made), id_of(F.get(state, i + 1))),
            )
            rest = F.flatten(F.array(F.slice(state, F.lit(1), i - 2), pair, F.slice(state, i + 2, F.size(state))))
            return F.when(best >= none, state).otherwise(rest)

        return _let(F.array_position(state, F.array_min(state)).cast("int"), joined)

    n = F.size(word) - 1
    first = F.transform(
        F.slice(word, F.lit(2), n),
        lambda x, i: F.get(table, F.get(word, i) * F.lit(_LAST + 1) + x).bitwiseOR(F.shiftleft(i.cast("bigint"), _SHIFT)),
    )
    last = F.aggregate(F.sequence(F.lit(2), n), F.flatten(F.array(edge, first, edge)), step)
    return F.transform(F.slice(last, F.lit(2), F.size(last) - 2), lambda entry: id_of(entry).cast("int"))


# Words of whole columns.

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


@cache
def _classes() -> np.ndarray:
    """Class of each code point in the pattern: letter, number, white space or other."""
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, dtype=np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
        at = np.fromiter((m.start() for m in regex.finditer(pattern, everything)), dtype=np.int64)
        out[at + np.where(at >= 0xD800, 0x800, 0)] = kind
    return out


def word_starts(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where words begin in code points of texts that lie one behind the other; ``bounds`` has the texts' places.

    Does what matching public_tokenizers.PATTERN from left to right does: runs of one class; a blank
    goes with the run behind it; of other white space before a run the last character stands alone; an
    apostrophe that begins a word takes one of the endings s, t, re, ve, m, ll, d with it.
    """
    n = len(points)
    kind = _classes()[points]
    head = np.zeros(n + 1, dtype=bool)  # a text begins here
    head[bounds] = True
    run = head[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    begin = run.copy()
    space = kind == _SPACE
    # The last white space before a run that is not white space, in the same text.
    final = np.zeros(n, dtype=bool)
    final[:-1] = space[:-1] & ~space[1:] & ~head[1:n]
    begin |= final
    blank = final & (points == 0x20)
    after = np.flatnonzero(blank) + 1
    begin[after] = False  # the run behind a blank begins with it
    # Endings of contractions: an apostrophe alone in its run, at the begin of a word.
    quote = np.flatnonzero((points == 0x27) & begin & run)
    if len(quote):
        padded = np.append(points, [0, 0])
        whose = np.searchsorted(bounds, quote, side="right")
        room = bounds[whose] - quote
        one, two = padded[quote + 1], padded[quote + 2]
        short = (room > 1) & np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(quote), dtype=bool)
        for a, b in ("re", "ve", "ll"):
            long |= (room > 2) & (one == ord(a)) & (two == ord(b))
        for at, size in ((quote[short], 2), (quote[long], 3)):
            begin[at + 1] = False
            end = at + size
            begin[end[end < n]] = True
    # A letter run cut by a contraction begins anew; white space and text begins stay as they are.
    begin[bounds[:-1][bounds[:-1] < n]] = True
    return np.flatnonzero(begin)


def text_words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(texts before, texts, code points, starts and ends of words, places of texts in the words) by pieces of a column."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    sizes = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))]) if n else np.zeros(1)
    at = 0
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(sizes, sizes[at] + CHUNK_CHARS, side="right")) - 1))
        some = texts.slice(at, to - at).to_pylist()
        points = np.frombuffer("".join(some).encode("utf-32-le"), dtype=np.uint32)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in some])]).astype(np.int64)
        start = word_starts(points, bounds) if len(points) else np.zeros(0, dtype=np.int64)
        yield at, to - at, points, start, np.append(start[1:], len(points)).astype(np.int64)[: len(start)], np.searchsorted(start, bounds)
        at = to


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


@cache
def _powers(base: int, n: int) -> np.ndarray:
    made = np.full(n, base, dtype=np.uint64)
    made[0] = 1
    return np.cumprod(made, dtype=np.uint64)


def _powers_of(base: np.uint64, n: int) -> np.ndarray:
    return _powers(int(base), max(CHUNK_CHARS, 1 << (n - 1).bit_length()) if n else CHUNK_CHARS)[:n]


def word_hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits for each word, from its code points and its length."""
    total = np.zeros(len(points) + 1, dtype=np.uint64)
    value = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
    value ^= value >> np.uint64(31)
    np.cumsum(value * _powers_of(_BASE, len(points)), out=total[1:])
    body = (total[end] - total[start]) * _powers_of(_INVERSE, len(points))[start]
    return mixed(body ^ ((end - start).astype(np.uint64) << np.uint64(40)))


def _bytes_of(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the words' bytes one behind the other, where each word begins and ends in them)."""
    flat = np.frombuffer(points.tobytes().decode("utf-32-le").encode(), dtype=np.uint8)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    at = np.concatenate([[0], np.cumsum(width)])
    sizes = at[end] - at[start]
    return flat[_ragged(at[start], sizes)], np.concatenate([[0], np.cumsum(sizes)])


def _codes_of(body: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same as :func:`fold` takes them: ``_LAST`` behind each word."""
    ends = bounds[1:]
    return np.insert(body.astype(np.int32), ends, _LAST), bounds + np.arange(len(bounds))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): every distinct word with its count over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, points, start, end, _ in text_words(batch.column(0)):
                if not len(start):
                    continue
                hashed = word_hashes(points, start, end)
                order = np.argsort(hashed)
                lead = np.flatnonzero(np.append(True, np.diff(hashed[order]) != 0))
                first, n = order[lead], np.diff(np.append(lead, len(order)))
                body, bounds = _bytes_of(points, start[first], end[first])
                words = pa.StringArray.from_buffers(len(first), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(body))
                yield pa.RecordBatch.from_arrays([words, pa.array(n.astype(np.int64))], ["word", "n"])

    return docs.select(text_of().alias("text")).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Part:
    """Ids of common words by hash, with a direct table in front of the search; all hashes begin with the same ``skip`` bits."""

    def __init__(self, hashes: np.ndarray, offsets: np.ndarray, ids: np.ndarray, skip: int):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.starts = offsets[:-1][order].astype(np.int32)  # LONGEST * COMMON ids at most
        self.sizes = np.diff(offsets)[order].astype(np.uint8)
        self.ids = ids
        self._skip = np.uint64(skip)
        self._first: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"_first": None}

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each word, -1 if it is not there."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        if self._first is None:
            bits = max(8, len(self.hashes).bit_length() + 1)
            self._shift = np.uint64(64 - bits)
            self._first = np.searchsorted((self.hashes << self._skip) >> self._shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
            self._deep = int(np.diff(self._first).max())
        cell = ((hashes << self._skip) >> self._shift).astype(np.int64)
        at, stop = self._first[cell], self._first[cell + 1]
        found = np.full(len(hashes), -1, dtype=np.int32)
        todo = np.arange(len(hashes))
        for step in range(self._deep):
            place = at + step
            todo = todo[place[todo] < stop[todo]]
            if not len(todo):
                break
            here = place[todo]
            hit = self.hashes[here] == hashes[todo]
            found[todo[hit]] = here[hit]
            todo = todo[~hit]
        return found


class Dictionary:
    """Broadcast parts, each of an equal range of hashes as signed numbers; their number is a power of two."""

    def __init__(self, parts: list[Broadcast]):
        self.parts = parts

    def find(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, Part, np.ndarray]]:
        """(words that are there, their part, their places in it), part by part."""
        bits = len(self.parts).bit_length() - 1
        signed = hashes.view(np.int64)
        whose = (signed >> (64 - bits)) + (len(self.parts) >> 1) if bits else np.zeros(len(hashes), dtype=np.int64)
        for i, shared in enumerate(self.parts):
            at = np.flatnonzero(whose == i)
            if len(at):
                place = shared.value.find(hashes[at])
                there = place >= 0
                yield at[there], shared.value, place[there]


def dictionary(docs: DataFrame, path: str = RANKS, common: int = COMMON) -> Dictionary:
    """The most frequent words of ``docs`` with their ids."""
    counted = materialize(word_counts(docs), "words")
    # A word that occurs once is folded once in its text too.
    short = counted.filter((F.octet_length("word") <= LONGEST) & (F.col("n") > 1))
    # Groups of counts by their logarithm, a few thousand at most; as many from the top as fit.
    level = F.floor(F.log2("n") * 64).cast("int")
    room, least = common, None
    for row in short.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if row["count"] > room:
            break
        room, least = room - row["count"], row.level
    if least is None:
        return Dictionary([])
    made = short.filter(level >= least).select(_hashed("word").alias("w"))
    made = made.select(F.col("w.h").alias("h"), F.col("w.codes").alias("codes"), rank_table(docs.sparkSession, path).alias("_t"))
    made = made.select("h", _let(F.col("_t"), lambda t: fold(F.col("codes"), t, path)).alias("ids"))
    bits = ((common - room - 1) // PART_WORDS).bit_length()
    width = 1 << (64 - bits)
    if bits:  # dealt by part and in order, so that a part's reader skips the others
        made = made.repartition(1 << bits, F.shiftright("h", 64 - bits)).sortWithinPartitions("h")
    table = materialize(made, "common")
    shared = []
    for low in range(-(1 << 63), 1 << 63, width):
        some = (table.filter(F.col("h").between(low, low + width - 1)) if bits else table).toArrow().combine_chunks()
        hashes, ids = (some.column(c).combine_chunks() for c in ("h", "ids"))
        part = Part(hashes.to_numpy().view(np.uint64), ids.offsets.to_numpy().astype(np.int64), ids.values.to_numpy().astype(np.int32), bits)
        shared.append(docs.sparkSession.sparkContext.broadcast(part))
    return Dictionary(shared)


@F.arrow_udf(StructType().add("h", LongType()).add("codes", ArrayType(IntegerType())))
def _hashed(words: pa.Array) -> pa.Array:
    """The hash of each word as a signed number, and the word as :func:`fold` takes it."""
    some = words.to_pylist()
    points = np.frombuffer("".join(some).encode("utf-32-le"), dtype=np.uint32)
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in some])]).astype(np.int64)
    codes, ends = _codes_of(*_bytes_of(points, bounds[:-1], bounds[1:]))
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(codes))
    return pa.StructArray.from_arrays([pa.array(word_hashes(points, bounds[:-1], bounds[1:]).view(np.int64)), lists], ["h", "codes"])


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0]+sizes[0]-1, then the same for the next."""
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


#: Makes further columns from a batch and its ids, in the task that has them.
Derive = Callable[[pa.RecordBatch, pa.Array], list[pa.Array]]


def encode(
    docs: DataFrame, path: str = RANKS, known: Dictionary | None = None, derive: Derive | None = None, derived: str = ""
) -> DataFrame:
    """``docs`` with ``ids`` array<int>, the tokens of the whole text.

    With ``derive`` the columns that it makes (``derived``, as a schema) come in place of ``ids``, so a
    caller that needs them only does not pass all ids on.
    """
    spark = docs.sparkSession
    ship_package(spark)
    table = known or dictionary(docs, path)

    @F.arrow_udf("codes array<int>, rare array<array<int>>")
    def split(texts: pa.Array) -> pa.Array:
        """Ids of common words; the k-th distinct other word of a text as -k, and these words."""
        codes, code_ends, rare, word_ends, rare_ends = [], [np.zeros(1, dtype=np.int64)], [], [np.zeros(1, dtype=np.int64)], [0]
        total = letters = 0
        for _, n, points, start, end, first in text_words(texts):
            hashed = word_hashes(points, start, end)
            found = list(table.find(hashed))
            sizes = np.zeros(len(hashed), dtype=np.int64)
            for usual, part, place in found:
                sizes[usual] = part.sizes[place]
            other = np.flatnonzero(sizes == 0)
            sizes[other] = 1
            ids = np.zeros(int(sizes.sum()), dtype=np.int32)
            ends = np.cumsum(sizes)
            text = np.searchsorted(first, other, side="right") - 1
            # Number the distinct other words of each text.
            order = np.lexsort((hashed[other], text))
            t, h = text[order], hashed[other][order]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
            group = np.cumsum(new)
            before = np.concatenate([[0], np.cumsum(np.bincount(t[new], minlength=n))])
            number = np.empty(len(order), dtype=np.int64)
            number[order] = group - before[t]
            lead = other[order][new]
            body, bounds = _codes_of(*_bytes_of(points, start[lead], end[lead]))
            rare.append(body)
            word_ends.append(bounds[1:] + letters)
            letters += len(body)
            rare_ends += (before[1:] + rare_ends[-1]).tolist()
            for usual, part, place in found:
                ids[_ragged((ends - sizes)[usual], sizes[usual])] = part.ids[_ragged(part.starts[place], sizes[usual])]
            ids[(ends - sizes)[other]] = -number
            codes.append(ids)
            code_ends.append(np.concatenate([[0], ends])[first[1:]] + total)
            total += len(ids)
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate(code_ends).astype(np.int32)), pa.array(np.concatenate(codes) if codes else np.zeros(0, dtype=np.int32))
        )
        inner = pa.ListArray.from_arrays(
            pa.array(np.concatenate(word_ends).astype(np.int32)), pa.array(np.concatenate(rare) if rare else np.zeros(0, dtype=np.int32))
        )
        words = pa.ListArray.from_arrays(pa.array(rare_ends, pa.int32()), inner)
        return pa.StructArray.from_arrays([lists, words], ["codes", "rare"])

    def fill(codes: pa.Array, folded: pa.Array) -> pa.Array:
        """Puts the ids of the other words in their places."""
        flat = codes.flatten().to_numpy()
        size = pc.list_value_length(codes).to_numpy(zero_copy_only=False)
        inner = folded.flatten()
        inner_size = pc.list_value_length(inner).to_numpy(zero_copy_only=False).astype(np.int64)
        inner_ids = inner.flatten().to_numpy()
        inner_start = np.cumsum(inner_size) - inner_size
        text_start = np.concatenate([[0], np.cumsum(pc.list_value_length(folded).to_numpy(zero_copy_only=False))])
        gap = np.flatnonzero(flat < 0)
        ends = np.cumsum(size)
        text = np.searchsorted(ends, gap, side="right")
        word = text_start[text] - flat[gap] - 1
        sizes = np.ones(len(flat), dtype=np.int64)
        sizes[gap] = inner_size[word]
        out_end = np.cumsum(sizes)
        out = np.empty(int(sizes.sum()), dtype=np.int32)
        plain = np.flatnonzero(flat >= 0)
        out[(out_end - 1)[plain]] = flat[plain]
        out[_ragged((out_end - sizes)[gap], sizes[gap])] = inner_ids[_ragged(inner_start[word], sizes[gap])]
        bounds = np.concatenate([[0], out_end])[np.concatenate([[0], ends])]
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(out))

    marked = docs.withColumn("_bpe", split(text_of()))
    folded = _let(F.col("_t"), lambda t: F.transform("_rare", lambda w: fold(w, t, path)))
    kept = [c for c in docs.columns if c != "ids"]
    schema = StructType(docs.select(*kept).schema.fields)
    if derive:
        made = StructType.fromDDL(derived)
        kept = [c for c in kept if c not in made.names]
        schema = StructType([f for f in schema if f.name in kept] + made.fields)
    else:
        schema.add("ids", ArrayType(IntegerType()))
    asked = [*kept, *(["text"] if derive and "text" not in kept else [])]
    # Three selections: the optimizer joins the last two, so no row holds the table, and does not repeat the split.
    ready = marked.select(*asked, F.col("_bpe.codes").alias("_codes"), F.col("_bpe.rare").alias("_rare"), rank_table(spark, path).alias("_t"))
    ready = ready.select(*asked, "_codes", folded.alias("_folded"))

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = fill(batch.column("_codes"), batch.column("_folded"))
            new = derive(batch, ids) if derive else [ids]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], schema.names)

    return ready.mapInArrow(filled, schema)


class Decoder:
    """The bytes of each id of a vocabulary."""

    def __init__(self, path: str = RANKS):
        ranks = read_ranks(path)
        by_id = {rank: piece for piece, rank in ranks.items()}
        self.pieces = [by_id.get(i, b"") for i in range(max(ranks.values()) + 1)] + [b""]  # the last for ids that are none
        self._table: pa.Array | None = None

    def __getstate__(self):
        return {"pieces": self.pieces, "_table": None}

    def decode(self, ids: pa.Array) -> pa.Array:
        """The pieces of each list one behind the other."""
        if self._table is None:
            self._table = pa.array(self.pieces, pa.large_binary())
        none = len(self.pieces) - 1
        counts = pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False)
        flat = ids.flatten().fill_null(-1).to_numpy()
        flat = np.where((flat < 0) | (flat > none), none, flat)
        taken = self._table.take(pa.array(flat))
        ends = np.frombuffer(taken.buffers()[1], dtype=np.int64)[: len(flat) + 1]
        bounds = ends[np.concatenate([[0], np.cumsum(counts)])]
        body = taken.buffers()[2]
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(bounds)), body if body else pa.py_buffer(b"")]
        ).cast(pa.binary())


def decode(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """``docs`` with ``decoded``, the bytes of ``ids``: the pieces of the vocabulary one behind the other."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Decoder(path))

    @F.arrow_udf("binary")
    def join(ids: pa.Array) -> pa.Array:
        return shared.value.decode(ids)

    return docs.withColumn("decoded", join("ids"))


def ids_sha256(ids: pa.Array) -> pa.Array:
    """SHA-256 of the decimal ids of each list joined by commas."""
    flat = ids.flatten().to_numpy()
    top = int(flat.max()) + 1 if len(flat) else 0
    names = pa.array([f"{i}," for i in range(top)], pa.large_string())
    taken = names.take(pa.array(flat))
    ends = np.frombuffer(taken.buffers()[1], dtype=np.int64)[: len(flat) + 1]
    counts = pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False)
    bounds = ends[np.concatenate([[0], np.cumsum(counts)])].tolist()
    body = memoryview(taken.buffers()[2]) if len(flat) else memoryview(b"")
    return pa.array([hashlib.sha256(body[a : max(a, b - 1)]).hexdigest() for a, b in zip(bounds, bounds[1:])])


def sha256_of(values: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(v.as_buffer()).hexdigest() for v in values])
