"""Personal data, with information-theoretic sanitisation of what gives it away.

Base findings are e-mail addresses, IP addresses, card and phone numbers, by fixed patterns.
Terms near them can give them away as well: for each protected entity, which is a kind and a
value, an e-mail domain or a kind alone, and each word within ``CONTEXT_WORDS`` words of it in its
line, the corpus says in how many documents the two occur together and each alone.  The pointwise
mutual information of term and entity over the information of the entity is the share of the
entity that the term discloses (Sanchez and Batet, 2016).  A term over ``DISCLOSURE`` counts if
chance would hardly bring the two together so often: the Chernoff bound of that, times the
number of pairs, is at most ``2 ** -EVIDENCE_BITS``.  Every occurrence of the term in documents that hold
the entity is a span too.  ``sanitised`` replaces base spans by their kind and terms by a
general word, or removes them.

Counts are over all documents; joins are on hashes of 64 bits.  Patterns run on the few stretches
of a text that can match, which are found in numpy for whole batches.

Defined cases: a null text is empty; rows with the same id are searched one by one, but count as one
document if their texts are equal as well; ids may be null.  A document without findings has zeros and
empty lists.  An empty table gives an empty result.  Columns beginning with ``_pii_`` are reserved;
``kinds``, ``starts``, ``ends`` and ``terms`` replace columns of that name; all others stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from capweave.llm.tables import id_key, materialize, ship_package, text_of
from capweave.llm.words import chunks, mixed, span_hashes, split_words

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns of the base findings.
EMAIL = re.compile(rb"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(rb"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(rb"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")

CONTEXT_WORDS = 6
EVIDENCE_BITS = 10
DISCLOSURE = 0.9
GENERAL = "[TERM]"
#: Hashes of the kinds, and what is added to those of domains.
_GROUPS = mixed(np.arange(1, len(KINDS) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
_DOMAIN = np.uint64(0xC2B2AE3D27D4EB4F)


def _set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_DIGITS = bytes(range(0x30, 0x3A))
_LETTERS = bytes([*range(0x41, 0x5B), *range(0x61, 0x7B)])
_DIGIT = _set(_DIGITS)
# Per kind: the bytes that a match consists of, the bytes to count, and the least count of a match.
_STRETCHES = (
    (EMAIL, _set(_LETTERS + _DIGITS + b"._%+-@"), _set(b"@"), 1),
    (IP, _set(_DIGITS + b"."), _set(b"."), 3),
    (CARD, _set(_DIGITS + b" -"), _DIGIT, 14),
    (PHONE, _set(_DIGITS + b"+ ().-"), _DIGIT, 10),
)
_TERM_BYTE = np.full(256, 0x20, dtype=np.uint8)
for _b in [*_DIGITS, *_LETTERS, *range(0x80, 0x100), 0x0A]:
    _TERM_BYTE[_b] = _b


def _luhn(digits: bytes) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        d -= 0x30
        total += d if place % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _valid(kind: int, found: bytes) -> bool:
    if kind == 0:
        return True
    if kind == 1:
        return all(int(part) <= 255 for part in found.split(b"."))
    digits = bytes(c for c in found if 0x30 <= c <= 0x39)
    return 14 <= len(digits) <= 19 and _luhn(digits) if kind == 2 else 10 <= len(digits) <= 15


def base_spans(data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, start, kind, end) in bytes of all base findings, in this order."""
    out = []
    head = np.zeros(len(data) + 1, dtype=bool)
    head[bounds] = True
    for kind, (pattern, inside, counted, least) in enumerate(_STRETCHES):
        within = inside[data]
        edge = within.copy()
        edge[1:] &= ~within[:-1] | head[1 : len(data)]
        start = np.flatnonzero(edge)
        if not len(start):
            continue
        stop = within.copy()
        stop[:-1] &= ~within[1:] | head[1 : len(data)]
        end = np.flatnonzero(stop) + 1
        marks = np.concatenate([[0], np.cumsum(counted[data])])
        for a, b in zip(*(x[marks[end] - marks[start] >= least].tolist() for x in (start, end))):
            for m in pattern.finditer(data[a:b].tobytes()):
                if _valid(kind, m.group()):
                    out.append((int(np.searchsorted(bounds, a, side="right")) - 1, a + m.start(), kind, a + m.end()))
    return sorted(out)


def _found(docs: DataFrame) -> DataFrame:
    """``docs`` without text, with the base spans in code points and the terms near them.

    ``_pii_near`` has hashes of each entity and term near it, ``_pii_words`` hash and place of each word of a text with spans.
    """
    kept = [c for c in docs.columns if c not in ("text", "kinds", "starts", "ends")]
    near = StructType().add("e", LongType()).add("t", LongType())
    word = StructType().add("t", LongType()).add("s", IntegerType()).add("f", IntegerType())
    schema = docs.select(*kept).schema
    for name, kind in (("kinds", IntegerType()), ("starts", IntegerType()), ("ends", IntegerType()), ("_pii_near", near), ("_pii_words", word)):
        schema = schema.add(name, ArrayType(kind))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, words in chunks(batch.column("text")):
                spans = base_spans(words.data, words.bounds)
                rows = [([], [], [], [], []) for _ in range(words.n)]
                if spans:
                    _place(words.data, words.bounds, spans, rows)
                old = [batch.column(c).slice(at, words.n) for c in kept]
                new = [pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in range(3)]
                pairs = pa.array([r[3] for r in rows], pa.list_(pa.struct([("e", pa.int64()), ("t", pa.int64())])))
                each = pa.array([r[4] for r in rows], pa.list_(pa.struct([("t", pa.int64()), ("s", pa.int32()), ("f", pa.int32())])))
                yield pa.RecordBatch.from_arrays([*old, *new, pairs, each], schema.names)

    return docs.select(*kept, "text").mapInArrow(search, schema)


def _place(data: np.ndarray, bounds: np.ndarray, spans: list[tuple[int, int, int, int]], rows: list[tuple[list, list, list, list, list]]) -> None:
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before a byte
    for text in sorted({s[0] for s in spans}):
        low, high = int(bounds[text]), int(bounds[text + 1])
        own = [s for s in spans if s[0] == text]
        plain = _TERM_BYTE[data[low:high]]
        for _, a, _, b in own:
            plain[a - low : b - low] = 0x20  # what is protected is no term
        words = split_words(plain, np.array([0, high - low]))
        hashes = term_hashes(plain, words.start, words.end).view(np.int64)
        lines = np.flatnonzero(plain == 0x0A)
        line_of = np.searchsorted(lines, words.start)
        entity = span_hashes(data[low:high], np.array([s[1] - low for s in own]), np.array([s[3] - low for s in own]))
        entity = mixed(entity + np.array([s[2] + 1 for s in own], dtype=np.uint64)).view(np.int64)
        places = (points[words.start + low] - points[low]).tolist(), (points[words.end + low] - points[low]).tolist()
        rows[text][4].extend(zip(hashes.tolist(), *places))
        near = set()
        for (_, a, kind, b), e in zip(own, entity.tolist()):
            rows[text][0].append(kind)
            rows[text][1].append(int(points[a] - points[low]))
            rows[text][2].append(int(points[b] - points[low]))
            held = [e, int(_GROUPS[kind])]
            if kind == 0:  # the domain
                at = data[low:high].tobytes().index(b"@", a - low, b - low) + 1
                held.append(int(mixed(span_hashes(data[low:high], np.array([at]), np.array([b - low])) + _DOMAIN).view(np.int64)[0]))
            middle, line = int(np.searchsorted(words.start, a - low)), int(np.searchsorted(lines, a - low))
            for w in range(max(0, middle - CONTEXT_WORDS), min(len(words.start), middle + CONTEXT_WORDS)):
                if line_of[w] == line:
                    near.update((x, int(hashes[w])) for x in held)
        rows[text][3].extend(near)


def term_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed(span_hashes(data, start, end) + np.uint64(0x5851F42D4C957F2D))


def term_counts(texts: DataFrame) -> DataFrame:
    """(t, n): in how many texts each term occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, some in chunks(batch.column("text")):
                words = split_words(_TERM_BYTE[some.data], some.bounds)
                if not len(words.start):
                    continue
                hashed = term_hashes(words.data, words.start, words.end)
                text = np.repeat(np.arange(words.n, dtype=np.uint64), words.count)
                # Once for each text, then summed over the texts of the chunk.
                order = np.lexsort((text, hashed))
                h, x = hashed[order], text[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (x[1:] != x[:-1])
                each, n = np.unique(h[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(each.view(np.int64)), pa.array(n.astype(np.int64))], ["t", "n"])

    return texts.select("text").mapInArrow(count, "t bigint, n bigint").groupBy("t").agg(F.sum("n").alias("n"))


def disclosing(found: DataFrame, texts: DataFrame, n_docs: int) -> DataFrame:
    """(e, t): pairs of an entity and a term that discloses it."""
    seen = found.filter(F.size("_pii_near") > 0).select("_pii_id", "_pii_text", F.explode("_pii_near").alias("p"))
    seen = seen.select("_pii_id", "_pii_text", "p.e", "p.t").distinct()
    joint = materialize(seen.groupBy("e", "t").agg(F.count("*").alias("both")), "joint")
    total = F.lit(float(max(n_docs, 1)))
    least = EVIDENCE_BITS + np.log2(max(joint.count(), 1))
    # No pair has more bits of evidence than one whose term is in a single document.
    joint = joint.filter(F.col("both") * F.log2(total) >= least)
    alone = seen.select("_pii_id", "_pii_text", "e").distinct().groupBy("e").agg(F.count("*").alias("n_e"))
    terms = term_counts(texts).withColumnRenamed("n", "n_t")
    counted = joint.join(alone, "e").join(terms, "t")
    information = F.log2(total / F.col("n_e"))
    mutual = F.log2(F.col("both") * total / (F.col("n_e") * F.col("n_t")))
    apart = F.col("n_e") - F.col("both")
    without = F.when(apart > 0, apart * F.log2(apart / F.col("n_e") / (1 - F.col("n_t") / total))).otherwise(0.0)
    evidence = F.col("both") * mutual + without
    return counted.filter((information > 0) & (mutual >= DISCLOSURE * information) & (evidence >= float(least))).select("e", "t")


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with kinds, starts and ends of the base spans in code points, and ``terms``: spans (s, f) of disclosing terms."""
    ship_package(docs.sparkSession)
    named = [c for c in docs.columns if c not in ("text", "terms")]
    keyed = docs.select(*named, text_of().alias("text"), id_key().alias("_pii_id"), F.xxhash64(text_of()).alias("_pii_text"))
    found = materialize(_found(keyed), "pii")
    pairs = disclosing(found, keyed, docs.count())
    near = found.filter(F.size("_pii_near") > 0).select("_pii_id", "_pii_text", F.explode("_pii_near.e").alias("e")).distinct()
    given = near.join(materialize(pairs, "disclosing"), "e").groupBy("_pii_id", "_pii_text").agg(F.collect_set("t").alias("_pii_terms"))
    joined = found.join(given, ["_pii_id", "_pii_text"], "left")
    every = F.filter("_pii_words", lambda x: F.array_contains("_pii_terms", x.t))
    spans = F.array_sort(F.transform(every, lambda x: F.struct(x.s.alias("s"), x.f.alias("f"))))
    none = F.array().cast("array<struct<s:int,f:int>>")
    joined = joined.withColumn("terms", F.coalesce(F.when(F.col("_pii_terms").isNotNull(), spans), none))
    out = [c for c in named if c not in ("kinds", "starts", "ends")]
    return joined.select(*out, "kinds", "starts", "ends", "terms", "_pii_id", "_pii_text")


def how_many(kind: str) -> Column:
    """Number of base spans of a kind."""
    place = KINDS.index(kind)
    return F.size(F.filter("kinds", lambda k: k == place)).cast("bigint")


def named_spans(with_terms: bool) -> Column:
    """kind:start:end of the spans by start, joined by commas."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    base = F.transform(
        F.arrays_zip("starts", "kinds", "ends"), lambda x: F.struct(x.starts.alias("s"), x.kinds.alias("k"), x.ends.alias("f"))
    )
    every = base
    if with_terms:
        every = F.concat(base, F.transform("terms", lambda x: F.struct(x.s.alias("s"), F.lit(len(KINDS)).alias("k"), x.f.alias("f"))))
    name = lambda x: F.coalesce(F.get(kind, x.k), F.lit("term"))
    return F.array_join(F.transform(F.array_sort(every), lambda x: F.concat_ws(":", name(x), x.s.cast("string"), x.f.cast("string"))), ",")


def sanitised(docs: DataFrame, remove_terms: bool = False) -> DataFrame:
    """``docs`` with base spans replaced by their kind in brackets and disclosing terms generalised or removed."""
    spans = find(docs.select("doc_id", "text")).select("_pii_id", "_pii_text", named_spans(True).alias("_pii_spans"))
    spans = spans.filter("_pii_spans <> ''").dropDuplicates(["_pii_id", "_pii_text"])
    keyed = docs.withColumn("_pii_id", id_key()).withColumn("_pii_text", F.xxhash64(text_of()))
    joined = keyed.join(spans, ["_pii_id", "_pii_text"], "left")
    term = "" if remove_terms else GENERAL

    @F.arrow_udf(StringType())
    def replace(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for text, listed in zip(texts.to_pylist(), found.to_pylist()):
            if text is not None and listed:
                pieces, at = [], 0
                for kind, s, f in (x.split(":") for x in listed.split(",")):
                    if int(s) >= at:
                        pieces += [text[at : int(s)], term if kind == "term" else f"[{kind.upper()}]"]
                    at = max(at, int(f))
                text = "".join(pieces) + text[at:]
            out.append(text)
        return pa.array(out, pa.string())

    return joined.withColumn("text", replace("text", "_pii_spans")).select(*docs.columns)
