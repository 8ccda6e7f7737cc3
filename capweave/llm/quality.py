"""Quality rules as a ledger of bits: measure once, judge by versioned policies.

Every document is measured once.  Each rule that fails sets a bit; bits and measurements are kept, so a
policy, which is a mask of rules, can be applied or changed without reading a text again, and an
ablation is an aggregation over bits.

Words are longest runs of anything but ASCII white space.  The measures are taken in numpy for
whole Arrow batches: words, code points in words, symbols, capitals, exclamation marks,
lines that repeat an earlier one, and words in three-word windows found more than once.

Defined cases: null and empty texts have no words and so fail the base; ratios of a text without words are zero. Rows with
the same id are judged one by one.  An empty table gives an empty result.  Measures that bear the name of
an input column replace it; all other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from capweave.llm.tables import ship_package
from capweave.llm.words import Words, chunks, mixed, span_hashes

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_exclaims")

#: Name, failure as SQL over the measures.  A rule's place is its bit; places never change.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 2 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 60 * n_lines"),
    ("capitals", "100 * n_capitals > 40 * word_chars"),
    ("exclaims", "10 * n_exclaims > 3 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
)
BIT = {name: 1 << place for place, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
#: Masks of rules by version; a document is kept if it fails none of them.
POLICIES = {
    1: BASE,
    2: BASE | BIT["symbols"] | BIT["capitals"] | BIT["exclaims"],
    3: BASE | BIT["symbols"] | BIT["repeated_lines"] | BIT["capitals"] | BIT["exclaims"] | BIT["short_words"] | BIT["long_words"],
}
CURRENT = 3


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOL, _CAPITAL, _EXCLAIM = _flags("#*$%&|<>"), _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _flags("!")
_SPACE = _flags(" \t\n\v\f\r")


def _per_text(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeats(text: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether a key is found more than once in its text."""
    joined = mixed(key ^ mixed(text.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(joined, kind="stable")
    same = joined[order][1:] == joined[order][:-1]
    out = np.zeros(len(key), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def measured(words: Words) -> list[np.ndarray]:
    """The measures of each text, in the order of MEASURES."""
    data, bounds, n = words.data, words.bounds, words.n
    lead = ((data & 0xC0) != 0x80) & ~_SPACE[data]
    # Lines that hold a word: from the byte behind a line end, or the begin of the text, to the next.
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate([bounds[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([bounds[1:], breaks]))
    held = np.searchsorted(words.start, ends) > np.searchsorted(words.start, starts)
    starts, ends = starts[held], ends[held]
    line_text = np.searchsorted(bounds, starts, side="right") - 1
    key = mixed(span_hashes(data, starts, ends) ^ mixed(line_text.astype(np.uint64) + np.uint64(1)))
    once = np.zeros(len(key), dtype=bool)
    once[np.unique(key, return_index=True)[1]] = True
    n_lines = np.bincount(line_text, minlength=n)
    # Windows of three words of one text.
    hashed, text = words.hashes(), np.repeat(np.arange(n), words.count)
    repeated = np.zeros(len(hashed), dtype=bool)
    at = np.flatnonzero(np.arange(len(hashed)) + 2 < np.repeat(words.first[1:], words.count))
    if len(at):
        odd = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
        window = hashed[at] + mixed(hashed[at + 1] * odd[0]) + mixed(hashed[at + 2] * odd[1] + np.uint64(7))
        twice = at[_repeats(text[at], window)]
        for k in range(3):
            repeated[twice + k] = True
    return [
        words.count,
        _per_text(lead, bounds),
        _per_text(_SYMBOL[data], bounds),
        n_lines - np.bincount(line_text[once], minlength=n),
        np.bincount(text[repeated], minlength=n),
        n_lines,
        _per_text(_CAPITAL[data], bounds),
        _per_text(_EXCLAIM[data], bounds),
    ]


def ledger(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, with the measures and ``failed``, the bits of the rules that fail."""
    ship_package(docs.sparkSession)
    kept = [c for c in docs.columns if c != "text" and c not in MEASURES]
    schema = docs.select(*kept).schema
    for name in MEASURES:
        schema = schema.add(name, LongType())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, words in chunks(batch.column("text")):
                old = [batch.column(c).slice(at, words.n) for c in kept]
                new = [pa.array(x.astype(np.int64)) for x in measured(words)]
                yield pa.RecordBatch.from_arrays([*old, *new], [*kept, *MEASURES])

    made = docs.select(*kept, "text").mapInArrow(measure, schema)
    bits = [F.when(F.expr(fails), F.lit(BIT[name])).otherwise(F.lit(0)) for name, fails in RULES]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return made.withColumn("failed", failed.cast("bigint"))


def fails(mask: int) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask).cast("bigint")) != 0


def verdicts(entries: DataFrame, version: int = CURRENT) -> DataFrame:
    """The ledger with base_failed and kept under a policy."""
    return entries.withColumn("base_failed", fails(BASE)).withColumn("kept", ~fails(POLICIES[version] | BASE))


def ablations(entries: DataFrame, version: int = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that the policy would keep without it.

    One pass over the bits; nothing but a row of counts leaves the tasks.
    """
    mask = POLICIES[version] | BASE
    used = [(name, BIT[name]) for name, _ in RULES if BIT[name] & mask]
    counts = [F.count_if(~fails(mask)).alias("kept"), F.bit_or("failed").alias("seen")]
    for name, bit in used:
        counts += [F.count_if(fails(bit)).alias(f"{name}_fail"), F.count_if(fails(bit) & ~fails(mask & ~bit)).alias(f"{name}_alone")]
    row = entries.agg(*counts)
    each = [
        F.struct(
            F.lit(name).alias("rule"),
            F.col(f"{name}_fail").alias("n_fail"),
            F.col(f"{name}_alone").alias("n_alone"),
            (F.col("kept") + F.col(f"{name}_alone")).alias("kept_without"),
        )
        for name, _ in used
    ]
    return row.select(F.inline(F.array(*each)))


_POLICY_SQL = " OR ".join(f"({fails})" for name, fails in RULES if BIT[name] & POLICIES[CURRENT])
SQL = f"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
k AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g) WHERE n > 1),
p AS (SELECT r, count(DISTINCT i + d) AS n FROM k, (VALUES (0), (1), (2)) v(d) GROUP BY r),
l AS (
  SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(l.dup, 0)::BIGINT AS n_dup_lines,
         coalesce(p.n, 0)::BIGINT AS n_repeat_words, coalesce(l.n, 0)::BIGINT AS n_lines,
         len(regexp_extract_all(text, '[A-Z]')) AS n_capitals, len(regexp_extract_all(text, '!')) AS n_exclaims
  FROM t LEFT JOIN p ON p.r = t.r LEFT JOIN l ON l.r = t.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT ({_POLICY_SQL}) AS kept FROM m
"""
