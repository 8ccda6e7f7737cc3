"""Repeated passages removed by winnowing over line hashes, in DataFrame operations only.

A document is its sequence of lines that hold a word.  A *gram* is the shortest
run of lines from a given one on with at least ``GRAM_WORDS`` words.  Of the
grams that start within ``WINDOW_WORDS`` words the one with the least hash is
selected, so two documents that share a run of whole lines of ``GRAM_WORDS + WINDOW_WORDS``
words share a selected gram wherever the run lies, and a run of fewer than
``GRAM_WORDS`` words never matches (Schleimer, Wilkerson and Aiken, 2003, with
words for the length of lines).  Every occurrence of a selected gram after the
first, by document id and place, is matched with the first; the match is extended
line by line both ways, and the lines of the later run are deleted.

Words count the gram, so one line of 25 words or more is a gram by itself.

Defined cases: null and empty texts come back as they are, and lines without a
word are never matched nor deleted; a document whose lines all go becomes the
empty text, but keeps its row.  Rows with the same id and the same text are one
document and are cut alike; rows with the same id and other texts are separate.
An empty table gives an empty result.  Columns whose names begin with ``_ld_``
are reserved; all other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capweave.llm.mixing import n_words
from capweave.llm.tables import id_key, materialize, text_of

GRAM_WORDS = 25
WINDOW_WORDS = 25


def _lines(docs: DataFrame) -> DataFrame:
    """A row for each distinct document: key, and its lines' hashes, words and word offsets in order."""
    split = F.split(text_of(), "\n", -1)
    one = docs.select(id_key().alias("_ld_id"), F.xxhash64(text_of()).alias("_ld_text"), split.alias("_l"))
    marked = one.select(
        "_ld_id",
        "_ld_text",
        F.posexplode(F.transform("_l", lambda x: F.struct(F.unhex(F.md5(x)).alias("h"), n_words(x).cast("int").alias("w")))),
    ).filter("col.w > 0")
    lines = marked.select("_ld_id", "_ld_text", "pos", F.col("col.h").alias("h"), F.col("col.w").alias("w"))
    # Laid out as the windows need it; repeated rows of a document fall together without moving texts.
    return lines.repartition("_ld_id", "_ld_text").dropDuplicates(["_ld_id", "_ld_text", "pos"])


def _grams(lines: DataFrame) -> DataFrame:
    """Lines by number among those with words, with the gram that starts there, and whether it is selected."""
    by_doc = Window.partitionBy("_ld_id", "_ld_text").orderBy("pos")
    offset = F.sum("w").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)) - F.col("w")
    numbered = lines.withColumn("c", offset).withColumn("n", F.row_number().over(by_doc))
    by_words = Window.partitionBy("_ld_id", "_ld_text").orderBy("c")
    run = by_words.rangeBetween(0, GRAM_WORDS - 1)
    run_hash = F.unhex(F.md5(F.array_join(F.transform(F.collect_list("h").over(run), F.hex), ",")))
    grams = numbered.withColumn("_long", F.sum("w").over(run) >= GRAM_WORDS).withColumn(
        "g", F.when(F.col("_long"), run_hash)
    )
    near = by_words.rangeBetween(0, WINDOW_WORDS - 1)
    least = F.min(F.when(F.col("g").isNotNull(), F.struct("g", "n"))).over(near)
    return grams.withColumn("pick", least)


def removed_lines(docs: DataFrame) -> DataFrame:
    """(_ld_id, _ld_text, gone): the places of the lines to delete, for documents that lose any."""
    grams = materialize(_grams(_lines(docs)), "grams")
    key = ["_ld_id", "_ld_text"]
    picked = grams.filter("pick IS NOT NULL").select(*key, "pick.g", "pick.n").distinct()
    first = picked.groupBy("g").agg(F.count("*").alias("often"), F.min(F.struct(*key, "n")).alias("at"))
    first = materialize(first.filter("often > 1").select("g", "at"), "first")
    pairs = picked.join(first, "g").filter(F.struct(*key, "n") > F.col("at"))
    pairs = pairs.select(
        *key,
        F.col("at._ld_id").alias("_s_id"),
        F.col("at._ld_text").alias("_s_text"),
        (F.col("n") - F.col("at.n")).alias("shift"),
        "n",
    )
    pairs = pairs.groupBy(*key, "_s_id", "_s_text", "shift").agg(F.sort_array(F.collect_set("n")).alias("seeds"))
    whole = grams.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "h"))), lambda x: x.h).alias("hs"))
    whole = materialize(whole, "hashes")
    source = whole.select(F.col("_ld_id").alias("_s_id"), F.col("_ld_text").alias("_s_text"), F.col("hs").alias("ss"))
    both = pairs.join(whole, key).join(source, ["_s_id", "_s_text"])
    runs = both.select(*key, F.explode(_extended()).alias("n"))
    gone = runs.distinct().join(grams.select(*key, "n", "pos"), [*key, "n"])
    return gone.groupBy(*key).agg(F.sort_array(F.collect_list("pos")).alias("gone"))


def _extended() -> Column:
    """Numbers of the lines in equal runs of both documents that hold a seed.

    Lines that lie opposite each other are compared once for each pair of documents and shift.
    """
    low = F.greatest(F.lit(1), 1 + F.col("shift"))
    high = F.least(F.size("hs"), F.size("ss") + F.col("shift"))
    breaks = F.filter(
        F.sequence(low, high), lambda n: F.get("hs", n - 1) != F.get("ss", n - F.col("shift") - 1)
    )
    # A run lies between two places that differ; a seed belongs to the run between the places around it.
    ends = F.concat(F.array(low - 1), breaks, F.array(high + 1))
    spans = F.zip_with(
        F.slice(ends, F.lit(1), F.size(ends) - 1),
        F.slice(ends, F.lit(2), F.size(ends) - 1),
        lambda a, b: F.struct((a + 1).alias("a"), (b - 1).alias("b")),
    )
    held = F.filter(spans, lambda r: (r.a <= r.b) & F.exists("seeds", lambda n: (n >= r.a) & (n <= r.b)))
    return F.flatten(F.transform(held, lambda r: F.sequence(r.a, r.b)))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with later repeated runs of lines cut from the text; adds ``_ld_gone``, the places cut (null if none)."""
    gone = removed_lines(docs)
    keyed = docs.withColumn("_ld_id", id_key()).withColumn("_ld_text", F.xxhash64(text_of()))
    joined = keyed.join(gone.withColumnRenamed("gone", "_ld_gone"), ["_ld_id", "_ld_text"], "left")
    split = F.split(text_of(), "\n", -1)
    kept = F.filter(split, lambda x, i: ~F.array_contains("_ld_gone", i))
    text = F.when(F.col("_ld_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn("text", text).drop("_ld_id", "_ld_text")


SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
w AS (SELECT doc_id, pos, line, md5(line) AS h, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS w FROM l),
n AS (
  SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) - w AS c, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n
  FROM w WHERE w > 0),
g AS (
  SELECT *, CASE WHEN sum(w) OVER r >= {GRAM_WORDS} THEN md5(array_to_string(list(upper(h)) OVER r, ',')) END AS g FROM n
  WINDOW r AS (PARTITION BY doc_id ORDER BY c RANGE BETWEEN CURRENT ROW AND {GRAM_WORDS - 1} FOLLOWING)),
p AS (
  SELECT doc_id, min(CASE WHEN g IS NOT NULL THEN {{'g': g, 'n': n}} END) OVER (
    PARTITION BY doc_id ORDER BY c RANGE BETWEEN CURRENT ROW AND {WINDOW_WORDS - 1} FOLLOWING) AS x FROM g),
s AS (SELECT DISTINCT doc_id, x.g AS g, x.n AS n FROM p WHERE x IS NOT NULL),
m AS (
  SELECT DISTINCT doc_id, src, n, n - src_n AS shift FROM (
    SELECT doc_id, g, n, first_value(doc_id) OVER e AS src, first_value(n) OVER e AS src_n FROM s
    WINDOW e AS (PARTITION BY g ORDER BY doc_id, n)) WHERE (doc_id, n) <> (src, src_n)),
o AS (  -- lines that lie opposite each other and are equal
  SELECT k.doc_id, k.src, k.shift, a.n, a.pos, a.n - row_number() OVER (PARTITION BY k.doc_id, k.src, k.shift ORDER BY a.n) AS island
  FROM (SELECT DISTINCT doc_id, src, shift FROM m) k
  JOIN n a ON a.doc_id = k.doc_id JOIN n b ON b.doc_id = k.src AND b.n = a.n - k.shift AND b.h = a.h),
cut AS (
  SELECT DISTINCT o.doc_id, o.pos FROM o JOIN (
    SELECT DISTINCT o.doc_id, o.src, o.shift, o.island FROM o JOIN m USING (doc_id, src, shift, n)) i
  USING (doc_id, src, shift, island))
SELECT d.doc_id, coalesce(k.gone, 0)::BIGINT AS n_removed,
       CASE WHEN k.gone IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN (
  SELECT l.doc_id, count(cut.pos) AS gone, string_agg(CASE WHEN cut.pos IS NULL THEN line END, chr(10) ORDER BY l.pos) AS text
  FROM l LEFT JOIN cut ON l.doc_id = cut.doc_id AND l.pos = cut.pos GROUP BY l.doc_id HAVING count(cut.pos) > 0) k
ON d.doc_id = k.doc_id
"""
