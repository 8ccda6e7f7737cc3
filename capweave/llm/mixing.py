"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Every source has a weight and a size in words.  Targets share all words by
weight; a source never gets more than ``MAX_EPOCHS`` times its size, and what is
cut off is shared anew among the others by weight until no target is above its
cap.  A source's target is then taken from its documents: every document as
many whole times as the target holds the source, and the rest from documents in
seeded order until the target is met as nearly as whole documents allow.

Defined cases: a null text is empty and has size 0, and a document of size 0 is
repeated like the others but adds no words; a null source is a source of its
own, last in order; a source of size 0 has target 0 and none of it is taken.
Rows that repeat a document id are separate documents.  Of an empty table the
result is empty.  Columns of the input that have a name the operator makes are
left out of the result; all others are kept by :func:`mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capweave.llm.tables import WORD, materialize, text_of

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Hexadecimal digits of the seeded order that one step of the search looks at.
STEP = 3
STEPS = 2


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds the place of each source by code point, null last.

    Names are counted by their first two characters; a place is the names in
    earlier groups plus the place in the group, so no task sees all names.
    """
    head = F.substring("_source", 1, 2)
    grouped = sources.withColumn("_head", head)
    sizes = grouped.groupBy("_head").count()
    before = Window.orderBy(F.col("_head").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_head", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_head").orderBy(F.col("_source").asc_nulls_last())
    placed = grouped.withColumn("_in", F.row_number().over(within) - 1)
    joined = placed.alias("p").join(starts.alias("s"), F.expr("p._head <=> s._head"))
    return joined.select("p._source", "p.source_size", (F.col("_in") + F.col("_before")).alias("_rank"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Water-filling over a table (_source, source_size); adds ``target``.

    Each round brings one row of totals to the driver.  Sizes and weights are
    whole numbers, so the totals do not depend on the order of rows.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    table = materialize(_ranked(sources).withColumn("_weight", weight.cast("bigint")), "sources")
    whole = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    over = F.lit(False)  # sources at their cap
    seen = -1
    while True:
        free = F.when(over, 0)
        row = table.agg(
            F.count_if(over),
            F.coalesce(F.sum(F.when(over, F.col("source_size") * max_epochs)), F.lit(0)),
            F.coalesce(F.sum(free.otherwise(F.col("_weight"))), F.lit(0)),
        ).first()
        at_cap, held, left = row
        share = F.lit(float(whole - held)) * F.col("_weight") / F.lit(float(left or 1))
        cap = (F.col("source_size") * max_epochs).cast("double")
        if at_cap == seen or not left:
            break
        seen, over = at_cap, cap < share
    return table.withColumn("target", F.least(cap, share) if left else cap)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size and seeded order of every document; a narrow table."""
    order = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return docs.select("doc_id", F.col("source").alias("_source"), n_words(text_of()).alias("size"), order.alias("_order"))


def allotted(narrow: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, times (whole repetitions) and taken, one row per document.

    ``narrow`` is a written table from :func:`sized`.  The last documents of a source are found by a
    search in its seeded order: sums of the sizes by the first digits of the order say in which
    group the target falls, then the same inside that group, and only the documents of the group
    that is left are put in order one by one.
    """
    sums = narrow.groupBy("_source").agg(F.sum("size").alias("source_size"))
    goal = targets(sums)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(epochs).cast("bigint")
    goal = goal.withColumn("_whole", whole).withColumn(
        "_rest", F.col("target") - F.col("_whole") * F.col("source_size")
    )
    goal = materialize(goal.withColumn("_name", _name()), "goals")
    docs = narrow.withColumn("_name", _name())
    # The search: per source the digits found so far and what is still to be taken behind them.
    found = goal.select("_name", F.lit("").alias("_digits"), F.col("_rest").alias("_need"))
    for step in range(STEPS):
        upto = F.substring("_order", 1, (step + 1) * STEP)
        same = F.col("_digits") == F.substring("_order", 1, step * STEP)
        inside = docs.join(found, "_name").filter(same) if step else docs.join(found, "_name")
        parts = inside.groupBy("_name", upto.alias("_next")).agg(
            F.sum("size").alias("_size"), F.first("_need").alias("_need")
        )
        before = Window.partitionBy("_name").orderBy("_next").rowsBetween(Window.unboundedPreceding, -1)
        running = parts.withColumn("_gone", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        last = running.filter(F.col("_gone") <= F.col("_need")).groupBy("_name").agg(
            F.max_by(F.struct("_next", (F.col("_need") - F.col("_gone")).alias("_need")), "_next").alias("_at")
        )
        found = materialize(last.select("_name", F.col("_at._next").alias("_digits"), F.col("_at._need").alias("_need")), "search")
    place = docs.join(found.withColumnRenamed("_need", "_left"), "_name", "left").withColumn(
        "_side", F.substring("_order", 1, STEPS * STEP)
    )
    edge = place.filter(F.col("_side") == F.col("_digits"))
    line = Window.partitionBy("_name").orderBy("_order", "size")
    ahead = F.coalesce(F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = edge.withColumn("_ahead", ahead).withColumn("_more", (F.col("_left") - F.col("_ahead")) * 2 >= F.col("size"))
    edge = edge.withColumn("_more", F.col("_more") & (F.col("_left") > F.col("_ahead")))
    rest = place.filter(~F.col("_side").eqNullSafe(F.col("_digits"))).withColumn(
        "_more", F.coalesce(F.col("_side") < F.col("_digits"), F.lit(False))
    )
    columns = ["doc_id", "_name", "size", "_more"]
    marked = edge.select(columns).unionByName(rest.select(columns))
    times = F.when(F.col("source_size") > 0, F.col("_whole") + F.col("_more").cast("bigint")).otherwise(F.lit(0))
    return marked.join(goal, "_name").select(
        "doc_id", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken")
    )


def _name() -> Column:
    """A source as a join key that is never null."""
    return F.concat(F.when(F.col("_source").isNull(), F.lit("n")).otherwise(F.lit("s")), F.coalesce("_source", F.lit("")))


def mix(docs: DataFrame) -> DataFrame:
    """Size, target and words taken of every document."""
    return allotted(materialize(sized(docs), "sized"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns."""
    raw = docs.withColumn("_size", n_words(text_of()))
    plan = allotted(materialize(sized(docs), "sized"))
    often = plan.groupBy(F.col("doc_id").alias("_id"), F.col("size").alias("_words")).agg(
        F.sort_array(F.collect_list("times"), asc=False).alias("_times")
    )
    # Rows with the same id and size are interchangeable for the mix: the n-th of them gets the n-th number.
    nth = Window.partitionBy("doc_id", "_size").orderBy(F.xxhash64("text"))
    placed = raw.withColumn("_nth", F.row_number().over(nth))
    joined = placed.join(often, F.expr("doc_id <=> _id AND _size = _words"))
    copies = F.array_repeat(F.lit(1), F.element_at("_times", F.col("_nth")).cast("int"))
    return joined.withColumn("_copy", F.explode(copies)).select(*docs.columns)


SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS o
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
c AS (
  SELECT *, {MAX_EPOCHS} * source_size AS cap, sum(source_size) OVER () AS total,
         coalesce(sum({MAX_EPOCHS} * source_size) OVER lower, 0) AS held, sum(weight) OVER upper AS free
  FROM w
  WINDOW lower AS (ORDER BY source_size / weight::DOUBLE, weight, source_size, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         upper AS (ORDER BY source_size / weight::DOUBLE, weight, source_size, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
lev AS (  -- the first source, by cap for its weight, whose cap isn't below its share
  SELECT held, free, total FROM c WHERE cap >= (total - held)::DOUBLE * weight / free
  ORDER BY source_size / weight::DOUBLE LIMIT 1),
t AS (
  SELECT c.source, source_size, least(cap::DOUBLE, (lev.total - lev.held)::DOUBLE * weight / lev.free::DOUBLE) AS target FROM c, lev),
e AS (
  SELECT source, source_size, target,
         CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
r AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.whole,
         e.target - e.whole * e.source_size AS need,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0
       ELSE (whole + CASE WHEN need > ahead AND (need - ahead) * 2 >= size THEN 1 ELSE 0 END) * size END::BIGINT AS taken
FROM r
"""
