"""The corpus pipeline: stages that each apply one operator to what the stage before has kept."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capweave.llm import bpe, line_dedup, mixing, near_dup, toxicity
from capweave.llm.tables import materialize, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that the classifier calls toxic."""
    judged = toxicity.toxicity(docs.select(*COLUMNS), read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return judged.filter("predicted = 0").select(*COLUMNS)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes passages that an earlier document or line already has; ``n_chars`` follows the text."""
    cut = line_dedup.dedup_lines(docs.select(*COLUMNS))
    n_chars = F.when(F.col("_ld_gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint"))
    return cut.withColumn("n_chars", n_chars).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each class of near copies."""
    return near_dup.survivors(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents until each source has its target."""
    return mixing.mixed(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, checked by decoding them."""
    decoder = spark.sparkContext.broadcast(bpe.Decoder())

    def checked(batch: pa.RecordBatch, ids: pa.Array) -> list[pa.Array]:
        text = batch.column("text").fill_null("").cast(pa.binary())
        return [ids, pc.list_value_length(ids).cast(pa.int64()), pc.equal(decoder.value.decode(ids), text)]

    made = "ids array<int>, n_tokens bigint, round_trip boolean"
    return bpe.encode(docs.select(*COLUMNS), derive=checked, derived=made).drop("text", "n_chars")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", cut_repeated_lines),
    ("near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: No SQL: the classifier, the sampled signatures and the merges have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
