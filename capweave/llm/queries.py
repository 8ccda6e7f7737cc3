"""The registered queries of the operators, with the SQL that gives the same rows where there is any."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capweave.llm import ann, bpe, convo_repair, html_text, line_dedup, lm_score, mixing, near_dup, pii, quality, runs, toxicity, url_filter
from capweave.llm.tables import read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return keep


@_query("op5_line_dedup", line_dedup.SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", F.coalesce(F.size("_ld_gone"), F.lit(0)).cast("bigint").alias("n_removed"), "text")


@_query("op7_mix_sources", mixing.SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


@_query("op10_near_duplicates")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.classes(read(spark, sf_dir, "documents").select("doc_id", "text"))
    key = near_dup.id_of
    return found.select(key(F.col("key")).alias("doc_id"), key(F.col("class")).alias("class_id"))


@_query("op2_byte_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoder = spark.sparkContext.broadcast(bpe.Decoder())

    def digests(batch: pa.RecordBatch, ids: pa.Array) -> list[pa.Array]:
        size = pc.list_value_length(ids).cast(pa.int64())
        return [size, bpe.ids_sha256(ids), bpe.sha256_of(decoder.value.decode(ids))]

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    made = bpe.encode(docs, derive=digests, derived="n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return made.drop("text")


@_query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return toxicity.toxicity(docs.select("doc_id", "text"), labels.select("doc_id", "toxic")).select("doc_id", "held_out", "score", "predicted")


@_query("op9_quality_rules", quality.SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.verdicts(quality.ledger(read(spark, sf_dir, "documents").select("doc_id", "text")))
    return judged.select("doc_id", *quality.MEASURES[:5], "base_failed", "kept")


@_query("op8_personal_data")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents").select("doc_id", "text"))
    found = found.select("*", *[pii.how_many(kind).alias(f"n_{kind}") for kind in pii.KINDS])
    counts = [f"n_{kind}" for kind in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(pii.named_spans(False), 256).alias("base_sha256"), pii.named_spans(True).alias("spans")
    )


@_query("op6_url_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(read(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@_query("op1_nearest_neighbours")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


@_query("op3_main_text")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


@_query("op12_lm_scores")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.score(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(read(spark, sf_dir, "documents").select("doc_id", "text"))


@_query("op11_conversation_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convo_repair.repaired(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
