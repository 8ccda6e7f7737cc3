import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as C
from capweave.llm import queries as Q
from capweave.llm.tables import materialize
from checks.compare import TABLES, rows_of
from tests.llm.helpers import docs, jaccard, words_of


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    made = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, stage in C.STAGES:
        made.append(materialize(stage(spark, made[-1], sf_dir), "stage"))
    return made


def test_columns_and_rows_of_each_stage(stages):
    raw, clean, cut, alone, mix, ids = stages
    for made in (clean, cut, alone, mix):
        assert made.columns == raw.columns
    assert 0 < clean.count() < raw.count() and cut.count() == clean.count()
    assert alone.count() < cut.count() and alone.select("doc_id").distinct().count() == alone.count()
    assert ids.count() == mix.count() and ids.filter("NOT round_trip OR size(ids) <> n_tokens").count() == 0


def test_toxic_documents_go_and_others_stay(spark, sf_dir, stages):
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet").join(stages[0], "doc_id").select("doc_id", "toxic").collect()
    kept = {r.doc_id for r in stages[1].select("doc_id").collect()}
    clean = [r.doc_id for r in marks if not r.toxic]
    assert sum(i in kept for i in clean) >= 0.85 * len(clean)


def test_no_near_copies_are_left_and_every_class_keeps_one(stages):
    before = {r.doc_id: r.text for r in stages[2].select("doc_id", "text").collect()}
    after = {r.doc_id for r in stages[3].select("doc_id").collect()}
    ids = sorted(before)
    for n, a in enumerate(ids):
        wa = set(words_of(before[a]))
        for b in ids[n + 1 :]:
            if len(wa & set(words_of(before[b]))) * 2 >= len(wa) and (before[a] == before[b] or jaccard(before[a], before[b]) >= 0.84):
                assert not (a in after and b in after), (a, b)
    gone = set(before) - after
    assert all(any(before[a] == before[b] or jaccard(before[a], before[b]) >= 0.76 for b in ids if b != a) for a in gone)


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    got = C.run(spark, sf_dir).select("doc_id", F.array_join("ids", ",")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, stages[-1].select("doc_id", F.array_join("ids", ",")).collect()))


def test_odd_documents_pass_every_stage(spark, sf_dir):
    rows = [(1, None), (2, ""), (3, "word " * 50_000), (3, "word " * 50_000), (None, "x y z"), (4, "a\n\nb")]
    made = docs(spark, rows).withColumn("source", F.when(F.col("doc_id") == 4, None).otherwise(F.col("source"))).withColumn("key", F.lit(1))
    for _, stage in C.STAGES:
        made = materialize(stage(spark, made, sf_dir), "stage")
    assert made.filter("NOT round_trip").count() == 0
    empty = docs(spark, rows).limit(0)
    for _, stage in C.STAGES:
        empty = materialize(stage(spark, empty, sf_dir), "stage")
    assert empty.count() == 0


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    got, want = entry.queries()[name](spark, sf_dir).toPandas(), con.execute(Q.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and sorted(rows_of(got)) == sorted(rows_of(want))


CONTRACT = {
    "op1_": "query_id rank vec_id score",
    "op2_": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op3_": "page_id url text n_chars",
    "op4_": "doc_id held_out score predicted",
    "op6_": "page_id host path rule verdict",
    "op7_": "doc_id size source_size target taken",
    "op8_": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op9_": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
}


@pytest.mark.parametrize("prefix", CONTRACT)
def test_queries_have_the_agreed_columns(spark, sf_dir, prefix):
    name = next(n for n in Q.QUERIES if n.startswith(prefix))
    assert entry.queries()[name](spark, sf_dir).columns == CONTRACT[prefix].split()
