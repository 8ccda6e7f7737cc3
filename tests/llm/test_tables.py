from pyspark.sql import functions as F

from capweave.llm.tables import first_by_hash


def test_first_by_hash_is_the_plain_order(spark):
    for n in (0, 10, 30_000):
        df = spark.range(n)
        got = [r.id for r in first_by_hash(df, F.xxhash64("id", F.lit(3)), 50).orderBy("o").collect()]
        assert got == [r.id for r in df.orderBy(F.xxhash64("id", F.lit(3))).limit(50).collect()]
