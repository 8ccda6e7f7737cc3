"""Small helpers that the operators share: table access, word pattern, scratch tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capweave.operators.scratch import materialize
from capweave.plans import session

#: A word: a longest run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_FIRST_ID = -(1 << 63)

__all__ = ["WORD", "first_by_hash", "id_key", "materialize", "read", "ship_package", "text_of"]


#: Rows of an Arrow batch: texts can be long, and a task holds several batches at a time.
BATCH_ROWS = 1_000


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, and bound the Arrow batches of the session."""
    session.ship_package(spark)
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def id_key(column: str = "doc_id") -> Column:
    """An id that joins and sorts also where it is null: null comes before every id."""
    return F.coalesce(F.col(column).cast("bigint"), F.lit(_FIRST_ID))


def first_by_hash(df: DataFrame, order: Column, k: int) -> DataFrame:
    """The ``k`` rows of ``df`` with the least ``order``, a 64-bit hash; adds it as ``o``.

    Hashes are spread evenly, so all but about the first 2 k rows are left out where they are read:
    otherwise every task would send k rows to the one that puts them in order.
    """
    n = df.count()
    hashed = df.withColumn("o", order)
    if n > 4 * (k + 1000):
        hashed = hashed.filter(F.col("o") <= _FIRST_ID + ((2 * k + 2000) << 64) // n)
    return hashed.orderBy("o").limit(k)
