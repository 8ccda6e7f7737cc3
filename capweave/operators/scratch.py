"""Tables written to the shared folder to cut lineage.

The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only a session whose
executors are this process (a local master, as in unit tests) may go without: it gets a
temporary folder of this machine.  Any other session without the setting is refused.
A setting without a file system means the cluster's default one, which is then named:
workers that write files themselves have no such default.
A written table survives the loss of executors and, unlike an RDD checkpoint,
keeps column pruning and filter push-down for its readers.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}


def is_local(spark: SparkSession) -> bool:
    """Whether the tasks run in the driver's own process."""
    return spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")


def scratch_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        root = _fallback.setdefault(app, tempfile.mkdtemp(prefix="capweave-"))
    return root.rstrip("/") if is_local(spark) else qualified(spark, root.rstrip("/"))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as in ``file:///x`` or ``hdfs://host/x``."""
    named = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = named.getFileSystem(spark._jsc.hadoopConfiguration())
    scheme, _, rest = named.makeQualified(system.getUri(), system.getWorkingDirectory()).toString().partition(":")
    return f"{scheme}:{rest}" if rest.startswith("//") else f"{scheme}://{rest}"


def scratch_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{scratch_root(spark)}/capweave-{app}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
