"""Session helpers: table access and scratch space that survives lost executors.

Intermediate results that are read more than once, or that cut a long lineage,
are written as Parquet below the folder named by ``spark.checkpoint.dir``.  On a
cluster that folder is shared; only where the setting is absent (unit tests,
single-machine use) a temporary folder is chosen.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", memory)
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in (LOCAL_CONF | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; set to a temporary one where none is configured."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        context_dir = spark.sparkContext.getCheckpointDir()
        if context_dir:
            return context_dir
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="tesserae-")
        spark.sparkContext.setCheckpointDir(where)
        where = spark.sparkContext.getCheckpointDir()
    return where


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` in the session's number of shuffle partitions, by ``columns``.

    For rows that are few or narrow but cost much: adaptive execution would put
    them into one task by their size.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


class Scratch:
    """A folder of intermediate tables, one per run of an operator."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a DataFrame that reads the written copy."""
        path = self.path(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def append(self, df: DataFrame, name: str) -> None:
        df.write.mode("append").parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Delete one table, or the whole folder."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
