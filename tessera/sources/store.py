"""Tables written once and read by many plans, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where that is unset under a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows of a task, where a step works long on each row. Files of few bytes would else be one task, however many rows they hold.
ROWS = 20_000


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df dealt to tasks of about ROWS rows by a hash of key; small tables to as many tasks as run at once."""
    rows = df.count()
    tasks = max(1, -(-rows // ROWS), min(df.sparkSession.sparkContext.defaultParallelism, -(-rows // 1000)))
    return df.repartition(tasks, key)


class Store:
    """Parquet tables by name under a folder of its own, removed when the program ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        atexit.register(self.remove)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def remove(self) -> None:
        context = self.spark.sparkContext
        if context._jsc is not None and not context._jsc.sc().isStopped():
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
