"""What the operators share: reading tables, scratch tables in the shared folder, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space between words.
BLANK = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark alone (the folder may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's spark.checkpoint.dir. Only where that is unset, as in local tests, a temporary
    folder of this machine is named.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Texts can be long: batches that go to Python are bounded by rows and bytes that two workers beside a heap can hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


class Scratch:
    """Written tables that cut lineage: a lost executor costs the tasks it ran, not the whole history.

    Tables that a returned plan reads stay in the shared folder as long as the session does; its end removes them.
    """

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        self.spark, self.top = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        self.made = 0
        atexit.register(self.remove)

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.top}/{self.made}"
        self.made += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def remove(self) -> None:
        """Deletes all tables. A session that has ended before leaves them to the folder's owner."""
        context = self.spark.sparkContext
        if context._jsc is not None and not context._jsc.sc().isStopped():
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.top)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, df: DataFrame) -> None:
        """Deletes a table of write() that no later plan reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of edges (a, b): one row (node, root) for every node of an edge.

    root is the smallest node. Large-star and small-star steps alternate until the edges no longer change,
    in O(log(n)^2) rounds; each round is two partial aggregations and two joins, written to the shared
    folder. What the large-star joins with is a table, so that Spark can split a hub's edges there (it can't split a shuffle that
    also feeds an aggregation); after it a node has only smaller neighbours, of which a hub's spokes have one each.
    Null ends and loops are ignored; no edges give no rows.
    """
    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    e = scratch.write(edges.where("a <> b").select(hi.alias("a"), lo.alias("b")).distinct())
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hub = scratch.write(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(hub, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        old, e = e, scratch.write(small.distinct())
        scratch.drop(old)
        scratch.drop(hub)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
