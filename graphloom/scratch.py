"""Tables written to shared storage, to cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The shared folder that the session names; a local one of our own only if it names none and is local itself."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{folder(spark)}/graphloom/{name}-{uuid.uuid4().hex}"


def keep(spark: SparkSession, df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it from there; ``codec`` is for tables of bases, which the usual one hardly shortens."""
    path = new_path(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    fs, found = _path(spark, path)
    return fs.exists(found)


def delete(spark: SparkSession, path: str) -> None:
    fs, found = _path(spark, path)
    fs.delete(found, True)


class Rounds:
    """The written states of an iteration. A state is read until the next one is written, so the last two stay."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name, self.paths = spark, name, []

    def keep(self, df: DataFrame) -> DataFrame:
        path = new_path(self.spark, self.name)
        df.write.parquet(path)
        self.paths.append(path)
        if len(self.paths) > 2:
            delete(self.spark, self.paths.pop(0))
        return self.spark.read.schema(df.schema).parquet(path)

    def end(self) -> None:
        """Drop all states, once what is left of them is written elsewhere."""
        for path in self.paths:
            delete(self.spark, path)
        self.paths.clear()


def _dealt(spark: SparkSession, df: DataFrame, order: list[str], weight, name: str) -> tuple[DataFrame, DataFrame]:
    """``df`` by ranges of an order, written with the range's number, and each range's sum of ``weight`` over those before it."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    dealt = keep(spark, dealt, name)
    before, parts = 0, []
    for r in dealt.groupBy("_part").agg(F.sum(weight).alias("sum")).orderBy("_part").collect():  # a row a range
        parts.append((r["_part"], before))
        before += r["sum"] or 0
    kind = dealt.select(F.sum(weight).alias("sum")).schema["sum"].dataType.simpleString()
    if kind == "double":
        parts = [(p, float(b)) for p, b in parts]
    return dealt, F.broadcast(spark.createDataFrame(parts, f"_part int, _before {kind}"))


def numbered(spark: SparkSession, df: DataFrame, order: list[str], column: str, name: str = "numbered") -> DataFrame:
    """``df`` with ``column`` 0, 1, ... in order; only one count per partition reaches the driver."""
    dealt, offsets = _dealt(spark, df, order, F.lit(1), name)
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_within", within).join(offsets, "_part").withColumn(column, F.col("_before") + F.col("_within") - 1).drop("_part", "_before", "_within")


def cumulated(spark: SparkSession, df: DataFrame, order: list[str], weight: str, column: str, name: str = "cumulated") -> DataFrame:
    """``df`` with ``column``, the sum of ``weight`` over the row and all before it in order; only one sum per partition reaches the driver."""
    dealt, offsets = _dealt(spark, df, order, F.col(weight), name)
    within = F.sum(weight).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_within", within).join(offsets, "_part").withColumn(column, F.col("_before") + F.col("_within")).drop("_part", "_before", "_within")
