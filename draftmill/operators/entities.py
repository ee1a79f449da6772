"""Entities laid out for scans of the active ones and for finding them by name: only the folders that can hold them are read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


@dataclass(frozen=True)
class Entities:
    """A table of entities, by whether they are active and by the hash of their name; null activity counts as inactive."""

    path: str
    schema: StructType
    name: str = "name"
    active: str = "active"
    buckets: int = 16

    def _bucket(self, name: Column) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(self.buckets)).cast("int")

    def save(self, rows: DataFrame) -> None:
        rows = rows.select(self.schema.fieldNames()).withColumns({self.active: F.coalesce(F.col(self.active), F.lit(False)), "bucket": self._bucket(F.col(self.name))})
        laid = rows.repartition(self.active, "bucket").sortWithinPartitions(self.active, "bucket", self.name)
        laid.write.mode("overwrite").partitionBy(self.active, "bucket").option(f"parquet.bloom.filter.enabled#{self.name}", "true").parquet(self.path)

    def _read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(StructType([*self.schema.fields, StructField("bucket", IntegerType())])).parquet(self.path)

    def scan(self, spark: SparkSession) -> DataFrame:
        """The active entities; folders of others are not read."""
        return self._read(spark).where(F.col(self.active)).select(self.schema.fieldNames())

    def named(self, spark: SparkSession, name: str) -> DataFrame:
        """The active entities of a name, whatever characters it has: a value in the plan, never a part of a statement."""
        bucket = spark.range(1).select(self._bucket(F.lit(name))).first()[0]
        return self._read(spark).where(F.col(self.active) & (F.col("bucket") == bucket) & (F.col(self.name) == F.lit(name))).select(self.schema.fieldNames())

    def find(self, names: DataFrame, id_column: str) -> DataFrame:
        """Each distinct name of (name) with the least id of an active entity so named, null where there is none; only buckets of these names are read."""
        spark = names.sparkSession
        wanted = names.select(F.col(names.columns[0]).alias("wanted")).dropna().distinct()
        touched = [r[0] for r in wanted.select(self._bucket(F.col("wanted")).alias("b")).distinct().collect()]  # at most one row a bucket
        rows = self._read(spark).where(F.col(self.active) & F.col("bucket").isin(touched))
        least = rows.groupBy(self.name).agg(F.min(id_column).alias(id_column))
        return wanted.join(least, wanted["wanted"] == least[self.name], "left").select(F.col("wanted").alias(self.name), id_column)
