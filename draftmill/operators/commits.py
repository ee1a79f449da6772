"""A batch's writes to several tables count together or not at all.

Each table has a folder a batch.  What a batch wrote counts from the moment its
marker is there, which is written last; readers leave out batches without one,
and the next start sweeps away what a broken batch left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from draftmill.sources import workdir

MARKERS = "commits"


def is_done(spark: SparkSession, store: str, number: int) -> bool:
    return workdir.exists(spark, f"{store}/{MARKERS}/batch={number}/_SUCCESS")


def write(parts: dict[str, DataFrame], store: str, number: int) -> None:
    """Writes all parts, then the marker; a batch that is committed stays as it is."""
    spark = next(iter(parts.values())).sparkSession
    if is_done(spark, store, number):
        return
    for name, part in parts.items():
        part.write.mode("overwrite").parquet(f"{store}/{name}/batch={number}")
    mark(spark, store, number, list(parts))


def mark(spark: SparkSession, store: str, number: int, tables: list[str]) -> None:
    spark.createDataFrame([(tables,)], "tables array<string>").coalesce(1).write.mode("overwrite").parquet(f"{store}/{MARKERS}/batch={number}")


def read(spark: SparkSession, store: str, name: str, schema: StructType | None = None) -> DataFrame:
    """A table's rows of all committed batches, with the number of the batch; the folders of others are not read."""
    done = {n for n in workdir.batches(spark, f"{store}/{MARKERS}") if is_done(spark, store, n)}
    here = [n for n in workdir.batches(spark, f"{store}/{name}") if n in done]
    reader = spark.read.option("basePath", f"{store}/{name}")
    if not here:
        if schema is None:
            raise ValueError(f"{name} has no committed batch to take its columns from")
        return spark.createDataFrame([], StructType([*schema.fields]).add("batch", "int"))
    rows = (reader.schema(StructType([*schema.fields]).add("batch", "int")) if schema else reader).parquet(f"{store}/{name}")
    return rows.where(F.col("batch").isin(here)) if len(here) < len(workdir.batches(spark, f"{store}/{name}")) else rows


def sweep(spark: SparkSession, store: str, tables: list[str]) -> list[str]:
    """Removes what batches without a marker left in these tables; gives the folders."""
    gone = []
    for name in tables:
        for number in workdir.batches(spark, f"{store}/{name}"):
            if not is_done(spark, store, number):
                gone.append(f"{name}/batch={number}")
                workdir.remove(spark, f"{store}/{gone[-1]}")
    return gone
