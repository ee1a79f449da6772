"""The polling job as a stream, with duplicate suppression across all batches by keyed state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from draftmill.functions import validation
from draftmill.operators import commits, dedup, outcomes, routing
from draftmill.plans.settings import Settings
from draftmill.streaming import ledger

def poll(source: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, settings: Settings = Settings(), once: bool = False) -> StreamingQuery:
    """Runs handle on each micro-batch, every poll interval, or on all that is there when once is set."""
    writer = source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{settings.poll_seconds} seconds")).start()


def landing(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """Submissions that arrive as Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_seen(batch: DataFrame, store: str, number: int) -> DataFrame:
    """(key, first): where those of the batch's keys that came before, or come again in it, came first, as (batch, rid).

    The keys of every batch run through a keyed aggregation whose state holds
    each key's first place and never expires.  A batch reads and writes the
    state of its own keys only, so a poll costs as much as its batch, however
    long the history is.  A batch that runs again meets the same first places.
    """
    keys = batch.where(F.col("error").isNull()).dropna(subset=list(dedup.KEY)).select(*dedup.KEY, F.col("rid").cast("long").alias("rid"))

    def step(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*dedup.KEY).agg(F.min(F.struct("batch", "rid")).alias("first"), F.count("*").alias("n"))

    found = ledger.advance(keys, number, step, store, "keys", "firsts").where("n > 1")
    return found.groupBy(*dedup.KEY).agg(F.min("first").alias("first"))


def intake(store: str, as_of: str, settings: Settings = Settings()) -> Callable[[DataFrame, int], None]:
    """Routes a batch against all history and stores its rows, receipts, mappings, events, moves and a log of routes as one commit.

    What a batch without its commit left behind goes when the job starts.
    """
    swept: list[bool] = []

    def handle(batch: DataFrame, number: int) -> None:
        if not swept:
            swept.append(True)
            commits.sweep(batch.sparkSession, store, list(outcomes.TABLES))
        firsts = first_seen(batch, store, number)
        judged = outcomes.needed(routing.judge_alone(batch, as_of, settings))
        here = F.struct(F.lit(number).cast("long").alias("batch"), F.col("rid").cast("long").alias("rid"))
        judged = judged.join(firsts, list(dedup.KEY), "left")
        gate = validation.duplicate_gate(F.col("routing_number"), F.col("check_number"))
        judged = judged.withColumn("is_duplicate", gate & F.col("error").isNull() & F.coalesce(F.col("first") < here, F.lit(False)))
        judged = judged.withColumn("route", routing.route())
        outcomes.write(judged.drop("first"), store, number, F.lit(as_of).cast("date"), settings)

    return handle
