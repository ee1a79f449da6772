"""Keyed state that the polls of a job read and advance, each poll exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from draftmill.sources import workdir

#: State on disk, of which a poll writes only what it changed.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def advance(rows: DataFrame, number: int, step: Callable[[DataFrame], DataFrame], store: str, name: str, out: str) -> DataFrame:
    """Runs a poll's rows through a stateful query and gives what it emits for them.

    ``step`` makes the stateful query of a stream that has the columns of rows
    and ``batch``.  Rows are put down once a batch, under ``store/name``: a batch
    that runs again finds its own and adds nothing, finishes what was left
    undone, and gets what the first run got, from ``store/out``.  Rows of earlier
    batches are in the state by then and go, so neither a listing nor the state
    a poll touches grows with the number of polls.
    """
    spark = rows.sparkSession
    inbox, results = f"{store}/{name}", f"{store}/{out}/batch={number}"
    for old in workdir.batches(spark, inbox):
        if old < number:
            workdir.remove(spark, f"{inbox}/batch={old}")
    if not workdir.exists(spark, f"{inbox}/batch={number}/_SUCCESS"):
        rows.write.mode("overwrite").parquet(f"{inbox}/batch={number}")
    own = spark.newSession()  # settings of its own
    for k, v in STATE.items():
        own.conf.set(k, v)
    source = own.readStream.schema(StructType([*rows.schema.fields]).add("batch", "long")).parquet(inbox)
    stepped = step(source)

    def put(emitted: DataFrame, at: int) -> None:  # a micro-batch that runs again replaces its own folder
        emitted.write.mode("overwrite").parquet(f"{results}/at={at}")

    stepped.writeStream.outputMode("update").option("checkpointLocation", f"{store}/{name}-state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    schema = StructType([*stepped.schema.fields])
    return spark.read.schema(schema).parquet(results).select(schema.fieldNames()) if workdir.exists(spark, results) else spark.createDataFrame([], schema)


def carry(rows: DataFrame, number: int, step: Callable[[DataFrame], DataFrame], waits: list[str], store: str, out: str) -> DataFrame:
    """Runs a poll's rows together with those that wait from earlier polls, and gives what ``step`` makes of them and lets go.

    For what leaves again, so that what waits stays about as large as what comes:
    a poll reads and writes all that waits, in one job.  ``step`` gets the rows
    with ``new`` (whether they are this poll's), those that wait with null for
    what is not among the columns ``waits``, and gives rows with ``stays``, true
    for those that wait for a later poll, in these columns.  The poll's table in
    ``store/out`` holds both, so one write commits it; a poll that runs again
    gets what the first run got.  What waited for an earlier poll goes.
    """
    spark, home = rows.sparkSession, f"{store}/{out}"

    def at(poll: int) -> str:
        return f"{home}/batch={poll}"

    done = [n for n in workdir.batches(spark, home) if n <= number and workdir.exists(spark, f"{at(n)}/_SUCCESS")]
    earlier = [n for n in done if n < number]
    rows = rows.withColumn("new", F.lit(True))
    stepped = step(rows)
    schema = StructType([f for f in stepped.schema.fields if f.name != "stays"])
    if number not in done:
        before = earlier[-1] if earlier else None
        if before is not None and workdir.exists(spark, f"{at(before)}/stays=true"):
            waiting = spark.read.schema(schema).parquet(f"{at(before)}/stays=true").select(*waits, F.lit(False).alias("new"))
            stepped = step(rows.unionByName(waiting, allowMissingColumns=True))
        stepped.write.mode("overwrite").partitionBy("stays").parquet(at(number))
        for old in earlier[:-1]:
            workdir.remove(spark, f"{at(old)}/stays=true")
    let_go = f"{at(number)}/stays=false"
    return spark.read.schema(schema).parquet(let_go) if workdir.exists(spark, let_go) else spark.createDataFrame([], schema)
