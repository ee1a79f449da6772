"""Operator 7: exact deduplication as a stateful stream.

A stream of (digest, row) records runs through a keyed aggregation whose state
lives on disk (RocksDB) and never expires.  Per digest the state retains the
row that stays: its code points, identifier and content locator (source file
and row number), and the size of the group.  Records are partially aggregated
before the shuffle, so a group of copies of any size sends a few rows.  Each
micro-batch writes the keys it changed; the last version of a key counts.

A hit is a digest with several rows.  Their normalised texts are compared in
full: within a digest the least and the greatest text must be equal, which is
again a map-side-combined aggregate.  Digests whose texts differ (a hash
collision) are grouped by text instead.

A row without a hit keeps itself and meets no join.  Rows with a hit meet the
state of their digest by a broadcast; where hits are too many for that, only
digests with over a thousandth of all rows are broadcast, at most a thousand,
and the rest is shuffled, so no digest's rows go to one task.

``exact_groups`` holds a table against itself, and its state serves one call.
``dedup_delivery`` keeps the state for later calls: a delivery is held against
all earlier ones, whose texts are found by the locators in the state.

Only DataFrame and Structured Streaming functions; no Python on the executors.
The stream's settings are those of a session of its own.

Edge cases: null text counts as empty; of equal texts the row with the most
code points stays, then the smallest id, nulls last, then the earliest row, so
repeated rows leave one; very long texts are compared whole; other columns do
not matter, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from draftmill.llm.common import SPACE_CLASS, save, text_of, with_row, work_dir

#: Digests of hits with their state are broadcast up to this many (some 50 MB).
BROADCAST_HITS = 200_000
#: Settings of the stream: state on disk; no preallocated files, of which each state partition would hold several megabytes;
#: a partition's store is closed when its task ends, as it would else hold native memory long after the stream.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_of(text), SPACE_CLASS + "+", "")


def _stream_session(spark: SparkSession) -> SparkSession:
    """A session of its own, with the state's settings and as many partitions as the caller's: a new session starts from the defaults."""
    own = spark.newSession()
    for k, v in {**_STATE, "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")}.items():
        own.conf.set(k, v)
    return own


def _sha(x: Column) -> Column:
    return F.sha2(x, 256)


def exact_groups(docs: DataFrame, row: str, id_column: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = _sha, bytes_per_batch: int = 64 << 30, files_per_batch: int | None = None) -> DataFrame:
    """For each row of docs, named by the unique column ``row``: keep_row, keep_id, group_size, digest, id.

    ``docs`` must be a stored table, as it is read twice.
    """
    spark = docs.sparkSession
    norm = normalised(text)
    landing = work_dir(spark, "dedup-landing")
    # The landing table is the stream's source; it has digests and locators, no texts.
    docs.select(F.col(row).alias("row"), F.col(id_column).alias("id"), F.length(text_of(text)).cast("long").alias("chars"), digest(norm).alias("digest")).write.parquet(landing)
    state = _stream(spark, landing, bytes_per_batch, files_per_batch)
    records = spark.read.parquet(landing)
    hits = save(state.where(F.col("group_size") > 1), "dedup-hits")
    few, hot = hits.count() <= BROADCAST_HITS, records.count() / 1000
    own = F.struct((-F.col("chars")).alias("less"), F.col("id").isNull().alias("no_id"), "id", "row")
    placed = _meet(records, hits, few, hot, "left").select("digest", "row", "id", "chars", F.coalesce("best", own).alias("best"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"))
    rows = docs.select(F.col(row).alias("row"), F.col(id_column).alias("id"), F.length(text_of(text)).cast("long").alias("chars"), norm.alias("norm")).withColumn("digest", digest(F.col("norm")))
    rows = _meet(rows, hits, few, hot, "left_semi")
    differ = save(rows.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).where(F.col("a") != F.col("b")).select("digest"), "dedup-collisions")
    if differ.limit(1).count():
        apart = rows.join(differ, "digest", "left_semi")
        by_text = apart.groupBy("norm").agg(_best().alias("best"), F.count("*").alias("group_size"))
        apart = apart.join(by_text, "norm").select("digest", "row", "id", "chars", "best", "group_size")
        placed = placed.join(differ, "digest", "left_anti").select("digest", "row", "id", "chars", "best", "group_size").unionByName(apart)
    return placed.select("row", "id", "digest", F.col("best.row").alias("keep_row"), F.col("best.id").alias("keep_id"), "group_size")


def _meet(rows: DataFrame, hits: DataFrame, few: bool, hot: float, how: str) -> DataFrame:
    """A left or semi join of rows with the hits that sends no hot digest's rows to one task."""
    if few:
        return rows.join(F.broadcast(hits), "digest", how)
    heavy, light = hits.where(F.col("group_size") > hot), hits.where(F.col("group_size") <= hot)
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").join(light, "digest", how)
    return rows.join(F.broadcast(heavy), "digest", "inner" if how == "left" else how).unionByName(rest)


def _best() -> Column:
    """The row that stays, as the least struct."""
    return F.min(F.struct((-F.col("chars")).alias("less"), F.col("id").isNull().alias("no_id"), "id", "row"))


def _stream(spark: SparkSession, landing: str, bytes_per_batch: int, files_per_batch: int | None) -> DataFrame:
    out, at = work_dir(spark, "dedup-state"), work_dir(spark, "dedup-checkpoint")
    source = spark.read.parquet(landing)
    own = _stream_session(spark)
    limit = {"maxFilesPerTrigger": files_per_batch} if files_per_batch else {"maxBytesPerTrigger": bytes_per_batch}
    grouped = (
        own.readStream.schema(source.schema)
        .options(**limit)
        .parquet(landing)
        .groupBy("digest")
        .agg(_best().alias("best"), F.count("*").alias("group_size"))
    )

    def put(batch: DataFrame, number: int) -> None:  # a batch that runs again replaces its own folder
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/{number}")

    query = grouped.writeStream.outputMode("update").option("checkpointLocation", at).trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    schema = source.select("digest", F.struct(F.col("chars").alias("less"), F.lit(True).alias("no_id"), "id", "row").alias("best"), F.lit(0).cast("long").alias("group_size"), F.lit(0).cast("int").alias("batch")).schema
    batches = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out) if source.limit(1).count() else spark.createDataFrame([], schema)
    return batches.groupBy("digest").agg(F.max_by(F.struct("best", "group_size"), "batch").alias("s")).select("digest", "s.best", "s.group_size")


def dedup_exact(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Only the rows that stay, with all columns of docs."""
    docs, row = with_row(docs)
    groups = exact_groups(docs, row, id_column, text, **options)
    stays = groups.where(F.col("row") == F.col("keep_row")).select(F.col("row").alias(row))
    return docs.join(stays, row, "left_semi").drop(row)


def dedup_delivery(docs: DataFrame, home: str, delivery: int, id_column: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = _sha) -> DataFrame:
    """The rows of a delivery whose text neither an earlier delivery nor an earlier row of this one has, with all columns of docs.

    ``home`` keeps, from call to call, the stream's checkpoint with its state:
    per digest the locators of the rows that stayed, one a delivery that brought
    one.  A row whose digest is there is a hit; the texts at its locators are
    read and compared in full, so rows of equal digest but other text stay.  The
    files of earlier deliveries must therefore still be where they were.
    Deliveries are numbered upwards; one that is given again gets the rows it
    got, and a call that broke off is finished by the next of its number.
    """
    spark = docs.sparkSession
    docs, row = with_row(docs)
    groups = exact_groups(docs, row, id_column, text, digest)
    stays = save(groups.where(F.col("row") == F.col("keep_row")).select("row", "digest"), "dedup-stays")
    emitted = f"{home}/seen/{delivery}"
    landing = f"{home}/landing/{delivery}"
    if not _exists(spark, f"{landing}/_SUCCESS"):
        stays.withColumn("delivery", F.lit(delivery)).write.mode("overwrite").parquet(landing)
    own = _stream_session(spark)
    source = own.readStream.schema(stays.withColumn("delivery", F.lit(0)).schema).option("recursiveFileLookup", "true").parquet(f"{home}/landing")
    state = source.groupBy("digest").agg(F.collect_list(F.struct("delivery", "row")).alias("known"))

    def put(batch: DataFrame, number: int) -> None:  # the digests of this delivery; a batch that runs again replaces its own folder
        batch.write.mode("overwrite").parquet(f"{emitted}/{number}")

    state.writeStream.outputMode("update").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    if not _exists(spark, emitted):
        return docs.where(F.lit(False)).drop(row)
    seen = spark.read.schema(state.schema).option("recursiveFileLookup", "true").parquet(emitted)
    hits = seen.select("digest", F.explode(F.filter("known", lambda k: k["delivery"] < delivery)).alias("k")).select("digest", F.col("k.row").alias("old"))
    hits = save(hits, "dedup-seen")
    files = [r[0] for r in hits.select("old.file").distinct().collect()]  # files, not rows
    new = docs.join(stays.select(F.col("row").alias(row), F.col("digest").alias("_dm_digest")), row)
    if not files:
        return new.select(docs.columns).drop(row)
    old = spark.read.parquet(*files).select(text, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias("old"))
    texts = old.join(hits, "old").select("digest", normalised(text).alias("theirs"))
    # A digest has one row of this delivery, or one a text where texts collide, and as many of each earlier one.
    mine = new.select(F.col(row).alias("row"), F.col("_dm_digest").alias("digest"), normalised(text).alias("mine"))
    known = mine.join(texts, "digest").where(F.col("mine") == F.col("theirs")).select(F.col("row").alias(row)).distinct()
    return new.select(docs.columns).join(known, row, "left_anti").drop(row)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
