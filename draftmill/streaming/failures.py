"""Failures set aside: unreadable records, dead letters, and retries that wait for their time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from draftmill.functions import scalars, validation
from draftmill.plans.settings import Settings
from draftmill.streaming import ledger

UNREADABLE = "_unreadable"


def landing(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """Submissions that arrive as JSON lines; a record that can't be read, or a file of other content, becomes a row with an error instead of stopping the poll.

    Such a row has the file's name in its ``error`` and no number of its own: it
    gets a negative one, from its file and text.
    """
    source = spark.readStream.schema(StructType([*schema.fields]).add(UNREADABLE, StringType()))
    rows = source.option("maxFilesPerTrigger", files_per_batch).option("columnNameOfCorruptRecord", UNREADABLE).option("mode", "PERMISSIVE").json(path)
    bad, file = F.col(UNREADABLE).isNotNull(), F.col("_metadata.file_path")
    number = -F.pmod(F.xxhash64(file, UNREADABLE), F.lit(1 << 60)) - 1
    error = F.concat(F.lit("unreadable record in "), F.regexp_extract(file, "[^/]*$", 0))
    return rows.withColumns({"error": F.when(bad, error).otherwise(F.col("error")), "rid": F.when(bad, number).otherwise(F.col("rid"))}).drop(UNREADABLE)


def dead_letters(rows: DataFrame) -> DataFrame:
    """(rid, attempt, error) of failed rows; an attempt that the row doesn't tell is the first."""
    attempt = F.coalesce(F.col("attempt").cast("int"), F.lit(1)) if "attempt" in rows.columns else F.lit(1)
    return rows.where("route = 'failed'").select("rid", attempt.alias("attempt"), "error")


def retries(failures: DataFrame, store: str, number: int, now: int, status: Column | None = None, settings: Settings = Settings()) -> DataFrame:
    """What becomes of failures by second ``now``: (rid, attempt, outcome, error), an attempt to make now or a failure for good.

    ``failures`` has rows of (rid, attempt from 1, error), which failed since the
    last poll, and the ``status`` of the response, none if there was none.  A
    failure that may be tried again waits for its time, a delay after its poll
    that doubles with every attempt; any other is final.  A later failure of a
    row stands for its earlier ones.  What waits is a table that each poll
    carries on, grouped by row in one job; time is the polls'
    own clock, which must advance from poll to poll, so a poll that runs again
    gives the same.
    """
    tried = F.col("attempt").cast("int")
    again = validation.should_retry(F.lit(None).cast("int") if status is None else status, tried - 1, settings.api_attempts)
    due = (F.lit(now) + scalars.retry_delay(tried, settings.api_delay, 2.0)) * 1000
    rows = failures.select(F.col("rid").cast("long").alias("rid"), tried.alias("attempt"), again.alias("again"), due.cast("long").alias("due"), F.col("error").cast("string").alias("error"))

    def step(rows: DataFrame) -> DataFrame:
        last = rows.groupBy("rid").agg(F.max(F.struct("new", "attempt", "due", "again", "error")).alias("last")).select("rid", "last.*")
        woken = F.col("due") < now * 1000  # the clock has passed it
        outcome = F.when(~F.col("again"), "dead").when(woken, "retry")
        attempt = F.when(F.col("again") & woken, F.col("attempt") + 1).otherwise(F.col("attempt"))
        return last.select("rid", attempt.alias("attempt"), outcome.alias("outcome"), "error", "again", "due", outcome.isNull().alias("stays"))

    return ledger.carry(rows, number, step, ["rid", "attempt", "again", "due", "error"], store, "retries").select("rid", "attempt", "outcome", "error")
