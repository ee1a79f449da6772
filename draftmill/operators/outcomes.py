"""What a batch of judged submissions leaves behind: receipts, stored rows, mappings, log events and folders.

Ids are given against those of all earlier batches.  All else is a projection of
the judged rows with their ids, and a batch writes it as one commit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftmill.functions import ids, scalars
from draftmill.operators import commits, dedup, payload, routing
from draftmill.operators.store import MAPPING_REQUIRED
from draftmill.plans.settings import Settings
from draftmill.sources import workdir
from draftmill.streaming import failures, ledger, mails

ID_FIELDS = ("routing_number", "account_number", "check_number", "check_date", "amount")


#: What a batch reads of its judged rows, where they have it; scores and other columns would only be shuffled and written.
NEEDED = ("rid", *ID_FIELDS, "customer_name", "confidence", "review_reason", "error", "memo", "state", "file", "items", "message_id", "attempt", "route")


def needed(judged: DataFrame) -> DataFrame:
    return judged.select(*(c for c in NEEDED if c in judged.columns))


def marked(judged: DataFrame) -> DataFrame:
    """Processed and manual-review rows with the text of their id, and whether they will be mapped: processed ones with all that a mapping requires."""
    whole = F.lit(True)
    for c in MAPPING_REQUIRED:
        if c != "check_id":
            whole &= F.col(c).isNotNull()
    kept = judged.where(F.col("route").isin("processed", "manual_review"))
    return kept.withColumns({"id_text": ids.hash_input(*(F.col(c) for c in ID_FIELDS)), "mapped": (F.col("route") == "processed") & whole})


def with_ids(judged: DataFrame, before: DataFrame | None = None, unique: bool = False) -> DataFrame:
    """Processed and manual-review rows with ``check_id`` and ``shareable_id``.

    An id steps aside for ids that are mapped: it counts the earlier mapped rows
    of its text.  ``before`` has the counts of earlier batches, ``mapped`` and
    ``unmapped`` a text.  Rows that are stored without a mapping leave their id
    free to be given again; with ``unique``, such a later row is refused, and its
    route becomes failed.
    """
    rows = dedup.counted_before(marked(judged), "id_text", "rid", {"n_mapped": F.col("mapped"), "n_unmapped": ~F.col("mapped")}, before)
    rows = rows.withColumn("check_id", ids.hash_id(F.col("id_text"), F.col("n_mapped")))
    shareable = ids.reversible_id(F.col("check_number"), F.col("amount"), F.col("check_date"), F.col("customer_name"), F.col("routing_number"))
    rows = rows.withColumn("shareable_id", shareable)
    if unique:
        # Once a row keeps an id without mapping it, every later row of the text comes upon that id.
        taken = F.col("n_unmapped") > 0
        rows = rows.withColumns({"error": F.when(taken, F.concat(F.lit("check id is stored already: "), "check_id")).otherwise(F.col("error")), "route": F.when(taken, "failed").otherwise(F.col("route"))})
        rows = rows.withColumns({c: F.when(F.col("route") != "failed", F.col(c)) for c in ("check_id", "shareable_id")})
    return rows.drop("id_text", "mapped", "n_mapped", "n_unmapped")


def counts_before(judged: DataFrame, store: str, number: int) -> DataFrame:
    """(id_text, n_mapped, n_unmapped): rows that earlier batches kept of the batch's texts, by state that never expires."""
    own = marked(judged).groupBy("id_text").agg(F.count_if("mapped").alias("n_mapped"), F.count_if(~F.col("mapped")).alias("n_unmapped"))

    def step(rows: DataFrame) -> DataFrame:
        return rows.groupBy("id_text").agg(F.sum("n_mapped").alias("n_mapped"), F.sum("n_unmapped").alias("n_unmapped"), F.max("batch").alias("batch"), F.max_by("n_mapped", "batch").alias("own_mapped"), F.max_by("n_unmapped", "batch").alias("own_unmapped"))

    after = ledger.advance(own, number, step, store, "texts", "counts").where(F.col("batch") == number)
    return after.select("id_text", (F.col("n_mapped") - F.col("own_mapped")).alias("n_mapped"), (F.col("n_unmapped") - F.col("own_unmapped")).alias("n_unmapped"))


def settled(judged: DataFrame, with_ids: DataFrame) -> DataFrame:
    """All judged rows as they end: kept ones with their ids, refused ones as failed."""
    rest = judged.where(~F.col("route").isin("processed", "manual_review"))
    return with_ids.unionByName(rest, allowMissingColumns=True)


def receipts(with_ids: DataFrame, as_of: Column, method: str, account: str, item: str) -> DataFrame:
    """(rid, check_id, payload): one receipt a processed row, numbered by its id."""
    null = F.lit(None).cast("string")
    address = payload.bill_address(null, null, F.col("state"), F.lit(""), F.lit("USA"))
    date = scalars.iso_from_any(F.col("check_date"), as_of)
    body = payload.receipt(F.col("check_id"), F.col("check_number"), date, F.col("amount"), F.col("customer_name"), payload.minimal_note(F.col("memo"), null), address, method, account, item)
    return with_ids.where("route = 'processed'").select("rid", "check_id", body.alias("payload"))


def stored_rows(judged: DataFrame, with_ids: DataFrame) -> DataFrame:
    """The rows of the checks table: processed, manual review with its reason, failed with its error; duplicates store none."""
    kept = with_ids.select("rid", "check_id", "shareable_id", *ID_FIELDS, "customer_name", F.col("confidence").cast("double").alias("ocr_confidence"), F.col("route").alias("status"), F.when(F.col("route") == "manual_review", F.col("review_reason")).alias("error_message"))
    null = F.lit(None)
    kept = kept.where("status <> 'failed'")
    failed = judged.where("route = 'failed'").select(
        "rid",
        F.concat(F.lit("error_"), F.col("rid").cast("string")).alias("check_id"),
        *(null.cast(kept.schema[c].dataType).alias(c) for c in ("shareable_id", *ID_FIELDS, "customer_name", "ocr_confidence")),
        F.lit("failed").alias("status"),
        F.col("error").alias("error_message"),
    )
    return kept.unionByName(failed)


def mappings(with_ids: DataFrame) -> DataFrame:
    """Processed rows with all that a mapping requires."""
    return with_ids.where("route = 'processed'").select(*MAPPING_REQUIRED, "customer_name").dropna(subset=list(MAPPING_REQUIRED))


def log_events(with_ids: DataFrame) -> DataFrame:
    return with_ids.where("route = 'processed'").select("check_id", F.lit("processed").alias("event_type"), F.lit("Successfully processed check").alias("event_data"))


def moves(judged: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(file, folder): a file's mail moves once, by the outcome of all its items."""
    return routing.batch_outcome(judged, settings).select("file", "folder")


def _moves(rows: DataFrame, store: str, number: int, settings: Settings) -> DataFrame:
    """Moves of the batch's mails; where rows tell how many items their mail has, it moves with the last, whichever batch brings that."""
    if "items" not in rows.columns:
        return moves(rows, settings)
    sent = rows if "message_id" in rows.columns else rows.withColumn("message_id", F.lit(None).cast("string"))
    return mails.finished(sent, store, number, settings).select("file", "folder", "message_ids")


#: The tables that a batch writes, all of them or none.
TABLES = ("checks", "receipts", "mappings", "events", "moves", "dead", "logs")


def write(judged: DataFrame, store: str, number: int, as_of: Column, settings: Settings = Settings()) -> None:
    """Stores a batch with the ids that earlier batches leave it, as one commit; a batch that runs again changes nothing."""
    spark, held = judged.sparkSession, f"{store}/held/batch={number}"
    if commits.is_done(spark, store, number):
        return

    def hold(rows: DataFrame, name: str) -> DataFrame:  # what several writes read is worked out once
        rows.write.mode("overwrite").parquet(f"{held}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{held}/{name}")

    judged = hold(needed(judged), "judged")
    known = with_ids(judged, counts_before(judged, store, number), settings.unique_ids)
    rows = hold(settled(judged, known), "settled")
    parts = {
        "checks": stored_rows(rows, rows.where("check_id is not null")),
        "receipts": receipts(rows, as_of, settings.method_ref, settings.account_ref, settings.item_ref),
        "mappings": mappings(rows),
        "events": log_events(rows),
        "moves": _moves(rows, store, number, settings),
        "dead": failures.dead_letters(rows),
        "logs": rows.select("rid", F.col("route").alias("event_type")),
    }
    commits.write(parts, store, number)
    workdir.remove(spark, held)
