"""The pending queue of each mail: what its items came to, and the notifications sent about them, until the last item is done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftmill.operators import routing
from draftmill.plans.settings import Settings
from draftmill.streaming import ledger


def finished(items: DataFrame, store: str, number: int, settings: Settings = Settings()) -> DataFrame:
    """Mails whose last item is in this batch, each once: its items by outcome, its folder, and the ids of its notifications by item.

    ``items`` has a row an item: the mail's ``file``, the item's ``rid``, how
    many ``items`` the mail has, its ``route`` and the ``message_id`` of the
    notification, if one was sent.  A mail without a file is no mail.  Items of
    mails that lack some wait in a table that each poll carries on, grouped by
    mail; they go with the last item.  A batch that runs again gives the same
    mails.
    """
    rows = items.where(F.col("file").isNotNull()).select(F.col("file").cast("long"), F.col("rid").cast("long"), F.col("items").cast("long"), F.coalesce(F.col("route") == "failed", F.lit(False)).alias("bad"), F.col("message_id").cast("string"))

    def step(rows: DataFrame) -> DataFrame:
        one = F.struct("rid", "message_id", "bad")
        queue = rows.select("file", "items", "new", one.alias("one")) if "queue" not in rows.columns else rows.select("file", "items", "new", F.explode(F.coalesce("queue", F.array(one))).alias("one"))
        mails = queue.groupBy("file").agg(F.max("items").alias("most"), F.sort_array(F.collect_list("one")).alias("queue"), F.count("*").alias("items"), F.count_if("one.bad").alias("failed"))
        ids = F.filter(F.col("queue.message_id"), lambda m: m.isNotNull())
        waits = ~F.coalesce(F.col("items") >= F.col("most"), F.lit(False))  # a mail without an item in this batch waits on
        return mails.select("file", "items", (F.col("items") - F.col("failed")).alias("succeeded"), "failed", F.when(~waits, ids).alias("message_ids"), F.when(waits, F.col("queue")).alias("queue"), waits.alias("stays"))

    return ledger.carry(rows, number, step, ["file", "queue"], store, "mails").drop("queue").withColumn("folder", routing.folder(settings))
