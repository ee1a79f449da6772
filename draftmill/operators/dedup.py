"""Duplicate search against history and within a batch, and collision-free identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftmill.functions import ids, validation

KEY = ("routing_number", "account_number", "check_number", "check_date")


def first_of_key(df: DataFrame, order: str = "rid", keys: DataFrame | None = None) -> DataFrame:
    """Adds ``first_rid``: the earliest stored row of the four-part key, where the key is whole and has several rows; else null.

    Failed rows store no key.  Only keys of several rows are joined back, and the
    minimum is combined on the map side: a key that a third of all rows share
    sends a row a task, and the join's small side tells nothing of single rows.
    ``keys`` is df or what it was derived from; it should be a stored relation,
    as it is read for its keys alone.
    """
    keyed = (df if keys is None else keys).where(F.col("error").isNull()).dropna(subset=list(KEY))
    firsts = keyed.groupBy(*KEY).agg(F.min(order).alias("first_rid"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return df.join(firsts, list(KEY), "left")


def mark_duplicates(df: DataFrame, order: str = "rid", keys: DataFrame | None = None) -> DataFrame:
    """Adds ``is_duplicate``: an earlier row has the same key; null keys never match."""
    gate = validation.duplicate_gate(F.col("routing_number"), F.col("check_number"))
    dup = gate & F.col("error").isNull() & F.coalesce(F.col("first_rid") < F.col(order), F.lit(False))
    return first_of_key(df, order, keys).withColumn("is_duplicate", dup)


def duplicates_of(new: DataFrame, history: DataFrame) -> DataFrame:
    """New rows with the newest matching row of history (``match_rid``)."""
    newest = history.dropna(subset=list(KEY)).groupBy(*KEY).agg(F.max(F.struct("received_on", "rid")).alias("m"))
    return new.join(newest, list(KEY)).select(new["rid"], F.col("m.rid").alias("match_rid"), F.col("m.received_on").alias("match_received_on"))


def fresh_against(new: DataFrame, history: DataFrame) -> DataFrame:
    """New rows whose key is neither in history nor on an earlier new row."""
    known = new.join(history.select(*KEY).dropna(), list(KEY), "left_anti")
    return mark_duplicates(known).where(~F.col("is_duplicate")).drop("is_duplicate", "first_rid")


def numbered(df: DataFrame, key: str, order: str, name: str, block: int = 1 << 16) -> DataFrame:
    """Adds each row's place, from 0, among the rows of its key by a whole-number order."""
    return counted_before(df, key, order, {name: F.lit(True)}, block=block)


def counted_before(df: DataFrame, key: str, order: str, counts: dict[str, Column], start: DataFrame | None = None, block: int = 1 << 16) -> DataFrame:
    """Adds how many earlier rows of the same key, by a whole-number order, meet each condition.

    ``start`` has what the counts of a key begin with, a row a key.  Rows are
    counted within blocks of the order, and a block starts after the key's
    earlier blocks, so no task sorts more than a block of a key, however many
    rows share it.
    """
    conditions = {f"_is_{n}": c.cast("long") for n, c in counts.items()}
    df = df.withColumns({"_block": F.floor(F.col(order) / block), **conditions})
    sizes = df.groupBy(key, "_block").agg(*(F.sum(f"_is_{n}").alias(f"_n_{n}") for n in counts))
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(key, "_block", *(F.coalesce(F.sum(f"_n_{n}").over(earlier), F.lit(0)).alias(f"_start_{n}") for n in counts))
    if start is not None:
        begin = start.select(key, *(F.col(n).alias(f"_begin_{n}") for n in counts))
        starts = starts.join(begin, key, "left").select(key, "_block", *((F.col(f"_start_{n}") + F.coalesce(f"_begin_{n}", F.lit(0))).alias(f"_start_{n}") for n in counts))
    within = Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({f"_here_{n}": F.coalesce(F.sum(f"_is_{n}").over(within), F.lit(0)) for n in counts})
    out = df.join(starts, [key, "_block"]).withColumns({n: F.col(f"_start_{n}") + F.col(f"_here_{n}") for n in counts})
    return out.drop("_block", *(f"_{k}_{n}" for n in counts for k in ("is", "start", "here")))


def with_hash_ids(df: DataFrame, order: str = "rid") -> DataFrame:
    """Adds ``check_id``; later rows with an equal input text get |1, |2, ... before hashing."""
    text = ids.hash_input(*(F.col(c) for c in ("routing_number", "account_number", "check_number", "check_date", "amount")))
    df = numbered(df.withColumn("id_text", text), "id_text", order, "occurrence")
    return df.withColumn("check_id", ids.hash_id(F.col("id_text"), F.col("occurrence")))
