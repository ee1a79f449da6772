"""The record store: lookups, top rows, aggregates, and writes as append plus latest-wins views.

Parquet tables have no updates in place, so writes are append-only logs, and a
view picks what counts for each key with map-side-combined aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The columns that a plain insert lists.
INSERT_COLUMNS = (
    "check_id shareable_id check_number routing_number account_number amount check_date customer_name customer_id email_uid email_from email_subject "
    "email_received_at ocr_confidence status image_path image_filename created_at updated_at metadata"
).split()
MAPPING_REQUIRED = ("check_id", "routing_number", "account_number", "check_number", "amount", "check_date")


def insert_rows(df: DataFrame, now: Column, listed_only: bool = False) -> DataFrame:
    """Stamps new rows and gives them the default status; all supplied columns stay.

    ``listed_only`` gives the columns that a plain insert lists, null where none
    was supplied, and drops all others.
    """
    status = F.coalesce(F.col("status"), F.lit("pending")) if "status" in df.columns else F.lit("pending")
    out = df.withColumns({"status": status, "created_at": now, "updated_at": now})
    return out.select(*(F.col(c) if c in out.columns else F.lit(None).cast("string").alias(c) for c in INSERT_COLUMNS)) if listed_only else out


def update_rows(table: DataFrame, key: str, changes: DataFrame, columns: list[str], now: Column) -> DataFrame:
    """Applies the named columns of changes (one row a key) to the table, and stamps what changed."""
    bad = set(columns) - set(table.columns)
    if bad:
        raise ValueError(f"no such columns: {sorted(bad)}")
    c = changes.select(key, *(F.col(x).alias(f"_new_{x}") for x in columns), F.lit(True).alias("_hit"))
    out = table.join(c, key, "left")
    values = {x: F.when(F.col("_hit"), F.col(f"_new_{x}")).otherwise(F.col(x)) for x in columns}
    values["updated_at"] = F.when(F.col("_hit"), now).otherwise(F.col("updated_at"))
    return out.withColumns(values).select(table.columns)


def insert_or_ignore(new: DataFrame, existing: DataFrame, key: str, required: tuple[str, ...], order: str) -> DataFrame:
    """New rows to append: complete, not in the table yet, the first of each key."""
    fresh = new.dropna(subset=list(required)).join(existing.select(key), key, "left_anti")
    first = fresh.groupBy(key).agg(F.min_by(F.struct(*(c for c in fresh.columns if c != key)), order).alias("r"))
    return first.select(key, "r.*").select(new.columns)


def upsert(log: DataFrame, key: str, at: str, created: str, tie: str) -> DataFrame:
    """The latest row of each key, with the time the key first came."""
    rest = [c for c in log.columns if c != key]
    latest = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("r"), F.min(at).alias(created))
    return latest.select(key, "r.*", created)


def by_key(table: DataFrame, key: str, value: object) -> DataFrame:
    return table.where(F.col(key) == F.lit(value))


def by_status(checks: DataFrame, status: str, limit: int = 100) -> DataFrame:
    """Newest first."""
    return checks.where(F.col("route") == status).orderBy(F.col("received_on").desc(), F.col("rid").desc()).limit(limit)


def log_of(logs: DataFrame, check_id: str) -> DataFrame:
    """Oldest first."""
    return logs.where(F.col("check_id") == check_id).orderBy("timestamp", "id")


def statistics(checks: DataFrame) -> DataFrame:
    """One row: the count, the counts by status, the mean confidence (null of no rows)."""
    by = checks.groupBy("route").agg(F.count("*").alias("n"), F.sum("confidence").alias("s"), F.count("confidence").alias("c"))  # a row a status
    return by.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "route", F.col("n").cast("string")))), ","), F.lit("")).alias("by_status"),
        F.round(F.sum("s") / F.sum("c"), 6).alias("mean_confidence"),
    )


def entity_listing(accounts: DataFrame) -> DataFrame:
    """Active entities by type, then name."""
    return accounts.where("active").orderBy("type", "name", "id")


def grouped_listing(accounts: DataFrame) -> DataFrame:
    """Active entities with the size of their type, by type, then name: rows, as a type may have any number of members."""
    sizes = accounts.where("active").groupBy("type").agg(F.count("*").alias("n"))
    return accounts.where("active").join(sizes, "type").orderBy("type", "name", "id").select("type", "name", "id", "n")


def find_customers(checks: DataFrame, customers: DataFrame) -> DataFrame:
    """Each check with the customer of that display name, the least id where several have it; null where none has."""
    least = customers.groupBy("display_name").agg(F.min("customer_id").alias("customer_id"))
    return checks.join(least, checks["customer_name"] == least["display_name"], "left").drop("display_name")


def customers_to_create(checks: DataFrame, customers: DataFrame) -> DataFrame:
    return checks.select("customer_name").dropna().distinct().join(customers, F.col("customer_name") == F.col("display_name"), "left_anti")


def lookup(ids: DataFrame, mappings: DataFrame) -> DataFrame:
    """An id is a stored one or else a reversible one; found says which."""
    from draftmill.functions.ids import decode

    hit = ids.join(mappings.select("check_id", F.col("check_number").alias("m_number"), F.col("amount").cast("string").alias("m_amount"), F.lit(True).alias("hit")), ids["id"] == F.col("check_id"), "left")
    d = decode(F.col("id"))
    hit = hit.withColumn("d", F.when(F.col("hit").isNull(), d))
    found = F.when(F.col("hit"), "mapping").when(F.col("d.cn").isNotNull() | F.col("d.amt").isNotNull(), "decoded").otherwise("unknown")
    return hit.select("id", found.alias("found"), F.coalesce("m_number", "d.cn").alias("check_number"), F.coalesce("m_amount", "d.amt").alias("amount"))


def trailing_calls(calls: DataFrame, seconds: int, at: str = "ts") -> DataFrame:
    """Calls in the window of so many seconds that ends with each call.

    Calls are counted by second first.  Seconds are dealt into blocks as long
    as the window, which then reaches at most one block back; each block also
    gets the seconds of the one before, so a task holds two windows' seconds,
    however many calls there are.
    """
    by = calls.groupBy(F.col(at).cast("long").alias("_s")).agg(F.count("*").alias("_n"))
    own = by.withColumn("_block", F.floor(F.col("_s") / seconds)).withColumn("_mine", F.lit(True))
    both = own.unionByName(own.withColumn("_block", F.col("_block") + 1).withColumn("_mine", F.lit(False)))
    w = Window.partitionBy("_block").orderBy("_s").rangeBetween(-seconds, Window.currentRow)
    sums = both.withColumn("calls", F.sum("_n").over(w)).where("_mine").select("_s", "calls")
    return calls.join(sums, F.col(at).cast("long") == F.col("_s")).drop("_s")


def calls_in_flight(calls: DataFrame, start: str = "start", end: str = "end", block: int = 3600) -> DataFrame:
    """(minute, most): the most calls under way at once in each minute in which one starts; a call no longer counts in the second it ends.

    Starts and ends are counted by second.  Seconds are summed up within blocks,
    and a block begins with the sum of all earlier ones, of which there is a row
    an hour: no task sorts the calls, and none holds more than a block's seconds.
    """
    begun = calls.where(F.col(start) < F.col(end)).groupBy(F.col(start).cast("long").alias("_s")).agg(F.count("*").alias("_n"), F.count("*").alias("_starts"))
    over = calls.where(F.col(start) < F.col(end)).groupBy(F.col(end).cast("long").alias("_s")).agg((-F.count("*")).alias("_n"), F.lit(0).cast("long").alias("_starts"))
    net = begun.unionByName(over).groupBy("_s").agg(F.sum("_n").alias("_n"), F.sum("_starts").alias("_starts")).withColumn("_block", F.floor(F.col("_s") / block))
    totals = net.groupBy("_block").agg(F.sum("_n").alias("_n"))
    before = totals.select("_block", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_block").orderBy("_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = net.withColumn("_here", F.sum("_n").over(within)).join(before, "_block").where("_starts > 0")
    return at.groupBy(F.floor(F.col("_s") / 60).alias("minute")).agg(F.max(F.col("_before") + F.col("_here")).alias("most"))


#: The running state of statistics: a status, how many rows have it, and the sum and number of their confidences.
KEPT = ("status", "n", "s", "c")


def changed_statistics(before: DataFrame, after: DataFrame, key: str = "check_id", status: str = "status", confidence: str = "confidence") -> DataFrame:
    """What a batch changes in the statistics: rows of (status, n, s, c) to add, one a status.

    ``after`` has the rows as the batch leaves them, ``before`` the same keys as
    they were: what they counted for is taken back.  Confidences are summed as
    whole numbers or decimals, so nothing is lost when they are taken back.
    """

    def counted(rows: DataFrame, sign: int) -> DataFrame:
        return rows.groupBy(F.col(status).alias("status")).agg((F.lit(sign) * F.count("*")).alias("n"), (F.lit(sign) * F.coalesce(F.sum(F.col(confidence).cast("decimal(20,6)")), F.lit(0))).alias("s"), (F.lit(sign) * F.count(confidence)).alias("c"))

    changed = before.join(after.select(key), key, "left_semi")
    return kept_statistics(counted(after, 1).unionByName(counted(changed, -1)))


def kept_statistics(*parts: DataFrame) -> DataFrame:
    """The sum of statistics and changes, one row a status that rows still have or lose."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("status").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(30,6)").alias("s"), F.sum("c").alias("c"))


def shown_statistics(kept: DataFrame) -> DataFrame:
    """One row as ``statistics`` gives it, from a row a status."""
    by = kept.where("n > 0")
    return by.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "status", F.col("n").cast("string")))), ","), F.lit("")).alias("by_status"),
        F.round((F.sum("s") / F.sum("c")).cast("double"), 6).alias("mean_confidence"),
    )
