"""Operator 1: shards by extendible hashing.

The directory is indexed by the leading bits of a key's hash.  A bucket whose
rows exceed the byte limit splits on one more bit; the others stay.  Because a
bucket's content depends only on its prefix, the final directory follows from
the byte totals of all prefixes, and Spark finds it without inserting row by
row: one map-side-combined histogram over 16 bits gives the totals of the 17
upper levels.  Only prefixes that are still too large go on to the next 16
bits, with only their own rows.

Edge cases: a null key hashes as the empty string; a null size counts as 0; an
empty table gives an empty result; a row larger than the limit gets a shard of
its own.  Rows that share a key share all hash bits, so a key that is itself
over the limit cannot be split by them: its rows go to overflow pages
(``prefix/pK.J``), each within the limit.  All input columns are kept, but
those by the names of the added ones, which the caller can choose, are
replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftmill.llm.common import free_name, save

#: Bits of one round.  A round's first histogram has at most 2**16 rows, so its directory is safe to broadcast.
ROUND_BITS = 16
ROUNDS = 3


def _bits(hex4: Column) -> Column:
    return F.lpad(F.conv(hex4, 16, 2), ROUND_BITS, "0")


def extendible_shards(
    df: DataFrame,
    key: Column,
    size: Column,
    limit_bytes: int,
    shard: str = "shard",
    depth: str = "depth",
    shard_bytes: str = "shard_bytes",
    shard_rows: str = "shard_rows",
    rounds: int = ROUNDS,
) -> DataFrame:
    """df with the shard of each row: its hash prefix, depth in bits, and the shard's bytes and rows."""
    if not 1 <= rounds <= 8:
        raise ValueError("rounds must be 1 to 8")
    h, n, parent = free_name(df, "hash", "size", "parent")
    added = (shard, depth, shard_bytes, shard_rows)
    columns = [c for c in df.columns if c.lower() not in {a.lower() for a in added}]
    rows = df.select(
        *(df[c] for c in columns),
        F.md5(F.coalesce(key.cast("string"), F.lit(""))).alias(h),
        F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias(n),
        F.lit("").alias(parent),
    )
    done: list[DataFrame] = []
    for k in range(rounds):
        chunk = F.substring(h, 4 * k + 1, 4)
        leaves = save(_leaves(rows, parent, chunk, n, limit_bytes, added), f"directory{k}")
        if k == 0:  # at most 65,536 rows of under 100 bytes
            leaves = F.broadcast(leaves)
        on = leaves.withColumnsRenamed({"parent": f"{parent}p", "chunk": f"{parent}c"})
        placed = rows.join(on, (rows[parent] == on[f"{parent}p"]) & (chunk == on[f"{parent}c"]), "left").drop(f"{parent}p", f"{parent}c")
        done.append(placed.where(F.col(shard).isNotNull()))
        rows = placed.where(F.col(shard).isNull()).drop(*added).withColumn(parent, F.concat(parent, _bits(chunk)))
        if rows.limit(1).count() == 0:
            break
    else:
        done.append(_overflow(rows, parent, n, limit_bytes, added))
    return reduce(DataFrame.unionByName, (d.select(*columns, *added) for d in done))


def _leaves(rows: DataFrame, parent: str, chunk: Column, n: str, limit: int, added: tuple[str, ...]) -> DataFrame:
    """For each 16-bit value in use, the shallowest prefix that fits; values that fit at no depth are left out."""
    totals = rows.groupBy(F.col(parent).alias("parent"), chunk.alias("chunk")).agg(F.sum(n).alias("bytes"), F.count("*").alias("rows"))
    levels = totals.select("*", F.explode(F.sequence(F.lit(0), F.lit(ROUND_BITS))).alias("d")).withColumn("prefix", F.substring(_bits(F.col("chunk")), F.lit(1), F.col("d")))
    nodes = levels.groupBy("parent", "d", "prefix").agg(F.sum("bytes").alias("b"), F.sum("rows").alias("r")).where((F.col("b") <= limit) | (F.col("r") == 1))
    best = levels.join(nodes, ["parent", "d", "prefix"]).groupBy("parent", "chunk").agg(F.min(F.struct("d", "prefix", "b", "r")).alias("leaf"))
    shard, depth, shard_bytes, shard_rows = added
    return best.select(
        "parent",
        "chunk",
        F.concat("parent", "leaf.prefix").alias(shard),
        (F.length("parent") + F.col("leaf.d")).cast("int").alias(depth),
        F.col("leaf.b").alias(shard_bytes),
        F.col("leaf.r").alias(shard_rows),
    )


def _overflow(rows: DataFrame, parent: str, n: str, limit: int, added: tuple[str, ...]) -> DataFrame:
    """Pages for prefixes that no bit splits.

    Rows are dealt over as many salts as the prefix holds 16-fold limits, so a
    window never sorts more than about that; within a salt, a row's page is
    that of its running start.  Dividing by the limit less the largest row
    keeps every page within the limit.
    """
    shard, depth, shard_bytes, shard_rows = added
    rid, salt, start, page, most, all_ = free_name(rows, "rid", "salt", "start", "page", "most", "all")
    rows = save(rows.withColumn(rid, F.monotonically_increasing_id()), "overflow")
    stats = rows.groupBy(parent).agg(F.max(F.when(F.col(n) <= limit, F.col(n))).alias(most), F.sum(n).alias(all_))
    rows = rows.join(stats, parent).withColumn(salt, F.pmod(F.xxhash64(rid), F.greatest(F.lit(1), F.ceil(F.col(all_) / F.lit(16 * limit)))))
    big = F.col(n) > limit
    w = Window.partitionBy(parent, salt, big).orderBy(rid).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(start, F.coalesce(F.sum(n).over(w), F.lit(0)))
    step = F.greatest(F.lit(1), F.lit(limit) - F.coalesce(F.col(most), F.lit(0)))
    rows = rows.withColumn(page, F.when(big, F.concat(F.lit("r"), F.col(rid))).otherwise(F.concat(F.lit("p"), F.col(salt), F.lit("."), F.floor(F.col(start) / step))))
    rows = rows.withColumn(shard, F.concat(parent, F.lit("/"), page)).withColumn(depth, F.length(parent))
    totals = rows.groupBy(shard).agg(F.sum(n).alias(shard_bytes), F.count("*").alias(shard_rows))
    return rows.join(totals, shard)


def write_shards(sharded: DataFrame, path: str, shard: str = "shard") -> None:
    """One folder a shard; a shard is within the byte limit, so one task holds it."""
    sharded.repartition(F.col(shard)).write.partitionBy(shard).parquet(path)
