"""Near-duplicate texts of the pipeline: five-word shingles, Jaccard similarity of 0.8 or more.

Op4's SimHash with its generalised pigeonhole proposes pairs; it alone cannot
decide: at a similarity of 0.8 two 64-bit fingerprints differ in 9.7 bits on
average, and any pigeonhole over so wide a radius makes candidates of a fixed
share of all pairs.  So MinHash proposes what lies beyond 3 bits, and the exact
similarity of the two sets decides on the pairs of both, in whole numbers.

1. A text is its set of shingle hashes (XXH64); texts of fewer words are one
   shingle.  ``BANDS`` keys of ``ROWS`` least hashes each: two texts of
   similarity s share a key with chance 1 - (1 - s**7)**60; at 0.8 one pair in
   a million is missed.
2. Texts that share keys, or that SimHash links, directly or over others, are a
   cluster; clusters are found by star contraction, without pairs.
3. A cluster's texts are shingled again and dealt into chunks of bounded size,
   of which any two meet in one task; most clusters are one chunk.  The task
   counts what all its sets have in common, and emits a spanning forest of the
   pairs that reach the limit: a group of any size costs links in proportion to
   its rows.  No cluster is capped and no text is dropped.

Sets are never stored.  Tables that only serve the search are dropped at its end.

Edge cases: null text counts as empty; texts without words are equal to each
other; very long texts are taken whole; null ids come last in a group, and of
rows that share the least id the first by hash and locator stays; repeated rows
leave one; other columns come through, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from draftmill.llm.common import drop, free_name, save, text_of, with_row
from draftmill.llm.simhash import components, fingerprints, shingle_hashes
from draftmill.llm.simhash import links as simhash_links

SHINGLE = 5
#: Similarity as a fraction of whole numbers.
PART, OF = 4, 5
BANDS, ROWS = 60, 7
#: Hashes that numpy handles at once.
AT_ONCE = 1 << 16
#: Texts and hashes of a chunk; two chunks meet in a task.
CHUNK_TEXTS, CHUNK_HASHES = 1024, 1 << 19
#: A shingle in more than this many of a task's texts is counted by a matrix product, a rarer one by its pairs.
HEAVY = 32
#: Texts that are shingled again are picked by a broadcast up to this many (some 30 MB); beyond it the join shuffles.
BROADCAST_TEXTS = 200_000


def with_sets(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The ``keep`` columns, ``s``: the sorted distinct shingle hashes, and ``d``: a hash of the set."""
    words, hashes = shingle_hashes(text_of(text), SHINGLE)
    rows = docs.select(*keep, words.alias("_dm_w"))
    rows = rows.select(*keep, F.sort_array(F.array_distinct(F.coalesce(hashes(F.col("_dm_w")), F.array().cast("array<bigint>")))).alias("s"))
    return rows.select(*keep, F.xxhash64("s").alias("d"), "s")


def set_keys(begin: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """BANDS keys for each set; ``begin`` holds where the sets, none of them empty, start in ``flat``, and its end.  AT_ONCE hashes at a time."""
    odd = np.random.default_rng(5).integers(1, 2**63, (BANDS * ROWS, 2), np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full((BANDS * ROWS, len(begin) - 1), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, int(begin[-1]), AT_ONCE):
        stop = min(at + AT_ONCE, int(begin[-1]))
        lo, hi = int(np.searchsorted(begin, at, "right")) - 1, int(np.searchsorted(begin, stop, "left"))
        cuts = np.maximum(begin[lo:hi], at) - at
        x = flat[at:stop] ^ (flat[at:stop] >> np.uint64(32))
        for k, (a, b) in enumerate(odd):
            h = x * a
            h ^= h >> np.uint64(29)
            h *= b
            np.minimum(least[k, lo:hi], np.minimum.reduceat(h, cuts), out=least[k, lo:hi])
    keys = np.empty((len(begin) - 1, BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(begin) - 1, band + 1, np.uint64)
        for row in range(ROWS):
            key = (key ^ least[band * ROWS + row]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
        keys[:, band] = key
    return keys.view(np.int64)


def keyed(sets: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns, d, n and the set's keys (none for an empty set)."""
    schema = StructType([*sets.select(*keep).schema, StructField("d", LongType()), StructField("n", IntegerType()), StructField("keys", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                s = batch.column(len(keep) + 1)
                n = pa.compute.list_value_length(s).to_numpy()
                begin = np.concatenate([[0], np.cumsum(n[n > 0], dtype=np.int64)])
                keys = set_keys(begin, s.flatten().to_numpy().view(np.uint64))
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep) + 1], pa.array(n, pa.int32()), lists], [*keep, "d", "n", "keys"])

    return sets.select(*keep, "d", "s").mapInArrow(run, schema)


def simhash_proposals(docs: DataFrame, row: str, text: str, rows: DataFrame) -> DataFrame:
    """(a, b): sets whose SimHash fingerprints op4 links or finds equal, each by the least set of its fingerprint; ``rows`` has row, d and n."""
    fps = fingerprints(docs.select(row, text), [row], text)
    sets = save(fps.join(rows.where("n > 0").select(row, "d"), row).select("fp", "d").distinct(), "near-simhash")
    least = save(sets.groupBy("fp").agg(F.min("d").alias("lo"), F.count("*").alias("sets")), "near-simhash-distinct")
    equal = sets.join(least.where("sets > 1"), "fp").where("d <> lo").select(F.col("d").alias("a"), F.col("lo").alias("b"))
    near = simhash_links(least.select("fp"))
    left, right = (least.select(F.col("fp").alias(c), F.col("lo").alias(f"_{c}")) for c in ("a", "b"))
    near = near.join(left, "a").join(right, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    out = save(equal.unionByName(near).distinct(), "near-proposals")
    drop(sets, least)
    return out


def clusters(rows: DataFrame, proposed: DataFrame) -> DataFrame:
    """(d, root): the texts that are proposed as pairs or share keys, directly or over others."""
    keys = rows.select(F.explode("keys").alias("key"), "d")
    least = keys.groupBy("key").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo <> hi").select("key", "lo")
    edges = keys.join(least, "key").where("d <> lo").select(F.col("d").alias("a"), F.col("lo").alias("b")).unionByName(proposed)
    edges = save(edges.distinct(), "near-edges")
    found = components(edges).select(F.col("node").alias("d"), "root")
    drop(edges)
    return found.unionByName(found.select(F.col("root").alias("d"), "root").distinct())  # a root is no node of its own


def common_counts(flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many hashes each two of n sets have in common."""
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    df = np.diff(np.append(first, len(flat)))
    # Rare hashes: each with those at every distance in its run, which are in order of their owners.
    out = np.zeros((n, n), np.float32)
    last = np.repeat(first + df, df)
    at = np.flatnonzero(np.repeat(df <= HEAVY, df))
    for distance in range(1, HEAVY):
        at = at[at + distance < last[at]]
        if not len(at):
            break
        np.add.at(out.ravel(), owner[at] * n + owner[at + distance], 1)
    out += out.T
    # Frequent ones: columns of a 0/1 matrix, some at a time.
    heavy = np.flatnonzero(df > HEAVY)
    for k in range(0, len(heavy), 512):
        block = heavy[k : k + 512]
        at = np.concatenate([np.arange(first[h], first[h] + df[h]) for h in block])
        x = np.zeros((n, len(block)), np.float32)
        x[owner[at], np.repeat(np.arange(len(block)), df[block])] = 1
        out += x @ x.T
    return out


def forest(ids: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect the sets whose similarity reaches the limit, at most one fewer than the sets."""
    n = len(ids)
    same = common_counts(flat, np.repeat(np.arange(n), sizes), n)
    # same / union >= PART / OF, with union = |a| + |b| - same.
    near = same * (PART + OF) >= (sizes[:, None] + sizes[None, :]) * PART
    out: list[tuple[int, int]] = []
    rest = np.ones(n, bool)
    for k in range(n):
        if not rest[k]:
            continue
        rest[k] = False
        front = [k]
        while front:
            f = front.pop()
            reached = np.flatnonzero(near[f] & rest)
            rest[reached] = False
            out += [(int(ids[f]), int(ids[x])) for x in reached]
            front += reached.tolist()
    return out


def verified(parts: DataFrame) -> DataFrame:
    """Links (a, b) among the sets of each group; rows (g, d, s) must come with whole groups in a partition, one after another."""

    def links(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, sizes, flat = (np.concatenate(x) for x in zip(*held, strict=True))
        pairs = np.array(forest(ids, sizes, flat), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs.min(1)), pa.array(pairs.max(1))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            g, d = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sizes = pa.compute.list_value_length(batch.column(2)).to_numpy().astype(np.int64)
            flat = batch.column(2).flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(sizes)])
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and g[a] != now:
                    yield links(held)
                    held = []
                now = g[a]
                held.append((d[a:b].copy(), sizes[a:b], flat[ends[a] : ends[b]].copy()))
        if held:
            yield links(held)

    return parts.mapInArrow(run, "a bigint, b bigint")


def links(docs: DataFrame, row: str, text: str, rows: DataFrame) -> DataFrame:
    """Links (a, b) of similar sets that connect all proposed pairs of the limit's similarity; ``rows`` has row, d, n and keys."""
    proposed = simhash_proposals(docs, row, text, rows)
    found = clusters(rows, proposed)
    drop(proposed)
    # One row of each set in a cluster; what a cluster holds tells its chunks.
    members = rows.join(found, "d").groupBy("d").agg(F.first("root").alias("root"), F.first("n").alias("n"), F.min(row).alias(row))
    members = save(members, "near-members")
    sizes = members.groupBy("root").agg(F.count("*").alias("texts"), F.sum("n").alias("hashes"))
    chunks = F.greatest(F.ceil(F.col("texts") / CHUNK_TEXTS), F.ceil(F.col("hashes") / CHUNK_HASHES)).cast("long")
    # A cluster of one chunk needs no row here.
    large = save(sizes.select("root", chunks.alias("chunks")).where("chunks > 1"), "near-large")
    picked = members.join(large, "root", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("long"))).select(row, "root", "chunks")
    if members.count() <= BROADCAST_TEXTS:
        picked = F.broadcast(picked)
    sets = with_sets(docs.select(row, text).join(picked, row), text, ["root", "chunks"]).withColumn("i", F.pmod(F.xxhash64("d"), F.col("chunks")))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda j: (j != F.col("i")) | (F.col("chunks") == 1))
    parts = sets.select("root", "d", "s", "i", F.explode(others).alias("j"))
    parts = parts.select(F.xxhash64("root", F.least("i", "j"), F.greatest("i", "j")).alias("g"), "d", "s").repartition("g").sortWithinPartitions("g")
    out = save(verified(parts).distinct(), "near-links")
    drop(members, large, found)
    return out


def near_groups(docs: DataFrame, row: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document, named by its unique column ``row``: row, id, ``d`` and ``component``, the least d that links reach."""
    keep = free_name(docs, "locator", "id")
    named = docs.select(F.col(row).alias(keep[0]), F.col(id_column).alias(keep[1]), F.col(text).alias("text"))
    rows = save(keyed(with_sets(named, "text", keep), keep), "near-rows")
    found = links(named, keep[0], "text", rows)
    roots = components(found)
    drop(found)
    out = rows.select(F.col(keep[0]).alias("row"), F.col(keep[1]).alias("id"), "d").join(roots.withColumnRenamed("node", "d"), "d", "left")
    return out.withColumn("component", F.coalesce("root", "d")).drop("root")


def dedup_near(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component stays, with all columns of docs: that of the least id; of rows that share it, the first by hash and locator."""
    docs, row = with_row(docs)
    found = near_groups(docs, row, id_column, text)
    best = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "d", "row")).alias("best"))
    stays = best.select(F.col("best.row").alias(row))
    return docs.join(stays, row, "left_semi").drop(row)
