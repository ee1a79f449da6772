"""Operator 4: near-duplicates by SimHash, linked by the generalised pigeonhole principle.

Fingerprints come from DataFrame functions: words, shingles, XXH64 of each, and
for each bit a count over the shingles.  Two 32-bit counters share a long, so
32 sums count 64 bits, and they combine before the shuffle.

Equal fingerprints meet first; only distinct ones are compared.  Two of them
within 3 bits, with the 64 bits dealt into m partitions and thresholds that sum
to 3 - m + 1, differ by at most its threshold in some partition.  So:

* correlated bits share a partition, by their co-occurrence over all distinct
  fingerprints (summed on the executors; one 64 x 64 matrix reaches the driver);
* a dynamic program allots unequal thresholds (-1 skips a partition), for each
  m, to the least estimated cost of candidates and probes.  Candidates are
  estimated from the pairs of ``SAMPLE`` fingerprints, those of least hash, and
  from the bits' shares where the sample has no such pair; the estimate decides
  what the plan costs, never what is found;
* every fingerprint probes one key for a threshold of 0, or one for each set of
  masked bits above; fingerprints that share a key meet and are verified.

A bucket of up to ``BUCKET`` fingerprints is verified by numpy, which emits a
spanning forest of its links rather than all pairs.  A larger bucket is parted
once more on the bits its key leaves open (the same principle, one level down)
if that leaves less than half of its pairs.  In a dense one, of near copies of
one text, it does not: parting would multiply its rows and keep its pairs.  Such
a bucket is dealt into chunks of ``CHUNK`` fingerprints, any two of which meet
in a task of bounded size.  No bucket is capped and no row is dropped.

Components are found by alternating star contraction on the links, which stays
on the executors; every round is a stored table.

Edge cases: null text counts as empty; texts without words have fingerprint 0;
a very long text is summed shingle by shingle like others; equal and repeated
rows share a fingerprint; of a component's rows with the least id, ties go to
the least fingerprint and then the locator; null ids never name a component
unless it has no other; columns to keep may have any names but those that the
result adds; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftmill.llm.common import drop, save, text_of, with_row

BITS = 64
RADIUS = 3
SHINGLE = 3
#: Fingerprints that one bucket may hold before it is parted again.
BUCKET = 4096
#: Fingerprints of a chunk; two chunks are verified in one task.
CHUNK = 1 << 16
#: A bucket is parted again if that leaves at most this share of its pairs.
PAYS = 0.5
#: Fingerprints whose pairs estimate the candidates.
SAMPLE = 2048
#: Relative cost of a probe (a row written, shuffled and sorted) and of a candidate (an XOR and a popcount).
PROBE_COST, CANDIDATE_COST = 1.0, 0.02
#: Large buckets are broadcast up to this many (1 MB); beyond it only those with over a thousandth of all rows.
BROADCAST_KEYS = 25_000


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: Column, k: int = SHINGLE) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return words, lambda w: F.when(
        F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0))), lambda i: F.xxhash64(F.concat_ws(" ", *(F.get(w, i + j) for j in range(k)))))
    ).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " "))))


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """One row a document: the ``keep`` columns and ``fp``, a 64-bit fingerprint."""
    words, hashes = shingle_hashes(text_of(text))
    rows = docs.select(*keep, F.monotonically_increasing_id().alias("_dm_rid"), words.alias("_dm_w"))
    rows = rows.select(*keep, "_dm_rid", F.explode_outer(hashes(F.col("_dm_w"))).alias("_dm_h"))
    lanes = F.lit(0x0000000100000001)
    sums = [F.sum(F.shiftrightunsigned("_dm_h", k).bitwiseAND(lanes)).alias(f"_dm_s{k}") for k in range(32)]
    # A document's shingles are in one task, in sequence: the partial sums leave one row a document.
    by = rows.groupBy("_dm_rid", *keep).agg(F.count("_dm_h").alias("_dm_n"), *sums)
    low, high = [], []
    for k in range(32):
        count = F.coalesce(F.col(f"_dm_s{k}"), F.lit(0))
        low.append(F.when(count.bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.col("_dm_n"), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
        high.append(F.when(F.shiftrightunsigned(count, 32) * 2 > F.col("_dm_n"), F.lit(1 << (k + 32) if k < 31 else -(1 << 63))).otherwise(F.lit(0)).cast("long"))
    return by.select(*keep, reduce(Column.bitwiseOR, low + high).alias("fp"))


# ------------------------------------------------------------------- the plan


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and how often bits i and j are set together, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            for k in range(0, batch.num_rows, 8192):
                x = bits_of(batch.column(0)[k : k + 8192].to_numpy()).astype(np.float32)
                both += x.T @ x
                n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS, dtype=np.int32)), pa.array(both.astype(np.int64).ravel()), pa.array(np.full(BITS * BITS, n, np.int64))], ["at", "both", "n"])

    rows = fps.select("fp").mapInArrow(run, "at int, both bigint, n bigint").groupBy("at").agg(F.sum("both").alias("both"), F.sum("n").alias("n")).collect()  # 4,096 rows
    both = np.zeros(BITS * BITS)
    for r in rows:
        both[r["at"]] = r["both"]
    return (rows[0]["n"] if rows else 0), both.reshape(BITS, BITS)


def bits_of(fp: np.ndarray) -> np.ndarray:
    """A row of 64 bits for each fingerprint, the lowest first."""
    return np.unpackbits(np.ascontiguousarray(fp, "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of nearly equal width; each grows from a free bit by the bits most correlated with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    free, parts = list(range(BITS)), []
    for k in range(m):
        width = BITS // m + (k < BITS % m)
        part = [free.pop(0)]
        while len(part) < width:
            best = max(free, key=lambda j: (corr[j, part].sum(), -j))
            free.remove(best)
            part.append(best)
        parts.append(sorted(part))
    return parts


def within(disagree: np.ndarray, most: int) -> float:
    """The chance that at most ``most`` of independent bits disagree."""
    dist = np.zeros(most + 1)
    dist[0] = 1
    for q in disagree:
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    return float(dist.sum())


def pair_differences(sample: np.ndarray) -> np.ndarray:
    """The differing bits of all pairs of the sample's fingerprints."""
    i, j = np.triu_indices(len(sample), 1)
    x = sample.view(np.uint64)
    return x[i] ^ x[j]


def allot(n: int, both: np.ndarray, differ: np.ndarray | None = None, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """Partitions of bits with their thresholds, at the least estimated cost over all numbers of partitions."""
    n = max(n, 1)  # without fingerprints all schemes would cost nothing, and the first one has 41,664 keys
    p = np.diag(both) / n
    disagree = 2 * p * (1 - p)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in range(1, radius + 2):
        parts, total = group_bits(n, both, m), radius - m + 1

        def cost(part: list[int], t: int, apart: np.ndarray) -> float:
            if t < 0:
                return 0.0
            keys = comb(len(part), t)
            met = max(within(disagree[part], t), float((apart <= t).mean()) if len(apart) else 0.0)
            # Partners that agree on a key, for each of its masks, and the probes.
            return PROBE_COST * n * keys + CANDIDATE_COST * n * n / 2 * met * max(1, keys / 2)

        # f[s]: the least cost of the partitions so far with thresholds that sum to s - m.
        f: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for part in parts:
            mask = np.uint64(sum(1 << b for b in part))
            apart = np.bitwise_count(differ & mask) if differ is not None else np.zeros(0)
            g: dict[int, tuple[float, list[int]]] = {}
            costs = {t: cost(part, t, apart) for t in range(-1, radius + 1)}
            for s, (c, chosen) in f.items():
                for t in range(-1, radius + 1):
                    new = c + costs[t]
                    if s + t not in g or new < g[s + t][0]:
                        g[s + t] = (new, [*chosen, t])
            f = g
        c, chosen = f[total]
        if best is None or c < best[0]:
            best = (c, [(part, t) for part, t in zip(parts, chosen, strict=True) if t >= 0])
    return best[1]


# ----------------------------------------------------------- probe and verify


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def probes(fps: DataFrame, scheme: list[tuple[list[int], int]]) -> DataFrame:
    """(tag, key, fp, mask): a row for each key a fingerprint probes; fingerprints with the same tag and key agree on the mask's bits."""
    masks = []
    for part, t in scheme:
        for hidden in combinations(part, t):
            masks.append(signed(sum(1 << b for b in part if b not in hidden)))
    table = F.array(*(F.lit(m).cast("long") for m in masks))
    return fps.select("fp", F.posexplode(table).alias("tag", "mask")).select(F.col("tag").cast("long").alias("tag"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "mask")


def forest(fp: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is linked within one bucket, at most one fewer than its fingerprints."""
    out: list[tuple[int, int]] = []
    rest = np.arange(1, len(fp))
    front = np.array([0])
    while len(rest):
        if not len(front):
            front, rest = rest[:1], rest[1:]
            continue
        reached = []
        for f in front:
            near = np.bitwise_count(fp[rest] ^ fp[f]) <= RADIUS
            if near.any():
                reached.append(rest[near])
                out += [(int(fp[f]), int(x)) for x in fp[rest[near]]]
                rest = rest[~near]
                if not len(rest):
                    break
        front = np.concatenate(reached) if reached else np.array([], np.int64)
    return out


def verify(rows: DataFrame) -> DataFrame:
    """Links among fingerprints that share a tag and key; rows must come with whole buckets in a partition, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # of the bucket that may go on in the next batch

        def links(x: np.ndarray) -> pa.RecordBatch:
            tag, key, fp = x
            fp = fp.view(np.uint64)
            new = np.flatnonzero((tag[1:] != tag[:-1]) | (key[1:] != key[:-1])) + 1
            begin, end = np.concatenate([[0], new]), np.concatenate([new, [len(tag)]])
            size = end - begin
            pairs: list[tuple[int, int]] = []
            # Small buckets all at once: compare each row with those at distance d in its bucket.
            last = np.repeat(end, size)
            small = np.repeat(size <= 16, size)
            for d in range(1, 16):
                i = np.flatnonzero(small & (np.arange(len(fp)) + d < last))
                if not len(i):
                    break
                i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= RADIUS]
                pairs += zip(fp[i].tolist(), fp[i + d].tolist(), strict=True)
            for k in np.flatnonzero(size > 16):
                pairs += forest(fp[begin[k] : end[k]])
            both = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both.min(1)), pa.array(both.max(1))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([batch.column(k).to_numpy() for k in range(3)])
            tag, key = x[0], x[1]
            if held and (held[0][0, 0], held[0][1, 0]) != (tag[0], key[0]):
                yield links(np.concatenate(held, axis=1))
                held = []
            cut = np.flatnonzero((tag != tag[-1]) | (key != key[-1]))
            at = cut[-1] + 1 if len(cut) else 0
            if at:
                yield links(np.concatenate([*held, x[:, :at]], axis=1))
                held = []
            held.append(x[:, at:])
        if held:
            yield links(np.concatenate(held, axis=1))

    return rows.select("tag", "key", "fp").mapInArrow(run, "a bigint, b bigint")


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) among distinct fingerprints; they connect exactly what is within reach of 3 bits."""
    n, both = bit_statistics(fps)
    sample = np.array([r["fp"] for r in fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64)
    scheme = allot(n, both, pair_differences(sample))
    rows = probes(fps, scheme)
    found, hot = [], n * sum(comb(len(part), t) for part, t in scheme) / 1000
    while True:
        sizes = rows.groupBy("tag", "key").agg(F.count("*").alias("size"), F.first("mask").alias("mask"))
        large = save(sizes.where(F.col("size") > BUCKET), "simhash-large")
        some = large.count()
        if not some:
            found.append(verify(_whole(rows)))
            return save(reduce(DataFrame.unionByName, found).distinct(), "simhash-links")
        plan = save(parting(_meet(rows, large.select("tag", "key", "size"), some, hot)), "simhash-parting")
        small = _meet(rows, large.select("tag", "key", "size"), some, hot, "left_anti")
        parted = _meet(rows, plan, some, hot)
        chunked = parted.where("chunks > 0").withColumn("i", F.pmod(F.xxhash64("fp"), F.col("chunks")))
        others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda j: (j != F.col("i")) | (F.col("chunks") == 1))
        chunked = chunked.select("tag", "key", "fp", "i", F.explode(others).alias("j"))
        chunked = chunked.select("tag", F.xxhash64("tag", "key", F.least("i", "j"), F.greatest("i", "j")).alias("key"), "fp")
        found += [verify(_whole(small)), verify(_whole(chunked))]
        narrowed = parted.where("chunks = 0").select("tag", "key", "fp", F.posexplode("masks").alias("k", "mask"))
        rows = save(narrowed.select(F.xxhash64("tag", "key", "k").alias("tag"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "mask"), "simhash-narrow")


def _whole(rows: DataFrame) -> DataFrame:
    """Whole buckets in a partition, one after another."""
    return rows.select("tag", "key", "fp").repartition("tag", "key").sortWithinPartitions("tag", "key")


def _meet(rows: DataFrame, buckets: DataFrame, some: int, hot: float, how: str = "inner") -> DataFrame:
    """Joins rows to the table of large buckets without sending a hot bucket's rows to one task.

    Few buckets are broadcast.  Of many, at most some thousand hold over a
    thousandth of all rows, and these are broadcast; the rest is shuffled.
    """
    on, table = ["tag", "key"], buckets if how == "inner" else buckets.select("tag", "key")
    if some <= BROADCAST_KEYS:
        return rows.join(F.broadcast(table), on, how)
    heavy, light = buckets.where(F.col("size") > hot), buckets.where(F.col("size") <= hot)
    if how == "left_anti":
        return rows.join(F.broadcast(heavy.select(*on)), on, how).join(light.select(*on), on, how)
    rest = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(heavy), on).unionByName(rest.join(light, on))


def parting(rows: DataFrame) -> DataFrame:
    """(tag, key, size, chunks, masks): how each large bucket is verified.

    Its open bits are dealt into RADIUS + 1 blocks, one of which two linked
    fingerprints share; they alternate, most balanced first, so that every block
    tells the bucket's fingerprints apart.  If that leaves few enough pairs, the
    four masks come with 0 chunks, else the number of chunks.
    """
    lanes = F.lit(0x0000000100000001)
    ones = [F.sum(F.shiftrightunsigned("fp", k).bitwiseAND(lanes)).alias(f"s{k}") for k in range(32)]
    stats = rows.groupBy("tag", "key").agg(F.first("mask").alias("mask"), F.first("size").alias("size"), *ones)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tag, key, mask, size, *sums = (c.to_numpy() for c in batch.columns)
            low = np.stack([x & 0xFFFFFFFF for x in sums], 1)
            high = np.stack([x >> 32 for x in sums], 1)
            share = np.concatenate([low, high], 1) / size[:, None]
            chunks, masks = [], []
            for m, n, p in zip(mask, size, share, strict=True):
                c, more = split_bucket(int(m), int(n), p)
                chunks.append(c)
                masks.append(more)
            yield pa.RecordBatch.from_arrays([pa.array(tag), pa.array(key), pa.array(size), pa.array(chunks, pa.int64()), pa.array(masks, pa.list_(pa.int64()))], ["tag", "key", "size", "chunks", "masks"])

    return stats.mapInArrow(run, "tag bigint, key bigint, size bigint, chunks bigint, masks array<bigint>")


def split_bucket(mask: int, size: int, share: np.ndarray) -> tuple[int, list[int]]:
    """(0, the masks of four blocks) or (number of chunks, none), by the share of fingerprints that have each bit."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    free.sort(key=lambda b: (abs(share[b] - 0.5), b))
    blocks = [free[k :: RADIUS + 1] for k in range(RADIUS + 1)]
    left = sum(float(np.prod([1 - 2 * share[b] * (1 - share[b]) for b in block])) for block in blocks)
    if left <= PAYS and all(blocks):
        return 0, [signed((mask % (1 << BITS)) | sum(1 << b for b in block)) for block in blocks]
    return -(-size // CHUNK), []


# ------------------------------------------------------------------ components


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links but the roots, by alternating large-star and small-star contraction."""
    edges = edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct()
    before = stored = None
    while True:
        # Large star: larger neighbours join the least neighbour.
        sym = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = sym.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours join the least of them.
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        near = edges.join(least, "u")
        edges = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges, old = save(edges, "simhash-star"), stored
        if old is not None:
            drop(old)
        stored = edges
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if before == (now["n"], now["s"]):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = (now["n"], now["s"])


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row a document: its id, the columns to ``keep``, ``fp``, ``component`` (a fingerprint of it) and ``component_id``, the least id reachable by links."""
    keep = [id_column, *(c for c in keep or [] if c.lower() not in ("fp", "component", "component_id"))]
    rows = save(fingerprints(docs.select(*keep, text), keep, text), "simhash-fp")
    least = save(rows.groupBy("fp").agg(F.min(id_column).alias("m")), "simhash-distinct")
    roots = components(links(least.select("fp")))
    named = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("root", "fp"))
    comp = named.groupBy("component").agg(F.min("m").alias("component_id"))
    named = named.join(comp, "component").select("fp", "component", "component_id")
    return rows.join(named, "fp").select(*keep, "fp", "component", "component_id")


def dedup_near(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component stays, with all columns of docs: that of the least id; of rows that share it, the first by fingerprint and locator."""
    docs, row = with_row(docs)
    found = near_duplicates(docs, id_column, text, keep=[row])
    best = found.groupBy("component").agg(F.min(F.struct(F.col(id_column).isNull().alias("z"), F.col(id_column).alias("id"), F.col("fp").alias("fp"), F.col(row).alias("row"))).alias("best"))
    stays = best.select(F.col("best.row").alias(row))
    return docs.join(stays, row, "left_semi").drop(row)
