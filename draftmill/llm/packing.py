"""Operator 9: packing token sequences by non-negative least squares.

A document's full windows of ``window`` ids stand alone; what is left of each
document has one of ``window - 1`` lengths.  The histogram of these lengths is
all that the plan needs, so the plan's size does not depend on the corpus:

1. enumerate shallow combinations (pairs and triples) of lengths that fill a
   window exactly;
2. solve for non-negative repeat counts by least squares against the histogram;
3. round down, and keep each length's use within its supply;
4. pack the residual pieces greedily one after another, cutting at window
   ends; the last, partial window is cut into power-of-two sequences, which
   need no padding.

Only step 2 runs on the driver, over at most ``window`` counts.  Documents find
their place by a rank among those of their length: the rank within a stored
partition, found while tokenizing, plus the counts of the partitions before it.
No window function ever sorts a length's documents, so a length that a third of
all documents share is as good as any.

Edge cases: null and empty texts hold the end id alone; repeated rows are
packed like others; an empty table gives no pieces; a document of any length is
cut into windows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from draftmill.llm.common import save

WINDOW = 1024
#: The id that ends a document.
END_ID = 0
#: Residual pieces are broadcast to the stored ids up to this many rows (some 20 MB); beyond it the join shuffles.
BROADCAST_RESIDUAL = 200_000

Encoder = Callable[[list[str]], list[list[int]]]


def byte_bpe_encoder(ranks_path: str, json_path: str, pattern: str) -> Callable[[], Encoder]:
    """An encoder of the library's ids; texts that hold a special token's string go through the library itself."""

    def make() -> Encoder:
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        library = Tokenizer.from_file(json_path)
        library.no_truncation()
        library.no_padding()
        special = [t.content for t in library.get_added_tokens_decoder().values()]

        def encode(texts: list[str]) -> list[list[int]]:
            return [library.encode(t, add_special_tokens=False).ids if any(s in t for s in special) else fast.encode_ordinary(t) for t in texts]

        return encode

    return make


def tokenize(df: DataFrame, encoder: Callable[[], Encoder], id_column: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: ``n`` ids with the end id, its rank data, CRCs of its full windows and of its rest, and the rest's ids."""
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        part = TaskContext.get().partitionId()
        seen = np.zeros(window, np.int64)
        windows = row = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                piece = batch.slice(start, 512)
                out: dict[str, list] = {k: [] for k in ("row", "n", "rest", "rank", "first", "crcs", "rest_crc", "rest_ids")}
                for ids in encode([t or "" for t in piece.column(1).to_pylist()]):
                    raw = np.array([*ids, END_ID], "<u4").tobytes()
                    n = len(ids) + 1
                    full, rest = divmod(n, window)
                    tail = raw[4 * full * window :]
                    values = ((part << 33) + row, n, rest, int(seen[rest]), windows, [zlib.crc32(raw[4 * k * window : 4 * (k + 1) * window]) for k in range(full)], zlib.crc32(tail), tail)
                    for column, value in zip(out.values(), values, strict=True):
                        column.append(value)
                    seen[rest] += 1
                    windows += full
                    row += 1
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([part] * piece.num_rows, pa.int32()), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], ["id", "part", *out])

    return df.select(id_column, text).mapInArrow(run, f"id {kind}, part int, row bigint, n bigint, rest int, rank bigint, first bigint, crcs array<bigint>, rest_crc bigint, rest_ids binary")


def combinations(hist: dict[int, int], window: int = WINDOW, spread: int = 6) -> list[tuple[int, ...]]:
    """Pairs and triples of the lengths in use that fill a window; for each longest part at most ``spread`` triples, evenly spaced."""
    used = sorted(length for length, n in hist.items() if 0 < length < window and n)
    have = set(used)
    out = [(window - b, b) for b in used if window - b in have and window - b >= b]
    for a in used:
        fits = [(a, window - a - c, c) for c in used if a >= window - a - c >= c and window - a - c in have]
        step = max(1, len(fits) // spread)
        out += fits[::step]
    return out


def solve(hist: dict[int, int], combos: list[tuple[int, ...]], sweeps: int = 40) -> np.ndarray:
    """Repeat counts x >= 0 that bring sum_j x_j combo_j close to the histogram, by coordinate descent on the squared error."""
    left = {length: float(n) for length, n in hist.items()}
    x = [0.0] * len(combos)
    weights = [{length: combo.count(length) for length in combo} for combo in combos]
    norms = [sum(v * v for v in w.values()) for w in weights]
    total = sum(left.values()) or 1.0
    for _ in range(sweeps):
        moved = 0.0
        for j, w in enumerate(weights):
            step = max(-x[j], sum(left[length] * v for length, v in w.items()) / norms[j])
            if step:
                x[j] += step
                moved += abs(step)
                for length, v in w.items():
                    left[length] -= step * v
        if moved < 1e-6 * total:
            break
    return np.array(x)


def plan(hist: dict[int, int], window: int = WINDOW) -> tuple[list[tuple[int, int, int, int, int]], dict[int, int], int]:
    """(length, first rank, end rank, first sequence, offset) of each planned slot; ranks used by length; planned sequences."""
    combos = combinations(hist, window)
    x = solve(hist, combos)
    used = dict.fromkeys(hist, 0)
    slots, sequences = [], 0
    for j in sorted(range(len(combos)), key=lambda j: (-x[j], combos[j])):
        combo = combos[j]
        count = min([int(x[j] + 1e-9), *((hist[length] - used[length]) // combo.count(length) for length in combo)])
        if count < 1:
            continue
        offset = 0
        for length in combo:
            slots.append((length, used[length], used[length] + count, sequences, offset))
            used[length] += count
            offset += length
        sequences += count
    return slots, used, sequences


def pack(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces of the stored table that ``tokenize`` made: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = tokens.sparkSession
    counts = save(tokens.groupBy("part", "rest").agg(F.count("*").alias("c")), "packing-counts")
    hist = {r["rest"]: r["n"] for r in counts.where("rest > 0").groupBy("rest").agg(F.sum("c").alias("n")).collect()}  # under `window` rows
    slots, used, sequences = plan(hist, window)

    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.where("rest > 0").select("part", "rest", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("shift"))
    rests = tokens.where("rest > 0").select("id", "part", "row", "n", "rest", "rank", "rest_crc").join(offsets, ["part", "rest"])
    rests = rests.select("id", "row", "n", "rest", "rest_crc", (F.col("rank") + F.col("shift")).alias("rank"), (F.col("n") - F.col("rest")).alias("start"))

    slot_table = F.broadcast(spark.createDataFrame(slots, "rest int, lo bigint, hi bigint, seq bigint, offset bigint"))  # at most a few slots a combination
    s = slot_table.withColumnRenamed("rest", "rest_s")
    placed = rests.join(s, (F.col("rest") == F.col("rest_s")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    planned = placed.select("id", "start", F.col("rest").cast("long").alias("length"), F.col("rest_crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), (F.col("seq") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")

    # Residual pieces lie end to end, by length and rank; a piece's place follows from its length's first place.
    bases, at = [], 0
    for length in sorted(hist, reverse=True):
        bases.append((length, used[length], at))
        at += (hist[length] - used[length]) * length
    windows, tail = divmod(at, window)
    cuts = [windows * window]
    for bit in range(window.bit_length() - 1, -1, -1):
        if tail >> bit & 1:
            cuts.append(cuts[-1] + (1 << bit))
    base_table = F.broadcast(spark.createDataFrame(bases, "rest int, used bigint, base bigint"))
    rest_rows = rests.join(base_table, "rest").where("rank >= used").select("row", "id", "n", "start", "rest", (F.col("base") + (F.col("rank") - F.col("used")) * F.col("rest")).alias("lo"))
    rest_rows = save(rest_rows, "packing-residual")
    if rest_rows.count() <= BROADCAST_RESIDUAL:
        rest_rows = F.broadcast(rest_rows)
    rest_rows = rest_rows.join(tokens.select("row", "rest_ids"), "row").withColumn("hi", F.col("lo") + F.col("rest"))
    edge = (F.floor(F.col("lo") / window) + 1) * window
    inside = F.filter(F.concat(F.array(edge), F.array(*(F.lit(c).cast("long") for c in cuts))), lambda c: (c > F.col("lo")) & (c < F.col("hi")))
    marks = F.array_sort(F.array_distinct(F.concat(F.array("lo", "hi"), inside)))
    cut = rest_rows.withColumn("m", marks).select("*", F.explode(F.sequence(F.lit(0), F.size("m") - 2)).alias("k"))
    a, b = F.get("m", F.col("k")), F.get("m", F.col("k") + 1)
    cut = cut.withColumn("a", a).withColumn("b", b).withColumn("skip", F.col("a") - F.col("lo"))
    # The sequence that holds position a: a window, or one of the powers of two of the last, partial window.
    cuts_array = F.array(*(F.lit(c).cast("long") for c in cuts))
    in_tail = F.size(F.filter(cuts_array, lambda c: c <= F.col("a"))) - 1
    late = F.col("a") >= windows * window
    sequence = F.when(late, F.lit(sequences + windows) + in_tail).otherwise(F.lit(sequences) + F.floor(F.col("a") / window))
    begin = F.when(late, F.get(cuts_array, in_tail)).otherwise(F.floor(F.col("a") / window) * window)
    ids = F.expr("substring(rest_ids, cast(4 * skip + 1 as int), cast(4 * (b - a) as int))")
    residual = cut.select(
        "id",
        (F.col("start") + F.col("skip")).alias("start"),
        (F.col("b") - F.col("a")).alias("length"),
        F.crc32(ids).alias("ids_crc32"),
        F.col("n").alias("doc_tokens"),
        sequence.cast("long").alias("sequence_id"),
        (F.col("a") - begin).alias("offset"),
    )

    # Full windows number on from there: those of earlier partitions, of earlier documents, of this document.
    base = sequences + windows + len(cuts) - 1
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = tokens.groupBy("part").agg(F.sum(F.size("crcs")).alias("w")).select("part", F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("base"))  # a row a partition
    full = tokens.where(F.size("crcs") > 0).select("id", "part", "n", "first", "crcs").join(F.broadcast(firsts), "part").select("*", F.posexplode("crcs").alias("k", "crc"))
    full = full.select("id", (F.col("k") * F.lit(window)).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), (F.lit(base) + F.col("base") + F.col("first") + F.col("k")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return planned.unionByName(residual).unionByName(full)


def pack_documents(df: DataFrame, encoder: Callable[[], Encoder], id_column: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Tokenizes once, stores what packing needs, and packs."""
    tokens = save(tokenize(df, encoder, id_column, text, window), "packing-tokens")
    return pack(tokens, window).withColumnRenamed("id", id_column)
