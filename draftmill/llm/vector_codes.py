"""Operator 12: product-quantisation codes of vectors, with a kd-tree a codebook.

A vector's integer components are cut into equal parts; every part position has
a codebook whose entries move, round by round, to the mean of the parts nearest
to them.  Each round broadcasts one kd-tree a codebook, of ``ENTRIES`` entries
at most.  A search walks the tree depth first, nearer child first, and leaves
out only nodes whose box is farther than the best entry so far: a node at the
same distance is visited, so of entries at equal distance the lower index wins.
All queries of a batch that stand at a node walk on together.  Tasks send an
integer count and sum for each entry they used; Spark adds them up, and at most
``parts * ENTRIES`` rows reach the driver, which moves the entries and builds
the next trees.  All arithmetic is on integers, so results depend on neither
the order nor the number of tasks, nor on tasks that run twice.

Edge cases: vectors that are null, empty or hold a null, NaN or infinite
component are dropped, and so are those of another length than the vector of the
smallest id; a length that the number of parts does not divide is filled up with
zeros; scaled components beyond ``LARGEST`` are held there, so that squared
distances fit a long; rows without an id come after all others when entries are
chosen, and rows of equal ids by their components; fewer rows than entries make
smaller codebooks; repeated rows are rows in their own right; null labels count
as one label; columns named like a result are replaced, others come through; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from draftmill.llm.common import drop, free_name, meet, save

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LARGEST = 1 << 28
#: Entries in a leaf of the tree.
LEAF = 16
#: Vectors that walk the trees together.
TOGETHER = 8192
#: Below this magnitude inner products are exact in doubles for up to 64 components.
EXACT = 1 << 22


@dataclass
class Node:
    """The box of some entries; a leaf has their indices, another node the axis and value that part its children."""

    low: np.ndarray
    high: np.ndarray
    entries: np.ndarray
    axis: int = 0
    at: int = 0
    near: Node | None = None
    far: Node | None = None


def build(book: np.ndarray, entries: np.ndarray | None = None) -> Node:
    """The kd-tree of a codebook, parted at the median of the widest axis; equal entries share a leaf, whatever its size."""
    entries = np.arange(len(book)) if entries is None else entries
    own = book[entries]
    node = Node(own.min(0), own.max(0), entries)
    width = node.high - node.low
    if len(entries) > LEAF and width.max() > 0:
        node.axis = int(width.argmax())
        values = own[:, node.axis]
        node.at = int(np.sort(values)[len(values) // 2])
        if node.at == values.min():
            node.at = int(values[values > node.at].min())
        node.near, node.far = build(book, entries[values < node.at]), build(book, entries[values >= node.at])
    return node


class Search:
    """The nearest entries of a batch of queries, by branch and bound."""

    def __init__(self, book: np.ndarray, queries: np.ndarray):
        self.book, self.queries = book, queries
        self.best = np.full(len(queries), np.iinfo(np.int64).max)
        self.entry = np.full(len(queries), len(book), np.int64)
        small = len(book) == 0 or max(abs(book).max(), abs(queries).max(initial=0)) < EXACT
        self.exact = small and book.shape[1] <= 64
        self.plain = (book.astype(float), queries.astype(float), (book * book).sum(1), (queries * queries).sum(1)) if self.exact else None

    def run(self, tree: Node) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every query."""
        self._visit(tree, np.arange(len(self.queries)))
        return self.entry, self.best

    def _visit(self, node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        own = self.queries[rows]
        out = np.maximum(np.maximum(node.low - own, own - node.high), 0)
        rows = rows[(out * out).sum(1) <= self.best[rows]]  # an equal bound may hide a lower index
        if node.near is None:
            self._compare(node.entries, rows)
            return
        left = self.queries[rows, node.axis] < node.at
        for first, second, some in ((node.near, node.far, rows[left]), (node.far, node.near, rows[~left])):
            self._visit(first, some)
            self._visit(second, some)

    def _compare(self, entries: np.ndarray, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if self.plain:
            book, queries, book_norm, norm = self.plain
            found = norm[rows, None] + book_norm[entries] - 2 * (queries[rows] @ book[entries].T).astype(np.int64)
        else:
            found = np.stack([np.square(self.queries[rows] - self.book[e]).sum(1) for e in entries], 1)
        k = found.argmin(1)  # the first of equals, and entries ascend
        least, entry = found[np.arange(len(rows)), k], entries[k]
        better = (least < self.best[rows]) | ((least == self.best[rows]) & (entry < self.entry[rows]))
        self.best[rows[better]], self.entry[rows[better]] = least[better], entry[better]


def scaled(vector: Column) -> Column:
    """Whole-number components; null where the vector is dropped."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.greatest(F.least(F.lit(float(SCALE)) * x.cast("double"), F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int"))
    return F.when((F.size(vector) > 0) & ~bad, whole)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow list column as rows of ``width`` components, filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    rows = flat.reshape(len(column), -1) if len(column) else np.zeros((0, width), np.int64)
    return np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def _assign(batch: pa.RecordBatch, at: int, books: np.ndarray, trees: list[Node]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, their parts, entries, distances) for slices of a batch."""
    parts, _, size = books.shape
    for k in range(0, batch.num_rows, TOGETHER):
        b = batch.slice(k, TOGETHER)
        vectors = _vectors(b.column(at), parts * size).reshape(-1, parts, size)
        found = [Search(books[p], np.ascontiguousarray(vectors[:, p])).run(trees[p]) for p in range(parts)]
        yield b, vectors, np.stack([e for e, _ in found], 1), np.stack([d for _, d in found], 1)


def first_entries(rows: DataFrame, id_column: str, codes: str, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """The codebooks to start from: the parts of the rows of the smallest ids, at most ``entries`` rows on the driver."""
    found = rows.orderBy(F.col(id_column).asc_nulls_last(), codes).limit(entries).select(codes).collect()
    size = -(-len(found[0][0]) // parts)
    vectors = np.array([r[0] for r in found], np.int64)
    return np.pad(vectors, ((0, 0), (0, parts * size - vectors.shape[1]))).reshape(-1, parts, size).transpose(1, 0, 2)


def moved(rows: DataFrame, codes: str, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over all rows; entries that no part is nearest to stay."""
    parts, entries, size = books.shape
    shared = rows.sparkSession.sparkContext.broadcast((books, [build(b) for b in books]))
    at = rows.columns.index(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, trees = shared.value
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, size), np.int64)
        for batch in batches:
            for _, vectors, entry, _ in _assign(batch, at, books, trees):
                for p in range(parts):
                    count[p] += np.bincount(entry[:, p], minlength=entries)
                    order = np.argsort(entry[:, p], kind="stable")
                    used, start = np.unique(entry[order, p], return_index=True)
                    total[p, used] += np.add.reduceat(vectors[order, p], start, axis=0)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["p", "e", "n", "s"])

    sums = [F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(size)]
    found = rows.mapInArrow(run, "p long, e long, n long, s array<long>").groupBy("p", "e").agg(F.sum("n").alias("n"), *sums).collect()
    shared.unpersist()
    out = books.copy()
    for p, e, n, *s in found:
        out[p, e] = [x // n for x in s]
    return out


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def encode_vectors(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(rows, codebooks): all kept rows with ``code`` (a byte a part), ``error`` and ``label_error``, and the final entries by part."""
    if not 0 < entries <= 256:
        raise ValueError("a code byte names at most 256 entries")
    df = df.drop(*(c for c in df.columns if c in ("code", "error", "label_error") and c not in (id_column, vector, label)))
    (codes,) = free_name(df, "codes")
    kept = df.withColumn(codes, scaled(F.col(vector))).where(F.col(codes).isNotNull())
    first = kept.orderBy(F.col(id_column).asc_nulls_last(), codes).select(F.size(codes)).first()
    if first is None:
        none = kept.drop(codes).withColumns({"code": F.lit(b""), "error": F.lit(0).cast("long"), "label_error": F.lit(0).cast("long")})
        return none, np.zeros((parts, 0, 0), np.int64)
    kept = kept.where(F.size(codes) == first[0])
    small = save(kept.select(id_column, codes), "vector-codes")
    books = first_entries(small, id_column, codes, parts, entries)
    for _ in range(rounds):
        books = moved(small, codes, books)
    drop(small)
    coded = save(_coded(kept, codes, books), "vector-coded")
    sums = coded.groupBy(label).agg(F.sum("error").alias("label_error"), F.count("*").alias("_dm_weight"))
    return meet(coded, sums, label, "_dm_weight"), books


def _coded(kept: DataFrame, codes: str, books: np.ndarray) -> DataFrame:
    shared = kept.sparkSession.sparkContext.broadcast((books, [build(b) for b in books]))
    at = kept.columns.index(codes)
    schema = StructType([f for f in kept.schema.fields if f.name != codes] + [StructField("code", BinaryType()), StructField("error", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, _, entry, distance in _assign(batch, at, *shared.value):
                code = pa.array([x.tobytes() for x in entry.astype(np.uint8)], pa.binary())
                columns = [c for k, c in enumerate(b.columns) if k != at]
                yield pa.RecordBatch.from_arrays([*columns, code, pa.array(distance.sum(1))], schema.fieldNames())

    return kept.mapInArrow(run, schema)
