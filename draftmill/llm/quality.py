"""Operator 10: document quality by attention-based multiple-instance learning.

A document is a bag of passages of at most 512 bytes, of its whole text.  Every
passage is encoded as shares of character classes and marks, word shape, and
how concentrated its byte pairs are.  A small network embeds passages; gated
attention, learned from document labels alone, weighs them; the score is that
of the weighted passage representation.

Training reads a bounded sample of labelled documents (``TRAIN_DOCS``,
``TRAIN_BYTES``): the ids with the least MD5 among those that may be learned
from.  Only their passage features reach the driver, at most
``TRAIN_DOCS * TRAIN_BYTES / PASSAGE`` rows and far fewer in practice.  Scoring
runs over all texts in Arrow batches with no shuffle.  Texts are encoded
``SLICE`` bytes at a time, straight from the batch's buffer: a slice holds many
short texts or a part of a long one, and attention's sums (greatest logit,
denominator, numerator) are carried from slice to slice, so that a text of any
length takes the memory of a slice.

Edge cases: null and empty texts are one empty passage and get a score; a very
long text is one bag of all its passages; a document with several labels counts
with the greatest; null labels and ids are not learned from; without labels of
both kinds every score is 0.5, which rejects nothing; equal texts and repeated
rows get equal scores; a column named like the score is replaced, all others
come through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

PASSAGE = 512
#: Bounds of the training sample.
TRAIN_DOCS, TRAIN_BYTES = 4000, 1 << 17
THRESHOLD = 0.3
HIDDEN, ATTENTION, STEPS, BATCH, SEED = 24, 12, 1500, 64, 7
#: Bytes encoded together, a multiple of PASSAGE.
SLICE = 1 << 19

MARKS = b"!\"#$%&'()*+,-./:;<=>?@[]_{|}~"
_CLASS = np.zeros(256, np.int64)  # 0: other
for _chars, _k in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b" \t\r\x0b\x0c", 4), (b"\n", 5)):
    _CLASS[list(_chars)] = _k
_CLASS[0x80:0xC0] = 6  # later bytes of a character
_CLASS[0xC0:] = 7  # first bytes of characters beyond ASCII
for _i, _c in enumerate(MARKS):
    _CLASS[_c] = 8 + _i
CLASSES = 8 + len(MARKS)
PAIRS = 1024
FEATURES = CLASSES + 8


def spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow column and the len + 1 bounds of its texts; null is empty.  Nothing is copied."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, bounds, data = texts.buffers()
    at = np.frombuffer(bounds, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if bounds else np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def slices(at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, begin, end) of what to encode together: at most SLICE bytes and as many texts; a text is cut at passage ends only."""
    k, start, n = 0, int(at[0]) if len(at) else 0, len(at) - 1
    while k < n:
        if at[k + 1] - start > SLICE:  # part of a long text
            yield np.array([k]), np.array([start]), np.array([start + SLICE])
            start += SLICE
            continue
        end = min(int(np.searchsorted(at, start + SLICE, "right")) - 1, k + SLICE // PASSAGE, n)
        begin = at[k:end].copy()
        begin[0] = start
        yield np.arange(k, end), begin, at[k + 1 : end + 1]
        k, start = end, int(at[end])


def encode(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the byte ranges, which lie end to end, and how many passages each has."""
    sizes = end - begin
    counts = np.maximum(1, -(-sizes // PASSAGE))
    passages = int(counts.sum())
    # The passage of each byte.
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    first = begin[0] if len(begin) else 0
    data = data[first : first + int(sizes.sum())]
    inside = np.arange(len(data)) - (begin - first)[text_of]
    owner = (np.concatenate([[0], np.cumsum(counts)[:-1]])[text_of] + inside // PASSAGE).astype(np.int64)
    kind = _CLASS[data]
    hist = np.bincount(owner * CLASSES + kind, minlength=passages * CLASSES).reshape(passages, CLASSES).astype(np.float32)
    size = hist.sum(1)
    safe = np.maximum(size, 1)
    share = hist / safe[:, None]
    # Byte pairs within a passage: how evenly they spread, and how many differ.
    same = owner[1:] == owner[:-1]
    pair = ((data[:-1].astype(np.int64) * 31 + data[1:]) % PAIRS)[same]
    spread = np.bincount(owner[1:][same] * PAIRS + pair, minlength=passages * PAIRS).reshape(passages, PAIRS).astype(np.float32)
    pairs = np.maximum(spread.sum(1), 1)
    words = hist[:, 4] + hist[:, 5] + 1
    upper_next = np.bincount(owner[1:][same & (kind[1:] == 2) & (kind[:-1] == 2)], minlength=passages) / safe
    mark_pairs = np.bincount(owner[1:][same & (kind[1:] >= 8) & (data[1:] == data[:-1])], minlength=passages) / safe
    extra = np.stack(
        [
            np.log1p(size) / 6,
            np.square(spread).sum(1) / np.square(pairs) * 20,
            (spread > 0).sum(1) / pairs,
            spread.max(1) / pairs * 10,
            safe / words / 10,
            hist[:, 2] / np.maximum(hist[:, 1] + hist[:, 2], 1),
            upper_next * 2,
            mark_pairs * 5,
        ],
        1,
    )
    return np.concatenate([np.sqrt(share), extra], 1).astype(np.float32), counts


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def passages(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The representation of each passage and the logit of its attention."""
        p = self.weights
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["w"] + p["b"])
        return h, (np.tanh(h @ p["v"]) / (1 + np.exp(-(h @ p["u"])))) @ p["a"]

    def of_bags(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(z @ self.weights["c"] + self.weights["d"])))

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        sums = Pooled(len(counts), len(self.weights["b"]))
        sums.add(np.arange(len(counts)), *self.passages(x), counts)
        return self.of_bags(sums.mean())


class Pooled:
    """Attention-weighted means of bags whose passages come in parts."""

    def __init__(self, bags: int, width: int):
        self.most, self.below, self.above = np.full(bags, -np.inf), np.zeros(bags), np.zeros((bags, width))

    def add(self, bags: np.ndarray, h: np.ndarray, a: np.ndarray, counts: np.ndarray) -> None:
        """Adds passages to distinct bags, ``counts`` to each."""
        start = np.concatenate([[0], np.cumsum(counts)[:-1]])
        most = np.maximum(self.most[bags], np.maximum.reduceat(a, start))
        e = np.exp(a - np.repeat(most, counts))
        shrink = np.exp(self.most[bags] - most)
        self.below[bags] = self.below[bags] * shrink + np.add.reduceat(e, start)
        self.above[bags] = self.above[bags] * shrink[:, None] + np.add.reduceat(h * e[:, None], start, axis=0)
        self.most[bags] = most

    def mean(self) -> np.ndarray:
        return self.above / self.below[:, None]


def score_texts(texts: pa.Array, model: Model) -> np.ndarray:
    data, at = spans(texts)
    sums = Pooled(len(texts), len(model.weights["b"]))
    for rows, begin, end in slices(at):
        x, counts = encode(data, begin, end)
        sums.add(rows, *model.passages(x), counts)
    return model.of_bags(sums.mean())


def encode_texts(texts: pa.Array) -> list[np.ndarray]:
    """The features of each text's passages."""
    data, at = spans(texts)
    parts: list[list[np.ndarray]] = [[] for _ in range(len(texts))]
    for rows, begin, end in slices(at):
        x, counts = encode(data, begin, end)
        for k, part in zip(rows, np.split(x, np.cumsum(counts)[:-1]), strict=True):
            parts[k].append(part)
    return [np.concatenate(p) for p in parts]


def train(x: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> Model | None:
    """Gated attention pooling by Adam on the log loss of documents."""
    if len(labels) == 0 or labels.min() == labels.max():
        return None
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / scale
    rng = np.random.default_rng(SEED)
    n = x.shape[1]
    p = {
        "w": rng.normal(0, n**-0.5, (n, HIDDEN)),
        "b": np.zeros(HIDDEN),
        "v": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)),
        "u": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)),
        "a": rng.normal(0, ATTENTION**-0.5, ATTENTION),
        "c": rng.normal(0, HIDDEN**-0.5, HIDDEN),
        "d": np.zeros(()),
    }
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    start = np.concatenate([[0], np.cumsum(counts)[:-1]])
    step = 0
    epochs = -(-STEPS // -(-len(labels) // BATCH))
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            bags = order[at : at + BATCH]
            size = counts[bags]
            rows = np.concatenate([np.arange(start[b], start[b] + counts[b]) for b in bags])
            g = _gradient(p, x[rows], size, labels[bags])
            step += 1
            for k in p:
                d = g[k] + 1e-4 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * d
                s[k] = 0.999 * s[k] + 0.001 * d * d
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, p)


def _gradient(p: dict[str, np.ndarray], x: np.ndarray, size: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    bag = np.repeat(np.arange(len(size)), size)
    h = np.tanh(x @ p["w"] + p["b"])
    t, o = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
    e = (t * o) @ p["a"]
    e = np.exp(e - np.maximum.reduceat(e, first)[bag])
    att = e / np.add.reduceat(e, first)[bag]
    z = np.add.reduceat(h * att[:, None], first, axis=0)
    q = 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))
    dl = (q - y) / len(y)
    dz = dl[:, None] * p["c"]
    datt = (h * dz[bag]).sum(1)
    de = att * (datt - np.add.reduceat(att * datt, first)[bag])
    dto = de[:, None] * p["a"]
    dt, do = dto * o * (1 - t * t), dto * t * o * (1 - o)
    dh = att[:, None] * dz[bag] + dt @ p["v"].T + do @ p["u"].T
    dx = dh * (1 - h * h)
    return {"w": x.T @ dx, "b": dx.sum(0), "v": h.T @ dt, "u": h.T @ do, "a": (t * o).T @ de, "c": z.T @ dl, "d": dl.sum()}


def held_out(id_column: str = "doc_id") -> Column:
    """Ids whose CRC-32, as text, is divisible by 5 are never learned from."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality") -> Model | None:
    """Learns from labelled rows outside the held-out part."""
    known = labels.select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.where(~held_out("id")).groupBy("id").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.md5(F.col("id").cast("string")), "id").limit(TRAIN_DOCS)
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.octet_length("text") <= TRAIN_BYTES)
    rows = rows.join(F.broadcast(chosen), "id").select("id", "y", "text")  # at most TRAIN_DOCS ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                b = batch.slice(k, 64)
                x = [f.tobytes() for f in encode_texts(b.column(2))]
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1), pa.array(x, pa.binary())], ["id", "y", "x"])

    found = sorted(rows.mapInArrow(run, "id string, y int, x binary").collect(), key=lambda r: (r["id"], r["y"], bytes(r["x"])))
    # Repeated rows of an id count once.
    found = list({r["id"]: r for r in found}.values())
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in found]
    if not bags:
        return None
    return train(np.concatenate(bags), np.array([len(b) for b in bags]), np.array([r["y"] for r in found], np.float64))


def score(df: DataFrame, model: Model | None, text: str = "text", name: str = "score") -> DataFrame:
    """df with the score added; a column of that name is replaced."""
    out = df.drop(name)
    schema = out.schema
    at = schema.fieldNames().index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = score_texts(batch.column(at), model) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, name])

    return out.mapInArrow(run, StructType([*schema.fields, StructField(name, DoubleType())]))
