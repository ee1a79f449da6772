"""Operator 11: a hidden Markov language model.

Training counts all words of all training documents.  Words of at least
1 / SYMBOLS of all occurrences, of which there are at most ``SYMBOLS``, are
symbols of the model; every other word is emitted as its class, told by its last
letters and length, and then drawn from the class by its count.  So the model's
tables are bounded however many words the corpus has, and a word's share of its
class leaves the recursion: the likelihood of a text is that of its symbols by
the scaled forward recursion, times the shares of its class members.

Baum-Welch runs over the symbols of every training document, stored once by
row.  A task adds up its expected counts and sends them, in whole units of
2^-16, a row a symbol; Spark sums them, and at most ``SYMBOLS + CLASSES`` rows
reach the driver.  Whole units make the sums independent of their order and of
tasks that run twice.  Rounds end at ``ROUNDS``, or when the gain falls below
``GAIN`` of the log-likelihood.

Words of at least 1 / COMMON of all occurrences, at most ``COMMON``, are
broadcast with their counts; the counts of the others come by a join, to which a
document sends its rare words.  No word there has more than
1 / COMMON of all occurrences, so no task gets a hot one.

A sequence of more than ``CHUNK`` tokens is cut: the matrices that carry state
probabilities across each chunk are worked out side by side, which gives the
exact state at every cut, so a text of any length takes bounded memory and a
bounded number of steps.

Edge cases: null and empty texts are the end token alone; ids that are null are
held out or not by the empty string; repeated rows are rows in their own right
and are learned from each time; without training rows every count is zero, and
all words of a class, and all classes, are equally likely; columns named like a
result are replaced, all others but the text come through; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StringType, StructField, StructType

from draftmill.llm.common import free_name, save, spread, text_of

#: Bounds of the tables that are broadcast; symbols and classes fit two bytes.
SYMBOLS, CLASSES, COMMON = 1 << 15, 1 << 10, 1 << 18
STATES, ROUNDS, GAIN, STAY, SEED = 8, 8, 1e-3, 0.9, 1
#: What a word that never came counts for, as in the base score; weight of the corpus in each state's emissions.
ADDED, PRIOR = 0.1, 50.0
#: Tokens worked on together, of a sequence between cuts, and gathered before they are sorted by length.
TOGETHER, CHUNK, GATHERED = 1 << 19, 1 << 15, 1 << 22
#: Bytes of texts whose words are looked up together; a longer text is looked up alone.
GROUP = 1 << 23
UNITS = 1 << 16


def _crc_table() -> np.ndarray:
    """CRC-32 of each byte."""
    k = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        k = np.where(k & 1, k >> 1 ^ 0xEDB88320, k >> 1).astype(np.uint32)
    return k


_CRC = _crc_table()


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts end to end, and where each text's begin and end; only A to Z are lower-cased."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, bounds = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # text that begins or ends with white space
    return flat.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[bounds]


def groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of texts to look up together."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    k = 0
    while k < len(ends):
        stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + GROUP, "right")))
        yield k, stop
        k = stop


def classes_of(words: pa.Array) -> np.ndarray:
    """The class of each word: the CRC-32 of its last three bytes and its length, in steps of three up to 15, modulo the number of classes."""
    if not len(words):
        return np.zeros(0, np.int64)
    _, bounds, data = words.buffers()
    at = np.frombuffer(bounds, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)
    size, crc = np.diff(at), np.full(len(words), 0xFFFFFFFF, np.uint32)
    for back in (3, 2, 1):
        step = _CRC[(crc ^ data[np.maximum(at[1:] - back, 0)]) & 255] ^ (crc >> 8)
        crc = np.where(size >= back, step, crc)
    crc = _CRC[(crc ^ np.minimum(size // 3, 5).astype(np.uint32)) & 255] ^ (crc >> 8)
    return (~crc).astype(np.int64) % CLASSES


def held_out(id_column: str) -> Column:
    """Ids whose CRC-32, as text, is divisible by 10 are never learned from."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 10 == 0


# --------------------------------------------------------------------- lexicon


def count_words(docs: DataFrame, held: Column, text: str = "text") -> DataFrame:
    """(word, c, n): occurrences in training documents and in all; the empty word is the end of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            learned = ~batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for k, stop in groups(batch.column(1)):
                words, bounds = words_of(batch.column(1).slice(k, stop - k))
                coded = words.dictionary_encode()
                index, size = coded.indices.to_numpy(), len(coded.dictionary)
                own = np.repeat(learned[k:stop], np.diff(bounds))
                c, n = np.bincount(index[own], minlength=size), np.bincount(index, minlength=size)
                ends = pa.array([""], coded.dictionary.type)
                words = pa.concat_arrays([coded.dictionary, ends])
                yield pa.RecordBatch.from_arrays([words, pa.array(np.append(c, learned[k:stop].sum())), pa.array(np.append(n, stop - k))], ["word", "c", "n"])

    return docs.select(held.alias("h"), text_of(text).alias("t")).mapInArrow(run, "word string, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """What tasks know of words: the common ones by number, with their symbols and logarithms, and the weight of each symbol."""

    tokens: int
    distinct: int
    ends: int
    words: pa.Array
    count: np.ndarray
    symbol: np.ndarray
    weight: np.ndarray
    first_class: int

    @property
    def base(self) -> np.ndarray:
        return np.log10(self.count + ADDED)

    @property
    def share(self) -> np.ndarray:
        """log10 of each common word's share of its symbol."""
        return np.where(self.symbol < self.first_class, 0.0, self.base - np.log10(self.weight)[self.symbol])


def lexicon(words: DataFrame) -> Lexicon:
    """From the stored counts of all words."""
    total = words.agg(F.sum("c").alias("c"), F.sum("n").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.max(F.when(_is_end(), F.col("c"))).alias("ends")).first()
    everything = total["n"] or 0
    rows = words.where(_common(everything) & ~_is_end()).orderBy("word").toArrow().combine_chunks()
    common, count, every = (rows[c].combine_chunks() if rows.num_rows else pa.array([], t) for c, t in (("word", pa.string()), ("c", pa.int64()), ("n", pa.int64())))
    count = count.to_numpy()
    named = every.to_numpy() * SYMBOLS >= everything
    first = 1 + int(named.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, c = classes_of(batch.column(0)), batch.column(1).to_numpy()
            sums = np.zeros((2, CLASSES), np.int64)
            np.add.at(sums[0], k, c)
            np.add.at(sums[1], k, c > 0)
            (k,) = np.nonzero(sums[1])
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(sums[0, k]), pa.array(sums[1, k])], ["k", "c", "v"])

    members = words.where((F.col("n") * SYMBOLS < everything) & ~_is_end()).select("word", "c")
    classes = members.mapInArrow(run, "k long, c long, v long").groupBy("k").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).collect()
    symbol = classes_of(common) + first
    symbol[named] = np.arange(1, first)
    weight = np.full(first + CLASSES, ADDED)
    weight[0] += total["ends"] or 0
    weight[1:first] += count[named]
    for r in classes:
        weight[first + r["k"]] = r["c"] + ADDED * (r["v"] + 1)
    return Lexicon(total["c"] or 0, total["v"] or 0, total["ends"] or 0, common, count, symbol, weight, first)


def _is_end() -> Column:
    return F.octet_length("word") == 0


def _common(everything: int) -> Column:
    return F.col("n") * COMMON >= everything


def encode(docs: DataFrame, words: Lexicon, held: Column, text: str, names: list[str]) -> DataFrame:
    """docs without the text, with columns of the given names: row number, held out, tokens, known common tokens, the common part of the base and of the shares, symbols, rare words."""
    row, held_name, *rest = names
    keep = [c for c in docs.columns if c != text]
    rows = docs.select(*keep, F.monotonically_increasing_id().alias(row), held.alias(held_name), text_of(text).alias(text))
    kinds = [LongType(), LongType(), DoubleType(), DoubleType(), BinaryType(), ArrayType(StringType())]
    schema = StructType([f for f in rows.schema.fields if f.name != text] + [StructField(n, k) for n, k in zip(rest, kinds, strict=True)])
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        log_weight, end = np.log10(lex.weight), float(np.log10(lex.ends + ADDED))
        # Number -1, the last, is that of rare words.
        symbol, base, share, known = (np.append(x, 0) for x in (lex.symbol, lex.base, lex.share, lex.count > 0))

        def columns(texts: pa.Array) -> list[pa.Array]:
            words, bounds = words_of(texts)
            at = pc.fill_null(pc.index_in(words, value_set=lex.words.cast(words.type)), -1).to_numpy().astype(np.int64)
            own, logs = symbol[at], share[at]
            gone = at < 0
            rare = words.filter(pa.array(gone))
            own[gone] = classes_of(rare) + lex.first_class
            logs[gone] = -log_weight[own[gone]]
            sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[bounds])
            some = np.diff(bounds) > 0

            def exact(x: np.ndarray) -> np.ndarray:  # sums of each text's own numbers, without the rounding of a running sum
                out = np.zeros(len(texts))
                if some.any():
                    out[some] = np.add.reduceat(x, bounds[:-1][some])
                return out

            data = np.insert(own, bounds[1:], 0).astype(np.uint16)  # the end of each text
            cuts = pa.array(2 * (bounds + np.arange(len(bounds))), pa.int32())
            symbols = pa.Array.from_buffers(pa.binary(), len(texts), [None, cuts.buffers()[1], pa.py_buffer(data)])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(gone)])[bounds], pa.int32()), rare)
            return [pa.array(np.diff(bounds) + 1), pa.array(sums(known[at]) + (lex.ends > 0)), pa.array(exact(base[at]) + end), pa.array(exact(logs)), symbols, lists.cast(pa.list_(pa.string()))]

        for batch in batches:
            texts, others = batch.column(batch.num_columns - 1), batch.columns[:-1]
            for k, stop in groups(texts):
                yield pa.RecordBatch.from_arrays([*(c.slice(k, stop - k) for c in others), *columns(texts.slice(k, stop - k))], schema.fieldNames())

    return rows.mapInArrow(run, schema)


# ----------------------------------------------------------------------- model


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # by state, then symbol


class Block:
    """Sequences side by side, longest first, in the order of time."""

    def __init__(self, pieces: list[np.ndarray]):
        sizes = np.array([len(p) for p in pieces])
        self.active = (len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), "right")).tolist()
        self.bounds = np.concatenate([[0], np.cumsum(self.active)])
        self.flat = np.empty(self.bounds[-1], np.int64)
        for k, p in enumerate(pieces):
            self.flat[self.bounds[: len(p)] + k] = p
        self.at = self.bounds.tolist()

    def forward(self, model: Model, start: np.ndarray) -> tuple[np.ndarray, ...]:
        """(emissions, state probabilities, scales, last state probabilities), states along the first axis and tokens or sequences along the second."""
        to, at, n = model.move.T.copy(), self.at, start.shape[1]
        emit = model.emit.take(self.flat, axis=1)
        alpha, scale, last = np.empty_like(emit), np.empty(len(self.flat), emit.dtype), np.empty_like(start)
        a = start
        for t, m in enumerate(self.active):
            here = slice(at[t], at[t + 1])
            now = alpha[:, here]
            if t:
                np.matmul(to, a[:, :m], out=now)
                now *= emit[:, here]
                if m < n:
                    last[:, m:n] = a[:, m:n]
                    n = m
            else:
                np.multiply(a, emit[:, here], out=now)
            z = now.sum(0, out=scale[here])
            now /= z
            a = now
        last[:, :n] = a
        return emit, alpha, scale, last

    def logs(self, scale: np.ndarray, n: int) -> np.ndarray:
        """The log-likelihood of each sequence."""
        own = np.arange(len(self.flat)) - np.repeat(self.at[:-1], self.active)
        return np.bincount(own, np.log(scale, dtype=np.float64), n)

    def counts(self, model: Model, start: np.ndarray, end: np.ndarray, to: Sums) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Adds the log-likelihood and the expected emissions and moves to ``to``; gives first state probabilities, and what leads into and out of the sequences."""
        emit, alpha, scale, last = self.forward(model, start)
        to.total += float(np.log(scale, dtype=np.float64).sum())
        n, at = start.shape[1], self.at
        emit /= scale
        beta = np.empty_like(alpha)
        ends = end / (last * end).sum(0)
        beta[:, at[-2] :] = ends[:, : self.active[-1]]
        for t in range(len(self.active) - 1, -1, -1):
            m, here = self.active[t], slice(at[t], at[t + 1])
            e = emit[:, here]
            e *= beta[:, here]
            if t:
                cut = at[t - 1] + m
                np.matmul(model.move, e, out=beta[:, at[t - 1] : cut])
                if cut < at[t]:
                    beta[:, cut : at[t]] = ends[:, m : self.active[t - 1]]
        before = np.arange(n, len(self.flat)) - np.repeat(np.array(self.active[:-1], np.int64), self.active[1:])
        to.moves += alpha.take(before, axis=1) @ emit[:, n:].T * model.move
        alpha *= beta
        for k in range(len(alpha)):
            to.emissions[k] += np.bincount(self.flat, alpha[k], to.emissions.shape[1])
        return alpha[:, :n], emit[:, :n], last


@dataclass
class Sums:
    """Expected counts of a task."""

    emissions: np.ndarray
    moves: np.ndarray
    start: np.ndarray
    total: float = 0.0


def _halved(model: Model) -> Model:
    """In single precision, which is enough for expected counts: every step is scaled."""
    return Model(*(x.astype(np.float32) for x in (model.start, model.move, model.emit)))


def _blocks(texts: list[np.ndarray]) -> Iterator[list[int]]:
    """Numbers of sequences to work on together, longest first."""
    some: list[int] = []
    tokens = 0
    for k in sorted(range(len(texts)), key=lambda k: -len(texts[k])):
        if some and tokens + len(texts[k]) > TOGETHER:
            yield some
            some, tokens = [], 0
        some.append(k)
        tokens += len(texts[k])
    if some:
        yield some


def _cut(text: np.ndarray) -> list[np.ndarray]:
    return [text[k : k + CHUNK] for k in range(0, len(text), CHUNK)]


def _carried(model: Model, pieces: list[np.ndarray]) -> np.ndarray:
    """For each piece, up to scale, the matrix from state probabilities at its first token, before that is seen, to those at its last."""
    states = len(model.move)
    out = []
    for k in range(0, len(pieces), 4):
        some = pieces[k : k + 4]
        block = Block([p for p in some for _ in range(states)])
        _, _, scale, last = block.forward(model, np.tile(np.eye(states, dtype=model.move.dtype), (1, len(some))))
        total = block.logs(scale, len(some) * states).reshape(-1, states)
        out.append(last.T.reshape(-1, states, states) * np.exp(total - total.max(1, keepdims=True))[:, :, None])
    return np.concatenate(out)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum()


def _columns(x: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(x[:, None], n, axis=1)


def likelihoods(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Natural logarithms of the probabilities of symbol sequences."""
    out = np.zeros(len(texts))
    short = [k for k, t in enumerate(texts) if len(t) <= CHUNK]
    for some in _blocks([texts[k] for k in short]):
        out[[short[k] for k in some]] = _logs(model, [texts[short[k]] for k in some], _columns(model.start, len(some)))
    for k in (k for k, t in enumerate(texts) if len(t) > CHUNK):
        pieces = _cut(texts[k])
        starts = [model.start]
        for m in _carried(model, pieces[:-1]):
            starts.append(_unit(starts[-1] @ m) @ model.move)
        for j in range(0, len(pieces), 16):
            out[k] += _logs(model, pieces[j : j + 16], np.stack(starts[j : j + 16], 1)).sum()
    return out


def _logs(model: Model, pieces: list[np.ndarray], start: np.ndarray) -> np.ndarray:
    block = Block(pieces)
    return block.logs(block.forward(model, start)[2], len(pieces))


def expect(model: Model, texts: list[np.ndarray], to: Sums) -> None:
    """Adds the expected counts of whole sequences."""
    states = len(model.move)
    short = [t for t in texts if len(t) <= CHUNK]
    for some in _blocks(short):
        first, _, _ = Block([short[k] for k in some]).counts(model, _columns(model.start, len(some)), np.ones((states, len(some)), model.move.dtype), to)
        to.start += first.sum(1)
    for text in (t for t in texts if len(t) > CHUNK):
        pieces = _cut(text)
        carried = _carried(model, pieces)
        starts, ends = [model.start], [np.ones(states, model.move.dtype)]
        for m in carried[:-1]:
            starts.append(_unit(starts[-1] @ m) @ model.move)
        for m in carried[:0:-1]:
            ends.append(_unit(model.move @ (m @ ends[-1])))
        ends.reverse()
        gone = None
        for j in range(0, len(pieces), 16):
            here = slice(j, j + 16)
            first, into, last = Block(pieces[here]).counts(model, np.stack(starts[here], 1), np.stack(ends[here], 1), to)
            if j == 0:
                to.start += first[:, 0]
            # Moves across the cuts.
            for k in range(len(pieces[here])):
                if gone is not None:
                    to.moves += _unit(gone[:, None] * model.move * into[:, k])
                gone = last[:, k]


def _gathered(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Rows of about GATHERED tokens with their symbols."""
    rows: list[pa.RecordBatch] = []
    texts: list[np.ndarray] = []
    tokens = 0
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            b = batch.slice(k, 256)
            rows.append(b)
            own = [np.frombuffer(x, np.uint16) for x in b.column(at).to_pylist()]
            texts += own
            tokens += sum(map(len, own))
            if tokens >= GATHERED:
                yield rows, texts
                rows, texts, tokens = [], [], 0
    if rows:
        yield rows, texts


def train(rows: DataFrame, symbols: str, words: Lexicon, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over the stored symbols of all rows."""
    prior = words.weight / words.weight.sum()
    size = len(prior)
    emit = prior * np.random.default_rng(SEED).uniform(0.5, 1.5, (states, size))
    move = np.full((states, states), (1 - STAY) / max(1, states - 1))
    np.fill_diagonal(move, STAY if states > 1 else 1.0)
    model = Model(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True))
    sums = [F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(states)]
    known = None
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(_halved(model))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            to = Sums(np.zeros((states, size)), np.zeros((states, states)), np.zeros(states))
            for _, texts in _gathered(batches, 0):
                expect(shared.value, texts, to)
            # Behind the symbols: the moves from each state, the first states, the log-likelihood.
            table = np.concatenate([to.emissions.T, to.moves, to.start[None], np.full((1, states), to.total)])
            units = np.rint(table * UNITS).astype(np.int64)
            (k,) = np.nonzero(units.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(list(units[k]), pa.list_(pa.int64()))], ["k", "v"])

        found = rows.select(symbols).mapInArrow(run, "k long, v array<long>").groupBy("k").agg(*sums).toArrow()
        shared.unpersist()
        table = np.zeros((size + states + 2, states))
        table[found["k"].to_numpy()] = np.stack([found[f"v{k}"].to_numpy() for k in range(states)], 1) / UNITS
        if not table[:size].any():
            break  # nothing to learn from
        emit = table[:size].T + PRIOR * prior
        move, start = table[size : size + states] + ADDED, table[size + states] + ADDED
        model = Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))
        if known is not None and table[-1, 0] - known < GAIN * abs(known):
            break
        known = table[-1, 0]
    return model


def score(docs: DataFrame, id_column: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """docs without the text, with held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    results = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    docs = docs.drop(*(c for c in docs.columns if c in results and c not in (id_column, text)))
    docs = spread(docs)
    held = held_out(id_column)
    words = save(count_words(docs, held, text), "hmm-words")
    lex = lexicon(words)
    names = free_name(docs, "row", "held", "tokens", "known", "base", "share", "symbols", "rare", "late", "seen", "model")
    row, held_name, tokens, known, base, share, symbols, rare, late_name, seen, of_model = names
    rows = save(encode(docs, lex, held, text, names[:8]), "hmm-rows")
    model = train(rows.where(~F.col(held_name)), symbols, lex, states, rounds)
    # The counts of rare words; each of them has few occurrences.
    everything = words.agg(F.sum("n")).first()[0] or 0
    sent = rows.select(row, F.explode(rare).alias("word"))
    counts = words.where(~_common(everything)).select("word", "c")
    met = sent.join(counts, "word")
    late = met.groupBy(row).agg(F.sum(F.log10(F.col("c") + ADDED)).alias(late_name), F.count_if(F.col("c") > 0).alias(seen))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = rows.drop(rare)
    schema = StructType([f for f in out.schema.fields if f.name != symbols] + [StructField(of_model, DoubleType())])
    at = out.columns.index(symbols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, texts in _gathered(batches, at):
            logs, k = likelihoods(shared.value, texts) / np.log(10), 0
            for b in some:
                yield pa.RecordBatch.from_arrays([*(c for j, c in enumerate(b.columns) if j != at), pa.array(logs[k : k + b.num_rows])], schema.fieldNames())
                k += b.num_rows

    scored = out.mapInArrow(run, schema).join(late, row, "left")
    of_rare = F.coalesce(late_name, F.lit(0.0))
    return scored.select(
        *(c for c in docs.columns if c != text),
        F.col(held_name).alias("held_out"),
        F.col(tokens).alias("n_tokens"),
        (F.col(known) + F.coalesce(seen, F.lit(0))).alias("n_known"),
        F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col(base) + of_rare - F.col(tokens) * float(np.log10(lex.tokens + ADDED * (lex.distinct + 1)))).alias("base_score"),
        (F.col(of_model) + F.col(share) + of_rare).alias("score"),
    )
