"""The hidden Markov language model against plain loops over words and states."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from draftmill.llm import hmm
from tests.llm.test_operators import SCHEMA, messy_rows, prose


def some_model(states, symbols, seed=4):
    rng = np.random.default_rng(seed)
    unit = lambda x: x / x.sum(-1, keepdims=True)
    return hmm.Model(unit(rng.random(states)), unit(rng.random((states, states))), unit(rng.random((states, symbols))))


def plain(model, text):
    """(log-likelihood, emissions, moves, first states) of one sequence, all forward and backward sums written out."""
    n, states = len(text), len(model.move)
    a, b = np.zeros((n, states)), np.ones((n, states))
    for t in range(n):
        for j in range(states):
            a[t, j] = model.emit[j, text[t]] * (sum(a[t - 1, i] * model.move[i, j] for i in range(states)) if t else model.start[j])
    for t in range(n - 2, -1, -1):
        for i in range(states):
            b[t, i] = sum(model.move[i, j] * model.emit[j, text[t + 1]] * b[t + 1, j] for j in range(states))
    p = a[-1].sum()
    emissions, moves = np.zeros(model.emit.shape), np.zeros((states, states))
    for t in range(n):
        emissions[:, text[t]] += a[t] * b[t] / p
        if t + 1 < n:
            moves += np.outer(a[t], model.emit[:, text[t + 1]] * b[t + 1]) * model.move / p
    return math.log(p), emissions, moves, a[0] * b[0] / p


@pytest.mark.parametrize("chunk", [5, 1000])
def test_counts_and_likelihoods_are_those_of_plain_loops(monkeypatch, chunk):
    """Cut into chunks or not, in blocks of any size."""
    monkeypatch.setattr(hmm, "CHUNK", chunk)
    monkeypatch.setattr(hmm, "TOGETHER", 40)
    rng = np.random.default_rng(3)
    model = some_model(3, 6)
    texts = [rng.integers(0, 6, n).astype(np.uint16) for n in (1, 1, 2, 4, 5, 6, 10, 11, 40, 97, 3)]
    want = [plain(model, t) for t in texts]
    assert np.allclose(hmm.likelihoods(model, texts), [w[0] for w in want], rtol=1e-12)
    to = hmm.Sums(np.zeros((3, 6)), np.zeros((3, 3)), np.zeros(3))
    hmm.expect(model, texts, to)
    assert np.allclose(to.total, sum(w[0] for w in want))
    for got, k in ((to.emissions, 1), (to.moves, 2), (to.start, 3)):
        assert np.allclose(got, sum(w[k] for w in want))


def test_a_very_long_sequence_of_unlikely_symbols():
    model = some_model(4, 300)
    long = np.random.default_rng(1).integers(0, 300, 200_000).astype(np.uint16)
    a, b = model.start, 0.0
    for x in long:
        a = a * model.emit[:, x]
        b += math.log(a.sum())
        a = a / a.sum() @ model.move
    assert math.isclose(hmm.likelihoods(model, [long])[0], b, rel_tol=1e-10)


def test_words_and_classes_are_those_of_python():
    texts = ["", " a\tB\x0bc\x0c d\r\n", "É ÀB\x1cc x\x85y\u00a0z\u2003w", "  ", "abcdefghijklmnopqrstuvwxyz ab a 日本語 " + "x" * 100, "end "]
    words, bounds = hmm.words_of(pa.array(["skipped", *texts, None]).slice(1).fill_null(""))
    want = [t.encode().lower().split() for t in [*texts, ""]]
    got = [w.encode() for w in words.to_pylist()]
    assert [got[a:b] for a, b in zip(bounds, bounds[1:])] == want
    assert hmm.classes_of(words).tolist() == [zlib.crc32(w[-3:] + bytes([min(len(w) // 3, 5)])) % 1024 for t in want for w in t]


def texts_of(rng):
    kinds = ["alpha beta gamma delta", "uno dos tres quatro", "eins zwei drei vier"]
    return [" ".join(kinds[k % 3].split()[j] + ("" if j % 2 else f"{rng.integers(0, 40)}") for j in rng.integers(0, 4, int(rng.integers(1, 60)))) for k in range(150)]


def small(monkeypatch):
    monkeypatch.setattr(hmm, "SYMBOLS", 24)
    monkeypatch.setattr(hmm, "COMMON", 300)


def known(rows):
    c = Counter()
    for k, t in rows:
        if zlib.crc32(("" if k is None else str(k)).encode()) % 10:
            c.update((t or "").encode().lower().split())
            c[b""] += 1
    return c


def test_score_is_the_probability_of_the_words(spark, monkeypatch):
    """With a given model, against the forward recursion over whole words, each emitted as its class and drawn from it."""
    small(monkeypatch)
    rows = list(enumerate([*texts_of(np.random.default_rng(2)), "Alpha NEVER seen", "", None, "  \t "]))
    made = []

    def fixed(_, __, words, *more):
        made.append((words, some_model(3, len(words.weight))))
        return made[0][1]

    monkeypatch.setattr(hmm, "train", fixed)
    got = {r.doc_id: r for r in hmm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    words, model = made[0]
    c, every = known(rows), Counter()
    for _, t in rows:
        every.update([*(t or "").encode().lower().split(), b""])
    total, everything = sum(c.values()), sum(every.values())
    symbols = [b"", *sorted(w for w, n in every.items() if n * 24 >= everything and w)]
    assert 1 < len(symbols) == words.first_class < len(words.words) < len(every)
    member = lambda w: zlib.crc32(w[-3:] + bytes([min(len(w) // 3, 5)])) % 1024
    size = Counter()
    for w, n in c.items():
        if w not in symbols:
            size[member(w)] += n + 0.1
    for k, t in rows:
        tokens = [*(t or "").encode().lower().split(), b""]
        a, p = model.start, 0.0
        for w in tokens:
            if w in symbols:
                e = model.emit[:, symbols.index(w)]
            else:
                e = model.emit[:, len(symbols) + member(w)] * (c[w] + 0.1) / (size[member(w)] + 0.1)
            a = a * e
            p += math.log10(a.sum())
            a = a / a.sum() @ model.move
        r = got[k]
        assert math.isclose(r.score, p, abs_tol=1e-8)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (total + 0.1 * (len(c) + 1))) for w in tokens), abs_tol=1e-8)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(tokens), sum(c[w] > 0 for w in tokens), total, zlib.crc32(str(k).encode()) % 10 == 0)


def test_training_finds_what_stays_together(spark, monkeypatch):
    """Three kinds of texts: held-out texts gain over the base, and training is that of plain loops."""
    small(monkeypatch)
    rows = list(enumerate(texts_of(np.random.default_rng(5))))
    seen = []
    real = hmm.train
    monkeypatch.setattr(hmm, "train", lambda *a: seen.append((a, real(*a))) or seen[-1][1])
    out = [r for r in hmm.score(spark.createDataFrame(rows, "doc_id long, text string"), states=4, rounds=3).collect() if r.held_out]
    assert sum(r.score for r in out) > 0.9 * sum(r.base_score for r in out)  # logarithms: less is worse
    (stored, symbols, words, *_), model = seen[0]
    texts = [np.frombuffer(r[0], np.uint16) for r in stored.select(symbols).collect()]
    assert len(texts) == sum(zlib.crc32(str(k).encode()) % 10 != 0 for k, _ in rows)
    prior = words.weight / words.weight.sum()
    emit = prior * np.random.default_rng(hmm.SEED).uniform(0.5, 1.5, (4, len(prior)))
    move = np.where(np.eye(4) > 0, 0.9, 0.1 / 3)
    want = hmm.Model(np.full(4, 0.25), move, emit / emit.sum(1, keepdims=True))
    for _ in range(3):
        parts = [plain(want, t) for t in texts]
        emit, move, start = sum(p[1] for p in parts) + hmm.PRIOR * prior, sum(p[2] for p in parts) + 0.1, sum(p[3] for p in parts) + 0.1
        want = hmm.Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))
    for a, b in ((model.start, want.start), (model.move, want.move), (model.emit, want.emit)):
        assert np.allclose(a, b, atol=1e-3)


def test_messy_and_empty_tables(spark):
    rows = messy_rows() + [(70, prose(np.random.default_rng(4), 400_000))]
    df = spark.createDataFrame([(k, t, None, "src", None, "s", "f", 0.5, 1, "r", 2) for k, t in rows], SCHEMA).withColumnsRenamed({"rest": "n_tokens", "n": "_late"}).repartition(3)
    out = hmm.score(df)
    got = out.collect()
    assert len(got) == len(rows) and set(out.columns) == ({*df.columns} - {"text"}) | {"held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}
    c = known(rows)
    assert all(r.train_tokens == sum(c.values()) and math.isfinite(r.score) and r.score < 0 and r["_late"] == 2 for r in got)
    assert sorted(r.n_tokens for r in got) == sorted(len((t or "").split()) + 1 for _, t in rows)
    assert hmm.score(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = hmm.score(spark.createDataFrame([(9, "held out alone"), (9, None)], "doc_id long, text string")).collect()
    assert zlib.crc32(b"9") % 10 == 0 or alone[0].train_tokens > 0
    assert len(alone) == 2 and all(math.isfinite(r.score) for r in alone)
