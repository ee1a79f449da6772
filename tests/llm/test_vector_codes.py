"""Vector codes against plain loops."""

import math

import numpy as np
import pytest

from draftmill.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, size int"


def plain(rows, parts=4, entries=256, rounds=4):
    """{row index: (code, error)} and the codebooks, by comparing every part with every entry."""
    kept = [(k, r) for k, r in enumerate(rows) if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return {}, []
    scaled = {k: [max(-vector_codes.LARGEST, min(vector_codes.LARGEST, math.floor(float(np.float32(x)) * 1024))) for x in r[1]] for k, r in kept}
    order = sorted((k for k, _ in kept), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, scaled[k]))
    width = len(scaled[order[0]])
    order = [k for k in order if len(scaled[k]) == width]
    size = -(-width // parts)
    cut = {k: [(scaled[k] + [0] * (parts * size - width))[p * size : (p + 1) * size] for p in range(parts)] for k in order}
    books = [[list(cut[k][p]) for k in order[:entries]] for p in range(parts)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        found = {(k, p): nearest(p, cut[k][p])[1] for k in order for p in range(parts)}
        for p in range(parts):
            for e in range(len(books[p])):
                if own := [cut[k][p] for k in order if found[k, p] == e]:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    last = {k: [nearest(p, cut[k][p]) for p in range(parts)] for k in order}
    return {k: (bytes(i for _, i in v), sum(d for d, _ in v)) for k, v in last.items()}, books


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, "old", k) for k, r in enumerate(rows)], SCHEMA).repartition(3)
    out, books = vector_codes.encode_vectors(df, **how)
    return {r["size"]: r for r in out.collect()}, books


def check(spark, rows, **how):
    want, books = plain(rows, **how)
    got, ours = run(spark, rows, **how)
    assert {k: (bytes(r["code"]), r["error"]) for k, r in got.items()} == want
    assert ours.tolist() == books
    for k in want:
        assert got[k]["label_error"] == sum(e for j, (_, e) in want.items() if rows[j][2] == rows[k][2])


def test_codes_are_those_of_plain_loops(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in v], int(i) % 3 or None) for i, v in zip(rng.permutation(300), rng.normal(0, 0.2, (300, 16)), strict=True)]
    check(spark, rows, entries=40, rounds=3)
    check(spark, rows[:30], rounds=2)  # fewer rows than entries


def test_ties_go_to_the_lower_index_across_leaves(spark, monkeypatch):
    """Components of few values: many entries are equally near, or equal."""
    monkeypatch.setattr(vector_codes, "LEAF", 2)
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) / 1024 for x in v], 1) for i, v in enumerate(rng.integers(0, 3, (200, 8)))]
    check(spark, rows, entries=64, rounds=2)


def test_messy_vectors(spark):
    inf, nan = float("inf"), float("nan")
    good = [0.1, -0.2, 0.3, 0.4, 0.5]
    rows = [(3, good, 1), (3, good, 1), (None, [0.0, 1.0, 2.0, 3.0, 4.0], None), (1, [9e8, -9e8, 0.0, 1e-30, -1e-30], None), (2, None, 1), (0, [], 2), (4, [0.1, None, 0.2, 0.3, 0.1], 1)]
    rows += [(5, [nan, *good[1:]], 1), (6, [inf, *good[1:]], 1), (7, [-inf, *good[1:]], 1), (8, good[:3], 1)]
    check(spark, rows, entries=2, rounds=2)
    for none in ([], [(1, None, 1)], [(None, [], None)]):
        out, books = run(spark, none)
        assert out == {} and books.size == 0


@pytest.mark.parametrize("scale", [1, 1 << 24])
def test_search_is_exact_for_small_and_large_components(scale):
    rng = np.random.default_rng(7)
    book = rng.integers(-8, 8, (100, 4)) * scale
    queries = rng.integers(-8, 8, (500, 4)) * scale + rng.integers(0, 2, (500, 4))
    entry, distance = vector_codes.Search(book, queries).run(vector_codes.build(book))
    every = ((queries[:, None] - book) ** 2).sum(2)
    assert (entry == every.argmin(1)).all() and (distance == every.min(1)).all()


def test_a_label_of_a_third_of_all_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in v], 0 if i % 3 == 0 else i) for i, v in enumerate(rng.normal(0, 1, (150, 4)))]
    check(spark, rows, entries=8, rounds=1)
