"""The pipeline's near-duplicates against brute-force Jaccard."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from draftmill.llm import near_text
from tests.llm.test_operators import prose


def shingles(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if x]
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()


def groups(texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (a and b and len(a & b) * 5 >= len(a | b) * 4):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {root(i) for i in range(len(texts))}


@pytest.mark.parametrize(("chunk", "heavy"), [(1024, 32), (16, 3)])
def test_near_stage_is_brute_force_jaccard(spark, tmp_path, monkeypatch, chunk, heavy):
    monkeypatch.setattr(near_text, "CHUNK_TEXTS", chunk)
    monkeypatch.setattr(near_text, "HEAVY", heavy)
    if chunk == 16:
        monkeypatch.setattr(near_text, "BROADCAST_TEXTS", 0)
    rng = np.random.default_rng(21)
    texts = [None, "", "one", "one two three", "One  two three"]
    for size in (30, 60, 120, 240):
        for _ in range(6):
            words = prose(rng, size).split()
            texts.append(" ".join(words))
            for _ in range(8):  # 0.6 to 0.98 like the first
                near = list(words)
                for at in rng.choice(size, max(1, int(size * rng.uniform(0.004, 0.05))), replace=False):
                    near[at] = f"changed{rng.integers(0, 10**6)}"
                texts.append(" ".join(near))
    hot = prose(rng, 200).split()
    for k in range(60):
        texts.append(" ".join([*hot[: 60 + k], f"new{k}", *hot[60 + k :]]))
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(path)
    kept = corpus_pipeline.near_stage(spark, spark.read.parquet(path), "")
    assert kept.columns == corpus_pipeline.COLUMNS
    assert {r.doc_id for r in kept.collect()} == groups(texts)


def test_common_counts_are_those_of_sets():
    rng = np.random.default_rng(1)
    for heavy in (2, 5, 40):
        near_text.HEAVY, before = heavy, near_text.HEAVY
        sets = [np.unique(rng.integers(0, 60, int(k))) for k in rng.integers(1, 40, 30)]
        got = near_text.common_counts(np.concatenate(sets), np.repeat(np.arange(30), [len(x) for x in sets]), 30)
        near_text.HEAVY = before
        assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(30) for j in range(30) if i != j)


def test_keys_do_not_depend_on_what_comes_together(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 2**63, int(k)).astype(np.uint64) for k in rng.integers(1, 300, 20)]
    begin = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    whole = near_text.set_keys(begin, np.concatenate(sets))
    monkeypatch.setattr(near_text, "AT_ONCE", 64)
    assert (near_text.set_keys(begin, np.concatenate(sets)) == whole).all()
    assert all((near_text.set_keys(np.array([0, len(x)]), x)[0] == w).all() for x, w in zip(sets, whole, strict=True))


def test_simhash_proposes_and_the_sets_decide(spark, monkeypatch):
    """Without a single MinHash key, op4's links still bring near copies together; of what it links, only similar sets are one group."""
    rng = np.random.default_rng(8)
    monkeypatch.setattr(near_text, "keyed", lambda sets, keep, real=near_text.keyed: real(sets, keep).withColumn("keys", F.array().cast("array<bigint>")))
    long = prose(rng, 900).split()
    texts = [" ".join(long), " ".join([*long[:-1], "other"]), prose(rng, 200), "one two three", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_text.dedup_near(docs).collect()) == [0, 2, 3, 4]
