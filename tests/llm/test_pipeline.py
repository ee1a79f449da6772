"""Every stage on its own input, against brute force where there is one; nulls, empty and repeated rows throughout."""

import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_near_text import groups
from tests.llm.test_operators import base, messy_rows, prose, strip


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rng = np.random.default_rng(12)
    rows = [(k, t, "en", "s", len(t) if t else None) for k, t in messy_rows()]
    for k in range(100, 400):
        t = prose(rng, 90) if k % 3 else prose(rng, 45) + "\n" + prose(rng, 45).upper().replace(" ", "!! ")
        rows.append((k, t + (f" mail x{k}@y.org" if k % 10 == 1 else ""), None if k % 7 == 0 else "en", "s", len(t)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(100, 400)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    """The rows before and after each stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [("documents", docs)]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs))
    return out


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_keep_the_columns(tables):
    assert [n for n, _ in tables[1:]] == ["quality", "exact_dedup", "near_dedup", "pii", "packing"]
    assert all(d.columns == corpus_pipeline.COLUMNS for _, d in tables[:-1])


def test_quality_rejects_the_marked_kind(tables):
    kept = {k for k, _ in rows_of(tables[1][1])}
    clean, junk = [k for k in range(100, 400) if k % 3], [k for k in range(100, 400) if k % 3 == 0]
    assert np.mean([k in kept for k in clean]) > 0.97 and np.mean([k in kept for k in junk]) < 0.1


def test_exact_dedup_keeps_one_of_each(tables):
    before, after = rows_of(tables[1][1]), rows_of(tables[2][1])
    groups = defaultdict(list)
    for k, t in before:
        groups[strip(t)].append((-len(t or ""), k is None, k or 0))
    assert sorted((k is None, k or 0) for k, _ in after) == sorted(min(g)[1:] for g in groups.values())


def test_near_dedup_keeps_one_of_each(tables):
    before, after = rows_of(tables[2][1]), rows_of(tables[3][1])
    before.sort(key=lambda r: (r[0] is None, r[0] or 0))  # the least id of a group stays
    want = [before[k][0] for k in groups([t for _, t in before])]
    assert sorted((k is None, k or 0) for k, _ in after) == sorted((k is None, k or 0) for k in want)


def test_pii_is_gone_and_clean_text_is_not_touched(tables):
    before, after = dict(rows_of(tables[3][1])), dict(rows_of(tables[4][1]))
    assert set(before) == set(after)
    touched = 0
    for k, t in before.items():
        if base(t or ""):
            touched += 1
            assert not base(after[k]) and re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", after[k])
        else:
            assert after[k] == t
    assert touched > 10
    assert tables[4][1].where(F.col("n_chars") != F.length("text")).count() == 0


def test_packing_covers_all(tables):
    pieces = tables[5][1]
    assert pieces.select("doc_id").distinct().count() == tables[4][1].select("doc_id").distinct().count()
    whole = pieces.groupBy("doc_id").agg(F.sum("length").alias("a"), F.max("doc_tokens").alias("b"))
    assert whole.where("a <> b").count() == 0


def test_stages_take_empty_tables(spark, tables, sf_dir):
    for (_, stage), (_, before) in zip(corpus_pipeline.STAGES, tables[:-1], strict=True):
        assert stage(spark, before.limit(0), sf_dir).count() == 0


def test_run_is_the_stages(spark, tables, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() == tables[-1][1].count()
