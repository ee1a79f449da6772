"""The store for lookups: latest rows before and after compaction, work in proportion to what is new, files that lookups read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftmill.operators import buckets, store
from draftmill.sources import workdir

SCHEMA = "a string, b long, status string, confidence int, version long"


def batches(spark, n=3, rows=60, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for number in range(n):
        keys = {(f"k{x % 7}" if x % 9 else None, int(x)) for x in rng.integers(0, 80, rows if number == 0 else 12)}
        out.append([(a, b, ["pending", "done", "failed"][int(rng.integers(3))], int(b) % 50 if b % 4 else None, number) for a, b in sorted(keys, key=str)])
    return out, [spark.createDataFrame(x, SCHEMA) for x in out]


def latest(rows):
    return {(a, b): (a, b, s, c, v) for batch in rows for a, b, s, c, v in batch}


def test_latest_rows_survive_compaction(spark, tmp_path):
    rows, frames = batches(spark, 5)
    table = buckets.Store(str(tmp_path), frames[0].schema, ("a", "b"), "version", 8)
    assert table.read(spark).count() == 0 and table.compact(spark) == 0
    for number, frame in enumerate(frames):
        table.append(frame, number)
        table.append(frame, number)  # again
        want = sorted(map(repr, latest(rows[: number + 1]).values()))
        assert sorted(repr(tuple(r)) for r in table.read(spark).collect()) == want
        if number in (1, 3):
            assert table.compact(spark) > 0 and table.compact(spark) == 0
            assert sorted(repr(tuple(r)) for r in table.read(spark).collect()) == want
    # A reader that began before the last compaction still finds its files.
    assert set(workdir.batches(spark, f"{tmp_path}/deltas")) == {2, 3, 4}


def test_compaction_writes_only_buckets_with_new_rows(spark, tmp_path):
    _, frames = batches(spark)
    table = buckets.Store(str(tmp_path), frames[0].schema, ("a", "b"), "version", 32)
    table.append(frames[0], 0)
    first = table.compact(spark)
    table.append(frames[1].limit(1), 1)
    assert table.compact(spark) == 1 < first
    assert len(workdir.folders(spark, f"{tmp_path}/bases/batch=1")) <= 3  # a bucket, and the marks of a write
    assert table.read(spark).count() >= frames[0].count()


def test_a_broken_compaction_leaves_the_old_base(spark, tmp_path, monkeypatch):
    rows, frames = batches(spark)
    table = buckets.Store(str(tmp_path), frames[0].schema, ("a", "b"), "version", 4)
    table.append(frames[0], 0)
    table.compact(spark)
    table.append(frames[1], 1)
    real = spark.createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **b: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        table.compact(spark)  # before its manifest
    monkeypatch.undo()
    assert real is not None and table._bases(spark) and {b for b, _ in table._bases(spark).values()} == {0}
    want = sorted(map(repr, latest(rows[:2]).values()))
    assert sorted(repr(tuple(r)) for r in table.read(spark).collect()) == want
    table.compact(spark)
    assert sorted(repr(tuple(r)) for r in table.read(spark).collect()) == want


def test_a_lookup_reads_one_bucket_and_filters_in_the_scan(spark, tmp_path):
    rows, frames = batches(spark)
    table = buckets.Store(str(tmp_path), frames[0].schema, ("a", "b"), "version", 16)
    for number, frame in enumerate(frames):
        table.append(frame, number)
    row = next(r for r in latest(rows).values() if r[0] is not None)
    found = table.lookup(spark, row[0], row[1])
    assert [tuple(r) for r in found.collect()] == [row]
    files = found.inputFiles()
    assert 0 < len(files) <= 3 and len({f.rsplit("bucket=", 1)[1].split("/")[0] for f in files}) == 1
    plan = found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters" in plan and "EqualTo(b," in plan
    assert table.lookup(spark, "nobody", 1).count() == 0
    wanted = spark.createDataFrame([r[:2] for r in list(latest(rows).values())[:5]] + [("x", 5), (None, 1)], "a string, b long")
    assert {tuple(r) for r in table.known(wanted).collect()} == {r for r in list(latest(rows).values())[:5] if r[0] is not None}


def test_kept_statistics_follow_inserts_changes_and_reruns(spark, tmp_path):
    rows, frames = batches(spark, 4, seed=3)
    frames = [f.dropna(subset=["a"]) for f in frames]
    table = buckets.Store(str(tmp_path / "t"), frames[0].schema, ("a", "b"), "version", 4)
    key = F.concat_ws("/", "a", "b")
    for number in (0, 1, 1, 2, 3):
        old, new = table.known(frames[number], before=number).withColumn("key", key), frames[number].withColumn("key", key)
        store.changed_statistics(old, new, "key").write.mode("overwrite").parquet(f"{tmp_path}/s/batch={number}")
        table.append(frames[number], number)
        if number == 2:
            table.compact(spark)
        got = store.shown_statistics(store.kept_statistics(spark.read.parquet(f"{tmp_path}/s").drop("batch"))).first()
        now = table.read(spark)
        want = store.statistics(now.withColumnRenamed("status", "route")).first()
        assert (got.total, got.by_status, got.mean_confidence) == (want.total, want.by_status, want.mean_confidence)


def test_calls_in_flight_are_those_of_a_loop(spark):
    rng = np.random.default_rng(2)
    calls = [(int(a), int(a + b)) for a, b in zip(rng.integers(7000, 11_000, 300), rng.integers(0, 500, 300), strict=True)]
    got = {r.minute: r.most for r in store.calls_in_flight(spark.createDataFrame(calls, "start long, end long"), block=600).collect()}
    want = {}
    for a, b in calls:
        if a < b:
            want[a // 60] = max(want.get(a // 60, 0), sum(x <= a < y for x, y in calls))
    assert got == want
    assert store.calls_in_flight(spark.createDataFrame([], "start long, end long")).count() == 0
