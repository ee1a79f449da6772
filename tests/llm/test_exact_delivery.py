"""Exact deduplication over several calls, by state that outlives them."""

import shutil

import pytest
from pyspark.sql import functions as F

from draftmill.llm import exact_dedup
from tests.llm.test_operators import strip

SCHEMA = "doc_id long, text string, source string, digest string, row string"


def deliver(spark, tmp_path, number, rows, **how):
    path = str(tmp_path / f"in{number}")
    spark.createDataFrame([(k, t, "s", "d", "r") for k, t in rows], SCHEMA).repartition(2).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("digest", [None, lambda x: F.substring(F.sha2(x, 256), 1, 1)])
def test_later_deliveries_meet_the_state(spark, tmp_path, digest):
    """Copies of earlier rows go, also where digests of one hex digit make every other text a false hit; a delivery given again gets the same."""
    deliveries = [
        [(1, "a b"), (2, "ab "), (3, None), (4, "long " * 50_000), (5, "x1"), (6, "x2")],
        [(7, "a\tb"), (8, "new"), (9, " n e w"), (10, ""), (11, "long" * 50_000), (None, "x3")],
        [(12, "x3"), (13, "x2"), (14, "x4"), (15, "NEW")] + [(100 + k, f"t{k}") for k in range(40)],
        [(16, "x4"), (17, "x4"), (None, None), (18, "t7"), (19, "last")],
    ]
    home, seen = str(tmp_path / "home"), set()
    for number, rows in enumerate(deliveries):
        docs = deliver(spark, tmp_path, number, rows)
        want = {strip(t) for _, t in rows} - seen
        for _ in range(2):
            out = exact_dedup.dedup_delivery(docs, home, number, **({"digest": digest} if digest else {}))
            assert out.columns == docs.columns
            got = [strip(r.text) for r in out.collect()]
            assert len(got) == len(set(got)) and set(got) == want
        seen |= want


def test_a_call_that_broke_off_is_finished(spark, tmp_path, monkeypatch):
    home = str(tmp_path / "home")
    first = deliver(spark, tmp_path, 0, [(1, "a"), (2, "b")])
    assert exact_dedup.dedup_delivery(first, home, 0).count() == 2
    second = deliver(spark, tmp_path, 1, [(3, "b"), (4, "c")])
    real = exact_dedup._exists
    monkeypatch.setattr(exact_dedup, "_exists", lambda s, p: real(s, p) if p.endswith("_SUCCESS") else (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        exact_dedup.dedup_delivery(second, home, 1)
    monkeypatch.undo()
    assert [r.text for r in exact_dedup.dedup_delivery(second, home, 1).collect()] == ["c"]
    empty = deliver(spark, tmp_path, 2, [])
    assert exact_dedup.dedup_delivery(empty, home, 2).count() == 0
    shutil.rmtree(tmp_path / "home" / "seen")  # results of earlier calls may go, the state may not
    third = deliver(spark, tmp_path, 3, [(5, "c"), (6, "a"), (7, "d")])
    assert [r.text for r in exact_dedup.dedup_delivery(third, home, 3).collect()] == ["d"]
