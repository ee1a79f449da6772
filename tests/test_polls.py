"""What a job keeps from poll to poll: mails in progress, failures set aside, retries."""

import json

import pytest
from pyspark.sql import functions as F

from draftmill.operators import commits, routing
from draftmill.streaming import failures, intake
from draftmill.streaming.mails import finished
from tests.test_intake import submissions

ITEMS = "file long, rid long, items long, route string, message_id string"


def test_a_mail_moves_once_with_its_last_item(spark, tmp_path):
    """Items over four polls, one of them run again after all earlier results are gone."""
    polls = [
        [(1, 3, 4, "processed", "<c>"), (2, 1, 1, "failed", None), (3, 9, 2, "failed", "<z>")],
        [(1, 2, 4, "duplicate", None), (None, 7, 1, "processed", "<lost>")],
        [],
        [(1, 4, 4, "failed", "<d>"), (1, 1, 4, "manual_review", "<a>"), (3, 8, 2, "failed", "<y>"), (4, 1, 2, "processed", "<w>")],
    ]
    got = []
    for number in (0, 1, 1, 2, 3):
        out = finished(spark.createDataFrame(polls[number], ITEMS), str(tmp_path), number)
        got.append(sorted((r.file, r["items"], r.succeeded, r.failed, r.folder, tuple(r.message_ids)) for r in out.collect()))
    assert got == [[(2, 1, 0, 1, "Failed", ())], [], [], [], [(1, 4, 3, 1, "ManualReview", ("<a>", "<c>", "<d>")), (3, 2, 0, 2, "Failed", ("<y>", "<z>"))]]


def test_the_job_moves_mails_whose_items_come_over_polls(spark, tmp_path):
    rows = submissions(spark).withColumns({"items": F.lit(12).cast("long"), "message_id": F.concat(F.lit("<"), "rid", F.lit(">"))})
    handle = intake.intake(str(tmp_path), "1998-08-02")
    for number in range(3):
        handle(rows.where(F.col("rid") % 3 == number), number)
        assert commits.read(spark, str(tmp_path), "moves").count() == (0 if number < 2 else 5)
    ends = {r.file: r for r in commits.read(spark, str(tmp_path), "moves").collect()}
    routes = commits.read(spark, str(tmp_path), "logs").withColumnRenamed("event_type", "route").withColumn("file", F.col("rid") % 5)
    want = {r.file: r.folder for r in routing.batch_outcome(routes).collect()}
    assert {k: r.folder for k, r in ends.items()} == want
    assert all(list(r.message_ids) == [f"<{k}>" for k in range(f, 60, 5)] for f, r in ends.items())


def test_unreadable_records_become_dead_letters(spark, tmp_path):
    """A broken line and a file of other content: the poll goes on, and both are on record."""
    rows = submissions(spark, 6)
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    lines = [json.dumps(json.loads(r), default=str) for r in rows.toJSON().collect()]
    (inbox / "good.json").write_text("\n".join(lines[:4]))
    (inbox / "half.json").write_text(lines[4] + "\n" + lines[5][:40] + "\n")
    (inbox / "image.json").write_bytes(b"\x89PNG\r\x1a\x00\x00 not json")
    intake.poll(failures.landing(spark, str(inbox), rows.schema), intake.intake(out, "1998-08-02"), str(tmp_path / "at"), once=True).awaitTermination()
    dead = [(r.rid < 0, r.attempt, r.error) for r in commits.read(spark, out, "dead").collect()]
    assert {e for _, _, e in dead} == {"unreadable record in half.json", "unreadable record in image.json", "err"} - ({"err"} if all(json.loads(x).get("error") is None for x in lines[:5]) else set())
    logs = commits.read(spark, out, "logs")
    assert {r.rid for r in logs.where("rid >= 0").collect()} == {0, 1, 2, 3, 4}
    assert commits.read(spark, out, "checks").where("status = 'failed' and rid < 0").count() == sum(neg for neg, _, _ in dead) >= 2


def test_retries_wait_for_their_timers(spark, tmp_path):
    """Delays of 1 and 2 seconds on the polls' clock, a status that is never retried, no response at all, and a poll that runs again."""
    schema = "rid long, attempt int, status int, error string"
    polls = [
        (1, 100, [(1, 1, 500, "a"), (2, 1, 404, "b"), (3, 1, None, "c")], {(2, 1, "dead", "b")}),
        (2, 101, [], set()),  # due at 101: not before the clock has passed it
        (2, 101, [], set()),
        (3, 102, [], {(1, 2, "retry", "a"), (3, 2, "retry", "c")}),
        (4, 103, [(1, 2, 503, "a2")], set()),
        (5, 105, [], set()),
        (6, 200, [], {(1, 3, "retry", "a2")}),
        (7, 300, [(1, 3, 503, "a3")], {(1, 3, "dead", "a3")}),
    ]
    for number, now, rows, want in polls:
        got = failures.retries(spark.createDataFrame(rows, schema), str(tmp_path), number, now, F.col("status"))
        assert {tuple(r) for r in got.collect()} == want, number


@pytest.mark.parametrize("column", ["attempt", None])
def test_dead_letters_tell_the_attempt(spark, column):
    rows = spark.createDataFrame([(1, "failed", "e", 2), (2, "processed", None, 1), (3, "failed", None, None)], "rid long, route string, error string, attempt int")
    out = failures.dead_letters(rows if column else rows.drop("attempt")).collect()
    assert sorted((r.rid, r.attempt) for r in out) == ([(1, 2), (3, 1)] if column else [(1, 1), (3, 1)])


def test_retries_are_grouped_and_not_called_row_by_row(spark, tmp_path):
    """Many failures at once: no Python worker takes part, what waits goes on from poll to poll, and tables of earlier polls' waiting rows go."""
    schema = "rid long, attempt int, status int, error string"
    many = spark.range(5000).select(F.col("id").alias("rid"), F.lit(1).alias("attempt"), F.lit(500).alias("status"), F.lit("x").alias("error"))
    none, home = spark.createDataFrame([], schema), str(tmp_path)
    assert failures.retries(many, home, 1, 100, F.col("status")).count() == 0
    again = failures.retries(spark.createDataFrame([(7, 1, 404, "y"), (8, 2, 503, "z")], schema), home, 2, 101, F.col("status"))
    assert [tuple(r) for r in again.collect()] == [(7, 1, "dead", "y")]
    woken = failures.retries(none, home, 3, 102, F.col("status"))
    assert sorted(r.rid for r in woken.where("outcome = 'retry' and attempt = 2").collect()) == [k for k in range(5000) if k not in (7, 8)]
    assert [tuple(r) for r in failures.retries(none, home, 4, 104, F.col("status")).collect()] == [(8, 3, "retry", "z")]
    assert not (tmp_path / "retries" / "batch=1" / "stays=true").exists()
    assert not (tmp_path / "retries-state").exists() and not (tmp_path / "failures-state").exists()


def test_mails_are_grouped_and_not_called_one_by_one(spark, tmp_path):
    """Many mails over three polls, most of them in none of the second's rows; no state of single mails is left, nor earlier polls' queues."""
    items = spark.range(6000).select((F.col("id") % 2000).alias("file"), F.col("id").alias("rid"), F.lit(3).alias("items"), F.when(F.col("id") % 5 == 0, "failed").otherwise("processed").alias("route"), F.concat(F.lit("<"), "id", F.lit(">")).alias("message_id"))
    got = [finished(items.where(f"rid >= {a} and rid < {b}"), str(tmp_path), number) for number, (a, b) in enumerate([(0, 3990), (3990, 4000), (4000, 6000)])]
    assert [x.count() for x in got] == [0, 0, 2000]
    want = {f: (sum(k % 5 == 0 for k in (f, f + 2000, f + 4000)), [f"<{k}>" for k in (f, f + 2000, f + 4000)]) for f in range(2000)}
    assert {r.file: (r.failed, list(r.message_ids)) for r in got[2].collect()} == want
    assert not (tmp_path / "items-state").exists() and not (tmp_path / "mails" / "batch=0" / "stays=true").exists()
