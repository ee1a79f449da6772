"""The data source of mail exports, in batch and as a stream that is stopped and started."""

import json

import pytest

from draftmill.sources import files, mail_export


@pytest.fixture
def source(spark):
    spark.dataSource.register(mail_export.MailExport)
    return spark


def line(k, *names):
    return json.dumps({"uid": f"u{k}", "received": "2024-01-15T10:30:00", "message_id": f"<m{k}>", "attachments": [{"filename": n, "content_type": "application/pdf"} for n in names]})


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_every_line_is_in_one_range(tmp_path, monkeypatch, size):
    monkeypatch.setattr(mail_export, "RANGE", size)
    texts = [line(k, *["é.pdf"] * (k % 3)) for k in range(9)]
    (tmp_path / "a.json").write_text("\n".join(texts[:5]) + "\n\n")
    (tmp_path / "b.json").write_text("\n".join(texts[5:]))
    (tmp_path / "_hidden").write_text("x")
    parts = mail_export.ranges(str(tmp_path), "", 0, None, None)
    assert [r[0] for p in parts for r in mail_export.mails(p)] == [f"u{k}" for k in range(9)]


def test_batch_reads_mails_and_keeps_what_is_none(source, tmp_path):
    odd = ["{", "[1]", '{"uid":7,"attachments":null}', '{"uid":"x","attachments":[1]}', "", '{"uid":"y"}']
    (tmp_path / "a.json").write_text("\n".join([line(1, "a.pdf", "b.txt"), *odd]))
    rows = source.read.format("mail_export").load(str(tmp_path)).collect()
    assert [(r.uid, r.unreadable) for r in rows] == [("u1", None), (None, "{"), (None, "[1]"), ("7", None), (None, odd[3]), ("y", None)]
    found = files.attachments(source.read.format("mail_export").load(str(tmp_path))).collect()
    assert [(r.uid, r.filename, list(r.message_ids)) for r in found] == [("u1", "a.pdf", ["<m1>"])]
    assert source.read.format("mail_export").load(str(tmp_path / "none")).count() == 0


def test_a_stream_goes_on_where_it_stopped(source, tmp_path):
    """New exports, lines that are appended, and a half-written line, which waits."""
    inbox = tmp_path / "in"
    inbox.mkdir()

    def poll():
        rows = files.attachments(source.readStream.format("mail_export").load(str(inbox)))
        rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.uid for r in source.read.schema(rows.schema).parquet(str(tmp_path / "out")).collect())

    (inbox / "1.json").write_text(line(1, "a.pdf") + "\n" + line(2, "a.pdf", "b.pdf") + "\n" + line(3, "c.pdf")[:20])
    assert poll() == ["u1", "u2", "u2"]
    assert poll() == ["u1", "u2", "u2"]
    with (inbox / "1.json").open("a") as f:
        f.write(line(3, "c.pdf")[20:] + "\n")
    (inbox / "2.json").write_text(line(4) + "\n" + line(5, "e.pdf") + "\n")
    assert poll() == ["u1", "u2", "u2", "u3", "u5"]
