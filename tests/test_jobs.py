"""The job runner, and the settings that it refuses."""

import os

import pytest

from draftmill.__main__ import main
from draftmill.operators import routing
from draftmill.plans import fixtures
from draftmill.plans.settings import Settings

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_jobs(spark, tmp_path, capfd):
    assert main(["batch", SF, str(tmp_path / "routes")]) == 0
    routes = {r.route: r["count"] for r in spark.read.parquet(str(tmp_path / "routes")).groupBy("route").count().collect()}
    want = {r.route: r["count"] for r in routing.judge(fixtures.checks_raw(spark, SF), fixtures.AS_OF).groupBy("route").count().collect()}
    assert routes == want and set(routes) == set(routing.ROUTES)
    assert main(["receipts", SF, str(tmp_path / "receipts")]) == 0
    assert spark.read.parquet(str(tmp_path / "receipts")).count() == routes["processed"]
    assert main(["list", SF]) == 0
    assert "name" in capfd.readouterr().out
    for wrong in ([], ["batch"], ["stream", "a"], ["nothing", "a", "b"]):
        assert main(wrong) == 2


def test_settings_are_checked():
    assert Settings(log_level="debug").log_level == "DEBUG"
    for wrong in ({"environment": "moon"}, {"log_level": "LOUD"}):
        with pytest.raises(ValueError):
            Settings(**wrong)


def test_a_payor_without_anything_to_show_keeps_its_title(spark):
    """An address that only has a postal code, and no payor: the section stands empty; without either there is none."""
    from pyspark.sql import functions as F

    from draftmill.operators import extraction, payload

    responses = ['{"check_number":"7","payor_address":{"zip":"1"}}', '{"check_number":"7"}', '{"check_number":"7","payor_name":{"full_name":"Ann"}}']
    df = spark.createDataFrame([(k, r) for k, r in enumerate(responses)], "rid long, response string")
    notes = {r.rid: r.note for r in extraction.flat_fields(extraction.normalise(extraction.parse(df))).select("rid", payload.full_note().alias("note")).orderBy(F.col("rid")).collect()}
    assert "\n\nPayor Information:\n\n" in notes[0] and "Payor" not in notes[1] and "Payor Information:\nName: Ann\n\n" in notes[2]
