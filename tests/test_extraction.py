"""Repair and parsing of extraction responses: what they cost, and odd texts."""

import pytest
from pyspark.sql import functions as F

from draftmill.operators import extraction
from draftmill.plans import fixtures, queries


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{a: 1 "b": "x, c: y" c : true d_1:[1, 2]}', '{"a":1,"b":"x, c: y","c":true,"d_1":[1,2]}'),
        ('{"a": -3 b: {"c": null d: "\\" e: "} f: ""}', '{"a":-3,"b":{"c":null,"d":"\\" e: "},"f":""}'),
        ('{"a" : "cut', '{"a":"cut'),
        ("12abc: -x", '12,"abc":-x'),
        ("", ""),
        (None, None),
    ],
)
def test_repair_of_odd_texts(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(extraction.repair(F.col("t")).alias("r")).first().r == want


def test_repair_of_long_texts(spark):
    """Tens of thousands of tokens and escapes overflow no stack."""
    text = "{" + " ".join(f"k{i}: {i}" for i in range(20000)) + ' z: "' + 'x\\"' * 20000 + '"}'
    want = "{" + ",".join(f'"k{i}":{i}' for i in range(20000)) + ',"z":"' + 'x\\"' * 20000 + '"}'
    assert spark.createDataFrame([(text,)], "t string").select(extraction.repair(F.col("t")).alias("r")).first().r == want


def test_a_filter_does_not_parse_again(spark):
    """One repair and two readings of JSON in the plan, whatever is asked of the outcome, and no function that runs token by token."""
    df = extraction.parse(spark.range(4).select(F.format_string("{a: %d}", "id").alias("response"), "id"))
    plan = df.where("parsed <> 'failed'").select("id", F.col("record")["a"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 2 and plan.count("regexp_replace") == 3
    assert "lambda" not in plan and "regexp_extract_all" not in plan


def test_responses_come_in_tasks_of_bounded_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fixtures, "TASK_ROWS", 100)
    d = "/root/testdata/sf0.001"
    assert queries._responses(spark, d).rdd.getNumPartitions() == -(-fixtures.table(spark, d, "orders").count() // 100)
