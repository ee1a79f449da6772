"""Scans of active entities and lookups by name: what they find, and what they read."""

from draftmill.operators.entities import Entities

NAMES = ["plain", "O'Brien", 'a "quoted" name', "x' OR '1'='1", "back\\slash", "É", "", "50%_*"]


def table(spark, tmp_path):
    rows = [(k, NAMES[k % len(NAMES)], k % 3 != 0, "t") for k in range(64)] + [(100, None, True, "t"), (101, "plain", None, "t")]
    df = spark.createDataFrame(rows, "id long, name string, active boolean, type string")
    found = Entities(str(tmp_path / "entities"), df.schema)
    found.save(df)
    return rows, found


def test_scan_and_names(spark, tmp_path):
    rows, found = table(spark, tmp_path)
    assert {tuple(r) for r in found.scan(spark).collect()} == {r for r in rows if r[2]}
    for name in [*NAMES, "nobody"]:
        assert {tuple(r) for r in found.named(spark, name).collect()} == {r for r in rows if r[2] and r[1] == name}
    wanted = spark.createDataFrame([(n,) for n in [*NAMES, "nobody", None, "plain"]], "customer string")
    want = {n: min((r[0] for r in rows if r[2] and r[1] == n), default=None) for n in [*NAMES, "nobody"]}
    assert {r.name: r.id for r in found.find(wanted, "id").collect()} == want


def test_only_matching_folders_are_read(spark, tmp_path):
    _, found = table(spark, tmp_path)

    def files(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        df.collect()
        scans = df._jdf.queryExecution().executedPlan().collectLeaves()
        return plan, sum(scans.apply(k).metrics().apply("numFiles").value() for k in range(scans.size()))

    everything = len(list((tmp_path / "entities").glob("active=*/bucket=*/*.parquet")))
    plan, read = files(found.named(spark, "O'Brien"))
    assert read == 1 < everything and "PartitionFilters: [isnotnull(active" in plan and "EqualTo(name,O'Brien)" in plan
    _, read = files(found.scan(spark))
    assert read == len(list((tmp_path / "entities").glob("active=true/bucket=*/*.parquet"))) < everything
