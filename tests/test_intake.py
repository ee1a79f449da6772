"""Unit vectors, independent loops and properties of the intake engine."""

import base64
import hashlib
import json
import zlib
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from draftmill.functions import ids, scalars, validation
from draftmill.operators import commits, dedup, detect, extraction, outcomes, payload, routing, scoring, store
from draftmill.plans.settings import Settings
from draftmill.sources import files
from draftmill.streaming import intake


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


# ---------------------------------------------------------------- identifiers


def test_hash_id_and_doc_number(spark):
    text = "123456789" + "987654" + "1001" + "01/15/2024" + "150.0"
    assert one(spark, ids.hash_id(F.col("t")), t=text) == "JeKmWvmOMHYALkVB"
    assert one(spark, ids.doc_number(F.col("t")), t=text) == "F97089F7E788375E2B2BD"
    want = base64.urlsafe_b64encode(hashlib.sha256(f"{text}|2".encode()).digest()[:12]).decode()
    assert one(spark, ids.hash_id(F.col("t"), F.lit(2)), t=text) == want


def test_reversible_id_round_trip(spark):
    rows = [("1001", "150.00", "01/15/2024", "9", "123456789"), (None, None, None, None, None), ("é", "1", "x", "y", "12")]
    df = spark.createDataFrame(rows, "a string, m string, d string, c string, r string")
    s = ids.reversible_id(F.col("a"), F.col("m"), F.col("d"), F.col("c"), F.col("r"))
    out = df.select("*", s.alias("s")).select("*", ids.decode(F.col("s")).alias("p")).collect()
    for r in out:
        assert (r.p.cn, r.p.dt, r.p.cid) == (r.a, r.d, r.c) and r.p.amt == (r.m or "None") and r.p.rn == (r.r or "")[-4:]
    assert json.loads(base64.urlsafe_b64decode(out[0].s + "=" * (-len(out[0].s) % 4))) == {"cn": "1001", "amt": "150.00", "dt": "01/15/2024", "cid": "9", "rn": "6789"}
    assert one(spark, ids.decode(F.lit("!!"))) in (None,) or one(spark, ids.decode(F.lit("!!")))["cn"] is None


def test_colliding_texts_get_suffixes(spark):
    df = spark.createDataFrame([(1, "12", "3", "c", "d", "e"), (2, "1", "23", "c", "d", "e"), (3, "9", "9", "c", "d", "e")], "rid int, routing_number string, account_number string, check_number string, check_date string, amount string")
    out = {r.rid: r for r in dedup.with_hash_ids(df).collect()}
    assert [out[k].occurrence for k in (1, 2, 3)] == [0, 1, 0] and len({r.check_id for r in out.values()}) == 3


def test_numbering_crosses_blocks(spark):
    df = spark.createDataFrame([(k, "a" if k % 3 else "b") for k in range(0, 400, 2)], "rid long, t string")
    got = {r.rid: r.n for r in dedup.numbered(df, "t", "rid", "n", block=16).collect()}
    seen = {"a": 0, "b": 0}
    for k in range(0, 400, 2):
        t = "a" if k % 3 else "b"
        assert got[k] == seen[t]
        seen[t] += 1


# -------------------------------------------------------------------- scalars


def test_dates(spark):
    rows = [("1/5/2024", "2024-01-05"), ("01/05/24", None), ("13/40/2024", None), ("", None), (None, None)]
    df = spark.createDataFrame([(a,) for a, _ in rows], "s string")
    out = [r.x for r in df.select(F.date_format(scalars.us_date(F.col("s")), "yyyy-MM-dd").alias("x")).collect()]
    assert out == [b for _, b in rows]
    as_of = F.lit("1998-08-02").cast("date")
    assert one(spark, scalars.iso_from_any(F.lit("2024-01-05"), as_of)) == "2024-01-05"
    assert one(spark, scalars.iso_from_us(F.lit("2024-01-05"), as_of)) == "1998-08-02"


@pytest.mark.parametrize(
    ("raw", "want"),
    [("a@b", ["<a@b>"]), ("<a@b>", ["<a@b>"]), ('"<a@b>"', ["<a@b>"]), ("  <a@b>  ", ["<a@b>"]), ("<a@b>, <c@d>;e@f", ["<a@b>", "<c@d>", "<e@f>"]), (" ,; ", [])],
)
def test_message_ids(spark, raw, want):
    assert one(spark, scalars.message_ids(F.col("r")), r=raw) == want


@pytest.mark.parametrize(("amount", "want"), [("1234.5", "$1,234.50"), ("", "N/A"), (None, "N/A"), ("abc", "abc"), ("0", "$0.00")])
def test_money(spark, amount, want):
    assert one(spark, scalars.money(F.lit(amount).cast("string"))) == want


def test_names_and_addresses(spark):
    n = F.lit(None).cast("string")
    assert one(spark, scalars.payor_name(n, F.lit(" "), F.lit(" Ann"), F.lit(""), F.lit("Lee "))) == "Ann Lee"
    assert one(spark, scalars.payor_name(n, n, n, n, n)) == "Unknown"
    assert one(spark, payload.bill_address(F.lit(""), n, n, n, n)) is None
    assert one(spark, F.to_json(payload.bill_address(F.lit("1 Elm"), n, F.lit("TX"), n, F.lit("")))) == '{"Line1":"1 Elm","CountrySubDivisionCode":"TX"}'
    assert one(spark, scalars.sender_address(F.lit("a@x.org@y"))) == "check_processor@x.org"


# ----------------------------------------------------------------- validation


@pytest.mark.parametrize(("r", "want"), [("021000021", True), ("123456789", False), ("000000000", True), ("12345678", False), (None, False), ("12345678x", False)])
def test_checksum(spark, r, want):
    assert one(spark, validation.routing_checksum(F.lit(r).cast("string"))) is want


@pytest.mark.parametrize(("status", "attempt", "want"), [(500, 0, True), (500, 2, False), (401, 0, False), (None, 1, True), (418, 0, False), (429, 1, True)])
def test_retry(spark, status, attempt, want):
    assert one(spark, validation.should_retry(F.lit(status).cast("int"), F.lit(attempt), 3)) is want


def test_recommendation_boundaries(spark):
    df = spark.createDataFrame([(75.0, 100.0), (74.9, 100.0), (90.0, 50.0)], "overall double, fc_routing_number double").withColumns({"fc_amount": F.lit(None).cast("double"), "fc_check_number": F.lit(90.0)})
    assert [r.action for r in scoring.recommendation(df).collect()] == ["auto_process", "manual_review", "manual_review"]


def test_settings_are_checked():
    assert Settings(log_level="debug").log_level == "DEBUG"
    with pytest.raises(ValueError):
        Settings(environment="moon")
    with pytest.raises(ValueError):
        Settings(log_level="loud")


# ----------------------------------------------------------------- extraction


@pytest.mark.parametrize(
    ("broken", "want"),
    [
        ('{check_number: "1" "date": null}', {"check_number": "1", "date": None}),
        ('{"a": true "b": false\n"c": null "d": 1.5e-3 "e": -2 "f": {} "g": []}', {"a": True, "b": False, "c": None, "d": 0.0015, "e": -2, "f": {}, "g": []}),
        ('{"truest": "elsefalse", refuse: "x null", "nul": "a\\" b: \\"c"}', {"truest": "elsefalse", "refuse": "x null", "nul": 'a" b: "c'}),
        ('{"text": "key: value, other : {x: 1} \\"q\\" :", n: [1, {m: 2}]}', {"text": 'key: value, other : {x: 1} "q" :', "n": [1, {"m": 2}]}),
        ('{"a": [1, 2] b: "c"}', {"a": [1, 2], "b": "c"}),
        ('{"a":"é⑆", b :"z"}', {"a": "é⑆", "b": "z"}),
    ],
)
def test_repair(spark, broken, want):
    assert json.loads(one(spark, extraction.repair(F.lit(broken)))) == want


def test_repair_changes_no_valid_json(spark):
    rng = np.random.default_rng(2)
    bits = ["true", 'say "x" : y', "a: b", "{", "}", ",", "null", "\\", "e", "0", "f\n"]

    def value(depth):
        k = int(rng.integers(0, 7 if depth else 5))
        if k < 5:
            return [None, True, -1.5, "".join(rng.choice(bits, 4)), 12][k]
        return [value(depth - 1) for _ in range(3)] if k == 5 else {"".join(rng.choice(bits, 3)): value(depth - 1) for _ in range(3)}

    meant = [{f"k{i}": value(2) for i in range(4)} for _ in range(200)]
    rows = [(i, json.dumps(m, indent=int(rng.integers(0, 3)) or None, ensure_ascii=False)) for i, m in enumerate(meant)]
    for r in spark.createDataFrame(rows, "i int, t string").select("i", extraction.repair(F.col("t")).alias("t")).collect():
        assert json.loads(r.t) == meant[r.i]


def test_repair_takes_long_texts(spark):
    text = '{"raw_text": "' + "word \\n" * 200_000 + '" "a": ' + "[" * 50_000
    assert len(one(spark, extraction.repair(F.lit(text)))) > 1_000_000


def test_records_are_read_field_by_field(spark):
    good = '{"check_number": "7", "amount_numeric": "$1,200.50", "routing_number": "021-000-021", "payor_name": {"full_name": "Ann Lee"}, "confidence": null}'
    rows = [
        (1, good),
        (2, '{check_number: "1" "date": "01/15/2024"}'),
        (3, "no json"),
        (4, None),
        (5, '{"check_number":"2","confidence":85.5,"amounts_match":"maybe","check_age_days":"x","field_confidences":{"payee":"90","memo":null}}'),
        (6, '{"check_number":1,"payor_name":"Ann Lee","payor_address":["x"],"amount_numeric":{"value":3},"raw_text":null}'),
        (7, '{"check_number":"1","confidence":8'),
        (8, "[1, 2]"),
        (9, '"text"'),
        (10, "{}"),
    ]
    out = {r.i: r for r in extraction.flat_fields(extraction.normalise(extraction.parse(spark.createDataFrame(rows, "i int, response string")))).collect()}
    a, b, e, f = (out[k] for k in (1, 2, 5, 6))
    assert (a.parsed, a.amount, a.routing_number, a.confidence, a.customer_name, a.payor.is_joint, a.check_condition, a.error) == ("as_is", 1200.5, "021000021", None, "Ann Lee", False, "fair", None)
    assert (b.parsed, b.check_number, b.check_date, b.field_confidences.payee, b.confidence) == ("repaired", "1", "01/15/2024", 50, 50)
    assert (e.parsed, e.confidence, e.amounts_match, e.age_days, e.field_confidences.payee, e.field_confidences.memo, e.field_confidences.date) == ("as_is", 85.5, None, None, 90, None, 50)
    assert (f.parsed, f.check_number, f.payor, f.payor_address, f.customer_name, f.amount, f.raw_text, f.signature_matches_payor) == ("as_is", "1", None, None, "Ann Lee", None, None, None)
    assert (out[10].parsed, out[10].confidence, out[10].customer_name, out[10].raw_text, out[10].signature_present) == ("as_is", 50, "Unknown", "", False)
    for k in (3, 4, 7, 8, 9):
        x = out[k]
        assert (x.parsed, x.confidence, x.check_condition, x.requires_manual_review, x.field_confidences.memo, x.check_number) == ("failed", 0, "poor", True, 0, None)
        assert x.error and x.raw_text == (rows[k - 1][1] or "")


# ------------------------------------------------------------------ detection


def loop_detect(comps, p=detect.Detector()):
    """The detector as a plain loop over one page."""
    rows = [c for c in comps if not (c["x"] == 0 or c["y"] == 0 or c["x"] + c["w"] == p.width or c["y"] + c["h"] == p.height) and c["area"] >= p.least_area]
    rows.sort(key=lambda c: (c["cy"], c["label"]))
    if not rows:
        return []
    gaps = [b["y"] - (a["y"] + a["h"]) for a, b in zip(rows, rows[1:], strict=False)]
    positive = [g for g in gaps if g > 0]
    cuts = []
    if positive:
        q1, q2, q3 = np.percentile(positive, [25, 50, 75])
        limit = q2 + p.iqr_factor * (q3 - q1)
        cuts = [k for k, g in enumerate(gaps) if g > 0 and g >= limit] or [gaps.index(max(positive))]
    groups, start = [], 0
    for k in [*cuts, len(rows) - 1]:
        groups.append(rows[start : k + 1])
        start = k + 1
    span = lambda g: (min(c["y"] for c in g), max(c["y"] + c["h"] for c in g))
    merged, k = [], 0
    while k < len(groups):
        if k + 1 < len(groups):
            (_, bottom), (top, end) = span(groups[k]), span(groups[k + 1])
            if end - top < p.strip_height and top - bottom < p.strip_gap:
                merged.append(groups[k] + groups[k + 1])
                k += 2
                continue
        merged.append(groups[k])
        k += 1
    found = []
    for g in merged:
        cy = np.array([c["cy"] for c in g])
        kept = [c for c, z in zip(g, np.abs(cy - cy.mean()) / (cy.std() + 1e-10), strict=True) if z <= p.z_limit] or g
        x0, y0 = min(c["x"] for c in kept), min(c["y"] for c in kept)
        x1, y1 = max(c["x"] + c["w"] for c in kept), max(c["y"] + c["h"] for c in kept)
        dx, dy = int((x1 - x0) * p.expand_percent / 100), int((y1 - y0) * p.expand_percent / 100)
        x0, y0, x1, y1 = max(0, x0 - dx), max(0, y0 - dy), min(p.width, x1 + dx), min(p.height, y1 + dy)
        if x1 - x0 >= p.least_width:
            found.append([x0, y0, x1, y1, len(kept)])
    found.sort(key=lambda b: b[1])
    for a, b in zip(found, found[1:], strict=False):
        b[1] = min(max(b[1], a[3] + p.margin), b[3] - 1)
    return [(x0, y0, x1 - x0, y1 - y0, n) for x0, y0, x1, y1, n in found]


def test_detector_equals_the_loop(spark):
    rng = np.random.default_rng(0)
    rows = []
    for page in range(120):
        for label in range(int(rng.integers(0, 40))):
            x, y, w, h = int(rng.integers(0, 2400)), int(rng.choice([0, 100, 700, 1500, 2900, 4400])) + int(rng.integers(0, 300)), int(rng.integers(3, 120)), int(rng.integers(3, 60))
            rows.append((page, label, x, y, w, h, w * h, x + w / 2, y + h / 2))
    df = spark.createDataFrame(rows, "page long, label long, x long, y long, w long, h long, area long, cx double, cy double")
    got = {}
    for r in detect.detect(df).orderBy("page", "det").collect():
        got.setdefault(r.page, []).append((r.x, r.y, r.w, r.h, r.components_used))
    names = ("page", "label", "x", "y", "w", "h", "area", "cx", "cy")
    for page in range(120):
        want = loop_detect([dict(zip(names, r, strict=True)) for r in rows if r[0] == page])
        assert sorted(got.get(page, [])) == sorted(want), page


# ---------------------------------------------------------------- store, routes


def submissions(spark, n=60):
    rows = []
    for k in range(n):
        key = k % 40
        rows.append((k, f"02100002{key % 2}", "12345678", None if key % 9 == 0 else str(100 + key), 10.5 + key, "07/01/1998", 60 + k % 40, 60 + k % 40, True, "good", None, "err" if k % 13 == 5 else None, f"c{key}", "TX", None, k % 5, k % 3))
    schema = "rid long, routing_number string, account_number string, check_number string, amount double, check_date string, confidence int, payee_confidence int, amounts_match boolean, check_condition string, received_on date, error string, customer_name string, state string, memo string, file long, page long"
    return spark.createDataFrame(rows, schema).withColumn("amount", F.col("amount").cast("decimal(12,2)"))


def test_every_row_has_one_route(spark):
    out = routing.judge(submissions(spark), "1998-08-02")
    assert out.count() == 60 and out.where(~F.col("route").isin(*routing.ROUTES)).count() == 0
    seen, want = set(), {}
    for r in out.orderBy("rid").collect():
        key = (r.routing_number, r.account_number, r.check_number, r.check_date)
        want[r.rid] = r.error is None and None not in key and key in seen
        if r.error is None and None not in key:
            seen.add(key)
        assert r.is_duplicate == want[r.rid]


def test_streamed_batches_equal_one_batch(spark, tmp_path):
    rows = submissions(spark)
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        rows.where((F.col("rid") >= 20 * k) & (F.col("rid") < 20 * k + 20)).coalesce(1).write.mode("append").parquet(inbox)
        q = intake.poll(intake.landing(spark, inbox, rows.schema, 1), intake.intake(out, "1998-08-02"), str(tmp_path / "at"), once=True)
        q.awaitTermination()
    got = {r.rid: r.event_type for r in spark.read.parquet(f"{out}/logs").collect()}
    judged = routing.judge(rows, "1998-08-02")
    want = {r.rid: r.route for r in judged.collect()}
    assert got == want
    assert spark.read.parquet(f"{out}/checks").count() == sum(v != "duplicate" for v in want.values())
    assert spark.read.parquet(f"{out}/events").count() == sum(v == "processed" for v in want.values())
    assert {r.file for r in spark.read.parquet(f"{out}/moves").collect()} == {k % 5 for k in range(60)}


def test_a_poll_reads_none_of_the_history(spark, tmp_path):
    """What earlier polls stored may be gone; the state alone tells what came before."""
    rows = submissions(spark).where("error is null and check_number is not null")
    handle, out = intake.intake(str(tmp_path / "out"), "1998-08-02"), tmp_path / "out"
    routes = []
    for number in range(3):
        handle(rows, number)
        routes.append({r.rid: r.event_type for r in spark.read.parquet(f"{out}/logs/batch={number}").collect()})
        for part in ("checks", "logs", "keys", "firsts", "mappings", "events", "moves"):
            for old in (out / part).iterdir():
                old.rename(tmp_path / f"{part}-{old.name}-{number}")
    assert set(routes[0].values()) >= {"processed", "duplicate"}
    assert set(routes[1].values()) == set(routes[2].values()) == {"duplicate"}


def test_a_poll_that_runs_again_gives_the_same(spark, tmp_path):
    rows, handle = submissions(spark), intake.intake(str(tmp_path), "1998-08-02")
    seen = []
    for number in (0, 1, 1):
        handle(rows.where("rid < 30") if number == 0 else rows.where("rid >= 30"), number)
        seen.append({r.rid: r.event_type for r in spark.read.parquet(f"{tmp_path}/logs/batch={number}").collect()})
    assert seen[1] == seen[2] and seen[0] | seen[1] == {r.rid: r.route for r in routing.judge(rows, "1998-08-02").collect()}


def clash(spark, n):
    """Rows of few id texts: mapped, unmapped and manual ones, whose account and check numbers part the same digits elsewhere."""
    rows = []
    for k in range(n):
        digits = f"12345{k % 4}7890123"
        at = 4 + k // 4 % 9
        account, check = digits[:at], digits[at:]
        rows.append((k, "021000021", account, check, Decimal("10.50"), None if k % 4 == 3 else "07/01/1998", 50 if k % 23 == 6 else 90, 90, True, "good", None, None, f"c{k}", "TX", None, k % 5, 0))
    return spark.createDataFrame(rows, submissions(spark, 1).schema)


def loop_ids(rows, unique):
    """{rid: id or None if refused}: what a loop gives that looks up mapped ids, and stored ones where they must be unique."""
    mapped, stored, out = set(), set(), {}
    for r in rows:
        text = "".join("None" if x is None else str(x) for x in (r.routing_number, r.account_number, r.check_number, r.check_date, r.amount))
        count = 0
        while True:
            full = f"{text}|{count}" if count else text
            made = base64.urlsafe_b64encode(hashlib.sha256(full.encode()).digest()[:12]).decode()
            if made not in mapped:
                break
            count += 1
        out[r.rid] = None if unique and made in stored else made
        if out[r.rid]:
            stored.add(made)
            if r.route == "processed" and None not in (r.routing_number, r.account_number, r.check_number, r.check_date, r.amount):
                mapped.add(made)
    return out


@pytest.mark.parametrize("unique", [False, True])
def test_ids_over_three_polls_are_those_of_a_loop(spark, tmp_path, unique):
    """Clashing texts, with all that earlier polls stored taken away; a poll that runs again changes nothing."""
    rows, out = clash(spark, 90), tmp_path / "out"
    handle = intake.intake(str(out), "1998-08-02", Settings(unique_ids=unique))
    got = {}
    for number in (0, 0, 1, 2, 2):
        handle(rows.where((F.col("rid") >= 30 * number) & (F.col("rid") < 30 * number + 30)), number)
        for r in commits.read(spark, str(out), "checks").collect():
            assert got.setdefault(r.rid, r.check_id) == r.check_id
    judged = sorted(routing.judge(rows, "1998-08-02").where("route in ('processed', 'manual_review')").collect(), key=lambda r: r.rid)
    assert {r.route for r in judged} == {"processed", "manual_review"}
    want = loop_ids(judged, unique)
    assert got == {k: v or f"error_{k}" for k, v in want.items()}
    assert any(v is None for v in want.values()) == unique
    once = sorted({r.check_id for r in commits.read(spark, str(out), "mappings").collect()})
    assert len(once) == commits.read(spark, str(out), "mappings").count() and len(once) > 8
    assert {r.check_id for r in outcomes.mappings(outcomes.with_ids(routing.judge(rows, "1998-08-02"), unique=unique)).collect()} == set(once)


def test_two_splits_of_the_same_digits_get_two_ids(spark, tmp_path):
    row = clash(spark, 1).drop("account_number", "check_number", "rid")
    handle = intake.intake(str(tmp_path), "1998-08-02")
    for number, (account, check) in enumerate([("1234", "56"), ("12345", "6")]):
        handle(row.withColumns({"rid": F.lit(number).cast("long"), "account_number": F.lit(account), "check_number": F.lit(check)}), number)
    for name in ("checks", "mappings", "events", "receipts"):
        assert len({r.check_id for r in commits.read(spark, str(tmp_path), name).collect()}) == 2, name


def test_a_batch_commits_as_a_whole(spark, tmp_path, monkeypatch):
    """A failure before any of the writes shows the old state; the next start sweeps, and the batch then gives what an undisturbed one gives."""
    rows, names = clash(spark, 40), [*outcomes.TABLES, "marker"]
    early, late = rows.where("rid < 20"), rows.where("rid >= 20")

    def state(home):
        return {n: sorted(map(repr, commits.read(spark, home, n).collect())) for n in outcomes.TABLES}

    whole, broken = str(tmp_path / "whole"), str(tmp_path / "broken")
    for home in (whole, broken):
        intake.intake(home, "1998-08-02")(early, 0)
    intake.intake(whole, "1998-08-02")(late, 1)
    before, after = state(broken), state(whole)
    assert all(len(after[n]) > len(before[n]) for n in outcomes.TABLES)
    real = DataFrameWriter.parquet
    for k, stop in enumerate(names):

        def failing(self, path, *more, stop=stop, **options):
            if f"/{'commits' if stop == 'marker' else stop}/batch=1" in path:
                raise RuntimeError("lost")
            return real(self, path, *more, **options)

        monkeypatch.setattr(DataFrameWriter, "parquet", failing)
        with pytest.raises(RuntimeError, match="lost"):
            intake.intake(broken, "1998-08-02")(late, 1)
        monkeypatch.setattr(DataFrameWriter, "parquet", real)
        assert state(broken) == before, stop
        assert len([n for n in outcomes.TABLES if (tmp_path / "broken" / n / "batch=1").exists()]) == k
    assert len(commits.sweep(spark, broken, list(outcomes.TABLES))) == len(outcomes.TABLES)
    intake.intake(broken, "1998-08-02")(late, 1)
    assert state(broken) == after
    intake.intake(broken, "1998-08-02")(late, 1)
    assert state(broken) == after and commits.sweep(spark, broken, list(outcomes.TABLES)) == []


def test_a_batch_carries_only_what_it_reads(spark, tmp_path, monkeypatch):
    """Scores and other columns of judged rows are neither held nor shuffled on; the tables stay whole."""
    held, real = {}, DataFrameWriter.parquet

    def watching(self, path, *more, **options):
        if "/held/" in path:
            held[path.rsplit("/", 1)[1]] = set(self._df.columns)
        return real(self, path, *more, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", watching)
    rows = submissions(spark)
    intake.intake(str(tmp_path), "1998-08-02")(rows.withColumn("other", F.lit("x")), 0)
    assert set(held) == {"judged", "settled"} and held["settled"] == held["judged"] | {"check_id", "shareable_id"}
    assert held["judged"] <= set(outcomes.NEEDED)
    judged = routing.judge(rows, "1998-08-02")
    assert {r.rid: r.event_type for r in commits.read(spark, str(tmp_path), "logs").collect()} == {r.rid: r.route for r in judged.collect()}
    want = {r.rid: r.review_reason for r in judged.where("route = 'manual_review'").collect()}
    assert {r.rid: r.error_message for r in commits.read(spark, str(tmp_path), "checks").where("status = 'manual_review'").collect()} == want


def test_updates_refuse_unknown_columns(spark):
    df = submissions(spark).withColumn("updated_at", F.lit(1))
    with pytest.raises(ValueError):
        store.update_rows(df, "rid", df, ["nope; drop"], F.lit(2))


def test_trailing_calls_cross_blocks(spark):
    rng = np.random.default_rng(1)
    at = sorted(int(x) for x in rng.integers(0, 500, 200))
    df = spark.createDataFrame(list(enumerate(at)), "i int, ts long")
    got = {r.i: r.calls for r in store.trailing_calls(df, 60).collect()}
    assert got == {i: sum(t - 60 <= x <= t for x in at) for i, t in enumerate(at)}


def test_text_is_escaped(spark):
    n = F.lit(None).cast("string")
    html = one(spark, payload.details_html(payload.check_info(n, n, n, F.lit("<b>&"), n, n, F.lit(91.0))))
    assert "#2ca01c" in html and "$0.00" in html
    assert "&lt;b&gt;&amp;" in html


# -------------------------------------------------------------------- sources


def test_mail_attachments(spark, tmp_path):
    mail = [
        {"uid": "1", "received": "2024-01-15T10:30:00", "message_id": '"<a@b>"', "attachments": [{"filename": "my:scan.PDF", "content_type": "application/pdf"}, {"filename": "x.doc", "content_type": "application/pdf"}]},
        {"uid": "2", "attachments": []},
        {"uid": "3"},
    ]
    (tmp_path / "m.json").write_text("\n".join(map(json.dumps, mail)))
    out = files.attachments(files.mail(spark, str(tmp_path / "m.json"))).collect()
    assert [(r.uid, r.saved_as, r.message_ids) for r in out] == [("1", "20240115_103000_myscan.PDF", ["<a@b>"])]
    assert files.paths_from(" a.pdf, ,b.pdf,") == ["a.pdf", "b.pdf"]
