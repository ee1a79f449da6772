"""Registered queries of the intake engine with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from draftmill.functions import ids, scalars, validation
from draftmill.operators import buckets, commits, dedup, detect, extraction, outcomes, payload, routing, scoring, store
from draftmill.operators.entities import Entities
from draftmill.plans.fixtures import AS_OF, CHECKS_RAW_SQL, CLASHING_SQL, COMPONENTS_SQL, checks_raw, clashing, components, dealt, stored, table
from draftmill.plans.settings import Settings
from draftmill.sources import files
from draftmill.sources.mail_export import MailExport
from draftmill.sources.workdir import folders, move, shared
from draftmill.streaming import failures, intake
from draftmill.streaming.mails import finished

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
S = Settings()


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def judged(spark: SparkSession, d: str) -> DataFrame:
    """The raw rows are derived twice, the second time for their keys alone, which is less than to store them."""
    return routing.judge(checks_raw(spark, d), AS_OF)


def judged_alone(spark: SparkSession, d: str) -> DataFrame:
    """Without duplicates and routes, for what asks for neither."""
    return routing.judge_alone(checks_raw(spark, d), AS_OF)


RAW = f"WITH {CHECKS_RAW_SQL} "
_DIGITS = [f"TRY_CAST(routing_number[{k}] AS INT)" for k in range(1, 10)]
_ABA = f"CASE WHEN regexp_full_match(routing_number, '[0-9]{{9}}') THEN (3 * ({_DIGITS[0]} + {_DIGITS[3]} + {_DIGITS[6]}) + 7 * ({_DIGITS[1]} + {_DIGITS[4]} + {_DIGITS[7]}) + {_DIGITS[2]} + {_DIGITS[5]} + {_DIGITS[8]}) % 10 = 0 ELSE false END"
_DATES = "[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{2,4}"
_DAY = "CAST(coalesce(try_strptime(check_date, '%m/%d/%Y'), try_strptime(check_date, '%Y-%m-%d')) AS DATE)"
JUDGED = (
    RAW
    + f""",
f AS (
  SELECT *, coalesce(routing_number, '') <> '' AS p_r, coalesce(account_number, '') <> '' AS p_a, coalesce(check_number, '') <> '' AS p_c, coalesce(amount <> 0, false) AS p_m, coalesce(check_date, '') <> '' AS p_d,
    coalesce(regexp_full_match(routing_number, '[0-9]{{9}}'), false) AS v_r, coalesce(regexp_full_match(account_number, '[0-9]{{4,17}}'), false) AS v_a,
    coalesce(regexp_full_match(check_number, '[0-9]{{1,6}}'), false) AS v_c, coalesce(amount > 0 AND amount < 1000000, false) AS v_m,
    coalesce(regexp_full_match(check_date, '{_DATES}'), false) AS v_d, {_ABA} AS aba, CAST(DATE '{AS_OF}' - {_DAY} AS INT) AS age_days FROM checks_raw),
s AS (
  SELECT *, CAST(confidence AS DOUBLE) AS char_score, CASE WHEN aba THEN 100e0 ELSE 0e0 END AS checksum_score,
    CASE WHEN p_r OR p_a OR p_c OR p_m OR p_d THEN (CAST(p_r AND v_r AS INT) + CAST(p_a AND v_a AS INT) + CAST(p_c AND v_c AS INT) + CAST(p_m AND v_m AS INT) + CAST(p_d AND v_d AS INT)) * 100e0
         / (CAST(p_r AS INT) + CAST(p_a AS INT) + CAST(p_c AS INT) + CAST(p_m AS INT) + CAST(p_d AS INT)) ELSE 0e0 END AS format_score,
    CASE WHEN p_r THEN (CASE WHEN v_r THEN 50e0 ELSE 0e0 END) + (CASE WHEN aba THEN 50e0 ELSE 0e0 END) END AS fc_routing_number,
    CASE WHEN p_a THEN CASE WHEN v_a THEN 80e0 ELSE 30e0 END END AS fc_account_number, CASE WHEN p_c THEN CASE WHEN v_c THEN 90e0 ELSE 40e0 END END AS fc_check_number,
    CASE WHEN p_m THEN CASE WHEN v_m THEN 85e0 ELSE 35e0 END END AS fc_amount, CASE WHEN p_d THEN CASE WHEN v_d THEN 80e0 ELSE 30e0 END END AS fc_date,
    coalesce(age_days > 180, false) AS is_stale, coalesce(age_days < 0, false) AS is_post_dated FROM f),
t AS (
  SELECT *, round(char_score * 0.4e0 + format_score * 0.2e0 + checksum_score * 0.2e0 + 0e0 * 0.2e0, 6) AS overall,
    confidence < 75 OR coalesce(NOT amounts_match, false) OR coalesce(fc_amount < 60, false) OR coalesce(fc_routing_number < 60, false) OR coalesce(fc_account_number < 60, false) OR coalesce(payee_confidence < 60, false)
      OR check_condition = 'poor' OR is_stale OR is_post_dated AS flagged FROM s),
u AS (
  SELECT *, concat_ws(', ', CASE WHEN is_post_dated THEN 'post-dated (' || abs(age_days) || ' days in future)' END, CASE WHEN is_stale THEN 'stale-dated (' || age_days || ' days old)' END,
    CASE WHEN NOT coalesce(amounts_match, false) THEN 'amounts mismatch' END, CASE WHEN check_condition = 'poor' THEN 'poor condition' END) AS reasons FROM t),
firsts AS (
  SELECT routing_number, account_number, check_number, check_date, min(rid) AS first_rid FROM u
  WHERE error IS NULL AND routing_number IS NOT NULL AND account_number IS NOT NULL AND check_number IS NOT NULL AND check_date IS NOT NULL GROUP BY ALL),
v AS (
  SELECT u.*, first_rid, p_r AND p_c AND error IS NULL AND coalesce(first_rid < rid, false) AS is_duplicate,
    CASE WHEN flagged THEN 'Vertex AI flagged for manual review: ' || CASE WHEN reasons <> '' THEN reasons ELSE 'AI recommendation' END
         WHEN confidence < 70 THEN 'Low OCR confidence (' || printf('%.1f', CAST(confidence AS DOUBLE)) || '%) below threshold 70.0%' END AS review_reason
  FROM u LEFT JOIN firsts USING (routing_number, account_number, check_number, check_date)),
judged AS (
  SELECT *, CASE WHEN error IS NOT NULL THEN 'failed' WHEN is_duplicate THEN 'duplicate' WHEN review_reason IS NOT NULL THEN 'manual_review' ELSE 'processed' END AS route FROM v)
"""
)

# ------------------------------------------------------------------ store


@query("f09_count_by_status", JUDGED + "SELECT route, count(*) AS n FROM judged GROUP BY route")
def count_by_status(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).groupBy("route").agg(F.count("*").alias("n"))


@query("f01_point_lookup", RAW + "SELECT rid, check_number, amount FROM checks_raw WHERE rid = 2000")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return store.by_key(checks_raw(spark, d), "rid", 2000).select("rid", "check_number", "amount")


@query("f02_duplicate_search", RAW + "SELECT n.rid, max_by(h.rid, (h.received_on, h.rid)) AS match_rid, max(h.received_on) AS match_received_on FROM checks_raw n JOIN checks_raw h USING (routing_number, account_number, check_number, check_date) WHERE n.rid % 2 = 1 AND h.rid % 2 = 0 GROUP BY n.rid")
def duplicate_search(spark: SparkSession, d: str) -> DataFrame:
    raw = checks_raw(spark, d)
    return dedup.duplicates_of(raw.where("rid % 2 = 1"), raw.where("rid % 2 = 0"))


@query("f03_by_status_newest", JUDGED + "SELECT rid, route, received_on FROM judged WHERE route = 'manual_review' ORDER BY received_on DESC, rid DESC LIMIT 100")
def by_status_newest(spark: SparkSession, d: str) -> DataFrame:
    return store.by_status(judged(spark, d), "manual_review").select("rid", "route", "received_on")


@query("f05_audit_log", "SELECT event_id AS id, CAST(user_id AS VARCHAR) AS check_id, event_type, props AS event_data, ts AS timestamp FROM events WHERE user_id = 7 ORDER BY ts, event_id")
def audit_log(spark: SparkSession, d: str) -> DataFrame:
    logs = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("check_id"), "event_type", F.col("props").alias("event_data"), F.col("ts").alias("timestamp"))
    return store.log_of(logs, "7")


_TOKENS = "SELECT event_type AS service, max_by(value, (ts, event_id)) AS value, max(ts) AS updated_at, min(ts) AS created_at FROM events GROUP BY event_type"


@query("b05_f06_latest_by_key", _TOKENS)
def latest_by_key(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select(F.col("event_type").alias("service"), "value", F.col("ts").alias("updated_at"), "event_id")
    return store.upsert(log, "service", "updated_at", "created_at", "event_id").select("service", "value", "updated_at", "created_at")


@query("f08_total", RAW + "SELECT count(*) AS total FROM checks_raw")
def total(spark: SparkSession, d: str) -> DataFrame:
    return checks_raw(spark, d).agg(F.count("*").alias("total"))


@query("f10_mean_confidence", RAW + "SELECT round(avg(confidence), 6) AS mean_confidence FROM checks_raw")
def mean_confidence(spark: SparkSession, d: str) -> DataFrame:
    return checks_raw(spark, d).agg(F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query(
    "f12_statistics",
    JUDGED + "SELECT CAST(sum(n) AS BIGINT) AS total, string_agg(route || '=' || n, ',' ORDER BY route) AS by_status, round(CAST(sum(s) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 6) AS mean_confidence FROM (SELECT route, count(*) AS n, sum(confidence) AS s FROM judged GROUP BY route)",
)
def statistics(spark: SparkSession, d: str) -> DataFrame:
    return store.statistics(judged(spark, d))


def _accounts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), (F.col("p_size") % 5 != 0).alias("active"))


@query("f13_grouped_listing", "SELECT p_type AS type, p_name AS name, p_partkey AS id, count(*) OVER (PARTITION BY p_type) AS n FROM part WHERE p_size % 5 <> 0 ORDER BY p_type, p_name, p_partkey")
def grouped_listing(spark: SparkSession, d: str) -> DataFrame:
    return store.grouped_listing(_accounts(spark, d))


@query("f14_a07_active_entities", "SELECT p_partkey AS id, p_name AS name, p_type AS type, true AS active FROM part WHERE p_size % 5 <> 0 ORDER BY p_type, p_name, p_partkey")
def active_entities(spark: SparkSession, d: str) -> DataFrame:
    return store.entity_listing(_accounts(spark, d))


@query(
    "a07_a08_entity_scan",
    """WITH e AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'O''' || p_name || '"' ELSE p_name END AS name, p_size % 5 <> 0 AS active FROM part)
SELECT w.name, (SELECT min(id) FROM e WHERE active AND e.name = w.name) AS id FROM (SELECT DISTINCT name FROM e WHERE id % 2 = 0) w""",
)
def entity_scan(spark: SparkSession, d: str) -> DataFrame:
    """Names looked up in a laid-out table of entities; some have quotes, and some belong to inactive entities only."""
    quoted = F.when(F.col("id") % 3 == 0, F.concat(F.lit("O'"), "name", F.lit('"'))).otherwise(F.col("name"))
    rows = _accounts(spark, d).withColumn("name", quoted)
    found = Entities(shared(spark, "entities"), rows.schema)
    found.save(rows)
    return found.find(rows.where("id % 2 = 0").select("name"), "id")


_CUSTOMERS = "SELECT rid, customer_name, (SELECT min(c_custkey) FROM customer c WHERE c.c_name = r.customer_name AND c_custkey % 7 <> 0) AS customer_id FROM checks_raw r"


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("display_name"))


@query("a08_find_customer", RAW + _CUSTOMERS)
def find_customer(spark: SparkSession, d: str) -> DataFrame:
    return store.find_customers(checks_raw(spark, d), _customers(spark, d)).select("rid", "customer_name", "customer_id")


@query("b11_customers_to_create", RAW + "SELECT DISTINCT customer_name FROM checks_raw WHERE customer_name NOT IN (SELECT c_name FROM customer WHERE c_custkey % 7 <> 0)")
def customers_to_create(spark: SparkSession, d: str) -> DataFrame:
    return store.customers_to_create(checks_raw(spark, d), _customers(spark, d))


_LISTED = "check_id shareable_id check_number routing_number account_number amount check_date customer_name customer_id email_uid email_from email_subject email_received_at ocr_confidence status image_path image_filename created_at updated_at metadata".split()
_GIVEN = {"check_id": "'c' || rid", "check_number": "check_number", "routing_number": "routing_number", "account_number": "account_number", "amount": "amount", "check_date": "check_date", "customer_name": "customer_name", "email_uid": "CAST(file AS VARCHAR)", "ocr_confidence": "confidence", "status": "CASE WHEN rid % 4 = 0 THEN 'processed' ELSE 'pending' END", "created_at": "TIMESTAMP '1998-08-02 00:00:00'", "updated_at": "TIMESTAMP '1998-08-02 00:00:00'"}


@query("b01_insert_listed", RAW + "SELECT " + ", ".join(f"{_GIVEN.get(c, 'CAST(NULL AS VARCHAR)')} AS {c}" for c in _LISTED) + " FROM checks_raw")
def insert_listed(spark: SparkSession, d: str) -> DataFrame:
    """The 20 columns of a plain insert; what else the rows have is dropped, what they lack is null."""
    rows = checks_raw(spark, d).withColumns({"check_id": F.concat(F.lit("c"), F.col("rid").cast("string")), "email_uid": F.col("file").cast("string"), "ocr_confidence": F.col("confidence"), "status": F.when(F.col("rid") % 4 == 0, "processed"), "processed_at": F.lit("dropped")})
    return store.insert_rows(rows, F.lit(AS_OF).cast("timestamp_ntz"), listed_only=True)


@query("b01_insert", RAW + "SELECT rid, 'pending' AS status, TIMESTAMP '1998-08-02 00:00:00' AS created_at, TIMESTAMP '1998-08-02 00:00:00' AS updated_at FROM checks_raw")
def insert(spark: SparkSession, d: str) -> DataFrame:
    return store.insert_rows(checks_raw(spark, d), F.lit(AS_OF).cast("timestamp_ntz")).select("rid", "status", "created_at", "updated_at")


@query("b02_update", RAW + "SELECT rid, CASE WHEN rid % 9 = 0 THEN 'x' ELSE memo END AS memo, CASE WHEN rid % 9 = 0 THEN DATE '1998-08-03' ELSE DATE '1998-08-02' END AS updated_at FROM checks_raw")
def update(spark: SparkSession, d: str) -> DataFrame:
    rows = checks_raw(spark, d).select("rid", "memo", F.lit(AS_OF).cast("date").alias("updated_at"))
    return store.update_rows(rows, "rid", rows.where("rid % 9 = 0").select("rid", F.lit("x").alias("memo")), ["memo"], F.lit("1998-08-03").cast("date"))


@query(
    "b03_insert_or_ignore",
    RAW + "SELECT check_number, min(rid) AS rid, min_by(amount, rid) AS amount FROM checks_raw WHERE check_number IS NOT NULL AND amount IS NOT NULL AND check_number NOT IN (SELECT check_number FROM checks_raw WHERE rid % 10 = 0 AND check_number IS NOT NULL) GROUP BY check_number",
)
def insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    raw = checks_raw(spark, d).select("check_number", "rid", "amount")
    return store.insert_or_ignore(raw, raw.where("rid % 10 = 0"), "check_number", ("check_number", "amount"), "rid")


# ------------------------------------------------------------------ scalars


@query("c04_c06_clean_fields", RAW + "SELECT rid, CAST(amount AS DOUBLE) AS amount, CASE WHEN length(routing_number) = 9 THEN routing_number END AS routing_number, account_number FROM checks_raw")
def clean_fields(spark: SparkSession, d: str) -> DataFrame:
    raw = checks_raw(spark, d)
    dirty = raw.select("rid", F.concat(F.lit("$"), F.format_number("amount", 2)).alias("a"), F.concat_ws("-", F.substring("routing_number", 1, 4), F.substring("routing_number", 5, 9)).alias("r"), "routing_number", F.concat(F.lit(" "), "account_number", F.lit(" ")).alias("n"))
    return dirty.select("rid", scalars.parse_amount(F.col("a")).alias("amount"), F.when(F.col("routing_number").isNotNull(), scalars.clean_routing(F.col("r"))).alias("routing_number"), scalars.clean_account(F.col("n")).alias("account_number"))


@query("c10_c18_names", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN trim(c_name) WHEN c_custkey % 3 = 1 THEN 'Ann Lee' ELSE 'Unknown' END AS payor, split_part(c_name, ' ', 1) AS given, CASE WHEN contains(c_name, ' ') THEN split_part(c_name, ' ', -1) ELSE '' END AS family FROM customer")
def names(spark: SparkSession, d: str) -> DataFrame:
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    null = F.lit(None).cast("string")
    payor = scalars.payor_name(F.lit(" "), F.when(k % 3 == 0, F.col("c_name")), F.when(k % 3 == 1, "Ann "), null, F.when(k % 3 == 1, " Lee"))
    return c.select("c_custkey", payor.alias("payor"), scalars.given_name(F.col("c_name")).alias("given"), scalars.family_name(F.col("c_name")).alias("family"))


@query(
    "c12_c13_dates",
    RAW + f"SELECT rid, strftime(coalesce(CAST(try_strptime(check_date, '%m/%d/%Y') AS DATE), DATE '{AS_OF}'), '%Y-%m-%d') AS v1, CASE WHEN try_strptime(check_date, '%m/%d/%Y') IS NULL AND try_strptime(check_date, '%Y-%m-%d') IS NOT NULL THEN check_date ELSE strftime(coalesce(CAST(try_strptime(check_date, '%m/%d/%Y') AS DATE), DATE '{AS_OF}'), '%Y-%m-%d') END AS v2 FROM checks_raw",
)
def dates(spark: SparkSession, d: str) -> DataFrame:
    as_of = F.lit(AS_OF).cast("date")
    return checks_raw(spark, d).select("rid", scalars.iso_from_us(F.col("check_date"), as_of).alias("v1"), scalars.iso_from_any(F.col("check_date"), as_of).alias("v2"))


@query("c11_c20_c22_c23_notice", RAW + "SELECT rid, CASE WHEN amount IS NULL THEN 'N/A' ELSE printf('$%,.2f', amount) END AS amount, CASE WHEN confidence >= 90 THEN '#2ca01c' WHEN confidence >= 70 THEN '#f39c12' ELSE '#e74c3c' END AS colour, coalesce(TRY_CAST(check_date AS DOUBLE), 0e0) AS number, coalesce(check_date, 'N/A') AS date FROM checks_raw")
def notice_formats(spark: SparkSession, d: str) -> DataFrame:
    return checks_raw(spark, d).select("rid", scalars.money(F.col("amount")).alias("amount"), scalars.colour(F.col("confidence")).alias("colour"), scalars.safe_number(F.col("check_date")).alias("number"), F.coalesce("check_date", F.lit("N/A")).alias("date"))


_INFO_SQL = "coalesce(check_number, 'N/A') AS i_number, coalesce(CAST(amount AS VARCHAR), '0') AS i_amount, CASE WHEN rid % 5 = 0 THEN customer_name ELSE 'N/A' END AS i_payee, CASE WHEN rid % 3 = 0 THEN customer_name WHEN rid % 3 = 1 THEN 'Ann ' || state ELSE 'Unknown' END AS i_payor, coalesce(check_date, 'N/A') AS i_date, CAST(confidence AS DOUBLE) AS i_confidence"


def _info() -> Column:
    payor, payee = F.when(F.col("rid") % 3 == 0, F.col("customer_name")), F.when(F.col("rid") % 5 == 0, F.col("customer_name")).otherwise("")
    sender = F.when(F.col("rid") % 3 == 1, F.concat(F.lit('"Ann '), F.col("state"), F.lit('" <ann@bank.example>'))).otherwise("<no@name.example>")
    return payload.check_info(F.col("check_number"), F.col("amount"), payee, payor, sender, F.col("check_date"), F.col("confidence"))


@query("c11_notice", RAW + f"SELECT rid, {_INFO_SQL} FROM checks_raw")
def notice(spark: SparkSession, d: str) -> DataFrame:
    names = ("check_number", "amount", "payee", "payor", "date", "confidence")
    return checks_raw(spark, d).withColumn("i", _info()).select("rid", *(F.col(f"i.{n}").alias(f"i_{n.removeprefix('check_')}") for n in names))


@query("c14_notes", RAW + "SELECT rid, concat_ws(chr(10), 'Memo: ' || memo, 'MICR: ' || routing_number || ' ' || account_number) AS note FROM checks_raw")
def notes(spark: SparkSession, d: str) -> DataFrame:
    micr = F.concat("routing_number", F.lit(" "), "account_number")
    return checks_raw(spark, d).select("rid", payload.minimal_note(F.col("memo"), micr).alias("note"))


@query("c19_c21_d01_attachments", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'image/tiff' ELSE 'application/octet-stream' END AS kind, trim(regexp_replace(p_name || '#?', '[^A-Za-z0-9 _-]', '', 'g')) AS saved, p_partkey % 4 < 2 AS usable FROM part")
def attachments(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat(F.lit("scan."), F.when(k % 4 == 0, "PNG").when(k % 4 == 1, "pdf").when(k % 4 == 2, "tif").otherwise("doc"))
    sent = F.when(k % 4 == 0, "image/png").when(k % 4 == 1, "application/pdf").otherwise("text/plain")
    return table(spark, d, "part").select("p_partkey", scalars.content_type(name).alias("kind"), scalars.safe_filename(F.concat("p_name", F.lit("#?"))).alias("saved"), validation.is_attachment(sent, name).alias("usable"))


@query(
    "c24_c25_c26_mail_headers",
    """SELECT conv_id, turn, '<' || conv_id || '.' || turn || '@example.org>' AS reply_to, '<' || conv_id || '.' || turn || '@example.org> <root@example.org>' AS refs,
CASE turn % 3 WHEN 0 THEN 'RE: hello' WHEN 1 THEN 'Re: hello' ELSE 'Re: Check #' || turn || ' Processed' END AS subject, 3 AS spellings FROM conversations""",
)
def mail_headers(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    one = F.concat(F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"), F.lit("@example.org"))
    raw = F.concat(F.lit(' "<'), one, F.lit('>" ;, <root@example.org>,'))
    got = scalars.message_ids(raw)
    original = F.when(F.col("turn") % 3 == 0, " RE: hello").when(F.col("turn") % 3 == 1, "hello ").otherwise("")
    subject = scalars.reply_subject(original, F.col("turn").cast("string"), F.lit(True), "Processed")
    return c.select("conv_id", "turn", F.get(got, F.lit(0)).alias("reply_to"), F.array_join(got, " ").alias("refs"), subject.alias("subject"), F.size(scalars.id_spellings(F.concat(F.lit("<<"), one, F.lit(">")))).alias("spellings"))


def _row(label: str, value: str) -> str:
    return f"""'<div class="detail-row"><span class="label">{label}:</span> <span class="value">' || {value} || '</span></div>'"""


_SCORE = "printf('%.1f', i_confidence) || '%'"
_MONEY = "printf('$%,.2f', CAST(i_amount AS DOUBLE))"
_COLOUR = "CASE WHEN i_confidence >= 90 THEN '#2ca01c' WHEN i_confidence >= 70 THEN '#f39c12' ELSE '#e74c3c' END"
_DETAILS_TEXT = f"concat_ws(chr(10), 'Check Information:', 'Check Number: ' || i_number, 'Amount: ' || {_MONEY}, 'Payee: ' || i_payee, 'Payor: ' || i_payor, 'Date: ' || i_date, 'Confidence Score: ' || {_SCORE})"
_DETAILS_HTML = (
    "'<div class=\"check-details\"><h3>Check Information</h3>' || "
    + " || ".join([_row("Check Number", "i_number"), _row("Amount", _MONEY), _row("Payee", "i_payee"), _row("Payor", "i_payor"), _row("Date", "i_date")])
    + " || "
    + _row("Confidence Score", f"""'<span style="color:' || {_COLOUR} || ';font-weight:bold">' || {_SCORE} || '</span>'""")
    + " || '</div>'"
)


@query("c27_details_text", RAW + f"SELECT rid, {_DETAILS_TEXT} AS text FROM (SELECT rid, {_INFO_SQL} FROM checks_raw)")
def details_text(spark: SparkSession, d: str) -> DataFrame:
    return checks_raw(spark, d).withColumn("i", _info()).select("rid", payload.details_text(F.col("i")).alias("text"))


@query("c27_details_html", JUDGED + f"""SELECT rid, '<div class="callout" style="border-left-color:#f39c12"><h3>Review</h3>' || coalesce('<p>' || review_reason || '</p>', '') || '</div>' || {_DETAILS_HTML} AS html FROM (SELECT rid, review_reason, {_INFO_SQL} FROM judged)""")
def details_html(spark: SparkSession, d: str) -> DataFrame:
    return judged_alone(spark, d).withColumn("i", _info()).select("rid", F.concat(payload.callout_html("Review", "#f39c12", F.col("review_reason")), payload.details_html(F.col("i"))).alias("html"))


def _mail_sql() -> str:
    texts, pages, subjects = [], [], []
    for kind, (suffix, header, accent, title) in payload.MAILS.items():
        line = "'Check #' || i_number" if kind == "processed" else "coalesce(why, '')"
        closing = "'View receipt: ' || link" if kind == "processed" else "NULL"
        data = "NULL" if kind == "failed" else "'Extracted Data (JSON):' || chr(10) || record"
        texts.append(f"WHEN '{kind}' THEN concat_ws(chr(10) || chr(10), concat_ws(chr(10), '{title}', nullif({line}, '')), {_DETAILS_TEXT}, {closing}, {data}, '---' || chr(10) || 'Automated Check Processing System')")
        button = """'<a class="button" href="' || replace(link, '&', '&amp;') || '">View receipt</a>'""" if kind == "processed" else "NULL"
        json = "NULL" if kind == "failed" else """'<div class="check-details"><h3>Extracted Data (JSON)</h3><pre>' || replace(record, '"', '&quot;') || '</pre></div>'"""
        callout = f"""'<div class="callout" style="border-left-color:{accent}"><h3>{title}</h3>' || CASE WHEN {line} <> '' THEN '<p>' || {line} || '</p>' ELSE '' END || '</div>'"""
        pages.append(f"""WHEN '{kind}' THEN '<html><body><div class="header" style="background-color:{accent};color:white"><h1>{header}</h1></div><div class="content">' || concat_ws('', {callout}, {_DETAILS_HTML}, {button}, {json}) || '</div><div class="footer"><p>Automated Check Processing System</p></div></body></html>'""")
        subjects.append(f"WHEN '{kind}' THEN CASE WHEN rid % 2 = 0 THEN 'Re: scan' ELSE 'Re: Check #' || i_number || ' {suffix}' END")
    link = "'https://app.qbo.intuit.com/app/salesreceipt?txnId=' || rid || '&companyid=9'"
    rows = f"""SELECT rid, route, coalesce(error, review_reason) AS why, {link} AS link, '{{"rid":' || rid || '}}' AS record, {_INFO_SQL} FROM judged"""
    return JUDGED + f"SELECT rid, CASE route {' '.join(subjects)} END AS subject, CASE route {' '.join(texts)} END AS text, CASE route {' '.join(pages)} END AS html FROM ({rows})"


@query("b14_r07_mails", _mail_sql())
def mails(spark: SparkSession, d: str) -> DataFrame:
    """The notification of each submission by its route."""
    rows = judged(spark, d).withColumn("i", _info())
    subject = F.when(F.col("rid") % 2 == 0, "scan").otherwise("")
    link = scalars.receipt_url(F.col("rid").cast("string"), F.lit("9"), "production")
    mail = payload.mail(F.col("route"), subject, F.col("i"), F.coalesce("error", "review_reason"), link, F.to_json(F.struct("rid")))
    return rows.withColumn("m", mail).select("rid", "m.subject", "m.text", "m.html")


@query(
    "c28_summary",
    JUDGED
    + """SELECT rid, concat_ws(chr(10), repeat('=', 80), 'CHECK PROCESSED SUCCESSFULLY', repeat('=', 80), '', 'Key Information:', repeat('-', 80), 'Check Number: ' || coalesce(check_number, 'N/A'), 'Date: ' || coalesce(check_date, 'N/A'),
'Amount: $' || printf('%,.2f', coalesce(amount, 0)), 'Payor: ' || customer_name, '', 'Bank Information:', repeat('-', 80), 'Routing: ' || coalesce(routing_number, 'N/A'), 'Account: ' || coalesce(account_number, 'N/A'), '',
'Validation Status:', repeat('-', 80), CASE WHEN amounts_match THEN 'Amounts Match: ✓ Yes' WHEN NOT amounts_match THEN 'Amounts Match: ✗ No - REQUIRES REVIEW' ELSE 'Amounts Match: Unknown' END,
CASE WHEN is_post_dated THEN 'Post-Dated: ⚠ WARNING - Check is dated in the future' END, CASE WHEN is_stale THEN 'Stale-Dated: ⚠ WARNING - Check is >180 days old' END, CASE WHEN flagged THEN 'Manual Review: ⚠ Required' END, 'Confidence: ' || confidence || '%') AS text
FROM judged WHERE route = 'processed'""",
)
def summary(spark: SparkSession, d: str) -> DataFrame:
    c = [F.col(x) for x in ("check_number", "check_date", "amount", "customer_name", "routing_number", "account_number", "amounts_match", "is_post_dated", "is_stale", "flagged", "confidence")]
    return judged(spark, d).where("route = 'processed'").select("rid", payload.summary(*c).alias("text"))


@query(
    "c29_c31_c32_urls",
    "SELECT s_suppkey, 'https://app.sandbox.qbo.intuit.com/app/salesreceipt?txnId=' || s_suppkey || '&companyid=9' AS url, s_name AS folder, 'check_processor@' || CASE WHEN s_suppkey % 2 = 0 THEN 'bank.example' ELSE 'example.com' END AS sender, CAST(s_suppkey AS VARCHAR) AS realm FROM supplier",
)
def urls(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    user = F.when(F.col("s_suppkey") % 2 == 0, "ann@bank.example").otherwise("ann")
    back = F.concat(F.lit("https://localhost/cb?code=ab&realmId="), k)
    return table(spark, d, "supplier").select("s_suppkey", scalars.receipt_url(k, F.lit("9"), "sandbox").alias("url"), scalars.folder_name(F.concat(F.lit("INBOX/"), "s_name")).alias("folder"), scalars.sender_address(user).alias("sender"), scalars.callback_parameter(back, "realmId").alias("realm"))


@query(
    "c30_d11_d12_api_errors",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'bad' ELSE 'HTTP ' || s END AS message, CASE WHEN event_id % 2 = 0 THEN '610' END AS code, CASE WHEN event_id % 2 = 0 THEN 'token expired' END AS detail,
event_id % 4 < 2 AND s NOT IN (400, 401, 403, 404) AS retry, event_id % 2 = 0 AS permanent FROM (SELECT *, [400, 401, 404, 429, 500, 503][event_id % 6 + 1] AS s FROM events)""",
)
def api_errors(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    status = F.get(F.array(*map(F.lit, (400, 401, 404, 429, 500, 503))), (k % 6).cast("int"))
    body = F.when(k % 2 == 0, '{"Fault":{"Error":[{"Message":"bad","Detail":"token expired","code":"610"}]}}').otherwise("{}")
    e = table(spark, d, "events").select("event_id", status.alias("s"), payload.api_error(body, status).alias("e"))
    return e.select("event_id", "e.message", "e.code", "e.detail", validation.should_retry(F.col("s"), (F.col("event_id") % 4).cast("int"), S.api_attempts).alias("retry"), validation.permanent_auth_error(F.col("e.detail")).alias("permanent"))


# --------------------------------------------------- validation and scoring


@query("d02_d06_formats", JUDGED + "SELECT rid, v_r, v_a, v_c, v_m, v_d FROM judged")
def formats(spark: SparkSession, d: str) -> DataFrame:
    no = F.lit(False)
    return checks_raw(spark, d).select(
        "rid",
        F.coalesce(validation.routing_format(F.col("routing_number")), no).alias("v_r"),
        F.coalesce(validation.account_format(F.col("account_number")), no).alias("v_a"),
        F.coalesce(validation.check_number_format(F.col("check_number")), no).alias("v_c"),
        validation.amount_format(F.col("amount")).alias("v_m"),
        F.coalesce(validation.date_format(F.col("check_date")), no).alias("v_d"),
    )


@query("d07_d08_checksum", JUDGED + "SELECT rid, aba, p_r AND p_c AS gate FROM judged")
def checksum(spark: SparkSession, d: str) -> DataFrame:
    return checks_raw(spark, d).select("rid", validation.routing_checksum(F.col("routing_number")).alias("aba"), validation.duplicate_gate(F.col("routing_number"), F.col("check_number")).alias("gate"))


@query("d09_highlights", "SELECT p_partkey, p_name, p_type FROM part WHERE lower(p_name) LIKE '%undeposited%' OR lower(p_name) LIKE '%checking%' OR lower(p_name) LIKE '%savings%' OR p_type = (SELECT min(p_type) FROM part)")
def highlights(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    least = part.agg(F.min("p_type").alias("least"))
    joined = part.crossJoin(F.broadcast(least))  # one row
    return joined.where(validation.account_highlight(F.col("p_name"), F.when(F.col("p_type") == F.col("least"), "Bank").otherwise(""))).select("p_partkey", "p_name", "p_type")


@query("d09_items_and_methods", "SELECT p_partkey, k IN (0, 1) AS item, k = 3 AS method FROM (SELECT p_partkey, p_partkey % 5 AS k FROM part)")
def items_and_methods(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    kind = F.when(k == 0, "Service").when(k == 1, "NonInventory").when(k == 2, "Inventory")
    name = F.when(k == 3, "Paper CHECK").otherwise("Cash")
    return table(spark, d, "part").select("p_partkey", F.coalesce(validation.item_highlight(kind), F.lit(False)).alias("item"), validation.payment_highlight(name).alias("method"))


@query("d13_token_expiry", "SELECT event_id, TIMESTAMP '2024-01-15 00:00:00' >= ts - INTERVAL 5 MINUTES AS expiring FROM events")
def token_expiry(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", validation.token_expiring(F.lit("2024-01-15 00:00:00").cast("timestamp"), F.col("ts")).alias("expiring"))


@query("e01_e04_overall", JUDGED + "SELECT rid, char_score, round(format_score, 6) AS format_score, checksum_score, overall FROM judged")
def overall(spark: SparkSession, d: str) -> DataFrame:
    return scoring.with_scores(checks_raw(spark, d)).select("rid", "char_score", F.round("format_score", 6).alias("format_score"), "checksum_score", "overall")


_RUN_FIELDS = ("routing_number", "account_number", "check_number", "amount")


@query(
    "e05_consistency",
    RAW
    + """, c AS (SELECT *, CAST(routing_number IS NOT NULL AS INT) + CAST(account_number IS NOT NULL AS INT) + CAST(check_number IS NOT NULL AS INT) + CAST(amount IS NOT NULL AS INT) AS n FROM checks_raw)
SELECT rid, CASE WHEN n = 0 THEN 50e0 WHEN rid % 7 = 0 AND amount IS NOT NULL THEN (n - 1) * 100e0 / n ELSE 100e0 END AS consistency FROM c""",
)
def consistency(spark: SparkSession, d: str) -> DataFrame:
    runs = checks_raw(spark, d).select("rid", *_RUN_FIELDS, F.explode(F.array(*map(F.lit, range(3)))).alias("run"))
    runs = runs.withColumn("amount", F.when((F.col("rid") % 7 == 0) & (F.col("run") == 2), F.col("amount") + F.lit(1)).otherwise(F.col("amount")))
    return scoring.consistency(runs, "rid", _RUN_FIELDS)


@query("e06_field_confidences", JUDGED + "SELECT rid, fc_routing_number, fc_account_number, fc_check_number, fc_amount, fc_date FROM judged")
def field_confidences(spark: SparkSession, d: str) -> DataFrame:
    return scoring.with_scores(checks_raw(spark, d)).select("rid", "fc_routing_number", "fc_account_number", "fc_check_number", "fc_amount", "fc_date")


@query(
    "e07_e09_recommendation",
    JUDGED
    + """, w AS (SELECT rid, overall, confidence, concat_ws(', ', CASE WHEN fc_routing_number < 70 THEN 'routing_number' END, CASE WHEN fc_amount < 70 THEN 'amount' END, CASE WHEN fc_check_number < 70 THEN 'check_number' END) AS low_fields FROM judged)
SELECT rid, low_fields, CASE WHEN overall >= 75 AND low_fields = '' THEN 'auto_process' ELSE 'manual_review' END AS action,
CASE WHEN overall < 75 THEN 'Low overall confidence' WHEN low_fields <> '' THEN 'Low confidence in critical fields: ' || low_fields ELSE 'High confidence in all fields' END AS reason,
CASE WHEN confidence >= 85 THEN 'auto_process' ELSE 'manual_review' END AS advisory FROM w""",
)
def recommendation(spark: SparkSession, d: str) -> DataFrame:
    return scoring.recommendation(scoring.with_scores(checks_raw(spark, d))).select("rid", "low_fields", "action", "reason", scoring.advisory(F.col("confidence"), S.auto_confidence).alias("advisory"))


@query("e10_review_reason", JUDGED + "SELECT rid, review_reason FROM judged")
def review_reason(spark: SparkSession, d: str) -> DataFrame:
    return judged_alone(spark, d).select("rid", "review_reason")


@query("e11_e12_flags", JUDGED + "SELECT rid, age_days, is_stale, is_post_dated, flagged FROM judged")
def flags(spark: SparkSession, d: str) -> DataFrame:
    return judged_alone(spark, d).select("rid", "age_days", "is_stale", "is_post_dated", "flagged")


@query("e13_e14_route", JUDGED + "SELECT rid, is_duplicate, route FROM judged")
def route(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).select("rid", "is_duplicate", "route")


# -------------------------------------------------------------- identifiers

_TEXT = "coalesce(routing_number, 'None') || coalesce(account_number, 'None') || coalesce(check_number, 'None') || coalesce(check_date, 'None') || coalesce(CAST(amount AS VARCHAR), 'None')"
_PIPED = _TEXT.replace("|| coalesce", "|| '|' || coalesce")
_IDS = RAW + f", x AS (SELECT *, {_TEXT} AS id_text FROM checks_raw), y AS (SELECT *, row_number() OVER (PARTITION BY id_text ORDER BY rid) - 1 AS occurrence FROM x), z AS (SELECT *, CASE WHEN occurrence > 0 THEN id_text || '|' || occurrence ELSE id_text END AS full_text FROM y), ids AS (SELECT *, translate(to_base64(unhex(substr(sha256(full_text), 1, 24))), '+/', '-_') AS check_id FROM z) "


@query("g01_g02_hash_ids", _IDS + "SELECT rid, occurrence, check_id FROM ids")
def hash_ids(spark: SparkSession, d: str) -> DataFrame:
    return dedup.with_hash_ids(checks_raw(spark, d)).select("rid", F.col("occurrence").cast("long").alias("occurrence"), "check_id")


@query("g03_doc_number", RAW + f"SELECT rid, substr(upper(sha1({_PIPED})), 1, 21) AS doc_number FROM checks_raw")
def doc_number(spark: SparkSession, d: str) -> DataFrame:
    text = ids.hash_input(*(F.col(c) for c in (*dedup.KEY, "amount")), separator="|")
    return checks_raw(spark, d).select("rid", ids.doc_number(text).alias("doc_number"))


def _shareable() -> Column:
    return ids.reversible_id(F.col("check_number"), F.col("amount"), F.col("check_date"), F.col("customer_name"), F.col("routing_number"))


_JSON = """'{"cn":' || coalesce('"' || check_number || '"', 'null') || ',"amt":"' || coalesce(CAST(amount AS VARCHAR), 'None') || '","dt":' || coalesce('"' || check_date || '"', 'null') || ',"cid":"' || customer_name || '","rn":"' || coalesce(right(routing_number, 4), '') || '"}'"""


@query("g04_reversible_id", RAW + f"SELECT rid, rtrim(translate(to_base64(encode({_JSON})), '+/', '-_'), '=') AS shareable FROM checks_raw")
def reversible_id(spark: SparkSession, d: str) -> DataFrame:
    return checks_raw(spark, d).select("rid", _shareable().alias("shareable"))


@query("g05_decode", RAW + "SELECT rid, check_number, amount, check_date, coalesce(right(routing_number, 4), '') AS routing_last4 FROM checks_raw")
def decode(spark: SparkSession, d: str) -> DataFrame:
    got = checks_raw(spark, d).select("rid", ids.decode(_shareable()).alias("p"))
    return got.select("rid", F.col("p.cn").alias("check_number"), F.col("p.amt").try_cast("decimal(12,2)").alias("amount"), F.col("p.dt").alias("check_date"), F.col("p.rn").alias("routing_last4"))


@query(
    "g07_g08_lookup",
    _IDS
    + f"""SELECT check_id AS id, CASE WHEN rid % 4 = 0 THEN 'mapping' ELSE 'unknown' END AS found, CASE WHEN rid % 4 = 0 THEN check_number END AS check_number, CASE WHEN rid % 4 = 0 THEN CAST(amount AS VARCHAR) END AS amount FROM ids
UNION ALL SELECT rtrim(translate(to_base64(encode({_JSON})), '+/', '-_'), '='), 'decoded', check_number, coalesce(CAST(amount AS VARCHAR), 'None') FROM checks_raw WHERE rid % 3 = 0""",
)
def lookup(spark: SparkSession, d: str) -> DataFrame:
    """Stored ids, ids that are not stored, and shared ids, which tell their check themselves."""
    raw = checks_raw(spark, d)
    rows = dedup.with_hash_ids(raw)
    asked = rows.select(F.col("check_id").alias("id")).unionByName(raw.where("rid % 3 = 0").select(_shareable().alias("id")))
    return store.lookup(asked, rows.where("rid % 4 = 0"))


# ---------------------------------------------------------------- detection

_GAPS = (
    f"WITH {COMPONENTS_SQL}"
    + """,
ok AS (SELECT *, w * h AS area, x + w / 2.0e0 AS cx, y + h / 2.0e0 AS cy FROM components WHERE NOT (x = 0 OR y = 0 OR x + w = 2550 OR y + h = 6000) AND w * h >= 80),
g AS (SELECT *, lead(y) OVER o - (y + h) AS gap FROM ok WINDOW o AS (PARTITION BY page ORDER BY cy, label)),
lim AS (SELECT page, quantile_cont(gap, 0.5) + 1.5e0 * (quantile_cont(gap, 0.75) - quantile_cont(gap, 0.25)) AS lim FROM g WHERE gap > 0 GROUP BY page),
c AS (SELECT g.*, coalesce(gap > 0 AND gap >= lim, false) AS big, row_number() OVER (PARTITION BY g.page ORDER BY CASE WHEN gap > 0 THEN gap END DESC NULLS LAST, cy, label) AS rk FROM g LEFT JOIN lim USING (page)),
c2 AS (SELECT *, CASE WHEN bool_or(big) OVER (PARTITION BY page) THEN big ELSE coalesce(gap > 0, false) AND rk = 1 END AS cut FROM c),
grouped AS (SELECT *, CAST(coalesce(sum(CAST(cut AS INT)) OVER (PARTITION BY page ORDER BY cy, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS grp FROM c2)
"""
)
_MERGED = (
    _GAPS
    + """,
bx AS (SELECT page, grp, min(y) AS top, max(y + h) AS bottom FROM grouped GROUP BY ALL),
e AS (SELECT *, coalesce(lead(bottom - top) OVER o < 450 AND lead(top) OVER o - bottom < 600, false) AS may FROM bx WINDOW o AS (PARTITION BY page ORDER BY grp)),
r AS (SELECT *, coalesce(sum(CAST(NOT may AS INT)) OVER (PARTITION BY page ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM e),
m AS (SELECT *, may AND (row_number() OVER (PARTITION BY page, run ORDER BY grp) - 1) % 2 = 0 AS merges FROM r),
n AS (SELECT page, grp, CASE WHEN coalesce(lag(merges) OVER (PARTITION BY page ORDER BY grp), false) THEN grp - 1 ELSE grp END AS into_grp FROM m),
merged AS (SELECT grouped.* EXCLUDE (grp), into_grp AS grp FROM grouped JOIN n USING (page, grp))
"""
)
_BOXES = (
    _MERGED
    + """,
z AS (SELECT *, abs(cy - avg(cy) OVER w) / (stddev_pop(cy) OVER w + 1e-10) <= 2.5 AS keep FROM merged WINDOW w AS (PARTITION BY page, grp)),
z2 AS (SELECT *, keep OR NOT bool_or(keep) OVER (PARTITION BY page, grp) AS used FROM z),
b AS (SELECT page, grp, min(x) FILTER (used) AS x0, min(y) FILTER (used) AS y0, max(x + w) FILTER (used) AS x1, max(y + h) FILTER (used) AS y1, count(*) FILTER (used) AS components_used, count(*) FILTER (NOT used) AS outliers_removed FROM z2 GROUP BY ALL),
b2 AS (SELECT page, grp, components_used, outliers_removed, greatest(0, x0 - floor((x1 - x0) * 0.04e0)) AS x, greatest(0, y0 - floor((y1 - y0) * 0.04e0)) AS y, least(2550, x1 + floor((x1 - x0) * 0.04e0)) AS xr, least(6000, y1 + floor((y1 - y0) * 0.04e0)) AS yb FROM b),
b3 AS (SELECT *, row_number() OVER o - 1 AS det, lag(yb) OVER o + 40 AS above FROM b2 WHERE xr - x >= 300 WINDOW o AS (PARTITION BY page ORDER BY y, grp)),
b4 AS (SELECT *, CASE WHEN above IS NULL THEN y ELSE least(greatest(y, above), yb - 1) END AS top FROM b3),
detections AS (
  SELECT page, CAST(det AS INT) AS det, CAST(x AS BIGINT) AS x, CAST(top AS BIGINT) AS y, CAST(xr - x AS BIGINT) AS w, CAST(yb - top AS BIGINT) AS h, least(100e0, 50e0 + components_used / 10e0) AS confidence, components_used, outliers_removed FROM b4)
"""
)


@query("h03_usable", _GAPS + "SELECT page, label FROM ok")
def h_usable(spark: SparkSession, d: str) -> DataFrame:
    return detect.usable(components(spark, d)).select("page", F.col("label").cast("long").alias("label"))


@query("h04_h08_groups", _GAPS + "SELECT page, label, gap, cut, grp FROM grouped")
def h_groups(spark: SparkSession, d: str) -> DataFrame:
    return detect.groups(components(spark, d)).select("page", F.col("label").cast("long").alias("label"), "gap", "cut", "grp")


@query("h09_merged", _MERGED + "SELECT page, label, grp FROM merged")
def h_merged(spark: SparkSession, d: str) -> DataFrame:
    return detect.merge_strips(detect.groups(components(spark, d))).select("page", F.col("label").cast("long").alias("label"), "grp")


@query("h10_h12_boxes", _BOXES + "SELECT page, grp, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(xr AS BIGINT) AS \"right\", CAST(yb AS BIGINT) AS bottom, components_used, outliers_removed FROM b3")
def h_boxes(spark: SparkSession, d: str) -> DataFrame:
    b = detect.boxes(detect.merge_strips(detect.groups(components(spark, d))))
    return b.select("page", "grp", *(F.col(c).cast("long").alias(c) for c in ("x", "y", "right", "bottom")), "components_used", "outliers_removed")


@query("h15_detect", _BOXES + "SELECT * FROM detections")
def h_detect(spark: SparkSession, d: str) -> DataFrame:
    return detect.detect(components(spark, d))


@query("f16_d10_counts", _BOXES + "SELECT page, count(*) AS n, count(*) FILTER (confidence >= 52) >= 2 AS several FROM detections GROUP BY page")
def h_counts(spark: SparkSession, d: str) -> DataFrame:
    return h_detect(spark, d).groupBy("page").agg(F.count("*").alias("n"), (F.count_if(F.col("confidence") >= 52) >= 2).alias("several"))


@query("f15_total_detections", _BOXES + "SELECT count(*) AS n FROM detections")
def h_total(spark: SparkSession, d: str) -> DataFrame:
    return h_detect(spark, d).agg(F.count("*").alias("n"))


# ----------------------------------------------------------- routing, batches


#: Every page is in a file of one, two or three pages: six pages make three files.
_FILE = "page // 6 * 3 + CASE page % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 2 END"


@query(
    "r01_work_units",
    _BOXES
    + f""", pf AS (SELECT DISTINCT page, {_FILE} AS file FROM components),
dets AS (SELECT file, page, det FROM pf JOIN detections USING (page)),
shape AS (SELECT file, count(DISTINCT page) AS pages, count(det) AS found FROM pf LEFT JOIN dets USING (file, page) GROUP BY file)
SELECT file, page, det, det IS NOT NULL AS used_detection, CASE WHEN pages > 1 THEN 'multi_page' WHEN found = 0 THEN 'full_page' WHEN found = 1 THEN 'single_crop' ELSE 'multi_check' END AS scenario FROM pf LEFT JOIN dets USING (file, page) JOIN shape USING (file)""",
)
def work_units(spark: SparkSession, d: str) -> DataFrame:
    page = F.expr("l_orderkey div 8")
    pages = table(spark, d, "lineitem").select(page.alias("page")).distinct().withColumn("file", F.expr(_FILE.replace("//", "div")))
    return routing.work_units(pages, detect.detect(components(spark, d)).select("page", "det")).select("file", "page", "det", "used_detection", "scenario")


@query("r02_r03_batch_items", JUDGED + "SELECT rid, file, row_number() OVER (PARTITION BY file ORDER BY page, rid) - 1 AS item FROM judged")
def batch_items(spark: SparkSession, d: str) -> DataFrame:
    return routing.batch_items(judged(spark, d)).select("rid", "file", F.col("item").cast("long").alias("item"))


_OUTCOME = ", done AS (SELECT file, count(*) AS items, count(*) FILTER (route <> 'failed') AS succeeded, count(*) FILTER (route = 'failed') AS failed FROM judged GROUP BY file), outcome AS (SELECT *, CASE WHEN failed = 0 THEN 'Processed' WHEN succeeded = 0 THEN 'Failed' ELSE 'ManualReview' END AS folder FROM done) "


@query("r04_batch_outcome", JUDGED + _OUTCOME + "SELECT * FROM outcome")
def batch_outcome(spark: SparkSession, d: str) -> DataFrame:
    return routing.batch_outcome(judged(spark, d))


@query("r06_b17_archive", JUDGED + _OUTCOME + "SELECT file, folder, string_agg('<' || rid || '@example.org>', ' ' ORDER BY rid) AS message_ids FROM judged JOIN outcome USING (file) GROUP BY file, folder")
def archive(spark: SparkSession, d: str) -> DataFrame:
    j = judged(spark, d)
    sent = j.groupBy("file").agg(F.array_sort(F.collect_list("rid")).alias("rids"))  # a file's own items
    text = F.array_join(F.transform("rids", lambda r: F.concat(F.lit("<"), r.cast("string"), F.lit("@example.org>"))), " ")
    return sent.join(routing.batch_outcome(j), "file").select("file", "folder", text.alias("message_ids"))


# ------------------------------------------------------------- time, streams


@query("s02_trailing_calls", "SELECT event_id, count(*) OVER (ORDER BY t RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS calls FROM (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)")
def trailing_calls(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "events").select("event_id", F.unix_timestamp("ts").alias("ts"))
    return store.trailing_calls(calls, 3600).select("event_id", "calls")


_ARCHIVE = JUDGED + _OUTCOME + "SELECT file, folder, string_agg('<' || rid || '@example.org>', ' ' ORDER BY rid) AS message_ids FROM judged JOIN outcome USING (file) GROUP BY file, folder"


@query("r06_pending_mail", _ARCHIVE)
def pending_mail(spark: SparkSession, d: str) -> DataFrame:
    """The archive again, of items that four polls bring: a mail moves in the poll of its last item."""
    home, rows = shared(spark, "mails"), judged(spark, d)
    sizes = checks_raw(spark, d).groupBy("file").agg(F.count("*").alias("items"))  # as many rows as are judged
    sent = F.concat(F.lit("<"), F.col("rid").cast("string"), F.lit("@example.org>"))
    items = stored(rows.join(sizes, "file").select("file", "rid", "items", "route", sent.alias("message_id")), "items")
    done = [finished(items.where(F.col("rid") % 4 == number), home, number) for number in range(4)]
    out = reduce(DataFrame.unionByName, done)
    return out.select("file", "folder", F.array_join("message_ids", " ").alias("message_ids"))


_POLLS = 2
_SINCE = f"CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events), e AS (SELECT event_id, 1 + CAST(least({_POLLS - 1}, (t - (SELECT min(t) FROM s)) * {_POLLS} // greatest(1, (SELECT max(t) - min(t) FROM s))) AS INT) AS poll, CASE event_id % 4 WHEN 0 THEN 500 WHEN 1 THEN 404 WHEN 2 THEN NULL ELSE 429 END AS status FROM s)"


@query(
    "s03_r05_retries",
    f"""WITH s AS (SELECT event_id, {_SINCE}, f AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN 3 WHEN event_id % 7 < 3 THEN 2 ELSE 1 END AS fails, coalesce(status IN (429, 500, 502, 503, 504), true) AS again FROM e)
SELECT event_id AS rid, CAST(a AS INT) AS attempt, 'retry' AS outcome, CAST(poll + 2 * a - 3 AS INT) AS poll FROM f, range(2, 4) AS r(a) WHERE again AND a <= fails + 1
UNION ALL SELECT event_id, CAST(CASE WHEN again THEN 3 ELSE 1 END AS INT), 'dead', CAST(poll + CASE WHEN again THEN 4 ELSE 0 END AS INT) FROM f WHERE NOT again OR fails = 3""",
)
def failed_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls that fail one to three times: each poll sets the failures since the last one aside and makes the attempts whose timers are due; those that fail again come with the next poll."""
    home, k = shared(spark, "failures"), F.col("event_id")
    second = F.unix_timestamp("ts")
    first, last = table(spark, d, "events").agg(F.min(second), F.max(second)).first()
    poll = 1 + F.least(F.lit(_POLLS - 1), F.expr(f"(unix_timestamp(ts) - {first}) * {_POLLS} div {max(1, (last or 0) - (first or 0))}"))
    status = F.when(k % 4 == 0, 500).when(k % 4 == 1, 404).when(k % 4 == 3, 429)
    calls = stored(table(spark, d, "events").select(k.alias("rid"), poll.alias("poll"), status.alias("status"), F.when(k % 7 == 0, 3).when(k % 7 < 3, 2).otherwise(1).alias("fails")), "calls")
    out = []
    for number in range(1, _POLLS + 5):
        failed = calls.where(F.col("poll") == number).select("rid", F.lit(1).alias("attempt"), "status")
        if out:
            tried = out[-1].where("outcome = 'retry'").select("rid", "attempt")
            failed = failed.unionByName(tried.join(calls, "rid").where("attempt <= fails").select("rid", "attempt", "status"))
        failed = failed.withColumn("error", F.lit("call failed"))
        out.append(failures.retries(failed, home, number, 10_000 * number, F.col("status")).withColumn("poll", F.lit(number)))
    return reduce(DataFrame.unionByName, out).select("rid", "attempt", "outcome", "poll")


@query(
    "s02_calls_in_flight",
    """WITH c AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS a, CAST(floor(epoch(ts)) AS BIGINT) + 1 + event_id % 900 AS b FROM events),
net AS (SELECT s, sum(n) AS n, sum(starts) AS starts FROM (SELECT a AS s, 1 AS n, 1 AS starts FROM c UNION ALL SELECT b, -1, 0 FROM c) GROUP BY s),
run AS (SELECT s, starts, sum(n) OVER (ORDER BY s) AS level FROM net)
SELECT s // 60 AS minute, CAST(max(level) AS BIGINT) AS most FROM run WHERE starts > 0 GROUP BY 1""",
)
def calls_in_flight(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_timestamp("ts")
    return store.calls_in_flight(table(spark, d, "events").select(at.alias("start"), (at + 1 + F.col("event_id") % 900).alias("end")))


def _history(spark: SparkSession, d: str) -> tuple[buckets.Store, list[DataFrame]]:
    """A store of submissions by number, and three batches: all as pending, a third as processed, a fifth as failed or no longer read."""
    raw = stored(checks_raw(spark, d).select("rid", "customer_name", "confidence"), "history")
    batches = [
        raw.select("*", F.lit("pending").alias("status"), F.lit(0).alias("version")),
        raw.where("rid % 3 = 0").select("*", F.lit("processed").alias("status"), F.lit(1).alias("version")),
        raw.where("rid % 5 = 0").withColumn("confidence", F.when(F.col("rid") % 2 == 0, F.col("confidence"))).select("*", F.lit("failed").alias("status"), F.lit(2).alias("version")),
    ]
    return buckets.Store(shared(spark, "store"), batches[0].schema, ("rid",), "version", 16), batches


_LATEST = RAW + ", latest AS (SELECT rid, customer_name, CASE WHEN rid % 5 = 0 AND rid % 2 = 1 THEN NULL ELSE confidence END AS confidence, CASE WHEN rid % 5 = 0 THEN 'failed' WHEN rid % 3 = 0 THEN 'processed' ELSE 'pending' END AS status, CASE WHEN rid % 5 = 0 THEN 2 WHEN rid % 3 = 0 THEN 1 ELSE 0 END AS version FROM checks_raw) "


@query("b02_b05_s06_compaction", _LATEST + "SELECT * FROM latest")
def compacted(spark: SparkSession, d: str) -> DataFrame:
    """The latest rows of a store that was compacted between its batches."""
    history, batches = _history(spark, d)
    for number, batch in enumerate(batches):
        history.append(batch, number)
        if number < 2:
            history.compact(spark)
    return history.read(spark)


@query("f01_f04_store_lookup", _LATEST + "SELECT * FROM latest WHERE rid IN (SELECT 2 * o_orderkey FROM orders WHERE o_orderkey % 20 = 0)")
def store_lookup(spark: SparkSession, d: str) -> DataFrame:
    """What the store has of the keys that come up again; the other buckets' files are not read."""
    history, batches = _history(spark, d)
    for number, batch in enumerate(batches):
        history.append(batch, number)
    return history.known(table(spark, d, "orders").where("o_orderkey % 20 = 0").select((2 * F.col("o_orderkey")).alias("rid")))


@query("f09_f12_kept_statistics", _LATEST + "SELECT CAST(sum(n) AS BIGINT) AS total, string_agg(status || '=' || n, ',' ORDER BY status) AS by_status, round(CAST(sum(s) AS DOUBLE) / CAST(sum(c) AS DOUBLE), 6) AS mean_confidence FROM (SELECT status, count(*) AS n, sum(confidence) AS s, count(confidence) AS c FROM latest GROUP BY status)")
def kept_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics that follow three batches by what each changes; the second is run again."""
    (history, batches), home = _history(spark, d), shared(spark, "statistics")
    for number in (0, 1, 1, 2):
        change = store.changed_statistics(history.known(batches[number], before=number), batches[number], "rid")
        change.write.mode("overwrite").parquet(f"{home}/batch={number}")
        history.append(batches[number], number)
    return store.shown_statistics(store.kept_statistics(spark.read.parquet(home).drop("batch")))


@query("s05_fresh_against_history", JUDGED + ", h AS (SELECT * FROM judged WHERE rid % 2 = 0 AND rid % 3 = 0), nw AS (SELECT * FROM judged WHERE NOT (rid % 2 = 0 AND rid % 3 = 0)), fr AS (SELECT nw.rid, nw.error, nw.p_r AND nw.p_c AS gate, nw.routing_number, nw.account_number, nw.check_number, nw.check_date FROM nw WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.routing_number = nw.routing_number AND h.account_number = nw.account_number AND h.check_number = nw.check_number AND h.check_date = nw.check_date)) SELECT rid FROM fr WHERE NOT (gate AND error IS NULL AND EXISTS (SELECT 1 FROM fr o WHERE o.error IS NULL AND o.rid < fr.rid AND o.routing_number = fr.routing_number AND o.account_number = fr.account_number AND o.check_number = fr.check_number AND o.check_date = fr.check_date))")
def fresh(spark: SparkSession, d: str) -> DataFrame:
    raw = checks_raw(spark, d)
    old = (F.col("rid") % 2 == 0) & (F.col("rid") % 3 == 0)
    return dedup.fresh_against(raw.where(~old), raw.where(old)).select("rid")


@query("a02_a13_explode_lists", "SELECT s_suppkey, trim(p) AS path FROM (SELECT s_suppkey, unnest(string_split(s_name || ', ,b.pdf,', ',')) AS p FROM supplier) WHERE trim(p) <> ''")
def explode_lists(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "supplier").select("s_suppkey", F.explode(F.split(F.concat("s_name", F.lit(", ,b.pdf,")), ",")).alias("p"))
    return parts.select("s_suppkey", F.trim("p").alias("path")).where("path <> ''")


@query(
    "a01_mail_scan",
    """WITH m AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, unnest(CASE WHEN o_orderkey % 5 = 0 THEN [] WHEN o_orderkey % 3 = 0 THEN [0, 1, 2] ELSE [0] END) AS n FROM orders)
SELECT 'u' || k AS uid, CASE n WHEN 0 THEN 'scan:' || k || '.PDF' ELSE 'p' || k || '.png' END AS filename, strftime(d, '%Y%m%d') || '_103000_' || CASE n WHEN 0 THEN 'scan' || k || '.PDF' ELSE 'p' || k || '.png' END AS saved_as, '<m' || k || '@x>' AS message_ids
FROM m WHERE n < 2""",
)
def mail_scan(spark: SparkSession, d: str) -> DataFrame:
    """A stream over a folder of mail exports that stops midway and goes on: a row a usable attachment."""
    home, k = shared(spark, "mail"), F.col("o_orderkey")
    files_of = F.when(k % 5 == 0, F.lit("[]"))
    one = F.concat(F.lit('{"filename":"scan:'), k.cast("string"), F.lit('.PDF","content_type":"application/pdf"}'))
    two = F.concat(F.lit(',{"filename":"p'), k.cast("string"), F.lit('.png","content_type":"image/png"},{"filename":"n.doc","content_type":"application/pdf"}'))
    listed = files_of.otherwise(F.concat(F.lit("["), one, F.when(k % 3 == 0, two).otherwise(""), F.lit("]")))
    line = F.concat(F.lit('{"uid":"u'), k.cast("string"), F.lit('","received":"'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('T10:30:00","message_id":"<m'), k.cast("string"), F.lit('@x>","attachments":'), listed, F.lit("}"))
    mail = table(spark, d, "orders").select(line.alias("value"), (k % 2).alias("part"))
    spark.dataSource.register(MailExport)
    scan = files.attachments(spark.readStream.format("mail_export").load(f"{home}/in"))
    for part in (0, 1):  # exports are read by name, and the second run begins where the first ended
        mail.where(F.col("part") == part).select("value").write.mode("overwrite").text(f"{home}/part")
        for n, name in enumerate(sorted(x for x in folders(spark, f"{home}/part") if x.startswith("part-"))):
            move(spark, f"{home}/part/{name}", f"{home}/in/export-{part}-{n:05}.json")
        scan.writeStream.format("parquet").option("checkpointLocation", f"{home}/at").option("path", f"{home}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(scan.schema).parquet(f"{home}/out").select("uid", "filename", "saved_as", F.array_join("message_ids", " ").alias("message_ids"))


# ---------------------------------------------------------------- extraction


def _responses(spark: SparkSession, d: str) -> DataFrame:
    """Extraction responses as models give them: whole, partial, with null and mistyped fields, with a bare key or a lacking comma, cut off, or no JSON."""
    raw, k = dealt(checks_raw(spark, d), "rid", table(spark, d, "orders").count()), F.col("rid")
    null, quote = F.lit(None).cast("string"), F.lit('"')

    def text(x: Column) -> Column:
        return F.coalesce(F.concat(quote, x, quote), F.lit("null"))

    def member(name: str, value: Column, given: Column | None = None) -> Column:
        one = F.concat(F.lit(f'"{name}":'), value)
        return one if given is None else F.when(given, one)

    joint = F.when(k % 6 == 0, ',"is_joint":true').otherwise("")
    name = F.when(k % 3 == 0, F.concat(F.lit('{"full_name":"'), F.col("customer_name"), quote, joint, F.lit("}"))).when(k % 3 == 1, F.lit('"Ann Lee"')).otherwise("null")
    place = F.when(k % 4 == 0, F.concat(F.lit('{"street":"1 Elm","city":"Troy","state":"'), F.col("state"), F.lit('","zip":"12180","country":"Peru"}'))).when(k % 4 == 1, F.lit('["1 Elm"]')).otherwise("null")
    flag = F.when(k % 3 == 0, "true").when(k % 3 == 1, "false").otherwise("null")
    body = F.concat_ws(
        ",",
        member("check_number", F.when(k % 2 == 0, F.coalesce("check_number", F.lit("null"))).otherwise(text(F.col("check_number")))),
        member("date", text(F.col("check_date"))),
        member("amount_numeric", F.coalesce(F.when(k % 2 == 0, F.col("amount").cast("string")).otherwise(F.concat(F.lit('"$'), F.format_number("amount", 2), quote)), F.lit("null"))),
        member("amount_written", F.lit('"ten \\"and\\" 00/100"'), k % 5 == 0),
        member("payor_name", name),
        member("payor_address", place),
        member("payee", F.lit('"Bo, {x}: y"'), k % 7 != 0),
        member("bank_name", text(F.when(k % 8 == 0, "First Bank")), k % 2 == 0),
        member("bank_address", F.lit('"2 Oak"'), k % 9 == 0),
        member("micr_line", F.lit('"⑆1⑆ 2"'), k % 9 == 1),
        member("routing_number", F.when((k % 2 == 0) & ~F.col("routing_number").startswith("0"), F.col("routing_number")).otherwise(text(F.concat_ws("-", F.substring("routing_number", 1, 4), F.substring("routing_number", 5, 9))))),
        member("account_number", F.when(k % 2 == 0, F.coalesce("account_number", F.lit("null"))).otherwise(text(F.concat(F.lit(" "), "account_number", F.lit(" "))))),
        member("memo", text(F.col("memo"))),
        member("signature_present", flag, k % 4 != 3),
        member("signature_matches_payor", flag, k % 5 != 3),
        member("amounts_match", F.coalesce(F.col("amounts_match").cast("string"), F.lit("null"))),
        member("check_age_days", F.when(k % 2 == 0, "12.0").otherwise("-3"), k % 3 != 2),
        member("is_stale_dated", flag, k % 6 != 5),
        member("is_post_dated", F.lit("true"), k % 6 == 5),
        member("check_condition", F.concat(quote, F.col("check_condition"), quote), k % 4 != 0),
        member("requires_manual_review", flag, k % 7 != 6),
        member("raw_text", F.concat(F.lit('"text '), k.cast("string"), quote)),
        member("confidence", F.when(k % 7 == 1, "null").when(k % 7 == 2, "85.5").otherwise(F.col("confidence").cast("string")), k % 7 != 0),
        member("field_confidences", F.when(k % 11 == 0, '{"payee":40,"memo":77.5}').otherwise('{"payee":null}'), k % 11 < 2),
    )
    bare = F.regexp_replace(body, '^"check_number":', "check_number: ")
    run_on = F.regexp_replace(body, ',"date":', ' "date":')
    cut = F.expr("substring(body, 1, length(body) - 9)")
    whole = F.when(k % 10 == 6, F.lit("no json")).when(k % 10 == 4, F.concat(F.lit("{"), bare, F.lit("}"))).when(k % 10 == 8, F.concat(F.lit("{"), run_on, F.lit("}"))).when(k % 20 == 2, F.concat(F.lit("{"), cut)).otherwise(F.concat(F.lit("{"), F.col("body"), F.lit("}")))
    return raw.withColumn("body", body).select("rid", whole.alias("response"), F.concat(F.lit("{"), F.col("body"), F.lit("}")).alias("meant"))


_BAD = "(rid % 10 = 6 OR rid % 20 = 2)"
_PARSED = f"CASE WHEN {_BAD} THEN 'failed' WHEN rid % 10 IN (4, 8) THEN 'repaired' ELSE 'as_is' END"
_FLAG = "CASE rid % 3 WHEN 0 THEN true WHEN 1 THEN false END"
_EXTRACTED_SQL = (
    RAW
    + f""", b AS (SELECT *, {_PARSED} AS parsed, NOT {_BAD} AS ok FROM checks_raw),
x AS (
  SELECT rid, parsed, ok, CASE WHEN ok THEN check_number END AS check_number, CASE WHEN ok THEN check_date END AS check_date, CASE WHEN ok THEN CAST(amount AS DOUBLE) END AS amount,
    CASE WHEN ok AND rid % 5 = 0 THEN 'ten "and" 00/100' END AS amount_written, CASE WHEN ok AND rid % 7 <> 0 THEN 'Bo, {{x}}: y' END AS payee,
    CASE WHEN ok AND rid % 3 = 0 THEN customer_name END AS full_name, CASE WHEN ok AND rid % 3 = 0 THEN rid % 6 = 0 END AS is_joint, CASE WHEN ok AND rid % 3 = 1 THEN 'Ann Lee' END AS payor_text,
    CASE WHEN ok AND rid % 4 = 0 THEN state END AS payor_state, CASE WHEN ok AND rid % 4 = 0 THEN '12180' END AS zip,
    CASE WHEN ok AND rid % 8 = 0 THEN 'First Bank' END AS bank_name, CASE WHEN ok AND rid % 9 = 0 THEN '2 Oak' END AS bank_address, CASE WHEN ok AND rid % 9 = 1 THEN '⑆1⑆ 2' END AS micr_line,
    CASE WHEN ok AND length(routing_number) = 9 THEN routing_number END AS routing_number, CASE WHEN ok THEN account_number END AS account_number, CASE WHEN ok THEN memo END AS memo,
    CASE WHEN NOT ok OR rid % 4 = 3 THEN false ELSE {_FLAG} END AS signature_present, CASE WHEN ok AND rid % 5 <> 3 THEN {_FLAG} END AS signature_matches_payor, CASE WHEN ok THEN amounts_match END AS amounts_match,
    CASE WHEN ok AND rid % 3 <> 2 THEN CASE WHEN rid % 2 = 0 THEN 12 ELSE -3 END END AS age_days, CASE WHEN NOT ok OR rid % 6 = 5 THEN false ELSE {_FLAG} END AS is_stale_dated, ok AND rid % 6 = 5 AS is_post_dated,
    CASE WHEN NOT ok THEN 'poor' WHEN rid % 4 = 0 THEN 'fair' ELSE check_condition END AS check_condition, CASE WHEN NOT ok THEN true WHEN rid % 7 = 6 THEN false ELSE {_FLAG} END AS requires_manual_review,
    CASE WHEN ok THEN 'text ' || rid END AS raw_text, CASE WHEN NOT ok THEN 0e0 WHEN rid % 7 = 0 THEN 50e0 WHEN rid % 7 = 1 THEN NULL WHEN rid % 7 = 2 THEN 85.5e0 ELSE CAST(confidence AS DOUBLE) END AS confidence,
    CASE WHEN NOT ok THEN 0e0 WHEN rid % 11 = 0 THEN 40e0 WHEN rid % 11 = 1 THEN NULL ELSE 50e0 END AS fc_payee, CASE WHEN NOT ok THEN 0e0 WHEN rid % 11 = 0 THEN 77.5e0 ELSE 50e0 END AS fc_memo,
    CASE WHEN NOT ok THEN 'response is not a JSON object' END AS error, CASE WHEN ok AND rid % 3 = 0 THEN customer_name WHEN ok AND rid % 3 = 1 THEN 'Ann Lee' ELSE 'Unknown' END AS customer_name FROM b)
"""
)
_PLAIN = ("rid", "parsed", "check_number", "check_date", "amount", "amount_written", "payee", "payor_text", "bank_name", "bank_address", "micr_line", "routing_number", "account_number", "memo", "signature_present", "signature_matches_payor", "amounts_match", "age_days", "is_stale_dated", "is_post_dated", "check_condition", "requires_manual_review", "confidence", "error", "customer_name")


def _records(spark: SparkSession, d: str) -> DataFrame:
    return extraction.flat_fields(extraction.normalise(extraction.parse(_responses(spark, d))))


@query("c01_c09_extraction", _EXTRACTED_SQL + f"SELECT {', '.join(_PLAIN)}, full_name, is_joint, payor_state, zip, coalesce(raw_text, 'unread') AS raw_text, fc_payee, fc_memo, 50e0 * CAST(ok AS INT) AS fc_date FROM x")
def extracted(spark: SparkSession, d: str) -> DataFrame:
    sure = F.col("field_confidences")
    raw = F.when((F.col("parsed") == "failed") & (F.col("raw_text") == F.col("response")), "unread").otherwise(F.col("raw_text"))
    return _records(spark, d).select(*_PLAIN, "payor.full_name", "payor.is_joint", F.col("payor_address.state").alias("payor_state"), "payor_address.zip", raw.alias("raw_text"), sure["payee"].alias("fc_payee"), sure["memo"].alias("fc_memo"), sure["date"].alias("fc_date"))


@query("c02_repair", RAW + f"SELECT rid, {_PARSED} <> 'failed' AS whole FROM checks_raw")
def repaired(spark: SparkSession, d: str) -> DataFrame:
    """Repaired texts are those that were meant."""
    return _responses(spark, d).select("rid", (extraction.repair(F.col("response")) == F.col("meant")).alias("whole"))


@query("a11_raw_text", RAW + f"SELECT rid, 'text ' || rid AS raw_text FROM checks_raw WHERE {_PARSED} <> 'failed'")
def raw_text(spark: SparkSession, d: str) -> DataFrame:
    return extraction.parse(_responses(spark, d)).where("parsed <> 'failed'").select("rid", F.col("record")["raw_text"].alias("raw_text"))


_NL = "chr(10)"


def _section_sql(title: str, *lines: str) -> str:
    body = f"concat_ws({_NL}, {', '.join(lines)})"
    head = f"'{title}:' || {_NL} || " if title else ""
    return f"CASE WHEN {body} <> '' THEN {head}{body} || {_NL} END"


_NOTE_SQL = f"concat_ws({_NL}, " + ", ".join(
    [
        "'Check #' || coalesce(check_number, 'Unknown') || coalesce(' from ' || full_name, '')",
        "''",
        _section_sql("Payor Information", "'Name: ' || full_name", "CASE WHEN is_joint THEN '  (Joint Account)' END", "CASE WHEN payor_state IS NOT NULL THEN 'Address: 1 Elm' END", "CASE WHEN payor_state <> '' THEN 'City/State/ZIP: Troy, ' || payor_state || ' 12180' END", "CASE WHEN payor_state IS NOT NULL THEN 'Country: Peru' END"),
        _section_sql("Bank Information", "'Bank Name: ' || bank_name", "'Routing Number: ' || routing_number", "'Account Number: ' || account_number"),
        _section_sql("", "'Memo: ' || memo"),
        _section_sql("Amount Details", "'Numeric: $' || printf('%,.2f', coalesce(amount, 0))", "'Written: ' || amount_written", "CASE WHEN amounts_match THEN 'Amounts Match: ✓' WHEN NOT amounts_match THEN 'Amounts Match: ✗ WARNING - MISMATCH!' END"),
        _section_sql("Validation", "CASE WHEN signature_present THEN 'Signature Present: ✓' ELSE 'Signature Present: ✗' END", "'Check Condition: ' || check_condition", "'Check Age: ' || age_days || CASE WHEN age_days < 0 THEN ' days (POST-DATED)' ELSE ' days' END", "CASE WHEN is_post_dated THEN 'Post-Dated: ✓ WARNING' END", "CASE WHEN is_stale_dated THEN 'Stale-Dated: ✓ WARNING - >180 days old' END", "CASE WHEN requires_manual_review THEN 'Requires Manual Review: ✓' END"),
        _section_sql("", "'Confidence: ' || CASE WHEN confidence = floor(confidence) THEN CAST(CAST(confidence AS BIGINT) AS VARCHAR) ELSE CAST(confidence AS VARCHAR) END || '%'"),
        "'Extracted via Vertex AI Gemini Pro'",
    ]
) + ")"


@query("c14_full_note", _EXTRACTED_SQL + f"SELECT rid, {_NOTE_SQL} AS note FROM x")
def full_note(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("rid", payload.full_note().alias("note"))


_DATE_SQL = f"strftime(coalesce(CAST(try_strptime(check_date, '%m/%d/%Y') AS DATE), DATE '{AS_OF}'), '%Y-%m-%d')"
_QUOTED_NOTE = f"""'"' || replace(replace({_NOTE_SQL}, '"', chr(92) || '"'), {_NL}, chr(92) || 'n') || '"'"""


@query(
    "c16_mapped_receipt",
    _EXTRACTED_SQL
    + f"""SELECT rid, '{{"DocNumber":"' || coalesce(check_number, 'CHK-' || rid) || '","TxnDate":"' || {_DATE_SQL} || '","Line":[{{' || coalesce('"Amount":' || m || ',', '') || '"DetailType":"SalesItemLineDetail","SalesItemLineDetail":{{"ItemRef":{{"value":"3"}},"Qty":1' || coalesce(',"UnitPrice":' || m, '')
|| '}},"Description":"Check payment"}}]' || coalesce(',"TotalAmt":' || m, '') || ',"PaymentMethodRef":{{"value":"1"}},"DepositToAccountRef":{{"value":"2"}},"PrivateNote":' || {_QUOTED_NOTE} || ',"CustomerRef":{{' || CASE WHEN rid % 5 = 0 THEN '"value":"' || rid || '"' ELSE '"name":"' || coalesce(payee, full_name, 'Unknown Customer') || '"' END || '}}}}' AS payload
FROM (SELECT *, CAST(CAST(amount AS DECIMAL(12, 2)) AS VARCHAR) AS m FROM x)""",
)
def mapped_receipt(spark: SparkSession, d: str) -> DataFrame:
    customer = payload.customer_ref(F.when(F.col("rid") % 5 == 0, F.col("rid").cast("string")), F.col("payee"), F.col("payor.full_name"))
    date = scalars.iso_from_us(F.col("check_date"), F.lit(AS_OF).cast("date"))
    body = payload.mapped_receipt(F.col("check_number"), F.col("rid").cast("string"), date, F.col("amount").cast("decimal(12,2)"), customer, payload.full_note(), "1", "2", "3")
    return _records(spark, d).select("rid", body.alias("payload"))


# ------------------------------------------------------------------ outcomes

_STORED_IDS = (
    JUDGED
    + f""", pt AS (SELECT *, coalesce(routing_number, 'None') || coalesce(account_number, 'None') || coalesce(check_number, 'None') || coalesce(check_date, 'None') || coalesce(CAST(amount AS VARCHAR), 'None') AS id_text FROM judged WHERE route IN ('processed', 'manual_review')),
pm AS (SELECT *, route = 'processed' AND routing_number IS NOT NULL AND account_number IS NOT NULL AND check_number IS NOT NULL AND amount IS NOT NULL AND check_date IS NOT NULL AS mapped FROM pt),
po AS (SELECT *, count(*) FILTER (mapped) OVER w AS again, count(*) FILTER (NOT mapped) OVER w AS taken FROM pm WINDOW w AS (PARTITION BY id_text ORDER BY rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
kept AS (SELECT *, translate(to_base64(unhex(substr(sha256(CASE WHEN again > 0 THEN id_text || '|' || again ELSE id_text END), 1, 24))), '+/', '-_') AS check_id FROM po)
"""
)


@query(
    "b06_b08_stored_rows",
    _STORED_IDS
    + """SELECT rid, check_id, check_number, amount, CAST(confidence AS DOUBLE) AS ocr_confidence, route AS status, CASE WHEN route = 'manual_review' THEN review_reason END AS error_message FROM kept UNION ALL
SELECT rid, 'error_' || rid, NULL, NULL, NULL, 'failed', error FROM judged WHERE route = 'failed'""",
)
def stored_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of processed, manual-review and failed submissions, read back from the store."""
    j, home = judged(spark, d), shared(spark, "outcomes")
    outcomes.write(j, home, 0, F.lit(AS_OF).cast("date"))
    return commits.read(spark, home, "checks").select("rid", "check_id", "check_number", "amount", "ocr_confidence", "status", "error_message")


@query(
    "b06_g07_mappings",
    _STORED_IDS + "SELECT check_id, routing_number, account_number, check_number, amount, check_date, customer_name FROM kept WHERE route = 'processed' AND routing_number IS NOT NULL AND account_number IS NOT NULL AND check_number IS NOT NULL AND amount IS NOT NULL AND check_date IS NOT NULL",
)
def mapping_rows(spark: SparkSession, d: str) -> DataFrame:
    return outcomes.mappings(outcomes.with_ids(judged(spark, d)))


@query(
    "c15_c17_receipt",
    _STORED_IDS
    + """SELECT rid, check_id, '{"CustomerRef":{"value":"' || customer_name || '"},"TxnDate":"' || CASE WHEN try_strptime(check_date, '%m/%d/%Y') IS NULL AND try_strptime(check_date, '%Y-%m-%d') IS NOT NULL THEN check_date ELSE strftime(coalesce(CAST(try_strptime(check_date, '%m/%d/%Y') AS DATE), DATE '1998-08-02'), '%Y-%m-%d') END
|| '","DocNumber":"' || check_id || '"' || coalesce(',"PaymentRefNum":"' || check_number || '"', '') || ',"PaymentMethodRef":{"value":"1"},"DepositToAccountRef":{"value":"2"},"Line":[{' || coalesce('"Amount":' || CAST(amount AS VARCHAR) || ',', '')
|| '"DetailType":"SalesItemLineDetail","SalesItemLineDetail":{"ItemRef":{"value":"3"}},"Description":"Check #' || coalesce(check_number, 'None') || '"}],"PrivateNote":"' || coalesce('Memo: ' || memo, '') || '","BillAddr":{"CountrySubDivisionCode":"' || state || '","Country":"USA"}}' AS payload
FROM kept WHERE route = 'processed'""",
)
def receipts(spark: SparkSession, d: str) -> DataFrame:
    return outcomes.receipts(outcomes.with_ids(judged(spark, d)), F.lit(AS_OF).cast("date"), "1", "2", "3")


@query("e15_log_events", _STORED_IDS + "SELECT check_id, 'processed' AS event_type, 'Successfully processed check' AS event_data FROM kept WHERE route = 'processed'")
def log_events(spark: SparkSession, d: str) -> DataFrame:
    return outcomes.log_events(outcomes.with_ids(judged(spark, d)))


_CLASHING_IDS = _STORED_IDS.replace(CHECKS_RAW_SQL, f"{CHECKS_RAW_SQL}, {CLASHING_SQL}", 1).replace("AS age_days FROM checks_raw)", "AS age_days FROM clashing)").replace("ORDER BY rid ROWS", "ORDER BY rid % 3, rid ROWS")


@query(
    "g02_b03_ids_over_polls",
    _CLASHING_IDS
    + """SELECT rid, CASE WHEN taken = 0 THEN check_id ELSE 'error_' || rid END AS check_id, CASE WHEN taken = 0 THEN route ELSE 'failed' END AS status, mapped AND taken = 0 AS mapped FROM kept UNION ALL
SELECT rid, 'error_' || rid, 'failed', false FROM judged WHERE route = 'failed'""",
)
def ids_over_polls(spark: SparkSession, d: str) -> DataFrame:
    """Three polls of rows whose id texts clash across them; an id that an unmapped row keeps is refused to later ones."""
    raw, home, rules = stored(clashing(checks_raw(spark, d)), "clashing"), shared(spark, "polls"), Settings(unique_ids=True)
    handle = intake.intake(home, AS_OF, rules)
    for number in range(3):
        handle(raw.where(F.col("rid") % 3 == number), number)
    mapped = commits.read(spark, home, "mappings").select("check_id", F.lit(True).alias("mapped"))
    checks = commits.read(spark, home, "checks").select("rid", "check_id", "status")
    return checks.join(mapped, "check_id", "left").select("rid", "check_id", "status", F.coalesce("mapped", F.lit(False)).alias("mapped"))


# ------------------------------------------------------- more of the store


@query("b04_append_event", "SELECT event_id AS id, CAST(user_id AS VARCHAR) AS check_id, event_type, ts AS timestamp FROM events")
def append_event(spark: SparkSession, d: str) -> DataFrame:
    out = shared(spark, "logs")
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("check_id"), "event_type", F.col("ts").alias("timestamp"))
    for part in (0, 1):  # two appends
        rows.where(F.col("id") % 2 == part).write.mode("append").parquet(out)
    return spark.read.schema(rows.schema).parquet(out)


@query("f04_mapping_lookup", _IDS + "SELECT check_id, rid FROM ids WHERE check_id = (SELECT check_id FROM ids WHERE rid = 2000)")
def mapping_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = dedup.with_hash_ids(checks_raw(spark, d)).select("check_id", "rid")
    return rows.join(rows.where("rid = 2000").select("check_id"), "check_id", "left_semi")


@query("f07_existence", "SELECT DISTINCT event_type AS service, event_type IN (SELECT event_type FROM events WHERE event_id < 5) AS known FROM events")
def existence(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    old = e.where("event_id < 5").select("event_type").distinct().withColumn("hit", F.lit(True))
    return e.select("event_type").distinct().join(old, "event_type", "left").select(F.col("event_type").alias("service"), F.coalesce("hit", F.lit(False)).alias("known"))


@query("e08_manual_flag", JUDGED + "SELECT rid, NOT (overall >= 75 AND NOT coalesce(fc_routing_number < 70, false) AND NOT coalesce(fc_amount < 70, false) AND NOT coalesce(fc_check_number < 70, false)) AS manual FROM judged")
def manual_flag(spark: SparkSession, d: str) -> DataFrame:
    return scoring.recommendation(scoring.with_scores(checks_raw(spark, d))).select("rid", (F.col("action") == "manual_review").alias("manual"))


@query("b26_error_facts", "SELECT event_id, 'HTTP ' || (CASE WHEN event_id % 2 = 0 THEN 500 ELSE 404 END) AS message, CAST(a AS INT) AS attempt FROM events, range(0, 3) AS r(a) WHERE a = 0 OR event_id % 2 = 0")
def error_facts(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_id") % 2 == 0, 500).otherwise(404)
    tries = table(spark, d, "events").select("event_id", status.alias("s"), F.explode(F.sequence(F.lit(0), F.lit(S.api_attempts - 1))).alias("attempt"))
    seen = (F.col("attempt") == 0) | validation.should_retry(F.col("s"), F.col("attempt") - 1, S.api_attempts)
    return tries.where(seen).select("event_id", payload.api_error(F.lit("{}"), F.col("s"))["message"].alias("message"), F.col("attempt").cast("int").alias("attempt"))


# ------------------------------------------------------------------ streams


@query("s01_s06_stream", JUDGED + "SELECT rid, route AS event_type FROM judged")
def stream(spark: SparkSession, d: str) -> DataFrame:
    """Two polls over a landing folder; the second sees what the first stored."""
    rows, home = checks_raw(spark, d), shared(spark, "intake")
    for early in (True, False):
        (rows.where("rid < 5000") if early else rows.where("rid >= 5000")).write.mode("append").parquet(f"{home}/in")
        intake.poll(intake.landing(spark, f"{home}/in", rows.schema), intake.intake(f"{home}/out", AS_OF), f"{home}/at", once=True).awaitTermination()
    return spark.read.schema("rid long, event_type string").parquet(f"{home}/out/logs/*")


@query("b21_crop_names", _BOXES + "SELECT page, det, 'scan' || page || '_p' || (page % 3 + 1) || '_idx' || det || '_19980802000000000000.png' AS name FROM detections")
def crop_names(spark: SparkSession, d: str) -> DataFrame:
    name = scalars.crop_name(F.concat(F.lit("scan"), F.col("page").cast("string"), F.lit(".pdf")), F.col("page") % 3, F.col("det"), F.lit("19980802000000000000"))
    return h_detect(spark, d).select("page", "det", name.alias("name"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
