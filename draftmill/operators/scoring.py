"""Confidence scores, recommendations and review rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftmill.functions import validation as v
from draftmill.functions.scalars import truthy

# Weights of the overall score, points of each field, valid or not.
WEIGHTS = {"char": 0.4, "format": 0.2, "checksum": 0.2, "consistency": 0.2}
POINTS = {"account_number": (80.0, 30.0), "check_number": (90.0, 40.0), "amount": (85.0, 35.0), "date": (80.0, 30.0)}
CRITICAL = ("routing_number", "amount", "check_number")


def _fields() -> dict[str, tuple[Column, Column]]:
    """Field to (present, valid); an amount of 0 is not present."""
    return {
        "routing_number": (truthy(F.col("routing_number")), v.routing_format(F.col("routing_number"))),
        "account_number": (truthy(F.col("account_number")), v.account_format(F.col("account_number"))),
        "check_number": (truthy(F.col("check_number")), v.check_number_format(F.col("check_number"))),
        "amount": (F.coalesce(F.col("amount") != 0, F.lit(False)), v.amount_format(F.col("amount"))),
        "date": (truthy(F.col("check_date")), v.date_format(F.col("check_date"))),
    }


def char_score(confidence: Column, line_confidences: Column | None = None) -> Column:
    """The record's confidence, or the mean of its lines', or 50."""
    if line_confidences is None:
        return F.coalesce(confidence.cast("double"), F.lit(50.0))
    known = F.filter(line_confidences, lambda x: x.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(known), F.lit(0))
    return F.coalesce(confidence.cast("double"), mean, F.lit(50.0))


def format_score() -> Column:
    fields = _fields().values()
    present = reduce(Column.__add__, (F.when(p, 1).otherwise(0) for p, _ in fields))
    good = reduce(Column.__add__, (F.when(p & ok, 1).otherwise(0) for p, ok in fields))
    return F.when(present > 0, good * 100.0 / present).otherwise(0.0)


def checksum_score() -> Column:
    return F.when(v.routing_checksum(F.col("routing_number")), 100.0).otherwise(0.0)


def field_confidence(name: str) -> Column:
    """Null where the field is absent."""
    present, ok = _fields()[name]
    if name == "routing_number":
        return F.when(present, F.when(ok, 50.0).otherwise(0.0) + F.when(v.routing_checksum(F.col(name)), 50.0).otherwise(0.0))
    good, bad = POINTS[name]
    return F.when(present, F.when(ok, good).otherwise(bad))


def consistency(runs: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """For each key the share of comparable fields on which all runs agree, times 100; 50 where nothing is comparable."""
    aggs, same, known = [F.count("*").alias("runs")], [], []
    for f in fields:
        aggs += [F.count(f).alias(f"n_{f}"), F.min(F.col(f).cast("string")).alias(f"lo_{f}"), F.max(F.col(f).cast("string")).alias(f"hi_{f}")]
        comparable = F.col(f"n_{f}") >= 2
        known.append(F.when(comparable, 1).otherwise(0))
        same.append(F.when(comparable & (F.col(f"lo_{f}") == F.col(f"hi_{f}")), 1).otherwise(0))
    n, m = reduce(Column.__add__, known), reduce(Column.__add__, same)
    return runs.groupBy(key).agg(*aggs).select(key, F.when((F.col("runs") >= 2) & (n > 0), m * 100.0 / n).otherwise(50.0).alias("consistency"))


def with_scores(df: DataFrame, consistency_score: Column | None = None) -> DataFrame:
    """Adds the part scores, the overall score and the field confidences (fc_*)."""
    c = F.lit(0.0) if consistency_score is None else consistency_score
    df = df.withColumns({"char_score": char_score(F.col("confidence")), "format_score": format_score(), "checksum_score": checksum_score()})
    overall = F.col("char_score") * WEIGHTS["char"] + F.col("format_score") * WEIGHTS["format"] + F.col("checksum_score") * WEIGHTS["checksum"] + c * WEIGHTS["consistency"]
    return df.withColumn("overall", F.round(overall, 6)).withColumns({f"fc_{f}": field_confidence(f) for f in _fields()})


def low_critical() -> Column:
    return F.filter(F.array(*(F.when(F.col(f"fc_{f}") < 70, F.lit(f)) for f in CRITICAL)), lambda x: x.isNotNull())


def recommendation(df: DataFrame, threshold: float = 75.0) -> DataFrame:
    """Adds ``action``, ``reason`` and ``low_fields`` by the overall score and the critical fields."""
    df = df.withColumn("low_fields", F.array_join(low_critical(), ", "))
    high, low = F.col("overall") >= threshold, F.col("low_fields") != ""
    action = F.when(high & ~low, "auto_process").otherwise("manual_review")
    reason = F.when(~high, "Low overall confidence").when(low, F.concat(F.lit("Low confidence in critical fields: "), F.col("low_fields"))).otherwise("High confidence in all fields")
    return df.withColumns({"action": action, "reason": reason})


def advisory(confidence: Column, threshold: float) -> Column:
    return F.when(confidence >= threshold, "auto_process").otherwise("manual_review")


def with_age(df: DataFrame, as_of: Column, day: Column, stale_days: int) -> DataFrame:
    """Adds the age in days, and whether the check is stale or post-dated; all unknown without a date."""
    age = F.datediff(as_of, day)
    return df.withColumn("age_days", age).withColumns({"is_stale": F.coalesce(F.col("age_days") > stale_days, F.lit(False)), "is_post_dated": F.coalesce(F.col("age_days") < 0, F.lit(False))})


def review_flag(prompt_confidence: float, field_threshold: float) -> Column:
    """The review flag as the extraction rules define it; ``payee_confidence`` is the extraction's own, the other fields' are scored here."""
    low = reduce(Column.__or__, (F.coalesce(F.col(c) < field_threshold, F.lit(False)) for c in ("fc_amount", "payee_confidence", "fc_routing_number", "fc_account_number")))
    return (F.col("confidence") < prompt_confidence) | F.coalesce(~F.col("amounts_match"), F.lit(False)) | low | (F.col("check_condition") == "poor") | F.col("is_stale") | F.col("is_post_dated")


def review_reason(threshold: float) -> Column:
    """Why a check needs review, null if it doesn't; needs ``flagged``. An unknown amounts_match counts as a mismatch."""
    post = F.when(F.col("is_post_dated"), F.concat(F.lit("post-dated ("), F.abs("age_days").cast("string"), F.lit(" days in future)")))
    stale = F.when(F.col("is_stale"), F.concat(F.lit("stale-dated ("), F.col("age_days").cast("string"), F.lit(" days old)")))
    mismatch = F.when(~F.coalesce(F.col("amounts_match"), F.lit(False)), "amounts mismatch")
    poor = F.when(F.col("check_condition") == "poor", "poor condition")
    reasons = F.concat_ws(", ", post, stale, mismatch, poor)
    low = F.concat(F.lit("Low OCR confidence ("), F.format_number("confidence", 1), F.lit(f"%) below threshold {threshold:.1f}%"))
    return F.when(F.col("flagged"), F.concat(F.lit("Vertex AI flagged for manual review: "), F.when(reasons != "", reasons).otherwise("AI recommendation"))).when(F.col("confidence") < threshold, low)
