"""The extraction record: parsing, repair, defaults and the flat field list.

A response is read field by field: its top level becomes a map of texts, and
each field is cast on its own, so that one field of an unexpected type never
costs the others.  Only text that is no JSON object fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftmill.functions import scalars

# The record's fields, those with a confidence of their own, and the parts of names and addresses.
CONFIDENCE_FIELDS = ("check_number", "date", "amount_numeric", "amount_written", "payee", "payor_name", "payor_address", "bank_name", "bank_address", "micr_line", "routing_number", "account_number", "memo")
NAME_FIELDS = ("first_name", "middle_name", "last_name", "full_name")
ADDRESS_FIELDS = ("street", "city", "state", "zip", "country")

# Tokens of JSON, well-formed or not: text, number, word, mark, white space, anything else.  All are taken whole and never given back.
_TEXT, _NUMBER, _WORD = r'"(?:[^"\\]++|\\.)*+"', "-?[0-9][0-9.eE+-]*+", "[A-Za-z_][A-Za-z0-9_]*+"
#: A key with its colon to come.
_KEY = rf'(?>{_TEXT}|{_WORD}|")(?=\s*+:)'
#: The end of a value; a quote that nothing closes counts as one.
_ENDED = rf'(?>{_TEXT}|{_NUMBER}|{_WORD}|[\]}}"])'
_OTHER = r'-(?![0-9])|[^-A-Za-z0-9_"\]}]'
# Each matches a run of tokens, from the last match on, up to the next place to mend.
LACKS_COMMA = rf'\G((?:{_ENDED}(?!\s*+{_KEY})|{_OTHER})*+{_ENDED}\s*+)(?={_KEY})'
LACKS_QUOTES = rf'\G((?:(?>{_TEXT}|{_NUMBER}|{_WORD}(?!\s*+:)|-(?![0-9])|[^-A-Za-z0-9_]))*+)({_WORD})'
WHITE = rf'\G((?:(?>{_TEXT}|\S))*+)\s++'


def repair(text: Column) -> Column:
    """Compact JSON from text that lacks quotes around keys, or commas between members.

    A bare word before a colon is a key and gets quotes.  A key right after the
    end of a value (a text, a number, a word such as true, a closing bracket)
    lacks a comma and gets one.  Texts are whole tokens, so nothing within them
    changes.  Three compiled replacements over the text, as the same by
    functions over an array of tokens would be interpreted token by token.
    """
    with_commas = F.regexp_replace(text, LACKS_COMMA, "$1,")
    return F.regexp_replace(F.regexp_replace(with_commas, LACKS_QUOTES, '$1"$2"'), WHITE, "$1")


def _object(text: Column) -> Column:
    """A JSON object as a map from its keys to texts (nested values as their JSON); null for anything else."""
    return F.when(F.ltrim(text).startswith("{"), F.from_json(text, "map<string,string>"))


def parse(df: DataFrame, text: str = "response") -> DataFrame:
    """Adds ``record``, a map from field to text, and ``parsed``: as_is, repaired or failed."""
    first = df.withColumn("_first", _object(F.col(text)))
    # A column of its own, as _object reads it twice.
    mended = first.withColumn("_mended", F.when(F.col("_first").isNull(), repair(F.col(text))))
    both = mended.withColumn("_second", _object(F.col("_mended")))
    state = F.when(F.col("_first").isNotNull(), "as_is").when(F.col("_second").isNotNull(), "repaired").otherwise("failed")
    # A generator is where the optimiser stops: neither filters nor fields that are asked for later copy the parsing below it.
    one = F.struct(state.alias("parsed"), F.coalesce("_first", "_second").alias("record"))
    return both.select(*df.columns, F.inline(F.array(one)))


def normalise(df: DataFrame, text: str = "response") -> DataFrame:
    """One flat, cleaned row a record: its 24 fields and ``error``.

    A default stands for a missing field only; a field that is null stays null.
    A failed record gets the values of the error record.  A name or address that
    is no object is null; ``payor_text`` keeps a name that came as plain text.
    """
    r, failed = F.col("record"), F.col("parsed") == "failed"

    def field(name: str, kind: str | None = None) -> Column:
        return r[name] if kind is None else r[name].try_cast(kind)

    def or_default(name: str, kind: str, ok: object, bad: object) -> Column:
        value = F.when(F.map_contains_key(r, name), field(name, kind)).otherwise(F.lit(ok).cast(kind))
        return F.when(failed, F.lit(bad).cast(kind)).otherwise(value).alias(name)

    def flag(name: str, bad: bool = False) -> Column:
        return or_default(name, "boolean", False, bad)

    name, address, sure = (F.col(c) for c in ("_name", "_address", "_sure"))
    joint = F.when(F.map_contains_key(name, "is_joint"), name["is_joint"].try_cast("boolean")).otherwise(False)
    payor = F.struct(*(name[f].alias(f) for f in NAME_FIELDS[:3]), joint.alias("is_joint"), name[NAME_FIELDS[3]].alias(NAME_FIELDS[3]))
    sureness = F.struct(*(F.when(failed, 0.0).when(F.map_contains_key(sure, f), sure[f].try_cast("double")).otherwise(50.0).alias(f) for f in CONFIDENCE_FIELDS))
    keep = [c for c in df.columns if c not in ("record", "parsed")]
    with_parts = df.withColumns({"_name": _object(r["payor_name"]), "_address": _object(r["payor_address"]), "_sure": F.coalesce(_object(r["field_confidences"]), F.create_map().cast("map<string,string>"))})
    return with_parts.select(
        *keep,
        "parsed",
        field("check_number").alias("check_number"),
        field("date").alias("check_date"),
        scalars.parse_amount(r["amount_numeric"]).alias("amount"),
        field("amount_written").alias("amount_written"),
        field("payee").alias("payee"),
        F.when(name.isNotNull(), payor).alias("payor"),
        F.when(name.isNull(), r["payor_name"]).alias("payor_text"),
        F.when(address.isNotNull(), F.struct(*(address[f].alias(f) for f in ADDRESS_FIELDS))).alias("payor_address"),
        field("bank_name").alias("bank_name"),
        field("bank_address").alias("bank_address"),
        field("micr_line").alias("micr_line"),
        scalars.clean_routing(r["routing_number"]).alias("routing_number"),
        scalars.clean_account(r["account_number"]).alias("account_number"),
        field("memo").alias("memo"),
        flag("signature_present"),
        field("signature_matches_payor", "boolean").alias("signature_matches_payor"),
        field("amounts_match", "boolean").alias("amounts_match"),
        field("check_age_days", "double").cast("int").alias("age_days"),
        flag("is_stale_dated"),
        flag("is_post_dated"),
        or_default("check_condition", "string", "fair", "poor"),
        flag("requires_manual_review", True),
        F.when(failed, F.coalesce(F.col(text), F.lit(""))).when(F.map_contains_key(r, "raw_text"), r["raw_text"]).otherwise("").alias("raw_text"),
        or_default("confidence", "double", 50.0, 0.0),
        sureness.alias("field_confidences"),
        F.when(failed, "response is not a JSON object").alias("error"),
    )


def flat_fields(df: DataFrame) -> DataFrame:
    """The short field list that later steps use, with the customer's name."""
    parts = (F.col(f"payor.{f}") for f in ("full_name", "first_name", "middle_name", "last_name"))
    return df.withColumn("customer_name", scalars.payor_name(F.lit(None).cast("string"), *parts, text=F.col("payor_text")))
