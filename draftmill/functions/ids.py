"""Deterministic and reversible identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAYLOAD = "cn string, amt string, dt string, cid string, rn string"


def _as_text(x: Column) -> Column:
    """A null field is written as None in the texts that are hashed."""
    return F.coalesce(x.cast("string"), F.lit("None"))


def hash_input(routing: Column, account: Column, check_number: Column, date: Column, amount: Column, separator: str = "") -> Column:
    return F.concat_ws(separator, *(_as_text(x) for x in (routing, account, check_number, date, amount)))


def hash_id(text: Column, occurrence: Column | None = None) -> Column:
    """The first 12 bytes of the SHA-256, as 16 characters safe in URLs; later occurrences of a text add |n."""
    full = text if occurrence is None else F.when(occurrence > 0, F.concat(text, F.lit("|"), occurrence.cast("string"))).otherwise(text)
    return F.translate(F.base64(F.unhex(F.substring(F.sha2(full, 256), 1, 24))), "+/", "-_")


def doc_number(text: Column) -> Column:
    return F.substring(F.upper(F.sha1(text)), 1, 21)


def reversible_id(check_number: Column, amount: Column, date: Column, customer: Column, routing: Column) -> Column:
    last4 = F.when(F.coalesce(routing, F.lit("")) != "", F.right(routing, F.lit(4))).otherwise("")
    data = F.struct(check_number.alias("cn"), _as_text(amount).alias("amt"), date.alias("dt"), customer.alias("cid"), last4.alias("rn"))
    return F.regexp_replace(F.translate(F.base64(F.to_json(data, {"ignoreNullFields": "false"}).cast("binary")), "+/", "-_"), "[=\r\n]+", "")


def decode(shareable: Column) -> Column:
    """(cn, amt, dt, cid, rn) of a reversible id, all null for other texts; amt as a number where it is one."""
    plain = F.translate(shareable, "-_", "+/")
    padded = F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4))))
    return F.from_json(F.try_to_binary(padded, F.lit("base64")).cast("string"), PAYLOAD)
