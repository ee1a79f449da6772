"""Predicates on fields, attachments, entities and errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from draftmill.functions.scalars import extension, truthy

# Attachment kinds, extensions, status codes, shapes of fields, words and types of accounting entities.
ATTACHMENT_TYPES = ("application/pdf", "image/jpeg", "image/png", "image/tiff")
ATTACHMENT_EXTENSIONS = (".pdf", ".jpg", ".jpeg", ".png", ".tiff", ".tif")
NEVER_RETRIED = (400, 401, 403, 404)
RETRIED = (429, 500, 502, 503, 504)
ROUTING_FORMAT = "^[0-9]{9}$"
ACCOUNT_FORMAT = "^[0-9]{4,17}$"
CHECK_NUMBER_FORMAT = "^[0-9]{1,6}$"
DATE_FORMATS = ("[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}", "[0-9]{4}-[0-9]{2}-[0-9]{2}", "[0-9]{1,2}-[0-9]{1,2}-[0-9]{2,4}")
ACCOUNT_WORDS = ("undeposited", "checking", "savings")
ACCOUNT_TYPE = "Bank"
ITEM_TYPES = ("Service", "NonInventory")
PAYMENT_WORD = "check"


def is_attachment(content_type: Column, filename: Column) -> Column:
    return content_type.isin(*ATTACHMENT_TYPES) & extension(filename).isin(*ATTACHMENT_EXTENSIONS)


def routing_format(x: Column) -> Column:
    return x.rlike(ROUTING_FORMAT)


def account_format(x: Column) -> Column:
    return x.rlike(ACCOUNT_FORMAT)


def check_number_format(x: Column) -> Column:
    return x.rlike(CHECK_NUMBER_FORMAT)


def amount_format(x: Column) -> Column:
    value = x.try_cast("double")
    return F.coalesce((value > 0) & (value < 1_000_000), F.lit(False))


def date_format(x: Column) -> Column:
    return x.rlike(f"^({'|'.join(DATE_FORMATS)})$")


def routing_checksum(x: Column) -> Column:
    """Weights 3, 7, 1 over nine digits; the sum ends in 0."""
    weights = (3, 7, 1, 3, 7, 1, 3, 7, 1)
    digit = [F.substring(x, k + 1, 1).try_cast("int") for k in range(9)]
    total = digit[0] * weights[0]
    for d, w in zip(digit[1:], weights[1:], strict=True):
        total = total + d * w
    return F.when(routing_format(x), total % 10 == 0).otherwise(False)


def duplicate_gate(routing: Column, check_number: Column) -> Column:
    return truthy(routing) & truthy(check_number)


def should_retry(status: Column, attempt: Column, attempts: int) -> Column:
    """Attempts count from 0; a null status is a failure without a response."""
    return F.when(attempt >= attempts - 1, False).when(status.isNull(), True).when(status.isin(*NEVER_RETRIED), False).when(status.isin(*RETRIED), True).otherwise(False)


def permanent_auth_error(message: Column) -> Column:
    return F.coalesce(F.lower(message).rlike("invalid|revoked|expired"), F.lit(False))


def token_expiring(now: Column, expires_at: Column) -> Column:
    return now >= expires_at - F.expr("INTERVAL 5 MINUTES")


def account_highlight(name: Column, kind: Column) -> Column:
    """Accounts that a receipt may be deposited to."""
    low = F.lower(name)
    return reduce(Column.__or__, (low.contains(w) for w in ACCOUNT_WORDS)) | (kind == ACCOUNT_TYPE)


def item_highlight(kind: Column) -> Column:
    """Items that a receipt may sell."""
    return kind.isin(*ITEM_TYPES)


def payment_highlight(name: Column) -> Column:
    """Payment methods that stand for a check."""
    return F.lower(name).contains(PAYMENT_WORD)
