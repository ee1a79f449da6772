"""Text, number, date and name functions of the intake rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colours by confidence, content types by extension, receipt hosts by environment.
COLOURS = ((90, "#2ca01c"), (70, "#f39c12"), (None, "#e74c3c"))
CONTENT_TYPES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".pdf": "application/pdf", ".tif": "image/tiff", ".tiff": "image/tiff"}
RECEIPT_HOSTS = {"sandbox": "https://app.sandbox.qbo.intuit.com", "production": "https://app.qbo.intuit.com"}
API_HOSTS = {"sandbox": "https://sandbox-quickbooks.api.intuit.com", "production": "https://quickbooks.api.intuit.com"}


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def truthy(x: Column) -> Column:
    """A text that is neither null nor empty."""
    return F.coalesce(x, F.lit("")) != ""


def parse_amount(x: Column) -> Column:
    """'$1,234.50' as a number; null if it isn't one."""
    return F.trim(F.regexp_replace(x, "[$,]", "")).try_cast("double")


def clean_routing(x: Column) -> Column:
    digits = F.regexp_replace(x, "[^0-9]", "")
    return F.when(F.length(digits) == 9, digits)


def clean_account(x: Column) -> Column:
    return F.trim(x.cast("string"))


def safe_number(x: Column) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(0.0))


def money(x: Column) -> Column:
    """'$1,234.50'; N/A for null and empty, other text unchanged."""
    text = x.cast("string")
    return F.when(~truthy(text), "N/A").otherwise(F.coalesce(F.concat(F.lit("$"), F.format_number(text.try_cast("decimal(18,2)"), 2)), text))


def us_date(x: Column) -> Column:
    return F.try_to_date(x, "M/d/yyyy")


def any_date(x: Column) -> Column:
    return F.coalesce(us_date(x), F.try_to_date(x, "yyyy-M-d"))


def iso_from_us(x: Column, as_of: Column) -> Column:
    """ISO text of a month-first date; as_of for anything else."""
    return F.date_format(F.coalesce(us_date(x), as_of), "yyyy-MM-dd")


def iso_from_any(x: Column, as_of: Column) -> Column:
    """ISO text of a month-first date; valid ISO text stays as it is; as_of for anything else."""
    day = F.date_format(us_date(x), "yyyy-MM-dd")
    return F.coalesce(day, F.when(F.try_to_date(x, "yyyy-M-d").isNotNull(), x), F.date_format(as_of, "yyyy-MM-dd"))


def payor_name(payor: Column, full: Column, first: Column, middle: Column, last: Column, text: Column | None = None) -> Column:
    """The first that isn't blank of the payor text, the full name, the parts together, a name that came as plain text."""
    parts = F.concat_ws(" ", *(blank_to_null(p) for p in (first, middle, last)))
    plain = [] if text is None else [blank_to_null(text)]
    return F.coalesce(blank_to_null(payor), blank_to_null(full), F.nullif(parts, F.lit("")), *plain, F.lit("Unknown"))


def sender_name(email_from: Column) -> Column:
    """The display part of a sender, before the address in angle brackets, without quotes."""
    return F.regexp_replace(F.trim(F.substring_index(email_from, "<", 1)), '^"+|"+$', "")


def given_name(name: Column) -> Column:
    return F.coalesce(F.get(F.split(F.trim(name), r"\s+"), F.lit(0)), F.lit(""))


def family_name(name: Column) -> Column:
    parts = F.split(F.trim(name), r"\s+")
    return F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise("")


def extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"(\.[^.]+)$", 1))


def content_type(filename: Column) -> Column:
    out = F.lit("application/octet-stream")
    for ext, kind in CONTENT_TYPES.items():
        out = F.when(extension(filename) == ext, kind).otherwise(out)
    return out


def crop_name(filename: Column, page: Column, index: Column, stamp: Column) -> Column:
    """The file name of a cropped check: pages count from 1, checks from 0."""
    stem = F.coalesce(F.nullif(F.regexp_replace(filename, r"\.[^.]+$", ""), F.lit("")), F.lit("check"))
    return F.concat(stem, F.lit("_p"), (page + 1).cast("string"), F.lit("_idx"), index.cast("string"), F.lit("_"), stamp, F.lit(".png"))


def safe_filename(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"[^\p{L}\p{N} _-]", ""))


def colour(confidence: Column) -> Column:
    (green, a), (amber, b), (_, red) = COLOURS
    return F.when(confidence >= green, a).when(confidence >= amber, b).otherwise(red)


def reply_subject(original: Column, check_number: Column, has_info: Column, suffix: str) -> Column:
    kept = F.trim(original)
    reply = F.when(F.lower(kept).startswith("re:"), kept).otherwise(F.concat(F.lit("Re: "), kept))
    numbered = F.concat(F.lit("Re: Check #"), F.coalesce(check_number, F.lit("Unknown")), F.lit(f" {suffix}"))
    return F.when(truthy(original), reply).when(has_info, numbered).otherwise(f"Re: {suffix}")


def message_ids(raw: Column) -> Column:
    """Bracketed message ids of a header, whatever separates and quotes them."""
    bare = F.transform(F.split(raw, r"[\s,;]+"), lambda p: F.regexp_replace(F.regexp_replace(p, '^"+|"+$', ""), "^[<>]+|[<>]+$", ""))
    return F.transform(F.filter(bare, lambda p: p != ""), lambda p: F.concat(F.lit("<"), p, F.lit(">")))


def id_spellings(raw: Column) -> Column:
    bare = F.regexp_replace(raw, "^[<>]+|[<>]+$", "")
    return F.array_distinct(F.array(raw, bare, F.concat(F.lit("<"), bare, F.lit(">"))))


def folder_name(name: Column, inbox: str = "INBOX") -> Column:
    return F.regexp_replace(name, rf"^{inbox}[/.]", "")


def sender_address(user: Column, fallback_domain: str = "example.com") -> Column:
    """check_processor@ the domain after the first '@' of the user."""
    domain = F.get(F.split(user, "@"), F.lit(1))
    return F.concat(F.lit("check_processor@"), F.coalesce(F.nullif(domain, F.lit("")), F.lit(fallback_domain)))


def receipt_url(receipt_id: Column, realm: Column, environment: str) -> Column:
    host = RECEIPT_HOSTS["sandbox" if environment == "sandbox" else "production"]
    return F.concat(F.lit(f"{host}/app/salesreceipt?txnId="), receipt_id, F.lit("&companyid="), realm)


def api_base(environment: str) -> str:
    return API_HOSTS["production" if environment == "production" else "sandbox"]


def callback_parameter(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit("QUERY"), F.lit(name))


def escape_html(x: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(char), F.lit(entity))
    return x


def retry_delay(attempt: Column, delay: float, multiplier: float) -> Column:
    """Seconds before the attempt after the given one, counted from 1."""
    return F.lit(delay) * F.pow(F.lit(multiplier), attempt - 1)
