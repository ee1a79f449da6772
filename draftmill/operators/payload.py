"""Receipt payloads, notes and notification texts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from draftmill.functions import scalars


# The labels, rules and sentences of notes, summaries and notifications below are part of their texts.


def _line(label: str, x: Column) -> Column:
    """'label: x', null where x is null or empty, so that concat_ws leaves it out."""
    return F.when(scalars.truthy(x.cast("string")), F.concat(F.lit(label), x.cast("string")))


def minimal_note(memo: Column, micr: Column) -> Column:
    return F.concat_ws("\n", _line("Memo: ", memo), _line("MICR: ", micr))


def _number(x: Column) -> Column:
    """A number's text, without a fraction where it is whole."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def _section(title: str, *lines: Column, given: Column | None = None) -> Column:
    """The title, those lines that aren't null and an empty line; null without any line, unless the section's subject is given."""
    body, head = F.concat_ws("\n", *lines), F.lit(f"{title}:\n" if title else "")
    whole = F.when(body != "", F.concat(head, body, F.lit("\n")))
    return whole if given is None else F.coalesce(whole, F.when(given, head))


def full_note(**c: Column) -> Column:
    """The note with all sections, by the names of a normalised record; other columns may stand for some of them."""

    def f(name: str) -> Column:
        return c[name] if name in c else F.col(name)

    payor, address = f("payor"), f("payor_address")
    name = F.nullif(payor["full_name"], F.lit(""))
    place = [address["city"], address["state"], address["zip"]]
    amount = F.coalesce(f("amount").cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))
    age = F.concat(F.lit("Check Age: "), f("age_days").cast("string"), F.when(f("age_days") < 0, " days (POST-DATED)").otherwise(" days"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Check #"), F.coalesce(F.nullif(f("check_number"), F.lit("")), F.lit("Unknown")), F.coalesce(F.concat(F.lit(" from "), name), F.lit(""))),
        F.lit(""),
        _section(
            "Payor Information",
            F.when(payor.isNotNull(), F.concat(F.lit("Name: "), F.coalesce(name, F.lit("N/A")))),
            F.when(payor["is_joint"], "  (Joint Account)"),
            _line("Address: ", address["street"]),
            F.when(scalars.truthy(place[0]) & scalars.truthy(place[1]) & scalars.truthy(place[2]), F.concat(F.lit("City/State/ZIP: "), place[0], F.lit(", "), place[1], F.lit(" "), place[2])),
            F.when(address["country"] != "USA", _line("Country: ", address["country"])),
            given=payor.isNotNull() | address.isNotNull(),
        ),
        _section("Bank Information", _line("Bank Name: ", f("bank_name")), _line("Routing Number: ", f("routing_number")), _line("Account Number: ", f("account_number"))),
        _section("", _line("Memo: ", f("memo"))),
        _section(
            "Amount Details",
            F.concat(F.lit("Numeric: $"), F.format_number(amount, 2)),
            _line("Written: ", f("amount_written")),
            F.when(f("amounts_match"), "Amounts Match: ✓").when(~f("amounts_match"), "Amounts Match: ✗ WARNING - MISMATCH!"),
        ),
        _section(
            "Validation",
            F.when(f("signature_present"), "Signature Present: ✓").otherwise("Signature Present: ✗"),
            _line("Check Condition: ", f("check_condition")),
            age,
            F.when(f("is_post_dated"), "Post-Dated: ✓ WARNING"),
            F.when(f("is_stale_dated"), "Stale-Dated: ✓ WARNING - >180 days old"),
            F.when(f("requires_manual_review"), "Requires Manual Review: ✓"),
        ),
        _section("", F.concat(F.lit("Confidence: "), _number(f("confidence")), F.lit("%"))),
        F.lit("Extracted via Vertex AI Gemini Pro"),
    )


def bill_address(street: Column, city: Column, state: Column, postal: Column, country: Column) -> Column:
    """Only the parts that aren't empty; null without any."""
    parts = {"Line1": street, "City": city, "CountrySubDivisionCode": state, "PostalCode": postal, "Country": country}
    any_part = F.coalesce(*(F.nullif(x, F.lit("")) for x in parts.values())).isNotNull()
    return F.when(any_part, F.struct(*(F.nullif(x, F.lit("")).alias(k) for k, x in parts.items())))


def receipt(doc: Column, number: Column, date: Column, amount: Column, customer: Column, note: Column, address: Column, method: str, account: str, item: str) -> Column:
    """JSON of a sales receipt, null parts left out."""
    if not (method and account and item):
        raise ValueError("method, account and item ids are required")

    def ref(x: Column | str) -> Column:
        return F.struct((F.lit(x) if isinstance(x, str) else x).alias("value"))

    line = F.struct(amount.alias("Amount"), F.lit("SalesItemLineDetail").alias("DetailType"), F.struct(ref(item).alias("ItemRef")).alias("SalesItemLineDetail"), F.concat(F.lit("Check #"), F.coalesce(number, F.lit("None"))).alias("Description"))
    return F.to_json(
        F.struct(
            ref(customer).alias("CustomerRef"),
            date.alias("TxnDate"),
            doc.alias("DocNumber"),
            number.alias("PaymentRefNum"),
            ref(method).alias("PaymentMethodRef"),
            ref(account).alias("DepositToAccountRef"),
            F.array(line).alias("Line"),
            note.alias("PrivateNote"),
            address.alias("BillAddr"),
        )
    )


def customer_ref(customer_id: Column, payee: Column, payor: Column) -> Column:
    """By id, or else by the payee's or payor's name."""
    name = F.coalesce(F.nullif(payee, F.lit("")), F.nullif(payor, F.lit("")), F.lit("Unknown Customer"))
    return F.struct(customer_id.alias("value"), F.when(customer_id.isNull(), name).alias("name"))


def mapped_receipt(number: Column, spare: Column, date: Column, amount: Column, customer: Column, note: Column, method: str, account: str, item: str) -> Column:
    """JSON of the receipt that the mapping makes: ``spare`` numbers a check without a number; ``customer`` is a customer_ref."""
    if not (method and account and item):
        raise ValueError("method, account and item ids are required")

    def ref(x: str) -> Column:
        return F.struct(F.lit(x).alias("value"))

    detail = F.struct(ref(item).alias("ItemRef"), F.lit(1).alias("Qty"), amount.alias("UnitPrice"))
    line = F.struct(amount.alias("Amount"), F.lit("SalesItemLineDetail").alias("DetailType"), detail.alias("SalesItemLineDetail"), F.lit("Check payment").alias("Description"))
    return F.to_json(
        F.struct(
            F.coalesce(F.nullif(number, F.lit("")), F.concat(F.lit("CHK-"), spare)).alias("DocNumber"),
            date.alias("TxnDate"),
            F.array(line).alias("Line"),
            amount.alias("TotalAmt"),
            ref(method).alias("PaymentMethodRef"),
            ref(account).alias("DepositToAccountRef"),
            note.alias("PrivateNote"),
            customer.alias("CustomerRef"),
        )
    )


# ---------------------------------------------------------------- notifications


def check_info(number: Column, amount: Column, payee: Column, payor: Column, sender: Column, date: Column, confidence: Column) -> Column:
    """What a notification shows of a check: the sender's name stands for a missing payor, 0 for a missing amount."""
    from_sender = F.nullif(scalars.sender_name(sender), F.lit(""))
    return F.struct(
        F.coalesce(number, F.lit("N/A")).alias("check_number"),
        F.coalesce(F.nullif(amount.cast("string"), F.lit("")), F.lit("0")).alias("amount"),
        F.coalesce(F.nullif(payee, F.lit("")), F.lit("N/A")).alias("payee"),
        F.coalesce(F.nullif(payor, F.lit("")), from_sender, F.lit("Unknown")).alias("payor"),
        F.coalesce(F.nullif(date, F.lit("")), F.lit("N/A")).alias("date"),
        scalars.safe_number(confidence).alias("confidence"),
    )


def _details(info: Column) -> list[tuple[str, Column]]:
    score = F.concat(F.format_number(info["confidence"], 1), F.lit("%"))
    return [("Check Number", info["check_number"]), ("Amount", scalars.money(info["amount"])), ("Payee", info["payee"]), ("Payor", info["payor"]), ("Date", info["date"]), ("Confidence Score", score)]


def details_text(info: Column) -> Column:
    return F.concat_ws("\n", F.lit("Check Information:"), *(F.concat(F.lit(f"{k}: "), x) for k, x in _details(info)))


def details_html(info: Column) -> Column:
    """Values are escaped; the score has the colour of its band."""

    def row(label: str, value: Column) -> Column:
        return F.concat(F.lit(f'<div class="detail-row"><span class="label">{label}:</span> <span class="value">'), value, F.lit("</span></div>"))

    *plain, (last, score) = _details(info)
    coloured = F.concat(F.lit('<span style="color:'), scalars.colour(info["confidence"]), F.lit(';font-weight:bold">'), score, F.lit("</span>"))
    return F.concat(F.lit('<div class="check-details"><h3>Check Information</h3>'), *(row(k, scalars.escape_html(x)) for k, x in plain), row(last, coloured), F.lit("</div>"))


def callout_html(title: str, accent: str, *lines: Column) -> Column:
    """Empty lines are left out."""
    return F.concat(F.lit(f'<div class="callout" style="border-left-color:{accent}"><h3>{title}</h3>'), *(F.when(scalars.truthy(x), F.concat(F.lit("<p>"), scalars.escape_html(x), F.lit("</p>"))).otherwise("") for x in lines), F.lit("</div>"))


def json_text(data: Column) -> Column:
    return F.concat(F.lit("Extracted Data (JSON):\n"), data)


def json_html(data: Column) -> Column:
    return F.concat(F.lit('<div class="check-details"><h3>Extracted Data (JSON)</h3><pre>'), scalars.escape_html(data), F.lit("</pre></div>"))


def page_html(title: str, accent: str, *parts: Column) -> Column:
    """A page with a header and a footer; null parts are left out."""
    head = F.lit(f'<html><body><div class="header" style="background-color:{accent};color:white"><h1>{title}</h1></div><div class="content">')
    return F.concat(head, F.concat_ws("", *parts), F.lit('</div><div class="footer"><p>Automated Check Processing System</p></div></body></html>'))


def page_text(*parts: Column) -> Column:
    """Parts with an empty line between them; null and empty ones are left out."""
    return F.concat_ws("\n\n", *(F.nullif(p, F.lit("")) for p in parts), F.lit("---\nAutomated Check Processing System"))


# Of each kind of mail the subject's end, the header, the accent and the callout's title.
MAILS = {
    "processed": ("Processed", "✓ Check Processed Successfully", "#2ca01c", "Check processed automatically"),
    "manual_review": ("Manual Review Required", "⚠ Manual Review Required", "#f39c12", "Manual review required"),
    "duplicate": ("Duplicate Detected", "⚠ Duplicate Check Detected", "#f39c12", "Duplicate check detected"),
    "failed": ("Processing Error", "✗ Check Processing Error", "#e74c3c", "Processing failed"),
}


def mail(route: Column, subject: Column, info: Column, why: Column, link: Column, record: Column) -> Column:
    """The notification (subject, text, html) of a check by its route; ``why`` and ``link`` may be null.

    A success links to its receipt, the others say why.  The record's JSON is
    part of all but the error mail.
    """
    kinds = None
    for kind, (suffix, header, accent, title) in MAILS.items():
        line = F.concat(F.lit("Check #"), info["check_number"]) if kind == "processed" else F.coalesce(why, F.lit(""))
        button = F.concat(F.lit('<a class="button" href="'), scalars.escape_html(link), F.lit('">View receipt</a>')) if kind == "processed" else F.lit(None).cast("string")
        closing = F.concat(F.lit("View receipt: "), link) if kind == "processed" else F.lit(None).cast("string")
        data = F.lit(None).cast("string") if kind == "failed" else record
        one = F.struct(
            scalars.reply_subject(subject, info["check_number"], F.lit(True), suffix).alias("subject"),
            page_text(F.concat_ws("\n", F.lit(title), F.nullif(line, F.lit(""))), details_text(info), closing, json_text(data)).alias("text"),
            page_html(header, accent, callout_html(title, accent, line), details_html(info), button, json_html(data)).alias("html"),
        )
        kinds = F.when(route == kind, one) if kinds is None else kinds.when(route == kind, one)
    return kinds


def summary(number: Column, date: Column, amount: Column, payor: Column, routing: Column, account: Column, match: Column, post: Column, stale: Column, review: Column, confidence: Column) -> Column:
    """Text for a processed check."""
    na, rule = F.lit("N/A"), F.lit("-" * 80)
    return F.concat_ws(
        "\n",
        F.lit("=" * 80),
        F.lit("CHECK PROCESSED SUCCESSFULLY"),
        F.lit("=" * 80),
        F.lit(""),
        F.lit("Key Information:"),
        rule,
        F.concat(F.lit("Check Number: "), F.coalesce(number, na)),
        F.concat(F.lit("Date: "), F.coalesce(date, na)),
        F.concat(F.lit("Amount: $"), F.format_number(F.coalesce(amount, F.lit(0).cast("decimal(12,2)")), 2)),
        F.concat(F.lit("Payor: "), F.coalesce(payor, na)),
        F.lit(""),
        F.lit("Bank Information:"),
        rule,
        F.concat(F.lit("Routing: "), F.coalesce(routing, na)),
        F.concat(F.lit("Account: "), F.coalesce(account, na)),
        F.lit(""),
        F.lit("Validation Status:"),
        rule,
        F.when(match, "Amounts Match: ✓ Yes").when(~match, "Amounts Match: ✗ No - REQUIRES REVIEW").otherwise("Amounts Match: Unknown"),
        F.when(post, "Post-Dated: ⚠ WARNING - Check is dated in the future"),
        F.when(stale, "Stale-Dated: ⚠ WARNING - Check is >180 days old"),
        F.when(review, "Manual Review: ⚠ Required"),
        F.concat(F.lit("Confidence: "), confidence.cast("string"), F.lit("%")),
    )


def api_error(body: Column, status: Column) -> Column:
    """(message, code, detail, body) of an error response."""
    first = "$.Fault.Error[0]"

    def get(*names: str) -> Column:
        return F.coalesce(*(F.get_json_object(body, f"{first}.{n}") for n in names))

    return F.struct(
        F.coalesce(get("Message", "message"), F.concat(F.lit("HTTP "), status.cast("string"))).alias("message"),
        get("code").alias("code"),
        get("Detail", "detail").alias("detail"),
        F.substring(body, 1, 1000).alias("body"),
    )
