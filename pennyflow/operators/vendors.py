"""Receipts of known vendors: each is read by its vendor's own program of extraction steps.

A program is a list of rows: a field, what it is looked for in, a pattern, and the group that holds it. Steps of a field are tried in order until one gives a value. Programs are compiled once in a
worker; a mail runs its own vendor's program alone, in Arrow batches of one narrow pass, so that nothing is shuffled and a vendor of a third of all mails is no hot key.
"""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gates
from ..functions.mail import mail_merchant, sender_domain
from ..functions.text import html_text
from .receipts import parsed


class Vendor(NamedTuple):
    """A vendor's hosts, what is said of its receipts, which of the fields one has to be found (none: always a receipt), and its steps (field, in subject, text or both, pattern, group)."""

    hosts: tuple[str, ...]
    key: str
    merchant: str
    category: str
    currency: str
    confidence: int
    needs: tuple[str, ...]
    steps: tuple[tuple[str, str, str, int], ...]


# Hosts and patterns, in the order in which they are tried.
TOTAL, ORDER_TOTAL, GRAND_TOTAL, AMOUNT = r"Total[:\s]*£\s*([0-9,]+\.?\d*)", r"Order Total[:\s]*£\s*([0-9,]+\.?\d*)", r"Grand Total[:\s]*£\s*([0-9,]+\.?\d*)", r"Amount[:\s]*£\s*([0-9,]+\.?\d*)"
EITHER = ("order_id", "total")
VENDORS = (
    Vendor(("audioemotion.co.uk",), "audio_emotion", "Audio Emotion", "electronics", "GBP", 85, EITHER, (
        ("order_id", "both", r"order\s*(?:#|number|:)?\s*(\d+)", 1), ("total", "text", TOTAL, 1), ("total", "text", ORDER_TOTAL, 1), ("total", "text", GRAND_TOTAL, 1),
    )),
    Vendor(("novationmusic.com",), "novation", "Novation", "electronics", "GBP", 85, EITHER, (("order_id", "subject", r"#(\d+)", 1), ("total", "text", TOTAL, 1), ("total", "text", ORDER_TOTAL, 1))),
    Vendor(("account.bluehost.com", "bluehost.com"), "bluehost", "Bluehost", "software_subscription", "USD", 85, EITHER, (
        ("order_id", "text", r"order\s*(?:#|ID|:)?\s*(\d+)", 1), ("total", "text", r"Total[:\s]*\$\s*([0-9,]+\.?\d*)", 1), ("total", "text", r"Amount[:\s]*\$\s*([0-9,]+\.?\d*)", 1), ("total", "text", r"\$\s*([0-9,]+\.[0-9]{2})", 1),
        ("GBP", "text", "£", 0),
    )),
    Vendor(("worldpay.com",), "worldpay", "WorldPay", "payment", "GBP", 80, EITHER, (
        ("order_id", "text", r"reference[:\s]*([A-Z0-9\-]+)", 1), ("total", "text", TOTAL, 1), ("total", "text", AMOUNT, 1), ("total", "text", r"£\s*([0-9,]+\.[0-9]{2})", 1),
    )),
    Vendor(("designacable.com",), "designacable", "Designacable", "electronics", "GBP", 85, EITHER, (("order_id", "both", r"order\s*(?:#|:)?\s*(\d+)", 1), ("total", "text", TOTAL, 1), ("total", "text", ORDER_TOTAL, 1))),
    Vendor(("cooksmill.co.uk",), "cooksmill", "Cooksmill", "home", "GBP", 85, EITHER, (("order_id", "subject", r"#(\d+)", 1), ("total", "text", TOTAL, 1), ("total", "text", ORDER_TOTAL, 1))),
    Vendor(("bahaievents.org.uk",), "bahai_events", "Baha'i Events", "community", "GBP", 85, ("total",), (("total", "text", TOTAL, 1), ("total", "text", AMOUNT, 1), ("total", "text", r"Payment[:\s]*£\s*([0-9,]+\.?\d*)", 1))),
    Vendor(("bahai.org.uk",), "bahai_books", "Baha'i Books", "books", "GBP", 85, EITHER, (("order_id", "subject", r"#([A-Z]?\d+)", 1), ("total", "text", TOTAL, 1), ("total", "text", AMOUNT, 1))),
    Vendor(("smolproducts.com",), "smol", "Smol", "home", "GBP", 85, EITHER, (("order_id", "text", r"order\s*(?:#|:)?\s*(\d+)", 1), ("total", "text", TOTAL, 1), ("total", "text", ORDER_TOTAL, 1))),
    Vendor(("cables4all.co.uk",), "cables4all", "Cables4All", "electronics", "GBP", 85, EITHER, (("order_id", "text", r"order\s*(?:#|:)?\s*(\d+)", 1), ("total", "text", TOTAL, 1), ("total", "text", ORDER_TOTAL, 1))),
    Vendor(("figma.com",), "figma", "Figma", "software_subscription", "USD", 85, ("day", "total"), (
        ("day", "subject", r"(\w{3}\s+\d{1,2},?\s+\d{4})", 1), ("total", "text", r"Total:?\s*[\n\s]*£([\d,]+\.?\d*)", 1), ("total", "text", r"Total:?\s*[\n\s]*\$([\d,]+\.?\d*)", 1), ("total", "text", r"£([\d,]+\.?\d*)\s*GBP", 1),
        ("total", "text", r"\$([\d,]+\.\d{2})\s*USD", 1), ("GBP", "text", "£", 0),
    )),
    # Grocery orders alone: its other kinds of mails have no program here.
    Vendor(("amazon.co.uk", "amazon.com", "amazon.de", "amazon.fr"), "amazon_fresh", "Amazon Fresh", "groceries", "", 85, (), (
        ("required", "subject", r"^(?!ordered:)(?!.*cancelled)(?!.*refund).*fresh", 0), ("total", "text", r"Order\s+Total[:\s]*[£$€]?\s*([0-9,]+\.?\d*)", 1), ("total", "text", r"Grand\s+Total[:\s]*[£$€]?\s*([0-9,]+\.?\d*)", 1),
        ("total", "text", r"Total[:\s]*[£$€]\s*([0-9,]+\.?\d*)", 1), ("total", "text", r"Your\s+order\s+total[:\s]*[£$€]?\s*([0-9,]+\.?\d*)", 1), ("GBP", "text", "£", 0), ("EUR", "text", "€", 0), ("USD", "text", r"\$", 0),
        ("day", "text", r"Delivery\s+date[:\s]+(\d{1,2}\s+\w+\s+\d{4})", 1), ("day", "text", r"Arriving[:\s]+(?:\w+day,?\s+)?(\d{1,2}\s+\w+\s+\d{4})", 1), ("day", "text", r"Arriving[:\s]+(?:\w+day,?\s+)?(\w+\s+\d{1,2}(?:,\s+\d{4})?)", 1),
        ("day", "text", r"(\d{1,2}\s+(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+\d{4})", 1),
    )),
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: What a program gives.
FIELDS = "vendor string, merchant string, order_id string, total decimal(18,2), currency string, day date, category string, confidence long"


def amount(text: str) -> Decimal | None:
    """The number of an amount: a comma before the last two digits of a number without points is a decimal one, others separate thousands; None where there is none, 0 counts as none."""
    text = text.replace(",", ".") if re.fullmatch(r"\d+,\d{2}", text) else text.replace(",", "")
    found = re.search(r"\d+\.?\d*", text)
    value = Decimal(found.group().rstrip(".")) if found else None
    return value.quantize(Decimal("0.01")) if value and value < 10**15 else None


def written_day(text: str) -> dt.date | None:
    """The date of ``3 May 2024`` or ``May 3, 2024``, months by their first three letters; None where it is none."""
    number, month = re.search(r"\b(\d{1,2})\b", text), re.search(r"[a-z]{3}", text, re.IGNORECASE)
    year = re.search(r"\b(\d{4})\b", text)
    if number is None or month is None or year is None or month.group().lower() not in MONTHS:
        return None
    try:
        return dt.date(int(year.group()), MONTHS.index(month.group().lower()) + 1, int(number.group()))
    except ValueError:
        return None


@lru_cache(maxsize=1)
def programs() -> list[tuple[Vendor, list[tuple[str, str, re.Pattern, int]]]]:
    return [(v, [(field, where, re.compile(pattern, re.IGNORECASE), group) for field, where, pattern, group in v.steps]) for v in VENDORS]


@lru_cache(maxsize=10_000)
def vendor_of(host: str) -> int | None:
    """The vendor registered under a host, else the first of whose hosts one is part of it."""
    every = [(h, k) for k, v in enumerate(VENDORS) for h in v.hosts]
    return next((k for h, k in every if h == host), next((k for h, k in every if h in host), None))


def run(host: str | None, subject: str | None, text: str | None) -> dict | None:
    """What the host's vendor's program finds in a mail; None without a vendor, or where nothing is found that it needs."""
    at = vendor_of(host or "")
    if at is None:
        return None
    vendor, steps = programs()[at]
    sources = {"subject": subject or "", "text": text or ""}
    sources["both"] = f"{sources['subject']} {sources['text']}"
    found: dict = {}
    for field, where, pattern, group in steps:
        if field in found or (field in ("GBP", "EUR", "USD") and "currency" in found):
            continue
        hit = pattern.search(sources[where])
        if field == "required":
            if hit is None:
                return None
        elif hit is not None:
            if field in ("GBP", "EUR", "USD"):
                found["currency"] = field
            else:
                value = {"total": amount, "day": written_day}.get(field, str)(hit.group(group))
                # A date that is none lets the next step try; an amount that is none ends its search, as the first pattern that fits decides.
                if value is not None or field == "total":
                    found[field] = value
    if vendor.needs and not any(found.get(n) for n in vendor.needs):
        return None
    return {"vendor": vendor.key, "merchant": vendor.merchant, "category": vendor.category, "confidence": vendor.confidence, "currency": vendor.currency or None} | found


def _read(hosts: pa.Array, subjects: pa.Array, texts: pa.Array) -> pa.Array:
    rows = [run(*r) for r in zip(hosts.to_pylist(), subjects.to_pylist(), texts.to_pylist(), strict=True)]
    kinds = {"total": pa.decimal128(18, 2), "day": pa.date32(), "confidence": pa.int64()}
    names = [f.split()[0] for f in FIELDS.split(", ")]
    columns = [pa.array([None if r is None else r.get(n) for r in rows], kinds.get(n, pa.string())) for n in names]
    return pa.StructArray.from_arrays(columns, names=names)


def vendor_fields(host: Column, subject: Column, text: Column) -> Column:
    """What the mail's vendor's program finds, as a struct of FIELDS; all null without a vendor or where it finds nothing. Nulls are empty texts."""
    return F.arrow_udf(_read, FIELDS)(host, subject, text)


def cascade(rows: DataFrame) -> DataFrame:
    """``rows`` (subject, sender, sender_name, body, html, unsubscribe, received) with method, merchant, order_id, total, day and confidence.

    In order: mails that the gates or their words reject (``pre_filter``, 0), the vendor's own program, linked data (95), patterns (80 with order and total, 60 with one),
    the merchant alone (50), else none (0). A day that isn't found is the day of ``received``. The text is the body, else that of the page.
    """
    text = F.coalesce(F.nullif("body", F.lit("")), html_text(F.col("html")), F.lit(""))
    out = rows.withColumn("markup", F.coalesce((F.contains("html", F.lit('"@type"')) & F.contains("html", F.lit('"Order"'))) | (F.contains("html", F.lit("itemtype")) & F.contains("html", F.lit("schema.org/Order"))), F.lit(False)))
    out = out.withColumn("__body", F.col("body")).withColumn("body", text)
    out = gates.judged(out).withColumn("__ok", F.col("likely.accept")).drop("gate", "likely", "imported", "markup")
    host = sender_domain(F.col("sender"))
    out = out.withColumn("__vendor", vendor_fields(F.when(F.col("__ok"), host), F.col("subject"), F.col("body")))
    none = F.lit(None).cast("string")
    out = out.withColumn("__merchant", F.explode(F.array(mail_merchant(F.col("subject"), host, F.col("sender_name"), none))))
    out = parsed(out.withColumnRenamed("html", "__html").withColumn("__html", F.coalesce("__html", F.lit(""))), "__html", "body").withColumnsRenamed({"__html": "html", "order_id": "__order", "total": "__total", "method": "__method", "confidence": "__sure"})
    by_vendor, found = F.col("__vendor.vendor").isNotNull(), F.col("__method") != "none"
    pick = lambda own, rest: F.when(~F.col("__ok"), F.lit(None)).when(by_vendor, own).otherwise(rest)
    alone = F.col("__merchant").isNotNull()
    return out.withColumns({
        "method": F.when(~F.col("__ok"), "pre_filter").when(by_vendor, F.concat(F.lit("vendor_"), "__vendor.vendor")).when(found, F.col("__method")).when(alone, "merchant").otherwise("none"),
        "merchant": pick(F.col("__vendor.merchant"), F.col("__merchant")),
        "order_id": pick(F.col("__vendor.order_id"), F.col("__order")),
        "total": pick(F.col("__vendor.total"), F.col("__total")),
        "day": pick(F.coalesce("__vendor.day", F.to_date("received")), F.when(found | alone, F.to_date("received"))),
        "confidence": F.when(~F.col("__ok"), 0).when(by_vendor, F.col("__vendor.confidence")).when(found, F.col("__sure")).when(alone, 50).otherwise(0).cast("long"),
        "body": F.col("__body"),
    }).drop("__ok", "__vendor", "__merchant", "__order", "__total", "__method", "__sure", "__body")
