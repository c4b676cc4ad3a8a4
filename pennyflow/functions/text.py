"""Text as Columns: merchant keys, patterns, identifiers, clean-up, hashes."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, each in the order in which they are tried; the order decides the result.
COMPANY_ENDINGS = (" ltd", " limited", " inc", " plc", " llc", ".com", ".co.uk", " uk")
BANK_PREFIXES = ("payment to ", "card payment ", "direct debit ", "debit card ")
BANK_ENDINGS = (" gb", " uk", " london", " www.")
ORDER_PATTERNS = (
    r"order\s*(?:#|number|no\.?|id)?[:\s]*([A-Z0-9\-]{5,30})",
    r"confirmation\s*(?:#|number|no\.?)?[:\s]*([A-Z0-9\-]{5,30})",
    r"reference\s*(?:#|number|no\.?)?[:\s]*([A-Z0-9\-]{5,30})",
    r"booking\s*(?:#|number|no\.?|ref)?[:\s]*([A-Z0-9\-]{5,30})",
    r"invoice\s*(?:#|number|no\.?)?[:\s]*([A-Z0-9\-]{5,30})",
)
NO_ORDER_IDS = ("your", "order", "total")
MERCHANT_NAMES = (
    ("amznmktplace", "Amazon Marketplace"),
    ("amazon marketplace", "Amazon Marketplace"),
    ("www.amazon.*", "Amazon"),
    ("amazon.co.uk", "Amazon.co.uk"),
    ("amazon.com", "Amazon.com"),
    ("amazon.de", "Amazon.de"),
    ("amazon.fr", "Amazon.fr"),
    ("amazon prime", "Amazon Prime"),
    ("ebay", "eBay"),
    ("paypal", "PayPal"),
)
PAYMENT_PHRASES = ("card payment to ", "payment to ", "transfer to ", "via apple pay", "via google pay", "via paypal", "online payment", "direct debit", "standing order")
STORE_PATTERNS = ("APPLE.COM", "APPLE COM", "APP STORE", "APPSTORE", "ITUNES", "APPLE SERVICES", "APPLE BILL")
MARKET_PATTERNS = ("AMAZON", "AMZN", "AMZ")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def merchant_key(name: Column) -> Column:
    """Lower case, without company endings (one pass over them), punctuation and extra spaces; null for null and empty names."""
    out = F.trim(F.lower(F.nullif(name, F.lit(""))))
    for ending in COMPANY_ENDINGS:
        out = F.regexp_replace(out, r"\s*" + re.escape(ending) + r"\z", "")
    return squeeze(F.regexp_replace(out, r"[^\p{L}\p{N}_\s]", ""))


def bank_key(text: Column) -> Column:
    """A bank text's merchant: prefixes off in turn, then endings, punctuation to spaces; empty for null."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for prefix in BANK_PREFIXES:
        out = F.regexp_replace(out, "^" + re.escape(prefix), "")
    for ending in BANK_ENDINGS:
        out = F.regexp_replace(out, re.escape(ending) + r"\z", "")
    return squeeze(F.regexp_replace(out, r"[^\p{L}\p{N}_\s]", " "))


def normal_merchant(text: Column) -> Column:
    """A card merchant: credit and refund prefixes, auction ids, ``*CODE``, a long last code and trailing signs go; known beginnings get their name.

    Null and blank texts stay as they are, and so does a text of which nothing would be left.
    """
    out = F.regexp_replace(F.regexp_replace(F.trim(text), r"(?i)^CREDIT FROM\s+", ""), r"(?i)^REFUND FROM\s+", "")
    out = F.regexp_replace(out, r"(?i)^ebay\s+O\*\d+.*\z", "eBay")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)\*[A-Z0-9]+\d+\z", ""), r"(?i)\s+[A-Z0-9]{8,}\z", "")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, r"\*+\z", ""), r"\.+\z", ""))
    low = F.lower(out)
    named = None
    for start, name in MERCHANT_NAMES:
        test = F.startswith(low, F.lit(start))
        named = F.when(test, name) if named is None else named.when(test, name)
    return F.when(F.trim(text) == "", text).otherwise(F.coalesce(named, F.nullif(out, F.lit("")), text))


def merchant_group(merchant: Column) -> Column:
    """Domains and services of one merchant under one name; others are their own group."""
    low = F.lower(merchant)
    market = F.when(F.contains(low, F.lit("marketplace")), "Amazon Marketplace").when(F.contains(low, F.lit("prime")), "Amazon Prime").otherwise("Amazon")
    return F.when(F.contains(low, F.lit("amazon")), market).when(F.contains(low, F.lit("ebay")), "eBay").when(F.contains(low, F.lit("paypal")), "PayPal").otherwise(merchant)


def account_details(text: Column) -> Column:
    """``sort code`` and ``account`` of ``ACCOUNT dddddd dddddddd``, joined by a space; null if there are none."""
    pattern = r"(?i)ACCOUNT\s+(\d{6})\s+(\d{8})"
    return F.when(F.rlike(text, F.lit(pattern)), F.concat_ws(" ", F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)))


def card_merchant(description: Column) -> Column:
    """What follows ``CARD PAYMENT [TO]``; null for other descriptions."""
    return F.nullif(F.trim(F.regexp_extract(description, r"(?i)^CARD\s+PAYMENT\s+(?:TO\s+)?(.+)$", 1)), F.lit(""))


def identified_merchant(description: Column, given: Column) -> Column:
    """The given merchant, else the description up to its first comma unless that is a number, else the whole description."""
    first = F.trim(F.split_part(description, F.lit(","), F.lit(1)))
    own = F.when((first != "") & ~F.rlike(first, F.lit(r"^\d+$")), first)
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), own, F.nullif(description, F.lit("")), F.lit("Unknown Merchant"))


def clean_text(text: Column) -> Column:
    """A description without payment phrases, dates, references and codes, in lower case."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for phrase in PAYMENT_PHRASES:
        out = F.replace(out, F.lit(phrase), F.lit(""))
    for pattern in (r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b", r"\b\d{2,4}[-/]\d{1,2}[-/]\d{1,2}\b", r"\bref\s*\d+\b", r"\b[a-z]{2,3}\d{4,}\b"):
        out = F.regexp_replace(out, pattern, "")
    return squeeze(out)


def any_literal(text: Column, literals: Sequence[str]) -> Column:
    """Whether any of the literals occurs in the text, as written; False for null."""
    out = F.lit(False)
    for x in literals:
        out = out | F.contains(text, F.lit(x))
    return F.coalesce(out, F.lit(False))


def source_status(description: Column, merchant: Column, kind: Column) -> Column:
    """Which purchases a bank row belongs to: the app store's, the market's or the market's returns; the text ``None`` for neither.

    A store's own merchant counts even if it was paid through the wallet; a wallet alone is no store.
    """
    text = F.upper(F.concat_ws(" ", F.coalesce(description, F.lit("")), F.coalesce(merchant, F.lit(""))))
    market = F.when(kind == "CREDIT", "AMZN RTN").otherwise("AMZN")
    return F.when(any_literal(text, STORE_PATTERNS), "Apple").when(any_literal(text, MARKET_PATTERNS), market).otherwise("None")


def is_store(description: Column, merchant: Column) -> Column:
    """Whether a row is of the app store itself and not only paid through its wallet."""
    return any_literal(F.upper(F.concat_ws(" ", F.coalesce(description, F.lit("")), F.coalesce(merchant, F.lit("")))), STORE_PATTERNS)


def foreign_amount(description: Column, currency: Column) -> Column:
    """Amount and rate in ``,240.00 USD, RATE 0.7521/GBP`` for the row's currency; null if there are none."""
    pattern = F.concat(F.lit(r"(?i),(\d+\.\d{2})\s+"), currency, F.lit(r",\s+RATE\s+([\d.]+)/GBP"))
    amount = F.regexp_extract(description, pattern, 1).try_cast("decimal(18,2)")
    rate = F.regexp_extract(description, pattern, 2).try_cast("double")
    return F.when(amount.isNotNull() & rate.isNotNull(), F.struct(amount.alias("amount"), rate.alias("rate")))


def abbreviated(name: Column, most: int = 35) -> Column:
    """At most ``most`` characters, cut at the last space past 70 %; punctuation at the end of a cut name goes."""
    head = F.substring(name, 1, most)
    back = F.instr(F.reverse(head), " ")
    cut = F.when((back > 0) & (F.lit(most) - back > most * 0.7), F.substring(head, F.lit(1), F.lit(most) - back)).otherwise(head)
    return F.when(F.length(name) <= most, name).otherwise(F.trim(F.rtrim(cut, F.lit(".,:-()[]"))))


#: How a rule's kind is written before its body.
RULE_KIND = r"(?i)^(starts|contains|exact|regex):"


def rule_kind(pattern: Column) -> Column:
    """``starts``, ``contains``, ``exact`` or ``regex`` from the pattern's prefix; without one, contains."""
    kind = F.lower(F.regexp_extract(pattern, RULE_KIND, 1))
    return F.when(kind == "", "contains").otherwise(kind)


def rule_body(pattern: Column) -> Column:
    return F.regexp_replace(pattern, RULE_KIND, "")


def rule_fault(pattern: str) -> str | None:
    """What is wrong with a written rule: empty, over 255 characters, or a regex that Python doesn't compile; None for nothing. Spark's own engine is asked by ``rules.java_fault`` and ``rules.usable``."""
    body = re.sub(RULE_KIND, "", pattern or "")
    if not body.strip():
        return "empty"
    if len(pattern) > 255:
        return "too long"
    if pattern.lower().startswith("regex:"):
        try:
            re.compile(body)
        except re.error as e:
            return f"invalid regex: {e}"
    return None


def rule_text(kind: Column, body: Column) -> Column:
    """A rule as it is written: the kind before the body, nothing for contains."""
    return F.when(kind == "contains", body).otherwise(F.concat(kind, F.lit(":"), body))


def rule_matches(text: Column, kind: Column, body: Column) -> Column:
    """Whether a rule fits: literal kinds ignore case, ``%`` and the like are ordinary; regexes ignore case but stay as written."""
    up, own = F.upper(text), F.upper(body)
    regex = F.when(kind == "regex", F.rlike(text, F.concat(F.lit("(?i)"), body)))
    literal = F.when(kind == "starts", F.startswith(up, own)).when(kind == "exact", up == own).when(kind == "contains", F.contains(up, own))
    return F.coalesce(literal, regex, F.lit(False))


def order_id(text: Column) -> Column:
    """The first order, confirmation, reference, booking or invoice number, by the patterns in turn; null if there is none."""
    found = [F.regexp_extract(text, f"(?i){p}", 1) for p in ORDER_PATTERNS]
    return F.coalesce(*[F.when((x != "") & ~F.lower(x).isin(*NO_ORDER_IDS), x) for x in found])


def email_domain(address: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(address, r"@([^\s>]+)", 1)), F.lit(""))


def url_host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1)), F.lit(""))


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and heads off, tags to spaces, the common entities read, spaces squeezed."""
    out = html
    for tag in ("script", "style", "head"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return squeeze(out)


def receipt_hash(merchant: Column, amount: Column, day: Column, order: Column) -> Column:
    """The key under which two receipts are one: SHA-256 of merchant, amount, day and order; amount 0 counts as none."""
    money = F.when(amount == 0, F.lit("")).otherwise(F.coalesce(amount.cast("decimal(18,2)").cast("string"), F.lit("")))
    parts = [F.lower(F.trim(F.coalesce(merchant, F.lit("")))), money, F.coalesce(day.cast("string"), F.lit("")), F.coalesce(order, F.lit(""))]
    return F.sha2(F.concat_ws("|", *parts), 256)


def ngrams(words: Column, n: int) -> Column:
    """All runs of ``n`` words, joined by spaces; none for shorter arrays."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1)))
    return F.coalesce(F.transform(starts, lambda k: F.array_join(F.slice(words, k, n), " ")), F.array().cast("array<string>"))


def first_of(text: Column, tests: Sequence[tuple[str, str]], default: str) -> Column:
    """The label of the first test whose literal occurs in the text, whatever the case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = None
    for literal, label in tests:
        test = F.contains(low, F.lit(literal))
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(default)
