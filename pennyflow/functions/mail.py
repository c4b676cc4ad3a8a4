"""Mail as Columns: senders, gates that tell receipts from the rest, kinds of mail and of errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_literal

# Fixed values, each in the order in which they are tried.
#: Kinds of errors by literals in the message or names of exceptions, and whether to try again; then the parse stages and the rest.
ERROR_KINDS = (
    ("timeout", True, ("timeout",), ("TimeoutError", "ReadTimeout")),
    ("rate_limit", True, ("rate", "429", "quota"), ()),
    ("auth_error", False, ("auth", "401", "unauthorized"), ()),
    ("network", True, ("connection", "network"), ("ConnectionError", "ConnectionResetError")),
    ("db_error", False, ("database", "psycopg2", "postgres", "constraint"), ()),
    ("validation", False, ("validation", "invalid"), ("ValueError", "ValidationError")),
)
PARSE_STAGES = ("parse", "vendor_parse", "schema_parse", "pattern_parse")
API_MARKS = ("4", "5", "api")
MAIL_KINDS = (("cancellation", "cancelled"), ("refund", "refund"), ("fresh", "fresh"))
SHIPMENT_WORDS = ("shipped", "dispatched", "out for delivery", "delivered")


def low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def sender_domain(sender: Column) -> Column:
    """What follows the last ``@``, in lower case; empty without one."""
    return F.when(F.contains(sender, F.lit("@")), F.lower(F.substring_index(sender, "@", -1))).otherwise("")


def has_order_markup(html: Column) -> Column:
    """Whether a page names an order as linked data or as microdata."""
    ld = F.contains(html, F.lit('"@type"')) & F.contains(html, F.lit('"Order"'))
    return F.coalesce(ld | (F.contains(html, F.lit("itemtype")) & F.contains(html, F.lit("schema.org/Order"))), F.lit(False))


def mail_kind(subject: Column, body: Column) -> Column:
    """Ordered, cancellation, refund, fresh, business, shipment or order, by the first test that fits."""
    title = low(subject)
    out = F.when(F.startswith(title, F.lit("ordered:")), "ordered")
    for kind, word in MAIL_KINDS:
        out = out.when(F.contains(title, F.lit(word)), kind)
    out = out.when(F.contains(low(body), F.lit("order is placed on behalf of")), "business")
    return out.when(any_literal(title, SHIPMENT_WORDS), "shipment").otherwise("order")


def error_kind(message: Column, exception: Column, stage: Column) -> Column:
    """kind and retryable of an error, by the first test that its message, exception or stage fits."""
    text = low(message)
    says = lambda kind, again: F.struct(F.lit(kind).alias("kind"), F.lit(again).alias("retryable"))
    out = None
    for kind, again, literals, names in ERROR_KINDS:
        test = any_literal(text, literals)
        test = test | F.coalesce(exception.isin(*names), F.lit(False)) if names else test
        out = F.when(test, says(kind, again)) if out is None else out.when(test, says(kind, again))
    out = out.when(stage.isin(*PARSE_STAGES), says("parse_error", False))
    return out.when(any_literal(text, API_MARKS), says("api_error", True)).otherwise(says("unknown", False))


def parse_status(given: Column, rejected: Column, amount: Column, n_items: Column) -> Column:
    """The given status, else filtered, parsed (an amount or items were found) or unparseable."""
    found = (F.coalesce(amount, F.lit(0)) != 0) | (F.coalesce(n_items, F.lit(0)) > 0)
    return F.coalesce(F.nullif(given, F.lit("")), F.when(F.coalesce(rejected, F.lit(False)), "filtered").when(found, "parsed").otherwise("unparseable"))


# What a merchant's name can't hold, be or begin with.
NO_MERCHANT_PATTERNS = (
    r"\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\b",
    r"\b\d{1,2}(?:st|nd|rd|th)?\b",
    r"\b20\d{2}\b",
)
STOP_WORDS = (
    "for", "your", "the", "a", "an", "on", "in", "at", "to", "of", "from", "with", "by", "and", "or", "is", "are", "was", "were", "this", "that", "these", "those", "my", "our", "their",
    "rides", "ride", "trip", "trips", "subscription", "payment",
)
PROMO_WORDS = (
    "black friday", "cyber monday", "sale", "deals", "offer", "save up", "discount", "special", "limited time", "exclusive", "gift", "promo", "marketing", "newsletter",
)
BAD_STARTS = ("for ", "your ", "on ", "in ", "thank ")
SUBJECT_PHRASES = ("thank you", "thanks for", "your order", "your receipt", "order confirmation", "payment confirmation", "purchase confirmation")
GENERIC_SENDERS = ("noreply", "no-reply", "info", "support", "orders", "receipts", "notifications", "hello", "team", "customer service")
GENERIC_HOSTS = ("no-reply", "noreply", "info", "mail", "email", "orders", "receipts")
SUBJECT_PATTERNS = (
    r"(?i)(?:your\s+)?(?:order|receipt|confirmation)\s+(?:from\s+)?([A-Za-z0-9\s&']+)",
    r"(?i)([A-Za-z0-9\s&']+?)(?:\s+order|\s+receipt|\s+confirmation)",
    r"(?i)thank(?:s|you)?\s+for\s+(?:your\s+)?(?:order|purchase)\s+(?:from\s+)?([A-Za-z0-9\s&']+)",
)
#: A product's description and category by the first pattern that its name fits.
PRODUCT_KINDS = (
    (r"headphone|earphone|earbud|airpod", "audio headphones/earbuds"),
    (r"cable|charger|adapter|usb", "charging/connectivity accessory"),
    (r"case|cover|screen protector", "protective case/cover"),
    (r"battery|power bank", "portable power/battery"),
    (r"book|kindle|paperback|hardcover", "book"),
    (r"shirt|dress|pants|jeans|jacket|coat", "clothing item"),
    (r"toy|lego|game|puzzle", "toy/game"),
    (r"vitamin|supplement|medicine", "health supplement"),
    (r"food|snack|chocolate|coffee|tea", "food/beverage"),
    (r"cleaning|soap|detergent", "cleaning product"),
    (r"phone|tablet|laptop|computer", "electronic device"),
    (r"subscription|monthly|annual", "subscription service"),
    (r"delivery|shipping", "delivery service"),
)
PRODUCT_CATEGORIES = (
    (r"headphone|speaker|audio|earphone|earbud|airpod|cable|charger|phone|tablet|laptop|computer|usb|hdmi|adapter|battery|power bank", "electronics"),
    (r"book|kindle|paperback|hardcover|novel|magazine", "entertainment"),
    (r"shirt|dress|pants|jeans|jacket|coat|shoe|sock|underwear|clothing", "clothing"),
    (r"food|snack|chocolate|coffee|tea|grocery|organic|vitamin|supplement", "groceries"),
    (r"toy|lego|game|puzzle|doll|action figure", "entertainment"),
    (r"cleaning|soap|detergent|shampoo|toothpaste|tissue", "home"),
    (r"medicine|pharmacy|health|first aid|bandage", "health"),
    (r"kitchen|cooking|pan|pot|utensil|plate|bowl|cup", "home"),
    (r"uber|lyft|taxi|ride|trip", "transport"),
    (r"deliveroo|uber eats|just eat|delivery", "food_delivery"),
    (r"subscription|monthly|annual|premium|membership", "subscription"),
    (r"netflix|spotify|disney|streaming", "subscription"),
)


def valid_merchant(name: Column) -> Column:
    """Whether a text can be a merchant's name: 2 to 50 characters, no dates, years or promotion, not mostly stop words; False for null."""
    text = F.trim(low(name))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    stops = F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS)))
    bad = any_literal(text, PROMO_WORDS) | any_literal(text, SUBJECT_PHRASES)
    for pattern in NO_MERCHANT_PATTERNS:
        bad = bad | F.rlike(text, F.lit(pattern))
    for start in BAD_STARTS:
        bad = bad | F.startswith(text, F.lit(start))
    return F.length(text).between(2, 50) & ~bad & (stops * 2 <= F.size(words))


def mail_merchant(subject: Column, domain: Column, sender_name: Column, known: Column) -> Column:
    """A mail's merchant: the domain's known name, else the sender's name, else the subject's, else the domain itself in title case.

    ``known`` is the domain's name from a table, joined before, or null. A generic host has none.
    """
    name = F.trim(sender_name)
    own = F.when(valid_merchant(name) & ~F.lower(name).isin(*GENERIC_SENDERS) & ~F.startswith(F.lower(name), F.lit("no")), name)
    tries = [F.trim(F.regexp_extract(F.coalesce(subject, F.lit("")), p, 1)) for p in SUBJECT_PATTERNS]
    host = F.split_part(F.nullif(domain, F.lit("")), F.lit("."), F.lit(1))
    titled = F.when(~F.lower(host).isin(*GENERIC_HOSTS), F.initcap(F.regexp_replace(host, "[-_]", " ")))
    return F.coalesce(known, own, *[F.when(valid_merchant(t), t) for t in tries], titled)


def _first_kind(name: Column, kinds: Sequence[tuple[str, str]]) -> Column:
    text, out = F.lower(name), None
    for pattern, kind in kinds:
        test = F.rlike(text, F.lit(pattern))
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out


def product_kind(name: Column) -> Column:
    """A short description of a product by its name, or null."""
    return _first_kind(name, PRODUCT_KINDS)


def product_category(name: Column) -> Column:
    """A category hint of a product by its name, ``other`` where nothing fits."""
    return _first_kind(name, PRODUCT_CATEGORIES).otherwise("other")
