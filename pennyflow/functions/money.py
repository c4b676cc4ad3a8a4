"""Money as Columns. Amounts are decimals; what can't be read is null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def cents(amount: Column) -> Column:
    """The absolute amount in whole cents: the equality key of amount joins."""
    return F.round(F.abs(amount) * 100).cast("long")


def currency_value(text: Column) -> Column:
    """The number in a currency text without its signs, separators and quotes; 0 where there is none."""
    bare = F.regexp_replace(F.trim(text), r"[£$€,'\s]", "")
    return F.coalesce(bare.try_cast("double"), F.lit(0.0))


def european_value(text: Column) -> Column:
    """As ``currency_value``, but null where there is no number, and one comma before two last digits is the decimal sign."""
    bare = F.regexp_replace(F.trim(text), r"[£$€\s]", "")
    comma = bare.rlike(r"^\d+,\d{2}$")
    return F.when(comma, F.replace(bare, F.lit(","), F.lit("."))).otherwise(F.replace(bare, F.lit(","), F.lit(""))).try_cast("double")


# Fixed values, in the order in which they are tried.
TOTAL_PATTERNS = (
    r"(?i)(?:total|order total|amount|grand total|payment|charged|paid)[:\s]*[£$€]?\s*([0-9,]+\.?[0-9]*)",
    r"(?i)[£$€]\s*([0-9,]+\.[0-9]{2})\s*(?:total|paid|charged)",
)
AMOUNT_PATTERNS = (
    (r"(?i)(?:£|GBP)\s*([0-9,]+\.?[0-9]*)", "GBP"),
    (r"(?i)(?:\$|USD)\s*([0-9,]+\.?[0-9]*)", "USD"),
    (r"(?i)(?:€|EUR)\s*([0-9,]+\.?[0-9]*)", "EUR"),
    (r"(?i)([0-9,]+\.[0-9]{2})\s*(?:GBP|USD|EUR)", "GBP"),
)
CURRENCY_SIGNS = (("£", "GBP"), ("$", "USD"), ("€", "EUR"), ("¥", "JPY"), ("CHF", "CHF"))
#: Characters before and from a total's first one that may hold its sign.
SIGN_BEFORE, SIGN_AFTER = 20, 30


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast(MONEY)


def found_amount(text: Column) -> Column:
    """amount and currency of a text: what stands by a total's label, with the sign near it (else GBP), or the largest amount with a sign.

    Of equal largest amounts the first pattern's counts. Null where there is no amount.
    """
    labelled = None
    for pattern in TOTAL_PATTERNS:
        amount = _number(F.regexp_extract(text, pattern, 1))
        at = F.regexp_instr(text, F.lit(pattern))
        start = F.greatest(F.lit(1), at - SIGN_BEFORE)
        near = F.substring(text, start, at + SIGN_AFTER - start)
        sign = None
        for mark, code in CURRENCY_SIGNS:
            test = F.contains(near, F.lit(mark))
            sign = F.when(test, code) if sign is None else sign.when(test, code)
        own = F.when(amount.isNotNull(), F.struct(amount.alias("amount"), sign.otherwise("GBP").alias("currency")))
        labelled = own if labelled is None else F.coalesce(labelled, own)

    def signed(k: int, code: str):
        return lambda x: F.struct(_number(x).alias("amount"), F.lit(-k).alias("k"), F.lit(code).alias("currency"))

    every = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), signed(k, code)) for k, (p, code) in enumerate(AMOUNT_PATTERNS)]
    most = F.array_max(F.filter(F.concat(*every), lambda x: x["amount"].isNotNull()))
    return F.coalesce(labelled, F.when(most.isNotNull(), F.struct(most["amount"].alias("amount"), most["currency"].alias("currency"))))


def largest_amount(text: Column) -> Column:
    """The amount of ``found_amount``."""
    return found_amount(text)["amount"]


def token_estimate(text: Column, most: int = 2000) -> Column:
    """A model's tokens for a text: a quarter of its characters, at most ``most``."""
    return F.least(F.floor(F.length(text) / 4), F.lit(most)).cast("long")


def cost_cents(tokens_in: Column, tokens_out: Column, per_million_in: float, per_million_out: float) -> Column:
    """Whole cents, rounded up, 1 at least."""
    exact = (tokens_in * F.lit(per_million_in) + tokens_out * F.lit(per_million_out)) / 1_000_000 * 100
    return F.greatest(F.ceil(exact), F.lit(1)).cast("long")
