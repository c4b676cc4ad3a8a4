"""Structured fields of bank descriptions, as Columns: anchored patterns in order, then variants and payees alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("payee", "reference", "trip_date", "mandate_number", "sender", "payment_count", "rate", "tax")
_DAY = r"ON\s+(\d{1,2})-(\d{1,2})-(\d{4})$"
#: Provider, variant, pattern, fields of its groups, confidence. Fixed values in the order in which they are tried:
#: the second fits whatever the third and fourth fit, as ``.+?`` runs over ``*`` and ``Trip``, so those never decide.
PATTERNS = (
    ("Apple Pay", None, r"^(.+?)\s*\(VIA APPLE PAY\),\s*" + _DAY, ("payee",), 95),
    ("Card Payment", None, r"^CARD PAYMENT TO\s+(.+?)\s*" + _DAY, ("payee",), 90),
    ("Card Payment", None, r"^CARD PAYMENT TO\s+(.+?)\*(.+?)\s+" + _DAY, ("payee", "reference"), 95),
    ("Card Payment", "Zipcar", r"^CARD PAYMENT TO\s+(.+?)\s+Trip\s+(\w+)\s+" + _DAY, ("payee", "trip_date"), 90),
    ("Direct Debit", None, r"^DIRECT DEBIT PAYMENT TO\s+(.+?)\s+REF\s+([A-Z0-9\-_]+)\s*[/,]*\s*MANDATE NO\s+(\d+)$", ("payee", "reference", "mandate_number"), 95),
    ("Transfer", None, r"^TRANSFER FROM\s+(.+)$", ("sender",), 90),
    ("Santander", "Cashback", r"^(\d+)\s+Direct Debit Payments at\s+([\d.]+)%\s+Cashback$", ("payment_count", "rate"), 90),
    ("Santander", "Interest", r"^INTEREST PAID AFTER TAX\s+([\d.]+)\s+DEDUCTED$", ("tax",), 85),
)
#: Provider, variant and pattern, tried on the text in capitals, so that the second never fits. Fixed values.
VARIANTS = (
    ("Card Payment", "AIRBNB", "AIRBNB"),
    ("Amazon", "Marketplace", "AMZNMktplace"),
    ("Apple Pay", "Zettle", "ZETTLE"),
    ("Apple Pay", "PPOINT", r"PPOINT_\*"),
    ("Card Payment", "LIME", "LIME"),
    ("Apple Pay", "SUMUP", r"SUMUP\s*\*"),
)
VARIANT_CONFIDENCE, PAYEE_CONFIDENCE, FALLBACK_CONFIDENCE, LEAST_CONFIDENCE = 60, 70, 80, 70
_PAYEE = r"CARD PAYMENT TO\s+([A-Za-z0-9\s\-*]+?)(?:\s+ON|\s*$|\*)"


def group(text: Column, pattern: str, k: int = 1) -> Column:
    """A group of the first match, trimmed; null if it is empty or nothing matches."""
    return F.nullif(F.trim(F.regexp_extract(text, pattern, k)), F.lit(""))


def _row(provider: Column, variant: Column, confidence: Column, **found: Column) -> Column:
    none = F.lit(None).cast("string")
    fields = [found.get(n, none).alias(n) for n in FIELDS]
    return F.struct(provider.cast("string").alias("provider"), variant.cast("string").alias("variant"), *fields, confidence.cast("long").alias("confidence"))


def extracted(description: Column) -> Column:
    """provider, variant, the ``FIELDS`` and confidence of the first pattern that fits.

    Where none fits, a variant's mark in the text gives provider and variant (60), and a card payment's
    payee (70) stands beside it. Null and empty descriptions, and those that nothing fits, have nulls and 0.
    """
    out = None
    for provider, variant, pattern, fields, confidence in PATTERNS:
        own = _row(F.lit(provider), F.lit(variant), F.lit(confidence), **{n: group(description, pattern, k) for k, n in enumerate(fields, 1)})
        test = F.rlike(description, F.lit(pattern))
        out = F.when(test, own) if out is None else out.when(test, own)
    up, marked = F.upper(description), None
    for provider, variant, pattern in VARIANTS:
        own = F.struct(F.lit(provider).alias("provider"), F.lit(variant).alias("variant"))
        marked = F.when(F.rlike(up, F.lit(pattern)), own) if marked is None else marked.when(F.rlike(up, F.lit(pattern)), own)
    payee = group(description, _PAYEE)
    by_mark = F.when(marked.isNotNull(), VARIANT_CONFIDENCE).otherwise(0)
    rest = _row(
        F.coalesce(marked["provider"], F.when(payee.isNotNull(), "Card Payment")), marked["variant"],
        F.when(payee.isNotNull(), F.greatest(by_mark, F.lit(PAYEE_CONFIDENCE))).otherwise(by_mark), payee=payee,
    )
    return out.otherwise(rest)


def debit_fallback(description: Column) -> Column:
    """payee, reference and mandate_number of a direct debit in any layout (confidence 80); null for other descriptions."""
    pattern = r"(?i)^DIRECT DEBIT PAYMENT TO\s+(.+?)(?:\s+REF\s+(.*))?$"
    rest = F.regexp_extract(description, pattern, 2)
    return F.when(
        F.rlike(description, F.lit(pattern)),
        _row(
            F.lit("Direct Debit"), F.lit(None), F.lit(FALLBACK_CONFIDENCE), payee=group(description, pattern),
            reference=group(rest, r"(?i)^([^,]+?)(?:\s*[,/]\s*MANDATE|\s*MANDATE|\s*$)"), mandate_number=group(rest, r"(?i)MANDATE NO\s+(\d+)"),
        ),
    )


def debit_payee(description: Column) -> Column:
    """The payee of a direct debit, by the strict patterns and else by the fallback."""
    return F.coalesce(extracted(description)["payee"], debit_fallback(description)["payee"])
