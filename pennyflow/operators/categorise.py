"""Categories of transactions: by keywords, by payees' mappings, by the first source of several that knows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.descriptions import debit_payee

# Each category's keywords, in the order in which they are tried.
KEYWORDS = (
    ("Groceries", ("tesco", "sainsbury", "asda", "morrisons", "aldi", "lidl", "waitrose", "marks & spencer", "m&s", "co-op", "iceland", "ocado", "whole foods")),
    ("Transport", ("tfl", "transport for london", "uber", "trainline", "national rail", "shell", "bp", "esso", "petrol", "fuel", "parking", "lime", "bolt", "gett", "addison lee")),
    ("Dining", (
        "restaurant", "cafe", "coffee", "pizza", "mcdonalds", "kfc", "nando", "nandos", "wagamama", "pret", "starbucks", "costa", "nero", "greggs", "subway", "burger", "dominos", "pizza hut", "pizza express",
        "gourmet burger", "five guys", "gails", "food & mood", "hill food", "dishoom", "honest burger",
    )),
    ("Entertainment", ("cinema", "spotify", "netflix", "amazon prime", "apple music", "disney", "youtube", "xbox", "playstation", "steam", "odeon", "vue", "cineworld", "theatre", "concert", "subscription")),
    ("Utilities", ("thames water", "british gas", "edf", "eon", "octopus energy", "vodafone", "ee", "o2", "three", "bt", "sky", "virgin media", "council tax", "water", "electricity", "gas")),
    ("Shopping", ("amazon", "amzn", "ebay", "argos", "john lewis", "zara", "h&m", "next", "primark", "uniqlo", "asos", "boots", "superdrug", "wilko", "tk maxx", "debenhams", "jeanstore")),
    ("Health", ("pharmacy", "doctor", "dentist", "hospital", "gym", "fitness", "boots pharmacy", "lloyds pharmacy", "pure gym", "david lloyd")),
    ("Income", ("salary", "transfer from", "payment from", "refund")),
)
ESSENTIAL = ("Groceries", "Utilities", "Healthcare", "Transportation", "Housing", "Insurance", "Education", "Income", "Transfer", "Interest", "Banking Fees", "Taxes")


def keyword_category(description: Column, merchant: Column, amount: Column, keywords: Sequence = KEYWORDS) -> Column:
    """The category of the first keyword that the description or the merchant holds; ``Other`` for none.

    Income's keywords come first where the amount is positive. A keyword decides by its place, so that a
    category is tried whole before the next.
    """
    text = F.lower(F.concat_ws(" ", F.coalesce(description, F.lit("")), F.coalesce(merchant, F.lit(""))))

    def holds(words: Sequence[str]) -> Column:
        return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))

    out = F.when((amount > 0) & holds(dict(keywords)["Income"]), "Income")
    for category, words in keywords:
        out = out.when(holds(words), category)
    return out.otherwise("Other")


def necessity(category: Column, essential: Sequence[str] = ESSENTIAL) -> Column:
    """Essential for the named categories, Discretionary for all others and for null."""
    return F.when(category.isin(*essential), "Essential").otherwise("Discretionary")


def debit_mappings(rows: DataFrame, mappings: DataFrame, id_col: str = "id", text_col: str = "description") -> DataFrame:
    """id, name and category of the direct debits whose payee has a mapping, whatever the case.

    ``mappings`` has pattern, name and category, one row for a payee in capitals; the last by name wins
    where there are more. Spark broadcasts them by their size.
    """
    payee = F.upper(F.trim(debit_payee(F.col(text_col))))
    known = mappings.groupBy(F.upper("pattern").alias("payee")).agg(F.max_by(F.struct("name", "category"), "name").alias("m"))
    debits = rows.where(F.startswith(text_col, F.lit("DIRECT DEBIT PAYMENT TO"))).select(id_col, payee.alias("payee"))
    return debits.join(known, "payee").select(id_col, "m.name", "m.category")


def in_turn(rows: DataFrame, sources: Sequence[tuple[str, DataFrame]], key: str, value: str) -> DataFrame:
    """``rows`` with ``value`` and ``source`` from the first source that has a row for the key; null and ``none`` where none has.

    Each source has at most one row for a key; a source after the first that knows a row isn't asked.
    """
    out, tests = rows, []
    for k, (name, source) in enumerate(sources):
        own = source.select(key, F.struct(F.lit(name).alias("source"), F.col(value).alias("value")).alias(f"__s{k}"))
        out = out.join(own, key, "left")
        tests.append(F.col(f"__s{k}"))
    found = F.coalesce(*tests)
    out = out.withColumn(value, found["value"]).withColumn("source", F.coalesce(found["source"], F.lit("none")))
    return out.drop(*[f"__s{k}" for k in range(len(sources))])
