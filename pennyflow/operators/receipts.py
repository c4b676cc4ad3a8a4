"""Receipts: soft deletion, filters, and a cascade of extractions from cheap to costly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import MONEY, largest_amount
from ..functions.text import abbreviated, order_id
from .grams import contained


def soft_deleted(rows: DataFrame, gone: Column, at: Column) -> DataFrame:
    """``rows`` with ``deleted_at`` set where ``gone`` holds; rows that are deleted already keep their time."""
    return rows.withColumn("deleted_at", F.coalesce("deleted_at", F.when(F.coalesce(gone, F.lit(False)), at)))


def live(rows: DataFrame) -> DataFrame:
    """The rows that aren't deleted: the standing filter of all readers."""
    return rows.where(F.col("deleted_at").isNull())


def receipt_filter(merchant=None, status=None, method=None, least_confidence=None, with_items=None, with_match=None) -> Column:
    """A condition from optional filters that all have to hold; the merchant is part of the name, whatever the case."""
    keep = F.lit(True)
    if merchant is not None:
        keep &= F.coalesce(F.contains(F.lower("merchant_name"), F.lit(merchant.lower())), F.lit(False))
    for column, value in (("parsing_status", status), ("parse_method", method)):
        if value is not None:
            keep &= F.col(column) == value
    if least_confidence is not None:
        keep &= F.col("parse_confidence") >= least_confidence
    if with_items is not None:
        keep &= (F.coalesce("n_items", F.lit(0)) > 0) == F.lit(with_items)
    if with_match is not None:
        keep &= F.col("txn_id").isNotNull() == F.lit(with_match)
    return keep


def coverage(txns: DataFrame, names: DataFrame, matched: DataFrame, sources: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Of each name (lower case, unique): the transactions whose merchant or description holds it anywhere, those that no receipt matched, and those that each kind of other source covers.

    ``txns`` has id, merchant and description, ``matched`` id, ``sources`` id and source. Names that no text holds give no row. A name's signs are ordinary, ``%`` too.
    """
    # A name can't run from one text into the other over the line between them.
    text = F.lower(F.concat_ws("\n", F.coalesce("merchant", F.lit("")), F.coalesce("description", F.lit(""))))
    held = contained(txns.select("id", text.alias("__text_")), names.select("name"), "__text_", "name").select("id", "name")
    done = matched.select("id").distinct().withColumn("__hit", F.lit(True))
    flags = sources.groupBy("id").agg(*[F.bool_or(F.col("source") == k).alias(k) for k in kinds])
    every = held.join(done, "id", "left").join(flags, "id", "left")
    return every.groupBy("name").agg(F.count("*").alias("txns"), F.count_if(F.col("__hit").isNull()).alias("uncovered"), *[F.count_if(F.col(k)).alias(k) for k in kinds])


#: Names of an order up to this length stand in full; of longer ones only the first three.
SUMMARY_CHARS, SUMMARY_NAMES = 150, 3


def order_summary(names: Column) -> Column:
    """An order's names as one text: a single one in full, several abbreviated and joined, and only the first three with the number of the others where that is long."""
    short = F.transform(names, lambda x: abbreviated(x))
    joined = F.array_join(short, " | ")
    few = F.concat(F.array_join(F.slice(short, 1, SUMMARY_NAMES), " | "), F.lit(" & "), (F.size(names) - SUMMARY_NAMES).cast("string"), F.lit(" more"))
    return F.when(F.size(names) == 1, F.get(names, F.lit(0))).when(F.length(joined) > SUMMARY_CHARS, few).otherwise(joined)


def json_ld(html: Column) -> Column:
    """All embedded linked-data documents, in their order."""
    return F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*type\s*=\s*["']?application/ld\+json[^>]*>(.*?)</script>"""), F.lit(1))


def order_of(docs: Column) -> Column:
    """Order number, price, currency, day, seller and items of a linked-data Order or Invoice, by their alternative paths; null if there is none.

    Each document is parsed once. It may be an object, an array or hold a ``@graph``, and a type may be a list: the first order among all documents counts; what isn't JSON is passed over.
    """
    v = lambda d: F.try_parse_json(d)
    nodes = lambda d: F.coalesce(F.try_variant_get(v(d), "$['@graph']", "array<variant>"), F.try_variant_get(v(d), "$", "array<variant>"), F.array(v(d)))
    kinds = lambda x: F.coalesce(F.try_variant_get(x, "$['@type']", "array<string>"), F.array(F.try_variant_get(x, "$['@type']", "string")))
    every = F.flatten(F.transform(F.filter(docs, lambda d: v(d).isNotNull()), nodes))
    orders = F.filter(every, lambda x: F.coalesce(F.arrays_overlap(kinds(x), F.array(F.lit("Order"), F.lit("Invoice"))), F.lit(False)))
    first = lambda x, *paths: F.coalesce(*[F.try_variant_get(x, p, "string") for p in paths])
    name = lambda x: F.coalesce(F.try_variant_get(x, "$.itemOffered.name", "string"), F.try_variant_get(x, "$.orderedItem.name", "string"), F.try_variant_get(x, "$.name", "string"))

    def read(found: Column) -> Column:
        lines = F.coalesce(F.try_variant_get(found, "$.acceptedOffer", "array<variant>"), F.try_variant_get(found, "$.orderedItem", "array<variant>"))
        return F.struct(
            first(found, "$.orderNumber", "$.confirmationNumber").alias("order_id"),
            first(found, "$.price", "$.totalPrice", "$.totalPaymentDue.price", "$.priceSpecification.price", "$.acceptedOffer.price").try_cast(MONEY).alias("total"),
            first(found, "$.priceCurrency", "$.totalPaymentDue.priceCurrency", "$.acceptedOffer.priceCurrency").alias("currency"),
            F.try_to_timestamp(F.substring(first(found, "$.orderDate", "$.dateCreated", "$.paymentDueDate"), 1, 10), F.lit("yyyy-MM-dd")).cast("date").alias("day"),
            first(found, "$.seller.name", "$.merchant.name", "$.broker.name").alias("seller"),
            F.transform(lines, name).alias("items"),
        )

    # Read inside the array, so that the documents are parsed once whatever is asked of the result.
    return F.get(F.transform(F.slice(orders, 1, 1), read), F.lit(0))


def parsed(rows: DataFrame, html_col: str, text_col: str) -> DataFrame:
    """``rows`` with order_id, total, method and confidence: linked data first (95), then patterns (80 with both, 60 with one), else none (0).

    Each part is evaluated once a row, behind a generator that the optimizer doesn't copy into its uses; linked data is looked for in pages that are marked as holding some.
    """
    marked = F.contains(html_col, F.lit("ld+json"))
    told = F.struct(order_id(F.col(text_col)).alias("id"), largest_amount(F.col(text_col)).alias("total"))
    out = rows.withColumn("__ld", F.explode(F.array(F.when(marked, order_of(json_ld(F.col(html_col)))))))
    # Patterns only where linked data hasn't decided.
    out = out.withColumn("__told", F.explode(F.array(F.when(F.col("__ld").isNull(), told))))
    by_ld, n = F.col("__ld").isNotNull(), F.col("__told.id").isNotNull().cast("int") + F.col("__told.total").isNotNull().cast("int")
    return out.withColumns({
        "order_id": F.when(by_ld, F.col("__ld.order_id")).otherwise(F.col("__told.id")),
        "total": F.when(by_ld, F.col("__ld.total")).otherwise(F.col("__told.total")),
        "method": F.when(by_ld, "linked_data").when(n > 0, "pattern").otherwise("none"),
        "confidence": F.when(by_ld, 95).when(n == 2, 80).when(n == 1, 60).otherwise(0).cast("long"),
    }).drop("__ld", "__told")


# How a table's cells are told apart.
ITEM_PRICE, ITEM_QUANTITY, NO_ITEM = r"[£$€]\s*([0-9,]+\.?\d*)", r"(?i)(?:qty|quantity)[:\s]*(\d+)|x(\d+)", r"order|total|subtotal|shipping|tax|delivery|amazon"
MOST_ITEMS = 10


def table_items(html: Column) -> Column:
    """Line items (name, price, quantity) of a page's tables: one for each row of two cells or more that names a product, the first ten names.

    A cell is a price, unless the name is known already, a quantity (else 1), or a name: 11 to 199 characters
    with three letters in a row and none of the words of totals and delivery; of several the last counts.
    """
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    text = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), r"\s+", " "))
    empty = F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast(MONEY).alias("price"), F.lit(1).alias("quantity"))

    def read(item: Column, cell: Column) -> Column:
        price = F.replace(F.regexp_extract(cell, ITEM_PRICE, 1), F.lit(","), F.lit("")).try_cast(MONEY)
        number = F.coalesce(*[F.nullif(F.regexp_extract(cell, ITEM_QUANTITY, k), F.lit("")) for k in (1, 2)]).try_cast("int")
        named = F.length(cell).between(11, 199) & F.rlike(cell, F.lit("[a-zA-Z]{3,}")) & ~F.rlike(F.lower(cell), F.lit(NO_ITEM))
        with_ = lambda **new: F.struct(*[new.get(n, item[n]).alias(n) for n in ("name", "price", "quantity")])
        return (
            F.when(F.length(cell) < 3, item).when(F.rlike(cell, F.lit(ITEM_PRICE)) & item["name"].isNull(), with_(price=price))
            .when(number.isNotNull(), with_(quantity=number)).when(named, with_(name=cell)).otherwise(item)
        )

    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), text))
    items = F.transform(F.filter(cells, lambda c: F.size(c) >= 2), lambda c: F.aggregate(c, empty, read))
    items = F.filter(items, lambda i: i["name"].isNotNull())
    names = F.transform(items, lambda i: i["name"])
    first = F.filter(items, lambda i, k: F.array_position(names, i["name"]) == k + 1)
    return F.slice(first, 1, MOST_ITEMS)
