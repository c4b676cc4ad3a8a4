"""The register of queries, and the driver's tables in the roles that the operators expect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import MONEY

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with SQL of the same rows where SQL can express it."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as bank transactions: finished ones are debits; the unspecified priority stands for no category."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("account_id"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").cast(MONEY).alias("amount"),
        F.when(F.col("o_orderstatus") == "F", "DEBIT").otherwise("CREDIT").alias("type"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("category"),
        F.concat(F.lit("S"), (F.col("o_custkey") % 4).cast("string")).alias("subcategory"), F.col("o_orderstatus").alias("status"),
    )


#: The same in SQL, as the first of a query's common tables.
TXNS = """t AS (
  SELECT o_orderkey AS id, o_custkey AS account_id, o_orderdate::DATE AS day, o_totalprice::DECIMAL(18,2) AS amount,
    CASE WHEN o_orderstatus = 'F' THEN 'DEBIT' ELSE 'CREDIT' END AS type,
    CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS category,
    'S' || (o_custkey % 4)::VARCHAR AS subcategory, o_orderstatus AS status
  FROM orders
)"""


def events(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    """Events with a money amount and a day; those of one kind, or all."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.to_date("ts").alias("day"), "user_id", "event_type", F.col("value").cast(MONEY).alias("amount"), "props")
    return e if kind is None else e.where(F.col("event_type") == kind)


EVENTS = "e AS (SELECT event_id, ts, ts::DATE AS day, user_id, event_type, value::DECIMAL(18,2) AS amount, props FROM events)"


def banked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the kind ``purchase`` as transactions of a matching job."""
    e = events(spark, sf_dir, "purchase")
    return e.select(F.col("event_id").alias("txn_id"), F.col("day").alias("txn_day"), F.col("amount").alias("txn_amount"))


def bought(spark: SparkSession, sf_dir: str, kind: str = "view") -> DataFrame:
    """Events of another kind as the purchases."""
    e = events(spark, sf_dir, kind)
    return e.select(F.col("event_id").alias("purchase_id"), F.col("day").alias("purchase_day"), F.col("amount").alias("purchase_amount"))


#: Merchants and descriptions that the finance tables' own columns lack, by a row's ids. ``{m}`` is the merchant, ``{d}`` the day as dd-mm-yyyy, ``{id}`` the id.
MERCHANTS = (
    "Amazon.co.uk*6Q22J0R25", "AMZNMktplace*E25645GE5", "eBay O*08-12045-48091", "WWW.AMAZON.* TH2TK7EM4", "APPLE.COM/BILL", "Tesco Stores 2041", "CREDIT FROM PayPal *shop", "Prime Coffee Ltd.", "", "Amazon Prime",
)
DESCRIPTIONS = (
    "CARD PAYMENT TO {m} ON {d}",
    "{m} (VIA APPLE PAY), ON {d}",
    "CARD PAYMENT TO Shop*R{id} ON {d}",
    "CARD PAYMENT TO Zipcar Trip T{id} ON {d}",
    "DIRECT DEBIT PAYMENT TO Payee {id} REF A{id}, MANDATE NO {id}",
    "DIRECT DEBIT PAYMENT TO Water Board REF x{id}/MANDATE NO {id} late",
    "DIRECT DEBIT PAYMENT TO Gas Board",
    "TRANSFER FROM Customer {id}",
    "{id} Direct Debit Payments at 1.00% Cashback",
    "INTEREST PAID AFTER TAX 0.25 DEDUCTED",
    "AIRBNB * HM{id}, card payment to host",
    "CARD PAYMENT TO LIME RIDE",
    "card payment shop in town ,240.00 USD, RATE 0.7521/GBP ON {d}",
    "TO ACCOUNT 090129 30458079 REF {id}",
    "{id}",
    "",
)


def pick(values, at):
    """The text at the place ``at``, counted around."""
    quoted = ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
    return F.get(F.expr(f"array({quoted})"), F.pmod(at, F.lit(len(values))).cast("int"))


def pick_sql(values, at: str) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[(({at}) % {len(values)} + 1)::BIGINT]"


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with a merchant, null where it has none, and a bank's description."""
    text = pick(DESCRIPTIONS, F.col("id"))
    parts = {"{m}": F.coalesce("merchant", F.lit("")), "{d}": F.date_format("day", "dd-MM-yyyy"), "{id}": F.col("id").cast("string")}
    for mark, value in parts.items():
        text = F.replace(text, F.lit(mark), value)
    return txns(spark, sf_dir).withColumn("merchant", F.nullif(pick(MERCHANTS, F.col("account_id")), F.lit(""))).withColumn("description", text)


#: The same in SQL, after TXNS.
DESCRIBED = f"""{TXNS}, dm AS (SELECT *, nullif({pick_sql(MERCHANTS, "account_id")}, '') AS merchant FROM t),
d AS (SELECT *, replace(replace(replace({pick_sql(DESCRIPTIONS, "id")}, '{{m}}', coalesce(merchant, '')), '{{d}}', strftime(day, '%d-%m-%Y')), '{{id}}', id::VARCHAR) AS description FROM dm)"""

SENDERS = (
    "auto-confirm@amazon.co.uk", "deals@amazon.co.uk", "ebay@ebay.com", "noreply@uber.com", "service@paypal.co.uk", "microsoft-noreply@microsoft.com", "no_reply@email.apple.com", "friend@gmail.com", "hello@shop.example", "orders@shop.example", "news@woolrich.com",
)
SUBJECTS = (
    "Ordered: 'red bolt'", "Your order is confirmed.", "Order confirmed: blue ring", "Your Thursday evening trip with Uber", "Receipt for your payment to Shop", "Your purchase of Office has been processed", "Your receipt from Apple.",
    "Shop now: sale ends today", "Your order has shipped", "Order confirmation #A{id}B77 - thank you for your order", "Your refund for order A{id}", "Your subscription is confirmed", "Booking confirmation for A{id}", "Hello there", "Your order was cancelled", "thank you for your purchase",
)
BODIES = ("Thanks for your order. Total: £{a}", "This order is placed on behalf of a company. Amount paid $ {a}", "unsubscribe here, special discount inside", "Invoice number INV-{id}99 of 15 January 2024", "Out for delivery on 03/02/2024", "", "total due {a} EUR by 2024-03-05")
NAMES = ("Bloom & Co", "noreply", "", "Black Friday Team", "The Body Shop", "November 12")


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as mails: sender, subject, body and the header and markup that some have, by a row's ids."""
    e = events(spark, sf_dir)
    fill = lambda c: F.replace(F.replace(c, F.lit("{id}"), F.col("event_id").cast("string")), F.lit("{a}"), F.col("amount").cast("string"))
    return e.select(
        F.col("event_id").alias("id"), "ts", "day", "user_id", "amount", "event_type", pick(SENDERS, F.col("user_id") + F.col("event_id")).alias("sender"), fill(pick(SUBJECTS, F.col("event_id"))).alias("subject"),
        fill(pick(BODIES, F.col("user_id"))).alias("body"), F.nullif(pick(NAMES, F.col("event_id")), F.lit("")).alias("sender_name"), F.when(F.col("event_id") % 9 == 0, "<mailto:x>").alias("unsubscribe"), (F.col("event_id") % 31 == 0).alias("markup"),
    )


#: The same in SQL, after EVENTS.
MAILS = f"""{EVENTS}, mail AS (SELECT event_id AS id, ts, day, user_id, amount, event_type, {pick_sql(SENDERS, "user_id + event_id")} AS sender,
  replace(replace({pick_sql(SUBJECTS, "event_id")}, '{{id}}', event_id::VARCHAR), '{{a}}', amount::VARCHAR) AS subject,
  replace(replace({pick_sql(BODIES, "user_id")}, '{{id}}', event_id::VARCHAR), '{{a}}', amount::VARCHAR) AS body,
  nullif({pick_sql(NAMES, "event_id")}, '') AS sender_name, CASE WHEN event_id % 9 = 0 THEN '<mailto:x>' END AS unsubscribe, event_id % 31 = 0 AS markup FROM e)"""


def receipts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as parsed receipts: status, method, confidence, items, cost, soft deletion."""
    e = events(spark, sf_dir)
    return e.select(
        F.col("event_id").alias("id"), (F.col("user_id") % 3).alias("connection_id"), F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message_id"), F.col("ts").alias("received_at"), "day",
        F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("Shop "), (F.col("user_id") % 12).cast("string"))).alias("merchant_name"), F.concat(F.lit("Shop"), (F.col("user_id") % 5).cast("string"), F.lit(".example")).alias("merchant_domain"),
        F.when(F.col("event_id") % 11 != 0, F.col("amount")).alias("total_amount"), pick(STATUSES, F.col("event_id")).alias("parsing_status"), F.nullif(pick(METHODS, F.col("user_id")), F.lit("")).alias("parse_method"),
        (F.col("event_id") % 101).alias("parse_confidence"), F.nullif(pick(MODEL_STATUSES, F.col("event_id") + F.col("user_id")), F.lit("")).alias("llm_parse_status"), (F.col("event_id") % 4).alias("llm_cost_cents"),
        F.get_json_object("props", "$.k").cast("long").alias("n_items"), F.when(F.col("event_id") % 13 == 0, F.col("ts")).alias("deleted_at"),
    )


STATUSES = ("parsed", "unparseable", "pending", "parsed", "failed", "unparseable", "parsed")
METHODS = ("vendor_parser", "schema_org", "", "pattern", "llm")
MODEL_STATUSES = ("", "pending", "processing", "completed", "failed")
#: The same in SQL, after EVENTS; and matches of receipts: purchases of the next id that weren't refused.
RECEIPTS = f"""{EVENTS}, r AS (SELECT event_id AS id, user_id % 3 AS connection_id, 'm' || event_id::VARCHAR AS message_id, ts AS received_at, day,
  CASE WHEN user_id % 7 <> 0 THEN 'Shop ' || (user_id % 12)::VARCHAR END AS merchant_name, 'Shop' || (user_id % 5)::VARCHAR || '.example' AS merchant_domain,
  CASE WHEN event_id % 11 <> 0 THEN amount END AS total_amount, {pick_sql(STATUSES, "event_id")} AS parsing_status, nullif({pick_sql(METHODS, "user_id")}, '') AS parse_method,
  event_id % 101 AS parse_confidence, nullif({pick_sql(MODEL_STATUSES, "event_id + user_id")}, '') AS llm_parse_status, event_id % 4 AS llm_cost_cents,
  json_extract_string(props, '$.k')::BIGINT AS n_items, CASE WHEN event_id % 13 = 0 THEN ts END AS deleted_at FROM e),
x AS (SELECT event_id AS match_id, event_id - 1 AS receipt_id, event_id AS txn_id, (60 + event_id % 41)::BIGINT AS confidence FROM e WHERE event_type = 'purchase')"""


def receipt_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of receipts: each purchase belongs to the receipt of the id before."""
    e = events(spark, sf_dir, "purchase")
    return e.select(F.col("event_id").alias("match_id"), (F.col("event_id") - 1).alias("receipt_id"), F.col("event_id").alias("txn_id"), (60 + F.col("event_id") % 41).cast("long").alias("confidence"))


def bank_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``banked`` with a merchant and a description, of which some name another day."""
    e = events(spark, sf_dir, "purchase").withColumn("txn_merchant", F.nullif(pick(BANK_MERCHANTS, F.col("user_id")), F.lit("")))
    later = F.concat(F.lit(" ON "), F.date_format(F.date_add("day", 1), "dd-MM-yyyy"))
    text = F.concat(pick(BANK_TEXTS, F.col("user_id")), F.when(F.col("event_id") % 3 == 0, later).otherwise(""))
    return e.select(F.col("event_id").alias("txn_id"), F.col("day").alias("txn_day"), F.col("ts").alias("txn_ts"), F.col("amount").alias("txn_amount"), "txn_merchant", text.alias("txn_description"))


BANK_MERCHANTS = ("Apple", "Amazon", "", "Amazon", "Tesco")
BANK_TEXTS = ("APPLE.COM/BILL", "AMAZON.CO.UK RETAIL", "ITUNES VIA APPLE PAY", "AMZN MKTP UK*1A2B3", "TESCO STORES")
#: The same in SQL, after EVENTS.
BANK = f"""{EVENTS}, b AS (SELECT event_id AS txn_id, day AS txn_day, ts AS txn_ts, amount AS txn_amount, nullif({pick_sql(BANK_MERCHANTS, "user_id")}, '') AS txn_merchant,
  {pick_sql(BANK_TEXTS, "user_id")} || CASE WHEN event_id % 3 = 0 THEN ' ON ' || strftime(day + 1, '%d-%m-%Y') ELSE '' END AS txn_description FROM e WHERE event_type = 'purchase'),
p AS (SELECT event_id AS purchase_id, day AS purchase_day, amount AS purchase_amount FROM e WHERE event_type = 'view')"""
