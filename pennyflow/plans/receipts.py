"""Parsed receipts: searches, lists and statistics; soft deletion is a standing filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import receipts as op
from ..operators.tables import page
from .base import EVENTS, RECEIPTS, events, mails, query, receipt_matches, receipts_of, table, MAILS
from .ledger import dbl, percent

LIVE = f"{RECEIPTS}, v AS (SELECT * FROM r WHERE deleted_at IS NULL)"
RATE = "coalesce(round(({0})::DECIMAL(18,4) * 100 / nullif({1}, 0), 1), 0)::DOUBLE"


def live(spark, sf_dir) -> DataFrame:
    return op.live(receipts_of(spark, sf_dir))


@query("s21_soft_deletes", f"WITH {RECEIPTS} SELECT id, message_id FROM r WHERE deleted_at IS NULL AND NOT (parsing_status = 'failed' AND total_amount IS NULL)")
def soft_deletes(spark, sf_dir) -> DataFrame:
    """Receipts that are left when failed ones without an amount are marked as deleted too."""
    gone = (F.col("parsing_status") == "failed") & F.col("total_amount").isNull()
    return op.live(op.soft_deleted(receipts_of(spark, sf_dir), gone, F.col("received_at"))).select("id", "message_id")


@query("p05_receipt_search", f"""WITH {LIVE} SELECT v.id, merchant_name, parse_confidence, x.txn_id FROM v LEFT JOIN x ON x.receipt_id = v.id
WHERE contains(lower(merchant_name), 'shop 1') AND parsing_status = 'parsed' AND parse_method = 'pattern' AND parse_confidence >= 20 AND coalesce(n_items, 0) > 0 AND x.txn_id IS NOT NULL""")  # fmt: skip
def receipt_search(spark, sf_dir) -> DataFrame:
    """Receipts by merchant, status, method, least confidence, with items and with a match."""
    joined = live(spark, sf_dir).join(receipt_matches(spark, sf_dir), F.col("id") == F.col("receipt_id"), "left")
    keep = op.receipt_filter(merchant="Shop 1", status="parsed", method="pattern", least_confidence=20, with_items=True, with_match=True)
    return joined.where(keep).select("id", "merchant_name", "parse_confidence", "txn_id")


@query("p18_model_queue", f"WITH {LIVE} SELECT id, received_at::VARCHAR AS received_at FROM v WHERE parsing_status = 'unparseable' AND (llm_parse_status IS NULL OR llm_parse_status = 'failed') ORDER BY v.received_at DESC, id LIMIT 40")
def model_queue(spark, sf_dir) -> DataFrame:
    """The newest forty unparseable receipts that no model has tried or that failed (P18); the limit is the feature."""
    todo = live(spark, sf_dir).where((F.col("parsing_status") == "unparseable") & (F.col("llm_parse_status").isNull() | (F.col("llm_parse_status") == "failed")))
    return todo.orderBy(F.desc("received_at"), "id").limit(40).select("id", F.col("received_at").cast("string").alias("received_at"))


@query("j25_receipt_bodies", f"WITH {LIVE}, {MAILS.replace(EVENTS + ', ', '')} SELECT v.id, md5(mail.body) AS body, v.merchant_domain AS host FROM v LEFT JOIN mail ON mail.id = v.id AND mail.event_type = 'purchase'")
def receipt_bodies(spark, sf_dir) -> DataFrame:
    """Receipts with the stored body of their mail, where there is one."""
    bodies = mails(spark, sf_dir).where("event_type = 'purchase'").select("id", F.md5("body").alias("body"))
    return live(spark, sf_dir).join(bodies, "id", "left").select("id", "body", F.col("merchant_domain").alias("host"))


MATCHED = f"{LIVE}, c AS (SELECT n_nationkey AS connection_id, n_name FROM nation)"


@query("j26_match_list", f"""WITH {MATCHED} SELECT match_id, v.id AS receipt_id, t.amount::DOUBLE AS amount, n_name FROM x JOIN v ON v.id = x.receipt_id JOIN e t ON t.event_id = x.txn_id JOIN c ON c.connection_id = v.connection_id
ORDER BY x.confidence DESC, match_id LIMIT 20 OFFSET 20""")  # fmt: skip
def match_list(spark, sf_dir) -> DataFrame:
    """The second page of twenty matches with receipt, transaction and connection, surest first (J26); the limit is the feature."""
    t = events(spark, sf_dir).select(F.col("event_id").alias("txn_id"), F.col("amount").alias("txn_amount"))
    c = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("connection_id"), "n_name")
    r = live(spark, sf_dir).select(F.col("id").alias("receipt_id"), "connection_id")
    out = receipt_matches(spark, sf_dir).join(r, "receipt_id").join(t, "txn_id").join(c, "connection_id")
    return out.orderBy(F.desc("confidence"), "match_id").offset(20).limit(20).select("match_id", "receipt_id", dbl(F.col("txn_amount")).alias("amount"), "n_name")


@query("j27_merchant_receipts", f"""WITH {LIVE}, f AS (SELECT v.*, x.txn_id FROM v LEFT JOIN x ON x.receipt_id = v.id WHERE (lower(merchant_name) = lower('SHOP 3') OR lower(merchant_domain) = lower('Shop2.example')) AND parsing_status = 'parsed'),
n AS (SELECT count(*) AS total FROM f) SELECT f.id, txn_id::VARCHAR AS txn_id, total, ceil(total / 10.0)::BIGINT AS pages FROM f, n ORDER BY received_at DESC, f.id LIMIT 10""")  # fmt: skip
def merchant_receipts(spark, sf_dir) -> DataFrame:
    """The first page of a merchant's receipts by name or domain, whatever the case, with their matches (J27); the limit is the feature."""
    ours = (F.lower("merchant_name") == "shop 3") | (F.lower("merchant_domain") == "shop2.example")
    rows = live(spark, sf_dir).where(ours & (F.col("parsing_status") == "parsed")).join(receipt_matches(spark, sf_dir).select(F.col("receipt_id").alias("id"), "txn_id"), "id", "left")
    return page(rows.select("id", "txn_id", "received_at"), [F.desc("received_at"), "id"], number=1, size=10).select("id", F.col("txn_id").cast("string").alias("txn_id"), "total", "pages")


@query("j28_flagged_orders", """SELECT o_orderkey AS id, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS matched, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey""")
def flagged_orders(spark, sf_dir) -> DataFrame:
    """Orders with their account's attributes and whether a match is known."""
    from .describing import hits

    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c_custkey"))
    o = o.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment")), "c_custkey")
    return o.join(hits(spark, sf_dir).withColumn("hit", F.lit(True)), "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("matched"), "segment")


@query("a08_receipt_statistics", f"""WITH {RECEIPTS}, j AS (SELECT r.*, x.receipt_id FROM r LEFT JOIN (SELECT DISTINCT receipt_id FROM x) x ON x.receipt_id = r.id)
SELECT count_if(deleted_at IS NULL)::BIGINT AS total, count_if(deleted_at IS NULL AND parsing_status = 'parsed')::BIGINT AS parsed, count_if(deleted_at IS NULL AND parsing_status = 'pending')::BIGINT AS pending,
  count_if(deleted_at IS NULL AND parsing_status = 'failed')::BIGINT AS failed, count(DISTINCT receipt_id) AS matched, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day, coalesce(sum(llm_cost_cents), 0)::BIGINT AS cents FROM j""")  # fmt: skip
def receipt_statistics(spark, sf_dir) -> DataFrame:
    """Receipts by status, matches, days and costs; a receipt with several matches counts once."""
    known = receipt_matches(spark, sf_dir).select(F.col("receipt_id").alias("id")).distinct().withColumn("hit", F.col("id"))
    r = receipts_of(spark, sf_dir).join(known, "id", "left")
    alive = F.col("deleted_at").isNull()
    part = lambda s: F.count_if(alive & (F.col("parsing_status") == s)).alias(s)
    return r.agg(
        F.count_if(alive).alias("total"), part("parsed"), part("pending"), part("failed"), F.countDistinct("hit").alias("matched"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"),
        F.coalesce(F.sum("llm_cost_cents"), F.lit(0)).alias("cents"),
    )


@query("a09_model_queue_summary", f"""WITH {LIVE} SELECT count(*) AS total, count_if(llm_parse_status IS NULL)::BIGINT AS available, count_if(llm_parse_status = 'pending')::BIGINT AS pending, count_if(llm_parse_status = 'processing')::BIGINT AS processing,
  count_if(llm_parse_status = 'completed')::BIGINT AS completed, count_if(llm_parse_status = 'failed')::BIGINT AS failed, coalesce(sum(llm_cost_cents), 0)::BIGINT AS estimated, coalesce(sum(CASE WHEN llm_parse_status = 'completed' THEN llm_cost_cents END), 0)::BIGINT AS actual
FROM v WHERE parsing_status = 'unparseable'""")  # fmt: skip
def model_queue_summary(spark, sf_dir) -> DataFrame:
    """The queue of a model by status, with estimated and actual costs, 0 where there are none."""
    s = F.col("llm_parse_status")
    part = lambda x: F.count_if(s == x).alias(x)
    cents = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return live(spark, sf_dir).where("parsing_status = 'unparseable'").agg(
        F.count("*").alias("total"), F.count_if(s.isNull()).alias("available"), part("pending"), part("processing"), part("completed"), part("failed"),
        cents(F.col("llm_cost_cents")).alias("estimated"), cents(F.when(s == "completed", F.col("llm_cost_cents"))).alias("actual"),
    )


@query("a11_parse_statistics", f"""WITH {LIVE} SELECT coalesce(merchant_name, 'Unknown') AS merchant, merchant_domain AS host, coalesce(parse_method, 'none') AS method, count(*) AS n, count_if(parsing_status = 'parsed')::BIGINT AS parsed,
  count_if(parsing_status = 'failed')::BIGINT AS failed, count_if(parsing_status = 'unparseable')::BIGINT AS unparseable, count_if(parsing_status = 'pending')::BIGINT AS pending, count_if(total_amount IS NOT NULL)::BIGINT AS amounts, count_if(n_items > 0)::BIGINT AS with_items,
  count_if(parse_confidence >= 80)::BIGINT AS sure, sum(coalesce(n_items, 0))::BIGINT AS items, sum(llm_cost_cents)::BIGINT AS cents, round(sum(parse_confidence)::DECIMAL(18,4) / count(*), 1)::DOUBLE AS mean_confidence,
  round(sum(total_amount) / nullif(count(total_amount), 0), 2)::DOUBLE AS mean_amount, {RATE.format("count_if(parsing_status = 'parsed')", 'count(*)')} AS parse_rate, {RATE.format('count_if(n_items > 0)', 'count(*)')} AS item_rate FROM v GROUP BY ALL""")  # fmt: skip
def parse_statistics(spark, sf_dir) -> DataFrame:
    """Ten sums, two means and two rates by merchant, domain and method."""
    part = lambda s: F.count_if(F.col("parsing_status") == s)
    items = F.count_if(F.col("n_items") > 0)
    g = live(spark, sf_dir).groupBy(F.coalesce("merchant_name", F.lit("Unknown")).alias("merchant"), F.col("merchant_domain").alias("host"), F.coalesce("parse_method", F.lit("none")).alias("method"))
    return g.agg(
        F.count("*").alias("n"), part("parsed").alias("parsed"), part("failed").alias("failed"), part("unparseable").alias("unparseable"), part("pending").alias("pending"), F.count("total_amount").alias("amounts"), items.alias("with_items"),
        F.count_if(F.col("parse_confidence") >= 80).alias("sure"), F.sum(F.coalesce("n_items", F.lit(0))).alias("items"), F.sum("llm_cost_cents").alias("cents"),
        dbl(F.round(F.sum("parse_confidence").cast("decimal(18,4)") / F.count("*"), 1)).alias("mean_confidence"), dbl(F.round(F.sum("total_amount") / F.nullif(F.count("total_amount"), F.lit(0)), 2)).alias("mean_amount"),
        percent(part("parsed"), F.count("*")).alias("parse_rate"), percent(items, F.count("*")).alias("item_rate"),
    )


@query("a38_parsing_gaps", f"""WITH {LIVE}, m AS (SELECT DISTINCT receipt_id FROM x), g AS (SELECT coalesce(merchant_name, merchant_domain) AS merchant, count(*) AS n, count_if(parsing_status = 'parsed')::BIGINT AS parsed, count_if(n_items > 0)::BIGINT AS with_items,
  count(m.receipt_id) AS matched, count_if(parse_confidence < 50)::BIGINT AS unsure FROM v LEFT JOIN m ON m.receipt_id = v.id GROUP BY 1)
SELECT *, {RATE.format('parsed', 'n')} AS parse_rate, {RATE.format('with_items', 'n')} AS item_rate, {RATE.format('matched', 'n')} AS match_rate FROM g WHERE n >= 5""")  # fmt: skip
def parsing_gaps(spark, sf_dir) -> DataFrame:
    """Merchants of five receipts or more by how badly they parse, the worst first; unsure is a confidence below 50 of 100."""
    known = receipt_matches(spark, sf_dir).select(F.col("receipt_id").alias("id")).distinct().withColumn("hit", F.lit(1))
    g = live(spark, sf_dir).join(known, "id", "left").groupBy(F.coalesce("merchant_name", "merchant_domain").alias("merchant")).agg(
        F.count("*").alias("n"), F.count_if(F.col("parsing_status") == "parsed").alias("parsed"), F.count_if(F.col("n_items") > 0).alias("with_items"), F.count("hit").alias("matched"), F.count_if(F.col("parse_confidence") < 50).alias("unsure")
    ).where("n >= 5")
    rate = lambda c: percent(F.col(c), F.col("n"))
    return g.withColumns({"parse_rate": rate("parsed"), "item_rate": rate("with_items"), "match_rate": rate("matched")}).orderBy("parse_rate", "merchant")


@query("a41_store_statistics", "SELECT count(*) AS n, coalesce(sum(octet_length(encode(html))), 0)::BIGINT AS bytes, count(DISTINCT sha256(html)) AS contents, count(DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS hosts FROM pages")
def store_statistics(spark, sf_dir) -> DataFrame:
    """Stored files: their number, bytes, distinct contents by hash and distinct owners."""
    p = table(spark, sf_dir, "pages")
    bytes_ = F.coalesce(F.sum(F.octet_length(F.encode("html", "UTF-8"))), F.lit(0)).cast("long")
    return p.agg(F.count("*").alias("n"), bytes_.alias("bytes"), F.countDistinct(F.sha2("html", 256)).alias("contents"), F.countDistinct(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)).alias("hosts"))


@query("a46_quality_audit", f"""WITH {LIVE} SELECT coalesce(parse_method, 'none') AS method, count(*) AS n, count_if(merchant_name IS NULL)::BIGINT AS no_merchant, count_if(total_amount IS NULL)::BIGINT AS no_amount, count_if(total_amount = 0)::BIGINT AS zero_amount,
  {RATE.format('count_if(merchant_name IS NOT NULL)', 'count(*)')} AS brand_coverage, round(sum(total_amount) / nullif(count(total_amount), 0), 2)::DOUBLE AS mean_amount,
  count(*) FILTER (WHERE merchant_name IS NOT NULL AND total_amount IS NOT NULL AND n_items > 0) AS complete FROM v GROUP BY 1""")  # fmt: skip
def quality_audit(spark, sf_dir) -> DataFrame:
    """What receipts lack, by the method that parsed them."""
    return live(spark, sf_dir).groupBy(F.coalesce("parse_method", F.lit("none")).alias("method")).agg(
        F.count("*").alias("n"), F.count_if(F.col("merchant_name").isNull()).alias("no_merchant"), F.count_if(F.col("total_amount").isNull()).alias("no_amount"), F.count_if(F.col("total_amount") == 0).alias("zero_amount"),
        percent(F.count("merchant_name"), F.count("*")).alias("brand_coverage"), dbl(F.round(F.sum("total_amount") / F.nullif(F.count("total_amount"), F.lit(0)), 2)).alias("mean_amount"),
        F.count_if(F.col("merchant_name").isNotNull() & F.col("total_amount").isNotNull() & (F.col("n_items") > 0)).alias("complete"),
    )


@query("a12_recent_errors", f"""WITH {EVENTS}, f AS (SELECT * FROM e WHERE event_type = 'error' AND day >= (SELECT max(day) FROM e) - 7)
SELECT event_id, (user_id % 10)::VARCHAR AS stage, event_id % 3 <> 0 AS retryable, (SELECT count(*) FROM f) AS total, (SELECT count_if(event_id % 3 <> 0) FROM f)::BIGINT AS retryable_total FROM f ORDER BY ts DESC, event_id LIMIT 20""")  # fmt: skip
def recent_errors(spark, sf_dir) -> DataFrame:
    """The last twenty errors of the last week, with how many there are and may be tried again (A12); the limit is the feature."""
    e = events(spark, sf_dir)
    f = e.crossJoin(F.broadcast(e.agg(F.date_sub(F.max("day"), 7).alias("since")))).where("event_type = 'error' AND day >= since").withColumn("retryable", F.col("event_id") % 3 != 0)
    sums = f.agg(F.count("*").alias("total"), F.count_if("retryable").alias("retryable_total"))
    last = f.orderBy(F.desc("ts"), "event_id").limit(20).select("event_id", (F.col("user_id") % 10).cast("string").alias("stage"), "retryable")
    return last.crossJoin(sums)


@query("j18_merchant_coverage", f"""WITH {LIVE}, m AS (SELECT DISTINCT lower(merchant_name) AS name FROM v WHERE merchant_name IS NOT NULL),
t AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'My Shop ' || (user_id % 20)::VARCHAR END AS merchant, 'card to the' || CASE WHEN event_id % 2 = 0 THEN 'SHOP ' ELSE 'other' END || (user_id % 15)::VARCHAR || 'town' AS description, event_id % 8 AS k FROM e WHERE event_type = 'purchase'),
j AS (SELECT m.name, t.*, t.event_id IN (SELECT txn_id FROM x) AS hit FROM m JOIN t ON contains(lower(coalesce(merchant, '')), m.name) OR contains(lower(description), m.name))
SELECT name, count(*) AS txns, count_if(NOT hit)::BIGINT AS uncovered, count_if(k IN (1, 5))::BIGINT AS amazon, count_if(k = 1)::BIGINT AS amazon_business, count_if(k IN (2, 6))::BIGINT AS apple FROM j GROUP BY 1""")  # fmt: skip
def merchant_coverage(spark, sf_dir) -> DataFrame:
    """Transactions whose merchant or description holds a receipts' merchant anywhere, inside words too: how many no receipt covers, and how many each other source does."""
    names = live(spark, sf_dir).where("merchant_name IS NOT NULL").select(F.lower("merchant_name").alias("name")).distinct()
    e = events(spark, sf_dir, "purchase")
    place = F.when(F.col("event_id") % 2 == 0, "SHOP ").otherwise("other")
    t = e.select(
        F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("My Shop "), (F.col("user_id") % 20).cast("string"))).alias("merchant"),
        F.concat(F.lit("card to the"), place, (F.col("user_id") % 15).cast("string"), F.lit("town")).alias("description"),
    )
    k = F.col("event_id") % 8
    kinds = F.array_compact(F.array(F.when(k.isin(1, 5), "amazon"), F.when(k == 1, "amazon_business"), F.when(k.isin(2, 6), "apple")))
    sources = e.select(F.col("event_id").alias("id"), F.explode(kinds).alias("source"))
    matched = receipt_matches(spark, sf_dir).select(F.col("txn_id").alias("id"))
    return op.coverage(t, names, matched, sources, ("amazon", "amazon_business", "apple"))
