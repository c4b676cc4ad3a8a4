"""Merchant keys, amounts, dates, keywords, pages, receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, mail, money, text
from ..operators import mining, receipts
from .base import EVENTS, events, pick, pick_sql, query, table


#: Endings and beginnings that keys lose, or keep.
ENDINGS = (" & Sons, Ltd", " Limited Inc", ".co.uk", " UK", ".com uk", " plc.", " Llc", "-shop", " uk.com", "")
STARTS = ("Card payment direct debit ", "payment to card payment ", "Debit card ", "Faster payment to ", "")
TAILS = (" London", " GB", " UK London", " www.", " gb uk", "*12")


def off_sql(x: str, endings, start: bool = False) -> str:
    for e in endings:
        x = f"regexp_replace({x}, '^{e}', '')" if start else f"regexp_replace({x}, '\\s*{e.replace('.', '[.]')}$', '')"
    return x


@query("f03_merchant_keys", f"""WITH n AS (SELECT p_partkey AS id, ' ' || upper(p_name) || {pick_sql(ENDINGS, 'p_partkey')} AS a, {pick_sql(STARTS, 'p_partkey')} || p_name || {pick_sql(TAILS, 'p_partkey // 5')} AS b FROM part)
SELECT id, trim(regexp_replace(regexp_replace({off_sql('trim(lower(a))', (' ltd', ' limited', ' inc', ' plc', ' llc', '.com', '.co.uk', ' uk'))}, '[^a-z0-9_\\s]', '', 'g'), '\\s+', ' ', 'g')) AS merchant,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({off_sql('lower(b)', ('payment to ', 'card payment ', 'direct debit ', 'debit card '), True)}, ' gb$', ''), ' uk$', ''), ' london$', ''), ' www[.]$', ''), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS bank FROM n""")  # fmt: skip
def merchant_keys(spark, sf_dir) -> DataFrame:
    """Keys under which a receipt's and a bank's merchant meet."""
    p = table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey"))
    receipt = F.concat(F.lit(" "), F.upper("p_name"), pick(ENDINGS, F.col("k")))
    bank = F.concat(pick(STARTS, F.col("k")), "p_name", pick(TAILS, F.floor(F.col("k") / 5)))
    return p.select(F.col("p_partkey").alias("id"), text.merchant_key(receipt).alias("merchant"), text.bank_key(bank).alias("bank"))


@query("f12_hosts", "SELECT nullif(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '') AS host, count(*) AS n FROM pages GROUP BY 1")
def hosts(spark, sf_dir) -> DataFrame:
    """Pages by host."""
    return table(spark, sf_dir, "pages").groupBy(text.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query("f20_dates_and_amounts", r"""SELECT o_orderkey AS id, o_orderdate::DATE::VARCHAR AS iso, o_orderdate::DATE::VARCHAR AS embedded, NULL::VARCHAR AS bad, o_totalprice::DECIMAL(18,2)::DOUBLE AS money,
  o_totalprice::DECIMAL(18,2)::DOUBLE AS largest, 0::DOUBLE AS none, least(length('order ' || o_orderkey::VARCHAR) // 4, 2000)::BIGINT AS tokens FROM orders""")  # fmt: skip
def dates_and_amounts(spark, sf_dir) -> DataFrame:
    """Dates and amounts read back from texts made of them."""
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.date_format("o_orderdate", "dd-MM-yyyy").alias("uk"), amount.cast("string").alias("a"))
    note = F.concat(F.lit("was £1.00, now Total: £"), "a", F.lit(" on "), "uk")
    return o.select(
        F.col("o_orderkey").alias("id"), dates.order_date(F.concat("d", F.lit("T10:00:00Z"))).cast("string").alias("iso"), dates.embedded_date(note).cast("string").alias("embedded"),
        dates.order_date(F.concat(F.lit("x"), "d")).cast("string").alias("bad"), money.currency_value(F.concat(F.lit("£ "), "a")).alias("money"), money.largest_amount(note).cast("double").alias("largest"),
        money.currency_value(F.lit("n/a")).alias("none"), money.token_estimate(F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))).alias("tokens"),
    )


@query("f40_keywords", r"""WITH w AS (SELECT p_partkey, string_split(trim(regexp_replace(lower(p_name), '[^\w]+', ' ', 'g')), ' ') AS w FROM part),
g AS (SELECT p_partkey, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS term FROM w),
c AS (SELECT term, count(*) AS n, count(DISTINCT p_partkey) AS df FROM g GROUP BY 1)
SELECT term, n::BIGINT AS n, df, round(ln((SELECT count(*) FROM part)::DOUBLE / df), 6) AS idf FROM c WHERE n >= 3 AND df <= floor(0.3 * (SELECT count(*) FROM part))""")  # fmt: skip
def keywords(spark, sf_dir) -> DataFrame:
    """Terms of up to three words in names."""
    p = table(spark, sf_dir, "part").select("p_name")
    return mining.keywords(p, "p_name").select("term", "n", "df", "idf")


#: Kinds of one array, in expectation, and arrays of kinds that are broadcast, at most.
ARRAY_KINDS, BROADCAST_ARRAYS = 500, 200


@query("f43_similarity")
def name_similarity(spark, sf_dir) -> DataFrame:
    """The most similar type for each distinct name, from 40 on (F43, F44); a null name has a null one. SQL has no matching-blocks ratio."""
    p = table(spark, sf_dir, "part")
    names, kinds = p.select("p_name").distinct(), p.select(F.lower("p_type").alias("kind")).dropna().distinct()
    n_arrays = -(-kinds.count() // ARRAY_KINDS) or 1
    arrays = kinds.groupBy(F.pmod(F.xxhash64("kind"), F.lit(n_arrays))).agg(F.collect_list("kind").alias("kinds")).select("kinds")
    pairs = names.dropna().crossJoin(F.broadcast(arrays) if n_arrays <= BROADCAST_ARRAYS else arrays).select("p_name", F.explode("kinds").alias("kind"))
    scored = pairs.withColumn("score", mining.similarity("p_name", "kind"))
    best = scored.groupBy("p_name").agg(F.max_by(F.struct("kind", "score"), F.struct("score", "kind")).alias("b"))
    return names.join(best, "p_name", "left").select("p_name", F.when(F.col("b.score") >= 40, F.col("b.kind")).alias("kind"), F.col("b.score").alias("score"))


@query("f60_receipt_hash", f"""WITH {EVENTS} SELECT sha256('u' || user_id::VARCHAR || '|' || CASE WHEN amount = 0 THEN '' ELSE amount::VARCHAR END || '|' || day::VARCHAR || '|') AS key, count(*) AS n, min(event_id) AS kept
FROM e GROUP BY 1""")  # fmt: skip
def receipt_hashes(spark, sf_dir) -> DataFrame:
    """Receipts by their key: copies have one."""
    key = text.receipt_hash(F.concat(F.lit(" U"), F.col("user_id").cast("string")), F.col("amount"), F.col("day"), F.lit(None).cast("string"))
    return events(spark, sf_dir).groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min("event_id").alias("kept"))


@query("f61_page_text", r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?is)<head\b.*?</head>', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(h, '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS t FROM a)
SELECT page_id, md5(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS digest, length(trim(regexp_replace(t, '\s+', ' ', 'g')))::BIGINT AS n FROM b""")  # fmt: skip
def page_text(spark, sf_dir) -> DataFrame:
    """Pages' texts, by digest and length."""
    t = table(spark, sf_dir, "pages").select("page_id", text.html_text(F.col("html")).alias("t"))
    return t.select("page_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


@query("f51_json_props", "SELECT event_type, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k, count_if(json_extract_string(props, '$.z') IS NULL)::BIGINT AS missing FROM events GROUP BY 1")
def json_props(spark, sf_dir) -> DataFrame:
    """Fields of JSON texts."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"), F.count_if(F.get_json_object("props", "$.z").isNull()).alias("missing"))


@query("x02_parse_cascade", """WITH o AS (SELECT o_orderkey AS id, o_orderkey % 3 AS kind, o_totalprice::DECIMAL(18,2) AS a FROM orders)
SELECT id, CASE kind WHEN 0 THEN 'N' || id::VARCHAR WHEN 1 THEN 'ref-' || (10000 + id)::VARCHAR END AS order_id, CASE WHEN kind < 2 THEN a END::DOUBLE AS total,
  CASE kind WHEN 0 THEN 'linked_data' WHEN 1 THEN 'pattern' ELSE 'none' END AS method, CASE kind WHEN 0 THEN 95 WHEN 1 THEN 80 ELSE 0 END::BIGINT AS confidence FROM o""")  # fmt: skip
def parse_cascade(spark, sf_dir) -> DataFrame:
    """Linked data, then patterns, then nothing, over mails made from orders."""
    amount, oid, kind = F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 3
    ld = F.concat(F.lit('<html><script type="application/ld+json">{"@type":"Order","orderNumber":"N'), oid, F.lit('","acceptedOffer":{"price":"'), amount, F.lit('"}}</script></html>'))
    body = F.concat(F.lit("Order number: ref-"), (F.col("o_orderkey") + 10000).cast("string"), F.lit(". Total: £"), amount)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(kind == 0, ld).otherwise("<html></html>").alias("html"), F.when(kind == 1, body).otherwise("hello").alias("body"))
    return receipts.parsed(o, "html", "body").select("id", "order_id", F.col("total").cast("double").alias("total"), "method", "confidence")


@query("f66_line_items", """SELECT p_partkey AS id, 1::BIGINT AS n, p_name || ' of the kind ' || p_type AS name, p_retailprice::DECIMAL(18,2)::DOUBLE AS price, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 1 END::BIGINT AS quantity FROM part""")
def line_items(spark, sf_dir) -> DataFrame:
    """Items in the tables of mails made from parts: a price, a name and maybe a quantity in a row, beside rows that are no items and a repeated one."""
    price, name = F.col("p_retailprice").cast("decimal(18,2)").cast("string"), F.concat(F.col("p_name"), F.lit(" of the kind "), F.col("p_type"))
    row = F.concat(F.lit("<tr class=x><td> £"), price, F.lit("</td><td><b>"), name, F.lit("</b></td>"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("<td>Qty: "), F.col("p_size").cast("string"), F.lit("</td>"))).otherwise(""), F.lit("</tr>"))
    html = F.concat(F.lit("<table><tr><th>Item price</th></tr>"), row, row, F.lit("<tr><td>Grand total of all</td><td>£1,000.00</td></tr><tr><td>one cell only in this</td></tr></table>"))
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), receipts.table_items(html).alias("items"))
    first = F.get("items", F.lit(0))
    return items.select("id", F.size("items").cast("long").alias("n"), first["name"].alias("name"), first["price"].cast("double").alias("price"), first["quantity"].cast("long").alias("quantity"))


@query("f52_order_markup", """WITH p AS (SELECT page_id, html || CASE page_id % 3 WHEN 0 THEN '{"@type":"Order"}' WHEN 1 THEN '<div itemtype="http://schema.org/Order">' ELSE '"@type"' END AS h FROM pages)
SELECT page_id, (contains(h, '"@type"') AND contains(h, '"Order"')) OR (contains(h, 'itemtype') AND contains(h, 'schema.org/Order')) AS marked FROM p""")  # fmt: skip
def order_markup(spark, sf_dir) -> DataFrame:
    """Pages that name an order as linked data or microdata."""
    k = F.col("page_id") % 3
    more = F.when(k == 0, '{"@type":"Order"}').when(k == 1, '<div itemtype="http://schema.org/Order">').otherwise('"@type"')
    return table(spark, sf_dir, "pages").select("page_id", mail.has_order_markup(F.concat("html", more)).alias("marked"))


@query("f51_json_arrays", """SELECT l_orderkey AS id, count(*) AS length, bool_or(l_returnflag = 'R') AS returned, 'ARRAY' AS kind, sum(l_linenumber)::BIGINT AS numbers FROM lineitem GROUP BY 1""")
def json_arrays(spark, sf_dir) -> DataFrame:
    """Arrays in JSON texts made of lines: their type, length, whether any element fits, and a sum over their elements."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.to_json(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("f")))).alias("j"))
    v = F.try_parse_json("j")
    items = F.try_variant_get(v, "$", "array<struct<n long, f string>>")
    return lines.select(
        "id", F.size(items).cast("long").alias("length"), F.exists(items, lambda x: x["f"] == "R").alias("returned"), F.upper(F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1)).alias("kind"),
        F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("numbers"),
    )
