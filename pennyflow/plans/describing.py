"""What bank descriptions and merchants say: structured fields, names, groups, statuses, categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import descriptions, text
from ..operators import categorise as c
from ..operators.matching import band_join
from .base import BANK, DESCRIBED, bank_rows, bought, described, query, table

DAY = r"ON\s+(\d{1,2})-(\d{1,2})-(\d{4})$"
CARD = r"CARD PAYMENT TO\s+([A-Za-z0-9\s\-*]+?)(?:\s+ON|\s*$|\*)"
# Each pattern's rows, first match wins; the third and fourth of the eight never win, as the second fits their texts.
EXTRACTED = rf"""{DESCRIBED}, k AS (SELECT id, description, CASE
  WHEN regexp_matches(description, '^(.+?)\s*\(VIA APPLE PAY\),\s*{DAY}') THEN 1 WHEN regexp_matches(description, '^CARD PAYMENT TO\s+(.+?)\s*{DAY}') THEN 2
  WHEN regexp_matches(description, '^DIRECT DEBIT PAYMENT TO\s+(.+?)\s+REF\s+([A-Z0-9\-_]+)\s*[/,]*\s*MANDATE NO\s+(\d+)$') THEN 5 WHEN regexp_matches(description, '^TRANSFER FROM\s+(.+)$') THEN 6
  WHEN regexp_matches(description, '^(\d+)\s+Direct Debit Payments at\s+([\d.]+)%\s+Cashback$') THEN 7 WHEN regexp_matches(description, '^INTEREST PAID AFTER TAX\s+([\d.]+)\s+DEDUCTED$') THEN 8
  WHEN regexp_matches(upper(description), 'AIRBNB') THEN 11 WHEN regexp_matches(upper(description), 'ZETTLE') THEN 13 WHEN regexp_matches(upper(description), 'PPOINT_\*') THEN 14
  WHEN regexp_matches(upper(description), 'LIME') THEN 15 WHEN regexp_matches(upper(description), 'SUMUP\s*\*') THEN 16 ELSE 20 END AS k FROM d),
x AS (SELECT id, description, k, CASE WHEN k > 10 THEN nullif(trim(regexp_extract(description, '{CARD}', 1)), '') END AS card,
  CASE k WHEN 1 THEN trim(regexp_extract(description, '^(.+?)\s*\(VIA APPLE PAY\),\s*{DAY}', 1)) WHEN 2 THEN trim(regexp_extract(description, '^CARD PAYMENT TO\s+(.+?)\s*{DAY}', 1))
    WHEN 5 THEN trim(regexp_extract(description, '^DIRECT DEBIT PAYMENT TO\s+(.+?)\s+REF', 1)) END AS strict FROM k),
v AS (SELECT id, description, nullif(coalesce(strict, card), '') AS payee, CASE WHEN k = 5 THEN regexp_extract(description, 'REF\s+([A-Z0-9\-_]+)', 1) END AS reference, CASE WHEN k = 5 THEN regexp_extract(description, 'MANDATE NO\s+(\d+)$', 1) END AS mandate_number,
  CASE k WHEN 1 THEN 'Apple Pay' WHEN 2 THEN 'Card Payment' WHEN 5 THEN 'Direct Debit' WHEN 6 THEN 'Transfer' WHEN 7 THEN 'Santander' WHEN 8 THEN 'Santander' WHEN 11 THEN 'Card Payment' WHEN 13 THEN 'Apple Pay' WHEN 14 THEN 'Apple Pay'
    WHEN 15 THEN 'Card Payment' WHEN 16 THEN 'Apple Pay' WHEN 20 THEN CASE WHEN card IS NOT NULL THEN 'Card Payment' END END AS provider,
  CASE k WHEN 7 THEN 'Cashback' WHEN 8 THEN 'Interest' WHEN 11 THEN 'AIRBNB' WHEN 13 THEN 'Zettle' WHEN 14 THEN 'PPOINT' WHEN 15 THEN 'LIME' WHEN 16 THEN 'SUMUP' END AS variant,
  CASE WHEN k = 6 THEN trim(regexp_extract(description, '^TRANSFER FROM\s+(.+)$', 1)) END AS sender, CASE WHEN k = 7 THEN regexp_extract(description, '^(\d+)', 1) END AS payment_count,
  CASE WHEN k = 7 THEN regexp_extract(description, 'at\s+([\d.]+)%', 1) END AS rate, CASE WHEN k = 8 THEN regexp_extract(description, 'TAX\s+([\d.]+)', 1) END AS tax,
  (CASE k WHEN 1 THEN 95 WHEN 2 THEN 90 WHEN 5 THEN 95 WHEN 6 THEN 90 WHEN 7 THEN 90 WHEN 8 THEN 85 WHEN 20 THEN CASE WHEN card IS NULL THEN 0 ELSE 70 END ELSE CASE WHEN card IS NULL THEN 60 ELSE 70 END END)::BIGINT AS confidence FROM x)"""


@query("f05_extracted", f"WITH {EXTRACTED} SELECT id, provider, variant, payee, reference, mandate_number, sender, payment_count, rate, tax, confidence FROM v")
def extracted(spark, sf_dir) -> DataFrame:
    """Structured fields of every description; the earlier of two patterns decides."""
    out = described(spark, sf_dir).select("id", descriptions.extracted(F.col("description")).alias("x"))
    return out.select("id", *[f"x.{n}" for n in ("provider", "variant", "payee", "reference", "mandate_number", "sender", "payment_count", "rate", "tax", "confidence")])


FALLBACK = r"(?i)^DIRECT DEBIT PAYMENT TO\s+(.+?)(?:\s+REF\s+(.*))?$"


@query("f06_debit_fallback", rf"""WITH {DESCRIBED}, f AS (SELECT id, trim(regexp_extract(description, '{FALLBACK}', 1)) AS payee, regexp_extract(description, '{FALLBACK}', 2) AS rest FROM d WHERE regexp_matches(description, '{FALLBACK}'))
SELECT id, payee, nullif(trim(regexp_extract(rest, '(?i)^([^,]+?)(?:\s*[,/]\s*MANDATE|\s*MANDATE|\s*$)', 1)), '') AS reference, nullif(regexp_extract(rest, '(?i)MANDATE NO\s+(\d+)', 1), '') AS mandate_number FROM f""")  # fmt: skip
def debit_fallback(spark, sf_dir) -> DataFrame:
    """Payee, reference and mandate of direct debits in any layout."""
    out = described(spark, sf_dir).select("id", descriptions.debit_fallback(F.col("description")).alias("x")).where("x IS NOT NULL")
    return out.select("id", "x.payee", "x.reference", "x.mandate_number")


NORMAL = r"""n0 AS (SELECT *, trim(merchant) AS m0 FROM d), n1 AS (SELECT *, regexp_replace(regexp_replace(m0, '(?i)^CREDIT FROM\s+', ''), '(?i)^REFUND FROM\s+', '') AS m1 FROM n0),
n2 AS (SELECT *, CASE WHEN regexp_matches(m1, '(?i)^ebay\s+O\*\d+') THEN 'eBay' ELSE m1 END AS m2 FROM n1),
n3 AS (SELECT *, trim(rtrim(regexp_replace(regexp_replace(regexp_replace(m2, '(?i)\*[A-Z0-9]+\d+$', ''), '(?i)\s+[A-Z0-9]{8,}$', ''), '\*+$', ''), '.')) AS m3 FROM n2),
n AS (SELECT *, CASE WHEN starts_with(lower(m3), 'amznmktplace') OR starts_with(lower(m3), 'amazon marketplace') THEN 'Amazon Marketplace' WHEN starts_with(lower(m3), 'www.amazon.*') THEN 'Amazon'
  WHEN starts_with(lower(m3), 'amazon.co.uk') THEN 'Amazon.co.uk' WHEN starts_with(lower(m3), 'amazon.com') THEN 'Amazon.com' WHEN starts_with(lower(m3), 'amazon.de') THEN 'Amazon.de' WHEN starts_with(lower(m3), 'amazon.fr') THEN 'Amazon.fr'
  WHEN starts_with(lower(m3), 'amazon prime') THEN 'Amazon Prime' WHEN starts_with(lower(m3), 'ebay') THEN 'eBay' WHEN starts_with(lower(m3), 'paypal') THEN 'PayPal' WHEN m3 = '' THEN merchant ELSE m3 END AS normal FROM n3)"""
GROUPED = """CASE WHEN contains(lower(normal), 'amazon') THEN CASE WHEN contains(lower(normal), 'marketplace') THEN 'Amazon Marketplace' WHEN contains(lower(normal), 'prime') THEN 'Amazon Prime' ELSE 'Amazon' END
  WHEN contains(lower(normal), 'ebay') THEN 'eBay' WHEN contains(lower(normal), 'paypal') THEN 'PayPal' ELSE normal END"""
#: Accounts that have a name of their own.
ACCOUNTS = (("090129 30458079", "Savings"), ("111111 22222222", "Rent"))


def named(rows: DataFrame) -> DataFrame:
    """``rows`` with ``normal``: an account's own name where merchant or description hold its number, else the normal merchant."""
    accounts = rows.sparkSession.createDataFrame(ACCOUNTS, "account string, name string")
    rows = rows.withColumn("account", F.coalesce(text.account_details(F.col("merchant")), text.account_details(F.col("description"))))
    rows = rows.join(F.broadcast(accounts), "account", "left")
    return rows.withColumn("normal", F.when(F.col("merchant").isNotNull() & F.col("name").isNotNull(), F.concat(F.lit("Payment to "), "name")).otherwise(text.normal_merchant(F.col("merchant"))))


NAMED = rf"""{DESCRIBED}, {NORMAL}, w AS (SELECT * REPLACE (CASE WHEN merchant IS NOT NULL AND regexp_matches(description, 'ACCOUNT\s+090129\s+30458079') THEN 'Payment to Savings' ELSE normal END AS normal) FROM n)"""


@query("f01_merchants", f"WITH {NAMED} SELECT id, normal, {GROUPED} AS grp, nullif(regexp_extract(description, 'ACCOUNT\\s+(\\d{{6}})\\s+\\d{{8}}', 1), '') AS sort_code FROM w")
def merchants(spark, sf_dir) -> DataFrame:
    """Merchants without codes and under their known names, their groups, and accounts by name."""
    w = named(described(spark, sf_dir))
    code = text.account_details(F.col("description"))
    return w.select("id", "normal", text.merchant_group(F.col("normal")).alias("grp"), F.split_part(code, F.lit(" "), F.lit(1)).alias("sort_code"))


@query("a39_normalisation_effect", f"WITH {NAMED} SELECT count(DISTINCT merchant) AS before, count(DISTINCT normal) AS after, count_if(merchant <> normal)::BIGINT AS changed, string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (WHERE k <= 10) AS samples FROM (SELECT *, CASE WHEN merchant <> normal THEN row_number() OVER (PARTITION BY merchant <> normal ORDER BY id) END AS k FROM w)")
def normalisation_effect(spark, sf_dir) -> DataFrame:
    """Merchants before and after normalising, rows that change, and the first ten of them (A39); the limit is the feature."""
    w = named(described(spark, sf_dir)).select("id", "merchant", "normal")
    first = w.where("merchant <> normal").orderBy("id").limit(10).agg(F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("samples"))
    sums = w.agg(F.countDistinct("merchant").alias("before"), F.countDistinct("normal").alias("after"), F.count_if(F.col("merchant") != F.col("normal")).alias("changed"))
    return sums.crossJoin(first)


@query("a40_unmapped_accounts", rf"""WITH {DESCRIBED}, a AS (SELECT nullif(regexp_extract(description, '(?i)ACCOUNT\s+(\d{{6}}\s+\d{{8}})', 1), '') AS account FROM d)
SELECT account, count(*) AS n FROM a WHERE account IS NOT NULL AND account NOT IN ('111111 22222222') GROUP BY 1""")  # fmt: skip
def unmapped_accounts(spark, sf_dir) -> DataFrame:
    """Accounts in descriptions that have no name yet, the commonest first."""
    known = spark.createDataFrame(ACCOUNTS[1:], "account string, name string")
    found = described(spark, sf_dir).select(text.account_details(F.col("description")).alias("account")).where("account IS NOT NULL")
    return found.join(F.broadcast(known), "account", "left_anti").groupBy("account").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "account")


@query("c14_reapplied_accounts", f"WITH {NAMED} SELECT id, merchant AS before, normal AS after FROM w WHERE merchant <> normal AND starts_with(normal, 'Payment to ')")
def reapplied_accounts(spark, sf_dir) -> DataFrame:
    """Rows whose merchant becomes an account's name (C14)."""
    w = named(described(spark, sf_dir))
    return w.where("merchant <> normal AND name IS NOT NULL").select("id", F.col("merchant").alias("before"), F.col("normal").alias("after"))


@query("f09_card_merchants", rf"""WITH {DESCRIBED}, m AS (SELECT id, merchant, nullif(trim(regexp_extract(description, '(?i)^CARD\s+PAYMENT\s+(?:TO\s+)?(.+)$', 1)), '') AS found, trim(split_part(description, ',', 1)) AS first, description FROM d)
SELECT id, found, coalesce(nullif(trim(merchant), ''), CASE WHEN first <> '' AND NOT regexp_matches(first, '^\d+$') THEN first END, nullif(description, ''), 'Unknown Merchant') AS identified FROM m""")  # fmt: skip
def card_merchants(spark, sf_dir) -> DataFrame:
    """Card payments' merchants, and each row's merchant as given or up to the first comma."""
    d = described(spark, sf_dir)
    return d.select("id", text.card_merchant(F.col("description")).alias("found"), text.identified_merchant(F.col("description"), F.col("merchant")).alias("identified"))


@query("f13_clean_texts", r"WITH " + DESCRIBED + r""", a AS (SELECT id, replace(replace(replace(replace(replace(replace(replace(replace(replace(lower(description), 'card payment to ', ''), 'payment to ', ''), 'transfer to ', ''), 'via apple pay', ''), 'via google pay', ''),
  'via paypal', ''), 'online payment', ''), 'direct debit', ''), 'standing order', '') AS t FROM d),
b AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b', '', 'g'), '\b\d{2,4}[-/]\d{1,2}[-/]\d{1,2}\b', '', 'g'), '\bref\s*\d+\b', '', 'g'), '\b[a-z]{2,3}\d{4,}\b', '', 'g') AS t FROM a)
SELECT id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS cleaned FROM b""")  # fmt: skip
def clean_texts(spark, sf_dir) -> DataFrame:
    """Descriptions without payment phrases, dates, references and codes."""
    return described(spark, sf_dir).select("id", text.clean_text(F.col("description")).alias("cleaned"))


STORE = "['APPLE.COM', 'APPLE COM', 'APP STORE', 'APPSTORE', 'ITUNES', 'APPLE SERVICES', 'APPLE BILL']"
STATUS = f"""CASE WHEN list_bool_or(list_transform({STORE}, lambda w: contains(u, w))) THEN 'Apple' WHEN contains(u, 'AMAZON') OR contains(u, 'AMZN') OR contains(u, 'AMZ') THEN CASE WHEN type = 'CREDIT' THEN 'AMZN RTN' ELSE 'AMZN' END ELSE 'None' END"""


@query("p08_source_status", f"WITH {DESCRIBED}, u AS (SELECT *, upper(description || ' ' || coalesce(merchant, '')) AS u FROM d) SELECT id, {STATUS} AS status, list_bool_or(list_transform({STORE}, lambda w: contains(u, w))) AS store FROM u")
def source_status(spark, sf_dir) -> DataFrame:
    """Which purchases a row belongs to, and whether it is the store's own; ``None`` is a text."""
    d = described(spark, sf_dir)
    return d.select("id", text.source_status(F.col("description"), F.col("merchant"), F.col("type")).alias("status"), text.is_store(F.col("description"), F.col("merchant")).alias("store"))


# Orders with a returned line stand for rows of the match table.
HITS = "h AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R')"


def hits(spark, sf_dir) -> DataFrame:
    """Transactions with a returned line, as those of the match table."""
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")).distinct()


@query("c06_status_backfill", f"""WITH {DESCRIBED}, {HITS}, u AS (SELECT *, upper(description || ' ' || coalesce(merchant, '')) AS u FROM d), s AS (SELECT CASE WHEN h.id IS NOT NULL THEN 'Matched' ELSE {STATUS} END AS status FROM u LEFT JOIN h ON u.id = h.id)
SELECT status, count(*) AS n FROM s GROUP BY 1""")  # fmt: skip
def status_backfill(spark, sf_dir) -> DataFrame:
    """The status of every row by its description, Matched where a match is known, counted."""
    d = described(spark, sf_dir).join(hits(spark, sf_dir).withColumn("hit", F.lit("Matched")), "id", "left")
    status = F.coalesce("hit", text.source_status(F.col("description"), F.col("merchant"), F.col("type")))
    return d.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("a18_identified", f"""WITH {DESCRIBED}, {HITS}, u AS (SELECT *, upper(description || ' ' || coalesce(merchant, '')) AS u FROM d), s AS (SELECT u.id, {STATUS} AS status, h.id IS NOT NULL AS matched FROM u LEFT JOIN h ON u.id = h.id)
SELECT count(DISTINCT CASE WHEN status = 'AMZN' OR (matched AND status <> 'Apple') THEN id END) AS market, count(DISTINCT CASE WHEN status = 'Apple' THEN id END) AS store, count(DISTINCT CASE WHEN status = 'AMZN RTN' THEN id END) AS returned FROM s""")  # fmt: skip
def identified(spark, sf_dir) -> DataFrame:
    """Rows that a vendor's pattern or match table names, by vendor; a matched row always counts."""
    d = described(spark, sf_dir).join(hits(spark, sf_dir).withColumn("hit", F.lit(True)), "id", "left")
    d = d.withColumn("status", text.source_status(F.col("description"), F.col("merchant"), F.col("type")))
    part = lambda c: F.countDistinct(F.when(c, F.col("id")))
    s = F.col("status")
    return d.agg(part((s == "AMZN") | (F.col("hit").isNotNull() & (s != "Apple"))).alias("market"), part(s == "Apple").alias("store"), part(s == "AMZN RTN").alias("returned"))


FAMILY = "(contains(upper(coalesce(txn_merchant, '')), '{0}') OR contains(upper(txn_description), '{0}'))"


@query("p06_family_rows", f"""WITH {BANK}, m AS (SELECT DISTINCT txn_id FROM b JOIN p ON txn_amount = purchase_amount AND abs(purchase_day - txn_day) <= 7)
SELECT txn_id, {FAMILY.format('AMAZON')} OR {FAMILY.format('AMZN')} AS market, {FAMILY.format('APPLE')} AS store FROM b
WHERE ({FAMILY.format('AMAZON')} OR {FAMILY.format('AMZN')} OR {FAMILY.format('APPLE')}) AND NOT contains(upper(txn_description), 'AMZN MKTP') AND txn_id NOT IN (SELECT txn_id FROM m)""")  # fmt: skip
def family_rows(spark, sf_dir) -> DataFrame:
    """Rows of two merchant families that aren't matched yet; the marketplace's descriptor is left out."""
    b = bank_rows(spark, sf_dir)
    fam = lambda *w: text.any_literal(F.upper(F.coalesce("txn_merchant", F.lit(""))), w) | text.any_literal(F.upper("txn_description"), w)
    b = b.withColumn("market", fam("AMAZON", "AMZN")).withColumn("store", fam("APPLE"))
    b = b.where((F.col("market") | F.col("store")) & ~text.any_literal(F.upper("txn_description"), ("AMZN MKTP",)))
    done = band_join(b, bought(spark, sf_dir), -7, 7).select("txn_id")
    return b.join(done, "txn_id", "left_anti").select("txn_id", "market", "store")


#: Payees' mappings: pattern, name, category.
MAPPINGS = (("gas board", "Gas", "Utilities"), ("Water Board", "Water", "Utilities"), ("nobody", "x", "y"))


@query("j16_debit_mappings", rf"""WITH {EXTRACTED}, q AS (SELECT id, upper(trim(coalesce(payee, nullif(trim(regexp_extract(description, '{FALLBACK}', 1)), '')))) AS payee FROM v WHERE starts_with(description, 'DIRECT DEBIT PAYMENT TO'))
SELECT id, name, category FROM q JOIN (VALUES ('GAS BOARD', 'Gas', 'Utilities'), ('WATER BOARD', 'Water', 'Utilities')) m(payee, name, category) USING (payee)""")  # fmt: skip
def debit_mappings(spark, sf_dir) -> DataFrame:
    """Direct debits with their payee's mapping."""
    return c.debit_mappings(described(spark, sf_dir), spark.createDataFrame(MAPPINGS, "pattern string, name string, category string"))


KEYWORD_SQL = "CASE WHEN amount > 0 AND list_bool_or(list_transform(['salary', 'transfer from', 'payment from', 'refund'], lambda w: contains(s, w))) THEN 'Income' " + " ".join(
    f"WHEN list_bool_or(list_transform([{', '.join(repr(w) for w in words)}], lambda w: contains(s, w))) THEN '{category}'" for category, words in c.KEYWORDS
) + " ELSE 'Other' END"
CATEGORISED = f"{DESCRIBED}, s AS (SELECT *, lower(description || ' ' || coalesce(merchant, '')) AS s FROM d), g AS (SELECT id, {KEYWORD_SQL} AS category FROM s)"
ESSENTIALS = ", ".join(f"'{x}'" for x in c.ESSENTIAL)


@query("f45_keyword_categories", f"WITH {CATEGORISED} SELECT category, CASE WHEN category IN ({ESSENTIALS}) THEN 'Essential' ELSE 'Discretionary' END AS necessity, count(*) AS n, min(id) AS first FROM g GROUP BY 1")
def keyword_categories(spark, sf_dir) -> DataFrame:
    """Rows by the category of their first keyword, and whether it is essential."""
    d = described(spark, sf_dir).select("id", c.keyword_category(F.col("description"), F.col("merchant"), F.col("amount")).alias("category"))
    return d.groupBy("category").agg(F.count("*").alias("n"), F.min("id").alias("first")).withColumn("necessity", c.necessity(F.col("category")))


@query("c09_enrichment_order", f"""WITH {CATEGORISED}, rule AS (SELECT id, name AS category FROM (SELECT id, 'Gas' AS name FROM d WHERE description = 'DIRECT DEBIT PAYMENT TO Gas Board')),
known AS (SELECT id, category FROM t WHERE category IS NOT NULL AND type = 'DEBIT'), cache AS (SELECT description, type, min(id) AS first FROM d WHERE description <> '' GROUP BY 1, 2 HAVING count(*) > 1)
SELECT d.id, CASE WHEN known.id IS NOT NULL THEN known.category WHEN rule.id IS NOT NULL THEN rule.category WHEN cache.description IS NOT NULL THEN cg.category END AS category,
  CASE WHEN known.id IS NOT NULL THEN 'known' WHEN rule.id IS NOT NULL THEN 'rule' WHEN cache.description IS NOT NULL THEN 'cache' ELSE 'none' END AS source
FROM d LEFT JOIN known ON d.id = known.id LEFT JOIN rule ON d.id = rule.id LEFT JOIN cache ON d.description = cache.description AND d.type = cache.type LEFT JOIN g cg ON cg.id = cache.first""")  # fmt: skip
def enrichment_order(spark, sf_dir) -> DataFrame:
    """Known rows, then mappings, then the cache by description and direction; what is left needs a model."""
    d = described(spark, sf_dir)
    known = d.where("category IS NOT NULL AND type = 'DEBIT'").select("id", "category")
    rule = d.where("description = 'DIRECT DEBIT PAYMENT TO Gas Board'").select("id", F.lit("Gas").alias("category"))
    own = c.keyword_category(F.col("description"), F.col("merchant"), F.col("amount"))
    cache = d.where("description <> ''").groupBy("description", "type").agg(F.count("*").alias("n"), F.min_by(own, "id").alias("category")).where("n > 1")
    cached = d.select("id", "description", "type").join(cache, ["description", "type"]).select("id", "category")
    return c.in_turn(d.select("id"), [("known", known), ("rule", rule), ("cache", cached)], "id", "category")
