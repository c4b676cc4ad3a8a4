"""Category totals, statistics, coverage and paging over transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_key
from ..functions.text import any_literal
from ..operators.enrichment import suggested
from ..operators.matching import band_join
from ..operators.receipts import order_summary
from ..operators.tables import page
from .base import BANK, EVENTS, TXNS, bank_rows, bought, events, query, table, txns

FROM, TO = "1996-01-01", "1998-12-31"


def dbl(c):
    return c.cast("double")


def percent(part, whole, digits: int = 1):
    """A share in percent, rounded half up in decimals; 0 of nothing."""
    exact = part.cast("decimal(18,4)") * 100 / F.when(whole != 0, whole)
    return F.coalesce(F.round(exact, digits), F.lit(0)).cast("double")


PERCENT = "coalesce(round(({0})::DECIMAL(18,4) * 100 / nullif({1}, 0), 1), 0)::DOUBLE"


@query("a01_category_spend", f"""WITH {TXNS}
SELECT coalesce(category, 'Uncategorized') AS category, sum(amount)::DOUBLE AS total, count(*) AS n FROM t
WHERE type = 'DEBIT' AND day BETWEEN DATE '{FROM}' AND DATE '{TO}' GROUP BY t.category""")  # fmt: skip
def category_spend(spark, sf_dir) -> DataFrame:
    """Debits by category. Grouped by the raw category, so that a category of that name beside null keeps its own row."""
    t = txns(spark, sf_dir).where((F.col("type") == "DEBIT") & F.col("day").between(FROM, TO))
    out = t.groupBy("category").agg(dbl(F.sum("amount")).alias("total"), F.count("*").alias("n"))
    return out.withColumn("category", F.coalesce("category", F.lit("Uncategorized"))).orderBy(F.desc("total"))


@query("a03_bank_totals", f"""WITH {TXNS}
SELECT count(*) AS n, coalesce(sum(CASE WHEN type = 'CREDIT' THEN amount END), 0)::DOUBLE AS credits,
  coalesce(sum(CASE WHEN type = 'DEBIT' THEN abs(amount) END), 0)::DOUBLE AS debits, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day FROM t""")  # fmt: skip
def bank_totals(spark, sf_dir) -> DataFrame:
    """Counts and sums; an empty table has zeros, and null days."""
    part = lambda kind: dbl(F.coalesce(F.sum(F.when(F.col("type") == kind, F.abs("amount"))), F.lit(0)))
    return txns(spark, sf_dir).agg(
        F.count("*").alias("n"), part("CREDIT").alias("credits"), part("DEBIT").alias("debits"),
        F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"),
    )


KINDS = ("view", "click", "signup")


@query("a04_source_statistics", f"""WITH {EVENTS}, m AS (SELECT DISTINCT user_id, day FROM e WHERE event_type = 'purchase'),
s AS (SELECT e.*, m.user_id IS NOT NULL AS matched FROM e LEFT JOIN m ON e.user_id = m.user_id AND e.day = m.day WHERE event_type IN ('view', 'click', 'signup')),
b AS (SELECT min(day) AS b0, max(day) AS b1 FROM e WHERE event_type = 'purchase'),
g AS (SELECT event_type AS source, count(*) AS n, count_if(matched) AS matched, min(day) AS d0, max(day) AS d1 FROM s GROUP BY 1)
SELECT source, n, matched::BIGINT AS matched, (n - matched)::BIGINT AS unmatched, d0::VARCHAR AS first_day, d1::VARCHAR AS last_day,
  CASE WHEN greatest(d0, b0) <= least(d1, b1) THEN greatest(d0, b0) END::VARCHAR AS overlap_from,
  CASE WHEN greatest(d0, b0) <= least(d1, b1) THEN least(d1, b1) END::VARCHAR AS overlap_to,
  (d1 < b1 - 7) AS stale FROM g, b""")  # fmt: skip
def source_statistics(spark, sf_dir) -> DataFrame:
    """Per source: rows, matched, unmatched, days, overlap with the bank's days (null if none), staleness (over 7 days behind, strictly)."""
    e = events(spark, sf_dir)
    bank = e.where("event_type = 'purchase'")
    days = bank.select("user_id", "day").distinct().withColumn("hit", F.lit(True))
    s = e.where(F.col("event_type").isin(*KINDS)).join(days, ["user_id", "day"], "left")
    out = s.groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("n"), F.count("hit").alias("matched"), F.min("day").alias("d0"), F.max("day").alias("d1"))
    out = out.crossJoin(F.broadcast(bank.agg(F.min("day").alias("b0"), F.max("day").alias("b1"))))
    start, end = F.greatest("d0", "b0"), F.least("d1", "b1")
    known = F.col("d0").isNotNull() & F.col("b0").isNotNull() & (start <= end)
    return out.select(
        "source", "n", "matched", (F.col("n") - F.col("matched")).alias("unmatched"), F.col("d0").cast("string").alias("first_day"), F.col("d1").cast("string").alias("last_day"),
        F.when(known, start).cast("string").alias("overlap_from"), F.when(known, end).cast("string").alias("overlap_to"), (F.col("d1") < F.date_sub("b1", 7)).alias("stale"),
    )


RANGE = ("2024-01-05", "2024-01-25")


@query("a07_coverage", f"""WITH {BANK}, t AS (SELECT * FROM b WHERE txn_day BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}'), f AS (SELECT * FROM t WHERE contains(upper(coalesce(txn_merchant, '')), 'AMAZON') OR contains(upper(coalesce(txn_merchant, '')), 'AMZN')
  OR contains(upper(txn_description), 'AMAZON') OR contains(upper(txn_description), 'AMZN')), m AS (SELECT DISTINCT txn_id FROM t JOIN p ON txn_amount = purchase_amount AND abs(purchase_day - txn_day) <= 7)
SELECT (SELECT count(*) FROM f) AS txns, (SELECT count(*) FROM p WHERE purchase_day BETWEEN DATE '{RANGE[0]}' - 3 AND DATE '{RANGE[1]}' + 3) AS orders, (SELECT count(*) FROM m) AS matched,
  (SELECT count(*) FROM p WHERE purchase_day BETWEEN DATE '{RANGE[0]}' - 3 AND DATE '{RANGE[1]}' + 3) > 0 AS covered, coalesce(round((SELECT count(*) FROM m)::DECIMAL(18,4) * 100 / nullif((SELECT count(*) FROM f), 0), 4), 0)::DOUBLE AS rate""")  # fmt: skip
def coverage(spark, sf_dir) -> DataFrame:
    """Market rows of some days, purchases within three days of them, matched rows, and their share of the market rows in percent, 0 of none."""
    start, end = (F.lit(d).cast("date") for d in RANGE)
    t = bank_rows(spark, sf_dir).where(F.col("txn_day").between(start, end))
    market = any_literal(F.upper(F.coalesce("txn_merchant", F.lit(""))), ("AMAZON", "AMZN")) | any_literal(F.upper("txn_description"), ("AMAZON", "AMZN"))
    orders = bought(spark, sf_dir).where(F.col("purchase_day").between(F.date_sub(start, 3), F.date_add(end, 3)))
    found = band_join(t, bought(spark, sf_dir), -7, 7).select("txn_id").distinct()
    sums = t.agg(F.count_if(market).alias("txns")).crossJoin(orders.agg(F.count("*").alias("orders"))).crossJoin(found.agg(F.count("*").alias("matched")))
    return sums.withColumn("covered", F.col("orders") > 0).withColumn("rate", percent(F.col("matched"), F.col("txns"), 4))


@query("a10_merchant_rollup", """SELECT user_id AS merchant, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
  count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE value > 100) AS large, count(DISTINCT event_type) AS kinds,
  count(DISTINCT ts::DATE) AS days, min(ts::DATE)::VARCHAR AS first_day, max(ts::DATE)::VARCHAR AS last_day,
  round(count(*) FILTER (WHERE event_type = 'error')::DECIMAL(18,4) * 100 / count(*), 1)::DOUBLE AS error_rate,
  round(sum(value::DECIMAL(18,2)) / count(*), 2)::DOUBLE AS mean_value FROM events GROUP BY 1""")  # fmt: skip
def merchant_rollup(spark, sf_dir) -> DataFrame:
    """Counts by condition, distinct kinds and days, a rate and a mean, for each merchant (A10)."""
    kind = lambda k: F.count_if(F.col("event_type") == k)
    return events(spark, sf_dir).groupBy(F.col("user_id").alias("merchant")).agg(
        F.count("*").alias("n"), kind("purchase").alias("purchases"), kind("error").alias("errors"), F.count_if(F.col("amount") > 100).alias("large"),
        F.countDistinct("event_type").alias("kinds"), F.countDistinct("day").alias("days"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"),
        percent(kind("error"), F.count("*")).alias("error_rate"), dbl(F.round(F.sum("amount") / F.count("*"), 2)).alias("mean_value"),
    )


@query("a12_error_summary", f"""WITH {EVENTS} SELECT coalesce(event_type, '*') AS kind, coalesce((user_id % 10)::VARCHAR, '*') AS stage, count(*) AS n FROM e
GROUP BY GROUPING SETS ((), (event_type), (user_id % 10))""")  # fmt: skip
def error_summary(spark, sf_dir) -> DataFrame:
    """Total, by kind and by stage, in one pass."""
    e = events(spark, sf_dir).withColumn("stage", (F.col("user_id") % 10).cast("string"))
    sets = e.groupingSets([[], ["event_type"], ["stage"]], "event_type", "stage").agg(F.count("*").alias("n"))
    return sets.select(F.coalesce("event_type", F.lit("*")).alias("kind"), F.coalesce("stage", F.lit("*")).alias("stage"), "n")


@query("a13_job_progress", f"""WITH {EVENTS} SELECT user_id AS job, count(DISTINCT CASE WHEN event_type = 'purchase' THEN day END) AS done_days, count(DISTINCT day) AS days,
  {PERCENT.format("count(DISTINCT CASE WHEN event_type = 'purchase' THEN day END)", 'count(DISTINCT day)')} AS percent,
  string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM e GROUP BY 1""")  # fmt: skip
def job_progress(spark, sf_dir) -> DataFrame:
    """Distinct days of a job, those with a purchase, their share, and its kinds in order."""
    done = F.countDistinct(F.when(F.col("event_type") == "purchase", F.col("day")))
    return events(spark, sf_dir).groupBy(F.col("user_id").alias("job")).agg(
        done.alias("done_days"), F.countDistinct("day").alias("days"), percent(done, F.countDistinct("day")).alias("percent"),
        F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"),
    )


SHORT = """CASE WHEN length(x) <= 35 THEN x ELSE trim(rtrim(CASE WHEN strpos(reverse(left(x, 35)), ' ') > 0 AND 35 - strpos(reverse(left(x, 35)), ' ') > 24.5 THEN left(x, 35 - strpos(reverse(left(x, 35)), ' ')) ELSE left(x, 35) END, '.,:-()[]')) END"""


@query("a16_order_rollup", f"""WITH l AS (SELECT l_orderkey, p_name || ' (' || lower(p_type) || ', ' || p_brand || '), size ' || p_size::VARCHAR AS x, l_extendedprice::DECIMAL(18,2) AS price,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem JOIN part ON l_partkey = p_partkey),
g AS (SELECT l_orderkey AS order_id, count(*) AS items, sum(price)::DOUBLE AS total, min(CASE WHEN k = 1 THEN x END) AS first_item, string_agg({SHORT}, ' | ' ORDER BY k) AS names, string_agg({SHORT}, ' | ' ORDER BY k) FILTER (WHERE k <= 3) AS three FROM l GROUP BY 1)
SELECT order_id, items, total, first_item, CASE WHEN items = 1 THEN first_item WHEN length(names) > 150 THEN three || ' & ' || (items - 3)::VARCHAR || ' more' ELSE names END AS summary FROM g""")  # fmt: skip
def order_rollup(spark, sf_dir) -> DataFrame:
    """Lines to orders: sum, first item, and the names in order, one in full, several abbreviated, the first three if all are over 150 characters."""
    name = F.concat("p_name", F.lit(" ("), F.lower("p_type"), F.lit(", "), "p_brand", F.lit("), size "), F.col("p_size").cast("string"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), name.alias("name"))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").join(part, "l_partkey")
    items = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "name"))), lambda x: x["name"])
    out = line.groupBy(F.col("l_orderkey").alias("order_id")).agg(F.count("*").alias("items"), dbl(F.sum(F.col("l_extendedprice").cast("decimal(18,2)"))).alias("total"), items.alias("names"))
    return out.select("order_id", "items", "total", F.col("names")[0].alias("first_item"), order_summary(F.col("names")).alias("summary"))


def mode_of(column: str, name: str) -> str:
    """A table of each payee's commonest value, the first by name of equals."""
    return f"{name} AS (SELECT account_id, {column} AS v FROM (SELECT account_id, {column}, row_number() OVER (PARTITION BY account_id ORDER BY count(*) DESC, {column} NULLS LAST) AS k FROM t WHERE type = 'DEBIT' GROUP BY 1, 2) WHERE k = 1)"


@query("a22_payee_modes", f"""WITH {TXNS}, {mode_of('category', 'm')}, {mode_of('subcategory', 's')}, g AS (SELECT account_id, count(*) AS n, min(day) AS d0, arg_max(id, (day, id)) AS sample FROM t WHERE type = 'DEBIT' GROUP BY 1)
SELECT g.account_id, g.n, d0::VARCHAR AS first_seen, sample, coalesce(m.v, 'none') AS mode, s.v AS submode FROM g JOIN m ON g.account_id = m.account_id JOIN s ON g.account_id = s.account_id""")  # fmt: skip
def payee_modes(spark, sf_dir) -> DataFrame:
    """Payees with their count, first day, newest row, and commonest category and subcategory; the first by name of equals."""
    t = txns(spark, sf_dir).where("type = 'DEBIT'")
    by = t.groupBy("account_id", "category", "subcategory").agg(F.count("*").alias("n"), F.min("day").alias("d0"), F.max(F.struct("day", "id")).alias("last"))
    g = by.groupBy("account_id").agg(F.sum("n").alias("n"), F.min("d0").cast("string").alias("first_seen"), F.max("last")["id"].alias("sample"))
    for column, name in (("category", "mode"), ("subcategory", "submode")):
        counts = by.groupBy("account_id", column).agg(F.sum("n").alias("n"))
        order = F.struct(-F.col("n"), F.col(column).isNull(), column)
        g = g.join(counts.groupBy("account_id").agg(F.min_by(F.struct(column), order)[column].alias(name)), "account_id")
    return g.withColumn("mode", F.coalesce("mode", F.lit("none")))


@query("a23_new_payees", f"""WITH {TXNS}, m AS (SELECT DISTINCT account_id FROM t WHERE day < DATE '1996-01-01')
SELECT account_id, min(day)::VARCHAR AS first_seen, count(*) AS n, string_agg(DISTINCT subcategory, ',' ORDER BY subcategory) AS mandates FROM t
WHERE type = 'DEBIT' AND account_id NOT IN (SELECT account_id FROM m) GROUP BY 1""")  # fmt: skip
def new_payees(spark, sf_dir) -> DataFrame:
    """Payees that weren't known before 1996."""
    t = txns(spark, sf_dir)
    known = t.where("day < DATE '1996-01-01'").select("account_id").distinct()
    new = t.where("type = 'DEBIT'").join(known, "account_id", "left_anti")
    return new.groupBy("account_id").agg(F.min("day").cast("string").alias("first_seen"), F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("subcategory")), ",").alias("mandates"))


@query("a24_levy", f"""WITH {TXNS} SELECT coalesce(sum(CASE WHEN category IN ('1-URGENT', '2-HIGH') THEN amount END), 0)::DOUBLE AS essential,
  coalesce(sum(CASE WHEN category IN ('3-MEDIUM', '5-LOW') THEN amount END), 0)::DOUBLE AS discretionary, count_if(category IS NULL)::BIGINT AS unclassified,
  round(0.19 * coalesce(sum(CASE WHEN category IN ('3-MEDIUM', '5-LOW') THEN amount END), 0), 2)::DOUBLE AS due FROM t WHERE type = 'DEBIT' AND amount > 0""")  # fmt: skip
def levy(spark, sf_dir) -> DataFrame:
    """Essential and discretionary debits, and 19 % of the latter, in decimals rounded half up; 0 where there are none."""
    t = txns(spark, sf_dir).where("type = 'DEBIT' AND amount > 0")
    part = lambda *names: F.coalesce(F.sum(F.when(F.col("category").isin(*names), F.col("amount"))), F.lit(0))
    rest = part("3-MEDIUM", "5-LOW")
    due = F.round(rest * F.lit("0.19").cast("decimal(3,2)"), 2)
    return t.agg(dbl(part("1-URGENT", "2-HIGH")).alias("essential"), dbl(rest).alias("discretionary"), F.count_if(F.col("category").isNull()).alias("unclassified"), dbl(due).alias("due"))


CLASSED = f"""{TXNS}, c AS (SELECT *, CASE WHEN amount < 50 THEN 0 WHEN amount < 100000 THEN 1 ELSE 2 END AS band, CASE WHEN status = 'F' AND id % 3 = 0 THEN CASE WHEN category IN ('1-URGENT', '2-HIGH') THEN 'essential' WHEN category IS NOT NULL THEN 'discretionary' END END AS class FROM t)"""


def mode_sql(key: str) -> str:
    """The commonest class of each key and its share; the discretionary one of equals."""
    return f"""(SELECT {key} AS key, class, n, round(n::DECIMAL(18,4) / every, 4) AS share FROM (SELECT {key}, class, count(*) AS n, sum(count(*)) OVER (PARTITION BY {key}) AS every,
  row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, class) AS k FROM c WHERE class IS NOT NULL AND type = 'DEBIT' GROUP BY 1, 2) WHERE k = 1)"""


@query("a25_class_suggestion", f"""WITH {CLASSED} SELECT c.id, coalesce(m.class, g.class, b.class) AS class, round(CASE WHEN m.class IS NOT NULL THEN m.share WHEN g.class IS NOT NULL THEN g.share * 0.7 ELSE b.share * 0.5 END, 2)::DOUBLE AS confidence,
  CASE WHEN m.class IS NOT NULL THEN 'merchant' WHEN g.class IS NOT NULL THEN 'category' WHEN b.class IS NOT NULL THEN 'amount' END AS reason
FROM c LEFT JOIN {mode_sql('account_id')} m ON m.key = c.account_id LEFT JOIN {mode_sql('category')} g ON g.key = c.category LEFT JOIN {mode_sql('band')} b ON b.key = c.band WHERE c.type = 'DEBIT' AND c.class IS NULL""")  # fmt: skip
def class_suggestion(spark, sf_dir) -> DataFrame:
    """A class for each unclassified debit: the merchant's commonest, else the category's (x 0.7), else the amount band's (x 0.5), of equals discretionary."""
    own = F.when(F.col("category").isin("1-URGENT", "2-HIGH"), "essential").when(F.col("category").isNotNull(), "discretionary")
    t = txns(spark, sf_dir).where("type = 'DEBIT'").withColumn("class", F.when((F.col("status") == "F") & (F.col("id") % 3 == 0), own))
    t = t.withColumn("band", F.when(F.col("amount") < 50, 0).when(F.col("amount") < 100000, 1).otherwise(2))
    return suggested(t.where("class IS NULL"), t.where("class IS NOT NULL"), [("merchant", "account_id", "1.0"), ("category", "category", "0.7"), ("amount", "band", "0.5")]).select("id", "class", "confidence", "reason")


@query("a26_class_patterns", f"""WITH {CLASSED} SELECT category, count_if(class = 'essential')::BIGINT AS essential, count_if(class = 'discretionary')::BIGINT AS discretionary, {PERCENT.format("count_if(class = 'essential')", 'count(*)')} AS essential_percent,
  {PERCENT.format("count_if(class = 'discretionary')", 'count(*)')} AS discretionary_percent, CASE WHEN count_if(class = 'essential') > count_if(class = 'discretionary') THEN 'essential' ELSE 'discretionary' END AS commonest FROM c WHERE class IS NOT NULL GROUP BY 1""")  # fmt: skip
def class_patterns(spark, sf_dir) -> DataFrame:
    """How often each category is essential, in percent; ties are discretionary."""
    own = F.when(F.col("category").isin("1-URGENT", "2-HIGH"), "essential").when(F.col("category").isNotNull(), "discretionary")
    t = txns(spark, sf_dir).where("status = 'F' AND id % 3 = 0").withColumn("class", own).where("class IS NOT NULL")
    part = lambda k: F.count_if(F.col("class") == k)
    return t.groupBy("category").agg(
        part("essential").alias("essential"), part("discretionary").alias("discretionary"), percent(part("essential"), F.count("*")).alias("essential_percent"),
        percent(part("discretionary"), F.count("*")).alias("discretionary_percent"), F.when(part("essential") > part("discretionary"), "essential").otherwise("discretionary").alias("commonest"),
    )


@query("a28_chart_categories", f"WITH {TXNS} SELECT coalesce(category, 'Uncategorized') AS category, sum(amount)::DOUBLE AS total FROM t WHERE type = 'DEBIT' GROUP BY 1 HAVING sum(amount) > 0")
def chart_categories(spark, sf_dir) -> DataFrame:
    """Positive sums of debits by category, largest first."""
    t = txns(spark, sf_dir).where("type = 'DEBIT'").groupBy(F.coalesce("category", F.lit("Uncategorized")).alias("category")).agg(F.sum("amount").alias("s"))
    return t.where("s > 0").orderBy(F.desc("s")).select("category", dbl(F.col("s")).alias("total"))


@query("a29_chart_subcategories", f"WITH {TXNS} SELECT coalesce(subcategory, 'Uncategorized') AS subcategory, sum(amount)::DOUBLE AS total FROM t WHERE type = 'DEBIT' AND category = '2-HIGH' GROUP BY 1 HAVING sum(amount) > 0")
def chart_subcategories(spark, sf_dir) -> DataFrame:
    """The same of one category by subcategory."""
    t = txns(spark, sf_dir).where("type = 'DEBIT' AND category = '2-HIGH'").groupBy(F.coalesce("subcategory", F.lit("Uncategorized")).alias("subcategory")).agg(F.sum("amount").alias("s"))
    return t.where("s > 0").orderBy(F.desc("s")).select("subcategory", dbl(F.col("s")).alias("total"))


@query("a27_category_stats", f"""WITH {TXNS} SELECT coalesce(category, 'Uncategorized') AS category, count(*) AS n,
  sum(CASE WHEN type = 'DEBIT' THEN -amount ELSE amount END)::DOUBLE AS total, coalesce(sum(CASE WHEN type = 'DEBIT' THEN amount END), 0)::DOUBLE AS expenses,
  coalesce(sum(CASE WHEN type = 'CREDIT' THEN amount END), 0)::DOUBLE AS income FROM t GROUP BY 1""")  # fmt: skip
def category_stats(spark, sf_dir) -> DataFrame:
    """Count, signed total, expenses and income of each category."""
    debit = F.col("type") == "DEBIT"
    part = lambda c: dbl(F.coalesce(F.sum(F.when(c, F.col("amount"))), F.lit(0)))
    return txns(spark, sf_dir).groupBy(F.coalesce("category", F.lit("Uncategorized")).alias("category")).agg(
        F.count("*").alias("n"), dbl(F.sum(F.when(debit, -F.col("amount")).otherwise(F.col("amount")))).alias("total"), part(debit).alias("expenses"), part(~debit).alias("income")
    )


@query("a30_monthly_average", f"""WITH {TXNS}, f AS (SELECT *, strftime(day, '%Y-%m') AS month FROM t WHERE type = 'DEBIT' AND day BETWEEN DATE '{FROM}' AND DATE '{TO}'),
m AS (SELECT greatest(1, count(DISTINCT month)) AS months FROM f)
SELECT coalesce(category, 'Uncategorized') AS category, round(sum(amount) / min(months), 2)::DOUBLE AS average FROM f, m GROUP BY 1""")  # fmt: skip
def monthly_average(spark, sf_dir) -> DataFrame:
    """Category totals over the months present in the filter: one divisor for all categories."""
    f = txns(spark, sf_dir).where((F.col("type") == "DEBIT") & F.col("day").between(FROM, TO))
    by = f.groupBy("category", month_key(F.col("day")).alias("month")).agg(F.sum("amount").alias("s"))
    months = by.agg(F.greatest(F.lit(1), F.countDistinct("month")).alias("months"))
    out = by.groupBy(F.coalesce("category", F.lit("Uncategorized")).alias("category")).agg(F.sum("s").alias("s")).crossJoin(F.broadcast(months))
    return out.select("category", dbl(F.round(F.col("s") / F.col("months"), 2)).alias("average"))


@query("a32_daily_series", f"WITH {TXNS} SELECT day::VARCHAR AS day, sum(amount)::DOUBLE AS total, count(*) AS n FROM t WHERE type = 'DEBIT' GROUP BY t.day")
def daily_series(spark, sf_dir) -> DataFrame:
    """Debits by day, ascending."""
    out = txns(spark, sf_dir).where("type = 'DEBIT'").groupBy("day").agg(dbl(F.sum("amount")).alias("total"), F.count("*").alias("n"))
    return out.orderBy("day").withColumn("day", F.col("day").cast("string"))


@query("a34_category_counts", f"""WITH {TXNS}, c AS (SELECT DISTINCT category FROM t WHERE category IS NOT NULL UNION SELECT 'Travel'),
n AS (SELECT category, count(*) AS n FROM t GROUP BY 1), s AS (SELECT category, count(DISTINCT subcategory) AS subs FROM t GROUP BY 1)
SELECT c.category, coalesce(n, 0)::BIGINT AS n, coalesce(subs, 0)::BIGINT AS subs FROM c LEFT JOIN n USING (category) LEFT JOIN s USING (category)""")  # fmt: skip
def category_counts(spark, sf_dir) -> DataFrame:
    """All categories, unused ones too, with transactions and subcategories; counted in one pass before the join."""
    t = txns(spark, sf_dir)
    names = t.where("category IS NOT NULL").select("category").union(spark.range(1).select(F.lit("Travel"))).distinct()
    counted = t.groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("subcategory").alias("subs"))
    return names.join(counted, "category", "left").fillna(0, ["n", "subs"])


@query("a35_duplicate_groups", f"""WITH {EVENTS} SELECT user_id, amount::DOUBLE AS amount, day::VARCHAR AS day, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS ids
FROM e GROUP BY e.user_id, e.amount, e.day HAVING count(*) > 1""")  # fmt: skip
def duplicate_groups(spark, sf_dir) -> DataFrame:
    """Same merchant, amount and day more than once, ids in the order of time."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"].cast("string"))
    out = events(spark, sf_dir).groupBy("user_id", "amount", "day").agg(F.count("*").alias("n"), F.array_join(ids, ",").alias("ids")).where("n > 1")
    return out.withColumns({"amount": dbl(F.col("amount")), "day": F.col("day").cast("string")})


@query("a36_line_item_totals", """WITH l AS (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,2)) AS s FROM lineitem GROUP BY 1)
SELECT count(*) AS n, count_if(abs(s - o_totalprice::DECIMAL(18,2)) <= 0.01 * o_totalprice::DECIMAL(18,2))::BIGINT AS within,
  count_if(s > o_totalprice::DECIMAL(18,2))::BIGINT AS above FROM orders JOIN l ON o_orderkey = l_orderkey""")  # fmt: skip
def line_item_totals(spark, sf_dir) -> DataFrame:
    """Orders whose lines add up to their total within 1 %."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("s"))
    t = txns(spark, sf_dir).select("id", "amount").join(lines, "id")
    near = F.abs(F.col("s") - F.col("amount")) <= F.col("amount") * F.lit("0.01").cast("decimal(3,2)")
    return t.agg(F.count("*").alias("n"), F.count_if(near).alias("within"), F.count_if(F.col("s") > F.col("amount")).alias("above"))


@query("a37_nested_counters", f"""WITH {EVENTS}, g AS (SELECT user_id, event_type, count(*) AS n FROM e GROUP BY 1, 2)
SELECT user_id, string_agg(event_type || '=' || n::VARCHAR, ',' ORDER BY event_type) AS counters FROM g GROUP BY 1""")  # fmt: skip
def nested_counters(spark, sf_dir) -> DataFrame:
    """A map of counters for each merchant, shown in the order of its keys."""
    g = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = g.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("m"))
    text = F.transform(F.map_entries("m"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))
    return m.select("user_id", F.array_join(text, ",").alias("counters"))


@query("a43_import_plan", f"""WITH {TXNS}, a AS (SELECT account_id % 10 AS connection, count(DISTINCT account_id) AS accounts, (max(day) - min(day))::BIGINT AS days FROM t GROUP BY 1)
SELECT connection, accounts, days, accounts * days * 10 AS txns, (accounts * 10 + accounts * days * 10 * 0.1)::DOUBLE AS seconds, (ceil(accounts * days * 10 / 100.0) * 0.001)::DOUBLE AS cost FROM a""")  # fmt: skip
def import_plan(spark, sf_dir) -> DataFrame:
    """Ten rows a day and account, 10 s an account and 0.1 s a row, a call for 100 rows at a tenth of a cent."""
    a = txns(spark, sf_dir).groupBy((F.col("account_id") % 10).alias("connection")).agg(F.countDistinct("account_id").alias("accounts"), F.datediff(F.max("day"), F.min("day")).cast("long").alias("days"))
    rows = F.col("accounts") * F.col("days") * 10
    return a.select("connection", "accounts", "days", rows.alias("txns"), dbl(F.col("accounts") * 10 + rows * 0.1).alias("seconds"), dbl(F.ceil(rows / 100.0) * 0.001).alias("cost"))


@query("p01_filters", f"""WITH {TXNS} SELECT id, day::VARCHAR AS day, amount::DOUBLE AS amount, category FROM t WHERE category = '2-HIGH' AND day BETWEEN DATE '{FROM}' AND DATE '{TO}'
  AND (contains(lower(status), '12') OR contains(amount::VARCHAR, '12')) AND type = 'DEBIT'""")  # fmt: skip
def filters(spark, sf_dir) -> DataFrame:
    """Optional filters that all have to hold: category, days, keyword in text or amount, direction."""
    keep = filter_of(category="2-HIGH", start=FROM, end=TO, keyword="12", text_cols=("status",), debits=True, credits=False)
    return txns(spark, sf_dir).where(keep).select("id", F.col("day").cast("string").alias("day"), dbl(F.col("amount")).alias("amount"), "category")


def filter_of(category=None, start=None, end=None, keyword=None, text_cols=(), debits=True, credits=True):
    """A condition from optional filters; what is None doesn't filter, and both directions on is as both off."""
    keep = F.lit(True)
    if category not in (None, "All"):
        keep &= F.col("category") == category
    if start is not None:
        keep &= F.col("day") >= F.lit(start).cast("date")
    if end is not None:
        keep &= F.col("day") <= F.lit(end).cast("date")
    if keyword:
        low = keyword.lower()
        fields = [F.contains(F.lower(F.col(c)), F.lit(low)) for c in text_cols] + [F.contains(F.abs("amount").cast("string"), F.lit(low))]
        hit = F.lit(False)
        for f in fields:
            hit |= F.coalesce(f, F.lit(False))
        keep &= hit
    if debits != credits:
        keep &= F.col("type") == ("DEBIT" if debits else "CREDIT")
    return keep


@query("p20_tenant_filter", """SELECT n_nationkey AS connection, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1""")  # fmt: skip
def tenant_filter(spark, sf_dir) -> DataFrame:
    """Rows of one tenant through account and connection (P20, J01, J07); Spark broadcasts the dimensions by their size."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    accounts = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("account_id"), F.col("n_nationkey").alias("connection"))
    t = txns(spark, sf_dir).select("account_id", "amount").join(accounts, "account_id")
    return t.groupBy("connection").agg(F.count("*").alias("n"), dbl(F.sum("amount")).alias("total"))


@query("o01_page", f"""WITH {TXNS}, n AS (SELECT count(*) AS total FROM t)
SELECT id, day::VARCHAR AS day, category, total, ceil(total / 25.0)::BIGINT AS pages FROM t, n ORDER BY t.day DESC, category ASC NULLS LAST, id LIMIT 25 OFFSET 50""")  # fmt: skip
def transaction_page(spark, sf_dir) -> DataFrame:
    """The third page of 25, newest first, with total and pages (O01, O02, O04, O05); the limit is the feature."""
    t = txns(spark, sf_dir).select("id", "day", "category")
    out = page(t, [F.desc("day"), F.col("category").asc_nulls_last(), "id"], number=3, size=25)
    return out.withColumn("day", F.col("day").cast("string"))


@query("w10_latest", f"""WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM e)
SELECT user_id, event_id, event_type, amount::DOUBLE AS amount FROM r WHERE k = 1""")  # fmt: skip
def latest(spark, sf_dir) -> DataFrame:
    """The latest row of each entity, by one aggregation instead of a sort."""
    last = F.max_by(F.struct("event_id", "event_type", "amount"), F.struct("ts", "event_id")).alias("x")
    out = events(spark, sf_dir).groupBy("user_id").agg(last)
    return out.select("user_id", "x.event_id", "x.event_type", dbl(F.col("x.amount")).alias("amount"))


@query("w09_first_samples", f"""WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY amount DESC, event_id) AS k FROM e)
SELECT event_type, string_agg(event_id::VARCHAR, ',' ORDER BY k) AS samples FROM r WHERE k <= 3 GROUP BY 1""")  # fmt: skip
def first_samples(spark, sf_dir) -> DataFrame:
    """Three samples of each key, in order (W09); the limit is the feature."""
    order = Window.partitionBy("event_type").orderBy(F.desc("amount"), "event_id")
    r = events(spark, sf_dir).select("event_type", "event_id", F.row_number().over(order).alias("k")).where("k <= 3")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("k", "event_id"))), lambda x: x["event_id"].cast("string"))
    return r.groupBy("event_type").agg(F.array_join(ids, ",").alias("samples"))


@query("a31_subcategory_average", f"""WITH {TXNS}, f AS (SELECT *, strftime(day, '%Y-%m') AS month FROM t WHERE type = 'DEBIT' AND category = '2-HIGH' AND day BETWEEN DATE '{FROM}' AND DATE '{TO}')
SELECT coalesce(subcategory, 'Uncategorized') AS subcategory, round(sum(amount) / (SELECT greatest(1, count(DISTINCT month)) FROM f), 2)::DOUBLE AS average FROM f GROUP BY 1""")  # fmt: skip
def subcategory_average(spark, sf_dir) -> DataFrame:
    """Subcategories of one category over the months in which that category has any."""
    f = txns(spark, sf_dir).where((F.col("type") == "DEBIT") & (F.col("category") == "2-HIGH") & F.col("day").between(FROM, TO))
    by = f.groupBy(F.coalesce("subcategory", F.lit("Uncategorized")).alias("subcategory"), month_key(F.col("day")).alias("month")).agg(F.sum("amount").alias("s"))
    months = by.agg(F.greatest(F.lit(1), F.countDistinct("month")).alias("months"))
    out = by.groupBy("subcategory").agg(F.sum("s").alias("s")).crossJoin(F.broadcast(months))
    return out.select("subcategory", dbl(F.round(F.col("s") / F.col("months"), 2)).alias("average"))


@query("a33_daily_groups", f"""WITH {TXNS} SELECT day::VARCHAR AS day, count(*) AS n, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, arg_max(id, (amount, id)) AS largest FROM t GROUP BY t.day""")
def daily_groups(spark, sf_dir) -> DataFrame:
    """Rows by day, newest first: how many, their distinct categories in order, the largest."""
    out = txns(spark, sf_dir).groupBy("day").agg(
        F.count("*").alias("n"), F.nullif(F.array_join(F.sort_array(F.collect_set("category")), ","), F.lit("")).alias("categories"), F.max_by("id", F.struct("amount", "id")).alias("largest")
    )
    return out.orderBy(F.desc("day")).withColumn("day", F.col("day").cast("string"))


@query("a15_job_rows", f"WITH {EVENTS} SELECT user_id AS job, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM (SELECT DISTINCT user_id, event_id FROM e) GROUP BY 1")
def job_rows(spark, sf_dir) -> DataFrame:
    """The distinct ids of each job's rows, in order."""
    ids = F.transform(F.sort_array(F.collect_set("event_id")), lambda x: x.cast("string"))
    return events(spark, sf_dir).groupBy(F.col("user_id").alias("job")).agg(F.array_join(ids, ",").alias("ids"))


@query("a45_enrichment_cost", f"""WITH {TXNS}, c AS (SELECT DISTINCT account_id, type FROM t WHERE category IS NOT NULL AND day < DATE '1996-01-01')
SELECT count(*) AS n, count_if(c.account_id IS NOT NULL)::BIGINT AS cached, (count_if(c.account_id IS NULL) * 150)::BIGINT AS tokens_in, (count_if(c.account_id IS NULL) * 50)::BIGINT AS tokens_out,
  round((count_if(c.account_id IS NULL) * 150 * 3.0 + count_if(c.account_id IS NULL) * 50 * 15.0) / 1000000, 4)::DOUBLE AS cost FROM t LEFT JOIN c ON t.account_id = c.account_id AND t.type = c.type""")  # fmt: skip
def enrichment_cost(spark, sf_dir) -> DataFrame:
    """Tokens and cost of the rows that the cache by merchant and direction lacks: 150 in and 50 out for a row."""
    t = txns(spark, sf_dir)
    cache = t.where("category IS NOT NULL AND day < DATE '1996-01-01'").select("account_id", "type").distinct().withColumn("hit", F.lit(True))
    n = F.count_if(F.col("hit").isNull())
    cost = F.round((n * 150 * F.lit("3.0").cast("decimal(4,1)") + n * 50 * F.lit("15.0").cast("decimal(4,1)")) / 1_000_000, 4)
    return t.join(cache, ["account_id", "type"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("cached"), (n * 150).alias("tokens_in"), (n * 50).alias("tokens_out"), dbl(cost).alias("cost"))


@query("p03_search", f"""WITH {TXNS}, w AS (SELECT * FROM t WHERE day BETWEEN (SELECT max(day) FROM t) - 365 AND (SELECT max(day) FROM t) AND contains(lower(subcategory), 's1') AND amount BETWEEN 50000 AND 300000 AND lower(category) = lower('2-high') AND category IS NOT NULL)
SELECT id, day::VARCHAR AS day, amount::DOUBLE AS amount, (SELECT count(*) FROM w) AS total FROM w ORDER BY w.day DESC, id LIMIT 50""")  # fmt: skip
def search(spark, sf_dir) -> DataFrame:
    """A search by text, amounts and category in the last year of the table, the newest fifty, and how many there are (P03); the limit is the feature."""
    t = txns(spark, sf_dir)
    found = searched(t, "day", text={"subcategory": "S1"}, least=50_000, most=300_000, category="2-high", enriched_only=True, days=365)
    top = found.orderBy(F.desc("day"), "id").limit(bounded(50))
    return top.select("id", F.col("day").cast("string").alias("day"), dbl(F.col("amount")).alias("amount")).crossJoin(found.agg(F.count("*").alias("total")))


def bounded(limit: int) -> int:
    """A limit from 1 to 500."""
    return max(1, min(limit, 500))


def searched(rows: DataFrame, day_col: str, text=None, least=None, most=None, category=None, enriched_only=False, days=30) -> DataFrame:
    """Rows of the last ``days`` up to the newest, with texts that hold the given ones whatever the case, absolute amounts in a range, a category whatever its case, and a category at all."""
    newest = rows.agg(F.max(day_col).alias("__newest"))
    out = rows.crossJoin(F.broadcast(newest)).where(F.col(day_col) >= F.date_sub("__newest", days)).drop("__newest")
    for column, value in (text or {}).items():
        out = out.where(F.contains(F.lower(column), F.lit(value.lower())))
    if least is not None:
        out = out.where(F.abs("amount") >= least)
    if most is not None:
        out = out.where(F.abs("amount") <= most)
    if category is not None:
        out = out.where(F.lower("category") == category.lower())
    return out.where("category IS NOT NULL AND category <> ''") if enriched_only else out


@query("p04_enriched_search", f"""WITH {TXNS}, m AS (SELECT doc_id AS id, 0.5 + quality * 0.3 + (1 - toxic) * 0.2 AS confidence FROM labels), w AS (SELECT t.*, coalesce(m.confidence, 1.0)::DOUBLE AS confidence, CASE WHEN m.id IS NULL THEN 'rule' ELSE 'model' END AS provider FROM t LEFT JOIN m ON m.id = t.id WHERE category IS NOT NULL)
SELECT id, provider, round(confidence, 2) AS confidence FROM w WHERE contains(provider, 'model') AND lower(category) = '2-high' AND confidence >= 0.7 ORDER BY day DESC, id LIMIT 100""")  # fmt: skip
def enriched_search(spark, sf_dir) -> DataFrame:
    """Enriched rows by provider, category and least confidence, the newest hundred (P04); the limit is the feature."""
    m = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (0.5 + F.col("quality") * 0.3 + (1 - F.col("toxic")) * 0.2).alias("confidence"), F.lit("model").alias("provider"))
    w = txns(spark, sf_dir).where("category IS NOT NULL").join(m, "id", "left").fillna({"confidence": 1.0, "provider": "rule"})
    w = w.where(F.contains("provider", F.lit("model")) & (F.lower("category") == "2-high") & (F.col("confidence") >= 0.7))
    return w.orderBy(F.desc("day"), "id").limit(100).select("id", "provider", F.round("confidence", 2).alias("confidence"))


@query("j29_matching_rows", f"""WITH {TXNS} SELECT t.id, t.day::VARCHAR AS day FROM t JOIN customer ON account_id = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = (SELECT min(r_name) FROM region) AND type = 'DEBIT' AND day BETWEEN DATE '{FROM}' AND DATE '{TO}'""")  # fmt: skip
def matching_rows(spark, sf_dir) -> DataFrame:
    """A tenant's debits of some days, newest first, as candidates of matching: all of them, without the cap of the newest thousand."""
    r = table(spark, sf_dir, "region")
    nations = table(spark, sf_dir, "nation").join(r.join(r.agg(F.min("r_name").alias("r_name")), "r_name", "left_semi"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    accounts = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select(F.col("c_custkey").alias("account_id"))
    t = txns(spark, sf_dir).where((F.col("type") == "DEBIT") & F.col("day").between(FROM, TO)).join(accounts, "account_id", "left_semi")
    return t.orderBy(F.desc("day"), "id").select("id", F.col("day").cast("string").alias("day"))


@query("j17_custom_flags", f"""WITH {TXNS}, k AS (SELECT DISTINCT category FROM t WHERE day >= DATE '1998-07-01' AND category IS NOT NULL), m AS (SELECT DISTINCT subcategory FROM t WHERE amount > 400000)
SELECT coalesce(t.category, 'Uncategorized') AS category, t.subcategory, sum(amount)::DOUBLE AS total, k.category IS NOT NULL AS custom, m.subcategory IS NOT NULL AS mapped FROM t LEFT JOIN k ON t.category = k.category LEFT JOIN m ON t.subcategory = m.subcategory GROUP BY t.category, t.subcategory, k.category, m.subcategory""")  # fmt: skip
def custom_flags(spark, sf_dir) -> DataFrame:
    """Totals with flags: whether the category is among the user's own and the subcategory among the mapped ones."""
    t = txns(spark, sf_dir)
    own = t.where("day >= DATE '1998-07-01' AND category IS NOT NULL").select("category").distinct().withColumn("custom", F.lit(True))
    mapped = t.where("amount > 400000").select("subcategory").distinct().withColumn("mapped", F.lit(True))
    g = t.groupBy("category", "subcategory").agg(dbl(F.sum("amount")).alias("total")).join(own, "category", "left").join(mapped, "subcategory", "left")
    return g.select(F.coalesce("category", F.lit("Uncategorized")).alias("category"), "subcategory", "total", F.coalesce("custom", F.lit(False)).alias("custom"), F.coalesce("mapped", F.lit(False)).alias("mapped"))


@query("u03_set_changes", f"""WITH {TXNS}, o AS (SELECT DISTINCT account_id FROM t WHERE day < DATE '1997-01-01'), n AS (SELECT DISTINCT account_id FROM t WHERE day >= DATE '1997-01-01')
SELECT coalesce(o.account_id, n.account_id) AS account_id, CASE WHEN o.account_id IS NULL THEN 'added' WHEN n.account_id IS NULL THEN 'removed' ELSE 'kept' END AS change FROM o FULL JOIN n ON o.account_id = n.account_id""")  # fmt: skip
def set_changes(spark, sf_dir) -> DataFrame:
    """Union, difference and intersection of two sets of accounts, in one grouping."""
    t = txns(spark, sf_dir).groupBy("account_id").agg(F.bool_or(F.col("day") < "1997-01-01").alias("old"), F.bool_or(F.col("day") >= "1997-01-01").alias("new"))
    return t.select("account_id", F.when(~F.col("old"), "added").when(~F.col("new"), "removed").otherwise("kept").alias("change"))


@query("u04_two_sources", f"""WITH {TXNS}, {EVENTS} SELECT source, count(*) AS n, count(category) AS categories FROM (SELECT 'legacy' AS source, id, category FROM t UNION ALL SELECT 'new', event_id, NULL FROM e) GROUP BY 1""")
def two_sources(spark, sf_dir) -> DataFrame:
    """Old and new rows as one table; columns that one side lacks are null there."""
    legacy = txns(spark, sf_dir).select("id", "category", F.lit("legacy").alias("source"))
    new = events(spark, sf_dir).select(F.col("event_id").alias("id"), F.lit("new").alias("source"))
    return legacy.unionByName(new, allowMissingColumns=True).groupBy("source").agg(F.count("*").alias("n"), F.count("category").alias("categories"))


@query("t10_latest_snapshots", f"""WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM e) SELECT user_id, event_id, k::BIGINT AS place FROM r WHERE k <= 5""")
def latest_snapshots(spark, sf_dir) -> DataFrame:
    """The newest five rows of each entity (T10); the limit is the feature."""
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events(spark, sf_dir).select("user_id", "event_id", F.row_number().over(order).cast("long").alias("place")).where("place <= 5")


@query("t08_progress", f"""WITH {EVENTS}, g AS (SELECT user_id AS job, count(*) AS total, count_if(event_type <> 'error')::BIGINT AS done, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS seconds FROM e GROUP BY 1)
SELECT job, round(done::DECIMAL(18,4) * 3600 / nullif(seconds, 0), 4)::DOUBLE AS per_hour, CASE WHEN done > 0 THEN ((total - done) * seconds) // done END::BIGINT::VARCHAR AS seconds_left FROM g""")  # fmt: skip
def progress(spark, sf_dir) -> DataFrame:
    """A job's rate, and the seconds that the rest takes at it; null while nothing is done."""
    span = ((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1_000_000).cast("long")
    g = events(spark, sf_dir).groupBy(F.col("user_id").alias("job")).agg(F.count("*").alias("total"), F.count_if(F.col("event_type") != "error").alias("done"), span.alias("seconds"))
    left = F.when(F.col("done") > 0, F.floor((F.col("total") - F.col("done")) * F.col("seconds") / F.col("done")))
    return g.select("job", dbl(F.round(F.col("done").cast("decimal(18,4)") * 3600 / F.nullif("seconds", F.lit(0)), 4)).alias("per_hour"), left.cast("long").cast("string").alias("seconds_left"))


@query("a37_sync_statistics", f"""WITH {EVENTS}, g AS (SELECT user_id, event_type, count(*) AS attempted, count_if(amount > 100)::BIGINT AS succeeded, (((sum(amount) * 100)::BIGINT * 2 + count(*)) // (2 * count(*)))::VARCHAR AS mean FROM e GROUP BY 1, 2)
SELECT user_id, sum(attempted)::BIGINT AS attempted, sum(succeeded)::BIGINT AS succeeded, string_agg(event_type || ': ' || succeeded::VARCHAR || '/' || attempted::VARCHAR || ' ' || mean, ', ' ORDER BY event_type) AS by_kind FROM g GROUP BY 1""")  # fmt: skip
def sync_statistics(spark, sf_dir) -> DataFrame:
    """Attempts, successes and a mean in cents by kind within each merchant, as a map in one row, and their totals."""
    g = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("attempted"), F.count_if(F.col("amount") > 100).alias("succeeded"), (F.sum("amount") * 100).cast("long").alias("cents"))
    g = g.withColumn("mean", F.expr("(cents * 2 + attempted) DIV (2 * attempted)"))
    entry = F.struct("event_type", F.struct("attempted", "succeeded", "mean").alias("v"))
    m = g.groupBy("user_id").agg(F.sum("attempted").alias("attempted"), F.sum("succeeded").alias("succeeded"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("m"))
    shown = F.transform(F.map_entries("m"), lambda x: F.concat(x["key"], F.lit(": "), x["value"]["succeeded"].cast("string"), F.lit("/"), x["value"]["attempted"].cast("string"), F.lit(" "), x["value"]["mean"].cast("string")))
    return m.select("user_id", "attempted", "succeeded", F.array_join(shown, ", ").alias("by_kind"))
