"""Rule, model and external enrichment put together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import enrichment as n
from .base import TXNS, query, table, txns

SOURCES = f"""WITH {TXNS}, rule AS (SELECT id, 'rule-' || category AS subcategory FROM t WHERE id % 5 = 0), model AS (SELECT id, 'model-' || subcategory AS subcategory FROM t WHERE id % 3 = 0),
ext AS (SELECT l_orderkey AS id, 'external-' || l_linenumber::VARCHAR AS subcategory, l_linenumber, l_partkey, l_extendedprice AS price,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem)"""


def sources(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A rule's, a model's and external rows; the last have several for a transaction."""
    t = txns(spark, sf_dir)
    rule = t.where("id % 5 = 0").select("id", F.concat(F.lit("rule-"), "category").alias("subcategory"))
    model = t.where("id % 3 = 0").select("id", F.concat(F.lit("model-"), "subcategory").alias("subcategory"))
    ext = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.concat(F.lit("external-"), F.col("l_linenumber").cast("string")).alias("subcategory"),
        "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("price"),
    )
    return rule, model, ext


def primary(ext: DataFrame) -> DataFrame:
    return n.primary_source(ext, "id", [F.desc("price"), "l_linenumber", "l_partkey", "l_suppkey"])


@query("j02_enriched", f"""{SOURCES} SELECT t.id, coalesce(rule.subcategory, model.subcategory, ext.subcategory, 'Unknown') AS subcategory FROM t LEFT JOIN rule ON t.id = rule.id
LEFT JOIN model ON t.id = model.id LEFT JOIN ext ON t.id = ext.id AND k = 1""")  # fmt: skip
def enriched(spark, sf_dir) -> DataFrame:
    """Each column from the first source that has it; one row for a transaction, whatever the external rows."""
    rule, model, ext = sources(spark, sf_dir)
    return n.coalesced(txns(spark, sf_dir).select("id"), [rule, model, primary(ext)], "id", "subcategory", "Unknown")


@query("a02_subcategory_spend", f"""{SOURCES} SELECT coalesce(rule.subcategory, model.subcategory, 'Unknown') AS subcategory, sum(amount)::DOUBLE AS total, count(*) AS n FROM t LEFT JOIN rule ON t.id = rule.id
LEFT JOIN model ON t.id = model.id WHERE type = 'DEBIT' GROUP BY 1""")  # fmt: skip
def subcategory_spend(spark, sf_dir) -> DataFrame:
    """Debits by the subcategory that counts."""
    rule, model, _ = sources(spark, sf_dir)
    t = n.coalesced(txns(spark, sf_dir).where("type = 'DEBIT'").select("id", "amount"), [rule, model], "id", "subcategory", "Unknown")
    return t.groupBy("subcategory").agg(F.sum("amount").cast("double").alias("total"), F.count("*").alias("n"))


@query("c05_combined", f"""{SOURCES} SELECT t.id, CASE WHEN rule.id IS NOT NULL THEN rule.subcategory WHEN model.id IS NOT NULL THEN model.subcategory ELSE ext.subcategory END AS subcategory,
CASE WHEN rule.id IS NOT NULL THEN 'rule' WHEN model.id IS NOT NULL THEN 'model' WHEN ext.id IS NOT NULL THEN 'external' ELSE 'none' END AS source
FROM t LEFT JOIN rule ON t.id = rule.id LEFT JOIN model ON t.id = model.id LEFT JOIN ext ON t.id = ext.id AND k = 1""")  # fmt: skip
def combined(spark, sf_dir) -> DataFrame:
    """The first source that has a row decides, with its nulls."""
    rule, model, ext = sources(spark, sf_dir)
    every = [s.select("id", F.lit(k).alias("k"), F.lit(name).alias("source"), "subcategory") for k, (name, s) in enumerate((("rule", rule), ("model", model), ("external", primary(ext))))]
    best = n.primary_source(every[0].unionByName(every[1]).unionByName(every[2]), "id", ["k"]).drop("k")
    return txns(spark, sf_dir).select("id").join(best, "id", "left").select("id", "subcategory", F.coalesce("source", F.lit("none")).alias("source"))


@query("w08_source_list", f"{SOURCES} SELECT id, string_agg(subcategory || ': ' || l_partkey::VARCHAR, ' | ' ORDER BY l_linenumber, l_partkey) AS sources FROM ext GROUP BY 1")
def source_list(spark, sf_dir) -> DataFrame:
    """All external sources of a transaction as one text of labels and values, in order."""
    return listed(sources(spark, sf_dir)[2])


def listed(ext: DataFrame) -> DataFrame:
    out = ext.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "subcategory"))).alias("p"))
    return out.select("id", F.array_join(F.transform("p", lambda x: F.concat(x["subcategory"], F.lit(": "), x["l_partkey"].cast("string"))), " | ").alias("sources"))


@query("c01_transactions", f"""{SOURCES}, l AS (SELECT id, string_agg(subcategory || ': ' || l_partkey::VARCHAR, ' | ' ORDER BY l_linenumber, l_partkey) AS sources FROM ext GROUP BY 1)
SELECT t.id, t.day::VARCHAR AS day, coalesce(rule.subcategory, model.subcategory, ext.subcategory, 'Unknown') AS subcategory, l.sources FROM t LEFT JOIN rule ON t.id = rule.id LEFT JOIN model ON t.id = model.id
LEFT JOIN ext ON t.id = ext.id AND k = 1 LEFT JOIN l ON t.id = l.id""")  # fmt: skip
def transactions(spark, sf_dir) -> DataFrame:
    """Transactions with the subcategory that counts and the list of their sources, newest first."""
    rule, model, ext = sources(spark, sf_dir)
    out = n.coalesced(txns(spark, sf_dir).select("id", "day"), [rule, model, primary(ext)], "id", "subcategory", "Unknown").join(listed(ext), "id", "left")
    return out.orderBy(F.desc("day"), "id").withColumn("day", F.col("day").cast("string"))


@query("j02_fanout", f"""{SOURCES} SELECT coalesce(rule.subcategory, model.subcategory, ext.subcategory, 'Unknown') AS subcategory, count(*) AS n, sum(amount)::DOUBLE AS total FROM t LEFT JOIN rule ON t.id = rule.id LEFT JOIN model ON t.id = model.id LEFT JOIN ext ON t.id = ext.id GROUP BY 1""")
def fanout(spark, sf_dir) -> DataFrame:
    """As the enriched rows, but a transaction comes once for each external source, so that sums count it several times (J02, D12): for comparison only."""
    rule, model, ext = sources(spark, sf_dir)
    out = n.coalesced(txns(spark, sf_dir).select("id", "amount"), [rule, model, ext], "id", "subcategory", "Unknown")
    return out.groupBy("subcategory").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"))


@query("a17_enriched_count", f"""{SOURCES}, u AS (SELECT id FROM rule UNION SELECT id FROM model UNION SELECT id FROM ext)
SELECT count(*) AS total, count_if(u.id IS NOT NULL)::BIGINT AS enriched, coalesce(round(count_if(u.id IS NOT NULL)::DECIMAL(18,4) * 100 / nullif(count(*), 0), 1), 0)::DOUBLE AS percent FROM t LEFT JOIN u ON t.id = u.id""")  # fmt: skip
def enriched_count(spark, sf_dir) -> DataFrame:
    """Transactions with any enrichment."""
    rule, model, ext = sources(spark, sf_dir)
    ids = rule.select("id").union(model.select("id")).union(ext.select("id")).distinct().withColumn("hit", F.lit(True))
    t = txns(spark, sf_dir).select("id").join(ids, "id", "left")
    share = F.round(F.count("hit").cast("decimal(18,4)") * 100 / F.nullif(F.count("*"), F.lit(0)), 1)
    return t.agg(F.count("*").alias("total"), F.count("hit").alias("enriched"), F.coalesce(share, F.lit(0)).cast("double").alias("percent"))


@query("j06_enrichment_view", f"""{SOURCES} SELECT t.id, coalesce(rule.subcategory, model.subcategory, (SELECT subcategory FROM ext WHERE ext.id = t.id AND k = 1)) AS subcategory,
CASE WHEN rule.id IS NOT NULL THEN 'rule' WHEN model.id IS NOT NULL THEN 'model' WHEN EXISTS (SELECT 1 FROM ext WHERE ext.id = t.id) THEN 'external' ELSE 'none' END AS source, (SELECT count(*) FROM ext WHERE ext.id = t.id) AS externals
FROM t LEFT JOIN rule ON t.id = rule.id LEFT JOIN model ON t.id = model.id""")  # fmt: skip
def enrichment_view(spark, sf_dir) -> DataFrame:
    """Each transaction's subcategory, where it is from, and how many external sources it has; these are reduced to a row before the join."""
    rule, model, ext = sources(spark, sf_dir)
    counts = ext.groupBy("id").agg(F.count("*").alias("externals"))
    flag = lambda df, name: df.select("id", F.lit(True).alias(name))
    out = n.coalesced(txns(spark, sf_dir).select("id"), [rule, model, primary(ext)], "id", "subcategory")
    out = out.join(flag(rule, "r"), "id", "left").join(flag(model, "m"), "id", "left").join(counts, "id", "left")
    source = F.when(F.col("r"), "rule").when(F.col("m"), "model").when(F.col("externals").isNotNull(), "external").otherwise("none")
    return out.select("id", "subcategory", source.alias("source"), F.coalesce("externals", F.lit(0)).cast("long").alias("externals"))


@query("c15_primary_context", f"""{SOURCES}, p AS (SELECT id, subcategory, l_partkey FROM ext WHERE k = 1) SELECT p.id, p.subcategory || ': ' || p.l_partkey::VARCHAR AS description, count(*) - 1 AS others FROM p JOIN ext ON p.id = ext.id GROUP BY ALL""")
def primary_context(spark, sf_dir) -> DataFrame:
    """The primary source of each transaction as a text for the model, and how many others it has."""
    ext = sources(spark, sf_dir)[2]
    others = ext.groupBy("id").agg((F.count("*") - 1).alias("others"))
    return primary(ext).join(others, "id").select("id", F.concat("subcategory", F.lit(": "), F.col("l_partkey").cast("string")).alias("description"), "others")
