"""Boundaries of the operators, on literal rows."""

import datetime as dt
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from pennyflow import plans
from pennyflow.functions import dates, descriptions, gates, mail, money, text
from pennyflow.operators import categorise, duplicates, enrichment, matching, mining, receipts, rules, tables
from pennyflow.plans import ledger, texts
from pennyflow.sources import feeds
from pennyflow.streaming import ingest


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "want"), [("£1,234.50", 1234.5), ("$ 3", 3.0), ("n/a", 0.0), (None, 0.0)])
def test_currency_value(spark, given, want):
    assert one(spark, money.currency_value(F.col("t")), t=given) == want


@pytest.mark.parametrize(("given", "want"), [("12,34", 12.34), ("1,234", 1234.0), ("x", None)])
def test_european_value(spark, given, want):
    assert one(spark, money.european_value(F.col("t")), t=given) == want


@pytest.mark.parametrize(("given", "want"), [("due 15 January 2024", dt.date(2024, 1, 15)), ("March 3, 2024", dt.date(2024, 3, 3)), ("31/02/2024", None), ("2024-02-29", dt.date(2024, 2, 29)), (None, None)])
def test_free_date(spark, given, want):
    assert one(spark, dates.free_date(F.col("t")), t=given) == want


@pytest.mark.parametrize(
    ("pattern", "value", "want"),
    [("contains:A%B", "xa%by", True), ("contains:A%B", "xaxby", False), ("starts:ab", "ABC", True), ("exact:ab", "abc", False), (r"regex:^\d+$", "123", True), (r"regex:^\d+$", "abc", False), ("bc", "abcd", True)],
)
def test_rule_kinds(spark, pattern, value, want):
    fits = text.rule_matches(F.col("v"), text.rule_kind(F.col("p")), text.rule_body(F.col("p")))
    assert one(spark, fits, p=pattern, v=value) is want


def test_merchant_and_order_ids(spark):
    assert one(spark, text.merchant_key(F.col("t")), t=" Foo & Bar Ltd") == "foo bar"
    assert one(spark, text.merchant_key(F.col("t")), t="argos.co.uk") == "argos" and one(spark, text.merchant_key(F.col("t")), t="Foo UK") == "foo"
    assert one(spark, text.normal_merchant(F.col("t")), t="REFUND FROM Shop*AB12") == "Shop" and one(spark, text.normal_merchant(F.col("t")), t="***") == "***"
    assert one(spark, text.order_id(F.col("t")), t="your order #: 123-1234567-1234567") == "123-1234567-1234567"
    assert one(spark, text.order_id(F.col("t")), t="nothing") is None
    assert len(one(spark, text.abbreviated(F.col("t")), t="a very long product name with many words in it")) <= 35


def test_receipt_hash_of_zero_amount(spark):
    h = lambda a: one(spark, text.receipt_hash(F.col("m"), F.col("a").cast("decimal(18,2)"), F.lit(None).cast("date"), F.lit(None).cast("string")), m="X", a=a)
    assert h("0") == h(None) != h("1")


def pairs(spark, txns, purchases, before, after):
    a = spark.createDataFrame(txns, "txn_id long, d string, x double").select("txn_id", F.to_date("d").alias("txn_day"), F.col("x").cast("decimal(18,2)").alias("txn_amount"))
    b = spark.createDataFrame(purchases, "purchase_id long, d string, x double").select("purchase_id", F.to_date("d").alias("purchase_day"), F.col("x").cast("decimal(18,2)").alias("purchase_amount"))
    return matching.band_join(a, b, before, after)


def test_band_join_bounds_and_rank(spark):
    found = pairs(spark, [(1, "2024-01-10", -5.0)], [(1, "2024-01-17", 5.0), (2, "2024-01-18", 5.0), (3, "2024-01-09", 5.0), (4, "2024-01-10", 5.01), (5, None, 5.0)], -7, 7)
    out = matching.ranked(matching.scored(found, matching.ORDER_POINTS)).orderBy("rank").collect()
    assert [(r["purchase_id"], r["score"]) for r in out] == [(3, 95), (1, 70)]


def rule_set():
    return [rules.Rule(*r) for r in ((2, "a", None, "B", 5), (1, "a", None, "A", 5), (3, "a", "CREDIT", "C", 9), (4, "a", None, "D", 99, False), (5, "regex:(", None, "E", 98), (6, "x" * 300, None, "F", 97), (7, "exact:ZZZ long", None, "G", 1), (8, "starts:zzz", None, "H", 2), (9, r"regex:\d{3}$", None, "I", 1))]


def test_rules_first_match(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "xax", "DEBIT"), (2, "a", "CREDIT"), (3, "q", "DEBIT"), (4, None, "DEBIT"), (5, "zzz long", "DEBIT"), (6, "no 123", "DEBIT"), (7, "", "DEBIT")], "id long, t string, k string")
    want = {1: ("A", 2), 2: ("C", 3), 5: ("H", 2), 6: ("I", 1)}
    for most in (200, 4):  # compiled, and met by their first characters
        monkeypatch.setattr(rules, "COMPILED_RULES", most)
        out = {x["id"]: (x["category"], x["n_rules"]) for x in rules.first_match(rules.matches(rows, rule_set(), "t", "k"), "id").collect()}
        assert out == want
    assert rules.matches(rows, [], "t").count() == 0
    assert [r.priority for r in rules.raised(rule_set(), 1) if r.rule_id == 1] == [100]


def test_writes_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id long, v string, w string")
    new = spark.createDataFrame([(2, "c", "y"), (3, "d", None)], "id long, v string, w string")
    as_set = lambda df: {tuple(r) for r in df.collect()}
    once = tables.insert_new(old, new, ["id"])
    assert as_set(once) == as_set(tables.insert_new(once, new, ["id"])) == {(1, "a", "x"), (2, "b", None), (3, "d", None)}
    assert as_set(tables.upsert(old, new, ["id"])) == {(1, "a", "x"), (2, "c", "y"), (3, "d", None)}
    assert as_set(tables.upsert(old, new.union(new), ["id"])) == as_set(tables.upsert(old, new, ["id"]))
    assert as_set(tables.upsert_columns(old, new, ["id"], ["w"])) == {(1, "a", "x"), (2, "b", "y"), (3, "d", None)}


def test_coalesced_and_primary(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    a, b = (spark.createDataFrame(x, "id long, v string") for x in ([(1, None), (2, "a2")], [(1, "b1"), (2, "b2")]))
    out = {r["id"]: r["v"] for r in enrichment.coalesced(rows, [a, b], "id", "v", "-").collect()}
    assert out == {1: "b1", 2: "a2", 3: "-"}
    s = spark.createDataFrame([(1, 5, "x"), (1, 7, "y")], "id long, c long, v string")
    assert [r["v"] for r in enrichment.primary_source(s, "id", [F.desc("c")]).collect()] == ["y"]
    assert enrichment.source_list(s, "id", "v", "c").first()["sources"] == "x | y"


@pytest.mark.parametrize(("debits", "credits", "want"), [(True, True, 2), (False, False, 2), (True, False, 1), (False, True, 1)])
def test_direction_toggles(spark, debits, credits, want):
    t = spark.createDataFrame([(1, "DEBIT"), (2, "CREDIT")], "id long, type string")
    assert t.where(ledger.filter_of(debits=debits, credits=credits)).count() == want


def test_similarity():
    assert mining.similarity_of("Tea", "tea") == 100 and mining.similarity_of("tea", "tea shop") == 90
    assert 0 <= mining.similarity_of("abc", "xyz") < 40


def test_linked_data_paths(spark):
    doc = '<script type="application/ld+json">{"@graph":[{"@type":"Order","orderNumber":"G1","price":"3.50"}]}</script>'
    order = one(spark, receipts.order_of(receipts.json_ld(F.col("t"))), t=doc)
    assert order["order_id"] == "G1" and float(order["total"]) == 3.5
    assert one(spark, receipts.order_of(receipts.json_ld(F.col("t"))), t="<html></html>") is None


def test_feeds(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"results":[{"transaction_id":"a","timestamp":"2024-01-02T03:04:05Z","amount":-3.5,"running_balance":{"amount":9.0}}]}')
    r = feeds.bank_pages(spark, str(tmp_path / "p.json")).first()
    assert (float(r["amount"]), r["day"], float(r["running_balance"])) == (3.5, dt.date(2024, 1, 2), 9.0)
    (tmp_path / "o.csv").write_text("Website,Order ID,Order Date,Total Owed,Product Name\nw,1,2024-01-02T00:00:00Z,\"£1,000.00\",Tea\nw,,2024-01-02,1,x\n")
    assert [(x["order_id"], float(x["amount"])) for x in feeds.order_lines(spark, str(tmp_path / "o.csv")).collect()] == [("1", 1000.0)]
    with pytest.raises(ValueError, match="Product Name"):
        (tmp_path / "bad.csv").write_text("Website,Order ID,Order Date,Total Owed\n")
        feeds.order_lines(spark, str(tmp_path / "bad.csv"))
    path = str(tmp_path / "table")
    for n in (3, 2):
        feeds.replace_table(spark.range(n), path)
    assert spark.read.parquet(path).count() == 2


def test_stream_ingest_once(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, v string").write.parquet(str(tmp_path / "in"))
    for run in ("one", "two"):
        ingest.ingest_once(ingest.file_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema), str(tmp_path / "out"), ["id"], str(tmp_path / run))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_similarity_keeps_every_name(spark, tmp_path, monkeypatch):
    rows = [("red tea", "RED TEA"), (None, "shop"), ("zzz", None), ("the shop", "x")]
    spark.createDataFrame(rows, "p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    want = {"red tea": ("red tea", 100), "the shop": ("shop", 90), None: (None, None)}
    for size in (500, 1):
        monkeypatch.setattr(texts, "ARRAY_KINDS", size)
        got = {r["p_name"]: (r["kind"], r["score"]) for r in texts.name_similarity(spark, str(tmp_path)).collect()}
        assert got.keys() == {*want, "zzz"} and got["zzz"][0] is None
        assert {k: got[k] for k in want} == want


def test_tolerance_of_a_cent(spark):
    rows = [(1, "2024-01-10", 102.03)]
    others = [(k, "2024-01-11", x) for k, x in enumerate((102.02, 102.03, 102.04, 102.05))]
    a = spark.createDataFrame(rows, "txn_id long, d string, x double").select("txn_id", F.to_date("d").alias("txn_day"), F.col("x").cast("decimal(18,2)").alias("txn_amount"))
    b = spark.createDataFrame(others, "purchase_id long, d string, x double").select("purchase_id", F.to_date("d").alias("purchase_day"), F.col("x").cast("decimal(18,2)").alias("purchase_amount"))
    assert sorted(r["purchase_id"] for r in matching.band_join(a, b, -3, 3, tolerance=1).collect()) == [0, 1, 2]


def fuzzy(spark, amount, receipt, days=0, currency=None, description=None, merchant="Tesco", own="tesco", aliases=None):
    t = spark.createDataFrame([(1, dt.datetime(2024, 1, 20), amount, merchant, description)], "txn_id long, txn_ts timestamp, a string, txn_merchant string, txn_description string").withColumn("txn_amount", F.col("a").cast("decimal(18,2)"))
    r = spark.createDataFrame([(1, dt.datetime(2024, 1, 20) + dt.timedelta(days=days), receipt, own, currency)], "receipt_id long, receipt_ts timestamp, a string, receipt_merchant string, receipt_currency string").withColumn("receipt_amount", F.col("a").cast("decimal(18,2)"))
    return [(x["score"], x["method"]) for x in matching.fuzzy_join(t, r, aliases).collect()]


def test_fuzzy_boundaries(spark):
    assert fuzzy(spark, "3.50", "3.00") == []  # 0.50 is no longer equal
    assert fuzzy(spark, "3.49", "3.00") == [(100, "exact_amount_date_merchant")]
    assert fuzzy(spark, "100.01", "100.00") == [(80, "fuzzy_amount_wide_date_merchant")]
    assert fuzzy(spark, "102.03", "100.00") == [] and fuzzy(spark, "102.00", "100.00", own="x") == [(70, "fuzzy_amount_wide_date")]
    assert fuzzy(spark, "9.00", "9.00", days=-3) == [(100, "exact_amount_close_date_merchant_early_receipt")]
    assert fuzzy(spark, "9.00", "9.00", days=10) == [(90, "exact_amount_wide_date_merchant")] and fuzzy(spark, "9.00", "9.00", days=11) == []
    text_ = "card payment to shop ,240.00 USD, RATE 0.7521/GBP on 20-01-2024"
    assert fuzzy(spark, "180.50", "240.00", currency="USD", description=text_, merchant=None, own="shop") == [(100, "exact_amount_date_merchant")]
    assert fuzzy(spark, "180.50", "180.50", currency="USD", description=text_) == []
    known = spark.createDataFrame([("big shop", "Tesco")], "merchant string, bank_name string")
    assert fuzzy(spark, "9.00", "9.00", merchant=None, description="at TESCO", own="Big Shop", aliases=known) == [(100, "exact_amount_date_merchant")]
    assert fuzzy(spark, "9.00", "9.00", own="") == [(85, "exact_amount_close_date")]


def crowd(n, kind):
    """Rows of one day, half of them purchases, half of another kind, at four amounts that are close together."""
    start = dt.datetime(2024, 3, 1)
    return [(k, start + dt.timedelta(seconds=k), k, ("purchase", kind)[k % 2], 100.0 + k % 4 / 100, "{}") for k in range(n)]


def joined_rows(df):
    """The rows that the joins of a collected frame made."""
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name, metric = node.nodeName(), node.metrics().get("numOutputRows")
        if "Join" in name and metric.isDefined():
            total += metric.get().value()
        todo += [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in name else [node.children().apply(k) for k in range(node.children().size())]
    return total


def test_a_crowded_day_makes_no_pairs(spark, tmp_path):
    rows = spark.createDataFrame(crowd(800, "signup"), "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    got = plans.queries()["c04_unified_matching"](spark, str(tmp_path))
    assert {tuple(x) for x in got.collect()} == {("orders", 400, 0), ("store", 400, 0), ("receipts", 400, 400), ("all", 400, 400)}
    assert joined_rows(got) < 10 * 800  # all pairs: 160,000


def test_a_crowded_day_of_mails_makes_no_pairs(spark, tmp_path):
    rows = spark.createDataFrame(crowd(800, "signup"), "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    got = plans.queries()["c10_mail_pipeline"](spark, str(tmp_path))
    found = dict(got.collect())
    assert found["synced"] == 800 and found["matched"] == found["receipts"] > 40
    assert joined_rows(got) < 10 * 800  # all pairs: over 16,000


@pytest.mark.parametrize("of", ["txn_id", "receipt_id"])
def test_fuzzy_hits_are_the_ids_of_the_pairs(spark, of):
    """Amounts near the bounds, instants near the days, ways in three currencies; nulls and what isn't above 0."""
    rng, start = random.Random(5), dt.datetime(2024, 1, 1)
    amounts = [None, -3.0, 0.0, 0.01, 0.49, 0.5, 0.51, 2.0, 4.5, 4.99, 5.0, 5.01, 5.48, 5.49, 5.5, 49.0, 50.0, 51.0, 99.99, 102.04, 10_000.0, 10_200.0, 10_204.08, 9_999_999.0, 1e13]
    amount = lambda: None if (a := rng.choice(amounts)) is None else round(a * rng.choice([1, 1, 0.98, 1.02, 1.0204, 0.9804]) + rng.choice([0, 0, 0.01, -0.01]), 2)
    at = lambda: None if rng.random() < 0.02 else start + dt.timedelta(days=rng.choice([0, 10, 11, 21, 60, 70, 200]) + rng.randint(0, 1), microseconds=rng.choice([0, 0, 1, -1, 3_600_000_000]))
    for _ in range(2):
        t = [(k, at(), amount(), "Shop", f"at ,{abs(amount() or 1):.2f} {rng.choice(['USD', 'EUR', 'GBP'])}, RATE 0.5/GBP" if rng.random() < 0.4 else "x") for k in range(150)]
        r = [(k, at(), amount(), "Shop", rng.choice([None, "GBP", "usd", "EUR"])) for k in range(150)]
        txns = spark.createDataFrame(t, "txn_id long, txn_ts timestamp_ntz, txn_amount double, txn_merchant string, txn_description string")
        asked = spark.createDataFrame(r, "receipt_id long, receipt_ts timestamp_ntz, receipt_amount double, receipt_merchant string, receipt_currency string")
        want = {x[0] for x in matching.fuzzy_join(txns, asked).where("score >= 70").select(of).collect()}
        got = [x[0] for x in matching.fuzzy_hits(txns, asked, of).collect()]
        assert sorted(got) == sorted(want) and 20 < len(want) < 140


def test_fuzzy_pairs_are_compared_by_whole_numbers(spark):
    """One join by bins, in which cents and microseconds are compared; decimals of a pair would be objects."""
    plan = plans.queries()["j14_receipt_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join [__day" in x]
    assert len(joins) == 1 and "decimal" not in joins[0]


def test_ranked_receipts_are_ranked_where_they_are_paired(spark):
    """No pair is shuffled between the join and the window; receipts of one id, wherever they lie, are ranked together."""
    plan = plans.queries()["w02_ranked_receipts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[plan.index("Window ["):plan.index("Join [__day")]
    t = spark.createDataFrame([(k, dt.datetime(2024, 1, 1), a, None) for k, a in enumerate((9.0, 900.0, 9.1))], "txn_id long, txn_ts timestamp, txn_amount double, txn_merchant string")
    r = spark.createDataFrame([(7, dt.datetime(2024, 1, 1), a, "x") for a in (9.0, 900.0)], "receipt_id long, receipt_ts timestamp, receipt_amount double, receipt_merchant string")
    got = matching.fuzzy_ranked(t, r).select("txn_id", "score", "rank", "primary").collect()
    assert sorted(map(tuple, got)) == [(0, 85, 1, True), (1, 85, 2, False), (2, 70, 3, False)]


@pytest.mark.parametrize(("own", "text"), [("tesco", "at tesco 12"), ("té", "café té"), ("x", "box"), ("", "box"), ("東京", "in 東京 now"), ("🎉🎊", "a 🎉🎊 b")])
def test_pair_bits_of_what_a_text_holds(spark, own, text):
    bits = lambda t: one(spark, matching._pair_bits(F.col("t")), t=t)
    assert bits(own) & ~bits(text) == 0
    assert bits("tesco") & ~bits("market") != 0


def test_duplicates_keep_the_first(spark):
    at = lambda m, s=0: dt.datetime(2024, 1, 1, 10, m, s)
    rows = [(1, "m", at(0), "[a, b, c]"), (2, "m", at(4), "[a, b, c]"), (3, "m", at(8), "[a, b, c]"), (4, "m", at(8), "zzz"), (5, "m", at(9), ""), (6, "n", at(4), "[a, b, c]"), (7, "m", at(30), "[a, b, c]"), (8, "m", at(35), "[a, b, d]"), (9, "m", None, "[a, b, c]")]
    got = duplicates.duplicates(spark.createDataFrame(rows, "id long, m string, ts timestamp, items string"), ["m"], "id", "ts", "items")
    assert sorted(map(tuple, got.collect())) == [(1, 2), (7, 8)]  # 3 is more than five minutes after the kept one


@pytest.mark.parametrize(("slice_rows", "most"), [(duplicates.SLICE_ROWS, 1), (200, 4), (100, 7), (1, 40)])
def test_a_key_that_never_pauses_takes_a_round_for_so_many_rows(spark, monkeypatch, slice_rows, most):
    """Every kept row depends on the one before it, over 30 slices of six hours; the rounds are bounded by rows, and the pairs are those of one sweep."""
    drawn, rows, now, calls = random.Random(3), [], 0.0, []
    for k in range(600):
        now += drawn.expovariate(1 / 1080)
        rows.append((k, "a", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=now), "tea"))
    want, kept = [], None
    for row in rows:
        if kept is None or (row[2] - kept[2]).total_seconds() > 5400:
            kept = row
        else:
            want.append((kept[0], row[0]))
    swept = duplicates._swept
    monkeypatch.setattr(duplicates, "_swept", lambda *a: calls.append(1) or swept(*a))
    df = spark.createDataFrame(rows, "id long, m string, ts timestamp, items string")
    got = duplicates.duplicates(df, ["m"], "id", "ts", "items", minutes=90, slice_rows=slice_rows)
    assert sorted(map(tuple, got.collect())) == want and len(calls) <= most


@pytest.mark.parametrize("slice_rows", [1, 40])
def test_duplicates_over_slices_of_few_rows(spark, slice_rows):
    """Against one sweep over all rows with the plain ratio; slices end anywhere, and some hours are empty."""
    drawn, rows, now = random.Random(slice_rows), [], 0.0
    for k in range(700):
        now += drawn.uniform(1, 100) if k % 150 else 5000
        rows.append((k, drawn.choice(["a", "a", None]), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=now), drawn.choice(["tea, cup", "tea, cups", "a cup of tea", "red bolt", "blue bolt", "bolt"])))
    want, kept = [], []
    for k, key, t, items in rows:
        of = next((j for j, other, s, text in kept if other == key and (t - s).total_seconds() <= 300 and SequenceMatcher(None, text, items).ratio() > 0.8), None)
        kept.append((k, key, t, items)) if of is None else want.append((of, k))
    df = spark.createDataFrame(rows, "id long, m string, ts timestamp, items string")
    got = duplicates.duplicates(df, ["m"], "id", "ts", "items", slice_hours=0.1, slice_rows=slice_rows)
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("hours", [0.25, 6])
def test_duplicates_of_a_key_that_never_pauses(spark, hours):
    """Against one sweep over all rows with the plain ratio: what is handed over from slice to slice changes what is kept far behind."""
    drawn = random.Random(int(hours * 8))
    rows, now = [], 0.0
    for k in range(1200):
        now += drawn.uniform(1, 100) if k % 300 else 2000
        rows.append((k, drawn.choice(["a", "a", "a", None]), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=now), drawn.choice(["tea, cup", "tea, cups", "a cup of tea", "red bolt", "blue bolt", "bolt", "x" * drawn.randrange(1, 9)])))
    want, kept = [], []
    for k, key, t, items in rows:
        of = next((j for j, other, s, text in kept if other == key and (t - s).total_seconds() <= 300 and SequenceMatcher(None, text, items).ratio() > 0.8), None)
        kept.append((k, key, t, items)) if of is None else want.append((of, k))
    df = spark.createDataFrame(rows, "id long, m string, ts timestamp, items string")
    got = duplicates.duplicates(df, ["m"], "id", "ts", "items", slice_hours=hours)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 200


def test_bounds_of_the_ratio():
    drawn = random.Random(5)
    for _ in range(2000):
        a, b = ("".join(drawn.choice("abc ") for _ in range(drawn.randrange(1, 12))) for _ in range(2))
        for similar in (0.5, 0.8, 1.0):
            assert duplicates.alike(a, b, similar) == (SequenceMatcher(None, a, b).ratio() > similar)


def test_extraction_order(spark):
    x = lambda t: one(spark, descriptions.extracted(F.col("t")), t=t)
    shadowed = x("CARD PAYMENT TO Shop*R1 ON 01-02-2024")
    assert (shadowed["payee"], shadowed["reference"], shadowed["confidence"]) == ("Shop*R1", None, 90)
    assert x("CARD PAYMENT TO Zipcar Trip T1 ON 1-2-2024")["variant"] is None
    assert (x("CARD PAYMENT TO LIME RIDE")["variant"], x("CARD PAYMENT TO LIME RIDE")["confidence"]) == ("LIME", 70)
    assert x("AMZNMktplace")["provider"] is None and x("")["confidence"] == x(None)["confidence"] == 0
    assert one(spark, descriptions.debit_payee(F.col("t")), t="direct debit payment to Gas  REF") == "Gas  REF"


@pytest.mark.parametrize(("name", "want"), [("Bloom & Co", True), ("a", False), ("x" * 51, False), ("Shop 2024", False), ("for the", False), ("the shop", True), ("Gift Shop", False), (None, False)])
def test_merchant_names(spark, name, want):
    assert one(spark, mail.valid_merchant(F.col("t")), t=name) is want


@pytest.mark.parametrize(("given", "want"), [("Total: £1,234.50", (1234.5, "GBP")), ("paid $3", (3.0, "USD")), ("£5 and €9.50", (9.5, "EUR")), ("5", None), (None, None)])
def test_found_amount(spark, given, want):
    got = one(spark, money.found_amount(F.col("t")), t=given)
    assert (got and (float(got["amount"]), got["currency"])) == want


def test_abbreviated_has_no_ellipsis(spark):
    short = lambda t: one(spark, text.abbreviated(F.col("t")), t=t)
    assert short("x" * 35) == "x" * 35 and short("x" * 36) == "x" * 35
    assert short("a very long product name with many - words in it") == "a very long product name with many"
    assert short("one " + "y" * 40) == "one " + "y" * 31


def test_order_summary(spark):
    summary = lambda names: spark.createDataFrame([(names,)], "n array<string>").select(receipts.order_summary(F.col("n"))).first()[0]
    assert summary(["z" * 60]) == "z" * 60 and summary(["a", "b"]) == "a | b"
    assert summary(["w" * 40] * 5) == " | ".join(["w" * 35] * 3) + " & 2 more"


def test_keyword_order_and_necessity(spark):
    category = lambda t, a: one(spark, categorise.keyword_category(F.col("t"), F.lit(None), F.lit(a)), t=t)
    assert category("refund of tesco", 5) == "Income" and category("refund of tesco", -5) == "Groceries" and category("zzz", 1) == "Other"
    assert one(spark, categorise.necessity(F.col("t")), t="Groceries") == "Essential" and one(spark, categorise.necessity(F.lit(None).cast("string"))) == "Discretionary"


def test_recent_counts_over_bins(spark):
    rows = spark.createDataFrame([(k, "u", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)) for k, s in enumerate((0, 5, 10, 11, 25, 25, 60))], "id long, u string, ts timestamp")
    got = [r["recent"] for r in ingest.recent_counts(rows, "u", F.col("ts"), 10).orderBy("id").collect()]
    assert got == [1, 2, 3, 3, 2, 2, 1]


def test_balances_and_cards(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"results":[{"transaction_id":"a","timestamp":"2024-01-02T03:04:05Z","amount":-3.5,"running_balance":9.25},{"transaction_id":"b"}]}')
    a, b = feeds.bank_pages(spark, str(tmp_path / "p.json")).orderBy("transaction_id").collect()
    assert (float(a["running_balance"]), a["currency"]) == (9.25, "GBP") and (float(b["amount"]), b["day"], b["description"]) == (0, None, "")
    raw = spark.createDataFrame([("c", "2024-01-02T00:00:00Z", "shop", -7.0, "GBP", "DEBIT", "PURCHASE", None)], "transaction_id string, timestamp string, description string, amount double, currency string, transaction_type string, transaction_category string, merchant_name string")
    row = feeds.card_rows(raw).first()
    assert (float(row["amount"]), row["running_balance"], row["day"]) == (7.0, None, dt.date(2024, 1, 2))


def test_orders_of_lines(spark, tmp_path):
    (tmp_path / "o.csv").write_text("Website,Order ID,Order Date,Total Owed,Product Name,Currency\nw,1,2024-01-02,2.00,Tea,GBP\nw,1,2024-01-02,3.00,Cup,GBP\nw,2,2024-01-03,1.00,,GBP\n")
    out = feeds.orders(feeds.order_lines(spark, str(tmp_path / "o.csv"))).collect()
    assert [(r["order_id"], float(r["amount"]), r["products"], r["currency"], r["order_status"]) for r in out] == [("1", 5.0, "Tea | Cup", "GBP", None)]


def test_digital_orders_and_returns(spark, tmp_path):
    (tmp_path / "d.csv").write_text("ASIN,ProductName,OrderId,DigitalOrderItemId,OrderDate,OurPrice\nA,Film,1,i,2024-01-02T00:00:00Z,3.49\nA,Free,2,j,2024-01-02,0\nA,None,,k,2024-01-02,1\nA,NoItem,3,,2024-01-02,1\n")
    assert [(r["order_id"], float(r["amount"]), r["currency"]) for r in feeds.digital_orders(spark, str(tmp_path / "d.csv")).collect()] == [("1", 3.49, "GBP")]
    (tmp_path / "r.csv").write_text("OrderID,ReversalID,RefundCompletionDate,AmountRefunded\n1,x,2024-02-03T00:00:00Z,£4.00\n")
    assert [(r["order_id"], r["day"], float(r["amount"])) for r in feeds.returns(spark, str(tmp_path / "r.csv")).collect()] == [("1", dt.date(2024, 2, 3), 4.0)]


def test_business_orders(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"orders":[{"orderId":"o1","orderDate":"2024-01-02T10:00:00Z","orderNetTotal":{"amount":"12.50","currencyCode":"EUR"},"lineItems":[{"asin":"x","title":"Pen","itemNetTotal":{"amount":"12.50"}}]},{"orderId":"o2"}]}')
    orders = feeds.business_orders(spark, str(tmp_path / "b.json"))
    assert sorted((r["order_id"], float(r["net_total"]), r["currency"], r["item_count"]) for r in orders.collect()) == [("o1", 12.5, "EUR", 1), ("o2", 0.0, "GBP", 0)]
    assert [(r["order_id"], r["title"], r["quantity"], float(r["unit_price"]), float(r["total_price"])) for r in feeds.business_items(orders).collect()] == [("o1", "Pen", 1, 0.0, 12.5)]


def test_store_pages(spark, tmp_path):
    (tmp_path / "s.html").write_text(
        "<html><body><div>24 Oct 2025</div><div>MM62VW915F</div><div>Total</div><div>£0.99</div><div>Loading...</div><div>Hazard Kit</div><div>Test Press</div><div>1 Sept 2025</div><div>AB12CD34EF</div><div>Total</div><div>£3.49</div><div>Loading...</div><div>BFI PlayerApple TV</div></body>"
        '<script>x={"orderDate":"2025-01-02","orderId":"JSON123456","totalPrice":"£2.00","title":"Song","artistName":"Band"};y={"orderDate":"2025-01-02","orderId":"MM62VW915F","totalPrice":"9"}</script></html>'
    )
    got = {r["order_id"]: (str(r["day"]), float(r["amount"]), r["names"], r["publishers"]) for r in feeds.store_history(spark, str(tmp_path / "s.html")).collect()}
    assert got == {"MM62VW915F": ("2025-10-24", 0.99, "Hazard Kit", "Test Press"), "AB12CD34EF": ("2025-09-01", 3.49, "BFI Player", "Apple TV"), "JSON123456": ("2025-01-02", 2.0, "Song", "Band")}
    (tmp_path / "d.html").write_text("<div>24 Oct 2025</div><div>MM62VW915F</div><div>Total</div><div>£0.99</div><div>Loading...</div><div>Song 10</div><div>Band 11</div>")
    assert feeds.store_history(spark, str(tmp_path / "d.html")).select("names", "publishers").first() == ("Song 10", "Band 11")  # digits at a line's end stay


def test_receipt_search_and_files(spark, tmp_path):
    rows = [(1, "Your ORDER", "x@y.z", 1), (2, "hi", "a@uber.com", 2), (3, "hi", "x@y.z", 2), (4, None, None, 2), (5, "invoice", "q", 9)]
    mails_ = spark.createDataFrame(rows, "id long, subject string, sender string, received_at int")
    assert sorted(r["id"] for r in feeds.receipt_mails(mails_, F.lit(1), F.lit(9)).collect()) == [1, 2]
    for name in ("a.pdf", "b.pdf"):
        (tmp_path / name).write_bytes(b"same")
    assert feeds.files_by_hash(spark, str(tmp_path)).count() == 1
    feeds.write_csv(spark.range(2), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2


def test_linked_data_items_and_graphs(spark):
    doc = '<script type="application/ld+json">{"@graph":[{"@type":"Person"},{"@type":"Invoice","confirmationNumber":"C9","totalPaymentDue":{"price":"8.00","priceCurrency":"EUR"},"acceptedOffer":[{"itemOffered":{"name":"Tea"}},{"name":"Cup"}]}]}</script>'
    order = one(spark, receipts.order_of(receipts.json_ld(F.col("t"))), t=doc)
    assert (order["order_id"], float(order["total"]), order["currency"], order["items"]) == ("C9", 8.0, "EUR", ["Tea", "Cup"])
    assert one(spark, receipts.order_of(F.array(F.col("t"))), t="not json") is None


def test_linked_data_of_a_later_script(spark):
    """The order among all scripts counts, whatever stands before it: other types, lists of types, what isn't JSON."""
    script = lambda kind, doc: f"<script data-x=1 type={kind}>{doc}</script>"
    page = script('"application/ld+json"', '{"@type":"Organization","name":"Shop"}') + script("'application/ld+json'", "{broken") + script("application/ld+json", '[{"@type":["Thing","Order"],"orderNumber":"A1","price":"3.00"}]') + script('"application/ld+json"', '{"@type":"Order","orderNumber":"B2"}')
    assert one(spark, receipts.order_of(receipts.json_ld(F.col("t")))["order_id"], t=page) == "A1"
    row = receipts.parsed(spark.createDataFrame([(page, "order number ZZZZZ9 total £9.00")], "h string, t string"), "h", "t").first()
    assert (row["order_id"], float(row["total"]), row["method"], row["confidence"]) == ("A1", 3.0, "linked_data", 95)


def test_table_items(spark):
    html = "<table><tr><td>£ 3.50</td><td>Garden hose blue</td></tr><tr><td>Garden hose blue</td><td>x3</td></tr><tr><td>Paper towels big</td><td>£9.00</td><td>quantity 4</td></tr><tr><td>Shipping and more</td><td>£1</td></tr><tr><td>Lonely name here</td></tr></table>"
    got = one(spark, receipts.table_items(F.col("t")), t=html)
    assert [(i["name"], i["price"] and float(i["price"]), i["quantity"]) for i in got] == [("Garden hose blue", 3.5, 1), ("Paper towels big", None, 4)]
    assert one(spark, receipts.table_items(F.col("t")), t="none") == []


def test_mail_gates(spark):
    cases = [
        ("Ordered: 'x'", "auto-confirm@amazon.co.uk", "", None, (True, 95), True), ("your order has shipped", "x@amazon.co.uk", "", None, (False, 95), False), ("shop now", "a@shop.example", "", None, (False, 80), True),
        ("hello", "a@shop.example", "", None, (False, 50), True), ("order confirmation for order #A12345", "a@shop.example", "", None, (True, 95), True), ("hi", "a@gmail.com", "", None, (False, 95), False),
        ("hello", "x@amazon.co.uk", "z" * 5000 + "Thanks for YOUR order", None, (True, 95), True), ("hi", "orders@sebago.co.uk", "", None, (False, 90), True), ("order status", "a@ocado.com", None, "<x>", (False, 85), True),
        (None, None, None, None, (False, 50), True), ("Ryanair travel itinerary ", "x@ryanair.com", "", None, (False, 90), True), ("booked confirmation", "a@opentable.com", "", None, (False, 95), True),
    ]
    rows = spark.createDataFrame([(k, *c[:4]) for k, c in enumerate(cases)], "id int, subject string, sender string, body string, unsubscribe string").withColumn("markup", F.lit(None).cast("boolean"))
    got = gates.judged(rows).orderBy("id").collect()
    assert [(tuple(r["likely"]), r["imported"]) for r in got] == [c[4:] for c in cases]
    assert tuple(gates.judged(rows.withColumn("markup", F.lit(True))).first()["likely"]) == (True, 100)


def test_gates_compile_whole(spark, caplog):
    """The gates' tests stay within the 8000 bytes of a method that the JVM compiles."""
    rows = spark.createDataFrame([("a", "b", "c", None, False)], "subject string, sender string, body string, unsubscribe string, markup boolean")
    out = gates.judged(rows)
    code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(out._jdf.queryExecution().executedPlan())
    sizes = [code.apply(k)._3().maxMethodCodeSize() for k in range(code.size())]
    assert sizes and max(sizes) < 8000, sizes
