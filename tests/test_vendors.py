"""Programs of vendors and the whole cascade, on literal mails."""

import datetime as dt
from decimal import Decimal

import pytest

from pennyflow.operators import vendors

FRESH = "Thanks for shopping. Items: milk. Order Total: £45.67. Arriving: Friday, 3 May 2024 between 8 and 9."


def test_fresh_orders():
    got = vendors.run("amazon.co.uk", "Your Amazon Fresh order has been received", FRESH)
    assert got == {"vendor": "amazon_fresh", "merchant": "Amazon Fresh", "category": "groceries", "confidence": 85, "currency": "GBP", "total": Decimal("45.67"), "day": dt.date(2024, 5, 3)}
    bare = vendors.run("mail.amazon.de", "Your Amazon Fresh order", None)
    assert bare["merchant"] == "Amazon Fresh" and bare["currency"] is None and "total" not in bare
    # Other kinds of the market's mails have no program here, and the word alone doesn't make a grocery order.
    assert vendors.run("amazon.co.uk", "Ordered: 'fresh tea'", FRESH) is None and vendors.run("amazon.co.uk", "Refund for your Fresh order", FRESH) is None and vendors.run("amazon.co.uk", "Your order", FRESH) is None


@pytest.mark.parametrize(("host", "subject", "text", "want"), [
    ("novationmusic.com", "Your Novation order confirmation (#700024906)", "Total: £1,199.50", ("700024906", Decimal("1199.50"), "GBP")),
    ("bahai.org.uk", "Invoice #D4551", "Amount £12", ("D4551", Decimal("12.00"), "GBP")),
    ("mail.account.bluehost.com", "hi", "Order ID 77. Paid £5.00, Total: $ 6.10", ("77", Decimal("6.10"), "GBP")),
    ("worldpay.com", "x", "reference: AB-1 you paid £ 9.99", ("AB-1", Decimal("9.99"), "GBP")),
    ("smolproducts.com", "order 9", "Subtotal: £3.00 Total: £4.00", (None, Decimal("3.00"), "GBP")),
    ("figma.com", "Receipt for subscription payment Nov 30, 2025", "", (None, None, "USD")),
    ("bahaievents.org.uk", "#12", "no amount", None), ("unknown.example", "#12", "Total: £1.00", None), (None, None, None, None), ("figma.com", "Feb 31, 2025", "", None),
])
def test_programs(host, subject, text, want):
    got = vendors.run(host, subject, text)
    assert (got and (got.get("order_id"), got.get("total"), got["currency"])) == want


def test_amounts_and_days():
    assert [vendors.amount(x) for x in ("63,75", "1,234.5", "12", "0.00", ",", "1,234")] == [Decimal("63.75"), Decimal("1234.50"), Decimal("12.00"), None, None, Decimal("1234.00")]
    assert vendors.written_day("May 3, 2024") == dt.date(2024, 5, 3) and vendors.written_day("31 June 2024") is None and vendors.written_day("3 Foo 2024") is None


def test_cascade_in_order(spark):
    order = '<script type="application/ld+json">{"@type":"Order","orderNumber":"L1","price":"7.00"}</script>'
    mails = [
        ("shop now: sale ends", "a@shop.example", "Acme", "order number A12345", None, ("pre_filter", 0, None, None)),
        ("Your order confirmation (#77)", "shop@novationmusic.com", None, "Thank you for your order. Total: £5.00", order, ("vendor_novation", 85, "77", Decimal("5.00"))),
        ("Your order confirmation", "a@shop.example", "Acme", "Total £5.00", order, ("linked_data", 95, "L1", Decimal("7.00"))),
        ("Your order confirmation", "a@shop.example", "Acme", "order number A12345 total £8.00", None, ("pattern", 80, "A12345", Decimal("8.00"))),
        ("Thank you for your purchase, your receipt", "a@shop.example", "Acme", "hello", None, ("merchant", 50, None, None)),
        ("Thank you for your purchase, your receipt", "a@info", None, "hello", None, ("none", 0, None, None)),
    ]
    rows = [(k, *m[:5], None, dt.datetime(2024, 5, 1, 12)) for k, m in enumerate(mails)]
    df = spark.createDataFrame(rows, "id int, subject string, sender string, sender_name string, body string, html string, unsubscribe string, received timestamp")
    got = vendors.cascade(df).orderBy("id").collect()
    assert [(r["method"], r["confidence"], r["order_id"], r["total"]) for r in got] == [m[5] for m in mails]
    assert [r["day"] for r in got] == [None, *[dt.date(2024, 5, 1)] * 4, None] and got[1]["merchant"] == "Novation"
    assert sorted(got[0].asDict()) == sorted([*df.columns, "method", "merchant", "order_id", "total", "day", "confidence"])
