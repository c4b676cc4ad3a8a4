"""Mails: which are receipts, whose they are, and the dates, amounts and numbers in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, gates, mail, money, text
from ..operators import vendors
from ..operators.matching import fuzzy_hits
from ..operators.scratch import cut
from .base import EVENTS, MAILS, events, mails, pick, pick_sql, query, table


def quoted(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def any_sql(column: str, words) -> str:
    return f"list_bool_or(list_transform({quoted(words)}, lambda w: contains({column}, w)))"


def hits_sql(column: str, words) -> str:
    return f"len(list_filter({quoted(words)}, lambda w: contains({column}, w)))"


#: Senders and subjects that meet every gate and every test of it, by a row's id: each sender with each subject.
GATE_SENDERS = (
    "friend@gmail.com", "news@bmail.sony-europe.com", "noreply@booking.com", "hello@shop.example", "news@woolrich.com", "no-reply@thefork.co.uk", "orders@designacable.com", "itinerary@ryanair.com", "mail@ctshirts.com", "ebay@ebay.com",
    "auto-confirm@amazon.co.uk", "deals@amazon.co.uk", "return@amazon.co.uk", "noreply@uber.com", "service@paypal.co.uk", "microsoft-noreply@microsoft.com", "xbox@microsoft.com", "account@microsoft.com", "no_reply@email.apple.com",
    "news@email.apple.com", "no-reply@lyftmail.com", "noreply@deliveroo.co.uk", "no-reply@spotify.com", "info@account.netflix.com", "payments-noreply@google.com", "play@google.com", "offers@marketing.ocado.com", "customer@ocado.com",
    "team@citizensofsoil.com", "support@figma.com", "info@email.sebago.co.uk", "orders@sebago.co.uk", "transaction@etsy.com", "newsletter@big.example", "orders@shop.example",
)
GATE_SUBJECTS = (
    "Booking confirmation for two", "Table booked", "Your shipment 12", "Your order is on the way", "Your booking is confirmed", "Your receipt", "Your designacable.com order confirmation", "Ryanair Travel Itinerary",
    "With our thanks, here is your Charles Tyrwhitt e-receipt!", "Ann, your order is confirmed", "Order confirmed: red bolt", "Your order is confirmed.", "Your return of a lamp", "Drop-off confirmation", "Your parcel has shipped",
    "Ordered: 'blue ring'", "Your Amazon Fresh order has been received", "Refund for your order", "Your Thursday evening trip with Uber", "Receipt for your payment to Shop", "Your PayPal receipt", "Your purchase of Office",
    "It has been processed", "Order confirmation #A{id}B77", "Subscription renewed", "New features to discover", "Introducing a free trial", "Your subscription is expiring", "Your invoice from Apple", "What's new", "Your ride on Monday",
    "Your receipt for rides", "Earn credits", "Your order's in the kitchen", "Google Play order receipt", "Your invoice is available", "Try Google today", "Olive oil order #12 confirmed", "Receipt for subscription payment 3 May",
    "Your Sebago Order", "Your order has updates", "Your Etsy Purchase from Ann (12)", "Your Etsy Order dispatched (Receipt #12)", "Delivered", "Shop now: sale ends today", "Special offer, hurry", "Payment confirmation 123", "Hello there", "thank you for your purchase", "invoice number INV-{id}9",
)


def gated(spark, sf_dir) -> DataFrame:
    """Mails with the senders and subjects above."""
    m, n = mails(spark, sf_dir), len(GATE_SENDERS)
    subject = F.replace(pick(GATE_SUBJECTS, F.floor(F.col("id") / n)), F.lit("{id}"), F.col("id").cast("string"))
    return m.withColumns({"sender": pick(GATE_SENDERS, F.col("id")), "subject": subject})


#: The same in SQL: lower-case subject, sender and body, and what is scored; and of the mails as they are.
LOW = f"{MAILS}, lo AS (SELECT *, lower(subject) AS subj, lower(sender) AS send, lower(body) AS bod, lower(subject) || ' ' || lower(left(body, 1000)) AS txt FROM mail)"
GATED = f"""{MAILS}, gm AS (SELECT * REPLACE ({pick_sql(GATE_SENDERS, 'id')} AS sender, replace({pick_sql(GATE_SUBJECTS, f'id // {len(GATE_SENDERS)}')}, '{{id}}', id::VARCHAR) AS subject) FROM mail),
lo AS (SELECT *, lower(subject) AS subj, lower(sender) AS send, lower(body) AS bod, lower(subject) || ' ' || lower(left(body, 1000)) AS txt FROM gm)"""
#: Each gate in SQL, by its literals alone: what it says of the columns subj, send and bod ('vendor', accept, confidence), in the order in which they are tried.
GATE_SQL = {
    "gmail": "WHEN send LIKE '%gmail.com%' THEN ('gmail', false, 95)",
    "sony": "WHEN send LIKE '%bmail.sony-europe.com%' THEN ('sony', false, 95)",
    "booking": "WHEN send LIKE '%booking.com%' THEN ('booking', false, 95)",
    "notice": """WHEN regexp_matches(subj, 'booking confirmation for|your reservation at|reservation confirmed|table booked|your booking at') THEN ('notice', false, 95)
  WHEN regexp_matches(subj, 'your order is on the way|your order has shipped|your order has been shipped|your order has been delivered|your package is on its way|out for delivery|delivery update|tracking your order|your shipment|has been dispatched|is being prepared') THEN ('notice', false, 95)
  WHEN send LIKE '%woolrich.com%' AND NOT regexp_matches(subj, 'receipt|invoice|your purchase|thank you for your purchase') THEN ('notice', false, 95)
  WHEN regexp_matches(send, 'thefork\\.co\\.uk|thefork\\.com|opentable\\.com|opentable\\.co\\.uk') AND regexp_matches(subj, 'confirmation|booked') THEN ('notice', false, 95)""",
    "designacable": "WHEN send LIKE '%designacable%' THEN ('designacable', subj = 'your designacable.com order confirmation', CASE WHEN subj = 'your designacable.com order confirmation' THEN 95 ELSE 90 END)",
    "ryanair": "WHEN send LIKE '%ryanair%' THEN ('ryanair', subj = 'ryanair travel itinerary', CASE WHEN subj = 'ryanair travel itinerary' THEN 95 ELSE 90 END)",
    "ctshirts": "WHEN send LIKE '%ctshirts%' AND subj = 'with our thanks, here is your charles tyrwhitt e-receipt!' THEN ('ctshirts', true, 95) WHEN send LIKE '%ctshirts%' THEN ('ctshirts', false, 90)",
    "ebay": "WHEN send LIKE '%ebay%' AND (subj LIKE '%, your order is confirmed%' OR subj LIKE 'order confirmed:%' OR subj IN ('your order is confirmed.', 'your order is confirmed')) THEN ('ebay', true, 95) WHEN send LIKE '%ebay%' THEN ('ebay', false, 90)",
    "amazon": """WHEN send LIKE '%amazon%' THEN CASE WHEN regexp_matches(send, '(store-news|deals|recommendations|marketing|promo)@amazon') OR subj LIKE 'your return%' OR (subj LIKE '%drop%' AND subj LIKE '%confirmation%')
    OR regexp_matches(subj, 'has been dispatched|has been shipped|has shipped|out for delivery|arriving today|arriving tomorrow|delivered:|dispatched:') THEN ('amazon', false, 95)
  WHEN subj LIKE 'ordered:%' OR subj = 'your amazon fresh order has been received' OR bod LIKE '%order is placed on behalf of%' OR bod LIKE '%thanks for your order%' THEN ('amazon', true, 95)
  WHEN subj LIKE '%your refund%' OR subj LIKE '%refund for%' OR send LIKE '%return@amazon%' THEN ('amazon', true, 90) ELSE ('amazon', false, 90) END""",
    "uber": "WHEN send LIKE '%uber%' AND subj LIKE 'your %' AND subj LIKE '%trip with uber%' THEN ('uber', true, 95) WHEN send LIKE '%uber%' THEN ('uber', false, 90)",
    "paypal": "WHEN send LIKE '%paypal%' AND (subj LIKE 'receipt for your payment to%' OR subj IN ('your paypal receipt', 'receipt for your paypal payment')) THEN ('paypal', true, 95) WHEN send LIKE '%paypal%' THEN ('paypal', false, 90)",
    "microsoft": """WHEN send LIKE '%microsoft%' THEN CASE WHEN regexp_matches(send, '(marketing|promo|newsletter|offers|xbox)@microsoft') THEN ('microsoft', false, 95) WHEN subj LIKE '%your purchase of%' THEN ('microsoft', true, 95)
  WHEN subj LIKE '%has been processed%' THEN ('microsoft', true, 90) WHEN subj LIKE '%order confirmation%' THEN ('microsoft', true, 95) WHEN regexp_matches(subj, 'your order|subscription renewed|payment received') THEN ('microsoft', true, 90)
  WHEN subj LIKE '%receipt for your%' THEN ('microsoft', true, 95)
  WHEN regexp_matches(subj, 'special offer|save on|exclusive deal|limited time|try for free|introducing|new features|update available|security alert|sign-in activity|verify your') THEN ('microsoft', false, 90)
  WHEN send LIKE '%microsoft-noreply@microsoft%' THEN ('microsoft', true, 85) ELSE ('microsoft', false, 60) END""",
    "apple": """WHEN send LIKE '%apple%' THEN CASE WHEN regexp_matches(send, '(news@apple|news@email\\.apple|marketing@apple|promo@apple|store@apple)')
    OR regexp_matches(subj, 'subscription is confirmed|subscription is expiring|subscription confirmation|subscription renewal|your subscription is|pre-order for|is now available') THEN ('apple', false, 95)
  WHEN regexp_matches(subj, 'your receipt from apple|your invoice from apple|your apple store order') THEN ('apple', true, 95) WHEN regexp_matches(subj, 'order confirmation|your purchase') THEN ('apple', true, 90)
  WHEN regexp_matches(subj, 'new in the app store|discover|special offer|try apple|get more from|introducing|free trial|upgrade to|what''s new') THEN ('apple', false, 90) ELSE ('apple', false, 60) END""",
    "lyft": """WHEN send LIKE '%lyft%' THEN CASE WHEN regexp_matches(subj, 'your receipt for rides|your lyft ride receipt|receipt for your ride') THEN ('lyft', true, 95) WHEN subj LIKE '%your ride on%' THEN ('lyft', true, 90)
  WHEN regexp_matches(subj, 'earn credits|refer a friend|special offer|free ride|promo code|discount') THEN ('lyft', false, 90) ELSE ('lyft', false, 60) END""",
    "deliveroo": "WHEN send LIKE '%deliveroo%' AND regexp_matches(subj, 'order(''s| is) in the kitchen') THEN ('deliveroo', true, 95) WHEN send LIKE '%deliveroo%' THEN ('deliveroo', false, 90)",
    "spotify": "WHEN send LIKE '%spotify%' THEN ('spotify', false, 95)",
    "netflix": "WHEN send LIKE '%netflix%' THEN ('netflix', false, 95)",
    "google": """WHEN send LIKE '%google%' THEN CASE WHEN regexp_matches(send, '(googleplay|payments)-noreply@google\\.com') AND regexp_matches(subj, 'receipt|invoice|order|payment') THEN ('google', true, 95)
  WHEN regexp_matches(subj, 'google play order receipt|your invoice is available') THEN ('google', true, 95) WHEN regexp_matches(subj, 'payment confirmation|order confirmation|your receipt') THEN ('google', true, 90)
  WHEN regexp_matches(subj, 'new features|introducing|try google|upgrade to|get more|special offer') THEN ('google', false, 90) ELSE ('google', false, 60) END""",
    "ocado": "WHEN send LIKE '%ocado%' AND send LIKE '%marketing.ocado%' THEN ('ocado', false, 95)",
    "citizensofsoil": """WHEN regexp_matches(send, 'citizensofsoil|citizens of soil') THEN CASE WHEN subj LIKE '%confirmed%' AND subj LIKE '%order%' THEN ('citizensofsoil', true, 95) WHEN subj LIKE '%is on the way%' THEN ('citizensofsoil', false, 95) ELSE ('citizensofsoil', false, 90) END""",
    "figma": "WHEN send LIKE '%figma%' AND subj LIKE 'receipt for subscription payment%' THEN ('figma', true, 95) WHEN send LIKE '%figma%' THEN ('figma', false, 90)",
    "sebago": """WHEN send LIKE '%sebago%' THEN CASE WHEN send LIKE '%info@%' OR send LIKE '%email.sebago%' THEN ('sebago', false, 95) WHEN subj LIKE '%sebago order%' OR subj LIKE '%order from sebago%' THEN ('sebago', true, 95)
  WHEN subj LIKE '%has updates%' OR subj LIKE '%status%' THEN ('sebago', false, 95) ELSE ('sebago', false, 90) END""",
    "etsy": """WHEN send LIKE '%etsy%' THEN CASE WHEN subj LIKE 'your etsy purchase from%' THEN ('etsy', true, 95) WHEN regexp_matches(subj, 'dispatched|shipped|on the way|delivered') THEN ('etsy', false, 95) ELSE ('etsy', false, 90) END""",
}
#: The gates that importing tries, in its order.
IMPORTING = ("amazon", "ebay", "etsy", "uber", "paypal", "microsoft", "apple", "lyft", "deliveroo", "spotify", "netflix", "google", "ocado", "citizensofsoil", "figma")


def gate_sql(names=None) -> str:
    """The gates as one CASE that gives vendor, accept and confidence, or null."""
    return f"CASE {' '.join(GATE_SQL[n] for n in names or GATE_SQL)} END"


def split_sql(source: str, gate: str) -> str:
    """Common tables that give each row of ``source`` its gate's answer as v, a and c."""
    return f"{gate}0 AS (SELECT *, {gate_sql(IMPORTING if gate == 'ig' else None)} AS answer FROM {source}), {gate} AS (SELECT * EXCLUDE (answer), answer[1] AS v, answer[2] AS a, answer[3]::BIGINT AS c FROM {gate}0)"


@query("p13_vendor_gates", f"WITH {GATED}, {split_sql('lo', 'g')} SELECT id, v AS vendor, a AS accept, c AS confidence FROM g WHERE v IS NOT NULL")
def vendor_gates(spark, sf_dir) -> DataFrame:
    """What the first of the 23 gates that applies says of a mail; mails that none applies to aren't judged."""
    return gates.judged(gated(spark, sf_dir)).where("gate IS NOT NULL").select("id", "gate.vendor", "gate.accept", "gate.confidence")


STRONG_SQL = """['order confirmed', 'order confirmation', 'your order has been', 'payment received', 'payment confirmation', 'receipt for your', 'invoice #', 'invoice number', 'order #', 'order number', 'transaction id', 'confirmation number',
  'booking confirmed', 'thank you for your order', 'thank you for your purchase', 'your receipt', 'e-receipt', 'digital receipt']"""
WEAK_SQL = "['order', 'receipt', 'invoice', 'confirmation', 'purchase', 'payment', 'transaction', 'booking', 'subscription']"
PROMO_SQL = """['shop now', 'buy now', 'order now', 'get yours', 'sale ends', 'limited time', 'flash sale', 'black friday', 'cyber monday', 'exclusive deal', 'special offer', 'save up to', 'up to % off', 'deals you', 'deals for', 'gift ideas',
  'gift guide', 'perfect gift', 'don''t miss', 'last chance', 'hurry', 'view in browser', 'email preferences', 'manage preferences']"""
WEAK_PROMO_SQL = "['unsubscribe', 'newsletter', 'promotional', 'marketing', 'sale', 'discount', 'offer', 'promo', 'savings']"
KNOWN_SQL = """regexp_matches(send, '(auto-confirm|order-update|shipment-tracking|return)@amazon|(noreply|receipts)@uber\\.com|noreply@apple\\.com|no_reply@email\\.apple\\.com|(service|noreply)@paypal|(noreply|orders)@deliveroo|receipts@netflix\\.com|info@account\\.netflix\\.com|noreply@spotify\\.com|(^|[^a-z])noreply@google\\.com|payments-noreply@google\\.com|noreply@google\\.com|msa@communication\\.microsoft\\.com|(ebay|orders|transaction)@ebay\\.com|ebay@reply\\.ebay\\.com')"""
PUSHY_SQL = "regexp_matches(send, 'store-news@amazon|deals@amazon|recommendations@amazon|(marketing|promo|newsletter|deals|offers|sales|promotions|campaign|email|hello)@|news@uber')"
COUNT = "len(list_filter({0}, lambda w: contains(txt, w)))"
SCORED = f"""{split_sql('lo', 'g')}, s AS (SELECT *, {KNOWN_SQL} AS known, {PUSHY_SQL} AS pushy, {COUNT.format(PROMO_SQL)} AS sm,
  {COUNT.format(STRONG_SQL)} * 2 + {COUNT.format(WEAK_SQL)} - {COUNT.format(PROMO_SQL)} * 3 - {COUNT.format(WEAK_PROMO_SQL)}
  + CASE WHEN regexp_matches(txt, '(?i)(?:order|invoice|confirmation|booking|transaction)\\s*(?:#|number|no\\.?|id)?\\s*[:.]?\\s*[A-Z0-9-]{{5,}}') THEN 3 ELSE 0 END + CASE WHEN {KNOWN_SQL} THEN 2 ELSE 0 END AS score FROM g),
y AS (SELECT id, ts, amount, subject || ' ' || body AS both, CASE WHEN markup THEN true WHEN v IS NOT NULL THEN a WHEN unsubscribe IS NOT NULL AND NOT known THEN false WHEN pushy THEN false WHEN sm > 0 AND NOT known THEN false ELSE score >= 3 END AS accept,
  CASE WHEN markup THEN 100 WHEN v IS NOT NULL THEN c WHEN unsubscribe IS NOT NULL AND NOT known THEN 85 WHEN pushy THEN 90 WHEN sm > 0 AND NOT known THEN 80
    WHEN score >= 3 OR score <= -2 THEN least(70 + abs(score) * 5, 95) ELSE 50 END::BIGINT AS confidence FROM s)"""

LIKELY = f"{GATED}, {SCORED}"


@query("p14_likely_receipts", f"WITH {LIKELY} SELECT id, accept, confidence FROM y")
def likely_receipts(spark, sf_dir) -> DataFrame:
    """Markup, gates, senders and words: whether a mail is a receipt, and how surely."""
    return gates.judged(gated(spark, sf_dir)).select("id", "likely.accept", "likely.confidence")


IMPORTED = f"""{split_sql('lo', 'ig')}, i0 AS (SELECT *, lower(regexp_extract(sender, '([^@]*)$', 1)) AS dom FROM ig),
i AS (SELECT id, NOT (dom IN ('gmail.com', 'googlemail.com', 'outlook.com', 'hotmail.com', 'live.com', 'msn.com', 'yahoo.com', 'yahoo.co.uk', 'icloud.com', 'me.com', 'mac.com', 'aol.com', 'protonmail.com', 'proton.me')
  OR regexp_matches(subj, 'your order is on the way|your order has shipped|your order has been shipped|your order has been delivered|your package is on its way|out for delivery|booking confirmation for|your reservation at|reservation confirmed')
  OR (dom = 'woolrich.com' AND NOT regexp_matches(subj, 'thank you for your purchase|receipt|invoice'))) AND coalesce(a, true) AS imported FROM i0)"""


@query("p15_import_gate", f"WITH {GATED}, {IMPORTED} SELECT id, imported FROM i")
def import_gate(spark, sf_dir) -> DataFrame:
    """Mails that are taken in at all."""
    return gates.judged(gated(spark, sf_dir)).select("id", "imported")


def valid_sql(v: str) -> str:
    """Whether the lower-case text ``v`` can be a merchant's name."""
    return f"""({v} IS NOT NULL AND length({v}) BETWEEN 2 AND 50 AND NOT regexp_matches({v}, '\\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\\b')
  AND NOT regexp_matches({v}, '\\b\\d{{1,2}}(?:st|nd|rd|th)?\\b') AND NOT regexp_matches({v}, '\\b20\\d{{2}}\\b') AND NOT {any_sql(v, mail.PROMO_WORDS)} AND NOT {any_sql(v, mail.SUBJECT_PHRASES)}
  AND NOT list_bool_or(list_transform({quoted(mail.BAD_STARTS)}, lambda w: starts_with({v}, w)))
  AND len(list_filter(string_split_regex({v}, '\\s+'), lambda w: list_contains({quoted(mail.STOP_WORDS)}, w))) * 2 <= len(list_filter(string_split_regex({v}, '\\s+'), lambda w: w <> '')))"""


#: Texts that are names of merchants or not, beside the senders' names.
CANDIDATES = ("Bloom & Co", "for your trip", "The Body Shop", "Black Friday Team", "November 12", "Shop 2024", "a", "your order", "my the shop", "Café du Nord")


@query("p16_merchant_names", f"WITH {MAILS}, v AS (SELECT id, trim(lower({pick_sql(CANDIDATES, 'id')})) AS v FROM mail) SELECT id, {valid_sql('v')} AS valid FROM v")
def merchant_names(spark, sf_dir) -> DataFrame:
    """Which texts can be merchants' names."""
    return mails(spark, sf_dir).select("id", mail.valid_merchant(pick(CANDIDATES, F.col("id"))).alias("valid"))


#: Hosts whose merchant is known.
HOSTS = (("ebay.com", "eBay"), ("uber.com", "Uber"))
SUBJECT_RE = [p.replace("'", "''") for p in mail.SUBJECT_PATTERNS]


@query("f14_mail_merchants", f"""WITH {MAILS}, s AS (SELECT id, subject, lower(regexp_extract(sender, '([^@]*)$', 1)) AS dom, trim(sender_name) AS nm,
  trim(regexp_extract(subject, '{SUBJECT_RE[0]}', 1)) AS s0, trim(regexp_extract(subject, '{SUBJECT_RE[1]}', 1)) AS s1, trim(regexp_extract(subject, '{SUBJECT_RE[2]}', 1)) AS s2 FROM mail),
k AS (SELECT *, CASE WHEN {valid_sql('lower(nm)')} THEN nm END AS n0 FROM s),
c AS (SELECT id, dom, CASE WHEN NOT list_contains({quoted(mail.GENERIC_SENDERS)}, lower(n0)) AND NOT starts_with(lower(n0), 'no') THEN n0 END AS n1,
  CASE WHEN {valid_sql('lower(s0)')} THEN s0 END AS v0, CASE WHEN {valid_sql('lower(s1)')} THEN s1 END AS v1, CASE WHEN {valid_sql('lower(s2)')} THEN s2 END AS v2 FROM k)
SELECT id, coalesce(CASE dom WHEN 'ebay.com' THEN 'eBay' WHEN 'uber.com' THEN 'Uber' END, n1, v0, v1, v2,
  CASE WHEN NOT list_contains({quoted(mail.GENERIC_HOSTS)}, split_part(dom, '.', 1)) THEN upper(left(split_part(dom, '.', 1), 1)) || substr(split_part(dom, '.', 1), 2) END) AS merchant FROM c""")  # fmt: skip
def mail_merchants(spark, sf_dir) -> DataFrame:
    """Each mail's merchant: by its host, its sender's name, its subject, or the host's own name."""
    known = spark.createDataFrame(HOSTS, "host string, known string")
    m = mails(spark, sf_dir).withColumn("host", mail.sender_domain(F.col("sender"))).join(F.broadcast(known), "host", "left")
    return m.select("id", mail.mail_merchant(F.col("subject"), F.col("host"), F.col("sender_name"), F.col("known")).alias("merchant"))


PRODUCTS = ("USB charger", "Kindle case", "red bolt", "Coffee beans 1kg", "Lego game", "Power bank", "monthly plan", "Uber Eats delivery", "frying pan", "shoe", "vitamin C", "Toothpaste")


def first_sql(column: str, kinds, rest: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}') THEN '{k}'" for p, k in kinds) + f" {rest} END"


@query("f15_product_hints", f"""WITH n AS (SELECT p_partkey AS id, lower({pick_sql(PRODUCTS, 'p_partkey')} || ' ' || p_name) AS l FROM part)
SELECT id, {first_sql('l', mail.PRODUCT_KINDS, '')} AS kind, {first_sql('l', mail.PRODUCT_CATEGORIES, "ELSE 'other'")} AS category FROM n""")  # fmt: skip
def product_hints(spark, sf_dir) -> DataFrame:
    """A description and a category hint of each product by its name."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", pick(PRODUCTS, F.col("p_partkey")), F.col("p_name")).alias("name"))
    return p.select("id", mail.product_kind(F.col("name")).alias("kind"), mail.product_category(F.col("name")).alias("category"))


@query("f64_order_numbers", f"""WITH {MAILS}, b AS (SELECT id, subject || ' ' || body AS b FROM mail), f AS (SELECT id, [regexp_extract(b, '(?i)order\\s*(?:#|number|no\\.?|id)?[:\\s]*([A-Z0-9\\-]{{5,30}})', 1),
  regexp_extract(b, '(?i)confirmation\\s*(?:#|number|no\\.?)?[:\\s]*([A-Z0-9\\-]{{5,30}})', 1), regexp_extract(b, '(?i)reference\\s*(?:#|number|no\\.?)?[:\\s]*([A-Z0-9\\-]{{5,30}})', 1),
  regexp_extract(b, '(?i)booking\\s*(?:#|number|no\\.?|ref)?[:\\s]*([A-Z0-9\\-]{{5,30}})', 1), regexp_extract(b, '(?i)invoice\\s*(?:#|number|no\\.?)?[:\\s]*([A-Z0-9\\-]{{5,30}})', 1)] AS f FROM b)
SELECT id, list_filter(f, lambda x: x <> '' AND lower(x) NOT IN ('your', 'order', 'total'))[1] AS number FROM f""")  # fmt: skip
def order_numbers(spark, sf_dir) -> DataFrame:
    """The first order, confirmation, reference, booking or invoice number of a mail (F64)."""
    return mails(spark, sf_dir).select("id", text.order_id(F.concat_ws(" ", "subject", "body")).alias("number"))


@query("f65_mail_kinds", f"""WITH {LOW} SELECT id, CASE WHEN starts_with(subj, 'ordered:') THEN 'ordered' WHEN contains(subj, 'cancelled') THEN 'cancellation' WHEN contains(subj, 'refund') THEN 'refund' WHEN contains(subj, 'fresh') THEN 'fresh'
  WHEN contains(bod, 'order is placed on behalf of') THEN 'business' WHEN {any_sql('subj', mail.SHIPMENT_WORDS)} THEN 'shipment' ELSE 'order' END AS kind FROM lo""")  # fmt: skip
def mail_kinds(spark, sf_dir) -> DataFrame:
    """The kind of each order mail."""
    return mails(spark, sf_dir).select("id", mail.mail_kind(F.col("subject"), F.col("body")).alias("kind"))


MESSAGES = ("Read timeout", "HTTP 429 quota", "401 unauthorized", "connection reset", "constraint violated", "invalid value", "no table in mail", "HTTP 503", "what", "")
EXCEPTIONS = ("ReadTimeout", "ValueError", "KeyError", "ConnectionError")
STAGES = ("fetch", "parse", "vendor_parse", "match", "store")


@query("f67_errors", f"""WITH {MAILS}, z AS (SELECT id, lower({pick_sql(MESSAGES, 'id')}) AS m, {pick_sql(EXCEPTIONS, 'user_id')} AS x, {pick_sql(STAGES, 'id + user_id')} AS st FROM mail),
k AS (SELECT id, CASE WHEN contains(m, 'timeout') OR x IN ('TimeoutError', 'ReadTimeout') THEN 'timeout' WHEN contains(m, 'rate') OR contains(m, '429') OR contains(m, 'quota') THEN 'rate_limit'
  WHEN contains(m, 'auth') OR contains(m, '401') THEN 'auth_error' WHEN contains(m, 'connection') OR contains(m, 'network') OR x IN ('ConnectionError', 'ConnectionResetError') THEN 'network'
  WHEN contains(m, 'database') OR contains(m, 'psycopg2') OR contains(m, 'postgres') OR contains(m, 'constraint') THEN 'db_error' WHEN contains(m, 'validation') OR contains(m, 'invalid') OR x IN ('ValueError', 'ValidationError') THEN 'validation'
  WHEN st IN ('parse', 'vendor_parse', 'schema_parse', 'pattern_parse') THEN 'parse_error' WHEN contains(m, '4') OR contains(m, '5') OR contains(m, 'api') THEN 'api_error' ELSE 'unknown' END AS kind FROM z)
SELECT kind, kind IN ('timeout', 'rate_limit', 'network', 'api_error') AS retryable, count(*) AS n FROM k GROUP BY 1""")  # fmt: skip
def errors(spark, sf_dir) -> DataFrame:
    """Errors by kind, and whether to try again."""
    m = mails(spark, sf_dir)
    x = mail.error_kind(pick(MESSAGES, F.col("id")), pick(EXCEPTIONS, F.col("user_id")), pick(STAGES, F.col("id") + F.col("user_id")))
    return m.select(x.alias("x")).groupBy("x.kind", "x.retryable").agg(F.count("*").alias("n"))


WRITTEN = ("paid 3/4/2024", "on 2024-02-30 or March 5th, 2024", "12 jan 2023 at noon", "Sept 3 2024", "1st Feb 2024", "2024/7/9", "31-12-1999", "no day", "May 9, 2024", "15 January 2024")


@query("f22_free_dates", rf"""WITH {MAILS}, w AS (SELECT id, {pick_sql(WRITTEN, 'id')} AS w FROM mail),
m AS (SELECT *, list_transform(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lambda x: x) AS mm FROM w),
f AS (SELECT id, w, [regexp_extract(w, '(\d{{1,2}})[/\-](\d{{1,2}})[/\-](\d{{4}})', 3) || '-' || lpad(regexp_extract(w, '(\d{{1,2}})[/\-](\d{{1,2}})[/\-](\d{{4}})', 2), 2, '0') || '-' || lpad(regexp_extract(w, '(\d{{1,2}})[/\-](\d{{1,2}})[/\-](\d{{4}})', 1), 2, '0'),
  regexp_extract(w, '(\d{{4}})[/\-](\d{{1,2}})[/\-](\d{{1,2}})', 1) || '-' || lpad(regexp_extract(w, '(\d{{4}})[/\-](\d{{1,2}})[/\-](\d{{1,2}})', 2), 2, '0') || '-' || lpad(regexp_extract(w, '(\d{{4}})[/\-](\d{{1,2}})[/\-](\d{{1,2}})', 3), 2, '0'),
  regexp_extract(w, '(?i){dates._NAME}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})', 3) || '-' || lpad(list_position(mm, lower(left(regexp_extract(w, '(?i){dates._NAME}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})', 1), 3)))::VARCHAR, 2, '0')
    || '-' || lpad(regexp_extract(w, '(?i){dates._NAME}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})', 2), 2, '0'),
  regexp_extract(w, '(?i)(\d{{1,2}})(?:st|nd|rd|th)?\s+{dates._NAME}\s+(\d{{4}})', 3) || '-' || lpad(list_position(mm, lower(left(regexp_extract(w, '(?i)(\d{{1,2}})(?:st|nd|rd|th)?\s+{dates._NAME}\s+(\d{{4}})', 2), 3)))::VARCHAR, 2, '0')
    || '-' || lpad(regexp_extract(w, '(?i)(\d{{1,2}})(?:st|nd|rd|th)?\s+{dates._NAME}\s+(\d{{4}})', 1), 2, '0')] AS f FROM m)
SELECT id, list_filter(list_transform(f, lambda x: try_strptime(x, '%Y-%m-%d')::DATE), lambda d: d IS NOT NULL AND year(d) BETWEEN 2000 AND 2100)[1]::VARCHAR AS day FROM f""")  # fmt: skip
def free_dates(spark, sf_dir) -> DataFrame:
    """The first date in a text by the four layouts in turn; month names parse in either order."""
    return mails(spark, sf_dir).select("id", dates.free_date(pick(WRITTEN, F.col("id"))).cast("string").alias("day"))


NOTES = ("Total: £1,234.50 paid", "was £5 now $7.25", "12.00 EUR", "€9 and £8.50", "nothing", "amount 5", "charged EUR 3", "£ 4.10 and GBP 400", "grand total: $ 12")


@query("f32_amounts", r"WITH " + MAILS + ", w AS (SELECT id, " + pick_sql(NOTES, "id") + r""" AS w FROM mail),
t AS (SELECT *, '(?i)(?:total|order total|amount|grand total|payment|charged|paid)[:\s]*[£$€]?\s*([0-9,]+\.?[0-9]*)' AS p1, '(?i)[£$€]\s*([0-9,]+\.[0-9]{2})\s*(?:total|paid|charged)' AS p2 FROM w),
l AS (SELECT id, w, try_cast(replace(regexp_extract(w, p1, 1), ',', '') AS DECIMAL(18,2)) AS a1, strpos(w, nullif(regexp_extract(w, p1, 0), '')) AS i1, try_cast(replace(regexp_extract(w, p2, 1), ',', '') AS DECIMAL(18,2)) AS a2, strpos(w, nullif(regexp_extract(w, p2, 0), '')) AS i2 FROM t),
c AS (SELECT *, coalesce(a1, a2) AS a, substr(w, greatest(1, CASE WHEN a1 IS NOT NULL THEN i1 ELSE i2 END - 20), CASE WHEN a1 IS NOT NULL THEN i1 ELSE i2 END + 30 - greatest(1, CASE WHEN a1 IS NOT NULL THEN i1 ELSE i2 END - 20)) AS near FROM l),
g AS (SELECT *, list_concat(list_transform(regexp_extract_all(w, '(?i)(?:£|GBP)\s*([0-9,]+\.?[0-9]*)', 1), lambda x: {'a': try_cast(replace(x, ',', '') AS DECIMAL(18,2)), 'k': 0, 'c': 'GBP'}),
  list_transform(regexp_extract_all(w, '(?i)(?:\$|USD)\s*([0-9,]+\.?[0-9]*)', 1), lambda x: {'a': try_cast(replace(x, ',', '') AS DECIMAL(18,2)), 'k': -1, 'c': 'USD'}),
  list_transform(regexp_extract_all(w, '(?i)(?:€|EUR)\s*([0-9,]+\.?[0-9]*)', 1), lambda x: {'a': try_cast(replace(x, ',', '') AS DECIMAL(18,2)), 'k': -2, 'c': 'EUR'}),
  list_transform(regexp_extract_all(w, '(?i)([0-9,]+\.[0-9]{2})\s*(?:GBP|USD|EUR)', 1), lambda x: {'a': try_cast(replace(x, ',', '') AS DECIMAL(18,2)), 'k': -3, 'c': 'GBP'})) AS g FROM c),
h AS (SELECT *, list_reverse_sort(list_filter(g, lambda x: x.a IS NOT NULL))[1] AS m FROM g)
SELECT id, coalesce(a, m.a)::DOUBLE AS amount, CASE WHEN a IS NOT NULL THEN CASE WHEN contains(near, '£') THEN 'GBP' WHEN contains(near, '$') THEN 'USD' WHEN contains(near, '€') THEN 'EUR' WHEN contains(near, '¥') THEN 'JPY' WHEN contains(near, 'CHF') THEN 'CHF' ELSE 'GBP' END ELSE m.c END AS currency FROM h""")  # fmt: skip
def amounts(spark, sf_dir) -> DataFrame:
    """A text's total and its currency, else the largest amount with a sign (F32)."""
    out = mails(spark, sf_dir).select("id", money.found_amount(pick(NOTES, F.col("id"))).alias("x"))
    return out.select("id", F.col("x.amount").cast("double").alias("amount"), "x.currency")


#: Hosts of the vendors' parsers, in the order in which they were registered.
REGISTERED = ("org", "example.com", "shop.example", "example.org")


@query("j22_parser_hosts", f"""WITH u AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host FROM pages)
SELECT page_id, CASE WHEN list_contains({quoted(REGISTERED)}, host) THEN host ELSE list_filter({quoted(REGISTERED)}, lambda w: contains(host, w))[1] END AS parser FROM u""")  # fmt: skip
def parser_hosts(spark, sf_dir) -> DataFrame:
    """The parser of a page's host: registered under it, else the first whose name is part of it."""
    p = table(spark, sf_dir, "pages").select("page_id", text.url_host(F.col("url")).alias("host"))
    first = F.get(F.filter(F.array(*[F.lit(h) for h in REGISTERED]), lambda h: F.contains("host", h)), F.lit(0))
    return p.select("page_id", F.when(F.col("host").isin(*REGISTERED), F.col("host")).otherwise(first).alias("parser"))


@query("j19_hosts_by_name", """WITH u AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host FROM pages), d AS (SELECT DISTINCT upper(host) AS domain FROM u WHERE page_id < 100)
SELECT host, count(*) AS n FROM u JOIN d ON lower(domain) = host GROUP BY 1""")  # fmt: skip
def hosts_by_name(spark, sf_dir) -> DataFrame:
    """Pages joined to a table of domains, whatever the case."""
    u = table(spark, sf_dir, "pages").select("page_id", text.url_host(F.col("url")).alias("host"))
    d = u.where("page_id < 100").select(F.lower(F.upper("host")).alias("host")).distinct()
    return u.join(d, "host").groupBy("host").agg(F.count("*").alias("n"))


@query("c10_mail_pipeline", f"""WITH {LIKELY}, {IMPORTED}, k AS (SELECT y.*, i.imported FROM y JOIN i ON y.id = i.id), rc AS (SELECT * FROM k WHERE imported AND accept AND amount > 0), t AS (SELECT ts AS tts, amount AS ta FROM e WHERE event_type = 'purchase' AND amount > 0),
h AS (SELECT DISTINCT id FROM rc JOIN t ON abs(floor((epoch_us(ts) - epoch_us(tts)) / 86400000000.0)) <= 10 AND (abs(ta - amount) < CASE WHEN amount < 5 THEN 0.50 ELSE 0.01 END OR abs(ta - amount) <= 0.02 * amount))
SELECT 'synced' AS stage, count(*) AS n FROM k UNION ALL SELECT 'imported', count_if(imported)::BIGINT FROM k UNION ALL SELECT 'receipts', count_if(imported AND accept)::BIGINT FROM k UNION ALL SELECT 'matched', count(*) FROM h""")  # fmt: skip
def mail_pipeline(spark, sf_dir) -> DataFrame:
    """Mails taken in, found to be receipts, and matched to bank rows by tolerant amounts and days: how many pass each stage."""
    # Kept, as mails are judged once for the counts and for the matching.
    m = cut(gates.judged(gated(spark, sf_dir)).select("id", "ts", "amount", "imported", (F.col("imported") & F.col("likely.accept")).alias("receipt")))
    none = F.lit(None).cast("string")
    r = m.where("receipt").select(F.col("id").alias("receipt_id"), F.col("ts").alias("receipt_ts"), F.col("amount").alias("receipt_amount"), none.alias("receipt_merchant"))
    t = events(spark, sf_dir, "purchase").select(F.col("event_id").alias("txn_id"), F.col("ts").alias("txn_ts"), F.col("amount").alias("txn_amount"), none.alias("txn_merchant"))
    matched = fuzzy_hits(t, r, "receipt_id").agg(F.countDistinct("receipt_id").alias("matched"))
    sums = m.agg(F.count("*").alias("synced"), F.count_if("imported").alias("imported"), F.count_if("receipt").alias("receipts")).crossJoin(matched)
    return sums.select(F.expr("stack(4, 'synced', synced, 'imported', imported, 'receipts', receipts, 'matched', matched) AS (stage, n)"))


VENDOR_HOSTS = (
    "audioemotion.co.uk", "novationmusic.com", "mail.account.bluehost.com", "worldpay.com", "designacable.com", "shop.cooksmill.co.uk", "bahaievents.org.uk", "bahai.org.uk", "smolproducts.com", "cables4all.co.uk", "figma.com", "amazon.co.uk", "unknown.example",
)
VENDOR_SUBJECTS = ("Your order confirmation (#{id})", "Invoice #D{id}", "Receipt for subscription payment Nov 30, 2025", "Your Amazon Fresh order has been received", "Order: {id}", "Hello")
VENDOR_TEXTS = (
    "Order #{id} Total: £{a}", "Reference: R-{id} Amount: £{a}", "order ID {id} Payment: £ {a}", "Amount: $ {a} of your order", "Nothing to see", "Subtotal £1.00 Order Total: £{a} Arriving Friday, 3 May 2024", "Total: $12.50 USD Delivery date: 4 May 2024", "Grand Total € 63,75",
)


def vendor_mails(spark, sf_dir) -> DataFrame:
    """Events as mails of known vendors: each host with each subject and text."""
    e, (h, s) = events(spark, sf_dir), (len(VENDOR_HOSTS), len(VENDOR_SUBJECTS))
    fill = lambda c: F.replace(F.replace(c, F.lit("{id}"), F.col("event_id").cast("string")), F.lit("{a}"), F.col("amount").cast("string"))
    return e.select(
        F.col("event_id").alias("id"), "ts", pick(VENDOR_HOSTS, F.col("event_id")).alias("host"), fill(pick(VENDOR_SUBJECTS, F.floor(F.col("event_id") / h))).alias("subject"), fill(pick(VENDOR_TEXTS, F.floor(F.col("event_id") / (h * s)))).alias("body"),
    )


#: The same in SQL, and each field by its vendor's patterns alone; what isn't found is an empty text.
VENDOR_SQL = f"""{EVENTS}, vm AS (SELECT event_id AS id, {pick_sql(VENDOR_HOSTS, 'event_id')} AS host,
  replace(replace({pick_sql(VENDOR_SUBJECTS, f'event_id // {len(VENDOR_HOSTS)}')}, '{{id}}', event_id::VARCHAR), '{{a}}', amount::VARCHAR) AS subject,
  replace(replace({pick_sql(VENDOR_TEXTS, f'event_id // {len(VENDOR_HOSTS) * len(VENDOR_SUBJECTS)}')}, '{{id}}', event_id::VARCHAR), '{{a}}', amount::VARCHAR) AS body FROM e),
vf AS (SELECT *, CASE WHEN host = 'unknown.example' OR (host = 'amazon.co.uk' AND NOT contains(lower(subject), 'fresh')) THEN NULL ELSE host END AS v,
  CASE WHEN host IN ('novationmusic.com', 'shop.cooksmill.co.uk') THEN regexp_extract(subject, '#(\\d+)', 1) WHEN host = 'bahai.org.uk' THEN regexp_extract(subject, '#([A-Z]?\\d+)', 1)
    WHEN host = 'audioemotion.co.uk' THEN regexp_extract(subject || ' ' || body, '(?i)order\\s*(?:#|number|:)?\\s*(\\d+)', 1) WHEN host = 'designacable.com' THEN regexp_extract(subject || ' ' || body, '(?i)order\\s*(?:#|:)?\\s*(\\d+)', 1)
    WHEN host = 'mail.account.bluehost.com' THEN regexp_extract(body, '(?i)order\\s*(?:#|ID|:)?\\s*(\\d+)', 1) WHEN host = 'worldpay.com' THEN regexp_extract(body, '(?i)reference[:\\s]*([A-Z0-9\\-]+)', 1)
    WHEN host IN ('smolproducts.com', 'cables4all.co.uk') THEN regexp_extract(body, '(?i)order\\s*(?:#|:)?\\s*(\\d+)', 1) ELSE '' END AS o,
  CASE WHEN host = 'mail.account.bluehost.com' THEN regexp_extract(body, '(?i)(?:Total[:\\s]*|Amount[:\\s]*)\\$\\s*([0-9,]+\\.?\\d*)', 1)
    WHEN host = 'figma.com' THEN coalesce(nullif(regexp_extract(body, '(?i)Total:?\\s*£([\\d,]+\\.?\\d*)', 1), ''), regexp_extract(body, '(?i)Total:?\\s*\\$([\\d,]+\\.?\\d*)', 1))
    WHEN host = 'amazon.co.uk' THEN coalesce(nullif(regexp_extract(body, '(?i)Order\\s+Total[:\\s]*[£$€]?\\s*([0-9,]+\\.?\\d*)', 1), ''), nullif(regexp_extract(body, '(?i)Grand\\s+Total[:\\s]*[£$€]?\\s*([0-9,]+\\.?\\d*)', 1), ''), regexp_extract(body, '(?i)Total[:\\s]*[£$€]\\s*([0-9,]+\\.?\\d*)', 1))
    WHEN host = 'worldpay.com' THEN coalesce(nullif(regexp_extract(body, '(?i)Total[:\\s]*£\\s*([0-9,]+\\.?\\d*)', 1), ''), nullif(regexp_extract(body, '(?i)Amount[:\\s]*£\\s*([0-9,]+\\.?\\d*)', 1), ''), regexp_extract(body, '£\\s*([0-9,]+\\.[0-9]{{2}})', 1))
    WHEN host = 'bahaievents.org.uk' THEN regexp_extract(body, '(?i)(?:Total|Amount|Payment)[:\\s]*£\\s*([0-9,]+\\.?\\d*)', 1) WHEN host = 'bahai.org.uk' THEN regexp_extract(body, '(?i)(?:Total|Amount)[:\\s]*£\\s*([0-9,]+\\.?\\d*)', 1)
    ELSE regexp_extract(body, '(?i)Total[:\\s]*£\\s*([0-9,]+\\.?\\d*)', 1) END AS t,
  CASE WHEN host = 'figma.com' AND contains(subject, 'Nov 30, 2025') THEN '2025-11-30' WHEN host = 'amazon.co.uk' AND contains(body, '3 May 2024') THEN '2024-05-03' WHEN host = 'amazon.co.uk' AND contains(body, '4 May 2024') THEN '2024-05-04' END AS d FROM vm),
vg AS (SELECT id, v, nullif(o, '') AS order_id, nullif(CASE WHEN regexp_full_match(t, '\\d+,\\d\\d') THEN replace(t, ',', '.') ELSE replace(t, ',', '') END, '')::DECIMAL(18,2) AS tot, d, body FROM vf)"""


@query("x01_vendor_fields", f"""WITH {VENDOR_SQL} SELECT id, order_id, nullif(tot, 0)::DOUBLE AS total, d AS day,
  CASE WHEN v IN ('mail.account.bluehost.com', 'figma.com') THEN CASE WHEN contains(body, '£') THEN 'GBP' ELSE 'USD' END WHEN v = 'amazon.co.uk' THEN CASE WHEN contains(body, '£') THEN 'GBP' WHEN contains(body, '€') THEN 'EUR' WHEN contains(body, '$') THEN 'USD' END ELSE 'GBP' END AS currency
FROM vg WHERE v IS NOT NULL AND CASE v WHEN 'bahaievents.org.uk' THEN coalesce(tot, 0) <> 0 WHEN 'figma.com' THEN d IS NOT NULL OR coalesce(tot, 0) <> 0 WHEN 'amazon.co.uk' THEN true ELSE order_id IS NOT NULL OR coalesce(tot, 0) <> 0 END""")  # fmt: skip
def vendor_receipts(spark, sf_dir) -> DataFrame:
    """What the programs of twelve vendors find in their mails; a mail runs its own vendor's alone."""
    found = vendor_mails(spark, sf_dir).select("id", vendors.vendor_fields(F.col("host"), F.col("subject"), F.col("body")).alias("x")).where("x.vendor IS NOT NULL")
    return found.select("id", "x.order_id", F.col("x.total").cast("double").alias("total"), F.col("x.day").cast("string").alias("day"), "x.currency")


@query("x02_full_cascade", f"""WITH {VENDOR_SQL}, lo AS (SELECT *, lower(subject) AS subj, lower('orders@' || host) AS send, lower(body) AS bod, lower(subject) || ' ' || lower(body) AS txt, false AS markup, NULL AS unsubscribe, 0 AS ts, 0 AS amount FROM vm), {SCORED},
vk AS (SELECT id, CASE WHEN CASE v WHEN 'bahaievents.org.uk' THEN coalesce(tot, 0) <> 0 WHEN 'figma.com' THEN d IS NOT NULL OR coalesce(tot, 0) <> 0 WHEN 'amazon.co.uk' THEN true ELSE v IS NOT NULL AND (order_id IS NOT NULL OR coalesce(tot, 0) <> 0) END THEN v END AS v,
  order_id, nullif(tot, 0)::DOUBLE AS total FROM vg)
SELECT y.id, CASE WHEN NOT y.accept THEN 'pre_filter' WHEN v IS NOT NULL THEN 'vendor' ELSE 'other' END AS stage, CASE WHEN y.accept AND v IS NOT NULL THEN order_id END AS order_id, CASE WHEN y.accept AND v IS NOT NULL THEN total END AS total,
  CASE WHEN NOT y.accept THEN 0 WHEN v = 'worldpay.com' THEN 80 WHEN v IS NOT NULL THEN 85 ELSE 0 END::BIGINT AS confidence FROM y JOIN vk ON y.id = vk.id""")  # fmt: skip
def full_cascade(spark, sf_dir) -> DataFrame:
    """The whole cascade over vendors' mails: what the gates reject, what the vendors' programs read, and what is left to linked data, patterns and the merchant's name."""
    none = F.lit(None).cast("string")
    m = vendor_mails(spark, sf_dir).select("id", "subject", F.concat(F.lit("orders@"), "host").alias("sender"), none.alias("sender_name"), "body", none.alias("html"), none.alias("unsubscribe"), F.col("ts").alias("received"))
    c = vendors.cascade(m)
    stage = F.when(F.startswith("method", F.lit("vendor_")), "vendor").when(F.col("method") == "pre_filter", "pre_filter").otherwise("other")
    own = lambda x: F.when(stage == "vendor", x)
    return c.select("id", stage.alias("stage"), own(F.col("order_id")).alias("order_id"), own(F.col("total").cast("double")).alias("total"), F.when(stage != "other", F.col("confidence")).otherwise(0).alias("confidence"))
