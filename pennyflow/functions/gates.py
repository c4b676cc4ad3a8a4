"""Mail gates by an automaton: one pass over a mail finds all literals of all gates, and gates are tests of the bits that they set.

Every literal that any gate or list looks for in a field has a bit. Aho-Corasick automata, built once in a worker from the values below, set the bits of a mail in
Arrow batches; the first gate that decides and the number of each list's words follow from comparisons of masks. What is left to
expressions is short enough for generated code that the JVM compiles.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Test = tuple[bool, int, tuple[tuple[str, str, tuple[str, ...]], ...]]


class Gate(NamedTuple):
    """A sender's gate: words of which the sender has to hold one (none: every mail), tests in order (accept?, confidence, conditions that all have to hold) and what holds where no test does; None lets the mail on to the next gates."""

    name: str
    words: tuple[str, ...]
    tests: tuple[Test, ...]
    rest: tuple[bool, int] | None


# Fixed values, each in the order in which they are tried; the order decides the result. A condition is a field, how it is tested, and literals of which one has to fit.
GATES = (
    Gate("gmail", ("gmail.com",), (), (False, 95)),
    Gate("sony", ("bmail.sony-europe.com",), (), (False, 95)),
    Gate("booking", ("booking.com",), (), (False, 95)),
    Gate("notice", (), (
        (False, 95, (("subject", "contains", ("booking confirmation for", "your reservation at", "reservation confirmed", "table booked", "your booking at")),)),
        (False, 95, (("subject", "contains", (
            "your order is on the way", "your order has shipped", "your order has been shipped", "your order has been delivered", "your package is on its way", "out for delivery", "delivery update", "tracking your order",
            "your shipment", "has been dispatched", "is being prepared",
        )),)),
        (False, 95, (("sender", "contains", ("woolrich.com",)), ("subject", "lacks", ("receipt", "invoice", "your purchase", "thank you for your purchase")))),
        (False, 95, (("sender", "contains", ("thefork.co.uk", "thefork.com", "opentable.com", "opentable.co.uk")), ("subject", "contains", ("confirmation", "booked")))),
    ), None),
    Gate("designacable", ("designacable",), ((True, 95, (("subject", "equals", ("your designacable.com order confirmation",)),)),), (False, 90)),
    Gate("ryanair", ("ryanair",), ((True, 95, (("subject", "equals", ("ryanair travel itinerary",)),)),), (False, 90)),
    Gate("ctshirts", ("ctshirts",), ((True, 95, (("subject", "equals", ("with our thanks, here is your charles tyrwhitt e-receipt!",)),)),), (False, 90)),
    Gate("ebay", ("ebay",), (
        (True, 95, (("subject", "contains", (", your order is confirmed",)),)), (True, 95, (("subject", "starts", ("order confirmed:",)),)),
        (True, 95, (("subject", "equals", ("your order is confirmed.", "your order is confirmed")),)),
    ), (False, 90)),
    Gate("amazon", ("amazon",), (
        (False, 95, (("sender", "contains", ("store-news@amazon", "deals@amazon", "recommendations@amazon", "marketing@amazon", "promo@amazon")),)), (False, 95, (("subject", "starts", ("your return",)),)),
        (False, 95, (("subject", "contains", ("drop",)), ("subject", "contains", ("confirmation",)))),
        (False, 95, (("subject", "contains", ("has been dispatched", "has been shipped", "has shipped", "out for delivery", "arriving today", "arriving tomorrow", "delivered:", "dispatched:")),)),
        (True, 95, (("subject", "starts", ("ordered:",)),)), (True, 95, (("subject", "equals", ("your amazon fresh order has been received",)),)),
        (True, 95, (("body", "contains", ("order is placed on behalf of", "thanks for your order")),)), (True, 90, (("subject", "contains", ("your refund", "refund for")),)), (True, 90, (("sender", "contains", ("return@amazon",)),)),
    ), (False, 90)),
    Gate("uber", ("uber",), ((True, 95, (("subject", "starts", ("your ",)), ("subject", "contains", ("trip with uber",)))),), (False, 90)),
    Gate("paypal", ("paypal",), ((True, 95, (("subject", "starts", ("receipt for your payment to",)),)), (True, 95, (("subject", "equals", ("your paypal receipt", "receipt for your paypal payment")),))), (False, 90)),
    Gate("microsoft", ("microsoft",), (
        (False, 95, (("sender", "contains", ("marketing@microsoft", "promo@microsoft", "newsletter@microsoft", "offers@microsoft", "xbox@microsoft")),)), (True, 95, (("subject", "contains", ("your purchase of",)),)),
        (True, 90, (("subject", "contains", ("has been processed",)),)), (True, 95, (("subject", "contains", ("order confirmation",)),)),
        (True, 90, (("subject", "contains", ("your order", "subscription renewed", "payment received")),)), (True, 95, (("subject", "contains", ("receipt for your",)),)),
        (False, 90, (("subject", "contains", ("special offer", "save on", "exclusive deal", "limited time", "try for free", "introducing", "new features", "update available", "security alert", "sign-in activity", "verify your")),)),
        (True, 85, (("sender", "contains", ("microsoft-noreply@microsoft",)),)),
    ), (False, 60)),
    Gate("apple", ("apple",), (
        (False, 95, (("sender", "contains", ("news@apple", "news@email.apple", "marketing@apple", "promo@apple", "store@apple")),)),
        (False, 95, (("subject", "contains", ("subscription is confirmed", "subscription is expiring", "subscription confirmation", "subscription renewal", "your subscription is", "pre-order for", "is now available")),)),
        (True, 95, (("subject", "contains", ("your receipt from apple", "your invoice from apple", "your apple store order")),)), (True, 90, (("subject", "contains", ("order confirmation", "your purchase")),)),
        (False, 90, (("subject", "contains", ("new in the app store", "discover", "special offer", "try apple", "get more from", "introducing", "free trial", "upgrade to", "what's new")),)),
    ), (False, 60)),
    Gate("lyft", ("lyft",), (
        (True, 95, (("subject", "contains", ("your receipt for rides", "your lyft ride receipt", "receipt for your ride")),)), (True, 90, (("subject", "contains", ("your ride on",)),)),
        (False, 90, (("subject", "contains", ("earn credits", "refer a friend", "special offer", "free ride", "promo code", "discount")),)),
    ), (False, 60)),
    Gate("deliveroo", ("deliveroo",), ((True, 95, (("subject", "contains", ("order's in the kitchen", "order is in the kitchen")),)),), (False, 90)),
    Gate("spotify", ("spotify",), (), (False, 95)),
    Gate("netflix", ("netflix",), (), (False, 95)),
    Gate("google", ("google",), (
        (True, 95, (("sender", "contains", ("googleplay-noreply@google.com", "payments-noreply@google.com")), ("subject", "contains", ("receipt", "invoice", "order", "payment")))),
        (True, 95, (("subject", "contains", ("google play order receipt", "your invoice is available")),)), (True, 90, (("subject", "contains", ("payment confirmation", "order confirmation", "your receipt")),)),
        (False, 90, (("subject", "contains", ("new features", "introducing", "try google", "upgrade to", "get more", "special offer")),)),
    ), (False, 60)),
    Gate("ocado", ("ocado",), ((False, 95, (("sender", "contains", ("marketing.ocado",)),)),), None),
    Gate("citizensofsoil", ("citizensofsoil", "citizens of soil"), (
        (True, 95, (("subject", "contains", ("confirmed",)), ("subject", "contains", ("order",)))), (False, 95, (("subject", "contains", ("is on the way",)),)),
    ), (False, 90)),
    Gate("figma", ("figma",), ((True, 95, (("subject", "starts", ("receipt for subscription payment",)),)),), (False, 90)),
    Gate("sebago", ("sebago",), (
        (False, 95, (("sender", "contains", ("info@", "email.sebago")),)), (True, 95, (("subject", "contains", ("sebago order", "order from sebago")),)), (False, 95, (("subject", "contains", ("has updates", "status")),)),
    ), (False, 90)),
    Gate("etsy", ("etsy",), (
        (True, 95, (("subject", "starts", ("your etsy purchase from",)),)), (False, 95, (("subject", "contains", ("dispatched", "shipped")),)), (False, 95, (("subject", "contains", ("on the way", "delivered")),)),
    ), (False, 90)),
)
#: Of these gates, those that importing tries, in its own order.
IMPORT_ORDER = ("amazon", "ebay", "etsy", "uber", "paypal", "microsoft", "apple", "lyft", "deliveroo", "spotify", "netflix", "google", "ocado", "citizensofsoil", "figma")
PERSONAL_DOMAINS = (
    "gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "live.com", "msn.com", "yahoo.com", "yahoo.co.uk", "icloud.com", "me.com", "mac.com", "aol.com", "protonmail.com", "proton.me",
)
SHIPPING_SUBJECTS = ("your order is on the way", "your order has shipped", "your order has been shipped", "your order has been delivered", "your package is on its way", "out for delivery")
BOOKING_SUBJECTS = ("booking confirmation for", "your reservation at", "reservation confirmed")
SHIPPING_DOMAIN, BOUGHT_SUBJECTS = "woolrich.com", ("thank you for your purchase", "receipt", "invoice")
STRONG_RECEIPT = (
    "order confirmed", "order confirmation", "your order has been", "payment received", "payment confirmation", "receipt for your", "invoice #", "invoice number", "order #", "order number",
    "transaction id", "confirmation number", "booking confirmed", "thank you for your order", "thank you for your purchase", "your receipt", "e-receipt", "digital receipt",
)
WEAK_RECEIPT = ("order", "receipt", "invoice", "confirmation", "purchase", "payment", "transaction", "booking", "subscription")
STRONG_MARKETING = (
    "shop now", "buy now", "order now", "get yours", "sale ends", "limited time", "flash sale", "black friday", "cyber monday", "exclusive deal", "special offer", "save up to", "up to % off",
    "deals you", "deals for", "gift ideas", "gift guide", "perfect gift", "don't miss", "last chance", "hurry", "view in browser", "email preferences", "manage preferences",
)
WEAK_MARKETING = ("unsubscribe", "newsletter", "promotional", "marketing", "sale", "discount", "offer", "promo", "savings")
RECEIPT_SENDERS = (
    "auto-confirm@amazon", "order-update@amazon", "shipment-tracking@amazon", "return@amazon", "noreply@uber.com", "receipts@uber.com", "noreply@apple.com", "no_reply@email.apple.com",
    "service@paypal", "noreply@paypal", "noreply@deliveroo", "orders@deliveroo", "receipts@netflix.com", "info@account.netflix.com", "noreply@spotify.com", "noreply@google.com",
    "payments-noreply@google.com", "msa@communication.microsoft.com", "ebay@ebay.com", "orders@ebay.com", "transaction@ebay.com", "ebay@reply.ebay.com",
)
MARKETING_SENDERS = (
    "store-news@amazon", "deals@amazon", "recommendations@amazon", "marketing@", "promo@", "newsletter@", "deals@", "offers@", "sales@", "promotions@", "campaign@", "email@", "hello@",
    "newsletter@ebay", "promotions@ebay", "deals@ebay", "offers@ebay", "marketing@uber", "promo@uber", "promotions@uber", "deals@uber", "news@uber",
)
ORDER_NUMBER = r"(?i)(?:order|invoice|confirmation|booking|transaction)\s*(?:#|number|no\.?|id)?\s*[:.]?\s*[A-Z0-9-]{5,}"
#: Of the body, so many characters count for the score.
BODY_CHARS = 1000

FIELDS = ("subject", "sender", "body", "text")
LISTS = {
    "strong_receipt": ("text", STRONG_RECEIPT), "weak_receipt": ("text", WEAK_RECEIPT), "strong_marketing": ("text", STRONG_MARKETING), "weak_marketing": ("text", WEAK_MARKETING),
    "known": ("sender", RECEIPT_SENDERS), "pushy": ("sender", MARKETING_SENDERS), "refused": ("subject", (*SHIPPING_SUBJECTS, *BOOKING_SUBJECTS)), "bought": ("subject", BOUGHT_SUBJECTS),
}
#: What is told of a mail: the places of the answers in VERDICTS (-1 for none), and how many literals of each list it holds.
TOLD = ("gate", "importing", *LISTS)


def _looked_for() -> dict[tuple[str, str, str], int]:
    """The bit of each literal, by field and how it is tested."""
    wanted = [(field, "contains", x) for field, literals in LISTS.values() for x in literals]
    for gate in GATES:
        wanted += [("sender", "contains", x) for x in gate.words]
        wanted += [(field, "contains" if how == "lacks" else how, x) for _, _, conditions in gate.tests for field, how, literals in conditions for x in literals]
    return {key: 1 << k for k, key in enumerate(dict.fromkeys(wanted))}


BITS = _looked_for()


def mask(field: str, how: str, literals: Iterable[str]) -> int:
    """The bits that tell that one of the literals fits."""
    return sum({BITS[field, "contains" if how == "lacks" else how, x] for x in literals})


#: vendor, accept and confidence of everything that a gate can say.
VERDICTS = tuple((g.name, accept, confidence) for g in GATES for accept, confidence in [*((t[0], t[1]) for t in g.tests), *([g.rest] if g.rest is not None else [])])


class Machine:
    """The automata of the fields and the gates as masks, built once in a worker."""

    def __init__(self) -> None:
        self.search = {}
        for field in FIELDS:
            own = ahocorasick.Automaton()
            for literal in dict.fromkeys(x for f, _, x in BITS if f == field):
                anywhere, start, whole = (BITS.get((field, how, literal), 0) for how in ("contains", "starts", "equals"))
                own.add_word(literal, (len(literal), anywhere, anywhere | start, anywhere | start | whole))
            own.make_automaton()
            self.search[field] = own.iter
        self.lists = [mask(field, "contains", literals) for field, literals in LISTS.values()]
        gates, place = {}, 0
        for g in GATES:
            tests = [([(mask(*c), c[1] == "lacks") for c in conditions], place + k) for k, (_, _, conditions) in enumerate(g.tests)]
            place += len(tests) + (g.rest is not None)
            gates[g.name] = (mask("sender", "contains", g.words), tests, place - 1 if g.rest is not None else None)
        self.orders = [list(gates.values()), [gates[n] for n in IMPORT_ORDER]]

    def bits(self, texts: Sequence[str]) -> int:
        found = 0
        for field, text in zip(FIELDS, texts, strict=True):
            size = len(text)
            for end, (length, anywhere, start, whole) in self.search[field](text):
                found |= anywhere if end + 1 != length else whole if length == size else start
        return found

    @staticmethod
    def first(bits: int, gates: Sequence[tuple]) -> int:
        """The place of the first answer that holds."""
        for words, tests, rest in gates:
            if words and not bits & words:
                continue
            for conditions, place in tests:
                if all(bool(bits & m) != lacks for m, lacks in conditions):
                    return place
            if rest is not None:
                return rest
        return -1

    def told(self, texts: Sequence[str]) -> list[int]:
        bits = self.bits(texts)
        return [*(self.first(bits, g) for g in self.orders), *((bits & m).bit_count() for m in self.lists)]


@lru_cache(maxsize=1)
def machine() -> Machine:
    return Machine()


def _told(*columns: pa.Array) -> pa.Array:
    rows = zip(*(c.to_pylist() for c in columns), strict=True)
    told = np.array([machine().told(r) for r in rows], np.int32).reshape(-1, len(TOLD))
    return pa.StructArray.from_arrays([pa.array(told[:, k]) for k in range(len(TOLD))], names=list(TOLD))


def _low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def answer(place: Column) -> Column:
    """vendor, accept and confidence at a place of VERDICTS; null for none."""
    said = ", ".join(f"named_struct('vendor', '{v}', 'accept', {str(a).lower()}, 'confidence', {n}L)" for v, a, n in VERDICTS)
    return F.when(place >= 0, F.get(F.expr(f"array({said})"), place))


def judged(rows: DataFrame) -> DataFrame:
    """``rows`` (subject, sender, body, unsubscribe, markup) with ``gate``, ``likely`` (accept and confidence) and ``imported``. Texts may be null.

    For ``likely`` markup decides, then the gates, then senders, then the score of the words: strong marketing words reject unless the sender is known for receipts; from a score of 3 on a mail is a receipt,
    down from -2 marketing, and between them rejected at 50. A mail is ``imported`` unless it comes from a personal domain, is about shipping or a booking, or is refused by the gates that importing tries. Of the body the first BODY_CHARS characters count for the score, and all of it for the gates.
    """
    text = F.concat(_low(F.col("subject")), F.lit(" "), F.lower(F.substring(F.coalesce("body", F.lit("")), 1, BODY_CHARS)))
    told = F.arrow_udf(_told, ", ".join(f"{n} int" for n in TOLD))(_low(F.col("subject")), _low(F.col("sender")), _low(F.col("body")), text)
    out = rows.withColumn("__told", told).withColumn("__numbered", F.rlike(text, F.lit(ORDER_NUMBER)))
    t = lambda n: F.col(f"__told.{n}")
    gate, unknown = answer(t("gate")), t("known") == 0
    score = t("strong_receipt") * 2 + t("weak_receipt") - t("strong_marketing") * 3 - t("weak_marketing") + F.col("__numbered").cast("int") * 3 + F.when(unknown, 0).otherwise(2)
    # Exploding an array of one keeps the score from being computed anew in each of its uses.
    out = out.withColumn("__score", F.explode(F.array(score)))
    domain = F.when(F.contains("sender", F.lit("@")), F.lower(F.substring_index("sender", "@", -1))).otherwise("")
    refused = F.coalesce(domain.isin(*PERSONAL_DOMAINS) | ((domain == SHIPPING_DOMAIN) & (t("bought") == 0)), F.lit(False)) | (t("refused") > 0)
    says = lambda ok, points: F.struct(F.lit(ok).alias("accept"), points.cast("long").alias("confidence"))
    s = F.col("__score")
    sure = F.least(70 + F.abs(s) * 5, F.lit(95))
    likely = (
        F.when(F.coalesce("markup", F.lit(False)), says(True, F.lit(100)))
        .when(gate.isNotNull(), F.struct(gate["accept"].alias("accept"), gate["confidence"].alias("confidence")))
        .when((F.coalesce("unsubscribe", F.lit("")) != "") & unknown, says(False, F.lit(85)))
        .when(t("pushy") > 0, says(False, F.lit(90)))
        .when((t("strong_marketing") > 0) & unknown, says(False, F.lit(80)))
        .when(s >= 3, says(True, sure)).when(s <= -2, says(False, sure)).otherwise(says(False, F.lit(50)))
    )
    imported = ~refused & F.coalesce(answer(t("importing"))["accept"], F.lit(True))
    return out.withColumns({"gate": gate, "likely": likely, "imported": imported}).drop("__told", "__numbered", "__score")
