"""The queries that apply the library's operators to whole tables, and SQL of the same rows."""

from __future__ import annotations

from importlib import import_module

from .base import QUERIES, SQL

FLAGSHIP = "j08_purchase_match"

for _name in ("ledger", "matching", "describing", "rules", "enrichment", "texts", "mailbox", "receipts", "incremental", "feeds"):
    import_module(f"{__name__}.{_name}")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
