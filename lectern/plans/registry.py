"""Queries over the reference tables and their SQL."""

from __future__ import annotations

from lectern.plans import checks, citing, records, rules, shapes, texts

MODULES = (records, checks, citing, texts, rules, shapes)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
FLAGSHIP = "reconciled_records"
