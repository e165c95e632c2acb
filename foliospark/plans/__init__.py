"""The engine's registered queries and the SQL they are held against."""

from __future__ import annotations

from foliospark.plans import catalogue, drafts, lexical, pages, references, scoring

MODULES = [references, catalogue, lexical, scoring, pages, drafts]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
