"""Operators for preparing training text at corpus scale, and their registered queries.

Every module holds one operator (a function from DataFrame to DataFrame with
its real outputs), the query that applies it to a driver table, and the SQL
twin where SQL can express it.  Nothing else in the library imports this
package.
"""

from __future__ import annotations

import importlib

MODULES = ["line_dedup", "html_text", "ngram_join", "mixing", "url_filter", "toxicity", "bpe", "licences",
           "quality", "exact_dedup", "knn_quality", "turn_repair", "manifest"]


def _collect(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(getattr(importlib.import_module(f"{__name__}.{name}"), attribute))
    return out


def all_queries() -> dict:
    return _collect("QUERIES")


def all_oracle_sql() -> dict:
    return _collect("ORACLE")
