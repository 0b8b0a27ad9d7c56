"""Collects the registered queries and SQL twins from every query module."""

from __future__ import annotations

import importlib

MODULES = ["q_profile", "q_clean", "q_features", "q_explore", "q_spectrum", "q_fit", "q_regress"]


def _mods():
    return [importlib.import_module(f"{__package__}.{m}") for m in MODULES]


def all_queries():
    out = {}
    for m in _mods():
        out.update(m.QUERIES)
    return out


def all_oracle_sql():
    out = {}
    for m in _mods():
        out.update(m.ORACLE)
    return out


def flagship(spark, sf):
    from ..plans.chain import lineitem_chain
    return lineitem_chain(spark, sf)
