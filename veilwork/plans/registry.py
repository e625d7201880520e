"""All registered queries of the core and the SQL that states the same result."""

from __future__ import annotations

from importlib import import_module

from veilwork.plans.base import long_counts

FAMILIES = ["detection", "suppression", "fusion", "deidentification", "storage", "evaluation", "curation", "ingestion", "streams", "references"]


def _collect(what: str):
    out = {}
    for f in FAMILIES:
        out |= getattr(import_module(f"veilwork.plans.{f}"), what)()
    return out


def queries():
    return _collect("queries")


def oracle_sql():
    return {name: long_counts(sql) for name, sql in _collect("oracle_sql").items()}
