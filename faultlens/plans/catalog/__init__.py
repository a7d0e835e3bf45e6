"""Registered queries: every operator over the given tables, with its SQL twin where SQL can say it."""

from __future__ import annotations

from faultlens.plans.catalog import answering, experiments, knowledge, preparing, searching, streams

MODULES = [preparing, searching, knowledge, answering, experiments, streams]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
