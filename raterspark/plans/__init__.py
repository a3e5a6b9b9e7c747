"""Registered queries over the driver tables and their SQL oracles.

Each plan module exposes ``QUERIES`` (name -> callable(spark, sf_dir) -> DataFrame) and
``ORACLE`` (name -> SQL text over the same tables). Queries without an oracle entry are
not expressible in plain SQL and are checked against brute force in ``tests/``.
"""

from __future__ import annotations

import importlib

_MODULES = [
    "raterspark.plans.votes",
    "raterspark.plans.ratings",
    "raterspark.plans.linkage_q",
    "raterspark.plans.coverage",
    "raterspark.plans.requests_q",
    "raterspark.plans.files_q",
]


def all_queries() -> dict:
    out: dict = {}
    for name in _MODULES:
        out.update(importlib.import_module(name).QUERIES)
    return out


def all_oracles() -> dict:
    out: dict = {}
    for name in _MODULES:
        out.update(importlib.import_module(name).ORACLE)
    return out
