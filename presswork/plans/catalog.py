"""Registered queries: each key pairs a Spark plan with its DuckDB oracle text.

``QueryParams`` holds the fixed parameters the checks run with (period, author,
section and country filters); every query reads the whole tables.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame

from presswork.params import Filters, Period, Settings


@dataclass(frozen=True)
class QueryParams:
    """Parameters of the registered checks. They are operator arguments, not data subsets:
    every query still reads all rows of every table it uses.

    The two-week period sits inside the data's month, so records before it (first SAVE
    before the period, T2) and after it both exist. The author is active at every scale.
    The country is given in lower case to exercise the case-insensitive match.
    """

    period: Period = Period(dt.date(2024, 1, 8), dt.date(2024, 1, 21))
    author: str = "customer#000000012"
    section: str = "section_3"
    country: str = "america"
    settings: Settings = field(default_factory=Settings)

    def filters(self, author=False, section=False, country=False) -> Filters:
        return Filters(self.author if author else None, self.section if section else None,
                       self.country if country else None)


@dataclass(frozen=True)
class Entry:
    key: str
    build: Callable  # (Tables, QueryParams) -> DataFrame
    sql: Callable | None  # (QueryParams) -> str
    note: str = ""


REGISTRY: dict[str, Entry] = {}


def register(key: str, sql: Callable | None = None, note: str = ""):
    def deco(fn):
        if key in REGISTRY:
            raise KeyError(f"duplicate query key {key}")
        REGISTRY[key] = Entry(key, fn, sql, note)
        return fn
    return deco


def all_entries() -> dict[str, Entry]:
    # importing the modules fills the registry
    from presswork.plans import queries  # noqa: F401

    return REGISTRY


def run(key: str, tables, params: QueryParams | None = None) -> DataFrame:
    return all_entries()[key].build(tables, params or QueryParams())
