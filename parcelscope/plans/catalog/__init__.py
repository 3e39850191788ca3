"""Registered queries: each runs an operator over the whole driver tables, most with the same answer in SQL.

``query`` registers a function of the tables under a name that starts with its inventory id. The SQL text may
name driver tables, domain projections (``d_``) and shared steps (``o_``); the needed ones are put in front
as common table expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelscope.plans.driver_tables import PROJECTIONS, Tables

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
                 "embeddings", "pages", "benchmark", "labels", "conversations")


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Tables], DataFrame]
    sql: str | None
    covers: tuple[str, ...]


REGISTRY: dict[str, Query] = {}
STEPS: dict[str, str] = {name: text.format(**{table: table for table in DRIVER_TABLES})
                         for name, text in PROJECTIONS.items()}


def step(name: str, sql: str) -> None:
    """A shared step of the SQL answers."""
    if not name.startswith("o_") or name in STEPS:
        raise ValueError(f"bad or repeated step name {name}")
    STEPS[name] = sql


def query(name: str, covers: str = "", sql: str | None = None):
    def register(run: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        ids = (name.split("_", 1)[0], *covers.split())
        REGISTRY[name] = Query(name, run, sql, tuple(dict.fromkeys(ids)))
        return run

    return register


def with_steps(sql: str) -> str:
    """Put every step the text needs, in order of dependence, in front of it."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b[do]_\w+\b", text):
            if name in STEPS and name not in ordered:
                visit(STEPS[name])
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    if not ordered:
        return sql
    steps = ",\n".join(f"{name} AS ({STEPS[name]})" for name in ordered)
    return f"WITH {steps}\n{sql}"


def _plain(name: str, kind: T.DataType) -> Column:
    column = F.col(f"`{name}`")
    if isinstance(kind, T.DecimalType):
        return column.cast("double").alias(name)
    if isinstance(kind, T.DateType):
        return column.cast("string").alias(name)
    if isinstance(kind, T.TimestampType):
        return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(name)
    if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
        return column.cast("bigint").alias(name)
    if isinstance(kind, T.ArrayType):
        return F.array_join(column.cast("array<string>"), ",").alias(name)
    return column.alias(name)


def plain(df: DataFrame) -> DataFrame:
    """Plain column types for a report: numbers, text, booleans."""
    return df.select(*[_plain(field.name, field.dataType) for field in df.schema.fields])


def load() -> dict[str, Query]:
    """Import every catalogue module and return the registry."""
    from parcelscope.plans.catalog import (  # noqa: F401
        deals,
        extracts,
        flows,
        insight,
        lists,
        places,
        ranks,
        records,
        reports,
        watch,
    )

    return REGISTRY
