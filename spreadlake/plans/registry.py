"""Registered queries: a Spark callable, its output columns and, where SQL can say it, an oracle.

Every output column is declared once as ``name:kind``. The same declaration
shapes the Spark frame and wraps the oracle text, so both sides publish the
same names, types and rounding.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from spreadlake.plans import sqlviews
from spreadlake.plans.views import Views

KINDS = ("str", "date", "int", "bool", "num", "num0", "num2", "num3", "num4")


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Views], DataFrame]
    columns: tuple[tuple[str, str], ...]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def _columns(text: str) -> tuple[tuple[str, str], ...]:
    out = []
    for part in text.split():
        name, _, kind = part.partition(":")
        kind = kind or "str"
        if kind not in KINDS:
            raise ValueError(f"column {name}: unknown kind {kind!r}")
        out.append((name, kind))
    return tuple(out)


def query(name: str, columns: str, sql: str | None = None):
    """Register a builder under ``name``."""

    def wrap(build):
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")
        REGISTRY[name] = Query(name, build, _columns(columns), sql)
        return build

    return wrap


def _places(kind: str) -> int:
    return 6 if kind == "num" else int(kind[3:])


def present(df: DataFrame, columns) -> DataFrame:
    """The declared columns, in order, with published types."""
    out = []
    for name, kind in columns:
        c = F.col(name)
        if kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind == "int":
            c = c.cast("bigint")
        elif kind == "bool":
            c = c.cast("boolean")
        elif kind.startswith("num"):
            c = c.cast("double")
            c = F.round(F.when(~F.isnan(c), c), _places(kind)) + F.lit(0.0)
        else:
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)


def oracle(q: Query) -> str | None:
    if q.sql is None:
        return None
    out = []
    for column, kind in q.columns:
        name = f'"{column}"'
        if kind == "date":
            c = f"strftime(cast({name} as date), '%Y-%m-%d')"
        elif kind == "int":
            c = f"cast({name} as bigint)"
        elif kind == "bool":
            c = f"cast({name} as boolean)"
        elif kind.startswith("num"):
            c = (
                f"round(case when isnan(cast({name} as double)) then null "
                f"else cast({name} as double) end, {_places(kind)}) + 0.0"
            )
        else:
            c = f"cast({name} as varchar)"
        out.append(f"{c} as {name}")
    body = f"select {', '.join(out)} from (\n{q.sql.strip()}\n) published"
    return sqlviews.with_views(body)


def run(q: Query, spark, sf_dir: str) -> DataFrame:
    return present(q.build(Views(spark, sf_dir)), q.columns)
