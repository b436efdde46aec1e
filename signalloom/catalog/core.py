"""Registry of queries, each with its output columns and, where possible, SQL.

A column spec such as ``"edf_id n:l auc:6"`` names the output columns and how
both sides present them: ``name`` or ``name:s`` text, ``:l`` 64-bit integer,
``:N`` double rounded to N places.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple((token + ":s").split(":")[:2]) for token in spec.split()]


def present(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for name, kind in _columns(spec):
        col = F.col(name)
        if kind == "s":
            col = col.cast("string")
        elif kind == "l":
            col = col.cast("bigint")
        else:
            col = F.round(col.cast("double"), int(kind)) + F.lit(0.0)
        out.append(col.alias(name))
    return df.select(*out)


def _present_sql(spec: str, sql: str) -> str:
    out = []
    for name, kind in _columns(spec):
        if kind == "s":
            expr = f'CAST("{name}" AS VARCHAR)'
        elif kind == "l":
            expr = f'CAST("{name}" AS BIGINT)'
        else:
            expr = f'round(CAST("{name}" AS DOUBLE), {kind}) + 0.0'
        out.append(f'{expr} AS "{name}"')
    return f"SELECT {', '.join(out)} FROM ({sql}) AS answer"


def _needed(sql: str) -> list[str]:
    """Views used by a statement, each after the views it uses itself."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_\w+", text):
            if name in VIEWS and name not in found:
                visit(VIEWS[name])
                found.append(name)

    visit(sql)
    return found


def oracle(spec: str, sql: str) -> str:
    body = _present_sql(spec, sql.strip())
    views = _needed(body)
    if not views:
        return body
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in views) + "\n" + body


def query(name: str, spec: str, sql: str | None = None):
    """Register a query; without ``sql`` the driver can only count its rows."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(spark, sf_dir), spec)

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql:
            ORACLES[name] = oracle(spec, sql)
        return fn

    return register
