"""Registered queries: a Spark callable, its output columns and the SQL it must agree with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.catalog.roles_sql import CTES
from lonja.session import bound_tasks, tune
from lonja.sources.tpch import TpchStar, tpch_star

SPARK_TYPES = {"s": "string", "l": "bigint", "d": "double", "date": "date", "b": "boolean", "ts": "timestamp_ntz"}
SQL_TYPES = {"s": "VARCHAR", "l": "BIGINT", "d": "DOUBLE", "date": "DATE", "b": "BOOLEAN", "ts": "TIMESTAMP"}


class Catalog:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, columns: str, plan: Callable[[TpchStar], DataFrame], sql: str | None = None) -> None:
        """``columns`` is "name type, ..." with types s, l, d, date, b, ts."""
        fields = [tuple(part.split()) for part in columns.split(",")]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            star = tpch_star(tune(spark), sf_dir)
            bound_tasks(spark, star.largest_bytes())
            out = plan(star)
            return out.select(*[F.col(c).cast(SPARK_TYPES[t]).alias(c) for c, t in fields])

        assert name not in self.queries, name
        self.queries[name] = run
        if sql:
            self.sql[name] = oracle(sql, fields)


def oracle(sql: str, fields: list[tuple[str, str]]) -> str:
    """Put the needed role definitions in front of a SELECT and cast its columns to the declared types."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in CTES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    casts = ", ".join(f'CAST({c} AS {SQL_TYPES[t]}) AS {c}' for c, t in fields)
    ctes = [f"{n} AS ({CTES[n].strip()})" for n in needed] + [f"answer AS ({sql.strip()})"]
    return "WITH " + ",\n".join(ctes) + f"\nSELECT {casts} FROM answer"
