"""Named queries over the given tables, each with the SQL that checks it.

Role tables (facilities, traffic, rates, ...) are cut from the given tables by a
SQL text that both engines run, so a query and its check start from the same
rows; the work of the query itself is done by the library on one side and by
plain SQL on the other.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyledger.session import SETTINGS, settle

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ROLES: dict[str, str] = {}
SETTLED: set[str] = set()


class Tables:
    """Lazy access to the given tables and the role tables, as attributes."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path, self._made = spark, path, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in ROLES:
                needs = {n: getattr(self, n) for n in references(ROLES[name])}
                made = self._spark.sql(ROLES[name], **needs)
                self._made[name] = settle(made, name) if name in SETTLED else made
            elif name in TABLES:
                self._made[name] = self._spark.read.parquet(f"{self._path}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self._made[name]


def references(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def role(name: str, sql: str, settled: bool = False) -> None:
    """Name a role table; a ``settled`` one is written once, as several steps read it or its size must be known."""
    ROLES[name] = sql
    if settled:
        SETTLED.add(name)


def oracle_text(sql: str) -> str:
    """Replace ``{name}`` by the table name, with the roles in use as CTEs in front."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in ROLES and name not in order:
            for n in references(ROLES[name]):
                visit(n)
            order.append(name)

    for n in references(sql):
        visit(n)
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", text)
    ctes = [f"{n} AS (\n{plain(ROLES[n])}\n)" for n in order]
    body = plain(sql).strip()
    if not ctes:
        return body
    if body[:4].upper() == "WITH":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[4:].lstrip()
    return "WITH " + ",\n".join(ctes) + "\n" + body


def query(name: str, sql: str | None = None):
    """Register ``fn(t: Tables) -> DataFrame`` under a name."""
    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, path: str) -> DataFrame:
            for key in ("spark.sql.adaptive.forceOptimizeSkewedJoin", "spark.sql.session.timeZone", "spark.sql.requireAllClusterKeysForCoPartition"):
                spark.conf.set(key, SETTINGS[key])
            return fn(Tables(spark, path))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle_text(sql)
        return fn
    return add
