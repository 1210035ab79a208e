"""The register of queries and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from glyphmill.session import tune

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    item: str
    build: Builder
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, item: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a query under ``name`` for inventory item ``item``."""

    def add(build: Builder) -> Builder:
        if name in CATALOG:
            raise ValueError(f"query registered twice: {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(tune(spark), sf_dir)

        CATALOG[name] = Query(name, item, run, sql)
        return build

    return add
