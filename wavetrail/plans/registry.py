"""Registration of queries next to the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wavetrail.session import prepare
from wavetrail.sources.bindings import VIEW_SQL, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: str = ""):
    """Register ``fn(views) -> DataFrame`` under ``name``.

    ``sql`` is the final SELECT, ``ctes`` further comma-separated CTEs; the
    bound views (``ev``, ``gr``, ``tg`` ...) are in scope for both.
    """

    def wrap(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Views(prepare(spark), sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            parts = ",\n".join([VIEW_SQL.strip()] + ([ctes.strip()] if ctes.strip() else []))
            ORACLES[name] = f"WITH {parts}\n{sql.strip()}"
        return fn

    return wrap
