"""Where the catalogues note their queries and oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers the decorated (spark, sf_dir) -> DataFrame under name, with its SQL where there is one."""

    def note(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = make
        if oracle:
            ORACLES[name] = oracle
        return make

    return note
