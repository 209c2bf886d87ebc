"""Where queries are filed: by name, with the SQL that DuckDB can run on the same tables, if there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.model import Registry
from plumbline.plans import declared as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def file(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return file


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def repo(spark: SparkSession) -> Registry:
    return Registry.of(spark, D.repo_documents())


def live(spark: SparkSession) -> Registry:
    return Registry.of(spark, D.live_documents())


def rules(spark: SparkSession) -> Registry:
    return Registry.of(spark, D.rule_documents(), D.SECTIONS, D.ENDPOINTS)
