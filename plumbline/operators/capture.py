"""Capturing small reference tables with their rows (S9h, S12, S13, A12, F15, F16)."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import iso_timestamp
from plumbline.operators.filters import reference_tables

MAX_ROWS, MAX_KB = 100, 1024
log = logging.getLogger(__name__)


def json_value(name: str, kind: T.DataType) -> Column:
    """a column as what its JSON value is written from."""
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return iso_timestamp(c)
    if isinstance(kind, T.BinaryType):
        return F.base64(c)
    if isinstance(kind, (T.BooleanType, T.NumericType, T.StringType, T.ArrayType, T.MapType, T.StructType)):
        return c
    return c.cast("string")


def json_rows(rows: DataFrame) -> DataFrame:
    """Rows as one ``json`` column, nulls kept."""
    values = [json_value(f.name, f.dataType).alias(f.name) for f in rows.schema.fields]
    return rows.select(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}).alias("json"))


def serialized_size(rows: DataFrame) -> DataFrame:
    """(n_rows, n_chars) of the rows written as one JSON list."""
    out = json_rows(rows).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.length("json")), F.lit(0)).alias("c"))
    return out.select("n_rows", (F.col("c") + F.greatest(F.col("n_rows") - 1, F.lit(0)) + 2).alias("n_chars"))


def capture_rows(rows: DataFrame, keys: Sequence[str], max_kb: int = MAX_KB) -> DataFrame:
    """(row_index, json) in key order; nothing if the list is over ``max_kb``.

    The size is known before anything is ordered: it is one aggregate, joined as a
    single row.  Meant for tables that passed the row gate, whose order fits a task.
    """
    from pyspark.sql import Window

    allowed = serialized_size(rows).filter(F.col("n_chars") <= max_kb * 1024).select(F.lit(1).alias("_ok"))
    place = F.row_number().over(Window.orderBy(*keys)) - 1
    values = [json_value(f.name, f.dataType).alias(f.name) for f in rows.schema.fields]
    listed = rows.select(place.alias("row_index"), F.to_json(F.struct(*values), {"ignoreNullFields": "false"}).alias("json"))
    return listed.withColumn("_one", F.lit(1)).join(F.broadcast(allowed), F.col("_one") == F.col("_ok"), "left_semi").drop("_one")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n_rows), exact."""
    from plumbline.model import union_all

    return union_all([df.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows")) for name, df in tables.items()])


def enrich(tables: dict[str, DataFrame], keys: dict[str, Sequence[str]], explicit: Sequence[str] = (), globs: Sequence[str] = ("*",), max_rows: int = MAX_ROWS, max_kb: int = MAX_KB) -> DataFrame:
    """(name, row_index, json) of the detected reference tables, counts and sizes gated.

    A table without a key is taken in the order of all its columns.  What can't be read
    degrades: a table whose count fails counts as one of unknown size, one whose rows
    fail is left out; both are logged.
    """
    from plumbline.model import union_all

    spark = next(iter(tables.values())).sparkSession if tables else None
    if spark is None:
        raise ValueError("no tables")
    names = spark.createDataFrame([(n,) for n in tables], "name string")
    counts = spark.createDataFrame([(n, _degraded(f"count of {n}", tables[n].count)) for n in tables], "name string, n_rows long")
    found = reference_tables(names, counts, explicit, globs, max_rows).filter("is_reference")
    parts = []
    for n in sorted(r["name"] for r in found.select("name").collect()):  # one row a table
        read = lambda n=n: capture_rows(tables[n], keys.get(n) or tables[n].columns, max_kb).collect()  # noqa: E731  max_kb at most
        if rows := _degraded(f"rows of {n}", read):
            parts.append(spark.createDataFrame([(n, r["row_index"], r["json"]) for r in rows], "name string, row_index int, json string"))
    return union_all(parts) if parts else spark.createDataFrame([], "name string, row_index int, json string")


def _degraded(what: str, read: Callable[[], object]) -> object:
    """What ``read`` gives, or None with a warning where Spark can't read it."""
    try:
        return read()
    except (PySparkException, Py4JError) as e:
        log.warning("%s: %s", what, str(e).partition("\n")[0])
        return None
