"""Helpers that every operator of this package shares."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plumbline.shared import checkpointed, removed, shared_folder  # noqa: F401  the operators take them from here

A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_hash(df: DataFrame, salt: str) -> Column:
    """A hash of all plain columns of a row, by which rows (not texts) are drawn."""
    plain = ("string", "tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp", "timestamp_ntz", "binary")
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if kind in plain or kind.startswith("decimal")], F.lit(salt))


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null id: null)."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def by_batch(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], dict]],
    schema: str,
) -> DataFrame:
    """``mapInArrow`` with set-up once a task.

    ``make()`` runs on the executor and returns a function from a record batch
    to columns in the order of ``schema``: Arrow arrays as they are, or lists and
    numpy arrays that get the schema's type.
    """
    kinds = [f.type for f in to_arrow_schema(StructType.fromDDL(schema))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("OMP_NUM_THREADS", "1")
        os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
        work = make()
        for batch in batches:
            if batch.num_rows:
                columns = work(batch)
                arrays = [v if isinstance(v, pa.Array) else pa.array(v, kind) for v, kind in zip(columns.values(), kinds)]
                yield pa.RecordBatch.from_arrays(arrays, list(columns))

    return df.mapInArrow(run, schema)


def ddl(df: DataFrame, *cols: str) -> str:
    """DDL of some columns of a frame, quoted, in the given order."""
    types = dict(df.dtypes)
    return ", ".join(f"`{c}` {types[c]}" for c in cols)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have yet (in any case)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name
