"""SQL type strings: of catalogs, and of schema languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Scalar types of the model language by dialect (sqlserver, mysql, postgres).
SCALARS = {
    "String": ("nvarchar(max)", "varchar(191)", "text"),
    "Int": ("int", "int", "integer"),
    "BigInt": ("bigint", "bigint", "bigint"),
    "Float": ("float", "double", "double precision"),
    "Decimal": ("decimal(18,6)", "decimal(18,6)", "decimal(65,30)"),
    "Boolean": ("bit", "tinyint(1)", "boolean"),
    "DateTime": ("datetime2", "datetime", "timestamp"),
    "Bytes": ("varbinary(max)", "longblob", "bytea"),
    "Json": ("nvarchar(max)", "json", "jsonb"),
}
DIALECTS = ("sqlserver", "mysql", "postgres")


def scalar_type(name: str, dialect: str) -> str | None:
    """Type string of a model scalar, or None."""
    row = SCALARS.get(name)
    return row[DIALECTS.index(dialect)] if row else None


def scalar_type_column(name: Column, dialect: str) -> Column:
    """The same over a column, as a lookup in a literal map."""
    pairs = [F.lit(x) for k, v in SCALARS.items() for x in (k, v[DIALECTS.index(dialect)])]
    return F.element_at(F.create_map(*pairs), name)


def mysql_type(data_type: Column, length: Column, precision: Column, scale: Column) -> Column:
    """Length on character and binary types, precision and scale on decimals, else the bare type."""
    t = F.lower(data_type)
    sized = F.when(length.isNotNull(), F.concat(data_type, F.lit("("), length.cast("string"), F.lit(")"))).otherwise(data_type)
    decimal = F.when(precision.isNotNull(), F.concat(data_type, F.lit("("), precision.cast("string"), F.lit(","), F.coalesce(scale, F.lit(0)).cast("string"), F.lit(")"))).otherwise(data_type)
    return F.when(t.isin("varchar", "char", "binary", "varbinary"), sized).when(t.isin("decimal", "numeric"), decimal).otherwise(data_type)


def postgres_type(data_type: Column, udt: Column, length: Column, precision: Column, scale: Column) -> Column:
    """Short names for character types, precision on decimals, the underlying name of user-defined and array types."""
    t = F.lower(data_type)
    sized = lambda name: F.when(length.isNotNull(), F.concat(F.lit(f"{name}("), length.cast("string"), F.lit(")"))).otherwise(name)
    decimal = F.when(precision.isNotNull(), F.concat(data_type, F.lit("("), precision.cast("string"), F.lit(","), F.coalesce(scale, F.lit(0)).cast("string"), F.lit(")"))).otherwise(data_type)
    return (
        F.when(t == "character varying", sized("varchar")).when(t == "character", sized("char")).when(t.isin("numeric", "decimal"), decimal)
        .when(t.isin("user-defined", "array"), udt).otherwise(data_type)
    )


def sql_type(kind: T.DataType) -> str:
    """Type string of a Spark type, as a catalog would give it."""
    names = {"string": "varchar", "integer": "integer", "long": "bigint", "short": "smallint", "byte": "tinyint", "timestamp_ntz": "timestamp", "timestamp": "timestamptz", "binary": "blob"}
    if isinstance(kind, T.ArrayType):
        return f"{sql_type(kind.elementType)}[]"
    if isinstance(kind, T.DecimalType):
        return f"decimal({kind.precision},{kind.scale})"
    return names.get(kind.typeName(), kind.simpleString())
