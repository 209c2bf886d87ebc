"""Live snapshots (S9-S11, S14, J19, J20): from data files, and from catalogs over JDBC.

``from_parquet`` takes the schemas of data files as the live catalog.  ``from_rows``
assembles documents from catalog relations (tables and columns, keys, constraints),
however they were read: over JDBC with the queries of ``CATALOG_SQL``, whose filters
the database applies, or from frames in tests.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.types import mysql_type, postgres_type, sql_type
from plumbline.model import TABLE_DDL, Registry, table_document
from plumbline.operators.filters import catalog_schema_filter, of_table_type, without_system_schemas
from plumbline.sources.registry import ConfigError


def from_parquet(spark: SparkSession, folder: str, names: Sequence[str]) -> Registry:
    """The Parquet tables of a folder as a live snapshot; only footers are read."""
    docs = []
    for name in names:
        schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
        docs.append(table_document(name=name, fields=[{"name": f.name, "type": sql_type(f.dataType), "nullable": f.nullable} for f in schema.fields]))
    return Registry.of(spark, docs)


#: Columns that each catalog relation has, whatever it was read from.
COLUMNS = "table_schema string, table_name string, table_type string, ordinal int, column_name string, data_type string, udt_name string, length int, precision int, scale int, nullable boolean, default string"
KEYS = "table_schema string, table_name string, ordinal int, column_name string"
FOREIGN_KEYS = "table_schema string, table_name string, constraint_name string, source_field string, target_schema string, target_name string, target_field string, delete_rule string"
GENERATED = "table_schema string, table_name string, column_name string, expression string, extra string"
INDEX_COLUMNS = "table_schema string, table_name string, index_name string, ordinal int, column_name string, is_unique boolean, is_included boolean, filter string"
CHECKS = "table_schema string, table_name string, name string, expression string, columns array<string>"
#: What a PostgreSQL catalog has for INDEX_COLUMNS.
INDEX_KEYS = "table_schema string, table_name string, table_oid bigint, index_name string, attnums array<int>, n_keys int, is_unique boolean, filter string"
ATTRIBUTES = "table_oid bigint, attnum int, column_name string"
UNIQUE_COLUMNS = "table_schema string, table_name string, name string, ordinal int, column_name string"

_SYSTEM = "('pg_catalog', 'information_schema')"
#: Queries over the standard information schema, for a JDBC source.
CATALOG_SQL = {
    "postgres": {
        "columns": f"""SELECT c.table_schema, c.table_name, t.table_type, c.ordinal_position AS ordinal, c.column_name, c.data_type, c.udt_name,
            c.character_maximum_length AS length, c.numeric_precision AS precision, c.numeric_scale AS scale, c.is_nullable = 'YES' AS nullable, c.column_default AS "default"
            FROM information_schema.columns c JOIN information_schema.tables t USING (table_catalog, table_schema, table_name) WHERE c.table_schema NOT IN {_SYSTEM}""",
        "keys": f"""SELECT k.table_schema, k.table_name, k.ordinal_position AS ordinal, k.column_name FROM information_schema.table_constraints t
            JOIN information_schema.key_column_usage k USING (constraint_schema, constraint_name, table_name) WHERE t.constraint_type = 'PRIMARY KEY' AND k.table_schema NOT IN {_SYSTEM}""",
        "foreign_keys": f"""SELECT k.table_schema, k.table_name, k.constraint_name, k.column_name AS source_field, u.table_schema AS target_schema, u.table_name AS target_name, u.column_name AS target_field, r.delete_rule
            FROM information_schema.referential_constraints r
            JOIN information_schema.key_column_usage k ON k.constraint_schema = r.constraint_schema AND k.constraint_name = r.constraint_name
            JOIN information_schema.key_column_usage u ON u.constraint_schema = r.unique_constraint_schema AND u.constraint_name = r.unique_constraint_name AND u.ordinal_position = k.position_in_unique_constraint
            WHERE k.table_schema NOT IN {_SYSTEM}""",
        "generated": f"SELECT table_schema, table_name, column_name, generation_expression AS expression, 'STORED' AS extra FROM information_schema.columns WHERE is_generated = 'ALWAYS' AND table_schema NOT IN {_SYSTEM}",
        "index_keys": f"""SELECT n.nspname AS table_schema, t.relname AS table_name, x.indrelid::bigint AS table_oid, i.relname AS index_name, x.indkey::int2[]::int[] AS attnums, x.indnkeyatts::int AS n_keys, x.indisunique AS is_unique, pg_get_expr(x.indpred, x.indrelid) AS filter
            FROM pg_index x JOIN pg_class i ON i.oid = x.indexrelid JOIN pg_class t ON t.oid = x.indrelid JOIN pg_namespace n ON n.oid = t.relnamespace WHERE NOT x.indisprimary AND n.nspname NOT IN {_SYSTEM}""",
        "attributes": "SELECT attrelid::bigint AS table_oid, attnum::int AS attnum, attname AS column_name FROM pg_attribute WHERE attnum > 0 AND NOT attisdropped",
        "checks": f"""SELECT n.nspname AS table_schema, t.relname AS table_name, c.conname AS name, pg_get_expr(c.conbin, c.conrelid) AS expression,
            ARRAY(SELECT a.attname::text FROM pg_attribute a WHERE a.attrelid = c.conrelid AND a.attnum = ANY(c.conkey) ORDER BY a.attnum) AS columns
            FROM pg_constraint c JOIN pg_class t ON t.oid = c.conrelid JOIN pg_namespace n ON n.oid = t.relnamespace WHERE c.contype = 'c' AND n.nspname NOT IN {_SYSTEM}""",
        "unique_columns": f"""SELECT k.table_schema, k.table_name, k.constraint_name AS name, k.ordinal_position AS ordinal, k.column_name FROM information_schema.table_constraints t
            JOIN information_schema.key_column_usage k USING (constraint_schema, constraint_name, table_name) WHERE t.constraint_type = 'UNIQUE' AND k.table_schema NOT IN {_SYSTEM}""",
        "counts": "SELECT n.nspname AS table_schema, c.relname AS table_name, GREATEST(0, c.reltuples)::bigint AS n_rows FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace WHERE c.relkind = 'r'",
    },
    "mysql": {
        "columns": """SELECT c.table_schema, c.table_name, t.table_type, c.ordinal_position AS ordinal, c.column_name, c.data_type, NULL AS udt_name,
            c.character_maximum_length AS length, c.numeric_precision AS `precision`, c.numeric_scale AS scale, c.is_nullable = 'YES' AS nullable, c.column_default AS `default`
            FROM information_schema.columns c JOIN information_schema.tables t ON t.table_schema = c.table_schema AND t.table_name = c.table_name WHERE c.table_schema = DATABASE()""",
        "keys": "SELECT table_schema, table_name, ordinal_position AS ordinal, column_name FROM information_schema.key_column_usage WHERE constraint_name = 'PRIMARY' AND table_schema = DATABASE()",
        "foreign_keys": """SELECT k.table_schema, k.table_name, k.constraint_name, k.column_name AS source_field, k.referenced_table_schema AS target_schema, k.referenced_table_name AS target_name, k.referenced_column_name AS target_field, r.delete_rule
            FROM information_schema.key_column_usage k JOIN information_schema.referential_constraints r ON r.constraint_schema = k.constraint_schema AND r.constraint_name = k.constraint_name
            WHERE k.referenced_table_name IS NOT NULL AND k.table_schema = DATABASE()""",
        "generated": "SELECT table_schema, table_name, column_name, generation_expression AS expression, extra FROM information_schema.columns WHERE generation_expression IS NOT NULL AND table_schema = DATABASE()",
        "index_columns": "SELECT table_schema, table_name, index_name, seq_in_index - 1 AS ordinal, column_name, FALSE AS is_unique, FALSE AS is_included FROM information_schema.statistics WHERE non_unique = 1 AND column_name IS NOT NULL AND table_schema = DATABASE()",
        "checks": """SELECT t.table_schema, t.table_name, c.constraint_name AS name, c.check_clause AS expression FROM information_schema.check_constraints c
            JOIN information_schema.table_constraints t ON t.constraint_schema = c.constraint_schema AND t.constraint_name = c.constraint_name AND t.constraint_type = 'CHECK' WHERE t.table_schema = DATABASE()""",
        "unique_columns": """SELECT k.table_schema, k.table_name, k.constraint_name AS name, k.ordinal_position AS ordinal, k.column_name FROM information_schema.table_constraints t
            JOIN information_schema.key_column_usage k ON k.constraint_schema = t.constraint_schema AND k.constraint_name = t.constraint_name AND k.table_name = t.table_name WHERE t.constraint_type = 'UNIQUE' AND t.table_schema = DATABASE()""",
        "counts": "SELECT table_schema, table_name, table_rows AS n_rows FROM information_schema.tables WHERE table_schema = DATABASE()",
    },
}


def jdbc_relation(spark: SparkSession, url: str, provider: str, relation: str, **options: str) -> DataFrame:
    """One catalog relation over JDBC; needs the database's driver on the class path."""
    query = CATALOG_SQL[check_provider(provider)][relation]
    return spark.read.format("jdbc").options(url=url, query=query, queryTimeout="30", **options).load()


def check_provider(name: str | None) -> str:
    """Mysql (default) or postgres; others are refused."""
    found = {"mysql": "mysql", "postgres": "postgres", "postgresql": "postgres"}.get((name or "mysql").lower())
    if not found:
        raise ConfigError(f"provider {name} isn't supported; use mysql or postgres")
    return found


def postgres_index_columns(indexes: DataFrame, attributes: DataFrame, unique_names: DataFrame) -> DataFrame:
    """S10e: index columns by position from (index key arrays) and (attributes), as INDEX_COLUMNS.

    ``indexes`` has table_schema, table_name, table_oid, index_name, attnums (array), n_keys, is_unique, filter;
    ``attributes`` table_oid, attnum, column_name.  Columns past ``n_keys`` are included ones; indexes that serve a
    UNIQUE constraint of the same name, and those with expressions only, are left out.
    """
    own = indexes.join(unique_names, ["table_schema", "table_name", "index_name"], "left_anti")
    parts = own.select("*", F.posexplode("attnums").alias("ordinal", "attnum")).join(attributes, ["table_oid", "attnum"])
    return parts.select("table_schema", "table_name", "index_name", "ordinal", "column_name", "is_unique", (F.col("ordinal") >= F.col("n_keys")).alias("is_included"), "filter")


def _gathered(df: DataFrame, by: Sequence[str], order: str, value, name: str) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return df.groupBy(*by).agg(F.transform(pairs, lambda x: x["v"]).alias(name))


def from_rows(
    columns: DataFrame, keys: DataFrame, foreign_keys: DataFrame, generated: DataFrame, index_columns: DataFrame, checks: DataFrame, unique_columns: DataFrame,
    provider: str = "postgres", schemas: str | None = None, kind: str = "both",
) -> DataFrame:
    """Documents from catalog relations, each joined once after its own grouping.

    PostgreSQL tables are named schema.table and filtered by schema (P2); MySQL names
    have no schema and the filter is ignored.  Generated columns need a non-blank
    expression.
    """
    postgres = check_provider(provider) == "postgres"
    cols = of_table_type(without_system_schemas(columns), kind)
    cols = catalog_schema_filter(cols, schemas) if postgres else cols
    at = ["table_schema", "table_name"]
    made = generated.filter(F.trim(F.coalesce("expression", F.lit(""))) != "").select(*at, F.lower("column_name").alias("_c"), "expression", F.lit(True).alias("_made"), (F.lit(postgres) | F.contains(F.upper("extra"), F.lit("STORED"))).alias("_stored"))
    typed = postgres_type(F.col("data_type"), F.col("udt_name"), F.col("length"), F.col("precision"), F.col("scale")) if postgres else mysql_type(F.col("data_type"), F.col("length"), F.col("precision"), F.col("scale"))
    joined = cols.withColumn("_c", F.lower("column_name")).join(made, [*at, "_c"], "left")
    from pyspark.sql.types import StructType

    whole = StructType.fromDDL(TABLE_DDL)
    values = {
        "name": F.col("column_name"), "type": typed, "nullable": F.col("nullable"), "description": F.lit(""), "is_primary_key": F.lit(False), "is_match_column": F.lit(False),
        "default": F.col("default"), "is_computed": F.coalesce("_made", F.lit(False)), "computed_expression": F.col("expression"),
        "is_persisted": F.coalesce(F.col("_made") & F.col("_stored"), F.lit(False)), "is_deprecated": F.lit(False),
    }
    field = F.struct(*[values.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in whole["fields"].dataType.elementType.fields])
    docs = _gathered(joined, at, "ordinal", field, "fields")
    docs = docs.join(_gathered(keys, at, "ordinal", F.col("column_name"), "primary_key"), at, "left")
    target = F.concat_ws(".", "target_schema", "target_name") if postgres else F.col("target_name")
    fk = F.struct("source_field", target.alias("target_table"), "target_field", (F.upper("delete_rule") == "CASCADE").alias("cascade_delete"), F.lit("physical").alias("kind"))
    docs = docs.join(_gathered(foreign_keys, at, "constraint_name", fk, "foreign_keys"), at, "left")
    indexes = index_columns.groupBy(*at, "index_name").agg(
        F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_included"), F.struct("ordinal", "column_name")))), lambda x: x["column_name"]).alias("columns"), F.bool_or("is_unique").alias("is_unique"),
        F.max("filter").alias("filter"), F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("is_included"), F.struct("ordinal", "column_name")))), lambda x: x["column_name"]), ", "), F.lit("")).alias("included"),
    )
    index = F.struct(F.col("index_name").alias("name"), "columns", "is_unique", F.lit(False).alias("is_clustered"), F.col("filter").isNotNull().alias("is_filtered"), F.col("filter").alias("filter_expression"), F.col("included").alias("included_columns"), F.lit(None).cast("string").alias("description"))
    docs = docs.join(_gathered(indexes.filter("size(columns) > 0"), at, "index_name", index, "indexes"), at, "left")
    check = F.struct("name", "expression", F.when(F.size("columns") == 1, F.get("columns", F.lit(0))).alias("column"))
    docs = docs.join(_gathered(checks, at, "name", check, "check_constraints"), at, "left")
    uniques = _gathered(unique_columns, [*at, "name"], "ordinal", F.col("column_name"), "columns")
    docs = docs.join(_gathered(uniques, at, "name", F.struct("name", "columns"), "unique_constraints"), at, "left")
    name = F.concat_ws(".", "table_schema", "table_name") if postgres else F.col("table_name")
    docs = docs.withColumn("name", name)
    fixed = {"description": F.lit(""), "is_deprecated": F.lit(False), "is_reference_table": F.lit(False), "source_file": F.lit("")}

    def member(f) -> object:
        if f.name in docs.columns:
            c = F.col(f.name).cast(f.dataType)
        else:
            c = fixed.get(f.name, F.lit(None)).cast(f.dataType)
        return (F.coalesce(c, F.array().cast(f.dataType)) if f.dataType.typeName() == "array" else c).alias(f.name)

    return docs.select(*[member(f) for f in whole.fields])


def shaped(df: DataFrame, ddl: str) -> DataFrame:
    """A relation with the columns and types of ``ddl``; what it lacks is null."""
    from pyspark.sql.types import StructType

    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[f.name]}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(ddl).fields])


def introspect(read: Callable[[str], DataFrame], provider: str | None = None, schemas: str | None = None, kind: str = "both") -> Registry:
    """A live snapshot from ``read(relation)``, which gives the catalog relations of ``CATALOG_SQL``.

    Indexes that serve a UNIQUE constraint of the same name are told as constraints only.
    """
    found = check_provider(provider)
    rel = {n: shaped(read(n), d) for n, d in {"columns": COLUMNS, "keys": KEYS, "foreign_keys": FOREIGN_KEYS, "generated": GENERATED, "checks": CHECKS, "unique_columns": UNIQUE_COLUMNS}.items()}
    if found == "postgres":
        names = rel["unique_columns"].select("table_schema", "table_name", F.col("name").alias("index_name")).distinct()
        indexes = postgres_index_columns(shaped(read("index_keys"), INDEX_KEYS), shaped(read("attributes"), ATTRIBUTES), names)
    else:
        indexes = shaped(read("index_columns"), INDEX_COLUMNS)
    return Registry(from_rows(rel["columns"], rel["keys"], rel["foreign_keys"], rel["generated"], indexes, rel["checks"], rel["unique_columns"], found, schemas, kind))


def jdbc_catalog(spark: SparkSession, url: str, provider: str | None = None, **options: str) -> Callable[[str], DataFrame]:
    """``read`` for ``introspect`` over JDBC."""
    return lambda relation: jdbc_relation(spark, url, provider or "mysql", relation, **options)


def live_snapshot(connect: Callable[[], Registry] | None = None, folder: Callable[[], Registry] | None = None) -> Registry:
    """From a connection or a folder, exactly one of them."""
    if (connect is None) == (folder is None):
        raise ConfigError("give either a connection or an input folder")
    return (connect or folder)()
