"""Queries over documents, parsers, catalogs and reports, and their SQL.

Most results are registries taken apart into rows (part, table_name, ordinal, name,
value), so that whole documents can be held against SQL over the literals they were
made from.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.model import Registry, frame, table_document, union_all
from plumbline.operators import capture, filters, graph, merge, validate
from plumbline.plans import declared as D
from plumbline.plans.register import live, query, read, repo
from plumbline.shared import put_text, shared_folder
from plumbline.sources import catalog as live_catalog

ROWS = "part VARCHAR, table_name VARCHAR, ordinal INTEGER, name VARCHAR, value VARCHAR"


def unnested(r: Registry) -> DataFrame:
    """(part, table_name, ordinal, name, value) of every member that a registry's documents hold."""

    def part(df: DataFrame, kind: str, ordinal, name, *values) -> DataFrame:
        text = F.concat_ws("|", *[F.coalesce(v.cast("string"), F.lit("")) for v in values]) if values else F.lit("")
        return df.select(F.lit(kind).alias("part"), "table_name", ordinal.cast("int").alias("ordinal"), name.alias("name"), text.alias("value"))

    c, at = F.col, F.col("ordinal")
    data = r.ref_rows.select("table_name", "row_index", F.explode("row"))
    uniques = r.uniques.select("table_name", "name", F.explode("columns").alias("column"))
    return union_all(
        [
            part(r.fields, "field", at, c("name"), c("type"), c("nullable"), c("default"), c("is_computed"), c("computed_expression"), c("is_persisted"), c("is_match_column"), c("is_deprecated"), c("sensitivity"), c("description")),
            part(r.primary_keys, "pk", at, c("name")),
            part(r.foreign_keys, "fk", at, c("source_field"), F.concat_ws(".", "target_table", "target_field"), c("kind"), c("cascade_delete")),
            part(r.indexes, "index", at, c("name"), F.array_join("columns", ","), c("is_unique")),
            part(r.checks, "check", F.lit(0), c("name"), c("column")),
            part(uniques, "unique", F.lit(0), c("name"), c("column")),
            part(r.table_sections, "section", F.lit(0), c("section")),
            part(data, "data", c("row_index"), c("key"), c("value")),
        ]
    )


_ALL = ("fields", "pks", "fks", "indexes", "checks", "uniques", "memberships", "data")


def _unnested_sql(prefix: str = "", **instead: str) -> str:
    """The same over literal relations; ``instead`` gives another body for a part."""
    p = prefix
    parts = {
        "field": f"SELECT 'field' AS part, table_name, ordinal, name, concat_ws('|', type, CAST(nullable AS VARCHAR), coalesce(dflt, ''), CAST(is_computed AS VARCHAR), coalesce(computed_expression, ''), CAST(is_persisted AS VARCHAR), CAST(is_match_column AS VARCHAR), CAST(is_deprecated AS VARCHAR), coalesce(sensitivity, ''), coalesce(description, '')) AS value FROM {p}fields",
        "pk": f"SELECT 'pk' AS part, table_name, ordinal, name, '' AS value FROM {p}pks",
        "fk": f"SELECT 'fk' AS part, table_name, ordinal, source_field AS name, concat_ws('|', target_table || '.' || target_field, kind, CAST(cascade_delete AS VARCHAR)) AS value FROM {p}fks",
        "index": f"SELECT 'index' AS part, table_name, ordinal, name, array_to_string(columns, ',') || '|' || CAST(is_unique AS VARCHAR) AS value FROM {p}indexes",
        "check": f"SELECT 'check' AS part, table_name, 0 AS ordinal, name, coalesce(col, '') AS value FROM {p}checks",
        "unique": f"SELECT 'unique' AS part, table_name, 0 AS ordinal, name, col AS value FROM {p}uniques",
        "section": f"SELECT 'section' AS part, table_name, 0 AS ordinal, section AS name, '' AS value FROM {p}memberships",
        "data": f"SELECT 'data' AS part, table_name, row_index AS ordinal, k AS name, v AS value FROM {p}data",
    } | instead
    return " UNION ALL ".join(f"({v})" for v in parts.values() if v)


def _expected(columns: str, rows: list[tuple]) -> str:
    return f"WITH {D.cte('x', columns, rows)} SELECT * FROM x"


# Registries of JSON files

#: A registry as files: path -> text.  Only the first two, and the section, are documents of it.
_FILES = {
    "registry/sales/Tables/a_cust.json": '﻿{"name": "app.Cust", "FIELDS": [{"name": "id", "TYPE": "int"}, {"name": "score", "type": "decimal(4,2)", "nullable": true, "default": "0"}], "primaryKey": ["id"], "isReferenceTable": true, "data": [{"id": 1, "score": 1.50}, {"id": 2, "score": null}], "unknownMember": 7}',
    "registry/tables/b_orders.json": '{"name": "app.Orders", "fields": [{"name": "id", "type": "int"}, {"name": "cust", "type": "int"}], "primaryKey": ["id"], "foreignKeys": [{"sourceField": "cust", "targetTable": "app.Cust", "targetField": "id", "soft": true}, {"sourceField": "id", "targetTable": "app.Cust", "targetField": "id", "kind": "Physical", "cascadeDelete": true}, {"sourceField": "id", "targetTable": "app.Cust", "targetField": "id", "soft": false}], "sections": ["Core"]}',
    "registry/tables/Archive/old.json": "not even JSON",
    "registry/views/v.json": '{"name": "app.V", "fields": []}',
    "registry/tables/readme.txt": "text",
    "sections/core.json": '{"name": "Core", "title": "Core tables", "tables": ["app.Orders", "app.Cust"], "isModule": true}',
}
_FILE_ROWS = [
    ("file", "app.Cust", 0, "registry/sales/Tables/a_cust.json", ""), ("file", "app.Orders", 1, "registry/tables/b_orders.json", ""),
    ("field", "app.Cust", 0, "id", "int|false||false||false|false|false||"), ("field", "app.Cust", 1, "score", "decimal(4,2)|true|0|false||false|false|false||"),
    ("pk", "app.Cust", 0, "id", ""), ("data", "app.Cust", 0, "id", "1"), ("data", "app.Cust", 0, "score", "1.50"), ("data", "app.Cust", 1, "id", "2"), ("data", "app.Cust", 1, "score", "null"),
    ("field", "app.Orders", 0, "id", "int|false||false||false|false|false||"), ("field", "app.Orders", 1, "cust", "int|false||false||false|false|false||"), ("pk", "app.Orders", 0, "id", ""),
    ("fk", "app.Orders", 0, "cust", "app.Cust.id|logical|false"), ("fk", "app.Orders", 1, "id", "app.Cust.id|physical|true"), ("fk", "app.Orders", 2, "id", "app.Cust.id|physical|false"),
    ("section", "app.Orders", 0, "Core", ""), ("member", "app.Orders", 0, "Core", "Core tables"), ("member", "app.Cust", 1, "Core", "Core tables"),
]


@query(_expected(ROWS, _FILE_ROWS))
def json_registry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry read from files, with a skipped folder, a broken file in it, and files that are no documents."""
    from plumbline.sources.registry import load_registry, scan_json

    root = f"{shared_folder(spark)}/registry-{uuid.uuid4().hex}"
    for path, text in _FILES.items():
        put_text(spark, f"{root}/{path}", text)
    r = load_registry(spark, f"{root}/registry", f"{root}/sections", ["archive"])
    assert scan_json(spark, f"{root}/nowhere").isEmpty()
    inside = F.substring_index("source_file", f"{root.rpartition('/')[2]}/", -1)
    files = r.documents.select(F.col("name").alias("table_name"), inside.alias("name"))
    place = (F.row_number().over(T.ordered("name")) - 1).cast("int")
    files = files.select(F.lit("file").alias("part"), "table_name", place.alias("ordinal"), "name", F.lit("").alias("value"))
    members = r.section_tables.select(F.lit("member").alias("part"), "table_name", F.col("ordinal").cast("int").alias("ordinal"), F.col("section").alias("name"), F.col("title").alias("value"))
    return union_all([unnested(r), files, members])


@query(f"WITH {D.ctes('', D.repo_documents() + D.rule_documents(), *_ALL, 'tables')} SELECT * FROM ({_unnested_sql()}) WHERE part <> 'data' OR table_name IN (SELECT name FROM tables WHERE is_reference_table)")
def registry_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written as registry JSON and read again."""
    from plumbline.sinks.writers import document_json, documents_of
    from plumbline.sources.registry import decode

    docs = documents_of(Registry.of(spark, D.repo_documents() + D.rule_documents()))
    return unnested(Registry.of(spark, [decode(d["source_file"], document_json(d), ("name",)) for d in docs]))


@query(f"WITH {D.ctes('', D.repo_documents(), 'tables')} SELECT CAST(row_number() OVER (ORDER BY lower(name)) - 1 AS INTEGER) AS ordinal, name AS table_name, 'All Tables' AS section FROM tables")
def all_tables_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: the generated section of all tables, as written."""
    from plumbline.sinks.writers import all_tables_section as section_of
    from plumbline.sinks.writers import section_json

    doc = json.loads(section_json(section_of(repo(spark))))
    return frame(spark, [{"ordinal": i, "table_name": t, "section": doc["name"]} for i, t in enumerate(doc["tables"])], "ordinal int, table_name string, section string")


_CONFIG = """{
  // comments and trailing commas are allowed
  "Paths": {"tables": "db/tables", "DocumentSections": ["a", "b",],},
  /* "nothing": 1, */
  "output": {"Format": {"type": "DBML", "Dialect": "x // no comment"}},
  "referenceTables": {"maxRows": 50},
}"""


@query(_expected("path VARCHAR, value VARCHAR", [("paths.tables", "db/tables"), ("paths.documentsections.0", "a"), ("paths.documentsections.1", "b"), ("output.format.type", "DBML"), ("output.format.dialect", "x // no comment"), ("referencetables.maxrows", "50")]))
def config_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A config document by path; names in lower case."""
    from plumbline.sources.registry import parse_config

    def walk(value, path: str):
        pairs = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else None
        if pairs is None:
            yield path.lstrip("."), str(value)
        else:
            for k, v in pairs:
                yield from walk(v, f"{path}.{k}")

    return spark.createDataFrame(list(walk(parse_config(_CONFIG), "")), "path string, value string")


# Model files


@query(f"""WITH {D.ctes('', D.repo_documents(), *_ALL)}, keyed AS (SELECT f.*, EXISTS (SELECT 1 FROM pks p WHERE p.table_name = f.table_name AND lower(p.name) = lower(f.name)) AS pk FROM fields f) {
    _unnested_sql(
        field="SELECT 'field' AS part, table_name, ordinal, name, concat_ws('|', type, CAST(nullable AND NOT pk AS VARCHAR), '', CAST(is_computed AS VARCHAR), coalesce(computed_expression, ''), CAST(is_persisted AS VARCHAR), 'false', 'false', '', coalesce(description, '')) AS value FROM keyed",
        pk="SELECT 'pk' AS part, table_name, CAST(row_number() OVER (PARTITION BY table_name ORDER BY ordinal) - 1 AS INTEGER) AS ordinal, name, '' AS value FROM keyed WHERE pk",
        fk="SELECT 'fk' AS part, table_name, ordinal, source_field AS name, concat_ws('|', target_table || '.' || target_field, kind, 'false') AS value FROM fks",
        index="", check="", unique="", section="", data="",
    )}""")
def dbml_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repo as DBML, parsed again; what DBML has no place for is lost."""
    from plumbline.sinks import render
    from plumbline.sources.dbml import parse_dbml

    return unnested(Registry.of(spark, parse_dbml(render.document_database(repo(spark), "dbml")).tables))


_DBML = r"""
// a comment
Table "app.Order Lines" [headercolor: #fff] {
  id int [pk, not null]
  "qty" decimal(10,2) [not null, default: 0, note: 'How many; // calculated: (a * b) PERSISTED']
  price money [null, ref: > x.y, note: "in \"EUR\""]
  Note: '''Lines of
orders'''
  indexes {
    (id, qty) [unique]
  }
}
Table Cust {
  key varchar(10) [primary key]
  parent varchar(10)
}
Ref: "app.Order Lines".id > Cust.key // logical
Ref named: Cust.key < "app.Order Lines"."price"
Ref: Cust.parent - Cust.key // VIRTUAL
Ref: Cust.key <> Cust.parent
Ref: nowhere.x > Cust.key
TableGroup sales {
  Cust
  "app.Order Lines"
}
"""
_DBML_ROWS = [
    ("field", "app.Order Lines", 0, "id", "int|false||false||false|false|false||"), ("field", "app.Order Lines", 1, "qty", "decimal(10,2)|false||true|a * b|true|false|false||How many"), ("field", "app.Order Lines", 2, 'price', 'money|true||false||false|false|false||in "EUR"'),
    ("pk", "app.Order Lines", 0, "id", ""), ("field", "dbo.Cust", 0, "key", "varchar(10)|false||false||false|false|false||"), ("field", "dbo.Cust", 1, "parent", "varchar(10)|true||false||false|false|false||"), ("pk", "dbo.Cust", 0, "key", ""),
    ("fk", "app.Order Lines", 0, "id", "dbo.Cust.key|logical|false"), ("fk", "app.Order Lines", 1, "price", "dbo.Cust.key|physical|false"), ("fk", "dbo.Cust", 0, "parent", "dbo.Cust.key|virtual|false"),
    ("member", "Cust", 0, "sales", ""), ("member", "app.Order Lines", 1, "sales", ""),
    ("error", "", 0, "Could not parse Ref", ""), ("error", "", 1, "Ref refers to unknown table 'dbo.nowhere'", ""),
]


def _parsed(spark: SparkSession, found) -> DataFrame:
    """A parsed model as rows, with its groups' members and its errors (up to a colon)."""
    registry = Registry.of(spark, [*found.tables, *found.enums], found.sections)
    more = [("member", t, i, s["name"], "") for s in found.sections for i, t in enumerate(s["tables"])]
    more += [("error", "", i, e.partition(":")[0], "") for i, e in enumerate(found.errors)]
    return unnested(registry).unionByName(spark.createDataFrame(more, "part string, table_name string, ordinal int, name string, value string"))


@query(_expected(ROWS, _DBML_ROWS))
def dbml_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7a-S7f/J21: a DBML text with every kind of reference, quoting, notes, groups and errors."""
    from plumbline.sources.dbml import parse_dbml

    return _parsed(spark, parse_dbml(_DBML, "dbo"))


_PRISMA = """
datasource db {
  provider     = "postgresql"
  relationMode = "prisma"
}
enum Color { 
  RED
  GREEN
}
model User {
  id      Int      @id @default(autoincrement())
  name    String?  @db.VarChar(40)
  color   Color    @default(RED)
  score   Float    @default(1.5)
  note    String   @default("a b") // text
  tags    Json
  posts   Post[]
  raw     Unsupported("circle")?
  odd     Strange
  @@unique([name, color])
  @@map("users")
}
model Post {
  a        BigInt
  b        Int       @unique
  amount   Decimal   @db.Decimal(10, 2)
  at       DateTime  @default(now()) @db.Timestamp(3)
  flag     Boolean   @default(true)
  authorId Int
  author   User      @relation("x", fields: [authorId], references: [id], onDelete: Cascade)
  twinA    BigInt
  twinB    Int
  twin     Post?     @relation(fields: [twinA, twinB], references: [a, b])
  @@id([a, b])
  @@index([authorId, at])
  @@index([flag], name: "by_flag")
}
"""
_PRISMA_FIELD = lambda t, i, n, kind, null=False, default="": ("field", t, i, n, f"{kind}|{str(null).lower()}|{default}|false||false|false|false||")
_PRISMA_ROWS = [
    _PRISMA_FIELD("app.users", 0, "id", "integer"), _PRISMA_FIELD("app.users", 1, "name", "varchar(40)", True), _PRISMA_FIELD("app.users", 2, "color", "text", default="RED"), _PRISMA_FIELD("app.users", 3, "score", "double precision", default="5"),
    _PRISMA_FIELD("app.users", 4, "note", "text", default="a b"), _PRISMA_FIELD("app.users", 5, "tags", "jsonb"), _PRISMA_FIELD("app.users", 6, "raw", "circle", True), _PRISMA_FIELD("app.users", 7, "odd", "Strange"),
    ("pk", "app.users", 0, "id", ""), ("unique", "app.users", 0, "uq_name_color", "name"), ("unique", "app.users", 0, "uq_name_color", "color"),
    _PRISMA_FIELD("app.Post", 0, "a", "bigint"), _PRISMA_FIELD("app.Post", 1, "b", "integer"), _PRISMA_FIELD("app.Post", 2, "amount", "decimal(10, 2)"), _PRISMA_FIELD("app.Post", 3, "at", "timestamp"), _PRISMA_FIELD("app.Post", 4, "flag", "boolean", default="true"),
    _PRISMA_FIELD("app.Post", 5, "authorId", "integer"), _PRISMA_FIELD("app.Post", 6, "twinA", "bigint"), _PRISMA_FIELD("app.Post", 7, "twinB", "integer"), ("pk", "app.Post", 0, "a", ""), ("pk", "app.Post", 1, "b", ""), ("unique", "app.Post", 0, "uq_b", "b"),
    ("fk", "app.Post", 0, "authorId", "app.users.id|logical|true"), ("index", "app.Post", 0, "idx_authorid_at", "authorId,at|false"), ("index", "app.Post", 1, "by_flag", "flag|false"),
    _PRISMA_FIELD("app.Color", 0, "Value", "text"), ("error", "", 0, "Unknown Prisma type 'Strange' on field 'odd' — used as-is.", ""),
]


@query(_expected(ROWS, _PRISMA_ROWS))
def prisma_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8a-S8f/J22/U2/F7/F22: models, an enum, native types, defaults, relations (one of two columns), keys and indexes."""
    from plumbline.sources.prisma import parse_prisma

    return _parsed(spark, parse_prisma(_PRISMA, schema_prefix="app", include_enums=True))


# Live catalogs

#: Catalog relations of a small database, by name: columns and rows.
POSTGRES = {
    "columns": ("table_schema VARCHAR, table_name VARCHAR, table_type VARCHAR, ordinal INTEGER, column_name VARCHAR, data_type VARCHAR, udt_name VARCHAR, length INTEGER, precision INTEGER, scale INTEGER, nullable BOOLEAN, default VARCHAR", [
        ("app", "orders", "BASE TABLE", 1, "id", "integer", "int4", None, 32, 0, False, "nextval('s')"), ("app", "orders", "BASE TABLE", 3, "total", "numeric", "numeric", None, 10, 2, True, None),
        ("app", "orders", "BASE TABLE", 2, "cust_id", "integer", "int4", None, 32, 0, False, None), ("app", "orders", "BASE TABLE", 4, "tags", "ARRAY", "_text", None, None, None, True, None), ("app", "orders", "BASE TABLE", 5, "blank", "text", "text", None, None, None, True, None),
        ("app", "cust", "BASE TABLE", 1, "id", "integer", "int4", None, 32, 0, False, None), ("app", "cust", "BASE TABLE", 2, "mail", "character varying", "varchar", 80, None, None, True, None),
        ("app", "v_orders", "VIEW", 1, "id", "integer", "int4", None, 32, 0, True, None), ("other", "cust", "BASE TABLE", 1, "id", "uuid", "uuid", None, None, None, False, None), ("pg_catalog", "pg_class", "BASE TABLE", 1, "oid", "oid", "oid", None, None, None, False, None),
    ]),
    "keys": ("table_schema VARCHAR, table_name VARCHAR, ordinal INTEGER, column_name VARCHAR", [("app", "orders", 2, "id"), ("app", "orders", 1, "cust_id"), ("app", "cust", 1, "id"), ("other", "cust", 1, "id")]),
    "foreign_keys": ("table_schema VARCHAR, table_name VARCHAR, constraint_name VARCHAR, source_field VARCHAR, target_schema VARCHAR, target_name VARCHAR, target_field VARCHAR, delete_rule VARCHAR", [("app", "orders", "fk_b", "cust_id", "app", "cust", "id", "CASCADE"), ("app", "orders", "fk_a", "id", "other", "cust", "id", "NO ACTION")]),
    "generated": ("table_schema VARCHAR, table_name VARCHAR, column_name VARCHAR, expression VARCHAR, extra VARCHAR", [("app", "orders", "TOTAL", "(a * b)", "STORED"), ("app", "orders", "blank", "  ", "STORED")]),
    "index_keys": ("table_schema VARCHAR, table_name VARCHAR, table_oid BIGINT, index_name VARCHAR, attnums INTEGER[], n_keys INTEGER, is_unique BOOLEAN, filter VARCHAR", [
        ("app", "orders", 11, "ix_two", [3, 2, 5], 2, False, "(total > 0)"), ("app", "orders", 11, "ix_expr", [0], 1, False, None), ("app", "cust", 12, "uq_mail", [2], 1, True, None), ("app", "cust", 12, "ux_id_mail", [1, 2], 2, True, None)]),
    "attributes": ("table_oid BIGINT, attnum INTEGER, column_name VARCHAR", [(11, 1, "id"), (11, 2, "cust_id"), (11, 3, "total"), (11, 5, "blank"), (12, 1, "id"), (12, 2, "mail")]),
    "checks": ("table_schema VARCHAR, table_name VARCHAR, name VARCHAR, expression VARCHAR, columns VARCHAR[]", [("app", "orders", "ck_total", "(total > 0)", ["total"]), ("app", "orders", "ck_both", "(id > cust_id)", ["id", "cust_id"])]),
    "unique_columns": ("table_schema VARCHAR, table_name VARCHAR, name VARCHAR, ordinal INTEGER, column_name VARCHAR", [("app", "cust", "uq_mail", 1, "mail"), ("app", "orders", "uq_two", 2, "id"), ("app", "orders", "uq_two", 1, "total")]),
}
MYSQL = {
    "columns": (POSTGRES["columns"][0], [
        ("shop", "orders", "BASE TABLE", 1, "id", "int", None, None, 10, 0, False, None), ("shop", "orders", "BASE TABLE", 2, "name", "varchar", None, 40, None, None, True, "x"), ("shop", "orders", "BASE TABLE", 3, "total", "decimal", None, None, 10, 2, True, None),
        ("shop", "orders", "BASE TABLE", 4, "twice", "decimal", None, None, 10, 2, True, None), ("shop", "cust", "BASE TABLE", 1, "id", "int", None, None, 10, 0, False, None), ("shop", "v", "VIEW", 1, "id", "int", None, None, 10, 0, True, None), ("mysql", "user", "BASE TABLE", 1, "id", "int", None, None, 10, 0, True, None),
    ]),
    "keys": (POSTGRES["keys"][0], [("shop", "orders", 1, "id"), ("shop", "cust", 1, "id")]),
    "foreign_keys": (POSTGRES["foreign_keys"][0], [("shop", "orders", "fk_1", "id", "shop", "cust", "id", "cascade")]),
    "generated": (POSTGRES["generated"][0], [("shop", "orders", "total", "a * b", "STORED GENERATED"), ("shop", "orders", "twice", "total * 2", "VIRTUAL GENERATED"), ("shop", "orders", "name", "", "")]),
    "index_columns": ("table_schema VARCHAR, table_name VARCHAR, index_name VARCHAR, ordinal INTEGER, column_name VARCHAR, is_unique BOOLEAN, is_included BOOLEAN", [("shop", "orders", "ix", 1, "id", False, False), ("shop", "orders", "ix", 0, "name", False, False)]),
    "checks": ("table_schema VARCHAR, table_name VARCHAR, name VARCHAR, expression VARCHAR", [("shop", "orders", "ck", "total > 0")]),
    "unique_columns": (POSTGRES["unique_columns"][0], [("shop", "cust", "uq", 1, "id")]),
}


def _spark_ddl(columns: str) -> str:
    kinds = {"VARCHAR": "string", "INTEGER": "int", "BIGINT": "bigint", "BOOLEAN": "boolean", "VARCHAR[]": "array<string>", "INTEGER[]": "array<int>"}
    return ", ".join(f"`{n}` {kinds[t]}" for n, t in (c.rsplit(" ", 1) for c in columns.split(", ")))


def _catalog_of(spark: SparkSession, relations: dict):
    return lambda name: spark.createDataFrame(relations[name][1], _spark_ddl(relations[name][0]))


def _catalog_ctes(relations: dict) -> str:
    rename = lambda c: c.replace("default VARCHAR", "dflt VARCHAR")
    out = []
    for name, (columns, rows) in relations.items():
        out.append(D.cte(name, rename(columns), rows))
    return ",\n".join(out)


def _assembly_sql(postgres: bool) -> str:
    key = "table_schema || '.' || table_name" if postgres else "table_name"
    target = "target_schema || '.' || target_name" if postgres else "target_name"
    kind = (
        "CASE WHEN data_type = 'character varying' AND length IS NOT NULL THEN 'varchar(' || length || ')' WHEN data_type = 'numeric' THEN 'numeric(' || precision || ',' || scale || ')' WHEN data_type = 'ARRAY' THEN udt_name ELSE data_type END"
        if postgres
        else "CASE WHEN data_type = 'varchar' THEN 'varchar(' || length || ')' WHEN data_type = 'decimal' THEN 'decimal(' || precision || ',' || scale || ')' ELSE data_type END"
    )
    stored = "true" if postgres else "contains(g.extra, 'STORED')"
    scope = "table_schema IN ('app')" if postgres else "table_schema <> 'mysql'"
    indexes = (
        """index_parts AS (SELECT i.table_schema, i.table_name, i.index_name, p.place - 1 AS place, a.column_name, i.is_unique, p.place > i.n_keys AS included FROM index_keys i,
  LATERAL (SELECT unnest(attnums) AS attnum, generate_subscripts(attnums, 1) AS place) p JOIN attributes a ON a.table_oid = i.table_oid AND a.attnum = p.attnum
  WHERE NOT EXISTS (SELECT 1 FROM unique_columns u WHERE u.table_schema = i.table_schema AND u.table_name = i.table_name AND u.name = i.index_name))"""
        if postgres
        else "index_parts AS (SELECT table_schema, table_name, index_name, ordinal AS place, column_name, is_unique, is_included AS included FROM index_columns)"
    )
    check_column = "CASE WHEN len(columns) = 1 THEN columns[1] ELSE '' END" if postgres else "''"
    return f"""WITH {_catalog_ctes(POSTGRES if postgres else MYSQL)}, {indexes},
known AS (SELECT DISTINCT table_schema, table_name FROM columns WHERE {scope})
SELECT 'field' AS part, {key} AS table_name, CAST(row_number() OVER (PARTITION BY c.table_schema, c.table_name ORDER BY ordinal) - 1 AS INTEGER) AS ordinal, c.column_name AS name,
  concat_ws('|', {kind}, CAST(nullable AS VARCHAR), coalesce(dflt, ''), CAST(g.expression IS NOT NULL AS VARCHAR), coalesce(g.expression, ''), CAST(g.expression IS NOT NULL AND {stored} AS VARCHAR), 'false', 'false', '', '') AS value
  FROM columns c LEFT JOIN (SELECT table_schema AS s, table_name AS t, lower(column_name) AS n, expression, extra FROM generated WHERE trim(expression) <> '') g ON g.s = table_schema AND g.t = table_name AND g.n = lower(column_name) WHERE {scope}
UNION ALL SELECT 'pk', {key}, CAST(row_number() OVER (PARTITION BY table_schema, table_name ORDER BY ordinal) - 1 AS INTEGER), column_name, '' FROM keys SEMI JOIN known USING (table_schema, table_name)
UNION ALL SELECT 'fk', {key}, CAST(row_number() OVER (PARTITION BY table_schema, table_name ORDER BY constraint_name) - 1 AS INTEGER), source_field, concat_ws('|', {target} || '.' || target_field, 'physical', CAST(upper(delete_rule) = 'CASCADE' AS VARCHAR)) FROM foreign_keys SEMI JOIN known USING (table_schema, table_name)
UNION ALL SELECT 'index', {key}, CAST(row_number() OVER (PARTITION BY table_schema, table_name ORDER BY index_name) - 1 AS INTEGER), index_name, string_agg(column_name, ',' ORDER BY place) FILTER (WHERE NOT included) || '|' || CAST(bool_or(is_unique) AS VARCHAR)
  FROM index_parts SEMI JOIN known USING (table_schema, table_name) GROUP BY table_schema, table_name, index_name
UNION ALL SELECT 'check', {key}, 0, name, {check_column} FROM checks SEMI JOIN known USING (table_schema, table_name)
UNION ALL SELECT 'unique', {key}, 0, name, column_name FROM unique_columns SEMI JOIN known USING (table_schema, table_name)"""


@query(_assembly_sql(True))
def catalog_assembly_postgres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10a-S10g/J19/J27/J28/P2/P14/A3: documents assembled from a PostgreSQL catalog's relations, one schema of it."""
    return unnested(live_catalog.introspect(_catalog_of(spark, POSTGRES), "PostgreSQL", "app"))


@query(_assembly_sql(False))
def catalog_assembly_mysql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9a-S9g/J20/A3: documents assembled from a MySQL catalog's relations; names have no schema and the filter counts for nothing."""
    return unnested(live_catalog.introspect(_catalog_of(spark, MYSQL), None, "nowhere"))


@query(f"""WITH {D.cte('columns', POSTGRES['columns'][0].replace('default VARCHAR', 'dflt VARCHAR'), POSTGRES['columns'][1])}, t AS (SELECT DISTINCT table_schema, table_name, table_type FROM columns WHERE table_schema <> 'pg_catalog')
SELECT 'tables' AS kind, table_schema || '.' || table_name AS table_name FROM t WHERE table_type = 'BASE TABLE' UNION ALL SELECT 'views', table_schema || '.' || table_name FROM t WHERE table_type = 'VIEW'
UNION ALL SELECT 'both', table_schema || '.' || table_name FROM t UNION ALL SELECT 'one schema', table_schema || '.' || table_name FROM t WHERE table_schema = 'other'""")
def catalog_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables, views or both, without system schemas, and of one schema (case counts there)."""
    columns = filters.without_system_schemas(_catalog_of(spark, POSTGRES)("columns"))
    told = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.concat_ws(".", "table_schema", "table_name").alias("table_name")).distinct()
    return union_all([*[told(filters.of_table_type(columns, k), k) for k in ("tables", "views", "both")], told(filters.catalog_schema_filter(columns, "other, APP"), "one schema")])


_PROVIDERS = [(None, "mysql"), ("MySQL", "mysql"), ("postgres", "postgres"), ("PostgreSQL", "postgres"), ("sqlserver", "error 4"), ("oracle", "error 4")]


@query(_expected("provider VARCHAR, outcome VARCHAR", _PROVIDERS))
def provider_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which catalog a provider name means; others are refused with the code of a setting."""
    from plumbline.plans.commands import Outcome, guarded

    found = [(p, guarded(lambda p=p: Outcome(live_catalog.check_provider(p)))) for p, _ in _PROVIDERS]
    return spark.createDataFrame([(p, f"error {o.code}" if o.code else o.text) for p, o in found], "provider string, outcome string")


@query("""SELECT 'region' AS name, CAST(row_number() OVER (ORDER BY r_regionkey) - 1 AS INTEGER) AS row_index, '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS json FROM region
UNION ALL SELECT 'nation', CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER), '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' FROM nation""")
def reference_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, detection and capture in one; a table whose rows can't be read is left out."""
    tables = {t: read(spark, sf_dir, t) for t in ("region", "nation", "customer")}
    broken = tables["region"].withColumn("r_name", F.raise_error(F.lit("unreadable")).cast("string"))
    return capture.enrich(tables | {"broken_region": broken}, {"region": ["r_regionkey"], "nation": ["n_nationkey"]}, globs=["*ion"])


# Merged documents

_MERGED = D.ctes("r_", D.repo_documents(), "tables", *_ALL) + ",\n" + D.ctes("l_", D.live_documents(), "tables", *_ALL)


@query(f"""WITH {_MERGED}, t AS (SELECT r.name, lower(r.name) AS k FROM r_tables r JOIN l_tables l ON lower(r.name) = lower(l.name)),
f AS (SELECT t.name AS table_name, coalesce(r.name, l.name) AS name, r.name IS NULL AS late, coalesce(r.ordinal, l.ordinal) AS place, r.name AS rn, l.name AS ln, r.type AS rt, l.type AS lt, r.nullable AS r0, l.nullable AS l0, r.dflt AS r1, l.dflt AS l1,
    r.is_computed AS r2, l.is_computed AS l2, r.computed_expression AS r3, l.computed_expression AS l3, r.is_persisted AS r4, l.is_persisted AS l4, r.is_match_column AS r5, r.is_deprecated AS r6, l.is_deprecated AS l6, r.sensitivity AS r7, l.sensitivity AS l7, r.description AS r8
  FROM (SELECT * FROM r_fields WHERE lower(table_name) IN (SELECT k FROM t)) r FULL JOIN (SELECT * FROM l_fields WHERE lower(table_name) IN (SELECT k FROM t)) l ON lower(r.table_name) = lower(l.table_name) AND lower(r.name) = lower(l.name)
  JOIN t ON t.k = lower(coalesce(r.table_name, l.table_name))),
a AS (SELECT lower(table_name) AS k, list(name ORDER BY ordinal) AS names FROM r_pks GROUP BY 1), b AS (SELECT lower(table_name) AS k, list(name ORDER BY ordinal) AS names FROM l_pks GROUP BY 1),
p AS (SELECT t.name AS table_name, CASE WHEN list_transform(a.names, lambda x: lower(x)) = list_transform(b.names, lambda x: lower(x)) THEN a.names ELSE b.names END AS names FROM t LEFT JOIN a USING (k) LEFT JOIN b USING (k)),
x AS (SELECT t.name AS table_name, coalesce(r.source_field, l.source_field) AS name, concat_ws('|', coalesce(r.target_table, l.target_table) || '.' || coalesce(r.target_field, l.target_field), coalesce(r.kind, 'physical'), CAST(coalesce(l.cascade_delete, r.cascade_delete) AS VARCHAR)) AS value,
    r.table_name IS NULL AS late, coalesce(r.ordinal, l.ordinal) AS place FROM r_fks r FULL JOIN l_fks l ON lower(r.table_name) = lower(l.table_name) AND lower(r.source_field) = lower(l.source_field) AND lower(r.target_table) = lower(l.target_table) AND lower(r.target_field) = lower(l.target_field)
  JOIN t ON t.k = lower(coalesce(r.table_name, l.table_name)) WHERE l.table_name IS NOT NULL OR r.kind <> 'physical')
SELECT 'field' AS part, table_name, CAST(row_number() OVER (PARTITION BY table_name ORDER BY late, place) - 1 AS INTEGER) AS ordinal, name, concat_ws('|', CASE WHEN ln IS NULL THEN rt ELSE lt END, CAST(CASE WHEN ln IS NULL THEN r0 ELSE l0 END AS VARCHAR), coalesce(CASE WHEN ln IS NULL THEN r1 ELSE l1 END, ''),
  CAST(CASE WHEN ln IS NULL THEN r2 ELSE l2 END AS VARCHAR), coalesce(CASE WHEN ln IS NULL THEN r3 ELSE l3 END, ''), CAST(CASE WHEN ln IS NULL THEN r4 ELSE l4 END AS VARCHAR), CAST(coalesce(r5, false) AS VARCHAR), CAST(CASE WHEN rn IS NULL THEN l6 ELSE r6 END AS VARCHAR), coalesce(CASE WHEN rn IS NULL THEN l7 ELSE r7 END, ''), coalesce(r8, '')) AS value FROM f
UNION ALL SELECT 'pk', table_name, CAST(generate_subscripts(names, 1) - 1 AS INTEGER), unnest(names), '' FROM p
UNION ALL SELECT 'fk', table_name, CAST(row_number() OVER (PARTITION BY table_name ORDER BY late, place) - 1 AS INTEGER), name, value FROM x
UNION ALL SELECT 'index', t.name, ordinal, i.name, array_to_string(columns, ',') || '|' || CAST(is_unique AS VARCHAR) FROM l_indexes i JOIN t ON t.k = lower(i.table_name)
UNION ALL SELECT 'data', t.name, row_index, d.k, d.v FROM r_data d JOIN t ON t.k = lower(d.table_name)""")
def merge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole merged documents, taken apart."""
    return unnested(Registry(merge.merge_documents(repo(spark), live(spark))))


# Order, filters, text


@query(f"""WITH RECURSIVE {D.ctes('', D.live_documents(), 'tables', 'fks')}, e AS (SELECT DISTINCT lower(table_name) AS s, lower(target_table) AS t FROM fks WHERE kind <> 'virtual' AND lower(table_name) <> lower(target_table) AND lower(target_table) IN (SELECT lower(name) FROM tables)),
w(n, l) AS (SELECT lower(name), 0 FROM tables UNION SELECT s, l + 1 FROM w JOIN e ON e.t = w.n WHERE l < 20), d AS (SELECT n AS table_key, max(l) AS level FROM w GROUP BY n)
SELECT table_key, level, CAST(row_number() OVER (ORDER BY level, table_key) AS INTEGER) AS position FROM d""")
def topological_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: tables in an order in which each comes after those it refers to."""
    r = live(spark)
    return graph.topological_order(r.tables, r.foreign_keys).select("table_key", "level", "position")


@query(f"WITH {D.ctes('', D.repo_documents(), 'tables')} SELECT name, source_file FROM tables WHERE NOT starts_with(lower(replace(source_file, 'tables/p', 'other/p')), 'tables/')".replace("SELECT name, source_file FROM", "SELECT name, replace(source_file, 'tables/p', 'other/p') AS source_file FROM"))
def outside_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose file isn't under a folder, case ignored."""
    docs = repo(spark).documents.withColumn("source_file", F.regexp_replace("source_file", "^tables/p", "other/p"))
    return filters.outside_folder(docs, "Tables/").select("name", "source_file")


@query("""WITH s AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_name || chr(10) || '  - a' || chr(10) || 'b' WHEN 1 THEN replace(s_name, '#', '"') WHEN 2 THEN s_name || chr(13) || chr(10) || 'x\\y' ELSE replace(s_name, '#', '.') END AS t, (['PII', 'internal', 'Public', 'secret', NULL])[s_suppkey % 5 + 1] AS level FROM supplier)
SELECT s_suppkey, replace(replace(replace(replace(t, chr(13) || chr(10), chr(10)), chr(10) || '  -', chr(1)), chr(10), '<br/>'), chr(1), chr(10) || '  -') AS cell, '"' || replace(replace(replace(replace(t, '\\', '\\\\'), '"', '\\"'), chr(13), ''), chr(10), ' ') || '"' AS quoted,
  CASE WHEN regexp_full_match(t, '[\\p{L}\\p{Nd}_.]*') THEN t ELSE '"' || replace(replace(t, '\\', '\\\\'), '"', '\\"') || '"' END AS identifier, CASE lower(level) WHEN 'pii' THEN '🔴 PII' WHEN 'internal' THEN '🔵 Internal' WHEN 'public' THEN '🟢 Public' ELSE '' END AS badge,
  array_to_string(list_filter(list_transform(string_split(' a,' || coalesce(level, '') || ', ,b ', ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM s""")
def cell_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lists, table cells, quoted names and texts, and badges, as column expressions over data."""
    text = F.expr("case s_suppkey % 4 when 0 then s_name || '\\n  - a\\nb' when 1 then replace(s_name, '#', '\"') when 2 then s_name || '\\r\\nx\\\\y' else replace(s_name, '#', '.') end")
    level = F.element_at(F.array(F.lit("PII"), F.lit("internal"), F.lit("Public"), F.lit("secret"), F.lit(None)), (F.col("s_suppkey") % 5 + 1).cast("int"))
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", text.alias("t"), level.alias("level"))
    t = F.col("t")
    parts = T.split_list(F.concat(F.lit(" a,"), F.coalesce("level", F.lit("")), F.lit(", ,b ")))
    return rows.select("s_suppkey", T.markdown_cell(t).alias("cell"), T.dbml_string(t).alias("quoted"), T.dbml_identifier(t).alias("identifier"), T.sensitivity_badge(F.col("level")).alias("badge"), F.array_join(parts, "|").alias("parts"))


_PATHS = [("default", "docs/database.md"), ("folder", "out/database.md"), ("file", "x/y.md"), ("both", "x/y.md")]


@query(_expected("given VARCHAR, path VARCHAR", _PATHS))
def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a document goes."""
    from plumbline.sinks.writers import output_path

    given = {"default": {}, "folder": {"output_dir": "out"}, "file": {"output": "x/y.md"}, "both": {"output": "x/y.md", "output_dir": "out"}}
    return spark.createDataFrame([(k, output_path("docs/database.md", **v)) for k, v in given.items()], "given string, path string")


_CODES = [("schema", 2), ("release", 3), ("config", 4), ("other", 5), ("none", 0)]


@query(_expected("error VARCHAR, code INTEGER", _CODES))
def exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section 2.16: the code of each kind of failure at a command's boundary."""
    from plumbline.plans.commands import Outcome, ReleaseError, guarded
    from plumbline.sources.registry import ConfigError, SchemaError

    kinds = {"schema": SchemaError, "release": ReleaseError, "config": ConfigError, "other": OSError}

    def run(name: str) -> Outcome:
        if name in kinds:
            raise kinds[name](name)
        return Outcome()

    return spark.createDataFrame([(n, guarded(run, n).code) for n, _ in _CODES], "error string, code int")
