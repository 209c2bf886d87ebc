import json

import pytest

from plumbline.model import Registry, table_document
from plumbline.operators import capture
from plumbline.plans import declared
from plumbline.sinks import render, writers
from plumbline.sources import catalog, registry
from plumbline.sources.dbml import parse_dbml
from plumbline.sources.prisma import default_of, native_type, parse_prisma

DBML = '''
// shop
Table "order details" [headercolor: #fff] {
  id int [pk, increment]
  "full name" varchar(40) [not null, unique, note: "who, // really \\"x\\""]
  total decimal(10,2) [note: 'sum; // calculated: (a + (b)) PERSISTED'] // trailing
  state int
  indexes {
    (id, state) [unique]
  }
  Note: 'All lines'
}
Table dbo.State { 
  id int [primary key]
}
Ref: "order details".state > dbo.State.id // logical
Ref many: dbo.State.id < "order details".state
Ref: a.b <> c.d
Ref: lost.x - dbo.State.id
TableGroup Sales {
  "order details"
  dbo.State
}
'''


def test_dbml():
    model = parse_dbml(DBML)
    first, second = model.tables
    assert (first["name"], first["description"], first["primary_key"]) == ("order details", "All lines", ["id"])
    assert [(f["name"], f["type"], f["nullable"]) for f in first["fields"]] == [("id", "int", False), ("full name", "varchar(40)", False), ("total", "decimal(10,2)", True), ("state", "int", True)]
    assert first["fields"][1]["description"] == 'who, // really "x"'
    assert {k: first["fields"][2][k] for k in ("description", "is_computed", "computed_expression", "is_persisted")} == {"description": "sum", "is_computed": True, "computed_expression": "a + (b)", "is_persisted": True}
    assert [(k["source_field"], k["target_table"], k["kind"]) for k in first["foreign_keys"]] == [("state", "dbo.State", "logical"), ("state", "dbo.State", "physical")]
    assert second["name"] == "dbo.State" and len(model.errors) == 2
    assert model.sections == [{"name": "Sales", "tables": ["order details", "dbo.State"], "erds": []}]


def test_dbml_prefix_leaves_groups_alone():
    model = parse_dbml("Table a {\n id int\n}\nTable x.b {\n id int\n}\nRef: a.id > x.b.id\nTableGroup g {\n a\n}", "app")
    assert [t["name"] for t in model.tables] == ["app.a", "x.b"] and model.sections[0]["tables"] == ["a"]
    assert model.tables[0]["foreign_keys"][0]["target_table"] == "x.b"


def test_dbml_round_trip(spark):
    docs = [d for d in declared.repo_documents() if d["name"] != "brand_old"]
    text = render.render_dbml(docs, [{"name": "All of it", "tables": [d["name"] for d in docs]}])
    model = parse_dbml(text)
    assert not model.errors and text.endswith("}\n") and not text.endswith("\n\n")
    for a, b in zip(docs, model.tables):
        assert a["name"] == b["name"] and [f["name"] for f in a["fields"]] == [f["name"] for f in b["fields"]]
        assert [f["type"] for f in a["fields"]] == [f["type"] for f in b["fields"]]
        assert [(k["source_field"], k["target_table"], k["kind"]) for k in a["foreign_keys"]] == [(k["source_field"], k["target_table"], k["kind"]) for k in b["foreign_keys"]]
        assert [f["computed_expression"] for f in a["fields"] if f["is_computed"]] == [f["computed_expression"] for f in b["fields"] if f["is_computed"]]
    assert model.sections[0]["name"] == "All of it"


PRISMA = '''
datasource db {
  provider     = "mysql"
  relationMode = "prisma"
}
enum Role {
  ADMIN
}
model User {
  id    Int     @id @default(autoincrement())
  email String  @unique @db.VarChar(120)
  role  Role    @default(Role.ADMIN)
  score Decimal? @default(1.5)
  at    DateTime @default(now())
  raw   Unsupported("geometry")?
  odd   Strange
  name  String  @default("x y")
  posts Post[]
  @@map("users")
  @@unique([email, name])
}
model Post {
  a Int
  b Int
  authorId Int
  author User @relation(fields: [authorId], references: [id], onDelete: Cascade)
  pair   Pair @relation(fields: [a, b], references: [x, y])
  @@id([a, b])
  @@index([authorId, b])
  @@index([a], name: "named")
}
model Pair {
  x Int
  y Int
}
'''


def test_prisma():
    model = parse_prisma(PRISMA, include_enums=True)
    user, post, _ = model.tables
    assert [(f["name"], f["type"], f["nullable"], f.get("default")) for f in user["fields"]] == [
        ("id", "int", False, None), ("email", "varchar(120)", False, None), ("role", "varchar(191)", False, "ADMIN"), ("score", "decimal(18,6)", True, "5"),
        ("at", "datetime", False, None), ("raw", "geometry", True, None), ("odd", "Strange", False, None), ("name", "varchar(191)", False, "x y"),
    ]
    assert user["name"] == "users" and user["primary_key"] == ["id"] and len(model.errors) == 1
    assert [u["name"] for u in user["unique_constraints"]] == ["uq_email", "uq_email_name"]
    assert post["primary_key"] == ["a", "b"] and [i["name"] for i in post["indexes"]] == ["idx_authorid_b", "named"]
    assert [(k["source_field"], k["target_table"], k["cascade_delete"], k["kind"]) for k in post["foreign_keys"]] == [("authorId", "users", True, "logical")]
    assert [(e["name"], e["is_reference_table"]) for e in model.enums] == [("Role", True)]
    assert parse_prisma(PRISMA, "postgres", "app").tables[0]["name"] == "app.users" and parse_prisma(PRISMA).enums == []


@pytest.mark.parametrize("name, args, sql", [("VarChar", "9", "varchar(9)"), ("Text", "9", "text"), ("UnsignedInt", None, "int unsigned"), ("DoublePrecision", None, "double precision"), ("ObjectId", None, "objectId"), ("Odd", "1", "Odd")])
def test_native_types(name, args, sql):
    assert native_type(name, args) == sql


@pytest.mark.parametrize("attrs, value", [("@default(uuid())", None), ('@default("a(b)")', "a(b)"), ("@default(true)", "true"), ("", None), ("@@default(1)", None)])
def test_defaults(attrs, value):
    assert default_of(attrs) == value


def test_registry_scan_round_trip_and_raw_tokens(spark, tmp_path):
    (tmp_path / "app/tables").mkdir(parents=True)
    (tmp_path / "skip/tables").mkdir(parents=True)
    text = '{"NAME": "a.b", "Fields": [{"Name": "id", "TYPE": "int", "extra": 1}], "primaryKey": ["id"], "isReferenceTable": true, "data": [{"id": 1.10, "S": "x", "n": null}], "foreignKeys": [{"sourceField": "id", "targetTable": "t", "targetField": "u", "soft": true}]}'
    (tmp_path / "app/tables/b.json").write_text(text)
    (tmp_path / "app/tables/a.json").write_text('﻿{"name": "first", "fields": []}')
    (tmp_path / "skip/tables/c.json").write_text("nope")
    docs = registry.load_tables(spark, str(tmp_path), ["SKIP"])
    assert [d["name"] for d in docs] == ["first", "a.b"] and docs[1]["data"] == [{"id": "1.10", "S": '"x"', "n": "null"}]
    assert docs[1]["foreign_keys"][0]["kind"] == "logical"
    whole = table_document(**docs[1])
    again = registry.decode("x", writers.document_json(whole), ("name",))
    assert again["data"] == docs[1]["data"] and again["fields"][0]["name"] == "id" and json.loads(writers.document_json(whole))["$schemaVersion"] == "1.0"
    with pytest.raises(registry.SchemaError, match="c.json"):
        registry.load_tables(spark, str(tmp_path))
    assert registry.load_tables(spark, str(tmp_path / "gone")) == []
    loaded = registry.load_registry(spark, str(tmp_path / "app"))
    assert loaded.documents.count() == 2
    (tmp_path / "app/tables/d.json").write_text('{"name": "A.B", "fields": []}')
    with pytest.raises(registry.SchemaError, match="more than once"):
        registry.load_registry(spark, str(tmp_path / "app"))


@pytest.mark.parametrize("doc, kind", [({}, "physical"), ({"soft": False}, "physical"), ({"soft": True}, "logical"), ({"kind": "Virtual"}, "virtual"), ({"soft": True, "kind": "logical"}, None), ({"kind": "odd"}, None)])
def test_foreign_key_kinds(doc, kind):
    fk = {"source_field": "a", "target_table": "b", "target_field": "c"} | doc
    if kind is None:
        with pytest.raises(registry.SchemaError):
            registry.foreign_key(fk)
    else:
        assert registry.foreign_key(fk)["kind"] == kind


def test_config():
    config = registry.parse_config('{ // note\n "Output": {"format": {"type": "dbml",},}, /* x */ "a": ["//x", ],}')
    assert config == {"output": {"format": {"type": "dbml"}}, "a": ["//x"]}
    for bad in ("{", '{"output": {"format": {"type": "pdf"}}}'):
        with pytest.raises(registry.ConfigError):
            registry.parse_config(bad)
    with pytest.raises(registry.ConfigError):
        catalog.check_provider("sqlserver")
    with pytest.raises(registry.ConfigError):
        catalog.live_snapshot()


def test_catalog_rows_become_documents(spark):
    make = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    col = lambda t, o, c, d, n=None, p=None, s=None: ("public", t, "BASE TABLE", o, c, d, "_int4", n, p, s, o > 1, None)
    columns = make([col("t", 2, "name", "character varying", 40), col("t", 1, "id", "integer"), col("t", 3, "sum", "numeric", None, 10, 2), col("t", 4, "tags", "ARRAY"), ("other", "z", "BASE TABLE", 1, "a", "text", None, None, None, None, True, None), ("public", "v", "VIEW", 1, "a", "text", None, None, None, None, True, None)], catalog.COLUMNS)
    docs = catalog.from_rows(
        columns, make([("public", "t", 1, "id")], catalog.KEYS), make([("public", "t", "fk", "id", "other", "z", "a", "CASCADE")], catalog.FOREIGN_KEYS),
        make([("public", "t", "sum", "(a + b)", None), ("public", "t", "name", " ", None)], catalog.GENERATED),
        make([("public", "t", "ix", 1, "name", True, False, "x > 1"), ("public", "t", "ix", 0, "sum", True, False, "x > 1"), ("public", "t", "ix", 2, "id", True, True, "x > 1")], catalog.INDEX_COLUMNS),
        make([("public", "t", "ck", "a > 0", ["a"]), ("public", "t", "ck2", "a > b", ["a", "b"])], catalog.CHECKS), make([("public", "t", "uq", 2, "b"), ("public", "t", "uq", 1, "a")], catalog.UNIQUE_COLUMNS),
        schemas="public", kind="tables",
    )
    (doc,) = docs.collect()
    assert doc["name"] == "public.t" and [(f["name"], f["type"], f["is_computed"], f["is_persisted"]) for f in doc["fields"]] == [("id", "integer", False, False), ("name", "varchar(40)", False, False), ("sum", "numeric(10,2)", True, True), ("tags", "_int4", False, False)]
    assert doc["foreign_keys"][0]["target_table"] == "other.z" and doc["foreign_keys"][0]["cascade_delete"]
    assert (doc["indexes"][0]["columns"], doc["indexes"][0]["included_columns"]) == (["sum", "name"], "id") and [c["column"] for c in doc["check_constraints"]] == ["a", None] and doc["unique_constraints"][0]["columns"] == ["a", "b"]
    assert Registry(docs).fields.count() == 4


def test_capture(spark):
    rows = spark.createDataFrame([(2, None, b"\x01"), (1, "x", None)], "id int, s string, b binary")
    got = [r["json"] for r in capture.capture_rows(rows, ["id"]).orderBy("row_index").collect()]
    assert got == ['{"id":1,"s":"x","b":null}', '{"id":2,"s":null,"b":"AQ=="}']
    assert capture.capture_rows(rows, ["id"], max_kb=0).isEmpty()
    assert tuple(capture.serialized_size(rows).first()) == (2, len("[" + ",".join(got) + "]"))
    found = capture.enrich({"aType": rows, "big": spark.range(500).toDF("id")}, {"aType": ["id"]}, globs=["*"])
    assert {r["name"] for r in found.collect()} == {"aType"}


def test_erd():
    f = lambda n, t="int(3)", **v: {"name": n, "type": t, "is_computed": False, "is_deprecated": False} | v
    fk = lambda s, t, k="physical": {"source_field": s, "target_table": t, "kind": k}
    tables = {t["name"].lower(): t for t in (
        {"name": "a b", "fields": [f("id"), f("x", "VARCHAR(9)"), f("c", is_computed=True)], "primary_key": ["ID"], "is_deprecated": True, "foreign_keys": [fk("x", "T2"), fk("x", "far"), fk("x", "far", "logical"), fk("c", "t2", "virtual"), fk("x", "nowhere")]},
        {"name": "t2", "fields": [f("id")], "primary_key": ["id"], "is_deprecated": False, "foreign_keys": []}, {"name": "far", "fields": [], "primary_key": [], "is_deprecated": False, "foreign_keys": []},
    )}
    text = render.render_erd({"title": "T"}, ["a b", "t2", "gone"], tables, sections={"far": "Other"})
    assert text.split("\n") == ["**T**", "", "```mermaid", "erDiagram", "direction LR", '    "T2" ||--o{ "a_b" : "x"', '    "[Other] far" ||--o{ "a_b" : "x"', "", '    %% External references (cross-section): "[Other] far"', '    %% DEPRECATED: "a_b"', '    "a_b" {', "        int id PK", "        varchar x FK", "        int c FK,C", "    }", '    "t2" {', "        int id PK", "    }", "```"]
    none = render.render_erd({"fields": "none", "include_virtual": True}, ["t2", "a b"], tables, "AzureDevOps")
    assert none.startswith(":::mermaid\n") and none.endswith(":::") and none.count("||--o{") == 2 and "{\n" not in none.replace("o{ ", "")


def test_markdown(spark):
    text = render.document_database(Registry.of(spark, declared.rule_documents(), declared.SECTIONS), section_order=["lookup"])
    for part in ("# DATABASE MODEL", "- [Lookup lists](#lookup-lists)", '<a id="app-keys"></a>', "> **Warning**: Definition file missing.", "**Primary Key**: `id, ID, nope`", "🔴 PII", "*CHECK constraints:*", "| id | name |", "```mermaid", "(logical, cascades)"):
        assert part in text, part
    assert text.index("Lookup lists") < text.index("Core tables") and text == render.document_database(Registry.of(spark, declared.rule_documents(), declared.SECTIONS), section_order=["lookup"])


@pytest.mark.parametrize("text, out", [("a|b", "a|b"), ("a\r\nb", "a<br/>b"), ("a\n  - b\nc", "a\n  - b<br/>c"), (None, "")])
def test_cells(text, out):
    assert render.cell(text) == out


def test_reports(spark):
    repo, live = Registry.of(spark, declared.repo_documents()), Registry.of(spark, declared.live_documents())
    text, drift = render.drift_report(repo, live, "db", "repo")
    assert drift and "**Status: ❌ Drift detected**" in text and "| Column type changed | `c_acctbal` | `decimal(15,2)` | `double` |" in text and "Row modified" in text and "- `events`" in text
    text, drift = render.drift_report(live, live)
    assert not drift and "✅ In sync" in text
    text, orphans = render.merge_report(repo, live)
    assert orphans and "| Column added | `o_orderpriority` | — | `varchar` |" in text and "| customer | `c_comment` | `tables/customer.json` |" in text


def test_writers(spark, tmp_path):
    assert writers.write_text(tmp_path / "a/b.txt", "x\n") and (tmp_path / "a/b.txt").read_text() == "x\n" and [p.name for p in (tmp_path / "a").iterdir()] == ["b.txt"]
    assert not writers.write_text(tmp_path / "c.txt", "x", dry_run=True) and not (tmp_path / "c.txt").exists()
    reg = Registry.of(spark, [d | {"source_file": ""} for d in declared.live_documents()])
    assert len(writers.write_registry(reg, str(tmp_path / "tables"))) == 8 and writers.write_registry(reg, str(tmp_path / "tables")) == []
    assert writers.output_path("x/d.md", None, "out") == "out/d.md" and writers.output_path("d.md", "o.md", "out") == "o.md"
    (tmp_path / "gone.json").write_text("{}")
    assert writers.delete_removed([str(tmp_path / "gone.json")], True, False) == [] and (tmp_path / "gone.json").exists()
    assert writers.delete_removed([str(tmp_path / "gone.json")], True, True) and not (tmp_path / "gone.json").exists()
    for kind in ("table", "section", "api", "config"):
        assert writers.json_schema(kind)["$schema"].endswith("draft-07/schema#")
    assert writers.json_schema("table")["properties"]["foreignKeys"]["items"]["properties"]["kind"]["enum"] == ["physical", "logical", "virtual"]
