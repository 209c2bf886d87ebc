import pytest

from plumbline.model import SECTION_DDL, TENANT_DATABASE_DDL, TENANT_TYPE_DDL, Registry, frame
from plumbline.operators import filters, validate


def f(name, type="int", **v):
    return {"name": name, "type": type, "nullable": False} | v


GOOD = {"name": "app.t", "fields": [f("id"), f("name", "text")], "primary_key": ["id"]}
FK = {"source_field": "id", "target_table": "app.t", "target_field": "id", "cascade_delete": False, "kind": "physical"}
CASES = [
    ({}, []),
    ({"name": " "}, ["TABLE-NAME-MISSING"]),
    ({"fields": []}, ["TABLE-FIELDS-EMPTY"]),
    ({"primary_key": ["ID"]}, ["PK-FIELD-MISSING"]),
    ({"fields": [f("id", nullable=True)]}, ["PK-NULLABLE"]),
    ({"foreign_keys": [FK | {"source_field": "Id"}]}, ["FK-SOURCE-MISSING"]),
    ({"foreign_keys": [FK | {"cascade_delete": True}]}, []),
    ({"foreign_keys": [FK | {"cascade_delete": True, "kind": "logical"}]}, ["FK-CASCADE-NON-PHYSICAL"]),
    ({"label_field": "NAME"}, []),
    ({"label_field": "title"}, ["TABLE-LABEL-FIELD-MISSING"]),
    ({"database_types": ["MySQL", "sqlite"]}, []),
    ({"database_types": ["MSSQL"]}, ["INVALID-DB-TYPE"]),
    ({"fields": [f("id"), f("m", nullable=True, is_match_column=True)]}, ["MATCH-COLUMN-NULLABLE"]),
    ({"fields": [f("id"), f("c", is_computed=True)]}, ["COMPUTED-NO-EXPRESSION"]),
    ({"fields": [f("id"), f("c", is_computed=True, computed_expression="1")], "sets": [{"name": "s", "columns": ["C", "id"]}]}, ["COMPUTED-IN-SET"]),
    ({"fields": [f("ID", is_deprecated=True)], "primary_key": ["ID"]}, ["DEPR-PK"]),
    ({"fields": [f("id"), f("m", is_deprecated=True, is_match_column=True)]}, ["DEPR-MATCH-COLUMN"]),
    ({"fields": [f("id"), f("m", is_deprecated=True)], "foreign_keys": [FK | {"source_field": "m"}]}, ["DEPR-FK-SOURCE"]),
    ({"fields": [f("id", sensitivity="Secret")]}, ["SENS-INVALID-VALUE"]),
    ({"fields": [f("id", sensitivity="PII")]}, ["SENS-PII-NO-DESCRIPTION"]),
    ({"fields": [f("id", sensitivity="pii", description="x"), f("b", sensitivity="Internal")]}, []),
    ({"check_constraints": [{"name": "c", "expression": "x", "column": "gone"}, {"name": "d", "expression": "x", "column": "ID"}]}, ["CHECK-COLUMN-MISSING"]),
    ({"unique_constraints": [{"name": "u", "columns": ["ID", "gone"]}]}, ["UNIQUE-COLUMN-MISSING"]),
    ({"is_reference_table": True, "data": [{"id": "1", "name": '"a"', "x": "1"}]}, ["DATA-UNKNOWN-COLUMN"]),
    ({"is_reference_table": True, "data": [{"id": "1"}]}, ["DATA-MISSING-COLUMN"]),
    ({"is_reference_table": True, "data": [{"id": "1", "name": "null"}, {"id": '"1"', "name": "null"}]}, ["DATA-DUPLICATE-PK"]),
    ({"is_reference_table": True, "data": [{"id": "9", "name": "null"}, {"id": "10", "name": "null"}]}, ["DATA-UNORDERED"]),
    ({"data": [{"x": "1"}]}, []),
]


def test_each_rule_of_single_tables(spark):
    for n, (change, _) in enumerate(CASES):
        assert isinstance(change, dict), n
    docs = [GOOD | change | ({} if "name" in change else {"name": f"app.t{n}"}) for n, (change, _) in enumerate(CASES)]
    found = {}
    for r in validate.validate_tables(Registry.of(spark, docs)).collect():
        found.setdefault(r["table_name"], []).append(r["code"])
    for doc, (_, codes) in zip(docs, CASES):
        assert sorted(found.get(doc["name"], [])) == codes, doc["name"]


def test_messages_and_summary(spark):
    issues = validate.validate_tables(Registry.of(spark, [GOOD | {"primary_key": ["no%s"]}, GOOD | {"name": "b", "label_field": "x"}]))
    assert {r["message"] for r in issues.collect()} == {"Primary key field 'no%s' does not exist", "labelField 'x' does not exist in table 'b'"}
    assert tuple(validate.issue_summary(issues).first()) == (1, 1, True, True)


def test_sections_of_single_tables(spark):
    r = Registry.of(spark, [GOOD | {"sections": ["Core", "gone"]}])
    assert [x["code"] for x in validate.validate_tables(r, ["core"]).collect()] == ["SECTION-UNDEFINED"]
    assert validate.validate_tables(r).isEmpty()


def test_rules_across_tables(spark):
    tables = [GOOD | {"foreign_keys": [FK | {"target_table": "APP.T"}, FK | {"target_table": "gone", "kind": "virtual"}], "sections": ["core", "x"], "database_types": ["mysql"], "source_file": "t.json"}]
    ends = [{"api": "a", "method": "GET", "path": "/", "db_table": t, "database_types": d, "source_file": "a.json"} for t, d in (("APP.T", ["MySQL"]), ("app.t", ["oracle"]), ("lost", []), (None, []))]
    found = validate.validate_cross(Registry.of(spark, tables, [{"name": "Core", "tables": ["app.T", "none"]}], ends)).collect()
    assert sorted(r["code"] for r in found) == ["API-DBTABLE-MISSING", "API-DBTYPE-MISMATCH", "FK-TARGET-MISSING", "SECTION-TABLE-UNDEFINED", "SECTION-UNDEFINED"]
    assert {r["file"] for r in found} == {"t.json", "a.json", None}


@pytest.mark.parametrize(
    "types, dbs, codes",
    [
        ([("c", True, [], [])], [("hub", "C", None, ["core"])], []),
        ([("c", False, [], [])], [("hub", "c", None, [])], ["TENANT-ORPHAN", "TENANT-ROOT-MISSING"]),
        ([("c", True, [], ["Core"])], [("hub", "c", None, ["x"])], ["TENANT-REQUIRED-SECTION-MISSING", "TENANT-SECTION-NOT-MODULE"]),
        ([("c", True, [], []), ("p", False, ["C"], [])], [("hub", "c", None, []), ("q", "p", "HUB", []), ("z", "p", "q", [])], ["TENANT-PARENT-NOT-ALLOWED"]),
        ([("c", True, [], []), ("p", False, ["p"], [])], [("hub", "c", None, []), ("a", "p", "b", []), ("b", "p", "a", [])], ["TENANT-CYCLE"]),
        ([("c", True, ["c"], [])], [("h1", "c", None, []), ("h2", "c", "h1", [])], ["TENANT-ROOT-DUPLICATE", "TENANT-ROOT-HAS-PARENT"]),
        ([("c", True, [], [])], [("hub", "c", None, []), ("x", "no", "gone", [])], ["TENANT-PARENT-UNKNOWN", "TENANT-TYPE-UNKNOWN"]),
    ],
)
def test_tenant_rules(spark, types, dbs, codes):
    t = frame(spark, [dict(zip(("type", "root", "allowed_parents", "required_sections"), x)) for x in types], TENANT_TYPE_DDL)
    d = frame(spark, [dict(zip(("name", "type", "parent", "sections"), x)) for x in dbs], TENANT_DATABASE_DDL)
    s = frame(spark, [{"name": "Core", "tables": [], "is_module": True, "erds": []}], SECTION_DDL)
    assert sorted(r["code"] for r in validate.validate_tenants(t, d, s).collect()) == codes


@pytest.mark.parametrize("schemas, names", [(None, {"app.a", "APP.b", "x.c", "plain"}), (" App ,", {"app.a", "APP.b"}), ("plain", set()), ("x,app", {"app.a", "APP.b", "x.c"})])
def test_schema_filter(spark, schemas, names):
    tables = spark.createDataFrame([("app.a",), ("APP.b",), ("x.c",), ("plain",)], "name string")
    assert {r["name"] for r in filters.schema_filter(tables, schemas).collect()} == names


def test_reference_detection(spark):
    names = spark.createDataFrame([(n,) for n in ("OrderStatus", "BigStatus", "UnknownStatus", "Orders", "Listed", "a.b")], "name string")
    counts = spark.createDataFrame([("orderstatus", 5), ("bigstatus", 500), ("orders", 5), ("listed", 10_000), ("a.b", 1)], "name string, n_rows long")
    found = filters.reference_tables(names, counts, ["LISTED"], ["*status", "a?b"])
    assert {r["name"] for r in found.collect() if r["is_reference"]} == {"OrderStatus", "UnknownStatus", "Listed"}


def test_unordered_rows_across_spans(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "c"), (15, "b"), (31, "d"), (32, "9"), (33, "10")], "p int, k string")
    for span in (1, 10, 1000):
        assert {r["p"] for r in validate.unordered_rows(rows, "p", ["k"], span).collect()} == {15, 32, 33}


def test_skipped_folders(spark):
    paths = spark.createDataFrame([("a/Skip/x.json",), ("a/b/skip",), ("a/skipped/x.json",)], "p string")
    from pyspark.sql import functions as F

    assert {r["p"] for r in paths.filter(filters.skipped_folder(F.col("p"), ["skip"])).collect()} == {"a/Skip/x.json"}


def test_order_of_rows_with_ties_and_without_positions(spark):
    rows = [(1, "b"), (1, "a"), (2, "a"), (3, None), (4, "z"), (None, "0"), (70_000, "y"), (140_000, "z"), (140_000, "x")]
    frame = spark.createDataFrame(rows, "at long, k string")
    got = sorted((r["at"], r["k"] or "") for r in validate.unordered_rows(frame, "at", ["k"], span=10).collect())
    assert got == [(2, "a"), (3, ""), (70_000, "y"), (140_000, "x")]
    assert validate.unordered_rows(frame.limit(0), "at", ["k"]).isEmpty()


def test_members_of_broken_and_null_objects(spark):
    frame = spark.createDataFrame([(1, '{"a":1,"b":2}'), (2, None), (3, "no json"), (4, "{}")], "id int, j string")
    from pyspark.sql import functions as F

    got = sorted(map(tuple, validate.member_problems(frame, "j", F.array(F.lit("a"), F.lit("c")), "id").collect()))
    assert got == [(1, "missing", "c"), (1, "unknown", "b")] + [(i, "missing", x) for i in (2, 3, 4) for x in ("a", "c")]
