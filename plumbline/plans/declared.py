"""Literal registries that the metadata queries run over, with seeded defects.

``live_documents`` mirrors the schemas of the data tables; ``repo_documents`` is what a
repository might say about them, with drift of every kind, and ``rule_documents`` breaks
each validation rule at least once.  ``values`` writes the same literals as SQL.
"""

from __future__ import annotations

from plumbline.model import table_document

#: Columns and types of the data tables.
COLUMNS = {
    "region": "r_regionkey integer, r_name varchar",
    "nation": "n_nationkey integer, n_name varchar, n_regionkey integer",
    "customer": "c_custkey bigint, c_name varchar, c_nationkey integer, c_acctbal double, c_mktsegment varchar",
    "supplier": "s_suppkey bigint, s_name varchar, s_nationkey integer, s_acctbal double",
    "part": "p_partkey bigint, p_name varchar, p_brand varchar, p_type varchar, p_size integer, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus varchar, o_totalprice double, o_orderdate timestamp, o_orderpriority varchar",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber integer, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag varchar, l_linestatus varchar, l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"]}
_FKS = {
    "nation": [("n_regionkey", "region", "r_regionkey")], "customer": [("c_nationkey", "nation", "n_nationkey")], "supplier": [("s_nationkey", "nation", "n_nationkey")],
    "orders": [("o_custkey", "customer", "c_custkey")], "lineitem": [("l_orderkey", "orders", "o_orderkey"), ("l_partkey", "part", "p_partkey"), ("l_suppkey", "supplier", "s_suppkey")],
    "events": [("user_id", "customer", "c_custkey")],
}
_INDEXES = {
    "orders": [("ix_orders_customer", ["o_custkey", "o_orderdate"], False), ("ix_orders_date", ["o_orderdate"], False), ("ix_orders_status", ["o_orderstatus"], False)],
    "customer": [("ux_customer_name", ["c_name"], True)], "lineitem": [("ix_lineitem_part", ["l_partkey", "l_suppkey"], False)],
}


def _fields(spec: str) -> list[dict]:
    return [dict(zip(("name", "type"), part.strip().rsplit(" ", 1))) | {"nullable": True} for part in spec.split(", ")]


def live_documents() -> list[dict]:
    """The data tables with their keys, foreign keys and indexes."""
    fk = lambda x: dict(zip(("source_field", "target_table", "target_field"), x)) | {"cascade_delete": False, "kind": "physical"}
    ix = lambda x: dict(zip(("name", "columns", "is_unique"), x))
    out = []
    for name, spec in COLUMNS.items():
        data = [{"r_regionkey": str(i), "r_name": f'"REGION {i}"'} for i in range(1, 6)] if name == "region" else []
        out.append(table_document(name=name, fields=_fields(spec), primary_key=_KEYS[name], foreign_keys=[fk(x) for x in _FKS.get(name, [])], indexes=[ix(x) for x in _INDEXES.get(name, [])], data=data, is_reference_table=name == "region"))
    return out


def repo_documents() -> list[dict]:
    """The same tables as a repository holds them, drifted in every way, plus one table that live lacks."""
    docs = {d["name"]: d for d in live_documents() if d["name"] != "events"}

    def change(table: str, field: str, **values) -> None:
        docs[table]["fields"] = [f | values if f["name"] == field else f for f in docs[table]["fields"]]

    def drop(table: str, field: str) -> None:
        docs[table]["fields"] = [f for f in docs[table]["fields"] if f["name"] != field]

    def add(table: str, at: int, **values) -> None:
        extra = table_document(name="x", fields=[values])["fields"]
        docs[table]["fields"] = docs[table]["fields"][:at] + extra + docs[table]["fields"][at:]

    change("customer", "c_acctbal", type="decimal(15,2)", description="Balance of the account")
    change("customer", "c_name", name="C_NAME", type="VARCHAR", is_match_column=True, sensitivity="pii", description="Full name")
    change("customer", "c_custkey", nullable=False)
    change("orders", "o_totalprice", default="0")
    change("orders", "o_orderstatus", is_computed=True, computed_expression="(upper(o_state))", is_persisted=True)
    change("supplier", "s_acctbal", type="double", description="Balance", is_deprecated=True, deprecation_message="use the ledger")
    drop("orders", "o_orderpriority")
    drop("part", "p_size")
    add("customer", 2, name="c_comment", type="varchar(117)", nullable=True, description="Free text")
    add("lineitem", 4, name="l_comment", type="varchar(44)", nullable=True)
    docs["lineitem"]["primary_key"] = ["l_linenumber", "l_orderkey"]
    docs["customer"]["primary_key"] = ["C_CUSTKEY"]
    docs["part"]["primary_key"] = ["p_partkey", "p_name"]
    docs["orders"]["foreign_keys"] = [{"source_field": "O_CUSTKEY", "target_table": "Customer", "target_field": "c_custkey", "cascade_delete": True, "kind": "physical"}]
    docs["supplier"]["foreign_keys"] = [docs["supplier"]["foreign_keys"][0] | {"kind": "logical"}]
    docs["nation"]["foreign_keys"] = [docs["nation"]["foreign_keys"][0] | {"kind": "logical", "cascade_delete": True}]
    docs["part"]["foreign_keys"] = [{"source_field": "p_brand", "target_table": "brand", "target_field": "id", "cascade_delete": False, "kind": "physical"}, {"source_field": "p_type", "target_table": "orders", "target_field": "o_orderkey", "cascade_delete": False, "kind": "virtual"}]
    docs["lineitem"]["foreign_keys"] = docs["lineitem"]["foreign_keys"][:2]
    docs["orders"]["indexes"] = [
        {"name": "IX_Orders_Customer", "columns": ["O_CUSTKEY", "o_orderdate"], "is_unique": True, "is_clustered": False, "is_filtered": False},
        {"name": "ix_orders_date", "columns": ["o_orderdate", "o_orderkey"], "is_unique": False, "is_clustered": False, "is_filtered": False},
        {"name": "ix_orders_old", "columns": ["o_totalprice"], "is_unique": False, "is_clustered": False, "is_filtered": False},
    ]
    docs["region"]["data"] = [{"r_regionkey": "1", "r_name": '"REGION 1"', "R_Note": "null"}, {"r_regionkey": "2", "r_name": '"SOUTH"'}, {"r_regionkey": "9", "r_name": '"LOST"', "r_note": '"x"'}, {"r_regionkey": "4", "r_name": '"REGION 4"'}]
    docs["brand_old"] = table_document(name="brand_old", fields=[{"name": "id", "type": "integer"}], primary_key=["id"])
    out = list(docs.values())
    for d in out:
        d["source_file"] = f"tables/{d['name']}.json"
    return out


def rule_documents() -> list[dict]:
    """Tables that break each rule of single tables."""
    f = lambda name, type="int", **v: {"name": name, "type": type, "nullable": False} | v
    fk = lambda s, t, u="id", **v: {"source_field": s, "target_table": t, "target_field": u, "cascade_delete": False, "kind": "physical"} | v
    docs = [
        table_document(name=" ", fields=[f("id")], primary_key=["id"], source_file="tables/blank.json"),
        table_document(name="app.empty", primary_key=["id"], sections=["Core", "Nowhere"], is_reference_table=True, data=[{"id": "2"}, {"id": "1"}, {"id": "2"}], source_file="tables/empty.json"),
        table_document(
            name="app.keys", fields=[f("id", nullable=True), f("parent_id"), f("code", "varchar(10)", nullable=True, is_match_column=True)], primary_key=["id", "ID", "nope"],
            foreign_keys=[fk("parent_id", "app.keys"), fk("lost_id", "app.state"), fk("parent_id", "app.gone", cascade_delete=True, kind="logical"), fk("code", "app.far", kind="virtual")],
            label_field="Title", database_types=["MySQL", "MSSQL", "Postgres"], sections=["Core", "Nowhere"], source_file="tables/keys.json",
        ),
        table_document(
            name="app.calc", fields=[f("id"), f("total", "decimal(10,2)", is_computed=True, computed_expression=" "), f("tax", "decimal(10,2)", is_computed=True, computed_expression="(total*0.2)"), f("label", "text")],
            primary_key=["id"], sets=[{"name": "writable", "columns": ["LABEL", "Tax"]}, {"name": "all", "columns": ["id", "total"]}], label_field="LABEL", database_types=["postgresql"], sections=["core"], source_file="tables/calc.json",
        ),
        table_document(
            name="app.old", fields=[f("ID", is_deprecated=True), f("user", is_deprecated=True, is_match_column=True), f("mail", "text", sensitivity="PII"), f("note", "text", sensitivity="secret"), f("name", "text", sensitivity="pii", description="Name")],
            primary_key=["ID"], foreign_keys=[fk("USER", "App.Keys")], check_constraints=[{"name": "ck_1", "expression": "a > 0", "column": "amount"}, {"name": "ck_2", "expression": "b", "column": None}, {"name": "ck_3", "expression": "c", "column": "MAIL"}],
            unique_constraints=[{"name": "uq_1", "columns": ["mail", "gone"]}], sections=["Sales"], source_file="tables/old.json",
        ),
        table_document(
            name="app.state", fields=[f("id"), f("name", "text")], primary_key=["id"], is_reference_table=True, source_file="tables/state.json",
            data=[{"id": "2", "name": '"b"'}, {"id": "10", "name": '"j"', "extra": "1"}, {"id": "2", "name": '"again"'}, {"id": "3"}],
        ),
    ]
    return docs


SECTIONS = [
    {"name": "Core", "title": "Core tables", "tables": ["app.keys", "APP.Calc", "app.missing"], "source_file": "sections/core.json", "is_module": True, "erds": [{"title": "Core", "tables": [], "include_virtual": False, "fields": "pk-and-fk"}]},
    {"name": "Sales", "tables": ["app.old", "app.keys"], "source_file": "sections/sales.json", "is_module": False, "erds": []},
    {"name": "Lookup", "title": "Lookup lists", "tables": ["app.state"], "source_file": "sections/lookup.json", "is_module": True, "erds": []},
]
SECTION_ORDER = ("Lookup", "nowhere", "core")
ENDPOINTS = [
    {"api": "orders", "method": "GET", "path": "/keys", "db_table": "App.Keys", "database_types": ["mysql", "oracle"], "source_file": "apis/orders.json"},
    {"api": "orders", "method": "POST", "path": "/lost", "db_table": "app.lost", "database_types": [], "source_file": "apis/orders.json"},
    {"api": "orders", "method": "GET", "path": "/old", "db_table": "app.old", "database_types": ["mysql"], "source_file": "apis/orders.json"},
    {"api": "orders", "method": "GET", "path": "/none", "db_table": None, "database_types": [], "source_file": "apis/orders.json"},
]
TENANT_TYPES = [
    {"type": "central", "root": True, "allowed_parents": [], "required_sections": ["Core"]},
    {"type": "partner", "root": False, "allowed_parents": ["central"], "required_sections": ["Core", "Lookup"]},
    {"type": "shop", "root": False, "allowed_parents": ["partner", "Shop"], "required_sections": []},
]
TENANT_DATABASES = [
    {"name": "hub", "type": "Central", "parent": None, "sections": ["core"]},
    {"name": "hub2", "type": "central", "parent": "hub", "sections": ["Core", "Sales"]},
    {"name": "p1", "type": "partner", "parent": "HUB", "sections": ["Core"]},
    {"name": "p2", "type": "partner", "parent": None, "sections": ["Core", "Lookup"]},
    {"name": "s1", "type": "shop", "parent": "p1", "sections": []},
    {"name": "s2", "type": "shop", "parent": "hub", "sections": []},
    {"name": "s3", "type": "shop", "parent": "nobody", "sections": []},
    {"name": "x1", "type": "alien", "parent": "p1", "sections": ["Unknown"]},
    {"name": "c1", "type": "shop", "parent": "c2", "sections": []},
    {"name": "c2", "type": "shop", "parent": "c3", "sections": []},
    {"name": "c3", "type": "shop", "parent": "c1", "sections": []},
]


#: A topology without any root.
ROOTLESS_TYPES = [t | {"root": False} for t in TENANT_TYPES]


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(literal, value)) + "]" if value else "CAST([] AS VARCHAR[])"
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


#: Columns of each relation in SQL and their types.
RELATIONS = {
    "tables": "name VARCHAR, label_field VARCHAR, is_reference_table BOOLEAN, database_types VARCHAR[], source_file VARCHAR, n_fields INTEGER",
    "fields": "table_name VARCHAR, ordinal INTEGER, name VARCHAR, type VARCHAR, nullable BOOLEAN, dflt VARCHAR, is_computed BOOLEAN, computed_expression VARCHAR, is_persisted BOOLEAN, is_match_column BOOLEAN, is_deprecated BOOLEAN, sensitivity VARCHAR, description VARCHAR",
    "pks": "table_name VARCHAR, ordinal INTEGER, name VARCHAR",
    "fks": "table_name VARCHAR, ordinal INTEGER, source_field VARCHAR, target_table VARCHAR, target_field VARCHAR, cascade_delete BOOLEAN, kind VARCHAR",
    "indexes": "table_name VARCHAR, ordinal INTEGER, name VARCHAR, columns VARCHAR[], is_unique BOOLEAN",
    "sets": "table_name VARCHAR, set_name VARCHAR, col VARCHAR",
    "checks": "table_name VARCHAR, name VARCHAR, col VARCHAR",
    "uniques": "table_name VARCHAR, name VARCHAR, col VARCHAR",
    "memberships": "table_name VARCHAR, section VARCHAR",
    "data": "table_name VARCHAR, row_index INTEGER, k VARCHAR, v VARCHAR",
}


def _relation_rows(docs: list[dict], relation: str) -> list[tuple]:
    many = lambda member: [(d["name"], i, x) for d in docs for i, x in enumerate(d[member])]
    if relation == "tables":
        return [(d["name"], d.get("label_field"), d["is_reference_table"], d["database_types"], d["source_file"], len(d["fields"])) for d in docs]
    if relation == "fields":
        names = ("name", "type", "nullable", "default", "is_computed", "computed_expression", "is_persisted", "is_match_column", "is_deprecated", "sensitivity", "description")
        return [(t, i, *[x.get(n) for n in names]) for t, i, x in many("fields")]
    if relation == "pks":
        return many("primary_key")
    if relation == "fks":
        return [(t, i, *[x[n] for n in ("source_field", "target_table", "target_field", "cascade_delete", "kind")]) for t, i, x in many("foreign_keys")]
    if relation == "indexes":
        return [(t, i, x["name"], x["columns"], x["is_unique"]) for t, i, x in many("indexes")]
    if relation == "sets":
        return [(t, x["name"], c) for t, _, x in many("sets") for c in x["columns"]]
    if relation == "checks":
        return [(t, x["name"], x["column"]) for t, _, x in many("check_constraints")]
    if relation == "uniques":
        return [(t, x["name"], c) for t, _, x in many("unique_constraints") for c in x["columns"]]
    if relation == "memberships":
        return [(t, x) for t, _, x in many("sections")]
    return [(t, i, k, v) for t, i, x in many("data") for k, v in x.items()]


def cte(name: str, columns: str, rows: list[tuple]) -> str:
    """A literal table as a common table expression, typed."""
    parts = [c.rsplit(" ", 1) for c in columns.split(", ")]
    casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in parts)
    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) or "(" + ", ".join("NULL" for _ in parts) + ")"
    return f"{name} AS (SELECT {casts} FROM (VALUES {body}) v({', '.join(n for n, _ in parts)}){'' if rows else ' WHERE false'})"


def ctes(prefix: str, docs: list[dict], *relations: str) -> str:
    return ",\n".join(cte(f"{prefix}{r}", RELATIONS[r], _relation_rows(docs, r)) for r in relations)
