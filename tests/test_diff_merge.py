import pytest

from plumbline.model import Registry
from plumbline.operators import diff, merge


def field(name, type="int", nullable=False, **v):
    return {"name": name, "type": type, "nullable": nullable} | v


def fk(source, target, column="id", **v):
    return {"source_field": source, "target_table": target, "target_field": column} | v


def table(*fields, name="dbo.Order", **v):
    return {"name": name, "fields": list(fields)} | v


def of(spark, *tables):
    return Registry.of(spark, list(tables))


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


@pytest.mark.parametrize(
    "a, b, kinds",
    [
        ({"type": "INT"}, {"type": "int"}, []),
        ({"type": "smallint"}, {"type": "int"}, ["TypeChanged"]),
        ({"nullable": True}, {}, ["NullabilityChanged"]),
        ({"default": "x"}, {"default": "X"}, ["DefaultChanged"]),
        ({"default": "x"}, {}, ["DefaultChanged"]),
        ({"is_computed": True}, {}, ["ComputedExpressionChanged"]),
        ({"is_computed": True, "computed_expression": "a"}, {"is_computed": True, "computed_expression": "b"}, ["ComputedExpressionChanged"]),
        ({"is_persisted": True}, {}, ["IsPersistedChanged"]),
        ({"description": "d", "sensitivity": "pii"}, {}, []),
        ({"type": "a", "nullable": True, "default": "1"}, {"type": "b"}, ["DefaultChanged", "NullabilityChanged", "TypeChanged"]),
    ],
)
def test_each_kind_of_field_change(spark, a, b, kinds):
    repo, live = of(spark, table(field("Id") | a)), of(spark, table(field("ID") | b, name="DBO.order"))
    assert [r[0] for r in rows(diff.field_changes(repo.fields, live.fields), "kind")] == kinds


def test_removed_and_extra_columns(spark):
    repo, live = of(spark, table(field("a"), field("b", "text"))), of(spark, table(field("A"), field("C")))
    assert rows(diff.field_changes(repo.fields, live.fields)) == [("dbo.order", "b", "Removed", "text", None)]
    assert rows(diff.extra_columns(repo.fields, live.fields)) == [("dbo.order", "C")]


def test_tables_of_one_side_only_are_no_field_changes(spark):
    repo, live = of(spark, table(field("a"), name="x")), of(spark, table(field("a"), name="y"))
    assert rows(diff.field_changes(repo.fields, live.fields)) == rows(diff.extra_columns(repo.fields, live.fields)) == []
    assert rows(diff.table_presence(repo.documents, live.documents), "table_key", "presence") == [("x", "missing_in_db"), ("y", "extra_in_db")]


@pytest.mark.parametrize("a, b, n", [(["x", "y"], ["X", "Y"], 0), (["x", "y"], ["y", "x"], 1), (["x"], [], 1), ([], ["x"], 1), ([], [], 0)])
def test_primary_key_order_counts(spark, a, b, n):
    repo, live = of(spark, table(field("x"), primary_key=a)), of(spark, table(field("x"), primary_key=b))
    found = diff.pk_changes(repo, live).collect()
    assert len(found) == n and all((r["before"], r["after"]) == (a, b) for r in found)


def test_foreign_key_kinds(spark):
    repo = of(spark, table(field("x"), foreign_keys=[fk("A", "T1", cascade_delete=True), fk("b", "t2"), fk("c", "t3", kind="logical"), fk("d", "t4", kind="virtual")]))
    live = of(spark, table(field("x"), foreign_keys=[fk("a", "t1"), fk("C", "t3"), fk("e", "t5")]))
    found = rows(diff.fk_changes(repo.foreign_keys, live.foreign_keys), "source_field", "kind")
    assert found == [("A", "CascadeDeleteChanged"), ("b", "Removed"), ("e", "Added")]
    strict = rows(diff.fk_changes(repo.foreign_keys, live.foreign_keys, strict_reference=True), "source_field", "kind")
    assert ("C", "Added") in strict


def test_index_kinds_and_columns_before_uniqueness(spark):
    ix = lambda n, c, u=False: {"name": n, "columns": c, "is_unique": u}
    repo = of(spark, table(field("x"), indexes=[ix("A", ["X", "y"]), ix("b", ["x"]), ix("c", ["x"]), ix("d", ["x"])]))
    live = of(spark, table(field("x"), indexes=[ix("a", ["x", "Y"]), ix("b", ["y"], True), ix("c", ["x"], True), ix("e", ["z"])]))
    assert rows(diff.index_changes(repo.indexes, live.indexes), "index_name", "kind") == [("b", "ColumnsChanged"), ("c", "UniquenessChanged"), ("d", "Removed"), ("e", "Added")]


def test_reference_rows_compare_raw_tokens(spark):
    make = lambda data, **v: of(spark, table(field("id"), primary_key=["id"], data=data, is_reference_table=True, **v))
    repo = make([{"id": "1", "v": "1.10"}, {"id": "2", "v": '"a"'}, {"id": "3", "v": "1"}])
    live = make([{"id": "1", "v": "1.1"}, {"id": "2", "v": '"a"'}, {"id": '"3"', "v": "1"}])
    assert rows(diff.reference_row_changes(repo, live), "pk", "kind", "changed_fields") == [(['"3"'], "Added", ""), (["1"], "Modified", "v"), (["3"], "Removed", "")]
    empty = make([])
    assert rows(diff.reference_row_changes(repo, empty)) == []
    assert len(rows(diff.reference_row_changes(repo, empty, strict_reference=True))) == 3


def test_row_diff_is_null_safe_and_antisymmetric(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (None, "n", 1), (4, "z", 4)], "k int, s string, n int")
    b = spark.createDataFrame([(1, "x", None), (2, None, 2), (None, "n", 1), (5, "z", 4)], "k int, s string, n int")
    found = {(r["k"], r["kind"], r["changed_fields"]) for r in diff.row_diff(a, b, ["k"]).collect()}
    assert found == {(2, "Modified", "s, n"), (4, "Removed", ""), (5, "Added", "")}
    swap = {"Added": "Removed", "Removed": "Added", "Modified": "Modified"}
    assert {(k, swap[c], f) for k, c, f in found} == {(r["k"], r["kind"], r["changed_fields"]) for r in diff.row_diff(b, a, ["k"]).collect()}
    assert diff.row_diff(a, a, ["k"]).isEmpty()


def pair(spark):
    repo = of(
        spark,
        table(field("id", description="key"), field("status", "smallint", description="s", is_match_column=True, sensitivity="pii"), field("old", "varchar(20)"), primary_key=["id"], foreign_keys=[fk("status", "st"), fk("x", "soft", kind="logical"), fk("gone", "t")], data=[{"ID": "1", "stale": "2", "Stale": "3"}], is_reference_table=True, description="Orders"),
        table(field("id"), name="only_repo"),
    )
    live = of(
        spark,
        table(field("ID"), field("Status", "int", True), field("new", "datetime", description="from live", is_match_column=True), name="DBO.ORDER", primary_key=["id"], foreign_keys=[fk("status", "st", cascade_delete=True), fk("new", "n")], indexes=[{"name": "ix", "columns": ["new"]}]),
        table(field("id"), name="only_live"),
    )
    return repo, live


def test_merge_ownership_and_order(spark):
    repo, live = pair(spark)
    merged = sorted((r["ordinal"], r["name"], r["type"], r["description"], r["is_match_column"], r["sensitivity"], r["state"], r["is_primary_key"]) for r in merge.merge_fields(repo.fields, live.fields, live.primary_keys).collect())
    assert merged == [
        (0, "id", "int", "key", False, None, "kept", True), (1, "status", "int", "s", True, "pii", "kept", False),
        (2, "old", "varchar(20)", "", False, None, "orphan", False), (3, "new", "datetime", "", False, None, "added", False),
    ]
    names = [r["name"] for r in merge.merge_fields(repo.fields, live.fields, live.primary_keys, True).orderBy("ordinal").collect()]
    assert names == ["id", "status", "new"]


def test_merge_foreign_keys(spark):
    repo, live = pair(spark)
    found = [(r["source_field"], r["kind"], r["cascade_delete"]) for r in merge.merge_fks(repo.foreign_keys, live.foreign_keys).orderBy("ordinal").collect()]
    assert found == [("status", "physical", True), ("x", "logical", False), ("new", "physical", False)]


def test_orphaned_data_keys_keep_the_first_spelling(spark):
    repo, live = pair(spark)
    merged = merge.merge_fields(repo.fields, live.fields, live.primary_keys)
    assert len(rows(merge.orphaned_data_keys(repo.ref_rows, merged))) == 1


def test_merge_is_idempotent_and_removes_drift(spark):
    repo, live = pair(spark)
    once = merge.merged_registry(repo, live, remove_deleted=True)
    twice = merge.merged_registry(once, live, remove_deleted=True)
    assert sorted(map(str, once.documents.collect())) == sorted(map(str, twice.documents.collect()))
    assert rows(diff.field_changes(once.fields, live.fields)) == rows(diff.pk_changes(once, live)) == []
    assert rows(diff.fk_changes(once.foreign_keys, live.foreign_keys)) == []
    assert dict(rows(merge.merge_session(once, live))) == {"dbo.order": "unchanged", "only_live": "unchanged", "only_repo": "orphan"}


def test_merge_session_sees_index_only_changes(spark):
    repo = of(spark, table(field("a")))
    live = of(spark, table(field("a"), indexes=[{"name": "ix", "columns": ["a"]}]))
    assert dict(rows(merge.merge_session(repo, live))) == {"dbo.order": "modified"}
    assert dict(rows(merge.merge_session(repo, live, strict_reference=True))) == {"dbo.order": "unchanged"}


def test_drift_counts_treat_extra_columns_as_warnings(spark):
    repo, live = of(spark, table(field("a"))), of(spark, table(field("a"), field("b")))
    assert [(r["has_drift"], r["has_warnings"]) for r in diff.drift_counts(repo, live).collect()] == [(False, True)]
    assert [r["has_drift"] for r in diff.drift_counts(repo, live, strict_reference=True).collect()] == [True]


def test_diff_of_a_snapshot_with_itself_is_empty(spark):
    repo, _ = pair(spark)
    assert not any(r["has_drift"] or r["has_warnings"] for r in diff.drift_counts(repo, repo).collect())
