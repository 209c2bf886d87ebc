"""Comparing two snapshots: tables, fields, keys, indexes and rows.

Every function takes relations of a repo and of a live snapshot and returns one frame
of changes.  Metadata sides are small and left for Catalyst to broadcast; row diffs are
one full outer join on the key with the changed columns computed in its projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.model import Registry, union_all


def _sides(repo: DataFrame, live: DataFrame, on: Sequence[str], how: str = "full_outer") -> DataFrame:
    """Both sides under ``r.`` and ``l.``, joined on equal (never null) key columns."""
    r, l = repo.alias("r"), live.alias("l")
    condition = None
    for c in on:
        same = F.col(f"r.{c}") == F.col(f"l.{c}")
        condition = same if condition is None else condition & same
    return r.join(l, condition, how)


def table_presence(repo: DataFrame, live: DataFrame) -> DataFrame:
    """(table_key, repo_name, live_name, presence) with matched, extra_in_db or missing_in_db."""
    r = repo.select(F.lower("name").alias("k"), F.col("name").alias("repo_name"))
    l = live.select(F.lower("name").alias("k"), F.col("name").alias("live_name"))
    state = F.when(F.col("repo_name").isNull(), "extra_in_db").when(F.col("live_name").isNull(), "missing_in_db").otherwise("matched")
    return r.join(l, "k", "full_outer").select(F.col("k").alias("table_key"), "repo_name", "live_name", state.alias("presence"))


def _property_changes(r: str = "r", l: str = "l") -> Column:
    """up to five change structs of a matched field, in fixed order."""

    def change(kind: str, differs: Column, old: Column, new: Column) -> Column:
        return F.when(differs, F.struct(F.lit(kind).alias("kind"), old.alias("old_value"), new.alias("new_value")))

    a, b = (lambda c: F.col(f"{r}.{c}")), (lambda c: F.col(f"{l}.{c}"))
    apart = lambda c: ~a(c).eqNullSafe(b(c))
    text = lambda x: x.cast("string")
    changes = F.array(
        change("TypeChanged", ~F.lower(a("type")).eqNullSafe(F.lower(b("type"))), a("type"), b("type")),
        change("NullabilityChanged", apart("nullable"), text(a("nullable")), text(b("nullable"))),
        change("DefaultChanged", apart("default"), a("default"), b("default")),
        change("ComputedExpressionChanged", apart("is_computed") | apart("computed_expression"), a("computed_expression"), b("computed_expression")),
        change("IsPersistedChanged", apart("is_persisted"), text(a("is_persisted")), text(b("is_persisted"))),
    )
    return F.filter(changes, lambda x: x.isNotNull())


def _matched_tables(repo: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both relations cut down to tables of both snapshots."""
    both = repo.select("table_key").distinct().join(live.select("table_key").distinct(), "table_key")
    return repo.join(both, "table_key", "left_semi"), live.join(both, "table_key", "left_semi")


def field_changes(repo: DataFrame, live: DataFrame) -> DataFrame:
    """(table_key, field_name, kind, old_value, new_value) of changed and removed fields of matched tables."""
    repo, live = _matched_tables(repo, live)
    removed = F.struct(F.lit("Removed").alias("kind"), F.col("r.type").alias("old_value"), F.lit(None).cast("string").alias("new_value"))
    changes = F.when(F.col("l.field_key").isNull(), F.array(removed)).otherwise(_property_changes())
    both = _sides(repo, live, ("table_key", "field_key"), "left")
    return both.select(F.col("r.table_key").alias("table_key"), F.col("r.name").alias("field_name"), F.explode(changes).alias("c")).select("table_key", "field_name", "c.*")


def extra_columns(repo: DataFrame, live: DataFrame) -> DataFrame:
    """(table_key, column_name) of live columns that the repo table lacks."""
    repo, live = _matched_tables(repo, live)
    return live.join(repo, ["table_key", "field_key"], "left_anti").select("table_key", F.col("name").alias("column_name"))


def ordered_names(relation: DataFrame, name: str = "names") -> DataFrame:
    """A table's names in their order, and their case-insensitive form."""
    pairs = F.array_sort(F.collect_list(F.struct("ordinal", "name")))
    return relation.groupBy("table_key").agg(F.transform(pairs, lambda x: x["name"]).alias(name))


def pk_changes(repo: Registry, live: Registry) -> DataFrame:
    """(table_key, before, after) of matched tables whose key columns or their order differ."""
    tables = repo.tables.select("table_key").join(live.tables.select("table_key"), "table_key")
    both = tables.join(ordered_names(repo.primary_keys, "before"), "table_key", "left").join(ordered_names(live.primary_keys, "after"), "table_key", "left")
    empty = F.array().cast("array<string>")
    both = both.select("table_key", F.coalesce("before", empty).alias("before"), F.coalesce("after", empty).alias("after"))
    lower = lambda c: F.transform(c, lambda x: F.lower(x))
    return both.filter(lower("before") != lower("after"))


FK_KEY = ("table_key", "source_key", "target_key", "target_field_key")


def fk_keyed(fks: DataFrame) -> DataFrame:
    """foreign keys with the case-insensitive columns they are matched on."""
    return fks.withColumns({"source_key": F.lower("source_field"), "target_key": F.lower("target_table"), "target_field_key": F.lower("target_field")})


def fk_changes(repo: DataFrame, live: DataFrame, strict_reference: bool = False) -> DataFrame:
    """(table_key, source_field, target_table, target_field, kind, old_value, new_value).

    Only physical repo keys take part.  A live key that the repo has as logical or
    virtual is no addition, unless ``strict_reference``.
    """
    repo, live = fk_keyed(repo), fk_keyed(live)
    physical = repo.filter(F.lower("kind") == "physical")
    both = _sides(physical, live, FK_KEY)
    kind = F.when(F.col("l.table_key").isNull(), "Removed").when(F.col("r.table_key").isNull(), "Added").when(F.col("r.cascade_delete") != F.col("l.cascade_delete"), "CascadeDeleteChanged")
    pick = lambda c: F.coalesce(f"r.{c}", f"l.{c}").alias(c)
    value = lambda side: F.when(kind == "CascadeDeleteChanged", F.col(f"{side}.cascade_delete").cast("string"))
    found = both.select(*map(pick, FK_KEY), pick("source_field"), pick("target_table"), pick("target_field"), kind.alias("kind"), value("r").alias("old_value"), value("l").alias("new_value"))
    found = found.filter("kind is not null")
    if not strict_reference:
        soft = repo.filter(F.lower("kind") != "physical").select(*FK_KEY, F.lit("Added").alias("kind"))
        found = found.join(soft, [*FK_KEY, "kind"], "left_anti")
    return found.select("table_key", "source_field", "target_table", "target_field", "kind", "old_value", "new_value")


def index_changes(repo: DataFrame, live: DataFrame) -> DataFrame:
    """(table_key, index_name, kind, old_columns, new_columns, old_is_unique, new_is_unique)."""
    both = _sides(repo, live, ("table_key", "index_key"))
    lower = lambda c: F.transform(c, lambda x: F.lower(x))
    kind = (
        F.when(F.col("l.index_key").isNull(), "Removed").when(F.col("r.index_key").isNull(), "Added")
        .when(lower("r.columns") != lower("l.columns"), "ColumnsChanged").when(F.col("r.is_unique") != F.col("l.is_unique"), "UniquenessChanged")
    )
    joined = lambda side, kinds: F.when(kind.isin(kinds), F.array_join(f"{side}.columns", ", "))
    unique = lambda side: F.when(kind == "UniquenessChanged", F.col(f"{side}.is_unique"))
    out = both.select(
        F.coalesce("r.table_key", "l.table_key").alias("table_key"), F.coalesce("r.name", "l.name").alias("index_name"), kind.alias("kind"),
        joined("r", ["Removed", "ColumnsChanged"]).alias("old_columns"), joined("l", ["Added", "ColumnsChanged"]).alias("new_columns"),
        unique("r").alias("old_is_unique"), unique("l").alias("new_is_unique"),
    )
    return out.filter("kind is not null")


def row_diff(repo: DataFrame, live: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Keys, ``kind`` (Added, Removed, Modified) and ``changed_fields`` of rows that differ.

    Keys are matched null-safely and must be unique on each side (``duplicate_keys``
    finds those that aren't).  Values are compared null-safely; changed_fields lists
    columns in their order and is empty for added and removed rows.
    """
    columns = [c for c in repo.columns if c not in keys] if columns is None else list(columns)
    r = repo.select(*keys, *columns, F.lit(True).alias("_in")).alias("r")
    l = live.select(*keys, *columns, F.lit(True).alias("_in")).alias("l")
    condition = None
    for k in keys:
        same = F.col(f"r.{k}").eqNullSafe(F.col(f"l.{k}"))
        condition = same if condition is None else condition & same
    both = r.join(l, condition, "full_outer")
    in_both = F.col("r._in").isNotNull() & F.col("l._in").isNotNull()
    changed = F.concat_ws(", ", *[F.when(in_both & ~F.col(f"r.{c}").eqNullSafe(F.col(f"l.{c}")), F.lit(c)) for c in columns])
    kind = F.when(F.col("r._in").isNull(), "Added").when(F.col("l._in").isNull(), "Removed").otherwise("Modified")
    own = [F.when(F.col("r._in").isNotNull(), F.col(f"r.{k}")).otherwise(F.col(f"l.{k}")).alias(k) for k in keys]
    return both.select(*own, kind.alias("kind"), changed.alias("changed_fields")).filter("kind <> 'Modified' or changed_fields <> ''")


def row_diff_summary(changes: DataFrame) -> DataFrame:
    """A10: one row of counts by kind and whether there is any drift."""
    n = lambda k: F.count_if(F.col("kind") == k).alias(k.lower())
    return changes.agg(n("Added"), n("Removed"), n("Modified"), (F.count("*") > 0).alias("has_drift"))


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A1: keys that more than one row has, with the number of rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def reference_row_changes(repo: Registry, live: Registry, strict_reference: bool = False) -> DataFrame:
    """J5 over embedded rows: (table_key, pk, kind, changed_fields).

    Rows are maps of raw JSON tokens, matched on the repo table's key columns (an
    absent one counts as the token null).  Tables without a key are passed over; so
    are those where either side has no rows, unless ``strict_reference``, which
    needs both to be empty.
    """
    keys = ordered_names(repo.primary_keys, "pk_columns")

    def keyed(side: Registry) -> DataFrame:
        pk = F.transform("pk_columns", lambda c: F.coalesce(F.try_element_at("row", c), F.lit("null")))
        return side.ref_rows.join(keys, "table_key").select("table_key", pk.alias("pk"), "row", F.map_keys("row").alias("ks"))

    r, l = keyed(repo), keyed(live)
    if not strict_reference:
        both = r.select("table_key").distinct().join(l.select("table_key").distinct(), "table_key")
        r, l = r.join(both, "table_key", "left_semi"), l.join(both, "table_key", "left_semi")
    else:
        both = repo.tables.select("table_key").join(live.tables.select("table_key"), "table_key")
        r, l = r.join(both, "table_key", "left_semi"), l.join(both, "table_key", "left_semi")
    joined = _sides(r, l, ("table_key", "pk"))
    changed = F.filter(F.array_union("r.ks", "l.ks"), lambda k: ~F.try_element_at("r.row", k).eqNullSafe(F.try_element_at("l.row", k)))
    kind = F.when(F.col("r.pk").isNull(), "Added").when(F.col("l.pk").isNull(), "Removed").otherwise("Modified")
    out = joined.select(
        F.coalesce("r.table_key", "l.table_key").alias("table_key"), F.coalesce("r.pk", "l.pk").alias("pk"), kind.alias("kind"),
        F.when(kind == "Modified", F.array_join(changed, ", ")).otherwise("").alias("changed_fields"),
    )
    return out.filter("kind <> 'Modified' or changed_fields <> ''")


def drift_counts(repo: Registry, live: Registry, strict_reference: bool = False) -> DataFrame:
    """Changes by matched table and grain, with has_drift and has_warnings.

    Extra live columns are warnings; with ``strict_reference`` they count as drift.
    """
    found = union_all(
        [
            field_changes(repo.fields, live.fields).select("table_key", F.lit("field").alias("grain")),
            pk_changes(repo, live).select("table_key", F.lit("primary_key").alias("grain")),
            fk_changes(repo.foreign_keys, live.foreign_keys, strict_reference).select("table_key", F.lit("foreign_key").alias("grain")),
            index_changes(repo.indexes, live.indexes).select("table_key", F.lit("index").alias("grain")),
            reference_row_changes(repo, live, strict_reference).select("table_key", F.lit("row").alias("grain")),
            extra_columns(repo.fields, live.fields).select("table_key", F.lit("extra_column").alias("grain")),
        ]
    )
    tables = repo.tables.select("table_key").join(live.tables.select("table_key"), "table_key")
    counted = tables.join(found, "table_key", "left").groupBy("table_key")
    n = lambda g: F.count_if(F.col("grain") == g)
    grains = ("field", "primary_key", "foreign_key", "index", "row", "extra_column")
    out = counted.agg(*[n(g).alias(f"n_{g}") for g in grains])
    total = sum((F.col(f"n_{g}") for g in grains[: 6 if strict_reference else 5]), F.lit(0))
    return out.withColumns({"has_drift": total > 0, "has_warnings": F.col("n_extra_column") > 0})
