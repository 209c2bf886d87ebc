"""Merging a live snapshot into a repo one under per-column ownership.

From live: the set of fields, type, nullable, default, computed flags, primary key,
physical foreign keys and their cascade, indexes, checks, uniques.  From repo:
descriptions, match flag, sensitivity, deprecation, kinds of foreign keys, logical and
virtual ones, and everything else of the document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.model import Registry
from plumbline.operators.diff import FK_KEY, _matched_tables, _sides, field_changes, fk_keyed, pk_changes

LIVE_OWNED = ("type", "nullable", "default", "is_computed", "computed_expression", "is_persisted")
REPO_OWNED = ("description", "is_match_column", "is_deprecated", "deprecation_message", "sensitivity", "description_auto_generated")


def merge_fields(repo: DataFrame, live: DataFrame, live_keys: DataFrame, remove_deleted: bool = False) -> DataFrame:
    """Merged fields of matched tables with ``ordinal`` and ``state``.

    ``state`` is kept, orphan (in repo only; dropped with ``remove_deleted``) or
    added.  Repo order comes first, then new columns in live order; is_primary_key is
    set anew from the live key.
    """
    repo, live = _matched_tables(repo, live)
    both = _sides(repo, live, ("table_key", "field_key"))
    in_repo, in_live = F.col("r.field_key").isNotNull(), F.col("l.field_key").isNotNull()
    state = F.when(in_repo & in_live, "kept").when(in_repo, "orphan").otherwise("added")
    blank = {"description": F.lit(""), "is_match_column": F.lit(False)}
    merged = both.select(
        F.coalesce("r.table_key", "l.table_key").alias("table_key"), F.coalesce("r.table_name", "l.table_name").alias("table_name"),
        F.coalesce("r.field_key", "l.field_key").alias("field_key"), F.coalesce("r.name", "l.name").alias("name"),
        *[F.when(in_live, F.col(f"l.{c}")).otherwise(F.col(f"r.{c}")).alias(c) for c in LIVE_OWNED],
        *[F.when(in_repo, F.col(f"r.{c}")).otherwise(blank.get(c, F.col(f"l.{c}"))).alias(c) for c in REPO_OWNED],
        state.alias("state"), (~in_repo).alias("_new"), F.coalesce("r.ordinal", "l.ordinal").alias("_at"),
    )
    if remove_deleted:
        merged = merged.filter("state <> 'orphan'")
    keys = live_keys.select("table_key", "field_key", F.lit(True).alias("_pk")).distinct()
    merged = merged.join(keys, ["table_key", "field_key"], "left")
    place = F.row_number().over(Window.partitionBy("table_key").orderBy("_new", "_at")) - 1
    return merged.select("*", place.alias("ordinal"), F.coalesce("_pk", F.lit(False)).alias("is_primary_key")).drop("_new", "_at", "_pk")


def merge_fks(repo: DataFrame, live: DataFrame) -> DataFrame:
    """Merged foreign keys with ``ordinal``.

    Matched keys keep the repo's kind and take the live cascade; physical ones that
    live lacks go; logical and virtual ones stay; live-only ones come last as physical.
    """
    both = _sides(fk_keyed(repo), fk_keyed(live), FK_KEY)
    in_repo, in_live = F.col("r.table_key").isNotNull(), F.col("l.table_key").isNotNull()
    pick = lambda c: F.coalesce(f"r.{c}", f"l.{c}").alias(c)
    merged = both.filter(in_live | (F.lower("r.kind") != "physical")).select(
        pick("table_key"), pick("source_field"), pick("target_table"), pick("target_field"),
        F.coalesce("l.cascade_delete", "r.cascade_delete").alias("cascade_delete"), F.when(in_repo, F.col("r.kind")).otherwise("physical").alias("kind"),
        (~in_repo).alias("_new"), pick("ordinal").alias("_at"),
    )
    place = F.row_number().over(Window.partitionBy("table_key").orderBy("_new", "_at")) - 1
    return merged.withColumn("ordinal", place).drop("_new", "_at")


def merge_fk_changes(repo: DataFrame, live: DataFrame) -> DataFrame:
    """What a merge changes in foreign keys of any kind, with the columns of ``fk_changes``.

    Added (live only), Removed (physical ones that live lacks) and CascadeDeleteChanged.
    """
    both = _sides(fk_keyed(repo), fk_keyed(live), FK_KEY)
    in_repo, in_live = F.col("r.table_key").isNotNull(), F.col("l.table_key").isNotNull()
    gone = ~in_live & (F.lower("r.kind") == "physical")
    kind = F.when(~in_repo, "Added").when(gone, "Removed").when(in_live & (F.col("r.cascade_delete") != F.col("l.cascade_delete")), "CascadeDeleteChanged")
    names = ("table_key", "source_field", "target_table", "target_field")
    value = lambda side: F.when(kind == "CascadeDeleteChanged", F.col(f"{side}.cascade_delete").cast("string"))
    return both.select(*[F.coalesce(f"r.{c}", f"l.{c}").alias(c) for c in names], kind.alias("kind"), value("r").alias("old_value"), value("l").alias("new_value")).filter("kind is not null")


def orphaned_data_keys(ref_rows: DataFrame, fields: DataFrame) -> DataFrame:
    """(table_key, data_key) of row members that no field has; the first spelling of each."""
    keys = ref_rows.select("table_key", "row_index", F.posexplode(F.map_keys("row")).alias("at", "data_key")).withColumn("field_key", F.lower("data_key"))
    lost = keys.join(fields.select("table_key", "field_key"), ["table_key", "field_key"], "left_anti")
    first = F.row_number().over(Window.partitionBy("table_key", "field_key").orderBy("row_index", "at"))
    return lost.withColumn("_n", first).filter("_n = 1").select("table_key", "data_key")


def orphan_columns(merged_fields: DataFrame) -> DataFrame:
    return merged_fields.filter("state = 'orphan'").select("table_key", F.col("name").alias("column_name"))


def merge_documents(repo: Registry, live: Registry, remove_deleted: bool = False) -> DataFrame:
    """Whole merged documents of matched tables, in the schema of documents."""
    fields = merge_fields(repo.fields, live.fields, live.primary_keys, remove_deleted)
    names = [f.name for f in repo.documents.schema["fields"].dataType.elementType.fields]
    gather = lambda df, cols: F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.struct(*cols).alias("x")))), lambda s: s["x"])
    own = fields.groupBy("table_key").agg(gather(fields, names).alias("m_fields"))
    fks = merge_fks(repo.foreign_keys, live.foreign_keys)
    fks = fks.groupBy("table_key").agg(gather(fks, ["source_field", "target_table", "target_field", "cascade_delete", "kind"]).alias("m_fks"))
    kept = live.tables.select("table_key", F.col("primary_key").alias("m_pk"), F.col("indexes").alias("m_indexes"), F.col("check_constraints").alias("m_checks"), F.col("unique_constraints").alias("m_uniques"))
    joined = repo.tables.join(kept, "table_key").join(own, "table_key").join(fks, "table_key", "left")
    same_key = F.transform("primary_key", lambda x: F.lower(x)) == F.transform("m_pk", lambda x: F.lower(x))
    taken = {
        "fields": F.col("m_fields"), "primary_key": F.when(same_key, F.col("primary_key")).otherwise(F.col("m_pk")),
        "foreign_keys": F.coalesce("m_fks", F.array().cast(repo.documents.schema["foreign_keys"].dataType)),
        "indexes": F.col("m_indexes"), "check_constraints": F.col("m_checks"), "unique_constraints": F.col("m_uniques"),
    }
    return joined.select(*[taken.get(f.name, F.col(f.name)).alias(f.name) for f in repo.documents.schema.fields])


def merge_session(repo: Registry, live: Registry, remove_deleted: bool = False, strict_reference: bool = False) -> DataFrame:
    """(table_key, outcome) with modified, unchanged, new, orphan.

    A change of indexes, checks or uniques alone makes a table modified, unless
    ``strict_reference``, which takes only fields, keys and foreign keys into account.
    """
    changed = field_changes(repo.fields, live.fields).filter("kind <> 'Removed'" if not remove_deleted else "true").select("table_key")
    added = merge_fields(repo.fields, live.fields, live.primary_keys).filter("state = 'added'").select("table_key")
    keys = pk_changes(repo, live).select("table_key")
    fks = merge_fk_changes(repo.foreign_keys, live.foreign_keys).select("table_key")
    changed = changed.union(added).union(keys).union(fks)
    if not strict_reference:
        a = repo.tables.select("table_key", F.struct("indexes", "check_constraints", "unique_constraints").alias("a"))
        b = live.tables.select("table_key", F.struct("indexes", "check_constraints", "unique_constraints").alias("b"))
        changed = changed.union(a.join(b, "table_key").filter("a <> b").select("table_key"))
    changed = changed.distinct().withColumn("_c", F.lit(True))
    r, l = repo.tables.select("table_key", F.lit(True).alias("_r")), live.tables.select("table_key", F.lit(True).alias("_l"))
    both = r.join(l, "table_key", "full_outer").join(changed, "table_key", "left")
    outcome = F.when(F.col("_r").isNull(), "new").when(F.col("_l").isNull(), "orphan").when(F.col("_c"), "modified").otherwise("unchanged")
    return both.select("table_key", outcome.alias("outcome"))


def merged_registry(repo: Registry, live: Registry, remove_deleted: bool = False) -> Registry:
    """The repo after a merge: merged tables, repo-only ones as they were, live-only ones as they are."""
    merged = merge_documents(repo, live, remove_deleted)
    only_repo = repo.tables.join(live.tables.select("table_key"), "table_key", "left_anti").drop("table_key")
    only_live = live.tables.join(repo.tables.select("table_key"), "table_key", "left_anti").drop("table_key")
    return Registry(merged.unionByName(only_repo).unionByName(only_live), repo.sections, repo.endpoints)


