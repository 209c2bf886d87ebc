"""The queries of the engine proper and their SQL, by name.

A query is a function (spark, sf_dir) -> DataFrame; ``query`` files it under its name
with the SQL that DuckDB can run on the same tables, if there is any.  Those over
documents, parsers and catalogs are in ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions import types as types_
from plumbline.model import SECTION_DDL, TENANT_DATABASE_DDL, TENANT_TYPE_DDL, frame
from plumbline.operators import capture, diff, erd, filters, graph, merge, validate
from plumbline.plans import declared as D
from plumbline.plans import documents  # noqa: F401  files its queries
from plumbline.plans.register import ORACLES, QUERIES, live, query, read, repo, rules  # noqa: F401
from plumbline.sources import catalog as live_catalog

# Row diffs


def _live_rows(df: DataFrame, key: str, changed: str, nulled: str) -> DataFrame:
    """The seeded live side of a row diff: changes, nulls, removals and additions by rules on the key."""
    k = F.col(key)
    seeded = df.filter(k % 97 != 0).withColumns({changed: F.when(k % 50 == 0, F.lit("X")).otherwise(F.col(changed)), nulled: F.when(k % 75 != 0, F.col(nulled))})
    return seeded.unionByName(df.filter(k % 101 == 0).withColumn(key, k + 10_000_000))


def _row_diff_sql(table: str, key: str, columns: list[str], changed: str, nulled: str) -> str:
    live_of = {changed: f"CASE WHEN {key} % 50 = 0 THEN 'X' ELSE {changed} END AS {changed}", nulled: f"CASE WHEN {key} % 75 <> 0 THEN {nulled} END AS {nulled}"}
    side = ", ".join(live_of.get(c, c) for c in columns)
    marks = ", ".join(f"CASE WHEN r.{key} IS NOT NULL AND l.{key} IS NOT NULL AND r.{c} IS DISTINCT FROM l.{c} THEN '{c}' END" for c in columns)
    return f"""WITH r AS (SELECT {key}, {', '.join(columns)} FROM {table}),
l AS (SELECT {key}, {side} FROM {table} WHERE {key} % 97 <> 0 UNION ALL SELECT {key} + 10000000, {', '.join(columns)} FROM {table} WHERE {key} % 101 = 0),
d AS (SELECT coalesce(r.{key}, l.{key}) AS {key}, CASE WHEN r.{key} IS NULL THEN 'Added' WHEN l.{key} IS NULL THEN 'Removed' ELSE 'Modified' END AS kind,
  concat_ws(', ', {marks}) AS changed_fields FROM r FULL JOIN l ON r.{key} = l.{key})
SELECT * FROM d WHERE kind <> 'Modified' OR changed_fields <> ''"""


_ROW_DIFFS = {
    "orders": ("o_orderkey", ["o_orderstatus", "o_orderpriority", "o_custkey"], "o_orderstatus", "o_orderpriority"),
    "customer": ("c_custkey", ["c_name", "c_mktsegment", "c_acctbal"], "c_name", "c_mktsegment"),
    "supplier": ("s_suppkey", ["s_name", "s_nationkey", "s_acctbal"], "s_name", "s_nationkey"),
    "part": ("p_partkey", ["p_brand", "p_type", "p_size", "p_retailprice"], "p_brand", "p_size"),
}


def _row_diff(table: str) -> Callable[[SparkSession, str], DataFrame]:
    key, columns, changed, nulled = _ROW_DIFFS[table]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = read(spark, sf_dir, table).select(key, *columns)
        return diff.row_diff(rows, _live_rows(rows, key, changed, nulled), [key], columns)

    run.__doc__ = f"J5/U5/R6: rows of {table} that differ between two snapshots."
    return run


for _t, _args in _ROW_DIFFS.items():
    query(_row_diff_sql(_t, *_args), f"row_diff_{_t}")(_row_diff(_t))


@query("""WITH r AS (SELECT conv_id, turn, role, text FROM conversations),
l AS (SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 AND turn = 1 THEN NULL ELSE role END AS role, CASE WHEN turn % 5 = 2 THEN text || '.' ELSE text END AS text FROM r WHERE (conv_id + turn) % 31 <> 0
  UNION ALL SELECT conv_id + 1000000, turn, role, text FROM r WHERE conv_id % 29 = 0),
d AS (SELECT coalesce(r.conv_id, l.conv_id) AS conv_id, coalesce(r.turn, l.turn) AS turn, CASE WHEN r.conv_id IS NULL THEN 'Added' WHEN l.conv_id IS NULL THEN 'Removed' ELSE 'Modified' END AS kind,
  concat_ws(', ', CASE WHEN r.conv_id IS NOT NULL AND l.conv_id IS NOT NULL AND r.role IS DISTINCT FROM l.role THEN 'role' END, CASE WHEN r.conv_id IS NOT NULL AND l.conv_id IS NOT NULL AND r.text IS DISTINCT FROM l.text THEN 'text' END) AS changed_fields
  FROM r FULL JOIN l ON r.conv_id = l.conv_id AND r.turn = l.turn)
SELECT * FROM d WHERE kind <> 'Modified' OR changed_fields <> ''""")
def row_diff_composite_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5 with a key of two columns."""
    r = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    l = r.filter("(conv_id + turn) % 31 <> 0").withColumns({"role": F.expr("if(conv_id % 7 = 0 and turn = 1, null, role)"), "text": F.expr("if(turn % 5 = 2, text || '.', text)")})
    l = l.unionByName(r.filter("conv_id % 29 = 0").withColumn("conv_id", F.col("conv_id") + 1_000_000))
    return diff.row_diff(r, l, ["conv_id", "turn"])


@query(f"""SELECT count(*) FILTER (WHERE kind = 'Added') AS added, count(*) FILTER (WHERE kind = 'Removed') AS removed, count(*) FILTER (WHERE kind = 'Modified') AS modified, count(*) > 0 AS has_drift
FROM ({_row_diff_sql('orders', *_ROW_DIFFS['orders'])})""")
def row_diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: counts of the row diff of orders."""
    return diff.row_diff_summary(QUERIES["row_diff_orders"](spark, sf_dir))


# Catalog and metadata diffs

_TYPE_MAP = "CASE lower(data_type) WHEN 'float[]' THEN 'float[]' ELSE lower(data_type) END"
_NAMES = ", ".join(f"'{t}'" for t in D.TABLES)


@query(f"""SELECT table_name, CAST(ordinal_position - 1 AS INTEGER) AS ordinal, column_name AS name, {_TYPE_MAP} AS type FROM information_schema.columns WHERE table_name IN ({_NAMES})""")
def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the live catalog."""
    return live_catalog.from_parquet(spark, sf_dir, D.TABLES).fields.select("table_name", "ordinal", "name", "type")


@query(f"""WITH {D.ctes('r_', D.repo_documents(), 'tables')}, l AS (SELECT DISTINCT table_name AS name FROM information_schema.columns WHERE table_name IN ({_NAMES}))
SELECT lower(coalesce(r.name, l.name)) AS table_key, r.name AS repo_name, l.name AS live_name, CASE WHEN r.name IS NULL THEN 'extra_in_db' WHEN l.name IS NULL THEN 'missing_in_db' ELSE 'matched' END AS presence
FROM r_tables r FULL JOIN l ON lower(r.name) = lower(l.name)""")
def table_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared tables against the live catalog."""
    return diff.table_presence(repo(spark).documents, live_catalog.from_parquet(spark, sf_dir, D.TABLES).documents)


_LIVE_FIELDS = f"l AS (SELECT table_name, column_name AS name, {_TYPE_MAP} AS type FROM information_schema.columns WHERE table_name IN ({_NAMES}))"


@query(f"""WITH {D.ctes('r_', D.repo_documents(), 'fields')}, {_LIVE_FIELDS},
r AS (SELECT * FROM r_fields WHERE lower(table_name) IN (SELECT lower(table_name) FROM l)),
j AS (SELECT lower(r.table_name) AS table_key, r.name AS field_name, r.*, l.name AS l_name, l.type AS l_type FROM r LEFT JOIN l ON lower(r.table_name) = lower(l.table_name) AND lower(r.name) = lower(l.name))
SELECT table_key, field_name, 'Removed' AS kind, type AS old_value, NULL AS new_value FROM j WHERE l_name IS NULL
UNION ALL SELECT table_key, field_name, 'TypeChanged', type, l_type FROM j WHERE l_name IS NOT NULL AND lower(type) <> lower(l_type)
UNION ALL SELECT table_key, field_name, 'NullabilityChanged', CAST(nullable AS VARCHAR), 'true' FROM j WHERE l_name IS NOT NULL AND NOT nullable
UNION ALL SELECT table_key, field_name, 'DefaultChanged', dflt, NULL FROM j WHERE l_name IS NOT NULL AND dflt IS NOT NULL
UNION ALL SELECT table_key, field_name, 'ComputedExpressionChanged', computed_expression, NULL FROM j WHERE l_name IS NOT NULL AND (is_computed OR computed_expression IS NOT NULL)
UNION ALL SELECT table_key, field_name, 'IsPersistedChanged', 'true', 'false' FROM j WHERE l_name IS NOT NULL AND is_persisted""")
def field_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared fields against the live catalog."""
    return diff.field_changes(repo(spark).fields, live_catalog.from_parquet(spark, sf_dir, D.TABLES).fields)


@query(f"""WITH {D.ctes('r_', D.repo_documents(), 'fields')}, {_LIVE_FIELDS}
SELECT lower(l.table_name) AS table_key, l.name AS column_name FROM l WHERE lower(l.table_name) IN (SELECT lower(table_name) FROM r_fields)
AND NOT EXISTS (SELECT 1 FROM r_fields r WHERE lower(r.table_name) = lower(l.table_name) AND lower(r.name) = lower(l.name))""")
def extra_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live columns that no document declares."""
    return diff.extra_columns(repo(spark).fields, live_catalog.from_parquet(spark, sf_dir, D.TABLES).fields)


_BOTH = lambda *rel: D.ctes("r_", D.repo_documents(), *rel) + ",\n" + D.ctes("l_", D.live_documents(), *rel)
_PK_CHANGES = f"""t AS (SELECT lower(r.name) AS k FROM r_tables r JOIN l_tables l ON lower(r.name) = lower(l.name)),
a AS (SELECT lower(table_name) AS k, list(name ORDER BY ordinal) AS names FROM r_pks GROUP BY 1), b AS (SELECT lower(table_name) AS k, list(name ORDER BY ordinal) AS names FROM l_pks GROUP BY 1),
pk_changes AS (SELECT t.k AS table_key, coalesce(a.names, []) AS before, coalesce(b.names, []) AS after FROM t LEFT JOIN a USING (k) LEFT JOIN b USING (k)
WHERE list_transform(coalesce(a.names, []), lambda x: lower(x)) <> list_transform(coalesce(b.names, []), lambda x: lower(x)))"""


@query(f"WITH {_BOTH('tables', 'pks')}, {_PK_CHANGES} SELECT table_key, array_to_string(before, ',') AS before, array_to_string(after, ',') AS after FROM pk_changes")
def pk_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary keys whose columns or order differ."""
    return diff.pk_changes(repo(spark), live(spark)).select("table_key", F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after"))


def _fk_body(strict: bool) -> str:
    soft = "" if strict else """ AND NOT (kind = 'Added' AND EXISTS (SELECT 1 FROM r_fks s WHERE s.kind <> 'physical' AND lower(s.table_name) = d.table_key AND lower(s.source_field) = lower(d.source_field)
  AND lower(s.target_table) = lower(d.target_table) AND lower(s.target_field) = lower(d.target_field)))"""
    return f"""d AS (SELECT lower(coalesce(r.table_name, l.table_name)) AS table_key, coalesce(r.source_field, l.source_field) AS source_field, coalesce(r.target_table, l.target_table) AS target_table,
  coalesce(r.target_field, l.target_field) AS target_field, CASE WHEN l.table_name IS NULL THEN 'Removed' WHEN r.table_name IS NULL THEN 'Added' WHEN r.cascade_delete <> l.cascade_delete THEN 'CascadeDeleteChanged' END AS kind,
  r.cascade_delete AS a, l.cascade_delete AS b FROM (SELECT * FROM r_fks WHERE kind = 'physical') r FULL JOIN l_fks l
  ON lower(r.table_name) = lower(l.table_name) AND lower(r.source_field) = lower(l.source_field) AND lower(r.target_table) = lower(l.target_table) AND lower(r.target_field) = lower(l.target_field))
SELECT table_key, source_field, target_table, target_field, kind, CASE WHEN kind = 'CascadeDeleteChanged' THEN CAST(a AS VARCHAR) END AS old_value, CASE WHEN kind = 'CascadeDeleteChanged' THEN CAST(b AS VARCHAR) END AS new_value
FROM d WHERE kind IS NOT NULL{soft}"""


@query(f"WITH {_BOTH('fks')}, {_fk_body(False)}")
def fk_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys; a logical key that live has is no addition."""
    return diff.fk_changes(repo(spark).foreign_keys, live(spark).foreign_keys)


@query(f"WITH {_BOTH('fks')}, {_fk_body(True)}")
def fk_changes_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3 with the stricter reading: it is one."""
    return diff.fk_changes(repo(spark).foreign_keys, live(spark).foreign_keys, strict_reference=True)


@query(f"""WITH {_BOTH('indexes')}, d AS (SELECT lower(coalesce(r.table_name, l.table_name)) AS table_key, coalesce(r.name, l.name) AS index_name, r.columns AS a, l.columns AS b, r.is_unique AS u, l.is_unique AS v,
  CASE WHEN l.name IS NULL THEN 'Removed' WHEN r.name IS NULL THEN 'Added' WHEN list_transform(r.columns, lambda x: lower(x)) <> list_transform(l.columns, lambda x: lower(x)) THEN 'ColumnsChanged' WHEN r.is_unique <> l.is_unique THEN 'UniquenessChanged' END AS kind
  FROM r_indexes r FULL JOIN l_indexes l ON lower(r.table_name) = lower(l.table_name) AND lower(r.name) = lower(l.name))
SELECT table_key, index_name, kind, CASE WHEN kind IN ('Removed', 'ColumnsChanged') THEN array_to_string(a, ', ') END AS old_columns, CASE WHEN kind IN ('Added', 'ColumnsChanged') THEN array_to_string(b, ', ') END AS new_columns,
  CASE WHEN kind = 'UniquenessChanged' THEN u END AS old_is_unique, CASE WHEN kind = 'UniquenessChanged' THEN v END AS new_is_unique FROM d WHERE kind IS NOT NULL""")
def index_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes by name."""
    return diff.index_changes(repo(spark).indexes, live(spark).indexes)


_ROW_CHANGES = """keyed AS (SELECT d.side, lower(d.table_name) AS table_key, d.row_index, list(coalesce(v.v, 'null') ORDER BY p.ordinal) AS pk
  FROM (SELECT DISTINCT 'r' AS side, table_name, row_index FROM r_data UNION ALL SELECT DISTINCT 'l', table_name, row_index FROM l_data) d
  JOIN r_pks p ON lower(p.table_name) = lower(d.table_name)
  LEFT JOIN (SELECT 'r' AS side, * FROM r_data UNION ALL SELECT 'l', * FROM l_data) v ON v.side = d.side AND v.table_name = d.table_name AND v.row_index = d.row_index AND v.k = p.name GROUP BY ALL),
pairs AS (SELECT coalesce(a.table_key, b.table_key) AS table_key, coalesce(a.pk, b.pk) AS pk, a.row_index AS i, b.row_index AS j FROM (SELECT * FROM keyed WHERE side = 'r') a FULL JOIN (SELECT * FROM keyed WHERE side = 'l') b ON a.table_key = b.table_key AND a.pk = b.pk),
cells AS (SELECT table_key, pk, i, j, coalesce(a.k, b.k) AS k, a.k IS NULL AS late FROM pairs JOIN r_data a ON lower(a.table_name) = table_key AND a.row_index = i LEFT JOIN l_data b ON lower(b.table_name) = table_key AND b.row_index = j AND b.k = a.k WHERE i IS NOT NULL AND j IS NOT NULL AND a.v IS DISTINCT FROM b.v
  UNION ALL SELECT table_key, pk, i, j, b.k, true FROM pairs JOIN l_data b ON lower(b.table_name) = table_key AND b.row_index = j LEFT JOIN r_data a ON lower(a.table_name) = table_key AND a.row_index = i AND a.k = b.k WHERE i IS NOT NULL AND j IS NOT NULL AND a.k IS NULL),
row_changes AS (SELECT table_key, pk, CASE WHEN i IS NULL THEN 'Added' WHEN j IS NULL THEN 'Removed' ELSE 'Modified' END AS kind,
  coalesce((SELECT string_agg(k, ', ' ORDER BY late, k) FROM cells c WHERE c.table_key = p.table_key AND c.pk = p.pk), '') AS changed_fields FROM pairs p)"""


@query(f"WITH {_BOTH('pks', 'data')}, {_ROW_CHANGES} SELECT table_key, array_to_string(pk, '|') AS pk, kind, changed_fields FROM row_changes WHERE kind <> 'Modified' OR changed_fields <> ''")
def reference_row_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5 over rows embedded in documents."""
    return diff.reference_row_changes(repo(spark), live(spark)).withColumn("pk", F.array_join("pk", "|"))


_GRAINS = f"""{_BOTH('tables', 'fields', 'pks', 'fks', 'indexes', 'data')}, {_PK_CHANGES}, {_ROW_CHANGES},
pairs_ AS (SELECT lower(r.table_name) AS table_key, l.name IS NULL AS gone, CAST(lower(r.type) <> lower(l.type) AS INTEGER) + CAST(r.nullable <> l.nullable AS INTEGER) + CAST(r.dflt IS DISTINCT FROM l.dflt AS INTEGER)
  + CAST(r.is_computed <> l.is_computed OR r.computed_expression IS DISTINCT FROM l.computed_expression AS INTEGER) + CAST(r.is_persisted <> l.is_persisted AS INTEGER) AS changes
  FROM r_fields r LEFT JOIN l_fields l ON lower(r.table_name) = lower(l.table_name) AND lower(r.name) = lower(l.name) WHERE lower(r.table_name) IN (SELECT k FROM t)),
extra AS (SELECT lower(table_name) AS table_key FROM l_fields l WHERE lower(table_name) IN (SELECT k FROM t) AND NOT EXISTS (SELECT 1 FROM r_fields r WHERE lower(r.table_name) = lower(l.table_name) AND lower(r.name) = lower(l.name))),
fk_ AS (WITH {_fk_body(False)}),
ix_ AS (SELECT lower(coalesce(r.table_name, l.table_name)) AS table_key FROM r_indexes r FULL JOIN l_indexes l ON lower(r.table_name) = lower(l.table_name) AND lower(r.name) = lower(l.name)
  WHERE r.name IS NULL OR l.name IS NULL OR list_transform(r.columns, lambda x: lower(x)) <> list_transform(l.columns, lambda x: lower(x)) OR r.is_unique <> l.is_unique)"""


@query(f"""WITH {_GRAINS}, c AS (SELECT k AS table_key, (SELECT coalesce(sum(CASE WHEN gone THEN 1 ELSE changes END), 0) FROM pairs_ p WHERE p.table_key = k) AS n_field, (SELECT count(*) FROM pk_changes p WHERE p.table_key = k) AS n_primary_key,
  (SELECT count(*) FROM fk_ f WHERE f.table_key = k) AS n_foreign_key, (SELECT count(*) FROM ix_ i WHERE i.table_key = k) AS n_index, (SELECT count(*) FROM row_changes x WHERE x.table_key = k AND (kind <> 'Modified' OR changed_fields <> '')) AS n_row,
  (SELECT count(*) FROM extra e WHERE e.table_key = k) AS n_extra_column FROM t)
SELECT table_key, CAST(n_field AS BIGINT) AS n_field, n_primary_key, n_foreign_key, n_index, n_row, n_extra_column, n_field + n_primary_key + n_foreign_key + n_index + n_row > 0 AS has_drift, n_extra_column > 0 AS has_warnings FROM c""")
def drift_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of every grain by table."""
    return diff.drift_counts(repo(spark), live(spark))


# Merge

_FIELD_PAIRS = """both_tables AS (SELECT DISTINCT lower(r.table_name) AS k FROM r_fields r JOIN l_fields l ON lower(r.table_name) = lower(l.table_name)),
m AS (SELECT lower(coalesce(r.table_name, l.table_name)) AS table_key, coalesce(r.name, l.name) AS name, CASE WHEN r.name IS NOT NULL AND l.name IS NOT NULL THEN 'kept' WHEN r.name IS NOT NULL THEN 'orphan' ELSE 'added' END AS state,
  CASE WHEN l.name IS NOT NULL THEN l.type ELSE r.type END AS type, CASE WHEN l.name IS NOT NULL THEN l.nullable ELSE r.nullable END AS nullable, CASE WHEN l.name IS NOT NULL THEN l.is_computed ELSE r.is_computed END AS is_computed,
  CASE WHEN r.name IS NOT NULL THEN r.description ELSE '' END AS description, CASE WHEN r.name IS NOT NULL THEN r.is_match_column ELSE false END AS is_match_column, r.sensitivity, r.name IS NULL AS is_new, coalesce(r.ordinal, l.ordinal) AS at
  FROM (SELECT * FROM r_fields WHERE lower(table_name) IN (SELECT k FROM both_tables)) r FULL JOIN (SELECT * FROM l_fields WHERE lower(table_name) IN (SELECT k FROM both_tables)) l ON lower(r.table_name) = lower(l.table_name) AND lower(r.name) = lower(l.name))""".replace(" AS at\n", " AS place\n")


def _merge_sql(remove: bool) -> str:
    return f"""WITH {_BOTH('fields', 'pks')}, {_FIELD_PAIRS}
SELECT table_key, CAST(row_number() OVER (PARTITION BY table_key ORDER BY is_new, place) - 1 AS INTEGER) AS ordinal, name, state, type, nullable, is_computed, description, is_match_column, sensitivity,
  EXISTS (SELECT 1 FROM l_pks p WHERE lower(p.table_name) = table_key AND lower(p.name) = lower(m.name)) AS is_primary_key FROM m{" WHERE state <> 'orphan'" if remove else ''}"""


def _merged(spark: SparkSession, remove: bool) -> DataFrame:
    r, l = repo(spark), live(spark)
    names = ("table_key", "ordinal", "name", "state", "type", "nullable", "is_computed", "description", "is_match_column", "sensitivity", "is_primary_key")
    return merge.merge_fields(r.fields, l.fields, l.primary_keys, remove).select(*names)


@query(_merge_sql(False))
def merge_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged fields, orphans kept."""
    return _merged(spark, False)


@query(_merge_sql(True))
def merge_fields_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7 with deleted columns removed."""
    return _merged(spark, True)


@query(f"""WITH {_BOTH('fks')}, m AS (SELECT lower(coalesce(r.table_name, l.table_name)) AS table_key, coalesce(r.source_field, l.source_field) AS source_field, coalesce(r.target_table, l.target_table) AS target_table, coalesce(r.target_field, l.target_field) AS target_field,
  coalesce(l.cascade_delete, r.cascade_delete) AS cascade_delete, coalesce(r.kind, 'physical') AS kind, r.table_name IS NULL AS is_new, coalesce(r.ordinal, l.ordinal) AS place
  FROM r_fks r FULL JOIN l_fks l ON lower(r.table_name) = lower(l.table_name) AND lower(r.source_field) = lower(l.source_field) AND lower(r.target_table) = lower(l.target_table) AND lower(r.target_field) = lower(l.target_field)
  WHERE l.table_name IS NOT NULL OR r.kind <> 'physical')
SELECT table_key, CAST(row_number() OVER (PARTITION BY table_key ORDER BY is_new, place) - 1 AS INTEGER) AS ordinal, source_field, target_table, target_field, cascade_delete, kind FROM m""")
def merge_fks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged foreign keys."""
    return merge.merge_fks(repo(spark).foreign_keys, live(spark).foreign_keys).select("table_key", "ordinal", "source_field", "target_table", "target_field", "cascade_delete", "kind")


@query(f"""WITH {D.ctes('r_', D.repo_documents(), 'data', 'fields')}, lost AS (SELECT lower(table_name) AS table_key, k, row_number() OVER (PARTITION BY lower(table_name), lower(k) ORDER BY row_index) AS n FROM r_data d
  WHERE NOT EXISTS (SELECT 1 FROM r_fields f WHERE lower(f.table_name) = lower(d.table_name) AND lower(f.name) = lower(d.k)))
SELECT table_key, k AS data_key FROM lost WHERE n = 1""")
def orphaned_data_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of embedded rows that no field has, in their first spelling."""
    r = repo(spark)
    return merge.orphaned_data_keys(r.ref_rows, r.fields)


_INDEX_LISTS = "(SELECT list({'n': name, 'c': columns, 'u': is_unique} ORDER BY ordinal) FROM %s_indexes i WHERE lower(i.table_name) = k)"


_MERGE_FKS = """mfk_ AS (SELECT lower(coalesce(r.table_name, l.table_name)) AS table_key, coalesce(r.source_field, l.source_field) AS source_field, coalesce(r.target_table, l.target_table) AS target_table, coalesce(r.target_field, l.target_field) AS target_field,
  CASE WHEN r.table_name IS NULL THEN 'Added' WHEN l.table_name IS NULL AND r.kind = 'physical' THEN 'Removed' WHEN r.cascade_delete <> l.cascade_delete THEN 'CascadeDeleteChanged' END AS kind,
  CASE WHEN r.cascade_delete <> l.cascade_delete THEN CAST(r.cascade_delete AS VARCHAR) END AS old_value, CASE WHEN r.cascade_delete <> l.cascade_delete THEN CAST(l.cascade_delete AS VARCHAR) END AS new_value
  FROM r_fks r FULL JOIN l_fks l ON lower(r.table_name) = lower(l.table_name) AND lower(r.source_field) = lower(l.source_field) AND lower(r.target_table) = lower(l.target_table) AND lower(r.target_field) = lower(l.target_field)
  WHERE r.table_name IS NULL OR l.table_name IS NULL AND r.kind = 'physical' OR r.cascade_delete <> l.cascade_delete)"""


@query(f"WITH {_BOTH('fks')}, {_MERGE_FKS} SELECT * FROM mfk_")
def merge_fk_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a merge changes in foreign keys of any kind."""
    return merge.merge_fk_changes(repo(spark).foreign_keys, live(spark).foreign_keys)


@query(f"""WITH {_GRAINS}, {_MERGE_FKS}, both_ AS (SELECT DISTINCT lower(name) AS k FROM (SELECT name FROM r_tables UNION ALL SELECT name FROM l_tables))
SELECT k AS table_key, CASE WHEN k NOT IN (SELECT lower(name) FROM r_tables) THEN 'new' WHEN k NOT IN (SELECT lower(name) FROM l_tables) THEN 'orphan'
  WHEN EXISTS (SELECT 1 FROM pairs_ p WHERE p.table_key = k AND changes > 0) OR EXISTS (SELECT 1 FROM extra e WHERE e.table_key = k) OR EXISTS (SELECT 1 FROM pk_changes p WHERE p.table_key = k)
    OR EXISTS (SELECT 1 FROM mfk_ f WHERE f.table_key = k) OR {_INDEX_LISTS % 'r'} IS DISTINCT FROM {_INDEX_LISTS % 'l'} THEN 'modified' ELSE 'unchanged' END AS outcome FROM both_""")
def merge_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a merge does with each table."""
    return merge.merge_session(repo(spark), live(spark))


# Integrity of data


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_pk_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: keys that several rows have."""
    return diff.duplicate_keys(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS occurrence FROM lineitem) WHERE occurrence > 1""")
def dup_pk_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: second and later rows of a key."""
    order = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    found = validate.duplicate_occurrences(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], order)
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "occurrence")


@query("""SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, o_custkey, lag(CAST(o_custkey AS VARCHAR)) OVER (ORDER BY o_orderkey) AS before FROM orders) WHERE before > CAST(o_custkey AS VARCHAR)""")
def unordered_by_pk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key as text is below that of the row before."""
    return validate.unordered_rows(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", ["o_custkey"])


@query("SELECT doc_id, lang, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def fk_orphan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9 over data: documents that no label refers to."""
    return validate.missing_targets(read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id", read(spark, sf_dir, "labels"), "doc_id")


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 211 = 0 THEN c_nationkey + 1000 WHEN c_custkey % 37 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey FROM customer)
SELECT c_custkey, c_nationkey FROM c WHERE c_nationkey IS NOT NULL AND c_nationkey NOT IN (SELECT n_nationkey FROM nation)""")
def fk_dangling_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9 over data with seeded dangling and null references."""
    c = read(spark, sf_dir, "customer").select("c_custkey", F.expr("case when c_custkey % 211 = 0 then c_nationkey + 1000 when c_custkey % 37 = 0 then null else c_nationkey end").alias("c_nationkey"))
    return validate.missing_targets(c, "c_nationkey", read(spark, sf_dir, "nation"), "n_nationkey").select("c_custkey", "c_nationkey")


@query("""WITH e AS (SELECT event_id, json_keys(props) AS ks, CASE event_id % 3 WHEN 0 THEN ['k', 'n'] WHEN 1 THEN ['v'] ELSE ['k'] END AS fields FROM events)
SELECT event_id, 'unknown' AS problem, unnest(list_filter(ks, lambda x: NOT list_contains(fields, x))) AS col FROM e
UNION ALL SELECT event_id, 'missing', unnest(list_filter(fields, lambda x: NOT list_contains(ks, x))) FROM e""")
def data_unknown_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of JSON rows against the fields each kind of row should have."""
    expected = F.expr("case event_id % 3 when 0 then array('k', 'n') when 1 then array('v') else array('k') end")
    return validate.member_problems(read(spark, sf_dir, "events"), "props", expected, "event_id")


# Validation rules

_RULES = D.ctes("", D.rule_documents(), "tables", "fields", "pks", "fks", "sets", "checks", "uniques", "memberships", "data")
_TABLE_RULES = f"""WITH {_RULES}, filled AS (SELECT DISTINCT table_name FROM fields), ref AS (SELECT name AS table_name FROM tables WHERE is_reference_table),
rows_ AS (SELECT DISTINCT d.table_name, row_index FROM data d JOIN ref USING (table_name) JOIN filled USING (table_name)),
keyed AS (SELECT r.table_name, r.row_index, list(coalesce(CASE WHEN d.v LIKE '"%' THEN d.v[2:-2] ELSE d.v END, '') ORDER BY p.ordinal) AS pk FROM rows_ r JOIN pks p USING (table_name) LEFT JOIN data d ON d.table_name = r.table_name AND d.row_index = r.row_index AND d.k = p.name GROUP BY ALL)
SELECT 'Error' AS severity, 'TABLE-NAME-MISSING' AS code, name AS table_name, NULL AS field FROM tables WHERE trim(name) = ''
UNION ALL SELECT 'Error', 'TABLE-FIELDS-EMPTY', name, NULL FROM tables WHERE n_fields = 0
UNION ALL SELECT 'Error', CASE WHEN f.name IS NULL THEN 'PK-FIELD-MISSING' ELSE 'PK-NULLABLE' END, p.table_name, p.name FROM pks p JOIN filled USING (table_name) LEFT JOIN fields f ON f.table_name = p.table_name AND f.name = p.name WHERE f.name IS NULL OR f.nullable
UNION ALL SELECT 'Error', 'FK-SOURCE-MISSING', k.table_name, k.source_field FROM fks k JOIN filled USING (table_name) WHERE NOT EXISTS (SELECT 1 FROM fields f WHERE f.table_name = k.table_name AND f.name = k.source_field)
UNION ALL SELECT 'Warning', 'FK-CASCADE-NON-PHYSICAL', table_name, source_field FROM fks JOIN filled USING (table_name) WHERE cascade_delete AND kind <> 'physical'
UNION ALL SELECT 'Warning', 'TABLE-LABEL-FIELD-MISSING', t.name, label_field FROM tables t JOIN filled ON filled.table_name = t.name WHERE label_field IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fields f WHERE f.table_name = t.name AND lower(f.name) = lower(label_field))
UNION ALL SELECT 'Error', 'INVALID-DB-TYPE', name, NULL FROM (SELECT name, unnest(database_types) AS tag FROM tables) JOIN filled ON table_name = name WHERE lower(tag) NOT IN ('sqlserver', 'mysql', 'postgresql', 'oracle', 'sqlite')
UNION ALL SELECT 'Warning', 'MATCH-COLUMN-NULLABLE', table_name, name FROM fields WHERE is_match_column AND nullable
UNION ALL SELECT 'Error', 'COMPUTED-NO-EXPRESSION', table_name, name FROM fields WHERE is_computed AND trim(coalesce(computed_expression, '')) = ''
UNION ALL SELECT 'Warning', 'COMPUTED-IN-SET', table_name, col FROM sets s WHERE EXISTS (SELECT 1 FROM fields f WHERE f.table_name = s.table_name AND lower(f.name) = lower(s.col) AND f.is_computed)
UNION ALL SELECT 'Warning', 'DEPR-PK', f.table_name, f.name FROM fields f WHERE is_deprecated AND EXISTS (SELECT 1 FROM pks p WHERE p.table_name = f.table_name AND lower(p.name) = lower(f.name))
UNION ALL SELECT 'Warning', 'DEPR-MATCH-COLUMN', table_name, name FROM fields WHERE is_deprecated AND is_match_column
UNION ALL SELECT 'Warning', 'DEPR-FK-SOURCE', f.table_name, f.name FROM fields f WHERE is_deprecated AND EXISTS (SELECT 1 FROM fks k WHERE k.table_name = f.table_name AND lower(k.source_field) = lower(f.name))
UNION ALL SELECT 'Error', 'SENS-INVALID-VALUE', table_name, name FROM fields WHERE lower(sensitivity) NOT IN ('public', 'internal', 'confidential', 'pii')
UNION ALL SELECT 'Warning', 'SENS-PII-NO-DESCRIPTION', table_name, name FROM fields WHERE lower(sensitivity) = 'pii' AND trim(coalesce(description, '')) = ''
UNION ALL SELECT 'Warning', 'CHECK-COLUMN-MISSING', table_name, col FROM checks c JOIN filled USING (table_name) WHERE col IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fields f WHERE f.table_name = c.table_name AND lower(f.name) = lower(col))
UNION ALL SELECT 'Warning', 'UNIQUE-COLUMN-MISSING', table_name, col FROM uniques u JOIN filled USING (table_name) WHERE NOT EXISTS (SELECT 1 FROM fields f WHERE f.table_name = u.table_name AND lower(f.name) = lower(col))
UNION ALL SELECT 'Error', 'DATA-UNKNOWN-COLUMN', table_name, k FROM data d JOIN ref USING (table_name) JOIN filled USING (table_name) WHERE NOT EXISTS (SELECT 1 FROM fields f WHERE f.table_name = d.table_name AND lower(f.name) = lower(k))
UNION ALL SELECT 'Error', 'DATA-MISSING-COLUMN', r.table_name, f.name FROM rows_ r JOIN fields f USING (table_name) WHERE NOT EXISTS (SELECT 1 FROM data d WHERE d.table_name = r.table_name AND d.row_index = r.row_index AND d.k = f.name)
UNION ALL SELECT 'Error', 'DATA-DUPLICATE-PK', table_name, NULL FROM (SELECT table_name, row_number() OVER (PARTITION BY table_name, pk ORDER BY row_index) AS n FROM keyed) WHERE n > 1
UNION ALL SELECT DISTINCT 'Warning', 'DATA-UNORDERED', table_name, NULL FROM (SELECT table_name, pk, lag(pk) OVER (PARTITION BY table_name ORDER BY row_index) AS before FROM keyed) WHERE before > pk"""


@query(_TABLE_RULES)
def validate_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section 2.11: all rules of single tables."""
    return validate.validate_tables(rules(spark)).select("severity", "code", "table_name", "field")


@query(f"WITH {_RULES}, filled AS (SELECT DISTINCT table_name FROM fields) SELECT 'Warning' AS severity, 'SECTION-UNDEFINED' AS code, table_name, section FROM memberships JOIN filled USING (table_name) WHERE lower(section) NOT IN ('core', 'lookup')")
def section_undefined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section 2.11: sections of single tables that a given list doesn't know; tables without fields are passed over."""
    found = validate.validate_tables(rules(spark), ["Core", "LOOKUP"]).filter("code = 'SECTION-UNDEFINED'")
    return found.select("severity", "code", "table_name", F.regexp_extract("message", "'([^']*)'", 1).alias("section"))


@query(f"SELECT count(*) FILTER (WHERE severity = 'Error') AS errors, count(*) FILTER (WHERE severity = 'Warning') AS warnings, bool_or(severity = 'Error') AS has_errors, bool_or(severity = 'Warning') AS has_warnings FROM ({_TABLE_RULES})")
def issue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: issues by severity."""
    return validate.issue_summary(validate.validate_tables(rules(spark)))


@query(f"SELECT * FROM ({_TABLE_RULES}) WHERE code LIKE 'DEPR-%' OR code LIKE 'SENS-%'")
def deprecation_sensitivity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules about deprecated and sensitive fields."""
    found = validate.union_all(validate.quality_rules(rules(spark)))
    return found.filter("code like 'DEPR-%' or code like 'SENS-%'").select("severity", "code", "table_name", "field")


_SECTION_CTE = D.cte("sections", "name VARCHAR, title VARCHAR, load_order INTEGER, is_module BOOLEAN", [(s["name"], s.get("title"), i, s["is_module"]) for i, s in enumerate(D.SECTIONS)])
_MEMBER_CTE = D.cte("members", "section VARCHAR, ordinal INTEGER, table_name VARCHAR", [(s["name"], i, t) for s in D.SECTIONS for i, t in enumerate(s["tables"])])
_ENDPOINT_CTE = D.cte("endpoints", "path VARCHAR, db_table VARCHAR, tags VARCHAR[]", [(e["path"], e["db_table"], e["database_types"]) for e in D.ENDPOINTS])


@query(f"""WITH {_RULES}, {_SECTION_CTE}, {_MEMBER_CTE}, {_ENDPOINT_CTE}, e AS (SELECT e.*, t.name AS found, t.database_types AS declared FROM endpoints e LEFT JOIN tables t ON lower(t.name) = lower(db_table) WHERE db_table IS NOT NULL)
SELECT 'Error' AS severity, 'FK-TARGET-MISSING' AS code, table_name, source_field AS field FROM fks WHERE lower(target_table) NOT IN (SELECT lower(name) FROM tables)
UNION ALL SELECT 'Warning', 'SECTION-UNDEFINED', table_name, NULL FROM memberships WHERE lower(section) NOT IN (SELECT lower(name) FROM sections)
UNION ALL SELECT 'Warning', 'SECTION-TABLE-UNDEFINED', table_name, NULL FROM members WHERE lower(table_name) NOT IN (SELECT lower(name) FROM tables)
UNION ALL SELECT 'Error', 'API-DBTABLE-MISSING', NULL, NULL FROM e WHERE found IS NULL
UNION ALL SELECT 'Warning', 'API-DBTYPE-MISMATCH', found, NULL FROM (SELECT found, declared, unnest(tags) AS tag FROM e WHERE found IS NOT NULL AND len(tags) > 0 AND len(declared) > 0) WHERE NOT list_contains(list_transform(declared, lambda x: lower(x)), lower(tag))""")
def validate_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules across tables, sections and endpoints."""
    return validate.validate_cross(rules(spark)).select("severity", "code", "table_name", "field")


_type_cte = lambda types: D.cte("ttypes", "type VARCHAR, root BOOLEAN, allowed VARCHAR[], required VARCHAR[]", [tuple(t.values()) for t in types])
_DB_CTE = D.cte("dbs", "name VARCHAR, type VARCHAR, parent VARCHAR, installed VARCHAR[]", [tuple(t.values()) for t in D.TENANT_DATABASES])
_WALK = "walk(node, up, depth) AS (SELECT lower(name), lower(parent), 1 FROM dbs WHERE parent IS NOT NULL UNION SELECT w.node, lower(d.parent), depth + 1 FROM walk w JOIN dbs d ON lower(d.name) = w.up WHERE d.parent IS NOT NULL AND depth < 12)"


def _tenants_sql(types: list[dict]) -> str:
    return f"""WITH RECURSIVE {_type_cte(types)}, {_DB_CTE}, {_SECTION_CTE}, {_WALK},
k AS (SELECT d.*, t.root, t.allowed, t.required FROM dbs d LEFT JOIN ttypes t ON lower(t.type) = lower(d.type)), low AS (SELECT node, min(up) AS least FROM walk w WHERE EXISTS (SELECT 1 FROM walk x WHERE x.node = w.up AND x.up = w.up) AND node IN (SELECT node FROM walk WHERE node = up) GROUP BY node)
SELECT 'Error' AS severity, 'TENANT-TYPE-UNKNOWN' AS code, name AS table_name FROM k WHERE root IS NULL
UNION ALL SELECT 'Error', 'TENANT-SECTION-NOT-MODULE', name FROM (SELECT name, unnest(installed) AS s FROM k) WHERE lower(s) NOT IN (SELECT lower(name) FROM sections WHERE is_module)
UNION ALL SELECT 'Error', 'TENANT-REQUIRED-SECTION-MISSING', name FROM (SELECT name, installed, unnest(required) AS s FROM k WHERE root IS NOT NULL) WHERE NOT list_contains(list_transform(installed, lambda x: lower(x)), lower(s))
UNION ALL SELECT 'Error', 'TENANT-PARENT-UNKNOWN', name FROM k WHERE parent IS NOT NULL AND lower(parent) NOT IN (SELECT lower(name) FROM dbs)
UNION ALL SELECT 'Error', 'TENANT-PARENT-NOT-ALLOWED', k.name FROM k JOIN dbs p ON lower(p.name) = lower(k.parent) WHERE root IS NOT NULL AND NOT list_contains(list_transform(allowed, lambda x: lower(x)), lower(p.type))
UNION ALL SELECT 'Error', 'TENANT-ROOT-HAS-PARENT', name FROM k WHERE parent IS NOT NULL AND root
UNION ALL SELECT 'Warning', 'TENANT-ORPHAN', name FROM k WHERE parent IS NULL AND NOT root
UNION ALL SELECT 'Error', 'TENANT-ROOT-DUPLICATE', NULL FROM k WHERE root HAVING count(*) > 1
UNION ALL SELECT 'Error', 'TENANT-CYCLE', d.name FROM low JOIN dbs d ON lower(d.name) = node WHERE node = least
UNION ALL SELECT 'Error', 'TENANT-ROOT-MISSING', NULL WHERE NOT EXISTS (SELECT 1 FROM ttypes WHERE root)"""


def _tenants(spark: SparkSession, types: list[dict]) -> DataFrame:
    found = validate.validate_tenants(frame(spark, types, TENANT_TYPE_DDL), frame(spark, D.TENANT_DATABASES, TENANT_DATABASE_DDL), frame(spark, D.SECTIONS, SECTION_DDL))
    return found.select("severity", "code", "table_name")


@query(_tenants_sql(D.TENANT_TYPES))
def validate_tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of a tenant topology."""
    return _tenants(spark, D.TENANT_TYPES)


@query(_tenants_sql(D.ROOTLESS_TYPES))
def validate_tenants_rootless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where no type is a root."""
    return _tenants(spark, D.ROOTLESS_TYPES)


# Filters and capture


@query(f"WITH {_MEMBER_CTE}, {_SECTION_CTE}, {_RULES} SELECT section, ordinal, m.table_name, t.name IS NOT NULL AS defined FROM members m LEFT JOIN tables t ON lower(t.name) = lower(m.table_name)")
def section_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of each section and whether they are defined."""
    r = rules(spark)
    known = r.tables.select("table_key", F.lit(True).alias("d"))
    return r.section_tables.join(known, "table_key", "left").select("section", "ordinal", "table_name", F.coalesce("d", F.lit(False)).alias("defined"))


@query(f"WITH {_MEMBER_CTE}, {_RULES} SELECT name FROM tables t WHERE EXISTS (SELECT 1 FROM members m WHERE lower(section) IN ('sales', 'lookup') AND lower(m.table_name) = lower(t.name))")
def section_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of two sections."""
    r = rules(spark)
    return filters.section_filter(r.tables, r.section_tables, ["SALES", "lookup"]).select("name")


@query(f"WITH {_SECTION_CTE} SELECT w.s AS section FROM (VALUES ('Core'), ('nope'), ('SALES')) w(s) WHERE lower(s) NOT IN (SELECT lower(name) FROM sections)")
def unknown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested sections that aren't defined."""
    return filters.unknown_sections(rules(spark).sections, ["Core", "nope", "SALES"])


@query("SELECT c_custkey, c_name FROM (SELECT c_custkey, c_mktsegment || '.' || c_name AS c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 1) WHERE contains(c_name, '.') AND lower(split_part(c_name, '.', 1)) IN ('building', 'machinery')")
def schema_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by their schema prefix, case ignored."""
    c = read(spark, sf_dir, "customer").select("c_custkey", F.expr("if(c_custkey % 2 = 0, c_mktsegment || '.' || c_name, c_name)").alias("c_name"))
    return filters.schema_filter(c, " Building , machinery,", "c_name")


@query(f"WITH {_MEMBER_CTE}, {_RULES} SELECT name FROM tables t WHERE lower(split_part(name, '.', 1)) = 'app' AND contains(name, '.') AND EXISTS (SELECT 1 FROM members m WHERE lower(section) = 'core' AND lower(m.table_name) = lower(t.name))")
def combined_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema and section together."""
    r = rules(spark)
    return filters.combined_filter(r.tables, r.section_tables, "APP", ["core"]).select("name")


@query("SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '(?is)^.*a.*e.*$')")
def glob_reference_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: names by a pattern with stars."""
    return read(spark, sf_dir, "part").select("p_partkey", "p_type").filter(F.col("p_type").rlike(T.glob_regex("*A*e*")))


_COUNTED = ("region", "nation", "customer", "supplier", "part", "orders", "benchmark")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows FROM {t}" for t in _COUNTED))
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9h/S10h/A11: exact row counts."""
    return capture.table_counts({t: read(spark, sf_dir, t) for t in _COUNTED})


@query("WITH c AS (" + " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows FROM {t}" for t in _COUNTED[:5]) + """),
n AS (SELECT name, CASE WHEN name = 'part' THEN NULL ELSE n_rows END AS n_rows FROM c)
SELECT name, n_rows, name = 'orders' OR name = 'customer' OR ((n_rows IS NULL OR n_rows <= 100) AND (regexp_matches(name, '(?i)^.*ion$') OR regexp_matches(name, '(?i)^p.*t$'))) AS is_reference FROM n""")
def reference_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed, or small (or of unknown size) with a matching name."""
    counts = capture.table_counts({t: read(spark, sf_dir, t) for t in _COUNTED[:5]})
    return filters.reference_tables(counts, counts.filter("name <> 'part'"), ["CUSTOMER", "orders"], ["*ion", "P*t"])


@query("SELECT CAST(row_number() OVER (ORDER BY r_regionkey) - 1 AS INTEGER) AS row_index, '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS json FROM region")
def reference_capture_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a small table as JSON in key order."""
    return capture.capture_rows(read(spark, sf_dir, "region"), ["r_regionkey"])


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS row_index, '' AS json FROM nation WHERE false")
def reference_capture_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list over the size gate is dropped whole."""
    return capture.capture_rows(read(spark, sf_dir, "nation"), ["n_nationkey"], max_kb=1).select("row_index", "json")


# Graphs

_EDGES = D.ctes("", D.live_documents(), "tables", "fks")


@query(f"""WITH RECURSIVE {_EDGES}, e AS (SELECT DISTINCT lower(table_name) AS s, lower(target_table) AS t FROM fks WHERE kind <> 'virtual' AND lower(table_name) <> lower(target_table) AND lower(target_table) IN (SELECT lower(name) FROM tables)),
w(n, l) AS (SELECT lower(name), 0 FROM tables UNION SELECT s, l + 1 FROM w JOIN e ON e.t = w.n WHERE l < 20) SELECT n AS node, max(l) AS level FROM w GROUP BY n""")
def fk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: levels of the foreign-key graph."""
    r = live(spark)
    return graph.levels(r.tables, graph.fk_edges(r.tables, r.foreign_keys))


_CYCLE_EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("f", "f"), ("g", "d"), ("h", "i"), ("i", "h")]
_CYCLE_CTE = D.cte("edges", "source VARCHAR, target VARCHAR", _CYCLE_EDGES)


@query(f"WITH RECURSIVE {_CYCLE_CTE}, p(s, t) AS (SELECT source, target FROM edges UNION SELECT p.s, e.target FROM p JOIN edges e ON e.source = p.t) SELECT s AS node FROM p WHERE s = t")
def fk_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes on a cycle."""
    return graph.cyclic_nodes(spark.createDataFrame(_CYCLE_EDGES, "source string, target string"))


@query(f"WITH RECURSIVE {_DB_CTE}, p(n, a) AS (SELECT lower(name), lower(parent) FROM dbs WHERE parent IS NOT NULL UNION SELECT p.n, lower(d.parent) FROM p JOIN dbs d ON lower(d.name) = p.a WHERE d.parent IS NOT NULL) SELECT lower(d.name) AS node, count(p.n) FILTER (WHERE p.n <> lower(d.name)) AS descendants FROM dbs d LEFT JOIN p ON p.a = lower(d.name) GROUP BY 1")
def tenant_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descendants of each database."""
    d = frame(spark, D.TENANT_DATABASES, TENANT_DATABASE_DDL)
    return graph.subtree_sizes(d.select(F.lower("name").alias("node"), F.lower("parent").alias("parent")))


# Aggregates, order, text


@query(f"WITH {D.ctes('', D.live_documents(), 'indexes')} SELECT table_name, name, array_to_string(columns, ',') AS cols FROM indexes")
def index_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9e/A7: columns of each index put together in their order."""
    parts = live(spark).indexes.select("table_name", "name", F.posexplode("columns").alias("at", "c"))
    return spark.sql("SELECT table_name, name, listagg(c, ',') WITHIN GROUP (ORDER BY at) AS cols FROM {parts} GROUP BY table_name, name", parts=parts)


@query("SELECT o_custkey, string_agg(o_orderstatus, ',' ORDER BY o_orderdate, o_orderkey) AS history, count(*) AS n FROM orders GROUP BY o_custkey")
def status_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered string aggregation over data."""
    parts = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")))
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(parts, lambda x: x["o_orderstatus"]), ",").alias("history"), F.count("*").alias("n"))


@query("SELECT c_nationkey, c_mktsegment, c_custkey, c_name FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, lower(c_mktsegment) ORDER BY c_custkey) AS k FROM customer) WHERE k = 1")
def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: the first row of each key in load order."""
    c = read(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", "c_custkey", "c_name", F.lower("c_mktsegment").alias("k"))
    return filters.first_wins(c, ["c_nationkey", "k"], ["c_custkey"]).drop("k")


@query("SELECT lower(s_name) AS table_key, count(*) AS n, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY CAST(s_suppkey AS VARCHAR)) AS members FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN 'SUPPLIER X' WHEN s_suppkey % 9 = 1 THEN 'Supplier x' ELSE s_name END AS s_name FROM supplier) GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: names that occur more than once, case ignored, with their members."""
    s = read(spark, sf_dir, "supplier").select(F.expr("case when s_suppkey % 9 = 0 then 'SUPPLIER X' when s_suppkey % 9 = 1 then 'Supplier x' else s_name end").alias("name"), F.col("s_suppkey").cast("string").alias("source_file"))
    return filters.duplicate_names(s).withColumn("members", F.array_join("members", ","))


@query(f"WITH {_SECTION_CTE}, o(k, at) AS (VALUES ('lookup', 0), ('nowhere', 1), ('core', 2)) SELECT name, CAST(row_number() OVER (ORDER BY at NULLS LAST, load_order) AS INTEGER) AS position FROM sections s LEFT JOIN o ON k = lower(name)".replace("o(k, at)", "o(k, place)").replace("BY at NULLS", "BY place NULLS"))
def section_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed sections first, the rest in load order."""
    return filters.ordered_sections(rules(spark).sections, D.SECTION_ORDER).select("name", "position")


@query("SELECT p_partkey, translate(lower(p_name || ' / ' || p_brand || '_' || p_type), ' ._/', '----') AS anchor FROM part")
def markdown_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: heading anchors."""
    return read(spark, sf_dir, "part").select("p_partkey", T.markdown_anchor(F.concat("p_name", F.lit(" / "), "p_brand", F.lit("_"), "p_type")).alias("anchor"))


@query("""WITH t AS (SELECT p_partkey, (['varchar', 'CHAR', 'decimal', 'int', 'numeric', 'text'])[p_partkey % 6 + 1] AS m, (['character varying', 'character', 'numeric', 'ARRAY', 'USER-DEFINED', 'integer'])[p_partkey % 6 + 1] AS p,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size END AS n, (['String', 'Int', 'Json', 'Bytes', 'Nope'])[p_partkey % 5 + 1] AS s FROM part)
SELECT p_partkey, CASE WHEN n IS NULL THEN m WHEN lower(m) IN ('varchar', 'char', 'binary', 'varbinary') THEN m || '(' || n || ')' WHEN lower(m) IN ('decimal', 'numeric') THEN m || '(' || n || ',' || 2 || ')' ELSE m END AS mysql_type,
  CASE WHEN p = 'character varying' THEN CASE WHEN n IS NULL THEN 'varchar' ELSE 'varchar(' || n || ')' END WHEN p = 'character' THEN CASE WHEN n IS NULL THEN 'char' ELSE 'char(' || n || ')' END WHEN p = 'numeric' THEN CASE WHEN n IS NULL THEN p ELSE p || '(' || n || ',2)' END WHEN p IN ('ARRAY', 'USER-DEFINED') THEN '_int4' ELSE p END AS postgres_type,
  CASE s WHEN 'String' THEN 'text' WHEN 'Int' THEN 'integer' WHEN 'Json' THEN 'jsonb' WHEN 'Bytes' THEN 'bytea' END AS scalar_type FROM t""")
def type_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """type strings of both catalogs, and of model scalars."""
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % n + 1).cast("int"))
    n = F.when(F.col("p_partkey") % 4 != 0, F.col("p_size"))
    part = read(spark, sf_dir, "part").select("p_partkey", pick(["varchar", "CHAR", "decimal", "int", "numeric", "text"], 6).alias("m"), pick(["character varying", "character", "numeric", "ARRAY", "USER-DEFINED", "integer"], 6).alias("p"), n.alias("n"), pick(["String", "Int", "Json", "Bytes", "Nope"], 5).alias("s"))
    return part.select(
        "p_partkey", types_.mysql_type(F.col("m"), F.col("n"), F.col("n"), F.lit(2)).alias("mysql_type"),
        types_.postgres_type(F.col("p"), F.lit("_int4"), F.col("n"), F.col("n"), F.lit(2)).alias("postgres_type"), types_.scalar_type_column(F.col("s"), "postgres").alias("scalar_type"),
    )


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || '0' AS at, 'o_orderkey=' || o_orderkey || ', o_custkey=' || o_custkey AS pk FROM orders".replace(" AS at,", " AS iso,"))
def row_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How keys and times are shown."""
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", T.iso_timestamp(F.col("o_orderdate")).alias("iso"), T.key_display([("o_orderkey", F.col("o_orderkey")), ("o_custkey", F.col("o_custkey"))]).alias("pk"))


# Diagrams

_ERD = f"""WITH {_RULES}, {_SECTION_CTE}, {_MEMBER_CTE}, scope AS (SELECT DISTINCT lower(m.table_name) AS k, m.table_name AS shown FROM members m JOIN tables t ON lower(t.name) = lower(m.table_name) WHERE lower(section) = 'core'),
homes AS (SELECT DISTINCT ON (lower(m.table_name)) lower(m.table_name) AS k, coalesce(s.title, s.name) AS home FROM members m JOIN sections s ON s.name = m.section ORDER BY lower(m.table_name), load_order, ordinal)"""


@query(f"""{_ERD}, e AS (SELECT CASE WHEN lower(target_table) IN (SELECT k FROM scope) THEN '"' || replace(target_table, ' ', '_') || '"' WHEN kind = 'physical' AND lower(target_table) IN (SELECT lower(name) FROM tables) THEN '"[' || coalesce(home, '?') || '] ' || replace(target_table, ' ', '_') || '"' END AS parent,
  '"' || replace(shown, ' ', '_') || '"' AS child, source_field AS field FROM fks JOIN scope ON scope.k = lower(table_name) LEFT JOIN homes ON homes.k = lower(target_table) WHERE kind <> 'virtual')
SELECT parent, child, field, '    ' || parent || ' ||--o{{ ' || child || ' : "' || field || '"' AS line FROM e WHERE parent IS NOT NULL""")
def erd_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a section's diagram."""
    return erd.erd_edges(rules(spark), "core")


@query(f"""{_ERD}, f AS (SELECT lower(f.table_name) AS table_key, f.*, EXISTS (SELECT 1 FROM pks p WHERE lower(p.table_name) = lower(f.table_name) AND lower(p.name) = lower(f.name)) AS pk, EXISTS (SELECT 1 FROM fks x WHERE lower(x.table_name) = lower(f.table_name) AND lower(source_field) = lower(f.name)) AS fk
  FROM fields f WHERE lower(f.table_name) IN (SELECT k FROM scope))
SELECT table_key, ordinal, rtrim('        ' || lower(split_part(type, '(', 1)) || ' ' || name || ' ' || concat_ws(',', CASE WHEN pk THEN 'PK' WHEN fk THEN 'FK' END, CASE WHEN is_computed THEN 'C' END, CASE WHEN is_deprecated THEN 'DEPR' END)) AS line FROM f""")
def erd_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a section's diagram."""
    return erd.erd_fields(rules(spark), "core", "all")


from plumbline.plans import reports  # noqa: E402, F401  builds on the SQL above
