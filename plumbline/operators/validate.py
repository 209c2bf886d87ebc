"""Validation rules: each is one filter, anti-join or window that yields issues.

Issues are (severity, code, message, table_name, field, file); severity is Error or
Warning.  ``validate_tables``, ``validate_cross`` and ``validate_tenants`` are the
unions of their rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.model import Registry, union_all
from plumbline.operators.graph import parent_cycles

#: What a table may be tagged with, and levels of sensitivity.
DATABASE_TYPES = ("sqlserver", "mysql", "postgresql", "oracle", "sqlite")
SENSITIVITIES = ("public", "internal", "confidential", "pii")


# Codes, severities and message texts of the rules below are fixed values.


def _text(template: str, *cols: Column | str) -> Column:
    return F.format_string(template.replace("%", "%%").replace("{}", "%s"), *cols)


def _issues(df: DataFrame, severity: str, code: str, message: Column, field: Column | None = None, file: Column | None = None) -> DataFrame:
    name = F.col("table_name") if "table_name" in df.columns else F.lit(None).cast("string")
    none = F.lit(None).cast("string")
    return df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message"), name.alias("table_name"), (none if field is None else field).alias("field"), (none if file is None else file).alias("file"))


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def structure_rules(r: Registry) -> list[DataFrame]:
    """TABLE-*, PK-*, FK-*, INVALID-DB-TYPE, MATCH-*, COMPUTED-* over tables that have fields."""
    out = []
    tables = r.tables.withColumnRenamed("name", "table_name")
    out.append(_issues(tables.filter(_blank(F.col("table_name"))), "Error", "TABLE-NAME-MISSING", F.lit("Table name is required and cannot be empty")))
    out.append(_issues(tables.filter(F.size("fields") == 0), "Error", "TABLE-FIELDS-EMPTY", F.lit("Table must have at least one field")))
    fields = r.fields
    filled = fields.select("table_key").distinct()
    live = lambda df: df.join(filled, "table_key", "left_semi")  # noqa: E731  no fields: no further rules

    named = fields.select("table_key", "name", "nullable")
    pk = live(r.primary_keys).join(named, ["table_key", "name"], "left")
    out.append(_issues(pk.filter("nullable is null"), "Error", "PK-FIELD-MISSING", _text("Primary key field '{}' does not exist", "name"), F.col("name")))
    out.append(_issues(pk.filter("nullable"), "Error", "PK-NULLABLE", _text("Primary key field '{}' cannot be nullable", "name"), F.col("name")))
    fk = live(r.foreign_keys)
    lost = fk.join(fields.select("table_key", F.col("name").alias("source_field")), ["table_key", "source_field"], "left_anti")
    out.append(_issues(lost, "Error", "FK-SOURCE-MISSING", _text("Foreign key source field '{}' does not exist", "source_field"), F.col("source_field")))
    soft = fk.filter("cascade_delete and lower(kind) <> 'physical'")
    out.append(_issues(soft, "Warning", "FK-CASCADE-NON-PHYSICAL", _text("Foreign key '{}' → '{}.{}': cascadeDelete is only valid for Physical FK relationships (kind is '{}')", "source_field", "target_table", "target_field", F.lower("kind")), F.col("source_field")))
    label = live(tables.filter("label_field is not null")).withColumn("field_key", F.lower("label_field"))
    label = label.join(fields.select("table_key", "field_key"), ["table_key", "field_key"], "left_anti")
    out.append(_issues(label, "Warning", "TABLE-LABEL-FIELD-MISSING", _text("labelField '{}' does not exist in table '{}'", "label_field", "table_name"), F.col("label_field")))
    types = live(r.database_types).filter(~F.lower("database_type").isin(*DATABASE_TYPES))
    out.append(_issues(types, "Error", "INVALID-DB-TYPE", _text("Unknown database type '{}'", "database_type")))
    name = F.col("name")
    out.append(_issues(fields.filter("is_match_column and nullable"), "Warning", "MATCH-COLUMN-NULLABLE", _text("Match column '{}' should not be nullable", name), name))
    out.append(_issues(fields.filter(F.col("is_computed") & _blank(F.col("computed_expression"))), "Error", "COMPUTED-NO-EXPRESSION", _text("Computed column '{}' must have a computedExpression", name), name))
    computed = fields.filter("is_computed").select("table_key", "field_key").distinct()
    sets = r.column_sets.join(computed, ["table_key", "field_key"], "left_semi")
    out.append(_issues(sets, "Warning", "COMPUTED-IN-SET", _text("Column set '{}' includes computed column '{}' — computed columns cannot be written", "set_name", "column"), F.col("column")))
    return out


def quality_rules(r: Registry) -> list[DataFrame]:
    """DEPR-*, SENS-*, CHECK-* and UNIQUE-COLUMN-MISSING."""
    fields, name = r.fields, F.col("name")
    old = fields.filter("is_deprecated")
    in_pk = old.join(r.primary_keys.select("table_key", "field_key"), ["table_key", "field_key"], "left_semi")
    sources = r.foreign_keys.select("table_key", F.lower("source_field").alias("field_key"))
    in_fk = old.join(sources, ["table_key", "field_key"], "left_semi")
    level = F.lower("sensitivity")
    has_fields = fields.select("table_key").distinct()
    lower = fields.select("table_key", "field_key")
    checks = r.checks.filter("column is not null").withColumn("field_key", F.lower("column")).join(has_fields, "table_key", "left_semi")
    checks = checks.join(lower, ["table_key", "field_key"], "left_anti")
    uniques = r.uniques.select("table_name", "table_key", "name", F.explode("columns").alias("column")).withColumn("field_key", F.lower("column"))
    uniques = uniques.join(has_fields, "table_key", "left_semi").join(lower, ["table_key", "field_key"], "left_anti")
    column = F.col("column")
    return [
        _issues(in_pk, "Warning", "DEPR-PK", _text("Field '{}' is deprecated but is part of the primary key", name), name),
        _issues(old.filter("is_match_column"), "Warning", "DEPR-MATCH-COLUMN", _text("Field '{}' is deprecated but is marked as a match column", name), name),
        _issues(in_fk, "Warning", "DEPR-FK-SOURCE", _text("Field '{}' is deprecated but is the source of a foreign key", name), name),
        _issues(fields.filter(~level.isin(*SENSITIVITIES)), "Error", "SENS-INVALID-VALUE", _text("Field '{}' has invalid sensitivity value '{}'. Allowed: public, internal, confidential, pii", name, "sensitivity"), name),
        _issues(fields.filter((level == "pii") & _blank(F.col("description"))), "Warning", "SENS-PII-NO-DESCRIPTION", _text("PII field '{}' has no description — document what data it stores", name), name),
        _issues(checks, "Warning", "CHECK-COLUMN-MISSING", _text("CHECK constraint '{}' references column '{}' which does not exist in fields", name, column), column),
        _issues(uniques, "Warning", "UNIQUE-COLUMN-MISSING", _text("UNIQUE constraint '{}' references column '{}' which does not exist in fields", name, column), column),
    ]


def data_rules(r: Registry) -> list[DataFrame]:
    """DATA-UNKNOWN-COLUMN, DATA-MISSING-COLUMN, DATA-DUPLICATE-PK, DATA-UNORDERED of reference tables.

    Keys of rows are compared as tuples of text.
    """
    from plumbline.operators.diff import ordered_names

    names = ordered_names(r.fields, "names")
    rows = r.ref_rows.filter("is_reference_table").join(names.select("table_key"), "table_key", "left_semi")  # no fields: no further rules
    pk = ordered_names(r.primary_keys, "pk_columns")
    own = rows.join(names, "table_key")
    lower = F.transform("names", lambda x: F.lower(x))
    unknown = own.select("table_name", "row_index", F.explode(F.filter(F.map_keys("row"), lambda k: ~F.array_contains(lower, F.lower(k)))).alias("column"))
    missing = own.select("table_name", "row_index", F.explode(F.array_except("names", F.map_keys("row"))).alias("column"))
    text = F.transform("pk_columns", lambda c: F.coalesce(_token_text(F.try_element_at("row", c)), F.lit("")))
    keyed = rows.join(pk, "table_key").select("table_name", "table_key", "row_index", text.alias("pk"))
    nth = F.row_number().over(Window.partitionBy("table_key", "pk").orderBy("row_index"))
    again = keyed.withColumn("n", nth).filter("n > 1")
    before = F.lag("pk").over(Window.partitionBy("table_key").orderBy("row_index"))
    unordered = keyed.withColumn("before", before).groupBy("table_key", "table_name").agg(F.bool_or(F.col("before") > F.col("pk")).alias("bad")).filter("bad")
    index = F.col("row_index").cast("string")
    return [
        _issues(unknown, "Error", "DATA-UNKNOWN-COLUMN", _text("data[{}] contains column '{}' which does not exist in fields", index, "column"), F.col("column")),
        _issues(missing, "Error", "DATA-MISSING-COLUMN", _text("data[{}] is missing column '{}'", index, "column"), F.col("column")),
        _issues(again, "Error", "DATA-DUPLICATE-PK", _text("data[{}] has a duplicate primary key value '{}'", index, F.array_join("pk", "|"))),
        _issues(unordered, "Warning", "DATA-UNORDERED", F.lit("data rows are not sorted by primary key — sort for deterministic diffs")),
    ]


def _token_text(token: Column) -> Column:
    """Text of a raw JSON token: a string without its quotes, null as nothing."""
    return F.when(token == "null", "").when(F.startswith(token, F.lit('"')), F.get_json_object(F.concat(F.lit('{"v":'), token, F.lit("}")), "$.v")).otherwise(token)


def section_rule(r: Registry, known: Sequence[str]) -> DataFrame:
    """SECTION-UNDEFINED in its form for one table (with fields), against a given set of sections."""
    filled = r.fields.select("table_key").distinct()
    lost = r.table_sections.filter(~F.col("section_key").isin([k.lower() for k in known]) if known else F.lit(True)).join(filled, "table_key", "left_semi")
    return _issues(lost, "Warning", "SECTION-UNDEFINED", _text("Section '{}' is not defined in configuration", "section"))


def validate_tables(r: Registry, known_sections: Sequence[str] | None = None) -> DataFrame:
    """All rules of single tables.

    Rules about the same relations read it once; the union adds no shuffle of its own.
    """
    rules = structure_rules(r) + quality_rules(r) + data_rules(r)
    return union_all(rules + ([section_rule(r, known_sections)] if known_sections is not None else []))


def validate_cross(r: Registry) -> DataFrame:
    """FK-TARGET-MISSING, SECTION-*, API-*: what only shows with all tables at hand."""
    known = r.tables.select("table_key").distinct()
    fk = r.foreign_keys.withColumn("target_key", F.lower("target_table"))
    fk = fk.join(known.withColumnRenamed("table_key", "target_key"), "target_key", "left_anti")
    out = [_issues(fk, "Error", "FK-TARGET-MISSING", _text("Table '{}': FK '{}' → '{}': target table '{}' is not defined", "table_name", "source_field", "target_table", "target_table"), F.col("source_field"), F.nullif(F.col("source_file"), F.lit("")))]
    sections = r.sections.select(F.lower("name").alias("section_key")).distinct()
    lost = r.table_sections.join(sections, "section_key", "left_anti")
    out.append(_issues(lost, "Warning", "SECTION-UNDEFINED", _text("Table '{}' references undefined section '{}'", "table_name", "section"), file=F.nullif(F.col("source_file"), F.lit(""))))
    members = r.section_tables.join(known, "table_key", "left_anti")
    out.append(_issues(members, "Warning", "SECTION-TABLE-UNDEFINED", _text("Section '{}' references undefined table '{}'", "section", "table_name"), file=F.nullif(F.col("source_file"), F.lit(""))))
    ends = r.endpoints.filter("db_table is not null").withColumn("table_key", F.lower("db_table"))
    tags = r.tables.select("table_key", F.col("name").alias("table_name"), F.col("database_types").alias("declared"))
    ends = ends.join(tags, "table_key", "left")
    place = "API '{}' endpoint '{} {}': "
    out.append(_issues(ends.filter("declared is null"), "Error", "API-DBTABLE-MISSING", _text(place + "x-db-table '{}' is not defined in table definitions", "api", "method", "path", "db_table"), file=F.col("source_file")))
    typed = ends.filter("size(database_types) > 0 and size(declared) > 0").withColumn("tag", F.explode("database_types"))
    typed = typed.filter(~F.array_contains(F.transform("declared", lambda x: F.lower(x)), F.lower("tag")))
    out.append(_issues(typed, "Warning", "API-DBTYPE-MISMATCH", _text(place + "x-databaseTypes value '{}' is not declared on table '{}' (table declares: {})", "api", "method", "path", "tag", "table_name", F.array_join("declared", ", ")), file=F.col("source_file")))
    return union_all(out)


def validate_tenants(types: DataFrame, databases: DataFrame, sections: DataFrame) -> DataFrame:
    """TENANT-*: a topology of databases against its types and the module sections."""
    t = types.select(F.lower("type").alias("type_key"), F.coalesce("root", F.lit(False)).alias("is_root"), "allowed_parents", "required_sections")
    d = databases.withColumns({"db_key": F.lower("name"), "type_key": F.lower("type"), "parent_key": F.lower("parent")}).withColumnRenamed("name", "table_name")
    known = d.join(F.broadcast(t), "type_key", "left")
    has = F.col("is_root").isNotNull()
    roots = types.agg(F.count_if(F.coalesce("root", F.lit(False))).alias("n")).filter("n = 0")
    out = [
        _issues(roots, "Error", "TENANT-ROOT-MISSING", F.lit("No tenant type has 'root: true'; exactly one database must be the root")),
        _issues(known.filter(~has), "Error", "TENANT-TYPE-UNKNOWN", _text("Database '{}' references unknown type '{}'", "table_name", "type")),
    ]
    modules = sections.filter("is_module").select(F.lower("name").alias("section_key")).distinct()
    installed = known.withColumn("section", F.explode("sections")).withColumn("section_key", F.lower("section"))
    out.append(_issues(installed.join(modules, "section_key", "left_anti"), "Error", "TENANT-SECTION-NOT-MODULE", _text("Database '{}' references section '{}' which is not flagged as isModule: true", "table_name", "section")))
    lower = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(x))
    wanted = known.filter(has).withColumn("need", F.explode("required_sections")).filter(~F.array_contains(lower("sections"), F.lower("need")))
    out.append(_issues(wanted, "Error", "TENANT-REQUIRED-SECTION-MISSING", _text("Database '{}' (type '{}') is missing required section '{}'", "table_name", "type", "need")))
    parents = d.select(F.col("db_key").alias("parent_key"), F.col("type").alias("parent_type")).withColumn("_found", F.lit(True))
    child = known.filter("parent is not null").join(parents, "parent_key", "left")
    out.append(_issues(child.filter("_found is null"), "Error", "TENANT-PARENT-UNKNOWN", _text("Database '{}' references unknown parent '{}'", "table_name", "parent")))
    wrong = child.filter(F.col("_found") & has & ~F.array_contains(lower("allowed_parents"), F.lower("parent_type")))
    out.append(_issues(wrong, "Error", "TENANT-PARENT-NOT-ALLOWED", _text("Database '{}' (type '{}') has parent '{}' (type '{}') which is not in allowedParents: [{}]", "table_name", "type", "parent", "parent_type", F.array_join("allowed_parents", ", "))))
    out.append(_issues(known.filter("parent is not null and is_root"), "Error", "TENANT-ROOT-HAS-PARENT", _text("Database '{}' has root type '{}' but also specifies parent '{}'; root databases must not have a parent", "table_name", "type", "parent")))
    out.append(_issues(known.filter("parent is null and not is_root"), "Warning", "TENANT-ORPHAN", _text("Database '{}' (type '{}') has no parent; non-root databases should specify a parent", "table_name", "type")))
    many = known.filter("is_root").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("table_name")), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ").alias("names")).filter("n > 1")
    out.append(_issues(many, "Error", "TENANT-ROOT-DUPLICATE", _text("Multiple databases have a root type: {}; exactly one database must be the root", "names")))
    cycles = parent_cycles(d.select(F.col("db_key").alias("node"), F.col("parent_key").alias("parent")))
    cycles = cycles.join(d.select(F.col("db_key").alias("node"), "table_name", F.col("parent").alias("up")), "node")
    out.append(_issues(cycles, "Error", "TENANT-CYCLE", _text("Circular parent reference detected: database '{}' → parent '{}' creates a cycle", "table_name", "up")))
    return union_all(out)


def issue_summary(issues: DataFrame) -> DataFrame:
    """A4: counts of errors and warnings, and the flags that follow."""
    errors, warnings = F.count_if(F.col("severity") == "Error"), F.count_if(F.col("severity") == "Warning")
    return issues.agg(errors.alias("errors"), warnings.alias("warnings"), (errors > 0).alias("has_errors"), (warnings > 0).alias("has_warnings"))


def duplicate_occurrences(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A5: second and later rows of each key in a total order, with ``occurrence``."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("occurrence", nth).filter("occurrence > 1")


def unordered_rows(rows: DataFrame, position: str, keys: Sequence[str], span: int = 65_536) -> DataFrame:
    """Rows whose key, as text, is less than that of the row before by a numeric position.

    The list is cut into spans of positions, each ordered by one task; the last key of
    a span (one row each) is handed on to the first row of the next span that has rows.
    Rows at one position are ordered by their key, so they are never out of order among
    themselves; a null key column comes first; rows without a position aren't in the list.
    """
    text = F.array(*[F.col(k).cast("string") for k in keys])
    cut = rows.filter(F.col(position).isNotNull()).withColumn("_span", F.floor(F.col(position) / span)).withColumn("_key", text)
    own = Window.partitionBy("_span").orderBy(position, "_key")
    ends = cut.groupBy("_span").agg(F.max(F.struct(position, "_key"))["_key"].alias("_last"))
    ends = ends.select("_span", F.lag("_last").over(Window.orderBy("_span")).alias("_handed"))  # one row a span
    joined = cut.withColumns({"_inside": F.lag("_key").over(own), "_nth": F.row_number().over(own)}).join(ends, "_span")
    before = F.when(F.col("_nth") == 1, F.col("_handed")).otherwise(F.col("_inside"))
    return joined.filter(before > F.col("_key")).select(*rows.columns)


def member_problems(rows: DataFrame, json: str, expected: Column, *keep: str) -> DataFrame:
    """J17 over data: (keep..., problem, col) of the members of JSON objects against a list of expected names.

    ``unknown`` members aren't expected, ``missing`` ones aren't there; a null or broken
    object lacks them all.
    """
    found = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    told = lambda names, problem: F.transform(names, lambda x: F.struct(F.lit(problem).alias("problem"), x.alias("col")))
    both = F.concat(told(F.array_except(found, expected), "unknown"), told(F.array_except(expected, found), "missing"))
    return rows.select(*keep, F.explode(both).alias("x")).select(*keep, "x.*")


def missing_targets(rows: DataFrame, column: str, targets: DataFrame, target: str) -> DataFrame:
    """J9 over data: rows whose non-null reference has no target row."""
    return rows.filter(F.col(column).isNotNull()).join(targets.select(F.col(target).alias(column)), column, "left_anti")
