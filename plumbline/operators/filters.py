"""Filters by schema, section, name pattern and row count."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import glob_regex, schema_prefix

#: Schemas that a catalog keeps for itself.
SYSTEM_SCHEMAS = ("pg_catalog", "information_schema", "mysql", "performance_schema", "sys")


def parts_of(text: str | None) -> list[str]:
    return [p for x in (text or "").split(",") if (p := x.strip())]


def schema_matches(name: Column, schemas: str | None) -> Column:
    """The prefix before the first dot is listed, case ignored; all match without a list, dotless names never with one."""
    wanted = [p.lower() for p in parts_of(schemas)]
    if not wanted:
        return F.lit(True)
    return (F.instr(name, ".") > 1) & F.lower(schema_prefix(name)).isin(wanted)


def schema_filter(tables: DataFrame, schemas: str | None, name: str = "name") -> DataFrame:
    return tables.filter(schema_matches(F.col(name), schemas))


def catalog_schema_filter(columns: DataFrame, schemas: str | None, schema: str = "table_schema") -> DataFrame:
    """Like P1 on a schema column, case-sensitive."""
    wanted = parts_of(schemas)
    return columns.filter(F.col(schema).isin(wanted)) if wanted else columns


def without_system_schemas(columns: DataFrame, schema: str = "table_schema") -> DataFrame:
    """P14."""
    return columns.filter(~F.col(schema).isin(*SYSTEM_SCHEMAS))


def of_table_type(tables: DataFrame, kind: str = "both", column: str = "table_type") -> DataFrame:
    """Base tables, views, or both."""
    wanted = {"tables": ["BASE TABLE"], "views": ["VIEW"], "both": ["BASE TABLE", "VIEW"]}[kind]
    return tables.filter(F.col(column).isin(wanted))


def section_filter(tables: DataFrame, section_tables: DataFrame, sections: Sequence[str]) -> DataFrame:
    """Tables of any of the sections (all without a list)."""
    if not sections:
        return tables
    wanted = section_tables.filter(F.col("section_key").isin([s.lower() for s in sections])).select("table_key")
    return tables.join(wanted, "table_key", "left_semi")


def unknown_sections(sections: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """(section) of the requested ones that aren't defined."""
    asked = sections.sparkSession.createDataFrame([(s,) for s in wanted], "section string")
    return asked.join(sections.select(F.lower("name").alias("k")), F.lower("section") == F.col("k"), "left_anti")


def combined_filter(tables: DataFrame, section_tables: DataFrame, schemas: str | None, sections: Sequence[str], name: str = "name") -> DataFrame:
    """Both filters; one that isn't set lets all pass."""
    return section_filter(schema_filter(tables, schemas, name), section_tables, sections)


def outside_folder(tables: DataFrame, folder: str) -> DataFrame:
    """Documents whose file isn't under ``folder`` (case ignored)."""
    return tables.filter(~F.startswith(F.lower("source_file"), F.lit(folder.rstrip("/").lower() + "/")))


def matches_any(name: Column, globs: Iterable[str]) -> Column:
    found = F.lit(False)
    for g in globs:
        found = found | name.rlike(glob_regex(g))
    return found


def reference_tables(names: DataFrame, counts: DataFrame, explicit: Sequence[str], globs: Sequence[str], max_rows: int = 100) -> DataFrame:
    """(name, n_rows, is_reference): listed by name, or of few (or unknown) rows and a matching name."""
    rows = names.select("name", F.lower("name").alias("table_key")).join(counts.select(F.lower("name").alias("table_key"), "n_rows"), "table_key", "left")
    listed = F.col("table_key").isin([e.lower() for e in explicit]) if explicit else F.lit(False)
    few = F.col("n_rows").isNull() | (F.col("n_rows") <= max_rows)
    return rows.select("name", "n_rows", (listed | (few & matches_any(F.col("name"), globs))).alias("is_reference"))


def duplicate_names(tables: DataFrame, name: str = "name", path: str = "source_file") -> DataFrame:
    """A1: (table_key, n, members) of names that occur more than once, case ignored."""
    grouped = tables.groupBy(F.lower(name).alias("table_key")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(path)).alias("members"))
    return grouped.filter("n > 1")


def first_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in a given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_first", F.row_number().over(w)).filter("_first = 1").drop("_first")


def ordered_sections(sections: DataFrame, order: Sequence[str]) -> DataFrame:
    """Sections with ``position``: those listed in that order, the others after them in load order."""
    listed = sections.sparkSession.createDataFrame([(s.lower(), i) for i, s in enumerate(order)], "section_key string, at int")
    joined = sections.withColumn("section_key", F.lower("name")).join(F.broadcast(listed), "section_key", "left")
    place = F.row_number().over(Window.orderBy(F.col("at").asc_nulls_last(), "load_order"))
    return joined.select("name", "section_key", place.alias("position"))


def skipped_folder(path: Column, skip: Sequence[str]) -> Column:
    """Whether a folder on the way to a file (not the file itself) is in the skip list, case ignored."""
    if not skip:
        return F.lit(False)
    parts = F.split(F.lower(path), "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(s.lower()) for s in skip]))
