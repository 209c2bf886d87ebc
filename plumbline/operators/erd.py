"""Diagram relations: scope, edges and fields of a section's diagram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import mermaid_name, mermaid_stub, type_base
from plumbline.model import Registry


def erd_scope(registry: Registry, section: str) -> DataFrame:
    """(table_key, name) of a section's tables that are defined."""
    members = registry.section_tables.filter(F.col("section_key") == section.lower()).select("table_key", F.col("table_name").alias("name")).distinct()
    return members.join(registry.tables.select("table_key"), "table_key", "left_semi")


def erd_edges(registry: Registry, section: str, include_logical: bool | None = None, include_virtual: bool = False) -> DataFrame:
    """(parent, child, field, line): edges inside the section, and stubs of physical keys that leave it."""
    scope = erd_scope(registry, section)
    fk = registry.foreign_keys.join(scope.withColumnRenamed("name", "child"), "table_key")
    kind = F.lower("kind")
    fk = fk.filter((kind == "physical") | ((kind == "logical") & F.coalesce(F.lit(include_logical), F.lit(True))) | ((kind == "virtual") & F.lit(include_virtual)))
    fk = fk.withColumn("target_key", F.lower("target_table"))
    inside = scope.select(F.col("table_key").alias("target_key"), F.lit(True).alias("_in"))
    known = registry.tables.select(F.col("table_key").alias("target_key"), F.lit(True).alias("_known"))
    # the first section that names a table is its home
    homes = registry.section_tables.groupBy(F.col("table_key").alias("target_key")).agg(F.min_by(F.coalesce("title", "section"), F.struct("load_order", "ordinal")).alias("home"))
    joined = fk.join(inside, "target_key", "left").join(known, "target_key", "left").join(homes, "target_key", "left")
    stub = mermaid_stub(F.coalesce("home", F.lit("?")), F.col("target_table"))
    parent = F.when(F.col("_in"), mermaid_name(F.col("target_table"))).when(F.col("_known") & (kind == "physical"), stub)
    out = joined.select(parent.alias("parent"), mermaid_name(F.col("child")).alias("child"), F.col("source_field").alias("field")).filter("parent is not null")
    line = F.concat(F.lit("    "), "parent", F.lit(" ||--o{ "), "child", F.lit(' : "'), "field", F.lit('"'))
    return out.withColumn("line", line)


def erd_fields(registry: Registry, section: str, mode: str = "pk-and-fk") -> DataFrame:
    """(table_key, ordinal, line) of the fields that a diagram shows."""
    fields = registry.fields.join(erd_scope(registry, section).select("table_key"), "table_key", "left_semi")
    pk = registry.primary_keys.select("table_key", "field_key", F.lit(True).alias("_pk")).distinct()
    fk = registry.foreign_keys.select("table_key", F.lower("source_field").alias("field_key"), F.lit(True).alias("_fk")).distinct()
    marked = fields.join(pk, ["table_key", "field_key"], "left").join(fk, ["table_key", "field_key"], "left")
    if mode != "all":
        marked = marked.filter("_pk or _fk") if mode == "pk-and-fk" else marked.limit(0)
    marks = F.concat_ws(",", F.when(F.col("_pk"), "PK").when(F.col("_fk"), "FK"), F.when(F.col("is_computed"), "C"), F.when(F.col("is_deprecated"), "DEPR"))
    line = F.rtrim(F.concat_ws(" ", F.concat(F.lit("        "), type_base(F.col("type"))), "name", marks))
    return marked.select("table_key", "ordinal", line.alias("line"))
