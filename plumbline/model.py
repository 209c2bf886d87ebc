"""The record model: one nested document a table, and the relations it is taken apart into.

Identifiers are compared case-insensitively through ``*_key = lower(name)`` columns.
Order is data: fields, key columns, indexes and rows carry an ``ordinal``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

FIELD = (
    "name string, type string, nullable boolean, description string, is_primary_key boolean, is_match_column boolean, default string, "
    "is_computed boolean, computed_expression string, is_persisted boolean, is_deprecated boolean, deprecation_message string, sensitivity string, description_auto_generated boolean"
)
FOREIGN_KEY = "source_field string, target_table string, target_field string, cascade_delete boolean, kind string"
INDEX = "name string, columns array<string>, is_unique boolean, is_clustered boolean, is_filtered boolean, filter_expression string, included_columns string, description string"
TABLE_DDL = (
    "name string, description string, description_auto_generated boolean, short_description string, is_deprecated boolean, deprecation_message string, "
    f"fields array<struct<{FIELD.replace(' ', ':').replace(',:', ',')}>>, primary_key array<string>, "
    f"foreign_keys array<struct<{FOREIGN_KEY.replace(' ', ':').replace(',:', ',')}>>, database_types array<string>, "
    "sets array<struct<name:string,columns:array<string>>>, sections array<string>, source_file string, is_reference_table boolean, label_field string, "
    "data array<map<string,string>>, "
    f"indexes array<struct<{INDEX.replace(' ', ':').replace(',:', ',')}>>, "
    "check_constraints array<struct<name:string,expression:string,column:string>>, unique_constraints array<struct<name:string,columns:array<string>>>"
)
SECTION_DDL = (
    "name string, title string, description string, tables array<string>, is_module boolean, source_file string, load_order int, "
    "erds array<struct<title:string,tables:array<string>,include_logical:boolean,include_virtual:boolean,fields:string>>"
)
ENDPOINT_DDL = "api string, method string, path string, db_table string, database_types array<string>, source_file string"
TENANT_TYPE_DDL = "type string, root boolean, allowed_parents array<string>, required_sections array<string>"
TENANT_DATABASE_DDL = "name string, type string, parent string, sections array<string>"
ISSUE_DDL = "severity string, code string, message string, table_name string, field string, file string"

#: Defaults of members that a document may leave out.
FIELD_DEFAULTS = {"nullable": False, "is_primary_key": False, "is_match_column": False, "is_computed": False, "is_persisted": False, "is_deprecated": False, "description": ""}
TABLE_DEFAULTS = {
    "description": "", "is_deprecated": False, "is_reference_table": False, "fields": [], "primary_key": [], "foreign_keys": [], "database_types": [], "sets": [],
    "sections": [], "data": [], "indexes": [], "check_constraints": [], "unique_constraints": [], "source_file": "",
}


def table_document(**values) -> dict:
    """A whole table document from the members given, defaults filled in."""
    out = TABLE_DEFAULTS | {k: v for k, v in values.items() if v is not None}
    out["fields"] = [FIELD_DEFAULTS | {k: v for k, v in f.items() if v is not None} for f in out["fields"]]
    out["foreign_keys"] = [{"cascade_delete": False, "kind": "physical"} | fk for fk in out["foreign_keys"]]
    out["indexes"] = [{"is_unique": False, "is_clustered": False, "is_filtered": False} | i for i in out["indexes"]]
    return out



def _shape(value, kind):
    """``value`` as what Arrow takes for ``kind``: absent members null, maps as pairs."""
    name = kind.typeName()
    if value is None:
        return None
    if name == "struct":
        return {f.name: _shape(value.get(f.name), f.dataType) for f in kind.fields}
    if name == "array":
        return [_shape(v, kind.elementType) for v in value]
    return list(value.items()) if name == "map" else value


def frame(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A DataFrame of documents in the given schema; members that are absent are null.

    It goes through Arrow to a local relation, whose size Catalyst knows: joins with
    metadata then broadcast by themselves.
    """
    schema = StructType.fromDDL(ddl)
    table = pa.Table.from_pylist([_shape(r, schema) for r in rows], to_arrow_schema(schema))
    return spark.createDataFrame(table, schema)


def key(name: str | Column) -> Column:
    """The case-insensitive form of an identifier (one code point each, so lower and not upper)."""
    return F.lower(F.col(name) if isinstance(name, str) else name)


@dataclass
class Registry:
    """The relations of one snapshot.  All but ``documents`` are built when first asked for."""

    documents: DataFrame
    sections: DataFrame | None = None
    endpoints: DataFrame | None = None

    @classmethod
    def of(cls, spark: SparkSession, tables: list[dict], sections: list[dict] = (), endpoints: list[dict] = ()) -> Registry:
        """From plain documents, in load order."""
        docs = frame(spark, [table_document(**t) for t in tables], TABLE_DDL)
        sections = [{"tables": [], "erds": [], "load_order": i} | s for i, s in enumerate(sections)]
        return cls(docs, frame(spark, sections, SECTION_DDL), frame(spark, list(endpoints), ENDPOINT_DDL))

    def _exploded(self, column: str, *extra: str) -> DataFrame:
        base = self.documents.select(F.col("name").alias("table_name"), key("name").alias("table_key"), *extra, F.posexplode(column).alias("ordinal", "x"))
        return base

    @property
    def tables(self) -> DataFrame:
        return self.documents.withColumn("table_key", key("name"))

    @property
    def fields(self) -> DataFrame:
        return self._exploded("fields").select("table_name", "table_key", "ordinal", key("x.name").alias("field_key"), "x.*")

    @property
    def primary_keys(self) -> DataFrame:
        return self._exploded("primary_key").select("table_name", "table_key", "ordinal", F.col("x").alias("name"), key("x").alias("field_key"))

    @property
    def foreign_keys(self) -> DataFrame:
        return self._exploded("foreign_keys", "source_file").select("table_name", "table_key", "source_file", "ordinal", "x.*")

    @property
    def indexes(self) -> DataFrame:
        return self._exploded("indexes").select("table_name", "table_key", "ordinal", key("x.name").alias("index_key"), "x.*")

    @property
    def checks(self) -> DataFrame:
        return self._exploded("check_constraints").select("table_name", "table_key", "ordinal", "x.*")

    @property
    def uniques(self) -> DataFrame:
        return self._exploded("unique_constraints").select("table_name", "table_key", "ordinal", "x.*")

    @property
    def column_sets(self) -> DataFrame:
        sets = self._exploded("sets").select("table_name", "table_key", F.col("x.name").alias("set_name"), "ordinal", F.posexplode("x.columns").alias("at", "column"))
        return sets.withColumn("field_key", key("column"))

    @property
    def table_sections(self) -> DataFrame:
        return self._exploded("sections", "source_file").select("table_name", "table_key", "source_file", F.col("x").alias("section"), key("x").alias("section_key"))

    @property
    def database_types(self) -> DataFrame:
        return self._exploded("database_types").select("table_name", "table_key", "ordinal", F.col("x").alias("database_type"))

    @property
    def ref_rows(self) -> DataFrame:
        return self._exploded("data", "is_reference_table").select("table_name", "table_key", "is_reference_table", F.col("ordinal").alias("row_index"), F.col("x").alias("row"))

    @property
    def section_tables(self) -> DataFrame:
        base = self.sections.select(F.col("name").alias("section"), key("name").alias("section_key"), "title", "source_file", "load_order", F.posexplode("tables").alias("ordinal", "table_name"))
        return base.withColumn("table_key", key("table_name"))

    @property
    def erds(self) -> DataFrame:
        return self.sections.select(F.col("name").alias("section"), key("name").alias("section_key"), F.posexplode("erds").alias("ordinal", "x")).select("section", "section_key", "ordinal", "x.*")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
