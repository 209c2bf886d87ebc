"""Registries of JSON documents (S1-S4, S6): scanning, key canonicalising and checks.

The scan is Spark's (recursive, by glob); documents are small and few next to the
data, so they are decoded on the driver, where the raw tokens of embedded rows can be
kept exactly.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.model import Registry
from plumbline.operators.filters import skipped_folder


class SchemaError(ValueError):
    """A document that can't be read or breaks the registry's rules (exit code 2)."""


class ConfigError(ValueError):
    """A setting that is missing or contradicts another (exit code 4)."""


def scan_json(spark: SparkSession, root: str, skip: Sequence[str] = ()) -> DataFrame:
    """(path, value) of every ``*.json`` under a folder by path; a missing folder has none."""
    from pyspark.errors import AnalysisException

    try:
        files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], "path string, value string")
        raise
    path = F.url_decode(F.replace(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/"), F.lit("+"), F.lit("%2B")))
    rows = files.select(path.alias("path"), "value")
    inside = F.regexp_replace("path", "^" + re.escape(root.rstrip("/")) + "/?", "")
    return rows.filter(~skipped_folder(inside, skip)).orderBy("path")


class _Raw(str):
    """A number as it was written."""


def _snake(name: str) -> str:
    return re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower()


#: Member names of documents; the model has them in snake case.
_NAMES = (
    "name", "description", "descriptionAutoGenerated", "shortDescription", "isDeprecated", "deprecationMessage", "fields", "primaryKey", "foreignKeys", "databaseTypes",
    "sets", "sections", "sourceFile", "isReferenceTable", "labelField", "data", "indexes", "checkConstraints", "uniqueConstraints", "type", "nullable", "isPrimaryKey",
    "isMatchColumn", "default", "isComputed", "computedExpression", "isPersisted", "sensitivity", "sourceField", "targetTable", "targetField", "cascadeDelete", "kind",
    "soft", "columns", "isUnique", "isClustered", "isFiltered", "filterExpression", "includedColumns", "expression", "column", "title", "tables", "isModule", "erds",
    "includeLogical", "includeVirtual",
)
_MEMBERS = {n.lower(): _snake(n) for n in _NAMES}


def _canonical(value):
    """Members under their model names; those that aren't known are left out."""
    if isinstance(value, dict):
        return {_MEMBERS[k.lower()]: (v if k.lower() == "data" else _canonical(v)) for k, v in value.items() if k.lower() in _MEMBERS}
    if isinstance(value, list):
        return [_canonical(v) for v in value]
    return str(value) if isinstance(value, _Raw) else value


def raw_token(value) -> str:
    """A decoded value as the JSON token it came from (nested ones are written anew)."""
    if isinstance(value, _Raw):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{raw_token(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(raw_token, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def data_row(text: str) -> dict[str, str]:
    """A JSON object as raw tokens by member."""
    return {k: raw_token(v) for k, v in json.loads(text, parse_float=_Raw, parse_int=_Raw).items()}


def foreign_key(doc: dict) -> dict:
    """The legacy member ``soft`` means logical or physical and can't stand beside ``kind``."""
    fk = dict(doc)
    soft, kind = fk.pop("soft", None), fk.pop("kind", None)
    for member in ("source_field", "target_table", "target_field"):
        if not isinstance(fk.get(member), str):
            raise SchemaError(f"foreign key without {member}")
    if soft is not None and kind is not None:
        raise SchemaError("a foreign key can't have both soft and kind")
    kind = ("logical" if soft else "physical") if soft is not None else (kind or "physical").lower()
    if kind not in ("physical", "logical", "virtual"):
        raise SchemaError(f"unknown kind of foreign key: {kind}")
    return fk | {"kind": kind, "cascade_delete": bool(fk.get("cascade_delete"))}


def decode(path: str, text: str, required: Sequence[str]) -> dict:
    """One document under model names, with its raw data rows; SchemaError names the file."""
    try:
        doc = json.loads(text.lstrip("\ufeff"), parse_float=_Raw, parse_int=_Raw)
        if not isinstance(doc, dict):
            raise SchemaError("not an object")
        out = _canonical(doc)
        for member in required:
            if out.get(member) is None:
                raise SchemaError(f"{member} is missing")
        if "data" in out:
            out["data"] = [{k: raw_token(v) for k, v in row.items()} for row in out["data"]]
        if "foreign_keys" in out:
            out["foreign_keys"] = [foreign_key(fk) for fk in out["foreign_keys"]]
    except (ValueError, AttributeError, TypeError) as e:
        raise SchemaError(f"{path}: {e}") from e
    return out | {"source_file": path}


def load_tables(spark: SparkSession, root: str, skip: Sequence[str] = (), only_tables_folders: bool = False) -> list[dict]:
    """Table documents by path; with ``only_tables_folders`` those under folders called tables (S3)."""
    files = scan_json(spark, root, skip)
    if only_tables_folders:
        files = files.filter(F.lower("path").rlike("/tables/"))
    return [decode(r["path"], r["value"], ("name",)) for r in files.collect()]


def load_sections(spark: SparkSession, root: str, skip: Sequence[str] = ()) -> list[dict]:
    """Section documents by path."""
    return [{"tables": [], "erds": []} | decode(r["path"], r["value"], ("name",)) for r in scan_json(spark, root, skip).collect()]


def load_registry(spark: SparkSession, root: str, sections_root: str | None = None, skip: Sequence[str] = ()) -> Registry:
    """S3: all tables below the root, and its sections; fails without tables or with a name twice."""
    tables = load_tables(spark, root, skip, only_tables_folders=True)
    if not tables:
        raise SchemaError(f"no table documents under {root}")
    check_unique(tables)
    sections = load_sections(spark, sections_root, skip) if sections_root else []
    return Registry.of(spark, tables, sections)


def check_unique(tables: Sequence[dict]) -> None:
    """A1: a name may occur once, case ignored."""
    seen: dict[str, list[str]] = {}
    for t in tables:
        seen.setdefault(t["name"].lower(), []).append(t.get("source_file") or t["name"])
    twice = {k: v for k, v in seen.items() if len(v) > 1}
    if twice:
        raise SchemaError("table names that occur more than once: " + "; ".join(f"{k} ({', '.join(v)})" for k, v in sorted(twice.items())))


def parse_config(text: str) -> dict:
    """A config document with comments and trailing commas; keys in lower case at every level."""

    def drop(m: re.Match) -> str:
        return m[0] if m[0].startswith('"') else ("" if m[0].startswith(",") else " ")

    plain = re.sub(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', drop, text.lstrip("\ufeff"), flags=re.S)
    plain = re.sub(r'"(?:\\.|[^"\\])*"|,(?=\s*[}\]])', drop, plain)
    lower = lambda v: {k.lower(): lower(x) for k, x in v.items()} if isinstance(v, dict) else [lower(x) for x in v] if isinstance(v, list) else v
    try:
        config = json.loads(plain)
    except ValueError as e:
        raise ConfigError(f"config: {e}") from e
    kind = ((config.get("output") or {}).get("format") or {}).get("type", "markdown")
    if kind.lower() not in ("markdown", "dbml"):
        raise ConfigError(f"output.format.type: {kind}")
    return lower(config)


def load_config(path: str) -> dict:
    """S5 from a file on the driver; the file must exist."""
    from pathlib import Path

    if not Path(path).is_file():
        raise ConfigError(f"no config file {path}")
    return parse_config(Path(path).read_text(encoding="utf-8"))


__all__ = ["ConfigError", "SchemaError", "check_unique", "decode", "load_config", "load_registry", "load_sections", "load_tables", "parse_config", "raw_token", "scan_json"]
