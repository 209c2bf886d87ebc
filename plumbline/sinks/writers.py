"""Writers: atomic text files, registry documents, reports as JSON."""

from __future__ import annotations

import json
import logging
import os
import re
import tempfile
from collections.abc import Callable, Mapping
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame

from plumbline.model import FIELD_DEFAULTS, TABLE_DEFAULTS, TABLE_DDL, Registry

log = logging.getLogger(__name__)


def write_text(path: str | os.PathLike, text: str, dry_run: bool = False) -> bool:
    """K1/K2: the whole file or none of it; parents are made.  A dry run only tells what it would write."""
    path = Path(path)
    if dry_run:
        log.info("would write %s (%d characters)", path, len(text))
        return False
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, temporary = tempfile.mkstemp(prefix=f".{path.name}.", suffix=".tmp", dir=path.parent)
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as out:
            out.write(text)
        os.replace(temporary, path)
    except BaseException:
        Path(temporary).unlink(missing_ok=True)
        raise
    return True


def camel(name: str) -> str:
    return re.sub(r"_(\w)", lambda m: m[1].upper(), name)


def _plain(row) -> object:
    if hasattr(row, "asDict"):
        return {k: _plain(v) for k, v in row.asDict().items()}
    return [_plain(v) for v in row] if isinstance(row, list) else dict(row) if isinstance(row, Mapping) else row


def _slim(doc: dict, defaults: Mapping, keep: tuple[str, ...]) -> dict:
    """Members under camelCase names, without nulls and values that are defaults."""
    return {camel(k): v for k, v in doc.items() if k in keep or v is not None and v != defaults.get(k) and v != []}


def foreign_key_json(fk: dict) -> dict:
    """K5: defaults are left out."""
    return _slim(fk, {"cascade_delete": False, "kind": "physical"}, ("source_field", "target_table", "target_field"))


class _Token(float):
    """A number that is written as it was read."""

    def __new__(cls, text: str):
        self = super().__new__(cls, 0)
        self.text = text
        return self

    def __repr__(self) -> str:
        return self.text


def _value(token: str | None) -> object:
    return json.loads(token, parse_int=_Token, parse_float=_Token) if token is not None else None


def document_json(doc: dict) -> str:
    """K3: a table document as it is kept in a registry: fixed member order, two-space indent."""
    index_defaults = {"is_unique": False, "is_clustered": False, "is_filtered": False}
    out = _slim({k: v for k, v in doc.items() if k not in ("source_file", "data")}, {**TABLE_DEFAULTS, "fields": None}, ("name", "fields"))
    out["fields"] = [_slim(f, FIELD_DEFAULTS, ("name", "type")) for f in doc["fields"]]
    parts = {"foreignKeys": foreign_key_json, "indexes": lambda i: _slim(i, index_defaults, ("name", "columns")), "checkConstraints": lambda c: _slim(c, {}, ("name", "expression"))}
    for name, shape in parts.items():
        if name in out:
            out[name] = [shape(x) for x in out[name]]
    if doc.get("is_reference_table") and doc.get("data"):
        out["data"] = [{k: _value(v) for k, v in row.items()} for row in doc["data"]]
    order = ["name", "description", "descriptionAutoGenerated", "shortDescription", "isDeprecated", "deprecationMessage", "isReferenceTable", "labelField", "fields", "primaryKey", "foreignKeys", "databaseTypes", "sets", "sections", "data", "indexes", "checkConstraints", "uniqueConstraints"]
    whole = {"$schemaVersion": "1.0"} | {k: out[k] for k in order if k in out}
    encoder = json.JSONEncoder(indent=2, ensure_ascii=False)
    return "".join(_encode(encoder, whole)) + "\n"


def _encode(encoder: json.JSONEncoder, value: object):
    """``encoder`` with tokens of numbers kept: they are put in for placeholders after encoding."""
    tokens: list[str] = []

    def mark(v):
        if isinstance(v, _Token):
            tokens.append(v.text)
            return f"\x00{len(tokens) - 1}\x00"
        if isinstance(v, dict):
            return {k: mark(x) for k, x in v.items()}
        return [mark(x) for x in v] if isinstance(v, list) else v

    yield re.sub(r'"\\u0000(\d+)\\u0000"', lambda m: tokens[int(m[1])], encoder.encode(mark(value)))


def documents_of(registry: Registry) -> list[dict]:
    """All table documents of a snapshot on the driver, by name: a registry is metadata, small by nature."""
    return [_plain(r) for r in registry.documents.orderBy("name").collect()]


def sections_of(registry: Registry) -> list[dict]:
    return [_plain(r) for r in registry.sections.orderBy("load_order").collect()] if registry.sections is not None else []


def safe_file_name(name: str) -> str:
    return re.sub(r'[\\/:*?"<>|]', "_", name) + ".json"


def write_registry(registry: Registry, folder: str, path_of: Callable[[dict], str] | None = None, dry_run: bool = False) -> list[str]:
    """K3: a file a table; existing files whose content is the same aren't touched."""
    written = []
    for doc in documents_of(registry):
        path = path_of(doc) if path_of else doc["source_file"] or f"{folder}/{safe_file_name(doc['name'])}"
        text = document_json(doc)
        if Path(path).is_file() and Path(path).read_text(encoding="utf-8") == text:
            continue
        write_text(path, text, dry_run)
        written.append(path)
    return written


def section_json(section: dict) -> str:
    """K4."""
    doc = {"name": section["name"], "title": section.get("title"), "description": section.get("description"), "tables": section["tables"]}
    return json.dumps({k: v for k, v in doc.items() if v is not None}, indent=2, ensure_ascii=False) + "\n"


def all_tables_section(registry: Registry) -> dict:
    """K4: the generated section of every table, names sorted."""
    return {"name": "All Tables", "tables": sorted((r["name"] for r in registry.documents.select("name").collect()), key=str.lower)}


def validation_report(issues: DataFrame, tables: int = 0, sections: int = 0, apis: int = 0, now: datetime | None = None) -> str:
    """K6: counts and issues as JSON; one collect of the issues, which are about metadata."""
    rows = [r.asDict() for r in issues.collect()]
    errors, warnings = (sum(r["severity"] == s for r in rows) for s in ("Error", "Warning"))
    summary = {"tablesScanned": tables, "sectionsScanned": sections, "apisScanned": apis, "errors": errors, "warnings": warnings, "hasErrors": errors > 0, "hasWarnings": warnings > 0}
    listed = [{"severity": r["severity"], "code": r["code"], "message": r["message"], "file": r["file"], "field": r["field"], "line": None} for r in rows]
    return json.dumps({"generatedAt": (now or datetime.now(UTC)).isoformat(), "summary": summary, "issues": listed}, indent=2, ensure_ascii=False)


def delete_removed(paths: list[str], remove_tables: bool, remove_columns: bool, dry_run: bool = False) -> list[str]:
    """Files of removed tables go only with both remove flags, and not in a dry run."""
    if not (remove_tables and remove_columns):
        return []
    for p in paths if not dry_run else ():
        Path(p).unlink(missing_ok=True)
    return list(paths)


def output_path(default: str, output: str | None = None, output_dir: str | None = None) -> str:
    """An explicit file, else the default's name in an explicit folder, else the default."""
    return output or (str(Path(output_dir) / Path(default).name) if output_dir else default)


def formatted(value: object, kind: str = "json") -> str:
    """A value of maps, lists and scalars as JSON or YAML; scalars of YAML are written as JSON's, which it takes."""
    if kind == "json":
        return json.dumps(value, indent=2, ensure_ascii=False)
    return "\n".join(_yaml(value)) + "\n"


def _yaml(value: object) -> list[str]:
    """Lines of a value at the left edge."""
    if not value or not isinstance(value, (Mapping, list)):
        return [json.dumps(value, ensure_ascii=False)]
    out = []
    for head, v in ((f"{k}:", v) for k, v in value.items()) if isinstance(value, Mapping) else (("-", v) for v in value):
        lines = _yaml(v)
        nested = bool(v) and isinstance(v, (Mapping, list))
        out += [head, *(f"  {line}" for line in lines)] if nested else [f"{head} {lines[0]}"]
    return out


def json_schema(kind: str) -> dict:
    """Draft-7 schema of a document kind, derived from the model's own types."""
    from pyspark.sql.types import StructType

    from plumbline.model import SECTION_DDL

    def shape(t, name: str) -> dict:
        k = t.typeName()
        if k == "array":
            return {"type": "array", "items": shape(t.elementType, name)}
        if k == "struct":
            needed = [camel(f.name) for f in t.fields if f.name in _REQUIRED.get(name, ())]
            return {"type": "object", "properties": {camel(f.name): shape(f.dataType, f.name) for f in t.fields}} | ({"required": needed} if needed else {})
        if k == "map":
            return {"type": "object"}
        return {"type": {"boolean": "boolean", "integer": "integer"}.get(k, "string")} | ({"enum": _ENUMS[name]} if name in _ENUMS else {})

    head = {"$schema": "http://json-schema.org/draft-07/schema#", "title": f"{kind.capitalize()} Definition"}
    if kind in ("table", "section"):
        whole = StructType.fromDDL(TABLE_DDL if kind == "table" else SECTION_DDL)
        own = shape(whole, kind)
        for inner in ("sourceFile", "loadOrder"):
            own["properties"].pop(inner, None)
        if kind == "section":
            own["properties"]["erds"]["items"]["properties"]["fields"] = {"type": "string", "enum": ["none", "pk-and-fk", "all"]}
        return head | own
    if kind == "api":
        endpoint = {"type": "object", "required": ["path", "method"], "properties": {"path": {"type": "string"}, "method": {"type": "string", "enum": ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"]}, "tags": {"type": "array", "items": {"type": "string"}}, "dbTable": {"type": "string"}, "dbOperation": {"type": "string"}, "databaseTypes": {"type": "array", "items": {"type": "string"}}}}
        return head | {"type": "object", "required": ["name", "title", "version"], "properties": {"name": {"type": "string"}, "title": {"type": "string"}, "version": {"type": "string"}, "endpoints": {"type": "array", "items": endpoint}}}
    if kind == "config":
        text, texts, flag = {"type": "string"}, {"type": "array", "items": {"type": "string"}}, {"type": "boolean"}
        paths = {"root": text, "skip": texts, "documentSections": text, "tables": text, "adapters": text}
        formats = {"type": "object", "required": ["type"], "properties": {"type": {"type": "string", "enum": ["markdown", "dbml"]}, "dialect": {"type": "string", "enum": ["CommonMark", "AzureDevOps"]}}}
        gates = {"enabled": flag, "maxRows": {"type": "integer", "default": 100}, "maxSizeKb": {"type": "integer", "default": 1024}, "patterns": texts}
        reference = {"enabled": flag, "autoCapture": flag, "captureOn": texts, "explicitTables": texts, "heuristics": {"type": "object", "properties": gates}}
        parts = {"paths": paths, "output": {"title": text, "sectionOrder": texts, "format": formats}, "referenceTables": reference}
        return head | {"type": "object", "properties": {k: {"type": "object", "properties": v} for k, v in parts.items()}}
    raise ValueError(f"no schema of {kind}")


_REQUIRED = {
    "table": ("name",), "fields": ("name", "type"), "foreign_keys": ("source_field", "target_table", "target_field"), "section": ("name", "tables"),
    "sets": ("name",), "indexes": ("name", "columns"), "check_constraints": ("name", "expression"), "unique_constraints": ("name", "columns"),
}
_ENUMS = {"kind": ["physical", "logical", "virtual"], "sensitivity": ["public", "internal", "confidential", "pii"]}
