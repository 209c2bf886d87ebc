"""Prisma documents (S8): models, enums, relations and the datasource's settings."""

from __future__ import annotations

import re

from plumbline.functions.types import scalar_type
from plumbline.model import table_document
from plumbline.sources.dbml import ParsedModel

#: Native types that are known, lower-case, with what is written for those spelt otherwise.
NATIVE_TYPES = (
    "varchar", "nvarchar", "char", "nchar", "text", "ntext", "tinytext", "mediumtext", "longtext", "tinyint", "smallint", "mediumint", "int", "unsignedint", "bigint",
    "decimal", "double", "doubleprecision", "float", "real", "money", "smallmoney", "bit", "boolean", "date", "time", "datetime", "datetime2", "datetimeoffset",
    "smalldatetime", "timestamp", "uniqueidentifier", "xml", "json", "jsonb", "uuid", "inet", "cidr", "objectid", "bytes", "binary", "varbinary", "longblob",
    "mediumblob", "blob", "tinyblob", "bytea",
)
NATIVE_SPELLINGS = {"unsignedint": "int unsigned", "doubleprecision": "double precision", "objectid": "objectId"}
#: Native types that keep their arguments.
NATIVE_SIZED = ("varchar", "nvarchar", "char", "nchar", "decimal", "time", "datetime2", "datetimeoffset", "binary", "varbinary")
PROVIDERS = {"sqlserver": "sqlserver", "mysql": "mysql", "postgresql": "postgres", "postgres": "postgres"}
_BLOCK = re.compile(r"^[ \t]*(?P<kind>model|enum|datasource|generator|type|view)[ \t]+(?P<name>\w+)[ \t]*\{(?P<body>.*?)^[ \t]*\}[ \t]*$", re.M | re.S)
_FIELD = re.compile(r"""^(?P<name>\w+)\s+(?P<type>Unsupported\("[^"]*"\)\??(?:\[\])?|[\w.]+(?:\[\])?\??)(?P<attrs>.*)$""")
_GENERATED = re.compile(r"^(autoincrement|cuid|uuid|dbgenerated|now)\s*\(", re.I)


def native_type(name: str, args: str | None) -> str:
    """S8e: type string of ``@db.Name(args)``; an unknown name is kept."""
    low = name.lower()
    if low not in NATIVE_TYPES:
        return name
    base = NATIVE_SPELLINGS.get(low, low)
    return f"{base}({args})" if args is not None and low in NATIVE_SIZED else base


def attribute(attrs: str, name: str) -> str | None:
    """Arguments of ``@name(...)`` (balanced), an empty string for a bare ``@name``, None without."""
    m = re.search(rf"(?<!@)@{re.escape(name)}(?![\w.])", attrs)
    if not m:
        return None
    at, depth = m.end(), 0
    if at >= len(attrs) or attrs[at] != "(":
        return ""
    for i in range(at, len(attrs)):
        depth += (attrs[i] == "(") - (attrs[i] == ")")
        if not depth:
            return attrs[at + 1 : i]
    return None


def listed(text: str, name: str | None = None) -> list[str]:
    """Members of a bracket list, of the one called ``name`` if given."""
    m = re.search(rf"{name}\s*:\s*\[([^\]]*)\]" if name else r"\[([^\]]*)\]", text, re.I)
    return [p.strip() for p in m[1].split(",") if p.strip()] if m else []


def default_of(attrs: str) -> str | None:
    """S8d: no value for generating functions, text without quotes, else what follows the first dot."""
    inner = attribute(attrs, "default")
    if not inner or _GENERATED.match(inner):
        return None
    if len(inner) >= 2 and inner[0] == inner[-1] == '"':
        return inner[1:-1]
    return inner.partition(".")[2] if "." in inner else inner


def _quoted(text: str) -> str | None:
    m = re.search(r'"([^"]*)"', text)
    return m[1] if m else None


def _qualified(name: str, prefix: str | None) -> str:
    return f"{prefix}.{name}" if prefix else name


def _model(body: str, name: str, known: dict, out: ParsedModel) -> dict:
    fields, pk, fks, indexes, uniques, prefix = [], [], [], [], [], known["prefix"]
    for line in map(str.strip, body.split("\n")):
        if not line or line.startswith("//"):
            continue
        if block := re.match(r"@@(id|unique|index)\(", line):
            columns = listed(line)
            if block[1] == "id":
                pk += [c for c in columns if c not in pk]
            elif columns and block[1] == "unique":
                uniques.append({"name": "uq_" + "_".join(columns).lower(), "columns": columns})
            elif columns:
                named = re.search(r'name\s*:\s*"([^"]+)"', line)
                indexes.append({"name": named[1] if named else "idx_" + "_".join(columns).lower(), "columns": columns})
            continue
        m = _FIELD.match(line)
        if line.startswith("@@") or not m:
            continue
        field, kind, attrs = m["name"], m["type"], re.sub(r"\s//.*$", "", m["attrs"])
        optional, many = kind.endswith("?"), "[]" in kind
        base = kind.replace("[]", "").rstrip("?")
        if many or base in known["models"]:
            relation = None if many else attribute(attrs, "relation")
            own, refs = (listed(relation, "fields"), listed(relation, "references")) if relation else ([], [])
            if len(own) == 1 and refs:  # keys of several columns have no place in the model
                cascade = re.search(r"onDelete\s*:\s*Cascade\b", relation, re.I) is not None
                fks.append({"source_field": own[0], "target_table": _qualified(known["models"][base], prefix), "target_field": refs[0], "cascade_delete": cascade, "kind": known["kind"]})
            continue
        is_id = attribute(attrs, "id") is not None
        if is_id and field not in pk:
            pk.append(field)
        if attribute(attrs, "unique") is not None:
            uniques.append({"name": f"uq_{field.lower()}", "columns": [field]})
        native = re.search(r"@db\.(\w+)(?:\(([^)]*)\))?", attrs, re.I)
        if native:
            sql = native_type(native[1], native[2])
        elif base.lower().startswith("unsupported("):
            sql = _quoted(base) or base
        elif base in known["enums"]:
            sql = scalar_type("String", known["dialect"])
        elif not (sql := scalar_type(base, known["dialect"])):
            out.errors.append(f"Unknown Prisma type '{base}' on field '{field}' — used as-is.")
            sql = base
        fields.append({"name": field, "type": sql, "nullable": optional and not is_id, "default": default_of(attrs), "is_primary_key": is_id})
    return table_document(name=_qualified(known["models"][name], prefix), fields=fields, primary_key=pk, foreign_keys=fks, indexes=indexes, unique_constraints=uniques)


def parse_prisma(text: str, dialect: str | None = None, schema_prefix: str | None = None, include_enums: bool = False) -> ParsedModel:
    """Models as tables, enums as reference tables of one column; ``dialect`` overrides the datasource's."""
    blocks = list(_BLOCK.finditer(text.replace("\r\n", "\n")))
    source = next((b["body"] for b in blocks if b["kind"] == "datasource"), "")
    setting = lambda k: (m[1] if (m := re.search(rf'^\s*{k}\s*=\s*"([^"]*)"', source, re.M | re.I)) else None)
    found = dialect or PROVIDERS.get((setting("provider") or "").lower(), "sqlserver")
    mode = setting("relationMode")
    named = lambda b: m[1] if (m := re.search(r'^\s*@@map\([^"\n]*"([^"]*)"', b["body"], re.M)) else b["name"]
    known = {
        "models": {b["name"]: named(b) for b in blocks if b["kind"] == "model"}, "enums": {b["name"] for b in blocks if b["kind"] == "enum"},
        "dialect": found, "prefix": schema_prefix, "kind": "physical" if mode is None or mode.lower() == "foreignkeys" else "logical",
    }
    out = ParsedModel()
    for b in blocks:
        if b["kind"] == "model":
            out.tables.append(_model(b["body"], b["name"], known, out))
        elif b["kind"] == "enum" and include_enums:
            value = {"name": "Value", "type": scalar_type("String", found), "nullable": False}
            out.enums.append(table_document(name=_qualified(b["name"], schema_prefix), fields=[value], is_reference_table=True))
    return out
