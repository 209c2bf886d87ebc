"""DBML documents (S7): tables, references and groups, with errors collected.

The text is cut into tokens once; a small recursive reader takes blocks from them, so
nested blocks (indexes and the like) are passed over whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.model import table_document

_TOKEN = re.compile(r"""(?P<comment>//[^\n]*)|(?P<string>'''.*?'''|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`[^`\n]*`)|(?P<mark>[{}\n])|(?P<space>[ \t\r]+)|(?P<word>(?:(?!//)[^\s{}"'`])+)""", re.S)
_NOTE = re.compile(r"^(?P<text>.*?)[; \t]*//\s*calculated:\s*(?P<expr>.*?)(?P<kept>\s+PERSISTED)?\s*$", re.I | re.S)
_END = r'(?:"(?:\\.|[^"\\])*"|[^\s."<>-]+)'
_REF = re.compile(rf"^(?P<left>{_END}(?:\.{_END})*)\s+(?P<op><>|<|>|-)\s+(?P<right>{_END}(?:\.{_END})*)$")


@dataclass
class ParsedModel:
    """What a schema text holds: table and section documents, and what could not be read."""

    tables: list[dict] = field(default_factory=list)
    sections: list[dict] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    enums: list[dict] = field(default_factory=list)


def unquoted(text: str) -> str:
    """A quoted string without its quotes and escapes; other text as it is."""
    for q in ("'''", "'", '"', "`"):
        if len(text) >= 2 * len(q) and text.startswith(q) and text.endswith(q):
            inner = text[len(q) : -len(q)]
            return inner if q == "'''" else re.sub(r"\\(.)", r"\1", inner)
    return text


def note_parts(note: str) -> dict:
    """Description, and the calculation that a note may end with."""
    m = _NOTE.match(note)
    if not m:
        return {"description": note}
    expr = m["expr"].strip()
    expr = expr[1:-1] if expr.startswith("(") and expr.endswith(")") else expr
    return {"description": m["text"], "is_computed": True, "computed_expression": expr, "is_persisted": bool(m["kept"])}


def _statements(text: str) -> Iterator[tuple[str, str, list]]:
    """(line, comment, lines of its block) at the top level; blocks nest."""
    stack: list[tuple[str, str, list]] = []
    out: list[tuple[str, str, list]] = []
    line, comment = [], ""

    def end() -> None:
        nonlocal line, comment
        if (joined := "".join(line).strip()) or comment:
            (stack[-1][2] if stack else out).append((joined, comment, []))
        line, comment = [], ""

    depth = 0
    for m in _TOKEN.finditer(text.replace("\r\n", "\n")):
        kind, value = m.lastgroup, m.group()
        if kind == "comment":
            comment = value[2:].strip()
        elif value == "\n":
            if depth:
                line.append(" ")
            else:
                end()
        elif value == "{":
            stack.append(("".join(line).strip(), comment, []))
            line, comment = [], ""
        elif value == "}":
            end()
            if stack:
                block = stack.pop()
                (stack[-1][2] if stack else out).append((block[0], "{", block[2]))
        else:
            line.append(value)
            if kind == "word":
                depth = max(0, depth + value.count("[") - value.count("]"))
    end()
    return iter(out)


def _split(text: str, at: str) -> list[str]:
    """Parts between ``at`` outside of quotes and brackets."""
    parts = re.findall(rf"""(?:"(?:\\.|[^"\\])*"|'''.*?'''|'(?:\\.|[^'\\])*'|\([^)]*\)|[^{at}])+""", text, re.S)
    return [p.strip() for p in parts if p.strip()]


def _column(line: str) -> dict | None:
    m = re.match(r"""^(?P<name>"(?:\\.|[^"\\])*"|\S+)\s+(?P<type>[^\[]*?)\s*(?:\[(?P<rest>.*?)\]?)?$""", line, re.S)
    if not m or not m["type"]:
        return None
    out: dict = {"name": unquoted(m["name"]), "type": m["type"], "nullable": True}
    for c in _split(m["rest"] or "", ","):
        low = c.lower()
        if low in ("pk", "primary key"):
            out |= {"is_primary_key": True, "nullable": False}
        elif low in ("not null", "null"):
            out["nullable"] = low == "null"
        elif low.startswith("note:"):
            out |= note_parts(unquoted(c[5:].strip()))
    return out


def _qualified(name: str, prefix: str | None) -> str:
    return f"{prefix}.{name}" if prefix and "." not in name else name


def _endpoint(text: str) -> tuple[str, str] | None:
    """(table, field) of a dotted name: the field is what follows the last dot outside of quotes."""
    parts = re.findall(_END, text)
    if len(parts) < 2:
        return None
    return ".".join(map(unquoted, parts[:-1])), unquoted(parts[-1])


def _reference(body: str, comment: str, prefix: str | None) -> tuple[str, dict] | None:
    m = _REF.match(body)
    if not m or m["op"] == "<>":
        return None
    left, right = _endpoint(m["left"]), _endpoint(m["right"])
    if not left or not right:
        return None
    source, target = (right, left) if m["op"] == "<" else (left, right)
    kind = comment.lower() if comment.lower() in ("logical", "virtual") else "physical"
    fk = {"source_field": source[1], "target_table": _qualified(target[0], prefix), "target_field": target[1], "kind": kind}
    return _qualified(source[0], prefix), fk


def parse_dbml(text: str, schema_prefix: str | None = None) -> ParsedModel:
    """Tables with their references, groups as sections (their members are not prefixed)."""
    out, refs = ParsedModel(), []
    for head, comment, lines in _statements(text):
        word, _, rest = head.partition(" ")
        is_block = comment == "{"
        if is_block and word.lower() == "table":
            name = _block_name(rest)
            if not name:
                out.errors.append(f"Could not parse table name: {head}")
                continue
            note, fields = "", []
            for line, inner, _ in lines:
                if inner == "{" or not line:
                    continue
                if line.lower().startswith("note:"):
                    note = unquoted(line[5:].strip())
                elif not line.startswith("[") and (column := _column(line)):
                    fields.append(column)
            keys = [f["name"] for f in fields if f.get("is_primary_key")]
            out.tables.append(table_document(name=_qualified(name, schema_prefix), description=note, fields=fields, primary_key=keys))
        elif is_block and word.lower() == "tablegroup":
            out.sections.append({"name": _block_name(rest) or "Unnamed", "tables": [unquoted(line) for line, _, _ in lines if line], "erds": []})
        elif not is_block and re.match(r"ref\b", head, re.I):
            found = _reference(head.partition(":")[2].strip(), comment, schema_prefix)
            if found:
                refs.append(found)
            else:
                out.errors.append(f"Could not parse Ref: {head}")
    by_name = {t["name"].lower(): t for t in out.tables}
    for source, fk in refs:
        if source.lower() in by_name:
            by_name[source.lower()]["foreign_keys"] = [*by_name[source.lower()]["foreign_keys"], {"cascade_delete": False} | fk]
        else:
            out.errors.append(f"Ref refers to unknown table '{source}'")
    return out


def _block_name(rest: str) -> str:
    m = re.match(r"""\s*("(?:\\.|[^"\\])*"|[^\s\[]+)""", rest)
    return unquoted(m[1]) if m else ""


def parsed_files(texts: DataFrame, parse=parse_dbml) -> DataFrame:
    """Many schema texts (path, value) at once: (path, tables as JSON, errors), parsed on the executors."""
    import json

    import pandas as pd

    def run(batches):
        for pdf in batches:
            found = [parse(v) for v in pdf["value"]]
            yield pd.DataFrame({"path": pdf["path"], "tables": [json.dumps(p.tables) for p in found], "errors": [list(p.errors) for p in found]})

    return texts.select("path", F.col("value")).mapInPandas(run, "path string, tables string, errors array<string>")
