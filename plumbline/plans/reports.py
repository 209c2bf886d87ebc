"""Queries over reports: their lines, and what they say, held against SQL.

Imported after ``catalog``, whose SQL some of these build on.
"""

from __future__ import annotations

import contextlib
import itertools
import json
import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans import declared as D
from plumbline.plans.register import ORACLES, live, query, repo, rules


def _lines(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "n int, line string")


def _blocks(text: str) -> list[tuple[str, str, list[str]]]:
    """(second-level heading, third-level heading or nothing, lines below) of a Markdown text."""
    out = [("", "", [])]
    for line in text.split("\n"):
        if m := re.match(r"(##|###) (.*)", line):
            out.append((m[2], "", []) if m[1] == "##" else (out[-1][0], m[2], []))
        else:
            out[-1][2].append(line)
    return out


def _cells(lines: list[str]) -> int:
    """Rows of Markdown tables, without their headings and rules."""
    rows = [i for i, line in enumerate(lines) if line.startswith("|")]
    rules_ = [i for i in rows if re.fullmatch(r"\|(-+\|)+", lines[i])]
    return len(rows) - 2 * len(rules_)


_MD_COLUMNS = """columns_ AS (SELECT %(p)sf.table_name, 'Field,Type,Nullable' || CASE WHEN bool_or(dflt <> '') THEN ',Default' ELSE '' END || CASE WHEN bool_or(is_computed) THEN ',Expression' ELSE '' END || CASE WHEN bool_or(sensitivity IS NOT NULL) THEN ',Sensitivity' ELSE '' END || ',Description' AS columns,
  count(*) AS n_fields, count(*) FILTER (WHERE is_computed) AS n_computed, count(*) FILTER (WHERE is_deprecated) AS n_deprecated FROM %(p)sfields %(p)sf GROUP BY 1)"""
_MD_ROWS = "coalesce(c.columns, '') AS columns, coalesce(c.n_fields, 0) AS n_fields, coalesce(n_computed, 0) AS n_computed, coalesce(n_deprecated, 0) AS n_deprecated"


@query(f"""WITH {D.ctes('', D.rule_documents(), 'tables', 'fields')}, {D.ctes('r_', D.repo_documents(), 'tables', 'fields')}, {_MD_COLUMNS % {'p': ''}}, {(_MD_COLUMNS % {'p': 'r_'}).replace('columns_', 'r_columns_')},
{D.cte('members', 'section VARCHAR, table_name VARCHAR', [(s.get('title') or s['name'], t) for s in D.SECTIONS for t in s['tables']])}
SELECT m.section, coalesce(t.name, m.table_name) AS table_name, {_MD_ROWS} FROM members m LEFT JOIN tables t ON lower(t.name) = lower(m.table_name) LEFT JOIN columns_ c ON c.table_name = t.name
UNION ALL SELECT 'All Tables', t.name, {_MD_ROWS} FROM r_tables t LEFT JOIN r_columns_ c ON c.table_name = t.name""")
def database_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections, tables and the columns of their field tables in the Markdown of two registries, read from its text."""
    from plumbline.sinks import render

    rows = []
    for text in (render.document_database(rules(spark), section_order=D.SECTION_ORDER), render.document_database(repo(spark))):
        for section, table, lines in _blocks(text):
            if table:
                first = next((i for i, line in enumerate(lines) if line.startswith("| Field |")), len(lines))
                fields = list(itertools.takewhile(lambda line: line.startswith("|"), lines[first + 2 :]))
                columns = ",".join(c.strip() for c in lines[first].strip("|").split("|")) if first < len(lines) else ""
                rows.append((section, table, columns, len(fields), sum("`[C]`" in x for x in fields), sum(x.startswith("| ~~") for x in fields)))
    return spark.createDataFrame(rows, "section string, table_name string, columns string, n_fields long, n_computed long, n_deprecated long")


@query(f"SELECT severity, code, field FROM ({ORACLES['validate_tables']}) UNION ALL SELECT 'summary', 'errors', CAST(count(*) FILTER (WHERE severity = 'Error') AS VARCHAR) FROM ({ORACLES['validate_tables']}) UNION ALL SELECT 'summary', 'tables', CAST({len(D.rule_documents())} AS VARCHAR)")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: issues and counts of the JSON report of a validation, read from its text."""
    from plumbline.plans.commands import check

    report = json.loads(check(rules(spark)).text)
    rows = [(x["severity"], x["code"], x["field"]) for x in report["issues"]] + [("summary", "errors", str(report["summary"]["errors"])), ("summary", "tables", str(report["summary"]["tablesScanned"]))]
    return spark.createDataFrame(rows, "severity string, code string, field string")


_STEPS = [("written", "one"), ("dry run over it", "one"), ("written over it", "two"), ("failed write", "two"), ("files beside it", "0"), ("removal without both flags", "two"), ("removal in a dry run", "two"), ("removal", "")]


@query(f"WITH {D.cte('x', 'step VARCHAR, content VARCHAR', _STEPS)} SELECT * FROM x")
def atomic_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a file holds after each kind of write and removal (files of commands are the driver's own)."""
    from plumbline.sinks.writers import delete_removed, write_text

    rows = []
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder, "a/b.txt")
        content = lambda: path.read_text() if path.exists() else ""
        write_text(path, "one")
        rows.append(("written", content()))
        write_text(path, "no", dry_run=True)
        rows.append(("dry run over it", content()))
        write_text(path, "two")
        rows.append(("written over it", content()))
        with contextlib.suppress(UnicodeEncodeError):
            write_text(path, "broken \ud800")
        rows += [("failed write", content()), ("files beside it", str(len(list(path.parent.iterdir())) - 1))]
        for step, flags in (("removal without both flags", (True, False)), ("removal in a dry run", (True, True, True)), ("removal", (True, True))):
            delete_removed([str(path)], *flags)
            rows.append((step, content()))
    return spark.createDataFrame(rows, "step string, content string")


_VALUE = {"name": "a: b", "n": 1, "list": [1, "x", {"k": None, "deep": [True]}], "empty": [], "inner": {"t": "line\nbreak", "e": {}}}
_YAML = ['name: "a: b"', "n: 1", "list:", "  - 1", '  - "x"', "  -", "    k: null", "    deep:", "      - true", "empty: []", "inner:", '  t: "line\\nbreak"', "  e: {}"]


@query(f"WITH {D.cte('x', 'n INTEGER, line VARCHAR', list(enumerate(_YAML)))} SELECT * FROM x")
def yaml_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested value as YAML, by line."""
    from plumbline.sinks.writers import formatted

    return _lines(spark, formatted(_VALUE, "yaml").rstrip("\n"))


#: Members of the document kinds' schemas.
_SCHEMAS = {
    "table": ["name", "description", "descriptionAutoGenerated", "shortDescription", "isDeprecated", "deprecationMessage", "fields", "primaryKey", "foreignKeys", "databaseTypes", "sets", "sections", "isReferenceTable", "labelField", "data", "indexes", "checkConstraints", "uniqueConstraints"],
    "section": ["name", "title", "description", "tables", "isModule", "erds"],
    "api": ["name", "title", "version", "endpoints"],
    "config": ["paths", "output", "referenceTables"],
}
_REQUIRED = {"table": ["name"], "section": ["name", "tables"], "api": ["name", "title", "version"], "config": []}
_MEMBERS = [(k, m, m in _REQUIRED[k]) for k, v in _SCHEMAS.items() for m in v]


@query(f"WITH {D.cte('x', 'kind VARCHAR, member VARCHAR, required BOOLEAN', _MEMBERS)} SELECT * FROM x")
def json_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each document kind's JSON Schema, and which must be there."""
    from plumbline.plans.commands import schema

    found = {k: json.loads(schema(k).text) for k in _SCHEMAS}
    return spark.createDataFrame([(k, m, m in d.get("required", [])) for k, d in found.items() for m in d["properties"]], "kind string, member string, required boolean")


@query(f"SELECT table_key, n_field + n_primary_key + n_foreign_key + n_index + n_row AS n_changes, n_extra_column AS n_extra FROM ({ORACLES['drift_counts']}) WHERE has_drift")
def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2/K7: changes that the drift report lists for each drifted table, read from its text."""
    from plumbline.sinks import render

    text = render.drift_report(repo(spark), live(spark))[0]
    rows = [(table.lower(), _cells(lines), sum(line.startswith("- ") for line in lines)) for part, table, lines in _blocks(text) if part == "Drifted Tables" and table]
    return spark.createDataFrame(rows, "table_key string, n_changes long, n_extra long")


@query(f"SELECT outcome, table_key FROM ({ORACLES['merge_session']}) UNION ALL SELECT 'orphan data key', table_key || '.' || data_key FROM ({ORACLES['orphaned_data_keys']}) WHERE table_key IN (SELECT table_key FROM ({ORACLES['merge_session']}) WHERE outcome <> 'orphan')")
def merge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the merge report says of each table, read from its text."""
    from plumbline.sinks import render

    text = render.merge_report(repo(spark), live(spark))[0]
    rows = []
    for part, table, lines in _blocks(text):
        listed = [re.sub(r"[`*]|tables/|\.json", "", line[2:].partition(" (")[0]).lower() for line in lines if line.startswith("- ")]
        cells = [[c.strip(" `") for c in line.strip("|").split("|")] for line in lines if line.startswith("| ")][1:]
        if part == "Modified Tables" and table:
            rows.append(("modified", table.lower()))
        rows += [({"New Tables": "new", "Unchanged Tables": "unchanged", "Orphan Tables": "orphan"}[part], t) for t in listed if part in ("New Tables", "Unchanged Tables", "Orphan Tables")]
        rows += [("orphan data key", f"{c[0].lower()}.{c[1]}") for c in cells if part == "Orphaned Data Keys"]
    return spark.createDataFrame(rows, "outcome string, table_key string")
