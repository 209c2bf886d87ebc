"""The command surface as functions: init, drift, merge, document, validate.

Each returns what a command line would print or write, and an exit code: 0, 1 for
drift, orphans or errors, 2 for a broken document, 4 for a setting.  Files are written
only here.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import plumbline
from plumbline.model import Registry
from plumbline.operators import capture, filters, merge, validate
from plumbline.sinks import render, writers
from plumbline.sources import catalog as live_catalog
from plumbline.sources.dbml import ParsedModel, parse_dbml
from plumbline.sources.prisma import parse_prisma
from plumbline.sources.registry import ConfigError, SchemaError, data_row, load_tables

log = logging.getLogger(__name__)


@dataclass
class Outcome:
    """Text of a report or document, files written, and the exit code."""

    text: str = ""
    code: int = 0
    files: Sequence[str] = ()


def exit_code(error: Exception) -> int:
    """Code of an exception: 2 for documents, 3 for releases, 4 for settings, 5 for anything else."""
    return 2 if isinstance(error, SchemaError) else 3 if isinstance(error, ReleaseError) else 4 if isinstance(error, ConfigError) else 5


class ReleaseError(ValueError):
    """A release that isn't what it should be (exit code 3)."""


def guarded(command: Callable[..., Outcome], *args, **options) -> Outcome:
    """A command at the boundary: an exception becomes its message and exit code, logged once."""
    try:
        return command(*args, **options)
    except Exception as e:  # noqa: BLE001  whatever it is, it has a code
        log.error("%s", e)
        return Outcome(str(e), exit_code(e))


def version() -> Outcome:
    return Outcome(f"{plumbline.__name__} {plumbline.__version__}")


def live_of(spark: SparkSession, connection: str | None = None, folder: str | None = None, provider: str | None = None, schemas: str | None = None, **options: str) -> Registry:
    """The live side of a command, from a JDBC connection or a folder of documents, exactly one of them."""
    connect = (lambda: live_catalog.introspect(live_catalog.jdbc_catalog(spark, connection, provider, **options), provider, schemas)) if connection else None
    return live_catalog.live_snapshot(connect, (lambda: Registry.of(spark, load_tables(spark, folder))) if folder else None)


def _only(registry: Registry, schemas: str | None) -> Registry:
    return Registry(filters.schema_filter(registry.documents, schemas), registry.sections, registry.endpoints) if schemas else registry


def init_model(spark: SparkSession, model: ParsedModel, folder: str, sections_folder: str | None = None, overwrite: bool = False) -> Outcome:
    """Registry files of a parsed model; existing files stay unless ``overwrite``."""
    tables = [*model.tables, *model.enums]
    path_of = lambda d: f"{folder}/{writers.safe_file_name(d['name'])}"
    wanted = [t for t in tables if overwrite or not Path(path_of(t)).exists()]
    files = writers.write_registry(Registry.of(spark, wanted), folder, path_of) if wanted else []
    for s in model.sections if sections_folder else ():
        writers.write_text(f"{sections_folder}/{writers.safe_file_name(s['name'])}", writers.section_json(s))
    return Outcome("\n".join(model.errors), 1 if model.errors else 0, files)


def init_dbml(spark: SparkSession, text: str, folder: str, schema: str | None = None, **options) -> Outcome:
    return init_model(spark, parse_dbml(text, schema), folder, **options)


def init_prisma(spark: SparkSession, text: str, folder: str, provider: str | None = None, schema: str | None = None, import_enums: bool = False, **options) -> Outcome:
    return init_model(spark, parse_prisma(text, provider, schema, import_enums), folder, **options)


def _with_rows(registry: Registry, rows: dict[str, DataFrame], explicit: Sequence[str], globs: Sequence[str]) -> Registry:
    """A registry with the captured rows of its reference tables."""
    docs, data = writers.documents_of(registry), {}
    keys = {d["name"]: d["primary_key"] for d in docs}
    for r in capture.enrich(rows, {n: keys.get(n, ()) for n in rows}, explicit, globs).orderBy("name", "row_index").collect():
        data.setdefault(r["name"].lower(), []).append(data_row(r["json"]))
    docs = [d | ({"data": data[d["name"].lower()], "is_reference_table": True} if d["name"].lower() in data else {}) for d in docs]
    return Registry(Registry.of(registry.documents.sparkSession, docs).documents, registry.sections, registry.endpoints)


def init_live(live: Registry, folder: str, schemas: str | None = None, sections_folder: str | None = None, rows: dict[str, DataFrame] | None = None, explicit: Sequence[str] = (), globs: Sequence[str] = ("*",)) -> Outcome:
    """Registry files of a live snapshot, and the section of all tables (a file in ``sections_folder`` if given).

    With ``rows`` (table name -> its rows) the small tables among them are captured as
    reference tables; one that can't be read is left as it is.
    """
    own = _only(live, schemas)
    if rows:
        own = _with_rows(own, rows, explicit, globs)
    section = writers.section_json(writers.all_tables_section(own))
    if sections_folder:
        writers.write_text(f"{sections_folder}/{writers.safe_file_name('All Tables')}", section)
    return Outcome(section, 0, writers.write_registry(own, folder, lambda d: f"{folder}/{writers.safe_file_name(d['name'])}"))


def drift(repo: Registry, live: Registry, schemas: str | None = None, strict: bool = False, output: str | None = None, **options) -> Outcome:
    """The drift report; 1 for drift, and with ``strict`` for warnings too."""
    text, found = render.drift_report(_only(repo, schemas), _only(live, schemas), **options)
    if output:
        writers.write_text(output, text)
    return Outcome(text, int(found or strict and "Warnings only" in text))


def merge_into(repo: Registry, live: Registry, folder: str, schemas: str | None = None, remove_columns: bool = False, remove_tables: bool = False, skip_new: bool = False, dry_run: bool = False, report: str | None = None) -> Outcome:
    """Merged documents written over the repo's; new tables go to ``folder``, the report to the file ``report`` if given.

    The text names the documents that lie outside of ``folder`` (P12).
    """
    if remove_tables and not remove_columns:
        raise ConfigError("removing tables needs removing columns too")
    repo, live = _only(repo, schemas), _only(live, schemas)
    outcome = {r["table_key"]: r["outcome"] for r in merge.merge_session(repo, live, remove_columns).collect()}
    lost = [d["source_file"] for d in writers.documents_of(repo) if outcome.get(d["name"].lower()) == "orphan"]
    deleted = writers.delete_removed(lost, remove_tables, remove_columns, dry_run)
    text, orphans = render.merge_report(repo, live, remove_columns, dry_run, deleted=deleted)
    whole = merge.merged_registry(repo, live, remove_columns)
    wanted = {k for k, v in outcome.items() if v == "modified" or v == "new" and not skip_new}
    changed = whole.documents.filter(_named(wanted))
    path_of = lambda d: d["source_file"] or f"{folder}/{writers.safe_file_name(d['name'])}"
    if strays := [r["source_file"] for r in filters.outside_folder(changed.filter("source_file <> ''"), folder).select("source_file").orderBy("source_file").collect()]:
        text += "\nOutside of " + folder + ": " + ", ".join(strays) + "\n"
    if report:
        writers.write_text(report, text, dry_run)
    return Outcome(text, int(orphans), writers.write_registry(Registry(changed), folder, path_of, dry_run))


def _named(keys: set[str]):
    from pyspark.sql import functions as F

    return F.lower("name").isin(sorted(keys))


def document(registry: Registry, kind: str = "markdown", output: str | None = None, **options) -> Outcome:
    text = render.document_database(registry, kind, **options)
    if output:
        writers.write_text(output, text)
    return Outcome(text)


def schema(kind: str, output: str | None = None) -> Outcome:
    """JSON Schema of a document kind: table, section, api or config."""
    text = writers.formatted(writers.json_schema(kind)) + "\n"
    if output:
        writers.write_text(output, text)
    return Outcome(text)


def check(registry: Registry, cross: bool = False, strict: bool = False, output: str | None = None) -> Outcome:
    """The validation report; 1 for errors, and with ``strict`` for warnings."""
    issues: DataFrame = validate.validate_cross(registry) if cross else validate.validate_tables(registry)
    apis = registry.endpoints.select("api").distinct().count() if registry.endpoints is not None else 0
    text = writers.validation_report(issues, registry.documents.count(), registry.sections.count() if registry.sections is not None else 0, apis)
    if output:
        writers.write_text(output, text)
    return Outcome(text, int('"hasErrors": true' in text or strict and '"hasWarnings": true' in text))
