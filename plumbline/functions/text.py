"""Scalar expressions over names, types and cells, all built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_list(text: Column) -> Column:
    """parts of a comma list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def schema_prefix(name: Column) -> Column:
    """What stands before the first dot; the whole name without one."""
    return F.substring_index(name, ".", 1)


def glob_regex(glob: str) -> str:
    """P5: a pattern that matches a whole name; ``*`` is any run, all else literal, case ignored."""
    quoted = "".join(".*" if c == "*" else "\\" + c if c in r"\.[]{}()+-^$|?" else c for c in glob)
    return f"(?is)^{quoted}$"


def markdown_anchor(heading: Column) -> Column:
    """F8: lower case; space, dot, underscore and slash become a hyphen."""
    return F.translate(F.lower(heading), " ._/", "----")


def markdown_cell(text: Column) -> Column:
    """line breaks become ``<br/>``, save before an indented bullet."""
    plain = F.regexp_replace(text, "\r\n?", "\n")
    return F.regexp_replace(plain, r"\n(?![^\S\n]+-)", "<br/>")


def mermaid_name(name: Column) -> Column:
    """quoted entity name, spaces as underscores."""
    return F.concat(F.lit('"'), F.replace(name, F.lit(" "), F.lit("_")), F.lit('"'))


def mermaid_stub(section: Column, name: Column) -> Column:
    """quoted name of a table of another section."""
    return F.concat(F.lit('"['), section, F.lit("] "), F.replace(name, F.lit(" "), F.lit("_")), F.lit('"'))


def type_base(sql_type: Column) -> Column:
    """a type without length and precision, in lower case."""
    return F.lower(F.substring_index(sql_type, "(", 1))


def iso_timestamp(ts: Column) -> Column:
    """F16: ISO-8601 with seven fractional digits."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0"))


def key_display(pairs: list[tuple[str, Column]]) -> Column:
    """``k=v, k=v`` of a key's columns."""
    return F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit("null"))) for k, v in pairs])


def dbml_identifier(name: Column) -> Column:
    """bare where it has only letters, digits, underscores and dots, else quoted."""
    return F.when(name.rlike(r"^[\p{L}\p{Nd}_.]*$"), name).otherwise(F.concat(F.lit('"'), F.regexp_replace(name, r'(["\\])', r"\\$1"), F.lit('"')))


def dbml_string(text: Column) -> Column:
    """double-quoted on one line, quotes and backslashes escaped."""
    flat = F.translate(F.replace(text, F.lit("\r"), F.lit("")), "\n", " ")
    return F.concat(F.lit('"'), F.regexp_replace(flat, r'(["\\])', r"\\$1"), F.lit('"'))


#: Badges of the sensitivity levels.
BADGES = {"pii": "🔴 PII", "confidential": "🟡 Confidential", "internal": "🔵 Internal", "public": "🟢 Public"}


def sensitivity_badge(value: Column) -> Column:
    """the badge of a level, case ignored; empty for any other value."""
    pairs = [F.lit(x) for pair in BADGES.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(value)), F.lit(""))


def ordered(*columns: str | Column):
    """A window over all rows in an order, for tables of a few rows."""
    from pyspark.sql import Window

    return Window.orderBy(*columns)
