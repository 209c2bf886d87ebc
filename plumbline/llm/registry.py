"""Queries over the training-data operators, one for each, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import licenses
from plumbline.llm.common import A_TO_Z, table


#: Dated list entries for the pages: (list, key, action, day).
URL_ENTRIES = (
    ("spam", "spam-farm.example.com", "block", "2024-02-01"),
    ("spam", "spam-farm.example.com", "remove", "2024-08-01"),
    ("spam", "spam-farm.example.com", "block", "2024-10-15"),
    ("gambling", "free-bets.example.com", "block", "2024-01-15"),
    ("gambling", "example.com", "block", "2024-11-01"),
    ("gambling", "example.com", "remove", "2024-11-20"),
    ("partners", "spam-farm.example.com", "allow", "2024-06-01"),
    ("partners", "tionble.example.org", "allow", "2024-03-01"),
    ("adult", "example.org", "block", "2024-05-05"),
    ("adult", "example.org", "remove", "2024-05-25"),
    ("adult", "example.org", "block", "2024-12-01"),
    ("language", "blog.tionsh.example.com/fr", "block", "2024-04-01"),
    ("language", "blog.tionsh.example.com", "allow", "2024-01-01"),
    ("language", "blog.tionsh.example.com", "remove", "2024-07-01"),
)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page as of its fetch time.

    Pages carry no time, so page k counts as fetched k modulo 366 days and k modulo
    24 hours after the start of 2024.
    """
    from pyspark.sql import functions as F

    from plumbline.llm import url_filter

    entries = spark.createDataFrame(URL_ENTRIES, "list string, key string, action string, day string")
    seconds = F.expr("page_id % 366 * 86400 + page_id % 24 * 3600")
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    captures = table(spark, sf_dir, "pages").select("page_id", "url", at.alias("fetched_at"))
    return url_filter.verdicts(captures, entries)


OP1_SQL = f"""
WITH dated(list, key, action, day) AS (VALUES {", ".join(str(e) for e in URL_ENTRIES)}),
spans AS (
  SELECT list, key, action, CAST(day AS TIMESTAMP) AS since,
    lead(CAST(day AS TIMESTAMP)) OVER (PARTITION BY list, key ORDER BY day) AS until
  FROM dated
), captures AS (
  SELECT page_id, lower(url) AS url,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id % 366 * 86400 + page_id % 24 * 3600) AS fetched_at
  FROM pages
), parts AS (
  SELECT *, rtrim(regexp_replace(regexp_replace(regexp_extract(url, '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '.') AS host,
    regexp_extract(url, '^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) || '/' AS path
  FROM captures
), best AS (
  SELECT p.page_id, s.*, row_number() OVER (PARTITION BY p.page_id ORDER BY length(s.key) DESC, s.action = 'allow', s.list) AS k
  FROM parts p JOIN spans s ON s.action <> 'remove' AND fetched_at >= since AND (until IS NULL OR fetched_at < until)
    AND (host = s.key OR ends_with(host, '.' || s.key) OR contains(s.key, '/') AND starts_with(host || path, s.key || '/'))
)
SELECT p.page_id, p.host, p.fetched_at, coalesce(b.action, 'pass') AS verdict, b.list, b.key, b.since
FROM parts p LEFT JOIN best b ON p.page_id = b.page_id AND b.k = 1
"""


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of all documents."""
    from plumbline.llm import bpe

    return bpe.encode_digests(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in all documents."""
    return licenses.scan(table(spark, sf_dir, "documents"))


_TEMPLATES = ", ".join(f"({k}, '{t.label}', {t.words}, {t.needed}, {t.phrase}, {t.stride})" for k, t in enumerate(licenses.TEMPLATES))
OP3_SQL = rf"""
WITH templates(k, label, tw, needed, phrase, stride) AS (VALUES {_TEMPLATES}),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{A_TO_Z}', '{A_TO_Z.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), places AS (
  SELECT doc_id, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1 : i + len(tw)] = tw)) AS place
  FROM docs, templates WHERE phrase AND list_has_all(w, tw)
), blocks AS (
  SELECT doc_id, stride, list_distinct(w[b + 1 : b + 2 * stride]) AS block
  FROM (SELECT doc_id, w, stride, unnest(range(0, len(w), stride)) AS b FROM docs, (SELECT DISTINCT stride FROM templates))
), notices AS (
  SELECT doc_id, label, len(list_intersect(block, list_distinct(tw))) AS shared, needed, len(list_distinct(tw)) AS n
  FROM blocks JOIN templates USING (stride) WHERE NOT phrase
), hits AS (
  SELECT doc_id, label, place, CAST(1.0 AS DOUBLE) AS share FROM places
  UNION ALL SELECT doc_id, label, NULL, CAST(shared AS DOUBLE) / n FROM notices WHERE shared >= needed
), found AS (
  SELECT doc_id, count(place) AS n_base, min(place) AS first_word, max(place) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE place IS NOT NULL) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM hits GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM docs d LEFT JOIN found f ON d.doc_id = f.doc_id
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines on more than 5 % of their source's documents."""
    from plumbline.llm import line_dedup

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs, dropped="n_dropped")


OP4_SQL = """
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
), totals AS (
  SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source
), boilerplate AS (
  SELECT source, line FROM (SELECT DISTINCT doc_id, source, line FROM lines WHERE trim(line) <> '') JOIN totals USING (source)
  GROUP BY source, line, n HAVING count(*) >= 5 AND count(*) > CAST(0.05 AS DOUBLE) * n
)
SELECT doc_id, l.source, coalesce(string_agg(l.line, chr(10) ORDER BY pos) FILTER (WHERE b.line IS NULL), '') AS text,
  count(b.line) AS n_dropped
FROM lines l LEFT JOIN boilerplate b ON l.source = b.source AND l.line = b.line
GROUP BY doc_id, l.source
"""


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that each document holds."""
    from plumbline.llm import decontaminate

    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the audio columns of all documents."""
    from plumbline.llm import audio

    return audio.audio_digests(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned outside the held-out fold."""
    from plumbline.llm import language

    return language.identify(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, taught by the labels outside the held-out fold."""
    from plumbline.llm import toxicity

    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of all documents."""
    from plumbline.llm import token_counts

    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents."""
    from plumbline.llm import simhash

    return simhash.simhash_components(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_bpe": op2_bpe,
    "op3_licenses": op3_licenses,
    "op4_line_dedup": op4_line_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_audio": op6_audio,
    "op7_language": op7_language,
    "op8_toxicity": op8_toxicity,
    "op9_token_counts": op9_token_counts,
    "op10_simhash": op10_simhash,
}
ORACLES: dict[str, str] = {
    "op1_url_filter": OP1_SQL,
    "op3_licenses": OP3_SQL,
    "op4_line_dedup": OP4_SQL,
}
