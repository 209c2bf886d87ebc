"""Line deduplication by site-relative frequency.

For each site, the share of its pages that contain a line is compared with a
boilerplate ratio; lines above it are dropped from that site's pages.

Two passes over the pages.  The first counts (site, line hash) with map-side
partial sums; only hashes cross the shuffle.  What it finds is small: a site has
at most (mean distinct lines of a page / ratio) such lines.  The second pass
joins pages to their site's list.  The list is broadcast while it has at most
``BROADCAST_LINES`` lines over all sites; beyond that both sides are dealt by
(site, salt), so that a site with a third of all pages is spread over ``SALTS``
tasks.  The text of a page is moved only in that second case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import checkpointed, fresh

#: A line on more than this share of a site's pages is boilerplate, if on this many pages at least.
BOILERPLATE_RATIO, LEAST_PAGES = 0.05, 5
#: Lines of all sites that are broadcast (at most 40 bytes each), and the salt beyond that.
BROADCAST_LINES, SALTS = 200_000, 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """96 bits that stand for a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def boilerplate_lines(pages: DataFrame, site: str = "source", text: str = "text", ratio: float = BOILERPLATE_RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(site, a, b, pages, site_pages) of the lines above the ratio, by their hashes.

    Every row is a page.  Blank lines are never boilerplate; a line counts once a
    page.  Pages with a null site belong to no site and aren't counted; a null or
    empty text is a page without lines; an empty table gives no lines.
    """
    rows = pages.filter(F.col(site).isNotNull()).select(F.col(site).alias("site"), F.col(text).alias("text"))
    totals = rows.groupBy("site").agg(F.count("*").alias("site_pages"))
    distinct = rows.select("site", F.explode(F.array_distinct(_lines(F.col("text")))).alias("line")).filter(F.trim("line") != "")
    counts = distinct.select("site", F.xxhash64("line").alias("a"), F.hash("line").alias("b"))
    counts = counts.groupBy("site", "a", "b").agg(F.count("*").alias("pages")).filter(F.col("pages") >= least_pages)
    return counts.join(totals, "site").filter(F.col("pages") > F.lit(ratio) * F.col("site_pages"))


def drop_boilerplate(pages: DataFrame, site: str = "source", text: str = "text", ratio: float = BOILERPLATE_RATIO, least_pages: int = LEAST_PAGES, dropped: str | None = None, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """``pages`` with boilerplate lines taken out of ``text``; every row and column stays.

    The other lines keep their order and text.  A page of boilerplate only gets an
    empty text; a null text stays null; pages with a null site stay as they are.
    ``dropped`` names a column for the number of lines taken out of each page; a column
    of ``pages`` that has the name, in any case, is replaced.  Repeated rows are pages of
    their own; an empty table stays empty.
    """
    lines = checkpointed(boilerplate_lines(pages, site, text, ratio, least_pages))
    mine, their, salt, n = (fresh(pages, x) for x in ("_lines", "_site", "_salt", "_dropped"))
    lists = lines.groupBy(F.col("site").alias(their)).agg(F.collect_list(F.struct("a", "b")).alias(mine))
    if lines.count() <= broadcast_lines:
        found = pages.join(F.broadcast(lists), pages[f"`{site}`"] == F.col(their), "left")
    else:
        salted = pages.withColumn(salt, F.pmod(F.xxhash64(f"`{text}`"), F.lit(SALTS)))
        spread = lists.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))).withColumnRenamed(salt, f"{salt}2")
        found = salted.join(spread, (salted[f"`{site}`"] == F.col(their)) & (F.col(salt) == F.col(f"{salt}2")), "left").drop(salt, f"{salt}2")
    own = F.col(f"`{text}`")
    all_lines = _lines(own)
    kept = F.filter(all_lines, lambda x: ~F.array_contains(F.col(mine), _key(x)))
    clean = F.when(F.col(mine).isNull() | own.isNull(), own).otherwise(F.array_join(kept, "\n"))
    count = F.when(F.col(mine).isNull() | own.isNull(), 0).otherwise(F.size(all_lines) - F.size(kept)).cast("long")
    out = found.select(*[clean.alias(c) if c == text else F.col(f"`{c}`") for c in pages.columns if not dropped or c.lower() != dropped.lower()], *([count.alias(n)] if dropped else []))
    return out.withColumnRenamed(n, dropped) if dropped else out


def dedup_documents(docs: DataFrame, ratio: float = BOILERPLATE_RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``drop_boilerplate`` over documents by source, with n_chars following the text.

    Documents carry no host, so their source is the site.  A null text keeps a null
    n_chars; all other cases are as in ``drop_boilerplate``.
    """
    out = drop_boilerplate(docs, "source", "text", ratio, least_pages)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
