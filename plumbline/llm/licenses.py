"""License scans by an exact set-similarity join, with DataFrame functions only.

Text blocks are windows of twice a stride of words that begin every stride, so that
whatever is at most a stride long lies in one of them.  A template's stride is the least
power of two (``LEAST_STRIDE`` at least) that its words fit in, so whole license texts
have blocks of their own.  A block meets a template if it holds the template's share of
distinct words:

* the template words are put in one global order, rarest in the corpus first;
* prefix filter: a template that needs c of its n words is found through its first
  n - c + 1, and a block with m template words through its first m - c + 1;
* length filter: m >= c; positional filter: what can still follow a shared word in
  both orders must make up c.

Pairs that pass are verified by an intersection.  A template that is a phrase (base
labels) is then looked for word by word in the block.

Texts are split into words twice: once to count the template words, which fixes their
order and gives each row's number of words, and once for the blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import A_TO_Z, checkpointed

LEAST_STRIDE = 32
#: Percent of a notice's distinct words that a block must hold.
PERCENT = 85
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A license notice, or a phrase that must stand word for word."""

    label: str
    text: str
    phrase: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def stride(self) -> int:
        return max(LEAST_STRIDE, 1 << (len(self.words) - 1).bit_length())

    @property
    def needed(self) -> int:
        """Distinct words that a block must share with it."""
        n = len(set(self.words))
        return n if self.phrase else -(-PERCENT * n // 100)


#: The base phrases and their labels.
PHRASES = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
)
#: Wording that licenses ask to be quoted, and common one-line notices.
NOTICES = (
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    Template("gpl-or-later", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("mit-notice", "released under the mit license"),
    Template("mit-permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
#: Whole license texts in lower case, without punctuation.
TEXTS = (
    Template(
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software"
        " without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit"
        " persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all"
        " copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the"
        " warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages"
        " or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    Template(
        "isc-text",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this"
        " permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied"
        " warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever"
        " resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or"
        " performance of this software",
    ),
)
TEMPLATES = PHRASES + NOTICES + TEXTS


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case.

    ``lower`` is much faster than ``translate`` and differs only in letters outside
    ASCII, which never matter to a template word, save for the two whose lower case
    has an ASCII letter.
    """
    odd = F.contains(text, F.lit("K")) | F.contains(text, F.lit("İ"))
    return F.when(odd, F.translate(text, A_TO_Z, A_TO_Z.lower())).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _SEPARATORS, -1), "")


def _literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _begins(stride: int) -> Column:
    """Where the blocks of a stride begin in ``_words``."""
    at = F.sequence(F.lit(0), F.size("_words") - 1, F.lit(stride))
    return F.transform(at, lambda i: F.struct(i.alias("begin"), F.lit(stride).alias("stride")))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places where a phrase stands, first_word and last_word are
    the least and greatest of their starts (null without any).  ``labels`` has
    the phrases', notices' and texts' labels, ``score`` the largest share of a
    template's words that a block meeting it holds, 0 without.  A null or empty
    text has no words; repeated rows each give a row; rows with a null id are
    scanned like others; other columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    vocabulary = sorted({w for t in templates for w in t.words})
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text)).alias("_hash"), F.length(F.col(text)).alias("_size"), words_of(F.col(text)).alias("_words"))

    facts = checkpointed(rows.select("_id", "_hash", "_size", F.size("_words").cast("long").alias("n_words"), F.array_intersect(_literals(vocabulary), F.col("_words")).alias("_seen")))
    counts = dict(facts.select(F.explode("_seen").alias("w")).groupBy("w").count().collect())  # one row a vocabulary word at most
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    sides = []
    for k, t in enumerate(templates):
        own = sorted(set(t.words), key=place.__getitem__)
        sides += [(k, w, at, own, t.needed, t.stride, t.words if t.phrase else None, t.label) for at, w in enumerate(own[: len(own) - t.needed + 1])]
    schema = "template int, word string, t_at int, t_own array<string>, needed int, t_stride int, phrase array<string>, label string"
    side = F.broadcast(spark.createDataFrame(sides, schema))  # one row a template prefix word
    least = min((t.needed for t in templates), default=1)

    rare = _literals(sorted({s[1] for s in sides}))
    marked = rows.filter(F.arrays_overlap("_words", rare))
    begins = [_begins(n) for n in sorted({t.stride for t in templates})]
    blocks = marked.select("_id", "_hash", "_size", "_words", F.explode(F.concat(*begins)).alias("at"))
    blocks = blocks.select("_id", "_hash", "_size", "at.begin", "at.stride", F.slice("_words", F.col("at.begin") + 1, 2 * F.col("at.stride")).alias("block"))
    blocks = blocks.filter(F.arrays_overlap("block", rare)).withColumn("own", F.array_intersect(_literals(order), F.col("block")))
    prefix = F.slice("own", 1, F.greatest(F.size("own") - least + 1, F.lit(0)))
    probes = blocks.select("*", F.posexplode(prefix).alias("b_at", "token"))
    pairs = probes.join(side, (F.col("token") == F.col("word")) & (F.col("stride") == F.col("t_stride")))
    m, n, c = F.size("own"), F.size("t_own"), F.col("needed")
    pairs = pairs.filter((m >= c) & (F.col("b_at") <= m - c) & (1 + F.least(m - F.col("b_at") - 1, n - F.col("t_at") - 1) >= c))
    pairs = pairs.withColumn("shared", F.size(F.array_intersect("own", "t_own"))).filter(F.col("shared") >= c)
    starts = F.filter(F.sequence(F.lit(0), F.col("stride") - 1), lambda i: F.slice("block", i + 1, F.size("phrase")) == F.col("phrase"))
    places = F.when(F.col("phrase").isNotNull(), F.transform(starts, lambda i: F.col("begin") + i)).otherwise(F.array(F.lit(None).cast("int")))
    hits = pairs.select("_id", "_hash", "_size", "template", "label", F.explode(places).alias("place"), (F.col("shared") / n).alias("share")).distinct()
    base = F.col("place").isNotNull()
    found = hits.groupBy("_id", "_hash", "_size").agg(
        F.count("place").alias("n_base"),
        F.min("place").cast("long").alias("first_word"),
        F.max("place").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    found = checkpointed(found).toDF("_i", "_h", "_s", *found.columns[3:])
    out = facts.join(found, facts._id.eqNullSafe(found._i) & (facts._hash == found._h) & facts._size.eqNullSafe(found._s), "left")
    return out.select(
        F.col("_id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
