"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams (one to three letters,
a blank standing for each side of a word) by falling frequency.  A text's own list is
compared with each profile by the out-of-place distance: for each of its n-grams the
difference of the two ranks, or the profile's length where it isn't there.

Profiles are learned from at most ``LANGUAGE_ROWS`` rows of each language that have a
letter, those of least hash of the whole row (all where there are fewer); the counts
are summed by Spark.  Predicting is one pass over all rows without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import by_batch, checkpointed, ddl, fold_of, row_hash

#: Most rows of a language that its profile is learned from, and most languages.
LANGUAGE_ROWS, LANGUAGES = 2_000, 50_000
PROFILE, ORDERS = 400, (1, 2, 3)
HELD_OUT_FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
#: Characters of a text that are counted at once, if a break between words allows.
PART = 1 << 18
_BITS = np.int64(21)


def _is_letter() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letters_of(text: str, letter: np.ndarray) -> Iterator[np.ndarray]:
    """Code points of the lower-case text with one blank for each run of other characters and at both ends.

    They come in parts, cut between words; the blank at a cut ends one part and begins the next.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    at = 0
    while True:
        end = min(at + PART, len(codes))
        if end < len(codes):
            gaps = np.flatnonzero(~letter[codes[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # one word: on to its end
                while end < len(codes) and letter[codes[end]]:
                    more = np.flatnonzero(~letter[codes[end : end + PART]])
                    end = end + int(more[0]) if len(more) else min(end + PART, len(codes))
        part = codes[at:end].astype(np.int64)
        part = np.concatenate(([32], np.where(letter[part], part, 32), [32]))
        keep = np.ones(len(part), bool)
        keep[1:] = (part[1:] != 32) | (part[:-1] != 32)
        yield part[keep]
        at = end
        if at >= len(codes):
            return


def grams_of(codes: np.ndarray, order: int) -> np.ndarray:
    """Packed n-grams of one order that have a letter at all; blanks stand only at their ends."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.empty(0, np.int64)
    out = codes[:n].copy()
    for k in range(1, order):
        out = (out << _BITS) | codes[k : n + k]
    ok = codes[:n] != 32 if order == 1 else np.ones(n, bool)
    for k in range(1, order - 1):
        ok &= codes[k : n + k] != 32
    return out[ok]


def gram_counts(text: str, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams ascending, counts) of a whole text; an n-gram carries its order in the bits above its letters."""
    total: tuple[np.ndarray, np.ndarray] | None = None
    for codes in letters_of(text, letter):
        parts = np.unique(np.concatenate([grams_of(codes, n) for n in ORDERS]), return_counts=True)
        if total is None:
            total = parts
        else:
            keys, back = np.unique(np.concatenate((total[0], parts[0])), return_inverse=True)
            total = keys, np.bincount(back, np.concatenate((total[1], parts[1]))).astype(np.int64)
    return total


def ranked(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The PROFILE most frequent n-grams; on a tie the smaller first."""
    return grams[np.lexsort((grams, -counts))[:PROFILE]]


class Profiles:
    """Profiles of all languages, ready to be compared with texts."""

    def __init__(self, profiles: dict[str, np.ndarray]):
        self.names = sorted(profiles)
        sizes = [len(profiles[n]) for n in self.names]
        grams = np.concatenate([np.empty(0, np.int64), *(np.asarray(profiles[n], np.int64) for n in self.names)])
        order = np.argsort(grams, kind="stable")
        self.grams = grams[order]
        self.owner = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.place = np.concatenate([np.empty(0, np.int64), *map(np.arange, sizes)])[order]

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Mean out-of-place distance to each language as a share of the profile's length."""
        low, high = np.searchsorted(self.grams, own), np.searchsorted(self.grams, own, "right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        nearer = PROFILE - np.abs(self.place[at] - np.repeat(np.arange(len(own)), n))
        saved = np.bincount(self.owner[at], nearer, len(self.names))
        return 1 - saved / (len(own) * PROFILE)

    def predict(self, text: str | None, letter: np.ndarray) -> tuple[str, float]:
        grams, counts = gram_counts(text or "", letter)
        if not len(grams) or not self.names:
            return UNKNOWN, 0.0
        d = self.distances(ranked(grams, counts))
        return self.names[int(np.argmin(d))], float(1 - d.min())


def learning_rows(docs: DataFrame, lang: str, text: str, trainable: Column) -> DataFrame:
    """(lang, text) of the rows that profiles are learned from.

    A language's rows are cut down to about twice its bound by their hash, where they lie,
    before they are ranked, so that a language of a third of all rows is no burden on one
    task.  More than ``LANGUAGES`` languages are refused.
    """
    h = F.pmod(row_hash(docs, "profile"), F.lit(1 << 62))
    rows = docs.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"), trainable.alias("ok"), h.alias("h"))
    rows = rows.filter("ok and lang is not null").filter(F.col("text").rlike(r"\p{L}"))
    sizes = checkpointed(rows.groupBy(F.col("lang").alias("_lang")).agg((F.lit(2.0 * LANGUAGE_ROWS) / F.count("*")).alias("share")))
    if sizes.count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages; their profiles aren't sent to the executors")
    few = rows.join(F.broadcast(sizes), F.col("lang") == F.col("_lang")).filter(F.col("h") < F.col("share") * float(1 << 62))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    return few.withColumn("nth", nth).filter(F.col("nth") <= LANGUAGE_ROWS).select("lang", "text")


def learn_profiles(docs: DataFrame, lang: str, text: str, trainable: Column) -> dict[str, np.ndarray]:
    """language -> n-grams of its profile."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = _is_letter()
        for batch in batches:
            found: dict[str, list] = {}
            for name, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                found.setdefault(name, []).append(gram_counts(x.as_py(), letter))
            for name, parts in found.items():
                grams, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64) if len(grams) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_pydict({"lang": [name] * len(grams), "gram": grams, "n": n})

    counts = learning_rows(docs, lang, text, trainable).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("rank", best).filter(F.col("rank") <= PROFILE)
    lists = top.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "gram"))), lambda x: x["gram"]).alias("grams"))
    got = lists.toArrow()  # PROFILE numbers for each of at most LANGUAGES
    return {name: grams.values.to_numpy() for name, grams in zip(got.column("lang").to_pylist(), got.column("grams"))}


def identify(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", trainable: Column | None = None) -> DataFrame:
    """``id_col``, ``held_out``, ``lang_pred`` and ``score`` of every row.

    Profiles come from rows with a language for which ``trainable`` holds (default:
    crc32 of the id modulo 4 isn't 2).  ``score`` is one minus the mean
    out-of-place distance as a share of the largest.  A null text, or one without a
    letter, is ``und`` with score 0, and so is all if nothing was learned; on a tie
    the first language by name is taken.  Rows with a null id aren't held out and
    teach nothing; repeated rows each get a row; other columns are ignored; an empty
    table gives an empty one.  A language all of whose teaching rows lack a letter isn't
    learned; texts in it get another language's name.
    """
    fold = fold_of(id_col, HELD_OUT_FOLDS)
    profiles = learn_profiles(docs, lang, text, fold != HELD_OUT if trainable is None else trainable)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # PROFILE numbers a language

    def make():
        known, letter = Profiles(shared.value), _is_letter()

        def work(batch: pa.RecordBatch) -> dict:
            found = [known.predict(x.as_py(), letter) for x in batch.column(2)]
            return {"id": batch.column(0), "held_out": batch.column(1), "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

        return work

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    return by_batch(rows, make, f"{ddl(rows, 'id')}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
