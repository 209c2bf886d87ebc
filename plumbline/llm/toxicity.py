"""Toxicity scores: logistic regression by FTRL-proximal over hashed word features.

Features of a text are the distinct hashed words, neighbouring word pairs and
pairs with one word between (skip-grams).  FTRL-proximal keeps two sums for each
coordinate: a learning rate of its own, and an L1 term that leaves most weights at
exactly zero, so that the weights fit a small broadcast.

The model is fitted by one task on a bounded sample of labelled rows (``SAMPLE_ROWS``
ids of least hash and ``SAMPLE_BYTES`` of their features; all where there are fewer),
each learned whole.  Scoring is one pass over all rows without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import by_batch, ddl, fold_of, fresh

#: Most labelled rows that a model is fitted on, and most bytes of their packed features (4 bytes a feature).
SAMPLE_ROWS, SAMPLE_BYTES = 12_000, 256 << 20
BITS = 20
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 8.0, 1.0, 3
HELD_OUT_FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.5
_WORD = re.compile(r"\w+")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class WordHashes(dict):
    """word -> crc32, remembered for up to ``LIMIT`` words."""

    LIMIT = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = crc32(word.encode("utf-8"))
        return value


def features(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Hashed features of a whole text, repeats included."""
    words = _WORD.findall((text or "").lower())
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    one, shift = _MIX[0], np.uint64(64 - BITS)
    parts = [(h * one) >> shift]
    for gap, mix in ((1, _MIX[1]), (2, _MIX[2])):
        if len(h) > gap:
            parts.append(((h[:-gap] * mix + h[gap:]) * one) >> shift)
    return np.concatenate(parts).astype(np.int32)


def packed(found: np.ndarray) -> bytes:
    """All of a row's ascending distinct features: 4 bytes each, or 2**BITS bits where that is less."""
    if 32 * len(found) < 1 << BITS:
        return found.astype("<i4").tobytes()
    bits = np.zeros(1 << BITS, bool)
    bits[found] = True
    return np.packbits(bits).tobytes()


def unpacked(row: np.ndarray) -> np.ndarray:
    """The features of a row of bits (uint8); other rows as they are."""
    return np.flatnonzero(np.unpackbits(row)) if row.dtype == np.uint8 else row


@dataclass(frozen=True)
class Weights:
    """Non-zero weights by ascending feature."""

    index: np.ndarray
    value: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.index] = self.value
        return out


def fit_ftrl(rows: list[tuple[np.ndarray, int]]) -> Weights:
    """Weights after ``EPOCHS`` passes over (distinct features, label) in the given order.

    The bias is a coordinate of its own without L1.  Rows of bits are unpacked one at a time; others are never copied.
    """
    size = 1 << BITS
    z, n = np.zeros(size), np.zeros(size)
    bias_z = bias_n = 0.0

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    def bias() -> float:
        return -bias_z / ((BETA + bias_n**0.5) / ALPHA + L2)

    for _ in range(EPOCHS):
        for row, y in rows:
            i = unpacked(row)
            w, b = weight(i), bias()
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - step * w
            n[i] += g * g
            bias_z += g - ((bias_n + g * g) ** 0.5 - bias_n**0.5) / ALPHA * b
            bias_n += g * g
    w = weight(np.arange(size))
    index = np.flatnonzero(w)
    return Weights(index.astype(np.int32), w[index].astype(np.float32), float(bias()))


def _bounded(rows: Iterable[tuple[bytes, int]]) -> list[tuple[np.ndarray, int]]:
    """(packed features, label) in the given order, whole rows, until ``SAMPLE_BYTES`` are held."""
    out, held = [], 0
    for data, y in rows:
        held += len(data)
        if held > SAMPLE_BYTES:
            break
        out.append((np.frombuffer(data, "u1" if len(data) == 1 << (BITS - 3) else "<i4"), y))
    return out


def fitted(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, trainable: Column) -> Weights:
    """Weights learned by one executor task from a sample of at most ``SAMPLE_ROWS`` ids.

    The ids are those of least hash; a row of each is used (of several the one of least
    text hash), in the order of the ids' hashes.  Only the weights reach the driver.
    """
    labelled = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).filter(trainable)
    labelled = labelled.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_label"))
    chosen = labelled.withColumn("_key", F.xxhash64("_id", F.lit("sample"))).orderBy("_key", "_id").limit(SAMPLE_ROWS)

    def make():
        hashes = WordHashes()

        def work(batch: pa.RecordBatch) -> dict:
            found = [packed(np.unique(features(x.as_py(), hashes))) for x in batch.column(3)]
            return {"key": batch.column(0), "label": batch.column(1), "tie": batch.column(2), "features": found}

        return work

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((x.as_py(), int(y.as_py() > 0)) for b in batches for x, y in zip(b.column(1), b.column(0)))
        w = fit_ftrl(_bounded(rows))
        yield pa.RecordBatch.from_pydict({"index": [w.index.astype("<i4").tobytes()], "value": [w.value.astype("<f4").tobytes()], "bias": [w.bias]})

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")  # SAMPLE_ROWS rows of 20 bytes
    rows = rows.select("_key", "_label", F.xxhash64("_text").alias("_tie"), "_text")
    rows = by_batch(rows, make, "key long, label int, tie long, features binary")
    rows = rows.groupBy("key").agg(F.min(F.struct("tie", "label", "features")).alias("x")).select("key", "x.label", "x.features")
    got = rows.repartition(1).sortWithinPartitions("key").select("label", "features").mapInArrow(fit, "index binary, value binary, bias double").first()
    if got is None:  # no row at all
        return fit_ftrl([])
    return Weights(np.frombuffer(got["index"], "<i4"), np.frombuffer(got["value"], "<f4"), got["bias"])


def add_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", score: str = "score", trainable: Column | None = None) -> DataFrame:
    """``docs`` with a column ``score`` between 0 and 1 for every row.

    Only rows of ``labels`` for which ``trainable`` holds (default: crc32 of the id
    modulo 5 isn't 0) teach; a null label or id teaches nothing, of several
    labels of an id the largest counts, and of several rows of a labelled id one
    teaches.  Null and empty texts get the score of no features.  Without any label
    all scores are those of an empty model, 0.5.  Repeated rows each get a score; an
    empty table stays empty.  A column of ``docs`` that is named as the score is
    replaced.
    """
    trainable = fold_of(id_col, HELD_OUT_FOLDS) != HELD_OUT if trainable is None else trainable
    weights = fitted(docs, labels, id_col, text, label, trainable)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 8 bytes for each of 2**BITS weights at most
    keep = [c for c in docs.columns if c.lower() != score.lower()]
    name = fresh(docs, "_score")

    def make():
        w, hashes, seen = shared.value, WordHashes(), np.zeros(1 << BITS, bool)
        dense = w.dense()

        def value(x: str | None) -> float:
            f = features(x, hashes)
            f = f[dense[f] != 0]
            seen[f] = True  # each feature counts once
            f = np.flatnonzero(seen[w.index])
            total = w.bias + float(w.value[f].sum(dtype=np.float64))
            seen[w.index[f]] = False
            return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))

        def work(batch: pa.RecordBatch) -> dict:
            at = batch.schema.names.index(text)
            return {c: batch.column(i) for i, c in enumerate(keep)} | {name: [value(x.as_py()) for x in batch.column(at)]}

        return work

    if text not in keep:
        raise ValueError(f"the score can't replace the text column {text!r}")
    out = by_batch(docs.select(*[F.col(f"`{c}`") for c in keep]), make, f"{ddl(docs, *keep)}, `{name}` double")
    return out.withColumnRenamed(name, score)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """``id_col``, ``held_out``, ``score`` and ``predicted`` of every row (see ``add_scores``); a null id isn't held out."""
    plain = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    plain_labels = labels.select(F.col(id_col).alias("_id"), F.col(label).alias("_label"))
    out = add_scores(plain, plain_labels, "_id", "_text", "_label", "_score")
    return out.select(
        F.col("_id").alias(id_col),
        F.coalesce(fold_of("_id", HELD_OUT_FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """``docs`` without the rows that score ``THRESHOLD`` or more; all columns stay (see ``add_scores`` for nulls and repeats)."""
    name = fresh(docs, "_toxicity")
    return add_scores(docs, labels, id_col, text, label, name).filter(F.col(name) < THRESHOLD).drop(name)
