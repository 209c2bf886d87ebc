"""Benchmark decontamination by latent semantic retrieval and a subsequence check.

1. Document frequencies of hashed words over all documents: one partial vector a
   task, summed by a shuffle of at most 2**BITS rows a task.
2. A distributed randomised SVD of the unit TF-IDF passages of all benchmark items: Z = A'(A G) for a Gaussian
   G, Q = qr(Z), then the eigenvectors of (A Q)'(A Q).  The benchmark is what is
   searched for, so the basis is fitted on every item of it and on nothing else; the
   documents' windows are folded in.
3. Every document is cut into overlapping windows at three scales; prefix sums of
   the projected words give each window's latent vector, and those within
   ``COSINE`` of a benchmark item (of that scale) are candidates.  So are the places
   that share a run of ``RUN_WORDS`` words with an item, however common its words are.
4. A candidate counts as a leak if the longest common subsequence of its
   surroundings and the item covers ``LCS_RATIO`` of the item's words, or
   ``PARAPHRASE_RATIO`` and the item's answer (its last sentence) stands there word
   for word.

Step 3 and 4 are one pass without a shuffle.  The benchmark is searched in blocks of
about ``BLOCK_ITEMS`` items and ``BLOCK_BYTES`` of text, which bounds what is broadcast;
each block is a further pass.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import by_batch, checkpointed, ddl, fresh, row_hash  # noqa: F401  tests take row_hash from here

BITS, RANK, OVERSAMPLE, SEED = 16, 48, 8, 7
FIT_PARTS, FIT_WORDS = 8, 64
#: Directions with less than this share of the largest eigenvalue are rounding errors and left out.
LEAST_EIGENVALUE = 1e-5
#: Inverse document frequencies are raised to this power, so that a few common words outweigh no rare one.
IDF_POWER = 3
SCALES = (16, 32, 64)
COSINE = 0.55
#: A window's vector counts as at least this share of the item's length, so that one shared word is no candidate.
LEAST_SIZE = 0.7
LCS_RATIO, PARAPHRASE_RATIO = 0.8, 0.6
#: Items with fewer words must stand in a text word for word.
FEW_WORDS, ANSWER_WORDS = 6, 3
#: Words of the runs that make a candidate, and the fewest words of an item whose runs have that many; those of shorter
#: items have one less.  Of LCS_RATIO of an item's words some such run is left if words are only left out or replaced.
RUN_WORDS, LONG_WORDS = 4, 16
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
#: Items that windows are multiplied with at once.
ITEMS_AT_ONCE = 2048
#: Words of a text that are projected at once.
SEGMENT = 8192
_DIMS = 1 << BITS
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?\n]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


#: Characters of a text that are hashed at once, if a break between words allows.
_HASH_PART = 1 << 18
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _word_characters() -> np.ndarray:
    """For each code point whether ``\\w`` matches it."""
    return np.fromiter((c == 95 or chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _BASE and of its inverse, modulo 2**64."""
    bases = np.array([_BASE, pow(_BASE, -1, 1 << 64)], np.uint64)
    out = np.ones((2, n), np.uint64)
    out[:, 1:] = bases[:, None]
    np.multiply.accumulate(out, axis=1, out=out)
    return out[0], out[1]


def word_ids(text: str | None) -> np.ndarray:
    """A 31-bit hash of each word of a text, in order, without making the words.

    The hash is a polynomial of the code points.  Prefix sums over the text give that
    of every word at once: a difference of two sums, times the inverse power of where
    the word begins.
    """
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    inside = _word_characters()[codes]
    out, at = [], 0
    while at < len(codes):
        end = min(len(codes), at + _HASH_PART)
        if end < len(codes):
            gaps = np.flatnonzero(~inside[at:end])
            after = np.flatnonzero(~inside[end:]) if not len(gaps) else gaps
            end = (at + int(gaps[-1]) + 1) if len(gaps) else (end + int(after[0]) + 1 if len(after) else len(codes))
        part, own = codes[at:end], inside[at:end]
        power, inverse = _powers(max(_HASH_PART, 1 << (len(part) - 1).bit_length()))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * power[: len(part)], out=sums[1:])
        edge = np.flatnonzero(np.diff(own.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        first, last = edge[::2], edge[1::2]
        h = (sums[last] - sums[first]) * inverse[first]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out.append((h >> np.uint64(33)).astype(np.int64))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.int64)


def term_ids(text: str | None) -> np.ndarray:
    """``word_ids`` cut down to the hashed dimensions."""
    return word_ids(text) & (_DIMS - 1)


def run_hashes(ids: np.ndarray, widths: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(width, a 64-bit hash of each run of that many consecutive ids), by width."""
    codes = ids.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    codes ^= codes >> np.uint64(32)
    h = np.zeros(len(codes) + 1, np.uint64)
    for width in range(1, max(widths, default=0) + 1):
        h = h[:-1] * np.uint64(_BASE) + codes[width - 1 :] if len(h) else h
        if width in widths:
            yield width, h


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """(documents with each hashed term, documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(_DIMS + 1, np.int64)
        seen = np.zeros(_DIMS, bool)
        for batch in batches:
            for x in batch.column(0):
                seen[term_ids(x.as_py())] = True
                own = np.flatnonzero(seen)
                seen[own] = False
                n[own] += 1
                n[_DIMS] += 1
        term = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"term": term.astype(np.int32), "n": n[term]})

    parts = docs.select(text).mapInArrow(run, "term int, n long")
    got = parts.groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # 2**BITS + 1 rows at most
    out = np.zeros(_DIMS + 1, np.int64)
    out[got.column("term").to_numpy()] = got.column("n").to_numpy()
    return out[:_DIMS], int(out[_DIMS])


def inverse_frequencies(df: np.ndarray, n: int) -> np.ndarray:
    return (np.log((n + 1) / (df + 1)).clip(0) ** IDF_POWER).astype(np.float32)


def benchmark_terms(items: DataFrame) -> np.ndarray:
    """Which hashed terms occur in any item: other words can't speak for or against one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(_DIMS, bool)
        for batch in batches:
            for x in batch.column(0):
                seen[term_ids(x.as_py())] = True
        yield pa.RecordBatch.from_pydict({"term": np.flatnonzero(seen).astype(np.int32)})

    out = np.zeros(_DIMS, bool)
    out[items.select("text").mapInArrow(run, "term int").distinct().toArrow().column("term").to_numpy()] = True  # 2**BITS rows at most
    return out


def passage_matrix(text: str | None, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(terms, weights) of the unit TF-IDF vectors of a text's passages."""
    ids = term_ids(text)
    rows = []
    for at in range(0, len(ids), FIT_WORDS):
        term, tf = np.unique(ids[at : at + FIT_WORDS], return_counts=True)
        w = tf * idf[term]
        if (size := float(np.sqrt((w * w).sum()))) > 0:
            rows.append((term[w > 0], (w[w > 0] / size).astype(np.float32)))
    return rows


def _products(rows: list[tuple[np.ndarray, np.ndarray]], right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t, _ in rows])
    term, w = np.concatenate([t for t, _ in rows]), np.concatenate([x for _, x in rows])
    at = np.cumsum(sizes) - sizes
    return np.add.reduceat(right[term] * w[:, None], at), term, w, sizes


def _sum_parts(sample: DataFrame, idf: np.ndarray, right: np.ndarray, step, shape: tuple[int, int]) -> np.ndarray:
    """Sum over all passages of ``step``, a matrix of ``shape``; blocks of rows are summed apart."""
    shared = sample.sparkSession.sparkContext.broadcast((idf, right))
    rows_a_block = 4096

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, matrix = shared.value
        total = np.zeros(shape, np.float32)
        for batch in batches:
            rows = [r for x in batch.column(0) for r in passage_matrix(x.as_py(), weights)]
            for at in range(0, len(rows), 2000):
                step(total, rows[at : at + 2000], matrix)
        blocks = range(0, shape[0], rows_a_block)
        yield pa.RecordBatch.from_pydict({"block": pa.array(list(blocks), pa.int32()), "data": [total[b : b + rows_a_block].tobytes() for b in blocks]})

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float32).astype(np.float64) for x in group.column("data"))  # FIT_PARTS rows
        return pa.table({"block": [group.column("block")[0].as_py()], "data": [total.astype(np.float32).tobytes()]}, schema=group.schema)

    schema = "block int, data binary"
    parts = sample.mapInArrow(run, schema).groupBy("block").applyInArrow(add, schema).toArrow().to_pydict()
    out = np.zeros(shape, np.float32)
    for b, data in zip(parts["block"], parts["data"]):
        part = np.frombuffer(data, np.float32).reshape(-1, shape[1])
        out[b : b + len(part)] = part
    return out


def _power(total: np.ndarray, rows: list, right: np.ndarray) -> None:
    y, term, w, sizes = _products(rows, right)
    scaled = np.repeat(y, sizes, axis=0) * w[:, None]
    order = np.argsort(term, kind="stable")
    first = np.flatnonzero(np.diff(term[order], prepend=-1))
    total[term[order][first]] += np.add.reduceat(scaled[order], first)


def _gram(total: np.ndarray, rows: list, right: np.ndarray) -> None:
    y = _products(rows, right)[0]
    total += y.T @ y


def latent_basis(texts: DataFrame, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Right singular vectors (2**BITS x rank) of the unit TF-IDF passages of a one-column frame; zeros beyond its rank."""
    width = rank + OVERSAMPLE
    start = np.random.default_rng(SEED).standard_normal((_DIMS, width)).astype(np.float32)
    z = _sum_parts(texts, idf, start, _power, (_DIMS, width))
    q = np.linalg.qr(z)[0].astype(np.float32)
    c = _sum_parts(texts, idf, q, _gram, (width, width)).astype(np.float64)
    values, vectors = np.linalg.eigh((c + c.T) / 2)
    vectors[:, values <= LEAST_EIGENVALUE * values[-1]] = 0
    return (q @ vectors[:, ::-1][:, :rank]).astype(np.float32)


def common_subsequence(item: list, text: list) -> int:
    """Length of the longest common subsequence, a bit of an integer for each item word."""
    at: dict = {}
    for i, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in text:
        if m := at.get(w):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(item) - row.bit_count()


def stands_in(part: list, text: list) -> bool:
    """Whether ``part`` stands consecutively in ``text``."""
    n = len(part)
    return any(text[i : i + n] == part for i, w in enumerate(text) if w == part[0]) if n else True


def leak_share(item: list, answer: list, text: list, counts: dict | None = None) -> float:
    """Share of the item's words that ``text`` holds in order if that makes a leak, else 0."""
    if len(item) < FEW_WORDS:
        return float(bool(item) and stands_in(item, text))
    counts = Counter(item) if counts is None else counts
    missing = sum(counts[w] for w in counts.keys() - set(text))
    if len(item) - missing < PARAPHRASE_RATIO * len(item):  # no subsequence can be longer
        return 0.0
    share = common_subsequence(item, text) / len(item)
    return share if share >= LCS_RATIO or share >= PARAPHRASE_RATIO and stands_in(answer, text) else 0.0


def answer_of(text: str, words: list[str]) -> list[str]:
    """Words of the last sentence, or of the last fifth where that has under ANSWER_WORDS."""
    last = next((w for s in reversed(_SENTENCE.split(text)) if (w := words_of(s))), [])
    return last if len(last) >= ANSWER_WORDS else words[-max(ANSWER_WORDS, math.ceil(len(words) / 5)) :]


def parts_of(n: int) -> list[int]:
    """Where the parts of an item of n words begin: at most SCALES[-1] words each, the last one ending where the item ends."""
    size = SCALES[-1]
    return [*range(0, max(1, n - size), size), n - size] if n > size else [0] if n else []


@dataclass
class Item:
    """A benchmark item: its words and those of its answer, and their ids."""

    ident: object
    text: str | None
    words: list[str] = field(init=False)
    answer: list[str] = field(init=False)
    ids: list[int] = field(init=False)
    answer_ids: list[int] = field(init=False)
    counts: dict[int, int] = field(init=False)

    def __post_init__(self):
        self.words = words_of(self.text)
        self.answer = answer_of(self.text or "", self.words)
        self.ids, self.answer_ids = (word_ids(" ".join(x)).tolist() for x in (self.words, self.answer))
        self.counts = Counter(self.ids)


class Search:
    """One block of items, ready to be looked for in texts."""

    def __init__(self, items: list[Item], projection: np.ndarray):
        self.items, self.projection = items, projection
        rows: dict[int, list] = {s: [] for s in SCALES}
        for k, item in enumerate(items):
            terms = np.array(item.ids, np.int64) & (_DIMS - 1)
            for at in parts_of(len(terms)):
                part = terms[at : at + SCALES[-1]]
                v = projection[part].sum(axis=0)
                size = max(float(np.linalg.norm(v)), 1e-9)
                rows[next(s for s in SCALES if len(part) <= s)].append((k, at, v / size, LEAST_SIZE * size))
        #: By scale, in blocks: (item, place of the part in the item, unit vectors as columns, least sizes).
        self.sides: dict[int, list[tuple]] = {}
        for s, r in rows.items():
            for at in range(0, len(r), ITEMS_AT_ONCE):
                owner, place, vectors, least = zip(*r[at : at + ITEMS_AT_ONCE])
                self.sides.setdefault(s, []).append((np.array(owner), np.array(place), np.array(vectors, np.float32).T.copy(), np.array(least, np.float32)))
        self.runs, self.grid = self._runs(), np.array([max(1, len(item.ids) // 4) for item in items], np.int64)

    def _runs(self) -> dict[int, tuple]:
        """For each width (bits of the filter, filter, run hashes ascending, item, place in the item)."""
        found: dict[int, list] = {}
        for k, item in enumerate(self.items):
            n = len(item.ids)
            width = min(n, RUN_WORDS - (n < LONG_WORDS))
            if n:
                ((_, h),) = run_hashes(np.array(item.ids, np.int64), {width})
                found.setdefault(width, []).append((h, np.full(len(h), k), np.arange(len(h))))
                if (m := len(item.answer_ids)) < width:  # a paraphrase holds its answer whole
                    ((_, h),) = run_hashes(np.array(item.answer_ids, np.int64), {m})
                    found.setdefault(m, []).append((h, np.array([k]), np.array([n - m])))
        out = {}
        for width, parts in found.items():
            h, item, place = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            bits = max(16, len(h).bit_length() + 4)
            seen = np.zeros(1 << bits, bool)
            seen[h >> np.uint64(64 - bits)] = True
            out[width] = bits, seen, h[order], item[order], place[order]
        return out

    def shared_runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(item, about where it would begin) for the runs of words that a text shares with items; each once."""
        pairs = []
        for width, h in run_hashes(ids, set(self.runs)):
            bits, seen, hashes, owner, place = self.runs[width]
            at = np.flatnonzero(seen[h >> np.uint64(64 - bits)])
            if not len(at):
                continue
            low, high = np.searchsorted(hashes, h[at]), np.searchsorted(hashes, h[at], "right")
            n = high - low
            row = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            item = owner[row]
            grid = self.grid[item]
            first = (np.repeat(at, n) - place[row]) // grid * grid
            pairs.append(np.stack([item, first], axis=1))
        return np.unique(np.concatenate(pairs), axis=0).tolist() if pairs else []

    def candidates(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, about where it would begin, words of the window) of windows near an item."""
        step = SCALES[0] // 4
        for begin in range(0, len(ids), SEGMENT):
            part = ids[begin : begin + SEGMENT + SCALES[-1]]
            rows = np.zeros((-(-len(part) // step) * step, self.projection.shape[1]), np.float32)
            np.take(self.projection, part, axis=0, out=rows[: len(part)])
            blocks = rows[::step] + rows[1::step]
            for k in range(2, step):
                blocks += rows[k::step]
            sums = np.zeros((len(blocks) + 1, blocks.shape[1]), np.float32)
            np.cumsum(blocks, axis=0, out=sums[1:])
            for scale, blocks_of_items in self.sides.items():
                first = np.arange(0, max(1, min(len(part), SEGMENT + scale) - scale * 3 // 4), scale // 4)
                after = np.minimum(first + scale, len(part))
                window = sums[-(-after // step)] - sums[first // step]
                size = np.sqrt(np.einsum("ij,ij->i", window, window))
                for owner, place, side, least in blocks_of_items:
                    product = window @ side
                    rows_near = np.flatnonzero(product.max(axis=1) > COSINE * np.maximum(size, least.min()))
                    if not len(rows_near):
                        continue
                    near, row = np.nonzero(product[rows_near] > COSINE * np.maximum(size[rows_near, None], least))
                    near = rows_near[near]
                    yield from zip(owner[row].tolist(), (first[near] + begin - place[row]).tolist(), (after - first)[near].tolist())

    def leaks(self, text: str | None) -> list[tuple[int, float]]:
        """(item, share) of the items that a whole text holds; found by word ids, confirmed by the words."""
        ids = word_ids(text)
        found: dict[int, float] = {}
        looked: set[tuple[int, int, int]] = set()
        words: list[str] = []

        def look(k: int, begin: int, end: int) -> None:
            nonlocal words
            item = self.items[k]
            if leak_share(item.ids, item.answer_ids, ids[begin:end].tolist(), item.counts):
                words = words or words_of(text)
                if share := leak_share(item.words, item.answer, words[begin:end]):
                    found[k] = max(found.get(k, 0), share)

        for k, first in self.shared_runs(ids):
            n = len(self.items[k].ids)
            if found.get(k, 0) != 1.0:
                look(k, max(0, first - n // 2 - 1), first + n + n // 2 + 1)
        for k, first, width in self.candidates(ids & (_DIMS - 1)):
            n = max(width, len(self.items[k].ids))
            grid = n // 4 + 1
            place = first // grid
            if found.get(k, 0) == 1.0 or (k, n, place) in looked:
                continue
            looked.add((k, n, place))  # one look serves all windows that begin in a stretch of the grid
            look(k, max(0, place * grid - n // 2 - 1), (place + 1) * grid + n + n // 2 + 1)
        return sorted(found.items())


def add_leaks(docs: DataFrame, benchmark: DataFrame, leaks: str = "leaks", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``docs`` with ``leaks``: array of (item, share) for the benchmark items each row holds.

    Every row stays, with all its columns.  Null and empty texts hold nothing, null
    items and items without a word are held by nothing, an empty benchmark by
    nobody.  Rows of the benchmark that repeat an item each count.  An existing
    column named as ``leaks`` is replaced.
    """
    spark = docs.sparkSession
    kind = dict(benchmark.dtypes)[item_id]
    keep = [c for c in docs.columns if c.lower() != leaks.lower()]
    name = fresh(docs, "_leaks")
    out = docs.select(*[F.col(f"`{c}`") for c in keep])
    items = benchmark.select(F.col(f"`{item_id}`").alias("id"), F.col(f"`{item_text}`").alias("text"))
    count, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(math.ceil(count / block_items), math.ceil(size / BLOCK_BYTES))
    if not count:
        return out.withColumn(leaks, F.array().cast(f"array<struct<item:{kind},share:double>>"))
    df, n = document_frequencies(docs, text)
    idf = inverse_frequencies(df, n)
    idf[~benchmark_terms(items)] = 0
    fit = checkpointed(items.select("text").repartition(FIT_PARTS))
    projection = latent_basis(fit, idf) * idf[:, None]
    parts = []
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect() if blocks > 1 else items.collect()
        own = [Item(r["id"], r["text"]) for r in rows]
        shared = spark.sparkContext.broadcast((own, projection))
        parts.append(f"{name}{b}")
        out = _with_leaks(out, shared, text, parts[-1], kind)
    joined = F.concat(*parts) if len(parts) > 1 else F.col(parts[0])
    return out.withColumn(name, joined).drop(*parts).withColumnRenamed(name, leaks)


def _with_leaks(docs: DataFrame, shared, text: str, name: str, kind: str) -> DataFrame:
    columns = docs.columns

    def make():
        items, projection = shared.value
        search = Search(items, projection)

        def work(batch: pa.RecordBatch) -> dict:
            found = [[{"item": items[k].ident, "share": share} for k, share in search.leaks(x.as_py())] for x in batch.column(columns.index(text))]
            return {c: batch.column(i) for i, c in enumerate(columns)} | {name: pa.array(found, leak_type)}

        return work

    from pyspark.sql.pandas.types import to_arrow_type

    struct = f"array<struct<item:{kind},share:double>>"
    leak_type = to_arrow_type(docs.sparkSession.createDataFrame([], f"x {struct}").schema["x"].dataType)
    return by_batch(docs, make, f"{ddl(docs, *columns)}, `{name}` {struct}")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``id_col``, ``item_ids`` (ascending), ``n_items``, ``best`` (largest share, 0 without) and ``contaminated`` of every row.

    Null and empty texts hold nothing; repeated rows and rows with a null id each get a
    row; other columns are ignored; an empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    found = add_leaks(rows, benchmark, "_found", "_text", item_id)
    ids = F.array_sort(F.array_distinct(F.transform("_found", lambda x: x["item"])))
    best = F.coalesce(F.array_max(F.transform("_found", lambda x: x["share"])), F.lit(0.0))
    return found.select(F.col("_id").alias(id_col), ids.alias("item_ids"), F.size(ids).alias("n_items"), best.alias("best"), (F.size("_found") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; all columns stay.

    Null and empty texts hold nothing and stay; repeated rows are judged alike.
    """
    name = fresh(docs, "_leaks_found")
    return add_leaks(docs, benchmark, name, text, item_id).filter(F.size(name) == 0).drop(name)
