"""Links between near copies: texts whose five-word shingle sets have a Jaccard similarity of 0.8 or more.

1. ``BANDS`` x ``ROWS`` minimum hashes of every text's shingles; texts that agree on
   a whole band meet.  Two texts at a similarity of exactly 0.8 meet in no band with a
   probability of (1 - 0.8**ROWS)**BANDS, 5e-8.
2. In a group of up to ``SMALL`` texts all are compared with all.  In a larger one each
   is compared with the group's first and with the next ``NEXT`` of its part of about
   ``PART`` texts, so that no task holds the group.
3. A link is confirmed by the two texts' whole shingle sets.
4. What the confirmed links leave apart within a larger group is compared exactly: the
   texts outside the group's largest component, in blocks, with all texts of the group,
   in blocks.  A task sees one block of each side and gives a spanning forest of what it
   finds, not pairs; a group that step 3 joined into one component costs nothing.

Together the links connect what all pairs that meet would connect.  They join the
fingerprints of ``simhash``, to be added to its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import by_batch, checkpointed
from plumbline.llm.components import Forest, connected_components
from plumbline.llm.simhash import fingerprint, shingle_hashes

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 4
SMALL, NEXT, PART = 16, 4, 64
#: Texts and bytes of shingle sets of a block in step 4.
BLOCK_TEXTS, BLOCK_BYTES = 512, 16 << 20
_FACTORS = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_AT_ONCE = 512


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct hashes of a text's shingles, ascending; none without words."""
    parts = list(shingle_hashes(text, WORDS))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two shingle sets that aren't both empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def band_keys(text: str | None) -> np.ndarray:
    """A key for each band of a text; none without words."""
    least = np.full(len(_FACTORS), 0xFFFFFFFFFFFFFFFF, np.uint64)
    n = 0
    for shingles in shingle_hashes(text, WORDS):
        n += len(shingles)
        for at in range(0, len(shingles), _AT_ONCE):
            np.minimum(least, np.multiply.outer(_FACTORS, shingles[at : at + _AT_ONCE]).min(axis=1), out=least)
    if not n:
        return np.empty(0, np.int64)
    rows = least.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = (key ^ rows[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def _keys(batch: pa.RecordBatch) -> dict:
    keys = [band_keys(x.as_py()) for x in batch.column(1)]
    return {"key": np.concatenate(keys), "node": np.repeat(batch.column(0).to_numpy(), list(map(len, keys)))}


def _meetings(batch: pa.RecordBatch) -> dict:
    """Each of a list of nodes with the next ones: ``NEXT`` of them, or all where the list is a whole group."""
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for nodes, whole in zip(batch.column(0), batch.column(1)):
        n = nodes.values.to_numpy()
        for d in range(1, len(n) if whole.as_py() else min(NEXT + 1, len(n))):
            a.append(n[:-d])
            b.append(n[d:])
    return {"a": np.concatenate(a), "b": np.concatenate(b)}


def _sets(batch: pa.RecordBatch) -> dict:
    texts = [x.as_py() for x in batch.column(1)]
    return {"node": batch.column(0), "code": np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64), "shingles": [shingle_set(x).tobytes() for x in texts]}


def _confirmed(batch: pa.RecordBatch) -> dict:
    left, right = ([np.frombuffer(x.as_buffer(), "<u8") for x in batch.column(i)] for i in (2, 3))
    ok = np.array([similarity(x, y) >= SIMILARITY for x, y in zip(left, right)], bool)
    return {"a": batch.column(0).filter(ok), "b": batch.column(1).filter(ok)}


def links_between(left: list[tuple[int, int, np.ndarray]], right: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int]]:
    """(node, node) that join what lies in different components; both sides are lists of (node, component, shingles)."""
    forest, out = Forest(), []
    sizes = np.array([len(x) for _, _, x in right])
    owner, hashes = np.repeat(np.arange(len(right)), sizes), np.concatenate([x for _, _, x in right])
    order = np.argsort(hashes, kind="stable")
    owner, hashes = owner[order], hashes[order]
    for node, part, shingles in left:
        low, high = np.searchsorted(hashes, shingles), np.searchsorted(hashes, shingles, "right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(right))
        for k in np.flatnonzero(both >= SIMILARITY * (len(shingles) + sizes - both)):
            if part != right[k][1] and forest.join(part, right[k][1]):
                out.append((node, right[k][0]))
    return out


def _compared(group: pa.Table) -> pa.Table:
    sides: tuple[list, list] = ([], [])
    for side, node, part, data in zip(*(group.column(c) for c in ("side", "node", "root", "shingles"))):
        sides[side.as_py()].append((node.as_py(), part.as_py(), np.frombuffer(data.as_buffer(), "<u8")))
    found = links_between(*sides) if sides[0] and sides[1] else []
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})


def _left_apart(members: DataFrame, parts: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of step 4 from members (key, node, n, ...) of the larger groups and components (node, root)."""
    own = members.join(parts.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    own = own.join(sets.select(F.col("node").alias("_sized"), F.octet_length("shingles").alias("bytes")), F.col("node") == F.col("_sized"))
    own = checkpointed(own.select("key", "node", F.coalesce("root", "node").alias("root"), "bytes"))
    by_root = own.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    whole = by_root.groupBy(F.col("key").alias("_key")).agg(
        F.count("*").alias("parts"), F.sum("n").alias("all_n"), F.sum("bytes").alias("all_bytes"), F.max(F.struct("n", "root")).alias("most"), F.max_by("bytes", F.struct("n", "root")).alias("most_bytes")
    )
    whole = whole.filter("parts > 1")
    blocks = lambda n, b: F.ceil(F.greatest(n / BLOCK_TEXTS, b / BLOCK_BYTES))
    whole = checkpointed(whole.select("_key", F.col("most.root").alias("largest"), blocks(F.col("all_n") - F.col("most.n"), F.col("all_bytes") - F.col("most_bytes")).alias("n_left"), blocks(F.col("all_n"), F.col("all_bytes")).alias("n_right")))
    todo = own.join(whole, F.col("key") == F.col("_key")).select("key", "node", "root", "n_left", "n_right", (F.col("root") != F.col("largest")).alias("rest"))
    spread = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    mine = lambda n: F.array(F.pmod(F.xxhash64("node"), n))
    left = todo.filter("rest").select("key", "node", "root", F.lit(0).alias("side"), F.explode(mine(F.col("n_left"))).alias("i"), spread(F.col("n_right")).alias("js")).select("key", "node", "root", "side", "i", F.explode("js").alias("j"))
    right = todo.select("key", "node", "root", F.lit(1).alias("side"), F.explode(spread(F.col("n_left"))).alias("i"), mine(F.col("n_right")).alias("js")).select("key", "node", "root", "side", "i", F.explode("js").alias("j"))
    rows = left.unionAll(right).join(sets.select(F.col("node").alias("_n"), "shingles"), F.col("node") == F.col("_n"))
    return rows.select("key", "i", "j", "side", "node", "root", "shingles").groupBy("key", "i", "j").applyInArrow(_compared, "a long, b long")


def near_links(docs: DataFrame, text: str = "text") -> DataFrame:
    """Links (u, v) between the fingerprints of texts that are near copies of each other.

    Null texts and texts without a word have none; equal texts count once; other columns
    are ignored; an empty table gives no links.  Texts are told apart by 64-bit hashes.
    """
    own = F.col(f"`{text}`")
    texts = docs.filter(own.isNotNull()).select(F.xxhash64(own).alias("node"), own.alias("text"))
    keys = checkpointed(by_batch(texts, lambda: _keys, "key long, node long").distinct())
    sizes = checkpointed(keys.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("n"), F.min("node").alias("hub")).filter("n > 1"))
    # both sides of these joins are read from files, so that Spark can split a key that many texts share
    members = checkpointed(keys.join(sizes, keys.key == F.col("_key")).select("key", "node", "n", "hub"))
    if members.isEmpty():
        return docs.sparkSession.createDataFrame([], "u long, v long")
    small, large = members.filter(F.col("n") <= SMALL), members.filter(F.col("n") > SMALL)
    part = F.pmod(F.xxhash64("node"), F.pow(F.lit(2), F.ceil(F.log2(F.col("n") / PART))).cast("long"))
    lists = small.groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("nodes"), F.lit(True).alias("whole"))
    chains = large.withColumn("part", F.when(F.col("n") <= PART, 0).otherwise(part)).groupBy("key", "part").agg(F.sort_array(F.collect_list("node")).alias("nodes"), F.lit(False).alias("whole"))
    met = by_batch(lists.select("nodes", "whole").unionAll(chains.select("nodes", "whole")), lambda: _meetings, "a long, b long")
    hubs = large.filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    pairs = checkpointed(met.unionAll(hubs).distinct())
    named = members.select(F.col("node").alias("_m")).distinct()
    sets = by_batch(texts.join(named, F.col("node") == F.col("_m"), "left_semi").dropDuplicates(["node"]), lambda: _sets, "node long, code long, shingles binary")
    sets = checkpointed(sets)
    sides = [sets.select(F.col("node").alias(f"{x}_node"), F.col("shingles").alias(f"{x}_set")) for x in "ab"]
    both = pairs.join(sides[0], pairs.a == F.col("a_node")).join(sides[1], F.col("b") == F.col("b_node"))
    links = checkpointed(by_batch(both.select("a", "b", "a_set", "b_set"), lambda: _confirmed, "a long, b long"))
    if not large.isEmpty():
        links = links.unionAll(_left_apart(large, checkpointed(connected_components(links.toDF("u", "v"))), sets))
    codes = [sets.select(F.col("node").alias(f"{x}_node"), F.col("code").alias(x)) for x in "uv"]
    return links.join(codes[0], F.col("a") == F.col("u_node")).join(codes[1], F.col("b") == F.col("v_node")).select("u", "v")
