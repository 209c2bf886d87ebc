"""SimHash near-duplicates with a Gray-order hierarchical index.

Distinct fingerprints are put in Gray order.  A run of neighbours in that order
agrees on many bits; those bits (a mask and a pattern) are factored into an
upper node, and again for runs of nodes.  A search goes down from the top and
adds up the differing bits of each node's own mask; once a sum is over the limit
the whole run below is passed over.

Distribution: the bits are cut into one part more than ``max_distance``.  Two linked
fingerprints agree on a whole part, so for each part there is a Gray order that has its
bits first, cut into runs by common prefix, chosen from at most ``COUNTS`` counts in all.  A
fingerprint is sent to its own run of each order and to no other, however many runs
there are.  A run that the prefixes can't split is a group of a next level: its
fingerprints can differ in the other bits only, which are cut into parts again.  Runs
that no bits are left to split are split by hash into pieces of about ``RUN_SIZE``, and
what visits them into shares of about ``VISITORS``; a task searches one run or piece,
with its own lower levels.
A task keeps a spanning forest of the links it finds, not all pairs
(a fingerprint has at most 2,080 others within two bits, so the pairs it looks
at are bounded too), and the forests are joined by ``connected_components``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import by_batch, checkpointed, ddl
from plumbline.llm.components import Forest, connected_components

SEED = 42
SHINGLE_WORDS = 3
MAX_DISTANCE = 2
#: Depth of the prefixes that are counted for the cut, and fingerprints aimed at in a run.
CUT_BITS, RUN_SIZE = 16, 8192
#: Prefixes that are counted for all cuts of a level.
COUNTS = 1 << 18
#: Fingerprints of other runs or pieces aimed at in a task.
VISITORS = 2 * RUN_SIZE
FANOUT = 8
_CHUNK, _ROUTED = 50_000, 10_000
_ALL, _MASK = np.uint64(0xFFFFFFFFFFFFFFFF), (1 << 64) - 1


def shingle_hashes(text: str | None, words_each: int) -> Iterator[np.ndarray]:
    """Hashes of all word shingles of a whole text, in parts; of all its words where it has fewer."""
    words = (text or "").encode("utf-8").lower().split()
    n = len(words)
    if n == 0:
        return
    width = min(words_each, n)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: n - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(first), _CHUNK):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + _CHUNK], last[at : at + _CHUNK])], "<u8")


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a whole text; 0 without words."""
    n, ones = 0, np.zeros(64, np.int64)
    for h in shingle_hashes(text, SHINGLE_WORDS):
        n += len(h)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint16)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Local levels of the index over a sorted array of distinct fingerprints."""

    def __init__(self, codes: np.ndarray):
        order = np.argsort(gray_rank(codes), kind="stable")
        self.codes = codes[order]
        masks = [np.full(len(codes), _ALL, np.uint64)]
        patterns = [self.codes]
        while len(masks[-1]) > FANOUT:
            m, p = masks[-1], patterns[-1]
            at = np.arange(0, len(m), FANOUT)
            both, any_ = np.bitwise_and.reduceat(p, at), np.bitwise_or.reduceat(p, at)
            shared = np.bitwise_and.reduceat(m, at) & ~(both ^ any_)
            masks.append(shared)
            patterns.append(both & shared)
        for level in range(len(masks) - 1):  # what the parent already compares isn't compared again
            masks[level] = masks[level] & ~masks[level + 1][np.arange(len(masks[level])) // FANOUT]
        self.masks, self.patterns = masks, patterns

    def search(self, queries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(query index, code index) of all pairs at ``limit`` or fewer differing bits."""
        top = len(self.masks[-1])
        q = np.repeat(np.arange(len(queries)), top)
        node = np.tile(np.arange(top), len(queries))
        apart = np.zeros(len(q), np.uint8)
        for level in range(len(self.masks) - 1, -1, -1):
            apart = apart + np.bitwise_count((queries[q] ^ self.patterns[level][node]) & self.masks[level][node])
            near = np.flatnonzero(apart <= limit)
            q, node, apart = q[near], node[near], apart[near]
            if level:
                below = len(self.masks[level - 1])
                q, apart = np.repeat(q, FANOUT), np.repeat(apart, FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                real = np.flatnonzero(node < below)
                q, node, apart = q[real], node[real], apart[real]
        return q, node


def spanning_links(home: np.ndarray, visitors: np.ndarray, limit: int, inside: bool = True) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among ``home`` (if ``inside``) and from ``visitors`` to ``home``."""
    left: list[int] = []
    right: list[int] = []
    if not len(home):
        return left, right
    index, forest = GrayIndex(home), Forest()
    for side in (index.codes, visitors) if inside else (visitors,):
        for at in range(0, len(side), 2048):
            part = side[at : at + 2048]
            q, t = index.search(part, limit)
            if side is index.codes:
                later = t > q + at
                q, t = q[later], t[later]
            for a, b in zip(part[q].tolist(), index.codes[t].tolist()):
                if forest.join(a, b):
                    left.append(a)
                    right.append(b)
    return left, right


def cut_runs(counts: dict[int, int], bits: int, run_size: int) -> list[tuple[int, int]]:
    """(prefix, depth) of runs in Gray order: split by a bit while over ``run_size``."""
    levels = [counts]
    for _ in range(bits):
        above: dict[int, int] = {}
        for k, n in levels[-1].items():
            above[k >> 1] = above.get(k >> 1, 0) + n
        levels.append(above)
    levels.reverse()  # levels[d]: prefix of d bits -> fingerprints
    runs, todo = [], [(0, 0)]
    while todo:
        prefix, depth = todo.pop()
        if not (n := levels[depth].get(prefix, 0)):
            continue
        if n <= run_size or depth == bits:
            runs.append((prefix, depth))
        else:  # the half that comes first in Gray order is taken from the stack first
            odd = bin(prefix).count("1") & 1
            todo += [((prefix << 1) | (1 - odd), depth + 1), ((prefix << 1) | odd, depth + 1)]
    return runs


def _ramp(n: np.ndarray) -> np.ndarray:
    """0..n-1 for each n, one after the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class Router:
    """Which tasks (run, piece, share) a fingerprint is sent to."""

    def __init__(self, runs: list[tuple[int, int]], counts: dict[int, int], limit: int, bits: int, run_size: int, visitors: int):
        self.bits = np.uint64(64 - bits)
        self.run_of = np.full(1 << bits, -1, np.int32)
        for k, (prefix, depth) in enumerate(runs):
            self.run_of[prefix << (bits - depth) : (prefix + 1) << (bits - depth)] = k
        flips = [0]
        for _ in range(limit):
            flips = sorted({f ^ bit for f in flips for bit in (0, *(1 << b for b in range(bits)))})
        self.flips = np.array(flips, np.int64)
        prefixes, weights = np.array(list(counts), np.int64), np.array(list(counts.values()), np.int64)
        q, run, own = self._runs(prefixes)
        total = lambda which: np.bincount(run[which], weights[q[which]], len(runs))
        self.pieces = np.maximum(1, np.ceil(total(own) / run_size)).astype(np.int64)
        self.shares = np.maximum(1, np.ceil((total(~own) + total(own) * (self.pieces > 1)) / visitors)).astype(np.int64)

    def _runs(self, prefixes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the prefix, run, whether it is its own) for its own and later runs within the limit, each once."""
        home = self.run_of[prefixes]
        found = np.sort(self.run_of[prefixes[:, None] ^ self.flips], axis=1)
        once = np.diff(found, axis=1, prepend=np.int32(-2)) != 0
        q, at = np.nonzero(once & (found >= home[:, None]))
        run = found[q, at]
        return q, run, run == home[q]

    def route(self, codes: np.ndarray, prefixes: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Where codes go by their ``prefixes``, those of their highest bits if none are given."""
        q, run, own = self._runs((codes >> self.bits).astype(np.int64) if prefixes is None else prefixes)
        code = codes[q]
        h = ((code ^ (code >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        piece, share = h.astype(np.int64) % self.pieces[run], (h.astype(np.int64) // 7919) % self.shares[run]
        parts = []
        for which, n, fixed in (
            (own, self.shares, "own"),  # to its own piece, once for each share of visitors
            (own, None, "before"),  # as a visitor to the pieces of its run before its own
            (~own, self.pieces, "visit"),  # to all pieces of another run
        ):
            r, c, p, x = run[which], code[which], piece[which], share[which]
            times = p if n is None else n[r]
            step = _ramp(times)
            r, c, p, x = (np.repeat(v, times) for v in (r, c, p, x))
            parts.append((r, p if fixed == "own" else step, step if fixed == "own" else x, c, np.full(len(r), fixed == "own")))
        r, p, x, c, o = (np.concatenate(v) for v in zip(*parts))
        return {"run": r.astype(np.int32), "piece": p.astype(np.int32), "share": x.astype(np.int32), "code": c.view(np.int64), "own": o}


def prefix_of(codes: np.ndarray, places: tuple[int, ...]) -> np.ndarray:
    """The bits of each code at ``places``, the first one highest."""
    out = np.zeros(len(codes), np.int64)
    for place in places:
        out = out << 1 | (codes >> np.uint64(place) & np.uint64(1)).astype(np.int64)
    return out


def varying(free: list[tuple[int, ...]], differ: dict[int, int]) -> list[tuple[int, ...]]:
    """What is left of each group's free bits without those that are equal in all its codes."""
    return [tuple(b for b in own if differ.get(g, 0) >> b & 1) for g, own in enumerate(free)]


class Level:
    """Orders of groups of codes by parts of the bits in which the codes of a group can differ (``free``)."""

    def __init__(self, free: list[tuple[int, ...]], limit: int, bits: int):
        self.free, self.orders = free, limit + 1
        self.bits = max(1, min(bits, (COUNTS // (self.orders * len(free))).bit_length() - 1))
        cuts = [[len(f) * k // self.orders for k in range(self.orders + 1)] for f in free]
        #: By group and order: the places of its prefixes.
        self.places = [[f[a:b][: self.bits] for a, b in zip(c, c[1:])] for f, c in zip(free, cuts)]
        self.routers: list[list[Router]] = []
        #: By group and order: the number of the first run, and for each run its group in the next level, else -1.
        self.first: list[list[int]] = []
        self.below: list[list[np.ndarray]] = []

    def orders_of(self, batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(group, order, codes, prefixes) of a batch of (group, code)."""
        group, codes = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        for g in np.unique(group).tolist():
            own = codes[group == g]
            for k, places in enumerate(self.places[g]):
                yield g, k, own, prefix_of(own, places)

    def count(self, rows: DataFrame) -> dict[tuple[int, int], dict[int, int]]:
        """Codes by prefix, by group and order."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros((len(self.free) * self.orders) << self.bits, np.int64)
            for batch in batches:
                for g, k, _, prefixes in self.orders_of(batch):
                    at = (g * self.orders + k) << self.bits
                    n[at : at + (1 << self.bits)] += np.bincount(prefixes, minlength=1 << self.bits)
            cell = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"cell": cell, "n": n[cell]})

        got = rows.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # COUNTS rows, or two a group and order
        out: dict[tuple[int, int], dict[int, int]] = {(g, k): {} for g in range(len(self.free)) for k in range(self.orders)}
        for cell, n in zip(got.column("cell").to_pylist(), got.column("n").to_pylist()):
            out[divmod(cell >> self.bits, self.orders)][cell & ((1 << self.bits) - 1)] = n
        return out

    def cut(self, counts: dict[tuple[int, int], dict[int, int]], first: int, run_size: int, visitors: int) -> tuple[int, list[tuple[int, ...]]]:
        """Cuts all orders into runs numbered from ``first``; (the next number, free bits of the groups of the next level)."""
        groups: list[tuple[int, ...]] = []
        for g, free in enumerate(self.free):
            rows: tuple[list, list, list] = ([], [], [])
            for k, places in enumerate(self.places[g]):
                runs = cut_runs(counts[g, k], len(places), run_size)
                router = Router(runs, counts[g, k], 0, len(places), run_size, visitors)
                rest = tuple(b for b in free if b not in places)
                below = np.full(len(runs), -1, np.int64)
                if places and rest:
                    over = np.flatnonzero(router.shares + router.pieces / 2 > self.orders**2)
                    below[over] = len(groups) + np.arange(len(over))
                    groups += [rest] * len(over)
                for own, x in zip(rows, (router, first, below)):
                    own.append(x)
                first += len(runs)
            for all_rows, own in zip((self.routers, self.first, self.below), rows):
                all_rows.append(own)
        return first, groups

    def sent(self, batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        """What goes to the tasks."""
        parts = []
        for g, k, codes, prefixes in self.orders_of(batch):
            router = self.routers[g][k]
            stay = self.below[g][k][router.run_of[prefixes]] < 0
            to = router.route(codes[stay], prefixes[stay])
            parts.append(to | {"run": to["run"] + np.int32(self.first[g][k])})
        return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}

    def passed(self, batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        """(group, code) of the next level."""
        found = [(self.below[g][k][self.routers[g][k].run_of[prefixes]], codes) for g, k, codes, prefixes in self.orders_of(batch)]
        group, code = (np.concatenate(x) for x in zip(*found))
        return {"group": group[group >= 0], "code": code[group >= 0].view(np.int64)}


def fingerprint_links(distinct: DataFrame, code: str, limit: int = MAX_DISTANCE, run_size: int = RUN_SIZE, bits: int = CUT_BITS, visitors: int = VISITORS) -> DataFrame:
    """Links (u, v) that connect all distinct codes within ``limit`` bits of each other.

    ``code`` is a column of distinct signed 64-bit values.  The links are a union
    of spanning forests: two codes are connected by them exactly if they are by
    all links.
    """
    schema = "u long, v long"
    rows = distinct.select(F.lit(0).cast("long").alias("group"), F.col(code).alias("code"))
    groups, first, parts = [tuple(range(63, -1, -1))], 0, []
    while groups:
        spread = rows.groupBy("group").agg(F.bit_and("code"), F.bit_or("code")).collect()  # a row a group
        level = Level(varying(groups, {g: (same & _MASK) ^ (some & _MASK) for g, same, some in spread}), limit, bits)
        first, groups = level.cut(level.count(rows), first, run_size, visitors)
        parts.append(by_batch(rows, lambda level=level: level.sent, "run int, piece int, share int, code long, own boolean"))
        if groups:
            rows = checkpointed(by_batch(rows, lambda level=level: level.passed, "group long, code long"))
    if not first:
        return distinct.sparkSession.createDataFrame([], schema)
    routed = reduce(DataFrame.unionAll, parts)

    def search(key: tuple, group: pa.Table) -> pa.Table:
        codes = group.column("code").to_numpy().view(np.uint64)
        own = group.column("own").to_numpy(zero_copy_only=False).astype(bool)
        u, v = spanning_links(codes[own], codes[~own], limit, key[2].as_py() == 0)
        return pa.table({"u": np.array(u, np.uint64).view(np.int64), "v": np.array(v, np.uint64).view(np.int64)})

    return routed.groupBy("run", "piece", "share").applyInArrow(search, schema)


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and the signed 64-bit fingerprint of every row's whole text."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            out = {c: batch.column(i) for i, c in enumerate(keep)}
            values = [fingerprint(x.as_py()) for x in batch.column(len(keep))]
            return out | {name: np.array(values, np.uint64).view(np.int64)}

        return work

    own = ddl(docs, *keep)
    return by_batch(docs.select(*keep, text), make, f"{own}{', ' if own else ''}`{name}` long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", limit: int = MAX_DISTANCE, more: DataFrame | None = None) -> DataFrame:
    """One row for each input row: ``id_col``, ``fingerprint`` (16 hex digits), ``component_id``.

    component_id is the smallest id among the rows that fingerprint links reach,
    the row itself included.  Null, empty and blank texts have fingerprint zero
    and are linked like any other; equal texts always share a component; rows
    that repeat an id each get a row; a null id gets a row and never becomes a
    component_id unless a component has no other.  Other columns are ignored; an
    empty table gives an empty one.
    ``more`` holds further links (u, v) between fingerprints.
    """
    code, least = "_code", "_least"
    rows = checkpointed(fingerprints(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")), "_text", code, ("_id",)))
    nodes = checkpointed(rows.groupBy(code).agg(F.min("_id").alias(least)))
    links = fingerprint_links(nodes, code, limit)
    parts = connected_components(links if more is None else links.unionAll(more))
    parts = nodes.join(parts, nodes[code] == parts.node).select(code, "root", least)
    groups = checkpointed(parts)
    lowest = groups.groupBy("root").agg(F.min(least).alias("_low")).withColumnRenamed("root", "_root")
    linked = groups.join(lowest, groups.root == lowest._root).select(F.col(code).alias("_c"), "_low")
    named = checkpointed(nodes.join(linked, nodes[code] == F.col("_c"), "left").select(F.col(code).alias("_c"), F.coalesce("_low", least).alias("_component")))
    joined = rows.join(named, rows[code] == named._c)
    return joined.select(
        F.col("_id").alias(id_col),
        F.lower(F.lpad(F.hex(code), 16, "0")).alias("fingerprint"),
        F.col("_component").alias("component_id"),
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", limit: int = MAX_DISTANCE, more: DataFrame | None = None) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: that of its component_id.

    All columns stay.  Rows that repeat an id count as copies of each other, so
    one stays; rows with a null id have no name to be dropped by and stay.
    """
    found = checkpointed(simhash_components(docs, id_col, text, limit, more))
    gone = found.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct()
    left = docs.join(gone, docs[id_col] == gone._gone, "left_anti")
    again = found.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").select(F.col(id_col).alias("_again"))
    again = checkpointed(again)
    if again.isEmpty():
        return left
    once = left.join(again, left[id_col] == again._again, "left_anti")
    first = left.join(again, left[id_col] == again._again, "left_semi").dropDuplicates([id_col])
    return once.unionByName(first)
