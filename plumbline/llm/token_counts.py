"""Token counts of a unigram model by trie-shared dynamic programming.

The distinct pre-tokens that a batch brings are put in a trie and the forward scores
of the unigram model - the best log-probability of a segmentation of the prefix, and
its number of tokens - are computed once for each trie node, so a prefix that many
pre-tokens share costs once.  All nodes of a depth are computed together, as arrays;
the few pre-tokens over ``LEVELS`` bytes are walked one after the other in sorted order,
which visits their trie depth first.  The count at each pre-token's terminal is stored,
those of chunks are remembered; a text's count is a sum of lookups.

The vocabulary is that of a public tokenizer and stays as it is; the model's scores are
learned from the corpus.  One pass counts the distinct pre-tokens of all texts; then,
from scores that follow a Zipf law over the vocabulary's ranks, ``ROUNDS`` rounds of
hard expectation maximisation over the distinct pre-tokens: each is segmented, the
tokens are counted with the pre-token's weight, and a token's score becomes the
logarithm of its share (plus one for each token).  Counts are whole numbers, so the
order of the sums doesn't matter.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bpe import CACHE_PIECES, RANK_FILE, RANK_FILE_LIMIT, parse_ranks
from plumbline.llm.common import by_batch, checkpointed, ddl

ZIPF_SHIFT, ROUNDS = 2.7, 2
#: Bytes of texts that are cut at once, and distinct chunks (of as many bytes) that are split at once.
TEXT_BYTES, CHUNKS = 8 << 20, 100_000
#: Bytes of a pre-token up to which its trie is computed by depth.
LEVELS = 64


def zipf_scores(ranks: dict[bytes, int]) -> dict[int, float]:
    """Log-probabilities by rank that the first round starts from."""
    total = math.log(sum(1 / (r + ZIPF_SHIFT) for r in ranks.values())) if ranks else 0.0
    return {r: -math.log(r + ZIPF_SHIFT) - total for r in ranks.values()}


def scores_of(counts: dict[int, int], ranks: dict[bytes, int]) -> dict[int, float]:
    """Log-probabilities by rank from counts of tokens, one added to each."""
    total = math.log(sum(counts.values()) + len(ranks)) if ranks else 0.0
    return {r: math.log(counts.get(r, 0) + 1) - total for r in ranks.values()}


class StepTable:
    """Steps between the vocabulary's nodes as a hash table with linear probing, for many lookups at once."""

    _MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, steps: dict[int, int]):
        bits = max(4, (4 * len(steps)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.nodes = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        keys, nodes = np.fromiter(steps.keys(), np.int64, len(steps)), np.fromiter(steps.values(), np.int32, len(steps))
        slots = self._slots(keys)
        while len(keys):
            self.keys[slots] = np.where(self.keys[slots] < 0, keys, self.keys[slots])  # of several keys for a slot one stays
            put = self.keys[slots] == keys
            self.nodes[slots[put]] = nodes[put]
            keys, nodes, slots = keys[~put], nodes[~put], (slots[~put] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * self._MIX >> self.shift).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Node that each key (node << 8 | byte) leads to, or -1."""
        slots = self._slots(keys)
        there = self.keys[slots]
        out = np.where(there == keys, self.nodes[slots], np.int32(-1))
        rest = np.flatnonzero((there != keys) & (there >= 0))
        while len(rest):
            slots[rest] = (slots[rest] + 1) & self.mask
            there = self.keys[slots[rest]]
            hit = there == keys[rest]
            out[rest[hit]] = self.nodes[slots[rest[hit]]]
            rest = rest[~hit & (there >= 0)]
        return out


def _first_of_runs(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it."""
    return np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]])


class Levels:
    """Forward pass over the trie of sorted distinct pieces, all nodes of a depth at once.

    Nodes are numbered by depth: ``score`` (-inf where the vocabulary can't spell the prefix), ``size`` (tokens), ``back``
    (the node before the last token) and ``token`` (the vocabulary's node of that) of the best segmentation of each node;
    ``ends`` has the node of each piece, ``bounds`` the nodes of each depth.
    """

    def __init__(self, trie: UnigramTrie, pieces: pa.Array):
        lengths = pc.binary_length(pieces).to_numpy().astype(np.int64)
        begins, data = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(pieces.to_pylist()), np.uint8)
        self.score = np.full(1 + lengths.sum(), -math.inf)
        self.size, self.back, self.token = (np.zeros(len(self.score), np.int32) for _ in range(3))
        self.score[0] = 0.0
        self.ends, self.bounds = np.zeros(len(pieces), np.int64), [0, 1]
        active = np.flatnonzero(lengths)
        # of each node of the last depth: the vocabulary's nodes that go on, by the node they began after, the first of those first
        live, firsts, began, at = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int32), np.zeros(1, np.int32)
        while len(active):
            low, high = self.bounds[-2:]
            up, byte = self.ends[active], data[begins[active] + len(self.bounds) - 2]
            new = _first_of_runs(up << 8 | byte)
            self.ends[active] = high + np.cumsum(new) - 1
            up, byte = up[new], byte[new].astype(np.int64)
            parent = up - low
            widths = live[parent] + 1  # those of the parent, then one that begins after it
            stops = np.cumsum(widths)
            owner = np.repeat(np.arange(len(up)), widths)
            source = np.arange(len(owner)) + np.repeat(firsts[parent] - stops + widths, widths)
            began, at = began[source], at[source]
            began[stops - 1], at[stops - 1] = up, 0
            at = trie.steps.find(at.astype(np.int64) << 8 | byte[owner])
            found = np.flatnonzero(at >= 0)
            owner, began, at = owner[found], began[found], at[found]
            self._choose(trie, high + owner, began, at)
            live = np.bincount(owner, minlength=len(up))
            firsts = np.cumsum(live) - live
            began, at = np.append(began, np.int32(0)), np.append(at, np.int32(0))  # so that the place after the last one is there
            self.bounds.append(high + len(up))
            active = active[lengths[active] > len(self.bounds) - 2]

    def _choose(self, trie: UnigramTrie, node: np.ndarray, began: np.ndarray, at: np.ndarray) -> None:
        """The best of each node's last tokens: highest score, then fewest tokens, then the longest one."""
        own = trie.node_scores[at]
        tokens = np.flatnonzero(own > -math.inf)
        if not len(tokens):
            return
        node, began, at = node[tokens], began[tokens], at[tokens]
        score, size = self.score[began] + own[tokens], self.size[began] + 1
        run = _first_of_runs(node)
        starts, group = np.flatnonzero(run), np.cumsum(run) - 1
        top = np.maximum.reduceat(score, starts)
        size[score < top[group]] = np.iinfo(np.int32).max
        least = np.minimum.reduceat(size, starts)
        best = np.flatnonzero(size == least[group])
        best = best[_first_of_runs(group[best])]
        node = node[starts]
        self.score[node], self.size[node], self.back[node], self.token[node] = top, least, began[best], at[best]


class UnigramTrie:
    """The vocabulary as a trie, and the forward pass over a trie of pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], scores: dict[int, float]):
        self.next: dict[int, int] = {}
        self.score: dict[int, float] = {}
        self.rank: dict[int, int] = {}
        for token, rank in ranks.items():
            node = 0
            for b in token:
                key = node << 8 | b
                node = self.next.setdefault(key, len(self.next) + 1)
            self.score[node], self.rank[node] = scores[rank], rank
        self.steps = StepTable(self.next)
        self.node_scores, self.node_ranks = np.full(len(self.next) + 1, -math.inf), np.zeros(len(self.next) + 1, np.int64)
        known = np.fromiter(self.score, np.int64, len(self.score))
        self.node_scores[known], self.node_ranks[known] = list(self.score.values()), list(self.rank.values())

    def forward(self, pieces: Iterable[bytes]) -> Iterator[tuple[bytes, list[tuple[float, int, int, int]]]]:
        """(piece, by depth: best score, minus its tokens, minus where its last token begins, that token's node) in sorted order.

        On a tie of scores the segmentation with fewer tokens is best, then the one whose last token is longer.  The
        list is changed by the next step.
        """
        step, score = self.next.get, self.score
        best = [(0.0, 0, 0, 0)]
        live: list[list[tuple[int, int]]] = [[]]  # by depth: vocabulary nodes that go on, with the depth they began at
        before = b""
        for piece in sorted(set(pieces)):
            depth, most = 0, min(len(before), len(piece))
            while depth < most and before[depth] == piece[depth]:
                depth += 1
            del best[depth + 1 :], live[depth + 1 :]
            for d in range(depth, len(piece)):
                b, here, top = piece[d], [], (-math.inf, 0, 0, 0)
                for start, node in (*live[d], (d, 0)):
                    if (node := step(node << 8 | b)) is not None:
                        here.append((start, node))
                        if (own := score.get(node)) is not None:
                            so_far = best[start]
                            top = max(top, (so_far[0] + own, so_far[1] - 1, -start, node))
                best.append(top)
                live.append(here)
            before = piece
            yield piece, best

    @staticmethod
    def _parted(pieces: pa.Array) -> tuple[np.ndarray, pa.Array, dict[bytes, int]]:
        """(places of the shorter pieces in sorted order, those pieces, places of the longer ones)."""
        pieces = pieces.cast(pa.binary())
        longer = pc.greater(pc.binary_length(pieces), LEVELS).to_numpy(zero_copy_only=False)
        order, rest = pc.array_sort_indices(pieces).to_numpy(), np.flatnonzero(longer)
        order = order[~longer[order]]
        return order, pieces.take(pa.array(order)), dict(zip(pieces.take(pa.array(rest)).to_pylist(), rest.tolist()))

    def sizes(self, pieces: pa.Array) -> np.ndarray:
        """Tokens of the best segmentation of each of distinct pieces; 0 for one that the vocabulary can't spell."""
        order, short, longer = self._parted(pieces)
        out, levels = np.zeros(len(pieces), np.int64), Levels(self, short)
        out[order] = np.where(levels.score[levels.ends] > -math.inf, levels.size[levels.ends], 0)
        for piece, best in self.forward(longer):
            out[longer[piece]] = -best[-1][1] if best[-1][0] > -math.inf else 0
        return out

    def uses(self, pieces: pa.Array, weights: np.ndarray) -> Counter:
        """Tokens (by rank) of the best segmentations of distinct pieces, each with its piece's weight."""
        order, short, longer = self._parted(pieces)
        levels = Levels(self, short)
        flow, used = np.zeros(len(levels.score), np.int64), np.zeros(len(self.node_ranks), np.int64)
        flow[levels.ends] = weights[order]
        flow[levels.score == -math.inf] = 0
        for low, high in reversed(list(zip(levels.bounds[1:], levels.bounds[2:]))):
            nodes = low + np.flatnonzero(flow[low:high])
            np.add.at(used, levels.token[nodes], flow[nodes])
            np.add.at(flow, levels.back[nodes], flow[nodes])
        nodes = np.flatnonzero(used)
        out = Counter(dict(zip(self.node_ranks[nodes].tolist(), used[nodes].tolist())))
        for piece, best in self.forward(longer):
            at, weight = len(piece), int(weights[longer[piece]])
            while at and best[at][0] > -math.inf:
                _, _, start, node = best[at]
                out[self.rank[node]] += weight
                at = -start
        return out

    def counts(self, pieces: Iterable[bytes]) -> dict[bytes, int]:
        """``sizes`` by piece."""
        names = list(set(pieces))
        return dict(zip(names, self.sizes(pa.array(names, pa.binary())).tolist()))

    def usage(self, pieces: dict[bytes, int]) -> Counter:
        """``uses`` of pieces with their weights."""
        return self.uses(pa.array(list(pieces), pa.binary()), np.array(list(pieces.values()), np.int64))


class SpacedTexts:
    """Cuts texts at spaces where a match of the pattern always begins.

    A space without white space on either side is such a place, for this package's
    pattern; with another one a text stays whole.
    """

    AT_ONCE = 1 << 22
    _SEAM = regex.compile(r"(?<=\S) (?=\S)")

    def __init__(self, pattern: str):
        self.pattern, self.seams = regex.compile(pattern), pattern == public_tokenizers.PATTERN

    def cut(self, texts: list[str]) -> tuple[set[str], list[tuple[list[str], str]]]:
        """(distinct chunks; for each text its chunks, which stand for themselves with a space before, and what comes first)."""
        parted = [t.split(" ") if self.seams and len(t) <= self.AT_ONCE else [t] for t in texts]
        edges = set().union(*parted)
        bad = {c for c in edges if not c or c[0].isspace() or c[-1].isspace()}
        out, distinct = [], edges - bad
        for text, parts in zip(texts, parted):
            if len(parts) > 1 and not bad.isdisjoint(parts):  # some space is no seam
                parts = self._SEAM.split(text)
                distinct.update(parts[1:])
            out.append((parts[1:], parts[0]))
        return distinct, out

    def matches(self, text: str) -> Iterator[list[str]]:
        found = self.pattern.finditer(text)
        while part := [m.group() for m in islice(found, 100_000)]:
            yield part

    def parts(self, texts: pa.Array) -> tuple[list[tuple[pa.Array, np.ndarray, np.ndarray]], list[str]]:
        """``cut`` of many texts: (groups of distinct chunks, which of them stands at each place, that place's text; what comes first)."""
        if not self.seams:
            return [], texts.to_pylist()
        whole = pc.greater(pc.utf8_length(texts), self.AT_ONCE)
        split = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        begins = split.offsets.to_numpy()
        coded = split.values.dictionary_encode()
        distinct, which = coded.dictionary, coded.indices.to_numpy()
        trimmed = pc.binary_length(pc.utf8_trim_whitespace(distinct)).to_numpy()
        bad = (trimmed == 0) | (trimmed < pc.binary_length(distinct).to_numpy())
        other = np.logical_or.reduceat(bad[which], begins[:-1]) | whole.to_numpy(zero_copy_only=False)  # some space may be no seam
        firsts = distinct.take(pa.array(which[begins[:-1]])).to_pylist()
        text = np.repeat(np.arange(len(texts)), np.diff(begins))
        inner = ~other[text]
        inner[begins[:-1]] = False
        groups = [(distinct, which[inner], text[inner])]
        if other.any():
            places = np.flatnonzero(other)
            parted = self.cut(texts.take(pa.array(places)).to_pylist())[1]
            for k, (_, first) in zip(places.tolist(), parted):
                firsts[k] = first
            coded = pa.array(chain.from_iterable(chunks for chunks, _ in parted), pa.string()).dictionary_encode()
            groups.append((coded.dictionary, coded.indices.to_numpy(), np.repeat(places, [len(chunks) for chunks, _ in parted])))
        return groups, firsts

    def pieces(self, chunks: pa.Array) -> Iterator[tuple[int, int, pa.Array, np.ndarray]]:
        """(begin, end, pre-tokens of those chunks with a space before each, the chunk - from ``begin`` on - of each)."""
        find = self.pattern.findall
        at = 0
        for part in slices(chunks, CHUNKS):
            names = part.to_pylist()
            found = pa.array(find(" " + " ".join(names)), pa.string())
            begins = pc.starts_with(found, " ").to_numpy(zero_copy_only=False)
            owner = np.cumsum(begins) - 1
            if owner[-1] != len(names) - 1:  # some chunk has spaces of its own
                each = [find(f" {c}") for c in names]
                found, owner = pa.array(chain.from_iterable(each), pa.string()), np.repeat(np.arange(len(names)), [len(x) for x in each])
            yield at, at + len(names), found, owner
            at += len(names)


def slices(texts: pa.Array, most: int | None = None) -> Iterator[pa.Array]:
    """Neighbouring texts, ``most`` of them and of up to ``TEXT_BYTES`` bytes, or one; null as empty."""
    texts = pc.fill_null(texts, "")
    stops = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(stops, TEXT_BYTES + (stops[at - 1] if at else 0), "right")))
        end = min(end, at + most) if most else end
        yield texts.slice(at, end - at).cast(pa.string())
        at = end


def _summed(groups: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
    """Distinct values of all groups with the sums of their numbers."""
    coded = pa.concat_arrays([pa.array([], pa.string()), *(values for values, _ in groups)]).dictionary_encode()
    out = np.zeros(len(coded.dictionary), np.int64)
    np.add.at(out, coded.indices.to_numpy(), np.concatenate([np.zeros(0, np.int64), *(n for _, n in groups)]))
    return coded.dictionary, out


def piece_table(texts: SpacedTexts, batch: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct pre-tokens of texts with their number; each distinct chunk is split once."""
    chunks, found = [], []
    for part in slices(batch):
        groups, firsts = texts.parts(part)
        for distinct, which, _ in groups:
            n = np.bincount(which, minlength=len(distinct))
            used = np.flatnonzero(n)
            chunks.append((distinct.take(pa.array(used)), n[used]))
        own: Counter = Counter()
        for first in firsts:
            for some in texts.matches(first):
                own.update(some)
        found.append((pa.array(list(own), pa.string()), np.array(list(own.values()), np.int64)))
    distinct, n = _summed(chunks)
    for begin, end, pieces, owner in texts.pieces(distinct):
        found.append(_summed([(pieces, n[begin:end][owner])]))
    return _summed(found)


def piece_sums(texts: SpacedTexts, batch: list[str]) -> Counter:
    """``piece_table`` of a list."""
    pieces, n = piece_table(texts, pa.array(batch, pa.string()))
    return Counter(dict(zip(pieces.to_pylist(), n.tolist())))


class TextCounter:
    """(pre-tokens, tokens) of whole texts, batch by batch."""

    def __init__(self, ranks: dict[bytes, int], scores: dict[int, float], pattern: str):
        self.trie, self.texts = UnigramTrie(ranks, scores), SpacedTexts(pattern)
        self._forget()

    def _forget(self) -> None:
        self.chunks, self.known = pa.array([], pa.string()), np.zeros(0, np.int64)

    def _packed(self, pieces: pa.Array) -> np.ndarray:
        """1 << 32 | tokens of each of pre-tokens."""
        coded = pieces.dictionary_encode()
        return (1 << 32 | self.trie.sizes(coded.dictionary))[coded.indices.to_numpy()]

    def _whole(self, texts: list[str]) -> np.ndarray:
        """Packed counts of texts, matched from end to end."""
        out, some, owner = np.zeros(len(texts), np.int64), [], []

        def add() -> None:
            np.add.at(out, owner, self._packed(pa.array(some, pa.string())))
            some.clear()
            owner.clear()

        for k, text in enumerate(texts):
            for part in self.texts.matches(text):
                some += part
                owner += [k] * len(part)
                if len(some) >= CHUNKS:
                    add()
        if some:
            add()
        return out

    def _chunks(self, chunks: pa.Array) -> np.ndarray:
        """Packed counts of distinct chunks, remembered up to ``CACHE_PIECES``."""
        place = pc.fill_null(pc.index_in(chunks, value_set=self.chunks), -1).to_numpy()
        new = np.flatnonzero(place < 0)
        out = np.zeros(len(chunks), np.int64)
        if len(self.known):
            out = self.known[place]
        if len(new):
            names, found = chunks.take(pa.array(new)), np.zeros(len(new), np.int64)
            for begin, end, pieces, owner in self.texts.pieces(names):
                np.add.at(found[begin:end], owner, self._packed(pieces))
            out[new] = found
            if len(self.chunks) + len(names) > CACHE_PIECES:
                self._forget()
            self.chunks = pa.concat_arrays([self.chunks, names.slice(0, CACHE_PIECES)])
            self.known = np.concatenate([self.known, found[:CACHE_PIECES]])
        return out

    def packed(self, texts: pa.Array) -> np.ndarray:
        """pre-tokens << 32 | tokens of each text."""
        out = []
        for part in slices(texts):
            groups, firsts = self.texts.parts(part)
            totals = self._whole(firsts)
            for distinct, which, text in groups:
                values, used = np.zeros(len(distinct), np.int64), np.flatnonzero(np.bincount(which, minlength=len(distinct)))
                values[used] = self._chunks(distinct.take(pa.array(used)))
                sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(values[which])])
                totals += np.diff(sums[np.searchsorted(text, np.arange(len(part) + 1))])
            out.append(totals)
        return np.concatenate([np.zeros(0, np.int64), *out])

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        return [(n >> 32, n & 0xFFFFFFFF) for n in self.packed(pa.array(texts, pa.string())).tolist()]


def piece_counts(docs: DataFrame, text: str = "text", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(piece, n): the distinct pre-tokens of all whole texts; partial sums leave each batch."""

    def make():
        spaced = SpacedTexts(pattern)

        def work(batch: pa.RecordBatch) -> dict:
            piece, n = piece_table(spaced, batch.column(0))
            return {"piece": piece, "n": n}

        return work

    return by_batch(docs.select(F.col(f"`{text}`").alias("text")), make, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def _ranks_of(rank_file: str) -> bytes:
    data = Path(rank_file).read_bytes()
    if len(data) > RANK_FILE_LIMIT:
        raise ValueError(f"{rank_file} has {len(data)} bytes; at most {RANK_FILE_LIMIT} are sent to the executors")
    return data


def _packed(data: bytes, scores: dict[int, float]) -> tuple[bytes, bytes, bytes]:
    """A rank file and scores by rank as what is broadcast: the file and 16 bytes a rank."""
    order = sorted(scores)
    return data, np.array(order, "<i8").tobytes(), np.array([scores[r] for r in order], "<f8").tobytes()


def _unpacked(value: tuple[bytes, bytes, bytes]) -> tuple[dict[bytes, int], dict[int, float]]:
    data, ids, scores = value
    return parse_ranks(data), dict(zip(np.frombuffer(ids, "<i8").tolist(), np.frombuffer(scores, "<f8").tolist()))


#: What a worker keeps from task to task: the model of the last round, the counter of the last query.
_tries: dict[bytes, UnigramTrie] = {}
_workers: dict[tuple[bytes, str], TextCounter] = {}


def _kept(cache: dict, key: object, make: Callable[[], object]):
    """The one entry of a worker's cache, made anew where another key is asked for."""
    if key not in cache:
        cache.clear()
        cache[key] = make()
    return cache[key]


def learn_scores(docs: DataFrame, text: str = "text", rank_file: str = RANK_FILE, pattern: str = public_tokenizers.PATTERN, rounds: int = ROUNDS) -> dict[int, float]:
    """Scores by rank, learned from all texts; those of the Zipf law where there are none."""
    data = _ranks_of(rank_file)
    ranks = parse_ranks(data)
    scores = zipf_scores(ranks)
    pieces = checkpointed(piece_counts(docs, text, pattern).orderBy("piece"))  # neighbours share their prefixes
    context = docs.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast(_packed(data, scores))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            trie = _kept(_tries, hashlib.sha256(b"".join(shared.value)).digest(), lambda: UnigramTrie(*_unpacked(shared.value)))
            total: Counter = Counter()
            for batch in batches:
                total.update(trie.uses(batch.column(0), batch.column(1).to_numpy()))
            yield pa.RecordBatch.from_pydict({"token": pa.array(list(total), pa.int32()), "n": pa.array(list(total.values()), pa.int64())})

        got = pieces.mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()  # a row a token at most
        shared.destroy()
        if not got.num_rows:
            return scores
        scores = scores_of(dict(zip(got.column("token").to_pylist(), got.column("n").to_pylist())), ranks)
    return scores


def token_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rank_file: str = RANK_FILE, pattern: str = public_tokenizers.PATTERN, scores: dict[int, float] | None = None) -> DataFrame:
    """``id_col``, ``n_pretokens`` and ``n_tokens`` of each whole text, by ``scores`` (default: learned from ``docs``).

    A null or empty text has none; a pre-token that the vocabulary can't spell counts no
    tokens; repeated rows each give a row, and count each time where scores are learned;
    other columns are ignored; an empty table gives an empty one.
    """
    data = _ranks_of(rank_file)
    known = learn_scores(docs, text, rank_file, pattern) if scores is None else scores
    shared = docs.sparkSession.sparkContext.broadcast(_packed(data, known))

    def make():
        key = hashlib.sha256(b"".join(shared.value)).digest(), pattern
        counter = _kept(_workers, key, lambda: TextCounter(*_unpacked(shared.value), pattern))

        def work(batch: pa.RecordBatch) -> dict:
            found = counter.packed(batch.column(1))
            return {"id": batch.column(0), "a": found >> 32, "b": found & 0xFFFFFFFF}

        return work

    source = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return by_batch(source, make, f"{ddl(source, 'id')}, a long, b long").toDF(id_col, "n_pretokens", "n_tokens")
