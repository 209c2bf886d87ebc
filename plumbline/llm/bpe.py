"""Byte-level BPE encoding and decoding by monoid tree reduction.

A piece is halved until its parts are small, the parts are encoded by plain
merging, and neighbours are joined on the way up.  A token sequence is the
encoding of its bytes exactly if each two neighbouring tokens are the encoding of
their own joined bytes, so a join only has to mend the seam: the tokens next to it
are encoded anew, and the window grows on either side until its outermost token
and the first token outside agree.  From there on nothing outside can change.

Decoding joins the bytes of halves up the tree.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import islice
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import by_batch, ddl

RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Bytes of a part that plain merging encodes; ids of a part that decoding joins at once.
LEAF_BYTES, LEAF_IDS = 5, 1 << 16
#: Largest rank file that is sent to the executors, and cached pieces a worker holds.
RANK_FILE_LIMIT, CACHE_PIECES = 16 << 20, 400_000
#: Parts up to this many bytes are remembered.
PART_BYTES = 8


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """token bytes -> rank of a file with a base64 token and a rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}


class TreeBpe:
    """Encoder and decoder over one table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self._seams: dict[tuple[int, int], list[int]] = {}
        self._parts: dict[bytes, list[int]] = {}
        known = [self.tokens.get(i, b"") for i in range(max(self.tokens, default=-1) + 1)]
        self._sizes = np.array([len(x) for x in known], np.int64)
        self._begins = np.cumsum(self._sizes) - self._sizes
        self._bytes = np.frombuffer(b"".join(known), np.uint8)

    def merge(self, data: bytes) -> list[int]:
        """Plain merging: the pair of least rank first, the left one on a tie."""
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        worst = len(ranks)
        costs = [ranks.get(a + b, worst) for a, b in zip(parts, parts[1:])]
        while costs:
            low = min(costs)
            if low == worst:
                break
            i = costs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i < len(costs):
                costs[i] = ranks.get(parts[i] + parts[i + 1], worst)
            if i:
                costs[i - 1] = ranks.get(parts[i - 1] + parts[i], worst)
        return [ranks[p] for p in parts]

    def seam(self, a: int, b: int) -> list[int]:
        """Encoding of the bytes of two tokens side by side; [a, b] where they agree."""
        known = self._seams.get((a, b))
        if known is None:
            if len(self._seams) >= CACHE_PIECES:
                self._seams.clear()
            known = self._seams[a, b] = self.merge(self.tokens[a] + self.tokens[b])
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the joined bytes of two encodings."""
        if not left or not right:
            return left + right
        i = j = 1
        window = self.seam(left[-1], right[0])
        while True:
            grow_left = i < len(left) and self.seam(left[-i - 1], window[0]) != [left[-i - 1], window[0]]
            grow_right = j < len(right) and self.seam(window[-1], right[j]) != [window[-1], right[j]]
            if not grow_left and not grow_right:
                return left[: len(left) - i] + window + right[j:]
            i = min(len(left), i * 2) if grow_left else i
            j = min(len(right), j * 2) if grow_right else j
            window = self.merge(b"".join(map(self.tokens.__getitem__, left[-i:] + right[:j])))

    def tree(self, data: bytes) -> list[int]:
        known = self._parts.get(data)
        if known is None:
            if len(data) <= LEAF_BYTES:
                known = self.merge(data)
            else:
                mid = len(data) // 2
                known = self.join(self.tree(data[:mid]), self.tree(data[mid:]))
            if len(data) <= PART_BYTES:
                if len(self._parts) >= CACHE_PIECES:
                    self._parts.clear()
                self._parts[data] = known
        return known

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece; a piece that is itself a token is that token."""
        whole = self.ranks.get(piece)
        return self.tree(piece) if whole is None else [whole]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of an array of ids."""
        if len(ids) <= LEAF_IDS:
            sizes = self._sizes[ids]
            ends = np.cumsum(sizes)
            shift = np.repeat(self._begins[ids] - (ends - sizes), sizes)
            return self._bytes[shift + np.arange(len(shift))].tobytes()
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


class PackedPieces(dict):
    """piece text -> its ids as packed little-endian 32-bit integers, computed when first asked for."""

    def __init__(self, bpe: TreeBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        packed = np.array(self.bpe.encode(piece.encode("utf-8")), "<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = packed
        return packed


class SpacedChunks(dict):
    """chunk -> packed ids of the chunk with one space before it.

    A space with no white space on either side always begins a match of the
    pattern, so what stands between two such spaces can be encoded by itself and
    remembered.  None for a chunk that white space begins or ends, or an empty one:
    its spaces are no such seams.
    """

    def __init__(self, pieces: PackedPieces, pattern: regex.Pattern):
        super().__init__()
        self.pieces, self.pattern = pieces, pattern

    def __missing__(self, chunk: str) -> bytes | None:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return None
        packed = b"".join(map(self.pieces.__getitem__, self.pattern.findall(f" {chunk}")))
        if len(self) >= CACHE_PIECES:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = packed
        return packed


class TextPacker:
    """Packed ids of whole texts: each match of the pattern by itself."""

    #: Longer texts are matched piece by piece, so that no list of all pieces is held.
    AT_ONCE = 1 << 22

    def __init__(self, data: bytes, pattern: str):
        self.bpe = TreeBpe(parse_ranks(data))
        self.pattern = regex.compile(pattern)
        self.pieces = PackedPieces(self.bpe)
        self.chunks = SpacedChunks(self.pieces, self.pattern)
        #: The seams are known for this pattern only.
        self.seams = pattern == public_tokenizers.PATTERN

    def matched(self, text: str) -> bytes:
        found, out = self.pattern.finditer(text), []
        while part := [m.group() for m in islice(found, 100_000)]:
            out.append(b"".join(map(self.pieces.__getitem__, part)))
        return b"".join(out)

    def pack(self, text: str) -> bytes:
        if not self.seams or len(text) > self.AT_ONCE:
            return self.matched(text)
        first, *rest = text.split(" ")
        if not rest or not first or first[-1].isspace() or not rest[-1] or rest[-1][0].isspace():
            return self.matched(text)
        try:
            inner = b"".join(map(self.chunks.__getitem__, rest[:-1]))
        except TypeError:  # a None: some space is no seam
            return self.matched(text)
        return self.matched(first) + inner + self.matched(f" {rest[-1]}")


_workers: dict[tuple[bytes, str], TextPacker] = {}


def _worker(data: bytes, pattern: str) -> TextPacker:
    key = (hashlib.sha256(data).digest(), pattern)
    if key not in _workers:
        _workers.clear()
        _workers[key] = TextPacker(data, pattern)
    return _workers[key]


def _shared(docs: DataFrame, rank_file: str):
    data = Path(rank_file).read_bytes()
    if len(data) > RANK_FILE_LIMIT:
        raise ValueError(f"{rank_file} has {len(data)} bytes; at most {RANK_FILE_LIMIT} are sent to the executors")
    return docs.sparkSession.sparkContext.broadcast(data)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rank_file: str = RANK_FILE, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``id_col``, ``ids`` (array<int>) and ``decoded`` (binary) of each whole text.

    A null or empty text has no ids and decodes to no bytes.  Repeated ids and
    texts each give a row; other columns are ignored; an empty table gives an empty one.
    """
    shared = _shared(docs, rank_file)

    def make():
        packer = _worker(shared.value, pattern)

        def work(batch: pa.RecordBatch) -> dict:
            ids = [np.frombuffer(packer.pack(x.as_py() or ""), "<i4") for x in batch.column(1)]
            return {"id": batch.column(0), "ids": [x.tolist() for x in ids], "decoded": [packer.bpe.decode(x) for x in ids]}

        return work

    out = by_batch(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), make, f"{ddl(docs.select(F.col(id_col).alias('id')), 'id')}, ids array<int>, decoded binary")
    return out.withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rank_file: str = RANK_FILE, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``id_col``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each whole text.

    The same encoding as ``encode_documents`` with only digests leaving the
    worker: ids as little-endian unsigned 32-bit integers, and the decoded bytes.
    """
    shared = _shared(docs, rank_file)

    def make():
        packer = _worker(shared.value, pattern)

        def work(batch: pa.RecordBatch) -> dict:
            out: dict = {"id": batch.column(0), "n": [], "a": [], "b": []}
            for x in batch.column(1):
                packed = packer.pack(x.as_py() or "")
                out["n"].append(len(packed) // 4)
                out["a"].append(hashlib.sha256(packed).hexdigest())
                out["b"].append(hashlib.sha256(packer.bpe.decode(np.frombuffer(packed, "<u4"))).hexdigest())
            return out

        return work

    source = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    out = by_batch(source, make, f"{ddl(source, 'id')}, n long, a string, b string")
    return out.toDF(id_col, "n_tokens", "ids_sha256", "decoded_sha256")
