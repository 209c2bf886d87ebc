import hashlib
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import bpe

DATA = open(bpe.RANK_FILE, "rb").read()
PACKER = bpe.TextPacker(DATA, public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=PACKER.bpe.ranks, special_tokens={})
PARTS = st.sampled_from(["a", " ", "  ", "\n", "\t", "'s", "'ll", "the", "tion", "é", "1", "½", ".", "!?", " ", "　", "漢", "_", "\x1c", "<|endoftext|>", "\U0001f600", "aaaa", "ing"])


def ids(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=25).map("".join) | st.text(max_size=40))
def test_texts_encode_as_the_library_does(text):
    packed = PACKER.pack(text)
    assert ids(packed) == LIBRARY.encode_ordinary(text)
    assert PACKER.bpe.decode(__import__("numpy").frombuffer(packed, "<u4")) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=1, max_size=120) | st.lists(st.sampled_from(["the", "tion", "a", "aa", "é", "qu", "ß"]), min_size=1, max_size=60).map(lambda x: "".join(x).encode()))
def test_tree_equals_plain_merging(data):
    assert PACKER.bpe.tree(data) == PACKER.bpe.merge(data)


@pytest.mark.parametrize("text", ["", None, "tionaeringthe" * 5000, "a" * 30_000, " ".join(["word"] * 5000)])
def test_long_texts(text):
    assert ids(PACKER.pack(text or "")) == LIBRARY.encode_ordinary(text or "")


def test_texts_that_are_matched_piece_by_piece(monkeypatch):
    monkeypatch.setattr(bpe.TextPacker, "AT_ONCE", 10)
    text = "It's a longer text, with  double spaces\nand lines. " * 50
    assert ids(PACKER.pack(text)) == LIBRARY.encode_ordinary(text)


def test_digests_of_awkward_documents(awkward):
    rows = {(r["doc_id"], r["text"]) for r in awkward.collect()}
    got = bpe.encode_digests(awkward).collect()
    assert len(got) == awkward.count()
    known = set()
    for i, t in rows:
        e = LIBRARY.encode_ordinary(t or "")
        known.add((i, len(e), hashlib.sha256(struct.pack(f"<{len(e)}I", *e)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert {tuple(r) for r in got} == known


def test_documents_decode_to_themselves(docs):
    frame = docs([(1, "Ein Satz.", "de", "a"), (2, None, "de", "a")])
    got = {r["doc_id"]: (r["ids"], bytes(r["decoded"])) for r in bpe.encode_documents(frame).collect()}
    assert got[1] == (LIBRARY.encode_ordinary("Ein Satz."), b"Ein Satz.") and got[2] == ([], b"")
    assert bpe.encode_documents(docs([])).isEmpty()


def test_a_large_rank_file_is_refused(docs, tmp_path, monkeypatch):
    monkeypatch.setattr(bpe, "RANK_FILE_LIMIT", 10)
    (tmp_path / "ranks").write_bytes(b"YQ== 0\n" * 5)
    with pytest.raises(ValueError):
        bpe.encode_digests(docs([]), rank_file=str(tmp_path / "ranks"))
