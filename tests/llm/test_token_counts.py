import math
import random
import time
from collections import Counter

import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import token_counts as tc
from plumbline.llm.bpe import RANK_FILE, parse_ranks

RANKS = parse_ranks(open(RANK_FILE, "rb").read())
LONGEST = max(map(len, RANKS))
ZIPF = tc.zipf_scores(RANKS)
COUNTER = tc.TextCounter(RANKS, ZIPF, public_tokenizers.PATTERN)
PATTERN = regex.compile(public_tokenizers.PATTERN)


def segmented(piece, scores=ZIPF, ranks=RANKS):
    """Tokens of the best segmentation: highest score, then fewest tokens, then the longest last token, and so on backwards."""
    longest = LONGEST if ranks is RANKS else max(map(len, ranks))
    best = [(0.0, 0, 0, None)] + [None] * len(piece)
    for end in range(1, len(piece) + 1):
        for start in range(max(0, end - longest), end):
            rank = ranks.get(piece[start:end])
            if rank is not None and best[start] is not None:
                found = (best[start][0] + scores[rank], best[start][1] - 1, -start, rank)
                if best[end] is None or found[:3] > best[end][:3]:
                    best[end] = found
    out, at = [], len(piece)
    while at and best[at]:
        out.append(best[at][3])
        at = -best[at][2]
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["th", "the", "er", "tion", "é", "z", " ", "12"]), max_size=6).map("".join), max_size=20))
def test_shared_prefixes_give_each_piece_its_own_count(pieces):
    found = COUNTER.trie.counts(p.encode() for p in pieces)
    assert found == {p.encode(): len(segmented(p.encode())) for p in pieces}
    weights = {p.encode(): k + 1 for k, p in enumerate(dict.fromkeys(pieces))}
    expected = Counter()
    for p, n in weights.items():
        for rank in segmented(p):
            expected[rank] += n
    assert COUNTER.trie.usage(weights) == expected


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["the", " ", "  ", "\n", "a", "'s", "é", ".", " ", "12", "\t"]), max_size=20).map("".join))
def test_text_counts(text):
    chunks, ((inner, first),) = COUNTER.texts.cut([text])
    assert [p for part in (first, *(f" {c}" for c in inner)) for p in PATTERN.findall(part)] == PATTERN.findall(text) and set(inner) <= chunks
    pieces = COUNTER.texts.pattern.findall(text)
    assert COUNTER.count([text]) == [(len(pieces), sum(len(segmented(p.encode())) for p in pieces))]
    assert tc.piece_sums(COUNTER.texts, [text, text]) == Counter(pieces + pieces)


def test_full_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(tc, "CACHE_PIECES", 3)
    own, rng = tc.TextCounter(RANKS, ZIPF, public_tokenizers.PATTERN), random.Random(1)
    texts = [" ".join(rng.choice(["one", "two", "three", "four.", "five\nsix"]) for _ in range(30)) for _ in range(20)]
    assert own.count(texts) == COUNTER.count(texts)


def plain_scores(texts, ranks, rounds=tc.ROUNDS):
    pieces = Counter(p for t in texts for p in PATTERN.findall(t or ""))
    scores = tc.zipf_scores(ranks)
    for _ in range(rounds):
        counts = Counter()
        for p, n in pieces.items():
            for rank in segmented(p.encode(), scores, ranks):
                counts[rank] += n
        total = sum(counts.values()) + len(ranks)
        scores = {r: math.log((counts[r] + 1) / total) for r in ranks.values()}
    return scores


def test_documents_by_learned_scores(awkward, docs):
    texts = {(r["doc_id"], r["text"]) for r in awkward.collect()}
    every = [r["text"] for r in awkward.collect()]
    learned, plain = tc.learn_scores(awkward), plain_scores(every, RANKS)
    assert learned.keys() == plain.keys() and max(abs(learned[r] - plain[r]) for r in plain) < 1e-9
    assert learned[RANKS[b" word"]] > ZIPF[RANKS[b" word"]] + 3
    counter = tc.TextCounter(RANKS, learned, public_tokenizers.PATTERN)
    expected = {(i, *counter.count([t or ""])[0]) for i, t in texts}
    assert {(r["doc_id"], r["n_pretokens"], r["n_tokens"]) for r in tc.token_counts(awkward).collect()} == expected
    assert tc.token_counts(awkward).count() == awkward.count() and tc.token_counts(docs([])).isEmpty()


def test_no_text_leaves_the_first_scores(docs):
    assert tc.learn_scores(docs([(1, None, "en", "a"), (2, "", "en", "a")])) == ZIPF


def test_pieces_that_the_vocabulary_cant_spell(docs, tmp_path):
    (tmp_path / "ranks").write_bytes(b"YQ== 0\nYWE= 1\nIA== 2\n")  # a, aa and a space
    rows = docs([(1, "aaa b aa", "en", "a"), (2, "b", "en", "a")])
    got = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in tc.token_counts(rows, rank_file=str(tmp_path / "ranks")).collect()}
    assert got == {1: (3, 4), 2: (1, 0)}


@pytest.mark.parametrize("scores, tokens", [({0: -1.0, 1: -2.0, 2: -9.0}, 2), ({0: -1.0, 1: -2.5, 2: -9.0}, 4)])
def test_ties_take_fewer_tokens(scores, tokens):
    ranks = {b"a": 0, b"aa": 1, b" ": 2}
    assert tc.UnigramTrie(ranks, scores).counts([b"aaaa"]) == {b"aaaa": tokens}


def test_levels_are_the_walk_for_any_piece():
    rng = random.Random(2)
    ranks = {b"a": 0, b"aa": 1, b"ab": 2, b"b": 3, b"\x00": 4, b"ba": 5, b"abab": 6, b"\x00a": 7}
    trie = tc.UnigramTrie(ranks, {r: -rng.choice([1.0, 2.0, 3.0]) for r in ranks.values()})
    sizes = [*range(12), tc.LEVELS - 1, tc.LEVELS, tc.LEVELS + 1, 300]
    pieces = {bytes(rng.choices(b"ab\x00c", (9, 9, 3, 0.3), k=rng.choice(sizes))): rng.randint(1, 9) for _ in range(2_000)}
    walked = {piece: list(best) for piece, best in trie.forward(pieces)}
    assert trie.counts(pieces) == {p: -b[-1][1] if b[-1][0] > -math.inf else 0 for p, b in walked.items()}
    expected = Counter()
    for piece, best in walked.items():
        at = len(piece)
        while at and best[at][0] > -math.inf:
            expected[trie.rank[best[at][3]]] += pieces[piece]
            at = -best[at][2]
    assert trie.usage(pieces) == expected
    long = {p: n for p, n in pieces.items() if len(p) > tc.LEVELS}
    assert trie.counts(long) == {p: n for p, n in trie.counts(pieces).items() if p in long} and trie.counts([]) == {} and trie.usage({}) == Counter()


@pytest.mark.parametrize("text_bytes, chunks, longest", [(8 << 20, 100_000, 1 << 22), (40, 3, 1 << 22), (40, 3, 20)])
def test_slices_of_many_texts(monkeypatch, text_bytes, chunks, longest):
    monkeypatch.setattr(tc, "TEXT_BYTES", text_bytes)
    monkeypatch.setattr(tc, "CHUNKS", chunks)
    monkeypatch.setattr(tc.SpacedTexts, "AT_ONCE", longest)
    rng = random.Random(3)
    parts = ["one", "two's", "é", "12.", "'", " ", " ", " ", " ", "  ", "\n", "\x1c", "\x85", "\u3000", "\x00", "漢字"]
    texts = ["", None, " ", *("".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(400)), "one two " * 30]
    own, found = tc.TextCounter(RANKS, ZIPF, public_tokenizers.PATTERN), [PATTERN.findall(t or "") for t in texts]
    sizes = {p: len(segmented(p.encode())) for some in found for p in some}
    for _ in range(2):
        assert own.count(texts) == [(len(some), sum(map(sizes.__getitem__, some))) for some in found]
    assert tc.piece_sums(own.texts, texts) == Counter(p for some in found for p in some)


def test_a_batch_of_pieces_costs_less_than_its_walk():
    rng = random.Random(4)
    pieces = [("".join(rng.choices(["th", "er", "on", "tion", "é", "qu", "en", "x"], k=5))).encode() for _ in range(20_000)]

    def seconds(f):
        began = time.thread_time()
        f()
        return time.thread_time() - began

    assert min(seconds(lambda: COUNTER.trie.counts(pieces)) for _ in range(3)) < 0.7 * min(seconds(lambda: sum(1 for _ in COUNTER.trie.forward(pieces))) for _ in range(3))
