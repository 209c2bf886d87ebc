import random

import numpy as np
import pytest

import corpus_pipeline
from plumbline.llm import near_copies, simhash
from plumbline.llm.components import connected_components


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_the_stage_drops_near_copies_as_all_pairs_do(spark, docs):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu", "ri") for b in ("ra", "si", "to", "ve", "zan", "x", "k")]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(40, 200))), "en", "a") for i in range(60)]
    for i in range(60):  # from one changed word to so many that it is no near copy
        changed = rows[i][1].split()
        for _ in range(1 + i % 6):
            changed[rng.randrange(len(changed))] = "other"
        rows.append((100 + i, " ".join(changed), "en", "a"))
    base = [rng.choice(words) for _ in range(120)]
    for i in range(80):  # one large group
        rows.append((300 + i, " ".join(["new" if k == i else w for k, w in enumerate(base)]), "en", "a"))
    rows += [(400, None, "en", "a"), (401, "", "en", "a"), (402, "a b c", "en", "a"), (403, "a b d", "en", "a")]
    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))
    codes = [simhash.fingerprint(r[1]) for r in rows]

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            near = sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            if near or (codes[i] ^ codes[j]).bit_count() <= 2:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    kept = corpus_pipeline.drop_near_copies(spark, docs(rows), "")
    expected = sorted(rows[i][0] for i in range(len(rows)) if top(i) == i)
    assert sorted(r["doc_id"] for r in kept.collect()) == expected and len(expected) < 105


@pytest.mark.parametrize("block", [3, 512])
def test_large_groups_are_joined_as_all_pairs_that_meet_would_join_them(spark, docs, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK_TEXTS", block)
    monkeypatch.setattr(near_copies, "SMALL", 2)
    monkeypatch.setattr(near_copies, "NEXT", 1)
    monkeypatch.setattr(near_copies, "PART", 4)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for k in range(12):  # clusters that share most of a passage, so that they meet, and chains within them
        words = base[: 110 + k % 3] + [f"c{k}x{i}" for i in range(25)]
        for _ in range(8):
            words = words.copy()
            words[rng.randrange(len(words))] = f"n{rng.random()}"
            texts.append(" ".join(words))
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    sets, keys = [near_copies.shingle_set(t) for t in texts], [set(near_copies.band_keys(t).tolist()) for t in texts]
    forest = near_copies.Forest()
    for i in range(len(texts)):
        for j in range(i):
            if keys[i] & keys[j] and near_copies.similarity(sets[i], sets[j]) >= near_copies.SIMILARITY:
                forest.join(simhash.fingerprint(texts[i]), simhash.fingerprint(texts[j]))
    links = [(r["u"], r["v"]) for r in near_copies.near_links(docs(rows)).collect()]
    got = near_copies.Forest((int(np.int64(a).view(np.uint64)), int(np.int64(b).view(np.uint64))) for a, b in links)
    codes = {simhash.fingerprint(t) for t in texts}
    assert {c: got.root(c) for c in codes} == {c: forest.root(c) for c in codes} and 2 < len({forest.root(c) for c in codes}) < len(codes)


def test_blocks_give_a_spanning_forest():
    rng = np.random.default_rng(2)
    full = np.unique(rng.integers(0, 1 << 62, 100)).astype(np.uint64)
    sets = [np.delete(full, rng.integers(0, len(full), k % 25)) for k in range(30)] + [np.arange(k, dtype=np.uint64) for k in range(1, 8)]
    every = [(k, k, s) for k, s in enumerate(sets)]
    found, plain = near_copies.Forest(near_copies.links_between(every, every)), near_copies.Forest()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b)):
                plain.join(i, j)
    assert [found.root(k) for k in range(len(sets))] == [plain.root(k) for k in range(len(sets))]


def test_no_links_without_texts(spark, docs, awkward):
    assert near_copies.near_links(docs([])).isEmpty() and near_copies.near_links(docs([(1, None, "en", "a"), (2, "", "en", "a")])).isEmpty()
    near_copies.near_links(awkward).collect()


def test_components_beyond_one_task(spark):
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    frame = spark.createDataFrame(links, "u long, v long")
    one, many = (sorted(map(tuple, connected_components(frame, local_links=n).collect())) for n in (10_000, 0))
    assert one == many and len(one) > 50
