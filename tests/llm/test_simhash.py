import random

import numpy as np
import pytest
import xxhash

from plumbline.llm import simhash
from plumbline.llm.components import connected_components


def brute_components(codes, ids, limit=2):
    up = list(range(len(codes)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if bin(codes[i] ^ codes[j]).count("1") <= limit:
                up[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for i, d in enumerate(ids):
        r = root(i)
        low[r] = min((x for x in (low.get(r), d) if x is not None), default=None)
    return [low[root(i)] for i in range(len(codes))]


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \t ", "a", "A b", "a b c", "One two\x0bthree two THREE four é É", "w " * 1000])
def test_fingerprint_by_definition(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_uses_the_hash_of_spark(spark):
    value = spark.sql("select xxhash64('one two three') h").first().h
    assert value & (2**64 - 1) == xxhash.xxh64_intdigest(b"one two three", 42)


def near(code, bits, rng):
    for b in rng.sample(range(64), bits):
        code ^= 1 << b
    return code


@pytest.mark.parametrize("run_size, bits, visitors", [(4, 16, 10_000), (50, 16, 10_000), (10_000, 16, 10_000), (20, 3, 30), (1000, 1, 40), (40, 2, 10_000)])
def test_links_connect_what_all_pairs_connect(spark, run_size, bits, visitors):
    rng = random.Random(run_size)
    codes = {rng.getrandbits(64) for _ in range(150)} | {0, 2**64 - 1}
    for c in list(codes)[:60]:
        codes |= {near(c, rng.choice([1, 2, 3]), rng) for _ in range(3)}
    hub = rng.getrandbits(64)
    codes = sorted(codes | {near(hub, 1, rng) for _ in range(64)} | {near(hub, 2, rng) for _ in range(200)})
    signed = np.array(codes, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(c,) for c in signed], "code long")
    links = simhash.fingerprint_links(frame, "code", run_size=run_size, bits=bits, visitors=visitors)
    found = {r["node"]: r["root"] for r in connected_components(links).collect()}
    expected = brute_components(codes, list(range(len(codes))))
    groups = {}
    for c, e in zip(signed, expected):
        groups.setdefault(e, []).append(found.get(c, c))
    assert all(len(set(g)) == 1 for g in groups.values())
    assert len({g[0] for g in groups.values()}) == len(groups)


def test_gray_order_steps_by_one_bit():
    codes = np.arange(16, dtype=np.uint64)
    ordered = codes[np.argsort(simhash.gray_rank(codes))]
    assert all(bin(int(a) ^ int(b)).count("1") == 1 for a, b in zip(ordered, ordered[1:]))


def test_runs_cover_each_prefix_once():
    rng = random.Random(3)
    counts = {rng.getrandbits(8): rng.randint(1, 50) for _ in range(90)}
    runs = simhash.cut_runs(counts, 8, 100)
    for k in counts:
        assert sum(k >> (8 - d) == p for p, d in runs) == 1


def test_no_task_gets_more_than_its_share():
    rng = np.random.default_rng(6)
    codes = np.unique(np.concatenate([rng.integers(0, 1 << 44, 30_000, np.uint64), rng.integers(0, 1 << 63, 5_000, np.uint64)]))  # most of them share 20 bits
    counts = {int(k): int(n) for k, n in zip(*np.unique(codes >> np.uint64(48), return_counts=True))}
    router = simhash.Router(simhash.cut_runs(counts, 16, 1000), counts, 2, 16, 1000, 4000)
    sent = router.route(codes)
    groups = {}
    for *key, own in zip(sent["run"].tolist(), sent["piece"].tolist(), sent["share"].tolist(), sent["own"].tolist()):
        groups.setdefault(tuple(key), [0, 0])[not own] += 1
    assert max(g[0] for g in groups.values()) < 1300 and max(g[1] for g in groups.values()) < 6000
    assert len(np.unique(sent["code"])) == len(codes)


def routed(codes, run_size):
    """Rows that all levels send to tasks, and those of the largest task."""
    level, first, rows, sizes = None, 0, [(np.zeros(len(codes), np.int64), codes)], {}
    groups, total = [tuple(range(63, -1, -1))], 0
    while groups:
        group, code = rows[0]
        differ = {g: int(np.bitwise_or.reduce(code[group == g]) ^ np.bitwise_and.reduce(code[group == g])) for g in range(len(groups))}
        level = simhash.Level(simhash.varying(groups, differ), 2, 16)
        batch = simhash.pa.RecordBatch.from_pydict({"group": group, "code": code.view(np.int64)})
        counts = {}
        for g, k, _, prefixes in level.orders_of(batch):
            counts[g, k] = dict(zip(*(x.tolist() for x in np.unique(prefixes, return_counts=True))))
        first, groups = level.cut(counts, first, run_size, 2 * run_size)
        sent, passed = level.sent(batch), level.passed(batch)
        total += len(sent["code"])
        for *task, own in zip(sent["run"].tolist(), sent["piece"].tolist(), sent["share"].tolist(), sent["own"].tolist()):
            sizes[tuple(task)] = sizes.get(tuple(task), 0) + own
        rows = [(passed["group"], passed["code"].view(np.uint64))]
    return total, max(sizes.values())


def test_a_code_is_sent_to_as_many_tasks_however_many_codes_there_are():
    rng = np.random.default_rng(8)
    for n in (5_000, 25_000, 125_000):  # 5 to 120 runs
        codes = np.unique(rng.integers(0, 1 << 64, n, np.uint64, endpoint=False))
        total, largest = routed(codes, 1024)
        assert total == 3 * len(codes) and largest <= 1024


@pytest.mark.parametrize("places", [list(range(18)), list(range(0, 54, 3)), list(range(46, 64))])
def test_codes_that_share_most_bits_are_not_sent_by_the_square(places):
    rows = {}
    for n in (1 << 12, 1 << 14, 1 << 16):  # all values of the lowest 12, 14, 16 of these bits
        value = np.arange(n, dtype=np.uint64)
        codes = sum(((value >> np.uint64(k)) & np.uint64(1)) << np.uint64(b) for k, b in enumerate(places))
        rows[n], largest = routed(codes, 1024)
        assert largest <= 1300
    assert rows[1 << 16] <= 9 << 16  # two levels of three orders


def test_components_of_a_chain_a_star_and_repeats(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (3, 4), (200, 201), (201, 200)]
    found = dict(tuple(r) for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect())
    assert {found[i] for i in range(41)} == {0} and {found[100 + i] for i in range(30)} == {100} and found[201] == 200
    assert connected_components(spark.createDataFrame([], "u long, v long")).isEmpty()


def test_every_row_gets_its_component(spark, awkward):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    got = sorted(map(tuple, simhash.simhash_components(awkward).collect()), key=repr)
    codes = [plain_fingerprint(t) for _, t in rows]
    expected = brute_components(codes, [i for i, _ in rows])
    assert got == sorted([(i, f"{c:016x}", e) for (i, _), c, e in zip(rows, codes, expected)], key=repr)


def test_empty_table(spark, docs):
    assert simhash.simhash_components(docs([])).isEmpty()
    assert simhash.keep_one_of_each(docs([])).isEmpty()


def test_one_of_each_stays(spark, docs):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(9, base, "en", "a"), (4, base, "en", "b"), (4, base, "en", "b"), (5, "something else entirely here", "en", "a"), (None, base, "en", "a"), (8, "", "en", "a"), (6, None, "en", "a")]
    kept = simhash.keep_one_of_each(docs(rows))
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([4, 5, 6, None], key=repr)
    assert kept.columns == docs(rows).columns
