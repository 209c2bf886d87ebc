import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import decontaminate as dc


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=80), st.lists(st.sampled_from("abcde"), max_size=40))
def test_common_subsequence(a, b):
    assert dc.common_subsequence(a, b) == lcs(a, b)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "Bc", " ", "é", "_", ".", "ΑΣ", "漢", "\n", "½", "İ"]), max_size=30).map("".join))
def test_word_ids_follow_the_words(text):
    words, ids = dc.words_of(text), dc.word_ids(text).tolist()
    assert len(words) == len(ids) and len(set(ids)) == len(set(words))
    assert ids == [dc.word_ids(w)[0] for w in words] if all(w.lower() == w for w in words) else True


def test_word_ids_of_parts(monkeypatch):
    text = "some words, and more of them; " * 40 + "x" * 100
    whole = dc.word_ids(text).tolist()
    monkeypatch.setattr(dc, "_HASH_PART", 32)
    assert dc.word_ids(text).tolist() == whole


def corpus(seed=5, n=400):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne", "pu") for b in ("ra", "si", "to", "ve", "za") for c in ("n", "r", "s", "t", "x", "k", "m", "b")]
    sentence = lambda k: " ".join(rng.choice(words) for _ in range(k))
    rows = [[i, sentence(rng.randint(5, 200)) + ".", "en", "a"] for i in range(n)]
    items = [(100 + k, f"{sentence(20)}. {sentence(12)} {sentence(6)}.") for k in range(15)]
    return rng, rows, items


def test_planted_items_are_found_and_nothing_else(spark, docs):
    rng, rows, items = corpus()
    truth = {}
    for k, (ident, text) in enumerate(items):
        row = rows[k * 7]
        cut = rng.randrange(len(row[1]))
        cut = row[1].find(" ", cut) if " " in row[1][cut:] else len(row[1])
        row[1] = row[1][:cut] + " " + text.upper() + "\n" + row[1][cut:]
        truth[row[0]] = [ident]
    changed = items[3][1].split()  # a paraphrase: every eighth word is another
    rows.append([900, "lead in " + " ".join("other" if i % 8 == 4 and i < 24 else w for i, w in enumerate(changed)) + " and out", "en", "a"])
    truth[900] = [items[3][0]]
    got = dc.contaminated(docs([tuple(r) for r in rows]), spark.createDataFrame(items, "item_id long, text string"))
    found = {r["doc_id"]: r["item_ids"] for r in got.collect() if r["contaminated"]}
    assert found == truth and got.count() == len(rows)


def test_an_item_in_a_third_of_the_rows_is_found(spark, docs):
    rng, rows, items = corpus(n=600)
    common = f"{items[0][1]} {items[1][1]}".split()
    spread = [(1, " ".join(common[:24]) + ". " + " ".join(common[24:30])), (2, " ".join(common[30:38])), *items[2:]]
    for row in rows[::3]:  # each time among words of other items
        around = [w for _, t in rng.sample(items[2:], 4) for w in rng.sample(t.replace(".", "").split(), 12)]
        cut = rng.randrange(len(around))
        row[1] += " ".join(["", *around[:cut], spread[0][1], *around[cut:], spread[1][1], *around[:cut]])
    changed = dc.words_of(spread[0][1])
    rows[1][1] += " " + " ".join("other" if i % 5 == 4 and i < 24 else w for i, w in enumerate(changed)) + " and so on"
    got = dc.contaminated(docs([tuple(r) for r in rows]), spark.createDataFrame(spread, "item_id long, text string"))
    words = {i: dc.words_of(t) for i, t in spread}
    truth = {r[0]: [i for i in sorted(words) if dc.stands_in(words[i], dc.words_of(r[1]))] for r in rows}
    truth[rows[1][0]] = [1]
    assert {r["doc_id"]: r["item_ids"] for r in got.collect()} == truth and len([x for x in truth.values() if x]) == 201


@pytest.mark.parametrize("block", [4, 100])
def test_blocks_of_items_change_nothing(spark, docs, block):
    _, rows, items = corpus(n=60)
    rows[5][1] += " " + items[0][1]
    rows[6][1] = items[9][1] + " " + items[2][1]
    frame = docs([tuple(r) for r in rows])
    got = dc.add_leaks(frame, spark.createDataFrame(items, "item_id long, text string"), block_items=block)
    assert {r["doc_id"]: sorted(x["item"] for x in r["leaks"]) for r in got.collect() if r["leaks"]} == {5: [100], 6: [102, 109]}
    assert got.columns == [*frame.columns, "leaks"]


def test_awkward_cases(spark, awkward, docs):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (4, "lazy dog again"), (4, "lazy dog again"), (None, "The quick brown fox jumps over the lazy dog")], "item_id long, text string")
    got = dc.contaminated(awkward, bench)
    assert got.count() == awkward.count()
    assert {r["doc_id"] for r in got.filter("contaminated").collect()} == {1}
    assert dc.drop_contaminated(awkward, bench).columns == awkward.columns
    none = bench.limit(0)
    assert dc.contaminated(awkward, none).filter("contaminated").isEmpty()
    assert dc.contaminated(docs([]), bench).isEmpty()


def test_answer_is_the_last_sentence():
    text = "What is it? It is a long answer."
    assert dc.answer_of(text, dc.words_of(text)) == ["it", "is", "a", "long", "answer"]
    assert dc.answer_of("one two three four five. Yes", dc.words_of("one two three four five. Yes")) == ["four", "five", "yes"]


class Plain:
    """Every item at every place of a text, word by word."""

    def __init__(self, items):
        self.items = [(i, dc.words_of(t), dc.answer_of(t, dc.words_of(t))) for i, t in items]

    def leaks(self, text):
        words = dc.words_of(text)
        found = []
        for ident, item, answer in self.items:
            n = len(item)
            if any(dc.leak_share(item, answer, words[at : at + 2 * n]) for at in range(0, max(1, len(words) - n), max(1, n // 8))):
                found.append(ident)
        return found


def test_search_against_every_place(spark, docs):
    rng, rows, items = corpus(seed=9, n=120)
    sentence = lambda k: " ".join(rng.choice(rows)[1].strip(".").split()[0] for _ in range(k))
    items += [(200 + n, f"{sentence(n - 9)}. {sentence(9)}.") for n in (64, 65, 80, 96, 97, 130, 200)]
    changed = 0
    for k, (_, text) in enumerate(items * 3):  # whole, and with 10 to 45 % of the words replaced
        share = (0, 0.1, 0.15, 0.2, 0.3, 0.45)[k % 6]
        words = [f"new{rng.random()}" if rng.random() < share else w for w in text.split()]
        rows[k][1] = f"{rows[k][1]} {' '.join(words)} {rows[k + 30][1]}"
        changed += share > 0
    plain = Plain(items)
    truth = {r[0]: plain.leaks(r[1]) for r in rows}
    got = {r["doc_id"]: r["item_ids"] for r in dc.contaminated(docs([tuple(r) for r in rows]), spark.createDataFrame(items, "item_id long, text string")).collect()}
    wanted, found = ({(i, x) for i, own in side.items() for x in own} for side in (truth, got))
    assert len(wanted) > 30 and changed > 40
    assert len(found & wanted) >= 0.95 * len(wanted) and len(found - wanted) <= 0.02 * len(wanted)


@pytest.mark.parametrize("n", [65, 80, 96, 97, 128, 130])
def test_all_words_of_long_items_are_searched(n):
    rng = dc.np.random.default_rng(n)
    item = [f"w{n}x{i}" for i in range(n)]
    projection = rng.standard_normal((1 << dc.BITS, dc.RANK)).astype("f4")
    search = dc.Search([dc.Item(1, " ".join(item) + ".")], projection)
    search.runs = {}  # the windows alone
    filler = [f"f{i}" for i in range(300)]
    assert [dc.parts_of(n)[0], dc.parts_of(n)[-1] + dc.SCALES[-1]] == [0, n]
    for first, last in ((0, n), (0, -(-n * 5 // 6)), (n // 6, n)):
        for apart in (0, 1000):
            text = filler[: 37 + first] + item[first:last] + filler + [f"g{i}" for i in range(apart)] + item[-32:]
            assert [k for k, _ in search.leaks(" ".join(text))] == [0], (first, last, apart)
    assert search.leaks(" ".join(filler + item[-32:])) == []


def test_copies_under_other_ids_are_drawn_apart(spark):
    frame = spark.createDataFrame([(i, "one text") for i in range(2000)] + [(5000, "same row")] * 2000, "doc_id long, text string")
    share = frame.withColumn("h", dc.F.pmod(dc.row_hash(frame, "fit"), dc.F.lit(4)))
    assert 350 < share.filter("h = 0 and doc_id < 5000").count() < 650


def test_the_basis_is_fitted_on_every_item(spark, docs, monkeypatch):
    items = [(i, f"item number{i} of many{i % 7} and word{i * 31 % 1000} again") for i in range(2500)]
    fitted = []
    real = dc.latent_basis
    monkeypatch.setattr(dc, "latent_basis", lambda texts, idf: fitted.extend(r[0] for r in texts.collect()) or real(texts, idf))
    got = dc.contaminated(docs([(1, f"lead {items[2400][1]} out", "en", "a"), (2, "none", "en", "a")]), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"]: r["item_ids"] for r in got.collect()} == {1: [2400], 2: []}
    assert sorted(fitted) == sorted(t for _, t in items)


def test_few_items_span_few_directions(spark):
    texts = spark.createDataFrame([("one two three four five six",), ("seven eight nine ten eleven twelve",), ("one two three four five six",)], "text string")
    basis = dc.latent_basis(texts, dc.np.ones(1 << dc.BITS, "f4"))
    assert dc.np.count_nonzero(dc.np.abs(basis).sum(axis=0)) == 2
