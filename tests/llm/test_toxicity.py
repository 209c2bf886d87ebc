import math
import random
from zlib import crc32

import numpy as np

from plumbline.llm import toxicity

BAD = ["grulk", "snarf", "blegh"]


def corpus(n=900, seed=1):
    rng, words = random.Random(seed), [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(10, 80))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(BAD))
        rows.append((i, " ".join(text), "en", "a"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, docs):
    rows, labels = corpus()
    truth = {i: y for i, _, y in labels}
    got = toxicity.toxicity_scores(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_labels_of_the_held_out_fold_teach_nothing(spark, docs):
    rows, labels = corpus(300)
    schema = "doc_id long, quality int, toxic int"
    flipped = [(i, q, 1 - y if crc32(str(i).encode()) % 5 == 0 else y) for i, q, y in labels]
    a, b = (sorted(map(tuple, toxicity.toxicity_scores(docs(rows), spark.createDataFrame(x, schema)).collect())) for x in (labels, flipped))
    assert a == b


def test_toxic_documents_go_and_all_columns_stay(spark, docs):
    rows, labels = corpus()
    extra = [(5000, "w1 w2 grulk snarf blegh w3", "en", "a"), (5001, "w5 w6 w7", "en", "a"), (5002, None, "en", "a"), (5002, None, "en", "a"), (None, "", None, None)]
    frame = docs(rows + extra)
    kept = toxicity.drop_toxic(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == frame.columns and 5000 not in ids and 5001 in ids and ids.count(5002) == 2 and None in ids


def test_awkward_documents_and_labels(spark, awkward, docs):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (None, 1, 1), (5, 1, None), (77, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_scores(awkward, labels)
    assert got.count() == awkward.count() and got.filter("score is null or held_out is null").isEmpty()
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.toxicity_scores(awkward, none).collect()} == {0.5}
    assert toxicity.toxicity_scores(docs([]), none).isEmpty()


def test_l1_leaves_few_weights():
    rng = np.random.default_rng(0)
    rows = [(np.unique(np.append(rng.integers(0, 5000, 50), 9000 if y else 1)), y) for y in rng.integers(0, 2, 400).tolist()]
    weights = toxicity.fit_ftrl(rows)
    assert 9000 in weights.index and len(weights.index) < 500


SCHEMA = "doc_id long, quality int, toxic int"


def taught(spark, docs, rows, labels):
    return toxicity.fitted(docs(rows), spark.createDataFrame(labels, SCHEMA), "doc_id", "text", "toxic", toxicity.F.lit(True))


def test_a_very_long_row_teaches_all_its_features(spark, docs):
    text = " ".join(f"w{i}" for i in range(30_000))
    got = taught(spark, docs, [(i, text, "en", "a") for i in range(60)], [(i, 1, 1) for i in range(60)])
    own = np.unique(toxicity.features(text, toxicity.WordHashes()))
    assert len(own) > 1 << 16 and np.array_equal(got.index, own)
    assert np.array_equal(got.value, toxicity.fit_ftrl([(own, 1)] * 60).value)


def plain_ftrl(rows):
    """The same sums, one coordinate at a time."""
    z, n = {}, {}

    def weight(i, l1):
        zi = z.get(i, 0.0)
        if abs(zi) <= l1:
            return 0.0
        return -(zi - math.copysign(l1, zi)) / ((toxicity.BETA + math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for found, y in rows:
            w = {i: weight(i, toxicity.L1) for i in found} | {"bias": weight("bias", 0.0)}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i, wi in w.items():
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * wi
                n[i] = n.get(i, 0.0) + g * g
    return {i: w for i in z if i != "bias" and (w := weight(i, toxicity.L1))}, weight("bias", 0.0)


def test_weights_and_scores_against_a_plain_version(spark, docs):
    rows, labels = corpus(200)
    got = taught(spark, docs, rows, labels)
    texts = dict(r[:2] for r in rows)
    keys = {r["k"]: r["doc_id"] for r in docs(rows).select("doc_id", toxicity.F.xxhash64("doc_id", toxicity.F.lit("sample")).alias("k")).collect()}
    truth = {i: y for i, _, y in labels}
    hashes = toxicity.WordHashes()
    ordered = [(sorted(set(toxicity.features(texts[keys[k]], hashes).tolist())), truth[keys[k]]) for k in sorted(keys)]
    weights, bias = plain_ftrl(ordered)
    assert set(got.index.tolist()) == set(weights) and np.allclose(got.value, [weights[i] for i in got.index.tolist()], atol=1e-5) and abs(got.bias - bias) < 1e-6
    scored = toxicity.add_scores(docs(rows), spark.createDataFrame(labels, SCHEMA), score="s", trainable=toxicity.F.lit(True))
    for r in scored.collect():
        total = bias + sum(weights.get(i, 0.0) for i in set(toxicity.features(r["text"], hashes).tolist()))
        assert abs(r["s"] - 1 / (1 + math.exp(-total))) < 1e-5


def test_the_sample_is_bounded_by_rows_and_bytes(spark, docs, monkeypatch):
    rows, labels = corpus(300)
    repeated = rows + [(rows[0][0], f"only {i}", "en", "a") for i in range(500)]  # one labelled id over and over
    assert np.array_equal(taught(spark, docs, repeated + repeated, labels).index, taught(spark, docs, repeated, labels).index)
    first = [(np.arange(50, dtype="<i4").tobytes(), 1)] * 10
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 1000)
    assert len(toxicity._bounded(first)) == 5
