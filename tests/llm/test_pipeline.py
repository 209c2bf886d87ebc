import random

import public_tokenizers
import pytest

import corpus_pipeline
from plumbline.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from plumbline.llm.registry import ORACLES, QUERIES


def tables(spark, folder):
    """A small corpus with every kind of row that some stage drops or changes."""
    rng, words = random.Random(11), [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("n", "rt", "s", "lk", "mp")]
    sentence = lambda k: " ".join(rng.choice(words) for _ in range(k))
    items = [(i, f"{sentence(18)}. {sentence(9)}.") for i in range(6)]
    rows, labels = [], []
    for i in range(240):
        toxic = i % 6 == 0
        body = sentence(rng.randint(30, 120)) + (" grulk snarf blegh" if toxic else "")
        rows.append((i, "Share this page\n" * (i % 2) + body, "en", f"s{i % 3}"))
        labels.append((i, 1, int(toxic)))
    for k in range(5):
        rows.append((300 + k, rows[k * 10 + 1][1], "en", "s0"))  # copies
    rows += [(400, f"{sentence(30)} {items[2][1]} {sentence(30)}", "en", "s1"), (401, None, "en", "s1"), (402, "", "en", "s2"), (403, "Share this page", "en", "s1")]
    schema = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    data = {"documents": [(*r, None if r[1] is None else len(r[1])) for r in rows], "labels": labels, "benchmark": items}
    for name, ddl in schema.items():
        spark.createDataFrame(data[name], ddl).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return data


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    return folder, tables(spark, folder)


def test_stages_against_plain_versions(spark, corpus):
    folder, data = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    state = {r["doc_id"]: r["text"] for r in docs.collect()}
    sources = {r[0]: r[3] for r in data["documents"]}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).persist()
        got = {r["doc_id"]: r for r in docs.collect()}
        if name == "toxicity":
            scores = toxicity.toxicity_scores(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
            state = {r["doc_id"]: state[r["doc_id"]] for r in scores.collect() if r["score"] < 0.5}
        elif name == "line_dedup":
            pages, lines = {}, {}
            for i, t in state.items():
                pages[sources[i]] = pages.get(sources[i], 0) + 1
                for x in set((t or "").split("\n")) - {""}:
                    lines[sources[i], x] = lines.get((sources[i], x), 0) + 1
            gone = {k for k, n in lines.items() if n >= line_dedup.LEAST_PAGES and n > line_dedup.BOILERPLATE_RATIO * pages[k[0]]}
            state = {i: t and "\n".join(x for x in t.split("\n") if (sources[i], x) not in gone) for i, t in state.items()}
        elif name == "near_dedup":
            codes, kept = {i: simhash.fingerprint(t) for i, t in state.items()}, []
            for i in sorted(state):  # here no chain is longer than one link
                if not any(bin(codes[i] ^ codes[j]).count("1") <= 2 for j in kept):
                    kept.append(i)
            state = {i: state[i] for i in kept}
        elif name == "decontamination":
            items = [decontaminate.words_of(t) for _, t in data["benchmark"]]
            state = {i: t for i, t in state.items() if not any(decontaminate.stands_in(w, decontaminate.words_of(t)) for w in items)}
        else:
            packer = bpe.TextPacker(open(bpe.RANK_FILE, "rb").read(), public_tokenizers.PATTERN)
            assert {i: r["n_tokens"] for i, r in got.items()} == {i: len(packer.pack(t or "")) // 4 for i, t in state.items()}
            break
        assert {i: r["text"] for i, r in got.items()} == state, name
        assert sorted(docs.columns) == ["doc_id", "lang", "n_chars", "source", "text"]
    assert 400 not in state and 300 not in state and len(state) > 100


def test_run_gives_the_last_stage(spark, corpus):
    folder, _ = corpus
    got = corpus_pipeline.run(spark, folder)
    assert got.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 100


def test_ten_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


def test_stages_on_awkward_and_empty_tables(spark, corpus, awkward, docs):
    folder, _ = corpus
    long = docs([(70, " ".join(f"w{i % 900}x" for i in range(60_000)), "en", "b"), (70, "the same id with another text", "en", "b")])
    rows = awkward.unionByName(long)
    expected = {  # what each stage leaves of awkward rows by itself
        "toxicity": [None, None, 1, 1, 2, 3, 4, 5, 6, 70, 70],
        "line_dedup": [None, None, 1, 1, 2, 3, 4, 5, 6, 70, 70],
        "near_dedup": [None, None, 1, 2, 5, 6, 70],  # 2, 3 and 4 have no words; a repeated id stays once; rows without an id stay
        "decontamination": [None, None, 1, 1, 2, 3, 4, 5, 6, 70, 70],
        "bpe": [None, None, 1, 1, 2, 3, 4, 5, 6, 70, 70],
    }
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, rows, folder)
        assert sorted((r["doc_id"] for r in got.select("doc_id").collect()), key=lambda x: (x is not None, x)) == expected[name], name
        if name != "bpe":
            assert got.columns == rows.columns, name
        assert stage(spark, rows.limit(0), folder).isEmpty(), name
