import pytest

from plumbline.llm import line_dedup


def plain(rows, ratio=0.2, least=3):
    pages, lines = {}, {}
    for _, t, _, s in rows:
        if s is not None:
            pages[s] = pages.get(s, 0) + 1
            for x in set((t or "").split("\n")):
                if x.strip(" "):
                    lines[s, x] = lines.get((s, x), 0) + 1
    gone = {k for k, n in lines.items() if n >= least and n > ratio * pages[k[0]]}
    return [(i, None if t is None else t if s is None else "\n".join(x for x in t.split("\n") if (s, x) not in gone)) for i, t, _, s in rows]


ROWS = [(i, f"Home | About\nPage {i}\n\nFooter\nFooter", "en", "a") for i in range(10)] + [(20 + i, "Footer\nUnique" if i < 2 else f"line {i}", "en", "b") for i in range(12)] + [
    (50, None, "en", "a"), (51, "", "en", "a"), (52, "Home | About\nFooter", "en", None), (0, "Home | About\nPage 0\n\nFooter\nFooter", "en", "a"), (None, "Footer", "fr", "a"),
]


@pytest.mark.parametrize("broadcast", [100, 0])
def test_against_a_plain_version(docs, broadcast):
    got = line_dedup.drop_boilerplate(docs(ROWS), ratio=0.2, least_pages=3, broadcast_lines=broadcast)
    assert got.columns == docs(ROWS).columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(plain(ROWS), key=repr)


def test_dropped_lines_are_counted(docs):
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.drop_boilerplate(docs(ROWS), ratio=0.2, least_pages=3, dropped="n_dropped").collect()}
    assert got[5] == 3 and got[21] == 0 and got[50] == 0 and got[52] == 0


def test_a_column_named_as_the_count_is_replaced(docs):
    frame = docs(ROWS).withColumnRenamed("score", "N_Dropped")
    got = line_dedup.drop_boilerplate(frame, ratio=0.2, least_pages=3, dropped="n_dropped")
    assert [c.lower() for c in got.columns].count("n_dropped") == 1 and {r["doc_id"]: r["n_dropped"] for r in got.collect()}[5] == 3


def test_few_pages_and_the_ratio_itself_are_no_boilerplate(docs):
    rows = [(i, "same", "en", "a") for i in range(2)] + [(10 + i, "edge" if i < 3 else f"x{i}", "en", "b") for i in range(15)]
    assert [r["text"] for r in line_dedup.drop_boilerplate(docs(rows), ratio=0.2, least_pages=3).filter("source = 'a'").collect()] == ["same", "same"]
    assert line_dedup.boilerplate_lines(docs(rows), ratio=0.2, least_pages=3).isEmpty()


def test_awkward_and_empty(awkward, docs):
    assert line_dedup.drop_boilerplate(awkward).count() == awkward.count()
    assert line_dedup.drop_boilerplate(docs([])).isEmpty()


def test_n_chars_follows_the_text(docs):
    got = line_dedup.dedup_documents(docs(ROWS), 0.2, 3)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got.collect())
