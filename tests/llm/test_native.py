import re

from plumbline.llm import licenses, url_filter

ENTRIES = [("a", "bad.example", "block", "2024-01-10"), ("a", "bad.example", "remove", "2024-02-10"), ("a", "BAD.example", "block", "2024-03-10"), ("b", "ok.bad.example", "allow", "2024-01-01"), ("b", "site.example/x", "block", "2024-01-01"), ("b", "same.example", "allow", "2024-01-01"), ("b", "same.example", "block", "2024-01-01"), ("c", None, "block", "2024-01-01"), ("c", "k", "what", "2024-01-01"), ("a", "bad.example", "block", "2024-01-10")]
CAPTURES = [
    (1, "https://bad.example/p", "2024-01-09 23:59:59", "pass"), (2, "https://bad.example/p", "2024-01-10 00:00:00", "block"), (3, "HTTP://user@www.BAD.example.:80/?q", "2024-02-09 00:00:00", "block"),
    (4, "https://bad.example", "2024-02-10 00:00:00", "pass"), (5, "https://bad.example#f", "2024-04-01 00:00:00", "block"), (6, "https://ok.bad.example/", "2024-01-20 00:00:00", "allow"),
    (7, "https://site.example/x/y?z", "2024-05-01 00:00:00", "block"), (8, "https://site.example/xy", "2024-05-01 00:00:00", "pass"), (9, "https://www.site.example/x", "2024-05-01 00:00:00", "pass"),
    (10, "https://same.example", "2024-05-01 00:00:00", "block"), (11, "notbad.example", "2024-05-01 00:00:00", "pass"), (12, None, "2024-05-01 00:00:00", "pass"), (13, "https://bad.example", None, "pass"), (2, "https://bad.example/p", "2024-01-10 00:00:00", "block"), (14, "https://notbad.example/", "2024-05-01 00:00:00", "pass"),
]


def test_verdicts_as_of_the_fetch_time(spark):
    entries = spark.createDataFrame(ENTRIES, "list string, key string, action string, day string")
    captures = spark.createDataFrame([c[:3] for c in CAPTURES], "page_id long, url string, fetched_at string").selectExpr("page_id", "url", "cast(fetched_at as timestamp_ntz) fetched_at", "'x' as list", "1 as host")
    got = url_filter.verdicts(captures, entries)
    assert sorted((r["page_id"], r["verdict"]) for r in got.collect()) == sorted((c[0], c[3]) for c in CAPTURES)
    assert url_filter.verdicts(captures.limit(0), entries).isEmpty()
    assert {r["verdict"] for r in url_filter.verdicts(captures, entries.limit(0)).collect()} == {"pass"}


def test_intervals(spark):
    entries = spark.createDataFrame(ENTRIES, "list string, key string, action string, day string")
    spans = {(r["list"], r["key"], r["action"], str(r["since"])[:10], str(r["until"])[:10]) for r in url_filter.intervals(entries).collect()}
    assert ("a", "bad.example", "block", "2024-01-10", "2024-02-10") in spans and ("a", "bad.example", "block", "2024-03-10", "None") in spans and len(spans) == 5


def plain_scan(text, templates):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, base, labels, score = [], set(), set(), 0.0
    for t in templates:
        if t.phrase:
            at = [i for i in range(len(w)) if w[i : i + len(t.words)] == t.words]
            places += at
            base |= {t.label} if at else set()
            score = 1.0 if at else score
        else:
            for b in range(0, len(w), t.stride):
                shared = len(set(w[b : b + 2 * t.stride]) & set(t.words))
                if shared >= t.needed:
                    labels.add(t.label)
                    score = max(score, shared / len(set(t.words)))
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score


TEXTS = [
    "Released under the MIT License.", "mit license MIT-LICENSE mit\nlicense", "cc by cc by", "x " * 31 + "gnu general public license" + " y" * 40, "word " * 62 + "Apache License, Version 2.0.", "GNU general license public", "the mİt license", "Licensed under CC BY-NC 4.0", "mit K license",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions hold", "émit license mit", "apache\x00license", "...", "mit license " * 300, "a" * 40_000,
]


def test_scan_against_a_plain_version(docs):
    rows = [(i, t, "en", "a") for i, t in enumerate(TEXTS)] + [(99, None, "en", "a"), (98, "", "en", "a"), (0, TEXTS[0], "en", "a"), (None, "mit license", "en", "b"), (None, "mit license", "en", "b"), (0, "cc by", "en", "z")]
    got = sorted((tuple(r) for r in licenses.scan(docs(rows)).collect()), key=repr)
    templates = licenses.TEMPLATES
    assert got == sorted(((i, *plain_scan(t, templates)) for i, t, _, _ in rows), key=repr)
    assert licenses.scan(docs([])).isEmpty()


def test_whole_license_texts_are_found_wherever_they_stand(docs):
    mit, isc = licenses.TEXTS
    cut = lambda t, k: " ".join(w for i, w in enumerate(t.words) if i % k)  # noqa: E731  every k-th word is missing
    rows = [(i, f"{'lead ' * i}{mit.text.upper()}, {'tail ' * 50}", "en", "a") for i in (0, 1, 31, 100, 255, 256, 257, 700)]
    rows += [(1001, "Permission: " + cut(isc, 12), "en", "a"), (1002, cut(mit, 2), "en", "a"), (1003, " ".join(isc.words[:60]), "en", "a")]
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.scan(docs(rows)).collect()}
    assert got == {i: plain_scan(t, licenses.TEMPLATES) for i, t, _, _ in rows}
    assert all("mit-text" in got[r[0]][5] for r in rows[:8]) and "isc-text" in got[1001][5] and not {"mit-text", "isc-text"} & {*got[1002][5].split(","), *got[1003][5].split(",")}


def test_op3_sql_on_license_texts(spark, docs, tmp_path):
    import duckdb

    from plumbline.llm.registry import OP3_SQL

    mit = licenses.TEXTS[0]
    frame = docs([(i, f"{'lead ' * (37 * i)}{mit.text} MIT License", "en", "a") for i in range(12)] + [(50, None, "en", "a"), (51, "cc by", "en", "a")])
    frame.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet')")
    assert sorted(map(tuple, licenses.scan(frame).collect())) == sorted(con.execute(OP3_SQL).fetchall())
