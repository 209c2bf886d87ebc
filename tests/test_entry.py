import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from plumbline.plans import catalog

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_works_without_the_optional_parts():
    code = "import sys; sys.modules['plumbline.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'row_diff_orders' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); print(len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return round(float(value), 9) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


@pytest.mark.skipif(not DATA.exists(), reason="needs the data tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for n in NAMES:
        con.sql(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{DATA}/{n}.parquet')")
    frame = catalog.QUERIES[name](spark, str(DATA))
    columns = sorted(frame.columns)
    result = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    got = [tuple(r) for r in frame.select(*columns).collect()]
    assert sorted(repr([plain(v) for v in r]) for r in got) == sorted(repr([plain(v) for v in r]) for r in result)


def test_row_diff_plans_one_full_outer_merge_join(spark):
    if not DATA.exists():
        pytest.skip("needs the data tables")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = catalog.QUERIES["row_diff_orders"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("SortMergeJoin") == 1 and "FullOuter" in plan and "Cartesian" not in plan and "o_totalprice" not in plan
