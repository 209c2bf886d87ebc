import pytest

from plumbline.model import Registry
from plumbline.operators import graph


def pairs(df):
    return {tuple(r) for r in df.collect()}


EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e")]


@pytest.mark.parametrize("local", [0, 100])
def test_closure_and_cycles(spark, local):
    edges = spark.createDataFrame(EDGES, "source string, target string")
    found = pairs(graph.closure(edges, local_edges=local))
    assert ("a", "d") in found and ("a", "a") in found and ("d", "a") not in found
    assert {s for s, t in found if s == t} == {"a", "b", "c", "e"}


@pytest.mark.parametrize("local", [0, 100])
def test_levels_put_targets_first(spark, local):
    edges = [("o", "c"), ("c", "n"), ("n", "r"), ("l", "o"), ("l", "p")]
    nodes = spark.createDataFrame([(n,) for n in "rncolpx"], "table_key string")
    found = dict(pairs(graph.levels(nodes, spark.createDataFrame(edges, "source string, target string"), local_edges=local)))
    assert found == {"r": 0, "n": 1, "c": 2, "o": 3, "l": 4, "p": 0, "x": 0}
    assert all(found[s] > found[t] for s, t in edges)


@pytest.mark.parametrize("local", [0, 100])
def test_levels_raise_on_a_cycle(spark, local):
    nodes = spark.createDataFrame([("a",), ("b",)], "table_key string")
    with pytest.raises(graph.CycleError):
        graph.levels(nodes, spark.createDataFrame([("a", "b"), ("b", "a")], "source string, target string"), local_edges=local).collect()


def test_edges_skip_virtual_unknown_and_self(spark):
    fk = lambda t, kind="physical": {"source_field": "x", "target_table": t, "target_field": "id", "kind": kind}
    f = [{"name": "id", "type": "int"}]
    r = Registry.of(spark, [{"name": "A", "fields": f, "foreign_keys": [fk("b"), fk("C", "virtual"), fk("gone"), fk("a"), fk("D", "logical")]}, {"name": "B", "fields": f}, {"name": "C", "fields": f}, {"name": "d", "fields": f}])
    assert pairs(graph.fk_edges(r.tables, r.foreign_keys)) == {("a", "b"), ("a", "d")}


def test_parent_cycle_names_its_least_member_once(spark):
    parents = spark.createDataFrame([("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("p", None), ("q", "q")], "node string, parent string")
    assert {r[0] for r in graph.parent_cycles(parents).collect()} == {"x", "q"}


def test_subtree_sizes(spark):
    parents = spark.createDataFrame([("root", None), ("a", "root"), ("b", "a"), ("c", "a")], "node string, parent string")
    assert dict(pairs(graph.subtree_sizes(parents))) == {"root": 3, "a": 2, "b": 0, "c": 0}
