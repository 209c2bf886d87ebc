"""Order, cycles and closures of foreign-key and parent graphs.

Graphs of schemas are small: up to ``LOCAL_EDGES`` edges they are walked on the driver,
which saves a job for every round.  Larger ones stay distributed: levels and closures
grow by one join a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.shared import checkpointed

#: Edges of a graph that the driver walks itself.
LOCAL_EDGES = 2_000


class CycleError(ValueError):
    """The graph has a cycle where an order was asked for."""


def fk_edges(tables: DataFrame, fks: DataFrame) -> DataFrame:
    """(source, target): target must come before source.  Virtual keys, unknown targets and references to oneself are no edges."""
    known = tables.select(F.col("table_key").alias("target"))
    edges = fks.filter("lower(kind) <> 'virtual'").select(F.col("table_key").alias("source"), F.lower("target_table").alias("target"))
    return edges.filter("source <> target").join(known, "target", "left_semi").select("source", "target").distinct()


def _local(edges: DataFrame, limit: int) -> dict | None:
    """target lists by source, or None for a graph of more than ``limit`` edges."""
    rows = edges.select("source", "target").limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    out: dict = {}
    for s, t in rows:
        out.setdefault(s, []).append(t)
    return out


def _reached(start, links: dict) -> set:
    seen, todo = set(), list(links.get(start, ()))
    while todo:
        if (n := todo.pop()) not in seen:
            seen.add(n)
            todo += links.get(n, ())
    return seen


def closure(edges: DataFrame, max_rounds: int = 64, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(source, target) of all pairs joined by a path; paths double in length each round, so 64 rounds suffice for any graph."""
    if (links := _local(edges, local_edges)) is not None:
        schema = edges.select("source", "target").schema
        return edges.sparkSession.createDataFrame([(s, t) for s in links for t in _reached(s, links)], schema)
    paths = checkpointed(edges.select("source", "target").distinct())
    n = paths.count()
    for _ in range(max_rounds):  # each round's plan starts from the last one's files
        step = paths.alias("a").join(paths.alias("b"), F.col("a.target") == F.col("b.source")).select(F.col("a.source").alias("source"), F.col("b.target").alias("target"))
        paths = checkpointed(paths.union(step).distinct())
        if (grown := paths.count()) == n:
            break
        n = grown
    return paths


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """(node) of every node on a cycle."""
    return closure(edges).filter("source = target").select(F.col("source").alias("node"))


def levels(nodes: DataFrame, edges: DataFrame, node: str = "table_key", local_edges: int = LOCAL_EDGES) -> DataFrame:
    """G1: (node, level): 0 without a target, else one more than its highest target.

    Ordering by level is a topological order: each target comes before its sources.
    Levels settle within as many rounds as there are nodes unless there is a cycle,
    for which CycleError is raised.
    """
    out = nodes.select(F.col(node).alias("node"), F.lit(0).alias("level"), F.lit(True).alias("moved")).distinct()
    if (links := _local(edges, local_edges)) is not None:
        if circle := sorted(s for s in links if s in _reached(s, links)):
            raise CycleError("the foreign keys have a cycle: " + ", ".join(map(str, circle[:20])))
        depth: dict = {}
        for s in links:  # a node is done once all it refers to are
            todo = [s]
            while todo:
                n = todo[-1]
                if wait := [t for t in links.get(n, ()) if t not in depth]:
                    todo += wait
                else:
                    depth[todo.pop()] = 1 + max((depth[t] for t in links.get(n, ())), default=-1)
        known = edges.sparkSession.createDataFrame(list(depth.items()), "n string, found int")
        return out.join(known, F.col("node") == F.col("n"), "left").select("node", F.coalesce("found", "level").alias("level"))
    out = checkpointed(out)
    edges, bound = checkpointed(edges), out.count()
    for _ in range(bound + 1):
        up = edges.join(out.filter("moved"), edges.target == out.node).groupBy("source").agg((F.max("level") + 1).alias("up"))
        joined = out.join(up, out.node == up.source, "left")
        higher = F.coalesce(F.col("up") > F.col("level"), F.lit(False))
        better = checkpointed(joined.select("node", F.when(higher, F.col("up")).otherwise(F.col("level")).alias("level"), higher.alias("moved")))
        if better.filter("moved").isEmpty():
            return better.select("node", "level")
        out = better
    raise CycleError("the foreign keys have a cycle: " + ", ".join(sorted(r[0] for r in cyclic_nodes(edges).limit(20).collect())))


def topological_order(tables: DataFrame, fks: DataFrame) -> DataFrame:
    """G1: (table_key, name, level, position): by level, then by name; each target comes before its sources."""
    found = levels(tables, fk_edges(tables, fks)).withColumnRenamed("node", "table_key")
    place = F.row_number().over(Window.orderBy("level", "table_key"))  # a row a table
    return tables.select("table_key", "name").join(found, "table_key").withColumn("position", place)


def parent_cycles(parents: DataFrame) -> DataFrame:
    """(node): the least member of each cycle of (node, parent) pointers."""
    edges = parents.filter("parent is not null").select(F.col("node").alias("source"), F.col("parent").alias("target"))
    paths = closure(edges)
    on = paths.filter("source = target").select(F.col("source").alias("n"))
    mates = paths.join(on, paths.source == on.n, "left_semi").join(on.withColumnRenamed("n", "m"), paths.target == F.col("m"), "left_semi")
    return mates.groupBy("source").agg(F.min("target").alias("least")).filter("source = least").select(F.col("source").alias("node"))


def subtree_sizes(parents: DataFrame) -> DataFrame:
    """(node, descendants) of (node, parent) pointers."""
    edges = parents.filter("parent is not null").select(F.col("node").alias("source"), F.col("parent").alias("target"))
    below = closure(edges).filter("source <> target").groupBy("target").agg(F.count("*").alias("descendants"))
    return parents.select("node").distinct().join(below, F.col("node") == F.col("target"), "left").select("node", F.coalesce("descendants", F.lit(0)).alias("descendants"))
