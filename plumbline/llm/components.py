"""Connected components of a link table.

Up to ``LOCAL_LINKS`` links (counted first) are joined by one executor task, which
costs one job.  Beyond that alternating stars run: each round is two grouped minima
and two equi-joins over the remaining links, which shrink to one star a component.
Nothing is sent to the driver but two numbers a round.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm.common import checkpointed, removed, shared_folder

#: Links that one task joins: 16 bytes each in Arrow, and up to a few hundred where Python holds them.
LOCAL_LINKS = 500_000


class Forest:
    """Union-find over any orderable values; the least value of a tree is its root."""

    def __init__(self, links: Iterable[tuple] = ()):
        self.up: dict = {}
        for a, b in links:
            self.join(a, b)

    def root(self, x):
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = p
        return x

    def join(self, a, b) -> bool:
        """Whether the link joined two trees."""
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(pairs: DataFrame) -> DataFrame:
    """(v, smallest neighbour of u) for each pair (u, v); u's own value counts too."""
    least = pairs.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("hub"), F.least("u", "low").alias("low"))
    return pairs.join(least, pairs.u == least.hub).select("u", "v", "low")


def _in_one_task(links: DataFrame) -> DataFrame:
    kind = links.schema["u"].dataType
    arrow = to_arrow_type(kind)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        nodes = list(forest.up)
        for at in range(0, len(nodes), 100_000):
            part = nodes[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, arrow), pa.array(map(forest.root, part), arrow)], ["node", "root"])

    return links.coalesce(1).mapInArrow(walk, f"node {kind.simpleString()}, root {kind.simpleString()}")


def connected_components(links: DataFrame, max_rounds: int = 60, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(node, root) for every node of ``links(u, v)``; root is the least node reachable.

    Self-links and repeated links change nothing; an empty table gives an empty
    result.  Nodes may be any orderable type but not null.
    """
    spark = links.sparkSession
    links = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links, before = checkpointed(links), None
    if links.count() <= local_links:
        return _in_one_task(links)
    folder = f"{shared_folder(spark)}/components-{uuid.uuid4().hex}"
    for k in range(max_rounds):
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(state) == before:
            break
        before = tuple(state)
        large = _star(_both_ways(links)).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.filter("u <> v").distinct()
        small = _star(large)
        small = small.select(F.col("v").alias("u"), F.col("low").alias("v")).unionAll(small.select("u", F.col("low").alias("v")))
        small.filter("u <> v").distinct().write.parquet(f"{folder}/{k}")
        links = spark.read.parquet(f"{folder}/{k}")
        if k:
            removed(spark, f"{folder}/{k - 1}")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
