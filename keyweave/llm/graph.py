"""Connected components in tables: edges are contracted where they lie, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.cluster import cut, dealt
from keyweave.llm.textkit import batch_of, map_batches

#: Edges that one task contracts at about the same time.
TASK_EDGES = 500_000
_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return r[0], r[1]


def forest(u: list[int], v: list[int]) -> tuple[list[int], list[int]]:
    """Edges from each node to the smallest that it reaches by the given ones."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in zip(u, v, strict=True):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    return nodes, [root(x) for x in nodes]


def _contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """The same components with one edge for each node and task; nothing is shuffled."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = [], []
        for batch in batches:
            u += batch.column(0).to_pylist()
            v += batch.column(1).to_pylist()
            if len(u) > 2 * TASK_EDGES:  # a task may be given more: what it holds stays one edge a node
                u, v = forest(u, v)
                if len(u) > TASK_EDGES:
                    yield batch_of(_EDGES, u=u, v=v)
                    u, v = [], []
        u, v = forest(u, v)
        if u:
            yield batch_of(_EDGES, u=np.array(u), v=np.array(v))

    return map_batches(edges.coalesce(tasks), contract, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v): label is the smallest node that it reaches.

    Each round contracts the edges of each task, which leaves one a node, and where there is more than
    one task, shuffles them by node, with sums first that are dealt out anew before links are joined
    with them: so Spark splits the links of a node that has many.  A single task's edges, TASK_EDGES at
    most, need no round.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        tasks = -(-state[0] // TASK_EDGES)
        edges = _contracted(edges, tasks)
        if tasks == 1:
            edges = cut(edges)
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(dealt(least, "u", "m"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(dealt(least, "u", "m"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
