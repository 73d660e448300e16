"""Connected components of edge tables, without a key meeting in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.runtime import written


class Forest:
    """Union-find over 0..n-1; the root is the smallest member."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def contract(edges: DataFrame) -> DataFrame:
    """Edges (a, b), each partition's own replaced by stars around the smallest node of each of its trees."""
    kind = dict(edges.dtypes)["a"]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict = {}
        names: list = []
        pairs: list[tuple[int, int]] = []
        for batch in frames:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for v in (x, y):
                    if v not in numbers:
                        numbers[v] = len(names)
                        names.append(v)
                pairs.append((numbers[x], numbers[y]))
        if not pairs:
            return
        order = sorted(range(len(names)), key=names.__getitem__)
        place = np.empty(len(names), np.int64)
        place[order] = np.arange(len(names))
        forest = Forest(len(names))
        for x, y in pairs:
            forest.union(int(place[x]), int(place[y]))
        out = [(names[order[v]], names[order[forest.find(v)]]) for v in range(len(names)) if forest.find(v) != v]
        for i in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out[i : i + 10_000]], batch.column(0).type) for j in (0, 1)], names=["a", "b"])

    return edges.select("a", "b").where("a <> b").mapInArrow(run, f"a {kind}, b {kind}")


#: Edges that one task contracts.
EDGES_PER_TASK = 200_000


def connected_components(edges: DataFrame, per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(node, label): label is the smallest node reachable; only nodes of edges are listed.

    Rounds over edges (a, b) with b < a, in as many tasks as there are `per_task` edges. First every task, which has
    all edges of its nodes a, contracts them to stars by union-find. Then every edge (a, b) jumps to (a, the least
    parent of b). Neither step adds edges nor parts what is connected, since the nodes on the way to a root keep edges
    upwards. The rounds end when every node has one parent, and that a root; in one task the first step does it.
    A node has at most one row from each task in the first step; hot parents in the second are split by the skew join.
    """
    edges = written(contract(edges), "edges")
    n = edges.count()
    turn = 0
    while n:
        tasks = -(-n // per_task)
        stars = written(contract(edges.repartition(tasks, "a") if tasks > 1 else edges.coalesce(1)), f"stars{turn}")
        if tasks == 1:
            edges = stars
            break
        parents = stars.groupBy("a").agg(F.min("b").alias("up"), F.count("*").alias("n"))
        parents = written(parents.select(F.col("a").alias("b"), "up", "n"), f"parents{turn}")
        jumped = stars.join(parents.select("b", "up"), "b", "left").select("a", F.coalesce("up", "b").alias("b"), F.col("up").isNotNull().alias("jumped"))
        jumped = written(jumped, f"jumped{turn}")
        edges, turn = jumped.select("a", "b"), turn + 1
        at = jumped.agg(F.count("*").alias("n"), F.count_if("jumped").alias("jumped")).first()
        n = at.n
        if not at.jumped and n == parents.count():
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
