"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnsift.llm.common import keep_table, shuffles_freed

#: Edges in one file of a step's table; edges that one task can put together.
FILE_EDGES, LAST_EDGES = 500_000, 500_000


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def files_for(rows: int) -> int:
    """Files that so many edges fill."""
    return max(1, rows // FILE_EDGES)


def _mark(edges: DataFrame) -> tuple:
    with shuffles_freed(edges.sparkSession):
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root for every end of the edges (a, b, longs): root is the smallest node reachable.

    Once no more than LAST_EDGES edges are left, one task puts them together. Each step keeps its edges as a table in the shared folder, in as many files as they fill; a node with very many
    neighbours is met as one pre-aggregated minimum, and its neighbours are split by the join. Nothing but two numbers of
    each step reaches the driver.
    """
    now = keep_table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    while mark[0] > LAST_EDGES:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b") \
            .unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        now = keep_table(small.coalesce(files_for(mark[0])), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        return now.coalesce(1).mapInArrow(_roots, "node long, root long")
    roots = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root of all edges of the batches."""
    number, edges = {}, []
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            edges.append((number.setdefault(a, len(number)), number.setdefault(b, len(number))))
    nodes = sorted(number)
    rank = {number[node]: k for k, node in enumerate(nodes)}  # the forest's roots are its smallest members
    forest = Forest(len(nodes))
    for a, b in edges:
        forest.join(rank[a], rank[b])
    roots = [nodes[forest.root(k)] for k in range(len(nodes))]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], names=["node", "root"])
