"""Hard-negative mining by inner product over STR-packed R-trees.

Rows are tiled by sort-tile-recursive: slabs of the coordinate that varies most, each slab sorted by the next and cut into runs, one
tree a run; inside a tree the same goes on down to leaves of a few rows. A minimum bounding box bounds the inner product
of an anchor with everything in it from both sides (per coordinate, the anchor's entry times the nearer or the farther face). A
best-first queue takes boxes by their upper bound and drops those that miss every score window or lie strictly below the
k-th best so far. Every block of anchors (those of one tree) first searches its own tree; the k-th best found there goes with it
to all other trees, which return only what is better. Trees and blocks meet by the tree's number; a task holds one tree and
streams the blocks past it.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vulnsift.llm.common import keep_table

#: The integer grid, which rows are anchors, which labels are shifted, the window in hundredths.
SCALE, ANCHORS, SHIFTED, LABELS, LOW, HIGH = 256, 100, 7, 10, 30, 90
TREE_ROWS, LEAF, FAN = 8192, 32, 16
#: Inner products whose terms cannot add up to this are exact in doubles.
EXACT = 2.0 ** 53
LONG = 2 ** 63 - 1

TREES = "tree long, n int, d int, ids binary, labels binary, kind string, x binary"
_TREES = pa.schema([("tree", pa.int64()), ("n", pa.int32()), ("d", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()),
                    ("kind", pa.string()), ("x", pa.binary())])
FOUND = "block long, row int, slot int, id long, score long"
_FOUND = pa.schema([("block", pa.int64()), ("row", pa.int32()), ("slot", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])


def usable(vectors: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, x): rows that take part, labels shifted, components as whole doubles floor(256 * c)."""
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].cast("long").alias("label"),
                          vectors[vector_col].cast("array<double>").alias("x"))
    rows = rows.select("id", F.when(F.col("id") % SHIFTED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")).alias("label"),
                       F.transform("x", lambda c: c * SCALE).alias("x"))
    finite = F.forall("x", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    # floor() gives a long; doubles from 2^52 on are whole already
    whole = F.transform("x", lambda c: F.when(F.abs(c) < 2.0 ** 52, F.floor(c).cast("double")).otherwise(c))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite) \
        .select("id", "label", whole.alias("x"))


def tiled(x: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Row order of sort-tile-recursive: slabs by the coordinate that varies most, tiles in them by the next, leaves by the third."""
    dims = np.argsort(-x.var(axis=0), kind="stable")[:3]
    runs, leaves = [np.arange(len(x))], -(-len(x) // leaf)
    slabs = max(1, round(leaves ** (1 / 3)))
    for depth, dim in enumerate(dims):
        out = []
        for run in runs:
            run = run[np.argsort(x[run, dim], kind="stable")]
            size = leaf * -(-len(run) // (leaf * slabs)) if depth < len(dims) - 1 else len(run)
            out += [run[i:i + size] for i in range(0, len(run), max(1, size))]
        runs = out
    return np.concatenate(runs)


def _packed(x: np.ndarray) -> tuple[str, bytes]:
    """The narrowest type that holds the whole numbers, and their bytes."""
    most = np.abs(x).max(initial=0)
    kind = "i2" if most < 2 ** 15 else "i4" if most < 2 ** 31 else "f8"
    return kind, x.astype(kind).tobytes()


def trees(rows: DataFrame, n: int, d: int) -> DataFrame:
    """One row per tree: its rows in tiled order. Rows of one slab and coordinate, even equal rows, are cut into trees too."""
    count = max(1, -(-n // TREE_ROWS))
    spread = rows.agg(*[F.var_pop(F.col("x")[i]).alias(str(i)) for i in range(d)]).first()
    first, second = (sorted(range(d), key=lambda i: (-(spread[i] or 0.0), i)) * 2)[:2]
    slabs = max(1, round(count ** 0.5))
    edges = rows.agg(F.percentile_approx(F.col("x")[first], [i / slabs for i in range(1, slabs)], 10_000)).first()[0] if slabs > 1 else []
    slab = sum((F.when(F.col("x")[first] > e, 1).otherwise(0) for e in edges), F.lit(0)) if len(edges) < 64 else \
        F.size(F.filter(F.array([F.lit(e) for e in edges]), lambda e: e < F.col("x")[first]))
    keys = ["slab", "at", "id", "tie"]
    dealt = rows.select("id", "label", "x", slab.alias("slab"), F.col("x")[second].alias("at"), F.rand(7).alias("tie")) \
        .repartitionByRange(count, *keys).sortWithinPartitions(*keys).select("id", "label", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, size = TaskContext.get().partitionId() << 20, 0, [], 0

        def tree() -> pa.RecordBatch:
            nonlocal made, held, size
            table = pa.Table.from_batches(held)
            x = table.column(2).combine_chunks().flatten().to_numpy().reshape(-1, d)
            order = tiled(x)
            kind, data = _packed(x[order])
            made, held, size = made + 1, [], 0
            return pa.RecordBatch.from_arrays([
                pa.array([part + made - 1], pa.int64()), pa.array([len(x)], pa.int32()), pa.array([d], pa.int32()),
                *(pa.array([table.column(i).to_numpy()[order].astype("i8").tobytes()], pa.binary()) for i in (0, 1)),
                pa.array([kind]), pa.array([data], pa.binary())], schema=_TREES)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = min(batch.num_rows - at, TREE_ROWS - size)
                held.append(batch.slice(at, take))
                at, size = at + take, size + take
                if size == TREE_ROWS:
                    yield tree()
        if size:
            yield tree()

    return dealt.mapInArrow(run, TREES)


def _matrix(kind: str, data: bytes, d: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(-1, d).astype(np.float64)


class Tree:
    """Rows in tiled order, the boxes of their leaves, and the boxes of groups of leaves."""

    def __init__(self, row: dict):
        self.x = _matrix(row["kind"], row["x"], row["d"])
        self.ids, self.labels = np.frombuffer(row["ids"], "i8"), np.frombuffer(row["labels"], "i8")
        self.most = float(np.abs(self.x).max(initial=0))
        at = np.arange(0, len(self.x), LEAF)
        self.leaf_low, self.leaf_high = np.minimum.reduceat(self.x, at), np.maximum.reduceat(self.x, at)
        at = np.arange(0, len(at), FAN)
        self.low, self.high = np.minimum.reduceat(self.leaf_low, at), np.maximum.reduceat(self.leaf_high, at)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, ...]:
        """Least and greatest inner products of each anchor with each inner box and each leaf box."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        return (up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T,
                up @ self.leaf_low.T + down @ self.leaf_high.T, up @ self.leaf_high.T + down @ self.leaf_low.T)

    def products(self, q: np.ndarray, leaves: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, inner products) of an anchor with the rows of some leaves."""
        rows = (np.array(leaves)[:, None] * LEAF + np.arange(LEAF)).ravel()
        rows = rows[rows < len(self.x)]
        return rows, (self.x[rows] @ q).astype(np.int64)

    def all_products(self, q: np.ndarray) -> np.ndarray:
        """Inner products as Python integers, for numbers beyond the exact range of doubles."""
        whole = [int(c) for c in q]
        return np.array([sum(int(c) * w for c, w in zip(r, whole)) for r in self.x], object)


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k by falling score and rising id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    return np.lexsort((ids, -scores))[:k]


class Queries:
    """A block of anchors. Every anchor has slots, each with a window of scores and the k-th best known so far (score, id)."""

    def __init__(self, row: dict):
        self.q = _matrix(row["kind"], row["x"], row["d"])
        self.rows, self.labels = row["rows"], np.frombuffer(row["labels"], "i8")
        self.most = float(np.abs(self.q).max(initial=0))
        self.slots: list[list[tuple]] = [[] for _ in self.rows]  # (slot, low, high, k-th score, k-th id) of each anchor
        for r in row["slots"] or []:
            self.slots[r["at"]].append((r["slot"], r["low"], r["high"], r["kth"], r["kth_id"]))


def search(tree: Tree, own: bool, block: Queries, k: int, same: bool) -> Iterator[tuple[int, int, int, int]]:
    """(row, slot, id, score) of up to k rows of the tree for each slot of each anchor: of the anchor's label (`same`, the anchor's own
    row left out) or of other labels, within the slot's window, better than its k-th so far; best first, ties by smaller id."""
    exact = tree.most * block.most * tree.x.shape[1] < EXACT
    if exact:
        in_low, in_high, leaf_low, leaf_high = tree.bounds(block.q)
    for a, (row, label, slots) in enumerate(zip(block.rows, block.labels, block.slots)):
        if not slots:
            continue
        fits = (tree.labels == label) if same else (tree.labels != label)
        if own and same:
            fits[row] = False
        least, most = min(s[1] for s in slots), max(s[2] for s in slots)
        floors = [s[3] for s in slots]          # the k-th best score of each slot so far
        if not exact:
            products = tree.all_products(block.q[a])
            got_rows = np.flatnonzero(fits)
            got = products[got_rows]
        else:
            lowest = max(least, min(floors))
            queue = [(-u, i, -1) for i, (w, u) in enumerate(zip(in_low[a].tolist(), in_high[a].tolist())) if u >= lowest and w <= most]
            heapq.heapify(queue)
            leaves: list[int] = []
            parts_rows, parts = [], []
            kept = 0
            while queue or leaves:
                if queue and -queue[0][0] < max(least, min(floors)):
                    queue = []                  # all that is left lies strictly below
                if queue:
                    _, group, leaf = heapq.heappop(queue)
                    if leaf < 0:
                        for i in range(group * FAN, min((group + 1) * FAN, leaf_low.shape[1])):
                            w, u = leaf_low[a, i], leaf_high[a, i]
                            if u >= lowest and any(u >= max(s[1], f) and w <= s[2] for s, f in zip(slots, floors)):
                                heapq.heappush(queue, (-u, group, i))
                        continue
                    leaves.append(leaf)
                    if len(leaves) < FAN and queue:
                        continue
                if leaves:
                    rows, products = tree.products(block.q[a], leaves)
                    leaves = []
                    keep = fits[rows] & (products >= max(least, min(floors))) & (products <= most)
                    if keep.any():
                        parts_rows.append(rows[keep])
                        parts.append(products[keep])
                        kept += int(keep.sum())
                        if kept >= k:           # raise the floors by what is known now
                            known = np.concatenate(parts)
                            for i, s in enumerate(slots):
                                inside = known[(known >= s[1]) & (known <= s[2])]
                                if len(inside) >= k:
                                    floors[i] = max(floors[i], int(np.partition(inside, len(inside) - k)[len(inside) - k]))
                        lowest = max(least, min(floors))
            got_rows = np.concatenate(parts_rows) if parts else np.zeros(0, np.int64)
            got = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        for slot, low, high, kth, kth_id in slots:
            inside = ((got >= low) & (got <= high) & (got >= kth)).astype(bool)
            ids, scores = tree.ids[got_rows[inside]], got[inside]
            better = ((scores > kth) | (ids < kth_id)).astype(bool)
            ids, scores = ids[better], scores[better]
            for i in top(scores, ids, k):
                yield row, slot, int(ids[i]), max(-LONG, min(LONG, int(scores[i])))


def meet(numbered: DataFrame, count: int, blocks: DataFrame, k: int, same: bool) -> DataFrame:
    """What each block of anchors finds in each tree it is sent to (`route`, a tree's number). A task reads a tree, then its blocks."""
    nothing = {"slots": "array<struct<at:int,slot:int,low:long,high:long,kth:long,kth_id:long>>", "rows": "array<int>", "block": "long"}
    both = numbered.select("route", F.lit(0).alias("what"), *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()),
                           "tree", "d", "ids", "labels", "kind", "x") \
        .unionByName(blocks.select("route", F.lit(1).alias("what"), *nothing, F.lit(None).cast("long").alias("tree"), "d",
                                   F.lit(None).cast("binary").alias("ids"), "labels", "kind", "x"))
    dealt = both.repartition(count, "route").sortWithinPartitions("route", "what", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, number = None, None
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                if row["what"] == 0:
                    tree, number = Tree(row), row["tree"]
                    continue
                found = [(row["block"], *f) for f in search(tree, number == row["block"], Queries(row), k, same)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), _FOUND)], schema=_FOUND)

    return dealt.mapInArrow(run, FOUND)


def first_of(found: DataFrame, k: int) -> DataFrame:
    """The first k of each slot by falling score and rising id, with their `rank`."""
    order = Window.partitionBy("block", "row", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def anchors(numbered: DataFrame) -> DataFrame:
    """One row per tree that holds anchors: their row numbers in it, labels and vectors, and one slot for each with an open window."""
    schema = ("block long, route int, n int, d int, rows array<int>, anchor_ids array<long>, labels binary, kind string, x binary")
    arrow = pa.schema([("block", pa.int64()), ("route", pa.int32()), ("n", pa.int32()), ("d", pa.int32()), ("rows", pa.list_(pa.int32())),
                       ("anchor_ids", pa.list_(pa.int64())), ("labels", pa.binary()), ("kind", pa.string()), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                ids, labels = np.frombuffer(row["ids"], "i8"), np.frombuffer(row["labels"], "i8")
                which = np.flatnonzero(ids % ANCHORS == 0)
                if len(which):
                    x = np.frombuffer(row["x"], row["kind"]).reshape(-1, row["d"])[which]
                    values = [row["tree"], row["route"], len(which), row["d"], which.tolist(), ids[which].tolist(),
                              labels[which].tobytes(), row["kind"], x.tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, arrow)], schema=arrow)

    return numbered.select("tree", "route", "d", "ids", "labels", "kind", "x").mapInArrow(run, schema)


def _with_slots(blocks: DataFrame, slots: DataFrame) -> DataFrame:
    """Blocks with their slots; (block, row, slot, low, high, kth, kth_id) become one array of each block, by place of the anchor."""
    held = slots.groupBy("block").agg(F.collect_list(F.struct("row", "slot", "low", "high", "kth", "kth_id")).alias("given"))
    place = F.transform("given", lambda s: F.struct(
        (F.array_position("rows", s["row"]) - 1).cast("int").alias("at"), s["slot"].alias("slot"), s["low"].alias("low"),
        s["high"].alias("high"), s["kth"].alias("kth"), s["kth_id"].alias("kth_id")))
    return blocks.join(held, "block").withColumn("slots", place).drop("given")


def _search_all(numbered: DataFrame, blocks: DataFrame, slots: DataFrame, k: int, same: bool, count: int, label: str) -> DataFrame:
    """The first k of every slot over all trees: each block searches its own tree, then, with the k-th best of that, the others."""
    lowest = F.lit(-LONG)
    start = _with_slots(blocks, slots.withColumns({"kth": lowest, "kth_id": F.lit(LONG)}))
    home = keep_table(meet(numbered, count, start, k, same), f"{label}-own")
    kth = first_of(home, k).where(F.col("rank") == k).select("block", "row", "slot", F.col("score").alias("kth"), F.col("id").alias("kth_id"))
    known = slots.join(kth, ["block", "row", "slot"], "left") \
        .withColumns({"kth": F.coalesce("kth", lowest), "kth_id": F.coalesce("kth_id", F.lit(LONG))})
    away = _with_slots(blocks, known).withColumn("home", F.col("route")) \
        .withColumn("route", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).where(F.col("route") != F.col("home"))
    return keep_table(first_of(home.unionByName(meet(numbered, count, away, k, same)), k), label)


def mine(vectors: DataFrame, positives: int = 5, negatives: int = 10, id_col: str = "vec_id", label_col: str = "label",
         vector_col: str = "embedding") -> DataFrame:
    """One row per anchor, positive and rank: the hard negative, and both scores.

    Rows without an id, a label or a vector, or with a null or non-finite component, take no part, nor do those whose vector is
    not of the commonest length (of equally common ones the longest). Of repeated rows each is a row: an anchor twice over gives its
    rows twice, and a copy of the anchor is one of its positives. Anchors without positives or without rows in the window
    give no rows; an empty table gives none; other columns are not read. Scores beyond a long are returned as the nearest long.
    """
    spark = vectors.sparkSession
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = usable(vectors, id_col, label_col, vector_col)
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).where("d > 0").orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], result)
    d, n = sizes[0]["d"], sizes[0]["n"]
    packed = keep_table(trees(rows.where(F.size("x") == d), n, d), "rtrees")
    names = packed.select("tree").withColumn("route", F.row_number().over(Window.orderBy("tree")) - 1)
    numbered, count = packed.join(names, "tree"), packed.count()
    blocks = keep_table(anchors(numbered), "anchors")
    each = blocks.select("block", F.posexplode("rows").alias("at", "row"), "anchor_ids") \
        .select("block", "row", F.col("anchor_ids")[F.col("at")].alias("anchor_id"))

    open_window = each.select("block", "row", F.lit(0).alias("slot"), F.lit(-LONG).alias("low"), F.lit(LONG).alias("high"))
    near = _search_all(numbered, blocks, open_window, positives, True, count, "positives") \
        .select("block", "row", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    # 30 * p <= 100 * s <= 90 * p for whole s: from ceil(30p / 100) to floor(90p / 100)
    p = F.col("positive_score").cast("decimal(20,0)")
    window = near.select("block", "row", "slot", F.ceil(p * LOW / 100).cast("long").alias("low"), F.floor(p * HIGH / 100).cast("long").alias("high")) \
        .where("low <= high")
    far = _search_all(numbered, blocks, window, negatives, False, count, "negatives") \
        .select("block", "row", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return far.join(near, ["block", "row", "slot"]).join(each, ["block", "row"]) \
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
