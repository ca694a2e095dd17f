"""Exact global ranks, running sums, shuffles, splits and quotas without a one-task window
(W03, W04, W07, W10, W11, O01-O05, O08, U05, F14).

A plain ``row_number() over (order by …)`` puts every row into a single task. Here rows
are first given a *bucket* that is monotone in the order: a hash prefix for seeded shuffles; otherwise the
number of the range partition that Spark's own sort would put the row into, of which there are as many as keep a
bucket below a number of rows, at any size. Rows with equal keys are told apart by a random number, so a key that
half of all rows have is cut as well. The bucketed rows are written once, so every pass sees the same buckets. Then:

1. ``groupBy(group, bucket)`` counts (and sums) — pre-aggregated map-side, tiny output;
2. a window over that tiny table gives each bucket its offset (rows / measure before it);
3. the offsets are joined back on (group, bucket), the keys of the window that follows;
4. ``row_number`` / running sums run *within* each bucket, so the largest task holds one
   bucket (at most TASK_ROWS rows, or n / 16^hex_digits for hash buckets), never a whole group.

The result equals the single-window answer exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vulnsift.schemas import TRAIN_SPLIT
from vulnsift.session import kept

DEFAULT_HEX_DIGITS = 4  # 65,536 hash buckets: ~1.5e7 rows per window task at 1e12 rows
TASK_ROWS = 1 << 20  # most rows of an order-key bucket


def shuffle_key(seed: int, key: Column) -> Column:
    """W07 order: md5('<seed>:<key>'), ties broken by the key itself."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_bucket(h: Column, hex_digits: int = DEFAULT_HEX_DIGITS) -> Column:
    return F.substring(h, 1, hex_digits)


def order_buckets(df: DataFrame, keys: Sequence[str], most: int = TASK_ROWS) -> DataFrame:
    """`df`, written, with a bucket number `_bucket` that never falls along the order (*keys, `_tie`) and a random `_tie`. Any orderable
    types. Spark samples the range boundaries; buckets are planned at half of `most` rows, so that uneven ones stay below it."""
    rows = kept(df.withColumn("_tie", F.rand(29)), "order")
    tasks = -(-2 * rows.count() // most)
    if tasks <= 2:
        return rows.withColumn("_bucket", F.lit(0))
    return kept(rows.repartitionByRange(tasks, *keys, "_tie").withColumn("_bucket", F.spark_partition_id()), "order-buckets")


def ordered_rank(df: DataFrame, keys: Sequence[str], group: Sequence[str] = (), measure: str | None = None,
                 below: float | None = None, most: int = TASK_ROWS) -> DataFrame:
    """`exact_rank` in the order of `keys`, ties in no given order."""
    rows = order_buckets(df, keys, most)
    return exact_rank(rows, F.col("_bucket"), [*map(F.col, keys), F.col("_tie")], group, measure, below=below).drop("_tie")


def exact_rank(df: DataFrame, bucket: Column, order: Sequence[Column], group: Sequence[str] = (),
               measure: str | None = None, rank_col: str = "rank", size_col: str = "group_size",
               before_col: str = "before", below: float | None = None) -> DataFrame:
    """Adds `rank_col` (1-based row number within `group` in order (bucket, *order)), `size_col`
    (rows in the group) and, with `measure`, `before_col` = sum of `measure` over earlier rows.

    `bucket` must be non-decreasing along `order` (it is the leading sort key). With `below`, buckets that start with so much
    of `measure` before them are left out, before any of their rows is sorted.
    """
    g = list(group)
    b = df.withColumn("_bucket", bucket)
    aggs = [F.count(F.lit(1)).alias("_cnt")]
    if measure:
        aggs.append(F.sum(measure).alias("_msum"))
    counts = b.groupBy(*g, "_bucket").agg(*aggs)
    prior = Window.partitionBy(*g).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cols = [
        *g, "_bucket",
        F.coalesce(F.sum("_cnt").over(prior), F.lit(0)).alias("_off"),
        F.sum("_cnt").over(Window.partitionBy(*g)).alias(size_col),
    ]
    if measure:
        cols.append(F.coalesce(F.sum("_msum").over(prior), F.lit(0)).alias("_moff"))
    offsets = counts.select(*cols)
    if below is not None:
        offsets = offsets.where(F.col("_moff") < below)
    within = Window.partitionBy(*g, "_bucket").orderBy(*order)
    out = b.join(offsets, [*g, "_bucket"]).withColumn(rank_col, F.col("_off") + F.row_number().over(within))
    if measure:
        run = F.coalesce(F.sum(measure).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        out = out.withColumn(before_col, F.col("_moff") + run)
        out = out.drop("_moff")
    return out.drop("_bucket", "_off")


def seeded_shuffle(df: DataFrame, key: str, seed: int = 42, group: Sequence[str] = (),
                   hex_digits: int = DEFAULT_HEX_DIGITS) -> DataFrame:
    """Deterministic shuffle position `rank` (1-based) by md5(seed:key), tie on key."""
    h = shuffle_key(seed, F.col(key))
    d = df.withColumn("_h", h)
    return exact_rank(d, hash_bucket(F.col("_h"), hex_digits), [F.col("_h"), F.col(key)], group).drop("_h")


def train_validation_split(df: DataFrame, key: str, seed: int = 42, train_split: float = TRAIN_SPLIT,
                           group: Sequence[str] = ()) -> DataFrame:
    """W07 + U05: shuffle, then the first int(n * train_split) rows are 'train', the rest
    'validation' (disjoint and exhaustive by construction)."""
    r = seeded_shuffle(df, key, seed, group)
    cut = F.floor(F.col("group_size") * F.lit(float(train_split)))
    return r.withColumn("split", F.when(F.col("rank") <= cut, F.lit("train")).otherwise(F.lit("validation")))


def source_order_rank(df: DataFrame, source_rank: str, key: str, group: Sequence[str] = (),
                      measure: str | None = None, below: float | None = None, most: int = TASK_ROWS) -> DataFrame:
    """Rank in (source_rank, key) order — the engine's stand-in for file order; the key may be of any type."""
    return ordered_rank(df, [source_rank, key], group, measure, below, most)


def quota(n: int, ratio: float) -> int:
    """int(N * ratio) in double arithmetic, as Python computes it."""
    return int(n * ratio)


def first_n(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """First n rows in order — TakeOrderedAndProject keeps n per partition, then merges."""
    return df.orderBy(*order).limit(n)


def token_budget(ranked: DataFrame, target: float, before_col: str = "before") -> DataFrame:
    """Emit while the running total *before* the row is below the target (last row overshoots)."""
    return ranked.where(F.col(before_col) < F.lit(target))


def nested_sizes(ranked: DataFrame, sizes: Sequence[int], rank_col: str = "rank") -> DataFrame:
    """Membership of each row in nested prefixes of the given sizes (one rank, no re-sort)."""
    arr = F.array(*[F.lit(int(s)) for s in sizes])
    return ranked.select("*", F.explode(F.filter(arr, lambda s: F.col(rank_col) <= s)).alias("size"))
