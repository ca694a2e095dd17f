"""Equi-joins that a hot key of the large side does not bring to one task.

The few keys that hold more than a share of all rows are found by one mergeable sketch over the key column, so only
a bounded number of them can exist. A row of the large side with such a key gets a salt from its own content; the
other side's row of that key is repeated once for each salt. All other keys have the one salt 0. No plan depends on the
adaptive engine's skew handling, which cannot split a join whose input arrives partitioned by the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

#: A key is hot from this share of all rows on; its rows are dealt in parts of about this share.
SHARE = 1 / 64


def heavy_keys(df: DataFrame, key: str, share: float = SHARE) -> DataFrame:
    """(key, copies): the keys with more than `share` of the rows, at most 1 / share of them, and in how many parts to deal
    each. Counts are those of a sketch that tracks far more keys than can be hot: an error changes the parts, no result."""
    most = int(2 / share)
    top = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_k")) \
        .agg(F.expr(f"approx_top_k(_k, {most}, {64 * most})").alias("top"), F.count("*").alias("n"))
    return top.select("n", F.inline("top").alias("item", "count")).where(F.col("count") > F.col("n") * share) \
        .select(F.col("item").alias(key), F.ceil(F.col("count") / (F.col("n") * share)).cast("int").alias("_copies"))


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", share: float = SHARE) -> DataFrame:
    """`left` joined with `right` on `key` (inner or left), rows of hot keys of `left` dealt over several tasks. Rows of `left`
    that are equal in all columns stay together."""
    hot = F.broadcast(heavy_keys(left, key, share))  # at most 1 / share rows
    content = [f.name for f in left.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    dealt = left.join(hot, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*content), F.col("_copies")), F.lit(0)).cast("int"))
    every = F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1)
    repeated = right.join(hot, key, "left").withColumn("_salt", F.explode(every)).drop("_copies")
    return dealt.drop("_copies").join(repeated, [key, "_salt"], how).drop("_salt")
