"""Mixtures and ablation arms as records.

Every item of a component has one place in that component's seeded shuffle. An arm takes the first rows of each component, so arms that
take more hold those that take less, and arms of different sweeps share rows. How many is a water level per arm: components that
cannot give their share give all they have, and the others rise in proportion to their ratios until the arm is full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vulnsift.operators import ordering as od
from vulnsift.session import kept


def water_fill(arms: DataFrame, supply: DataFrame) -> DataFrame:
    """(arm, component, take): `arms` (arm, component, ratio, size) says how many rows an arm wants and in which ratios, `supply` (component,
    n) what there is. Both are small: one row per component. take = floor(min(n, level * ratio)), the level such that an arm's
    shares add up to its size, or all there is."""
    rows = arms.join(F.broadcast(supply), "component", "left").where("ratio > 0").withColumn("n", F.coalesce("n", F.lit(0)).cast("double"))
    w = Window.partitionBy("arm").orderBy(F.col("n") / F.col("ratio"), "component")
    rows = rows.withColumn("given", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) \
        .withColumn("left", F.sum("ratio").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))) \
        .withColumn("level", (F.col("size") - F.col("given")) / F.col("left"))
    # components in the order in which they run dry: the first that does not run dry sets the level
    level = F.min(F.when(F.col("level") <= F.col("n") / F.col("ratio"), F.struct(F.col("n") / F.col("ratio"), "component", "level"))) \
        .over(Window.partitionBy("arm"))["level"]
    take = F.floor(F.least(F.col("n"), F.coalesce(level * F.col("ratio"), F.col("n"))) + 1e-9).cast("long")
    return rows.select("arm", "component", take.alias("take"))


def arm_records(items: DataFrame, arms: DataFrame, seed: int = 42) -> DataFrame:
    """(arm, component, item_id, rank): the records of every arm. `items` (component, item_id) is ranked once for all arms; the arms' counts are
    the only thing joined to it."""
    rows = kept(items, "items")
    takes = water_fill(arms, rows.groupBy("component").agg(F.count("*").alias("n")))
    ranked = od.seeded_shuffle(rows, "item_id", seed, group=["component"])
    return ranked.join(F.broadcast(takes), "component").where(F.col("rank") <= F.col("take")).select("arm", "component", "item_id", F.col("rank").cast("long").alias("rank"))


def token_arms(docs: DataFrame, key: str, tokens: str, budgets: list[tuple[str, float]], seed: int = 42) -> DataFrame:
    """(key, tokens, before, arm): nested token budgets over one seeded shuffle; a row is in every arm whose budget is not yet used up
    before it (W03)."""
    h = docs.select(key, tokens).withColumn("_h", od.shuffle_key(seed, F.col(key)))
    r = od.exact_rank(h, od.hash_bucket(F.col("_h")), [F.col("_h"), F.col(key)], measure=tokens, below=max(b for _, b in budgets)).drop("_h")
    arms = F.array(*[F.struct(F.lit(n).alias("arm"), F.lit(float(b)).alias("budget")) for n, b in budgets])
    return r.withColumn("_a", F.explode(F.filter(arms, lambda a: F.col("before") < a["budget"]))) \
        .select(key, tokens, F.col("before").cast("long").alias("before"), F.col("_a.arm").alias("arm"))
