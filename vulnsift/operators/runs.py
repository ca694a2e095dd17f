"""Run logs, trajectories and comparisons (A10, A11, A13-A24, W04-W06, W08, W09, W11, O06, O07,
D13, D16, D18, F19, F23, F24, P29).

Raw log rows are first reduced to one row per (experiment, stage, step) with a
pre-aggregating ``groupBy``; per-run windows then run over that reduced log, whose size
is bounded by the number of evaluation steps, not by the raw data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vulnsift.functions import rewards as rw
from vulnsift.operators import ordering as od
from vulnsift.schemas import MILESTONES, STAGE_PRIORITY

RUN = ("experiment", "stage")
METRICS = ("precision", "recall", "f1", "mean_length", "latency_ms")


def step_log(runs: DataFrame) -> DataFrame:
    """One row per (experiment, stage, step): mean of each metric over that step's rows."""
    return runs.groupBy(*RUN, "step").agg(*[F.avg(m).alias(m) for m in METRICS], F.count(F.lit(1)).alias("n_rows"))


def stage_priority(stage: Column) -> Column:
    expr = None
    for i, s in enumerate(STAGE_PRIORITY):
        expr = F.when(stage == s, F.lit(i)) if expr is None else expr.when(stage == s, F.lit(i))
    return expr.otherwise(F.lit(len(STAGE_PRIORITY)))


def best_stage(log: DataFrame) -> DataFrame:
    """Best available stage per experiment (rlvr before dpo before sft)."""
    return log.groupBy("experiment").agg(F.min_by("stage", stage_priority(F.col("stage"))).alias("best_stage"))


def final_metrics(log: DataFrame) -> DataFrame:
    """Metrics at the last step of each run."""
    return log.groupBy(*RUN).agg(
        F.max("step").alias("final_step"),
        *[F.max_by(m, "step").alias(m) for m in ("precision", "recall", "f1")],
    )


def run_compare(log: DataFrame) -> DataFrame:
    """One row per experiment with f1 / precision / recall of its best stage's final step
    (long form, then pivot on the fixed metric list)."""
    fin = final_metrics(log).join(best_stage(log), "experiment").where(F.col("stage") == F.col("best_stage"))
    long = fin.unpivot(["experiment", "best_stage"], ["f1", "precision", "recall"], "metric", "value")
    return long.groupBy("experiment", "best_stage").pivot("metric", ["f1", "precision", "recall"]).agg(F.first("value"))


def variant_compare(log: DataFrame, baseline: str) -> DataFrame:
    """Run comparison plus deltas against a baseline experiment. The comparison table has
    one row per experiment, so the baseline is read with a window over that small table."""
    cmp_ = run_compare(log)
    whole = Window.partitionBy()
    return cmp_.select(
        "experiment", "best_stage", "f1", "precision", "recall",
        *[(F.col(m) - F.max(F.when(F.col("experiment") == baseline, F.col(m))).over(whole)).alias(f"delta_{m}")
          for m in ("f1", "precision", "recall")])


def run_summary(log: DataFrame, min_f1: float = 0.20) -> DataFrame:
    """A10: per stage, evaluations logged, successful (f1 >= min_f1) and failed."""
    ok = F.col("f1") >= F.lit(min_f1)
    return log.groupBy("stage").agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("successful"),
                                    F.count_if(~ok).alias("failed"))


def early_stop(log: DataFrame, patience: int = 3) -> DataFrame:
    """Per run, the first step with `patience` evaluations in a row without a new max F1."""
    w = Window.partitionBy(*RUN).orderBy("step")
    prev_max = F.max("f1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = log.withColumn("improved", prev_max.isNull() | (F.col("f1") > prev_max))
    x = x.withColumn("last_improved", F.max(F.when(F.col("improved"), F.col("step"))).over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("since", F.sum(F.when(F.col("improved"), 0).otherwise(1)).over(
        Window.partitionBy(*RUN, "last_improved").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)))
    return x.where(F.col("since") >= patience).groupBy(*RUN).agg(F.min("step").alias("stop_step"))


def length_explosion(log: DataFrame, factor: float = 2.0) -> DataFrame:
    """Steps whose mean length exceeds factor x the run's starting mean length."""
    start = log.groupBy(*RUN).agg(F.min_by("mean_length", "step").alias("start_length"))
    return log.join(start, list(RUN)).where(F.col("mean_length") > F.lit(factor) * F.col("start_length")) \
        .select(*RUN, "step", "mean_length", "start_length")


def stage_gain(log: DataFrame, min_gain: float = 0.02) -> DataFrame:
    """Final F1 gain of each stage over the previous stage (sft -> dpo -> rlvr)."""
    fin = final_metrics(log).withColumn("order", -stage_priority(F.col("stage")))
    w = Window.partitionBy("experiment").orderBy("order")
    g = fin.withColumn("prev_f1", F.lag("f1").over(w)).withColumn("gain", F.col("f1") - F.col("prev_f1"))
    return g.select("experiment", "stage", "f1", "gain", (F.col("gain") > F.lit(min_gain)).alias("meets_gain"))


def top_checkpoints(log: DataFrame, k: int = 3) -> DataFrame:
    """The k best steps per run by F1 (ties: earlier step first)."""
    w = Window.partitionBy(*RUN).orderBy(F.desc("f1"), F.asc("step"))
    return log.withColumn("pos", F.row_number().over(w).cast("long")).where(F.col("pos") <= k).select(*RUN, "step", "f1", "pos")


def steps_to_target(log: DataFrame, target: float) -> DataFrame:
    """First step reaching the target F1 and the logged rows before it."""
    w = Window.partitionBy(*RUN).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    x = log.withColumn("rows_before", F.coalesce(F.sum("n_rows").over(w), F.lit(0)))
    return x.where(F.col("f1") >= F.lit(target)).groupBy(*RUN).agg(
        F.min("step").alias("first_step"), F.min_by("rows_before", "step").alias("examples_before"))


def milestone_gates(metrics: DataFrame, by: Sequence[str] = ("k",), f1_col: str = "f1") -> DataFrame:
    """F1 against each milestone gate (fixed three-row table, explode of a literal array)."""
    ms = F.array(*[F.struct(F.lit(c).alias("checkpoint"), F.lit(m).alias("model"), F.lit(v).alias("min_f1"))
                   for c, m, v in MILESTONES])
    x = metrics.select(*by, f1_col, F.explode(ms).alias("g"))
    return x.select(*by, f1_col, "g.checkpoint", "g.model", "g.min_f1", (F.col(f1_col) >= F.col("g.min_f1")).alias("passed"))


# --- trajectories ---------------------------------------------------------------------

def trajectory_scores(traj: DataFrame) -> DataFrame:
    """F19 per trajectory."""
    return traj.withColumn("score", rw.trajectory_score("compiled", "fixed", "new_findings", "tool_errors",
                                                        "format_violations"))


def best_worst(traj: DataFrame, key: str = "prompt_id", id_col: str = "traj_id") -> DataFrame:
    """Best and worst trajectory per prompt; ties go to the smaller id."""
    s = trajectory_scores(traj)
    return s.groupBy(key).agg(
        F.max_by(id_col, F.struct(F.col("score"), -F.col(id_col))).alias("best_id"),
        F.max("score").alias("best_score"),
        F.min_by(id_col, F.struct(F.col("score"), F.col(id_col))).alias("worst_id"),
        F.min("score").alias("worst_score"),
        F.count(F.lit(1)).alias("n"),
    )


def trajectory_pairs(traj: DataFrame) -> DataFrame:
    """Best vs worst trajectory per prompt, when their scores differ."""
    return best_worst(traj).where(F.col("best_score") > F.col("worst_score"))


def outcome_pairs(traj: DataFrame, key: str = "prompt_id", id_col: str = "traj_id") -> DataFrame:
    """Chosen pool = compiled, fixed, no new findings; rejected pool = compile failure, new findings, or the wrong
    vulnerability (nothing new, but the given one not fixed). The i-th trajectory of one pool meets the i-th of the other
    (by id), so each takes part in one pair at most. Without new findings a trajectory that does not fix the finding is
    taken to have named a wrong one."""
    good = F.col("compiled") & F.col("fixed") & (F.col("new_findings") == 0)
    pool = F.when(good, F.lit("chosen")).otherwise(F.lit("rejected"))
    why = F.when(~F.col("compiled"), F.lit("compile_failure")).when(F.col("new_findings") > 0, F.lit("new_findings")) \
        .otherwise(F.lit("wrong_vulnerability"))
    w = Window.partitionBy(key, "pool").orderBy(id_col)
    r = traj.select(key, id_col, pool.alias("pool"), why.alias("reason")).withColumn("i", F.row_number().over(w))
    c = r.where("pool = 'chosen'").select(key, "i", F.col(id_col).alias("chosen_id"))
    return c.join(r.where("pool = 'rejected'").select(key, "i", F.col(id_col).alias("rejected_id"), "reason"), [key, "i"])


def exact_percentiles(df: DataFrame, group: str, value: str, key: str, shares: dict[str, float]) -> DataFrame:
    """For each group and share the value at rank ceil(share * n) in (value, key) order; exact at any size, through the
    bucketed ranks of `ordering`."""
    r = od.ordered_rank(df.select(group, value, key), [value, key], [group])
    at = {name: F.max(F.when(F.col("rank") == F.ceil(F.lit(share) * F.col("group_size")), F.col(value))) for name, share in shares.items()}
    return r.groupBy(group).agg(*(c.alias(name) for name, c in at.items()))


def tercile(df: DataFrame, value: str, key_id: Column, name: str = "bucket") -> DataFrame:
    """ntile(3) over (value, id) without a one-task window: exact rank by (value, id)
    buckets, then the ntile formula (the first n % 3 tiles hold one extra row)."""
    d = df.withColumn("_id", key_id)
    r = od.ordered_rank(d, [value, "_id"])
    n, k = F.col("group_size"), F.col("rank")
    q, rem = F.floor(n / 3), n % 3
    big = rem * (q + 1)
    tile = F.when(k <= big, F.floor((k - 1) / (q + 1)) + 1).otherwise(rem + F.floor((k - 1 - big) / q) + 1)
    return r.withColumn(name, tile.cast("int")).drop("_id", "group_size")
