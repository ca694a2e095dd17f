"""Rollout scoring and prompt difficulty.

Per-prompt statistics are computed with ``groupBy`` (partial aggregation before the
shuffle) and joined back on the prompt key, never with a window over the whole prompt
group: a prompt holding a third of all completions is then one pre-aggregated row. The truth
join and the join back go through ``skew.salted_join``, which deals the rows of hot prompts out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnsift.functions import rewards as rw
from vulnsift.functions import text as tx
from vulnsift.operators.evaluate import truth_classes
from vulnsift.operators.skew import salted_join
from vulnsift.schemas import CLASS_PARENTS, PASS_RATE_THRESHOLD
from vulnsift.session import kept


def with_truth(completions: DataFrame, contracts: DataFrame, key: str = "contract_id") -> DataFrame:
    """Each completion with its prompt's ground truth (left join; missing -> empty)."""
    c = contracts.select(key, "vulnerabilities")
    empty = F.array().cast(c.schema["vulnerabilities"].dataType)
    return salted_join(completions, c, key, "left").withColumn("vulnerabilities", F.coalesce("vulnerabilities", empty))


def score_rollouts(completions: DataFrame, contracts: DataFrame, tool_col: str | None = None,
                   keep_text: bool = False) -> DataFrame:
    """Class, line, format and total reward per completion.

    Text features are computed on the completion side before the truth join; the text itself
    is dropped there, so the join shuffles small arrays, not answers."""
    keep = [c for c in completions.columns if c != "text" or keep_text]
    feats = completions.select(*keep, *rw.text_features("text"))
    j = with_truth(feats, contracts).select(
        "*",
        rw.truth_numbers(truth_classes("vulnerabilities", default="")).alias("_gt"),
        rw.truth_intervals("vulnerabilities").alias("_truth_iv"),
    )
    cls = rw.class_reward(None, None, F.col("_model"), F.col("_gt"), F.col("_has_none"))
    line = rw.line_reward(None, "vulnerabilities", F.col("_pred_iv"), F.col("_truth_iv"))
    out = j.select(*keep, "vulnerabilities", cls.alias("class_reward"), line.alias("line_reward"), "format_reward")
    tool = F.col(tool_col) if tool_col else None
    return out.withColumn("reward", rw.total_reward(F.col("class_reward"), F.col("line_reward"),
                                                     F.col("format_reward"), tool))


def group_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per-group mean / min / max / count, aggregated map-side first."""
    return df.groupBy(key).agg(
        F.avg(value).alias("mean_reward"),
        F.min(value).alias("min_reward"),
        F.max(value).alias("max_reward"),
        F.count(F.lit(1)).alias("n"),
    )


def advantages(scored: DataFrame, key: str = "contract_id", value: str = "reward") -> DataFrame:
    """R - mean(r) of the prompt's group (no division by the std). The scored rows, a few numbers each, are written
    once: the group means and the join back read them instead of scoring twice."""
    scored = kept(scored.select(*[c for c in scored.columns if c != "vulnerabilities"]), "scored")
    return salted_join(scored, group_stats(scored, key, value), key).withColumn("advantage", F.col(value) - F.col("mean_reward"))


def drop_zero_gradient(with_adv: DataFrame) -> DataFrame:
    """Drop prompts whose rewards are all equal (all advantages 0)."""
    return with_adv.where(F.col("max_reward") != F.col("min_reward"))


def pass_rates(completions: DataFrame, contracts: DataFrame, key: str = "contract_id") -> DataFrame:
    """A05 + A06: mean 0/1 verifier reward over non-empty completions per prompt (prompts with
    none are dropped), and the share of completions whose combined reward is > 0. Text
    features are computed before the truth join."""
    nonempty = completions.where(F.coalesce(F.col("text"), F.lit("")) != "")
    feats = nonempty.select(*[c for c in completions.columns if c != "text"], *rw.text_features("text"))
    j = with_truth(feats, contracts, key)
    swcs = truth_classes("vulnerabilities", default="")
    j = j.select("*", rw.filter_verifier(None, swcs, F.col("_got"), F.col("_no_vuln")).alias("verified"),
                 rw.truth_numbers(swcs).alias("_gt"), rw.truth_intervals("vulnerabilities").alias("_truth_iv"))
    j = j.withColumn("reward", rw.total_reward(
        rw.class_reward(None, None, F.col("_model"), F.col("_gt"), F.col("_has_none")),
        rw.line_reward(None, "vulnerabilities", F.col("_pred_iv"), F.col("_truth_iv")),
        F.col("format_reward")))
    return j.groupBy(key).agg(
        F.avg("verified").alias("pass_rate"),
        F.avg((F.col("reward") > 0).cast("double")).alias("positive_share"),
        F.count(F.lit(1)).alias("n_completions"),
        F.sum("verified").cast("long").alias("n_correct"),
    )


def difficulty_filter(rates: DataFrame, threshold: float = PASS_RATE_THRESHOLD) -> DataFrame:
    """Keep prompts with pass_rate <= threshold."""
    return rates.where(F.col("pass_rate") <= F.lit(threshold))


def hard_only(rates: DataFrame) -> DataFrame:
    """P20: keep prompts the base model never solves."""
    return rates.where(F.col("pass_rate") == 0)


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Unbiased 1 - C(n-c, k)/C(n, k) as a running product; null when n < k."""
    ratio = F.aggregate(
        F.sequence(F.lit(0), F.lit(k - 1)),
        F.lit(1.0),
        lambda acc, i: acc * F.greatest(n - c - i, F.lit(0)).cast("double") / (n - i),
    )
    return F.when(n < k, F.lit(None).cast("double")).otherwise(F.lit(1.0) - ratio)


def self_consistency(completions: DataFrame, key: str = "contract_id") -> DataFrame:
    """Share of the modal answer (filter-dialect class, 'NONE' when absent) per prompt.

    Two aggregations, both pre-aggregated map-side: (prompt, answer) counts, then max/sum.
    """
    ans = completions.where(F.coalesce(F.col("text"), F.lit("")) != "").withColumn(
        "answer", F.coalesce(tx.class_filter_dialect("text"), F.lit("NONE")))
    cnt = ans.groupBy(key, "answer").agg(F.count(F.lit(1)).alias("cnt"))
    return cnt.groupBy(key).agg(
        (F.max("cnt") / F.sum("cnt")).alias("consistency"),
        F.count(F.lit(1)).alias("n_answers"),
    )


# --- F15 over all truth rows -----------------------------------------------------------------

def related_classes(spark: SparkSession, parents=CLASS_PARENTS) -> DataFrame:
    """(swc_id, related): the classes that share a weakness at any height with a class, from a fixed table of direct parents by
    recursion; a handful of rows."""
    spark.createDataFrame(parents, "child string, parent string").createOrReplaceTempView("_class_parents")
    pairs = spark.sql("""
        WITH RECURSIVE above AS (
          SELECT child AS swc_id, parent AS w FROM _class_parents WHERE child LIKE 'SWC%'
          UNION ALL SELECT a.swc_id, p.parent FROM above a JOIN _class_parents p ON p.child = a.w)
        SELECT x.swc_id, array_sort(collect_set(y.swc_id)) AS related FROM above x JOIN above y ON x.w = y.w AND x.swc_id <> y.swc_id
        GROUP BY x.swc_id""")
    spark.catalog.dropTempView("_class_parents")
    return pairs


def spec_rewards(completions: DataFrame, contracts: DataFrame, parents=CLASS_PARENTS) -> DataFrame:
    """F15 against every truth row of the prompt, the best one kept; a prompt without truth rows is clean. Answers are reduced to class,
    lines and severity before the join; the related classes travel as one map of a few entries."""
    keep = [c for c in completions.columns if c != "text"]
    j = with_truth(completions.select(*keep, *rw.spec_features("text")), contracts)
    lookup = related_classes(completions.sparkSession, parents).agg(F.map_from_entries(F.collect_list(F.struct("swc_id", "related"))).alias("_related"))
    j = j.join(F.broadcast(lookup))
    found, none = [F.col("_spec_got"), F.col("_spec_iv"), F.col("_spec_sev")], F.lit(None).cast("string")

    def score(swc: Column, lines: Column, severity: Column) -> Column:
        return rw.spec_detection_reward(None, swc, lines, severity, F.coalesce(F.col("_related")[swc], F.array().cast("array<string>")), found)

    each = F.transform("vulnerabilities", lambda v: score(v["swc_id"], F.coalesce(v["lines"], v["line_range"]), v["severity"]))
    clean = rw.spec_detection_reward(None, none, none, none, features=found)
    return j.select(*keep, F.when(F.size("vulnerabilities") > 0, F.array_max(each)).otherwise(clean).alias("reward"))
