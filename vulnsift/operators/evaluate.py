"""Findings parse, set matching and evaluation metrics.

Plan shape: a completion's predicted classes come from its own text and a contract's
true classes from its own ``vulnerabilities`` array, so set matching is per-row array
algebra after a single join of completions to contracts on ``contract_id``. Metrics are
global or per-class aggregates with map-side partial aggregation, so a hot contract or
class never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnsift.functions import text as tx
from vulnsift.schemas import EVAL_TARGETS, PRIMARY_CLASSES


# --- F03: findings parse ------------------------------------------------------------

def findings_array(text) -> Column:
    """Parsed findings of one answer as array<struct>, in block order.

    1. an answer saying 'vulnerability: none' / 'no vulnerabilit...' has no findings;
    2. blocks are split on blank lines, blank blocks skipped;
    3. fields are first matches per block; severity defaults to Medium;
    4. a block is kept if it has a class or a type; a missing class is inferred from
       the type by the substring map.

    Each pattern runs once over a block: what it finds is bound to a field before clean-up names it more than once, and
    blocks without class and type are dropped before the other fields are looked for.
    """
    t = F.coalesce(tx.col_(text), F.lit(""))
    found = F.transform(tx.split_blocks(t), lambda b, i: F.struct(i.alias("block"), b.alias("_body"), *tx.block_raw(b, "swc_id", "vuln_type")))
    named = F.transform(found, lambda f: F.struct(
        f["block"].alias("block"), f["_body"].alias("_body"), tx.prefixed_id(f["swc_id"], "SWC").alias("swc_id"),
        tx.strip(f["vuln_type"]).alias("vuln_type")))
    kept = F.filter(named, lambda f: ((f["swc_id"] != "") | (f["vuln_type"] != "")) & tx.not_blank(f["_body"]))
    parsed = F.transform(kept, lambda f: F.struct(
        f["block"].alias("block"), f["swc_id"].alias("swc_id"), f["vuln_type"].alias("vuln_type"),
        *tx.block_raw(f["_body"], "cwe_id", "severity", "lines", "explanation")))
    cleaned = F.transform(parsed, lambda f: F.struct(
        f["block"].alias("block"), f["swc_id"].alias("swc_id"), tx.prefixed_id(f["cwe_id"], "CWE").alias("cwe_id"),
        f["vuln_type"].alias("vuln_type"), f["severity"].alias("severity"), tx.strip(f["lines"]).alias("lines"),
        tx.strip(f["explanation"]).alias("explanation")))
    shaped = F.transform(
        cleaned,
        lambda f: F.struct(
            f["block"].alias("block"),
            F.when(f["swc_id"] == "", tx.swc_from_type_substring(f["vuln_type"])).otherwise(f["swc_id"]).alias("swc_id"),
            tx.nullif_empty(f["cwe_id"]).alias("cwe_id"),
            f["vuln_type"].alias("vuln_type"),
            F.when(f["severity"] == "", F.lit("Medium")).otherwise(f["severity"]).alias("severity"),
            tx.nullif_empty(f["lines"]).alias("lines"),
            f["explanation"].alias("explanation"),
            F.lit(1.0).alias("confidence"),
        ),
    )
    return F.when(tx.says_none(t), F.array().cast(shaped_type())).otherwise(shaped)


def shaped_type() -> str:
    return ("array<struct<block:int,swc_id:string,cwe_id:string,vuln_type:string,severity:string,"
            "lines:string,explanation:string,confidence:double>>")


def parse_findings(completions: DataFrame, keys=("contract_id", "k"), text_col: str = "text") -> DataFrame:
    """F03 + E04: one row per finding (one text -> many rows via a native generator)."""
    return completions.select(*keys, F.explode(findings_array(text_col)).alias("f")).select(*keys, "f.*")


def predicted_classes(text) -> Column:
    """Classes of the parsed findings, duplicates kept, in block order."""
    return F.transform(findings_array(text), lambda f: f["swc_id"])


def truth_classes(vulns="vulnerabilities", default: str = "SWC-000") -> Column:
    """True classes of a contract, one per labelled vulnerability (duplicates kept)."""
    return F.transform(tx.col_(vulns), lambda v: F.coalesce(v["swc_id"], F.lit(default)))


def category(c: Column) -> Column:
    """swc[:7] — the first seven characters (whole id when shorter)."""
    return F.substring(c, 1, 7)


# --- J04 / U02 / U03: per-answer set matching -----------------------------------------

def score_answers(completions: DataFrame, contracts: DataFrame, strict: bool = True, keep=()) -> DataFrame:
    """Per answer (contract_id, k): tp, fp, fn over distinct classes, plus context.

    One equi-join on contract_id, whose strategy the planner chooses by size at run time; everything else is
    per-row array algebra.
    """
    c = contracts.select("contract_id", "is_vulnerable", "vulnerabilities")
    pred = predicted_classes("text")
    truth = truth_classes()
    if not strict:
        pred = F.transform(pred, category)
        truth = F.transform(truth, category)
    # predicted classes are computed before the join: the shuffle carries them, not the text
    p = completions.select("contract_id", "k", *keep, F.array_distinct(pred).alias("pred"))
    j = p.join(c, "contract_id").withColumn("truth", F.array_distinct(truth))
    return j.select(
        "contract_id", "k", "is_vulnerable",
        F.size(F.array_intersect("pred", "truth")).alias("tp"),
        F.size(F.array_except("pred", "truth")).alias("fp"),
        F.size(F.array_except("truth", "pred")).alias("fn"),
        F.size("pred").alias("n_pred"),
        F.array_join(F.array_sort(F.array_intersect("pred", "truth")), ",").alias("matched"),
        "pred", "truth", *keep,
    )


def with_unanswered(answered: DataFrame, contracts: DataFrame, pred: str = "pred") -> DataFrame:
    """Every contract in every evaluation run: a contract without an answer has no predictions. `answered` holds
    (contract_id, k, `pred`, ...); the run numbers, of which there are few, travel as one array."""
    runs = answered.agg(F.collect_set("k").alias("_runs"))
    grid = contracts.join(F.broadcast(runs)).withColumn("k", F.explode("_runs")).drop("_runs")
    j = grid.join(answered, ["contract_id", "k"], "left")
    return j.withColumn(pred, F.coalesce(pred, F.array().cast("array<string>")))


def score_runs(completions: DataFrame, contracts: DataFrame, strict: bool = True) -> DataFrame:
    """`score_answers` with a row for every contract of every run, answered or not."""
    pred, truth = predicted_classes("text"), truth_classes()
    if not strict:
        pred, truth = F.transform(pred, category), F.transform(truth, category)
    found = completions.select("contract_id", "k", F.array_distinct(pred).alias("pred"))
    c = contracts.select("contract_id", "is_vulnerable", F.array_distinct(truth).alias("truth"))
    return with_unanswered(found, c).select(
        "contract_id", "k", "is_vulnerable", F.size(F.array_intersect("pred", "truth")).alias("tp"),
        F.size(F.array_except("pred", "truth")).alias("fp"), F.size(F.array_except("truth", "pred")).alias("fn"),
        F.size("pred").alias("n_pred"), "pred", "truth")


# --- A02 / A03: confusion totals and rates ----------------------------------------------

def safe_div(num: Column, den: Column) -> Column:
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


def rates(df: DataFrame, tp="tp", fp="fp", fn="fn", tn="tn") -> DataFrame:
    """Precision, recall, f1, false-positive rate; 0.0 on a zero denominator."""
    p = safe_div(F.col(tp), F.col(tp) + F.col(fp))
    r = safe_div(F.col(tp), F.col(tp) + F.col(fn))
    df = df.withColumn("precision", p).withColumn("recall", r)
    return df.withColumn(
        "f1", F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0))
        .otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    ).withColumn("false_positive_rate", safe_div(F.col(fp), F.col(fp) + F.col(tn)))


def confusion_totals(scored: DataFrame, by=("k",)) -> DataFrame:
    """Class-count tp/fp/fn; tn counts clean contracts with no parsed finding."""
    agg = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_contracts"),
        F.count_if(F.col("is_vulnerable")).alias("vulnerable_contracts"),
        F.count_if(~F.col("is_vulnerable")).alias("clean_contracts"),
        F.sum("tp").cast("long").alias("tp"),
        F.sum("fp").cast("long").alias("fp"),
        F.sum("fn").cast("long").alias("fn"),
        F.count_if(~F.col("is_vulnerable") & (F.col("n_pred") == 0)).alias("tn"),
    )
    return rates(agg)


def evaluate(completions: DataFrame, contracts: DataFrame, by=("k",), strict: bool = True) -> DataFrame:
    """Benchmark evaluation, one metrics row per evaluation run (default: per sample index k). Contracts without
    an answer count: their true classes are missed."""
    return confusion_totals(score_runs(completions, contracts, strict), by)


# --- A04 / J05: per-class recall, counted per truth row ---------------------------------

def class_hits(scored: DataFrame) -> DataFrame:
    """Each truth row of each answer, hit when any prediction has its class."""
    return scored.select(
        "contract_id", "k", "pred",
        F.explode(F.col("truth_rows")).alias("swc_id"),
    ).select("contract_id", "k", "swc_id", F.array_contains("pred", F.col("swc_id")).alias("hit"))


def per_class_recall(completions: DataFrame, contracts: DataFrame, by=("k",)) -> DataFrame:
    """Tp / fn per true class, per truth row (not distinct); recall = tp/(tp+fn)."""
    c = contracts.select("contract_id", truth_classes().alias("truth_rows"))
    p = completions.select("contract_id", "k", predicted_classes("text").alias("pred"))
    hits = class_hits(with_unanswered(p, c))
    agg = hits.groupBy(*by, "swc_id").agg(
        F.count_if("hit").alias("tp"),
        F.count_if(~F.col("hit")).alias("fn"),
    )
    return agg.withColumn("recall", safe_div(F.col("tp"), F.col("tp") + F.col("fn")))


# --- A09: macro F1 ---------------------------------------------------------------------

def per_class_confusion(scored: DataFrame, by=("k",)) -> DataFrame:
    """J04 by class: for each class in pred ∪ truth of an answer, tp / fp / fn flags summed."""
    x = scored.select(*by, "pred", "truth", F.explode(F.array_union("pred", "truth")).alias("swc_id"))
    inp = F.array_contains("pred", F.col("swc_id"))
    intr = F.array_contains("truth", F.col("swc_id"))
    agg = x.groupBy(*by, "swc_id").agg(
        F.count_if(inp & intr).alias("tp"),
        F.count_if(inp & ~intr).alias("fp"),
        F.count_if(~inp & intr).alias("fn"),
    )
    p = safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    r = safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    return agg.withColumn("precision", p).withColumn("recall", r).withColumn(
        "f1", F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)))


def macro_f1(scored: DataFrame, by=("k",)) -> DataFrame:
    """Mean of per-class F1 over classes seen in truth or predictions."""
    return per_class_confusion(scored, by).groupBy(*by).agg(
        F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("n_classes"))


# --- J09 / F23: metrics vs targets -------------------------------------------------------

REPORT_LABELS = {
    "precision": "Precision:",
    "recall": "Recall:",
    "f1": "F1 Score:",
    "false_positive_rate": "False Positive Rate:",
}


def targets_frame(spark) -> DataFrame:
    return spark.createDataFrame(EVAL_TARGETS, "metric string, target double, higher_better boolean")


def target_report(metrics: DataFrame, by=("k",)) -> DataFrame:
    """Unpivot the four rates, join the (fixed, four-row) target table, PASS/FAIL by direction."""
    long = metrics.unpivot(list(by), list(REPORT_LABELS), "metric", "value")
    t = F.broadcast(targets_frame(metrics.sparkSession))
    j = long.join(t, "metric")
    passed = F.when(F.col("higher_better"), F.col("value") >= F.col("target")).otherwise(F.col("value") <= F.col("target"))
    label = F.create_map(*[F.lit(x) for kv in REPORT_LABELS.items() for x in kv])
    return j.select(
        *by, "metric", "value", "target", "higher_better",
        F.when(passed, F.lit("PASS")).otherwise(F.lit("FAIL")).alias("status"),
        F.format_string("  %-20s %6.1f%% (target: %5.1f%%) [%s]", label[F.col("metric")],
                        F.col("value") * 100, F.col("target") * 100,
                        F.when(passed, F.lit("PASS")).otherwise(F.lit("FAIL"))).alias("line"),
    )


def primary_classes_frame(spark) -> DataFrame:
    return spark.createDataFrame(PRIMARY_CLASSES, "swc_id string, class_name string, cwe string, target_f1 double")


def restrict_primary(df: DataFrame, col: str = "swc_id") -> DataFrame:
    """Keep rows whose class is one of the five primary classes (fixed five-row broadcast)."""
    p = F.broadcast(primary_classes_frame(df.sparkSession).select(F.col("swc_id").alias(col)))
    return df.join(p, col, "left_semi")


def with_class_attributes(df: DataFrame, col: str = "swc_id") -> DataFrame:
    """Class id -> name, CWE, target F1 (fixed five-row broadcast, left join)."""
    p = F.broadcast(primary_classes_frame(df.sparkSession).withColumnRenamed("swc_id", col))
    return df.join(p, col, "left")
