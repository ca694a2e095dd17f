"""Verifiable rewards as Column expressions.

Inputs are an answer's text and the contract's truth array (``vulnerabilities``).
Everything is built-in higher-order functions; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vulnsift.functions import text as tx
from vulnsift.schemas import FORMAT_FIELD_PATTERNS, REWARD_WEIGHTS, TOOL_WEIGHT

# Fixed value: the line pattern.
_PRED_LINES = r"(?U)Lines?[:\s]*(\d+)(?:\s*-\s*(\d+))?"  # case-sensitive, as in the line reward


# --- F07: class reward --------------------------------------------------------------

def truth_numbers(truth_swcs) -> Column:
    return F.transform(tx.col_(truth_swcs), lambda s: F.replace(F.coalesce(s, F.lit("")), F.lit("SWC-"), F.lit("")))


def class_reward(text, truth_swcs, model: Column | None = None, gt: Column | None = None,
                 has_none: Column | None = None) -> Column:
    """+1/-1 on a clean contract; on a vulnerable one m/max(n_truth, n_pred) with duplicates
    counted, -0.5 on a wrong class, -1 when no class is given.

    ``model`` / ``gt`` / ``has_none`` may be passed as already-computed columns (reward dialect
    classes, truth class numbers, 'none' in the lower-cased text) so a plan evaluates each regex
    once and can compute the text features before a join."""
    if model is None or has_none is None:
        t = F.coalesce(tx.col_(text), F.lit(""))
        model = tx.classes_reward_dialect(t) if model is None else model
        has_none = F.lower(t).contains("none") if has_none is None else has_none
    gt = truth_numbers(truth_swcs) if gt is None else gt
    m = F.size(F.filter(model, lambda x: F.array_contains(gt, x)))
    return (
        F.when(F.size(gt) == 0,
               F.when((F.size(model) == 0) | has_none, F.lit(1.0)).otherwise(F.lit(-1.0)))
        .when(F.size(model) == 0, F.lit(-1.0))
        .when(m > 0, m / F.greatest(F.size(gt), F.size(model)))
        .otherwise(F.lit(-0.5))
    )


# --- U04 / F08: line-set IoU by interval arithmetic ------------------------------------

def _interval(s: Column, e: Column) -> Column:
    return F.struct(s.cast("long").alias("s"), e.cast("long").alias("e"))


def union_size(intervals: Column) -> Column:
    """Number of integers covered by a list of closed intervals (empty ones ignored).

    Sort by start, then one left fold that merges overlaps: O(n log n) per row and no
    enumeration of the lines, so a range like 1-999999999 costs the same as 1-2.
    """
    valid = F.array_sort(F.filter(intervals, lambda iv: iv["s"] <= iv["e"]))
    init = F.struct(F.lit(0).cast("long").alias("tot"), F.lit(None).cast("long").alias("cs"),
                    F.lit(None).cast("long").alias("ce"))

    def step(acc, iv):
        fresh = acc["cs"].isNull()
        joins = ~fresh & (iv["s"] <= acc["ce"] + 1)
        return F.struct(
            F.when(fresh | joins, acc["tot"]).otherwise(acc["tot"] + acc["ce"] - acc["cs"] + 1).alias("tot"),
            F.when(joins, acc["cs"]).otherwise(iv["s"]).alias("cs"),
            F.when(joins, F.greatest(acc["ce"], iv["e"])).otherwise(iv["e"]).alias("ce"),
        )

    def finish(acc):
        return F.when(acc["cs"].isNull(), acc["tot"]).otherwise(acc["tot"] + acc["ce"] - acc["cs"] + 1)

    return F.aggregate(valid, init, step, finish)


def predicted_intervals(text) -> Column:
    """Every 'Line(s): a[-b]' match (case-sensitive) as an interval; b defaults to a."""
    t = F.coalesce(tx.col_(text), F.lit(""))
    starts = tx.extract_all(t, _PRED_LINES, 1)
    ends = tx.extract_all(t, _PRED_LINES, 2)
    return F.transform(
        F.arrays_zip(starts.alias("a"), ends.alias("b")),
        lambda z: _interval(z["a"].try_cast("long"),
                            F.when(z["b"] == "", z["a"]).otherwise(z["b"]).try_cast("long")),
    )


def truth_interval(lines: Column) -> Column:
    """'a-b' -> [a, b]; 'n' -> [n, n]; anything malformed -> empty (null bounds)."""
    txt = F.coalesce(lines, F.lit(""))
    parts = F.split(txt, "-")
    two = (F.size(parts) == 2)
    a = F.when(two, F.trim(F.get(parts, 0)).try_cast("long"))
    b = F.when(two, F.trim(F.get(parts, 1)).try_cast("long"))
    single = F.trim(txt).try_cast("long")
    has_dash = txt.contains("-")
    return F.when(has_dash, _interval(a, b)).otherwise(_interval(single, single))


def truth_intervals(vulns) -> Column:
    """Truth ranges from each vulnerability's `lines`, else `line_range`."""
    return F.filter(
        F.transform(tx.col_(vulns), lambda v: truth_interval(F.coalesce(v["lines"], v["line_range"]))),
        lambda iv: iv["s"].isNotNull() & iv["e"].isNotNull(),
    )


def interval_iou(a: Column, b: Column) -> Column:
    """|A ∩ B| / |A ∪ B| over integer sets given as interval lists; 0.0 when either is empty."""
    na, nb = union_size(a), union_size(b)
    nu = union_size(F.concat(a, b))
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise((na + nb - nu) / nu)


def line_reward(text, vulns, pred: Column | None = None, truth: Column | None = None) -> Column:
    """IoU of predicted and true line sets; 0.0 without truth or without any match.

    ``pred`` / ``truth`` may be passed as already-computed interval-list columns."""
    pred = predicted_intervals(text) if pred is None else pred
    truth = truth_intervals(vulns) if truth is None else truth
    has_truth = F.size(tx.col_(vulns)) > 0
    return F.when(~has_truth | (F.size(pred) == 0), F.lit(0.0)).otherwise(interval_iou(pred, truth))


# --- F09 / F10 -----------------------------------------------------------------------

def format_reward(text) -> Column:
    """share of the five field labels present (case-insensitive)."""
    t = F.coalesce(tx.col_(text), F.lit(""))
    hits = [F.when(tx.matches(t, "(?iU)" + p), 1).otherwise(0) for p in FORMAT_FIELD_PATTERNS]
    return sum(hits[1:], hits[0]) / F.lit(float(len(FORMAT_FIELD_PATTERNS)))


def total_reward(cls: Column, line: Column, fmt: Column, tool: Column | None = None) -> Column:
    """0.5 class + 0.3 line + 0.2 format; with a tool score, 0.8 total + 0.2 tool."""
    wc, wl, wf = REWARD_WEIGHTS
    total = F.lit(wc) * cls + F.lit(wl) * line + F.lit(wf) * fmt
    if tool is None:
        return total
    return F.when(tool.isNull(), total).otherwise(F.lit(1 - TOOL_WEIGHT) * total + F.lit(TOOL_WEIGHT) * tool)


# --- F11: filter verifier ----------------------------------------------------------

def filter_verifier(text, truth_swcs, got: Column | None = None, no_vuln: Column | None = None) -> Column:
    """0/1 reward of the difficulty filter (filter dialect of the class). `got` / `no_vuln`
    may be passed as precomputed text features."""
    if got is None or no_vuln is None:
        t = F.coalesce(tx.col_(text), F.lit(""))
        got = tx.class_filter_dialect(t) if got is None else got
        no_vuln = F.lower(t).contains("no vulnerability") if no_vuln is None else no_vuln
    gt = tx.col_(truth_swcs)
    return (
        F.when(got.isNull(), F.lit(0.0))
        .when(F.array_contains(gt, got), F.lit(1.0))
        .when((F.size(gt) == 0) & ((got == "None") | no_vuln), F.lit(1.0))
        .otherwise(F.lit(0.0))
    )


def text_features(text) -> list[Column]:
    """Everything the rewards need from an answer's text, computed before any join so that
    shuffles carry these small values instead of the text."""
    t = F.coalesce(tx.col_(text), F.lit(""))
    low = F.lower(t)
    return [
        tx.classes_reward_dialect(t).alias("_model"),
        low.contains("none").alias("_has_none"),
        predicted_intervals(t).alias("_pred_iv"),
        format_reward(t).alias("format_reward"),
        tx.class_filter_dialect(t).alias("_got"),
        low.contains("no vulnerability").alias("_no_vuln"),
    ]


# --- F15 / F16 / F17 / F19 (specification rewards) ---------------------------------

def spec_features(text) -> list[Column]:
    """What F15 needs from an answer's text: `_spec_got`, `_spec_iv`, `_spec_sev`."""
    t = F.coalesce(tx.col_(text), F.lit(""))
    return [tx.class_spec_dialect(t).alias("_spec_got"), predicted_intervals(t).alias("_spec_iv"),
            tx.nullif_empty(tx.extract(t, r"(?iU)Severity[:\s]*(\w+)")).alias("_spec_sev")]


def spec_detection_reward(text, truth_swc: Column, truth_lines: Column, truth_severity: Column,
                          related: Column | None = None, features=None) -> Column:
    """mean of class (1 / 0.5 related / -1), line 2*IoU-1 when both known, severity (0.5 when equal, two missing ones
    included, else -0.25), and on clean contracts (truth class null) 0.5 / -1. `features` are the text's `spec_features` as
    already-computed columns; with them the text is not read."""
    got, pred, sev_got = spec_features(text) if features is None else features
    rel = related if related is not None else F.array().cast("array<string>")
    cls = (F.when(got.eqNullSafe(truth_swc), F.lit(1.0))
           .when(got.isNotNull() & F.array_contains(rel, got), F.lit(0.5)).otherwise(F.lit(-1.0)))
    tru = F.filter(F.array(truth_interval(truth_lines)), lambda iv: iv["s"].isNotNull() & iv["e"].isNotNull())
    known = (F.size(pred) > 0) & (F.size(tru) > 0)
    line = F.when(known, interval_iou(pred, tru) * 2 - 1)
    sev = F.when(sev_got.eqNullSafe(truth_severity), F.lit(0.5)).otherwise(F.lit(-0.25))
    clean = F.when(truth_swc.isNull(), F.when(got.isNull() | (got == "None"), F.lit(0.5)).otherwise(F.lit(-1.0)))
    parts = F.array(cls, line, sev, clean)
    present = F.filter(parts, lambda x: x.isNotNull())
    return F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present)


def test_reward(compiled: Column, passed: Column, total: Column) -> Column:
    """F16: -1 when not compiled; 1 when all pass; else 2*passed/total - 1."""
    return (F.when(~compiled, F.lit(-1.0))
            .when(passed == total, F.lit(1.0))
            .otherwise(passed.cast("double") / total * 2 - 1))


def judge_scale(score: Column) -> Column:
    """score/10*2-1."""
    return score.cast("double") / 10 * 2 - 1


def trajectory_score(compiled, fixed, new_findings, tool_errors, format_violations) -> Column:
    """compiled + fixed - 0.5 * (new findings + tool errors + format violations)."""
    c = lambda x: tx.col_(x)
    return (c(compiled).cast("double") + c(fixed).cast("double")
            - 0.5 * (c(new_findings) + c(tool_errors) + c(format_violations)))
