"""Quality filters and decontamination.

Filters are row predicates built from native expressions. Decontamination semi-joins n-gram
hashes of the training rows with the evaluation set's distinct hashes; a Bloom filter of those
drops nearly all training hashes before they become rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnsift.functions import formats as fm
from vulnsift.functions import text as tx
from vulnsift.operators import bloom
from vulnsift.session import kept


# --- P15 / P22-P26 ---------------------------------------------------------------------

def has_think(text) -> Column:
    """Non-empty and contains '<think>'."""
    return F.coalesce(tx.col_(text), F.lit("")).contains("<think>")


def is_complete(text) -> Column:
    """Think tags, a class id and line numbers all present."""
    t = F.coalesce(tx.col_(text), F.lit(""))
    return (t.contains("<think>") & t.contains("</think>") & tx.matches(t, r"(?iU)SWC[:\s-]*\d{3}")
            & tx.matches(t, r"(?iU)Lines?[:\s]*\d+"))


def length_ok(text, lo: int = 500, hi: int = 32_000) -> Column:
    """Lo <= estimated tokens <= hi."""
    tok = tx.token_estimate(text)
    return (tok >= lo) & (tok <= hi)


def concise(text, max_tokens: int = 512) -> Column:
    """Estimated tokens <= max_tokens."""
    return tx.token_estimate(text) <= F.lit(max_tokens)


def quality_flags(df: DataFrame, text: str = "text") -> DataFrame:
    """D10 steps as flags: completeness, repetition (word 3-grams), length; all_pass = all three."""
    cols = df.columns
    h = tx.with_word_hashes(df, text, "_wh")
    out = h.select(
        *cols,
        is_complete(text).alias("complete"),
        tx.repeated_ratio_vectorized("_wh", 3).alias("repeat_ratio"),
        tx.token_estimate(text).alias("tokens"),
    )
    return out.withColumn("repetition_ok", F.col("repeat_ratio") <= 0.30) \
        .withColumn("length_ok", (F.col("tokens") >= 500) & (F.col("tokens") <= 32_000)) \
        .withColumn("all_pass", F.col("complete") & F.col("repetition_ok") & F.col("length_ok"))


def trace_set(traces: DataFrame, evalset: DataFrame, key: str = "trace_id", text: str = "text") -> DataFrame:
    """D10 whole: the traces that are complete, not repetitive, of allowed length, and share nothing with the evaluation set."""
    passed = quality_flags(traces, text).where("all_pass")
    return decontaminate(passed, evalset, key, text)


def repetition(df: DataFrame, text: str = "text", n: int = 3, max_ratio: float = 0.30) -> DataFrame:
    """F18 + P23 over whole texts: repeat ratio and the keep flag."""
    cols = df.columns
    h = tx.with_word_hashes(df, text, "_wh")
    r = h.select(*cols, tx.repeated_ratio_vectorized("_wh", n).alias("repeat_ratio"))
    return r.withColumn("kept", F.col("repeat_ratio") <= F.lit(max_ratio))


def instruct_rows(traces: DataFrame, text: str = "text", max_tokens: int = 512) -> DataFrame:
    """THINK answers with the think block stripped (P25), kept when concise."""
    s = traces.withColumn("answer", fm.strip_think(text))
    return s.where((F.col("answer") != "") & concise("answer", max_tokens))


def confident(df: DataFrame, col: str = "confidence", threshold: float = 0.5) -> DataFrame:
    """Keep labels with confidence >= threshold before fan-out."""
    return df.where(F.col(col) >= F.lit(threshold))


# --- J06: decontamination ----------------------------------------------------------------

def normalized(text) -> Column:
    """Lower case, whitespace runs collapsed to one space, trimmed."""
    return tx.strip(tx.replace_all(F.lower(F.coalesce(tx.col_(text), F.lit(""))), r"(?U)\s+", " "))


def _gram_keys(df: DataFrame, text: str, n: int, keep: list[str], known=None) -> DataFrame:
    """(keep..., k1, k2) for every word n-gram of the lower-cased whole text, or those that the filter `known` may hold."""
    h = tx.with_word_hashes(df, text, "_wh", lower=True)
    return h.select(*keep, F.explode(tx.ngram_keys_vectorized("_wh", n, known)).alias("g")).select(*keep, "g.k1", "g.k2")


def _whole_keys(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(keep..., k1, k2) of the whole normalised text."""
    t = df.select(*keep, normalized(text).alias("_t"))
    return t.select(*keep, F.xxhash64("_t").alias("k1"), F.xxhash64("_t", F.lit(1)).alias("k2"))


def overlap_ids(train: DataFrame, evalset: DataFrame, key: str, text: str = "text",
                eval_text: str = "text", n: int = 13) -> DataFrame:
    """Ids of training rows that equal an evaluation item after normalisation, or share a
    word n-gram with one. The evaluation set's distinct keys are written once; a Bloom filter over them, of bounded
    size, is asked before the training side's n-grams are exploded, so that beyond any broadcast only the keys of overlapping
    rows, and the filter's few errors, are shuffled."""
    spark = train.sparkSession
    grams, whole = _gram_keys(evalset, eval_text, n, []), _whole_keys(evalset, eval_text, [])
    ev = kept(grams.withColumn("whole", F.lit(False)).unionByName(whole.withColumn("whole", F.lit(True))).distinct(), "eval-keys")
    bits = spark.sparkContext.broadcast(bloom.build(ev, ev.count()))

    @F.pandas_udf("boolean")
    def may_hold(k1: pd.Series, k2: pd.Series) -> pd.Series:
        return pd.Series(bloom.holds(bits.value, k1.to_numpy(), k2.to_numpy()))

    rows = train.select(key, text)
    by_gram = _gram_keys(rows, text, n, [key], bits).withColumn("whole", F.lit(False))
    exact = _whole_keys(rows, text, [key]).where(may_hold("k1", "k2")).withColumn("whole", F.lit(True))
    return by_gram.unionByName(exact).join(ev, ["k1", "k2", "whole"], "left_semi").select(key).distinct()


def decontaminate(train: DataFrame, evalset: DataFrame, key: str, text: str = "text", n: int = 13) -> DataFrame:
    """Remove overlapping rows (left anti join on the overlapping ids)."""
    return train.join(overlap_ids(train, evalset, key, text, "text", n), key, "left_anti")
