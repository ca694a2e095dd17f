"""Column -> Column text helpers.

Built-in Spark expressions, except the two n-gram key helpers at the end, which are
Arrow-batched numpy UDFs over already-hashed word arrays.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd

from pyspark.sql import Column
from pyspark.sql import functions as F

from vulnsift.schemas import (
    CHARS_PER_TOKEN,
    TYPE_TO_SWC_EXACT,
    TYPE_TO_SWC_SUBSTRING,
    UNKNOWN_SWC,
)

def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- patterns ------------------------------------------------------------------------
# Classes are Unicode classes, as in Python: flag U. On text of ASCII alone the flag changes nothing but the cost, so
# such text, told by its length in bytes, gets the pattern without it.

def _ascii(t: Column) -> Column:
    return F.octet_length(t) == F.length(t)


def _pattern(t: Column, pattern: str) -> Column:
    return F.when(_ascii(t), F.lit(pattern.replace("(?iU)", "(?i)").replace("(?U)", ""))).otherwise(F.lit(pattern))


def extract(t, pattern: str, group: int = 1) -> Column:
    """First match of the group, '' without a match."""
    t = col_(t)
    return F.call_function("regexp_extract", t, _pattern(t, pattern), F.lit(group))


def extract_all(t, pattern: str, group: int = 1) -> Column:
    t = col_(t)
    return F.regexp_extract_all(t, _pattern(t, pattern), group)


def matches(t, pattern: str) -> Column:
    t = col_(t)
    plain = pattern.replace("(?iU)", "(?i)").replace("(?U)", "")
    return F.when(_ascii(t), t.rlike(plain)).otherwise(t.rlike(pattern))


def replace_all(t, pattern: str, by: str) -> Column:
    t = col_(t)
    return F.regexp_replace(t, _pattern(t, pattern), F.lit(by))


def strip(c) -> Column:
    return replace_all(c, r"(?U)^\s+|\s+$", "")


def nullif_empty(c) -> Column:
    c = col_(c)
    return F.when(c == "", F.lit(None)).otherwise(c)


# --- F01 / F02: type name -> class -------------------------------------------------

def swc_exact_sql(t: str) -> str:
    """F01 as SQL over a string expression: exact lower-case key lookup, default SWC-000."""
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in TYPE_TO_SWC_EXACT)
    return f"coalesce(element_at(map({pairs}), lower({t})), '{UNKNOWN_SWC}')"


def swc_from_type_exact(t) -> Column:
    """exact lower-case key lookup, default SWC-000."""
    lookup = F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in TYPE_TO_SWC_EXACT) + ")")
    return F.coalesce(lookup[F.lower(col_(t))], F.lit(UNKNOWN_SWC))


def swc_from_type_substring(t) -> Column:
    """first key, in list order, contained in the lower-cased text; default SWC-000."""
    keys = F.expr("array(" + ", ".join(f"struct('{k}' as key, '{v}' as swc)" for k, v in TYPE_TO_SWC_SUBSTRING) + ")")
    low = F.lower(F.coalesce(col_(t), F.lit("")))
    return F.coalesce(F.get(F.filter(keys, lambda x: low.contains(x["key"])), 0)["swc"], F.lit(UNKNOWN_SWC))


# --- F03 field extractors (per block, case-insensitive, first match) -----------------
# The extraction patterns; (?U) makes \\s, \\w and \\d Unicode classes, as in Python.

SWC_PATTERN = r"(?iU)SWC[:\s]*(SWC-?\d+|\d+)"
CWE_PATTERN = r"(?iU)CWE[:\s]*(CWE-?\d+|\d+)"
TYPE_PATTERN = r"(?iU)Vulnerability[:\s]*([^\n]+)"
LINES_PATTERN = r"(?iU)Lines?[:\s]*(\d+(?:\s*-\s*\d+)?)"
SEVERITY_PATTERN = r"(?iU)Severity[:\s]*(\w+)"
EXPLANATION_PATTERN = r"(?iU)Explanation[:\s]*([^\n]+)"
NONE_PATTERN = r"(?U)vulnerability[:\s]*none|no vulnerabilit"
BLOCK_SPLIT = r"(?U)\n\s*\n+"
BLOCK_FIELDS = {"swc_id": SWC_PATTERN, "cwe_id": CWE_PATTERN, "vuln_type": TYPE_PATTERN, "severity": SEVERITY_PATTERN,
                "lines": LINES_PATTERN, "explanation": EXPLANATION_PATTERN}


# Extraction and clean-up are apart: a value that clean-up names several times has to be bound to a field first, since
# inside a lambda each mention of an expression is an evaluation of its own, here a search of the whole block.

def prefixed_id(raw: Column, prefix: str) -> Column:
    """Case-sensitive prefix test, then upper-case (so 'swc-107' -> 'SWC-SWC-107')."""
    return (
        F.when(raw == "", F.lit(""))
        .when(raw.startswith(prefix), F.upper(raw))
        .otherwise(F.upper(F.concat(F.lit(prefix + "-"), raw)))
    )


def block_raw(block, *fields: str) -> list[Column]:
    """First matches of the named fields in a block as found, '' without one."""
    return [extract(block, BLOCK_FIELDS[f]).alias(f) for f in fields]


def not_blank(t) -> Column:
    """Whether anything but white space is there."""
    return matches(t, r"(?U)\S")


def split_blocks(text) -> Column:
    t = col_(text)
    return F.split(t, _pattern(t, BLOCK_SPLIT))


def says_none(text) -> Column:
    """Early-return test of the findings parser: NONE_PATTERN in the lower-cased text. What the pattern asks for literally is
    looked for first, and the pattern itself runs only over texts with the word 'none'."""
    t = col_(text)
    none, literal = NONE_PATTERN.removeprefix("(?U)").split("|")

    def said(low: Column) -> Column:
        pattern = F.when(_ascii(t), low.rlike(none)).otherwise(low.rlike("(?U)" + none))
        return low.contains(literal) | (low.contains("none") & pattern)

    return F.exists(F.array(F.lower(t)), said)


# --- F04 / F05 / F06: class dialects ----------------------------------------------

def classes_reward_dialect(text) -> Column:
    """every match of SWC[:\\s]*(\\d+|SWC-\\d+), case-insensitive, 'SWC-'/'swc-' removed."""
    found = extract_all(text, r"(?iU)SWC[:\s]*(\d+|SWC-\d+)")
    return F.transform(found, lambda s: F.replace(F.replace(s, F.lit("SWC-"), F.lit("")), F.lit("swc-"), F.lit("")))


def class_filter_dialect(text) -> Column:
    """first SWC[:\\s]*([0-9]{3}), case-insensitive -> 'SWC-nnn' or null."""
    d = extract(text, r"(?iU)SWC[:\s]*([0-9]{3})")
    return F.when(d == "", F.lit(None)).otherwise(F.concat(F.lit("SWC-"), d))


# The patterns in the order they are tried.
SPEC_PATTERNS = [r"(?U)SWC[:\s]*([0-9]{3})", r"(?U)SWC-([0-9]{3})", r"(?U)swc[:\s]*([0-9]{3})"]


def class_spec_dialect(text) -> Column:
    """three case-sensitive patterns tried in order -> 'SWC-nnn' or null."""
    parts = [nullif_empty(extract(text, p)) for p in SPEC_PATTERNS]
    d = F.coalesce(*parts)
    return F.when(d.isNull(), F.lit(None)).otherwise(F.concat(F.lit("SWC-"), d))


# --- F12 / F13 / F18 -------------------------------------------------------------

def token_estimate(text) -> Column:
    """len(text) // 4 in code points."""
    return F.floor(F.length(col_(text)) / F.lit(CHARS_PER_TOKEN)).cast("long")


def word_count(text) -> Column:
    """len(text.split()) — whitespace runs, Unicode-aware, 0 for ''."""
    return F.coalesce(F.regexp_count(col_(text), _pattern(col_(text), r"(?U)\S+")), F.lit(0)).cast("long")


def words(text) -> Column:
    return extract_all(text, r"(?U)\S+", 0)


# --- n-grams at scale: per-word hashes computed once, n-gram keys from hashes ----------

def with_word_hashes(df, text, out: str = "_wh", lower: bool = False):
    """Adds `out` = [xxhash64(word) for each whitespace-separated word of the whole text].

    It is its own projection: every n-gram helper below references it several times, so
    Catalyst keeps it materialised once per row instead of re-running the regex."""
    t = col_(text)
    if lower:
        t = F.lower(t)
    return df.withColumn(out, F.transform(words(F.coalesce(t, F.lit(""))), lambda w: F.xxhash64(w)))


_MASK = (1 << 64) - 1
_P1, _P2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd multipliers of the two polynomial keys


def _powers(p: int, n: int):
    return np.array([pow(p, j, 1 << 64) for j in range(n)], dtype=np.uint64)


def ngram_keys_vectorized(wh, n: int, known=None) -> Column:
    """Two 64-bit keys per word n-gram (with `known`, the broadcast bits of a Bloom filter: only those it may hold), sum_j h[i+j] * P^j mod 2^64 for two odd P, computed
    with numpy over Arrow batches of the word-hash arrays (a vectorised sliding window; the
    interpreted per-element path costs ~3.5 us per n-gram). Returns array<struct<k1, k2>>."""
    from vulnsift.operators import bloom

    p1, p2 = _powers(_P1, n), _powers(_P2, n)

    @F.pandas_udf("struct<k1:array<bigint>,k2:array<bigint>>")
    def keys(col: pd.Series) -> pd.DataFrame:
        k1s, k2s = [], []
        for arr in col:
            a = np.asarray(arr if arr is not None else [], dtype=np.int64).view(np.uint64)
            if len(a) < n:
                k1s.append(np.empty(0, dtype=np.int64))
                k2s.append(np.empty(0, dtype=np.int64))
                continue
            win = np.lib.stride_tricks.sliding_window_view(a, n)
            with np.errstate(over="ignore"):
                k1 = (win * p1).sum(axis=1, dtype=np.uint64).view(np.int64)
                k2 = (win * p2).sum(axis=1, dtype=np.uint64).view(np.int64)
                keep = slice(None) if known is None else bloom.holds(known.value, k1, k2)
            k1s.append(k1[keep])
            k2s.append(k2[keep])
        return pd.DataFrame({"k1": k1s, "k2": k2s})

    k = keys(col_(wh))
    return F.arrays_zip(k["k1"].alias("k1"), k["k2"].alias("k2"))


# --- F20: path parts ----------------------------------------------------------------

def first_year_part(path) -> Column:
    """First path component made of exactly four digits, else null."""
    parts = F.filter(F.split(col_(path), "/"), lambda p: p.rlike(r"^[0-9]{4}$"))
    return F.get(parts, 0)


def file_stem(path) -> Column:
    """Final component without its last suffix."""
    name = F.regexp_extract(col_(path), r"([^/]*)$", 1)
    return F.when(name.rlike(r"^.+\.[^.]*$") & ~name.rlike(r"^\.[^.]*$"),
                  F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)).otherwise(name)


def repeated_ratio_vectorized(wh, n: int = 3) -> Column:
    """F18 over word hashes with numpy: 1 - distinct n-gram keys / n-grams (0.0 when none).
    Distinct 64-bit polynomial keys are counted per text (a collision inside one text needs
    ~2^32 n-grams)."""
    p1 = _powers(_P1, n)

    @F.pandas_udf("double")
    def ratio(col: pd.Series) -> pd.Series:
        out = np.zeros(len(col), dtype=np.float64)
        for i, arr in enumerate(col):
            a = np.asarray(arr if arr is not None else [], dtype=np.int64).view(np.uint64)
            m = len(a) - n + 1
            if m < 1:
                continue
            win = np.lib.stride_tricks.sliding_window_view(a, n)
            with np.errstate(over="ignore"):
                k = (win * p1).sum(axis=1, dtype=np.uint64)
            out[i] = 1.0 - len(np.unique(k)) / m
        return pd.Series(out)

    return ratio(col_(wh))
