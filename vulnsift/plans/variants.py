"""The training sets of all variants in one pass over the texts, written as one partitioned table.

Selections (quotas, fills, splits) need ids, sources and label lists only; these narrow rows are written once and every selection
reads them. Each selected row is then tagged with the sets it is in, at most one of each kind, and joined to its text once; the
records of all variants are formatted from that one row and written by (variant, kind, split). The counts of the manifest are
observed while the table is written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vulnsift.functions import formats as fm
from vulnsift.operators import ordering as od
from vulnsift.plans import datasets as ds
from vulnsift.schemas import NO_VULNERABILITY_OUTPUT, TRAIN_SPLIT
from vulnsift.session import kept

VARIANTS = ("THINK", "INSTRUCT", "RL-ZERO")
KINDS = {"sft": ("train", "validation"), "dpo": ("train", "validation"), "rl": ("all",)}


def membership(contracts: DataFrame, sft_samples: int = 10000, dpo_samples: int = 5000, rl_prompts: int = 1000, seed: int = 42,
               train_split: float = TRAIN_SPLIT, pools: ds.Pools = ds.TABLE_POOLS, key: str = "contract_id") -> DataFrame:
    """(key, sets): for every selected row an array of (kind, split, rank, flag); flag: taught as vulnerable (sft), a missed finding
    (dpo), labelled (rl)."""
    narrow = kept(contracts.select(key, "source", "vulnerabilities"), "narrow")
    sft = od.train_validation_split(ds.sft_selection(narrow, sft_samples, pools=pools, key=key), key, seed, train_split)
    dpo = od.train_validation_split(ds.dpo_selection(narrow, dpo_samples, pools, key), key, seed, train_split)
    rl = ds.rl_selection(narrow, rl_prompts, seed, pools, key).withColumn("split", F.lit("all"))
    parts = [(sft, "sft", F.col("as_vulnerable")), (dpo, "dpo", F.col("pair_kind") == "missed"), (rl, "rl", F.col("source").isin(*pools.labelled))]
    tagged = [d.select(key, F.struct(F.lit(k).alias("kind"), "split", F.col("rank").cast("long").alias("rank"), flag.alias("flag")).alias("s"))
              for d, k, flag in parts]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).groupBy(key).agg(F.collect_list("s").alias("sets"))


def variant_sets(contracts: DataFrame, variants: Sequence[str] = VARIANTS, key: str = "contract_id", **sizes) -> DataFrame:
    """One row per variant and record: variant, kind, split, key, rank and the fields of its kind (the others null): `messages` (sft),
    `prompt`, `chosen`, `rejected` (dpo), `prompt`, `has_vulnerability`, `ground_truth` (rl). RL-ZERO has no SFT set."""
    sets = membership(contracts, key=key, **sizes)
    full = contracts.select(key, "source_code", "vulnerabilities").join(sets, key)
    rows = full.select(key, "source_code", "vulnerabilities", F.inline("sets"))
    rows = rows.withColumn("variant", F.explode(F.array(*map(F.lit, variants)))).where("not (variant = 'RL-ZERO' and kind = 'sft')")
    kind, flag, none = F.col("kind"), F.col("flag"), F.array().cast(ds.VULN_TYPE)
    labels = F.when(flag, F.col("vulnerabilities")).otherwise(none)
    found, missing = fm.analysis_text("vulnerabilities"), F.lit(NO_VULNERABILITY_OUTPUT)
    return rows.select(
        "variant", "kind", "split", key, "rank",
        F.when(kind == "sft", fm.chat_messages(fm.sft_instruction(True), "source_code", fm.sft_output(labels, flag))).alias("messages"),
        F.when(kind != "sft", fm.zero_shot_prompt("source_code")).alias("prompt"),
        F.when(kind == "dpo", F.when(flag, found).otherwise(missing)).alias("chosen"),
        F.when(kind == "dpo", F.when(flag, missing).otherwise(fm.analysis_text(ds.false_finding()))).alias("rejected"),
        F.when(kind == "rl", flag).alias("has_vulnerability"), F.when(kind == "rl", labels).alias("ground_truth"))


def write_variant_sets(sets: DataFrame, path: str, variants: Sequence[str] = VARIANTS) -> DataFrame:
    """Write the records as <path>/variant=/kind=/split= and return the manifest (variant, kind, split, n), counted while writing."""
    cells = [(v, k, s) for v in variants for k, splits in KINDS.items() for s in splits]
    seen = Observation()
    counts = [F.count_if((F.col("variant") == v) & (F.col("kind") == k) & (F.col("split") == s)).alias(f"n{i}") for i, (v, k, s) in enumerate(cells)]
    sets.observe(seen, *counts).write.mode("overwrite").partitionBy("variant", "kind", "split").parquet(path)
    got = seen.get
    rows = [(*c, got[f"n{i}"]) for i, c in enumerate(cells) if got[f"n{i}"]]
    return sets.sparkSession.createDataFrame(rows, "variant string, kind string, split string, n long")
