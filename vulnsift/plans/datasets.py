"""Training-set construction.

Pools are carried as ids + sort keys through ranks, quotas and splits; source text is
joined back and formatted last.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vulnsift.functions import formats as fm
from vulnsift.functions import text as tx
from vulnsift.operators import ordering as od
from vulnsift.schemas import (
    DPO_CLEAN_SHARE,
    DPO_FALSE_FINDING,
    INSTRUCTION,
    MAX_WORD_GAP,
    NO_VULNERABILITY_OUTPUT,
    SFT_CLEAN_RATIO,
    SFT_VULN_RATIO,
    TRAIN_SPLIT,
    VULN_FIELDS,
)

VULN_TYPE = ("array<struct<" + ",".join(f"{f}:string" for f in VULN_FIELDS) + ">>")


@dataclass(frozen=True)
class Pools:
    """Which sources make up each pool, in order."""

    labelled: Sequence[str] = ("curated",)
    tabular: Sequence[str] = ("tabular",)
    unlabelled: Sequence[str] = ("unlabelled",)
    clean: Sequence[str] = ("clean",)

    def rank(self, source: str = "source") -> Column:
        """Position of a row's source in the order of all pools."""
        names = [*self.labelled, *self.tabular, *self.unlabelled, *self.clean]
        return F.array_position(F.array(*map(F.lit, names)), F.col(source)) - 1


#: Pools of rows with the source names of the tables, and of those the file loaders give.
TABLE_POOLS = Pools()
FILE_POOLS = Pools(("smartbugs",), ("kaggle_tdm", "kaggle_bccc_vuln"), ("zellic",), ())


def pool_size(contracts: DataFrame, sources: Sequence[str]) -> Column:
    """Rows of the sources, as a scalar subquery: counted when the set is, not when it is planned."""
    return contracts.where(F.col("source").isin(*sources)).agg(F.count("*")).scalar()


def _first(contracts: DataFrame, pools: Pools, sources: Sequence[str], limit: int | None, name: str, key: str) -> DataFrame:
    """The first `limit` rows (None: all) of the sources in (source rank, key) order: every task keeps its own first rows
    and only these meet, so a pool is never ranked as a whole."""
    p = contracts.where(F.col("source").isin(*sources)).select(key, "source", pools.rank().alias("source_rank"), F.lit(name).alias("pool"))
    return p if limit is None else p.orderBy("source_rank", key).limit(int(limit))


def _with_code(ids: DataFrame, contracts: DataFrame, cols=("source_code",), key: str = "contract_id") -> DataFrame:
    """Join the (small, quota-bounded) selection back to the text; the planner broadcasts it by its size at run time."""
    return ids.join(contracts.select(key, *cols), key)


# --- D01: SFT set --------------------------------------------------------------------

def sft_selection(contracts: DataFrame, num_samples: int | None = None,
                  vuln_ratio: float = SFT_VULN_RATIO, clean_ratio: float = SFT_CLEAN_RATIO,
                  pools: Pools = TABLE_POOLS, key: str = "contract_id") -> DataFrame:
    """O02 + W10: vulnerable int(N*0.4) labelled first then tabular; clean int(N*0.2) unlabelled."""
    n = num_samples or 10000
    vulnerable = _first(contracts, pools, [*pools.labelled, *pools.tabular], od.quota(n, vuln_ratio), "vulnerable", key)
    clean = _first(contracts, pools, pools.unlabelled, od.quota(n, clean_ratio), "clean", key)
    return vulnerable.unionByName(clean).select(key, "source", (F.col("pool") == "vulnerable").alias("as_vulnerable"))


def build_sft(contracts: DataFrame, variant: str = "THINK", num_samples: int | None = None,
              format_type: str = "chat", train_split: float = TRAIN_SPLIT, seed: int = 42,
              include_system_prompt: bool = True, pools: Pools = TABLE_POOLS, key: str = "contract_id") -> DataFrame:
    """Selection -> shuffle/split -> formatting (chat messages or alpaca columns).

    RL-ZERO builds no SFT set (empty result, same schema).
    """
    sel = sft_selection(contracts, num_samples, pools=pools, key=key)
    split = od.train_validation_split(sel, key, seed, train_split)
    full = _with_code(split, contracts, ("source_code", "vulnerabilities"), key)
    vulns = F.when(F.col("as_vulnerable"), F.col("vulnerabilities")).otherwise(F.array().cast(VULN_TYPE))
    instruction = fm.sft_instruction(include_system_prompt)
    output = fm.sft_output(vulns, F.col("as_vulnerable"))
    if format_type == "chat":
        out = full.select(key, "split", "rank",
                          fm.chat_messages(instruction, "source_code", output).alias("messages"))
    else:
        out = full.select(key, "split", "rank", instruction.alias("instruction"),
                          F.col("source_code").alias("input"), output.alias("output"),
                          F.col("as_vulnerable").alias("is_vulnerable"),
                          F.size(vulns).alias("num_vulns"))
    if variant == "RL-ZERO":
        out = out.where(F.lit(False))
    return out


# --- D02: DPO set -----------------------------------------------------------------------

def dpo_clean_count(n_vuln: Column, num_samples: int | None, share: float = DPO_CLEAN_SHARE) -> tuple[Column, int]:
    """O03 closed form: 0 if N given and n_vuln >= N, else the smallest c >= 1 with n_vuln + c >= (N or 1000) * share (a
    float compare, as the reference does; the left side is whole, so against the next whole number); and its upper bound."""
    most = max(1, math.ceil((num_samples or 1000) * share))
    need = F.greatest(F.lit(1), F.lit(most) - n_vuln)
    return (F.when(n_vuln >= num_samples, 0).otherwise(need) if num_samples else need), most


def dpo_selection(contracts: DataFrame, num_samples: int | None = None, pools: Pools = TABLE_POOLS,
                  key: str = "contract_id") -> DataFrame:
    """P21 + O03: labelled contracts with a non-empty list (up to N), then clean fill."""
    found = contracts.where(~F.col("source").isin(*pools.labelled) | (F.size("vulnerabilities") > 0))
    n_lab = pool_size(found, pools.labelled)
    need, most = dpo_clean_count(F.least(n_lab, F.lit(num_samples)) if num_samples else n_lab, num_samples)
    missed = _first(found, pools, pools.labelled, num_samples, "missed", key)
    clean = _first(found, pools, pools.unlabelled, most, "false_positive", key)  # at most this many rows are ranked
    place = F.row_number().over(Window.orderBy("source_rank", key))
    clean = clean.withColumn("place", place).where(F.col("place") <= need).drop("place")
    return missed.unionByName(clean).select(key, "source", F.col("pool").alias("pair_kind"))


def false_finding() -> F.Column:
    d = DPO_FALSE_FINDING
    return F.array(F.struct(*[F.lit(d.get(f)).cast("string").alias(f) for f in VULN_FIELDS]))


def build_dpo(contracts: DataFrame, num_samples: int | None = None, seed: int = 42,
              train_split: float = TRAIN_SPLIT, pools: Pools = TABLE_POOLS, key: str = "contract_id") -> DataFrame:
    """(true finding, none) for labelled; (none, fixed false finding) for clean; P05/P06."""
    sel = dpo_selection(contracts, num_samples, pools, key)
    split = od.train_validation_split(sel, key, seed, train_split)
    full = _with_code(split, contracts, ("source_code", "vulnerabilities"), key)
    missed = F.col("pair_kind") == "missed"
    chosen = F.when(missed, fm.analysis_text("vulnerabilities")).otherwise(F.lit(NO_VULNERABILITY_OUTPUT))
    rejected = F.when(missed, F.lit(NO_VULNERABILITY_OUTPUT)).otherwise(fm.analysis_text(false_finding()))
    return full.select(
        key, "split", "rank", "pair_kind",
        fm.zero_shot_prompt("source_code").alias("prompt"),
        chosen.alias("chosen"), rejected.alias("rejected"),
        F.when(missed, F.size("vulnerabilities")).otherwise(F.lit(0)).alias("correct_vuln_count"),
        F.when(missed, F.lit(0)).otherwise(F.lit(1)).alias("incorrect_vuln_count"),
    )


# --- D03: CPT set under a token budget ------------------------------------------------------

def cpt_candidates(contracts: DataFrame, reports: DataFrame, pools: Pools = TABLE_POOLS, key: str = "contract_id") -> DataFrame:
    """Unlabelled code (source 'solidity') then reports ('audit_report'), JSON content as text."""
    code = contracts.where(F.col("source").isin(*pools.unlabelled)).select(
        F.lit(0).alias("source_rank"), F.col(key).alias("item_id"),
        F.col("source_code").alias("text"), F.lit("solidity").alias("source"))
    rep = reports.select(F.lit(1).alias("source_rank"), F.col("report_id").alias("item_id"),
                         F.col("content").alias("text"), F.lit("audit_report").alias("source"))
    return code.unionByName(rep).withColumn("tokens", tx.token_estimate("text"))


def build_cpt(contracts: DataFrame, reports: DataFrame, target_tokens: float = 2e9, pools: Pools = TABLE_POOLS,
              key: str = "contract_id") -> DataFrame:
    """D03 + W03: in source order, emit while tokens before the row < target. Ranks are taken over ids and token counts;
    the texts of the kept rows are joined back."""
    c = cpt_candidates(contracts, reports, pools, key)
    r = od.source_order_rank(c.drop("text"), "source_rank", "item_id", measure="tokens", below=target_tokens)
    kept = od.token_budget(r, target_tokens).select("source_rank", "item_id", "source", "tokens", "before", "rank")
    return kept.join(c.select("source_rank", "item_id", "text"), ["source_rank", "item_id"])


# --- D04: RL prompts --------------------------------------------------------------------

def rl_selection(contracts: DataFrame, num_prompts: int = 1000, seed: int = 42, pools: Pools = TABLE_POOLS, key: str = "contract_id") -> DataFrame:
    """Labelled up to N, unlabelled fills the rest, seeded shuffle, first N: (key, source, rank)."""
    both = _first(contracts, pools, pools.labelled, num_prompts, "labelled", key) \
        .unionByName(_first(contracts, pools, pools.unlabelled, num_prompts, "fill", key))
    sel = both.orderBy(F.desc("pool"), "source_rank", key).limit(num_prompts).select(key, "source")  # labelled before fill
    return od.seeded_shuffle(sel, key, seed).where(F.col("rank") <= num_prompts)


def build_rl_prompts(contracts: DataFrame, num_prompts: int = 1000, seed: int = 42, pools: Pools = TABLE_POOLS,
                     key: str = "contract_id") -> DataFrame:
    """The selected prompts with their text and ground truth."""
    shuffled = rl_selection(contracts, num_prompts, seed, pools, key)
    full = _with_code(shuffled, contracts, ("source_code", "vulnerabilities"), key)
    has = F.col("source").isin(*pools.labelled)
    return full.select(
        key, "rank",
        fm.zero_shot_prompt("source_code").alias("prompt"),
        has.alias("has_vulnerability"),
        F.when(has, F.col("vulnerabilities")).otherwise(F.array().cast(VULN_TYPE)).alias("ground_truth"),
    )


# --- D06 / D07: completion-driven sets ------------------------------------------------------

def trace_prompts(contracts: DataFrame, traces_per_contract: int = 1) -> DataFrame:
    """J07 + P13: one generation prompt per (contract, trace index)."""
    fan = contracts.select("contract_id", "source_code", "vulnerabilities",
                           F.explode(F.sequence(F.lit(0), F.lit(traces_per_contract - 1))).alias("trace_id"))
    return fan.select("contract_id", "trace_id",
                      fm.trace_prompt("source_code", fm.vulns_json("vulnerabilities")).alias("prompt"))


def build_traces(traces: DataFrame, contracts: DataFrame) -> DataFrame:
    """D06 + P15: keep non-empty traces containing '<think>'; SFT rows (instruction, input, output)."""
    ok = traces.where(F.coalesce(F.col("text"), F.lit("")).contains("<think>"))
    full = ok.join(contracts.select("contract_id", "source_code", "source", "file_path"), "contract_id")
    return full.select(
        "contract_id", F.col("k").alias("trace_id"),
        F.lit(INSTRUCTION).alias("instruction"), F.col("source_code").alias("input"),
        F.col("text").alias("output"), "source", "file_path",
    )


def delta_pairs(completions: DataFrame, contracts: DataFrame, strong: str = "strong", weak: str = "weak",
                max_gap: int | None = MAX_WORD_GAP, signed_token_gap: int | None = None) -> DataFrame:
    """J02 strong ⋈ weak on the prompt; P16 drop empty code and empty sides; P17 word gap
    |w(chosen) - w(rejected)| <= max_gap; P18 (optional) drop when tokens(chosen) - tokens(rejected) > gap."""
    first = "k" if "k" in completions.columns else "text"

    def answer(model: str, name: str) -> DataFrame:
        """One answer of a model to each prompt, its first: a prompt makes one pair."""
        return completions.where(F.col("model") == model).groupBy("contract_id").agg(F.min_by("text", first).alias(name))

    s, w = answer(strong, "chosen"), answer(weak, "rejected")
    code = contracts.where(F.coalesce(F.length("source_code"), F.lit(0)) > 0).select("contract_id", "source_code")
    pairs = s.join(w, "contract_id").where((F.col("chosen") != "") & (F.col("rejected") != ""))
    pairs = pairs.join(code, "contract_id")
    pairs = pairs.withColumn("words_chosen", tx.word_count("chosen")).withColumn("words_rejected", tx.word_count("rejected"))
    if max_gap is not None:
        pairs = pairs.where(F.abs(F.col("words_chosen") - F.col("words_rejected")) <= max_gap)
    if signed_token_gap is not None:
        pairs = pairs.where(tx.token_estimate("chosen") - tx.token_estimate("rejected") <= signed_token_gap)
    return pairs.select("contract_id", fm.zero_shot_prompt("source_code").alias("prompt"), "chosen", "rejected",
                        "words_chosen", "words_rejected")


# --- D09: mixture sampling ------------------------------------------------------------------

def mixture_sample(contracts: DataFrame, mix: DataFrame, component_pools: DataFrame, num_samples: int) -> DataFrame:
    """D09 + W10: per component, the first int(N * ratio) rows of its pool(s).

    `mix` (component, ratio) and `component_pools` (component, source) are small fixed
    tables (broadcast); quotas are computed per component in double arithmetic."""
    q = mix.select("component", F.floor(F.lit(float(num_samples)) * F.col("ratio")).cast("long").alias("quota"))
    pools = F.broadcast(component_pools.join(q, "component"))
    c = contracts.select("contract_id", "source", TABLE_POOLS.rank().alias("source_rank")).join(pools, "source")
    r = od.ordered_rank(c, ["source_rank", "contract_id"], ["component"])
    return r.where(F.col("rank") <= F.col("quota")).select("component", "contract_id", "source", "rank", "quota")
