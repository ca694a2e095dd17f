"""The direct-answer model's training records, its preference records, and grouped responses.

All legs give records of one schema. Texts of answers pass through no join: prompts are joined to the answers that were kept, on
the contract's side text and on the answer's side text once each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnsift.functions import formats as fm
from vulnsift.functions import rewards as rw
from vulnsift.functions import text as tx
from vulnsift.operators import filters as fl
from vulnsift.operators import runs as rn
from vulnsift.operators import scoring as sc
from vulnsift.operators.evaluate import truth_classes
from vulnsift.plans import datasets as ds


def _turns(prompt: Column, answer: Column) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")), F.struct(F.lit("assistant").alias("role"), answer.alias("content")))


def verified(completions: DataFrame, contracts: DataFrame) -> DataFrame:
    """(contract_id, k): answers that the filter verifier accepts (F11). Features are taken from the text before the join."""
    j = sc.with_truth(completions.select("contract_id", "k", *rw.text_features("text")), contracts)
    return j.where(rw.filter_verifier(None, truth_classes("vulnerabilities", default=""), F.col("_got"), F.col("_no_vuln")) == 1.0).select("contract_id", "k")


def instruct_records(completions: DataFrame, contracts: DataFrame, tool: str = "run_slither", max_tokens: int = 512) -> DataFrame:
    """(kind, contract_id, k, messages). `think`: accepted traces without their think block; `tool`: a tool call, its result and the
    answer for each labelled contract (P27); `concise`: verified answers without a think block of at most `max_tokens`."""
    prompts = contracts.select("contract_id", fm.zero_shot_prompt("source_code").alias("prompt"))
    think = completions.where(fl.has_think("text")).select("contract_id", "k", fm.strip_think("text").alias("answer")).where("answer <> ''")
    plain = completions.where(~fl.has_think("text") & fl.concise("text", max_tokens)).select("contract_id", "k", "text")
    short = plain.join(verified(plain, contracts), ["contract_id", "k"], "left_semi").select("contract_id", "k", F.col("text").alias("answer"))
    answers = think.withColumn("kind", F.lit("think")).unionByName(short.withColumn("kind", F.lit("concise")))
    direct = answers.join(prompts, "contract_id").select("kind", "contract_id", "k", _turns(F.col("prompt"), F.col("answer")).alias("messages"))
    labelled = contracts.where(F.size("vulnerabilities") > 0)
    found = F.transform("vulnerabilities", lambda v: F.struct(v["type"].alias("type"), F.coalesce(v["lines"], v["line_range"]).alias("lines")))
    result = F.concat(F.lit('{"vulnerabilities": '), F.coalesce(fm.json_text(found, _result_type()), F.lit("[]")), F.lit("}"))
    call = fm.tool_call_record("source_code", tool, F.lit('{"contract_path": "contract.sol"}'), result, fm.sft_output("vulnerabilities", F.lit(True)))
    tools = labelled.select(F.lit("tool").alias("kind"), "contract_id", F.lit(None).cast("int").alias("k"), call.alias("messages"))
    return direct.unionByName(tools)


def _result_type():
    from pyspark.sql import types as T

    return T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("lines", T.StringType())]))


def judged_pairs(completions: DataFrame, score: str = "judge_score", key: str = "contract_id") -> DataFrame:
    """Best against worst answer of a prompt by a supplied judge score (ties to the smaller k), where they differ."""
    g = completions.where(F.coalesce(F.length("text"), F.lit(0)) > 0).groupBy(key).agg(
        F.max_by(F.struct("k", "text"), F.struct(F.col(score), -F.col("k"))).alias("b"), F.min_by(F.struct("k", "text"), F.struct(score, "k")).alias("w"),
        F.max(score).alias("hi"), F.min(score).alias("lo"))
    return g.where("hi > lo").select(key, F.col("b.text").alias("chosen"), F.col("w.text").alias("rejected"))


def concise_preference(completions: DataFrame, contracts: DataFrame) -> DataFrame:
    """A22 with its texts: shortest and longest verified answer of a prompt, where there are two of different length."""
    ok = completions.join(verified(completions, contracts), ["contract_id", "k"], "left_semi").withColumn("tokens", tx.token_estimate("text"))
    g = ok.groupBy("contract_id").agg(F.min_by("text", F.struct("tokens", "k")).alias("chosen"), F.max_by("text", F.struct(F.col("tokens"), -F.col("k"))).alias("rejected"),
                                      F.min("tokens").alias("lo"), F.max("tokens").alias("hi"))
    return g.where("hi > lo").select("contract_id", "chosen", "rejected")


def instruct_preferences(completions: DataFrame, contracts: DataFrame, trajectories: DataFrame, score: str = "judge_score", max_gap: int = 100) -> DataFrame:
    """(kind, prompt_id, chosen, rejected) of the four legs: `think` pairs under length control (P18), `tool_use` pairs by outcome
    (P29; the trajectories' ids), `concise` pairs (A22) and `judged` pairs."""
    think = ds.delta_pairs(completions, contracts, max_gap=None, signed_token_gap=max_gap).select(F.col("contract_id").alias("prompt_id"), "chosen", "rejected")
    tool = rn.outcome_pairs(trajectories).select("prompt_id", F.col("chosen_id").cast("string").alias("chosen"), F.col("rejected_id").cast("string").alias("rejected"))
    legs = [(think, "think"), (tool, "tool_use"), (concise_preference(completions, contracts).withColumnRenamed("contract_id", "prompt_id"), "concise"),
            (judged_pairs(completions, score).withColumnRenamed("contract_id", "prompt_id"), "judged")]
    out = None
    for df, kind in legs:
        part = df.select(F.lit(kind).alias("kind"), "prompt_id", "chosen", "rejected")
        out = part if out is None else out.unionByName(part)
    return out


def grouped_responses(scored: DataFrame, key: str = "contract_id") -> DataFrame:
    """One record per prompt: responses and rewards as arrays in the order of k, and how many there are. A record holds all samples of
    its prompt by definition."""
    g = scored.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("k", "response", "reward"))).alias("g"))
    return g.select(key, F.transform("g", lambda x: x["response"]).alias("responses"), F.transform("g", lambda x: x["reward"]).alias("rewards"),
                    F.size("g").alias("num_responses"))
