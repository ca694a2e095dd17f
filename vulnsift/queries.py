"""Registered queries: one per operator family of the survey, each (spark, sf_dir) -> DataFrame.

Every query reads the provided tables (through ``vulnsift.plans.fixtures``) so that its
work grows with them. Double columns are rounded to 9 places at the very end so that
the SQL oracle comparison is exact; the library operators themselves never round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnsift.functions import text as tx
from vulnsift.operators import evaluate as ev
from vulnsift.plans import fixtures as fx
from vulnsift.plans import variants as vr

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    return df.select(*[
        F.round(F.col(f.name), places).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


def _eval_inputs(spark, sf_dir):
    return fx.completions(spark, sf_dir), fx.eval_contracts(spark, sf_dir)


# ---------------------------------------------------------------------------
# Evaluation family
# ---------------------------------------------------------------------------

@query
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D15 + A02 + A03: confusion totals and rates per evaluation run (sample index k)."""
    comp, con = _eval_inputs(spark, sf_dir)
    m = ev.evaluate(comp, con)
    return rounded(m.select("k", "total_contracts", "vulnerable_contracts", "clean_contracts", "tp", "fp", "fn",
                            "tn", "precision", "recall", "f1", "false_positive_rate"))


@query
def findings_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one row per parsed finding of every answer."""
    comp = fx.completions(spark, sf_dir)
    return ev.parse_findings(comp)


@query
def match_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J04 + U02: distinct-class tp / fp / fn per answer, exact class match."""
    comp, con = _eval_inputs(spark, sf_dir)
    s = ev.score_answers(comp, con, strict=True)
    return s.select("contract_id", "k", F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"),
                    F.col("fn").cast("long").alias("fn"), "matched")


@query
def match_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same match on swc[:7]."""
    comp, con = _eval_inputs(spark, sf_dir)
    s = ev.score_answers(comp, con, strict=False)
    return s.select("contract_id", "k", F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"),
                    F.col("fn").cast("long").alias("fn"))


@query
def class_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four class dialects side by side on every answer."""
    comp = fx.completions(spark, sf_dir)
    return comp.select(
        "contract_id", "k",
        F.array_join(ev.predicted_classes("text"), ",").alias("parse_classes"),
        F.array_join(tx.classes_reward_dialect("text"), ",").alias("reward_classes"),
        tx.class_filter_dialect("text").alias("filter_class"),
        tx.class_spec_dialect("text").alias("spec_class"),
    )


@query
def per_class_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A04 + J05: per true class, hits counted per truth row."""
    comp, con = _eval_inputs(spark, sf_dir)
    return rounded(ev.per_class_recall(comp, con).select("k", "swc_id", "tp", "fn", "recall"))


@query
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean per-class F1 per run."""
    comp, con = _eval_inputs(spark, sf_dir)
    return rounded(ev.macro_f1(ev.score_runs(comp, con)).select("k", "macro_f1", "n_classes"))


@query
def target_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rate against its target with direction, PASS / FAIL."""
    comp, con = _eval_inputs(spark, sf_dir)
    rep = ev.target_report(ev.evaluate(comp, con))
    return rounded(rep.select("k", "metric", "value", "target", "higher_better", "status"))


@query
def infer_class_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F01 on every contract's category."""
    c = fx.contracts(spark, sf_dir)
    return c.select("contract_id", "category", tx.swc_from_type_exact("category").alias("swc_id"))


@query
def infer_class_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F02 on the raw category and on the category with spaces."""
    c = fx.contracts(spark, sf_dir)
    return c.select(
        "contract_id", "category",
        tx.swc_from_type_substring("category").alias("swc_id"),
        tx.swc_from_type_substring(F.replace(F.col("category"), F.lit("_"), F.lit(" "))).alias("swc_id_spaced"),
    )


@query
def primary_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings restricted to the five primary classes (distinct per answer)."""
    f = ev.parse_findings(fx.completions(spark, sf_dir)).select("contract_id", "k", "swc_id").distinct()
    return ev.restrict_primary(f)


@query
def class_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth rows with primary-class attributes (left join)."""
    g = fx.ground_truth(spark, sf_dir).select("contract_id", "swc_id")
    return ev.with_class_attributes(g).select("contract_id", "swc_id", "class_name", "cwe", "target_f1")


# ---------------------------------------------------------------------------
# Rewards, rollouts and difficulty
# ---------------------------------------------------------------------------

from vulnsift.functions import rewards as rw  # noqa: E402
from vulnsift.operators import scoring as sc  # noqa: E402


def _scored(spark, sf_dir):
    comp, con = _eval_inputs(spark, sf_dir)
    return sc.score_rollouts(comp, con)


@query
def reward_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F07, F08, F09 per completion."""
    s = _scored(spark, sf_dir)
    return rounded(s.select("contract_id", "k", "class_reward", "line_reward", "format_reward"))


@query
def reward_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """weighted total reward per completion."""
    return rounded(_scored(spark, sf_dir).select("contract_id", "k", "reward"))


@query
def line_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted vs true line sets (sizes and IoU) by interval arithmetic."""
    comp, con = _eval_inputs(spark, sf_dir)
    j = sc.with_truth(comp.select("contract_id", "k", rw.predicted_intervals("text").alias("pred")), con)
    tru = rw.truth_intervals("vulnerabilities")
    return rounded(j.select(
        "contract_id", "k",
        rw.union_size(F.col("pred")).alias("n_pred_lines"),
        rw.union_size(tru).alias("n_truth_lines"),
        rw.line_reward(None, "vulnerabilities", F.col("pred"), tru).alias("iou"),
    ))


@query
def rollout_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total reward and group-relative advantage per completion."""
    a = sc.advantages(_scored(spark, sf_dir))
    return rounded(a.select("contract_id", "k", "reward", "advantage"))


@query
def advantages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """advantage = reward - mean reward of the prompt."""
    a = sc.advantages(_scored(spark, sf_dir))
    return rounded(a.select("contract_id", "k", "advantage"))


@query
def zero_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions of prompts whose rewards are not all equal."""
    a = sc.drop_zero_gradient(sc.advantages(_scored(spark, sf_dir)))
    return rounded(a.select("contract_id", "k", "advantage"))


@query
def group_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean reward per prompt group."""
    g = sc.group_stats(_scored(spark, sf_dir), "contract_id", "reward")
    return rounded(g.select("contract_id", "mean_reward", "n"))


@query
def joined_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions left-joined to their ground truth."""
    comp, con = _eval_inputs(spark, sf_dir)
    j = sc.with_truth(comp.select("contract_id", "k"), con)
    return j.select("contract_id", "k", F.size("vulnerabilities").cast("long").alias("n_truth"),
                    F.array_join(ev.truth_classes(), ",").alias("truth_classes"))


@query
def filter_verifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0/1 difficulty-filter verifier per completion."""
    comp, con = _eval_inputs(spark, sf_dir)
    j = sc.with_truth(comp.select("contract_id", "k", *rw.text_features("text")), con)
    verified = rw.filter_verifier(None, ev.truth_classes("vulnerabilities", default=""), F.col("_got"), F.col("_no_vuln"))
    return j.select("contract_id", "k", verified.alias("verified"))


@query
def pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A05 + A06: pass rate over non-empty completions and share of positive rewards."""
    comp, con = _eval_inputs(spark, sf_dir)
    return rounded(sc.pass_rates(comp, con).select("contract_id", "pass_rate", "positive_share", "n_completions"))


@query
def difficulty_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with pass rate <= 0.625."""
    comp, con = _eval_inputs(spark, sf_dir)
    return rounded(sc.difficulty_filter(sc.pass_rates(comp, con)).select("contract_id", "pass_rate"))


@query
def hard_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20: prompts never solved."""
    comp, con = _eval_inputs(spark, sf_dir)
    return rounded(sc.hard_only(sc.pass_rates(comp, con)).select("contract_id", "pass_rate"))


@query
def pass_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unbiased pass@1, pass@8, pass@32 per prompt (null when n < k)."""
    comp, con = _eval_inputs(spark, sf_dir)
    r = sc.pass_rates(comp, con)
    n, c = F.col("n_completions"), F.col("n_correct")
    return rounded(r.select("contract_id", n.alias("n"), c.alias("c"),
                            sc.pass_at_k(n, c, 1).alias("pass_at_1"),
                            sc.pass_at_k(n, c, 8).alias("pass_at_8"),
                            sc.pass_at_k(n, c, 32).alias("pass_at_32")))


@query
def self_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the modal answer per prompt."""
    return rounded(sc.self_consistency(fx.completions(spark, sf_dir)))


# ---------------------------------------------------------------------------
# Training-set construction
# ---------------------------------------------------------------------------

from vulnsift.functions import formats as fm  # noqa: E402
from vulnsift.operators import ordering as od  # noqa: E402
from vulnsift.plans import datasets as ds  # noqa: E402
from vulnsift.schemas import MIXTURE, SIZE_SWEEP, LEARNING_RATES  # noqa: E402

SFT_N = 500
DPO_N = 200
RL_N = 300
CPT_TARGET = 500_000


def _messages_flat(df: DataFrame) -> DataFrame:
    return df.select("contract_id", "split", "rank",
                     F.col("messages")[0]["content"].alias("user_content"),
                     F.col("messages")[1]["content"].alias("assistant_content"))


@query
def sft_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D01 (chat): quotas, seeded shuffle, 90/10 split, chat messages."""
    return _messages_flat(ds.build_sft(fx.contracts(spark, sf_dir), num_samples=SFT_N))


@query
def sft_alpaca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D01 (alpaca) with P01, P02, P04: instruction / input / output columns."""
    s = ds.build_sft(fx.contracts(spark, sf_dir), num_samples=SFT_N, format_type="alpaca")
    return s.select("contract_id", "split", "instruction", "input", "output", "is_vulnerable",
                    F.col("num_vulns").cast("long").alias("num_vulns"))


@query
def default_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SFT answer text with every field default, for every labelled contract."""
    c = fx.contracts(spark, sf_dir).where(F.col("source") == "curated")
    return c.select("contract_id", fm.sft_output("vulnerabilities", "is_vulnerable").alias("output"))


@query
def chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P01 + P03 on every labelled and tabular contract (no quota)."""
    c = fx.contracts(spark, sf_dir).where(F.col("source").isin("curated", "tabular"))
    msgs = fm.chat_messages(fm.sft_instruction(True), "source_code", fm.sft_output("vulnerabilities", "is_vulnerable"))
    return c.select("contract_id", msgs.alias("m")).select(
        "contract_id", F.col("m")[0]["content"].alias("user_content"), F.col("m")[1]["content"].alias("assistant_content"))


@query
def dpo_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D02 + O03: labelled (true, none) pairs then clean (none, false) fill; split."""
    d = ds.build_dpo(fx.contracts(spark, sf_dir), num_samples=DPO_N)
    return d.select("contract_id", "split", "rank", "pair_kind", "prompt", "chosen", "rejected",
                    F.col("correct_vuln_count").cast("long").alias("correct_vuln_count"),
                    F.col("incorrect_vuln_count").cast("long").alias("incorrect_vuln_count"))


@query
def dpo_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair counts per kind at the default N (1000 when not given) and at N = 20."""
    c = fx.contracts(spark, sf_dir)
    a = ds.dpo_selection(c, None).groupBy("pair_kind").agg(F.count(F.lit(1)).alias("n")).withColumn("n_param", F.lit(0))
    b = ds.dpo_selection(c, 20).groupBy("pair_kind").agg(F.count(F.lit(1)).alias("n")).withColumn("n_param", F.lit(20))
    return a.unionByName(b).select("n_param", "pair_kind", "n")


@query
def rl_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D04 + O04: labelled first, unlabelled fill, seeded shuffle, first N."""
    r = ds.build_rl_prompts(fx.contracts(spark, sf_dir), num_prompts=RL_N)
    return r.select("contract_id", "rank", "prompt", "has_vulnerability",
                    F.size("ground_truth").cast("long").alias("n_truth"))


@query
def cpt_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D03 + W03 + F12: code then reports in order while tokens before the row < target, with their text."""
    r = ds.build_cpt(fx.contracts(spark, sf_dir), fx.reports(spark, sf_dir), target_tokens=CPT_TARGET)
    return r.select("source", "item_id", "tokens", F.col("before").cast("long").alias("tokens_before"),
                    F.col("rank").cast("long").alias("rank"), "text")


@query
def cpt_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P08 + P09 + F12: CPT rows with the optional header, lengths and token estimates."""
    c = fx.contracts(spark, sf_dir).where(F.col("source") == "unlabelled")
    code = c.select(F.col("contract_id").alias("item_id"),
                    fm.cpt_text("source_code", F.lit("solidity"), include_header=True).alias("text"),
                    F.lit("solidity").alias("source"))
    rep = fx.reports(spark, sf_dir).select(F.col("report_id").alias("item_id"), F.col("content").alias("text"),
                                           F.lit("audit_report").alias("source"))
    u = code.unionByName(rep)
    return u.select("source", "item_id", "text", F.length("text").cast("long").alias("length"),
                    tx.token_estimate("text").alias("tokens"))


@query
def split_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded shuffle position and 90/10 split over all documents."""
    d = read_docs(spark, sf_dir)
    s = od.train_validation_split(d, "doc_id", seed=42)
    return s.select("doc_id", F.col("rank").cast("long").alias("rank"), "split")


def read_docs(spark, sf_dir):
    from vulnsift.session import read_table
    return read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")


@query
def split_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split, row count, and rows shared with the other split (exceptAll-checked: 0)."""
    d = read_docs(spark, sf_dir)
    s = od.train_validation_split(d.select("doc_id"), "doc_id", seed=7).select("doc_id", "split")
    train = s.where(F.col("split") == "train").select("doc_id")
    val = s.where(F.col("split") == "validation").select("doc_id")
    shared = train.intersect(val).agg(F.count("*").alias("shared"))
    missing = d.select("doc_id").exceptAll(train.unionByName(val)).agg(F.count("*").alias("missing"))
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n")).join(shared).join(missing)


@query
def quota_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O02 + W10 + F14: SFT quota selection (vulnerable curated-first, then clean)."""
    s = ds.sft_selection(fx.contracts(spark, sf_dir), num_samples=SFT_N)
    return s.select("contract_id", "source", "as_vulnerable")


@query
def rl_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RL prompt pool membership (labelled up to N, unlabelled fill)."""
    r = ds.build_rl_prompts(fx.contracts(spark, sf_dir), num_prompts=RL_N)
    return r.select("contract_id", "has_vulnerability")


@query
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running token total over documents in (source, doc_id) order, budget 300k."""
    d = read_docs(spark, sf_dir).select("doc_id", F.regexp_extract("source", r"(\d+)$", 1).cast("int").alias("src"),
                                        tx.token_estimate("text").alias("tokens"))
    r = od.source_order_rank(d, "src", "doc_id", measure="tokens", below=300_000)
    kept = od.token_budget(r, 300_000)
    return kept.select("doc_id", "tokens", F.col("before").cast("long").alias("tokens_before"))


@query
def first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 10 curated contracts in id order."""
    c = fx.contracts(spark, sf_dir).where(F.col("source") == "curated").select("contract_id", "category")
    return od.first_n(c, ["contract_id"], 10)


@query
def union_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S09 + O01 + U01: sources in the given order, one global limit (here 100)."""
    c = fx.contracts(spark, sf_dir).where(F.col("source").isin("curated", "tabular", "unlabelled"))
    c = c.select("contract_id", "source", ds.TABLE_POOLS.rank().alias("source_rank"))
    return od.first_n(c, ["source_rank", "contract_id"], 100).select("contract_id", "source")


@query
def pool_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of all pools with their flags."""
    c = fx.contracts(spark, sf_dir)
    return c.select("contract_id", "source", "is_vulnerable", F.size("vulnerabilities").cast("long").alias("n_vulns"))


@query
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vulnerable / clean counts of the built SFT set, per split."""
    s = ds.build_sft(fx.contracts(spark, sf_dir), num_samples=SFT_N, format_type="alpaca")
    return s.groupBy("split", "is_vulnerable").agg(F.count(F.lit(1)).alias("n"))


@query
def zero_shot_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-shot prompt for every contract."""
    c = fx.contracts(spark, sf_dir)
    return c.select("contract_id", fm.zero_shot_prompt("source_code").alias("prompt"))


@query
def rl_zero_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RL-ZERO prompt for every contract."""
    c = fx.contracts(spark, sf_dir)
    return c.select("contract_id", fm.rl_zero_prompt("source_code").alias("prompt"))


@query
def trace_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J07 + P13 + F21: two trace prompts per labelled contract with JSON ground truth."""
    c = fx.contracts(spark, sf_dir).where(F.col("source") == "curated")
    return ds.trace_prompts(c, traces_per_contract=2)


@query
def trace_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D06 + P15: accepted reasoning traces as SFT rows."""
    t = ds.build_traces(fx.completions(spark, sf_dir), fx.contracts(spark, sf_dir))
    return t.select("contract_id", "trace_id", "instruction", "output", "source", "file_path")


@query
def delta_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong vs weak pairs with the word-gap filter."""
    p = ds.delta_pairs(fx.completions(spark, sf_dir), fx.contracts(spark, sf_dir))
    return p.select("contract_id", "chosen", "rejected", "words_chosen", "words_rejected")


@query
def delta_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed token-gap variant (drop when tokens(chosen) - tokens(rejected) > 10)."""
    p = ds.delta_pairs(fx.completions(spark, sf_dir), fx.contracts(spark, sf_dir), max_gap=None, signed_token_gap=10)
    return p.select("contract_id", "words_chosen", "words_rejected")


@query
def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: every document truncated to max_length*4 characters (max_length = 512)."""
    d = read_docs(spark, sf_dir)
    t = fm.truncate_chars("text", 512)
    return d.select("doc_id", t.alias("text"), F.length(t).cast("long").alias("length"))


@query
def rl_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P07 (long form): prompt, response, reward and the group's number of responses."""
    comp, con = _eval_inputs(spark, sf_dir)
    s = sc.score_rollouts(comp, con, keep_text=True).select("contract_id", "k", F.col("text").alias("response"), "reward")
    n = s.groupBy("contract_id").agg(F.count(F.lit(1)).alias("num_responses"))
    return rounded(s.join(n, "contract_id"))


@query
def mixture_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SFT mix components mapped to pools, first int(N * ratio) rows each (N = 400)."""
    mix = spark.createDataFrame([(c, r) for m, c, r in MIXTURE if m == "sft"], "component string, ratio double")
    pools = spark.createDataFrame([("labeled_vulns", "curated"), ("labeled_vulns", "tabular"),
                                   ("clean_contracts", "unlabelled"), ("clean_contracts", "clean")],
                                  "component string, source string")
    m = ds.mixture_sample(fx.contracts(spark, sf_dir), mix, pools, 400)
    return m.select("component", "contract_id", F.col("rank").cast("long").alias("rank"))


@query
def size_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested prefixes of one shuffle, sizes 50K..200K scaled down by 100 (500..2000)."""
    d = read_docs(spark, sf_dir).select("doc_id", tx.token_estimate("text").alias("tokens"))
    r = od.seeded_shuffle(d, "doc_id", seed=42)
    nested = od.nested_sizes(r, [s // 100 for s in SIZE_SWEEP])
    return nested.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").cast("long").alias("tokens"))


@query
def sweep_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learning rates x mixture components, each with the rows and tokens the component
    would draw from the data (per-component totals computed once, then the small grid)."""
    c = fx.contracts(spark, sf_dir).select("source", tx.token_estimate("source_code").alias("tokens"))
    per_source = c.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("tokens").alias("tokens"))
    pools = spark.createDataFrame([("labeled_vulns", "curated"), ("labeled_vulns", "tabular"),
                                   ("clean_contracts", "unlabelled"), ("clean_contracts", "clean")],
                                  "component string, source string")
    per_comp = per_source.join(F.broadcast(pools), "source").groupBy("component").agg(
        F.sum("rows").cast("long").alias("rows"), F.sum("tokens").cast("long").alias("tokens"))
    lrs = F.array(*[F.lit(float(x)) for x in LEARNING_RATES])
    return per_comp.select("component", F.explode(lrs).alias("learning_rate"), "rows", "tokens")


# ---------------------------------------------------------------------------
# Quality filters, decontamination, conversations
# ---------------------------------------------------------------------------

from vulnsift.operators import chat as ch  # noqa: E402
from vulnsift.operators import filters as fl  # noqa: E402
from vulnsift.session import read_table  # noqa: E402


@query
def trace_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions that contain a think block."""
    c = fx.completions(spark, sf_dir)
    return c.where(fl.has_think("text")).select("contract_id", "k")


@query
def trace_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness, repetition and length flags of every completion."""
    q = fl.quality_flags(fx.completions(spark, sf_dir))
    return rounded(q.select("contract_id", "k", "complete", "repeat_ratio", "tokens", "all_pass"))


@query
def quality_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P22-P24 over whole documents: flags per document."""
    q = fl.quality_flags(read_docs(spark, sf_dir))
    return rounded(q.select("doc_id", "complete", "repeat_ratio", "tokens", "repetition_ok", "length_ok"))


@query
def repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F18 + P23: repeated word 3-gram ratio of every whole document; kept when <= 0.30."""
    # the table may be one row group, which one task reads: the heavy per-text work is dealt out by id
    d = read_docs(spark, sf_dir).select("doc_id", "text").repartition("doc_id")
    return rounded(fl.repetition(d).select("doc_id", "repeat_ratio", "kept"))


@query
def strip_think(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25: answers with the think block removed."""
    c = fx.completions(spark, sf_dir)
    return c.where(fl.has_think("text")).select("contract_id", "k", fm.strip_think("text").alias("answer"))


@query
def concise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of at most 512 estimated tokens."""
    d = read_docs(spark, sf_dir)
    return d.where(fl.concise("text")).select("doc_id", tx.token_estimate("text").alias("tokens"))


@query
def confidence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed findings with confidence >= 0.5."""
    f = ev.parse_findings(fx.completions(spark, sf_dir))
    return rounded(fl.confident(f).select("contract_id", "k", "block", "swc_id", "confidence"))


@query
def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents left after removing those that share a word 13-gram with (or equal) a
    benchmark item."""
    d = read_docs(spark, sf_dir).select("doc_id", "text").repartition("doc_id")
    b = read_table(spark, sf_dir, "benchmark").select("item_id", "text")
    return fl.decontaminate(d, b, "doc_id").select("doc_id")


@query
def contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J06 (find side): the overlapping document ids."""
    d = read_docs(spark, sf_dir).select("doc_id", "text").repartition("doc_id")
    b = read_table(spark, sf_dir, "benchmark").select("item_id", "text")
    return fl.overlap_ids(d, b, "doc_id")


@query
def instruct_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """THINK answers stripped of reasoning and kept when concise."""
    t = fl.instruct_rows(fx.completions(spark, sf_dir).where(fl.has_think("text")))
    return t.select("contract_id", "k", "answer")


@query
def chat_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation rendered with role markers and a generation prompt."""
    return ch.render_chats(read_table(spark, sf_dir, "conversations"), add_generation_prompt=True).select(
        "conv_id", "rendered", F.col("n_turns").cast("long").alias("n_turns"))


@query
def multi_turn_pref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The better of two answers to the last user turn over the worse one, with the context before them."""
    return ch.multi_turn_preferences(read_table(spark, sf_dir, "conversations"), fx.chat_answers(spark, sf_dir))


@query
def tool_call_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool-call conversation per labelled contract (analyzer call, result, answer)."""
    c = fx.contracts(spark, sf_dir).where(F.col("source") == "curated")
    args = F.concat(F.lit('{"contract_id": '), F.col("contract_id").cast("string"), F.lit("}"))
    result = F.concat(F.lit("findings: "), F.array_join(ev.truth_classes(), ", "))
    m = fm.tool_call_record("source_code", "static_analyzer", args, result, fm.sft_output("vulnerabilities", "is_vulnerable"))
    return c.select("contract_id", m.alias("m")).select(
        "contract_id", *[F.col("m")[i]["content"].alias(f"turn{i}") for i in range(4)])


# ---------------------------------------------------------------------------
# Runs, trajectories, comparisons and reports (A10-A24, W04-W11, O06, O07, D05, D12, D13, D16-D19,
# F15-F17, F19, F23, F24, J05, P29)
# ---------------------------------------------------------------------------

from pyspark.sql import Window  # noqa: E402

from vulnsift.operators import runs as rn  # noqa: E402


def _log(spark, sf_dir):
    return rn.step_log(fx.runs(spark, sf_dir))


@query
def run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per experiment, f1 / precision / recall of its best stage's final step."""
    return rounded(rn.run_compare(_log(spark, sf_dir)))


@query
def best_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best available stage per experiment."""
    return rn.best_stage(_log(spark, sf_dir))


@query
def variant_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparison with deltas against the 'view' experiment."""
    return rounded(rn.variant_compare(_log(spark, sf_dir), "view"))


@query
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: evaluations per stage, successful (f1 >= 0.20) and failed."""
    return rn.run_summary(_log(spark, sf_dir))


@query
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First step with three evaluations in a row without a new best F1."""
    return rn.early_stop(_log(spark, sf_dir))


@query
def length_explosion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps whose mean length is above 1.5x the run's first step."""
    return rounded(rn.length_explosion(_log(spark, sf_dir), factor=1.5))


@query
def stage_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final-F1 gain of each stage over the previous one, > 2 points flagged."""
    return rounded(rn.stage_gain(_log(spark, sf_dir)))


@query
def top_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-3 steps per run by F1."""
    return rounded(rn.top_checkpoints(_log(spark, sf_dir)))


@query
def run_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample variance of F1 per experiment, over raw rows and over final stage values."""
    raw = fx.runs(spark, sf_dir).groupBy("experiment").agg(F.var_samp("f1").alias("var_rows"))
    fin = rn.final_metrics(_log(spark, sf_dir)).groupBy("experiment").agg(F.var_samp("f1").alias("var_final"))
    return rounded(raw.join(fin, "experiment"))


@query
def steps_to_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First step with F1 >= 0.30 and the logged rows before it."""
    return rn.steps_to_target(_log(spark, sf_dir), 0.30)


@query
def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency distribution per experiment (min, mean, max; exact percentiles)."""
    r = fx.runs(spark, sf_dir)
    moments = r.groupBy("experiment").agg(F.min("latency_ms").alias("min_ms"), F.avg("latency_ms").alias("mean_ms"), F.max("latency_ms").alias("max_ms"))
    return rounded(moments.join(rn.exact_percentiles(r, "experiment", "latency_ms", "run_row", {"p50_ms": 0.5, "p90_ms": 0.9}), "experiment"))


@query
def trajectory_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F19 + A11: best and worst trajectory per prompt (ties to the smaller id)."""
    return rounded(rn.best_worst(fx.trajectories(spark, sf_dir)))


@query
def trajectory_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs best vs worst where the scores differ."""
    return rounded(rn.trajectory_pairs(fx.trajectories(spark, sf_dir)).select(
        "prompt_id", F.col("best_id").alias("chosen_id"), F.col("worst_id").alias("rejected_id"),
        (F.col("best_score") - F.col("worst_score")).alias("margin")))


@query
def outcome_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome-labelled chosen / rejected trajectories paired per prompt."""
    return rn.outcome_pairs(fx.trajectories(spark, sf_dir)).select("prompt_id", F.col("i").cast("long").alias("i"), "chosen_id", "rejected_id", "reason")


@query
def test_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: test-result reward per trajectory (passed = 4 - new findings of 4 tests)."""
    t = fx.trajectories(spark, sf_dir)
    return rounded(t.select("traj_id", rw.test_reward(F.col("compiled"), 4 - F.col("new_findings"), F.lit(4)).alias("reward")))


@query
def judge_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge score (value mod 10) scaled to [-1, 1], per event."""
    e = read_table(spark, sf_dir, "events")
    return rounded(e.select("event_id", rw.judge_scale(F.floor(F.col("value")) % 10).alias("scaled")))


@query
def judge_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean judge score per user."""
    e = read_table(spark, sf_dir, "events")
    return rounded(e.groupBy("user_id").agg(F.avg(F.floor(F.col("value")) % 10).alias("mean_score")))


@query
def tool_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of trajectories without tool errors, per prompt."""
    t = fx.trajectories(spark, sf_dir)
    return rounded(t.groupBy("prompt_id").agg(F.avg((F.col("tool_errors") == 0).cast("double")).alias("success_rate")))


@query
def spec_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """specification detection reward per completion against the first truth row."""
    comp, con = _eval_inputs(spark, sf_dir)
    j = sc.with_truth(comp.select("contract_id", "k", *rw.spec_features("text")), con)
    v = F.get(F.col("vulnerabilities"), 0)
    r = rw.spec_detection_reward(None, v["swc_id"], F.coalesce(v["lines"], v["line_range"]), v["severity"],
                                 features=[F.col("_spec_got"), F.col("_spec_iv"), F.col("_spec_sev")])
    return rounded(j.select("contract_id", "k", r.alias("reward")))


@query
def tokens_per_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completion tokens per true positive, per run (0 when no hit)."""
    comp, con = _eval_inputs(spark, sf_dir)
    s = ev.score_answers(comp.withColumn("tokens", tx.token_estimate("text")), con, keep=("tokens",))
    agg = s.groupBy("k").agg(F.sum("tokens").alias("tokens"), F.sum("tp").alias("tp"))
    return rounded(agg.select("k", F.col("tokens").cast("long").alias("tokens"), F.col("tp").cast("long").alias("tp"),
                              ev.safe_div(F.col("tokens"), F.col("tp")).alias("tokens_per_hit")))


@query
def trace_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean estimated tokens of reasoning traces, per model."""
    c = fx.completions(spark, sf_dir).where(fl.has_think("text"))
    return rounded(c.groupBy("model").agg(F.avg(tx.token_estimate("text")).alias("mean_tokens"),
                                          F.count(F.lit(1)).alias("n")))


@query
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tercile of every completion by estimated tokens (ties by id)."""
    c = fx.completions(spark, sf_dir).select("contract_id", "k", tx.token_estimate("text").alias("tokens"))
    t = rn.tercile(c, "tokens", F.col("contract_id") * 8 + F.col("k"))
    return t.select("contract_id", "k", "tokens", "bucket")


@query
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of completions passing every quality filter, per model, gate > 0.90."""
    q = fl.quality_flags(fx.completions(spark, sf_dir))
    g = q.groupBy("model").agg(F.avg(F.col("all_pass").cast("double")).alias("pass_share"))
    return rounded(g.withColumn("gate_passed", F.col("pass_share") > 0.90))


@query
def concise_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Among verified answers of a prompt, shortest chosen and longest rejected (>= 2)."""
    comp, con = _eval_inputs(spark, sf_dir)
    j = sc.with_truth(comp.select("contract_id", "k", tx.token_estimate("text").alias("tokens"), *rw.text_features("text")), con)
    truth = ev.truth_classes("vulnerabilities", default="")
    ok = j.where(rw.filter_verifier(None, truth, F.col("_got"), F.col("_no_vuln")) == 1.0)
    g = ok.groupBy("contract_id").agg(
        F.min_by("k", F.struct("tokens", "k")).alias("chosen_k"),
        F.max_by("k", F.struct(F.col("tokens"), -F.col("k"))).alias("rejected_k"),
        F.count(F.lit(1)).alias("n_correct"))
    return g.where(F.col("n_correct") >= 2)


@query
def sweep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best learning rate per experiment by mean F1 (rate by step mod 4; ties to the smaller rate)."""
    r = fx.runs(spark, sf_dir)
    lrs = F.array(*[F.lit(float(x)) for x in LEARNING_RATES])
    s = r.withColumn("learning_rate", F.element_at(lrs, (F.col("step") % 4) + 1)) \
        .groupBy("experiment", "learning_rate").agg(F.avg("f1").alias("f1"))
    return rounded(s.groupBy("experiment").agg(
        F.max_by("learning_rate", F.struct(F.col("f1"), -F.col("learning_rate"))).alias("best_learning_rate"),
        F.max("f1").alias("best_f1")))


@query
def holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items split into development and test halves by seeded hash order."""
    b = read_table(spark, sf_dir, "benchmark").select("item_id")
    s = od.train_validation_split(b, "item_id", seed=11, train_split=0.5)
    return s.select("item_id", F.when(F.col("split") == "train", "dev").otherwise("test").alias("split"))


@query
def active_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After the zero-gradient filter, a full batch of 64 prompts in seeded order."""
    a = sc.drop_zero_gradient(sc.advantages(_scored(spark, sf_dir))).select("contract_id").distinct()
    r = od.seeded_shuffle(a, "contract_id", seed=3)
    return r.where(F.col("rank") <= 64).select("contract_id", F.col("rank").cast("long").alias("rank"))


@query
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milestone gates on each run's F1."""
    comp, con = _eval_inputs(spark, sf_dir)
    return rounded(rn.milestone_gates(ev.evaluate(comp, con)))


@query
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """formatted report lines (percent, target, PASS/FAIL)."""
    comp, con = _eval_inputs(spark, sf_dir)
    return ev.target_report(ev.evaluate(comp, con)).select("k", "metric", "line")


@query
def class_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every truth row of every answer with its hit flag."""
    comp, con = _eval_inputs(spark, sf_dir)
    c = con.select("contract_id", ev.truth_classes().alias("truth_rows"))
    pred = comp.select("contract_id", "k", ev.predicted_classes("text").alias("pred"))
    return ev.class_hits(ev.with_unanswered(pred, c)).groupBy("contract_id", "k", "swc_id", "hit").agg(F.count(F.lit(1)).alias("n"))


@query
def ordered_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-class recall report of run 0 with its position in class order."""
    comp, con = _eval_inputs(spark, sf_dir)
    r = ev.per_class_recall(comp, con).where(F.col("k") == 0)
    return rounded(r.select("swc_id", "tp", "fn", "recall",
                            F.row_number().over(Window.orderBy("swc_id")).cast("long").alias("position")))


@query
def instruct_dpo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INSTRUCT preference set = length-filtered THINK pairs + outcome pairs + concise pairs."""
    think = ds.delta_pairs(fx.completions(spark, sf_dir), fx.contracts(spark, sf_dir), max_gap=None,
                           signed_token_gap=100).select(F.col("contract_id").alias("prompt_id")).withColumn("kind", F.lit("think"))
    tool = rn.outcome_pairs(fx.trajectories(spark, sf_dir)).select("prompt_id").withColumn("kind", F.lit("tool_use"))
    conc = concise_pairs(spark, sf_dir).select(F.col("contract_id").alias("prompt_id")).withColumn("kind", F.lit("concise"))
    return think.unionByName(tool).unionByName(conc).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query
def data_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic share 0/25/50/75% of a 200-row SFT budget (traces vs labelled rows),
    bounded by the supply of each pool (one aggregate over both pools, then the share list)."""
    synth = fx.completions(spark, sf_dir).where(fl.has_think("text")).select(F.lit("synthetic").alias("pool"))
    lab = fx.contracts(spark, sf_dir).where(F.col("source").isin("curated", "tabular")).select(F.lit("labelled").alias("pool"))
    sup = synth.unionByName(lab).agg(F.count_if(F.col("pool") == "synthetic").alias("n_synth"),
                                     F.count_if(F.col("pool") == "labelled").alias("n_lab"))
    shares = F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75)])
    x = sup.select("*", F.explode(shares).alias("synthetic_share"))
    want = F.floor(F.lit(200.0) * F.col("synthetic_share")).cast("long")
    return x.select("synthetic_share", F.least(want, F.col("n_synth")).alias("synthetic_rows"),
                    F.least(F.lit(200) - want, F.col("n_lab")).cast("long").alias("labelled_rows"))


@query
def rl_zero_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RL-ZERO prompts of the hard-only prompts (pass rate 0)."""
    comp, con = _eval_inputs(spark, sf_dir)
    hard = sc.hard_only(sc.pass_rates(comp, con)).select("contract_id")
    c = fx.contracts(spark, sf_dir).join(hard, "contract_id", "left_semi")
    return c.select("contract_id", fm.rl_zero_prompt("source_code").alias("prompt"))


@query
def variant_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the SFT, DPO and RL sets per variant (RL-ZERO builds no SFT set)."""
    c = fx.contracts(spark, sf_dir)
    out = None
    for variant in ("THINK", "INSTRUCT", "RL-ZERO"):
        sft = ds.build_sft(c, variant=variant, num_samples=SFT_N, format_type="alpaca").select("split").withColumn("kind", F.lit("sft"))
        dpo = ds.build_dpo(c, num_samples=DPO_N).select("split").withColumn("kind", F.lit("dpo"))
        rl = ds.build_rl_prompts(c, num_prompts=RL_N).select(F.lit("all").alias("split")).withColumn("kind", F.lit("rl"))
        u = sft.unionByName(dpo).unionByName(rl).groupBy("kind", "split").agg(F.count(F.lit(1)).alias("n")) \
            .withColumn("variant", F.lit(variant))
        out = u if out is None else out.unionByName(u)
    return out.select("variant", "kind", "split", "n")


# ---------------------------------------------------------------------------
# Sources, sinks, catalogue
# ---------------------------------------------------------------------------

import uuid  # noqa: E402

from vulnsift.session import checkpoint_dir  # noqa: E402
from vulnsift.sources import catalog as cat  # noqa: E402
from vulnsift.sources import files as sf  # noqa: E402
from vulnsift.sources import sinks as sk  # noqa: E402


@query
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per source over the contract pools, 0 for catalogued sources without rows."""
    names = spark.createDataFrame([(s,) for s in ("curated", "tabular", "unlabelled", "clean", "exploits", "reports")],
                                  "source string")
    return cat.source_counts(fx.contracts(spark, sf_dir), names)


@query
def side_file_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV rows (address = doc id, 'Source Code' = text) left-joined to side files (stem =
    doc id, present for doc_id mod 3 <> 0, content with a '// file' first line); code is file-first."""
    d = read_docs(spark, sf_dir)
    csv = d.select(F.col("doc_id").cast("string").alias("Contract Address"), F.col("text").alias("Source Code"))
    side = d.where(F.col("doc_id") % 3 != 0).select(
        F.concat(F.lit("side/"), F.col("doc_id").cast("string"), F.lit(".sol")).alias("path"), F.concat(F.lit("// file\n"), F.col("text")).alias("text"))
    j = sf.side_file_join(csv, side, "Contract Address", "Source Code", "side")
    return j.select(F.col("Contract Address").alias("address"), F.col("_code").alias("source_code"),
                    F.col("_path").alias("file_path"))


@query
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """year (first 4-digit part) and stem of exploit-style paths derived from documents."""
    d = read_docs(spark, sf_dir)
    year = F.when(F.col("doc_id") % 4 == 0, F.lit("misc")).otherwise((2018 + F.col("doc_id") % 6).cast("string"))
    p = F.concat(F.lit("exploits/src/test/"), year, F.lit("/"), F.col("lang"), F.lit("/case_"),
                 F.col("doc_id").cast("string"), F.lit(".t.sol"))
    return d.select("doc_id", p.alias("path")).select("doc_id", "path", tx.first_year_part("path").alias("year"),
                                                      tx.file_stem("path").alias("stem"))


@query
def dataset_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S12 + S13 + S11: the alpaca SFT set written partitioned by split (and as JSON lines) into
    the shared checkpoint folder, then its train split read back with partition pruning."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/roundtrip-{uuid.uuid4().hex}"
    s = ds.build_sft(fx.contracts(spark, sf_dir), num_samples=SFT_N, format_type="alpaca")
    s = s.select("contract_id", "split", "instruction", "input", "output", "is_vulnerable")
    sk.write_split_dataset(s, f"{base}/parquet")
    sk.write_jsonl(s, f"{base}/jsonl")
    back = sk.read_train_split(spark, f"{base}/parquet")
    return back.select("contract_id", "output", "is_vulnerable")


# ---------------------------------------------------------------------------
# Streaming (X01, X02): staged files -> availableNow stream -> parquet sink -> batch read-back
# ---------------------------------------------------------------------------

from vulnsift.streaming import alarm as al  # noqa: E402
from vulnsift.streaming import append as st  # noqa: E402


@query
def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions (with retried duplicates of the weak answers) streamed through the
    watermark dedup and trace acceptance into a parquet sink."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-append-{uuid.uuid4().hex}"
    c = fx.completions(spark, sf_dir)
    ev_rows = c.select((F.col("contract_id") * 8 + F.col("k")).alias("completion_id"), "contract_id", "k", "model", "text",
                       F.timestamp_seconds(F.lit(1_704_067_200) + F.col("contract_id") * 8 + F.col("k")).alias("arrived_at"))
    retries = ev_rows.where(F.col("model") == "weak")
    ev_rows.unionByName(retries).write.json(f"{base}/in")
    st.run_append(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt")
    return spark.read.schema(st.COMPLETION_EVENTS).parquet(f"{base}/out").select("contract_id", "k")


@query
def stream_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean value per event type; windows closed by the watermark are emitted."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-monitor-{uuid.uuid4().hex}"
    e = read_table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    e.write.parquet(f"{base}/in")
    st.run_monitor(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt")
    out = spark.read.parquet(f"{base}/out")
    return rounded(out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                              "event_type", "mean_value", "n"))


# ---------------------------------------------------------------------------
# User hooks (E01-E04) and file sources
# ---------------------------------------------------------------------------

from vulnsift.operators import hooks as hk  # noqa: E402


def _demo_generator(batch):
    """A deterministic user 'model': names class 100 + id mod 30 and line id mod 40 + 1."""
    import pandas as pd
    ids = batch["contract_id"]
    text = ("Vulnerability: demo\nSWC: " + (100 + ids % 30).astype(str) + "\nLines: " + (ids % 40 + 1).astype(str)
            + "\n\nSWC: " + (100 + ids % 7).astype(str))
    return pd.DataFrame({"contract_id": ids, "text": text})


def _whitespace_tokens(s):
    return s.str.split().str.len().fillna(0).astype("int64")


@query
def user_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user generator over the prompts (mapInPandas), a user tokenizer (pandas UDF),
    a user reward blended into the class reward, and the native one-to-many findings parse."""
    c = fx.contracts(spark, sf_dir).where(F.col("source") == "curated")
    prompts = c.select("contract_id", fm.zero_shot_prompt("source_code").alias("prompt"))
    gen = hk.generate(prompts.select("contract_id"), _demo_generator, "contract_id long, text string")
    j = gen.join(c.select("contract_id", "vulnerabilities"), "contract_id")
    base = rw.class_reward("text", ev.truth_classes())
    reward = hk.custom_reward(base, lambda r: F.when(r > 0, F.lit(1.0)).otherwise(F.lit(0.0)), 0.5)
    n_find = F.size(ev.findings_array("text"))
    return rounded(j.select("contract_id", hk.token_count("text", _whitespace_tokens).alias("n_tokens"),
                            reward.alias("reward"), n_find.cast("long").alias("n_findings")))


def _stage_files(df: DataFrame, root: str) -> None:
    """Write each (relpath, text) row to its own file under `root` (test-input staging; the
    file system comes from the URI, so shared storage works as well as a local folder)."""
    def write(batches):
        import pandas as pd
        import pyarrow.fs as pafs
        fs, base = pafs.FileSystem.from_uri(root)  # a path without a scheme is a local one, as in a test
        for b in batches:
            for rel, text in zip(b["relpath"], b["text"]):
                path = f"{base}/{rel}"
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(path) as out:
                    out.write((text or "").encode("utf-8"))
            yield pd.DataFrame({"n": [len(b)]})
    df.mapInPandas(write, "n long").agg(F.sum("n")).collect()


def _staged(spark: SparkSession, sf_dir: str) -> str:
    """Files staged from the tables: curated pool as dataset/<category>/<id>.sol with CRLF line ends, tabular pool as two
    CSV layouts plus side files, unlabelled pool as parquet, exploit-style paths, pages as Markdown and JSON reports."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    c = fx.contracts(spark, sf_dir)
    cur = c.where(F.col("source") == "curated")
    tab = c.where(F.col("source") == "tabular")
    pages = fx.reports(spark, sf_dir)
    staged = (
        cur.select(F.concat(F.lit("curated/dataset/"), "category", F.lit("/"), F.col("contract_id").cast("string"),
                            F.lit(".sol")).alias("relpath"), F.replace("source_code", F.lit("\n"), F.lit("\r\n")).alias("text"))
        .unionByName(tab.where(F.col("contract_id") % 3 != 0).select(
            F.concat(F.lit("bccc/Vulnerable_SourceCodes/"), F.col("contract_id").cast("string"), F.lit(".sol")).alias("relpath"),
            F.col("source_code").alias("text")))
        .unionByName(cur.select(F.concat(F.lit("exploits/src/test/"), (2019 + F.col("contract_id") % 5).cast("string"),
                                         F.lit("/x"), F.col("contract_id").cast("string"), F.lit(".sol")).alias("relpath"),
                                F.col("source_code").alias("text")))
        .unionByName(pages.select(F.concat(F.lit("audits/firm"), (F.col("report_id") % 3).cast("string"), F.lit("/"),
                                           F.col("report_id").cast("string"),
                                           F.when(F.col("report_id") % 2 == 0, F.lit(".md")).otherwise(F.lit(".json"))).alias("relpath"),
                                  F.when(F.col("report_id") % 2 == 0, F.col("content"))
                                  .otherwise(F.to_json(F.struct("report_id", "file_path"))).alias("text")))
    )
    _stage_files(staged, base)
    tab.select(F.col("contract_id").alias("id"), F.col("source_code").alias("code")).write.csv(
        f"{base}/tdm", header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    tab.select(F.col("contract_id").cast("string").alias("Contract Address"), F.lit("csv code").alias("Source Code")) \
        .write.csv(f"{base}/bccc/csv", header=True, escape='"')
    c.where(F.col("source") == "unlabelled").select(F.col("source_code").alias("content"), "file_path") \
        .write.parquet(f"{base}/zellic")
    return base


def _loaded(spark: SparkSession, base: str) -> DataFrame:
    """S01-S04 + S09: the contract sources in their order, keyed by their path below the data folder."""
    return sf.with_key(cat.union_sources([
        sf.load_curated(spark, f"{base}/curated"), sf.load_labelled_csv(spark, f"{base}/tdm"),
        sf.load_address_csv(spark, f"{base}/bccc/csv", f"{base}/bccc/Vulnerable_SourceCodes"),
        sf.load_unlabelled(spark, f"{base}/zellic")]), base)


@query
def file_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S01-S08 + S09: every scan over the staged files."""
    base = _staged(spark, sf_dir)
    contracts = _loaded(spark, base).select("source", "file_path", "source_code")
    exploits = sf.load_exploits(spark, f"{base}/exploits").select(
        "source", "file_path", F.col("source_code"), F.col("year"))
    reports = sf.load_reports(spark, f"{base}/audits").select(
        "source", "file_path", F.col("content").alias("source_code"))
    return contracts.unionByName(exploits, allowMissingColumns=True).unionByName(reports, allowMissingColumns=True) \
        .select("source", F.length("source_code").cast("long").alias("length"), "year")


@query
def files_sft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D01 straight from the file loaders' rows."""
    s = ds.build_sft(_loaded(spark, _staged(spark, sf_dir)), num_samples=SFT_N, format_type="alpaca", pools=ds.FILE_POOLS)
    return s.select("contract_id", "split", F.col("rank").cast("long").alias("rank"), "is_vulnerable",
                    F.col("num_vulns").cast("long").alias("num_vulns"), F.length("input").cast("long").alias("length"))


@query
def files_dpo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D02 straight from the file loaders' rows."""
    d = ds.build_dpo(_loaded(spark, _staged(spark, sf_dir)), num_samples=DPO_N, pools=ds.FILE_POOLS)
    return d.select("contract_id", "split", F.col("rank").cast("long").alias("rank"), "pair_kind")


# ---------------------------------------------------------------------------
# Remaining inventory items: D08, F22, S10, S14-S16
# ---------------------------------------------------------------------------

@query
def rl_filter_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts whose completions pass the verifier at most 62.5% of the time, with the
    zero-shot prompt and the ground truth."""
    comp, con = _eval_inputs(spark, sf_dir)
    kept = sc.difficulty_filter(sc.pass_rates(comp, con))
    j = kept.join(con.select("contract_id", "source_code", "vulnerabilities"), "contract_id")
    return rounded(j.select("contract_id", fm.zero_shot_prompt("source_code").alias("prompt"), "pass_rate",
                            F.size("vulnerabilities").cast("long").alias("n_truth")))


@query
def severity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """severity of every finding of every answer against every truth row of its class: predicted, truth, match."""
    comp, con = _eval_inputs(spark, sf_dir)
    found = comp.select("contract_id", "k", F.explode(ev.findings_array("text")).alias("f")).select(
        "contract_id", "k", F.col("f.block").alias("block"), F.col("f.swc_id").alias("swc_id"), F.col("f.severity").alias("predicted"))
    truth = con.select("contract_id", F.posexplode("vulnerabilities").alias("truth_row", "v")).select(
        "contract_id", "truth_row", F.coalesce("v.swc_id", F.lit("SWC-000")).alias("swc_id"), F.col("v.severity").alias("truth"))
    return found.join(truth, ["contract_id", "swc_id"]).select(
        "contract_id", "k", "block", "truth_row", "swc_id", "predicted", "truth", (F.col("predicted") == F.col("truth")).alias("match"))


@query
def source_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10 + A01: the provided tables as a catalogue (present or not) with their row counts."""
    names = ["documents", "labels", "benchmark", "pages", "conversations", "events", "missing_table"]
    catalogue = cat.source_catalogue(spark, sf_dir, [(n, f"{n}.parquet") for n in names])
    present = [n for n in names if n != "missing_table"]
    rows = None
    for n in present:
        part = read_table(spark, sf_dir, n).select(F.lit(n).alias("source"))
        rows = part if rows is None else rows.unionByName(part)
    counts = cat.source_counts(rows, catalogue)
    return counts.join(catalogue.select("source", "present"), "source")


@query
def eval_sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S15 + S14 + S16: evaluation metrics and per-answer results written as two tables,
    answers appended as JSON records, a run summary appended twice; metrics read back."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/evalsink-{uuid.uuid4().hex}"
    comp, con = _eval_inputs(spark, sf_dir)
    scored = ev.score_answers(comp, con).select("contract_id", "k", "tp", "fp", "fn", "n_pred")
    metrics = ev.evaluate(comp, con)
    sk.write_evaluation(metrics, scored, base)
    sk.append_records(comp.select("contract_id", "k", "text"), f"{base}/records")
    summ = rn.run_summary(_log(spark, sf_dir))
    sk.append_run_summary(summ, f"{base}/runs")
    sk.append_run_summary(summ, f"{base}/runs")
    back = spark.read.parquet(f"{base}/metrics")
    n_results = spark.read.parquet(f"{base}/results").count()
    n_records = spark.read.json(f"{base}/records").count()
    n_runs = spark.read.parquet(f"{base}/runs").count()
    return rounded(back.select("k", "tp", "fp", "fn", "tn", "f1",
                               F.lit(n_results).cast("long").alias("n_results"),
                               F.lit(n_records).cast("long").alias("n_records"),
                               F.lit(n_runs).cast("long").alias("n_summary_rows")))


# ---------------------------------------------------------------------------
# The same queries over answers and labels that every filter both keeps and drops (fixtures.KIND)
# ---------------------------------------------------------------------------

MIXED = ["match_category", "zero_gradient", "difficulty_filter", "rl_filter_set", "pass_at_k", "concise_pairs",
         "quality_gate", "delta_pairs", "dpo_build", "trace_quality", "findings_parse", "eval_metrics"]


def _over_mixed(name: str) -> Callable[[SparkSession, str], DataFrame]:
    plain = QUERIES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        before = fx.KIND.set("mixed")
        try:
            return plain(spark, sf_dir)
        finally:
            fx.KIND.reset(before)

    run.__name__, run.__doc__ = f"{name}_mixed", f"{plain.__doc__} Mixed answers and labels."
    return run


for _name in MIXED:
    QUERIES[f"{_name}_mixed"] = _over_mixed(_name)


@query
def trace_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D10 whole: traces that are complete, not repetitive, long enough and free of benchmark text."""
    before = fx.KIND.set("mixed")
    try:
        traces = fx.completions(spark, sf_dir).withColumn("trace_id", F.col("contract_id") * 40 + F.col("k"))
        kept = fl.trace_set(traces, read_table(spark, sf_dir, "benchmark").select("text"))
    finally:
        fx.KIND.reset(before)
    return kept.select("contract_id", "k", "tokens")


def _best_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """specification reward against all truth rows, related classes included, the best kept."""
    comp, con = _eval_inputs(spark, sf_dir)
    return rounded(sc.spec_rewards(comp, con).select("contract_id", "k", "reward"))


QUERIES["spec_reward_best"] = _best_spec
QUERIES["spec_reward_best_mixed"] = _over_mixed("spec_reward_best")


@query
def confident_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled vulnerabilities of a confidence of at least 0.5, fanned out to four trace prompts each."""
    g = fx.ground_truth(spark, sf_dir).withColumn("confidence", (F.col("contract_id") * 7 % 10) / 10)
    return rounded(fl.confident(g).select("contract_id", "swc_id", "confidence", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("trace_id")))


@query
def variant_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all variants, written as one partitioned table and read back: digest of each record's text."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/variants-{uuid.uuid4().hex}"
    sets = vr.variant_sets(fx.contracts(spark, sf_dir), sft_samples=SFT_N, dpo_samples=DPO_N, rl_prompts=RL_N)
    vr.write_variant_sets(sets, path)
    back = spark.read.schema(sets.schema).parquet(path)
    text = F.concat_ws("|", F.array_join(F.transform("messages", lambda m: m["content"]), "|"), "prompt", "chosen", "rejected")
    return back.select("variant", "kind", "split", "contract_id", "rank", F.md5(text).alias("digest"), F.size("ground_truth").cast("long").alias("n_truth"))


@query
def variant_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every set, observed while the sets are written."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/variants-{uuid.uuid4().hex}"
    sets = vr.variant_sets(fx.contracts(spark, sf_dir), sft_samples=SFT_N, dpo_samples=DPO_N, rl_prompts=RL_N)
    return vr.write_variant_sets(sets, path)


@query
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SFT set written as JSON lines, one folder a split, and read back."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/jsonl-{uuid.uuid4().hex}"
    s = ds.build_sft(fx.contracts(spark, sf_dir), num_samples=SFT_N)
    sk.write_jsonl(s, path)
    return _messages_flat(spark.read.schema(s.schema).json(path))


@query
def stream_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X02 + W06 live: run events in four files, one a batch, the last with copies of the first days' rows that come too late; windows
    whose mean length is above 1.02 times that of the run's first window."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-alarms-{uuid.uuid4().hex}"
    r = fx.runs(spark, sf_dir).select("experiment", "stage", F.col("ts").cast("timestamp").alias("ts"), "mean_length", F.col("f1").alias("reward"))
    lo, hi = r.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    cuts = [lo + (hi - lo) * i // 4 for i in range(4)] + [hi + 1]
    at = F.unix_micros("ts")
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = r.where((at >= a) & (at < b))
        late = r.where(at < lo + 5 * 86_400_000_000).withColumn("mean_length", F.lit(1e9))
        (part.unionByName(late) if i == 3 else part).coalesce(1).write.mode("append").parquet(f"{base}/in")
    al.run_alarms(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", factor=1.02)
    out = spark.read.schema(al.ALARMS).parquet(f"{base}/out")
    return rounded(out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")))


# ---------------------------------------------------------------------------
# Mixtures and ablations as records
# ---------------------------------------------------------------------------

from vulnsift.plans import ablations as ab  # noqa: E402
from vulnsift.schemas import DATA_MIXES, GRID_LORA_RANKS, GRID_MODEL_SIZES, GRID_TOKEN_COUNTS  # noqa: E402

ARM_SIZE = 400
# component shares of each arm: the named mixes, the CPT mix, the shares of synthetic rows, security only against mixed, and
# one arm for each tercile of trace length and of the strong-weak gap
ABLATION_ARMS = [*((f"mix:{m}", c, r) for m, c, r in DATA_MIXES), *((f"mix:{m}", c, r) for m, c, r in MIXTURE if m == "cpt"),
                 *((f"synthetic:{s}", c, r) for s in (0.0, 0.25, 0.5, 0.75) for c, r in (("synthetic_vulns", s), ("labeled_vulns", 1 - s))),
                 ("domain:security", "labeled_vulns", 0.8), ("domain:security", "security_docs", 0.2), ("domain:mixed", "labeled_vulns", 0.4),
                 ("domain:mixed", "security_docs", 0.1), ("domain:mixed", "general_code", 0.3), ("domain:mixed", "math_reasoning", 0.2),
                 *((f"trace_length:{n}", f"trace_{i}", 1.0) for i, n in ((1, "short"), (2, "medium"), (3, "long"))),
                 *((f"delta_gap:{n}", f"gap_{i}", 1.0) for i, n in ((1, "small"), (2, "medium"), (3, "large")))]


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(component, item_id): every pool of the mixtures; traces and pairs also by the tercile of their length and gap."""
    con, comp = fx.contracts(spark, sf_dir), fx.completions(spark, sf_dir)
    of_source = F.create_map(*[F.lit(x) for kv in (("curated", "labeled_vulns"), ("tabular", "general_code"), ("unlabelled", "solidity_code"),
                                                   ("clean", "clean_contracts")) for x in kv])
    pools = con.select(of_source[F.col("source")].alias("component"), F.concat(F.lit("c"), "contract_id").alias("item_id"))
    pages = read_table(spark, sf_dir, "pages").select(F.explode(F.array(F.lit("security_docs"), F.lit("audit_reports"))).alias("component"),
                                                      F.concat(F.lit("r"), "page_id").alias("item_id"))
    talk = read_table(spark, sf_dir, "conversations").select(F.lit("math_reasoning").alias("component"),
                                                             F.concat(F.lit("t"), "conv_id", F.lit("-"), "turn").alias("item_id"))
    traces = comp.where(fl.has_think("text")).select("contract_id", "k", tx.token_estimate("text").alias("tokens"))
    length = rn.tercile(traces, "tokens", F.col("contract_id") * 40 + F.col("k"))
    trace_id = F.concat(F.lit("x"), "contract_id", F.lit("-"), "k")
    traces = length.select(F.explode(F.array(F.lit("synthetic_vulns"), F.concat(F.lit("trace_"), "bucket"))).alias("component"), trace_id.alias("item_id"))
    pairs = ds.delta_pairs(comp, con, max_gap=None).select("contract_id", F.abs(F.col("words_chosen") - F.col("words_rejected")).alias("gap"))
    gaps = rn.tercile(pairs, "gap", F.col("contract_id")).select(F.concat(F.lit("gap_"), "bucket").alias("component"), F.concat(F.lit("p"), "contract_id").alias("item_id"))
    return pools.unionByName(pages).unionByName(talk).unionByName(traces).unionByName(gaps)


@query
def ablation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D09 + D17: the records of every mix and of every arm of the four data ablations, short pools filled up from the others."""
    arms = spark.createDataFrame([(a, c, float(r), float(ARM_SIZE)) for a, c, r in ABLATION_ARMS], "arm string, component string, ratio double, size double")
    return ab.arm_records(_components(spark, sf_dir), arms)


QUERIES["ablation_records_mixed"] = _over_mixed("ablation_records")


@query
def token_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested token budgets (counts divided by 10,000) over one shuffle of the documents."""
    d = read_docs(spark, sf_dir).select("doc_id", tx.token_estimate("text").alias("tokens"))
    return ab.token_arms(d, "doc_id", "tokens", [(n, t / 1e4) for n, t in GRID_TOKEN_COUNTS])


@query
def token_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second grid (model size x token count x learning rate x rank) with the rows and tokens of its token arm."""
    sets = token_arms(spark, sf_dir).groupBy("arm").agg(F.count("*").alias("n_rows"), F.sum("tokens").cast("long").alias("n_tokens"))
    grid = [F.explode(F.array(*map(F.lit, v))).alias(c) for c, v in (("model_size", GRID_MODEL_SIZES), ("learning_rate", [float(x) for x in LEARNING_RATES]),
                                                                    ("lora_rank", GRID_LORA_RANKS))]
    for g in grid:
        sets = sets.select("*", g)
    return sets.withColumnRenamed("arm", "token_count")


# ---------------------------------------------------------------------------
# Direct-answer records, preferences and grouped responses (D11, D12, P07), first-token latency
# ---------------------------------------------------------------------------

from vulnsift.plans import instruct as ins  # noqa: E402


@query
def instruct_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the think, tool-call and concise legs."""
    r = ins.instruct_records(fx.completions(spark, sf_dir), fx.contracts(spark, sf_dir))
    return r.select("kind", "contract_id", "k", F.size("messages").cast("long").alias("turns"),
                    F.md5(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("|"), m["content"])), "|")).alias("digest"))


@query
def instruct_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference records of the think, tool-use, concise and judged legs (judge score (13 * contract + 7 * k) mod 11)."""
    c = fx.completions(spark, sf_dir).withColumn("judge_score", (F.col("contract_id") * 13 + F.col("k") * 7) % 11)
    p = ins.instruct_preferences(c, fx.contracts(spark, sf_dir), fx.trajectories(spark, sf_dir))
    return p.select("kind", "prompt_id", F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"))


for _name in ("instruct_records", "instruct_preferences"):
    QUERIES[f"{_name}_mixed"] = _over_mixed(_name)


@query
def grouped_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P07 (array form): responses and rewards of every prompt as arrays."""
    comp, con = _eval_inputs(spark, sf_dir)
    s = sc.score_rollouts(comp, con, keep_text=True).select("contract_id", "k", F.col("text").alias("response"), "reward")
    g = ins.grouped_responses(s)
    return rounded(g.select("contract_id", F.md5(F.array_join("responses", "|")).alias("responses"),
                            F.element_at("rewards", 1).alias("first_reward"), F.element_at("rewards", -1).alias("last_reward"), "num_responses"))


@query
def first_token_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time to the first token per experiment, exact percentiles."""
    return rounded(rn.exact_percentiles(fx.runs(spark, sf_dir), "experiment", "first_token_ms", "run_row", {"p50_ms": 0.5, "p90_ms": 0.9, "p99_ms": 0.99}))

