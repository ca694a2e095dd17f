"""Engine inputs derived from the provided tables.

The rules are key arithmetic, CASE and concatenation only, so that the SQL oracle can
state them identically (see ``vulnsift.oracle.FIXTURE_CTES``). They give rows in the
schemas the jobs expect and do none of the jobs' work.
"""

from __future__ import annotations

from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnsift.functions.text import swc_exact_sql
from vulnsift.session import read_table

# Directory-style category names picked by doc_id mod 8.
CATEGORIES = [
    "reentrancy", "access_control", "arithmetic", "unchecked_low_level_calls",
    "denial_of_service", "bad_randomness", "front_running", "time_manipulation",
]
N_SAMPLES = 8

#: Which answers and labels the fixtures give: "plain" (eight template answers to every prompt), or "mixed" (1 to 40 answers, some
#: after the document's whole text, prompts that are always answered alike, class ids of four digits, empty label lists).
KIND: ContextVar[str] = ContextVar("KIND", default="plain")
EXPERIMENT_STAGES = ["sft", "dpo", "rlvr"]

def _cat(key: str) -> str:
    """SQL of the category of an integer expression."""
    return f"element_at(array({', '.join(map(repr, CATEGORIES))}), cast(({key}) % 8 as int) + 1)"


def _lines_text(doc: str, i: int) -> str:
    first, width = f"({doc} + {7 * i}) % 40 + 1", f"({doc} + {i}) % 6"
    return (f"case when {doc} % 11 = 0 then concat('about ', {first}) when {doc} % 9 = 0 then string({first}) "
            f"else concat({first}, '-', {first} + {width}) end")


def _vuln(doc: str, i: int) -> str:
    """SQL of the i-th labelled vulnerability of a contract."""
    kind = _cat(f"{doc} + {3 * i}")
    return f"""named_struct(
      'type', {kind}, 'name', string(null), 'swc_id', {swc_exact_sql(kind)},
      'cwe_id', case when {doc} % 4 = 0 then concat('CWE-', {doc} % 50 + 100) end,
      'lines', case when {doc} % 7 <> 3 then {_lines_text(doc, i)} end,
      'line_range', case when {doc} % 7 = 3 then {_lines_text(doc, i)} end,
      'severity', case {doc} % 4 when 0 then 'High' when 1 then 'Medium' when 2 then 'Low' end,
      'explanation', case when {doc} % 2 = 0 then concat('Finding {i} in contract ', {doc}) end,
      'description', case when {doc} % 2 = 1 and {doc} % 3 = 0 then concat('Described issue ', {doc}) end,
      'remediation', case when {doc} % 5 <> 1 then 'Apply checks-effects-interactions.' end)"""


_VULNS = ("array<struct<type:string,name:string,swc_id:string,cwe_id:string,lines:string,line_range:string,severity:string,"
          "explanation:string,description:string,remediation:string>>")
_POOL = """case when toxic = 1 then 'curated' when quality = 0 and toxic = 0 then 'tabular'
  when quality = 1 and toxic = 0 then 'clean' when toxic is null then 'unlabelled' end as source"""


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four pools: curated (toxic), tabular (q0 t0), clean (q1 t0), unlabelled (no label)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    first, second = _vuln("doc_id", 0), _vuln("doc_id", 1)
    unlabelled = "source <> 'curated'" + (" or doc_id % 13 = 0" if KIND.get() == "mixed" else "")
    return docs.join(labels, "doc_id", "left").selectExpr("doc_id", "text", _POOL).where("source is not null").selectExpr(
        "doc_id as contract_id", "text as source_code",
        f"concat('dataset/', {_cat('doc_id')}, '/', doc_id, '.sol') as file_path", "source",
        f"{_cat('doc_id')} as category", "source in ('curated', 'tabular') as is_vulnerable",
        f"""case when {unlabelled} then cast(array() as {_VULNS})
          when doc_id % 5 = 0 then array({first}, {second}) else array({first}) end as vulnerabilities""")


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per labelled vulnerability of the curated pool."""
    c = contracts(spark, sf_dir).where("source = 'curated'")
    return c.selectExpr("contract_id", "explode(vulnerabilities) as v").selectExpr(
        "contract_id", "v.swc_id", "v.type as vuln_type", "coalesce(v.lines, v.line_range) as lines", "v.severity")


def _block(cls: str, first: str, last: str) -> str:
    return (f"concat('Vulnerability: ', typ, '\\nCWE: CWE-841\\nSWC: SWC-', {cls}, '\\nLines: ', {first}, '-', {last}, "
            "'\\nSeverity: High\\nExplanation: External call before state update."
            "\\nRemediation: Update state before the call.')")


_RELATED = "map('107', '114', '114', '107', '116', '128', '128', '116')"


def completion_text() -> str:
    """SQL of the answer shapes over the columns t (which), cls, typ and s."""
    blk = _block("cls", "s", "s + 3")
    alt = "if(cls = '107', '104', '107')"
    return f"""case t when 0 then {blk}
      when 1 then concat('Vulnerability: ', typ, '\\nSWC: ', cls, '\\nLines: ', s, '\\nSeverity: Medium\\nExplanation: Bare class number.')
      when 2 then concat('Possible issue SWC-', cls, ' around line ', s, '.')
      when 3 then concat('vulnerability: ', typ, '\\nswc: swc-', cls, '\\nlines: ', s, '-', s + 3, '\\nseverity: low\\nexplanation: lower case answer.')
      when 4 then concat('Vulnerability: ', typ, '\\nSeverity: Medium\\nExplanation: Type only, no class given.')
      when 5 then concat({blk}, '\\n\\n', {_block(alt, "s + 10", "s + 13")})
      when 6 then concat({blk}, '\\n\\n', {_block("cls", "s + 20", "s + 23")})
      when 7 then 'Vulnerability: None\\nExplanation: No vulnerabilities detected in this contract.'
      when 8 then concat({blk}, '\\n\\nThere are no vulnerabilities elsewhere in the code.')
      when 9 then concat('Vulnerability: ', typ, '\\nSWC: SWC-', cls, '\\nLines: ', s + 3, '-', s, '\\nSeverity: High\\nExplanation: Reversed range.')
      when 10 then concat('<think>\\nThe withdraw function sends value before it updates the balance.\\n</think>\\n', {blk})
      when 12 then {_block("concat(cls, '0')", "s", "s + 3")}
      when 13 then {_block(f"coalesce(element_at({_RELATED}, cls), '999')", "s", "s + 3")}
      else '' end"""


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled answers per curated or clean contract (k = 0 strong, k = 1 weak), of the kind that KIND names."""
    mixed = KIND.get() == "mixed"
    ids = contracts(spark, sf_dir).where("source in ('curated', 'clean')").select("contract_id", *["source_code"] * mixed)
    cat = _cat("contract_id")
    # A completions table is stored in files of even size: the stand-in is dealt to as many tasks as the session has shuffle
    # partitions, by answer, not merged into a few tasks by the size of its ids.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if mixed:
        return ids.selectExpr("*", "explode(sequence(0, cast(contract_id % 40 as int))) as k").selectExpr(
            "*", "case contract_id % 6 when 0 then 1 when 1 then if(k % 4 = 0, 5, 1) when 2 then if(k % 3 = 0, 12, (contract_id * 31 + k * 17) % 12) "
            "when 3 then if(k % 4 = 1, 13, (contract_id * 31 + k * 17) % 12) "
            "else (contract_id * 31 + k * 17) % 12 end as t", f"substring({swc_exact_sql(cat)}, 5, 3) as cls",
            f"replace({cat}, '_', ' ') as typ", "contract_id % 40 + 1 as s").selectExpr(
            "contract_id", "k", "source_code", "case k when 0 then 'strong' when 1 then 'weak' else 'policy' end as model",
            f"{completion_text()} as body").selectExpr(
            "contract_id", "k", "model",
            "if(k % 5 = 0 and body <> '', concat('<think>\\n', source_code, '\\n</think>\\n', body), body) as text").repartition(tasks, "contract_id", "k")
    return ids.selectExpr("contract_id", f"explode(sequence(0, {N_SAMPLES - 1})) as k").selectExpr(
        "contract_id", "k", "(contract_id * 31 + k * 17) % 12 as t", f"substring({swc_exact_sql(cat)}, 5, 3) as cls",
        f"replace({cat}, '_', ' ') as typ", "contract_id % 40 + 1 as s").selectExpr(
        "contract_id", "k", "case k when 0 then 'strong' when 1 then 'weak' else 'policy' end as model", f"{completion_text()} as text").repartition(tasks, "contract_id", "k")


def eval_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation set: curated (vulnerable) and clean labelled contracts."""
    return contracts(spark, sf_dir).where(F.col("source").isin("curated", "clean"))


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("prompt_id"),
        e.alias("traj_id"),
        (e % 7 != 0).alias("compiled"),
        (e % 3 == 0).alias("fixed"),
        (e % 4).cast("int").alias("new_findings"),
        F.when(e % 5 == 0, 1).otherwise(0).cast("int").alias("tool_errors"),
        ((e / 10).cast("long") % 3).cast("int").alias("format_violations"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training-run log rows: experiment by event type, step by day."""
    e = F.col("event_id")
    v = F.col("value")
    return read_table(spark, sf_dir, "events").select(
        F.col("event_type").alias("experiment"),
        F.element_at(F.array(*[F.lit(s) for s in EXPERIMENT_STAGES]), (e % 3).cast("int") + 1).alias("stage"),
        F.dayofmonth("ts").cast("int").alias("step"),
        e.alias("run_row"),
        ((v % 50) / 100).alias("precision"),
        ((v % 70) / 100).alias("recall"),
        ((v % 60) / 100).alias("f1"),
        (v * 10).alias("mean_length"),
        (v * 3 + 20).alias("latency_ms"),
        (v % 20 + 5).alias("first_token_ms"),
        F.col("ts"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit reports: page html as content, page_id as key, url as path."""
    return read_table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("report_id"),
        F.col("url").alias("file_path"),
        F.lit("pages").alias("source"),
        F.lit("audit_report").alias("type"),
        F.col("html").alias("content"),
    )


def chat_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two answers to the last user turn of each conversation with their scores: its own last assistant turn, and the
    first third of it."""
    a = read_table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    last = a.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))
    third = F.expr("substring(text, 1, cast(length(text) / 3 as int))")
    both = F.array(F.struct(F.lit(0).alias("answer_id"), F.col("text").alias("text"), F.lit(1.0).alias("score")),
                   F.struct(F.lit(1).alias("answer_id"), third.alias("text"), F.lit(0.25).alias("score")))
    return last.select("conv_id", "turn", F.explode(both).alias("x")).select("conv_id", "turn", "x.*")
