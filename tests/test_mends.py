"""Cases that earlier rounds got wrong: missing answers, new files, outlier ids, Unicode spaces, missing severities."""

import json

import pytest
from pyspark.sql import functions as F

from vulnsift.functions import rewards as rw
from vulnsift.functions import text as tx
from vulnsift.operators import chat as ch
from vulnsift.operators import evaluate as ev
from vulnsift.operators import ordering as od
from vulnsift.operators import runs as rn
from vulnsift.plans import datasets as ds
from vulnsift.plans import fixtures as fx
from vulnsift.schemas import VULN_FIELDS
from vulnsift.session import checkpoint_dir

VULN = "array<struct<swc_id:string>>"


def test_unanswered_contracts_count(spark):
    contracts = spark.createDataFrame([(1, True, [("SWC-107",)]), (2, True, [("SWC-101",)])],
                                      f"contract_id long, is_vulnerable boolean, vulnerabilities {VULN}")
    answers = spark.createDataFrame([(1, 0, "Vulnerability: x\nSWC: 107")], "contract_id long, k int, text string")
    m = ev.evaluate(answers, contracts).first()
    assert (m.total_contracts, m.tp, m.fn, m.recall) == (2, 1, 1, 0.5)
    r = {x.swc_id: (x.tp, x.fn) for x in ev.per_class_recall(answers, contracts).collect()}
    assert r == {"SWC-107": (1, 0), "SWC-101": (0, 1)}
    assert ev.macro_f1(ev.score_runs(answers, contracts)).first().macro_f1 == 0.5


def test_files_added_between_calls_are_seen(spark, tmp_path):
    doc = "doc_id long, text string"
    label = "doc_id long, quality int, toxic int"
    for n in (5, 9):
        spark.createDataFrame([(i, "x") for i in range(n)], doc).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame([(0, 1, 1)], label).write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
        assert fx.contracts(spark, str(tmp_path)).count() == n


@pytest.mark.parametrize("kind", ["long", "string"])
def test_order_buckets_are_even_whatever_the_keys(spark, kind):
    rows = spark.range(20_000).select(F.col("id")).unionByName(spark.range(1).select(F.lit(1 << 60).alias("id")))
    d = rows.select(F.lit(0).alias("src"), F.col("id").cast(kind).alias("key"))
    sizes = od.order_buckets(d, ["src", "key"], 1250).groupBy("_bucket").count().collect()
    assert len(sizes) >= 30 and max(r["count"] for r in sizes) <= 1250
    ranked = od.source_order_rank(d, "src", "key", most=1250).orderBy("key").select("rank").collect()
    assert [r.rank for r in ranked] == list(range(1, 20_002))


def test_no_bucket_above_the_target_on_a_skewed_key(spark):
    """10^7 rows, nine tenths of them with one key; ranks and running sums stay exact."""
    n = 10_000_000
    d = spark.range(n, numPartitions=8).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(777)).alias("key"), F.lit(2).alias("tokens"))
    b = od.order_buckets(d, ["key"], 500_000)
    assert b.groupBy("_bucket").count().agg(F.max("count")).first()[0] <= 500_000
    r = od.exact_rank(b, F.col("_bucket"), [F.col("key"), F.col("_tie")], measure="tokens")
    got = r.agg(F.count("*"), F.countDistinct("rank"), F.max("rank"), F.count_if(F.col("before") != 2 * (F.col("rank") - 1)),
                F.max(F.when(F.col("key") == 777, F.col("rank"))), F.min("group_size")).first()
    assert tuple(got) == (n, n, n, 0, 78 + 9_000_000, n)


def test_budget_leaves_later_buckets_out(spark):
    d = spark.range(20_000).select(F.lit(0).alias("src"), F.col("id").alias("key"), F.lit(3).alias("tokens"))
    r = od.source_order_rank(d, "src", "key", measure="tokens", below=300, most=1000)
    assert od.token_budget(r, 300).count() == 100 and r.count() <= 1000


def test_exact_percentiles(spark):
    d = spark.range(1000).select(F.lit("g").alias("g"), ((F.col("id") * 7919) % 1000).cast("double").alias("v"), "id")
    r = rn.exact_percentiles(d, "g", "v", "id", {"p50": 0.5, "p90": 0.9, "p100": 1.0}).first()
    assert (r.p50, r.p90, r.p100) == (499.0, 899.0, 999.0)


def test_unicode_spaces_and_digits(spark):
    t = "Vulnerability: x\nSWC:\u00a0107\nLines:\u00a05"
    r = spark.createDataFrame([(t,)], "text string").select(
        ev.predicted_classes("text").alias("f03"), tx.classes_reward_dialect("text").alias("f04"), tx.class_filter_dialect("text").alias("f05"),
        tx.class_spec_dialect("text").alias("f06")).first()
    assert (r.f03, r.f04, r.f05, r.f06) == (["SWC-107"], ["107"], "SWC-107", "SWC-107")


def test_missing_severities_are_equal(spark):
    r = spark.createDataFrame([("SWC: 107",)], "text string").select(rw.spec_detection_reward(
        "text", F.lit("SWC-107"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("r")).first()
    assert r.r == 0.75


def test_preference_context_holds_neither_answer(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2"), (1, 3, "assistant", "good")],
                                  "conv_id long, turn long, role string, text string")
    answers = spark.createDataFrame([(1, 3, 0, "good", 1.0), (1, 3, 1, "bad", 0.0), (2, 1, 0, "x", 1.0), (2, 1, 1, "y", 1.0)],
                                    "conv_id long, turn long, answer_id int, text string, score double")
    rows = ch.multi_turn_preferences(turns, answers).collect()
    assert [(r.conv_id, r.chosen, r.rejected) for r in rows] == [(1, "good", "bad")]
    assert "q2" in rows[0].context and "a1" in rows[0].context and "good" not in rows[0].context


def test_outcome_pairs_use_every_trajectory_once(spark):
    t = spark.createDataFrame([(1, 1, True, True, 0), (1, 2, True, True, 0), (1, 3, False, True, 0), (1, 4, True, False, 0), (1, 5, True, True, 2)],
                              "prompt_id long, traj_id long, compiled boolean, fixed boolean, new_findings int")
    assert sorted((r.chosen_id, r.rejected_id, r.reason) for r in rn.outcome_pairs(t).collect()) == [
        (1, 3, "compile_failure"), (2, 4, "wrong_vulnerability")]


def test_one_delta_pair_per_prompt(spark):
    comp = spark.createDataFrame([(1, k, m, f"{m} answer {k}") for k, m in enumerate(["strong", "strong", "weak", "weak", "weak"])],
                                 "contract_id long, k int, model string, text string")
    con = spark.createDataFrame([(1, "contract A {}")], "contract_id long, source_code string")
    assert [(r.chosen, r.rejected) for r in ds.delta_pairs(comp, con).collect()] == [("strong answer 0", "weak answer 2")]


def test_shared_folder_is_asked_for_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())


def test_json_text_equals_json_dumps(spark):
    from pyspark.sql import types as T
    from vulnsift.functions import formats as fm
    texts = ['plain', 'quo"te \\ back/slash', 'é ß 漢字 😀  ', '\x00\x01\b\f\n\r\t\x1f\x7f', '\\u00E9 \\\\u00AB', '', 'ABCDEF \\', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.j for r in df.select("i", fm.json_text(F.col("t"), T.StringType()).alias("j")).collect()}
    assert got == {i: None if t is None else json.dumps(t) for i, t in enumerate(texts)}
    kind = T._parse_datatype_string("array<struct<type:string,n:int,ok:boolean,tags:array<string>,more:map<string,string>,none:string>>")
    rows = [{"type": 'ré"x', "n": 3, "ok": True, "tags": ["a", None, "ü"], "more": {"k\n": "v"}, "none": None}, {"type": None, "n": None, "ok": False, "tags": [], "more": {}, "none": None}, None]
    df = spark.createDataFrame([(rows,)], T.StructType([T.StructField("v", kind)]))
    r = df.select(fm.json_text(F.col("v"), kind, keep_nulls=True).alias("all"), fm.json_text(F.col("v"), kind).alias("set")).first()
    assert r["all"] == json.dumps(rows)
    assert r["set"] == json.dumps([{k: v for k, v in x.items() if v is not None} if x else x for x in rows])
    assert df.select(fm.json_text(F.slice("v", 1, 0), kind)).first()[0] == json.dumps([])


def test_building_the_sets_starts_no_job(spark):
    rows = [(i, f"code {i}", "curated" if i < 40 else "unlabelled", [dict.fromkeys(VULN_FIELDS, "x")] if i < 40 and i % 4 else []) for i in range(300)]
    c = spark.createDataFrame(rows, f"contract_id long, source_code string, source string, vulnerabilities {ds.VULN_TYPE}")
    spark.sparkContext.setJobGroup("build", "sets")
    built = [ds.build_dpo(c, n) for n in (None, 20, 30, 100, 200)] + [ds.build_rl_prompts(c, n) for n in (10, 100)] + [ds.build_sft(c, num_samples=50)]
    assert spark.sparkContext.statusTracker().getJobIdsForGroup("build") == []
    spark.sparkContext.setJobGroup("run", "sets")
    # 30 labelled: none or 1 clean beyond N, else up to 0.3 N in all
    kinds = [dict(b.groupBy("pair_kind").count().collect()) for b in built[:5]]
    assert kinds == [{"missed": 30, "false_positive": 260}, {"missed": 20}, {"missed": 30}, {"missed": 30, "false_positive": 1}, {"missed": 30, "false_positive": 30}]
    assert [b.agg(F.count("*"), F.count_if("has_vulnerability")).first()[:] for b in built[5:7]] == [(10, 10), (100, 40)]
    assert built[7].count() == 30


def test_each_pattern_of_the_parse_searches_a_block_once(spark):
    """Inside a lambda every mention of an extraction is a search of its own: six fields took 26 of them."""
    for parse in (ev.findings_array("text"), ev.predicted_classes("text")):
        said = spark.range(1).select(F.lit("").alias("text")).select(parse.alias("f"))._jdf.queryExecution().analyzed().toString()
        assert [said.count(p) for p in (tx.SWC_PATTERN, tx.CWE_PATTERN, tx.TYPE_PATTERN, tx.SEVERITY_PATTERN, tx.LINES_PATTERN, tx.EXPLANATION_PATTERN)] == [1] * 6


def test_findings_of_long_and_odd_answers(spark):
    code = "<think>\n" + "x = y;  // line a\n" * 5000 + "</think>\n"
    block = "Vulnerability:  tx origin \nSWC: 115\nCWE: 284\nLines: 3 - 5\nSeverity: High\nExplanation: why "
    texts = [code + block, "a\n\n \n\n" + block + "\n\nvulnerability: overflow", "é\n\nſwc: swc-107", "Severity: Low\n\nCWE: 1", " \n\n \n\n ", "", None,
             block + "\n\nNo vulnerability elsewhere", "Vulnerability:  NONE", "vulnerability: noné", block + "\nnone"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", ev.findings_array("text").alias("f")).collect()
    full = ("SWC-115", "CWE-284", "tx origin", "High", "3 - 5", "why", 1.0)
    got = {r.i: [tuple(f) for f in r.f] for r in rows}
    assert got == {0: [(0, *full)], 1: [(1, *full), (2, "SWC-101", None, "overflow", "Medium", None, "", 1.0)], 2: [(1, "SWC-SWC-107", None, "", "Medium", None, "", 1.0)],
                   3: [], 4: [], 5: [], 6: [], 7: [], 8: [], 9: [(0, "SWC-000", None, "noné", "Medium", None, "", 1.0)], 10: [(0, *full)]}
