"""Hot prompts measured from the event log, filters that keep and drop, nested arms, Bloom filter, legs of the sets."""

import glob
import json
import subprocess
import sys
from collections import defaultdict
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from vulnsift.operators import bloom
from vulnsift.operators import filters as fl
from vulnsift.operators import skew
from vulnsift.plans import ablations as ab
from vulnsift.plans import fixtures as fx
from vulnsift.plans import variants as vr
from vulnsift.queries import QUERIES

SF = "/root/testdata/sf0.001"

HOT = '''
import sys
from pyspark.sql import SparkSession, functions as F
from vulnsift.operators import scoring as sc
from vulnsift.plans.datasets import VULN_TYPE
from vulnsift.session import get_session
spark = get_session("local[4]", 16, conf={"spark.eventLog.enabled": "true", "spark.eventLog.dir": "file://" + sys.argv[1],
    "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false"})
for k, v in {"coalescePartitions.enabled": "false", "skewJoin.enabled": "false", "autoBroadcastJoinThreshold": "-1"}.items():
    spark.conf.set("spark.sql.adaptive." + k, v)
spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
n = 120_000
comp = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 4000 + 1).alias("contract_id"), F.col("id").cast("int").alias("k"),
    F.concat(F.lit("SWC: 10"), F.col("id") % 10, F.lit(" Lines: "), F.col("id") % 40 + 1).alias("text"))
con = spark.range(4001).select(F.col("id").alias("contract_id"), F.from_json(F.lit('[{"swc_id": "SWC-107", "lines": "1-5"}]'), VULN_TYPE).alias("vulnerabilities"))
a = sc.advantages(sc.score_rollouts(comp, con))
assert a.count() == n and abs(a.agg(F.sum("advantage")).first()[0]) < 1e-6
a.write.format("noop").mode("overwrite").save()
spark.stop()
'''


def test_a_hot_prompt_is_dealt_out():
    """A third of all answers on one prompt: no task of a wide stage reads twice the median."""
    log = subprocess.check_output(["mktemp", "-d", "/tmp/run-XXXXXX"]).decode().strip()
    subprocess.run([sys.executable, "-c", HOT, log], check=True, cwd=__file__.rsplit("/", 2)[0], timeout=300, capture_output=True)
    read = defaultdict(list)
    for path in glob.glob(f"{log}/*"):
        for line in open(path):
            e = json.loads(line)
            if e.get("Event") == "SparkListenerTaskEnd":
                read[e["Stage ID"]].append(e["Task Metrics"]["Shuffle Read Metrics"]["Total Records Read"])
    wide = [r for r in read.values() if len(r) >= 16 and sum(r) >= 100_000]
    assert wide and all(max(r) <= 2 * median(r) for r in wide)


def test_salted_join_equals_plain_join(spark):
    left = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 500).alias("k"), F.col("id").alias("v"))
    right = spark.range(0, 400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    assert [r[:] for r in skew.heavy_keys(left, "k").select("k").collect()] == [(7,)]
    for how in ("inner", "left"):
        got, want = skew.salted_join(left, right, "k", how), left.join(right, "k", how)
        assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    assert skew.salted_join(left.limit(0), right, "k").count() == 0


@pytest.mark.parametrize("name,before", [("zero_gradient", "advantages"), ("difficulty_filter", "pass_rate"), ("rl_filter_set", "pass_rate"),
                                         ("delta_pairs", None), ("concise_pairs", "pass_rate")])
def test_filters_both_keep_and_drop(spark, name, before):
    kept = QUERIES[f"{name}_mixed"](spark, SF).count()
    token = fx.KIND.set("mixed")
    try:
        whole = QUERIES[before](spark, SF).count() if before else fx.contracts(spark, SF).where("source in ('curated', 'clean')").count()
    finally:
        fx.KIND.reset(token)
    assert 0 < kept < whole


def test_mixed_flags_vary(spark):
    q = QUERIES["trace_quality_mixed"](spark, SF)
    assert {r[0] for r in q.select("all_pass").distinct().collect()} == {True, False}
    assert 0 < QUERIES["quality_gate_mixed"](spark, SF).agg(F.max("pass_share")).first()[0] < 1
    assert QUERIES["pass_at_k_mixed"](spark, SF).where("pass_at_32 is not null").count() > 0
    labels = fx.ground_truth(spark, SF).count()
    assert 0 < QUERIES["confident_labels"](spark, SF).select("contract_id", "swc_id").distinct().count() < labels
    exact = QUERIES["spec_reward_best_mixed"](spark, "/root/testdata/sf0.01")
    assert exact.where("reward > 0 and reward < 1").count() > 0
    token = fx.KIND.set("mixed")
    try:
        cat, one = (QUERIES[n](spark, SF).agg(F.sum("tp")).first()[0] for n in ("match_category", "match_exact"))
        assert cat > one
        c = fx.contracts(spark, "/root/testdata/sf0.01").where("source = 'curated'")
        assert 0 < c.where("size(vulnerabilities) = 0").count() < c.count()
    finally:
        fx.KIND.reset(token)


def test_bloom_filter(spark):
    rng = np.random.default_rng(0)
    k = rng.integers(-2**63, 2**63, (2, 5000))
    keys = spark.createDataFrame([(int(a), int(b)) for a, b in k.T], "k1 long, k2 long").repartition(3)
    bits = bloom.build(keys, 5000)
    assert len(bits) * 8 == 1 << 17 and bloom.holds(bits, k[0], k[1]).all()
    other = rng.integers(-2**63, 2**63, (2, 50_000))
    assert bloom.holds(bits, other[0], other[1]).mean() < 0.01
    assert not bloom.holds(bloom.build(keys.limit(0), 0), k[0], k[1]).any()


def test_only_overlapping_rows_reach_the_join(spark):
    """With a filter far too small for the set all answers stay right; otherwise few n-grams pass."""
    train = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(200)], "id long, text string")
    bench = spark.createDataFrame([(" ".join(f"w{i}x{j}" for j in range(20, 40)),) for i in (3, 77)] + [("W9x0  w9x1\tw9x2",)], "text string")
    short = spark.createDataFrame([(900, "w9x0 w9x1 w9x2"), (901, "w9x0 w9x1"), (902, None)], "id long, text string")
    assert sorted(r[0] for r in fl.overlap_ids(train.unionByName(short), bench, "id").collect()) == [3, 77, 900]
    assert sorted(r[0] for r in fl.decontaminate(short, bench, "id").select("id").collect()) == [901, 902]


def test_water_level(spark):
    arms = spark.createDataFrame([("a", c, r, 100.0) for c, r in (("x", 0.5), ("y", 0.3), ("z", 0.2))] + [("b", "x", 0.5, 1000.0), ("b", "q", 0.5, 1000.0)],
                                 "arm string, component string, ratio double, size double")
    supply = spark.createDataFrame([("x", 10), ("y", 500), ("z", 500)], "component string, n long")
    got = {(r.arm, r.component): r["take"] for r in ab.water_fill(arms, supply).collect()}
    # x gives all its 10, the other 90 go 3 : 2; arm b gets all there is
    assert got == {("a", "x"): 10, ("a", "y"): 54, ("a", "z"): 36, ("b", "x"): 10, ("b", "q"): 0}


def test_arms_are_nested(spark):
    rows = QUERIES["ablation_records"](spark, "/root/testdata/sf0.01").collect()
    arm = defaultdict(set)
    for r in rows:
        arm[r.arm, r.component].add(r.item_id)
    for a, b in (("0.25", "0.5"), ("0.5", "0.75")):
        assert arm[f"synthetic:{a}", "synthetic_vulns"] <= arm[f"synthetic:{b}", "synthetic_vulns"]
        assert arm[f"synthetic:{b}", "labeled_vulns"] <= arm[f"synthetic:{a}", "labeled_vulns"]
    sizes = [QUERIES["token_arms"](spark, "/root/testdata/sf0.01").where(F.col("arm") == a) for a in ("500M", "2B", "10B")]
    assert sizes[0].select("doc_id").exceptAll(sizes[1].select("doc_id")).count() == 0
    assert sizes[1].select("doc_id").exceptAll(sizes[2].select("doc_id")).count() == 0


def test_variants_read_the_texts_once(spark):
    c = fx.contracts(spark, SF)
    plan = vr.variant_sets(c, sft_samples=50, dpo_samples=20, rl_prompts=30)._jdf.queryExecution().optimizedPlan().toString()
    reads = [line for line in plan.split("\n") if "Relation [" in line and "text#" in line]
    assert len(reads) == 1


def test_instruct_legs(spark):
    r = QUERIES["instruct_records_mixed"](spark, SF)
    assert {x.kind: x.turns for x in r.select("kind", "turns").distinct().collect()} == {"think": 2, "concise": 2, "tool": 4}
    p = QUERIES["instruct_preferences_mixed"](spark, SF)
    assert {x.kind for x in p.select("kind").distinct().collect()} == {"think", "tool_use", "concise", "judged"}
    assert p.where("kind = 'concise' and chosen = rejected").count() == 0
