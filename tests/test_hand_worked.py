"""Expectations worked out by hand from the reference's rules (FIXTURES.md §5, SURVEY §2.8.1)."""

import pytest
from pyspark.sql import functions as F

from vulnsift.functions import rewards as rw
from vulnsift.functions import text as tx
from vulnsift.operators import evaluate as ev
from vulnsift.operators import ordering as od
from vulnsift.operators import scoring as sc
from vulnsift.plans import datasets as ds
from vulnsift.schemas import VULN_FIELDS

VT = "array<struct<" + ",".join(f"{f}:string" for f in VULN_FIELDS) + ">>"


def vulns(*items):
    """Vulnerability list literal: items are (swc_id, lines)."""
    return F.array(*[F.struct(*[(F.lit(v[0]) if f == "swc_id" else F.lit(v[1]) if f == "lines" else F.lit(None))
                                .cast("string").alias(f) for f in VULN_FIELDS]) for v in items]) if items \
        else F.array().cast(VT)


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("text,f03,f04,f05,f06", [
    ("SWC: SWC-107", "SWC-107", "107", None, "SWC-107"),
    ("SWC: 107", "SWC-107", "107", "SWC-107", "SWC-107"),
    ("SWC-107", "", "", None, "SWC-107"),
    ("SWC107", "SWC-107", "107", "SWC-107", "SWC-107"),
    ("swc: swc-107", "SWC-SWC-107", "107", None, None),
])
def test_dialect_table(spark, text, f03, f04, f05, f06):
    t = F.lit(text)
    assert one(spark, F.array_join(ev.predicted_classes(t), ",")) == f03
    assert one(spark, F.array_join(tx.classes_reward_dialect(t), ",")) == f04
    assert one(spark, tx.class_filter_dialect(t)) == f05
    assert one(spark, tx.class_spec_dialect(t)) == f06


def test_match_and_class_reward(spark):
    text = "SWC: 107\n\nSWC: 107\n\nSWC: 104"
    comp = spark.createDataFrame([(1, 0, text)], "contract_id long, k int, text string")
    con = spark.range(1).select(F.lit(1).cast("long").alias("contract_id"), F.lit(True).alias("is_vulnerable"),
                                vulns(("SWC-107", "12-15")).alias("vulnerabilities"))
    r = ev.score_answers(comp, con).first()
    assert (r.tp, r.fp, r.fn) == (1, 1, 0)
    reward = one(spark, rw.class_reward(F.lit(text), F.array(F.lit("SWC-107"))))
    assert reward == pytest.approx(2 / 3)


def test_clean_contract_none_text(spark):
    assert one(spark, rw.class_reward(F.lit("none found, SWC: 107"), F.array().cast("array<string>"))) == 1.0


def test_line_iou(spark):
    iou = one(spark, rw.line_reward(F.lit("Lines: 14-17"), vulns(("SWC-107", "12-15"))))
    assert iou == pytest.approx(2 / 6)


def test_line_iou_huge_range_is_cheap(spark):
    iou = one(spark, rw.line_reward(F.lit("Lines: 1-999999999"), vulns(("SWC-107", "12-15"))))
    assert iou == pytest.approx(4 / 999999999)


def test_reversed_range_is_empty(spark):
    assert one(spark, rw.line_reward(F.lit("Lines: 20-10"), vulns(("SWC-107", "12-15")))) == 0.0


def test_canonical_answer_total_one(spark):
    text = ("Vulnerability: Reentrancy\nCWE: CWE-841\nSWC: SWC-107\nLines: 12-15\nSeverity: High\n"
            "Explanation: x\nRemediation: y")
    v = vulns(("SWC-107", "12-15"))
    cls = rw.class_reward(F.lit(text), ev.truth_classes(v))
    total = rw.total_reward(cls, rw.line_reward(F.lit(text), v), rw.format_reward(F.lit(text)))
    assert one(spark, total) == pytest.approx(1.0)


def test_no_contracts_all_zero(spark):
    comp = spark.createDataFrame([], "contract_id long, k int, text string")
    con = spark.createDataFrame([], f"contract_id long, is_vulnerable boolean, vulnerabilities {VT}")
    m = ev.confusion_totals(ev.score_answers(comp, con), by=())
    r = m.first()
    assert (r.precision, r.recall, r.f1, r.false_positive_rate) == (0.0, 0.0, 0.0, 0.0)


def test_equal_rewards_zero_advantage_dropped(spark):
    df = spark.createDataFrame([(1, k, 1.0) for k in range(4)], "contract_id long, k int, reward double")
    a = sc.advantages(df)
    assert [r.advantage for r in a.collect()] == [0.0] * 4
    assert sc.drop_zero_gradient(a).count() == 0


def test_pass_rate_threshold(spark):
    df = spark.createDataFrame([(1, 5 / 8), (2, 6 / 8)], "contract_id long, pass_rate double")
    kept = [r.contract_id for r in sc.difficulty_filter(df).collect()]
    assert kept == [1]


def test_token_budget(spark):
    df = spark.createDataFrame([(0, 1, 40), (0, 2, 80), (0, 3, 20)], "source_rank int, item_id long, n_chars long")
    df = df.withColumn("tokens", (F.col("n_chars") / 4).cast("long"))
    r = od.source_order_rank(df, "source_rank", "item_id", measure="tokens")
    kept = od.token_budget(r, 25).orderBy("item_id").collect()
    assert [x.item_id for x in kept] == [1, 2]
    assert sum(x.tokens for x in kept) == 30


@pytest.mark.parametrize("n_vuln,expected", [(10, 20), (40, 1), (100, 0)])
def test_dpo_cap(spark, n_vuln, expected):
    # The stop test compares the running total with (N or 1000) * 0.3 after each append.
    assert one(spark, ds.dpo_clean_count(F.lit(n_vuln), 100)[0]) == expected


def test_dpo_cap_bounded_by_supply(spark):
    rows = [(i, "curated" if i < 10 else "unlabelled", [dict.fromkeys(VULN_FIELDS, "x")] if i < 10 else []) for i in range(15)]
    c = spark.createDataFrame(rows, f"contract_id long, source string, vulnerabilities {ds.VULN_TYPE}")
    assert dict(ds.dpo_selection(c, 100).groupBy("pair_kind").count().collect()) == {"missed": 10, "false_positive": 5}
    assert one(spark, ds.dpo_clean_count(F.lit(0), None)[0]) == 300


def test_word_gap(spark):
    a = " ".join(["w"] * 150)
    df = spark.createDataFrame([(1, "strong", a), (1, "weak", " ".join(["w"] * 50)),
                                (2, "strong", a), (2, "weak", " ".join(["w"] * 49))],
                               "contract_id long, model string, text string")
    con = spark.createDataFrame([(1, "code"), (2, "code")], "contract_id long, source_code string")
    kept = [r.contract_id for r in ds.delta_pairs(df, con).collect()]
    assert kept == [1]


def test_pass_at_k(spark):
    assert one(spark, sc.pass_at_k(F.lit(8), F.lit(2), 1)) == pytest.approx(0.25)
    assert one(spark, sc.pass_at_k(F.lit(8), F.lit(2), 32)) is None


def test_word_count_python_split(spark):
    assert one(spark, tx.word_count(F.lit(""))) == 0
    assert one(spark, tx.word_count(F.lit("  a b \n c "))) == 3
