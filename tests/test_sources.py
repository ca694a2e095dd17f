"""File sources on tiny files written to a fresh scratch folder."""

import json
import os
import subprocess

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from vulnsift.sources import catalog as cat
from vulnsift.sources import files as sf
from vulnsift.sources import tree


def scratch():
    return subprocess.check_output(["mktemp", "-d", "/tmp/run-XXXXXX"]).decode().strip()


def write(path, text, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode, newline="") as f:
        f.write(text)


def test_curated_scan(spark):
    root = scratch()
    write(f"{root}/dataset/reentrancy/a.sol", "line1\r\nline2\r\n")
    write(f"{root}/dataset/access_control/b.sol", "")
    write(f"{root}/dataset/access_control/nested/c.sol", "deeper")  # one level only
    write(f"{root}/dataset/access_control/d.sol", "contract D {}")
    write(f"{root}/dataset/access_control/_e.sol", "hidden e")
    write(f"{root}/dataset/.access/.f.sol", "hidden f")
    write(f"{root}/dataset/access_control/f.txt", "no contract")
    rows = {os.path.basename(r.file_path): r for r in sf.load_curated(spark, root).collect()}
    assert set(rows) == {"a.sol", "b.sol", "d.sol", "_e.sol", ".f.sol"}
    assert rows["b.sol"].source_code == "" and rows["_e.sol"].source_code == "hidden e"
    assert rows["a.sol"].source_code == "line1\nline2\n"
    assert rows["a.sol"].vulnerabilities[0].swc_id == "SWC-107"
    assert rows["d.sol"].vulnerabilities[0].swc_id == "SWC-115"
    assert rows["d.sol"].category == "access_control"


def test_labelled_csv_absent_column(spark):
    root = scratch()
    pd.DataFrame({"code": ["x = 1;", None], "label": [1, 0]}).to_csv(f"{root}/a.csv", index=False)
    rows = sf.load_labelled_csv(spark, f"{root}/a.csv").collect()
    assert sorted(r.source_code for r in rows) == ["", "x = 1;"]
    assert {r.file_path for r in rows} == {"tranduongminhdai/unknown"}
    assert all(r.is_vulnerable and len(r.vulnerabilities) == 0 for r in rows)


def test_address_csv_side_files(spark):
    root = scratch()
    pd.DataFrame({"Address": ["0xa", "0xb", "0xc"], "Source Code": ["csv a", "csv b", None]}).to_csv(
        f"{root}/v.csv", index=False)
    write(f"{root}/Vulnerable_SourceCodes/0xa.sol", "file a")
    write(f"{root}/Vulnerable_SourceCodes/0xb.sol", "")  # empty side file: fall back to the CSV
    rows = {r.file_path.rsplit("/", 1)[-1]: r.source_code
            for r in sf.load_address_csv(spark, f"{root}/v.csv", f"{root}/Vulnerable_SourceCodes").collect()}
    assert rows == {"0xa.sol": "file a", "0xb.sol": "csv b", "0xc.sol": ""}


def test_unlabelled_parquet_then_fallback(spark):
    root = scratch()
    pq.write_table(pa.table({"content": ["c1", "c2"]}), f"{root}/part0.parquet")
    rows = sf.load_unlabelled(spark, root).collect()
    assert sorted(r.source_code for r in rows) == ["c1", "c2"]
    assert {r.file_path for r in rows} == {"unknown"}
    root2 = scratch()
    write(f"{root2}/contracts/x/y/z.sol", "zz")
    rows2 = sf.load_unlabelled(spark, root2).collect()
    assert [r.source_code for r in rows2] == ["zz"]


def test_exploits_year_and_stem(spark):
    root = scratch()
    write(f"{root}/src/test/2022-05/notyear.sol", "a")
    write(f"{root}/src/test/2023/Hack.exp.sol", "b")
    rows = {r.exploit_name: r.year for r in sf.load_exploits(spark, root).collect()}
    assert rows == {"notyear": None, "Hack.exp": "2023"}


def test_reports_md_and_json(spark):
    root = scratch()
    write(f"{root}/firm1/r/one.md", "# Report\r\n")
    write(f"{root}/firm2/obj.json", json.dumps({"a": 1}))
    write(f"{root}/firm2/list.json", json.dumps([1, 2]))
    write(f"{root}/firm2/bad.json", "{bad")
    write(f"{root}/top.md", "not in a source folder")
    rows = sf.load_reports(spark, root).collect()
    got = sorted((r.source, r.format, r.content) for r in rows)
    assert got == [("firm1", "md", "# Report\n"), ("firm2", "json", "[1, 2]"), ("firm2", "json", '{"a": 1}'), ("firm2", "json", "{bad")]
    parsed = sf.load_reports(spark, root).select("content", F.try_variant_get("content_json", "$.a", "int").alias("a"),
                                                 F.try_variant_get("content_json", "$[1]", "int").alias("second"), F.col("content_json").isNull().alias("none"))
    assert {r.content: (r.a, r.second, r.none) for r in parsed.collect()} == {
        "# Report\n": (None, None, True), '{"a": 1}': (1, None, False), "[1, 2]": (None, 2, False), "{bad": (None, None, True)}


def test_sources_by_name_and_second_exploit_root(spark):
    root = scratch()
    write(f"{root}/repos/vulnerability_datasets/smartbugs-curated/dataset/reentrancy/a.sol", "a")
    write(f"{root}/datasets/huggingface/Zellic_smart-contract-fiesta/contracts/x/.h.sol", "")
    write(f"{root}/defihacklabs/2021/Two.sol", "t")
    load = lambda *a: [(r.source, r.source_code) for r in sf.load_contracts(spark, root, *a).orderBy("source_rank").collect()]
    assert load() == [("smartbugs", "a"), ("zellic", "")]
    assert load(["zellic", "nowhere", "smartbugs"]) == [("zellic", ""), ("smartbugs", "a")]
    assert load(None, 1) == [("smartbugs", "a")] and load(["nowhere"]) == []
    assert sf.exploits_root(spark, root) == f"{root}/defihacklabs"
    assert [(r.exploit_name, r.year) for r in sf.load_exploits(spark, sf.exploits_root(spark, root)).collect()] == [("Two", "2021")]
    os.makedirs(f"{root}/exploits/defihacklabs")
    assert sf.exploits_root(spark, root) == f"{root}/exploits/defihacklabs"


def test_tree_cuts_partitions(spark, monkeypatch):
    root = scratch()
    for i in range(25):
        write(f"{root}/d{i % 3}/f{i}.sol", f"c{i}\r\n" * (i % 4))
    monkeypatch.setattr(tree, "PARTITION_FILES", 10)
    parts = tree.TreeReader({"path": root, "pattern": "**/*.sol"}).partitions()
    assert [len(p.paths) for p in parts] == [10, 10, 5]
    assert sf.whole_files(spark, "file:" + root, "**/*.sol").count() == 25
    assert {r.text for r in sf.whole_files(spark, root, "*/f3.sol").collect()} == {"c3\n" * 3}
    assert sf.whole_files(spark, root + "/none", "*.sol").count() == 0


def test_catalogue_and_counts(spark):
    root = scratch()
    os.makedirs(f"{root}/datasets/kaggle")
    write(f"{root}/datasets/kaggle/x.csv", "a\n1\n")
    c = cat.source_catalogue(spark, root)
    present = {r.source: r.present for r in c.collect()}
    assert present == {"smartbugs": False, "kaggle": True, "zellic": False, "audit_reports": False}
    rows = spark.createDataFrame([("kaggle",), ("kaggle",)], "source string")
    counts = {r.source: r.n_rows for r in cat.source_counts(rows, c).collect()}
    assert counts == {"smartbugs": 0, "kaggle": 2, "zellic": 0, "audit_reports": 0}
