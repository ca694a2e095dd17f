"""File sources (S01-S08, J01, F20) as Spark scans.

Whole files are read by the ``filetree`` data source (one row per file, hidden and empty files included). Windows
line ends are normalised as Python's text mode does.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from vulnsift.functions import text as tx
from vulnsift.plans.datasets import VULN_TYPE
from vulnsift.sources import tree

def empty_vulns() -> Column:
    return F.array().cast(VULN_TYPE)


def _vuln_struct(vtype: Column, swc: Column) -> Column:
    fields = {"type": vtype, "swc_id": swc}
    return F.struct(*[(fields.get(f, F.lit(None).cast("string"))).alias(f)
                      for f in ("type", "name", "swc_id", "cwe_id", "lines", "line_range", "severity",
                                "explanation", "description", "remediation")])


def exists(spark: SparkSession, path: str) -> bool:
    """True when `path` is there (any file system Spark is configured for); starts no job."""
    try:
        return tree.exists(path)
    except ValueError:
        pass
    try:
        spark.read.format("binaryFile").load(path)
        return True
    except AnalysisException:
        return False


def whole_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """One row per file below `root` whose relative path matches: (path, text) with '\\r\\n' / '\\r' normalised to '\\n'. Hidden and
    empty files count. Where only Spark can open the file system, its listing is used, which leaves those out."""
    root = root.rstrip("/")
    try:
        tree.opened(root)
    except ValueError:
        folders, _, name = pattern.rpartition("/")
        reader = spark.read.option("pathGlobFilter", name).option("recursiveFileLookup", "**" in folders)
        below = "/".join(f for f in folders.split("/") if f and f != "**")
        df = reader.text(f"{root}/{below}".rstrip("/") + ("" if "**" in folders else f"/{name}"), wholetext=True)
        return df.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))
    spark.dataSource.register(tree.TreeSource)
    return spark.read.format("filetree").option("pattern", pattern).load(root)


def _local(path: Column) -> Column:
    """Path without the 'file:' scheme prefix."""
    return F.regexp_replace(path, r"^file:(//)?", "")


def contracts_frame(df: DataFrame, code: Column, path: Column, source: str, vulnerable: bool,
                    vulns: Column | None = None, category: Column | None = None) -> DataFrame:
    return df.select(
        code.alias("source_code"), path.alias("file_path"), F.lit(source).alias("source"),
        (category if category is not None else F.lit(None).cast("string")).alias("category"),
        F.lit(vulnerable).alias("is_vulnerable"),
        (vulns if vulns is not None else empty_vulns()).alias("vulnerabilities"),
    )


def with_key(contracts: DataFrame, root: str) -> DataFrame:
    """`contract_id`: the path below the data folder, a stable string key for ranks, shuffles and joins."""
    base = re.escape(re.sub(r"^file:(//)?", "", root).rstrip("/")) + "/"
    return contracts.withColumn("contract_id", F.regexp_replace(_local(F.col("file_path")), "^" + base, ""))


def load_curated(spark: SparkSession, root: str) -> DataFrame:
    """<root>/dataset/<type>/*.sol, one level; type from the directory; one vulnerability
    with the exact-key class (F01)."""
    f = whole_files(spark, f"{root.rstrip('/')}/dataset", "*/*.sol")
    vtype = F.regexp_extract("path", r"/dataset/([^/]+)/[^/]+$", 1)
    vulns = F.array(_vuln_struct(vtype, tx.swc_from_type_exact(vtype)))
    return contracts_frame(f, F.col("text"), _local(F.col("path")), "smartbugs", True, vulns, vtype)


def _pick(df: DataFrame, *names: str) -> Column:
    """First present column among `names` (absent column -> ''), empty cell -> ''."""
    for n in names:
        if n in df.columns:
            return F.coalesce(F.col(f"`{n}`").cast("string"), F.lit(""))
    return F.lit("")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def load_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """Code from `source_code`, else `code`, else ''; path 'tranduongminhdai/<id or unknown>';
    vulnerable, with an empty vulnerability list."""
    df = read_csv(spark, path)
    ident = F.coalesce(F.col("id").cast("string"), F.lit("unknown")) if "id" in df.columns else F.lit("unknown")
    return contracts_frame(df, _pick(df, "source_code", "code"), F.concat(F.lit("tranduongminhdai/"), ident),
                           "kaggle_tdm", True)


def side_file_join(csv: DataFrame, side: DataFrame, key_col: str, code_col: str, side_dir: str) -> DataFrame:
    """CSV rows left-joined to side files on key = file stem; code file-first, then the CSV
    column, then ''."""
    files = side.select(tx.file_stem("path").alias("_stem"), F.col("text").alias("_file_code"))
    j = csv.join(files, csv[f"`{key_col}`"].cast("string") == files["_stem"], "left")
    code = F.coalesce(tx.nullif_empty(F.col("_file_code")), F.col(f"`{code_col}`").cast("string"), F.lit(""))
    path = F.concat(F.lit(side_dir.rstrip("/") + "/"), F.col(f"`{key_col}`").cast("string"), F.lit(".sol"))
    return j.select("*", code.alias("_code"), path.alias("_path"))


def load_address_csv(spark: SparkSession, csv_path: str, side_dir: str) -> DataFrame:
    """Key `Contract Address` else `Address`; code from <side_dir>/<key>.sol when present
    and non-empty, else the `Source Code` column."""
    df = read_csv(spark, csv_path)
    key = "Contract Address" if "Contract Address" in df.columns else "Address"
    if "Source Code" not in df.columns:
        df = df.withColumn("Source Code", F.lit(None).cast("string"))
    side = whole_files(spark, side_dir, "*.sol") if exists(spark, side_dir) else \
        spark.createDataFrame([], "path string, text string")
    j = side_file_join(df, side, key, "Source Code", side_dir)
    return contracts_frame(j, F.col("_code"), F.col("_path"), "kaggle_bccc_vuln", True)


def load_unlabelled(spark: SparkSession, root: str) -> DataFrame:
    """Top-level *.parquet (code from `source_code` else `content`, path default
    'unknown'); when no parquet file exists, a recursive scan of contracts/**/*.sol."""
    root = root.rstrip("/")
    try:
        df = spark.read.option("pathGlobFilter", "*.parquet").parquet(root)
        path = F.coalesce(F.col("file_path"), F.lit("unknown")) if "file_path" in df.columns else F.lit("unknown")
        return contracts_frame(df, _pick(df, "source_code", "content"), path, "zellic", False)
    except AnalysisException as e:
        if e.getCondition() not in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND"):
            raise
        f = whole_files(spark, f"{root}/contracts", "**/*.sol")
        return contracts_frame(f, F.col("text"), _local(F.col("path")), "zellic", False)


def exploits_root(spark: SparkSession, data_dir: str) -> str:
    """exploits/defihacklabs below the data folder, or defihacklabs if that is not there."""
    first, second = (f"{data_dir.rstrip('/')}/{d}" for d in ("exploits/defihacklabs", "defihacklabs"))
    return first if exists(spark, first) else second


def load_exploits(spark: SparkSession, root: str) -> DataFrame:
    """Recursive *.sol under src/test (else the root); year = first 4-digit path part,
    name = file stem."""
    root = root.rstrip("/")
    base = f"{root}/src/test" if exists(spark, f"{root}/src/test") else root
    f = whole_files(spark, base, "**/*.sol")
    p = _local(F.col("path"))
    return f.select(F.col("text").alias("source_code"), p.alias("file_path"),
                    tx.file_stem(p).alias("exploit_name"), tx.first_year_part(p).alias("year"),
                    F.lit("defihacklabs").alias("source"))


def load_reports(spark: SparkSession, root: str) -> DataFrame:
    """S07 + S08: recursive *.md and *.json under each first-level directory; source = that
    directory; JSON documents are kept as their JSON text (objects and lists alike) and, parsed, as a VARIANT
    (null for Markdown and for text that is not JSON)."""
    root = root.rstrip("/")
    below = "^" + re.escape(re.sub(r"^file:(//)?", "", root)) + r"/([^/]+)/"
    out = None
    for kind in ("md", "json"):
        f, p = whole_files(spark, root, f"*/**/*.{kind}"), _local(F.col("path"))
        parsed = F.try_parse_json("text") if kind == "json" else F.lit(None).cast("variant")
        part = f.select(F.col("text").alias("content"), p.alias("file_path"), F.regexp_extract(p, below, 1).alias("source"),
                        F.lit("audit_report").alias("type"), F.lit(kind).alias("format"), parsed.alias("content_json"))
        out = part if out is None else out.unionByName(part)
    return out


def load_contracts(spark: SparkSession, data_dir: str, sources: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """The named sources in the given order (default: all three), those without a loader silently skipped; one global limit
    (0 or None: none)."""
    from vulnsift.sources.catalog import union_sources

    base = data_dir.rstrip("/")
    kaggle = f"{base}/datasets/kaggle"

    def present(path: str, load, *more: str) -> list[DataFrame]:
        return [load(spark, path, *more)] if exists(spark, path) else []

    bccc = f"{kaggle}/bcccdatasets_bccc-vulscs-2023"
    loaders = {
        "smartbugs": lambda: present(f"{base}/repos/vulnerability_datasets/smartbugs-curated", load_curated),
        "kaggle": lambda: present(f"{kaggle}/tranduongminhdai_smart-contract-vulnerability-datset/SC_Vuln_8label.csv", load_labelled_csv)
        + present(f"{bccc}/BCCC-VolSCs-2023_Vulnerable.csv", load_address_csv, f"{bccc}/Vulnerable_SourceCodes"),
        "zellic": lambda: present(f"{base}/datasets/huggingface/Zellic_smart-contract-fiesta", load_unlabelled),
    }
    frames = [f for name in (sources if sources is not None else list(loaders)) if name in loaders for f in loaders[name]()]
    if not frames:
        return contracts_frame(spark.createDataFrame([], "c string, p string"), F.col("c"), F.col("p"), "", False).withColumn("source_rank", F.lit(0))
    return union_sources(frames, limit)
