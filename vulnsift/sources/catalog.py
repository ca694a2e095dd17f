"""Source catalogue and per-source counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnsift.sources.files import exists

# Source names and where each lives under a data folder.
SOURCE_PATHS = [
    ("smartbugs", "repos/vulnerability_datasets/smartbugs-curated"),
    ("kaggle", "datasets/kaggle"),
    ("zellic", "datasets/huggingface/Zellic_smart-contract-fiesta"),
    ("audit_reports", "repos/audit_repos"),
]


def source_catalogue(spark: SparkSession, data_dir: str, paths=None) -> DataFrame:
    """One row per known source with its path and whether it is present (the checks are
    file listings, one per source; the catalogue itself is a handful of rows)."""
    rows = [(name, f"{data_dir.rstrip('/')}/{rel}", exists(spark, f"{data_dir.rstrip('/')}/{rel}"))
            for name, rel in (paths or SOURCE_PATHS)]
    return spark.createDataFrame(rows, "source string, path string, present boolean")


def source_counts(rows: DataFrame, catalogue: DataFrame, source_col: str = "source") -> DataFrame:
    """Rows per source, 0 for catalogued sources without rows (right join to the catalogue)."""
    counts = rows.groupBy(source_col).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.join(catalogue.select(source_col), source_col, "right") \
        .select(source_col, F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def union_sources(frames: list[DataFrame], limit: int | None = None) -> DataFrame:
    """S09 + O01: sources in the given order; one global limit (0 or None: no limit)."""
    ranked = [f.withColumn("source_rank", F.lit(i)) for i, f in enumerate(frames)]
    u = ranked[0]
    for f in ranked[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    if limit:
        u = u.orderBy("source_rank", "file_path").limit(limit)
    return u
