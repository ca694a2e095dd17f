"""A subset of the registered queries against their DuckDB oracle on the smallest tables
(the full set runs with tools/check_oracle.py)."""

import math

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import oracle_sql, queries
from vulnsift.queries import QUERIES
from vulnsift.session import TABLES

from conftest import SF_SMALL

SUBSET = ["eval_metrics", "file_sources", "files_sft", "files_dpo", "latency", "multi_turn_pref", "outcome_pairs", "findings_parse", "match_exact", "reward_components", "line_iou", "pass_at_k",
          "sft_build", "dpo_build", "cpt_budget", "split_shuffle", "decontaminate", "chat_render",
          "early_stop", "length_buckets", "stream_monitor"]


def norm(v):
    if v is None:
        return None
    try:
        if pd.isna(v):
            return None
    except (TypeError, ValueError):
        pass
    if isinstance(v, float):
        return round(v, 6)
    return v.item() if hasattr(v, "item") else v


def canon(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(norm(x) for x in r) for r in df[cols].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SUBSET)
def test_query_matches_oracle(spark, con, name):
    sp = queries()[name](spark, SF_SMALL).toPandas()
    dd = con.execute(oracle_sql()[name]).df()
    assert canon(sp) == canon(dd)


def test_every_query_has_oracle_or_is_listed():
    assert set(QUERIES) <= set(queries())
    no_oracle = set(QUERIES) - set(oracle_sql())
    assert not no_oracle, no_oracle
