"""User extension points.

E01 reward: any ``Column -> Column`` (or a user pandas UDF) combined with the built-in
rewards. E02 generator: a user function over pandas batches of prompts, run with
``mapInPandas`` (Arrow batches, one call per batch). E03 tokenizer: an optional user
pandas UDF for token counts; the default is the 4-characters estimate. E04: one text ->
many findings is the native generator in ``evaluate.parse_findings``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnsift.functions import text as tx


def generate(prompts: DataFrame, user_fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a user generator to Arrow batches of prompts (distributed with the prompts)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield user_fn(b)
    return prompts.mapInPandas(run, schema)


def token_count(text, tokenizer: Callable[[pd.Series], pd.Series] | None = None) -> Column:
    """User tokenizer as a pandas UDF when given, else the built-in estimate."""
    if tokenizer is None:
        return tx.token_estimate(text)
    udf = F.pandas_udf(tokenizer, "long")
    return udf(tx.col_(text))


def custom_reward(base: Column, user: Callable[[Column], Column] | None, weight: float = 0.0) -> Column:
    """Blend a user reward expression into a built-in reward."""
    if user is None or weight == 0.0:
        return base
    return (1 - weight) * base + weight * user(base)
