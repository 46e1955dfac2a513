"""User functions over row batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def map_batches(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema,
    batch_size: int = 10_000,
) -> DataFrame:
    """Apply ``fn`` to batches of at most ``batch_size`` rows.

    Batches never span Spark partitions, so the last batch of each partition
    may be short. The first error ends the job.
    """
    if batch_size < 1:
        raise ValueError("batch size must be positive")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        count = 0
        for part in parts:
            begin = 0
            while begin < len(part):
                piece = part.iloc[begin : begin + batch_size - count]
                held.append(piece)
                count += len(piece)
                begin += len(piece)
                if count == batch_size:
                    yield fn(pd.concat(held, ignore_index=True))
                    held, count = [], 0
        if held:
            yield fn(pd.concat(held, ignore_index=True))

    return df.mapInPandas(run, schema)
