"""Rules that need the rows of a key in order: one sorted shuffle, then a stream through each task with a small state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def in_order(
    df: DataFrame, keys: list[str], order: list[str], schema: str, state: Callable[[], Any], step: Callable[[Any, pd.DataFrame], pd.DataFrame], end: Callable[[Any, tuple], pd.DataFrame] | None = None
) -> DataFrame:
    """step on the rows of each key in order, batch by batch with the key's state, then end on the state and the key. A task
    holds one batch and one state, however many rows a key has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, None
        for batch in batches:
            if batch.empty:
                continue
            k = batch[keys]
            cuts = [0, *(np.flatnonzero((k.ne(k.shift()) & ~(k.isna() & k.shift().isna())).any(axis=1).to_numpy()[1:]) + 1), len(batch)]
            out = []
            for lo, hi in zip(cuts, cuts[1:]):
                key = tuple(None if pd.isna(x) else x for x in k.iloc[lo])
                if key != last or held is None:
                    if held is not None and end:
                        out.append(end(held, last))
                    last, held = key, state()
                out.append(step(held, batch.iloc[lo:hi]))
            yield pd.concat(out, ignore_index=True)
        if held is not None and end:
            yield end(held, last)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
