"""Keyed state over sorted partitions: rows of a key arrive one after another, only the key's state is in memory.

Unlike ``applyInPandas``, no group is ever materialised and small groups cost no call each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

OUT_ROWS = 20_000


def keyed_scan(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, tuple], None], finish: Callable[[tuple, Any], list[tuple]], schema: str) -> DataFrame:
    """Shuffles ``rows`` by ``keys``, sorts by keys and ``order``, and folds each key's rows: ``start()`` makes a state,
    ``step(state, row)`` takes the next row (all columns, in their order), ``finish(key, state)`` gives the key's result rows.
    Result rows hold the columns of ``schema``."""
    at = [rows.columns.index(k) for k in keys]

    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(names, (pd.Series(c, dtype=object) for c in zip(*out)))))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, out = None, None, []
        for batch in batches:
            for row in zip(*(batch[c].astype(object).where(batch[c].notna(), None).tolist() for c in batch.columns)):
                own = tuple(row[i] for i in at)
                if own != key:
                    if key is not None:
                        out += finish(key, state)
                        if len(out) > OUT_ROWS:
                            yield frame(out)
                            out = []
                    key, state = own, start()
                step(state, row)
        if key is not None:
            out += finish(key, state)
        if out:
            yield frame(out)

    names = [part.strip().split(" ")[0].strip("`") for part in schema.split(",")]
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(scan, schema)
