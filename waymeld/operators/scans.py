"""Sequential scans whose state depends on every earlier kept row.

Rows are shuffled by key, sorted by Spark (spilling to disk) and streamed through
a small state machine in Arrow batches: no group is ever held in memory. Pass the
narrowest key there is - a section of a journey between two natural breaks - so
that one long journey spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def scan_sorted(df: DataFrame, keys: list[str], order: list[str], columns: list[str],
                machine: Callable, schema: str) -> DataFrame:
    """`machine(key)` returns an object with `row(*values) -> iterable of tuples`
    and `end() -> iterable of tuples`; the tuples follow `schema`."""
    names = [part.strip().split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, live = None, None
        for frame in batches:
            out = []
            heads = list(zip(*(frame[k].tolist() for k in keys)))
            values = list(zip(*(frame[c].tolist() for c in columns)))
            for head, row in zip(heads, values):
                if head != current:
                    if live is not None:
                        out.extend(live.end())
                    current, live = head, machine(head)
                out.extend(live.row(*row))
            yield pd.DataFrame(out, columns=names)
        if live is not None:
            yield pd.DataFrame(list(live.end()), columns=names)

    narrow = df.select(*keys, *[c for c in dict.fromkeys([*order, *columns]) if c not in keys])
    return (narrow.repartition(*keys).sortWithinPartitions(*keys, *order)
            .mapInPandas(run, schema))


def missing(value) -> bool:
    return value is None or (isinstance(value, float) and np.isnan(value))
