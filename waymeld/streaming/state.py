"""Runs the ordered state machines over a stream, one state value per key."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def run_machine(stream: DataFrame, keys: list[str], order: list[str], columns: list[str], machine: Callable,
                schema: str, idle_ms: int | None = None) -> DataFrame:
    """Live form of scans.scan_sorted: the same machine, its fields kept as state.

    A micro-batch is ordered within its key; rows older than what the machine has
    seen are its own decision to drop. With `idle_ms` the stream needs a watermark
    and a key's state ends, with its last rows, once event time passes it by.
    """
    names = [part.strip().split()[0] for part in schema.split(",")]

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            live = pickle.loads(state.get[0])
            state.remove()
            yield pd.DataFrame(list(live.end()), columns=names)
            return
        live = pickle.loads(state.get[0]) if state.exists else machine(key)
        out = []
        # All frames of one key in one batch; batches are bounded by the source's rate limit.
        rows = pd.concat(list(frames)).sort_values(order)
        for values in zip(*(rows[c].tolist() for c in columns)):
            out.extend(live.row(*values))
        state.update((pickle.dumps(live),))
        if idle_ms is not None:
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + idle_ms)
        yield pd.DataFrame(out, columns=names)

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.EventTimeTimeout
    return stream.groupBy(*keys).applyInPandasWithState(step, schema, "machine binary", "append", timeout)
