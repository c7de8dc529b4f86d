"""Sustained crossing over a stream: an extension; the batch operator is ``operators.series.sustained_crossing``.

Rows (key, idx, value, ts) arrive as they are observed; the state of a key is the length of its current run and where
that began, so it stays small however long the series gets.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "key string, crossing long"
STATE = "run long, start long, found boolean"


def crossings(rows: DataFrame, threshold: float, sustain: int = 5, delay: str = "30 days") -> DataFrame:
    """key and crossing, once a key has stayed at or above the threshold for ``sustain`` rows. A null ends a run. Rows
    of a micro-batch are taken in order of idx; rows later than the watermark are dropped."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, start, found = state.get if state.exists else (0, -1, False)
        batch = pd.concat(list(parts)).sort_values("idx")
        out = []
        for idx, value in zip(batch["idx"], batch["value"], strict=True):
            if pd.notna(value) and value >= threshold:
                start = int(idx) if run == 0 else start
                run += 1
                if run >= sustain and not found:
                    found = True
                    out.append((key[0], start))
            else:
                run = 0
        state.update((run, start, found))
        yield pd.DataFrame(out, columns=["key", "crossing"])

    return rows.withWatermark("ts", delay).groupBy("key").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
