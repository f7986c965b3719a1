"""Time series as streams: changes of a level, and windowed profiles with late rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def changes(stream: DataFrame) -> DataFrame:
    """Of a stream (series string, t double, value double): series, t, value of the rows whose value differs from the row before.

    The state of a series is its last value. Within a micro-batch rows are put in the order of t; across batches they count
    in the order in which they come.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("t", kind="stable")
        out = []
        for t, value in zip(rows["t"], rows["value"], strict=True):
            if last is not None and value != last:
                out.append((key[0], t, value))
            last = value
        state.update((float(last),))
        yield pd.DataFrame(out, columns=["series", "t", "value"])

    return stream.groupBy("series").applyInPandasWithState(step, "series string, t double, value double", "last double", "append", GroupStateTimeout.NoTimeout)


def profile(stream: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Of a stream (series, ts, value): rows, least, greatest by series and window; rows later than the watermark are left out."""
    return stream.withWatermark("ts", late).groupBy("series", F.window("ts", width)).agg(F.count("*").alias("rows"), F.min("value").alias("least"), F.max("value").alias("greatest"))
