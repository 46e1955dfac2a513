"""Rolling figures on a stream: the last rows of a key at each of its rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from packetloom.functions.values import clean_number
from packetloom.streaming.statistics import with_event_time


def rolling_stream(
    rows: DataFrame,
    key: str,
    row_id: str,
    value: str,
    ts: str = "ts",
    size: int = 10_000,
    delay: str = "1 minute",
    p: float = 0.95,
) -> DataFrame:
    """Every row with avg, min, max and percentile ``p`` (linear) of the last ``size``
    rows of its key, in the order of ``ts`` and ``row_id``, whatever order they come in.

    Rows wait until the watermark has passed them, so the figures are those of the
    batch form (``operators.ordering.rolling_stats``); rows behind the watermark are
    dropped, those of the last ``delay`` stay open. The state of a key is bounded: at
    most ``size - 1`` values, and the rows of ``delay``. A value that is NULL, NaN or
    infinite counts as 0, as in the batch form. NULL is a key like any other; rows
    without a time are dropped.
    """
    if size < 1:
        raise ValueError("size must be positive")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    timed = with_event_time(rows, ts, delay).filter(F.col(ts).isNotNull()).select(
        F.col(key),
        F.col(row_id),
        F.col(ts),
        F.unix_micros(ts).alias("us"),
        clean_number(F.col(value).cast("double")).alias("v"),
    )
    output = (
        f"`{row_id}` {kinds[row_id]}, `{key}` {kinds[key]}, rolling_avg double, rolling_min double, "
        "rolling_max double, rolling_p double"
    )

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, us, ids, values = state.get if state.exists else ([], [], [], [])
        mark = state.getCurrentWatermarkMs() * 1000
        waiting = [pd.DataFrame({"us": list(us), "id": list(ids), "v": list(values)})]
        if not state.hasTimedOut:
            for part in parts:
                fresh = part[part["us"] >= mark]  # the others come too late
                waiting.append(pd.DataFrame({"us": fresh["us"], "id": fresh[row_id], "v": fresh["v"]}))
        found = pd.concat([w for w in waiting if len(w)] or waiting[:1])
        found = found.sort_values(["us", "id"], kind="stable")
        final = found["us"].to_numpy() < mark
        done, rest = found[final], found[~final]
        kept = np.asarray(kept, dtype=float)
        if len(done):
            series = pd.Series(np.concatenate([kept, done["v"].to_numpy(dtype=float)]))
            window, new = series.rolling(size, min_periods=1), slice(len(kept), None)
            yield pd.DataFrame(
                {
                    row_id: done["id"].to_numpy(),
                    key: group[0],
                    "rolling_avg": window.mean().to_numpy()[new],
                    "rolling_min": window.min().to_numpy()[new],
                    "rolling_max": window.max().to_numpy()[new],
                    "rolling_p": window.quantile(p).to_numpy()[new],
                }
            )
            kept = series.to_numpy()[max(0, len(series) - size + 1) :]
        state.update(
            (kept.tolist(), rest["us"].astype("int64").tolist(), rest["id"].tolist(), rest["v"].astype(float).tolist())
        )
        if len(rest):
            due = int(rest["us"].iloc[0]) // 1000 + 1
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    return timed.groupBy(key).applyInPandasWithState(
        step,
        output,
        f"kept array<double>, us array<long>, ids array<{kinds[row_id]}>, vals array<double>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
