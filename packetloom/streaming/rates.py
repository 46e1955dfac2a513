"""Anchored request-rate windows on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from packetloom.streaming.statistics import with_event_time


def _openings(follows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which rows open a window: ``starts`` and what follows from them, a row at or
    behind the end being none. Jumps double, so long chains take few steps."""
    n = len(follows)
    opens, jump = np.zeros(n + 1, bool), np.append(follows, n)
    reached = starts[starts < n]
    while len(reached):
        opens[reached] = True
        further = jump[np.flatnonzero(opens[:n])]
        reached = further[~opens[further] & (further < n)]
        jump = jump[jump]
    return opens[:n]


def _number(client, us, opened, count, width):
    """Window and number in it of requests sorted by client (0, 1, ...) and time;
    ``opened`` and ``count``: of each client's window so far, no requests if none."""
    place, clients = np.arange(len(us)), len(opened)
    begin = np.searchsorted(client, np.arange(clients))
    end = np.append(begin[1:], len(us))
    follows, fresh = np.empty(len(us), np.int64), begin.copy()
    low = us.min()
    span = int(us.max()) - int(low) + width + 1
    some = max(1, 2**62 // span)  # clients whose times fit beside each other
    for first in range(0, clients, some):
        own = slice(first, min(first + some, clients))
        rows = slice(begin[first], end[own.stop - 1])
        line = (client[rows] - first) * span + (us[rows] - low)
        follows[rows] = np.searchsorted(line, line + width) + rows.start
        due = np.maximum(opened[own] + width - low, 0) + np.arange(own.stop - first) * span
        later = np.searchsorted(line, due) + rows.start
        fresh[own] = np.where(count[own] > 0, np.clip(later, begin[own], end[own]), begin[own])
    # the last window of a client leads to no other client
    follows = np.where(follows < end[client], follows, len(us))
    opens = _openings(follows, np.where(fresh < end, fresh, len(us)))
    which = np.maximum.accumulate(np.where(opens, place, 0))
    goes_on = place < fresh[client]
    window = np.where(goes_on, opened[client], us[which])
    number = np.where(goes_on, count[client] + place - begin[client], place - which) + 1
    return window, number


def _packed(**columns) -> bytes:
    batch = pa.RecordBatch.from_pydict({n: pa.array(v, from_pandas=True) for n, v in columns.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas(date_as_object=True)


def _sortable(values: pd.Series) -> np.ndarray:
    """Numbers in the order of the values."""
    if pd.api.types.is_numeric_dtype(values):
        return values.to_numpy()
    return pd.factorize(values, sort=True)[0]


def rate_limit_stream(
    requests: DataFrame,
    key: str,
    request_id: str,
    ts: str = "ts",
    limit: int = 1000,
    seconds: int = 60,
    delay: str = "1 minute",
    buckets: int = 256,
) -> DataFrame:
    """Every request with its window, number, flag and retry time.

    Requests are numbered in event-time order, whatever order they arrive in: a
    client's requests wait in its state until the watermark has passed them, so
    the result is that of the batch form. Requests that arrive behind the
    watermark are dropped, and those of the last ``delay`` stay open until
    later ones arrive. State per client: when its window opened, how many
    requests it has had, and the waiting requests (at most those of ``delay``).

    Clients are hashed into ``buckets``, each one state and one call of Python a
    micro-batch, whose clients are numbered together. A stream that is started again
    from its checkpoint needs the same number of buckets.
    """
    width = seconds * 1_000_000
    # clients without a name have a bucket of their own: NULL among numbers makes doubles
    bucket = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).cast("int")
    timed = with_event_time(requests, ts, delay).filter(F.col(ts).isNotNull()).select(
        F.col(key), F.col(request_id), F.col(ts), F.unix_micros(ts).alias("us"), bucket.alias("_bucket")
    )
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema.fields}
    output = (
        f"`{request_id}` {kinds[request_id]}, `{key}` {kinds[key]}, window_us long, "
        "requests long, flagged boolean, retry_after int"
    )

    def step(
        group: tuple, parts: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs() * 1000
        known, waiting = pd.DataFrame({"client": [], "opened": [], "count": []}), []
        if state.exists:
            known, held = (_unpacked(data) for data in state.get)
            waiting.append(held)
        if not state.hasTimedOut:
            for part in parts:
                fresh = part[part["us"] >= mark]  # the others come too late
                waiting.append(pd.DataFrame({"client": fresh[key], "us": fresh["us"], "id": fresh[request_id]}))
        rows = pd.concat([w for w in waiting if len(w)] or waiting[:1], ignore_index=True)
        final = rows["us"].to_numpy() < mark
        done, rest = rows[final], rows[~final]
        if len(done):
            names = pd.concat([x for x in (known["client"], done["client"]) if len(x)], ignore_index=True)
            code, names = pd.factorize(names, use_na_sentinel=False)
            opened, count = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
            opened[code[: len(known)]] = known["opened"]
            count[code[: len(known)]] = known["count"]
            code, at = code[len(known) :], done["us"].to_numpy().astype(np.int64)
            order = np.lexsort((_sortable(done["id"]), at, code))
            code, at, done = code[order], at[order], done.iloc[order]
            window, number = _number(code, at, opened, count, width)
            over = number > limit
            wait = seconds - (at - window) // 1_000_000
            yield pd.DataFrame(
                {
                    request_id: done["id"].to_numpy(),
                    key: done["client"].to_numpy(),
                    "window_us": window,
                    "requests": number,
                    "flagged": over,
                    "retry_after": pd.array(np.where(over, wait, 0), dtype="Int32"),
                }
            )
            last = np.append(code[1:] != code[:-1], True)
            opened[code[last]], count[code[last]] = window[last], number[last]
            known = pd.DataFrame({"client": names, "opened": opened, "count": count})
        # what comes later than the end of a window opens another
        known = known[(known["count"] > 0) & (known["opened"] + width > mark)]
        if not len(rest) and not len(known):
            if state.exists:
                state.remove()
            return
        state.update((_packed(**known), _packed(**rest)))
        due = int(rest["us"].min()) if len(rest) else int(known["opened"].min()) + width
        state.setTimeoutTimestamp(max(due // 1000 + 1, state.getCurrentWatermarkMs() + 1))

    flags = timed.groupBy("_bucket").applyInPandasWithState(
        step, output, "known binary, waiting binary", "append", GroupStateTimeout.EventTimeTimeout
    )
    return flags.withColumn("retry_after", F.when(F.col("flagged"), F.col("retry_after")))
