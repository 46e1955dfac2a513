"""Request rates per client and metrics per time window (batch forms)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions.values import ratio
from packetloom.operators.ordering import with_rank
from packetloom.operators.percentiles import RANK, grouped_percentiles
from packetloom.session import written


def windowed_metrics(
    df: DataFrame,
    width: str = "10 seconds",
    ts: str = "ts",
    duration: str = "duration_ms",
    success: str = "success",
) -> DataFrame:
    """Requests, success rate, mean and exact p95 latency of every window."""
    start = F.window(ts, width)["start"].alias("window_start")
    rows = df.select(start, F.col(duration).alias("duration"), F.col(success).alias("success"))
    total, good = F.count(F.lit(1)), F.count_if("success")
    counts = rows.groupBy("window_start").agg(
        total.alias("requests"),
        ratio(good, total).alias("success_rate"),
        F.avg("duration").alias("avg_ms"),
    )
    p95 = grouped_percentiles(rows, ["window_start"], "duration", (0.95,), RANK)
    return counts.join(p95.withColumnRenamed("p95", "p95_ms"), "window_start")


def tumbling_rate_flags(
    df: DataFrame, key: str, ts: str = "ts", limit: int = 1000, seconds: int = 60
) -> DataFrame:
    """Requests per client and fixed window, flagged above the limit."""
    return (
        df.groupBy(key, F.window(ts, f"{seconds} seconds")["start"].alias("window_start"))
        .agg(F.count(F.lit(1)).alias("requests"))
        .withColumn("flagged", F.col("requests") > limit)
    )


# --- windows anchored at a client's first request ---------------------------
#
# A window opens with the first request that arrives at least ``seconds`` after
# the last window opened, so every window depends on the one before. To keep a
# busy client out of a single task, its timeline is cut into chunks of rows:
#   1. each chunk is reduced to a table "a window due from here opens there,
#      and the chunk ends inside the window opened at ...";
#   2. the tables of a client are chained, which gives each chunk the window
#      that is open when it starts;
#   3. each chunk is then labelled on its own.
# Along with its time, a window carries the rank of its first request; a
# request's number in the window is then the difference of two ranks.


Group = dict[str, np.ndarray]
_CHUNK_ROWS = 50_000


def _joined(parts: list[Group]) -> Group:
    if len(parts) == 1:
        return parts[0]
    return {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}


def _runs(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[Group]:
    """Groups of a sorted stream of batches, one at a time."""
    held: list[Group] = []
    for batch in batches:
        if batch.empty:
            continue
        columns = {name: batch[name].to_numpy() for name in batch.columns}
        if held and any(columns[k][0] != held[-1][k][-1] for k in keys):
            yield _joined(held)
            held = []
        change = np.any([columns[k][1:] != columns[k][:-1] for k in keys], axis=0)
        edges = [0, *(np.flatnonzero(change) + 1), len(batch)]
        for begin, end in zip(edges, edges[1:]):
            if begin:
                yield _joined(held)
                held = []
            held.append({name: values[begin:end] for name, values in columns.items()})
    if held:
        yield _joined(held)


def _batches(groups: Iterator[Group], rows: int = 10_000) -> Iterator[pd.DataFrame]:
    """Small results joined into frames of a useful size."""
    held, count = [], 0
    for group in groups:
        held.append(group)
        count += len(next(iter(group.values())))
        if count >= rows:
            yield pd.DataFrame(_joined(held))
            held, count = [], 0
    if held:
        yield pd.DataFrame(_joined(held))


def _objects(*values) -> np.ndarray:
    out = np.empty(len(values), dtype=object)
    for i, value in enumerate(values):
        out[i] = value
    return out


def _chunk_table(at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(due, last): a window due by ``at[due[i]]`` makes ``at[last[i]]`` the
    last opening of the chunk. Entries with equal outcome are merged."""
    n = len(at)
    step = np.searchsorted(at, at + width)
    step = np.where(step < n, step, np.arange(n))  # no later opening in this chunk
    while True:
        further = step[step]
        if np.array_equal(further, step):
            break
        step = further
    entries = min(int(np.searchsorted(at, at[0] + width)) + 1, n)
    last = step[:entries]
    return np.flatnonzero(np.append(last[1:] != last[:-1], True)), last


def _openings(at: np.ndarray, width: int, first: int) -> np.ndarray:
    """Position of the opening request for every request from ``first`` on."""
    starts, i = [], first
    while i < len(at):
        starts.append(i)
        i = int(np.searchsorted(at, at[i] + width))
    begin = np.asarray(starts, dtype=np.int64)
    which = np.searchsorted(begin, np.arange(first, len(at)), side="right") - 1
    return begin[which]


def _reduce_chunks(rows: Group, key: str, width: int) -> Group:
    at, rank = rows["us"], rows["first"]
    due, last = _chunk_table(at, width)
    return {
        key: rows[key][:1],
        "_chunk": rows["_chunk"][:1],
        "due": _objects(at[due]),
        "end": at[-1:],
        "us": _objects(at[last[due]]),
        "first": _objects(rank[last[due]]),
    }


def _chain_chunks(batches: Iterator[pd.DataFrame], key: str, width: int) -> Iterator[pd.DataFrame]:
    """The window open at the start of every chunk; tables pass one at a time."""
    client, at, rank = None, None, None
    for batch in batches:
        open_us, open_first = [], []
        for name, due, end, us, first in zip(
            batch[key], batch["due"], batch["end"], batch["us"], batch["first"]
        ):
            if name != client:
                client, at, rank = name, None, None
            open_us.append(at)
            open_first.append(rank)
            if at is None:
                at, rank = int(us[0]), int(first[0])
            elif at + width <= end:
                i = int(np.searchsorted(due, at + width))
                at, rank = int(us[i]), int(first[i])
        yield pd.DataFrame(
            {
                key: batch[key],
                "_chunk": batch["_chunk"],
                "open_us": _objects(*open_us),
                "open_first": _objects(*open_first),
            }
        )


def _label_chunks(rows: Group, key: str, width: int) -> Group:
    at, rank = rows["us"], rows["first"]
    opened = rows["open_us"][0]
    begin = 0 if pd.isna(opened) else int(np.searchsorted(at, int(opened) + width))
    window, first = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    if begin:
        window[:begin], first[:begin] = int(opened), int(rows["open_first"][0])
    where = _openings(at, width, begin)
    window[begin:], first[begin:] = at[where], rank[where]
    return {
        key: rows[key],
        "_chunk": rows["_chunk"],
        "us": at,
        "window_us": window,
        "window_first": first,
    }


def _map_runs(df: DataFrame, keys: Sequence[str], step, schema: str, *args) -> DataFrame:
    """Apply ``step`` to every group of a frame that is partitioned and sorted
    by ``keys``; unlike a grouped map this costs no Arrow batch per group."""

    def run(batches):
        yield from _batches(step(group, *args) for group in _runs(batches, keys))

    return df.mapInPandas(run, schema)


def anchored_rate_flags(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    limit: int = 1000,
    seconds: int = 60,
    buckets: int | None = None,
    chunk_rows: int = _CHUNK_ROWS,
) -> DataFrame:
    """Every request with its window, its number in the window, whether it is
    above the limit, and after how many seconds a flagged client may retry.

    ``order`` is (time column, unique tie-break). NULL clients are left out. No
    task holds more than ``chunk_rows`` rows of a client at once.
    """
    width = seconds * 1_000_000
    ts = order[0]
    timed = df.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn(
        "us", F.unix_micros(F.col(ts).cast("timestamp"))
    )
    # one cut of the order gives the ranks, and the chunks with them
    ranked = written(
        with_rank(timed, order, [key], name="_rank", buckets=buckets).withColumn(
            "_chunk", F.floor((F.col("_rank") - 1) / chunk_rows)
        ),
        "ranked",
    )
    instants = ranked.groupBy(key, "_chunk", "us").agg(F.min("_rank").alias("first"))

    field = f"`{key}` {df.schema[key].dataType.simpleString()}"
    tables = _map_runs(
        instants.repartition(key, "_chunk").sortWithinPartitions(key, "_chunk", "us"),
        [key, "_chunk"],
        _reduce_chunks,
        f"{field}, _chunk long, due array<long>, `end` long, us array<long>, first array<long>",
        key,
        width,
    )
    entries = tables.repartition(key).sortWithinPartitions(key, "_chunk").mapInPandas(
        lambda batches: _chain_chunks(batches, key, width),
        f"{field}, _chunk long, open_us long, open_first long",
    )
    windows = _map_runs(
        instants.join(entries, [key, "_chunk"])
        .select(key, "_chunk", "us", "first", "open_us", "open_first")
        .repartition(key, "_chunk")
        .sortWithinPartitions(key, "_chunk", "us"),
        [key, "_chunk"],
        _label_chunks,
        f"{field}, _chunk long, us long, window_us long, window_first long",
        key,
        width,
    )
    counted = ranked.join(windows, [key, "_chunk", "us"]).withColumn(
        "requests", F.col("_rank") - F.col("window_first") + 1
    )
    over = F.col("requests") > limit
    waited = F.floor((F.col("us") - F.col("window_us")) / 1_000_000)
    return counted.select(
        *df.columns,
        F.timestamp_micros("window_us").cast(df.schema[ts].dataType).alias("window_start"),
        "requests",
        over.alias("flagged"),
        F.when(over, (F.lit(seconds) - waited).cast("int")).alias("retry_after"),
    )
