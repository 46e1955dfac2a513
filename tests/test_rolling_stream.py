import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.streaming.rolling import rolling_stream
from packetloom.streaming.sinks import drain

KIND = "id long, k string, ts timestamp, v double"


@pytest.mark.parametrize("size", [1, 7])
def test_late_files_give_the_batch_figures(spark, tmp_path, size):
    rnd = random.Random(size)
    start = datetime(2024, 5, 1)
    # half of the rows have one key, several share a moment, some values are missing
    rows = [
        (i, rnd.choice(["a", "a", "b", None]), start + timedelta(seconds=rnd.randrange(200)),
         rnd.choice([None, float("nan"), 1.0, *[rnd.uniform(0, 50) for _ in range(9)]]))
        for i in range(400)
    ]
    path = str(tmp_path / "in")
    rnd.shuffle(rows)
    for part in range(4):
        spark.createDataFrame(rows[part::4], KIND).coalesce(1).write.mode("append").parquet(path)
    closing = [(None, "z", start + timedelta(hours=1), None), (None, "z", None, 1.0)]
    spark.createDataFrame(closing, KIND).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(path)
    out = drain(rolling_stream(stream, "k", "id", "v", size=size, delay="10 minutes"), spark, "rolling")
    got = {r.id: r for r in out.collect()}
    assert len(got) == out.count() == len(rows)
    for k in ("a", "b", None):
        own = sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0]))
        values = [r[3] if r[3] is not None and r[3] == r[3] else 0.0 for r in own]
        for i, r in enumerate(own):
            last = values[max(0, i - size + 1) : i + 1]
            g = got[r[0]]
            assert g.k == k
            assert (g.rolling_min, g.rolling_max) == (min(last), max(last))
            assert g.rolling_avg == pytest.approx(np.mean(last))
            assert g.rolling_p == pytest.approx(np.percentile(last, 95))
    with pytest.raises(ValueError):
        rolling_stream(stream, "k", "id", "v", size=0)


def test_state_of_a_key_is_bounded(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = spark.range(5000).select(
        "id", F.lit("a").alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.col("id").cast("double").alias("v")
    )
    for part in range(2):
        rows.filter(F.floor(F.col("id") / 2500) == part).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = rolling_stream(stream, "k", "id", "v", size=50, delay="10 minutes")
    query = (
        out.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    state = spark.read.format("statestore").load(str(tmp_path / "c"))
    held = state.select("value.*").select(F.col(state.select("value.*").columns[0]).alias("g")).collect()
    sizes = [len(x) for r in held for x in (r.g if hasattr(r.g, "__fields__") else [r.g]) if isinstance(x, list)]
    assert sizes and max(sizes) <= 49
