"""Connected components of a link table, by joins alone.

Every round points each node's neighbours to the smallest of them ("large star",
then "small star"), which about halves the depth of the graph. Each round's links
are written to the shared folder, so lineage stays short and a lost executor
costs a re-read. Nothing is collected but a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.session import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Rows (u, v) with v < u, each u pointing to a smaller node of its own
    neighbourhood. ``large`` moves the greater neighbours, else the smaller."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    around = both if large else links
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = around.join(least, "u")
    if large:
        return moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    rows = moved.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rows.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) of every linked node.

    ``links`` has two columns of one ordered type; a link of a node with itself
    or with NULL is ignored, as are repeats. A node without links is absent.
    """
    a, b = links.columns
    pair = links.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    )
    now = written(pair.distinct(), "links")
    before = None
    while True:
        now = written(_star(now, large=True), "links")
        now = written(_star(now, large=False), "links")
        # bit_xor: an order-free checksum that cannot overflow
        row = now.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))
        ).first()
        if tuple(row) == before:
            break
        before = tuple(row)
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
