"""Connected components by joins and aggregates, for graphs that no single machine holds.

Large-star and small-star steps in turn: every node's neighbours are linked to its smallest neighbour until only stars are
left. Each round is written to shared storage and the one before it deleted. A node with very many neighbours is only ever aggregated by min or joined
to one row, which Spark pre-aggregates or splits.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import discard, shared_dir, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "k")
    return both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
    linked = down.join(least, F.col("u") == F.col("k"))
    return linked.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v) but the roots themselves: root is the smallest node it reaches."""
    spark = edges.sparkSession
    base = f"{shared_dir(spark)}/souk/components-{uuid.uuid4().hex}"
    step = 0
    now = written(spark, edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{base}/{step}")
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark, step = tuple(seen), step + 1
        now = written(spark, _small_star(_large_star(now)), f"{base}/{step}")
        discard(spark, f"{base}/{step - 1}")
