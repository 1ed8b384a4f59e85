"""Connected components of a stored edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintage.llm import common


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that is not the smallest of its component; edges are (u, v) of longs.

    Each round links every node's larger neighbours to the smallest one
    (large star), then its smaller ones (small star), until nothing changes;
    rounds grow with the logarithm of the longest chain. Minima are
    pre-aggregated, so a hub costs each task one row. Every round is written
    to the shared folder, and the round before it deleted.
    """
    spark = edges.sparkSession

    def stored(df: DataFrame) -> tuple[DataFrame, str, tuple]:
        path = common.scratch_path(spark, "edges")
        df.write.parquet(path)
        out = spark.read.schema("u long, v long").parquet(path)
        row = out.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("mark")).first()
        return out, path, (row["n"], row["mark"])

    now, path, mark = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    settled = not mark[0]
    while not settled:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after, new_path, new_mark = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        common.drop_path(spark, path)
        settled = new_mark == mark
        now, path, mark = after, new_path, new_mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
