"""All frequent prefixes and suffixes of a text column (#51).

A trie is grown breadth-first. Values are made distinct once, with their rows;
a round groups the values that are still alive by one character more than their
node's pattern, and only children with enough rows live on. Whatever all values
of a child have in common is taken in one step: the common prefix of a set of
texts is that of its least and its greatest, two aggregates. So a node is a
*closed* pattern (every longer one has fewer rows), rounds go from branch to
branch and not from character to character, and the patterns between a node and
its parent follow from it without being counted.

At most ``1 / min_support`` patterns of one length are frequent, as they share
out the rows, so a round brings that many rows to the driver (twice: prefixes
and suffixes) and sends them back as a broadcast. Values alive are written per
round; the last round's table is removed.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablework.session import remove_scratch, scratch_path

RESULT = "kind string, pattern string, n_rows long, n_keys long, closed boolean"


def frequent_affixes(df: DataFrame, column: str, min_support: float = 0.01) -> DataFrame:
    """``(kind, pattern, n_rows, n_keys, closed)``: every prefix and suffix of the
    column's values that at least ``min_support`` of its present values have, with
    the rows and the distinct values that do. ``closed``: no longer pattern of its
    kind has as many rows.

    Missing values are no values, an empty text has no patterns, and an empty
    table none at all. ``0 < min_support <= 1``.
    """
    if not 0 < min_support <= 1:
        raise ValueError("min_support must be above 0 and at most 1")
    spark, paths = df.sparkSession, []

    def kept(frame: DataFrame) -> DataFrame:
        paths.append(scratch_path(spark, "alive"))
        frame.write.parquet(paths[-1])
        return spark.read.schema(frame.schema).parquet(paths[-1])

    value = F.col(f"`{column}`").cast("string")
    per_key = df.where(value.isNotNull()).groupBy(value.alias("text")).agg(F.count("*").alias("n"))
    both = F.explode(F.array(
        F.struct(F.lit("prefix").alias("kind"), F.col("text").alias("value")),
        F.struct(F.lit("suffix").alias("kind"), F.reverse("text").alias("value"))))
    # ``depth``: characters of the node that the value stands below
    alive = kept(per_key.select("n", both.alias("v")).select("v.kind", "v.value", "n", F.lit(0).alias("depth")))
    total = alive.where("kind = 'prefix'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found: list[tuple] = []                                    # kind, node, parent's length, rows, keys
    while True:
        below = alive.where("length(value) > depth").withColumn("child", F.expr("substring(value, 1, depth + 1)"))
        nodes = below.groupBy("kind", "child").agg(
            F.sum("n").alias("rows"), F.count("*").alias("keys"), F.min("value").alias("low"),
            F.max("value").alias("high")).where(F.col("rows") >= F.lit(min_support * total)).collect()
        if not nodes:
            break
        step = []
        for r in nodes:
            node = os.path.commonprefix([r["low"], r["high"]])
            found.append((r["kind"], node, len(r["child"]) - 1, r["rows"], r["keys"]))
            step.append((r["kind"], r["child"], len(node)))
        # the node's texts go on below it; those of children that are not frequent end here
        step = spark.createDataFrame(step, "kind string, child string, depth int")
        alive = kept(below.drop("depth").join(F.broadcast(step), ["kind", "child"]).select("kind", "value", "n", "depth"))
        remove_scratch(spark, paths.pop(0))
    remove_scratch(spark, paths.pop(0))
    rows = spark.createDataFrame(found, "kind string, node string, above int, n_rows long, n_keys long")
    size = F.explode(F.sequence(F.col("above") + 1, F.length("node"))).alias("size")
    rows = rows.select("kind", "node", size, "n_rows", "n_keys")
    cut = F.expr("substring(node, 1, size)")
    return rows.select("kind", F.when(F.col("kind") == "suffix", F.reverse(cut)).otherwise(cut).alias("pattern"),
                       "n_rows", "n_keys", (F.length("node") == F.col("size")).alias("closed"))
