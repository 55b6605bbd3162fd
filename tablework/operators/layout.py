"""Tables laid out for repeated joins (#5 with #58).

A table that is joined again and again on the same keys is shuffled once, when it
is written: ``save_bucketed`` writes it in hash buckets of its keys, and
``join_bucketed`` joins two such tables bucket by bucket, without a shuffle.

A bucket is read by one task, so keys that alone hold more than an even share of
the rows (``relational.heavy_keys``) and rows with a missing key are kept apart, in
a table without buckets. A join takes every key that is kept apart on either side
through ``relational.skew_join``, which deals a heavy key's rows over tasks, and
all other keys from the buckets.

Three tables make a layout ``name``: ``name`` (buckets), ``name_apart`` (rows kept
apart) and ``name_heavy`` (hashes of the keys kept apart, ``2 * buckets`` rows at
most, so they are broadcast). Their files lie in the shared folder or in ``path``.

Defined cases: NULL keys match nothing, as in any equi-join; repeated rows are all
kept; an empty table makes an empty layout; key columns must have the same names and
types on both sides; a column named like one of the other side's that is no key
appears twice in an inner or left join, as in Spark's own join by names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.operators.relational import heavy_keys, skew_join
from tablework.session import scratch_path

_HASH = "__tw_key"


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _hashed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumn(_HASH, F.xxhash64(*[_q(k) for k in keys]))


def _with_hash_in(df: DataFrame, keys: Sequence[str], hashes: DataFrame, how: str) -> DataFrame:
    named = F.broadcast(hashes.select(F.col("key_hash").alias(_HASH)))
    return _hashed(df, keys).join(named, _HASH, how).drop(_HASH)


def save_bucketed(df: DataFrame, name: str, keys: str | Sequence[str], buckets: int,
                  path: str | None = None) -> str:
    """Writes ``df`` as the layout ``name`` (replacing one of that name in the
    catalog); returns ``name``. ``path``: folder of its files, a fresh one in the
    shared folder unless given.

    The rows are shuffled once, by the hash that numbers the buckets, so a bucket is
    one file. Choose ``buckets`` for the bytes of a bucket (a few hundred MB), alike
    for tables that are joined.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    spark = df.sparkSession
    root = (path or scratch_path(spark, name)).rstrip("/")

    def stored(rows, part: str):
        rows.option("path", f"{root}/{part}").mode("overwrite").saveAsTable(part)

    stored(heavy_keys(df, keys, buckets).write, f"{name}_heavy")
    heavy = spark.table(f"{name}_heavy")
    present = " AND ".join(f"`{k}` IS NOT NULL" for k in keys)
    known = df.where(present)
    apart = _with_hash_in(known, keys, heavy, "left_semi").unionByName(df.where(f"NOT ({present})"))
    stored(apart.write, f"{name}_apart")
    even = _with_hash_in(known, keys, heavy, "left_anti").repartition(buckets, *[_q(k) for k in keys])
    stored(even.write.bucketBy(buckets, *keys).sortBy(*keys), name)
    return name


def bucket_keys(spark: SparkSession, name: str) -> tuple[list[str], int]:
    """Key columns and number of buckets of the layout ``name``, from the catalog."""
    facts = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED `{name}`").collect()}
    if "Num Buckets" not in facts:
        raise ValueError(f"{name!r} has no buckets")
    return [k.strip("` ") for k in facts["Bucket Columns"].strip("[]").split(",")], int(facts["Num Buckets"])


def load_layout(spark: SparkSession, name: str) -> DataFrame:
    """All rows of the layout ``name``."""
    return spark.table(name).unionByName(spark.table(f"{name}_apart"))


def join_bucketed(spark: SparkSession, left: str, right: str, how: str = "inner") -> DataFrame:
    """Equi-join of two layouts on their keys: inner, left, left_semi or left_anti.

    Keys kept apart on neither side are joined from the buckets; with equal numbers
    of buckets neither side is shuffled. The others (all rows of a key on both sides
    go the same way) are joined by ``skew_join``: of the bucketed rows only those of
    keys that are heavy on the other side are shuffled.
    """
    keys, buckets = bucket_keys(spark, left)
    others, _ = bucket_keys(spark, right)
    ls, rs = spark.table(left), spark.table(right)
    if keys != others or any(ls.schema[k].dataType != rs.schema[k].dataType for k in keys):
        raise ValueError(f"{left!r} and {right!r} are not bucketed by the same columns of the same types")
    heavy_left, heavy_right = spark.table(f"{left}_heavy"), spark.table(f"{right}_heavy")
    even = _with_hash_in(ls, keys, heavy_right, "left_anti").join(rs, keys, how)
    moved_left = spark.table(f"{left}_apart").unionByName(_with_hash_in(ls, keys, heavy_right, "left_semi"))
    moved_right = spark.table(f"{right}_apart").unionByName(_with_hash_in(rs, keys, heavy_left, "left_semi"))
    return even.union(skew_join(moved_left, moved_right, keys, how, buckets))
