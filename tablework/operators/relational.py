"""Joins, first-by, sort, answer ordering (#58-#61)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SALT = "__tw_salt"


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def join_tables(left: DataFrame, right: DataFrame, keys: str | Sequence[str],
                how: str = "inner", salt_buckets: int = 0) -> DataFrame:
    """Equi-join on shared key columns.

    Strategy is left to Catalyst and AQE: a side whose (runtime) size is
    under the broadcast threshold is broadcast, otherwise both sides are
    shuffled on the keys, and AQE splits skewed shuffle partitions.
    A side that is skewed on keys unknown before is ``skew_join``'s case.
    ``salt_buckets > 1`` salts explicitly for a key known to be hot: left
    rows get a salt from a hash of the whole row, the right side is
    replicated once per salt value, so one key's rows spread over
    ``salt_buckets`` tasks (inner / left / left_semi / left_anti only).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    how = how.lower()
    if salt_buckets and salt_buckets > 1:
        if how not in ("inner", "left", "left_outer", "left_semi", "leftsemi", "left_anti", "leftanti"):
            raise ValueError("salting supports inner, left, left_semi and left_anti joins")
        salted_left = left.withColumn(
            _SALT, F.pmod(F.xxhash64(*[_q(c) for c in left.columns]), F.lit(salt_buckets)))
        salts = F.explode(F.sequence(F.lit(0), F.lit(salt_buckets - 1)).cast("array<bigint>"))
        salted_right = right.withColumn(_SALT, salts)
        return salted_left.join(salted_right, keys + [_SALT], how).drop(_SALT)
    return left.join(right, keys, how)


# Items that the summary of heavy keys tracks per partition of the join's shuffle.
_TRACKED, _TRACKED_MAX = 16, 1 << 19

_SPLITTABLE = {"inner", "left", "left_outer", "leftouter", "left_semi", "leftsemi", "left_anti", "leftanti"}


def heavy_keys(df: DataFrame, keys: str | Sequence[str], partitions: int) -> DataFrame:
    """Keys that hold more than an even share of the rows: ``(key_hash, parts)``,
    ``2 * partitions`` rows at most. ``parts`` is the number of even shares.

    One pass over the key columns: a mergeable frequent-items summary of
    ``16 * partitions`` counters per task (``approx_top_k``), whose counts are
    off by a fraction of one share at most, beside the number of rows. Rows with
    a missing key are not counted: they join with nothing.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    tracked = min(_TRACKED_MAX, max(1024, 1 << (_TRACKED * partitions - 1).bit_length()))
    present = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).select(
        F.xxhash64(*[_q(k) for k in keys]).alias("k"))
    top = present.agg(F.expr(f"approx_top_k(k, {min(2 * partitions, tracked)}, {tracked})").alias("top"),
                      F.count("*").alias("n"))
    found = top.select("n", F.explode("top").alias("t"))
    shares = F.col("t.count") * F.lit(partitions) / F.col("n")
    return found.where(F.col("t.item").isNotNull() & (shares > 1)).select(
        F.col("t.item").alias("key_hash"), F.ceil(shares).cast("int").alias("parts"))


def skew_join(left: DataFrame, right: DataFrame, keys: str | Sequence[str], how: str = "inner",
              partitions: int | None = None) -> DataFrame:
    """Equi-join whose left side may be skewed on any keys, unknown before.

    Heavy keys of the left side are found by one pass over its key columns
    (``heavy_keys``). A heavy key's left rows are dealt into as many parts as it
    holds even shares, and its right rows, and no others, are copied to each
    part; everything else is shuffled once, on its key. The copies sum up to
    ``2 * partitions`` keys' worth of right rows at most. Left rows with a
    missing key match nothing and are dealt out evenly.

    A row's part comes from its content and its input partition, so repeats of
    one row part too, and a task that runs again deals alike. ``how``: inner,
    left, left_semi, left_anti; ``right`` joins by changed sides.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    how = how.lower()
    if how in ("right", "right_outer", "rightouter"):
        columns = [*keys, *[c for c in left.columns if c not in keys], *[c for c in right.columns if c not in keys]]
        return skew_join(right, left, keys, "left", partitions).select(*[_q(c) for c in columns])
    if how not in _SPLITTABLE:
        raise ValueError(f"skew_join knows inner, left, right, left_semi and left_anti joins, not {how!r}")
    if partitions is None:
        partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = F.broadcast(heavy_keys(left, keys, partitions))   # 2 * partitions rows at most
    hashed, parts, missing = f"{_SALT}_key", f"{_SALT}_parts", F.lit(False)
    for k in keys:
        missing = missing | _q(k).isNull()

    def marked(df: DataFrame) -> DataFrame:
        named = heavy.select(F.col("key_hash").alias(hashed), F.col("parts").alias(parts))
        return df.withColumn(hashed, F.xxhash64(*[_q(k) for k in keys])).join(named, hashed, "left")

    row = F.xxhash64(*[_q(c) for c in left.columns], F.spark_partition_id())
    dealt = F.when(missing, F.pmod(row, F.lit(partitions))).otherwise(
        F.pmod(row, F.coalesce(F.col(parts), F.lit(1)).cast("long")))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(parts), F.lit(1)).cast("long") - 1))
    out = marked(left).withColumn(_SALT, dealt).drop(hashed, parts).join(
        marked(right).withColumn(_SALT, copies).drop(hashed, parts), [*keys, _SALT], how)
    return out.drop(_SALT)


def first_by(df: DataFrame, order: Sequence[str | Column], where: Column | str | None = None,
             columns: Sequence[str] | None = None) -> DataFrame:
    """The first row by ``order`` (add a unique tie-breaker to it), after an
    optional filter: per-partition top-1 then one merge, no global sort."""
    if where is not None:
        df = df.where(F.expr(where) if isinstance(where, str) else where)
    out = df.orderBy(*order).limit(1)
    return out.select(*columns) if columns else out


def sort_by_key(df: DataFrame, keys: Sequence[str | Column], descending: bool = False) -> DataFrame:
    """Range-partitioned total sort (only needed when order is the output)."""
    cols = [(_q(k) if isinstance(k, str) else k) for k in keys]
    return df.orderBy(*[c.desc() if descending else c.asc() for c in cols])


def order_answers(frames: Sequence[DataFrame], order: str = "task_id") -> DataFrame:
    """Union one-row answer frames and order them by task id."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.orderBy(order)
