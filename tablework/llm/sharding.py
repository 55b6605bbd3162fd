"""Sharding by extendible hashing (operator 3); DataFrame functions only.

A row's bucket is told by the leading bits of a 60-bit hash of its id and
text. The directory begins with as many bits as the total size asks for; a
bucket over the byte limit, and no other, splits on one bit more, until each
fits. Sizes are summed once per *cell* (``STEP`` bits finer than the bits in
question), all splits of those levels are decided on the cell sums, and only
cells that are still too large are looked at again, ``STEP`` bits deeper. So
the rows are read once per ``STEP`` levels at most, in a written table of a few
numbers per row, and what is shuffled are sums made before the shuffle.

When no bits are left, a bucket holds exact repeats only (equal id and text).
Such a bucket is dealt into pages by a running number, counted in salted
groups: the overflow pages of extendible hashing. A row that is over the limit
by itself takes no part in the splits; it has a page to itself, under its full
hash, and is marked ``oversize``.

A shard's name is its bits, with the page number behind a dot for overflow
pages ("0110", "0110.2").

Defined cases: NULL ids and texts hash as marked empty strings, and a NULL text
has 0 bytes; repeated rows each get a place; an empty table gives no rows;
columns that an output column's name would clash with are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LIMIT = 4 << 20                  # bytes of text per shard
BITS = 60                        # of the hash
STEP = 4                         # levels decided at once


def hash_bits(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The first 60 bits of md5 over id and text, as a string of 0 and 1."""
    part = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n"))
    hexed = F.substring(F.md5(F.concat(part(id_col), F.lit("/"), part(text_col))), 1, BITS // 4)
    return F.lpad(F.conv(hexed, 16, 2), BITS, "0")


def first_bits(total: int, limit: int) -> int:
    """Bits of the first directory: so many that an even share fits."""
    return min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))))


def _settle(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """(cell, bucket) of the cells (``high`` bits) of which a prefix of at least
    ``low`` bits fits the limit: the shortest such prefix."""
    levels = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
    levels = levels.withColumn("prefix", F.expr("substring(cell, 1, depth)"))
    sums = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("total")).where(F.col("total") <= limit)
    fits = levels.join(sums, ["depth", "prefix"])
    return fits.groupBy("cell").agg(F.min("depth").alias("depth")).select(
        "cell", F.expr("substring(cell, 1, depth)").alias("bucket"))


def directory(sized: DataFrame, limit: int = LIMIT) -> list[tuple[int, DataFrame]]:
    """[(bits, cells)]: what each round settled, from rows of (bits, n_bytes)."""
    total = sized.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    low, rounds, rest = first_bits(total, limit), [], sized
    while True:
        high = min(BITS, low + STEP)
        cells = rest.groupBy(F.expr(f"substring(bits, 1, {high})").alias("cell")) \
            .agg(F.sum("n_bytes").alias("bytes"))
        cells = written(cells, "cells")
        settled = written(_settle(cells, low, high, limit), "settled")
        rounds.append((high, settled))
        open_ = cells.join(settled, "cell", "left_anti")
        if high == BITS or open_.isEmpty():
            return rounds
        rest = rest.withColumn("cell", F.expr(f"substring(bits, 1, {high})")).join(
            open_.select("cell"), "cell", "left_semi").drop("cell")
        low = high + 1


def assign(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text",
           keep_columns: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, shard, depth (bits), oversize; with
    ``keep_columns`` the columns of ``docs`` before them."""
    bytes_ = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    names = {"n_bytes", "shard", "depth", "oversize"}
    kept = [c for c in docs.columns if c.lower() not in names] if keep_columns else [id_col]
    rows = docs.select(*[F.col(c) for c in kept], hash_bits(id_col, text_col).alias("__bits"),
                       bytes_.alias("n_bytes"), F.monotonically_increasing_id().alias("__row"))
    rows = written(rows, "sized")
    sized = rows.where(F.col("n_bytes") <= limit).select(F.col("__bits").alias("bits"), "n_bytes")
    rounds = directory(sized, limit)
    out = rows.withColumn("__bucket", F.lit(None).cast("string"))
    for high, settled in rounds:
        named = settled.select(F.col("cell").alias("__cell"), F.col("bucket").alias("__found"))
        out = out.withColumn("__cell", F.expr(f"substring(__bits, 1, {high})")).join(named, "__cell", "left")
        out = out.withColumn("__bucket", F.coalesce("__bucket", "__found")).drop("__cell", "__found")
    full = F.col("__bucket").isNotNull() & (F.col("n_bytes") <= limit)
    shared = out.where(full).withColumn("shard", F.col("__bucket"))
    paged = _pages(out.where(~full), limit)
    every = shared.unionByName(paged.select(*shared.columns))
    return every.select(*kept, "n_bytes", "shard",
                        F.least(F.length(F.substring_index("shard", ".", 1)), F.lit(BITS)).alias("depth"),
                        (F.col("n_bytes") > limit).alias("oversize"))


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Overflow pages of buckets whose rows are all alike: the n-th row goes to
    page n / (rows that fit a page)."""
    salts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("__row"), F.lit(salts)))
    before = salted.groupBy("__bits", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = before.select("__bits", "__salt", (F.sum("__n").over(
        Window.partitionBy("__bits").orderBy("__salt")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__bits", "__salt").orderBy("__row")) - 1
    placed = salted.withColumn("__at", place).join(before, ["__bits", "__salt"])
    per_page = F.greatest(F.floor(F.lit(limit) / F.col("n_bytes")), F.lit(1))
    page = F.floor((F.col("__at") + F.col("__before")) / per_page).cast("long")
    return placed.withColumn("shard", F.concat("__bits", F.lit("."), page.cast("string")))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Writes documents as Parquet, a folder per shard; rows of one shard are
    brought together first, so it is one file."""
    placed = assign(docs, limit, id_col, text_col, keep_columns=True)
    placed.repartition("shard").write.partitionBy("shard").parquet(path)


# The same rule in DuckDB SQL: the shortest prefix, not shorter than the first
# directory's, whose documents fit the limit; pages for rows that none fits.
def oracle(limit: int = LIMIT) -> str:
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
         md5(coalesce('v' || doc_id::VARCHAR, 'n') || '/' || coalesce('v' || text, 'n')) AS h
  FROM documents),
b AS (
  SELECT *, row_number() OVER () AS r,
         lpad(bin(('0x' || substr(h, 1, 15))::BIGINT), {BITS}, '0') AS bits FROM d),
fit AS (SELECT * FROM b WHERE n_bytes <= {limit}),
first AS (
  SELECT greatest(0, ceil(log2(greatest(1, coalesce(sum(n_bytes), 0) / {limit}))))::BIGINT AS low FROM fit),
levels AS (
  SELECT fit.*, g.depth, substr(bits, 1, g.depth) AS prefix
  FROM fit, first, LATERAL (SELECT unnest(range(first.low, {BITS} + 1)) AS depth) g),
sums AS (SELECT prefix, depth, sum(n_bytes) AS total FROM levels GROUP BY ALL HAVING total <= {limit}),
best AS (SELECT r, min(depth) AS depth FROM levels JOIN sums USING (prefix, depth) GROUP BY r),
paged AS (
  SELECT b.*, (row_number() OVER (PARTITION BY bits ORDER BY r) - 1)
              // greatest({limit} // greatest(n_bytes, 1), 1) AS page
  FROM b ANTI JOIN best USING (r))
SELECT doc_id, n_bytes, substr(bits, 1, depth) AS shard, depth::INTEGER AS depth, false AS oversize
FROM b JOIN best USING (r)
UNION ALL
SELECT doc_id, n_bytes, bits || '.' || page, {BITS}, n_bytes > {limit} FROM paged
"""


ORACLE = oracle()
