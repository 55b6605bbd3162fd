"""Benchmark decontamination by winnowing (operator 5); DataFrame functions only.

Both sides are words (``common.ascii_words``), each a 64-bit hash. Of every run
of ``GUARANTEE - K + 1`` consecutive hashes of ``K`` words the smallest is kept
as a fingerprint, so any passage of ``GUARANTEE`` words that a document shares
with an item shares a fingerprint too. Document fingerprints meet the
benchmark's in one join on the hash. Every hit is then extended, word by word
and both ways, inside the row; if the run reaches ``GUARANTEE`` words, all its
words are hit.

An item of fewer words than ``GUARANTEE`` (but not none) is one window: the
whole item. Fingerprints cannot promise to find it, so for each such length
(``GUARANTEE - 1`` at most) documents are looked up by the hash of every run of
that many words.

A fingerprint carries the hashes of the words within reach around it, so no row
holds a whole document and a text of any length takes memory in proportion.
The benchmark side is broadcast when it has at most ``BROADCAST_ROWS``
fingerprints (counted first; a row is its item's name and at most ``2 * REACH + K``
hashes of 8 bytes, so about 200 bytes: 40 MB at the limit, however long the
items are); a larger one is joined by shuffling fingerprints. Documents are not shuffled:
only hits and one row per document are, and hits of one document are few
numbers, merged before the shuffle where they meet in a task.

Defined cases: NULL and empty texts have no words and are clean; repeated rows
give one row each with equal results; NULL item ids count as items named "";
an empty benchmark leaves every document clean; further columns are kept by
``drop_contaminated`` and never read, so names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, with_row_key

GUARANTEE, K = 10, 5
BROADCAST_ROWS = 200_000
REACH = GUARANTEE - K            # words to look at on either side of a fingerprint


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once: inside a lambda, a column
    expression would be worked out anew for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _runs(h: Column, size: int) -> Column:
    """One hash per run of ``size`` consecutive words."""
    return F.when(F.size(h) >= size, F.transform(
        F.sequence(F.lit(0), F.size(h) - size),
        lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)]))
    ).otherwise(F.array().cast("array<bigint>"))


SPOT = "struct<f:bigint,p:int,short:int,near:array<bigint>>"


def _spot(h: Column, f: Column, p: Column, short: int) -> Column:
    """A fingerprint with its position and the words within reach of it."""
    near = F.slice(h, F.greatest(p - REACH, F.lit(0)) + 1, 2 * REACH + K)
    return F.struct(f.alias("f"), p.alias("p"), F.lit(short).alias("short"), near.alias("near"))


def _winnow(h: Column) -> Column:
    """(f, p): hash and position of the smallest run hash of every window. A run
    is one of these when it equals the largest minimum of the windows it is in."""
    size = GUARANTEE - K + 1
    none = F.array().cast(f"array<{SPOT}>")

    def picked(runs: Column) -> Column:
        minima = F.transform(F.sequence(F.lit(0), F.size(runs) - size),
                             lambda i: F.least(*[F.get(runs, i + k) for k in range(size)]))
        spots = _let(minima, lambda m: F.filter(
            F.sequence(F.lit(0), F.size(runs) - 1),
            lambda i: F.get(runs, i) == F.greatest(*[F.get(m, i - k) for k in range(size)])))
        return F.transform(spots, lambda i: _spot(h, F.get(runs, i), i, 0))

    return F.when(F.size(h) >= GUARANTEE, _let(_runs(h, K), picked)).otherwise(none)


def _short_spots(h: Column, size: int) -> Column:
    return F.transform(_runs(h, size), lambda f, i: _spot(h, f, i, size))


def _common(a: Column, at_a: Column, b: Column, at_b: Column, step: int) -> Column:
    """How many words agree from (at_a, at_b) on, going by ``step``, up to REACH."""
    agree = [F.coalesce(F.get(a, at_a + step * k) == F.get(b, at_b + step * k), F.lit(False))
             for k in range(REACH)]
    count = F.lit(REACH)
    for k in reversed(range(REACH)):
        count = F.when(~agree[k], F.lit(k)).otherwise(count)
    return count


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id") -> DataFrame:
    """Hit runs of words: one row per document and found run, and one row with a
    NULL item per document. Columns: id, __row_key, n_words, item, first, last."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
                             _hashes(ascii_words("text")).alias("ih"))
    items = items.withColumn("m", F.size("ih")).where("m > 0").distinct()
    prints = items.where(F.col("m") >= GUARANTEE) \
        .withColumn("w", _let(F.col("ih"), _winnow)) \
        .select("item", F.explode("w").alias("w")) \
        .select("item", F.col("w.near").alias("ih"), "w.short", "w.f",
                F.least(F.col("w.p"), F.lit(REACH)).alias("q"))
    lengths = [r["m"] for r in items.where(F.col("m") < GUARANTEE).select("m").distinct()
               .orderBy("m").collect()]                       # GUARANTEE - 1 at most
    for m in lengths:
        prints = prints.unionByName(items.where(F.col("m") == m).select(
            "item", "ih", F.lit(m).alias("short"),
            F.xxhash64(*[F.get("ih", F.lit(k)) for k in range(m)]).alias("f"), F.lit(0).alias("q")))
    small = prints.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    words = with_row_key(docs, id_col, text_col).select(id_col, "__row_key",
                                                         ascii_words(text_col).alias("__w"))
    words = words.select(id_col, "__row_key", _hashes(F.col("__w")).alias("h"))
    words = words.withColumn("n_words", F.size("h").cast("long"))
    # A first entry stands for the document itself. It meets no print, so it is
    # kept by an outer join; its hash is the row's, so no key is common to all.
    itself = F.array(F.struct(F.xxhash64("__row_key").alias("f"), F.lit(0).alias("p"), F.lit(-1).alias("short"),
                              F.array().cast("array<bigint>").alias("near")))
    spots = _let(F.col("h"), lambda h: F.concat(
        itself, _winnow(h), *[_short_spots(h, m) for m in lengths]))
    spots = words.withColumn("s", F.explode(spots)).select(id_col, "__row_key", "n_words", "s.*")
    met = spots.join(F.broadcast(prints) if small else prints, ["f", "short"], "left") \
        .where((F.col("short") < 0) | F.col("item").isNotNull())
    at = F.least(F.col("p"), F.lit(REACH))
    left = _common(F.col("near"), at - 1, F.col("ih"), F.col("q") - 1, -1)
    right = _common(F.col("near"), at + K, F.col("ih"), F.col("q") + K, 1)
    long = F.col("short") == 0
    first = F.when(long, F.col("p") - left).otherwise(F.col("p"))
    last = F.when(long, F.col("p") + K + right).otherwise(F.col("p") + F.col("short"))
    same = F.forall(F.sequence(F.lit(0), F.when(long, F.lit(K)).otherwise(F.col("short")) - 1),
                    lambda k: F.get(F.col("near"), at + k) == F.get(F.col("ih"), F.col("q") + k))
    found = F.col("item").isNotNull()
    rows = met.select(id_col, "__row_key", "n_words", F.col("item"),
                      F.when(found, first).alias("first"), F.when(found, last).alias("last"),
                      (~found | (same & (~long | (last - first >= GUARANTEE)))).alias("ok"))
    return rows.where("ok").drop("ok")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Per document: id, __row_key, n_words, n_hit, spans (merged, half-open word
    ranges), items (sorted ids) and n_rows (how many equal rows there are)."""
    rows = hits(docs, benchmark, id_col, text_col, item_col)
    runs = rows.groupBy(id_col, "__row_key", "n_words").agg(
        F.collect_set(F.when(F.col("item").isNotNull(), F.struct("first", "last"))).alias("runs"),
        F.collect_set("item").alias("items"),
        F.count(F.when(F.col("item").isNull(), 1)).alias("n_rows"))
    # Runs in order; a run that meets the last span widens it, another opens one.
    empty = F.array().cast("array<struct<first:int,last:int>>")
    spans = F.aggregate(F.array_sort("runs"), empty, lambda acc, r: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["last"] >= r["first"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["first"].alias("first"),
            F.greatest(F.element_at(acc, -1)["last"], r["last"]).alias("last"))))
    ).otherwise(F.concat(acc, F.array(r))))
    merged = runs.withColumn("spans", F.when(F.size("runs") == 0, empty).otherwise(spans))
    return merged.select(
        id_col, "__row_key", "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda s, r: s + (r["last"] - r["first"])).alias("n_hit"),
        "spans", F.array_sort("items").alias("items"), "n_rows")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The result columns of the query, one row per input row."""
    return found.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int")))).select(
        id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows without a hit, with their own columns."""
    bad = hits(docs, benchmark, id_col, text_col, item_col).where("item IS NOT NULL")
    keyed = with_row_key(docs, id_col, text_col)
    return keyed.join(bad.select("__row_key").distinct(), "__row_key", "left_anti").drop("__row_key")


# Every window of every text, in DuckDB SQL.
_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item, least({GUARANTEE}, len(w)) AS n, w[k:k + least({GUARANTEE}, len(w)) - 1] AS win
  FROM i, LATERAL (SELECT unnest(range(1, len(w) - least({GUARANTEE}, len(w)) + 2)) AS k) WHERE len(w) > 0),
dw AS (
  SELECT r, n, k, w[k:k + n - 1] AS win
  FROM d, (SELECT DISTINCT n FROM iw) s, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS k)),
hit AS (SELECT r, n, k, item FROM dw JOIN iw USING (n, win)),
words AS (SELECT r, count(DISTINCT p) AS n_hit
          FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
