"""Chart series (#69-#70): the table behind a chart, sized for a chart.

The picture itself is rendering work on one machine; what scales is the
series, which is always bounded here no matter how large the input is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablework.operators.stats import BOUND_BUCKETS, leading_counts, with_keys

OTHER = "other"


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def bar_series(df: DataFrame, key: str, order: str = "key", max_bars: int | None = None,
               other_label: str = OTHER, keep_missing: bool = False) -> DataFrame:
    """``(position, category, n)``: rows per category. Missing categories are
    left out unless ``keep_missing``. The bar of the rest is told from a real
    category of its name by " (rest)".

    With ``max_bars`` the largest ``max_bars`` categories are kept (ties →
    smaller key) by a top-k (TakeOrderedAndProject, no global sort) and
    the rest are summed into one ``other`` bar (total minus the top).
    ``order``: ``"key"`` (category ascending) or ``"count"`` (n descending,
    then key). ``position`` numbers the bars in that order (other last).
    """
    counts = with_keys(df, [key], keep_missing).groupBy(_q(key).cast("string").alias("category")) \
        .agg(F.count("*").alias("n"))
    return bars_of(counts, order, max_bars, other_label)


def bar_series_bounded(df: DataFrame, key: str, max_bars: int, order: str = "key",
                       other_label: str = OTHER, buckets: int = BOUND_BUCKETS) -> DataFrame:
    """``bar_series(df, key, order, max_bars)`` for many categories of uneven
    size: the leading bars come from ``leading_counts``, the bar of the rest from
    the number of rows, so small categories are never shuffled one by one."""
    text = with_keys(df, [key]).select(_q(key).cast("string").alias("category"))
    leading = leading_counts(text, "category", max_bars, buckets).select(F.col("key").alias("category"), "n")
    return bars_of(leading, order, max_bars, other_label, text.agg(F.count("*").alias("n")))


def bars_of(counts: DataFrame, order: str = "key", max_bars: int | None = None,
            other_label: str = OTHER, total: DataFrame | None = None) -> DataFrame:
    """``bar_series`` from the rows per category: ``(category, n)``. ``total``: the
    number of rows ``(n)``, where ``counts`` holds the leading categories only."""
    if max_bars is not None:
        top = counts.orderBy(F.col("n").desc(), F.col("category").asc_nulls_last()).limit(max_bars)
        # total minus the top bars: two one-row sums meet in a union + sum
        named = (F.col("category") == other_label).alias("named")
        whole = counts if total is None else total
        rest = (whole.select(F.col("n").alias("d"), F.lit(False).alias("named"))
                .unionByName(top.select((-F.col("n")).alias("d"), named))
                .agg(F.sum("d").alias("n"), F.max("named").alias("named"))
                .select(F.when(F.col("named"), F.lit(f"{other_label} (rest)"))
                        .otherwise(F.lit(other_label)).alias("category"), "n")
                .where(F.col("n") > 0))
        counts = top.withColumn("__other", F.lit(0)).unionByName(rest.withColumn("__other", F.lit(1)))
    else:
        counts = counts.withColumn("__other", F.lit(0))
    if order == "key":
        sort = [F.col("__other"), F.col("category").asc_nulls_last()]
    elif order == "count":
        sort = [F.col("__other"), F.col("n").desc(), F.col("category").asc_nulls_last()]
    else:
        raise ValueError("order must be 'key' or 'count'")
    if max_bars is not None:
        # at most max_bars + 1 rows: a single-partition window is bounded
        from pyspark.sql import Window
        pos = F.row_number().over(Window.orderBy(*sort)) - 1
        return counts.select(pos.alias("position"), "category", "n")
    return counts.orderBy(*sort).select("category", "n")


def scatter_series(df: DataFrame, x: str, y: str, max_points: int | None = None) -> DataFrame:
    """Points plus the least-squares line value at each point.

    ``max_points=None``: every complete (x, y) pair as
    ``(x, y, n, fit)`` with n = 1. With ``max_points`` the plane is cut
    into a ``b × b`` grid (``b = floor(sqrt(max_points))``) over the data
    range and each occupied cell gives one point ``(bx, by, x, y, n, fit)``
    at the cell centre with its row count (a binned scatter), so the series
    never exceeds ``max_points`` rows and keeps the density a thinned sample
    would lose; centres are exact arithmetic on the range, so the series is
    reproducible anywhere. The fit and the ranges are a one-row aggregate that
    enters the point plan as a scalar subquery; no job runs while planning.
    """
    xs, ys = _q(x).cast("double"), _q(y).cast("double")
    pts = df.select(xs.alias("x"), ys.alias("y")).where(
        F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    st = pts.agg(F.struct(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        F.min("x").alias("x0"), F.max("x").alias("x1"),
        F.min("y").alias("y0"), F.max("y").alias("y1")).alias("s")).scalar()
    if max_points is None:
        return pts.select("x", "y", F.lit(1).cast("bigint").alias("n"),
                          (st["slope"] * F.col("x") + st["intercept"]).alias("fit"))
    b = max(1, int(max_points ** 0.5))

    def cell(v: str, lo: Column, hi: Column) -> Column:
        raw = F.floor((F.col(v) - lo) * F.lit(float(b)) / F.nullif(hi - lo, F.lit(0.0)))
        return F.coalesce(F.least(raw, F.lit(b - 1)).cast("int"), F.lit(0))

    def centre(idx: str, lo: Column, hi: Column) -> Column:
        return F.when(hi == lo, lo).otherwise(lo + (F.col(idx) + F.lit(0.5)) * (hi - lo) / F.lit(float(b)))

    cells = (pts.groupBy(cell("x", st["x0"], st["x1"]).alias("bx"), cell("y", st["y0"], st["y1"]).alias("by"))
             .agg(F.count("*").alias("n")))
    x, y = centre("bx", st["x0"], st["x1"]), centre("by", st["y0"], st["y1"])
    return cells.select("bx", "by", x.alias("x"), y.alias("y"), "n",
                        (st["slope"] * x + st["intercept"]).alias("fit"))
