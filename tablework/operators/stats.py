"""Aggregations (#37-#57).

All are built-in aggregate functions, planned as partial (map-side)
aggregate → shuffle on the group key → final aggregate, so a hot key that
holds a third of the rows is pre-combined inside every map task before the
shuffle and never lands in one task as raw rows. Global results are one
row; per-key results have one row per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.functions.text import ends_with, shape_mask, starts_with


def _c(c: Column | str) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


# Scalar aggregates are defined once as (name, expression) pairs, so a
# report can fuse many of them over one source into a single pass.
Named = list[tuple[str, Column]]


def _pred(predicate: Column | str) -> Column:
    p = F.expr(predicate) if isinstance(predicate, str) else predicate
    return F.coalesce(p, F.lit(False))


def no_nan(df: DataFrame, column: str) -> Column:
    """The column, with NaN as missing for floating types (pandas skips NaN
    in mean/min/max; Spark would return NaN)."""
    c = _c(column)
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    return c


def row_count_aggs(df: DataFrame) -> Named:
    return [("n_rows", F.count("*"))]


def filtered_count_aggs(df: DataFrame, predicate: Column | str) -> Named:
    return [("n_rows", F.count_if(_pred(predicate)))]


def count_distinct_aggs(df: DataFrame, column: str, approx: bool = False, rsd: float = 0.01) -> Named:
    c = no_nan(df, column)
    return [("n_distinct", F.approx_count_distinct(c, rsd) if approx else F.count_distinct(c))]


def global_mean_aggs(df: DataFrame, column: str) -> Named:
    return [("mean", F.avg(no_nan(df, column)))]


def min_max_aggs(df: DataFrame, column: str) -> Named:
    c = no_nan(df, column)
    return [("min_value", F.min(c)), ("max_value", F.max(c))]


def percentage_aggs(df: DataFrame, predicate: Column | str) -> Named:
    pct = F.try_divide(F.lit(100.0) * F.count_if(_pred(predicate)), F.count("*"))
    return [("pct", F.coalesce(pct, F.lit(0.0)))]


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c.cast("double")), c.cast("double"))


def correlation_aggs(df: DataFrame, x: str, y: str) -> Named:
    return [("corr", F.corr(_finite(_c(x)), _finite(_c(y))))]


def regression_aggs(df: DataFrame, x: str, y: str) -> Named:
    xs, ys = _finite(_c(x)), _finite(_c(y))
    return [("slope", F.regr_slope(ys, xs)), ("intercept", F.regr_intercept(ys, xs)),
            ("r2", F.regr_r2(ys, xs)), ("n", F.regr_count(ys, xs))]


def _agg(df: DataFrame, named: Named) -> DataFrame:
    return df.agg(*[c.alias(n) for n, c in named])


def row_count(df: DataFrame) -> DataFrame:
    return _agg(df, row_count_aggs(df))


def filtered_count(df: DataFrame, predicate: Column | str) -> DataFrame:
    return _agg(df, filtered_count_aggs(df, predicate))


def count_distinct(df: DataFrame, column: str, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Distinct non-missing values. Exact: aggregate on (value) with
    partial dedup per map task; ``approx``: HyperLogLog++ sketch merge."""
    return _agg(df, count_distinct_aggs(df, column, approx, rsd))


def global_mean(df: DataFrame, column: str) -> DataFrame:
    return _agg(df, global_mean_aggs(df, column))


def min_max(df: DataFrame, column: str) -> DataFrame:
    return _agg(df, min_max_aggs(df, column))


def with_keys(df: DataFrame, keys: Sequence[str], keep_missing: bool = False) -> DataFrame:
    """The rows whose group keys are all present (NULL and NaN are missing, as
    in a pandas group-by); ``keep_missing`` keeps them as a group of their own."""
    if keep_missing:
        return df
    for k in keys:
        df = df.where(no_nan(df, k).isNotNull())
    return df


def group_counts(df: DataFrame, key: str | Sequence[str], keep_missing: bool = False) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return with_keys(df, keys, keep_missing).groupBy(*[_c(k) for k in keys]).agg(F.count("*").alias("n"))


def group_mean(df: DataFrame, key: str, column: str, keep_missing: bool = False) -> DataFrame:
    return with_keys(df, [key], keep_missing).groupBy(_c(key)).agg(F.avg(no_nan(df, column)).alias("mean"))


def top_groups(df: DataFrame, key: str, k: int = 1) -> DataFrame:
    """Keys with the most rows; ties → smaller key first (as a sorted
    group-by followed by idxmax). ``orderBy + limit`` plans as
    TakeOrderedAndProject: a per-partition top-k, never a global sort."""
    return top_of(group_counts(df, key), key, k)


def top_of(counts: DataFrame, key: str, k: int = 1) -> DataFrame:
    return counts.orderBy(F.col("n").desc(), _c(key).asc_nulls_last()).limit(k)


# Buckets of ``top_groups_bounded``; a row of their table takes 16 bytes.
BOUND_BUCKETS = 1 << 17


def bucketed_keys(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``(key, bucket)`` of the rows whose key is present. Keys that a group-by
    holds equal share a bucket (-0.0 counts as 0.0)."""
    c = _c(key)
    if isinstance(df.schema[key].dataType, (T.DoubleType, T.FloatType)):
        c = c + F.lit(0.0)
    # never NULL, and declared so: no filter on it tells two readings of the counts apart
    bucket = F.coalesce(F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int"), F.lit(0))
    return with_keys(df, [key]).select(_c(key).alias("key"), bucket.alias("bucket"))


def leading_counts(df: DataFrame, key: str, k: int, buckets: int = BOUND_BUCKETS) -> DataFrame:
    """``(key, n)``, exact, of the ``k`` keys with the most rows, all their ties
    and some other keys; not all keys are shuffled.

    A key has at most as many rows as its hash bucket. Pass one counts the rows
    per bucket: ``buckets`` rows a task at most. Pass two counts the keys of the
    ``4 * k`` largest buckets; its k-th largest count is one that k keys reach.
    Pass three counts the keys of the buckets with that many rows, and no others.
    Where keys are so even that no bucket can be left out this is a full group-by
    (and two scans of the key column more); the result is the same. Broadcast are
    bucket numbers, ``buckets`` of them at most.
    """
    rows = bucketed_keys(df, key, buckets)
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size"))

    def counts_in(chosen: DataFrame) -> DataFrame:
        return (rows.join(F.broadcast(chosen.select("bucket")), "bucket", "left_semi")
                .groupBy("key").agg(F.count("*").alias("n")))

    largest = sizes.orderBy(F.col("size").desc(), "bucket").limit(4 * k)
    reached = (counts_in(largest).orderBy(F.col("n").desc()).limit(k)
               .agg(F.when(F.count("*") == k, F.min("n")).otherwise(F.lit(0)).alias("least")).scalar())
    return counts_in(sizes.where(F.col("size") >= reached))


def top_groups_bounded(df: DataFrame, key: str, k: int = 1, buckets: int = BOUND_BUCKETS) -> DataFrame:
    """``top_groups`` for many keys of uneven size: same rows, found by
    ``leading_counts``. No present key: no rows."""
    counts = leading_counts(df, key, k, buckets).select(F.col("key").alias(key), "n")
    return top_of(counts, key, k)


def groups_with_count(df: DataFrame, key: str, n: int = 1) -> DataFrame:
    """Keys with exactly ``n`` rows."""
    return having_of(group_counts(df, key), key, n)


def having_of(counts: DataFrame, key: str, n: int = 1) -> DataFrame:
    return counts.where(F.col("n") == F.lit(n)).select(_c(key))


def group_size_histogram(df: DataFrame, key: str) -> DataFrame:
    """How many keys have 1, 2, ... rows: ``(group_size, n_groups)``."""
    return histogram_of(group_counts(df, key))


def histogram_of(counts: DataFrame) -> DataFrame:
    return (counts.groupBy(F.col("n").alias("group_size"))
            .agg(F.count("*").alias("n_groups"))
            .orderBy("group_size"))


def describe_group_sizes(df: DataFrame, key: str) -> DataFrame:
    """count, mean, std (sample), min, 25/50/75 % (linear interpolation),
    max of the group sizes. Exact ``percentile`` keeps a value → count map;
    group sizes have at most ~sqrt(2 * rows) distinct values, so the final
    merge stays small at any scale."""
    return describe_of(group_counts(df, key))


def describe_of(sizes: DataFrame) -> DataFrame:
    n = F.col("n")
    q = F.percentile(n, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (sizes.agg(F.count("*").alias("count"), F.avg(n).alias("mean"),
                      F.stddev_samp(n).alias("std"), F.min(n).cast("double").alias("min"),
                      q.alias("_q"), F.max(n).cast("double").alias("max"))
            .select("count", "mean", "std", "min",
                    F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("p50"),
                    F.col("_q")[2].alias("p75"), "max"))


def _pattern(col: Column, starts: str | None, ends: str | None) -> Column:
    pred = F.lit(True)
    if starts is not None:
        pred = pred & starts_with(col, starts)
    if ends is not None:
        pred = pred & ends_with(col, ends)
    return pred


def pattern_counts(df: DataFrame, column: str, patterns: dict[str, tuple[str | None, str | None]],
                   per: str = "row") -> DataFrame:
    """Rows (``per="row"``) or distinct keys (``per="key"``) matching each
    named prefix/suffix pattern, all in one aggregate:
    ``patterns={"ends_E": (None, "E"), "starts_8": ("8", None)}``."""
    if per not in ("row", "key"):
        raise ValueError("per must be 'row' or 'key'")
    c = _c(column)
    # per key: keys are made distinct once, with map-side combine, and then
    # every pattern is a count over the keys
    rows = df if per == "row" else df.select(c.alias(column)).distinct()
    return rows.agg(*[F.count_if(_pattern(c, starts, ends)).alias(name)
                      for name, (starts, ends) in patterns.items()])


def discover_patterns(df: DataFrame, column: str, min_rows: int = 1) -> DataFrame:
    """Candidate code patterns with counts: first character, last character
    and shape (digits → 9, letters → A). ``(kind, pattern, n_rows, n_keys)``.
    Pre-aggregated per key first, so each key's rows are counted once before
    the three-way expansion."""
    c = _c(column)
    return patterns_of(df.where(c.isNotNull()).groupBy(c.alias("key")).agg(F.count("*").alias("n")), min_rows)


def patterns_of(per_key: DataFrame, min_rows: int = 1) -> DataFrame:
    """``discover_patterns`` from the rows per key: ``(key, n)``."""
    k = F.col("key")
    kinds = F.array(
        F.struct(F.lit("first_char").alias("kind"), F.substring(k, 1, 1).alias("pattern")),
        F.struct(F.lit("last_char").alias("kind"), F.substring(k, -1, 1).alias("pattern")),
        F.struct(F.lit("shape").alias("kind"), shape_mask(k).alias("pattern")))
    return (per_key.select("n", F.explode(kinds).alias("p"))
            .groupBy(F.col("p.kind").alias("kind"), F.col("p.pattern").alias("pattern"))
            .agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"))
            .where(F.col("n_rows") >= F.lit(min_rows)))


# -- many groupings in one pass --------------------------------------------------

def group_states(df: DataFrame, means: dict[str, Sequence[str]]) -> DataFrame:
    """Mergeable states of several groupings of one table, by one scan and one
    shuffle of groups: for each key column of ``means``, rows per key and, for
    the columns named with it, sum and count of the present values.

    ``(grouping, k<j>, n, sum_<i>, cnt_<i>)``: a row per grouping and key;
    ``grouping`` is the key's position ``j`` in ``means``, ``i`` numbers the
    different columns. GROUPING SETS: every map task combines its rows for all
    keys before the shuffle, so raw rows are not shuffled. Missing keys (NULL,
    NaN) are groups here and left out by ``states_of``.
    """
    keys = list(means)
    columns = sorted({c for cs in means.values() for c in cs})
    source = df.select(*[no_nan(df, k).alias(f"k{i}") for i, k in enumerate(keys)],
                       *[no_nan(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    names = [f"k{i}" for i in range(len(keys))]
    aggs = [F.count("*").alias("n")]
    for i in range(len(columns)):
        aggs += [F.sum(f"v{i}").alias(f"sum_{i}"), F.count(f"v{i}").alias(f"cnt_{i}")]
    ones = (1 << len(keys)) - 1                  # grouping_id has a 0 where a key is grouped by
    which = F.lit(None).cast("int")
    for i in range(len(keys)):
        which = F.when(F.col("__gid") == ones - (1 << (len(keys) - 1 - i)), i).otherwise(which)
    grouped = source.groupingSets([[F.col(k)] for k in names], *names).agg(F.grouping_id().alias("__gid"), *aggs)
    return grouped.select(which.alias("grouping"), *names, *[c for c in grouped.columns
                                                             if c not in (*names, "__gid")])


def states_of(states: DataFrame, means: dict[str, Sequence[str]], key: str) -> DataFrame:
    """One grouping of ``group_states``: the key under its name, ``n`` and, per
    column, ``sum_<i>`` and ``cnt_<i>``."""
    i = list(means).index(key)
    rows = states.where(F.col("grouping") == i).where(F.col(f"k{i}").isNotNull())
    return rows.select(F.col(f"k{i}").alias(key), *[c for c in states.columns if c == "n" or c[:4] in ("sum_", "cnt_")])


def mean_of(one: DataFrame, means: dict[str, Sequence[str]], key: str, column: str) -> DataFrame:
    i = sorted({c for cs in means.values() for c in cs}).index(column)
    return one.select(_c(key), F.try_divide(F.col(f"sum_{i}").cast("double"), F.col(f"cnt_{i}")).alias("mean"))


def percentage(df: DataFrame, predicate: Column | str) -> DataFrame:
    """100 × matching / total; 0 for an empty table."""
    return _agg(df, percentage_aggs(df, predicate))


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson r over complete pairs (NaN counts as missing)."""
    return _agg(df, correlation_aggs(df, x, y))


def regression(df: DataFrame, x: str, y: str, by: str | Sequence[str] | None = None) -> DataFrame:
    """Least-squares line ``y = slope·x + intercept`` (per group with
    ``by``); constant x → NULL slope."""
    named = regression_aggs(df, x, y)
    if by is None:
        return _agg(df, named)
    keys = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*[_c(k) for k in keys]).agg(*[c.alias(n) for n, c in named])


# op name → (name, expression) builder, for fusing scalar tasks
SCALAR_AGGS = {
    "row_count": row_count_aggs, "filtered_count": filtered_count_aggs,
    "count_distinct": count_distinct_aggs, "global_mean": global_mean_aggs,
    "min_max": min_max_aggs, "percentage": percentage_aggs,
    "correlation": correlation_aggs, "regression": regression_aggs,
}


def delay_trend(df: DataFrame, start: str, end: str, year: Column | str | None = None,
                where: Column | str | None = None) -> tuple[DataFrame, DataFrame]:
    """Days from ``start`` to ``end`` (sign kept) against year.

    Only rows with a year and both dates count. Returns ``(summary, by_year)``: summary rows ``(method, slope,
    intercept)`` for the row-level fit of delay on year and for the fit of
    the per-year mean delays (the question has both readings);
    ``by_year`` has ``(year, n, avg_delay)``. Year defaults to the year of
    ``start``.
    """
    if where is not None:
        df = df.where(F.expr(where) if isinstance(where, str) else where)
    yr = F.year(_c(start)) if year is None else (F.col(year) if isinstance(year, str) else year)
    rows = df.select(yr.cast("int").alias("year"),
                     F.datediff(_c(end).cast("date"), _c(start).cast("date")).cast("double").alias("delay"))
    rows = rows.where(F.col("year").isNotNull() & F.col("delay").isNotNull())
    # Both fits come from one grouped pass: a year's rows share their x, so the
    # row-level fit needs each year's count and mean only, and its sums are one
    # aggregate over the per-year table.
    by_year = rows.groupBy("year").agg(F.count("delay").alias("n"), F.avg("delay").alias("avg_delay"))
    x, n, m = F.col("year").cast("double"), F.col("n").cast("double"), F.col("avg_delay")
    base = F.lit(2000.0)          # years near zero, so that the plain sums do not cancel
    u = x - base
    sums = by_year.agg(F.sum(n).alias("w"), F.sum(n * u).alias("wx"), F.sum(n * m).alias("wy"),
                       F.sum(n * u * u).alias("wxx"), F.sum(n * u * m).alias("wxy"),
                       F.regr_slope(m, x).alias("s2"), F.regr_intercept(m, x).alias("i2"))
    det = F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx")
    slope = F.when(det > 0, (F.col("w") * F.col("wxy") - F.col("wx") * F.col("wy")) / det)
    fits = sums.select(slope.alias("s1"),
                       ((F.col("wy") - slope * F.col("wx")) / F.col("w") - slope * base).alias("i1"), "s2", "i2")
    summary = fits.select(F.explode(F.array(
        F.struct(F.lit("row_level").alias("method"), F.col("s1").alias("slope"), F.col("i1").alias("intercept")),
        F.struct(F.lit("of_year_means").alias("method"), F.col("s2").alias("slope"),
                 F.col("i2").alias("intercept")))).alias("f")).select("f.*")
    return summary, by_year


def chi_square(df: DataFrame, a: str, b: str, with_p_value: bool = True) -> DataFrame:
    """Pearson chi-square test of independence of two categorical columns.

    The contingency table (one row per observed pair) and the marginals
    are Spark aggregates; expected counts come from joining the marginals
    back (equi-joins on the category). Unobserved pairs need no rows: over
    all cells ``sum((o-e)^2/e) = sum_observed(o^2/e) - n``. Output
    ``(statistic, dof, n[, p_value])``.
    """
    pairs = (df.where(_c(a).isNotNull() & _c(b).isNotNull())
             .groupBy(_c(a).alias("a"), _c(b).alias("b")).agg(F.count("*").alias("o")))
    ra = pairs.groupBy("a").agg(F.sum("o").alias("ra"))
    cb = pairs.groupBy("b").agg(F.sum("o").alias("cb"))
    # e = ra*cb/n, so sum_obs(o^2/e) - n = n * sum_obs(o^2/(ra*cb)) - n
    o = F.col("o").cast("double")
    sums = (pairs.join(ra, "a").join(cb, "b")
            .agg(F.sum("o").cast("double").alias("n"),
                 F.sum(o * o / (F.col("ra").cast("double") * F.col("cb").cast("double"))).alias("s"),
                 F.count_distinct("a").alias("ka"), F.count_distinct("b").alias("kb")))
    out = sums.select(
        (F.col("n") * F.col("s") - F.col("n")).alias("statistic"),
        ((F.col("ka") - 1) * (F.col("kb") - 1)).cast("bigint").alias("dof"),
        F.col("n").cast("bigint").alias("n"))
    if with_p_value:
        from tablework.operators.special import chi2_sf
        out = out.withColumn("p_value", chi2_sf(F.col("statistic"), F.col("dof")))
    return out


def fit_linear(df: DataFrame, features: Sequence[str], label: str,
               prediction_col: str = "prediction"):
    """Multi-feature least squares (``pyspark.ml`` LinearRegression, normal
    equations: one distributed pass for the Gram matrix). Rows with a
    missing feature or label are left out; other columns are kept next to
    the prediction. Returns ``(model, scored_df, summary_df)``."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    model_cols = set(features) | {label}
    data = df.select(*[_c(c) for c in df.columns if c not in model_cols],
                     *[_finite(_c(f)).alias(f) for f in features],
                     _finite(_c(label)).alias(label)).na.drop(subset=list(features) + [label])
    vec = VectorAssembler(inputCols=list(features), outputCol="__features").transform(data)
    model = LinearRegression(featuresCol="__features", labelCol=label, solver="normal",
                             predictionCol=prediction_col, regParam=0.0).fit(vec)
    scored = model.transform(vec).drop("__features")
    spark = df.sparkSession
    s = model.summary
    summary = spark.createDataFrame(
        [(f, float(c)) for f, c in zip(features, model.coefficients)]
        + [("intercept", float(model.intercept)), ("r2", float(s.r2)),
           ("rmse", float(s.rootMeanSquaredError))],
        "term STRING, value DOUBLE")
    return model, scored, summary


def fit_groups(df: DataFrame, features: Sequence[str], label: str, by: Sequence[str] = ()) -> DataFrame:
    """Least squares of ``label`` on several features, a model per group of ``by``
    (or one): ``(<by>, n, intercept, coefficients, r2)``.

    One lazy pass: means and the centred Gram matrix are aggregates whose states
    merge (``avg``, ``covar_pop``), so each group is one row of
    ``(p + 1) * (p + 2) / 2`` numbers, whatever it holds, and is solved where it
    lies (Cholesky). Rows with a missing value (NULL, NaN) in any model column are
    left out. A group whose features are dependent (or with fewer rows than needed)
    has NULL coefficients; a constant label has NULL ``r2``.
    """
    import numpy as np
    import pandas as pd
    names = [*features, label]
    p = len(features)
    cols = [_finite(_c(c)).alias(f"__x{i}") for i, c in enumerate(names)]
    rows = df.select(*[_c(b) for b in by], *cols).na.drop(subset=[f"__x{i}" for i in range(p + 1)])
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    gram = rows.groupBy(*[_c(b) for b in by]).agg(
        F.count("*").alias("n"), F.array(*[F.avg(f"__x{i}") for i in range(p + 1)]).alias("__m"),
        F.array(*[F.covar_pop(f"__x{i}", f"__x{j}") for i, j in pairs]).alias("__g")).where("n > 0")
    schema = T.StructType([*[df.schema[b] for b in by], T.StructField("n", T.LongType()),
                           T.StructField("intercept", T.DoubleType()),
                           T.StructField("coefficients", T.ArrayType(T.DoubleType())),
                           T.StructField("r2", T.DoubleType())])

    def solve(mean, gram_row) -> tuple:
        g = np.zeros((p + 1, p + 1))
        for (i, j), v in zip(pairs, gram_row):
            g[i, j] = g[j, i] = v
        scale = np.sqrt(np.diag(g)[:p])
        if not (scale > 0).all():
            return None, None, None
        a = g[:p, :p] / np.outer(scale, scale)          # correlations: a scale-free test of rank
        try:
            half = np.linalg.cholesky(a)
        except np.linalg.LinAlgError:
            return None, None, None
        if half.diagonal().min() < 1e-6:
            return None, None, None
        b = np.linalg.solve(half.T, np.linalg.solve(half, g[:p, p] / scale)) / scale
        r2 = float(b @ g[:p, p] / g[p, p]) if g[p, p] > 0 else None
        return float(mean[p] - b @ np.asarray(mean[:p])), b.tolist(), r2

    def run(batches):
        for pdf in batches:
            got = [solve(list(m), list(g)) for m, g in zip(pdf["__m"], pdf["__g"])]
            out = pdf[[*by, "n"]].copy()
            for k, c in enumerate(("intercept", "coefficients", "r2")):
                out[c] = pd.Series([r[k] for r in got], index=out.index, dtype=object)
            yield out

    return gram.mapInPandas(run, schema)
