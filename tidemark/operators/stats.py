"""Tests, correlations, regression and corrections over groups, as sums that Spark adds up in part before shuffling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.checkpoints import checkpoint

#: Rows of a key that are ordered in one task at most.
WINDOW_ROWS = 1_000_000


def _zero(x: Column) -> Column:
    return F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(0.0))


def one_sample_t(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, n, t): sqrt(n) mean / deviation; 0 if undefined."""
    t = F.try_divide(F.sqrt(F.count(value)) * F.avg(value), F.stddev_samp(value))
    return df.groupBy(*by).agg(F.count(value).alias("n"), _zero(t).alias("t"))


def paired_t(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    return one_sample_t(df.withColumn("_d", F.col(a) - F.col(b)), "_d", by)


def welch_t(df: DataFrame, value: str, is_first: Column, by: list[str]) -> DataFrame:
    """(by, t, dof) of two groups with their own variances."""
    x, y = F.when(is_first, F.col(value)), F.when(~is_first, F.col(value))
    m = df.groupBy(*by).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), (F.var_samp(x) / F.count(x)).alias("vx"), (F.var_samp(y) / F.count(y)).alias("vy"), F.count(x).alias("nx"), F.count(y).alias("ny"))
    dof = F.try_divide(F.pow(F.col("vx") + F.col("vy"), 2), F.pow("vx", 2) / (F.col("nx") - 1) + F.pow("vy", 2) / (F.col("ny") - 1))
    return m.select(*by, F.try_divide(F.col("mx") - F.col("my"), F.sqrt(F.col("vx") + F.col("vy"))).alias("t"), dof.alias("dof"))


def correlation_matrix(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, a, b, r) for each pair of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = df.groupBy(*(by or [])).agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs)))
    return wide.select(*(by or []), each.alias("x")).select(*(by or []), "x.a", "x.b", "x.r")


def fisher_z(r: Column) -> Column:
    return F.atanh(r)


def correlation_t(r: Column, n: Column) -> Column:
    return F.when(F.abs(r) > 1, 0.0).otherwise(r * F.sqrt(F.try_divide(n - 2, 1 - r * r)))


def independent_z(r1: Column, n1: Column, r2: Column, n2: Column) -> Column:
    return (F.atanh(r1) - F.atanh(r2)) / F.sqrt(1 / (n1 - 3) + 1 / (n2 - 3))


def kendall_tau(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by, tau) over pairs tied in neither, from counts of distinct value pairs of each group. Pairs are judged within
    blocks of one group, so it suits groups of bounded size; a group's points are never collected."""
    points = df.groupBy(*by, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    other = points.select(*by, F.col("x").alias("u"), F.col("y").alias("v"), F.col("n").alias("m"))
    sign = F.signum(F.col("x") - F.col("u")) * F.signum(F.col("y") - F.col("v"))
    return points.join(other, by).where("x > u").groupBy(*by).agg(F.try_divide(F.sum(sign * F.col("n") * F.col("m")), F.sum(F.abs(sign) * F.col("n") * F.col("m"))).alias("tau"))


def stouffer(df: DataFrame, z: str, by: list[str], weight: str | None = None) -> DataFrame:
    w = F.lit(1.0) if weight is None else F.col(weight)
    return df.groupBy(*by).agg((F.sum(w * F.col(z)) / F.sqrt(F.sum(w * w))).alias("z"))


def ols_simple(df: DataFrame, y: str, x: str, by: list[str]) -> DataFrame:
    """(by, slope, intercept, r2, t) of y on x with an intercept, from sums."""
    n = F.regr_count(y, x)
    residual = (F.regr_syy(y, x) - F.pow(F.regr_sxy(y, x), 2) / F.regr_sxx(y, x)) / (n - 2)
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.try_divide(F.regr_slope(y, x), F.sqrt(F.try_divide(residual, F.regr_sxx(y, x)))).alias("t"))


def ols_two(df: DataFrame, y: str, x1: str, x2: str, by: list[str], contrast: tuple[float, float] = (1.0, -1.0)) -> DataFrame:
    """(by, b1, b2, contrast, t) of y on two predictors and an intercept: normal equations from centred sums."""
    s = df.groupBy(*by).agg(F.covar_pop(x1, x1).alias("s11"), F.covar_pop(x2, x2).alias("s22"), F.covar_pop(x1, x2).alias("s12"), F.covar_pop(x1, y).alias("s1y"), F.covar_pop(x2, y).alias("s2y"), F.covar_pop(y, y).alias("syy"), F.count(F.lit(1)).alias("n"))
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    b1 = F.try_divide(F.col("s1y") * F.col("s22") - F.col("s2y") * F.col("s12"), det)
    b2 = F.try_divide(F.col("s2y") * F.col("s11") - F.col("s1y") * F.col("s12"), det)
    s = s.withColumn("b1", b1).withColumn("b2", b2)
    c1, c2 = map(F.lit, contrast)
    variance = F.try_divide(F.col("n") * (F.col("syy") - F.col("b1") * F.col("s1y") - F.col("b2") * F.col("s2y")), F.col("n") - 3)
    spread = F.try_divide(c1 * c1 * F.col("s22") - 2 * c1 * c2 * F.col("s12") + c2 * c2 * F.col("s11"), F.col("n") * det)
    value = c1 * F.col("b1") + c2 * F.col("b2")
    return s.select(*by, "b1", "b2", value.alias("contrast"), F.try_divide(value, F.sqrt(variance * spread)).alias("t"))


def jackknife_mean(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, estimate, sd): mean of pseudo-values c mean - (c - 1) mean without one, and sqrt(sum sq / (c (c - 1)))."""
    w = Window.partitionBy(*by)
    n, total = F.count(value).over(w), F.sum(value).over(w)
    pseudo = df.withColumn("_p", total - (n - 1) * F.try_divide(total - F.col(value), (n - 1).cast("double")))
    return pseudo.groupBy(*by).agg(F.avg("_p").alias("estimate"), F.sqrt(F.try_divide(F.var_samp("_p"), F.count("_p").cast("double"))).alias("sd"))


def running_sum(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the same keys up to each row's ``order``, of which a key has each value once.

    Up to WINDOW_ROWS rows of a key that is a window. Beyond, rows are cut into ranges of (by, order), summed in each range,
    and the sums of the ranges before are added, so no key's rows meet in one task."""
    most = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if most <= WINDOW_ROWS:
        return df.withColumn(name, F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    cut = checkpoint(df.repartitionByRange(*by, order).withColumn("_range", F.spark_partition_id()))
    own = Window.partitionBy("_range", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("_range", *by).agg(F.sum(value).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    sums = sums.select(F.col("_range").alias("_r"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(by)), "_before")
    on = cut["_range"] == sums["_r"]
    for i, k in enumerate(by):
        on = on & cut[k].eqNullSafe(sums[f"_k{i}"])
    return cut.withColumn("_own", F.sum(value).over(own)).join(sums, on).withColumn(name, F.col("_own") + F.col("_before")).select(*df.columns, name)


def _with_totals(df: DataFrame, by: list[str], **sums: str) -> DataFrame:
    """The rows with sums over their keys, joined on from sums in parts."""
    t = df.groupBy(*(F.col(k).alias(f"_t{i}") for i, k in enumerate(by))).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    if not by:
        return df.join(F.broadcast(t))  # one row
    on = F.lit(True)
    for i, k in enumerate(by):
        on = on & df[k].eqNullSafe(t[f"_t{i}"])
    return df.join(t, on).drop(*(f"_t{i}" for i in range(len(by))))


def fdr(df: DataFrame, p: str, by: list[str], level: float, dependent: bool = False) -> DataFrame:
    """(by, threshold): the largest p_i with p_i n / i <= level over sorted p, with level / (ln n + 0.5772) if dependent;
    p_1 / 2.001 if there is none. Ties share the last of their ranks; counts come from distinct p, not from a global sort."""
    counts = df.groupBy(*by, F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_k"))
    ranked = _with_totals(running_sum(counts, by, "_p", "_k", "_i"), by, _n="_k")
    q = F.lit(level) / (F.log("_n") + 0.5772) if dependent else F.lit(level)
    return ranked.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("_p") * F.col("_n") / F.col("_i") <= q, F.col("_p"))), F.min("_p") / 2.001).alias("threshold"))


def roc_area(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """(by, area) by ranks, ties averaged."""
    counts = df.groupBy(*by, F.col(score).alias("_s")).agg(F.sum(F.col(label)).alias("_p"), F.sum(1 - F.col(label)).alias("_q"))
    won = running_sum(counts, by, "_s", "_q", "_to").withColumn("_won", F.col("_p") * (F.col("_to") - F.col("_q") / F.lit(2.0)))
    return won.groupBy(*by).agg(F.try_divide(F.sum("_won"), (F.sum("_p") * F.sum("_q")).cast("double")).alias("area"))


def harmonic_mean(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    return df.where(F.col(value) != 0).groupBy(*by).agg((F.count(value) / F.sum(1 / F.col(value))).alias("mean"))


def moments(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, mean, sd, skew, kurtosis): population skewness, and kurtosis with 3 for a normal."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.skewness(value).alias("skew"), (F.kurtosis(value) + 3).alias("kurtosis"))


def second_level_t(df: DataFrame, subject: str, value: str, by: list[str]) -> DataFrame:
    """Means of each subject, then sqrt(n) mean / deviation over subjects."""
    return one_sample_t(df.groupBy(*by, subject).agg(F.avg(value).alias("_b")), "_b", by)


def anova_oneway(df: DataFrame, value: str, group: str, by: list[str] | None = None) -> DataFrame:
    """(by, f, df_between, df_within) from sums of squares of the groups."""
    by = by or []
    g = df.groupBy(*by, group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_pop(value) * F.count(value), F.lit(0.0)).alias("ss"))
    s = g.groupBy(*by).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("ss").alias("within"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), 2) / F.sum("n")).alias("between"))
    return s.select(*by, F.try_divide(F.col("between") / (F.col("k") - 1), F.try_divide(F.col("within"), (F.col("n") - F.col("k")).cast("double"))).alias("f"), (F.col("k") - 1).alias("df_between"), (F.col("n") - F.col("k")).alias("df_within"))


def variance_inflation(df: DataFrame, x1: str, x2: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.try_divide(F.lit(1.0), 1 - F.pow(F.corr(x1, x2), 2)).alias("vif"))


def conjunction(values: list[Column]) -> Column:
    """Smallest absolute value with its sign where all have one sign, else 0."""
    low, high = F.least(*values), F.greatest(*values)
    return F.when(low > 0, low).when(high < 0, high).otherwise(0.0)


def count_test(df: DataFrame, count: str, is_first: Column, by: list[str]) -> DataFrame:
    """(by, z): abs(X - Y) / sqrt(X + Y) over the totals of two conditions."""
    x, y = F.sum(F.when(is_first, F.col(count)).otherwise(0)), F.sum(F.when(~is_first, F.col(count)).otherwise(0))
    return df.groupBy(*by).agg(F.try_divide(F.abs(x - y).cast("double"), F.sqrt((x + y).cast("double"))).alias("z"))


def pooled_groups(df: DataFrame, value: str, group: str, weights: dict, by: list[str] | None = None) -> DataFrame:
    """(by, estimate, se, dof, t): a weighted contrast of the groups' means with the variance pooled over all groups, from
    counts, sums and squares. Groups without a weight count for the variance alone."""
    by = by or []
    g = df.where(F.col(value).isNotNull()).groupBy(*by, group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_pop(value) * F.count(value), F.lit(0.0)).alias("q"))
    w = F.lit(0.0)
    for k, v in weights.items():
        w = F.when(F.col(group) == F.lit(k), F.lit(float(v))).otherwise(w)
    s = g.withColumn("w", w).groupBy(*by).agg(F.sum(F.col("w") * F.col("m")).alias("estimate"), F.sum(F.col("w") * F.col("w") / F.col("n")).alias("_v"), F.sum("q").alias("_q"), (F.sum("n") - F.count(F.lit(1))).alias("dof"))
    se = F.sqrt(F.try_divide("_q", F.col("dof").cast("double")) * F.col("_v"))
    return s.select(*by, "estimate", se.alias("se"), "dof", F.try_divide(F.col("estimate"), se).alias("t"))
