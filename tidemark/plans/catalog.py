"""All queries of the library over the supplied tables, by name, and the SQL that checks them.

Stand-ins: events are point processes (user = channel, type = unit, value = amplitude), orders are trials (priority =
condition), lines of an order are samples (line number = index, quantity = value), embeddings are waveforms. Real
numbers are rounded on both sides, since sums depend on the order of their terms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import codes
from tidemark.operators import bins, intervals, maps, models, sets, sorting, stats, waveforms, windows

MINUTE = 60_000_000
HOUR = 60 * MINUTE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, and the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(x: Column | str, digits: int = 4) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time in microseconds."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as samples of trials; doubled line numbers are averaged."""
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy(F.col("l_orderkey").alias("trial"), F.col("l_linenumber").alias("i")).agg(F.avg("l_quantity").alias("v"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trial"), F.col("o_orderpriority").alias("cond"), F.col("o_custkey").alias("subject"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("day"))


E_SQL = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us FROM events)"
S_SQL = "s AS (SELECT l_orderkey AS trial, l_linenumber AS i, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"


# --- point processes around events -------------------------------------------------------------------------------


def _markers(e: DataFrame) -> DataFrame:
    return e.where("event_type = 'purchase'").select("user_id", F.col("us").alias("m"), F.col("event_id").alias("marker"))


@query(f"""WITH {E_SQL}, m AS (SELECT user_id, us AS m FROM e WHERE event_type = 'purchase'),
p AS (SELECT * FROM e WHERE event_type <> 'purchase'),
c AS (SELECT event_type, CAST(floor((us - m + {6 * HOUR}) / {HOUR}.0) AS BIGINT) AS bin, count(*) AS n
      FROM p JOIN m ON p.user_id = m.user_id AND us >= m - {6 * HOUR} AND us < m + {6 * HOUR} GROUP BY 1, 2),
b AS (SELECT event_type, CAST(range AS BIGINT) AS bin FROM (SELECT DISTINCT event_type FROM p), range(12)),
f AS (SELECT b.event_type, b.bin, coalesce(n, 0) AS n, coalesce(n, 0) / (SELECT count(*) FROM m)::DOUBLE AS mean FROM b LEFT JOIN c USING (event_type, bin))
SELECT event_type, bin, CAST(n AS BIGINT) AS n, round(mean, 6) + 0.0 AS mean, round(coalesce(mean / nullif(max(mean) OVER (PARTITION BY event_type), 0), 0), 6) + 0.0 AS norm FROM f""")
def psth_marker(spark, sf_dir):
    e = events(spark, sf_dir)
    out = bins.psth(e.where("event_type != 'purchase'"), _markers(e), "us", "m", "event_type", 6 * HOUR, 6 * HOUR, HOUR, ["user_id"])
    return out.select("event_type", "bin", F.col("n").cast("long").alias("n"), r("mean", 6).alias("mean"), r("norm", 6).alias("norm"))


@query(f"""WITH {E_SQL} SELECT p.event_id, m.event_id AS marker, p.us - m.us AS lag FROM e p JOIN e m
ON p.user_id = m.user_id AND p.event_type = 'error' AND m.event_type = 'purchase' AND p.us > m.us - {HOUR} AND p.us <= m.us + {2 * HOUR}""")
def peri_event_window(spark, sf_dir):
    e = events(spark, sf_dir)
    return intervals.peri_event(e.where("event_type = 'error'"), _markers(e), "us", "m", HOUR, 2 * HOUR, ["user_id"], "right").select("event_id", "marker", "lag")


@query(f"""WITH {E_SQL} SELECT event_id, max(CASE WHEN event_type = 'signup' THEN value END) OVER w0 AS marker_value FROM (
  SELECT *, count(CASE WHEN event_type = 'signup' THEN 1 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS seg FROM e) x WINDOW w0 AS (PARTITION BY user_id, seg)""")
def asof_marker(spark, sf_dir):
    return intervals.asof_last(events(spark, sf_dir), F.col("event_type") == "signup", "us", ["user_id"], F.col("value"), "marker_value", ["event_id"]).select("event_id", "marker_value")


@query(f"""WITH {E_SQL} SELECT user_id, segment, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM (
  SELECT *, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM e) GROUP BY 1, 2""")
def trial_segments(spark, sf_dir):
    s = intervals.segment_by_marker(events(spark, sf_dir), F.col("event_type") == "signup", "us", ["user_id"], ["event_id"])
    return s.groupBy("user_id", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query(f"""WITH {E_SQL}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) > {12 * HOUR} THEN 1 ELSE 0 END AS fresh FROM e),
p AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS BIGINT) AS part FROM g)
SELECT user_id, part, count(*) AS n FROM p GROUP BY 1, 2""")
def split_by_pause(spark, sf_dir):
    return intervals.split_by_gap(events(spark, sf_dir), "us", ["user_id"], 12 * HOUR).groupBy("user_id", "part").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {S_SQL}, t AS (SELECT trial, min(i) + 1 AS align FROM s GROUP BY 1)
SELECT s.trial, CAST(s.i - t.align AS BIGINT) AS k, round(v, 4) + 0.0 AS v FROM s JOIN t ON s.trial = t.trial AND s.i BETWEEN t.align - 1 AND t.align + 2""")
def interval_slice(spark, sf_dir):
    s = samples(spark, sf_dir)
    t = s.groupBy("trial").agg((F.min("i") + 1).alias("align"))
    return intervals.slice_samples(s, t, "i", "align", -1, 2, ["trial"]).select("trial", F.col("k").cast("long").alias("k"), r("v").alias("v"))


@query("""SELECT cond, count(*) AS n_repeats, round(avg(c), 6) + 0.0 AS mean_count, round(stddev_samp(c) / sqrt(count(*)), 6) + 0.0 AS sem FROM (
  SELECT o_orderpriority AS cond, l_orderkey, count(*) AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) GROUP BY 1""")
def spike_count_by_condition(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey").join(trials(spark, sf_dir), F.col("l_orderkey") == F.col("trial"))
    out = bins.count_by_condition(line, ["cond"], "trial")
    return out.select("cond", "n_repeats", r("mean_count", 6).alias("mean_count"), r("sem", 6).alias("sem"))


@query(f"""WITH {E_SQL}, d AS (SELECT event_type, us - lag(us) OVER (PARTITION BY event_type ORDER BY us) AS isi FROM e)
SELECT event_type, CAST(floor((isi + {MINUTE / 2}) / {MINUTE}.0) AS BIGINT) AS bin, count(*) AS n FROM d WHERE isi <= {HOUR} GROUP BY 1, 2""")
def isi_histogram(spark, sf_dir):
    return bins.isi_histogram(events(spark, sf_dir), "us", ["event_type"], MINUTE, HOUR)


@query(f"""WITH {E_SQL}, d AS (SELECT event_type, us - lag(us) OVER (PARTITION BY event_type ORDER BY us) AS isi FROM e)
SELECT event_type, count(*) AS n_spikes, count(*) FILTER (isi < {2 * MINUTE}) AS n_violations, round(count(*) FILTER (isi < {2 * MINUTE}) / count(*)::DOUBLE, 6) + 0.0 AS share FROM d GROUP BY 1""")
def isi_refractory_violations(spark, sf_dir):
    return bins.refractory_share(events(spark, sf_dir), "us", ["event_type"], 2 * MINUTE).withColumn("share", r("share", 6))


@query(f"""WITH {E_SQL}, d AS (SELECT event_type, us, us - lag(us) OVER (PARTITION BY event_type ORDER BY us) AS isi FROM e),
a AS (SELECT event_type, count(*) AS n_spikes, count(*) FILTER (isi < {2 * MINUTE}) AS n_violations, max(us) - min(us) AS span FROM d GROUP BY 1)
SELECT event_type, n_spikes, n_violations, round(least(coalesce(n_violations / nullif({4 * MINUTE}.0 * n_spikes * n_spikes / span, 0), 0), 1), 6) + 0.0 AS contamination FROM a""")
def rpv_contamination(spark, sf_dir):
    return bins.contamination(events(spark, sf_dir), "us", ["event_type"], 2 * MINUTE).withColumn("contamination", r("contamination", 6))


_CCG = f"""{E_SQL}, c AS (SELECT CAST(floor((a.us - b.us + {5 * MINUTE}) / {10 * MINUTE}.0) AS BIGINT) AS lag, count(*) AS n FROM e a JOIN e b
ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view' AND b.us - a.us BETWEEN -{2 * HOUR} AND {2 * HOUR} GROUP BY 1)"""


def _ccg(spark, sf_dir):
    e = events(spark, sf_dir)
    return bins.correlogram(e.where("event_type = 'click'").select("user_id", "us"), e.where("event_type = 'view'").select("user_id", "us"), "us", ["user_id"], 2 * HOUR, 10 * MINUTE)


@query(f"WITH {_CCG} SELECT lag, n FROM c")
def ccg_raw(spark, sf_dir):
    return _ccg(spark, sf_dir)


@query(f"WITH {_CCG} SELECT lag, round(n / sqrt((SELECT count(*) FROM e WHERE event_type = 'click')::DOUBLE * (SELECT count(*) FROM e WHERE event_type = 'view')), 6) + 0.0 AS c FROM c")
def ccg_norm_geometric(spark, sf_dir):
    e = events(spark, sf_dir)
    n = e.agg(F.count_if(F.col("event_type") == "click"), F.count_if(F.col("event_type") == "view")).first()
    return bins.correlogram_norm(_ccg(spark, sf_dir), n[0], n[1]).select("lag", r("c", 6).alias("c"))


@query(f"""WITH {E_SQL}, x AS (SELECT user_id, CAST(floor((us % {24 * HOUR}) / {HOUR}.0) AS BIGINT) AS bin, event_type FROM e WHERE event_type IN ('click', 'view')),
a AS (SELECT user_id, bin, count(*) AS n FROM x WHERE event_type = 'click' GROUP BY 1, 2), b AS (SELECT user_id, bin, count(*) AS n FROM x WHERE event_type = 'view' GROUP BY 1, 2),
k AS (SELECT count(DISTINCT user_id) AS k FROM x)
SELECT a.bin - b.bin AS lag, round(sum(CASE WHEN a.user_id <> b.user_id THEN a.n * b.n ELSE 0 END) / (k * (k - 1.0)), 6) + 0.0 AS mean FROM a, b, k GROUP BY 1, k""")
def shift_predictor(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("us", F.pmod("us", F.lit(24 * HOUR)))
    return bins.shift_predictor(e.where("event_type = 'click'"), e.where("event_type = 'view'"), "us", "user_id", HOUR, 23).select("lag", r("mean", 6).alias("mean"))


@query(f"""WITH {E_SQL}, g AS (SELECT DISTINCT (us // {6 * HOUR}) * {6 * HOUR} AS g FROM e),
p AS (SELECT g, sum(exp(-0.5 * ((us - g) / {HOUR}.0) * ((us - g) / {HOUR}.0)) / ({HOUR}.0 * sqrt(2 * pi()))) AS rate FROM g JOIN e ON e.event_type = 'click' AND us BETWEEN g - {4 * HOUR} AND g + {4 * HOUR} GROUP BY 1)
SELECT g, round(coalesce(rate, 0) * {HOUR}, 6) + 0.0 AS rate FROM g LEFT JOIN p USING (g)""")
def kernel_rate(spark, sf_dir):
    e = events(spark, sf_dir)
    grid = e.select((F.floor(F.col("us") / F.lit(6 * HOUR)) * (6 * HOUR)).alias("g")).distinct()
    return bins.kernel_rate(e.where("event_type = 'click'"), "us", grid, "g", float(HOUR)).select("g", r(F.col("rate") * HOUR, 6).alias("rate"))


# --- windows over samples ----------------------------------------------------------------------------------------


@query(f"""WITH {S_SQL}, w AS (SELECT *, lag(v) OVER (PARTITION BY trial ORDER BY i) AS was FROM s)
SELECT trial, i, round(v, 4) + 0.0 AS v FROM w WHERE v > 30 AND was IS NOT NULL AND NOT was > 30""")
def threshold_crossings(spark, sf_dir):
    return windows.crossings(samples(spark, sf_dir), "v", ["trial"], ["i"], 30.0).select("trial", "i", r("v").alias("v"))


@query(f"""WITH {S_SQL}, w AS (SELECT *, lag(v) OVER (PARTITION BY trial ORDER BY i) AS was FROM s)
SELECT trial, min(i) AS edge FROM w WHERE v > 25 AND was <= 25 GROUP BY 1""")
def edge_onset_first(spark, sf_dir):
    return windows.first_edge(samples(spark, sf_dir), "v", ["trial"], ["i"], 25.0)


@query(f"""WITH {S_SQL} SELECT trial, i, round(v * v - lag(v) OVER w * lead(v) OVER w, 4) + 0.0 AS energy FROM s WINDOW w AS (PARTITION BY trial ORDER BY i)""")
def nonlinear_energy(spark, sf_dir):
    return windows.nonlinear_energy(samples(spark, sf_dir), "v", ["trial"], ["i"]).select("trial", "i", r("energy").alias("energy"))


@query(f"""WITH {S_SQL} SELECT trial, i, round(-0.3 * (coalesce(lag(v) OVER w, v) - 2 * v + coalesce(lead(v) OVER w, v)), 4) + 0.0 AS csd FROM s WINDOW w AS (PARTITION BY trial ORDER BY i)""")
def second_difference_csd(spark, sf_dir):
    return windows.second_difference(samples(spark, sf_dir), "v", ["trial"], ["i"]).select("trial", "i", r("csd").alias("csd"))


@query(f"""WITH {S_SQL} SELECT trial, i, round(0.23 * coalesce(lag(v) OVER w, 0) + 0.54 * v + 0.23 * coalesce(lead(v) OVER w, 0), 4) + 0.0 AS smooth FROM s WINDOW w AS (PARTITION BY trial ORDER BY i)""")
def three_point_filter(spark, sf_dir):
    return windows.three_point_filter(samples(spark, sf_dir), "v", ["trial"], ["i"]).select("trial", "i", r("smooth").alias("smooth"))


@query(f"""WITH {S_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY i) AS n FROM s)
SELECT trial, i, round(v - avg(v) FILTER (n <= 2) OVER (PARTITION BY trial), 4) + 0.0 AS corrected FROM n""")
def baseline_subtract(spark, sf_dir):
    return windows.baseline_subtract(samples(spark, sf_dir), "v", ["trial"], ["i"], 2).select("trial", "i", r("corrected").alias("corrected"))


@query(f"""WITH {S_SQL} SELECT trial, i, round(coalesce(100 * v / nullif(avg(v) OVER (PARTITION BY trial), 0), 0), 4) + 0.0 AS psc FROM s""")
def percent_signal_change(spark, sf_dir):
    return windows.percent_signal_change(samples(spark, sf_dir), "v", ["trial"]).select("trial", "i", r("psc").alias("psc"))


@query(f"""WITH {E_SQL} SELECT event_id, round(coalesce((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 0), 4) + 0.0 AS z FROM e WINDOW w AS (PARTITION BY user_id, event_type)""")
def z_transform(spark, sf_dir):
    return windows.z_transform(events(spark, sf_dir), "value", ["user_id", "event_type"]).select("event_id", r("z").alias("z"))


@query("""SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0 AS rank FROM part""")
def rank_transform(spark, sf_dir):
    return windows.rank_transform(table(spark, sf_dir, "part"), "p_retailprice", ["p_brand"]).select("p_partkey", "rank")


@query(f"""WITH {S_SQL}, w AS (SELECT *, coalesce(lag(v) OVER w, v) AS l, coalesce(lead(v) OVER w, v) AS n FROM s WINDOW w AS (PARTITION BY trial ORDER BY i))
SELECT trial, i, round(v, 4) + 0.0 AS v FROM w WHERE v >= l AND v >= n AND v >= 10""")
def local_maxima(spark, sf_dir):
    return windows.local_maxima(samples(spark, sf_dir), "v", ["trial"], ["i"], 10.0).select("trial", "i", r("v").alias("v"))


@query(f"""WITH {S_SQL} SELECT trial, i, round(avg(v) OVER (PARTITION BY trial ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) + 0.0 AS average FROM s""")
def moving_average(spark, sf_dir):
    return windows.moving_average(samples(spark, sf_dir), "v", ["trial"], ["i"], 1).select("trial", "i", r("average").alias("average"))


@query(f"""WITH {S_SQL}, l AS (SELECT *, min(v) OVER (PARTITION BY trial ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS low FROM s)
SELECT trial, i, round(max(low) OVER (PARTITION BY trial ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) + 0.0 AS opened FROM l""")
def morphological_opening(spark, sf_dir):
    return windows.opening(samples(spark, sf_dir), "v", ["trial"], ["i"], 1).select("trial", "i", r("opened").alias("opened"))


@query(f"""WITH {E_SQL} SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS count FROM e""")
def running_count(spark, sf_dir):
    return windows.running_count(events(spark, sf_dir), ["user_id"], ["us", "event_id"]).select("event_id", "count")


@query("SELECT event_type, round(4 * quantile_cont(abs(value), 0.5) / 0.6745, 4) + 0.0 AS threshold FROM events GROUP BY 1")
def mad_threshold(spark, sf_dir):
    return windows.mad_threshold(events(spark, sf_dir), "value", ["event_type"], 4.0).select("event_type", r("threshold").alias("threshold"))


@query("""WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS m, stddev_samp(value) AS s FROM events GROUP BY 1),
n AS (SELECT e.event_type, value, avg(value) OVER (PARTITION BY e.event_type) AS a FROM events e JOIN m ON e.event_type = m.event_type AND abs(value - m) <= 2 * s)
SELECT event_type, round(quantile_cont(abs(value - a), 0.5) / 0.6745, 4) + 0.0 AS sd FROM n GROUP BY 1""")
def noise_deviation(spark, sf_dir):
    return windows.noise_deviation(events(spark, sf_dir), "value", ["event_type"], 2).select("event_type", r("sd").alias("sd"))


@query(f"""WITH {S_SQL}, w AS (SELECT trial, v, unnest(range(greatest(CAST(floor((i - 4) / 2.0) AS BIGINT) + 1, 0), CAST(floor(i / 2.0) AS BIGINT) + 1)) AS "window" FROM s)
SELECT "window", count(*) AS n, round(avg(v), 4) + 0.0 AS mean FROM w GROUP BY 1""")
def moving_windows(spark, sf_dir):
    return windows.moving_windows(samples(spark, sf_dir), "i", ["trial"], 4, 2).groupBy("window").agg(F.count(F.lit(1)).alias("n"), r(F.avg("v")).alias("mean"))


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM events GROUP BY 1)
SELECT event_id, round(least(greatest(value, lo), hi), 4) + 0.0 AS clamped FROM events JOIN q USING (event_type)""")
def winsorize(spark, sf_dir):
    return windows.winsorize(events(spark, sf_dir), "value", ["event_type"], 0.05, 0.95).select("event_id", r("clamped").alias("clamped"))


# --- histograms and sums -----------------------------------------------------------------------------------------


@query("SELECT event_type, CAST(floor(value / 10) AS BIGINT) AS bin, count(*) AS n FROM events WHERE value >= 0 AND value < 300 GROUP BY 1, 2")
def hist_1d(spark, sf_dir):
    return bins.histogram(table(spark, sf_dir, "events"), "value", 10.0, ["event_type"], stop=300.0)


@query("SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS bin_x, CAST(floor(l_discount / 0.025) AS BIGINT) AS bin_y, count(*) AS n FROM lineitem GROUP BY 1, 2")
def hist_2d(spark, sf_dir):
    return bins.histogram_2d(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", 5.0, 0.025)


@query("SELECT CAST(floor(l_quantity / 10) AS BIGINT) AS bin, round(sum(l_discount), 2) + 0.0 AS n FROM lineitem WHERE l_quantity >= 0 GROUP BY 1")
def hist_weighted(spark, sf_dir):
    return bins.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", 10.0, weight="l_discount").select("bin", r("n", 2).alias("n"))


@query("SELECT CAST(range AS BIGINT) AS key, round(coalesce(sum(l_quantity), 0), 2) + 0.0 AS total FROM range(1, 10) LEFT JOIN lineitem ON l_linenumber = range GROUP BY 1")
def conditional_sum(spark, sf_dir):
    return bins.conditional_sum(table(spark, sf_dir, "lineitem"), "l_linenumber", "l_quantity", 9).select("key", r("total", 2).alias("total"))


# --- statistics --------------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, count(*) AS n, round(sqrt(count(*)) * avg(l_discount - 0.05) / stddev_samp(l_discount - 0.05), 4) + 0.0 AS t FROM lineitem GROUP BY 1")
def one_sample_t(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumn("d", F.col("l_discount") - 0.05)
    return stats.one_sample_t(line, "d", ["l_returnflag"]).select("l_returnflag", "n", r("t").alias("t"))


@query("SELECT l_linestatus, count(*) AS n, round(sqrt(count(*)) * avg(l_discount - l_tax) / stddev_samp(l_discount - l_tax), 4) + 0.0 AS t FROM lineitem GROUP BY 1")
def paired_t(spark, sf_dir):
    return stats.paired_t(table(spark, sf_dir, "lineitem"), "l_discount", "l_tax", ["l_linestatus"]).select("l_linestatus", "n", r("t").alias("t"))


@query("""WITH m AS (SELECT event_type, avg(value) FILTER (user_id % 2 = 0) AS mx, avg(value) FILTER (user_id % 2 = 1) AS my,
 var_samp(value) FILTER (user_id % 2 = 0) / count(*) FILTER (user_id % 2 = 0) AS vx, var_samp(value) FILTER (user_id % 2 = 1) / count(*) FILTER (user_id % 2 = 1) AS vy,
 count(*) FILTER (user_id % 2 = 0) AS nx, count(*) FILTER (user_id % 2 = 1) AS ny FROM events GROUP BY 1)
SELECT event_type, round((mx - my) / sqrt(vx + vy), 4) + 0.0 AS t, round((vx + vy) * (vx + vy) / (vx * vx / (nx - 1) + vy * vy / (ny - 1)), 2) + 0.0 AS dof FROM m""")
def two_sample_t(spark, sf_dir):
    return stats.welch_t(events(spark, sf_dir), "value", F.col("user_id") % 2 == 0, ["event_type"]).select("event_type", r("t").alias("t"), r("dof", 2).alias("dof"))


@query("""SELECT 'l_quantity' AS a, 'l_discount' AS b, round(corr(l_quantity, l_discount), 6) + 0.0 AS r FROM lineitem UNION ALL
SELECT 'l_quantity', 'l_extendedprice', round(corr(l_quantity, l_extendedprice), 6) + 0.0 FROM lineitem UNION ALL
SELECT 'l_discount', 'l_extendedprice', round(corr(l_discount, l_extendedprice), 6) + 0.0 FROM lineitem""")
def corr_matrix(spark, sf_dir):
    return stats.correlation_matrix(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"]).withColumn("r", r("r", 6))


@query("""WITH c AS (SELECT l_returnflag, corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(atanh(r), 4) + 0.0 AS z, round(r * sqrt((n - 2) / (1 - r * r)), 4) + 0.0 AS t FROM c""")
def fisher_z(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.corr("l_quantity", "l_extendedprice").alias("r"), F.count(F.lit(1)).alias("n"))
    return c.select("l_returnflag", r(stats.fisher_z(F.col("r"))).alias("z"), r(stats.correlation_t(F.col("r"), F.col("n"))).alias("t"))


@query("""WITH c AS (SELECT c_nationkey AS g, c_custkey % 97 AS x, round(c_acctbal / 100) AS y FROM customer)
SELECT a.g, round(sum(sign(a.x - b.x) * sign(a.y - b.y)) / nullif(sum(abs(sign(a.x - b.x) * sign(a.y - b.y))), 0), 6) + 0.0 AS tau FROM c a JOIN c b ON a.g = b.g AND a.x > b.x GROUP BY 1""")
def kendall_tau(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("g"), (F.col("c_custkey") % 97).alias("x"), F.round(F.col("c_acctbal") / 100).alias("y"))
    return stats.kendall_tau(c.withColumnsRenamed({"x": "p", "y": "q"}), "p", "q", ["g"]).select("g", r("tau", 6).alias("tau"))


@query("""WITH z AS (SELECT event_type, user_id, sqrt(count(*)) * avg(value) / stddev_samp(value) AS z FROM events GROUP BY 1, 2 HAVING stddev_samp(value) > 0)
SELECT event_type, round(sum(z) / sqrt(count(*)), 4) + 0.0 AS z FROM z GROUP BY 1""")
def stouffer_z(spark, sf_dir):
    z = stats.one_sample_t(events(spark, sf_dir), "value", ["event_type", "user_id"]).where("t != 0")
    return stats.stouffer(z, "t", ["event_type"]).select("event_type", r("z").alias("z"))


@query("""SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 3) + 0.0 AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) + 0.0 AS intercept,
round(regr_r2(l_extendedprice, l_quantity), 6) + 0.0 AS r2, round(regr_slope(l_extendedprice, l_quantity) / sqrt((regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity) / regr_sxx(l_extendedprice, l_quantity)) / (regr_count(l_extendedprice, l_quantity) - 2) / regr_sxx(l_extendedprice, l_quantity)), 3) + 0.0 AS t FROM lineitem GROUP BY 1""")
def ols_betas(spark, sf_dir):
    o = stats.ols_simple(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"])
    return o.select("l_returnflag", r("slope", 3).alias("slope"), r("intercept", 2).alias("intercept"), r("r2", 6).alias("r2"), r("t", 3).alias("t"))


@query("""WITH s AS (SELECT l_returnflag, var_pop(l_discount) s11, var_pop(l_tax) s22, covar_pop(l_discount, l_tax) s12, covar_pop(l_discount, l_quantity) s1y, covar_pop(l_tax, l_quantity) s2y, var_pop(l_quantity) syy, count(*) n FROM lineitem GROUP BY 1),
b AS (SELECT *, s11 * s22 - s12 * s12 AS det, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM s)
SELECT l_returnflag, round(b1, 3) + 0.0 AS b1, round(b2, 3) + 0.0 AS b2, round(b1 - b2, 3) + 0.0 AS contrast, round((b1 - b2) / sqrt(n * (syy - b1 * s1y - b2 * s2y) / (n - 3) * (s22 + 2 * s12 + s11) / (n * det)), 3) + 0.0 AS t FROM b""")
def contrast_t(spark, sf_dir):
    o = stats.ols_two(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", "l_tax", ["l_returnflag"])
    return o.select("l_returnflag", r("b1", 3).alias("b1"), r("b2", 3).alias("b2"), r("contrast", 3).alias("contrast"), r("t", 3).alias("t"))


@query("""WITH b AS (SELECT event_type, user_id, avg(value) AS b FROM events GROUP BY 1, 2) SELECT event_type, count(b) AS n, round(sqrt(count(b)) * avg(b) / stddev_samp(b), 4) + 0.0 AS t FROM b GROUP BY 1""")
def rfx_t(spark, sf_dir):
    return stats.second_level_t(events(spark, sf_dir), "user_id", "value", ["event_type"]).select("event_type", "n", r("t").alias("t"))


@query("""WITH p AS (SELECT event_type, sum(value) OVER w - (count(*) OVER w - 1) * (sum(value) OVER w - value) / (count(*) OVER w - 1.0) AS p FROM events WINDOW w AS (PARTITION BY event_type))
SELECT event_type, round(avg(p), 4) + 0.0 AS estimate, round(sqrt(var_samp(p) / count(p)), 4) + 0.0 AS sd FROM p GROUP BY 1""")
def jackknife_mean(spark, sf_dir):
    return stats.jackknife_mean(events(spark, sf_dir), "value", ["event_type"]).select("event_type", r("estimate").alias("estimate"), r("sd").alias("sd"))


_FDR = """WITH p AS (SELECT event_type, value / 2000.0 AS p FROM events WHERE value < 100), c AS (SELECT event_type, p, count(*) AS k FROM p GROUP BY 1, 2),
q AS (SELECT *, sum(k) OVER (PARTITION BY event_type ORDER BY p ROWS UNBOUNDED PRECEDING) AS i, sum(k) OVER (PARTITION BY event_type) AS n FROM c)
SELECT event_type, round(coalesce(max(CASE WHEN p * n / i <= {q} THEN p END), min(p) / 2.001), 8) + 0.0 AS threshold FROM q GROUP BY 1"""


def _fdr(spark, sf_dir, dependent):
    p = events(spark, sf_dir).where("value < 100").withColumn("p", F.col("value") / 2000.0)
    return stats.fdr(p, "p", ["event_type"], 0.03, dependent).select("event_type", r("threshold", 8).alias("threshold"))


@query(_FDR.format(q="0.03"))
def fdr_bh(spark, sf_dir):
    return _fdr(spark, sf_dir, False)


@query(_FDR.format(q="0.03 / (ln(n) + 0.5772)"))
def fdr_by(spark, sf_dir):
    return _fdr(spark, sf_dir, True)


@query("""WITH x AS (SELECT source, n_chars AS s, toxic AS y FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL)
SELECT a.source, round(sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) / count(*), 6) + 0.0 AS area FROM x a JOIN x b ON a.source = b.source AND a.y = 1 AND b.y = 0 GROUP BY 1""")
def roc_area(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels").where("toxic is not null"), "doc_id")
    return stats.roc_area(x, "n_chars", "toxic", ["source"]).where("area is not null").select("source", r("area", 6).alias("area"))


@query("SELECT event_type, round(count(*) / sum(1 / value), 6) + 0.0 AS mean FROM events WHERE value <> 0 GROUP BY 1")
def harmonic_mean(spark, sf_dir):
    return stats.harmonic_mean(events(spark, sf_dir), "value", ["event_type"]).select("event_type", r("mean", 6).alias("mean"))


@query("""WITH m AS (SELECT event_type, value, avg(value) OVER (PARTITION BY event_type) AS a FROM events)
SELECT event_type, round(avg(value), 4) + 0.0 AS mean, round(stddev_samp(value), 4) + 0.0 AS sd, round(avg((value - a) ** 3) / avg((value - a) ** 2) ** 1.5, 4) + 0.0 AS skew, round(avg((value - a) ** 4) / avg((value - a) ** 2) ** 2, 4) + 0.0 AS kurtosis FROM m GROUP BY 1""")
def moments(spark, sf_dir):
    m = stats.moments(events(spark, sf_dir), "value", ["event_type"])
    return m.select("event_type", *(r(c).alias(c) for c in ("mean", "sd", "skew", "kurtosis")))


@query("""WITH g AS (SELECT o_orderpriority, count(*) n, avg(o_totalprice / 1000) m, var_pop(o_totalprice / 1000) * count(*) ss FROM orders GROUP BY 1)
SELECT round((sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / (count(*) - 1) / (sum(ss) / (sum(n) - count(*))), 3) + 0.0 AS f, count(*) - 1 AS df_between, CAST(sum(n) - count(*) AS BIGINT) AS df_within FROM g""")
def anova_oneway(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("y", F.col("o_totalprice") / 1000)
    return stats.anova_oneway(o, "y", "o_orderpriority").select(r("f", 3).alias("f"), "df_between", "df_within")


@query("SELECT l_returnflag, round(1 / (1 - corr(l_quantity, l_extendedprice) * corr(l_quantity, l_extendedprice)), 6) + 0.0 AS vif FROM lineitem GROUP BY 1")
def variance_inflation(spark, sf_dir):
    return stats.variance_inflation(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]).select("l_returnflag", r("vif", 6).alias("vif"))


@query("""SELECT c_custkey, round(CASE WHEN c_acctbal > 0 AND c_custkey % 7 - 3 > 0 THEN least(c_acctbal, c_custkey % 7 - 3) WHEN c_acctbal < 0 AND c_custkey % 7 - 3 < 0 THEN greatest(c_acctbal, c_custkey % 7 - 3) ELSE 0 END, 4) + 0.0 AS v FROM customer""")
def conjunction(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", r(stats.conjunction([F.col("c_acctbal"), (F.col("c_custkey") % 7 - 3).cast("double")])).alias("v"))


@query("""WITH c AS (SELECT event_type, sum(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END) AS x, sum(CASE WHEN user_id % 2 = 1 THEN 1 ELSE 0 END) AS y FROM events GROUP BY 1) SELECT event_type, round(abs(x - y) / sqrt(x + y), 6) + 0.0 AS z FROM c""")
def count_test(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("one", F.lit(1))
    return stats.count_test(e, "one", F.col("user_id") % 2 == 0, ["event_type"]).select("event_type", r("z", 6).alias("z"))


# --- selections and sets -----------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_brand) = 'brand#2' AND lower(p_name) LIKE '%r%' AND p_size >= 5")
def predicate_select(spark, sf_dir):
    return table(spark, sf_dir, "part").where(sets.text_equal("p_brand", "BRAND#2") & sets.text_equal("p_name", "*R*") & (F.col("p_size") >= 5)).select("p_partkey", "p_name")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT', '5-LOW')")
def valid_trials(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(sets.match_all({"o_orderstatus": ["F", "O"], "o_orderpriority": ["1-URGENT", "5-LOW"]})).select("o_orderkey")


@query("SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT CASE WHEN event_type IN ('click', 'error') THEN event_type END) = 2")
def required_codes(spark, sf_dir):
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("codes"))
    return u.where(sets.has_codes("codes", ["click", "error"])).select("user_id")


@query("SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 2) + 0.0 AS mean, max(o_totalprice) AS high FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def select_groupby(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_totalprice > 1000").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), r(F.avg("o_totalprice"), 2).alias("mean"), F.max("o_totalprice").alias("high"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def top_k_per_key(spark, sf_dir):
    return sets.top_k(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS best FROM orders GROUP BY 1 HAVING count(*) = count(DISTINCT o_totalprice)")
def arg_max(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", "o_totalprice").alias("best"), F.count(F.lit(1)).alias("n"), F.count_distinct("o_totalprice").alias("d"))
    return o.where("n = d").select("o_custkey", "best")


@query("SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def union_aligned(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return sets.union_aligned(c, table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("key")))


@query("""SELECT nationkey, CASE WHEN s IS NULL THEN 'only_left' WHEN c IS NULL THEN 'only_right' WHEN c = s THEN 'equal' ELSE 'differs' END AS status FROM
(SELECT c_nationkey AS nationkey, count(*) AS c FROM customer WHERE c_custkey % 11 = 0 GROUP BY 1) FULL JOIN (SELECT s_nationkey AS nationkey, count(*) AS s FROM supplier GROUP BY 1) USING (nationkey)""")
def outer_compare(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_custkey % 11 = 0").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("n"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("n"))
    return sets.compare(c, s, ["nationkey"], "n")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def table_update(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return sets.update_by_id(c, c.where("c_custkey % 3 = 0 and c_acctbal < 0").withColumn("c_acctbal", F.lit(0.0)), "c_custkey")


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def intersect_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_nationkey"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def first_occurrence(spark, sf_dir):
    return sets.first_occurrences(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT event_id, CAST(event_id >> 8 AS BIGINT) AS high, CAST(event_id & 255 AS BIGINT) AS low, CAST(((event_id >> 8) - 192) * 64 + ((event_id & 255) - 192) AS BIGINT) AS condition FROM events")
def code_bytes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    high, low = codes.high_byte(F.col("event_id")), codes.low_byte(F.col("event_id"))
    return e.select("event_id", high.alias("high"), low.alias("low"), codes.condition_id(high, low).alias("condition"))


# --- waveforms ---------------------------------------------------------------------------------------------------


_W_SQL = "w AS (SELECT vec_id, label, unnest(range(64)) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT label, k, avg(v) AS m FROM w GROUP BY 1, 2)"


@query(f"WITH {_W_SQL} SELECT label, CAST(k AS BIGINT) AS k, round(m, 5) + 0.0 AS m FROM m")
def mean_waveform(spark, sf_dir):
    return waveforms.mean_waveform(table(spark, sf_dir, "embeddings"), "embedding", "label").select("label", "k", r("m", 5).alias("m"))


@query(f"""WITH {_W_SQL}, d AS (SELECT w.label, stddev_samp(v - m) AS sd FROM w JOIN m ON w.label = m.label AND w.k = m.k GROUP BY 1), a AS (SELECT label, max(m) - min(m) AS range FROM m GROUP BY 1)
SELECT label, round(range / (5 * sd), 4) + 0.0 AS snr FROM a JOIN d USING (label)""")
def waveform_snr(spark, sf_dir):
    return waveforms.snr(table(spark, sf_dir, "embeddings"), "embedding", "label").select("label", r("snr").alias("snr"))


@query(f"""WITH {_W_SQL}, d AS (SELECT vec_id, m.label AS cluster, sum((v - m) ** 2) AS d FROM w JOIN m ON w.k = m.k GROUP BY 1, 2)
SELECT vec_id, arg_min(cluster, d) AS cluster, round(min(d), 4) + 0.0 AS distance FROM d GROUP BY 1""")
def nearest_centroid(spark, sf_dir):
    return waveforms.nearest_centroid(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label").select("vec_id", "cluster", r("distance").alias("distance"))


@query(f"""WITH {_W_SQL} SELECT CAST(k AS BIGINT) AS k, round(var_samp(v), 5) + 0.0 AS variance FROM w GROUP BY 1 ORDER BY var_samp(v) DESC LIMIT 10""")
def topk_variance_features(spark, sf_dir):
    return waveforms.top_features(table(spark, sf_dir, "embeddings"), "embedding", 10).select("k", r("variance", 5).alias("variance"))


@query(f"""WITH {_W_SQL} SELECT vec_id, CAST(arg_min(k, v) AS BIGINT) AS trough, round(max(v) - min(v), 5) + 0.0 AS height FROM w GROUP BY 1""")
def waveform_features(spark, sf_dir):
    return waveforms.features(table(spark, sf_dir, "embeddings"), "embedding").select("vec_id", "trough", r("height", 5).alias("height"))


# --- models, units and maps --------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT o_orderpriority, o_custkey, count(*) AS k, avg(o_totalprice) AS m, coalesce(var_pop(o_totalprice) * count(*), 0) AS w FROM orders GROUP BY 1, 2),
t AS (SELECT o_orderpriority, count(*) AS n, sum(k)::DOUBLE AS nk, sum(w) AS within_, sum(k * m * m) - sum(k * m) ** 2 / sum(k) AS between_ FROM s GROUP BY 1),
q AS (SELECT o_orderpriority, between_ / (n - 1) AS msb, within_ / (nk - n) AS msw, nk / n AS k FROM t)
SELECT o_orderpriority, round((msb - msw) / (msb + (k - 1) * msw), 4) + 0.0 AS icc FROM q""")
def intraclass(spark, sf_dir):
    return models.intraclass(table(spark, sf_dir, "orders"), "o_totalprice", "o_custkey", ["o_orderpriority"]).select("o_orderpriority", r("icc").alias("icc"))


@query("""WITH c AS (SELECT l_linestatus, l_suppkey, l_returnflag, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3),
m AS (SELECT l_linestatus, v, avg(v) OVER (PARTITION BY l_linestatus, l_suppkey) AS s, avg(v) OVER (PARTITION BY l_linestatus, l_returnflag) AS l, avg(v) OVER (PARTITION BY l_linestatus) AS g, l_suppkey, l_returnflag FROM c),
t AS (SELECT l_linestatus, sum((l - g) ** 2) AS e, sum((v - s - l + g) ** 2) AS r, count(DISTINCT l_suppkey) AS n, count(DISTINCT l_returnflag) AS k FROM m GROUP BY 1)
SELECT l_linestatus, round((e / (k - 1)) / (r / ((k - 1) * (n - 1))), 4) + 0.0 AS f, k - 1 AS df_effect, (k - 1) * (n - 1) AS df_error FROM t""")
def repeated_anova(spark, sf_dir):
    out = models.repeated_anova(table(spark, sf_dir, "lineitem"), "l_quantity", "l_suppkey", "l_returnflag", ["l_linestatus"])
    return out.select("l_linestatus", r("f").alias("f"), "df_effect", "df_error")


@query("""WITH g AS (SELECT DISTINCT c_mktsegment AS g FROM customer), p AS (SELECT x.g AS a, y.g AS b FROM g x JOIN g y ON x.g < y.g),
r AS (SELECT a, b, c_mktsegment = a AS first, rank() OVER (PARTITION BY a, b ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY a, b, c_acctbal) - 1) / 2.0 AS k FROM p JOIN customer ON c_mktsegment IN (a, b)),
t AS (SELECT a, b, sum(CASE WHEN first THEN k END) AS w, count(*) FILTER (first)::DOUBLE AS n, count(*) FILTER (NOT first)::DOUBLE AS m FROM r GROUP BY 1, 2)
SELECT a, b, round((w - n * (n + m + 1) / 2) / sqrt(n * m * (n + m + 1) / 12), 4) + 0.0 AS z FROM t""")
def rank_sum_pairs(spark, sf_dir):
    return sorting.rank_sum(table(spark, sf_dir, "customer"), "c_acctbal", "c_mktsegment", []).select("a", "b", r("z").alias("z"))


@query(f"""WITH {E_SQL}, g AS (SELECT user_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS d FROM e),
s AS (SELECT user_id, 100.0 * count(CASE WHEN d < {3 * HOUR} THEN 1 END) / count(*)::DOUBLE AS percent FROM g GROUP BY 1)
SELECT user_id, round(percent, 4) + 0.0 AS percent, percent <= 3 AS single FROM s""")
def refractory_verdict(spark, sf_dir):
    out = sorting.refractory_share(events(spark, sf_dir), "us", ["user_id"], HOUR)
    return out.select("user_id", r(F.col("percent").cast("double")).alias("percent"), "single")


@query("""WITH m AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY 1, 2)
SELECT x.event_type AS a, y.event_type AS b, round(corr(x.v, y.v), 4) + 0.0 AS r FROM m x JOIN m y ON x.user_id = y.user_id AND x.event_type < y.event_type GROUP BY 1, 2""")
def pattern_similarity(spark, sf_dir):
    out = maps.pattern_similarity(table(spark, sf_dir, "events"), "event_type", ["user_id"], "value", [])
    return out.select("a", "b", r("r").alias("r"))


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n, round(sum(abs(l_extendedprice - l_quantity * 1000) / (l_tax + 1) + sqrt(l_quantity)), 4) + 0.0 AS v FROM lineitem WHERE l_extendedprice > l_quantity * 900 GROUP BY 1, 2""")
def map_formula(spark, sf_dir):
    names = {"p": "l_extendedprice", "q": "l_quantity", "t": "l_tax"}
    line = table(spark, sf_dir, "lineitem").where(maps.formula("p > q * 900", names))
    return line.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), r(F.sum(maps.formula("abs(p - q * 1000) / (t + 1) + sqrt(q)", names))).alias("v"))


@query(f"""WITH {E_SQL}, o AS (SELECT user_id, event_type, CAST(floor(us / {HOUR}.0) AS BIGINT) - 473352 AS v FROM e),
x AS (SELECT user_id, event_type, v + k AS volume, ([0.2, 0.5, 0.3]::DOUBLE[])[k + 1] AS h FROM o, (SELECT unnest(range(3)) AS k))
SELECT user_id, event_type, volume, round(sum(h), 6) + 0.0 AS x FROM x WHERE volume >= 0 AND volume < 720 GROUP BY 1, 2, 3""")
def design_matrix(spark, sf_dir):
    v = events(spark, sf_dir).select("user_id", "event_type", (F.floor(F.col("us") / HOUR) - 473352).alias("on")).withColumn("off", F.col("on") + 1)
    return models.design(v, "user_id", "event_type", "on", "off", 720, [0.2, 0.5, 0.3]).select("user_id", "event_type", "volume", r("x", 6).alias("x"))


def _register_others() -> None:
    """The queries of the other modules: fields adds its own with query(), numeric has those without SQL."""
    from tidemark.plans import fields, numeric  # noqa: F401

    QUERIES.update(numeric.QUERIES)


_register_others()
