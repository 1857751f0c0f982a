"""Queries over fields around events, correlogram corrections and other point-process statistics, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import alignment, bins, fields, intervals, linkage, localfit, maps, models, stats, waveforms, wavelets, windows
from tidemark.plans.catalog import _CCG, _W_SQL, E_SQL, HOUR, MINUTE, S_SQL, _ccg, _markers, events, query, r, samples, table, trials

#: 2024-01-01 in microseconds, and the hours from there that are a field.
START, HOURS = 1_704_067_200_000_000, 720

F_SQL = f"""{E_SQL}, h AS (SELECT user_id, CAST(floor((us - {START}) / {HOUR}.0) AS BIGINT) AS h, sum(value) AS v FROM e GROUP BY 1, 2),
f AS (SELECT u.user_id, u.h, coalesce(h.v, 0.0) AS v FROM (SELECT user_id, CAST(range AS BIGINT) AS h FROM (SELECT DISTINCT user_id FROM e), range({HOURS})) u LEFT JOIN h ON h.user_id = u.user_id AND h.h = u.h),
s AS (SELECT user_id, (us - {START}) / {HOUR}.0 AS pos FROM e WHERE event_type = 'purchase'),
l AS (SELECT user_id, pos, CAST(range AS BIGINT) - 6 AS lag FROM s, range(13) WHERE pos - 6 >= 0 AND pos + 6 <= {HOURS - 1}),
x AS (SELECT l.lag, l.pos, CASE WHEN l.pos > floor(l.pos) THEN a.v * (1 - (l.pos - floor(l.pos))) + b.v * (l.pos - floor(l.pos)) ELSE a.v END AS v FROM l JOIN f a ON a.user_id = l.user_id AND a.h = CAST(floor(l.pos) AS BIGINT) + l.lag LEFT JOIN f b ON b.user_id = l.user_id AND b.h = CAST(floor(l.pos) AS BIGINT) + l.lag + 1)"""
_AVERAGE = "count(v) AS n, round(avg(v), 4) + 0.0 AS mean, round(stddev_samp(v) / sqrt(count(v)), 4) + 0.0 AS sem"


def _field(spark, sf_dir):
    """(user_id, h, v): hourly sums of values, 0 for hours without events."""
    e = events(spark, sf_dir)
    sums = e.groupBy("user_id", F.floor((F.col("us") - START) / F.lit(float(HOUR))).alias("h")).agg(F.sum("value").alias("v"))
    spine = e.select("user_id").distinct().withColumn("h", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(HOURS - 1).cast("long"))))
    return spine.join(sums.hint("merge"), ["user_id", "h"], "left").select("user_id", "h", F.coalesce("v", F.lit(0.0)).alias("v"))


def _spikes(spark, sf_dir):
    return events(spark, sf_dir).where("event_type = 'purchase'").select("user_id", ((F.col("us") - START) / F.lit(float(HOUR))).alias("at"))


def _rounded(df, *keys):
    return df.select(*(F.col(k).cast("long").alias(k) if k in ("lag", "window", "bin") else F.col(k) for k in keys), "n", r("mean").alias("mean"), r("sem").alias("sem"))


@query(f"WITH {F_SQL} SELECT lag, {_AVERAGE} FROM x GROUP BY 1")
def spike_triggered_average(spark, sf_dir):
    return _rounded(fields.spike_triggered_average(_spikes(spark, sf_dir), _field(spark, sf_dir), ["user_id"], "at", "h", "v", -6, 6), "lag")


@query(f'WITH {F_SQL} SELECT CAST(w.range AS BIGINT) AS "window", lag, {_AVERAGE} FROM x JOIN range(6) w ON pos >= w.range * 120 AND pos < w.range * 120 + 240 GROUP BY 1, 2')
def moving_spike_triggered_average(spark, sf_dir):
    return _rounded(fields.moving_spike_triggered_average(_spikes(spark, sf_dir), _field(spark, sf_dir), ["user_id"], "at", "h", "v", -6, 6, 240, 120), "window", "lag")


@query(f"""WITH {S_SQL}, t AS (SELECT trial, min(i) + 1 AS align FROM s GROUP BY 1),
x AS (SELECT o_orderpriority AS cond, CAST(s.i - t.align AS BIGINT) AS k, v FROM s JOIN t ON s.trial = t.trial AND s.i BETWEEN t.align - 1 AND t.align + 2 JOIN orders ON o_orderkey = s.trial)
SELECT cond, k, {_AVERAGE} FROM x GROUP BY 1, 2""")
def evoked_mean(spark, sf_dir):
    s = samples(spark, sf_dir)
    t = s.groupBy("trial").agg((F.min("i") + 1).alias("align"))
    cut = intervals.slice_samples(s, t, "i", "align", -1, 2, ["trial"]).join(trials(spark, sf_dir).select("trial", "cond"), "trial")
    return _rounded(fields.evoked_mean(cut.withColumn("k", F.col("k").cast("long")), ["cond"], "k", "v"), "cond", "k")


@query(f"""WITH {E_SQL}, l AS (SELECT m.event_id AS marker, p.value, p.us - m.us AS lag FROM e p JOIN e m ON p.user_id = m.user_id AND p.event_type <> 'purchase' AND m.event_type = 'purchase' AND p.us >= m.us - {6 * HOUR} AND p.us < m.us + {6 * HOUR}),
b AS (SELECT marker, avg(value) AS base FROM l WHERE lag < 0 GROUP BY 1), y AS (SELECT marker, CAST(floor((lag + {6 * HOUR}) / {HOUR}.0) AS BIGINT) AS bin, avg(value) AS v FROM l GROUP BY 1, 2),
x AS (SELECT bin, v - base AS v FROM y JOIN b USING (marker)) SELECT bin, {_AVERAGE} FROM x GROUP BY 1""")
def event_related_average(spark, sf_dir):
    e = events(spark, sf_dir)
    return _rounded(fields.event_related_average(e.where("event_type != 'purchase'").select("user_id", "us", "value"), _markers(e), "us", "m", "marker", "value", 6 * HOUR, 6 * HOUR, HOUR, ["user_id"]), "bin")


def _norm(spark, sf_dir, kind):
    e = events(spark, sf_dir)
    n = e.agg(F.count_if(F.col("event_type") == "click"), F.count_if(F.col("event_type") == "view")).first()
    return bins.correlogram_norm(_ccg(spark, sf_dir), n[0], n[1], kind).select("lag", r("c", 6).alias("c"))


_N = "(SELECT count(*) FROM e WHERE event_type = '{}')::DOUBLE"


@query(f"WITH {_CCG} SELECT lag, round(n / {_N.format('click')}, 6) + 0.0 AS c FROM c")
def ccg_norm_first(spark, sf_dir):
    return _norm(spark, sf_dir, "first")


@query(f"WITH {_CCG} SELECT lag, round(n / {_N.format('view')}, 6) + 0.0 AS c FROM c")
def ccg_norm_second(spark, sf_dir):
    return _norm(spark, sf_dir, "second")


@query(f"WITH {_CCG} SELECT lag, round(n / ({_N.format('click')} + {_N.format('view')} - n), 6) + 0.0 AS c FROM c")
def ccg_norm_union(spark, sf_dir):
    return _norm(spark, sf_dir, "union")


_DAY = f"""{E_SQL}, x AS (SELECT user_id, us % {24 * HOUR} AS t, event_type FROM e WHERE event_type IN ('click', 'view'))"""


def _days(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("us", F.pmod("us", F.lit(24 * HOUR)))
    return e.where("event_type = 'click'").select("user_id", "us"), e.where("event_type = 'view'").select("user_id", "us")


@query(f"""WITH {_DAY}, b AS (SELECT event_type, CAST(floor(t / {HOUR}.0) AS BIGINT) AS bin, count(*) AS n FROM x GROUP BY 1, 2), k AS (SELECT count(DISTINCT user_id) AS k FROM x)
SELECT p.bin - q.bin AS lag, round(sum(p.n * q.n) / (k * CAST(k AS DOUBLE)), 6) + 0.0 AS mean FROM b p JOIN b q ON p.event_type = 'click' AND q.event_type = 'view', k GROUP BY 1, k""")
def joint_predictor(spark, sf_dir):
    return bins.joint_predictor(*_days(spark, sf_dir), "us", "user_id", HOUR, 23).select("lag", r("mean", 6).alias("mean"))


@query(f"""WITH {_DAY}, a AS (SELECT user_id, CAST(floor(t / {4 * HOUR}.0) AS BIGINT) AS w, count(*) AS n FROM x WHERE event_type = 'click' GROUP BY 1, 2),
s AS (SELECT user_id, w * 4 + CAST(range AS BIGINT) AS bin, n / 4.0 AS n FROM a, range(4)), b AS (SELECT user_id, CAST(floor(t / {HOUR}.0) AS BIGINT) AS bin, count(*) AS n FROM x WHERE event_type = 'view' GROUP BY 1, 2)
SELECT s.bin - b.bin AS lag, round(sum(s.n * b.n), 4) + 0.0 AS expected FROM s JOIN b USING (user_id) WHERE abs(s.bin - b.bin) <= 8 GROUP BY 1""")
def jitter_predictor(spark, sf_dir):
    return bins.jitter_predictor(*_days(spark, sf_dir), "us", "user_id", HOUR, 4, 8).select("lag", r("expected").alias("expected"))


@query()
def correlogram_band(spark, sf_dir):
    e = events(spark, sf_dir)
    return bins.correlogram_band(e.where("event_type = 'click'").select("user_id", "us"), e.where("event_type = 'view'").select("user_id", "us"), "us", ["user_id"], 2 * HOUR, 10 * MINUTE, HOUR, 40)


@query(f"""WITH {E_SQL}, d AS (SELECT user_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS isi FROM e), c AS (SELECT user_id, CAST(floor((isi + {HOUR / 2}) / {HOUR}.0) AS BIGINT) AS bin, count(*) AS c FROM d WHERE isi <= {24 * HOUR} GROUP BY 1, 2),
t AS (SELECT count(DISTINCT user_id) AS t FROM e) SELECT bin, CAST(sum(c) AS BIGINT) AS n, CASE WHEN t > 4 THEN round(sqrt(greatest(0.0, (sum(c * c) - sum(c) * sum(c) / t::DOUBLE) / (t * (t - 1.0)))), 4) + 0.0 END AS error FROM c, t GROUP BY 1, t""")
def isi_jackknife(spark, sf_dir):
    return bins.interval_jackknife(events(spark, sf_dir), "us", "user_id", HOUR, 24 * HOUR).select("bin", "n", r("error").alias("error"))


@query(f"""WITH {E_SQL}, d AS (SELECT event_type, us - lag(us) OVER (PARTITION BY event_type ORDER BY us) AS isi FROM e)
SELECT event_type, CAST(greatest(10, floor(floor(count(isi) / 30.0) * max(isi) / median(isi))) AS BIGINT) AS bins, max(isi) AS longest FROM d GROUP BY 1""")
def isi_bins(spark, sf_dir):
    return bins.interval_bins(events(spark, sf_dir), "us", ["event_type"])


_RATE = f"""{E_SQL}, g AS (SELECT DISTINCT (us // {6 * HOUR}) * {6 * HOUR} AS g FROM e), k AS (SELECT count(DISTINCT user_id) AS k FROM e),
p AS (SELECT g, sum(exp(-0.5 * ((us - g) / {2 * HOUR}.0) ** 2) / ({2 * HOUR}.0 * sqrt(2 * pi()))) AS s FROM g JOIN e ON us BETWEEN g - {8 * HOUR} AND g + {8 * HOUR} GROUP BY 1),
r AS (SELECT g, coalesce(s, 0) / k AS rate, k FROM g LEFT JOIN p USING (g), k)"""


def _trial_rate(spark, sf_dir, adaptive):
    e = events(spark, sf_dir)
    grid = e.select((F.floor(F.col("us") / F.lit(6 * HOUR)) * (6 * HOUR)).alias("g")).distinct()
    n = e.agg(F.count_distinct("user_id")).first()[0]
    out = bins.trial_rate(e.select("us"), "us", grid, "g", float(2 * HOUR), max(1, n), adaptive)
    return out.select("g", r(F.col("rate") * HOUR, 6).alias("rate"), r(F.col("error") * HOUR, 6).alias("error"))


@query(f"WITH {_RATE} SELECT g, round(rate * {HOUR}, 6) + 0.0 AS rate, round(sqrt(rate / (2 * k * {2 * HOUR}.0 * sqrt(pi()))) * {HOUR}, 6) + 0.0 AS error FROM r")
def trial_rate(spark, sf_dir):
    return _trial_rate(spark, sf_dir, False)


@query(f"""WITH {_RATE}, w AS (SELECT g, k, least(coalesce({2 * HOUR}.0 * (SELECT avg(rate) FROM r) / nullif(rate, 0), {2 * HOUR}.0), greatest((SELECT max(g) - min(g) FROM r)::DOUBLE, {2 * HOUR}.0)) AS sg FROM r),
q AS (SELECT g, sum(exp(-0.5 * ((us - g) / sg) ** 2) / (sg * sqrt(2 * pi()))) AS s FROM w JOIN e ON us >= trunc(g - 4 * sg) AND us <= trunc(g + 4 * sg) GROUP BY 1)
SELECT g, round(coalesce(s, 0) / k * {HOUR}, 6) + 0.0 AS rate, round(sqrt(coalesce(s, 0) / k / (2 * k * sg * sqrt(pi()))) * {HOUR}, 6) + 0.0 AS error FROM w LEFT JOIN q USING (g)""")
def adaptive_rate(spark, sf_dir):
    return _trial_rate(spark, sf_dir, True)


# --- windows, sets and models ------------------------------------------------------------------------------------


@query(f"""WITH {S_SQL}, l AS (SELECT *, max(v) OVER (PARTITION BY trial ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS high FROM s)
SELECT trial, i, round(min(high) OVER (PARTITION BY trial ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) + 0.0 AS closed FROM l""")
def morphological_closing(spark, sf_dir):
    return windows.closing(samples(spark, sf_dir), "v", ["trial"], ["i"], 1).select("trial", "i", r("closed").alias("closed"))


@query(f"""WITH {S_SQL} SELECT trial, i, round((coalesce(lag(v) OVER w, v) + v + coalesce(lead(v) OVER w, v)) / 3, 4) + 0.0 AS smooth FROM s WINDOW w AS (PARTITION BY trial ORDER BY i)""")
def smoothed_edges(spark, sf_dir):
    return windows.smoothed(samples(spark, sf_dir), "v", ["trial"], ["i"], 1).select("trial", "i", r("smooth").alias("smooth"))


@query()
def running_line(spark, sf_dir):
    return windows.running_line(_field(spark, sf_dir), "v", ["user_id"], "h", 24, 6)


@query("""WITH a AS (SELECT l_orderkey, min(l_linenumber) AS bad FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_linenumber - bad + o_custkey AS BIGINT) AS repaired FROM lineitem JOIN a USING (l_orderkey) JOIN orders ON o_orderkey = l_orderkey""")
def mapped_clock(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))
    bad = line.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("l_linenumber"))
    good = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("l_linenumber"))
    return fields.mapped_clock(line, bad, good, "l_orderkey", "l_linenumber", [])


@query("""WITH w AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS k FROM embeddings),
d AS (SELECT q.vec_id, b.vec_id AS other, b.label, sum((q.v - b.v) * (q.v - b.v)) AS d FROM w q JOIN w b ON q.k = b.k AND q.vec_id % 50 = 0 AND q.vec_id <> b.vec_id GROUP BY 1, 2, 3),
n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS rank FROM d), v AS (SELECT vec_id, label, count(*) AS votes FROM n WHERE rank <= 7 GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY votes DESC, label) AS place FROM v) SELECT vec_id, label, votes FROM b WHERE place = 1""")
def knn_vote(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings")
    return waveforms.knn_vote(x.where("vec_id % 50 = 0"), x, "vec_id", "embedding", "label", 7).select("vec_id", "label", "votes")


@query("""WITH g AS (SELECT c_nationkey, c_mktsegment AS g, count(*) AS n, avg(c_acctbal) AS m, var_pop(c_acctbal) * count(*) AS q, CASE c_mktsegment WHEN 'BUILDING' THEN 1.0 WHEN 'MACHINERY' THEN -1.0 ELSE 0.0 END AS w FROM customer GROUP BY 1, 2),
s AS (SELECT c_nationkey, sum(w * m) AS estimate, sqrt(sum(q) / nullif(sum(n) - count(*), 0) * sum(w * w / n)) AS se, CAST(sum(n) - count(*) AS BIGINT) AS dof FROM g GROUP BY 1)
SELECT c_nationkey, round(estimate, 4) + 0.0 AS estimate, round(se, 4) + 0.0 AS se, dof, round(estimate / nullif(se, 0), 4) + 0.0 AS t FROM s""")
def pooled_groups(spark, sf_dir):
    out = stats.pooled_groups(table(spark, sf_dir, "customer"), "c_acctbal", "c_mktsegment", {"BUILDING": 1, "MACHINERY": -1}, ["c_nationkey"])
    return out.select("c_nationkey", r("estimate").alias("estimate"), r("se").alias("se"), "dof", r("t").alias("t"))


_CENTRED = "covar_pop({0}, {1}) * count(*) AS {2}"


@query(f"""WITH c AS (SELECT l_returnflag, l_quantity AS x, l_extendedprice AS m, l_discount AS y FROM lineitem),
s AS (SELECT l_returnflag, count(*) AS n, {_CENTRED.format('x', 'x', 'xx')}, {_CENTRED.format('m', 'm', 'mm')}, {_CENTRED.format('x', 'm', 'xm')}, {_CENTRED.format('x', 'y', 'xy')}, {_CENTRED.format('m', 'y', 'my')}, {_CENTRED.format('y', 'y', 'yy')} FROM c GROUP BY 1),
p AS (SELECT *, xm / xx AS a, sqrt((mm - xm * xm / xx) / (n - 2) / xx) AS sa, (xy * mm - my * xm) / (xx * mm - xm * xm) AS direct, (my * xx - xy * xm) / (xx * mm - xm * xm) AS b FROM s),
z AS (SELECT *, sqrt((yy - direct * xy - b * my) / (n - 3) * xx / (xx * mm - xm * xm)) AS sb FROM p)
SELECT l_returnflag, round(a, 4) + 0.0 AS a, round(b * 1e6, 4) + 0.0 AS b, round(direct * 1e3, 4) + 0.0 AS direct, round(a * b * 1e3, 4) + 0.0 AS indirect, round(a * b / sqrt(a * a * sb * sb + b * b * sa * sa), 4) + 0.0 AS z FROM z""")
def mediation_effect(spark, sf_dir):
    out = models.mediation(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "l_discount", ["l_returnflag"])
    return out.select("l_returnflag", r("a").alias("a"), r(F.col("b") * 1e6).alias("b"), r(F.col("direct") * 1e3).alias("direct"), r(F.col("indirect") * 1e3).alias("indirect"), r("z").alias("z"))


@query(f"""WITH c AS (SELECT p_brand, p_size::DOUBLE AS x, (p_partkey % 7)::DOUBLE AS m, p_retailprice AS y FROM part),
s AS (SELECT p_brand, count(*) AS n, {_CENTRED.format('x', 'x', 'xx')}, {_CENTRED.format('m', 'm', 'mm')}, {_CENTRED.format('x', 'm', 'xm')}, {_CENTRED.format('x', 'y', 'xy')}, {_CENTRED.format('m', 'y', 'my')}, {_CENTRED.format('y', 'y', 'yy')} FROM c GROUP BY 1),
p AS (SELECT *, (xy * mm - my * xm) / (xx * mm - xm * xm) AS b1, (my * xx - xy * xm) / (xx * mm - xm * xm) AS b2 FROM s)
SELECT p_brand, n - 3 AS dof, round(b1, 4) + 0.0 AS size, round(b2, 4) + 0.0 AS k, round((b1 * xy + b2 * my) / yy, 6) + 0.0 AS r2, round((b1 - b2) / sqrt((yy - b1 * xy - b2 * my) / (n - 3) * (mm + 2 * xm + xx) / (xx * mm - xm * xm)), 4) + 0.0 AS t FROM p WHERE n > 3""")
def glm_contrast(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", F.lit(1.0).alias("one"), F.col("p_size").cast("double").alias("size"), F.pmod("p_partkey", F.lit(7)).cast("double").alias("k"), "p_retailprice")
    out = models.linear(p, "p_retailprice", ["one", "size", "k"], ["p_brand"], [0.0, 1.0, -1.0]).where("dof > 0")
    return out.select("p_brand", "dof", r(F.col("betas")[1]).alias("size"), r(F.col("betas")[2]).alias("k"), r("r2", 6).alias("r2"), r("t").alias("t"))


@query(f"""WITH RECURSIVE {E_SQL}, n AS (SELECT DISTINCT user_id, us, min(us) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {HOUR + 1} FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM e),
k AS (SELECT user_id, min(us) AS us FROM e GROUP BY 1 UNION ALL SELECT k.user_id, n.later FROM k JOIN n ON n.user_id = k.user_id AND n.us = k.us WHERE n.later IS NOT NULL)
SELECT user_id, us FROM k""")
def refractory_events(spark, sf_dir):
    return waveforms.keep_after_refractory(events(spark, sf_dir).select("user_id", "us"), "us", ["user_id"], HOUR)


#: Prices by quantity, a local line at 11 places of each flag's range, a third of the rows in its window.
_LOCAL = localfit.Smooth(nn=1 / 3, degree=1)


@query("""WITH p AS (SELECT l_returnflag AS flag, l_discount * 100 + l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem), g AS (SELECT flag, min(x) AS lo, max(x) AS hi, count(*) AS n FROM p GROUP BY 1),
v AS (SELECT flag, lo + (hi - lo) * i.range / 10 AS v, n FROM g, range(11) i),
h AS (SELECT v.flag, v.v, abs(x - v.v) AS h FROM v JOIN p USING (flag) QUALIFY row_number() OVER (PARTITION BY v.flag, v.v ORDER BY abs(x - v.v)) = greatest(1, floor(max(n) OVER (PARTITION BY v.flag, v.v) / 3.0 + 1e-9))),
w AS (SELECT h.flag, h.v, h.h, (x - h.v) / h.h AS u, y, pow(1 - pow(abs(x - h.v) / h.h, 3), 3) AS w FROM h JOIN p ON p.flag = h.flag AND abs(x - h.v) < h.h),
s AS (SELECT flag, v, h, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * y) AS t0, sum(w * u * y) AS t1, sum(w * w) AS q0, sum(w * w * u) AS q1, sum(w * w * u * u) AS q2 FROM w GROUP BY 1, 2, 3)
SELECT flag, round(v, 4) + 0.0 AS v, round(h, 4) + 0.0 AS h, round((s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1), 4) + 0.0 AS value, round((s0 * t1 - s1 * t0) / (s0 * s2 - s1 * s1) / h, 4) + 0.0 AS slope,
round(1e4 * s2 / (s0 * s2 - s1 * s1), 4) + 0.0 AS influence, round(1e4 * (s2 * s2 * q0 - 2 * s1 * s2 * q1 + s1 * s1 * q2) / pow(s0 * s2 - s1 * s1, 2), 4) + 0.0 AS variance FROM s""")
def local_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.col("l_discount") * 100 + F.col("l_quantity")).alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    fit = localfit.local_fit(rows, ["flag"], "x", "y", smooth=_LOCAL, ev="grid", points=11)
    scaled = fit.table().withColumn("influence", F.col("influence") * 1e4).withColumn("variance", F.col("variance") * 1e4)
    return scaled.select("flag", *(r(c).alias(c) for c in ("v", "h", "value", "slope", "influence", "variance")))


@query("""WITH RECURSIVE e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
p AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.id <> b.id AND sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: pow(z[1] - z[2], 2)))) <= 1.07),
r AS (SELECT id, id AS x FROM e UNION SELECT r.id, p.b FROM r JOIN p ON r.x = p.a), l AS (SELECT id, min(x) AS label FROM r GROUP BY 1)
SELECT id AS vec_id, label, count(*) OVER (PARTITION BY label) AS size FROM l""")
def single_linkage_cut(spark, sf_dir):
    found = linkage.single_linkage(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", cut=1.07)
    return found.select(F.col("id").alias("vec_id"), "label", "size")


@query(f"""WITH RECURSIVE {E_SQL}, a AS (SELECT user_id, us, event_type AS code, row_number() OVER (PARTITION BY user_id ORDER BY us, event_type) AS i FROM e),
b AS (SELECT user_id, us, event_type AS code, row_number() OVER (PARTITION BY user_id ORDER BY us, event_type) AS j FROM e WHERE event_id % 3 <> 0),
w AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS j, FALSE AS met FROM a UNION ALL
SELECT w.user_id, w.i + 1, w.j + CASE WHEN a.code = b.code THEN 1 ELSE 0 END, coalesce(a.code = b.code, FALSE) FROM w JOIN a ON a.user_id = w.user_id AND a.i = w.i + 1 LEFT JOIN b ON b.user_id = w.user_id AND b.j = w.j + 1),
m AS (SELECT user_id, max(j) AS j FROM w GROUP BY 1)
SELECT a.user_id, a.us, a.code AS event_type, b.us AS other FROM w JOIN a ON a.user_id = w.user_id AND a.i = w.i LEFT JOIN b ON w.met AND b.user_id = w.user_id AND b.j = w.j
UNION ALL SELECT b.user_id, NULL, b.code, b.us FROM b JOIN m ON m.user_id = b.user_id WHERE b.j > m.j""")
def greedy_merge(spark, sf_dir):
    e = events(spark, sf_dir)
    return alignment.greedy_merge(e, e.where("event_id % 3 <> 0"), ["user_id"], "us", "event_type")


@query(f"""WITH {E_SQL}, t AS (SELECT event_type, user_id AS trial, min(us) AS begin, max(us) AS stop, min(event_id) AS one FROM e GROUP BY 1, 2)
SELECT event_type, trial, CAST(begin + 5000 AS BIGINT) AS begin, CAST(stop + 5000 AS BIGINT) AS stop, one % 4 = 0 AS repaired FROM t""")
def repaired_trials(spark, sf_dir):
    t = events(spark, sf_dir).groupBy("event_type", F.col("user_id").alias("trial")).agg(F.min("us").alias("begin"), F.max("us").alias("stop"), F.min("event_id").alias("one"))
    bad = t.where("one % 4 <> 0").select("event_type", "trial", (F.col("begin") + 5000).alias("begin"), (F.col("stop") + 5000).alias("stop"))
    return alignment.repaired_trials(bad, t, ["event_type"], "trial", "stop", ["begin", "stop"])


def _trains(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("us", F.floor(F.col("us") / (10 * MINUTE)).cast("long"))
    return [e.where(F.col("event_type") == k).select("user_id", "us").distinct() for k in ("click", "view")]


@query()
def pattern_shift_band(spark, sf_dir):
    a, b = _trains(spark, sf_dir)
    drawn = [bins.pattern_shifted(x, "us", ["user_id"], 36, 40, seed) for seed, x in enumerate((a, b))]
    return bins.resampled_band(a, b, *drawn, "us", ["user_id"], 12, 1, 40)


@query()
def reassignment_band(spark, sf_dir):
    a, b = _trains(spark, sf_dir)
    drawn = [bins.reassigned(x, "us", "user_id", 36, 40, seed) for seed, x in enumerate((a, b))]
    return bins.resampled_band(a, b, *drawn, "us", ["user_id"], 12, 1, 40)


@query("""WITH f AS (SELECT p_brand, CAST(p_partkey % 40 AS INT) AS x, CAST(p_size AS INT) AS y FROM part WHERE p_size <= 20),
n AS (SELECT DISTINCT p_brand, x + dx AS x, y + dy AS y FROM f, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) AS o(dx, dy))
SELECT x, y, round(count(*) / (SELECT count(DISTINCT p_brand) FROM f)::DOUBLE, 4) + 0.0 AS share FROM n GROUP BY 1, 2""")
def focus_density(spark, sf_dir):
    foci = table(spark, sf_dir, "part").where("p_size <= 20").select("p_brand", (F.pmod("p_partkey", F.lit(40))).cast("int").alias("x"), F.col("p_size").cast("int").alias("y"))
    return maps.kernel_density(foci, ["x", "y"], "p_brand", 1.0).select("x", "y", r("share").alias("share"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, CAST(len(embedding) AS BIGINT) AS n FROM embeddings),
p AS (SELECT vec_id, x, n, unnest(range(n)) AS k FROM e WHERE n % 4 = 0),
c AS (SELECT vec_id, k, CASE WHEN k < n // 4 THEN (x[4 * k + 1] + x[4 * k + 2] + x[4 * k + 3] + x[4 * k + 4]) / 2
WHEN k < n // 2 THEN (x[4 * k - n + 1] + x[4 * k - n + 2] - x[4 * k - n + 3] - x[4 * k - n + 4]) / 2
ELSE (x[2 * k - n + 1] - x[2 * k - n + 2]) / sqrt(2) END AS v FROM p)
SELECT vec_id, CAST(k AS INT) AS k, round(v, 4) + 0.0 AS v FROM c""")
def haar_coefficients(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").where(F.size("embedding") % 4 == 0)
    done = vectors.select("vec_id", wavelets.decomposed("embedding", wavelets.wavelet_nodes(2), 1).alias("c"))
    return done.select("vec_id", F.posexplode("c").alias("k", "v")).select("vec_id", "k", r("v").alias("v"))
