"""Multitaper spectra, coherence, intervals and tests of trials held as arrays.

Trials of equal length are transformed together in Arrow batches. Averages over trials, sums for intervals and ratios for
coherence are added up inside of tasks and then by DataFrame aggregates over (keys, frequency), so that neither all trials
meet in one task nor trials times frequencies become rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.checkpoints import checkpoint
from tidemark.functions.distributions import beta_cdf, digamma, f_inv, quantile, trigamma
from tidemark.operators.batches import mapped, ragged, sliced, stacks


@dataclass(frozen=True)
class Taper:
    """``tw``: time-bandwidth product; ``k``: tapers; ``pad``: powers of two added to the transform's length (-1: none)."""

    fs: float = 1.0
    tw: float = 3.0
    k: int = 5
    pad: int = 0
    low: float = 0.0
    high: float | None = None

    @staticmethod
    def of_bandwidth(fs: float, w: float, t: float, p: int = 1, **more) -> Taper:
        """From half bandwidth w and duration t: 2 t w - p tapers."""
        return Taper(fs, w * t, int(2 * w * t - p), **more)

    def length(self, n: int) -> int:
        return n if self.pad < 0 else max(1 << (int(np.ceil(np.log2(n))) + self.pad), n)

    def grid(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Frequencies in the band, and their places in the transform."""
        size = self.length(n)
        f = np.arange(size // 2 + 1) * self.fs / size
        at = np.flatnonzero((f >= self.low) & (f <= (self.fs / 2 if self.high is None else self.high)))
        return f[at], at


@lru_cache(maxsize=64)
def slepian(n: int, tw: float, k: int) -> np.ndarray:
    """(n, k) discrete prolate spheroidal sequences of unit energy: eigenvectors of the tridiagonal matrix that commutes
    with the band-limiting kernel. Even ones have a positive mean, odd ones begin upwards."""
    i = np.arange(n)
    diagonal = ((n - 1 - 2 * i) / 2) ** 2 * np.cos(2 * np.pi * tw / n)
    off = i[1:] * (n - i[1:]) / 2
    _, v = np.linalg.eigh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    v = v[:, ::-1][:, :k]
    for j in range(k):
        if (v[:, j].sum() if j % 2 == 0 else (v[:, j] * (n - 1 - 2 * i)).sum()) < 0:
            v[:, j] *= -1
    return v


def transforms(x: np.ndarray, p: Taper) -> np.ndarray:
    """(frequencies, tapers) of fft(x * taper) / fs, tapers scaled by sqrt(fs). Signals are along the last axis of x."""
    n = x.shape[-1]
    _, at = p.grid(n)
    return np.fft.rfft(x[..., None] * slepian(n, p.tw, p.k) * np.sqrt(p.fs), p.length(n), axis=-2)[..., at, :] / p.fs


@lru_cache(maxsize=16)
def _own(n: int, p: Taper) -> np.ndarray:
    """The tapers' own transform."""
    return np.fft.rfft(slepian(n, p.tw, p.k) * np.sqrt(p.fs), p.length(n), axis=0)[p.grid(n)[1]]


def point_transforms(times: np.ndarray, start: float, end: float, p: Taper) -> np.ndarray:
    """The same for events: sums of tapers at their times, less the tapers' own transform times the mean count."""
    n = int(round((end - start) * p.fs)) + 1
    f = p.grid(n)[0]
    grid, tapers = start + np.arange(n) / p.fs, slepian(n, p.tw, p.k) * np.sqrt(p.fs)
    times = times[(times >= start) & (times <= end)]
    values = np.stack([np.interp(times, grid, tapers[:, j]) for j in range(p.k)], axis=1)
    return np.exp(-2j * np.pi * f[:, None] * (times - start)[None, :]) @ values - _own(n, p) * len(times) / n


def _inputs(df: DataFrame, keep: list[str], inputs: list[str]) -> list[Column]:
    return [*(F.col(c) for c in keep), *(F.col(c).cast("array<double>").alias(f"_in{i}") for i, c in enumerate(inputs))]


def _each(df: DataFrame, keep: list[str], inputs: list[str], fields: str, one) -> DataFrame:
    """(keep, fields) with the rows that ``one`` gives for stacked arrays of equal length: the row of each value (None: all
    values of all rows in turn), frequencies, and arrays."""
    schema = T.StructType([*(df.schema[c] for c in keep), *T._parse_datatype_string(fields).fields])

    def run(batches):
        # rows needn't have equal keys to be stacked, so none is a key
        moved = (pa.RecordBatch.from_arrays([*b.columns[len(keep) :], *b.columns[: len(keep)]], [str(i) for i in range(b.num_columns)]) for b in batches)
        for _, batch, places, arrays in stacks(moved, 0, len(inputs)):
            row, *out = one(*arrays)
            at = pa.array(np.repeat(places, out[0].size // len(places)) if row is None else places[row])
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[len(inputs) :]), *(pa.array(np.ascontiguousarray(v).ravel()) for v in out)], schema.names)

    return df.select(*_inputs(df, keep, inputs)).mapInArrow(run, schema)


#: Numbers that a task sums up before it gives them on.
HELD = 1 << 20


def _summed(df: DataFrame, keys: list[str], inputs: list[str], names: list[str], one, totals: DataFrame | None = None, stack=stacks, more: list[str] | None = None) -> DataFrame:
    """(keys, f, names, n): sums over all rows of what ``one`` gives for stacked arrays of equal length: frequencies, a
    number for each of them, and an array for each name. Tasks add up, so that trials times frequencies are never rows.
    ``stack`` may give longer keys, by the numbers named in ``more``. With ``totals`` (keys, f, ...), ``one`` also gets, first, the totals of the rows' keys, as arrays by name, f rising."""
    more = more or []
    schema = T.StructType([*(df.schema[c] for c in keys), *T._parse_datatype_string(", ".join(f"{c} double" for c in (*more, "f", *names))).fields, T.StructField("n", T.LongType())])
    rows, known, given = df.select(*_inputs(df, keys, inputs)), None, None
    if totals is not None:
        given = [c for c in totals.columns if c not in keys]
        packed = totals.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*given))).alias("_totals"))  # a row a key: its frequencies
        if totals.count() <= BROADCAST_TOTALS:
            known = {}
            for r in packed.collect():
                known[tuple(r)[: len(keys)]] = {c: np.array([x[c] for x in r._totals]) for c in given}
        else:
            rows = rows.join(packed.hint("merge"), keys).select(*rows.columns, "_totals")
    sent = df.sparkSession.sparkContext.broadcast(known) if known is not None else None

    def run(batches):
        held: dict[tuple, list] = {}
        size = 0

        def told():
            for (key, f), (v, n) in held.items():
                f = np.frombuffer(f)
                yield pa.RecordBatch.from_arrays([*(pa.array([k] * len(f), t) for k, t in zip(key, types)), pa.array(f), *map(pa.array, v), pa.array(n)], schema.names)

        types = None
        for key, batch, places, arrays in stack(batches, len(keys), len(inputs)):
            types = types or [*(c.type for c in batch.columns[: len(keys)]), *[pa.float64()] * len(more)]
            if given is not None:
                if sent is None:
                    own = batch.column(len(keys) + len(inputs))[int(places[0])].values
                    own = {c: own.field(c).to_numpy(zero_copy_only=False) for c in given}
                else:
                    own = sent.value.get(key)
                if own is None:
                    continue
                arrays = [own, *arrays]
            f, n, *v = one(*arrays)
            v, at = np.stack(v), (key, f.tobytes())
            if at in held:
                held[at][0] += v
                held[at][1] += n
            else:
                held[at] = [v, np.broadcast_to(n, f.shape).astype(np.int64)]
                size += v.size
            if size > HELD:
                yield from told()
                held, size = {}, 0
        yield from told()

    sums = rows.mapInArrow(run, schema)
    return sums.groupBy(*keys, *more, "f").agg(*(F.sum(c).alias(c) for c in names), F.sum("n").alias("n"))


#: Rows of totals that are sent to all tasks at most; more are joined to the trials of their keys.
BROADCAST_TOTALS = 50_000


def spectrum_of_trials(df: DataFrame, keep: list[str], samples: str, p: Taper) -> DataFrame:
    """(keep, f, s) of each trial: mean over tapers of the squared transform."""
    return _each(df, keep, [samples], "f double, s double", lambda x: (None, np.tile(p.grid(x.shape[1])[0], len(x)), _power(transforms(x, p)).mean(axis=-1)))


def _power(j: np.ndarray) -> np.ndarray:
    return j.real**2 + j.imag**2


def _mean_spectrum(df: DataFrame, keys: list[str], samples: str, p: Taper) -> DataFrame:
    """(keys, f, s, trials): mean over trials."""
    one = lambda x: (p.grid(x.shape[1])[0], len(x), _power(transforms(x, p)).mean(axis=-1).sum(axis=0))
    return _summed(df, keys, [samples], ["s"], one).select(*keys, "f", (F.col("s") / F.col("n")).alias("s"), F.col("n").alias("trials"))


def spectrum(df: DataFrame, keys: list[str], samples: str, p: Taper, level: float | None = 0.05) -> DataFrame:
    """(keys, f, s, trials, low, high): mean over trials, with the chi-square interval of 2 k trials degrees of freedom."""
    out = _mean_spectrum(df, keys, samples, p)
    if level is None:
        return out
    from tidemark.functions.distributions import chi_square_quantile

    dof = F.col("trials") * (2 * p.k)
    return out.withColumn("low", dof * F.col("s") / chi_square_quantile(F.lit(1 - level / 2), dof)).withColumn("high", dof * F.col("s") / chi_square_quantile(F.lit(level / 2), dof))


def point_spectrum(df: DataFrame, keys: list[str], times: str, start: float, end: float, p: Taper) -> DataFrame:
    """(keys, f, s, trials) of trials of event times within [start, end]."""
    f = p.grid(int(round((end - start) * p.fs)) + 1)[0]
    one = lambda t: (f, len(t), sum(_power(point_transforms(x, start, end, p)).mean(axis=-1) for x in t))
    return _summed(df, keys, [times], ["s"], one).select(*keys, "f", (F.col("s") / F.col("n")).alias("s"), F.col("n").alias("trials"))


def windows(df: DataFrame, keep: list[str], samples: str, length: int, step: int, fs: float) -> DataFrame:
    """(keep, t, window): slices of ``length`` samples every ``step``, t in seconds at their middle."""
    starts = F.when(F.size(samples) >= length, F.sequence(F.lit(0), F.size(samples) - length, F.lit(step))).otherwise(F.array().cast("array<int>"))
    cut = df.select(*keep, samples, F.explode(starts).alias("_a"))
    return cut.select(*keep, ((F.col("_a") + 1 + round(length / 2)) / F.lit(fs)).alias("t"), F.slice(samples, F.col("_a") + 1, F.lit(length)).alias("window"))


def spectrogram(df: DataFrame, keys: list[str], samples: str, p: Taper, window: float, step: float) -> DataFrame:
    """(keys, t, f, s): spectra of moving windows, averaged over trials. Windows are cut inside of the tasks."""
    length, hop = round(window * p.fs), round(step * p.fs)

    def cut(batches, k, n):
        for key, batch, places, (x,) in stacks(batches, k, n):
            for a in range(0, x.shape[1] - length + 1, hop):
                yield (*key, (a + 1 + round(length / 2)) / p.fs), batch, places, [x[:, a : a + length]]

    one = lambda x: (p.grid(length)[0], len(x), _power(transforms(x, p)).mean(axis=-1).sum(axis=0))
    out = _summed(df, keys, [samples], ["s"], one, stack=cut, more=["t"])
    return out.select(*keys, "t", "f", (F.col("s") / F.col("n")).alias("s"))


def coherence(df: DataFrame, keys: list[str], x: str, y: str, p: Taper, level: float = 0.05) -> DataFrame:
    """(keys, f, c, phase, trials, limit): coherence over tapers and trials, and the limit above which it is significant."""

    def one(u: np.ndarray, v: np.ndarray):
        a, b = transforms(u, p), transforms(v, p)
        c = (a.conj() * b).sum(axis=(0, 2)) / p.k
        return p.grid(u.shape[1])[0], len(u), c.real, c.imag, _power(a).sum(axis=(0, 2)) / p.k, _power(b).sum(axis=(0, 2)) / p.k

    names = ["re", "im", "sx", "sy"]
    s = _summed(df, keys, [x, y], names, one).select(*keys, "f", *((F.col(c) / F.col("n")).alias(c) for c in names), F.col("n").alias("trials"))
    dof = F.col("trials") * (2 * p.k)
    limit = F.when(dof <= 2, 1.0).otherwise(F.sqrt(1 - F.pow(F.lit(level), 1 / (F.when(dof > 2, dof) / 2 - 1))))
    c = F.try_divide(F.sqrt(F.col("re") ** 2 + F.col("im") ** 2), F.sqrt(F.col("sx") * F.col("sy")))
    return s.select(*keys, "f", c.alias("c"), F.atan2("im", "re").alias("phase"), "trials", limit.alias("limit"))


def coherence_matrix(df: DataFrame, keys: list[str], trial: str, channel: str, samples: str, p: Taper) -> DataFrame:
    """(keys, a, b, f, c, phase, trials) of all pairs of channels a < b of the same trials. Each channel is transformed once.
    The channels of a trial come to a task one after the other; it holds their transforms and sums of pairs, of bounded
    number. Rows with a null key, trial or channel have no pairs."""
    names, kind = ["re", "im", "sa", "sb"], df.schema[channel].dataType
    schema = T.StructType([*(df.schema[c] for c in keys), T.StructField("a", kind), T.StructField("b", kind), *T._parse_datatype_string(", ".join(f"{c} double" for c in ("f", *names))).fields, T.StructField("n", T.LongType())])
    of = [*keys, trial]
    rows = df.select(*of, channel, F.col(samples).cast("array<double>").alias("_in")).dropna(subset=[*of, channel])
    rows = rows.repartition(*(F.col(c) for c in of)).sortWithinPartitions(*of, channel)

    def run(batches):
        held: dict[tuple, list] = {}
        size, now, parts, types = 0, None, [], None

        def told():
            for (key, a, b, f), (v, n) in held.items():
                f = np.frombuffer(f)
                yield pa.RecordBatch.from_arrays([*(pa.array([k] * len(f), t) for k, t in zip((*key, a, b), types)), pa.array(f), *map(pa.array, v), pa.array([n] * len(f), pa.int64())], schema.names)

        def paired():
            nonlocal size
            for i, (a, f, j) in enumerate(parts):
                for b, g, k in parts[i + 1 :]:
                    if not a < b:
                        continue
                    if len(f) != len(g) or (f != g).any():
                        both, x, y = np.intersect1d(f, g, return_indices=True)
                        u, w = j[x], k[y]
                    else:
                        both, u, w = f, j, k
                    c = (u.conj() * w).sum(axis=-1)
                    v, at = np.stack([c.real, c.imag, _power(u).sum(axis=-1), _power(w).sum(axis=-1)]), (now[: len(keys)], a, b, both.tobytes())
                    if at in held:
                        held[at][0] += v
                        held[at][1] += 1
                    else:
                        held[at] = [v, 1]
                        size += v.size
                    if size > HELD:
                        yield from told()
                        held.clear()
                        size = 0

        for batch in sliced(batches):
            types = types or [*(c.type for c in batch.columns[: len(keys)]), batch.column(len(of)).type, batch.column(len(of)).type]
            lengths, starts, values = ragged(batch.column(len(of) + 1))
            for i, (name, ch) in enumerate(zip(zip(*(c.to_pylist() for c in batch.columns[: len(of)])), batch.column(len(of)).to_pylist())):
                if name != now:
                    yield from paired()
                    now, parts = name, []
                if lengths[i]:
                    x = values[starts[i] : starts[i] + lengths[i]]
                    parts.append((ch, p.grid(len(x))[0], transforms(x, p)))
        yield from paired()
        yield from told()

    s = rows.mapInArrow(run, schema).groupBy(*keys, "a", "b", "f").agg(*(F.sum(c).alias(c) for c in names), F.sum("n").alias("trials"))
    c = F.try_divide(F.sqrt(F.col("re") ** 2 + F.col("im") ** 2), F.sqrt(F.col("sa") * F.col("sb")))
    return s.select(*keys, "a", "b", "f", c.alias("c"), F.atan2("im", "re").alias("phase"), "trials")


def _places(own: dict[str, np.ndarray], f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the frequencies have totals, and where."""
    at = np.minimum(np.searchsorted(own["f"], f), len(own["f"]) - 1)
    ok = own["f"][at] == f
    return ok, at[ok]


def _moments(total: DataFrame, left: DataFrame, keys: list[str]) -> DataFrame:
    """The totals with ``_sd``, the deviation of what leaves one part out; parts are told by their distance d from the value
    of all, so that sums of d and of its squares are exact enough."""
    mean = F.col("d") / F.col("m")
    left = left.select(*keys, "f", F.sqrt(F.greatest(F.col("dd") / F.col("m") - mean * mean, F.lit(0.0))).alias("_sd"))
    return total.join(left.hint("merge"), [*keys, "f"])


def jackknife_coherence(df: DataFrame, keys: list[str], x: str, y: str, p: Taper, level: float = 0.05) -> DataFrame:
    """(keys, f, c, low, high): interval from z = sqrt(2 n - 2) atanh(c) without one of the n tapers of trials each. What leaves
    one out comes from the totals, which are summed first."""
    from tidemark.functions.distributions import student_quantile

    names = ["re", "im", "sx", "sy"]

    def parts(u: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
        j, k = transforms(u, p), transforms(v, p)
        cross = j.conj() * k
        return [cross.real, cross.imag, _power(j), _power(k)]

    def one(u: np.ndarray, v: np.ndarray):
        return p.grid(u.shape[1])[0], len(u) * p.k, *(s.sum(axis=(0, 2)) for s in parts(u, v))

    def z_of(n, re, im, sx, sy):
        with np.errstate(divide="ignore", invalid="ignore"):
            c = np.where(sx * sy == 0, np.nan, np.sqrt(re**2 + im**2) / np.sqrt(sx * sy))
        return np.sqrt(2 * n - 2) * np.arctanh(np.fmin(c, 1 - 1e-15))

    def without(own: dict[str, np.ndarray], u: np.ndarray, v: np.ndarray):
        f = p.grid(u.shape[1])[0]
        ok, at = _places(own, f)
        n, sums = own["n"][at].astype(float), [own[c][at] for c in names]
        d = z_of(n[:, None], *(s[:, None] - q[:, ok] for s, q in zip(sums, parts(u, v)))) - z_of(n, *sums)[:, None]
        return f[ok], len(u) * p.k, d.sum(axis=(0, 2)), (d * d).sum(axis=(0, 2))

    total = checkpoint(_summed(df, keys, [x, y], names, one).where("n > 1"))
    left = _summed(df, keys, [x, y], ["d", "dd"], without, total).withColumnRenamed("n", "m")
    out = _moments(total, left, keys).withColumn("c", F.try_divide(F.sqrt(F.col("re") ** 2 + F.col("im") ** 2), F.sqrt(F.col("sx") * F.col("sy"))))
    z = F.sqrt(2 * F.col("n") - 2) * F.atanh(F.least("c", F.lit(1 - 1e-15)))
    reach = student_quantile(F.lit(1 - level / 2), 2 * F.col("n") - 1) * F.sqrt(F.col("n") - 1) * F.col("_sd")
    back = lambda v: F.tanh(v / F.sqrt(2 * F.col("n") - 2))
    return out.select(*keys, "f", "c", F.greatest(back(z - reach), F.lit(0.0)).alias("low"), back(z + reach).alias("high"))


def jackknife_spectrum(df: DataFrame, keys: list[str], samples: str, p: Taper, level: float = 0.05) -> DataFrame:
    """(keys, f, s, low, high): interval from the logarithms of the means without one taper of one trial. The sums that
    leave one out come from the total, which is summed first."""
    from tidemark.functions.distributions import student_quantile

    def one(x: np.ndarray):
        return p.grid(x.shape[1])[0], len(x) * p.k, _power(transforms(x, p)).sum(axis=(0, 2))

    def without(own: dict[str, np.ndarray], x: np.ndarray):
        f = p.grid(x.shape[1])[0]
        ok, at = _places(own, f)
        n, s = own["n"][at].astype(float), own["s"][at]
        log = lambda v, k: np.log(np.maximum(v, 1e-300) / k)
        d = log(s[:, None] - _power(transforms(x, p))[:, ok], (n - 1)[:, None]) - log(s, n)[:, None]
        return f[ok], len(x) * p.k, d.sum(axis=(0, 2)), (d * d).sum(axis=(0, 2))

    total = checkpoint(_summed(df, keys, [samples], ["s"], one).where("n > 1"))
    left = _summed(df, keys, [samples], ["d", "dd"], without, total).withColumnRenamed("n", "m")
    out = _moments(total, left, keys).withColumn("s", F.col("s") / F.col("n"))
    reach = student_quantile(F.lit(1 - level / 2), F.col("n") - 1) * F.sqrt(F.col("n") - 1) * F.col("_sd")
    return out.select(*keys, "f", "s", (F.col("s") * F.exp(-reach)).alias("low"), (F.col("s") * F.exp(reach)).alias("high"))


@lru_cache(maxsize=256)
def _line_limit(n: int, k: int, level: float | None) -> float:
    return float(f_inv(np.array([1 - (level or 0.05 / n)]), 2, 2 * k - 2)[0])


def line_test(df: DataFrame, keep: list[str], samples: str, p: Taper, level: float | None = None, found: bool = False) -> DataFrame:
    """(keep, f, ratio, limit, amplitude): is there a sine at f? The F ratio of its power against what the tapers leave, with the
    significance limit of level (0.05 / number of samples). ``found``: only where the ratio is above the limit."""

    def one(x: np.ndarray):
        n = x.shape[1]
        h = slepian(n, p.tw, p.k) * np.sqrt(p.fs)
        j, h0 = transforms(x, p), np.where(np.arange(p.k) % 2 == 0, h.sum(axis=0), 0.0)
        a = (j * h0).sum(axis=-1) / (h0**2).sum() * p.fs
        rest = np.abs(j - a[..., None] * h0 / p.fs) ** 2
        with np.errstate(divide="ignore", invalid="ignore"):
            value = (p.k - 1) * np.abs(a / p.fs) ** 2 * (h0**2).sum() / rest.sum(axis=-1)
        f, limit = np.broadcast_to(p.grid(n)[0], value.shape), _line_limit(n, p.k, level)
        # for Spark nan is above all numbers
        row, at = np.nonzero((value > limit) | np.isnan(value)) if found else np.indices(value.shape).reshape(2, -1)
        return row, f[row, at], value[row, at], np.full(len(row), limit), 2 * np.abs(a)[row, at]

    return _each(df, keep, [samples], "f double, ratio double, limit double, amplitude double", one)


def without_line(x: np.ndarray, p: Taper, line: float) -> np.ndarray:
    """The signal less the sine that the tapers fit at the frequency nearest to ``line``."""
    n = len(x)
    h = slepian(n, p.tw, p.k) * np.sqrt(p.fs)
    even = np.arange(p.k) % 2 == 0
    t = np.arange(n) / p.fs
    h0 = h.sum(axis=0)[even]
    j = (np.exp(-2j * np.pi * line * t) * x) @ h[:, even]
    a = (j * h0).sum() / (h0**2).sum()
    return x - 2 * (a * np.exp(2j * np.pi * line * t)).real


def remove_line(samples: Column | str, p: Taper, line: float) -> Column:
    return mapped(lambda v: without_line(v, p, line), samples)


def two_group_spectrum(a: DataFrame, b: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, f, z): spectra of spectrum() of two groups compared in logarithms, each freed of its bias psi(m) - ln m and
    weighted by its variance psi'(m), with m tapers times trials."""

    def batch(s1: pd.Series, n1: pd.Series, s2: pd.Series, n2: pd.Series) -> pd.Series:
        m1, m2 = k * n1.to_numpy(float), k * n2.to_numpy(float)
        bias = (digamma(m1) - np.log(m1)) - (digamma(m2) - np.log(m2))
        return pd.Series((np.log(s1.to_numpy(float)) - np.log(s2.to_numpy(float)) - bias) / np.sqrt(trigamma(m1) + trigamma(m2)))

    batch.__annotations__ = {x: pd.Series for x in ("s1", "n1", "s2", "n2")} | {"return": pd.Series}
    both = a.select(*keys, "f", F.col("s").alias("s1"), F.col("trials").alias("n1")).join(b.select(*keys, "f", F.col("s").alias("s2"), F.col("trials").alias("n2")), [*keys, "f"])
    return both.select(*keys, "f", F.pandas_udf(batch, "double")("s1", "n1", "s2", "n2").alias("z"))


def coherence_quantile(level: float, dof: float) -> float:
    """The coherence that noise exceeds with probability ``level``: its square has a beta distribution."""
    return float(np.sqrt(quantile(lambda x: beta_cdf(x, 1.0, dof / 2 - 1), np.array([1 - level]), 0.0, 1.0)[0]))
