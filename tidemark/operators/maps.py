"""Maps over grid points: formulas, thresholds, connected clusters and their tables, regions and masks."""

from __future__ import annotations

import ast
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.checkpoints import checkpoint

_FUNCTIONS = {"abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "log": F.log, "sign": F.signum, "min": F.least, "max": F.greatest, "tanh": F.tanh, "atanh": F.atanh}
_BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: F.try_divide, ast.Pow: F.pow, ast.BitAnd: lambda a, b: a & b, ast.BitOr: lambda a, b: a | b}
_COMPARE = {ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b}


#: Points of a mask that are broadcast at most; more are joined: some ten bytes each.
BROADCAST_POINTS = 500_000


def formula(text: str, columns: dict[str, str]) -> Column:
    """A column from an arithmetic expression over named maps. Only numbers, the given names, + - * / **, comparisons,
    & | - and a few functions are taken; nothing is evaluated as code."""

    def of(n: ast.AST) -> Column:
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)):
            return F.lit(float(n.value))
        if isinstance(n, ast.Name) and n.id in columns:
            return F.col(columns[n.id])
        if isinstance(n, ast.BinOp) and type(n.op) in _BINARY:
            return _BINARY[type(n.op)](of(n.left), of(n.right))
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub):
            return -of(n.operand)
        if isinstance(n, ast.Compare) and len(n.ops) == 1 and type(n.ops[0]) in _COMPARE:
            return _COMPARE[type(n.ops[0])](of(n.left), of(n.comparators[0]))
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in _FUNCTIONS and not n.keywords:
            return _FUNCTIONS[n.func.id](*map(of, n.args))
        raise ValueError(f"not allowed in a formula: {ast.unparse(n)}")

    return of(ast.parse(text.strip(), mode="eval").body)


#: Edges that a task contracts at once.
CONTRACTED = 500_000
#: Edges of a task of a later round: what is left goes to so few tasks and files as that makes.
TASK_EDGES = 50_000


def contracted(edges: DataFrame) -> DataFrame:
    """(a, b): edges of whole numbers, fewer, that connect the same nodes. What the edges of a task connect, some
    ``CONTRACTED`` of them at a time, becomes edges from its least node to each other one; a node's edge to itself stays one.
    Edges of one ``b`` that follow each other are contracted together."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root[x]) != x:
                root[x] = root[up]
                x = up
            return x

        def told() -> Iterator[pa.RecordBatch]:
            nodes = np.fromiter(root, np.int64, len(root))
            least = np.fromiter(map(find, root), np.int64, len(root))
            some = np.ones(len(nodes), bool)
            some[nodes == least] = ~np.isin(nodes[nodes == least], least[nodes != least])
            for at in range(0, len(ends := np.flatnonzero(some)), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(least[ends[at : at + (1 << 16)]]), pa.array(nodes[ends[at : at + (1 << 16)]])], ["a", "b"])

        held, last = 0, None
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held >= CONTRACTED and b != last:
                    yield from told()
                    root.clear()
                    held = 0
                root.setdefault(a, a), root.setdefault(b, b)
                if (u := find(a)) != (v := find(b)):
                    root[max(u, v)] = min(u, v)
                held, last = held + 1, b
        yield from told()

    return edges.select("a", "b").where("a is not null and b is not null").mapInArrow(stars, "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that each node of (a, b) is connected with. Numbers are contracted, others labelled in
    rounds.

    Edges are contracted inside of tasks, as they come and then once a round by their larger end, whose edges meet in one
    task: of them the least stays and the others become edges between smaller nodes. So what a round moves comes down to
    an edge a node, however many edges there were and however they were dealt; tasks follow the edges left. Smaller ends
    that have a smaller one themselves give way to it, which halves the depth of what is left; it ends when every node has
    its least one alone."""
    if not dict(edges.dtypes)["a"] == dict(edges.dtypes)["b"] == "bigint":
        return _labelled(edges)
    edges, tasks = contracted(edges), None
    while True:
        by_end = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).repartition("b")
        by_end = by_end.coalesce(tasks) if tasks else by_end
        edges = checkpoint(contracted(by_end.sortWithinPartitions("b")))
        tasks = edges.count() // TASK_EDGES + 1
        ends = edges.select(F.col("b").alias("node"), "a", F.lit(False).alias("over")).unionByName(edges.select(F.col("a").alias("node"), F.lit(None).cast("long").alias("a"), F.lit(True).alias("over")))
        ends = ends.groupBy("node").agg(F.min("a").alias("up"), F.max("a").alias("also"), F.max("over").alias("over"))
        moving = checkpoint(ends.where("up != also or over and up < node").select(F.col("node").alias("a"), "up").coalesce(tasks))
        if moving.isEmpty():
            return ends.select("node", F.coalesce("up", "node").alias("label"))
        edges = edges.join(moving, "a", "left").select(F.coalesce("up", "a").alias("a"), "b")


def _labelled(edges: DataFrame) -> DataFrame:
    """As connected(), for nodes of any kind: labels spread to neighbours and jump to their own label's label, so rounds
    grow with the logarithm of a component's length; each passes all edges."""
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = checkpoint(edges.select(F.explode(ways).alias("e")).select("e.a", "e.b").distinct())
    labels = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("n")).select("node", F.least("node", "n").alias("label")))
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        new = labels.join(heard, "node").select("node", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("jumped"))
        new = checkpoint(new.join(jump, "label").select("node", "was", F.least("label", "jumped").alias("label")))
        labels = new.select("node", "label")
        if new.where("was != label").isEmpty():
            return labels


def clusters(df: DataFrame, value: str, threshold: float, axes: list[str], corners: int = 1) -> DataFrame:
    """Rows past the threshold with ``cluster``: the least point of its connected component, points touching in faces (1),
    edges too (2) or corners too (3). Neighbours are found by equality on shifted coordinates, not by comparing pairs."""
    points = df.where(F.col(value) >= threshold).select("*", F.struct(*axes).alias("_p"))
    shifts = [()]
    for _ in axes:
        shifts = [(*s, d) for s in shifts for d in (-1, 0, 1)]
    shifts = [s for s in shifts if 0 < sum(map(abs, s)) <= corners and s > tuple([0] * len(axes))]
    moved = F.explode(F.array(*(F.struct(*((F.col(a) + d).cast(df.schema[a].dataType).alias(a) for a, d in zip(axes, s))) for s in shifts)))
    near = points.select(F.col("_p").alias("a"), moved.alias("b")).join(points.select(F.col("_p").alias("b")), "b").select("a", "b")
    labels = connected(near).select(F.col("node").alias("_p"), "label")
    return points.join(labels, "_p", "left").withColumn("cluster", F.coalesce("label", "_p")).drop("_p", "label")


def cluster_table(df: DataFrame, value: str, axes: list[str], least: int = 1) -> DataFrame:
    """(cluster, size, peak, peak_at, mean, centre) of clusters with ``least`` points."""
    out = df.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.max(value).alias("peak"), F.max_by(F.struct(*axes), F.struct(F.col(value), *((-F.col(a)).alias(a) for a in axes))).alias("peak_at"), F.avg(value).alias("mean"), F.struct(*(F.avg(a).alias(a) for a in axes)).alias("centre"))
    return out.where(F.col("size") >= least)


def region_means(df: DataFrame, regions: DataFrame, axes: list[str], region: str, by: list[str], value: str) -> DataFrame:
    """(by, region, mean, n): the values at a region's points; a point can be in several regions."""
    return df.join(regions.select(*axes, region), axes).groupBy(*by, region).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def sphere(centres: DataFrame, axes: list[str], name: str, radius: float) -> DataFrame:
    """(name, axes): grid points within the radius of each centre, nearest first by ``distance``."""
    reach = int(radius)
    out = centres.select(name, *axes)
    for a in axes:
        out = out.withColumn(f"_{a}", F.explode(F.sequence(F.round(a).cast("int") - reach, F.round(a).cast("int") + reach)))
    d = F.sqrt(sum(((F.col(f"_{a}") - F.col(a)) ** 2 for a in axes), F.lit(0.0)))
    return out.withColumn("distance", d).where(F.col("distance") <= radius).select(name, *(F.col(f"_{a}").alias(a) for a in axes), "distance")


def affine(axes: list[str], matrix: list[list[float]]) -> list[Column]:
    """Coordinates times a matrix of len(axes) rows and one more column, the shift."""
    return [sum((F.col(a) * float(m) for a, m in zip(axes, row)), F.lit(float(row[-1]))).alias(a) for a, row in zip(axes, matrix)]


def pattern_similarity(df: DataFrame, condition: str, point: list[str], value: str, by: list[str]) -> DataFrame:
    """(by, a, b, r): correlation over points of each pair of conditions, a < b; conditions are averaged at each point."""
    m = df.groupBy(*by, *point, condition).agg(F.avg(value).alias("v"))
    other = m.select(*by, *point, F.col(condition).alias("b"), F.col("v").alias("u"))
    return m.withColumnRenamed(condition, "a").join(other, [*by, *point]).where("a < b").groupBy(*by, "a", "b").agg(F.corr("v", "u").alias("r"))


def kernel_density(foci: DataFrame, axes: list[str], study: str, radius: float) -> DataFrame:
    """(axes, share): at each grid point the share of studies with a focus within the radius; a study counts once."""
    studies = foci.agg(F.countDistinct(study).alias("_n"))  # one row
    near = sphere(foci.select(study, *axes).distinct(), axes, study, radius).select(*axes, study).distinct().groupBy(*axes).agg(F.count(F.lit(1)).alias("n"))
    return near.join(F.broadcast(studies)).select(*axes, (F.col("n") / F.col("_n")).alias("share"))


def placed(foci: DataFrame, mask: DataFrame, axes: list[str], study: str, rounds: int, seed: int = 0) -> DataFrame:
    """(round, study, axes): each study's foci at points of ``mask`` drawn with equal chance, ``rounds`` times. Points are
    numbered by slices of the first axis, foci within their study; draws go by a hash of round, study and number, so that
    they are the same in any partitioning."""
    first, *others = axes
    points = mask.select(*axes).distinct()
    slices = points.groupBy(first).agg(F.count(F.lit(1)).alias("_m"))
    before = Window.orderBy(first).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a slice
    starts = slices.select(F.col(first).alias("_slice"), (F.sum("_m").over(before) - F.col("_m")).alias("_start"))
    at = F.row_number().over(Window.partitionBy(first).orderBy(*(others or [first]))) - 1
    numbered = points.withColumn("_at", at).join(starts, F.col(first) == F.col("_slice")).select(*axes, (F.col("_at") + F.col("_start")).cast("long").alias("_n"))
    total = slices.agg(F.sum("_m").alias("_total"))  # one row
    each = foci.groupBy(study).agg(F.count(F.lit(1)).cast("int").alias("_f")).join(F.broadcast(total))
    # a row for each round and focus: by rounds to the tasks, and never the side of a join that Spark thinks small
    drawn = each.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).repartition(rounds, "round", study).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_f"))))
    drawn = drawn.select("round", study, F.pmod(F.xxhash64("round", F.lit(seed), F.col(study), "_k"), F.col("_total")).alias("_n"))
    numbered = checkpoint(numbered)
    return drawn.join(numbered.hint("broadcast" if numbered.count() <= BROADCAST_POINTS else "merge"), "_n").select("round", study, *axes)


def density_limit(foci: DataFrame, mask: DataFrame, axes: list[str], study: str, radius: float, rounds: int = 100, share: float = 0.95, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The limit that the largest share of a map of kernel_density() stays under in ``share`` of maps by chance, as a row
    (limit), and (round, largest), the largest of each drawn map within ``mask``. Maps are counted for all rounds at once."""
    studies = foci.agg(F.countDistinct(study).alias("_s"))  # one row
    drawn = placed(foci, mask, axes, study, rounds, seed).distinct().withColumn("_of", F.struct("round", study))
    reached = sphere(drawn, axes, "_of", radius).select(F.col("_of.round").alias("round"), F.col(f"_of.{study}").alias("_study"), *axes).distinct()
    inside = reached.join(mask.select(*axes).distinct(), axes, "left_semi")
    counts = inside.groupBy("round", *axes).agg(F.count(F.lit(1)).alias("_c"))
    largest = counts.groupBy("round").agg(F.max("_c").alias("_c")).join(F.broadcast(studies)).select("round", (F.col("_c") / F.col("_s")).alias("largest"))
    place = max(1, min(rounds, math.ceil(rounds * share - 1e-9)))
    return largest.agg(F.element_at(F.array_sort(F.collect_list("largest")), place).alias("limit")), largest


def above_chance(foci: DataFrame, mask: DataFrame, axes: list[str], study: str, radius: float, rounds: int = 100, share: float = 0.95, seed: int = 0) -> DataFrame:
    """(axes, share, limit, above) of the points of ``mask`` that a study reaches."""
    limit, _ = density_limit(foci, mask, axes, study, radius, rounds, share, seed)
    own = kernel_density(foci, axes, study, radius).join(mask.select(*axes).distinct(), axes, "left_semi")
    return own.join(F.broadcast(limit)).withColumn("above", F.col("share") > F.col("limit"))  # one row
