"""Thresholds that make real factors Boolean, chosen by a metric: on a grid, by random trials, or one a factor by coordinate sweeps.

A cell is predicted if some factor is above its threshold on both sides. A grid or a list of trials is counted in one pass over dense
blocks of cells: on a grid, each cell's answer for one threshold of u is a number (the best v among the factors that pass), so all
thresholds of v follow from running counts. A sweep moves one threshold at a time to its best value given the others: as it falls,
rows turn on in the order of their values and bring cells with them that no other factor covers; how many follows from pairs of
masks and the ones, and running sums over the sorted values give the metric at every possible threshold.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import uniform
from ..operators import algebra
from ..operators.blocks import SIDE, on_blocks
from ..operators.lineage import cut
from ..operators.matrix import BoolMatrix
from ..operators.metrics import ALIASES, formulas
from .continuous import cols


def _metric(name: str) -> Column:
    return formulas(*(F.col(c) for c in ("p", "q", "tp", "n")))[ALIASES.get(name, name)]


def ranges(side: DataFrame, k: int) -> list[tuple[float, float]]:
    """Least and largest value of each factor."""
    r = side.agg(*[g(c).alias(f"{n}{c}") for c in cols(k) for n, g in (("a", F.min), ("b", F.max))]).first()
    return [(float(r[f"a{c}"] or 0.0), float(r[f"b{c}"] or 0.0)) for c in cols(k)]


def steps(low: float, high: float, n: int) -> list[float]:
    """n values from low on, at equal distances; high is not among them, as nothing lies above it."""
    return [low + (high - low) * g / n for g in range(n)]


# ---- counting ----------------------------------------------------------------------------------------------------------


def grid_counts(x: BoolMatrix, u: DataFrame, v: DataFrame, k: int, at_u: list[float], at_v: list[float], side: int = SIDE) -> DataFrame:
    """at_u, at_v, p, q, tp, n of every pair of thresholds."""
    at_u, at_v = sorted(set(at_u)), np.array(sorted(set(at_v)))

    def body(i, j, a, b, ones):
        out: list = [[], [], [], []]
        for t in at_u:
            best = np.full(ones.shape, -np.inf)
            for f in range(k):
                np.maximum(best, np.where(a[:, f] > t, 0.0, -np.inf)[:, None] + b[:, f], out=best)
            passed = np.searchsorted(at_v, best, side="left")  # how many thresholds of v lie below
            for name, of in enumerate((passed, passed[ones])):
                above = np.bincount(of.ravel(), minlength=len(at_v) + 1)[::-1].cumsum()[::-1][1:]
                out[2 + name] += above.tolist()
            out[0] += [t] * len(at_v)
            out[1] += at_v.tolist()
        return pa.table({"at_u": out[0], "at_v": out[1], "q": pa.array(out[2], pa.int64()), "tp": pa.array(out[3], pa.int64())})

    parts = on_blocks(x, u, v, body, "at_u double, at_v double, q bigint, tp bigint", side)
    counted = parts.groupBy("at_u", "at_v").agg(F.sum("q").alias("q"), F.sum("tp").alias("tp"))
    return counted.select("at_u", "at_v", F.lit(x.ones.count()).cast("bigint").alias("p"), "q", "tp", F.lit(x.m * x.n).cast("bigint").alias("n"))


def trial_counts(x: BoolMatrix, u: DataFrame, v: DataFrame, k: int, trials: list[tuple[list[float], list[float]]], side: int = SIDE) -> DataFrame:
    """trial, p, q, tp, n of every trial: its thresholds of u and of v, one a factor."""

    def body(i, j, a, b, ones):
        counts = []
        for us, vs in trials:
            hit = (a > us).astype(np.float32) @ (b > vs).astype(np.float32).T > 0.5
            counts.append((int(hit.sum()), int(hit[ones].sum())))
        return pa.table({"trial": list(range(len(trials))), "q": [q for q, _ in counts], "tp": [t for _, t in counts]})

    counted = on_blocks(x, u, v, body, "trial bigint, q bigint, tp bigint", side).groupBy("trial").agg(F.sum("q").alias("q"), F.sum("tp").alias("tp"))
    return counted.select("trial", F.lit(x.ones.count()).cast("bigint").alias("p"), "q", "tp", F.lit(x.m * x.n).cast("bigint").alias("n"))


def random_trials(spark, u: DataFrame, v: DataFrame, k: int, n: int, columnwise: bool, seed) -> list[tuple[list[float], list[float]]]:
    """Thresholds at random within the values of each factor, or of each side."""
    drawn = spark.range(n).select(*[uniform(seed, F.col("id"), F.lit(s), F.lit(f)).alias(f"{s}{f}") for s in "uv" for f in range(k)], "id").orderBy("id").collect()  # n rows, a parameter
    ends = {s: ranges(side, k) for s, side in (("u", u), ("v", v))}
    if not columnwise:
        ends = {s: [(min(a for a, _ in e), max(b for _, b in e))] * k for s, e in ends.items()}
    at = lambda r, s: [a + (b - a) * r[f"{s}{f if columnwise else 0}"] for f, (a, b) in enumerate(ends[s])]
    return [(at(r, "u"), at(r, "v")) for r in drawn]


# ---- sweeps ------------------------------------------------------------------------------------------------------------


def _masked(side: DataFrame, key: str, at: list[float], skip: int) -> DataFrame:
    """key and the factors other than `skip` that are above their threshold."""
    on = F.array_compact(F.array(*[F.when(F.col(c) > F.lit(at[f]), F.lit(f)) for f, c in enumerate(cols(len(at))) if f != skip])) if len(at) > 1 else F.array().cast("array<int>")
    return side.select(key, F.col(f"f{skip}").alias("__x"), on.alias("mask"))


def gained(x: BoolMatrix, mine: DataFrame, other: DataFrame, key: str, mine_at: list[float], other_at: list[float], f: int) -> tuple[DataFrame, DataFrame]:
    """value, q, tp: how many cells, and ones among them, the rows (or columns) of each value of factor f bring if they are on, beyond
    what the other factors cover; and one row q, tp: what those cover."""
    far = "j" if key == "i" else "i"
    a, b = _masked(mine, key, mine_at, f), _masked(other, far, other_at, f).withColumn("on", F.col("__x") > F.lit(other_at[f]))
    groups_a = a.groupBy("mask").agg(F.count(F.lit(1)).alias("na"))
    groups_b = b.groupBy("mask").agg(F.count(F.lit(1)).alias("nb"), F.sum(F.col("on").cast("bigint")).alias("on"))
    pairs = algebra.hit_pairs(groups_a.withColumnRenamed("mask", "ma"), "ma", groups_b.withColumnRenamed("mask", "mb"), "mb")
    covered = pairs.groupBy("ma").agg(F.sum("on").alias("hidden"), F.sum("nb").alias("nb"), F.first("na").alias("na"))
    whole = groups_b.agg(F.coalesce(F.sum("on"), F.lit(0)).alias("whole"))
    fresh = groups_a.join(covered.select(F.col("ma").alias("mask"), "hidden"), "mask", "left").crossJoin(F.broadcast(whole)).select("mask", (F.col("whole") - F.coalesce("hidden", F.lit(0))).alias("q"))  # whole: one row
    q = a.join(fresh, "mask").groupBy(F.col("__x").alias("value")).agg(F.sum("q").alias("q"))
    cells = x.ones.join(a.withColumnRenamed("mask", "ma"), key).join(b.select(far, "on", F.col("mask").alias("mb")), far)
    hit = algebra.mask_hit(F.col("ma"), F.col("mb"))
    tp = cells.filter(~hit & F.col("on")).groupBy(F.col("__x").alias("value")).agg(F.count(F.lit(1)).alias("tp"))
    base_q = covered.agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("q"))
    base_tp = cells.agg(F.coalesce(F.sum(hit.cast("bigint")), F.lit(0)).alias("tp"))
    return q.join(tp, "value", "left").select("value", "q", F.coalesce("tp", F.lit(0)).alias("tp")), base_q.crossJoin(base_tp)


def threshold_metrics(gains: DataFrame, base: DataFrame, p: int, n: int, metric: str) -> DataFrame:
    """t, score: the metric with the threshold at each value (rows of larger ones are on), and at 1 below the least, where all are. Running
    sums over ranges of sorted values, so no task sorts them all."""
    rows = cut(gains.sort(F.desc("value")).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("__part").agg(F.sum("q").alias("pq"), F.sum("tp").alias("pt"))  # one row a range
    parts = parts.select("__part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("pq", "pt")])
    w = Window.partitionBy("__part").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    b = base.first()
    at = rows.join(F.broadcast(parts), "__part").select(F.col("value").alias("t"), *[(F.coalesce(F.sum(c).over(w), F.lit(0)) + F.col(d) + F.lit(b[c])).alias(c) for c, d in (("q", "pq"), ("tp", "pt"))])
    every = rows.agg((F.min("value") - 1.0).alias("t"), *[(F.coalesce(F.sum(c), F.lit(0)) + F.lit(b[c])).alias(c) for c in ("q", "tp")]).filter("t IS NOT NULL")
    return at.unionByName(every).withColumns({"p": F.lit(p), "n": F.lit(n)}).select("t", _metric(metric).alias("score"))


@dataclass
class Thresholds:
    us: list[float]
    vs: list[float]
    score: float | None = None
    log: list = field(default_factory=list)


def sweep(x: BoolMatrix, u: DataFrame, v: DataFrame, k: int, us: list[float], vs: list[float], metric: str = "F1", rounds: int | None = None) -> Thresholds:
    """One threshold a factor and side: each in turn (all of u, then all of v) at its best given the others, ties to the largest, until a
    round gains nothing. The score never falls. log: side, factor, threshold and score of every step."""
    out, p, n = Thresholds(list(us), list(vs)), x.ones.count(), x.m * x.n
    while rounds is None or rounds > 0:
        was = out.score
        for name, mine, other, key in (("u", u, v, "i"), ("v", v, u, "j")):
            at, across = (out.us, out.vs) if name == "u" else (out.vs, out.us)
            for f in range(k):
                best = threshold_metrics(*gained(x, mine, other, key, at, across, f), p, n, metric).orderBy(F.desc("score"), F.desc("t")).first()
                if best is not None and (out.score is None or best["score"] > out.score):
                    at[f], out.score = float(best["t"]), float(best["score"])
                out.log.append({"side": name, "f": f, "t": at[f], "score": out.score})
        rounds = None if rounds is None else rounds - 1
        if was is not None and out.score is not None and out.score <= was:
            break
        if out.score is None:
            break
    return out


def simple_threshold(x: BoolMatrix, u: DataFrame, v: DataFrame, k: int, by_metric: str = "F1", columnwise: bool = False, randomize: bool = False, n_grid: int = 40, n_trials: int = 1000, seed=0) -> Thresholds:
    """The thresholds of the best metric: from a grid of n_grid x n_grid, or by sweeps from the best of that grid (columnwise), or the best
    of n_trials random ones. Ties go to the smallest thresholds of a grid and to the first trial."""
    if randomize:
        trials = random_trials(x.cells.sparkSession, u, v, k, n_trials, columnwise, seed)
        best = trial_counts(x, u, v, k, trials).select("trial", _metric(by_metric).alias("score")).orderBy(F.desc("score"), "trial").first()
        return Thresholds(*trials[best["trial"]], best["score"])
    ends = [ranges(s, k) for s in (u, v)]
    at = [steps(min(a for a, _ in e), max(b for _, b in e), n_grid) for e in ends]
    best = grid_counts(x, u, v, k, *at).select("at_u", "at_v", _metric(by_metric).alias("score")).orderBy(F.desc("score"), "at_u", "at_v").first()
    out = Thresholds([best["at_u"]] * k, [best["at_v"]] * k, best["score"])
    if columnwise:
        swept = sweep(x, u, v, k, out.us, out.vs, by_metric)
        return swept if swept.score is not None and swept.score > out.score else out
    return out
