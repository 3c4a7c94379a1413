"""Continuous factorizations. A factor table has a key and the columns f0 .. f(k-1); U is keyed by i, V by j.

With all cells weighted alike, everything about U V^T follows from k x k Gram matrices and joins over the ones; with a mask, from
joins over the stored cells. Only where the model is nonlinear in the product are all m x n cells visited, and then as dense
blocks that hand on sums (`operators.blocks`). The driver holds k x k numbers and scalars. Literals are doubles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import gap, prox, sigmoid, uniform
from ..operators.algebra import unique_mapping
from ..operators.blocks import SIDE, on_blocks, sigmoid_of, sums_of
from ..operators.lineage import cut
from ..operators.matrix import BoolMatrix
from .stopping import limited, line_search, stop_reason

EPS = 1e-12
#: Below this a value of a start by singular vectors counts as zero.
TINY = 1e-6


def cols(k: int, p: str = "f") -> list[str]:
    return [f"{p}{f}" for f in range(k)]


def wide(side: DataFrame, key: str, k: int, value: str = "x") -> DataFrame:
    """(key, f, x) as one row a key."""
    at = lambda f: F.coalesce(F.sum(F.when(F.col("f") == f, F.col(value))), F.lit(0.0)).cast("double").alias(f"f{f}")
    return side.groupBy(key).agg(*[at(f) for f in range(k)])


def long(side: DataFrame, key: str, k: int) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(c).alias("x")) for f, c in enumerate(cols(k))]))
    return side.select(key, pairs.alias("p")).select(key, "p.f", "p.x")


def init(ids: DataFrame, key: str, k: int, average: float, method: str = "uniform", seed=0) -> DataFrame:
    """uniform: in [0, 2 x average); normal: |average x N(0, 1)|, from two uniforms."""

    def value(f):
        u = uniform(f"{seed}:{key}", F.col(key), F.lit(f))
        if method == "uniform":
            return 2.0 * average * u
        w = uniform(f"{seed}:{key}:angle", F.col(key), F.lit(f))
        return F.abs(average * F.sqrt(-2.0 * F.ln(1.0 - u)) * F.cos(2.0 * math.pi * w))

    return ids.select(key, *[value(f).alias(f"f{f}") for f in range(k)])


def start(x: BoolMatrix, k: int, method: str = "uniform", seed=0) -> tuple[DataFrame, DataFrame]:
    """U and V such that products average to the matrix's density."""
    if method.startswith("nndsvd"):
        return nndsvd(x, k, seed, fill={"nndsvd": None, "nndsvda": "mean", "nndsvdar": "random"}[method])
    average = math.sqrt(x.ones.count() / (x.m * x.n) / k)
    return init(x.rows, "i", k, average, method, seed), init(x.cols, "j", k, average, method, seed)


def gram(side: DataFrame, k: int) -> list[list[float]]:
    """side^T side: k x k numbers."""
    r = side.agg(*[F.sum(F.col(f"f{a}") * F.col(f"f{b}")).alias(f"g{a}_{b}") for a in range(k) for b in range(a, k)]).first()
    return [[float(r[f"g{min(a, b)}_{max(a, b)}"] or 0.0) for b in range(k)] for a in range(k)]


def _other(key: str) -> str:
    return "j" if key == "i" else "i"


def numerator(cells: DataFrame, other: DataFrame, key: str, k: int, weight: Column | None = None) -> DataFrame:
    """For each key the weighted sum of the other side's rows over its cells: columns n0 .. n(k-1)."""
    w = F.lit(1.0) if weight is None else weight
    return cells.join(other, _other(key)).groupBy(key).agg(*[F.sum(w * F.col(f"f{f}")).alias(f"n{f}") for f in range(k)])


def products(cells: DataFrame, u: DataFrame, v: DataFrame, k: int) -> DataFrame:
    """cells with `y`, the product of their row and column, and the factors as u0.., v0.. ."""
    left = u.withColumnsRenamed({f"f{f}": f"u{f}" for f in range(k)})
    right = v.withColumnsRenamed({f"f{f}": f"v{f}" for f in range(k)})
    y = sum((F.col(f"u{f}") * F.col(f"v{f}") for f in range(1, k)), F.col("u0") * F.col("v0"))
    return cells.join(left, "i").join(right, "j").withColumn("y", y)


def _times(g: list[list[float]], k: int) -> list[Column]:
    """Each row of a side times a k x k matrix."""
    return [sum((F.col(f"f{b}") * F.lit(g[b][a]) for b in range(1, k)), F.col("f0") * F.lit(g[0][a])) for a in range(k)]


def _sums(x: BoolMatrix, mine: DataFrame, other: DataFrame, key: str, k: int, w: str) -> DataFrame:
    """mine with numerators n0.. and denominators d0.. of the Frobenius updates."""
    top = numerator(x.ones, other, key, k)
    out = mine.join(top, key, "left").select(key, *cols(k), *[F.coalesce(F.col(f"n{f}"), F.lit(0.0)).alias(f"n{f}") for f in range(k)])
    if w == "full":
        return out.select("*", *[c.alias(f"d{f}") for f, c in enumerate(_times(gram(other, k), k))])
    u, v = (mine, other) if key == "i" else (other, mine)
    p = products(x.cells.select("i", "j"), u, v, k)
    side = "v" if key == "i" else "u"
    below = p.groupBy(key).agg(*[F.sum(F.col("y") * F.col(f"{side}{f}")).alias(f"d{f}") for f in range(k)])
    return out.join(below, key, "left").select(key, *cols(k), *cols(k, "n"), *[F.coalesce(F.col(f"d{f}"), F.lit(0.0)).alias(f"d{f}") for f in range(k)])


def wnmf_step(x: BoolMatrix, mine: DataFrame, other: DataFrame, key: str, k: int, w: str = "mask") -> DataFrame:
    """mine x numerator / denominator (Frobenius)."""
    s = _sums(x, mine, other, key, k, w)
    return s.select(key, *[(F.greatest(F.col(f"f{f}"), F.lit(EPS)) * F.col(f"n{f}") / F.greatest(F.col(f"d{f}"), F.lit(EPS))).alias(f"f{f}") for f in range(k)])


def wnmf_kl_step(x: BoolMatrix, mine: DataFrame, other: DataFrame, key: str, k: int, w: str = "mask") -> DataFrame:
    """The same for the Kullback-Leibler loss: ones over their products; the denominator sums the other side."""
    u, v = (mine, other) if key == "i" else (other, mine)
    side = "v" if key == "i" else "u"
    p = products(x.ones, u, v, k)
    top = p.groupBy(key).agg(*[F.sum(F.col(f"{side}{f}") / F.greatest(F.col("y"), F.lit(EPS))).alias(f"n{f}") for f in range(k)])
    s = mine.join(top, key, "left")
    if w == "full":
        total = other.agg(*[F.sum(f"f{f}").alias(f"d{f}") for f in range(k)])
        s = s.crossJoin(F.broadcast(total))
    else:
        s = s.join(numerator(x.cells.select("i", "j"), other, key, k).withColumnsRenamed({f"n{f}": f"d{f}" for f in range(k)}), key, "left")
    n, d = (lambda f: F.coalesce(F.col(f"n{f}"), F.lit(0.0))), (lambda f: F.greatest(F.coalesce(F.col(f"d{f}"), F.lit(0.0)), F.lit(EPS)))
    return s.select(key, *[(F.greatest(F.col(f"f{f}"), F.lit(EPS)) * n(f) / d(f)).alias(f"f{f}") for f in range(k)])


def cd_step(x: BoolMatrix, mine: DataFrame, other: DataFrame, key: str, k: int) -> DataFrame:
    """One sweep of coordinate descent: each column in turn at its best given the others, not below 0."""
    g = gram(other, k)
    s = mine.join(numerator(x.ones, other, key, k), key, "left")
    for f in range(k):
        slope = _times([[g[b][f]] * k for b in range(k)], k)[0] - F.coalesce(F.col(f"n{f}"), F.lit(0.0))
        s = s.withColumn(f"f{f}", F.greatest(F.col(f"f{f}") - slope / F.lit(max(g[f][f], EPS)), F.lit(0.0)))
    return s.select(key, *cols(k))


def frobenius_error(x: BoolMatrix, u: DataFrame, v: DataFrame, k: int, w: str = "full") -> float:
    """Half the sum of squared differences; over all cells by Gram matrices, or over the stored ones."""
    p = products(x.cells.select("i", "j", "x"), u, v, k)
    if w != "full":
        return float(p.agg(F.sum((F.col("x") - F.col("y")) ** 2).alias("e")).first()["e"] or 0.0) / 2
    r = p.filter("x = 1").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).first()
    a, b = gram(u, k), gram(v, k)
    return (r["n"] - 2 * (r["y"] or 0.0) + sum(a[s][t] * b[s][t] for s in range(k) for t in range(k))) / 2


def kl_error(x: BoolMatrix, u: DataFrame, v: DataFrame, k: int, w: str = "mask") -> float:
    """Sum of x log(x / y) - x + y over the stored cells, or all."""
    p = products(x.cells.select("i", "j", "x"), u, v, k)
    one = -F.ln(F.greatest(F.col("y"), F.lit(EPS))) - 1.0
    r = p.agg(F.sum(F.when(F.col("x") == 1, one).otherwise(0.0)).alias("a"), F.sum("y").alias("y")).first()
    if w != "full":
        return (r["a"] or 0.0) + (r["y"] or 0.0)
    total = lambda s: s.agg(*[F.sum(c).alias(c) for c in cols(k)]).first()
    a, b = total(u), total(v)
    return (r["a"] or 0.0) + sum(a[c] * b[c] for c in cols(k))


def nmf(x: BoolMatrix, k: int, w: str = "full", loss: str = "fro", solver: str = "mu", method: str = "uniform", max_iter: int = 30, tol: float = 0.0, min_diff: float = 0.0, seed=0, converged: float = 0.0, every: int = 1, u=None, v=None) -> tuple[DataFrame, DataFrame, list]:
    """V, then U, in turn, from a start or from given factors. loss: fro or kl; solver: mu or cd (all cells, fro). Returns U, V and the errors, of every so many rounds.
    converged: ends when ten rounds lower the root of the error by less than this share of the first one; every divides ten."""
    u, v = (cut(s) for s in (start(x, k, method, seed) if u is None else (u, v)))
    step = {("fro", "mu"): lambda a, b, key: wnmf_step(x, a, b, key, k, w), ("kl", "mu"): lambda a, b, key: wnmf_kl_step(x, a, b, key, k, w), ("fro", "cd"): lambda a, b, key: cd_step(x, a, b, key, k)}[loss, solver]
    error = (lambda: frobenius_error(x, u, v, k, w)) if loss == "fro" else (lambda: kl_error(x, u, v, k, w))
    errors: list = [error()]
    for n in range(1, max_iter + 1):
        v = cut(step(v, u, "j"), v)
        u = cut(step(u, v, "i"), u)
        if n % every and n < max_iter:
            continue
        errors.append(error())
        if stop_reason(errors[-1], tol, n, max_iter, abs(errors[-2] - errors[-1]), min_diff):
            break
        if converged and n % 10 == 0 and errors[-1 - 10 // every] ** 0.5 - errors[-1] ** 0.5 < converged * errors[0] ** 0.5:
            break
    return u, v, errors


def _sqrt_inverse(g: list[list[float]]):
    values, vectors = np.linalg.eigh(np.array(g))
    return vectors / np.sqrt(np.maximum(values, EPS))


def _rotated(side: DataFrame, key: str, k: int, m) -> DataFrame:
    return side.select(key, *[c.alias(f"f{f}") for f, c in enumerate(_times([[float(m[b][a]) for a in range(k)] for b in range(k)], k))])


def nndsvd(x: BoolMatrix, k: int, seed=0, rounds: int = 8, fill: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Start from leading singular vectors: subspace iteration by joins, orthonormal through k x k Grams; of each pair the
    positive or the negative parts, whichever weighs more. The spectrum's signs are as they come out. fill: zeros become the matrix's mean,
    or random numbers of a hundredth of it, so that multiplicative updates can move them."""
    v = init(x.cols, "j", k, 0.5, "uniform", seed)
    for _ in range(rounds):
        v = cut(_rotated(v, "j", k, _sqrt_inverse(gram(v, k))))
        u = numerator(x.ones, v, "i", k).withColumnsRenamed({f"n{f}": f"f{f}" for f in range(k)})
        v = numerator(x.ones, u, "j", k).withColumnsRenamed({f"n{f}": f"f{f}" for f in range(k)})
    v = cut(_rotated(v, "j", k, _sqrt_inverse(gram(v, k))))
    u = numerator(x.ones, v, "i", k).withColumnsRenamed({f"n{f}": f"f{f}" for f in range(k)})
    values, vectors = np.linalg.eigh(np.array(gram(u, k)))
    order = np.argsort(-values)
    values, vectors = np.maximum(values[order], EPS), vectors[:, order]
    u, v = _rotated(u, "i", k, vectors / np.sqrt(values)), cut(_rotated(v, "j", k, vectors))
    u = cut(x.rows.join(u, "i", "left").fillna(0.0, cols(k)))
    v = cut(x.cols.join(v, "j", "left").fillna(0.0, cols(k)))
    norms = {}
    for name, side in (("u", u), ("v", v)):
        r = side.agg(*[F.sqrt(F.sum(F.greatest(s * F.col(c), F.lit(0.0)) ** 2)).alias(f"{c}{t}") for c in cols(k) for s, t in ((1.0, "p"), (-1.0, "n"))]).first()
        norms[name] = {(c, t): r[f"{c}{t}"] or 0.0 for c in cols(k) for t in "pn"}
    out = []
    for name, side, key in (("u", u, "i"), ("v", v, "j")):
        made = []
        for f, c in enumerate(cols(k)):
            t = max("pn", key=lambda t: norms["u"][c, t] * norms["v"][c, t])  # noqa: B023
            weight = math.sqrt(math.sqrt(float(values[f])) * norms["u"][c, t] * norms["v"][c, t]) / max(norms[name][c, t], EPS)
            made.append((F.greatest((1.0 if t == "p" else -1.0) * F.col(c), F.lit(0.0)) * weight).alias(c))
        side = side.select(key, *made)
        if fill is not None:
            mean = x.ones.count() / (x.m * x.n)
            other = [F.lit(mean)] * k if fill == "mean" else [F.col(f"__{c}") for c in cols(k)]
            if fill == "random":
                noise = init(side.select(key), key, k, mean / 100, "normal", f"{seed}:fill")
                side = side.join(noise.withColumnsRenamed({c: f"__{c}" for c in cols(k)}), key)
            side = side.select(key, *[F.when(F.col(c) < TINY, o).otherwise(F.col(c)).alias(c) for c, o in zip(cols(k), other)])
        out.append(side)
    return tuple(out)


def normalized(u: DataFrame, v: DataFrame, k: int, method: str = "balance") -> tuple[DataFrame, DataFrame]:
    """balance: column maxima of both sides made equal; matrixwise or columnwise: divided by the largest value; matrixwise-mapping or
    columnwise-mapping: each value becomes its rank among the distinct ones, over their number."""
    if method.endswith("-mapping"):
        by = {"matrixwise-mapping": None, "columnwise-mapping": "f"}[method]
        return tuple(wide(unique_mapping(long(s, key, k), by), key, k) for s, key in ((u, "i"), (v, "j")))
    top = lambda s: s.agg(*[F.max(c).alias(c) for c in cols(k)]).first()
    a, b = top(u), top(v)
    a, b = [float(a[c] or 0.0) for c in cols(k)], [float(b[c] or 0.0) for c in cols(k)]
    if method == "balance":
        su = [math.sqrt(y / x) if x > 0 and y > 0 else 1.0 for x, y in zip(a, b)]
        sv = [1 / s for s in su]
    elif method == "matrixwise":
        su, sv = [1 / max(max(a), EPS)] * k, [1 / max(max(b), EPS)] * k
    elif method == "columnwise":
        su, sv = [1 / x if x > 0 else 1.0 for x in a], [1 / x if x > 0 else 1.0 for x in b]
    else:
        raise ValueError(f"unknown normalization: {method}")
    scale = lambda s, key, w: s.select(key, *[(F.col(c) * F.lit(w[f])).alias(c) for f, c in enumerate(cols(k))])
    return scale(u, "i", su), scale(v, "j", sv)


# ---- penalty -----------------------------------------------------------------------------------------------------------


def penalty_step(x: BoolMatrix, mine: DataFrame, other: DataFrame, key: str, k: int, reg: float, w: str = "full") -> DataFrame:
    """The multiplicative update that also pulls entries to 0 or 1, by reg."""
    s = _sums(x, mine, other, key, k, w)
    out = []
    for f in range(k):
        a = F.greatest(F.col(f"f{f}"), F.lit(EPS))
        out.append((a * (F.col(f"n{f}") + 3.0 * reg * a * a) / F.greatest(F.col(f"d{f}") + 2.0 * reg * a * a * a + reg * a, F.lit(EPS))).alias(f"f{f}"))
    return s.select(key, *out)


def binary_error(side: DataFrame, k: int) -> Column:
    """Half the sum of (x^2 - x)^2 over a side, as an aggregate."""
    return F.sum(sum(((F.col(c) * F.col(c) - F.col(c)) ** 2 for c in cols(k)), F.lit(0.0))) / 2.0


def penalty(x: BoolMatrix, k: int, u=None, v=None, reg: float = 2.0, reg_growth: float = 3.0, max_reg: float = 1e10, tol: float = 0.01, min_diff: float = 0.0, max_iter: int = 100, w: str = "full", seed=0, link: float | None = None):
    """Penalty method; link: with a sigmoid of that steepness on the product."""
    if u is None:
        u, v = nmf(x, k, "full", max_iter=10, seed=seed)[:2]
    u, v = (cut(s) for s in normalized(u, v, k))
    errors: list = []
    for n in range(1, max_iter + 1):
        if link is None:
            v = cut(penalty_step(x, v, u, "j", k, reg, w), v)
            u = cut(penalty_step(x, u, v, "i", k, reg, w), u)
        else:
            v = cut(pnlpf_step(x, v, u, "j", k, reg, link), v)
            u = cut(pnlpf_step(x, u, v, "i", k, reg, link), u)
        reg = min(reg * reg_growth, max_reg)
        errors.append(sum(s.agg(binary_error(s, k).alias("e")).first()["e"] for s in (u, v)))
        diff = abs(errors[-2] - errors[-1]) if n > 1 else None
        if stop_reason(errors[-1], tol, n, max_iter, diff, min_diff):
            break
    return u, v, errors


def pnlpf_step(x: BoolMatrix, mine: DataFrame, other: DataFrame, key: str, k: int, reg: float, link: float, side: int = SIDE) -> DataFrame:
    """The penalty update under a sigmoid link, over all cells."""
    u, v = (mine, other) if key == "i" else (other, mine)

    def body(i, j, a, b, ones):
        s = sigmoid_of(link * (a @ b.T - 0.5))
        d = s * (1.0 - s)
        top, low, across = (ones * d, s * d, b) if key == "i" else ((ones * d).T, (s * d).T, a)
        top, low = top @ across, low @ across
        return sums_of(key, i if key == "i" else j, {f"n{f}": top[:, f] for f in range(k)} | {f"d{f}": low[:, f] for f in range(k)})

    kind = mine.schema[key].dataType.simpleString()
    parts = on_blocks(x, u, v, body, ", ".join([f"{key} {kind}", *[f"{c} double" for c in cols(k, "n") + cols(k, "d")]]), side)
    t = mine.join(parts.groupBy(key).agg(*[F.sum(c).alias(c) for c in cols(k, "n") + cols(k, "d")]), key)
    out = []
    for f in range(k):
        a = F.greatest(F.col(f"f{f}"), F.lit(EPS))
        below = F.lit(float(link)) * F.col(f"d{f}") + 2.0 * reg * a * a * a + reg * a
        out.append((a * (F.lit(float(link)) * F.col(f"n{f}") + 3.0 * reg * a * a) / F.greatest(below, F.lit(EPS))).alias(f"f{f}"))
    return t.select(key, *out)


def link_error(x: BoolMatrix, u: DataFrame, v: DataFrame, link: float, side: int = SIDE) -> float:
    """Half the squared error of the sigmoid of the product, over all cells."""

    def body(i, j, a, b, ones):
        return pa.table({"e": [float(np.square(ones - sigmoid_of(link * (a @ b.T - 0.5))).sum())]})

    return float(on_blocks(x, u, v, body, "e double", side).agg(F.sum("e").alias("e")).first()["e"] or 0.0) / 2.0


# ---- thresholds --------------------------------------------------------------------------------------------------------


def _soft(side: DataFrame, key: str, k: int, at: float, lam: float) -> DataFrame:
    return side.select(key, *[sigmoid(F.lit(float(lam)) * (F.col(c) - F.lit(float(at)))).alias(c) for c in cols(k)])


def threshold_value(x: BoolMatrix, u: DataFrame, v: DataFrame, k: int, at: list[float], lam: float, w: str = "full") -> float:
    """F(u, v): the Frobenius error of the two sides made soft Booleans at these thresholds."""
    return frobenius_error(x, _soft(u, "i", k, at[0], lam), _soft(v, "j", k, at[1], lam), k, w)


def threshold_gradient(x: BoolMatrix, u: DataFrame, v: DataFrame, k: int, at: list[float], lam: float, w: str = "full") -> list[float]:
    su, sv = _soft(u, "i", k, at[0], lam), _soft(v, "j", k, at[1], lam)
    out = []
    for mine, other, key in ((su, sv, "i"), (sv, su, "j")):
        s = _sums(x, mine, other, key, k, w)
        slope = sum(((F.col(f"n{f}") - F.col(f"d{f}")) * lam * F.col(f"f{f}") * (1.0 - F.col(f"f{f}")) for f in range(k)), F.lit(0.0))
        out.append(float(s.agg(F.sum(slope).alias("g")).first()["g"] or 0.0))
    return out


def threshold(x: BoolMatrix, u: DataFrame, v: DataFrame, k: int, start_at=(0.5, 0.5), lam: float = 100.0, min_diff: float = 1e-3, max_iter: int = 100, w: str = "full") -> tuple[list[float], list[float]]:
    """The two thresholds of least error, by descent with line search; they stay within the sides' values."""
    ends = [s.agg(F.min(F.least(*cols(k)) if k > 1 else F.col("f0")).alias("a"), F.max(F.greatest(*cols(k)) if k > 1 else F.col("f0")).alias("b")).first() for s in (u, v)]
    low, high = [e["a"] + 1e-6 for e in ends], [e["b"] - 1e-6 for e in ends]
    at = [min(max(a, lo), hi) for a, lo, hi in zip(start_at, low, high)]
    f, g = (lambda p: threshold_value(x, u, v, k, p, lam, w)), (lambda p: threshold_gradient(x, u, v, k, p, lam, w))
    values = [f(at)]
    for _ in range(max_iter):
        p = [-d for d in g(at)]
        if not any(p):
            break
        alpha = limited(line_search(f, g, at, p, max_iter=10)[0], at, p, low, high)
        new = [a + alpha * d for a, d in zip(at, p)]
        value = f(new)
        if value >= values[-1]:
            break
        at = new
        values.append(value)
        if values[-2] - values[-1] < min_diff:
            break
    return at, values


def threshold_grid(x: BoolMatrix, u: DataFrame, v: DataFrame, k: int, pairs: list[tuple[float, float]], n_cells: int) -> DataFrame:
    """at_u, at_v, p, q, tp, n for each pair of thresholds: all pairs by one query. Masks tell what a row or column has above a
    threshold, and rows and columns are counted by masks."""
    spark = u.sparkSession
    at = [sorted({p[d] for p in pairs}) for d in (0, 1)]

    def masked(side, key, values, name):
        bits = lambda t: sum((F.when(F.col(c) > t, F.lit(1 << f).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for f, c in enumerate(cols(k))), F.lit(0).cast("bigint"))
        table = F.broadcast(spark.createDataFrame([(t,) for t in values], f"{name} double"))
        return side.crossJoin(table).select(key, name, bits(F.col(name)).alias(f"m{key}"))

    mu, mv = masked(u, "i", at[0], "at_u"), masked(v, "j", at[1], "at_v")
    asked = F.broadcast(spark.createDataFrame(pairs, "at_u double, at_v double"))
    nu, nv = mu.groupBy("at_u", "mi").agg(F.count(F.lit(1)).alias("nu")), mv.groupBy("at_v", "mj").agg(F.count(F.lit(1)).alias("nv"))
    hit = F.col("mi").bitwiseAND(F.col("mj")) != 0
    q = nu.join(asked, "at_u").join(nv, "at_v").groupBy("at_u", "at_v").agg(F.coalesce(F.sum(F.when(hit, F.col("nu") * F.col("nv"))), F.lit(0)).alias("q"))
    # ones are counted by pairs of masks before the pairs of thresholds meet
    tp = x.ones.join(mu, "i").join(mv, "j").join(asked, ["at_u", "at_v"]).groupBy("at_u", "at_v").agg(F.count(F.lit(1)).alias("p"), F.sum(hit.cast("bigint")).alias("tp"))
    return q.join(tp, ["at_u", "at_v"]).select("at_u", "at_v", "p", "q", "tp", F.lit(n_cells).cast("bigint").alias("n"))


def boolean(side: DataFrame, key: str, k: int, at: float = 0.5) -> DataFrame:
    """(key, f) above a threshold."""
    return long(side, key, k).filter(F.col("x") > F.lit(float(at))).select(key, "f")


# ---- FastStep ----------------------------------------------------------------------------------------------------------


def faststep_loss(x: BoolMatrix, u: DataFrame, v: DataFrame, tau: float, side: int = SIDE) -> DataFrame:
    """f, one row: the sum of softplus(-M (y - tau)) over all cells; M is 1 for ones and -1 for others."""

    def body(i, j, a, b, ones):
        y = a @ b.T - tau
        return pa.table({"f": [float(np.logaddexp(0.0, np.where(ones, -y, y)).sum())]})

    return on_blocks(x, u, v, body, "f double", side).agg(F.sum("f").alias("f"))


def faststep_value(x, u, v, tau, side: int = SIDE) -> float:
    return float(faststep_loss(x, u, v, tau, side).first()["f"] or 0.0)


def faststep_gradient(x, u, v, k, tau, f: int, side: int = SIDE) -> tuple[DataFrame, DataFrame]:
    """(i, g) and (j, g) for factor f."""

    def slopes(y, ones):
        return np.where(ones, -sigmoid_of(-y), sigmoid_of(y))

    def body(key):
        def made(i, j, a, b, ones):
            w = slopes(a @ b.T - tau, ones)
            return sums_of("i", i, {"g": w @ b[:, f]}) if key == "i" else sums_of("j", j, {"g": w.T @ a[:, f]})

        return made

    kinds = {"i": x.rows.schema["i"].dataType.simpleString(), "j": x.cols.schema["j"].dataType.simpleString()}
    return tuple(on_blocks(x, u, v, body(key), f"{key} {kinds[key]}, g double", side).groupBy(key).agg(F.sum("g").alias("g")) for key in ("i", "j"))


def faststep_steps(x, u, v, k, tau, f: int, gu: DataFrame, gv: DataFrame, alphas: list[float], low: float, side: int = SIDE) -> list[float]:
    """The loss after a step of each length along both gradients of factor f, none below `low`: all lengths in one pass over the cells."""
    u, v = u.join(gu, "i", "left").fillna(0.0, ["g"]), v.join(gv, "j", "left").fillna(0.0, ["g"])

    def body(i, j, a, b, ones):
        y = a[:, :k] @ b[:, :k].T - tau - np.outer(a[:, f], b[:, f])
        out = []
        for alpha in alphas:
            z = y + np.outer(np.maximum(a[:, f] - alpha * a[:, k], low), np.maximum(b[:, f] - alpha * b[:, k], low))
            out.append(float(np.logaddexp(0.0, np.where(ones, -z, z)).sum()))
        return pa.table({"n": list(range(len(alphas))), "f": out})

    found = {r["n"]: r["f"] for r in on_blocks(x, u.select("i", *cols(k), "g"), v.select("j", *cols(k), "g"), body, "n bigint, f double", side).groupBy("n").agg(F.sum("f").alias("f")).collect()}
    return [found[n] for n in range(len(alphas))]


LENGTHS = 5


def faststep(x: BoolMatrix, k: int, tau: float = 20.0, max_round: int = 30, max_iter: int = 50, min_diff: float = 1e-2, seed=0, u=None, v=None):
    """Surrogate loss by projected descent, one pair of factors at a time; predicts y > tau."""
    given = u is not None
    u, v = (cut(s) for s in ((u, v) if given else start(x, k, "uniform", seed)))
    for s, key in () if given else ((u, "i"), (v, "j")):
        top = float(s.agg(F.max(F.greatest(*cols(k)) if k > 1 else F.col("f0")).alias("t")).first()["t"] or 1.0)
        s = s.select(key, *[(F.col(c) / top * (0.01 - 1e-5) + 1e-5).alias(c) for c in cols(k)])
        u, v = (cut(s), v) if key == "i" else (u, cut(s))
    values, low = [faststep_value(x, u, v, tau)], 1e-5
    for _ in range(max_round):
        before = values[-1]
        for f in range(k):
            for _ in range(max_iter):
                gu, gv = (cut(g) for g in faststep_gradient(x, u, v, k, tau, f))
                alpha, value = None, values[-1]
                for at in range(0, 20, LENGTHS):  # 2, 1, 1/2, ...: the first that lowers the loss
                    lengths = [2.0**-n for n in range(at - 1, at - 1 + LENGTHS)]
                    found = faststep_steps(x, u, v, k, tau, f, gu, gv, lengths, low)
                    if better := [(a, e) for a, e in zip(lengths, found, strict=True) if e < values[-1]]:
                        alpha, value = better[0]
                        break
                if alpha is None:
                    break
                u, v = (cut(s.join(g, key, "left").withColumn(f"f{f}", F.greatest(F.col(f"f{f}") - alpha * F.coalesce("g", F.lit(0.0)), F.lit(low))).drop("g")) for s, g, key in ((u, gu, "i"), (v, gv, "j")))
                values.append(value)
                if values[-2] - value < min_diff:
                    break
        if before - values[-1] < min_diff:
            break
    return u, v, values


# ---- proximal ----------------------------------------------------------------------------------------------------------


def lipschitz(g: list[list[float]], norm: str = "spectral") -> float:
    return max(float(np.linalg.norm(np.array(g), 2 if norm == "spectral" else "fro")), 1e-4)


def palm_step(x: BoolMatrix, mine: DataFrame, other: DataFrame, key: str, k: int, l1: float, l2: float, beta: float = 0.0, old: DataFrame | None = None, norm: str = "spectral", clip: str = "nonnegative") -> DataFrame:
    """Gradient step on one side by its Gram and the ones, then the proximal pull; beta: inertia from `old`."""
    g = gram(other, k)
    size = lipschitz(g, norm)
    eta = 1.0 / (1.1 * size) if beta == 0 else 2.0 * (1.0 - beta) / (1.0 + 2.0 * beta) / size
    if beta and old is not None:
        past = old.withColumnsRenamed({f"f{f}": f"o{f}" for f in range(k)})
        mine = mine.join(past, key).select(key, *[(F.col(f"f{f}") + beta * (F.col(f"f{f}") - F.col(f"o{f}"))).alias(f"f{f}") for f in range(k)])
    s = mine.join(numerator(x.ones, other, key, k), key, "left")
    moved = [F.col(f"f{f}") - eta * (t - F.coalesce(F.col(f"n{f}"), F.lit(0.0))) for f, t in enumerate(_times(g, k))]
    s = s.select(key, *[m.alias(f"f{f}") for f, m in enumerate(moved)])
    return s.select(key, *[prox(F.col(c), l1 * eta, l2 * eta, clip).alias(c) for c in cols(k)])


def integrality(side: DataFrame, k: int, kappa: float, lam: float) -> float:
    return float(side.agg(F.sum(sum((gap(F.col(c), kappa, lam) for c in cols(k)), F.lit(0.0))).alias("g")).first()["g"] or 0.0)


def rounded(side: DataFrame, key: str, k: int) -> DataFrame:
    """Every value at the nearer of 0 and 1 (0.5 goes down)."""
    return side.select(key, *[F.round(prox(F.col(c), 0.5, 1e20, "box")).alias(c) for c in cols(k)])


def elbmf(x: BoolMatrix, k: int, l1: float = 0.01, l2: float = 0.02, growth: float = 1.02, beta: float = 0.0, max_iter: int = 100, min_diff: float = 1e-8, norm: str = "spectral", clip: str = "nonnegative", seed=0, round_at_end: bool = True, u=None, v=None):
    """Elastic-net Boolean factorization by alternating proximal steps, with inertia if beta > 0; l2 grows every round. U moves
    first and V sees the new U; the momentum is that of the last step."""
    if u is None:
        u, v = start(x, k, "uniform", seed)
    u, v = cut(u), cut(v)
    old_u, old_v, errors, reg = u, v, [], l2
    for n in range(1, max_iter + 1):
        new_u = cut(palm_step(x, u, v, "i", k, l1, reg, beta, old_u, norm, clip))
        new_v = cut(palm_step(x, v, new_u, "j", k, l1, reg, beta, old_v, norm, clip))
        old_u, old_v, u, v = u, v, new_u, new_v
        reg *= growth
        errors.append(frobenius_error(x, u, v, k, "full"))
        if n > 1 and abs(errors[-2] - errors[-1]) < min_diff:
            break
        if integrality(u, k, l1, l2) + integrality(v, k, l1, l2) < min_diff:
            break
    if round_at_end:
        u, v = cut(rounded(u, "i", k)), cut(rounded(v, "j", k))
    return u, v, errors


def primp(x: BoolMatrix, k: int, reg: float = 0.01, growth: float = 1.02, beta: float = 1e-4, max_iter: int = 1000, min_diff: float = 1e-8, seed=0):
    """The same with an L1 pull alone, values in [0, 1] and steps by the Frobenius norm."""
    return elbmf(x, k, reg, 0.0, growth, beta, max_iter, min_diff, "fro", "box", seed)
