"""Greedy factorizations: each round finds one pattern, rows x columns, as one query whose best row reaches the driver.

U holds (i, f), V holds (j, f): pattern f has row i and column j. What is covered follows from each id's set of factors (its mask), so
neither the product nor the residual is kept between rounds. Ties go to the smallest id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalar import ratio
from ..operators import algebra, bits, metrics
from ..operators.lineage import cut
from ..operators.matrix import BoolMatrix, factorized


@dataclass
class Fit:
    """Factors and a log of rounds; u and v are None before the first pattern."""

    u: DataFrame | None = None
    v: DataFrame | None = None
    k: int = 0
    log: list = field(default_factory=list)

    def add(self, rows: DataFrame, cols: DataFrame, **said) -> None:
        u, v = rows.select("i", F.lit(self.k).alias("f")), cols.select("j", F.lit(self.k).alias("f"))
        self.u = cut(u if self.u is None else self.u.unionByName(u))
        self.v = cut(v if self.v is None else self.v.unionByName(v))
        self.log.append({"f": self.k, **said})
        self.k += 1

    def counts(self, x: BoolMatrix) -> dict:
        if self.u is None:
            p = x.ones.count()
            return {"p": p, "q": 0, "tp": 0, "n": x.m * x.n}
        return metrics.factor_counts(x.ones, self.u, self.v, x.m * x.n).first().asDict()

    def predict(self) -> DataFrame:
        return algebra.bool_matmul(self.u, self.v)


def cells(x: BoolMatrix, fit: Fit) -> DataFrame:
    """The ones (i, j) with `hit`: covered so far."""
    if fit.u is None:
        return x.ones.withColumn("hit", F.lit(False))
    return algebra.predicted(x.ones, fit.u, fit.v)


def _masked(table: DataFrame, key: str, side: DataFrame | None) -> DataFrame:
    none = F.array().cast("array<int>")
    if side is None:
        return table.withColumn(f"m{key}", none)
    return table.join(algebra.masks(side, key).withColumnRenamed("mask", f"m{key}"), key, "left").withColumn(f"m{key}", F.coalesce(f"m{key}", none))


# ---- association rules -------------------------------------------------------------------------------------------------


#: Ones of a row that meet at once.
TILE = 2000


def row_pairs(ones: DataFrame, tile: int = TILE) -> DataFrame:
    """p, q and the key (i, a, b) under which they meet: all pairs of ones of a row. The ones of a row of more than `tile` are dealt to tiles,
    and every two tiles of the row meet under a key of their own, so no key makes many more than tile x tile pairs."""
    many = ones.groupBy("i").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("__s")).filter("__s > 1")
    dealt = ones.join(many, "i", "left").withColumn("__s", F.coalesce("__s", F.lit(1))).withColumn("__t", F.pmod(F.xxhash64("j"), F.col("__s")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("__s") - 1))
    left = dealt.select("i", F.col("j").alias("p"), F.col("__t").alias("a"), every.alias("b"))
    return left.join(dealt.select("i", F.col("j").alias("q"), every.alias("a"), F.col("__t").alias("b")), ["i", "a", "b"])


def associations(x: BoolMatrix, by: str = "j", tile: int | None = None, dense: bool | None = None) -> DataFrame:
    """p, q, c: the share of p's ones that q has too, over columns (by 'j') or rows (by 'i'); pairs without any are left out. dense: by
    products of bits instead of a join; if not given, whichever costs less, and a join if a tile is given."""
    ones = x.ones if by == "j" else x.T.ones
    if dense or dense is None and tile is None and bits.pays(ones):
        return bits.shares(cut(ones))
    tile = TILE if tile is None else tile
    size = ones.groupBy("j").agg(F.count(F.lit(1)).alias("size"))
    pairs = row_pairs(ones, tile).groupBy("p", "q").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(size.withColumnRenamed("j", "p"), "p").select("p", "q", ratio(F.col("n"), F.col("size")).alias("c"))


def basis(assoc: DataFrame, tau: float) -> DataFrame:
    """p, j: candidate column sets."""
    return assoc.filter(F.col("c") > F.lit(float(tau))).select("p", F.col("q").alias("j"))


def gains(x: BoolMatrix, candidates: DataFrame, fit: Fit, w_fp, w_fn) -> DataFrame:
    """i, p, gain: by how much row i's cover grows if it takes candidate p; only rows that gain.

    A row gains only through ones that are still uncovered, so the join starts from those; what of a candidate is covered already
    depends on the row's mask alone and is counted once for each distinct mask."""
    left = cells(x, fit).filter(~F.col("hit"))
    r = left.join(candidates, "j").groupBy("i", "p").agg(F.count(F.lit(1)).alias("r"))
    size = candidates.groupBy("p").agg(F.count(F.lit(1)).alias("size"))
    r = _masked(r, "i", fit.u).join(size, "p")
    if fit.u is None:
        covered = F.lit(0)
    else:
        distinct = algebra.masks(fit.u, "i").select(F.col("mask").alias("mi")).distinct()
        c = algebra.hit_pairs(_masked(candidates, "j", fit.v).groupBy("p", "mj").agg(F.count(F.lit(1)).alias("n")), "mj", distinct, "mi")
        r = r.join(c.groupBy("mi", "p").agg(F.sum("n").alias("c")), ["mi", "p"], "left")
        covered = F.coalesce(F.col("c"), F.lit(0))
    gain = (w_fp + w_fn) * F.col("r") + w_fp * covered - w_fp * F.col("size")
    return r.select("i", "p", gain.alias("gain")).filter("gain > 0")


def asso(x: BoolMatrix, k: int, tau: float, w_fp=1, w_fn=1, candidates: DataFrame | None = None, dense: bool | None = None) -> Fit:
    """Candidate columns by association, each round the one whose rows gain most. Weights are best given as integers. dense: candidates are
    scored by products of bits, and only the one that is taken becomes a table; if not given, whichever costs less."""
    if candidates is None and (bits.pays(x.ones) if dense is None else dense):
        return _asso_dense(x, k, tau, w_fp, w_fn)
    fit = Fit()
    candidates = cut(basis(associations(x, dense=False), tau)) if candidates is None else candidates
    used: list = []
    while fit.k < k:
        free = candidates.join(_few(candidates, "p", used), "p", "left_anti") if used else candidates
        g = gains(x, free, fit, w_fp, w_fn)
        best = g.groupBy("p").agg(F.sum("gain").alias("gain"), F.count(F.lit(1)).alias("rows")).orderBy(F.desc("gain"), "p").limit(1).collect()
        if not best:
            break
        p = best[0]["p"]
        fit.add(g.filter(F.col("p") == F.lit(p)), candidates.filter(F.col("p") == F.lit(p)), p=p, gain=best[0]["gain"], n_rows=best[0]["rows"])
        used.append(p)
    return fit


def _asso_dense(x: BoolMatrix, k: int, tau: float, w_fp, w_fn) -> Fit:
    x = BoolMatrix(cut(x.cells), x.rows, x.cols)
    fit, used = Fit(), []
    while fit.k < k:
        planes = cells(x, fit).select("i", "j", F.col("hit").cast("int").alias("plane"))
        if fit.u is not None:
            planes = planes.unionByName(fit.predict().withColumn("plane", F.lit(2)))
        g = bits.cover_gains(planes, tau, w_fp, w_fn)
        free = g.join(_few(g, "p", used), "p", "left_anti") if used else g
        best = free.orderBy(F.desc("gain"), "p").limit(1).collect()
        if not best:
            break
        p = best[0]["p"]
        mine = x.ones.filter(F.col("j") == F.lit(p)).select("i")
        common = x.ones.join(mine, "i").groupBy("j").agg(F.count(F.lit(1)).alias("n"))
        columns = cut(common.filter(ratio(F.col("n"), F.lit(mine.count())) > F.lit(float(tau))).select(F.lit(p).alias("p"), "j"))
        fit.add(gains(x, columns, fit, w_fp, w_fn), columns, p=p, gain=best[0]["gain"], n_rows=best[0]["rows"])
        used.append(p)
    return fit


def _few(like: DataFrame, key: str, values: list) -> DataFrame:
    """A few values of a key as a table to join with."""
    return F.broadcast(like.sparkSession.createDataFrame([(v,) for v in values], like.select(key).schema))


def without(fit: Fit, f: int) -> Fit:
    return Fit(fit.u.filter(F.col("f") != f), fit.v.filter(F.col("f") != f), fit.k)


def refitted_column(x: BoolMatrix, fit: Fit, f: int, w_fp=1, w_fn=1) -> DataFrame:
    """i, f: the rows that gain from pattern f's columns, given the other patterns."""
    columns = fit.v.filter(F.col("f") == f).select(F.lit(f).alias("p"), "j")
    return gains(x, columns, without(fit, f), w_fp, w_fn).select("i", F.col("p").alias("f"))


def asso_iter(x: BoolMatrix, fit: Fit, w_fp=1, w_fn=1, max_rounds: int | None = None) -> Fit:
    """Re-fits the rows of one pattern after the other; a change stays only if the error falls; ends after k without one, or after
    max_rounds, which the log then says. The error falls by whole steps, so without a limit it ends too."""
    error = lambda t: t["p"] + t["q"] - 2 * t["tp"]
    best, still, f = error(fit.counts(x)), 0, 0
    out = Fit(fit.u, fit.v, fit.k, list(fit.log))
    rounds = 0
    while still < fit.k:
        if rounds == max_rounds:
            out.log.append({"converged": False, "rounds": rounds})
            break
        rounds += 1
        new = Fit(cut(without(out, f).u.unionByName(refitted_column(x, out, f, w_fp, w_fn))), out.v, out.k, out.log)
        now = error(new.counts(x))
        if now < best:
            out, best, still = new, now, 0
        else:
            still += 1
        f = (f + 1) % fit.k
    return out


#: Distinct column masks that a search for best sets holds in memory.
MASKS = 1_000_000


def best_set(gain: np.ndarray, member: np.ndarray) -> tuple[list[int], int]:
    """The set of patterns whose covered masks gain most, and that gain. gain: of each mask; member: masks x patterns. Of equal sets the one
    that leaves out the first patterns. Patterns are decided in order, out before in; a branch ends where all masks that are still open
    and gain cannot bring it above the best."""
    k = member.shape[1]
    useful = [f for f in range(k) if (member[:, f] & (gain > 0)).any()]  # others only cost
    later = np.zeros((len(useful) + 1, len(gain)), bool)
    for n in range(len(useful) - 1, -1, -1):
        later[n] = later[n + 1] | member[:, useful[n]]
    best: tuple[list[int], int] = ([], 0)
    stack = [(0, [], 0, np.zeros(len(gain), bool))]
    while stack:
        n, chosen, score, covered = stack.pop()
        if score > best[1]:
            best = (chosen, score)
        if n == len(useful) or score + np.maximum(gain[later[n] & ~covered], 0).sum() <= best[1]:
            continue
        new = member[:, useful[n]] & ~covered
        if new.any():
            stack.append((n + 1, [*chosen, useful[n]], score + gain[new].sum(), covered | new))
        stack.append((n + 1, chosen, score, covered))
    return best


def best_sets(x: BoolMatrix, fit: Fit, w_fp=1, w_fn=1) -> DataFrame:
    """i, factors, score: for each row the set of patterns of the best cover, for any number of patterns.

    A set's score needs only how many ones the row has in the columns of each distinct mask: its signature. The search runs once for each
    distinct signature, as rows of a DataFrame."""
    cols = _masked(x.cols, "j", fit.v)
    sizes = cols.filter("size(mj) > 0").groupBy("mj").agg(F.count(F.lit(1)).alias("size"))
    n = sizes.count()
    if n > MASKS:
        raise ValueError(f"{n} distinct sets of patterns over the columns; a search holds at most {MASKS}")
    held = sorted((tuple(r["mj"]), r["size"]) for r in sizes.collect())
    place = {m: at for at, (m, _) in enumerate(held)}
    member = np.zeros((n, fit.k), bool)
    for at, (m, _) in enumerate(held):
        member[at, list(m)] = True
    size = np.array([s for _, s in held])
    numbered = F.broadcast(x.cells.sparkSession.createDataFrame([(list(m), at) for m, at in place.items()], "mj array<int>, at int"))
    mine = x.ones.join(cols.join(numbered, "mj").select("j", "at"), "j").groupBy("i", "at").agg(F.count(F.lit(1)).alias("n"))
    signed = mine.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("signature"))

    def search(batches):
        for batch in batches:
            found = []
            for signature in batch.column("signature").to_pylist():
                gain = -w_fp * size
                for s in signature:
                    gain[s["at"]] += (w_fn + w_fp) * s["n"]
                found.append(best_set(gain, member))
            yield pa.RecordBatch.from_arrays([batch.column("signature"), pa.array([f for f, _ in found], pa.list_(pa.int32())), pa.array([float(s) for _, s in found])], names=["signature", "factors", "score"])

    solved = signed.select("signature").distinct().mapInArrow(search, f"signature {signed.schema['signature'].dataType.simpleString()}, factors array<int>, score double")
    rows = x.rows.join(signed.join(solved, "signature"), "i", "left")
    return rows.select("i", F.coalesce("factors", F.array().cast("array<int>")).alias("factors"), F.coalesce("score", F.lit(0.0)).alias("score"))


def asso_opt(x: BoolMatrix, fit: Fit, w_fp=1, w_fn=1) -> DataFrame:
    """i, choice, score: the best set of each row as a number, in which bit k - 1 is pattern 0 (ties: the smallest)."""
    if fit.k > 62:
        raise ValueError("a choice among more than 62 patterns is no long; best_sets gives it as an array")
    bit = lambda a, f: a + F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(fit.k - 1) - f)
    return best_sets(x, fit, w_fp, w_fn).select("i", F.aggregate("factors", F.lit(0).cast("bigint"), bit).alias("choice"), "score")


def rows_of_choice(choices: DataFrame, k: int) -> DataFrame:
    """(i, choice) as U(i, f)."""
    return choices.select("i", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("f"), "choice").filter(F.getbit("choice", F.lit(k - 1) - F.col("f")) == 1).select("i", "f")


def transposed(model, x: BoolMatrix, *args, **kw) -> Fit:
    """A model fitted to the transposed matrix, with its factors exchanged."""
    fit = model(x.T, *args, **kw)
    return Fit(fit.v.select(F.col("j").alias("i"), "f"), fit.u.select(F.col("i").alias("j"), "f"), fit.k, fit.log)


# ---- formal concepts ---------------------------------------------------------------------------------------------------


#: Rows of a column that say which other columns may be in its closure.
WITNESSES = 8


def witnesses(inside: DataFrame, size: DataFrame) -> DataFrame:
    """a, size, i, n: the WITNESSES smallest rows (of n ones) of each column a of size."""
    row = inside.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    few = inside.select("i", F.col("j").alias("a")).join(size, "a").join(row, "i")
    return few.withColumn("__k", F.row_number().over(Window.partitionBy("a").orderBy("n", "i"))).filter(F.col("__k") <= WITNESSES).drop("__k")


def closure_candidates(inside: DataFrame, size: DataFrame) -> DataFrame:
    """a, b, size: for each column a of size the columns b that its witnesses all have. The closure of a lies within them."""
    met = witnesses(inside, size).join(inside.select("i", F.col("j").alias("b")), "i").groupBy("a", "b").agg(F.count(F.lit(1)).alias("__w"), F.first("size").alias("size"))
    return met.filter(F.col("__w") == F.least(F.col("size"), F.lit(WITNESSES))).drop("__w")


def concept_step(x: BoolMatrix, left: DataFrame, rows: DataFrame | None, cols: list, beyond: int = 0, log: dict | None = None) -> DataFrame:
    """j, score: for each further column the uncovered ones of the concept that it makes of `rows`: the rows that have it, and the
    columns that all of those have. left: ones with hit; columns that cannot get beyond a score are left out.

    Pairs of columns are not made row by row: a few rows of a column leave few others for its closure, the uncovered ones of those bound
    its score, and only what is left meets all the rows. log: counts the pairs made in rows, and those that all rows would make."""
    inside = left if rows is None else left.join(rows, "i", "left_semi")
    count = inside.groupBy("j").agg(F.count(F.lit(1)).alias("size"), F.sum((~F.col("hit")).cast("int")).alias("open"))
    size = count.filter("open > 0").select(F.col("j").alias("a"), "size")
    if cols:
        size = size.join(_few(x.cols, "j", cols).withColumnRenamed("j", "a"), "a", "left_anti")
    near = closure_candidates(inside, size)
    most = near.join(count.select(F.col("j").alias("b"), "open"), "b").groupBy("a").agg(F.sum(F.least("size", "open")).alias("most")).filter(F.col("most") > beyond)
    if beyond:
        near = near.join(most, "a", "left_semi")
    if log is not None:
        log["pairs"] = log.get("pairs", 0) + (witnesses(inside, size).agg(F.sum("n").alias("n")).first()["n"] or 0) + (near.agg(F.sum("size").alias("n")).first()["n"] or 0)
        log["of"] = log.get("of", 0) + (inside.groupBy("i").count().agg(F.sum(F.col("count") * F.col("count")).alias("n")).first()["n"] or 0)
    pairs = near.join(inside.select("i", F.col("j").alias("a")), "a").join(inside.select("i", F.col("j").alias("b"), (~F.col("hit")).cast("int").alias("r")), ["i", "b"])
    closed = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("r"), F.first("size").alias("size")).filter("n = size")
    return closed.groupBy(F.col("a").alias("j")).agg(F.sum("r").alias("score"), F.collect_list("b").alias("closure"))


def concept(x: BoolMatrix, fit: Fit, log: dict | None = None) -> tuple[DataFrame, DataFrame, int] | None:
    """Rows, columns and newly covered ones of the next concept, grown column by column while that number grows."""
    spark = x.cells.sparkSession
    left = cut(cells(x, fit))
    rows, cols, score = None, [], 0
    while True:
        best = concept_step(x, left, rows, cols, score, log).orderBy(F.desc("score"), "j").limit(1).collect()
        if not best or best[0]["score"] <= score:
            break
        j, score, cols = best[0]
        with_j = left.filter(F.col("j") == F.lit(j)).select("i")
        rows = cut(with_j if rows is None else with_j.join(rows, "i", "left_semi"))
    if rows is None:
        return None
    return rows, spark.createDataFrame([(c,) for c in cols], x.cols.select("j").schema), score


def grecond(x: BoolMatrix, k: int | None = None, tol: int = 0, counted: bool = False) -> Fit:
    """Covers the ones by formal concepts: nothing but ones is ever covered. counted: the log says how many pairs were made, of how many."""
    fit, left = Fit(), x.ones.count()
    while left > tol and (k is None or fit.k < k):
        log: dict = {}
        found = concept(x, fit, log if counted else None)
        if found is None:
            break
        fit.add(found[0], found[1], score=found[2], **log)
        left -= found[2]
    return fit


def line_gains(x: BoolMatrix, fit: Fit, rows: DataFrame, cols: DataFrame, w_fp, w_fn, left: DataFrame | None = None, every: bool = False) -> DataFrame:
    """axis, id, gain: by how much the cover of all patterns grows if a row (or column) is added to the pattern rows x cols. every: also for
    lines without uncovered ones in it. left: the ones with hit, if they are at hand."""
    n_rows, n_cols = rows.count(), cols.count()
    left = cells(x, fit) if left is None else left
    out = []
    for axis, key, mine, across, size in (("row", "i", rows, cols, n_cols), ("col", "j", cols, rows, n_rows)):
        other = "j" if key == "i" else "i"
        ones = left.join(across, other, "left_semi").filter(~F.col("hit")).groupBy(key).agg(F.count(F.lit(1)).alias("r"))
        if every:
            ones = (x.rows if key == "i" else x.cols).join(ones, key, "left").withColumn("r", F.coalesce("r", F.lit(0)))
        ones = ones.join(mine, key, "left_anti")
        covered = F.lit(0)
        if fit.u is not None:
            a, b = (fit.u, fit.v) if key == "i" else (fit.v, fit.u)
            distinct = algebra.masks(a, key).select(F.col("mask").alias(f"m{key}")).distinct()
            crossed = algebra.hit_pairs(_masked(across, other, b).groupBy(f"m{other}").agg(F.count(F.lit(1)).alias("n")), f"m{other}", distinct, f"m{key}")
            ones = _masked(ones, key, a).join(crossed.groupBy(f"m{key}").agg(F.sum("n").alias("c")), f"m{key}", "left")
            covered = F.coalesce(F.col("c"), F.lit(0))
        gain = w_fn * F.col("r") - w_fp * (F.lit(size) - F.col("r") - covered)
        out.append(ones.select(F.lit(axis).alias("axis"), F.col(key).cast("string").alias("id"), gain.alias("gain"), F.col(key).alias(f"__{key}")))
    left_side = out[0].withColumn("__j", F.lit(None).cast(x.cols.schema["j"].dataType))
    right_side = out[1].withColumn("__i", F.lit(None).cast(x.rows.schema["i"].dataType))
    return left_side.unionByName(right_side)


#: Cells that lines fetched at once share, and lines of an axis that are fetched at once.
CELLS, LINES = 16_000_000, 200_000


def fetched(m: int, n: int, most: int = CELLS, lines: int = LINES) -> dict[str, int]:
    """How many rows and columns are fetched at once: all of a matrix of up to `most` cells."""
    cols = min(n, max(1, math.isqrt(most)))
    rows = min(m, max(1, most // max(cols, 1)), lines)
    return {"row": rows, "col": min(n, max(1, most // max(rows, 1)), lines)}


class Lines:
    """Fetched lines of one axis outside the pattern, by id, with their gains; `rest`: what no other line gains beyond."""

    def __init__(self, top: list, rest: float):
        top = sorted(top, key=lambda t: t[1])
        self.ids, self.gain, self.rest = [v for _, v in top], np.array([g for g, _ in top], float), rest
        self.order, self.picked = None, []

    def best(self) -> int:
        """The line that gains most, of equal ones that of the smallest id."""
        return int(self.gain.argmax() if self.order is None else self.order[0])

    def pick(self, at: int) -> None:
        """Gains stay as they are until lines across change them, so that they are sorted once for a run of picks."""
        if self.order is None:
            self.order = np.argsort(-self.gain, kind="stable")
        self.order = self.order[1:] if len(self.order) > 1 else None
        self.gain[at] = -np.inf
        self.picked.append(self.ids[at])

    def add(self, cells: np.ndarray) -> None:
        self.gain += cells
        self.order = None


def expanded(x: BoolMatrix, fit: Fit, rows: DataFrame, cols: DataFrame, w_fp, w_fn, most: int | None = None, lines: int | None = None) -> tuple[DataFrame, DataFrame, list]:
    """The pattern with the best line added while that gains, or `most` lines; ties: rows first, then the smallest id. Also the
    lines added.

    A line changes the gains of lines across it by one cell each. So the best rows and columns are fetched with the cells they share (up to
    CELLS of them, or `lines` x lines), and lines are picked one after the other from those for as long as no other line can
    have come to gain more; then all gains are found anew. Where all lines are fetched, once is enough."""
    added, spark = [], x.cells.sparkSession
    left = cut(cells(x, fit))
    held = fetched(x.m, x.n) if lines is None else {"row": lines, "col": lines}
    while most is None or len(added) < most:
        row, col, cell = _best_lines(x, fit, left, rows, cols, w_fp, w_fn, held)
        value = np.array([-w_fp, w_fn, 0], float)  # of a cell: a zero, an uncovered one, covered
        while most is None or len(added) < most:
            bound = {"row": row.rest + w_fn * len(col.picked), "col": col.rest + w_fn * len(row.picked)}
            best = [(side.gain[at], axis == "row", axis, at) for axis, side in (("row", row), ("col", col)) if side.ids for at in [side.best()]]
            if not best or (chosen := max(best, key=lambda t: t[:2]))[0] <= 0:
                break
            g, _, axis, at = chosen
            across = "col" if axis == "row" else "row"
            own_first = not (col if axis == "row" else row).picked  # then what was not fetched has larger ids at equal gains
            if not ((g > bound[axis] or own_first and g >= bound[axis]) and (g > bound[across] or axis == "row" and g >= bound[across])) and (row.picked or col.picked):
                break
            mine, other = (row, col) if axis == "row" else (col, row)
            mine.pick(at)
            other.add(value[cell[at] if axis == "row" else cell[:, at]])
            added.append((axis, mine.ids[at]))
        if not row.picked and not col.picked:
            break
        rows, cols = (cut(side.unionByName(spark.createDataFrame([(v,) for v in new], side.schema))) if new else side for side, new in ((rows, row.picked), (cols, col.picked)))
        if row.rest == col.rest == float("-inf"):
            break
    return rows, cols, added


def _best_lines(x, fit, left, rows, cols, w_fp, w_fn, held):
    """The best rows and columns outside the pattern, and what their cells are: 0 a zero, 1 an uncovered one, 2 covered."""
    spark = x.cells.sparkSession
    g = line_gains(x, fit, rows, cols, w_fp, w_fn, left, every=True)
    found, place = [], {}
    for axis, key, side, size in (("row", "i", rows, x.m), ("col", "j", cols, x.n)):
        best = g.filter(F.col("axis") == axis).select("gain", F.col(f"__{key}").alias(key))
        best = best if held[axis] >= size else best.orderBy(F.desc("gain"), key).limit(held[axis])
        top = [tuple(r) for r in best.collect()]
        whole = len(top) + side.count() >= size
        found.append(Lines(top, float("-inf") if whole or not top else min(t[0] for t in top)))
        place[key] = spark.createDataFrame([(v, at) for at, v in enumerate(found[-1].ids)], f"{key} {(x.rows if key == 'i' else x.cols).schema[key].dataType.simpleString()}, __{key} int")
    cell = np.zeros((len(found[0].ids), len(found[1].ids)), np.uint8)  # at most CELLS
    numbers = lambda df, *names: [c.to_numpy() for c in df.select(*names).toArrow().columns]
    code = F.col("__i").cast("bigint") * F.lit(cell.shape[1]) + F.col("__j")
    cell.reshape(-1)[numbers(left.join(place["i"], "i").join(place["j"], "j").select(code.alias("at")), "at")[0]] = 1
    if fit.u is not None:
        (i, fi), (j, fj) = (numbers(side.join(place[key], key), f"__{key}", "f") for key, side in (("i", fit.u), ("j", fit.v)))
        for f in np.unique(fi):
            cell[np.ix_(i[fi == f], j[fj == f])] = 2
    return *found, cell


def contained(u: DataFrame, v: DataFrame, f: int) -> DataFrame:
    """f of the other patterns that lie within pattern f."""
    out = None
    for side, key in ((u, "i"), (v, "j")):
        own = side.filter(F.col("f") == f).select(key, F.lit(1).alias("__in"))
        inside = side.filter(F.col("f") != f).join(own, key, "left").groupBy("f").agg(F.min(F.coalesce("__in", F.lit(0))).alias("all")).filter("all = 1").select("f")
        out = inside if out is None else out.join(inside, "f", "left_semi")
    return out


def needless_lines(x: BoolMatrix, u: DataFrame, v: DataFrame, f: int) -> DataFrame:
    """axis, id: lines of pattern f whose cells are all ones and all covered at least twice. Only ones within the pattern are looked
    at: a line is needless if as many of its ones are covered twice as the pattern has lines across."""
    rows, cols = (algebra.masks(side, key).filter(F.array_contains("mask", f)).withColumnRenamed("mask", f"m{key}") for side, key in ((u, "i"), (v, "j")))
    twice = x.ones.select("i", "j").join(rows, "i").join(cols, "j").filter(F.size(F.array_intersect("mi", "mj")) >= 2)
    of = lambda axis, key, across: twice.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == across.count()).select(F.lit(axis).alias("axis"), F.col(key).cast("string").alias("id"))
    return of("row", "i", cols).unionByName(of("col", "j", rows))


def grecond_plus(x: BoolMatrix, k: int, tol: int = 0, w_fp=1, w_fn=1, most: int | None = None) -> Fit:
    """Concepts that grow by lines while the cover gains; patterns within a new one go, and so do added lines that all other
    patterns cover."""
    fit, lines, spark = Fit(), {}, x.cells.sparkSession
    x = BoolMatrix(cut(x.cells), cut(x.rows), cut(x.cols))
    while fit.k < k:
        found = concept(x, fit)
        if found is None:
            break
        rows, cols, added = expanded(x, fit, found[0], found[1], w_fp, w_fn, most)
        fit.add(rows, cols, score=found[2], added=len(added))
        lines[fit.k - 1] = added
        gone = [r["f"] for r in contained(fit.u, fit.v, fit.k - 1).collect()]  # at most k
        if gone:
            fit.u, fit.v = cut(fit.u.filter(~F.col("f").isin(gone))), cut(fit.v.filter(~F.col("f").isin(gone)))
        for f in [f for f in lines if f not in gone]:
            # whether a row is needless does not depend on other rows of the pattern, so all go at once; then the columns
            for axis, key in (("row", "i"), ("col", "j")):
                mine = {str(v): v for a, v in lines[f] if a == axis}
                if mine:
                    found = needless_lines(x, fit.u, fit.v, f).filter(F.col("axis") == axis)
                    drop = {mine[r["id"]] for r in found.join(spark.createDataFrame([(v,) for v in mine], "id string"), "id").collect()}
                    if drop:
                        side = fit.u if axis == "row" else fit.v
                        side = cut(side.join(spark.createDataFrame([(v, f) for v in drop], side.select(key, "f").schema), [key, "f"], "left_anti"))
                        fit.u, fit.v = (side, fit.v) if axis == "row" else (fit.u, side)
                        lines[f] = [(a, v) for a, v in lines[f] if a != axis or v not in drop]
        t = fit.counts(x)
        if t["p"] - t["tp"] <= tol:
            break
    return fit


# ---- itemsets ----------------------------------------------------------------------------------------------------------


def itemsets(x: BoolMatrix, min_support: float, most: int | None = None) -> DataFrame:
    """c (a name), j: all single columns and all frequent sets of more, or those of at most `most`; support is a share of all rows."""
    from pyspark.ml.fpm import FPGrowth

    baskets = x.rows.join(x.ones.groupBy("i").agg(F.collect_set("j").alias("items")), "i", "left")
    baskets = baskets.select(F.coalesce("items", F.array().cast(f"array<{x.cols.schema['j'].dataType.simpleString()}>")).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=min_support).fit(baskets).freqItemsets.filter(F.size("items") > 1)
    if most is not None:
        found = found.filter(F.size("items") <= most)
    name = lambda c: F.array_join(F.sort_array(c).cast("array<string>"), "+")
    many = found.select(name(F.col("items")).alias("c"), F.explode("items").alias("j"))
    return x.cols.select(F.col("j").cast("string").alias("c"), "j").unionByName(many)


def hyper_candidates(x: BoolMatrix, candidates: DataFrame, left: DataFrame) -> DataFrame:
    """c, i, r: for each candidate the rows that have all its columns and uncovered ones in them (r)."""
    size = candidates.groupBy("c").agg(F.count(F.lit(1)).alias("size"))
    full = left.join(candidates, "j").groupBy("c", "i").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("hit")).cast("int")).alias("r"))
    return full.join(size, "c").filter((F.col("n") == F.col("size")) & (F.col("r") > 0)).select("c", "i", "r", "size")


def hyper_costs(rows: DataFrame, mode: str = "all") -> DataFrame:
    """c, rows, cost: (rows + columns) / newly covered ones. paper: only as many rows, the fullest first, as make that least."""
    if mode == "all":
        return rows.groupBy("c").agg(F.count(F.lit(1)).alias("rows"), ((F.count(F.lit(1)) + F.max("size")) / F.sum("r")).alias("cost"))
    # rows of a candidate differ only in r, which has few values: prefix sums run over those
    steps = rows.groupBy("c", "r").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    w = Window.partitionBy("c").orderBy(F.desc("r"))
    sums = steps.select("c", "r", (F.sum("n").over(w)).alias("rows"), ((F.sum("n").over(w) + F.col("size")) / F.sum(F.col("n") * F.col("r")).over(w)).alias("cost"))
    return sums.groupBy("c").agg(F.min_by("rows", F.struct("cost", "rows")).alias("rows"), F.min("cost").alias("cost"))


#: Candidates scored at once.
SCORED = 64


def hyper(x: BoolMatrix, min_support: float, most: int | None = None, k: int | None = None) -> Fit:
    """Exact cover by itemsets: each round the candidate of least cost, until all ones are covered. What is covered is kept
    as a flag of the ones here.

    Costs are found lazily. The least cost of a candidate over any number of its rows (as in the mode `paper`) only grows as ones get
    covered, and is never above the cost over all its rows, so an old one is a bound of what the candidate costs now. Each round
    scores the candidates of the least bounds, SCORED of them and then twice as many, until no bound is below the best cost found. The log
    says how many rows of candidates were scored (`scored`) and how many candidates were left alone (`idle`)."""
    fit, candidates = Fit(), cut(itemsets(x, min_support, most))
    left = cut(x.ones.withColumn("hit", F.lit(False)))
    bounds = None
    while k is None or fit.k < k:
        best, scored, tried, n = None, 0, 0, SCORED
        fresh, seen = None, None
        while True:
            if bounds is None:
                batch = candidates.select("c").distinct()
            else:
                batch = bounds if seen is None else bounds.join(seen, "c", "left_anti")
                if best is not None:
                    batch = batch.filter((F.col("bound") < best["cost"]) | (F.col("bound") == best["cost"]) & (F.col("c") < F.lit(best["c"])))
                batch = cut(batch.orderBy("bound", "c").limit(n).select("c"))
                if not batch.limit(1).count():
                    break
            rows = cut(hyper_candidates(x, candidates.join(batch, "c", "left_semi"), left))
            new = cut(hyper_costs(rows).join(hyper_costs(rows, "paper").select("c", F.col("cost").alias("bound")), "c"))
            scored, tried = scored + rows.count(), tried + batch.count()
            found = new.orderBy("cost", "c").limit(1).collect()
            if found and (best is None or (found[0]["cost"], found[0]["c"]) < (best["cost"], best["c"])):
                best, chosen = found[0], rows.filter(F.col("c") == F.lit(found[0]["c"])).select("i")
            fresh, seen = (new, batch) if fresh is None else (fresh.unionByName(new), seen.unionByName(batch))
            if bounds is None:
                break
            n *= 2
        if best is None:
            break
        # candidates that were scored and have no uncovered ones are gone
        kept = fresh.select("c", "bound")
        bounds = cut(kept if bounds is None else bounds.join(seen, "c", "left_anti").select("c", "bound").unionByName(kept))
        cols = candidates.filter(F.col("c") == F.lit(best["c"])).select("j")
        fit.add(chosen, cols, c=best["c"], cost=best["cost"], n_rows=best["rows"], scored=scored, idle=bounds.count() - tried)
        rows_in, cols_in = (fit_side.filter(F.col("f") == fit.k - 1).select(key, F.lit(True).alias(f"__{key}")) for fit_side, key in ((fit.u, "i"), (fit.v, "j")))
        left = left.join(rows_in, "i", "left").join(cols_in, "j", "left")
        left = cut(left.select("i", "j", (F.col("hit") | (F.coalesce("__i", F.lit(False)) & F.coalesce("__j", F.lit(False)))).alias("hit")))
    return fit


def _sides(u: DataFrame, v: DataFrame, pairs: DataFrame) -> list[DataFrame]:
    """a, b, i and a, b, j: the rows and columns of the tile that each pair of patterns would be."""
    both = F.explode(F.array("a", "b")).alias("f")
    return [pairs.select("a", "b", both).join(side, "f").select("a", "b", key).distinct() for side, key in ((u, "i"), (v, "j"))]


def _within(cells: DataFrame, sides: list[DataFrame], name: str) -> DataFrame:
    """a, b and how many of the cells lie in the tile of each pair."""
    return cells.join(sides[0], "i").join(sides[1], ["a", "b", "j"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias(name))


def merge_counts(x: BoolMatrix, u: DataFrame, v: DataFrame, pairs: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """a, b, nt, ni, nc, no, saved: rows and columns of the merged tile, how many of its cells are covered and how many are ones, and how many
    rows and columns fewer are to be written down. covered: the product of u and v, if it is there."""
    sides = _sides(u, v, pairs)
    size = lambda s: s.groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    sizes = size(u).unionByName(size(v)).groupBy("f").agg(F.sum("n").alias("n"))
    count = lambda s, name: s.groupBy("a", "b").agg(F.count(F.lit(1)).alias(name))
    covered = u.join(v, "f").select("i", "j").distinct() if covered is None else covered
    t = pairs.join(count(sides[0], "nt"), ["a", "b"]).join(count(sides[1], "ni"), ["a", "b"]).join(_within(covered, sides, "nc"), ["a", "b"], "left").join(_within(x.ones, sides, "no"), ["a", "b"], "left")
    t = t.join(sizes.select(F.col("f").alias("a"), F.col("n").alias("sa")), "a").join(sizes.select(F.col("f").alias("b"), F.col("n").alias("sb")), "b")
    return t.select("a", "b", "nt", "ni", F.coalesce("nc", F.lit(0)).alias("nc"), F.coalesce("no", F.lit(0)).alias("no"), (F.col("sa") + F.col("sb") - F.col("nt") - F.col("ni")).alias("saved"))


def savings(counts: DataFrame) -> DataFrame:
    """a, b, savings, fp: what merging patterns a and b saves for each cell it newly covers, and how many of the merged tile's
    cells are no ones."""
    new = F.col("nt") * F.col("ni") - F.col("nc")
    return counts.select("a", "b", F.try_divide(F.col("saved").cast("double"), new.cast("double")).alias("savings"), (F.col("nt") * F.col("ni") - F.col("no")).alias("fp"))


def merge_savings(x: BoolMatrix, u: DataFrame, v: DataFrame, pairs: DataFrame) -> DataFrame:
    return savings(merge_counts(x, u, v, pairs))


def sampled_pairs(u: DataFrame, samples: int, seed) -> DataFrame:
    from ..functions.scalar import digest

    f = u.select("f").distinct()
    pairs = f.select(F.col("f").alias("a")).join(f.select(F.col("f").alias("b")), F.col("a") < F.col("b"))
    return pairs.orderBy(digest(seed, F.col("a"), F.col("b")), "a", "b").limit(samples)


def hyper_plus(x: BoolMatrix, fit: Fit, target_k: int, samples: int = 500, beta: float | None = None, seed=0) -> Fit:
    """Merges pairs of patterns, the one of largest savings among sampled ones, while false positives stay within beta x ones.

    What is known of a pair is kept: a merge drops the pairs of the two merged patterns, adds the cells that it newly covers to the
    pairs whose tiles hold them, and of the next sample only pairs not yet known are counted. The log says how many (`counted`)."""
    u, v, alive, ones = fit.u, fit.v, fit.k, x.ones.count()
    out = Fit(u, v, fit.k, list(fit.log))
    covered = cut(u.join(v, "f").select("i", "j").distinct())
    known = None
    while alive > target_k:
        pairs = cut(sampled_pairs(out.u, samples, f"{seed}:{alive}"))
        asked = pairs if known is None else cut(pairs.join(known, ["a", "b"], "left_anti"))
        fresh = merge_counts(x, out.u, out.v, asked, covered)
        known = cut(fresh if known is None else known.unionByName(fresh))
        # a merge that covers nothing new saves without limit
        t = savings(known.join(pairs, ["a", "b"], "left_semi")).withColumn("savings", F.coalesce("savings", F.lit(float("inf"))))
        if beta is not None:
            t = t.filter(F.col("fp") <= F.lit(beta * ones))
        best = t.orderBy(F.desc("savings"), "a", "b").limit(1).collect()
        if not best:
            break
        a, b, new = best[0]["a"], best[0]["b"], out.k
        rows, cols = (cut(s.filter(F.col("f").isin(a, b)).select(key).distinct()) for s, key in ((out.u, "i"), (out.v, "j")))
        moved = lambda s, side: cut(s.filter(~F.col("f").isin(a, b)).unionByName(side.withColumn("f", F.lit(new))))  # noqa: B023,E731
        out = Fit(moved(out.u, rows), moved(out.v, cols), out.k + 1, [*out.log, {"merged": (a, b), "savings": best[0]["savings"], "counted": asked.count(), "of": pairs.count()}])
        gained = cut(rows.crossJoin(cols).join(covered, ["i", "j"], "left_anti"))  # cells of the new pattern alone
        covered = cut(covered.unionByName(gained))
        known = known.filter(~F.col("a").isin(a, b) & ~F.col("b").isin(a, b))
        more = _within(gained, _sides(out.u, out.v, known.select("a", "b")), "more")
        known = cut(known.join(more, ["a", "b"], "left").withColumn("nc", F.col("nc") + F.coalesce("more", F.lit(0))).drop("more"))
        alive -= 1
    return out


# ---- cores and extensions ----------------------------------------------------------------------------------------------


def item_order(left: DataFrame, method: str = "frequency", rows: DataFrame | None = None) -> DataFrame:
    """j, score, by the uncovered ones: of the column; of all rows that have it, less its own; or of the given rows."""
    open_ = left.filter(~F.col("hit")).select("i", "j")
    if method == "correlation" and rows is not None:
        return open_.join(rows, "i", "left_semi").groupBy("j").agg(F.count(F.lit(1)).alias("score"))
    if method in ("frequency", "correlation"):
        return open_.groupBy("j").agg(F.count(F.lit(1)).alias("score"))
    if method != "couples-frequency":
        raise ValueError(f"unknown order: {method}")
    size = open_.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    return open_.join(size, "i").groupBy("j").agg((F.sum("n") - F.count(F.lit(1))).alias("score"))


def panda_core(left: DataFrame, order: DataFrame, w_model=1, w_fn=1) -> tuple[DataFrame, DataFrame, int]:
    """Rows T, items I (with their places) and how many. order: j, ord. One query finds the next item, in order, that lowers the
    cost: items between are judged by the same rows and would fail."""
    at, e = order.orderBy("ord").limit(1).select("ord", "j").collect()[0]
    k, items = 1, order.filter(F.col("ord") == at)
    rows = cut(left.filter(~F.col("hit") & (F.col("j") == F.lit(e))).select("i"))
    while True:
        size, t = rows.count(), F.col("t")
        shared = left.filter(~F.col("hit")).join(order.filter(F.col("ord") > at), "j").join(rows, "i", "left_semi").groupBy("ord", "j").agg(F.count(F.lit(1)).alias("t"))
        lower = w_model * (1 + t - size) - w_fn * ((k + 1) * t - k * size) <= 0
        best = shared.filter(lower).orderBy("ord").limit(1).select("ord", "j").collect()
        if not best:
            return rows, items, k
        at, e = best[0]
        rows = cut(left.filter(~F.col("hit") & (F.col("j") == F.lit(e))).select("i").join(rows, "i", "left_semi"))
        k, items = k + 1, cut(items.unionByName(order.filter(F.col("ord") == at)))


def panda_item_costs(x: BoolMatrix, fit: Fit, rows: DataFrame, size: int, items: DataFrame | None = None, w_model=1, w_fp=1, w_fn=1) -> DataFrame:
    """j, cost: of adding a column, or one of items (j), to a pattern of these rows."""
    left = cells(x, fit).join(rows, "i", "left_semi")
    if items is not None:
        left = left.join(items, "j", "left_semi")
    open_ = left.groupBy("j").agg(F.sum((~F.col("hit")).cast("int")).alias("r"))
    cols = x.cols if items is None else x.cols.join(items, "j", "left_semi")
    t = cols.join(open_, "j", "left").withColumn("r", F.coalesce("r", F.lit(0)))
    covered = F.lit(0)
    if fit.u is not None:
        mine = _masked(rows, "i", fit.u).groupBy("mi").agg(F.count(F.lit(1)).alias("n"))
        c = algebra.hit_pairs(_masked(t, "j", fit.v), "mj", mine, "mi").groupBy("j").agg(F.sum("n").alias("c"))
        t, covered = t.join(c, "j", "left"), F.coalesce(F.col("c"), F.lit(0))
    fp = F.lit(size) - covered - F.col("r")
    return t.select("j", (w_model + w_fp * fp - w_fn * F.col("r")).alias("cost"))


def panda_row_costs(x: BoolMatrix, fit: Fit, rows: DataFrame, cols: DataFrame, size: int, w_model=1, w_fp=1, w_fn=1) -> DataFrame:
    """i, cost: of adding a row outside `rows` to a pattern of these columns."""
    flipped = Fit(None if fit.u is None else fit.v.select(F.col("j").alias("i"), "f"), None if fit.u is None else fit.u.select(F.col("i").alias("j"), "f"), fit.k)
    t = panda_item_costs(x.T, flipped, cols.select(F.col("j").alias("i")), size, None, w_model, w_fp, w_fn)
    return t.select(F.col("j").alias("i"), "cost").join(rows, "i", "left_anti")


def panda(x: BoolMatrix, k: int, w_model=1, w_fp=1, w_fn=1, method: str = "frequency", exact: bool = False, tol: int = 0) -> Fit:
    """Cores of shared items, extended by items and rows while the description gets shorter."""
    fit, w = Fit(), 0 if exact else w_model
    cost = w_fn * x.ones.count()
    while fit.k < k:
        left = cut(cells(x, fit))
        order = factorized(item_order(left, method).select(F.struct((-F.col("score")).alias("score"), "j").alias("item")), "item")
        order = cut(order.select("item.j", "ord"))
        if not order.limit(1).count():
            break
        rows, items, n_items = panda_core(left, order, w, w_fn)
        rest = cut(order.join(items, "j", "left_anti"))
        while not exact:
            costs = panda_item_costs(x, fit, rows, rows.count(), rest.select("j"), w, w_fp, w_fn)
            best = costs.filter("cost <= 0").join(rest, "j").orderBy("ord").limit(1).select("ord").collect()
            if not best:
                break
            at = best[0]["ord"]
            n_items, items = n_items + 1, cut(items.unionByName(rest.filter(F.col("ord") == at)))
            rest = rest.filter(F.col("ord") > at)
            more = panda_row_costs(x, fit, rows, items.select("j"), n_items, w, w_fp, w_fn).filter("cost <= 0").select("i")
            rows = cut(rows.unionByName(more))
        before = fit.counts(x)
        trial = Fit(fit.u, fit.v, fit.k, list(fit.log))
        trial.add(rows, items)
        after = trial.counts(x)
        error = w_fp * (after["q"] - after["tp"]) + w_fn * (after["p"] - after["tp"])
        if error > w_fp * (before["q"] - before["tp"]) + w_fn * (before["p"] - before["tp"]) or error > cost:
            break
        fit, cost = trial, error
        if after["p"] - after["tp"] <= tol:
            break
    return fit


# ---- medians -----------------------------------------------------------------------------------------------------------


def median_line(left: DataFrame, axis: int) -> DataFrame:
    """One row, `line` and `n`: of the columns (axis 0) or rows (axis 1) with uncovered ones, fullest first, the middle one."""
    key = "j" if axis == 0 else "i"
    sums = left.filter(~F.col("hit")).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    ordered = cut(factorized(sums.select(F.struct((-F.col("n")).alias("n"), F.col(key).alias("line")).alias("m")), "m"))
    return ordered.filter(F.col("ord") == ordered.count() // 2).select(F.col("m.line").alias("line"), (-F.col("m.n")).alias("n"))


def median_factor(left: DataFrame, axis: int, t: float) -> tuple[DataFrame, DataFrame]:
    """Rows and columns: the middle line's ids, and the lines that share more than t of them."""
    key, other = ("j", "i") if axis == 0 else ("i", "j")
    open_ = left.filter(~F.col("hit")).select("i", "j")
    line = median_line(left, axis)
    return _grown(open_, open_.join(F.broadcast(line.select(F.col("line").alias(key))), key, "left_semi").select(other), key, other, t, axis)


def weak_factor(left: DataFrame, axis: int, t: float) -> tuple[DataFrame, DataFrame]:
    """The same from the ids that the two fullest lines share."""
    key, other = ("j", "i") if axis == 0 else ("i", "j")
    open_ = left.filter(~F.col("hit")).select("i", "j")
    top = open_.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(2).select(key)
    both = open_.join(F.broadcast(top), key, "left_semi").groupBy(other).agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select(other)
    return _grown(open_, both, key, other, t, axis)


def _grown(open_, a, key, other, t, axis):
    size = a.agg(F.count(F.lit(1)).alias("size"))
    b = open_.join(a, other, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(size)).filter(F.col("n") > F.lit(float(t)) * F.col("size")).select(key)
    return (a, b) if axis == 0 else (b, a)


def mebf(x: BoolMatrix, k: int, t: float, w_fp=1, w_fn=1, tol: int = 0) -> Fit:
    """Patterns around the median line, of the axis that errs less; where that does not help, around the two fullest lines."""
    fit = Fit()
    error = lambda c: w_fp * (c["q"] - c["tp"]) + w_fn * (c["p"] - c["tp"])
    cost = error(fit.counts(x))
    while fit.k < k and cost > tol:
        left, best = cut(cells(x, fit)), None
        for find in (median_factor, weak_factor):
            tries = []
            for axis in (0, 1):
                rows, cols = (cut(s) for s in find(left, axis, t))
                if rows.limit(1).count() and cols.limit(1).count():
                    trial = Fit(fit.u, fit.v, fit.k, list(fit.log))
                    trial.add(rows, cols, axis=axis, by=find.__name__)
                    tries.append((error(trial.counts(x)), axis, trial))
            best = min(tries, key=lambda a: a[:2], default=None)
            if best is not None and best[0] <= cost:
                break
            best = None
        if best is None:
            break
        cost, _, fit = best
    return fit

