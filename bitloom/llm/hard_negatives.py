"""Hard negatives by inner product, from STR-packed R-trees.

Vectors become integers, floor(SCALE * x), and a row's score is its integer inner product with the anchor. An anchor's positives are its
POSITIVES best rows of the same label; for each of them the NEGATIVES best rows of other labels are wanted whose score lies in a
window, LOW to HIGH per cent of the positive's score. Higher scores come first, ties by the smaller vec_id.

Index. Rows are sorted by ranges of (label, first component, vec_id) into blocks of about BLOCK rows. In a block they are packed by
sort-tile-recursive: sort by the label, then by the widest component, cut, and so on, down to leaves of LEAF rows. A leaf is one
row of the index, with its rows' numbers and its minimum bounding box; the leaves' boxes are joined FAN by FAN up to a root. For
an anchor, a box gives an interval of every component's product and so of the inner product.

Search. Anchors (a stated query set) come in groups of about GROUP, and each group meets each block of the index in a task of
its own (a cogroup, so both sides are bounded and neither passes through the driver): for the positives only blocks that hold one of
the group's labels, for the negatives those that hold another one. A queue takes the box of the highest possible score first; boxes
outside the score windows, without a wanted label, or strictly below the worst of the rows held are dropped. The best rows of all
blocks are then merged by rank. All is exact: recall is 1.

Cost: anchors times rows in the worst case, which high-dimensional noise comes near to. Boxes prune where vectors cluster.

Defined results: rows with a null vec_id, label or vector, or a null or non-finite component take no part; shorter vectors end in
zeros; an empty vector has score 0 with all; of rows with one vec_id the one with the smallest label (then vector) counts;
fewer rows than asked for give all; a window of a negative positive score is empty; an empty table gives an empty table; other columns
are ignored; integers beyond 2^31, and scores that do not fit into a long, are refused with an error.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written
from .vectors import finite, largest, matrix, scaled

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
BLOCK, LEAF, FAN, GROUP = 8192, 256, 8, 2048
LEAVES = "block int, n int, ids binary, labels binary, q binary, box binary, kinds array<bigint>"


# ---- index -------------------------------------------------------------------------------------------------------------


def tiles(q: np.ndarray, labels: np.ndarray, ids: np.ndarray, size: int) -> list[np.ndarray]:
    """Sort-tile-recursive: the rows of each leaf. The axis is the label while there are several, then the widest component; all leaves
    but the last of a cut are full."""
    out, open_ = [], [np.arange(len(ids))]
    while open_:
        rows = open_.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        kinds, part = labels[rows], q[rows]
        axis = kinds if kinds.min() != kinds.max() else part[:, int(np.argmax(part.max(axis=0) - part.min(axis=0)))] if q.shape[1] else kinds
        rows = rows[np.lexsort((ids[rows], axis))]
        half = -(-len(rows) // size) // 2 * size
        open_ += [rows[half:], rows[:half]]
    return out


def leaves(rows: DataFrame, width: int, n: int, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """LEAVES of (vec_id, label, q), n rows in all."""
    spread = rows.repartitionByRange(max(1, -(-n // block)), "label", F.get("q", F.lit(0)), "vec_id").withColumn("block", F.spark_partition_id())

    def run(batches):
        held = [b for b in batches if len(b)]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        ids, labels = (table.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "label"))
        q, number = matrix(table.column("q").combine_chunks(), width), table.column("block")[0].as_py()
        for t in tiles(q, labels, ids, leaf):
            part = q[t]
            box = np.concatenate([part.min(axis=0), part.max(axis=0)])
            cols = [[number], [len(t)], [ids[t].tobytes()], [labels[t].tobytes()], [part.tobytes()], [box.tobytes()], [np.unique(labels[t]).tolist()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.list_(pa.int64())), strict=True)], names=[c.split()[0] for c in LEAVES.split(", ")])

    return spread.mapInArrow(run, LEAVES)


class Tree:
    """The leaves of a block under inner boxes. Nodes are numbered, leaves first and the root last."""

    def __init__(self, table: pa.Table, width: int):
        array = lambda c: [np.frombuffer(b, np.int64) for b in table.column(c).to_pylist()]
        self.ids, self.labels = array("ids"), array("labels")
        self.rows = [b.reshape(len(i), width) for i, b in zip(self.ids, array("q"), strict=True)]
        boxes = np.array(array("box")).reshape(len(self.ids), 2 * width)
        low, high = list(boxes[:, :width]), list(boxes[:, width:])
        kinds = [(k.min(), k.max()) for k in self.labels]
        self.children: list = [None] * len(low)
        level = sorted(range(len(low)), key=lambda n: (*kinds[n], low[n][:1].tolist()))
        while len(level) > 1:
            above = []
            for at in range(0, len(level), FAN):
                below = level[at : at + FAN]
                above.append(len(low))
                low.append(np.min([low[n] for n in below], axis=0))
                high.append(np.max([high[n] for n in below], axis=0))
                kinds.append((min(kinds[n][0] for n in below), max(kinds[n][1] for n in below)))
                self.children.append(below)
            level = above
        self.low, self.high, self.kinds = np.array(low), np.array(high), kinds
        self.root = level[0]

    def intervals(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and largest inner product of each anchor with what each node may hold: each component's product lies between those
        with the ends of the box."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T

    def exact(self, anchors: np.ndarray) -> np.ndarray:
        """The anchors, with the tree's numbers, as doubles where all inner products are exact in them, else as Python's integers."""
        most = largest(anchors) * max(largest(self.low), largest(self.high)) * max(1, anchors.shape[1])
        kind = np.float64 if most < 1 << 52 else object
        self.low, self.high, self.rows = self.low.astype(kind), self.high.astype(kind), [r.astype(kind) for r in self.rows]
        return anchors.astype(kind)


def positives(tree: Tree, anchor, anchor_id: int, label: int, top: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(score, id) of the k best rows of the label, but for the anchor. top: the nodes' largest possible scores."""
    best: list = []  # (-score, id), best first
    queue = [(-top[tree.root], tree.root)]
    while queue:
        bound, node = heapq.heappop(queue)
        if len(best) == k and -bound < -best[-1][0]:
            break
        if tree.children[node] is not None:
            for n in tree.children[node]:
                if tree.kinds[n][0] <= label <= tree.kinds[n][1]:
                    heapq.heappush(queue, (-top[n], n))
            continue
        s, ids = tree.rows[node] @ anchor, tree.ids[node]
        wanted = (tree.labels[node] == label) & (ids != anchor_id)
        if len(best) == k:
            wanted &= (s >= -best[-1][0]).astype(bool)
        at = np.flatnonzero(wanted)
        best = sorted([*best, *zip((-s[at]).tolist(), ids[at].tolist())])[:k]
    return [(int(-s), i) for s, i in best]


def negatives(tree: Tree, anchor, label: int, least: np.ndarray, top: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
    """For each window (low, high) the (score, id) of its k best rows of other labels."""
    best: list[list] = [[] for _ in windows]
    floor = [low for low, _ in windows]  # what a row has to reach: the window's end, then the worst row held
    ceiling = max(high for _, high in windows)
    queue = [(-top[tree.root], tree.root)]
    while queue:
        bound, node = heapq.heappop(queue)
        if -bound < min(floor):
            break
        if not any(f <= -bound and least[node] <= high for f, (_, high) in zip(floor, windows)):
            continue
        if tree.children[node] is not None:
            for n in tree.children[node]:
                if tree.kinds[n] != (label, label):
                    heapq.heappush(queue, (-top[n], n))
            continue
        s, ids = tree.rows[node] @ anchor, tree.ids[node]
        at = np.flatnonzero((tree.labels[node] != label) & ((s >= min(floor)) & (s <= ceiling)).astype(bool))
        if not len(at):
            continue
        at = at[np.lexsort((ids[at], -s[at]))]
        s, ids = s[at], ids[at]
        for w, (_, high) in enumerate(windows):
            first = int(np.searchsorted(-s, -high))
            found = [(-x, i) for x, i in zip(s[first : first + k].tolist(), ids[first : first + k].tolist()) if x >= floor[w]]
            if found:
                best[w] = sorted(best[w] + found)[:k]
                if len(best[w]) == k:
                    floor[w] = max(floor[w], -best[w][-1][0])
    return [[(int(-s), i) for s, i in b] for b in best]


def window(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """The least and largest score of a negative."""
    return -(-low * score // 100), high * score // 100


# ---- search ------------------------------------------------------------------------------------------------------------


def met(index: DataFrame, anchors: DataFrame, pairs: DataFrame, made, schema: str) -> DataFrame:
    """made(leaves, anchors) of every pair of a block and a group."""
    left, right = index.drop("kinds").join(pairs, "block"), anchors.join(pairs, "part")
    right = right.withColumns({"to_block": F.col("block") + 0, "to_part": F.col("part") + 0}).drop("block", "part")
    return left.groupBy("block", "part").cogroup(right.groupBy("to_block", "to_part")).applyInArrow(made, schema)


def first(df: DataFrame, keys: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each key, with their rank; tasks drop what cannot be among them before rows are shuffled."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def table_of(columns: list, names: list[str]) -> pa.Table:
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)


def mine(vectors: DataFrame, anchor: Column, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, block: int = BLOCK, leaf: int = LEAF, group: int = GROUP) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. vectors: vec_id, label, embedding; anchor says which rows
    are anchors, by vec_id and label."""
    whole = vectors.filter("vec_id IS NOT NULL AND label IS NOT NULL").filter(finite(F.col("embedding")))
    rows = whole.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), scaled(F.col("embedding"), scale).alias("q"))
    said = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("q")).alias("width"), F.sum(anchor.cast("bigint")).alias("anchors")).first()
    n, width = said["n"], max(said["width"] or 1, 1)
    if rows.groupBy("vec_id").count().filter("count > 1").limit(1).count():
        rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.label", "r.q")
    index = written(leaves(rows, width, n, block, leaf), "rtree")
    groups = max(1, -(-(said["anchors"] or 0) // group))
    anchors = rows.filter(anchor).repartitionByRange(groups, "label", F.get("q", F.lit(0)), "vec_id").withColumn("part", F.spark_partition_id())
    anchors = written(anchors.selectExpr("part", "vec_id", "label", "q"), "anchors")
    kinds = index.select("block", F.explode("kinds").alias("label")).distinct()
    asked = anchors.select("part", "label").distinct()

    def best_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list = [[], [], []]
        if len(left) and len(right):
            tree = Tree(left, width)
            a = tree.exact(matrix(right.column("q").combine_chunks(), width))
            top = tree.intervals(a)[1]
            for k, (i, label) in enumerate(zip(right.column("vec_id").to_pylist(), right.column("label").to_pylist(), strict=True)):
                for score, other in positives(tree, a[k], i, label, top[k], n_positives):
                    for c, x in zip(out, (i, other, score), strict=True):
                        c.append(x)
        return table_of(out, ["anchor_id", "positive_id", "positive_score"])

    near = met(index, anchors, kinds.join(asked, "label").select("block", "part").distinct(), best_positives, "anchor_id bigint, positive_id bigint, positive_score bigint")
    near = written(first(near, ["anchor_id"], "positive_score", "positive_id", n_positives), "positives")

    goals = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("goals"))  # at most n_positives each
    goals = goals.select(F.col("anchor_id").alias("vec_id"), F.col("goals.positive_id").alias("wanted"), F.col("goals.positive_score").alias("scores"))
    aimed = anchors.join(goals, "vec_id")

    def best_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list = [[] for _ in range(5)]
        if len(left) and len(right):
            tree = Tree(left, width)
            a = tree.exact(matrix(right.column("q").combine_chunks(), width))
            least, top = tree.intervals(a)
            for k, (i, label, wanted, scores) in enumerate(zip(*(right.column(c).to_pylist() for c in ("vec_id", "label", "wanted", "scores")), strict=True)):
                found = negatives(tree, a[k], label, least[k], top[k], [window(s, low, high) for s in scores], n_negatives)
                for p, s, rows_ in zip(wanted, scores, found, strict=True):
                    for score, other in rows_:
                        for c, x in zip(out, (i, p, s, other, score), strict=True):
                            c.append(x)
        return table_of(out, ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    # every block meets every group, but for those of the one same label
    last = anchors.agg(F.max("part").alias("p")).first()["p"] or 0
    one = lambda df, key: df.groupBy(key).agg(F.min("label").alias(f"low_{key}"), F.max("label").alias(f"high_{key}"))
    pairs = one(kinds, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(last)))).join(one(asked, "part"), "part")
    pairs = pairs.filter("low_block <> high_block OR low_part <> high_part OR low_block <> low_part").select("block", "part")
    far = met(index, aimed, pairs, best_negatives, "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    return first(far, ["anchor_id", "positive_id"], "negative_score", "negative_id", n_negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(vectors: DataFrame) -> DataFrame:
    """Every 50th row is an anchor; every 7th has the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 50 == 0)


ORACLE = f"""
WITH e AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, e.vec_id AS id, a.label = e.label AS same, CAST(list_dot_product(a.q, e.q) AS BIGINT) AS score FROM e a, e WHERE a.vec_id % 50 = 0 AND a.vec_id <> e.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score QUALIFY rank <= {NEGATIVES}
"""
