"""Toxic spans by a linear-chain conditional random field.

Labels are given for documents, so tokens are labelled by expectation-maximisation. A word is evidence as far as it follows many
different words in toxic documents and few in others (contexts are counted, not occurrences, so copies of one text weigh once).
At first a token of a toxic document is toxic with the strength of its word's evidence; later with its marginal under the field
fitted so far, given that at least one token of the document is toxic. All tokens of clean documents are clean.

The field has two states. A token's features are its word, prefix and suffix and the words beside it, hashed into a fixed number
of weights, so that the score of a token is the sum of three numbers that depend on one word each. Training and scoring share one
forward-backward pass over all tokens of a batch: a chain of 2 x 2 matrices, cut into blocks that run side by side. A text starts
with a matrix that forgets what was before, so texts of any length share the pass.

A document's score is a logistic function, fitted to the document labels, of the largest marginal and of the expected number of
toxic tokens. Tokens with a marginal of 0.5 or more give the offending offsets (code points, end exclusive; neighbours joined).

The field is fitted on the labelled documents that come first by a hash of doc_id: at most SAMPLE rows, of texts of at most
TEXT_BYTES each and SAMPLE_BYTES together, which bounds what reaches the driver. Everything else covers all rows.

Defined results: null and empty texts get the score of a text without tokens; very long texts are scored whole; a null doc_id
counts as the id '' and rows with null labels are not learned from; a doc_id labelled more than once is toxic if any row says so;
of a doc_id with several texts the smallest is learned from, and each is scored; repeated rows keep their own output row; without
labels of both kinds all scores are the share of toxic labels (0.5 without labels); other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SAMPLE, TEXT_BYTES, SAMPLE_BYTES = 2500, 1_000_000, 64_000_000
BITS = 18
BLOCK = 128
MIN_CONTEXTS = 5
MIN_LOG_ODDS = 3.0
SLOPE = 8.0
CACHE = 300_000
CHUNK = 2_000_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
EDGES = bytes(c for c in range(33, 128) if not chr(c).isalnum())
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def normal(token: bytes) -> bytes:
    return token.strip(EDGES) or token


def features(word: bytes) -> tuple[list[int], int, int]:
    """Hashed features of a word: for itself, for the word after it, for the word before it."""
    import xxhash

    mask = (1 << BITS) - 1
    own = [xxhash.xxh64_intdigest(f) & mask for f in (b"w " + word, b"p " + word[:4], b"s " + word[-4:])]
    return own, xxhash.xxh64_intdigest(b"a " + word) & mask, xxhash.xxh64_intdigest(b"b " + word) & mask


def marginals(odds: np.ndarray, starts: np.ndarray, moves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(token is toxic) and the expected numbers of moves (2 x 2). odds: score of toxic against clean for each token; starts: the
    first token of each text; moves: weights of state i before j; first: weights of the first state."""
    n = len(odds)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    rows = -(-n // BLOCK)
    e = np.ones((2, rows * BLOCK))
    top = np.maximum(odds, 0)
    e[0, :n], e[1, :n] = np.exp(-top), np.exp(odds - top)
    a, pi = np.exp(moves - moves.max()), np.exp(first - first.max())
    new = np.zeros(rows * BLOCK, dtype=bool)
    new[starts] = True
    new[n:] = True  # what fills the last block does not look back
    # m[i][j][t]: weight of going from state i to j at token t; column l of a block at m[i][j][:, l]
    m = [[(np.where(new, pi[j], a[i, j]) * e[j]).reshape(rows, BLOCK).T.copy() for j in (0, 1)] for i in (0, 1)]
    p = [[np.ones(rows), np.zeros(rows)], [np.zeros(rows), np.ones(rows)]]
    for step in range(BLOCK):
        q = [[p[i][0] * m[0][j][step] + p[i][1] * m[1][j][step] for j in (0, 1)] for i in (0, 1)]
        scale = 1 / (q[0][0] + q[0][1] + q[1][0] + q[1][1])
        p = [[x * scale for x in row] for row in q]
    whole = np.array([[p[0][0], p[0][1]], [p[1][0], p[1][1]]]).transpose(2, 0, 1).tolist()
    ahead, back, f, b = [], [0.0] * rows, (0.5, 0.5), (0.5, 0.5)
    for (x, y), (z, w) in whole:
        ahead.append(f)
        f = (f[0] * x + f[1] * z, f[0] * y + f[1] * w)
        s = f[0] + f[1]
        f = (f[0] / s, f[1] / s)
    for k in range(rows - 1, -1, -1):
        back[k] = b
        (x, y), (z, w) = whole[k]
        b = (x * b[0] + y * b[1], z * b[0] + w * b[1])
        s = b[0] + b[1]
        b = (b[0] / s, b[1] / s)
    f0, f1 = (np.array(c) for c in zip(*ahead))
    b0, b1 = (np.array(c) for c in zip(*back))
    before = np.empty((2, BLOCK, rows))  # forward vector before each token
    for step in range(BLOCK):
        before[0, step], before[1, step] = f0, f1
        f0, f1 = f0 * m[0][0][step] + f1 * m[1][0][step], f0 * m[0][1][step] + f1 * m[1][1][step]
        s = 1 / (f0 + f1)
        f0, f1 = f0 * s, f1 * s
    toxic = np.empty((BLOCK, rows))
    pairs = np.zeros((2, 2))
    inside = ~new.reshape(rows, BLOCK).T
    for step in range(BLOCK - 1, -1, -1):
        joint = [[before[i, step] * m[i][j][step] * (b0, b1)[j] for j in (0, 1)] for i in (0, 1)]
        s = 1 / (joint[0][0] + joint[0][1] + joint[1][0] + joint[1][1])
        toxic[step] = (joint[0][1] + joint[1][1]) * s
        live = s * inside[step]
        for i in (0, 1):
            for j in (0, 1):
                pairs[i, j] += float((joint[i][j] * live).sum())
        c0, c1 = m[0][0][step] * b0 + m[0][1][step] * b1, m[1][0][step] * b0 + m[1][1][step] * b1
        s = 1 / (c0 + c1)
        b0, b1 = c0 * s, c1 * s
    return toxic.T.reshape(-1)[:n], pairs


class Field:
    """The weights, and what they make of texts."""

    def __init__(self):
        self.weights = np.zeros(1 << BITS)
        self.moves, self.first = np.zeros((2, 2)), np.zeros(2)
        self.document = (0.0, 0.0, 0.0)
        self.known: dict[bytes, int] = {}
        self.own, self.after, self.before = np.zeros(0), np.zeros(0), np.zeros(0)

    def state(self) -> dict:
        """What a copy needs, as plain arrays."""
        return {"weights": self.weights.astype(np.float32), "moves": self.moves, "first": self.first, "document": self.document}

    @classmethod
    def of(cls, state: dict) -> Field:
        out = cls()
        out.__dict__.update(state)
        return out

    def tokens(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of each token's word, and how many tokens each text has."""
        known, sizes, out = self.known, [], []
        for text in texts:
            words = text.split()
            sizes.append(len(words))
            try:
                out.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
            except KeyError:
                for w in words:
                    known.setdefault(w, len(known))
                out.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        return (np.concatenate(out) if out else np.zeros(0, np.int64)), np.array(sizes, dtype=np.int64)

    def prepare(self) -> None:
        """Scores of the words met since."""
        words = list(self.known)[len(self.own) :]
        if not words:
            return
        table = [features(normal(w)) for w in words]
        w = self.weights
        self.own = np.concatenate([self.own, [w[own].sum() for own, _, _ in table]])
        self.after = np.concatenate([self.after, [w[a] for _, a, _ in table]])
        self.before = np.concatenate([self.before, [w[b] for _, _, b in table]])

    def forget(self, most: int = CACHE) -> None:
        if len(self.known) > most:
            self.known, self.own, self.after, self.before = {}, np.zeros(0), np.zeros(0), np.zeros(0)

    def odds(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = self.own[ids]
        if len(ids):
            left, right = self.after[ids[:-1]], self.before[ids[1:]]
            left[starts[starts > 0] - 1] = 0
            right[starts[starts > 0] - 1] = 0
            out[1:] += left
            out[:-1] += right
        return out

    def marks(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all tokens, and tokens of each text."""
        ids, sizes = self.tokens(texts)
        self.prepare()
        starts = (np.cumsum(sizes) - sizes)[sizes > 0]
        return marginals(self.odds(ids, starts), starts, self.moves, self.first)[0], sizes

    def inputs(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Largest marginal and expected toxic tokens of each text; marginals and sizes."""
        p, sizes = self.marks(texts)
        top, total = np.zeros(len(texts)), np.zeros(len(texts))
        if len(p):
            starts = (np.cumsum(sizes) - sizes)[sizes > 0]
            top[sizes > 0] = np.maximum.reduceat(p, starts)
            total[sizes > 0] = np.add.reduceat(p, starts)
        return top, total, p, sizes

    def scores(self, top: np.ndarray, total: np.ndarray) -> np.ndarray:
        bias, of_top, of_total = self.document
        return 1 / (1 + np.exp(-(bias + of_top * top + of_total * np.log1p(total))))


def evidence(texts: list[bytes], labels: list[int]) -> dict[bytes, float]:
    """How sure it is that a word of toxic texts is toxic, 0 to 1: by how many different words it follows in toxic texts against
    others. MIN_LOG_ODDS (or what the clearest words have, if less) is a half."""
    pairs: tuple = (defaultdict(set), defaultdict(set))
    for text, label in zip(texts, labels, strict=True):
        words = [normal(w) for w in text.split()]
        for before, word in zip([b"", *words], words):
            pairs[label][word].add(before)
    totals = [sum(map(len, p.values())) or 1 for p in pairs]
    odds = {}
    for word, contexts in pairs[1].items():
        own, other = len(contexts), len(pairs[0].get(word, ()))
        # few contexts tell little: the odds shrink towards 0
        odds[word] = (np.log((own + 0.5) / totals[1]) - np.log((other + 0.5) / totals[0])) * min(1.0, own / MIN_CONTEXTS)
    half = min(MIN_LOG_ODDS, 0.8 * max(odds.values(), default=0.0))
    return {w: float(1 / (1 + np.exp(-SLOPE * (o - half)))) for w, o in odds.items() if o > 0}


def targets(p: np.ndarray, toxic: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Marginals p given the labels of the documents: none in a clean one, at least one in a toxic one."""
    out = np.zeros(len(p))
    if len(p):
        starts = (np.cumsum(sizes) - sizes)[sizes > 0]
        some = 1 - np.exp(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-9)), starts))
        out = np.minimum(1.0, p / np.repeat(np.maximum(some, 1e-9), sizes[sizes > 0]))
    return out * np.repeat(toxic, sizes)


def fitted(texts: list[bytes], labels: list[int], rounds: int = 4, em: int = 2, group: int = 250, rate: float = 0.5, decay: float = 1e-6) -> Field:
    """The field, from labelled texts: minibatch ascent of the likelihood with a step of its own for each weight, `rounds` times by
    the evidence of words and then `em` times by the field's own marginals."""
    field = Field()
    share = (sum(labels) + 0.5) / (len(labels) + 1)
    field.document = (float(np.log(share / (1 - share))), 0.0, 0.0)
    if not 0 < sum(labels) < len(labels):
        return field
    ids_of, sizes_of = field.tokens(texts)
    words = [normal(w) for w in field.known]
    table = [features(w) for w in words]
    own, after, before = (np.array([t[k] for t in table], dtype=np.int64).reshape(len(table), -1 if k == 0 else 1) for k in range(3))
    after, before = after.ravel(), before.ravel()
    sure = evidence(texts, labels)
    sure_of, ends = np.array([sure.get(w, 0.0) for w in words]), np.cumsum(sizes_of)
    w, squares, move_squares, first_squares = field.weights, np.full(1 << BITS, 1e-2), np.full((2, 2), 1e-2), np.full(2, 1e-2)
    for n in range(rounds + em):
        for at in range(0, len(texts), group):
            sizes = sizes_of[at : at + group]
            ids = ids_of[ends[at] - sizes_of[at] : ends[min(at + group, len(texts)) - 1]]
            if not len(ids):
                continue
            met, at_met = np.unique(ids, return_inverse=True)
            starts = (np.cumsum(sizes) - sizes)[sizes > 0]
            inner = np.ones(len(ids), dtype=bool)
            inner[starts] = False
            odds = w[own[met]].sum(axis=1)[at_met]
            odds[1:] += w[after[met]][at_met[:-1]] * inner[1:]
            odds[:-1] += w[before[met]][at_met[1:]] * inner[1:]
            p, pairs = marginals(odds, starts, field.moves, field.first)
            toxic = np.array(labels[at : at + group], dtype=float)
            y = targets(sure_of[ids] if n < rounds else p, toxic, sizes)
            miss = y - p
            sums = [np.bincount(x, weights=m, minlength=len(met)) for x, m in ((at_met, miss), (at_met[:-1], miss[1:] * inner[1:]), (at_met[1:], miss[:-1] * inner[1:]))]
            slope = -decay * len(ids) * w
            for features_of, by_word in (*((own[met, k], sums[0]) for k in range(3)), (after[met], sums[1]), (before[met], sums[2])):
                np.add.at(slope, features_of, by_word)
            state = np.stack([1 - y, y])
            seen = (state[:, :-1] * inner[1:]) @ state[:, 1:].T  # expected moves, neighbours taken as independent
            begin = np.array([p[starts].sum() - y[starts].sum(), y[starts].sum() - p[starts].sum()])
            for value, g, sq in ((w, slope, squares), (field.moves, seen - pairs, move_squares), (field.first, begin, first_squares)):
                sq += g * g
                value += rate * g / np.sqrt(sq)
    field.forget(0)
    inputs = [field.inputs(texts[at : at + group])[:2] for at in range(0, len(texts), group)]
    x = np.stack([np.ones(len(texts)), np.concatenate([t for t, _ in inputs]), np.log1p(np.concatenate([t for _, t in inputs]))], axis=1)
    w, y = np.zeros(3), np.array(labels, dtype=float)
    for _ in range(50):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        w += np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
    field.document = tuple(map(float, w))
    field.forget(0)
    return field


def spans(text: bytes, p: np.ndarray, least: float = 0.5) -> str:
    """start:end of stretches of toxic tokens, comma-joined."""
    out: list = []
    last = -2
    for k, m in enumerate(WORD.finditer(text.decode())):
        if p[k] >= least:
            if last == k - 1:
                out[-1][1] = m.end()
            else:
                out.append([m.start(), m.end()])
            last = k
    return ",".join(f"{a}:{b}" for a, b in out)


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, text_bytes: int = TEXT_BYTES, sample_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], list[int]]:
    """Texts and labels of the first labelled documents, by a hash of doc_id: at most `rows`, texts of at most `text_bytes`, and no
    more once they are `sample_bytes` together."""
    ids = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", text.alias("text")).join(F.broadcast(ids), "doc_id").filter(F.octet_length("text") <= text_bytes)
    found = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    texts, marks, size = [], [], 0
    for r in found.orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():  # partition by partition, to the bound
        data = r["text"].encode().translate(LOWER)
        if (size := size + len(data)) > sample_bytes:
            break
        texts.append(data)
        marks.append(int(r["toxic"] > 0))
    return texts, marks


def scored(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score, n_toxic (tokens of marginal 0.5 or more), spans."""
    sent = docs.sparkSession.sparkContext.broadcast(field.state())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field.of(sent.value)
        for batch in batches:
            texts = [(t.as_py() or b"").translate(LOWER) for t in batch.column("text").cast(pa.binary())]
            at = 0
            while at < len(texts):
                stop, n = at, 0
                while stop < len(texts) and (stop == at or n + len(texts[stop]) <= CHUNK):
                    n += len(texts[stop])
                    stop += 1
                top, total, p, sizes = field.inputs(texts[at:stop])
                ends = np.cumsum(sizes)
                marked = [spans(t, p[e - s : e]) if m >= 0.5 else "" for t, e, s, m in zip(texts[at:stop], ends, sizes, top, strict=True)]
                hits = np.concatenate([[0], np.cumsum(p >= 0.5)])
                cols = [batch.column("doc_id").slice(at, stop - at), pa.array(field.scores(top, total)), pa.array((hits[ends] - hits[ends - sizes]).astype(np.int64)), pa.array(marked, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "score", "n_toxic", "spans"])
                field.forget()
                at = stop

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, n_toxic bigint, spans string")


def is_held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from labelled documents whose crc32(doc_id) mod 5 is not 0 and scores all."""
    rest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    field = fitted(*sample(docs, labels.filter(rest != 0)))
    return scored(docs, field).select("doc_id", (rest == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic", "spans")
