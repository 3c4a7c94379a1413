"""Language-model scoring by prediction by partial matching (PPM) over bytes.

The model is a trie of byte contexts up to ORDER bytes, with the counts of the symbols that followed. Escape estimation is
method C: in a context with T counts and q distinct symbols a symbol of count n has probability n / (T + q), the escape to the
next shorter context q / (T + q). Symbols of the longer context are excluded from the shorter one; as every symbol of a context
also occurs in its suffixes, what is excluded is the longer context's symbol set, so both T and q of the shorter one are
reduced by sums that are known for each context. Below order 0 the unseen bytes share the rest evenly.

Training counts all texts and keeps every entry: tasks count the (ORDER + 1)-grams and tokens of what they read, Spark sums the
counts, and the shorter contexts follow from the longest by summing. The probability of each distinct gram of the scored texts is
found by Spark too: a context's unseen symbols go down the trie by one join an order, and a context is one row of at most 256
symbols. `adaptive` scores a text by a trie that starts empty and learns as it goes.

The unigram base: log10((c + 1) / (N + V + 1)) for each token.

The most frequent tokens and grams (at most HOT and HOT_GRAMS, which bounds what is broadcast) are looked up in the tasks; the
rest of a document's are joined with their values by Spark. Both ways add the same numbers, so the bounds change no result, and
what is joined has few occurrences a key.

Texts are lower-cased A-Z; a text is preceded by ORDER zero bytes and ended by one, which the score includes.

Defined results: null text is empty (its only token is the end); a null doc_id counts as the id ''; repeated rows are texts of
their own, in training too; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import written

ORDER = 5
HOT_GRAMS = 1_000_000
HOT = 100_000
CHUNK = 2_000_000
CACHE = 300_000
END = b"\n"  # no word holds it
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
GRAM, TOKEN = 0, 1


def token_key(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word) - (1 << 63)


def gram_keys(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The key of each symbol of the texts, ends included, and where each text starts among them. A key holds the bytes of the
    context, the nearest first, then the symbol: keys of a shorter context are prefixes of it, but for the symbol."""
    pad = bytes(order)
    data = np.frombuffer(b"".join(pad + t + b"\0" for t in texts), dtype=np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    key = np.zeros(len(data) - order, dtype=np.int64)
    for back in range(1, order + 1):
        key = (key << 8) | data[order - back : len(data) - back]
    key = (key << 8) | data[order:]
    keep = np.ones(len(key), dtype=bool)
    # among the symbols are also the pads of all texts but the first
    pads = (starts + order * np.arange(len(texts)))[1:, None] - order + np.arange(order)[None, :]
    keep[pads.ravel()] = False
    return key[keep], starts


def chunks(texts: Iterator[bytes], size: int = CHUNK) -> Iterator[list[bytes]]:
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


def lowered(batch: pa.RecordBatch) -> list[bytes]:
    return [(t.as_py() or b"").translate(LOWER) for t in batch.column("text").cast(pa.binary())]


def counted(docs: DataFrame, learn: Column, order: int = ORDER) -> DataFrame:
    """kind, key, n, m: how often each gram occurs in the texts (m) and in those where learn is true (n); tokens of the latter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, flags = lowered(batch), batch.column("learn").to_pylist()
            for learned in (True, False):
                for part in chunks(t for t, f in zip(texts, flags, strict=True) if bool(f) == learned):
                    keys, n = np.unique(gram_keys(part, order)[0], return_counts=True)
                    yield made(GRAM, keys, n if learned else 0 * n, n)
                    if not learned:
                        continue
                    words: Counter = Counter()
                    for text in part:
                        words.update(text.split())
                    words[END] = len(part)
                    n = np.fromiter(words.values(), np.int64, len(words))
                    yield made(TOKEN, np.fromiter(map(token_key, words), np.int64, len(words)), n, n)

    def made(kind, keys, n, m):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), *(pa.array(c.astype(np.int64)) for c in (keys, n, m))], names=["kind", "key", "n", "m"])

    found = docs.select("text", learn.alias("learn")).mapInArrow(run, "kind int, key bigint, n bigint, m bigint")
    return found.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def least_count(counts: DataFrame, most: int, of: str = "n") -> int:
    """The smallest count such that at most `most` rows have it or more; from a table of at most 1100 rows."""
    step = F.when(F.col(of) <= 1024, F.col(of)).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(of))).cast("bigint"))
    rows = sorted((r["step"], r["count"]) for r in counts.groupBy(step.alias("step")).count().collect())
    total = 0
    for at in range(len(rows) - 1, -1, -1):
        total += rows[at][1]
        if total > most:
            return rows[at + 1][0] if at + 1 < len(rows) else int(rows[at][0]) * 2
    return 1


def trie_entries(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """order, key, n of the contexts shorter than order, from the counts of the longest ones."""
    at, out = grams.select("key", "n"), None
    for d in range(order - 1, -1, -1):
        shorter = F.shiftleft(F.shiftright("key", 16), 8).bitwiseOR(F.col("key").bitwiseAND(F.lit(255)))
        at = at.groupBy(shorter.alias("key")).agg(F.sum("n").alias("n"))
        level = at.select(F.lit(d).alias("order"), "key", "n")
        out = level if out is None else out.unionByName(level)
    return out


def probabilities(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """key, m, value: log10 of the probability of each gram's last symbol after its context. grams: key, n (0: not learned), m.

    A row is a context: the symbols that are still missing, those that the contexts above exclude, and the log10 of the
    escapes so far. Each order is one join with the counts of the shorter context."""
    symbol = F.col("key").bitwiseAND(F.lit(255)).cast("int")
    q, t = F.col("q").cast("double"), F.col("t").cast("double")

    def escape():
        return F.when(q > 0, F.log10(q / (t + q))).otherwise(F.lit(0.0))

    def valued(x, value):
        return F.struct(x["s"].alias("s"), x["m"].alias("m"), value.alias("value"))

    rows = grams.groupBy(F.shiftright("key", 8).alias("context")).agg(
        F.collect_list(F.struct(symbol.alias("s"), "n", "m")).alias("rows"), F.sum("n").alias("t"), F.count_if(F.col("n") > 0).alias("q")
    )
    seen = F.filter("rows", lambda x: x["n"] > 0)
    first = rows.select(
        "context",
        F.transform(F.filter("rows", lambda x: x["n"] == 0), lambda x: F.struct(x["s"].alias("s"), x["m"].alias("m"))).alias("missing"),
        F.transform(seen, lambda x: x["s"]).alias("seen"),
        F.transform(seen, lambda x: valued(x, F.log10(x["n"] / (t + q)))).alias("done"),
        escape().alias("log"),
    )
    first = written(first, "contexts")
    trie = written(trie_entries(grams.filter("n > 0"), order), "trie")
    left = first.filter(F.size("missing") > 0)
    for d in range(order - 1, -1, -1):
        node = trie.filter(F.col("order") == d).groupBy(F.shiftright("key", 8).alias("node")).agg(
            F.map_from_entries(F.collect_list(F.struct(symbol, "n"))).alias("of"), F.sum("n").alias("t"), F.count(F.lit(1)).alias("q")
        )
        if d < 2:
            node = F.broadcast(node)  # at most 256 contexts of at most 256 symbols
        left = left.join(node, F.shiftright("context", 8 * (order - d)) == F.col("node"), "left")
        excluded = F.aggregate("seen", F.lit(0).cast("bigint"), lambda a, s: a + F.col("of")[s])
        left = left.withColumns({"t": t - excluded, "q": q - F.size("seen")})
        holds = lambda x: F.coalesce(F.map_contains_key(F.col("of"), x["s"]), F.lit(False))
        met = F.transform(F.filter("missing", holds), lambda x: valued(x, F.col("log") + F.log10(F.col("of")[x["s"]] / (t + q))))
        left = left.select(
            "context",
            F.filter("missing", lambda x: ~holds(x)).alias("missing"),
            F.coalesce(F.map_keys("of"), F.col("seen")).alias("seen"),
            F.concat("done", met).alias("done"),
            (F.col("log") + escape()).alias("log"),
        )
    never = F.transform("missing", lambda x: valued(x, F.col("log") - F.log10(256 - F.size("seen"))))
    left = left.select("context", F.concat("done", never).alias("done"))
    out = first.filter(F.size("missing") == 0).select("context", "done").unionByName(left).select("context", F.explode("done").alias("x"))
    return out.select(F.shiftleft("context", 8).bitwiseOR(F.col("x.s").cast("bigint")).alias("key"), "x.m", "x.value")


def adaptive(text: bytes, order: int = ORDER) -> float:
    """log10 probability of one text by a trie that learns as it reads; per symbol work of at most order + 1 contexts."""
    seen: dict[bytes, Counter] = {}
    total, data = 0.0, bytes(order) + text + b"\0"
    for i in range(order, len(data)):
        symbol, excluded, p = data[i], set(), 1.0
        for d in range(order, -1, -1):
            c = seen.get(data[i - d : i])
            if not c:
                continue
            left = {s: n for s, n in c.items() if s not in excluded}
            if not left:
                continue
            whole = sum(left.values()) + len(left)
            if symbol in left:
                p *= left[symbol] / whole
                break
            p *= len(left) / whole
            excluded |= left.keys()
        else:
            p /= 256 - len(excluded)
        total += math.log10(p)
        for d in range(order + 1):
            seen.setdefault(data[i - d : i], Counter())[symbol] += 1
    return total


def remainder(divisor: int, of: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(of).cast("string"), F.lit("")).cast("binary")) % divisor


def looked_up(texts: list[bytes], order: int, hot_keys: np.ndarray, hot_values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sum of the values of each text's hot grams; and text, key and number of occurrences of its other grams."""
    keys, starts = gram_keys(texts, order)
    distinct, at = np.unique(keys, return_inverse=True)
    place = np.searchsorted(hot_keys, distinct)
    found = np.zeros(len(distinct), dtype=bool)
    inside = place < len(hot_keys)
    found[inside] = hot_keys[place[inside]] == distinct[inside]
    values = np.zeros(len(distinct))
    values[found] = hot_values[place[found]]
    lost = np.flatnonzero(~found[at])
    pairs, tf = np.unique((np.searchsorted(starts, lost, "right") - 1) * len(distinct) + at[lost], return_counts=True)
    return np.add.reduceat(values[at], starts), pairs // len(distinct), distinct[pairs % len(distinct)], tf.astype(np.int64)


def scored(docs: DataFrame, order: int, hot_grams: tuple[np.ndarray, np.ndarray], hot: dict[int, float]) -> DataFrame:
    """row, doc_id, n_tokens, hot_score (of the hot grams), hot_sum and hot_known (of the tokens in hot), rare (kind, key, tf of
    the other tokens and grams)."""
    sent = docs.sparkSession.sparkContext.broadcast((hot_grams, hot))
    of = pa.struct([("kind", pa.int32()), ("key", pa.int64()), ("tf", pa.int64())])

    def rare(text, kind, key, tf, n):
        """One list a text, from rows in any order."""
        up = np.argsort(text, kind="stable")
        ends = np.searchsorted(text[up], np.arange(n + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(c[up]) for c in (kind, key, tf)], fields=list(of)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (hot_keys, hot_values), hot = sent.value
        row = TaskContext.get().partitionId() << 33
        cache: dict[bytes, tuple] = {}

        def look(word):
            key = token_key(word)
            cache[word] = found = (key, hot.get(key))
            return found

        for batch in batches:
            ids, at = batch.column("doc_id"), 0
            for part in chunks(iter(lowered(batch))):
                scores, *grams = looked_up(part, order, hot_keys, hot_values)
                n_tokens, sums, known, others = [], [], [], []
                for k, text in enumerate(part):
                    words = text.split()
                    words.append(END)
                    total, seen = 0.0, 0
                    for word, tf in Counter(words).items():
                        key, value = cache.get(word) or look(word)
                        if value is None:
                            others.append((k, key, tf))
                        else:
                            total += tf * value
                            seen += tf
                    n_tokens.append(len(words))
                    sums.append(total)
                    known.append(seen)
                if len(cache) > CACHE:
                    cache.clear()
                tokens = np.array(others, dtype=np.int64).reshape(-1, 3)
                kinds = np.repeat(np.array([TOKEN, GRAM], np.int32), [len(tokens), len(grams[0])])
                lists = rare(*(np.concatenate([tokens[:, 0], grams[0]]), kinds, np.concatenate([tokens[:, 1], grams[1]]), np.concatenate([tokens[:, 2], grams[2]])), len(part))
                rows = np.arange(row, row + len(part), dtype=np.int64)
                row += len(part)
                cols = [pa.array(rows), ids.slice(at, len(part)), pa.array(n_tokens, pa.int64()), pa.array(scores), pa.array(sums, pa.float64()), pa.array(known, pa.int64()), lists]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "n_tokens", "hot_score", "hot_sum", "hot_known", "rare"])
                at += len(part)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"row bigint, doc_id {kind}, n_tokens bigint, hot_score double, hot_sum double, hot_known bigint, rare array<struct<kind:int,key:bigint,tf:bigint>>"
    )


def scored_by(docs: DataFrame, counts: DataFrame, order: int = ORDER, hot: int = HOT, hot_grams: int = HOT_GRAMS) -> DataFrame:
    """One row a document: doc_id, n_tokens, n_known, train_tokens, base_score, score. counts hold all grams of docs."""
    counts = written(counts, "counts")
    tokens = counts.filter(F.col("kind") == TOKEN).select("key", "n")
    total = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    least = least_count(tokens, hot)
    often = {r["key"]: math.log10(r["n"] + 1) for r in tokens.filter(F.col("n") >= least).toLocalIterator()}  # at most hot rows
    grams = counts.filter(F.col("kind") == GRAM).select("key", "n", "m")
    least_gram = least_count(grams, hot_grams, "m")
    values = written(probabilities(grams, order), "probabilities")
    near = values.filter(F.col("m") >= least_gram).select("key", "value").toArrow()  # at most hot_grams rows
    keys, value = near.column("key").to_numpy(), near.column("value").to_numpy()
    up = np.argsort(keys)
    table = written(scored(docs, order, (keys[up], value[up]), often), "scored")
    rest_of = tokens.filter(F.col("n") < least).select(F.lit(TOKEN).alias("kind"), "key", F.log10(F.col("n") + 1).alias("value"))
    rest_of = rest_of.unionByName(values.filter(F.col("m") < least_gram).select(F.lit(GRAM).alias("kind"), "key", "value"))
    rest = table.select("row", F.explode("rare").alias("r")).select("row", "r.*").join(rest_of, ["kind", "key"])
    part, is_token = F.col("tf") * F.col("value"), F.col("kind") == TOKEN
    rest = rest.groupBy("row").agg(F.sum(F.when(is_token, part)).alias("sum"), F.sum(F.when(is_token, F.col("tf"))).alias("known"), F.sum(F.when(~is_token, part)).alias("grams"))
    each = math.log10(total["n"] + total["v"] + 1)
    out = table.drop("rare").join(rest, "row", "left")
    return out.select(
        "doc_id", "n_tokens", (F.col("hot_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total["n"]).cast("bigint").alias("train_tokens"),
        (F.col("hot_sum") + F.coalesce("sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(each)).alias("base_score"),
        (F.col("hot_score") + F.coalesce("grams", F.lit(0.0))).alias("score"),
    )


def score(docs: DataFrame, train: DataFrame, order: int = ORDER, hot: int = HOT, hot_grams: int = HOT_GRAMS) -> DataFrame:
    """Learns from train and scores docs."""
    both = docs.select("text", F.lit(False).alias("learn")).unionByName(train.select("text", F.lit(True).alias("learn")))
    return scored_by(docs, counted(both, F.col("learn"), order), order, hot, hot_grams)


def query(docs: DataFrame, order: int = ORDER, hot: int = HOT, hot_grams: int = HOT_GRAMS) -> DataFrame:
    """Learns from the documents whose crc32(doc_id) mod 7 is not 2 and scores all."""
    out = scored_by(docs, counted(docs, remainder(7) != 2, order), order, hot, hot_grams)
    return out.select("doc_id", (remainder(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
