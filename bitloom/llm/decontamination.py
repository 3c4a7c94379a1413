"""Benchmark decontamination by winnowing, as DataFrame operations alone.

Of every WINDOW consecutive hashes of GRAM words the least is kept (the rightmost of equals). Any SPAN = GRAM + WINDOW - 1 = 10
words that two texts share therefore share a kept hash at the same place of the span. Kept hashes of the documents are joined
with those of the benchmark, and each hit is extended by up to SPAN - GRAM words to both sides, comparing word by word: that
is all that windows of SPAN words around it can reach. Both sides carry the words around a kept hash as 64-bit hashes.

Items of fewer than SPAN words are one window of their own length, which the winnowing guarantee does not reach: for the lengths
that occur (at most SPAN - 1), the documents' windows of those lengths are joined as they are, all in one pass.

Items that share a passage are one entry of the join with the list of their ids, so that hits are documents x passages.

The benchmark's hashes are broadcast if there are at most BROADCAST_ROWS of them, which is counted first; else Spark joins the
two sides by a shuffle.

Defined results: null text has no words; a null item_id is the id ''; rows repeated in either table count once in the item
lists and keep their own output row; a null doc_id is matched like any other; very long texts are taken whole, in one row; empty
tables give no hits or an empty table; other columns are ignored (`filtered`: kept).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, UPPER, boxed, indices, let, matched, unboxed, written

GRAM, WINDOW = 5, 6
SPAN = GRAM + WINDOW - 1
REACH = SPAN - GRAM
BROADCAST_ROWS = 300_000
LAST = 0x7FFF_FFFF  # greatest place of a word: an array holds no more
BETWEEN = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case. All that parts words becomes a blank in the pass that lower-cases, so that no regular
    expression goes over the text."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER + BETWEEN, LOWER + " " * len(BETWEEN)), " "), "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def along(a: Column, b: Column, by: int, both) -> Column:
    """both(a[i], b[i + by]) for every i of a; where b has ended it is given null."""
    return F.zip_with(a, F.slice(b, by + 1, F.size(b)), lambda x, y: both(x, y))


def kept_grams(h: Column) -> Column:
    """The winnowed grams of a text of at least SPAN words, given its word hashes, each as one number: the upper 33 bits of the gram's
    hash, then LAST - its place. The least number of a window is that of the rightmost of the least grams."""
    # of 2, then 4, then GRAM words
    grams = let(h, lambda h: let(along(h, h, 1, F.xxhash64), lambda two: along(along(two, two, 2, F.xxhash64), h, 4, F.xxhash64)))
    numbers = F.transform(grams, lambda g, i: g.bitwiseAND(F.lit(~LAST)).bitwiseOR(F.lit(LAST) - i))
    # of 2, then 4, then WINDOW places
    least = let(numbers, lambda k: let(along(k, k, 1, F.least), lambda two: let(along(two, two, 2, F.least), lambda four: along(four, four, 2, F.least))))
    return F.array_distinct(F.slice(least, 1, F.greatest(F.size(h) - (SPAN - 1), F.lit(0))))


def kept(texts: DataFrame) -> DataFrame:
    """A row for each kept gram of the texts, given their word hashes h, with its place at. The grams are a column before they are
    exploded, as a generator that holds a higher-order function copies all its columns for each gram. The generator is the outer one, as
    the plain one is preceded by a filter that computes the grams once more, to see whether there are any."""
    columns = texts.columns
    found = texts.withColumn("k", kept_grams(F.col("h"))).select(*columns, F.explode_outer("k").alias("k"))
    at = F.lit(LAST) - F.col("k").bitwiseAND(F.lit(LAST))
    return found.select(*columns, at.cast("int").alias("at"), F.shiftright("k", LAST.bit_length()).alias("gram")).filter("gram IS NOT NULL")


def around(h: Column, p: Column) -> Column:
    return F.array(*[F.get(h, p + d) for d in range(-REACH, GRAM + REACH)])


def all_grams(h: Column, n: int) -> Column:
    return F.transform(indices(F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + d) for d in range(n)]))


def is_small(df: DataFrame) -> bool:
    return df.count() <= BROADCAST_ROWS


def places(keyed: DataFrame, train: DataFrame) -> DataFrame:
    """doc_id, digest, at, around, items, theirs: where the documents (doc_id, digest, h) have a gram of train."""
    # a gram keeps its place, and the words of a document pass the join by reference: only hits look up their neighbours
    found = kept(keyed)
    if not is_small(train):
        return found.select("doc_id", "digest", "gram", "at", around(F.col("h"), F.col("at")).alias("around")).join(train, "gram")
    found = found.join(F.broadcast(train.select("gram").distinct()), "gram", "left_semi")
    return found.select("doc_id", "digest", "gram", "at", around(F.col("h"), F.col("at")).alias("around")).join(F.broadcast(train), "gram")


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, digest, items, start, stop: the word spans of documents that lie in occurrences of windows of these items."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), word_hashes(F.col("text")).alias("h"))
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("digest"), word_hashes(F.col("text")).alias("h"))
    train = kept(items).select("item", "gram", around(F.col("h"), F.col("at")).alias("theirs"))
    train = train.groupBy("gram", "theirs").agg(F.sort_array(F.collect_set("item")).alias("items"))
    pairs = places(keyed, train)

    def run(offsets):
        """How many of the words at these offsets are equal, counted until the first that isn't."""
        out = F.lit(0)
        for d in reversed(offsets):
            k = d + REACH
            out = F.when(F.coalesce(F.get("around", F.lit(k)) == F.get("theirs", F.lit(k)), F.lit(False)), out + 1).otherwise(0)
        return out

    same = run(range(GRAM)) == GRAM
    pairs = pairs.filter(same).withColumn("l", run(range(-1, -REACH - 1, -1))).withColumn("r", run(range(GRAM, GRAM + REACH))).filter(F.col("l") + F.col("r") >= REACH)
    out = pairs.select("doc_id", "digest", "items", (F.col("at") - F.col("l")).alias("start"), (F.col("at") + GRAM + F.col("r")).alias("stop"))

    lengths = sorted(r.n for r in items.select(F.size("h").alias("n")).filter((F.col("n") > 0) & (F.col("n") < SPAN)).distinct().collect())  # at most SPAN - 1
    if not lengths:
        return out
    whole = F.coalesce(*[F.when(F.size("h") == n, F.xxhash64(*[F.get("h", F.lit(d)) for d in range(n)])) for n in lengths])
    windows = items.filter(F.size("h").isin(lengths)).groupBy(F.size("h").alias("n"), whole.alias("gram")).agg(F.sort_array(F.collect_set("item")).alias("items"))

    def of(h, n):
        return F.transform(all_grams(h, n), lambda g, at: F.struct(F.lit(n).alias("n"), at.alias("at"), g.alias("gram")))

    every = let(F.col("h"), lambda h: F.concat(*[of(h, n) for n in lengths]))
    found = keyed.select("doc_id", "digest", F.explode_outer(every).alias("w")).select("doc_id", "digest", "w.*").join(F.broadcast(windows) if is_small(windows) else windows, ["n", "gram"])
    return out.unionByName(found.select("doc_id", "digest", "items", F.col("at").alias("start"), (F.col("at") + F.col("n")).alias("stop")))


def covered(spans: Column) -> Column:
    """Words in the union of spans (start, stop) that are sorted by start."""
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("bigint").alias("n"))

    def step(a, s):
        return F.struct(F.greatest(a["upto"], s["stop"]).alias("upto"), (a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(a["upto"], s["start"]))).alias("n"))

    return F.aggregate(spans, zero, step, lambda a: a["n"])


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = hits(docs, benchmark).groupBy("doc_id", "digest").agg(
        F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    ).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), covered(F.col("spans")).alias("n_hit"), F.size("items").alias("n_items"), F.array_join("items", ",").alias("items"))
    base = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("digest"), F.size(words(F.col("text"))).cast("bigint").alias("n_words"))
    out = base.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("bigint")
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.col("n_items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.col("items"), F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def filtered(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, with all their columns."""
    bad = hits(docs, benchmark).select(F.col("doc_id").alias("bad_id"), F.col("digest").alias("bad_digest")).distinct()
    bad = written(bad, "contaminated")
    keyed = boxed(docs, id=F.col("doc_id"), digest=F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    same = F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("digest") == F.col("bad_digest"))
    return unboxed(matched(keyed, bad, same, "left_anti", BROADCAST_ROWS), docs)


ORACLE = r"""
WITH dd AS (SELECT DISTINCT coalesce(text, '') AS body FROM documents),
dw AS (SELECT body, regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM dd),
bw AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bg AS (
  SELECT DISTINCT item, n, list_aggregate(w[i : i + n - 1], 'string_agg', ' ') AS g
  FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bg),
dg AS (
  SELECT body, i, n, list_aggregate(w[i : i + n - 1], 'string_agg', ' ') AS g
  FROM (SELECT body, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
h AS (SELECT body, item, i, dg.n FROM dg JOIN bg ON dg.g = bg.g AND dg.n = bg.n),
words AS (SELECT body, count(DISTINCT p) AS n_hit FROM (SELECT body, unnest(range(i, i + n)) AS p FROM h) GROUP BY body),
its AS (SELECT body, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT body, item FROM h) GROUP BY body)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents d JOIN dw ON coalesce(d.text, '') = dw.body LEFT JOIN words ON dw.body = words.body LEFT JOIN its ON dw.body = its.body
"""
