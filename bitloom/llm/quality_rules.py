"""Quality rules with cross-document line frequency, as DataFrame operations alone.

A line counts once for each distinct document of a host (`source`) that holds it; a document is a doc_id with its text. Lines in
more documents than the host's limit are boilerplate: they are removed from every document but the one that had them first (that
of the smallest doc_id), and a document whose remaining words are fewer than `min_share` of all its words is rejected as depleted.
The limit follows the host's size: `share` of its rows, but at least `least` and at most `max_docs` documents, so that a host of
ten pages loses what three of them repeat and a host of millions what 51 do.

The lines are counted by partial sums, so a line that a third of all documents hold is no hot key there. Lines above the limit
are few; they are counted, and broadcast up to BROADCAST_ROWS. Beyond, they meet the documents' lines by a shuffle in which each
of them is dealt to SALTS keys.

Defined results: null text is a text without words; null source is the host ''; a null doc_id counts as the largest; repeated
rows are one document and share one verdict, each row keeps its own output row; exact copies under several doc_ids are documents
of their own; of documents that had a line first under one doc_id, the one of the smallest hash keeps it; very long texts are
taken whole, in one row; an empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import add, boxed, indices, let, scratch, space_words, unboxed, written

MAX_DOCS, LEAST_DOCS, SHARE = 50, 2, 0.1
MIN_SHARE = 0.5
BROADCAST_ROWS = 200_000
SALTS = 64
SYMBOLS = "[#*$%&|<>]"


def normalised(text: Column) -> Column:
    """Lower case, white space collapsed (line feeds stay), digits alike; the lines are still to be trimmed."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[\\x20\\x09\\x0B-\\x0D]{2,}|[\\x09\\x0B-\\x0D]", " "), "[1-9]", "0")


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(normalised(line)))


def repeat_words(words: Column) -> Column:
    """Words within 3-word windows that occur at least twice in the text: a long.

    Sorting the windows' hashes brings equal ones together."""

    def of(starts):
        gaps = F.transform(starts, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - p, F.lit(3))))
        return add(gaps.cast("array<bigint>"))

    def sorted_twice(h):
        """By n log n, for any number of repeated windows."""

        def repeated(order):
            twice = F.filter(
                order,
                lambda e, i: F.coalesce(F.get(order, i - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(order, i + 1)["h"] == e["h"], F.lit(False)),
            )
            return F.sort_array(F.transform(twice, lambda e: e["i"]))

        return let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), repeated)

    def windows(h):
        order = F.sort_array(h)
        twice = let(order, lambda s: F.array_distinct(F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1) == x, F.lit(False)))))
        # few repeated windows: look each one up
        looked_up = lambda t: F.filter(indices(F.size(h) - 1), lambda i: F.array_contains(t, F.get(h, i)))
        return let(twice, lambda t: F.when(F.size(t) == 0, F.lit(0).cast("bigint")).when(F.size(t) <= 16, let(looked_up(t), of)).otherwise(let(sorted_twice(h), of)))

    def hashes(h):
        return let(F.transform(indices(F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))), windows)

    return let(F.transform(words, lambda w: F.xxhash64(w)), hashes)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, host, digest of the text, and the counts of one row; no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = docs.select(
        F.col("doc_id"),
        F.coalesce(F.col("source"), F.lit("")).alias("host"),
        F.xxhash64(text).alias("digest"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        let(
            F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
            lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
        ).alias("n_dup_lines"),
        let(space_words(text), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), F.char_length(F.array_join(w, "")).cast("bigint").alias("c"), repeat_words(w).alias("r"))).alias("w"),
    )
    return bare.select("doc_id", "host", "digest", F.col("w.n").alias("n_words"), F.col("w.c").alias("word_chars"), "n_symbols", "n_dup_lines", F.col("w.r").alias("n_repeat_words"))


def line_counts(text: Column) -> Column:
    """An array of (line, w, times): the distinct normalised lines that have a word, by hash, in one text."""

    def of(order):
        starts = F.filter(indices(F.size(order) - 1), lambda i: ~F.coalesce(F.get(order, i - 1)["line"] == F.get(order, i)["line"], F.lit(False)))
        runs = let(
            starts,
            lambda s: F.transform(
                s, lambda i, k: F.struct(F.get(order, i)["line"].alias("line"), F.get(order, i)["w"].alias("w"), (F.coalesce(F.get(s, k + 1), F.size(order)) - i).alias("times"))
            ),
        )
        return runs

    def hashed(line):
        return F.struct(F.xxhash64(line).alias("line"), (F.char_length(line) - F.char_length(F.translate(line, " ", "")) + 1).alias("w"))

    lines = F.array_remove(F.transform(F.split(normalised(text), "\n"), lambda x: F.trim(x)), "")
    return let(F.sort_array(F.transform(lines, hashed)), of)


def host_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["source"], F.lit(""))


def limit(rows: Column, max_docs: int, least: int, share: float) -> Column:
    """In how many documents of a host of so many rows a line may be."""
    return F.greatest(F.lit(float(least)), F.least(F.lit(float(max_docs)), F.lit(float(share)) * rows))


def removed_lines(docs: DataFrame, max_docs: int = MAX_DOCS, least: int = LEAST_DOCS, share: float = SHARE) -> DataFrame:
    """host, doc_id, digest, line (hash), words: the boilerplate lines that each document loses, with the words they take."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select("doc_id", host_of(docs).alias("host"), F.xxhash64(text).alias("digest"), F.explode(line_counts(text)).alias("l"))
    # one row for each document and line: a common line is spread over the documents that hold it
    held = lines.groupBy("host", F.col("l.line").alias("line"), "doc_id", "digest").agg(F.max(F.col("l.times") * F.col("l.w")).alias("words"))
    held = written(held, "lines")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("digest"))
    common = held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs"), F.min(order).alias("first")).filter(F.col("docs") > least)
    rows = docs.groupBy(host_of(docs).alias("host")).agg(F.count(F.lit(1)).alias("rows"))
    common = common.join(rows, "host").filter(F.col("docs") > limit(F.col("rows"), max_docs, least, share)).select("host", "line", "first")
    common = written(common, "boilerplate")
    if common.count() <= BROADCAST_ROWS:
        found = held.join(F.broadcast(common), ["host", "line"])
    else:
        found = held.withColumn("salt", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(SALTS)).cast("int"))
        found = found.join(common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "line", "salt"])
    return found.filter(~order.eqNullSafe(F.col("first"))).select("host", "doc_id", "digest", "line", "words")


def lost_by(docs: DataFrame, keyed: DataFrame, lost: DataFrame) -> DataFrame:
    """keyed (with host, id, digest) beside what its documents lose (its columns named l_...). Few such documents are broadcast,
    so that no text is shuffled; the keys of many are distinct, so no key is hot but that of a repeated row."""
    lost = lost.withColumnsRenamed({"host": "l_host", "doc_id": "l_id", "digest": "l_digest"})
    same = (F.col("host") == F.col("l_host")) & F.col("id").eqNullSafe(F.col("l_id")) & (F.col("digest") == F.col("l_digest"))
    return keyed.join(lost, same, "left")


def is_in(ascending: Column, x: Column) -> Column:
    """Whether a sorted array has x, by binary search; a few elements are looked at one by one."""

    def searched(steps):
        # at the end of the steps, as many elements as `n` are at most x
        step = lambda n, p: F.when(F.coalesce(F.get(ascending, n + p - 1) <= x, F.lit(False)), n + p).otherwise(n)
        return F.get(ascending, F.aggregate(steps, F.lit(0), step) - 1) == x

    powers = F.transform(F.sequence(F.floor(F.log2(F.size(ascending))).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.when(F.size(ascending) <= 16, F.array_contains(ascending, x)).otherwise(F.coalesce(searched(powers), F.lit(False)))


def without_lines(text: Column, gone: Column) -> Column:
    """The text without the lines whose hash is in the sorted array gone (null: none)."""
    kept = lambda g: F.filter(F.split(text, "\n"), lambda x: ~let(line_hash(x), lambda h: is_in(g, h)))
    return F.when(gone.isNull(), text).otherwise(F.array_join(let(gone, kept), "\n"))


def judge(docs: DataFrame, max_docs: int = MAX_DOCS, min_share: float = MIN_SHARE, least: int = LEAST_DOCS, share: float = SHARE) -> DataFrame:
    """One row a document: the counts, base_failed, removed_words and kept."""
    lost = removed_lines(docs, max_docs, least, share).groupBy("host", "doc_id", "digest").agg(F.sum("words").alias("removed_words"))
    out = lost_by(docs, measures(docs).withColumnRenamed("doc_id", "id"), lost)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    removed = F.coalesce(F.col("removed_words"), F.lit(0)).cast("bigint")
    out = out.withColumn("base_failed", failed).withColumn("removed_words", removed)
    depleted = (F.col("n_words") - F.col("removed_words")).cast("double") < F.lit(float(min_share)) * F.col("n_words")
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).withColumnRenamed("id", "doc_id").drop("l_host", "l_id", "l_digest")


def query(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")


def filtered(docs: DataFrame, max_docs: int = MAX_DOCS, min_share: float = MIN_SHARE, least: int = LEAST_DOCS, share: float = SHARE) -> DataFrame:
    """The documents that pass, with their boilerplate lines removed and n_chars set anew; all their columns, in order."""
    with scratch() as keep:
        lost = removed_lines(docs, max_docs, least, share).groupBy("host", "doc_id", "digest").agg(F.sort_array(F.collect_set("line")).alias("gone"), F.sum("words").alias("lost"))
        lost = written(lost, "losses")
        keep(lost)
    text = F.coalesce(F.col("text"), F.lit(""))
    words = let(space_words(text), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), repeat_words(w).alias("r")))
    keyed = boxed(docs, host=host_of(docs), id=F.col("doc_id"), digest=F.xxhash64(text), w=words)
    # a text that fails by itself needs no join
    keyed = keyed.filter((F.col("w.n") >= 50) & (100 * F.col("w.r") <= 50 * F.col("w.n")))
    taken = lost.agg(F.coalesce(F.sum(F.size("gone")), F.lit(0)).alias("n")).first()["n"]
    out = lost_by(docs, keyed, F.broadcast(lost) if taken <= BROADCAST_ROWS else lost)
    rest = F.col("w.n") - F.coalesce(F.col("lost"), F.lit(0))
    out = out.filter(rest.cast("double") >= F.lit(float(min_share)) * F.col("w.n"))
    left = without_lines(F.col("row.text"), F.col("gone"))
    return unboxed(out, docs, text=left, n_chars=F.char_length(left))


ORACLE = r"""
WITH base AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l
  FROM documents),
texts AS (SELECT DISTINCT body, w FROM base),
hit AS (
  SELECT body, count(DISTINCT p) AS n_rep FROM (
    SELECT body, unnest([i, i + 1, i + 2]) AS p FROM (
      SELECT body, i, count(*) OVER (PARTITION BY body, t) AS times FROM (
        SELECT body, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t
        FROM (SELECT body, w, unnest(range(1, len(w) - 1)) AS i FROM texts)))
    WHERE times > 1)
  GROUP BY body),
held AS (
  SELECT host, line, doc_id, body, count(*) * any_value(len(string_split(line, ' '))) AS words FROM (
    SELECT doc_id, host, body,
           trim(regexp_replace(translate(lower(x), '123456789', '000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line
    FROM (SELECT doc_id, host, body, unnest(string_split(body, chr(10))) AS x
          FROM (SELECT DISTINCT host, doc_id, body FROM base)))
  WHERE line <> '' GROUP BY host, line, doc_id, body),
hosts AS (SELECT host, count(*) AS n FROM base GROUP BY host),
common AS (
  SELECT host, line, min(doc_id) AS first_doc FROM held JOIN hosts USING (host) GROUP BY host, line
  HAVING count(*) > greatest(2, least(50, CAST(0.1 AS DOUBLE) * any_value(n)))),
lost AS (
  SELECT host, doc_id, body, CAST(sum(words) AS BIGINT) AS removed
  FROM held JOIN common USING (host, line) WHERE doc_id <> first_doc GROUP BY host, doc_id, body),
counts AS (
  SELECT b.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(b.body, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(b.body) - length(regexp_replace(b.body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_rep, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(removed, 0) AS BIGINT) AS removed_words
  FROM base b LEFT JOIN hit ON b.body = hit.body LEFT JOIN lost ON b.host = lost.host AND b.doc_id = lost.doc_id AND b.body = lost.body)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, removed_words,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND NOT (CAST(n_words - removed_words AS DOUBLE) < 0.5 * n_words) AS kept
FROM counts
"""
