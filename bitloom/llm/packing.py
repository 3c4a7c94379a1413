"""Packing by shortest-pack-first over the histogram of lengths.

Documents become token ids, whole; a document longer than a sequence is cut into full sequences and a rest. Only the histogram
of piece lengths (at most `size` numbers) reaches the driver. There, lengths are placed longest first, each into the packs that
are filled least among those with room; packs of the same content are one pattern with a count, so the work depends on the
number of lengths, not of documents. At most 2 x size patterns arise, as a length over size / 2 opens one and a shorter one splits
at most one pattern and opens at most two, and a pattern holds fewer than sqrt(2 x size) distinct lengths: that bounds the table that is broadcast.

Where whole pieces leave more than FREE of the room, as lengths over half a sequence do, the packs that are filled least are given up
and their pieces are cut into the room of the others, at multiples of GRID tokens, until at most FREE is left, or what cutting there
cannot use. How a piece is cut depends on its length and rank alone, so this is a lookup as well. Each piece carries the checksum of
its ids up to every GRID tokens, from which those of its parts follow without the ids.

Pieces find their place by their rank among the pieces of their length. The rank is the number of pieces of that length in
earlier buckets plus the row number within the bucket. A length has as many buckets as its count asks for, so that a length that a
third of all pieces share is numbered by all tasks; pieces fall into them by a row number of their own, so that copies part too.
A rank is looked up among the slots of its length by binary search.

Defined results: null text is the empty text, whose only token is the end token; repeated rows are pieces of their own; a null
doc_id is kept; very long texts are encoded whole, in one task each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import os
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import converted, worker_state, written

SIZE = 2048
END = 1
END_BYTES = END.to_bytes(4, "little")
FREE, GRID = 0.01, 16
SPREAD = 4
CACHE = 150_000
CHUNK_ROWS, CHUNK_BYTES = 2048, 4_000_000
TAILS = string.punctuation.replace("'", "")
PIECE = "doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, row bigint, marks binary"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit integers.

    The tokenizer's normaliser and splitter never look across a blank or a line feed, so Arrow splits a chunk of texts there and numbers
    its distinct stretches, each is looked up once a chunk, and Arrow strings the ids together again by number. A stretch of letters with
    ASCII punctuation behind it has the ids of the letters and then those of the punctuation, so only these two are kept, in caches of
    bounded size; letters alone are one word of the tokenizer and end with a token that ends a word, so many of them are encoded as one
    string and told apart by those tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}  # letters in lower case
        self.older: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {"": b""}  # all else, punctuation among it

    def plain(self, strings: list[str], into: dict[str, bytes]) -> None:
        for s, e in zip(strings, self.tokenizer.encode_batch_fast(strings, add_special_tokens=False), strict=True):
            into[s] = np.array(e.ids, dtype="<u4").tobytes()

    def letters(self, strings: list[str], group: int = 256) -> None:
        groups = [strings[at : at + group] for at in range(0, len(strings), group)]
        for part, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part) or stops[-1] != len(ids):
                self.plain(part, self.words)
                continue
            data, at = ids.tobytes(), 0
            for s, stop in zip(part, (4 * stops).tolist(), strict=True):
                self.words[s] = data[at:stop]
                at = stop

    def learn(self, lows: set[str]) -> None:
        """The ids of these letters, those met before among them."""
        words, older, new = self.words, self.older, []
        for low in lows:
            if low in older:
                words[low] = older[low]
            else:
                new.append(low)
        self.letters(new)

    def looked_up(self, strings: list[str]) -> list[bytes]:
        if len(self.words) > CACHE:  # words that come again move back from the older generation
            self.words, self.older = {}, self.words
        if len(self.others) > CACHE:
            self.others = {"": b""}
        words, others = self.words, self.others
        bases = [w.rstrip(TAILS) for w in strings]
        lows = [b.lower() for b in bases]
        rest, new, unknown = [], {low for low in lows if low not in words}, set()
        odd = {low for low in new if not (low.isalpha() and (low.isascii() or max(low) < "\u0250"))}
        self.learn(new - odd)
        for low, base, w in zip(lows, bases, strings):
            rest.append(r := w if low in odd else w[len(base) :])
            if r not in others:
                unknown.add(r)
        self.plain(list(unknown), others)
        return [others[r] if low in odd else words[low] + others[r] if r else words[low] for low, r in zip(lows, rest)]

    def __call__(self, texts: pa.Array | list[str]) -> Iterator[bytes]:
        split = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " "), " ")
        numbered = split.flatten().dictionary_encode()
        ids = pa.array(self.looked_up(numbered.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(numbered.indices)
        _, starts, data = ids.buffers()
        starts, data = np.frombuffer(starts, np.int64, len(ids) + 1), memoryview(data or b"")
        stops = starts[split.offsets.to_numpy()].tolist()
        for start, stop in zip(stops, stops[1:]):
            yield bytes(data[start:stop])


def encoder(path: str) -> Encoder:
    """One encoder a Python worker: Spark gives a worker many tasks in turn, and words met in one come again in the next."""
    kept = worker_state("encoders")
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def marked(part: bytes) -> tuple[int, bytes]:
    """The checksum of a piece's ids, and those of its first GRID, 2 * GRID, ... ids, as unsigned 32-bit integers."""
    crc, marks = 0, array("I")
    for at in range(0, len(part), 4 * GRID):
        marks.append(crc := zlib.crc32(part[at : at + 4 * GRID], crc))
    return crc, marks[:-1].tobytes()


def crc_between(marks: np.ndarray, crc: int, length: int, start: int, stop: int) -> int:
    """The checksum of the ids from start (a multiple of GRID) to stop (another, or the end) of a piece that `marked` went over."""
    before = int(marks[start // GRID - 1]) if start else 0
    upto = crc if stop == length else int(marks[stop // GRID - 1])
    zeros = bytes(4 * (stop - start))  # both checksums go on over as many bytes; what these leave of the first is taken off
    return upto ^ zlib.crc32(zeros, before) ^ zlib.crc32(zeros)


def chunks(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) of texts that are encoded together: at most CHUNK_ROWS of at most CHUNK_BYTES, or one. Bounds what is held as Python
    objects."""
    ends, at = np.cumsum(lengths, dtype=np.int64), 0
    while at < len(ends):
        room = np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_BYTES, "right")
        yield at, (at := max(at + 1, min(at + CHUNK_ROWS, int(room))))


def pieces(docs: DataFrame, size: int = SIZE, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, row (a number of its own), marks and, if asked for, ids: the pieces of all documents."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row = encoder(path), itertools.count(TaskContext.get().partitionId() << 33)

        def made(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows: list = []
            texts = pc.fill_null(batch.column("text"), "")
            for at, stop in chunks(pc.binary_length(texts).to_numpy()):
                ids_of = batch.column("doc_id").slice(at, stop - at).to_pylist()
                for doc, data in zip(ids_of, encode(texts.slice(at, stop - at)), strict=True):
                    data += END_BYTES
                    n = len(data) // 4
                    for start in range(0, n, size):
                        part = data[4 * start : 4 * (start + size)]
                        crc, marks = marked(part)
                        rows.append((doc, start, len(part) // 4, crc, n, next(row), marks, *([np.frombuffer(part, "<u4").tolist()] if with_ids else [])))
            cols = list(zip(*rows, strict=True)) or [[] for _ in range(8 if with_ids else 7)]
            kinds = [batch.schema.field("doc_id").type, *[pa.int64()] * 5, pa.binary(), pa.list_(pa.int32())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row", "marks", "ids"]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=names[: len(cols)])

        yield from converted(batches, made, trim=True)

    schema = PIECE.format(kind=docs.schema["doc_id"].dataType.simpleString()) + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def packed(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Patterns: (how many packs, ((length, how many of it), ...)), each of at most `size` tokens."""
    by_fill: dict[int, dict[tuple, int]] = {}

    def put(fill, content, count):
        group = by_fill.setdefault(fill, {})
        group[content] = group.get(content, 0) + count

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        placed: list = []
        while left:
            fill = min((f for f in by_fill if f + length <= size), default=None)
            if fill is None:
                # no open pack has room: a new one takes pieces of this length while they fit, and only then the next is opened
                each = min(left, size // length)
                count, rest = divmod(left, each)
                placed.append((each * length, ((length, each),), count))
                if rest:
                    placed.append((rest * length, ((length, rest),), 1))
                left = 0
                continue
            group = by_fill[fill]
            for content in sorted(group):
                take = min(left, group[content])
                group[content] -= take
                left -= take
                more = dict(content)
                more[length] = more.get(length, 0) + 1
                placed.append((fill + length, tuple(sorted(more.items(), reverse=True)), take))
                if not left:
                    break
            for content in [c for c, n in group.items() if not n]:
                del group[content]
            if not group:
                del by_fill[fill]
            if left and placed and fill + length + length <= size:
                # packs filled in this round may take this length again once all others with room have one
                for f, c, n in placed:
                    put(f, c, n)
                placed = []
        for f, c, n in placed:
            put(f, c, n)
    return sorted((n, c) for group in by_fill.values() for c, n in group.items())


def given_up(patterns: list, size: int = SIZE, free: float = FREE, grid: int = GRID) -> tuple[list, dict[int, int]]:
    """The patterns that stay, and how many pieces of each length are to be cut into their room."""
    fills = {c: sum(n * times for n, times in c) for _, c in patterns}
    needs = {c: sum(-(-n // grid) * grid * times for n, times in c) for _, c in patterns}
    spare = {c: (size - fills[c]) // grid * grid for _, c in patterns}
    tokens, packs = sum(n * fills[c] for n, c in patterns), sum(n for n, _ in patterns)
    room, target = sum(n * spare[c] for n, c in patterns), -int(-tokens // (size * (1 - free)))
    stay, cut = [], {}
    for count, content in sorted(patterns, key=lambda p: (fills[p[1]], p)):
        less = max(0, min(count, packs - target, room // (needs[content] + spare[content])))
        packs -= less
        room -= less * (needs[content] + spare[content])
        for length, times in content if less else ():
            cut[length] = cut.get(length, 0) + less * times
        if count > less:
            stay.append((count - less, content))
    return sorted(stay), cut


def cuts(stay: list, cut: dict[int, int], size: int = SIZE, grid: int = GRID) -> list[tuple[int, int, list[tuple[int, int, int, int, int]]]]:
    """(length, first rank, parts): how the pieces of a length are cut from a rank on, each part (start in the piece, length, sequence of
    the first of these pieces, sequences from one piece to the next, offset). The widest room goes first."""
    ranks: dict[int, int] = {}
    wide: list[tuple[int, int, int, int]] = []  # usable room (negative), first sequence, sequences, filled
    sequence = 0

    def more(first, count, fill):
        if count and (size - fill) // grid:
            heapq.heappush(wide, (-((size - fill) // grid * grid), first, count, fill))

    for count, content in stay:
        for length, times in content:
            ranks[length] = ranks.get(length, 0) + count * times
        more(sequence, count, sum(n * times for n, times in content))
        sequence += count
    out = []
    for length in sorted(cut, reverse=True):
        rank, left = ranks.get(length, 0), cut[length]
        while left:
            use, first, count, fill = wide[0][0] * -1, *wide[0][1:]
            whole, rest = divmod(length - 1, use)  # full parts, and one of rest + 1
            many = min(left, count // (whole + 1))
            if many:
                heapq.heappop(wide)
                parts = [(k * use, use, first + k, whole, fill) for k in range(whole)]
                out.append((length, rank, [*parts, (whole * use, rest + 1, first + many * whole, 1, fill)]))
                more(first + many * whole, many, fill + rest + 1)
                more(first + many * (whole + 1), count - many * (whole + 1), fill)
            else:  # these sequences are too few for a piece: one goes on in those of less room
                many, at, parts = 1, 0, []
                while at < length:
                    use, first, count, fill = heapq.heappop(wide)
                    part = min(-use, length - at)
                    parts.append((at, part, first, 0, fill))
                    at += part
                    more(first, 1, fill + part)
                    more(first + 1, count - 1, fill)
                out.append((length, rank, parts))
            rank, left = rank + many, left - many
    return out


def slots(patterns: list) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, packs, of it in a pack, first sequence, offset): where the pieces of each length go, by rank."""
    ranks: dict[int, int] = {}
    out, sequence = [], 0
    for count, content in patterns:
        offset = 0
        for length, times in content:
            first = ranks.get(length, 0)
            out.append((length, first, count * times, times, sequence, offset))
            ranks[length] = first + count * times
            offset += length * times
        sequence += count
    return out


def ranked(table: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """With `rank`: 0, 1, ... among the pieces of one length."""
    spark = table.sparkSession
    each = max(1, -(-sum(histogram.values()) // (SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    number = F.broadcast(spark.createDataFrame([(n, -(-count // each)) for n, count in histogram.items()] or [(0, 1)], "length bigint, buckets bigint"))  # at most size rows
    keyed = table.join(number, "length").withColumn("bucket", F.pmod(F.xxhash64("row"), F.col("buckets"))).drop("buckets")
    # at most size + SPREAD x partitions rows
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = keyed.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("length", "bucket").orderBy("row")
    return keyed.withColumn("__n", F.row_number().over(within) - 1).join(F.broadcast(ahead), ["length", "bucket"]).withColumn("rank", F.col("ahead") + F.col("__n")).drop("bucket", "__n", "ahead")


def placed(rows: DataFrame, where: list[tuple[int, int, int, int, int, int]], parts: list[tuple[int, int, list]] = ()) -> DataFrame:
    """rows (with length and rank) with sequence_id and offset, for the slots `where`; those that `parts` names, cut."""
    slot = np.array(sorted([*((*w, -1) for w in where), *((n, rank, 0, 1, 0, 0, k) for k, (n, rank, _) in enumerate(parts))]) or [(0, 0, 0, 1, 0, 0, -1)], dtype=np.int64)
    length, first, _, times, sequence, base, cut = slot.T
    each = [np.array(p, dtype=np.int64).reshape(-1, 5) for _, _, p in parts]
    sent = rows.sparkSession.sparkContext.broadcast(((length << 48) + first, first, times, sequence, base, cut, each))
    kept = [c for c in rows.columns if c not in ("rank", "marks")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, times, sequence, base, cut, each = sent.value

        def whole(batch, at, nth, length):
            # times pieces of this length stand side by side in one pack
            extra = [pa.array(sequence[at] + nth // times[at]), pa.array(base[at] + nth % times[at] * length)]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *extra], names=[*kept, "sequence_id", "offset"])

        def in_parts(batch, at, nth, length):
            table = [each[k] for k in cut[at]]
            of = np.repeat(np.arange(len(at)), [len(t) for t in table])
            start, part, sequence, step, offset = np.concatenate(table).T
            marks, crc = [np.frombuffer(m, "<u4") for m in batch.column("marks").to_pylist()], batch.column("ids_crc32").to_pylist()
            spans = list(zip(of.tolist(), start.tolist(), (start + part).tolist(), strict=True))
            new = {"start": pa.array(batch.column("start").to_numpy()[of] + start), "length": pa.array(part)}
            new["ids_crc32"] = pa.array([crc_between(marks[i], crc[i], int(length[i]), a, b) for i, a, b in spans], pa.int64())
            if "ids" in kept:
                ids = batch.column("ids").to_pylist()
                new["ids"] = pa.array([ids[i][a:b] for i, a, b in spans], batch.schema.field("ids").type)
            cols = [new[c] if c in new else batch.column(c).take(pa.array(of)) for c in kept]
            return pa.RecordBatch.from_arrays([*cols, pa.array(sequence + nth[of] * step), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 48) + rank, "right") - 1
            nth = rank - first[at]
            for make, these in ((whole, np.flatnonzero(cut[at] < 0)), (in_parts, np.flatnonzero(cut[at] >= 0))):
                for i in range(0, len(these), 1024):
                    some = these[i : i + 1024]
                    yield make(batch.take(pa.array(some)), at[some], nth[some], length[some])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept]
    return rows.mapInArrow(run, ", ".join([*kinds, "sequence_id bigint", "offset bigint"]))


def assigned(table: DataFrame, size: int = SIZE) -> DataFrame:
    """The pieces with sequence_id and offset."""
    histogram = {r["length"]: r["count"] for r in table.groupBy("length").count().collect()}  # at most size rows
    stay, cut = given_up(packed(histogram, size), size)
    table = table if cut else table.drop("marks")
    return placed(ranked(table, histogram), slots(stay), cuts(stay, cut, size)).drop("row")


def pack(docs: DataFrame, size: int = SIZE, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """All pieces of all documents with their places; with_ids adds the token ids of each piece."""
    return assigned(written(pieces(docs, size, path, with_ids), "pieces"), size)


def query(docs: DataFrame) -> DataFrame:
    return pack(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
