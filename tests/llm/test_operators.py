import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bitloom.llm import chat_expansion, decontamination, license_scan, packing, pii, ppm, quality_rules, simhash, toxicity, url_rules

from . import brute

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PROSE = "the quick brown fox jumps over a lazy dog while seven wizards brew strong coffee near old stone bridges and quiet rivers".split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(PROSE) + str(r.randrange(900)) for _ in range(n))


def table(spark, rows, extra=True):
    """Documents with a host; extra columns have names that operators use inside."""
    df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOC)
    return df.selectExpr("*", "1 AS digest", "'x' AS host", "2 AS `row`", "3 AS rank", "4 AS fp", "5 AS id", "6 AS `a.b`") if extra else df


@pytest.fixture(scope="module")
def rows():
    item = prose(30, "item")
    texts = [
        None, "", " \n\t ", "one", "Same line here\nSame line here\nother", prose(80, 1), prose(80, 1), prose(80, 1).replace("fox", "cat", 1), "a " * 3000, "word" * 9000,
        prose(60, 2) + "\n" + item + " tail", "x " + " ".join(item.split()[3:14]).upper(), " ".join(item.split()[3:12]),
        "mail a@b.c_x@d.e +1 (017) 555-7713 at 1.2.3.4.5.6.7.8 or 999.1.1.1 card 4111 1111-1111 1111 😀 é x@y.zz token = 0123456789abcdef0123456789abcdef01234567",
        "MIT License and Apache License. GNU General Public License mit license\n// SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND Apache-2.0 */ rest",
        "It's ÉTÉ; don't STOP *** 12ab " * 12, prose(3000, 3),
    ]
    out = [(k, t, f"s{k % 2}") for k, t in enumerate(texts)]
    return [*out, out[5], (None, "no id here " + prose(70, 4), None), (None, None, "s0")], [(1, item), (2, None), (3, "short item here"), (1, item), (None, prose(12, "other"))]


def test_quality_counts(spark, rows):
    got = Counter(tuple(r)[:7] for r in quality_rules.query(table(spark, rows[0])).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    assert got == Counter((i, *brute.base_quality(t)) for i, t, _ in rows[0])


@pytest.mark.parametrize("bound", [0, 200_000])
def test_quality_lines(spark, bound, monkeypatch):
    monkeypatch.setattr(quality_rules, "BROADCAST_ROWS", bound)
    common = prose(40, "line")
    texts = [(k, f"{prose(60, k)}\n{common}", "s") for k in range(12)] + [(k, f"{common}\n{prose(12, k)}", "s") for k in range(20, 24)]
    texts += [(50 + k, texts[3][1], "s") for k in range(30)] + [(99, f"{common}\n{prose(12, 99)}", "alone")]
    rule = {"max_docs": 8, "least": 8}
    got = {r["doc_id"]: r for r in quality_rules.judge(table(spark, texts), **rule).collect()}
    assert len(got) == len(texts)
    assert not any(got[k]["kept"] for k in range(20, 24)) and got[99]["kept"]  # depleted; the other host has it once
    assert all(got[k]["kept"] for k in range(12)) and got[0]["removed_words"] == 0 and got[1]["removed_words"] == 40
    assert not any(got[50 + k]["kept"] for k in range(30))  # copies of 3, which keeps its own line but not the common one
    kept = {r["doc_id"]: r for r in quality_rules.filtered(table(spark, texts), **rule).collect()}
    assert set(kept) == {k for k, r in got.items() if r["kept"]}
    assert kept[1]["text"] == prose(60, 1) and kept[1]["n_chars"] == len(kept[1]["text"]) and kept[0]["text"] == texts[0][1] and kept[1]["a.b"] == 6


@pytest.mark.parametrize("n", [16, 17, 700])
def test_quality_many_lines_go(spark, n):
    """Lines up to, just above and far above what is looked at one by one; repeated, with other case and digits."""
    line = lambda k: f"Notice {chr(97 + k % 26) * (k // 26 + 1)} of page {k % 9 + 1}"
    shared = "\n".join(line(k) for k in range(n))
    texts = [(0, shared, "s")] + [(k, f"{shared.upper()}\n{prose(9 * n, k)}\n  {line(k)}\n\n", "s") for k in range(1, 4)] + [(9, prose(60, 9), "s")]
    got = {r["doc_id"]: r["text"] for r in quality_rules.filtered(table(spark, texts)).collect()}
    assert got[9] == texts[-1][1] and [got[k] for k in (1, 2, 3)] == [f"{prose(9 * n, k)}\n\n" for k in (1, 2, 3)]
    assert [r["removed_words"] for r in quality_rules.query(table(spark, texts)).orderBy("doc_id").collect()][1:4] == [5 * (n + 1)] * 3


def quality_brute(rows, max_docs=50, least=2, share=0.1, min_share=0.5):
    """doc_id -> (removed words, kept), for distinct doc_ids and plain lines."""
    held, sizes, out = defaultdict(list), Counter(s for _, _, s in rows), {}
    for i, t, s in rows:
        for line in {x.strip().lower() for x in t.split("\n")} - {""}:
            held[s, line].append(i)
    for i, t, s in rows:
        gone = 0
        for line in [x.strip().lower() for x in t.split("\n")]:
            docs = held.get((s, line), ())
            if len(docs) > max(least, min(max_docs, share * sizes[s])) and i != min(docs):
                gone += len(line.split())
        n = len(t.split())
        out[i] = (gone, not brute.base_quality(t)[-1] and n - gone >= min_share * n)
    return out


def test_quality_limits_follow_the_host(spark):
    """Hosts of 10, 100 and 700 pages: a line goes from 3, 11 and 51 documents on; exact copies are documents of their own."""
    word = lambda *key: " ".join("".join(chr(97 + b % 26) for b in hashlib.sha256(f"{key}{k}".encode()).digest()[:7]) for k in range(60))
    rows, at = [], 0
    for host, size in (("a", 10), ("b", 100), ("c", 700)):
        for k in range(size):
            lines = [word(host, k)] + [f"seen in {chr(97 + n % 26) * (n // 26 + 1)} of them" for n in (2, 3, 10, 11, 50, 51) if k < n] + (["all copies of one page"] if k % 7 == 1 else [])
            rows.append((at, "\n".join(lines if k % 7 != 1 else [word(host, "copy"), lines[-1]]), host))
            at += 1
    got = {r["doc_id"]: (r["removed_words"], r["kept"]) for r in quality_rules.query(table(spark, rows)).collect()}
    assert got == quality_brute(rows) and sum(not k for _, k in got.values()) == 14 + 99


def test_quality_sql_removes_lines(spark):
    """The query against its SQL on a table where lines do go: 60 texts of one host share a line, 10 of them hold little else."""
    common = prose(40, "line")
    texts = [(k, f"{prose(60 if k < 50 else 12, k)}\n{common}", "s") for k in range(60)] + [(100 + k, f"{common}\n{prose(60, k)}", "t") for k in range(50)]
    texts += [(200 + k, f"{prose(60, k)}\nsmall host, three of them\nin all", "u") for k in range(3)] + [(300 + k, texts[60][1], "t") for k in range(4)] + [texts[3]]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", texts)
    df = quality_rules.query(table(spark, texts))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({quality_rules.ORACLE})").fetchall()
    got = df.collect()
    assert Counter(map(tuple, got)) == Counter(want)
    assert sum(r["removed_words"] for r in got if r["doc_id"] < 100) == 60 * 40 and {r["doc_id"] for r in got if r["doc_id"] < 100 and not r["kept"]} == set(range(50, 60))


def test_packing(spark, rows):
    got = packing.pack(table(spark, rows[0]), with_ids=True).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for i, text, _ in rows[0]:
        want[i, tuple(t.encode(text or "", add_special_tokens=False).ids + [1])] += 1
    pieces = defaultdict(list)
    for p in got:
        pieces[p["doc_id"], p["doc_tokens"]].append(p)
        assert zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"] and p["length"] == len(p["ids"]) <= 2048
    for (i, ids), n in want.items():  # other texts of one doc_id and as many tokens may stand among them
        counts = Counter(s + k for p in pieces[i, len(ids)] for s, part in [(p["start"], p["ids"])] for k, token in enumerate(part) if ids[s + k] == token)
        assert all(counts[k] >= n for k in range(len(ids)))
    assert sum(p["length"] for p in got) == sum(len(ids) * n for (_, ids), n in want.items())
    places = defaultdict(list)
    for p in got:
        places[p["sequence_id"]].append((p["offset"], p["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048


@pytest.mark.parametrize("seed", range(4))
def test_packed_patterns(seed):
    r = random.Random(seed)
    h = {r.randrange(1, 2049): r.randrange(1, 5000) for _ in range(r.choice([1, 5, 300]))}
    patterns, used = packing.packed(h), Counter()
    for count, content in patterns:
        assert sum(length * n for length, n in content) <= 2048
        for length, n in content:
            used[length] += count * n
    assert used == Counter(h) and len(patterns) <= 2 * 2048
    assert packing.packed({}) == []


HISTOGRAMS = [{1025: 1000}, {1100: 1000}, {1030: 500, 1020: 300, 400: 5}, {683: 300}, {1365: 900}, {700: 9000}, {1400: 1000, 700: 200}]


def sequences(h):
    """Fills of all sequences of a histogram, after checking that each piece is placed once and each part where the one before ends."""
    stay, cut = packing.given_up(packing.packed(h))
    held, used, at = defaultdict(list), Counter(), 0
    for count, content in stay:
        for k in range(count):
            held[at + k] = [(0, sum(n * times for n, times in content))]
        for n, times in content:
            used[n] += count * times
        at += count
    runs = sorted(packing.cuts(stay, cut))
    for (n, rank, parts), after in zip(runs, [*runs, (0, 0, [])][1:], strict=True):
        pieces = (after[1] if after[0] == n else h[n]) - rank
        assert rank == used[n] and [p[0] for p in parts] == [0, *np.cumsum([p[1] for p in parts])[:-1]] and sum(p[1] for p in parts) == n
        assert all(p[0] % packing.GRID == 0 for p in parts)
        used[n] += pieces
        for d in range(pieces):
            for _, part, first, step, offset in parts:
                held[first + d * step].append((offset, part))
    assert used == Counter(h)
    for spans in held.values():
        spans.sort()
        ends = np.cumsum([n for _, n in spans])
        assert [o for o, _ in spans] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert sum(n for spans in held.values() for _, n in spans) == sum(n * times for n, times in h.items())
    return len(held)


def test_packed_padding():
    """Pieces of one length share sequences, alone and as a third of all pieces; what doesn't fit together is cut."""
    assert sequences({100: 3000}) == 148 and sequences({1025: 7}) == 4 and sequences({100: 41}) == 3 and sequences({2048: 5}) == 5 and sequences({1025: 1}) == 1 and sequences({}) == 0
    r = random.Random(1)
    h = Counter(min(2048, max(1, int(r.lognormvariate(6.5, 0.7)))) for _ in range(4000))
    mixed = [{**h, length: h[length] + 2000} for length in (20, 90, 300, 900)]
    for m in [*HISTOGRAMS, *mixed, {n: 200 for n in range(1025, 2049)}, {n: r.randrange(1, 3000) for n in r.sample(range(1, 2049), 40)}]:
        assert sum(a * n for a, n in m.items()) >= 0.98 * 2048 * sequences(m)
    assert packing.given_up(packing.packed(h)) == (sorted(packing.packed(h)), {})  # hardly anything free: nothing is cut


@pytest.mark.parametrize("shape", ["one", "two", "cut", "many"])
def test_packed_sequences(spark, shape):
    """Places of pieces of one, two and many lengths, repeated rows among them: gapless, each sequence once, little padding, each id
    in one part, with the checksum of its ids."""
    r = random.Random(4)
    many = [min(2048, max(1, int(r.lognormvariate(5, 1)))) for _ in range(3000)] + [64] * 1500
    lengths = {"one": [700] * 900, "two": [1000] * 400 + [300] * 600, "cut": [1025] * 200 + [1900] * 30 + [1] * 3, "many": many}[shape]
    rows = []
    for k, n in enumerate(lengths):
        ids = np.arange(k * 4096, k * 4096 + n, dtype="<u4")
        rows.append((k % 7, 0, n, *packing.marked(ids.tobytes()), n, k, ids.tolist()))
    table = spark.createDataFrame(rows, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, marks binary, doc_tokens bigint, row bigint, ids array<int>")
    held, of = defaultdict(list), defaultdict(list)
    for p in packing.assigned(table.repartition(5)).collect():
        assert len(p["ids"]) == p["length"] and zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"]
        held[p["sequence_id"]].append((p["offset"], p["length"]))
        of[p["ids"][0] // 4096].append((p["start"], p["ids"], p["doc_tokens"]))
    for k, n in enumerate(lengths):
        parts = sorted(of.pop(k))
        assert [i for _, ids, _ in parts for i in ids] == list(range(k * 4096, k * 4096 + n)) and all(s == ids[0] % 4096 and t == n for s, ids, t in parts)
    assert not of
    for v in held.values():
        ends = np.cumsum([n for _, n in sorted(v)])
        assert [o for o, _ in sorted(v)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert set(held) == set(range(len(held))) and len(held) <= -(-sum(lengths) // 2048) * 1.02 + 1


def test_encoder_on_all_texts():
    """The ids of every text of a whole table against the tokenizer's own."""
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()]
    t = Tokenizer.from_file(packing.tokenizer_path())
    for text, got in zip(texts, packing.Encoder(packing.tokenizer_path())(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_encoder_keeps_bases(monkeypatch):
    """A stretch is looked up by its letters and its punctuation, each kept once, and ids stay right when the caches turn over."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    encode = packing.Encoder(packing.tokenizer_path())
    texts = ["Fox fox, FOX!!\nfox", "", "  ", "don't 12ab É été, \u212aelvin İx ... fo\u00adx, a\tb x\x00y fox1, FOX1,", ",", "😀 naïve. ﬁne e\u0301t, ŉ Ǆ", "\n\nfox\n"]
    for bound in (150_000, 3):
        monkeypatch.setattr(packing, "CACHE", bound)
        for part in (texts, texts[:1], texts[3:], []):
            for text, got in zip(part, encode(part), strict=True):
                assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    fresh = packing.Encoder(packing.tokenizer_path())
    list(fresh(["Fox fox, FOX!! fox"]))
    assert set(fresh.words) == {"fox"} and set(fresh.others) == {"", ",", "!!"}


def test_chunks(monkeypatch):
    monkeypatch.setattr(packing, "CHUNK_ROWS", 3)
    monkeypatch.setattr(packing, "CHUNK_BYTES", 10)
    assert list(packing.chunks(np.array([1, 1, 1, 1, 9, 2, 50, 0, 10, 10]))) == [(0, 3), (3, 5), (5, 6), (6, 7), (7, 9), (9, 10)]
    assert list(packing.chunks(np.array([], dtype=np.int32))) == []


def test_chat(spark):
    said = "\\### Assistant: </turn> ok"
    turns = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 2, "user", "é😀 <b>\\b\\l"), (2, 0, "assistant", None), (2, 1, "assistant", "\\bx"), (None, 0, None, "#"), (3, None, "a:b\n#", ""), (3, 5, "assistant", "x"), (3, 5, "assistant", "x")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").withColumn("parts", F.lit(1))
    got = {r["conv_id"]: r for r in chat_expansion.query(df).collect()}
    for c in {t[0] for t in turns}:
        own = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == c))
        loss = "".join(t for _, _, r, t in own if r == "assistant")
        assert got[c]["turns_sha256"] == brute.sha("".join(f"{r}\n{t}\n" for _, _, r, t in own)) and got[c]["n_turns"] == len(own)
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), brute.sha(loss))
    assert chat_expansion.query(df.limit(0)).count() == 0
    # every reply is an example of its own, its text stands under the mask, and all turns before it are its context
    code = lambda t: t.replace("\\", "\\b").replace("<", "\\l").replace("#", "\\h")
    for block in (1, 90, chat_expansion.BLOCK):
        examples = defaultdict(list)
        for r in chat_expansion.expand(df, block).orderBy("example").collect():
            examples[r["conv_id"]].append(r)
        for c in {t[0] for t in turns}:
            own = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == c))
            pieces = [f"### {code(r).replace(':', chr(92) + 'c')}: {code(t)}</turn>\n" for _, _, r, t in own]
            ends = [k for k, (_, _, r, _) in enumerate(own) if r == "assistant" or k == len(own) - 1]
            assert [r["text"] for r in examples[c]] == ["".join(pieces[: k + 1]) for k in ends] and [r["example"] for r in examples[c]] == list(range(len(ends)))
            assert [r["text"][r["loss_start"] :][: r["loss_chars"]] for r in examples[c]] == [code(own[k][3]) if own[k][2] == "assistant" else "" for k in ends]
            assert got[c]["formatted_chars"] == sum(len(r["text"]) for r in examples[c]) and [r["last"] for r in examples[c]] == [k == ends[-1] for k in ends]
        assert {r["conv_id"]: r for r in chat_expansion.query(df, block).collect()} == got


def test_chat_long(spark):
    """Many turns and very long texts, in blocks of one task each and in one."""
    turns = spark.range(600).selectExpr("1L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('said ', id, '<é', repeat('x', IF(id = 301, 200000, 3))) AS text")
    a, b = (chat_expansion.query(turns, n).collect() for n in (2_000_000, 10**12))
    assert a == b and a[0]["n_turns"] == 600 and a[0]["loss_chars"] == sum(len(f"said {k}<é") + (200_000 if k == 301 else 3) for k in range(1, 600, 2))


def test_simhash(spark, rows):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in simhash.query(table(spark, rows[0])).collect())
    prints = [(i, brute.fingerprint(t)) for i, t, _ in rows[0]]
    want = sorted((i is None, i or 0, f"{f:016x}", c) for (i, f), c in zip(prints, brute.components(prints)))
    assert got == want


@pytest.mark.parametrize("tile", [4, 8192])
def test_links_are_complete(spark, tile):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base[:12]:  # chains and dense groups
        for _ in range(30):
            b ^= (1 << r.randrange(64)) | (1 << r.randrange(64))
            fps.add(b)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(simhash.banded(spark.createDataFrame([(f,) for f in signed], "fp bigint")), tile=tile)
    got = {r["fp"]: r["root"] for r in simhash.components(edges, hub=3 if tile == 4 else simhash.HUB).collect()}
    want = brute.components([(s, s & ((1 << 64) - 1)) for s in signed])
    assert [got.get(s, s) for s in signed] == want


def test_components_send_no_empty_table(spark, monkeypatch):
    """A step broadcasts hot nodes only where there are some, and chains, stars and pairs come to their least node."""
    calls, broadcast = [], simhash.F.broadcast
    monkeypatch.setattr(simhash.F, "broadcast", lambda df: (calls.append(1), broadcast(df))[1])
    edges = [(k, k + 1) for k in range(1, 40)] + [(100 + k, 100) for k in range(1, 12)] + [(-7, 200), (200, -7), (300, 300)]
    table = spark.createDataFrame(edges, "a bigint, b bigint")
    want = {k: 1 for k in range(2, 41)} | {100 + k: 100 for k in range(1, 12)} | {200: -7}
    assert {r["fp"]: r["root"] for r in simhash.components(table).collect()} == want and not calls
    assert {r["fp"]: r["root"] for r in simhash.components(table, hub=5).collect()} == want and calls
    assert simhash.components(table.filter("a = b")).count() == 0


@pytest.mark.parametrize("chunk, small", [(2, 1), (5, 1), (16, 8), (256, 64)])
def test_tiles(chunk, small, monkeypatch):
    """Many tiles a block, with pairs of tiles that are skipped: the links' components are those of all pairs of a block."""
    monkeypatch.setattr(simhash, "SMALL", small)
    r = random.Random(chunk)
    block, fps = [], []
    for k in range(12):
        base = [r.getrandbits(64) & r.getrandbits(64) if n % 3 else r.getrandbits(64) | r.getrandbits(64) for n in range(r.randrange(1, 30))]
        near = {b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base for _ in range(3)}
        members = sorted({*base, *near})
        block += [k] * len(members)
        fps += members
    a, b = simhash.linked_in_blocks(np.array(block), np.array(fps, np.uint64), chunk=chunk)
    for k in range(12):
        members = [f for f, x in zip(fps, block) if x == k]
        want = brute.components(list(zip(members, members)))
        edges = [(int(x), int(y)) for x, y in zip(a, b) if int(x) in members and int(y) in members]
        root = {m: m for m in members}

        def up(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in edges:
            assert (x ^ y).bit_count() <= 64 and x != y
            root[max(up(x), up(y))] = min(up(x), up(y))
        assert [up(m) for m in members] == want


def test_deduplicated(spark, rows):
    """Against all pairs: within the radius, or near with a part of their sketches in common and signatures that agree."""
    kept = simhash.deduplicated(table(spark, rows[0]))
    assert kept.columns == table(spark, rows[0]).columns
    made = [(i, brute.fingerprint(t), *simhash.sketch(simhash.shingle_hashes((t or "").encode()))) for i, t, _ in rows[0]]

    def alike(x, y):
        pairs = [(a, b) for a, b in zip(x[3], y[3]) if a or b]
        return set(x[2]) & set(y[2]) and sum(a == b for a, b in pairs) >= simhash.SIMILAR * len(pairs)

    want, seen = [], set()
    for at in range(len(made)):
        group, todo = {at}, [at]
        while todo:
            x = todo.pop()
            for y in range(len(made)):
                d = (made[x][1] ^ made[y][1]).bit_count()
                if y not in group and (d <= simhash.RADIUS or d <= simhash.NEAR and alike(made[x], made[y])):
                    group.add(y)
                    todo.append(y)
        if at not in seen:
            want.append(min((made[k][0] is None, made[k][0] or 0) for k in group))
        seen |= group
    got = [(r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()]
    assert sorted(got) == sorted(want) and (False, 7) not in got


def test_near_copies(spark):
    """Copies of similarity 0.8 and more on shingles of five words go, others stay; repeated rows stay once, two texts of one id apart."""
    shingles = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    r, rows, close = random.Random(6), [], 0
    for k in range(150):
        words = prose(r.randrange(60, 400), f"near{k}").split()
        rows.append((2 * k, " ".join(words), "s"))
        for at in r.sample(range(len(words)), max(1, len(words) // 60)):
            words[at] = f"other{at}"
        a, b = shingles(rows[-1][1]), shingles(" ".join(words))
        if len(a & b) >= 0.8 * len(a | b):
            rows.append((2 * k + 1, " ".join(words), "s"))
            close += 1
    rows += [rows[0], (0, prose(80, "another text of id 0"), "s"), (None, rows[5][1], "s"), (None, prose(70, "no id"), "s")]
    left = Counter((x["doc_id"], x["text"]) for x in simhash.deduplicated(table(spark, rows)).collect())
    assert close > 100 and max(left.values()) == 1
    assert sum(i is not None and i % 2 for i, _ in left) <= 0.1 * close
    assert {(i, t) for i, t in left if i is None or i % 2 == 0} == {(i, t) for i, t, _ in rows if i is None and t != rows[5][1] or i is not None and i % 2 == 0}


def test_common_openings():
    """Texts with a common opening hardly share blocks, copies of similarity 0.8 nearly always do, whatever their length."""
    r = random.Random(8)
    words = lambda n: [str(r.randrange(10**9)) for _ in range(n)]
    made = lambda w: simhash.sketch(simhash.shingle_hashes(" ".join(w).encode()))
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    opening = words(40)
    held = Counter(k for _ in range(2000) for k in made(opening + words(100))[0])
    assert max(held.values()) <= 40
    for n in (60, 160, 600):
        found = 0
        for _ in range(150):
            w = opening + words(n)
            v = list(w)
            while True:
                u = list(v)
                u[r.randrange(len(u))] = "other"
                a, b = shingles(w), shingles(u)
                if len(a & b) < 0.8 * len(a | b):
                    break
                v = u
            (a, s), (b, t) = made(w), made(v)
            pairs = [(x, y) for x, y in zip(s, t, strict=True) if x or y]
            d = (simhash.fingerprint(" ".join(w).encode()) ^ simhash.fingerprint(" ".join(v).encode())).bit_count()
            found += bool(set(a) & set(b)) and sum(x == y for x, y in pairs) >= simhash.SIMILAR * len(pairs) and d <= simhash.NEAR
        assert found >= 0.9 * 150
    assert simhash.sketch(np.zeros(0, np.uint64)) == ([], bytes(simhash.SIGNED)) and len(made(["a"])[0]) == 1


def test_linked_tiles_are_skipped(monkeypatch):
    """Once all rows of a group of near copies are in one component, no more of its tiles are compared."""
    r = random.Random(9)
    base = r.getrandbits(64)
    fps = np.array(sorted({base ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(1500)}), np.uint64)
    compared = []
    union = simhash.union
    monkeypatch.setattr(simhash, "union", lambda labels, a, b: (compared.append(len(a)), union(labels, a, b)))
    a, b = simhash.linked_in_blocks(np.zeros(len(fps), np.int64), fps, radius=4, chunk=64)
    assert len(a) == len(fps) - 1 and len(compared) <= 4 * (len(fps) // 64 + 1)


def test_licences(spark, rows):
    import re

    for r in license_scan.scan(table(spark, rows[0])).filter("doc_id IS NOT NULL").distinct().collect():
        words = re.findall(brute.ALNUM, brute.lower(rows[0][r["doc_id"]][1]))
        places = sorted((i, label) for p, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    assert "spdx:apache-2.0" in license_scan.scan(table(spark, rows[0])).filter("doc_id = 14").first()["labels"]


def test_expressions():
    def of(text):
        found, read = license_scan.evaluated(text)
        return max(found.values(), default=None), sorted(found), read

    assert of("mit or gpl-3.0-only") == (1, ["mit"], True) and of("mit and gpl-3.0-only") == (3, ["gpl-3.0-only", "mit"], True)
    assert of("gpl-3.0-only with classpath-exception-2.0") == (2, ["gpl-3.0-only"], True) and of("mit or apache-2.0") == (1, ["mit"], True)
    assert of("mit or apache-2.0 and agpl-3.0")[:2] == (1, ["mit"]) and of("(mit or apache-2.0) and agpl-3.0")[:2] == (4, ["agpl-3.0", "mit"])
    assert of("mit or") == (1, ["mit"], False) and of("unknown-1.0") == (None, [], True) and of("") == (None, [], False) and of(") mit (")[0] == 1
    assert of("unknown-1.0 or gpl-2.0-only")[:2] == (3, ["gpl-2.0-only"]) and len(license_scan.IDS) < 200


def test_licence_labels():
    """The method's own labels, its score, overlapping phrases, and what ends an expression."""
    import time

    def of(text):
        r = license_scan.scanned(text.encode(), *license_scan.automata())
        return r["base_labels"], r["labels"], round(r["score"], 6), r["restriction"]

    tag = "// SPDX-License-Identifier: "
    assert of(tag + "MIT OR GPL-3.0-only") == ("", "spdx:mit,terms:notice", 0.6, 1)
    assert of(tag + "MIT AND GPL-3.0-only") == ("", "spdx:gpl-3.0-only,spdx:mit,terms:copyleft", round(1 - 0.4 * 0.2, 6), 3)
    assert of(tag + "MIT OR") == ("", "spdx:mit,terms:notice", 0.5, 1) and of(tag + "nothing known") == ("", "", 0.0, None)
    assert of("GNU Lesser General Public License, version 3") == ("gpl", "gpl,lgpl", 0.84, None)
    assert of("The MIT License. All rights reserved.")[:3] == ("mit", "mit,proprietary", 0.84)
    assert of(f"/* {tag}MIT */ gpl-2.0\n<!-- {tag}ISC --> agpl-3.0 {tag}Zlib {tag}0BSD")[1] == "spdx:0bsd,spdx:isc,spdx:mit,spdx:zlib,terms:notice"
    r = license_scan.scanned(b"mit license apache license mit license general public license", *license_scan.automata())
    assert (r["n_base"], r["first_word"], r["last_word"], r["n_words"]) == (4, 0, 6, 9)
    assert license_scan.scanned(None, *license_scan.automata())["score"] == 0.0
    took = []
    for n in (5_000, 40_000):  # tags in one line: in proportion to their number
        began = time.time()
        assert license_scan.scanned((f"{tag}MIT " * n).encode(), *license_scan.automata())["labels"] == "spdx:mit,terms:notice"
        took.append(time.time() - began)
    assert took[1] < 30 * took[0] + 1


@pytest.mark.parametrize("bound", [0, 300_000])
def test_decontamination(spark, rows, bound, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", bound)
    items = spark.createDataFrame(rows[1], "item_id bigint, text string")
    got = Counter(map(tuple, decontamination.judge(table(spark, rows[0]), items).collect()))
    assert got == Counter(brute.contamination([(i, t) for i, t, _ in rows[0]], rows[1]))
    bad = {(i, t) for (i, t, _), r in zip(rows[0], brute.contamination([(i, t) for i, t, _ in rows[0]], rows[1])) if r[-1]}
    left = decontamination.filtered(table(spark, rows[0]), items)
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter((i, t) for i, t, _ in rows[0] if (i, t) not in bad)


def test_shared_spans_are_found(spark):
    """Any ten shared words, in whatever surroundings and with whatever repeats."""
    r = random.Random(9)
    words = [f"w{k}" for k in range(6)]
    docs = [(k, " ".join(r.choice(words) for _ in range(r.randrange(5, 400)))) for k in range(25)]
    items = [(k, " ".join(r.choice(words) for _ in range(r.randrange(1, 40)))) for k in range(12)]
    got = Counter(map(tuple, decontamination.judge(table(spark, [(i, t, "s") for i, t in docs]), spark.createDataFrame(items, "item_id bigint, text string")).collect()))
    assert got == Counter(brute.contamination(docs, items))


def test_texts_are_winnowed_once(spark):
    """No filter computes the grams of a text beforehand, and no regular expression goes over it."""
    items = spark.createDataFrame([(1, prose(30, "item")), (2, "short item")], "item_id bigint, text string")
    plan = decontamination.judge(table(spark, [(k, prose(50, k), "s") for k in range(3)]), items)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" in plan and "regexp" not in plan and "\\x00" not in plan
    assert not [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter") and "lambda" in line]


def test_kept_grams(spark):
    """The rightmost of the least grams of every window, and no others; one text of many words."""
    r = random.Random(3)
    texts = [" ".join(r.choice(["a", "b", "c", "d"]) for _ in range(n)) for n in (0, 1, 4, 5, 9, 10, 11, 16, 300)]
    h = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", decontamination.word_hashes(F.col("text")).alias("h"))
    got, h = defaultdict(set), h.localCheckpoint()
    for row in decontamination.kept(h).collect():
        got[row["id"]].add(row["at"])
        assert row["gram"] in range(-(2**32), 2**32)
    for row in h.collect():
        n = len(row["h"])
        value = {tuple(row["h"][i : i + 5]): None for i in range(n - 4)}
        one = spark.createDataFrame([(list(g),) for g in value] or [([0] * 5,)], "g array<bigint>")
        w = [F.col("g")[k] for k in range(5)]
        for x in one.select("g", (F.shiftright(F.xxhash64(F.xxhash64(F.xxhash64(w[0], w[1]), F.xxhash64(w[2], w[3])), w[4]), 31)).alias("v")).collect():
            value[tuple(x["g"])] = x["v"]
        grams = [value[tuple(row["h"][i : i + 5])] for i in range(n - 4)]
        want = {min(range(i, i + 6), key=lambda p: (grams[p], -p)) for i in range(n - 9)}
        assert got[row["id"]] == want
    long = prose(100_000, "long") + " " + prose(30, "item") + " " + prose(100_000, "tail")
    out = decontamination.judge(table(spark, [(1, long, "s")]), spark.createDataFrame([(7, prose(30, "item"))], "item_id bigint, text string")).collect()
    assert [(x["n_words"], x["n_hit"], x["n_items"]) for x in out] == [(200_030, 30, 1)]


def test_pii(spark, rows):
    texts = {i: t for i, t, _ in rows[0] if i is not None}
    for r in pii.judge(table(spark, rows[0])).filter("doc_id IS NOT NULL").collect():
        base = brute.base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == brute.sha(base)
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x.startswith(f"{k}:") for x in base.split(",")) for k in pii.BASE]
    out = {r["doc_id"]: r for r in pii.redacted(table(spark, rows[0])).collect()}
    assert Counter(r["doc_id"] for r in pii.redacted(table(spark, rows[0])).collect()) == Counter(i for i, _, _ in rows[0])
    assert "<EMAIL>" in out[13]["text"] and "4111" not in out[13]["text"] and out[13]["n_chars"] == len(out[13]["text"]) and out[5]["text"] == texts[5]


def pii_texts():
    """Texts with one span of an added kind each, where it stands, and texts with what only looks like it."""
    r, good, bad = random.Random(7), [], []
    digits = lambda n: "".join(str(r.randrange(10)) for _ in range(n))

    def iban(country="DE", n=18):
        body = digits(n)
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        return f"{country}{check:02d}{body}"

    for k in range(40):
        key = "".join(r.choice("0123456789abcdef") for _ in range(40))
        for before, kind, span in (
            ("the api key is ", "secret", key), ("our token: ", "secret", "ghp_" + key[:36]), ("social security number ", "ssn", f"{r.randrange(100, 600)}-{digits(2)}-{digits(4)}"), ("pay to iban ", "iban", iban()),
            ("hardware address ", "mac", ":".join(key[i : i + 2] for i in range(0, 12, 2))), ("signed by Mr. ", "name", r.choice(["Thomas", "Peter", "Juan"]) + " " + r.choice(["Smith", "Meyer"])),
        ):
            good.append((f"{prose(5, k)} {before}{span} {prose(4, k)}", kind, span))
        bad += [f"{prose(5, k)} order-{digits(4)} page {iban()[:-1]}7x {prose(4, k)} then version 1-{digits(2)}-{digits(2)}", f"{prose(3, k)} some-very-long-hyphen-name-of-a-page2 {prose(3, k)}"]
    return good, bad


def test_pii_added_spans(spark):
    """The classifier adds the spans of the added kinds, with probabilities, and leaves look-alikes; kinds that EM learns as noise go."""
    good, bad = pii_texts()
    texts = [(k, t, "s") for k, (t, _, _) in enumerate(good)] + [(1000 + k, t, "s") for k, t in enumerate(bad)]
    found = defaultdict(list)
    for r in pii.spans(table(spark, texts)).collect():
        assert 0 <= r["probability"] <= 1 and (r["kind"] in pii.BASE or r["probability"] >= 0.5)
        found[r["doc_id"]].append((r["kind"], r["start"], r["stop"]))
    caught = Counter(kind for k, (t, kind, span) in enumerate(good) if (kind, t.index(span), t.index(span) + len(span)) in found[k])
    assert all(caught[k] >= 0.9 * n for k, n in Counter(kind for _, kind, _ in good).items()), caught
    assert sum(bool(found[1000 + k]) for k in range(len(bad))) <= 0.05 * len(bad)
    got = {r["doc_id"]: r["text"] for r in pii.redacted(table(spark, texts)).collect()}
    for k, (t, kind, span) in enumerate(good):
        if found[k] == [(kind, t.index(span), t.index(span) + len(span))]:
            assert got[k] == t.replace(span, f"<{kind.upper()}>")


def test_pii_classifier():
    """It follows the posteriors it is trained on."""
    rows = [{"kind": k, "shape": s, "mixed": 1, "n": 100, **dict(zip(pii.VOTES, v))} for k in ("secret", "ssn") for s in (1, 2) for v in ((1, 1, 1, 1), (1, 0, 1, 0), (-1, -1, 0, -1), (0, 0, 0, 0))]
    post = {(r["kind"], tuple(r[v] for v in pii.VOTES)): {(1, 1, 1, 1): 0.98, (1, 0, 1, 0): 0.9, (-1, -1, 0, -1): 0.02, (0, 0, 0, 0): 0.1}[tuple(r[v] for v in pii.VOTES)] for r in rows}
    weights = pii.classifier(rows, post)
    for r in rows:
        p = 1 / (1 + math.exp(-sum(weights.get(f, 0.0) for f in pii.names(r))))
        assert (p >= 0.5) == (post[r["kind"], tuple(r[v] for v in pii.VOTES)] >= 0.5)


def test_pii_many_matches_and_long_text(spark):
    """Offsets and masks of a text with thousands of matches that spans many blocks; overlapping spans; astral characters."""
    r = random.Random(3)
    text = " ".join(r.choice([f"a{k}@b{k}.org", f"10.{k % 256}.0.{k % 99}", "😀é", "4111 1111 1111 1111", f"+49 {170000000 + k}", "word"]) for k in range(6000))
    row = pii.judge(table(spark, [(1, text, "s")])).first()
    assert row["base_sha256"] == brute.sha(brute.base_spans(text))
    spans = sorted((r["start"], r["stop"], r["kind"]) for r in pii.spans(table(spark, [(1, text, "s")])).collect())
    want, at = [], 0
    for a, b, kind in spans:
        want += [text[at:a], f"<{kind.upper()}>"] if a >= at else []
        at = max(at, b)
    assert pii.redacted(table(spark, [(1, text, "s")])).first()["text"] == "".join(want) + text[at:]


def test_reliabilities():
    """Three good labelers and one that guesses: the guesser is told apart."""
    r = random.Random(2)
    counts, truth = Counter(), {}
    for _ in range(4000):
        y = r.random() < 0.4
        votes = tuple((1 if (y if r.random() < 0.9 else not y) else -1) for _ in range(3)) + (r.choice((1, -1)),)
        counts["k", votes] += 1
    tables, post = pii.reliabilities(counts)
    assert all(t[1, 1] > 0.8 and t[0, -1] > 0.8 for t in tables[:3]) and abs(tables[3][1, 1] - 0.5) < 0.1
    assert post["k", (1, 1, 1, -1)] > 0.9 and post["k", (-1, -1, -1, 1)] < 0.1 and not truth


def test_marginals(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 4)
    import itertools

    rng = np.random.default_rng(0)
    odds, starts, moves, first = rng.normal(size=23), np.array([0, 1, 7, 15, 21]), rng.normal(size=(2, 2)), rng.normal(size=2)
    want, pairs = [], np.zeros((2, 2))
    for a, b in zip(starts, [*starts[1:], len(odds)]):
        total, p, q = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            w = math.exp(first[y[0]] + sum(moves[i, j] for i, j in zip(y, y[1:])) + sum(odds[a + k] for k in range(b - a) if y[k]))
            total, p = total + w, p + w * np.array(y)
            for i, j in zip(y, y[1:]):
                q[i, j] += w
        want, pairs = [*want, *(p / total)], pairs + q / total
    got = toxicity.marginals(odds, starts, moves, first)
    assert np.allclose(got[0], want) and np.allclose(got[1], pairs)


def test_toxicity(spark):
    r = random.Random(3)
    rows, labels = [], []
    for k in range(300):
        words = [r.choice(PROSE) + str(r.randrange(60)) for _ in range(40)]
        bad = k % 4 == 0
        if bad:
            for _ in range(4):
                words.insert(r.randrange(40), r.choice(["Foulword,", "nastything"]))
        rows.append((k, " ".join(words), "s"))
        labels.append((k, 1, int(bad)))
    rows += [(900, None, "s"), (901, "", "s"), (902, "é foulword x", "s"), (None, "plain", "s"), rows[0]]
    out = toxicity.query(table(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (900, 1, None)], "doc_id bigint, quality int, toxic int")).collect()
    got = {x["doc_id"]: x for x in out}
    assert len(out) == len(rows) and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in out)
    held = [x for x in out if x["doc_id"] is not None and x["doc_id"] < 300 and x["held_out"]]
    assert held and all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in held)
    assert sum(x["predicted"] == (x["doc_id"] % 4 == 0) for x in held) >= 0.97 * len(held)
    assert got[902]["predicted"] == 1 and got[902]["spans"] == "2:10" and got[900]["predicted"] == 0
    empty = toxicity.query(table(spark, rows[:5]), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).collect()
    assert len(empty) == 5 and all(abs(x["score"] - 0.5) < 1e-9 for x in empty)


def test_document_scores():
    """Scores of whole texts against all labellings of their tokens."""
    import itertools

    rng, field = np.random.default_rng(1), toxicity.Field()
    field.weights, field.moves, field.first, field.document = rng.normal(size=1 << toxicity.BITS), rng.normal(size=(2, 2)), rng.normal(size=2), (-1.0, 2.0, 0.7)
    texts = [b"", b"one", b"a bad, word here", b"bad bad (word) a one bad", b"a b c d e f g h i j", b" \n "]
    top, total, p, sizes = field.inputs(texts)
    got, at = field.scores(top, total), 0
    for k, text in enumerate(texts):
        words = [toxicity.features(toxicity.normal(w)) for w in text.split()]
        odds = [sum(field.weights[f] for f in own) for own, _, _ in words]
        for n in range(1, len(words)):
            odds[n] += field.weights[words[n - 1][1]]
            odds[n - 1] += field.weights[words[n][2]]
        mass, whole = np.zeros(len(words)), 0.0
        for y in itertools.product((0, 1), repeat=len(words)):
            w = math.exp((field.first[y[0]] if y else 0) + sum(field.moves[i, j] for i, j in zip(y, y[1:])) + sum(o for o, b in zip(odds, y) if b))
            mass, whole = mass + w * np.array(y), whole + w
        mass = mass / whole
        assert sizes[k] == len(words) and np.allclose(p[at : at + len(words)], mass)
        at += len(words)
        z = -1.0 + 2.0 * (mass.max() if len(mass) else 0.0) + 0.7 * math.log1p(mass.sum())
        assert abs(got[k] - 1 / (1 + math.exp(-z))) < 1e-9


def test_targets():
    """Given the label: nothing in clean texts; in toxic ones the marginals over the chance of any toxic token."""
    p, sizes = np.array([0.5, 0.5, 0.9, 0.2]), np.array([2, 0, 1, 1])
    assert np.allclose(toxicity.targets(p, np.array([1.0, 1.0, 0.0, 1.0]), sizes), [0.5 / 0.75, 0.5 / 0.75, 0.0, 1.0])


def test_toxicity_without_clear_words(spark):
    """Labels of both kinds but no word that is clear: scores still differ; bounds of the sample; several texts of one doc_id."""
    r = random.Random(8)
    rows = [(k, " ".join(r.choice(PROSE) for _ in range(30)) + (" stone wizards" if k % 3 == 0 and k % 2 else ""), "s") for k in range(90)]
    labels = [(k, 1, int(k % 3 == 0)) for k in range(90)]
    docs, marks = table(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = toxicity.query(docs, marks).collect()
    assert len({round(x["score"], 9) for x in got}) > 10
    texts, kinds = toxicity.sample(docs, marks)
    assert len(texts) == 90 and sum(kinds) == 30
    assert sum(map(len, toxicity.sample(docs, marks, sample_bytes=900)[0])) <= 900 and len(toxicity.sample(docs, marks, rows=7)[0]) == 7
    assert toxicity.sample(docs, marks, text_bytes=10)[0] == []
    twice = table(spark, [(1, "zeta text", "s"), (1, "alpha text", "s"), (2, "x", "s"), (3, None, "s")])
    found = dict(zip(*toxicity.sample(twice, spark.createDataFrame([(1, 0, 1), (1, 0, 0), (2, 0, 0), (3, 1, 0)], "doc_id bigint, quality int, toxic int"))))
    assert found == {b"alpha text": 1, b"x": 0, b"": 0}


def ppm_brute(train, text, order):
    ctx = defaultdict(Counter)
    for t in train:
        data = bytes(order) + t + b"\0"
        for i in range(order, len(data)):
            for d in range(order + 1):
                ctx[data[i - d : i]][data[i]] += 1
    data, total = bytes(order) + text + b"\0", 0.0
    for i in range(order, len(data)):
        gone, p = set(), 1.0
        for d in range(order, -1, -1):
            left = {s: n for s, n in ctx.get(data[i - d : i], {}).items() if s not in gone}
            if not left:
                continue
            whole = sum(left.values()) + len(left)
            if data[i] in left:
                p *= left[data[i]] / whole
                break
            p *= len(left) / whole
            gone |= left.keys()
        else:
            p /= 256 - len(gone)
        total += math.log10(p)
    return total


@pytest.mark.parametrize("hot", [3, 100_000])
def test_ppm(spark, rows, hot):
    docs = table(spark, [(i, t if t is None else t[:400], s) for i, t, s in rows[0]])
    train = docs.filter(ppm.remainder(7) != 2)
    low = [(r["doc_id"], (r["text"] or "").encode().translate(ppm.LOWER)) for r in docs.collect()]
    learn = [t for i, t in low if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    tokens = Counter(w for t in learn for w in [*t.split(), b"\n"])
    n, v = sum(tokens.values()), len(tokens)
    out = sorted(ppm.score(docs, train, hot=hot).collect(), key=lambda r: (r["n_tokens"], r["score"]))
    want = []
    for _, t in low:
        words = [*t.split(), b"\n"]
        want.append((len(words), ppm_brute(learn, t, ppm.ORDER), sum(tokens[w] > 0 for w in words), sum(math.log10((tokens[w] + 1) / (n + v + 1)) for w in words)))
    assert len(out) == len(want)
    for r, (a, b, c, d) in zip(out, sorted(want)):
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (a, c, n)
        assert abs(r["score"] - b) < 1e-6 * (1 + abs(b)) and abs(r["base_score"] - d) < 1e-6 * (1 + abs(d))


@pytest.mark.parametrize("hot_grams", [0, 200])
def test_ppm_joined_grams(spark, rows, hot_grams):
    """Grams that are joined give the scores that grams looked up in the tasks give, and the query learns from its own rows alone."""
    docs = table(spark, [(i, t if t is None else t[:400], s) for i, t, s in rows[0]])
    train = docs.filter(ppm.remainder(7) != 2)
    key = lambda r: (r["n_tokens"], r["doc_id"] is None, r["doc_id"] or 0, round(r["score"], 6))
    want = sorted(ppm.score(docs, train).collect(), key=key)
    got = sorted(ppm.query(docs, hot_grams=hot_grams).collect(), key=key)
    assert len(got) == len(want) and any(r["held_out"] for r in got)
    for a, b in zip(got, want):
        assert a["doc_id"] == b["doc_id"] and a["n_known"] == b["n_known"] and abs(a["score"] - b["score"]) < 1e-9 * (1 + abs(b["score"]))


def test_adaptive():
    assert ppm.adaptive(b"abababababab") > 13 * math.log10(1 / 256) and abs(ppm.adaptive(b"") - math.log10(1 / 256)) < 1e-12


def test_urls(spark):
    urls = ["http://A.net/x", "https://example.NET/en/1?q", "https://x.example.net/fr#en/", "http://m.example.com/de/a", "http://a.org/fr/", "http://a.org/fr", "http://net", "http://net?/", None, "no host", "x://", "http://free-bets.example.com/a", "http://notexample.com/de/", "://a.net/#"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("host", F.lit("z"))
    got = {r["page_id"]: tuple(r)[1:] for r in url_rules.judge(df).collect()}
    assert got[0] == ("a.net", "/x", "net/", "block") and got[1] == ("example.net", "/en/1", "example.net/en/", "allow") and got[2] == ("x.example.net", "/fr", "net/", "block")
    assert got[3][2:] == ("example.com/de/", "block") and got[4][2:] == ("org/fr/", "allow") and got[5][2:] == (None, "allow") and got[6] == ("net", "", None, "allow") and got[7] == ("net", "", None, "allow")
    assert got[8] == got[9] == got[10] == ("", "", None, "allow") and got[11][3] == "block" and got[12][2] is None and got[13] == ("a.net", "/", "net/", "block")


def test_url_collisions(tmp_path, monkeypatch):
    monkeypatch.setattr(url_rules, "digests", lambda keys: np.array([len(k) for k in keys], dtype=np.uint64))  # all but the length collides
    path = tmp_path / "index"
    path.write_bytes(url_rules.index_bytes([("block", "ab/"), ("allow", "cd/"), ("block", "xyz/")]))
    index = url_rules.Index(str(path))
    assert index.find(["ab/", "cd/", "ef/", "xyz/", "none/"]).tolist() == [i if i is not None else -1 for i in (next(k for k in range(3) if index.string(k) == "ab/"), next(k for k in range(3) if index.string(k) == "cd/"), None, next(k for k in range(3) if index.string(k) == "xyz/"), None)]


def test_urls_by_a_million_rules(spark, tmp_path):
    """Rules from a table; the index is opened by its header; each url against a plain look-up."""
    path = tmp_path / "index"
    path.write_bytes(url_rules.index_bytes((("block", "allow")[k % 2], f"h{k}.example.com/{'p' * (k % 3)}") for k in range(1_000_000)))
    index = url_rules.Index(str(path))
    assert index.n == 1_000_000 and index.path_lengths == [1, 2, 3]
    asked = [f"h{k}.example.com/{'p' * (k % 3)}" for k in range(0, 1_000_000, 997)]
    at = index.find([*asked, *("not" + a for a in asked)])
    assert [index.string(i) for i in at[: len(asked)]] == asked and (at[len(asked) :] == -1).all()
    rules = spark.range(3000).selectExpr("IF(id % 2 = 0, 'block', 'allow') AS verdict", "concat('h', id, '.com/', repeat('p', cast(id % 3 AS int))) AS rule")
    pages = spark.range(6000).selectExpr("id AS page_id", "concat('https://www.h', id, '.com/ppp') AS url").union(spark.createDataFrame([(-1, "http://x.y/" + "z" * 200_000)], "page_id bigint, url string"))
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.judge(pages, rules.union(rules), spark.createDataFrame([("y",)], "term string")).collect()}
    assert got == {k: ((f"h{k}.com/{'p' * (k % 3)}", ("block", "allow")[k % 2]) if k < 3000 else (None, "allow")) for k in range(6000)} | {-1: (None, "block")}
    for bad in ([("block", "no-path")], [("block", "a/"), ("allow", "b")]):
        with pytest.raises(ValueError):
            url_rules.index_bytes(bad)
    assert url_rules.judge(pages, [], []).filter("rule IS NOT NULL OR verdict <> 'allow'").count() == 0


def test_sql(spark):
    """Queries that SQL can express, on the smallest tables."""
    from bitloom.llm.queries import ORACLE_SQL, QUERIES

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, d)
        names = sorted(df.columns)
        want = con.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
        assert Counter(map(tuple, df.select(*names).collect())) == Counter(want), name


def test_empty_tables(spark, rows):
    docs, items = table(spark, rows[0]).limit(0), spark.createDataFrame([], "item_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for out in (
        toxicity.query(docs, labels), quality_rules.query(docs), packing.query(docs), simhash.query(docs), license_scan.scan(docs), decontamination.judge(docs, items), pii.judge(docs), ppm.query(docs),
        url_rules.judge(spark.createDataFrame([], "page_id bigint, url string")), quality_rules.filtered(docs), simhash.deduplicated(docs), decontamination.filtered(docs, items), pii.redacted(docs),
    ):
        assert out.count() == 0
    assert decontamination.judge(table(spark, rows[0]), items).filter("contaminated").count() == 0


def test_pipeline(spark, tmp_path):
    """Every stage against plain code on its own input, and run() as their composition."""
    item = prose(30, "item")
    rows = [(k, prose(90, k), "s") for k in range(8)] + [(20, prose(90, 3), "s"), (21, prose(10, 21), "s"), (22, prose(60, 22) + " " + item, "t"), (23, prose(70, 23) + " write to me@mail.example.com now", "t"), (24, None, None)]
    table(spark, rows, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_duplicates", "benchmark_decontamination", "personal_data", "packing"]
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.schema.names == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert set(seen[0]) == {*range(8), 20, 22, 23} and set(seen[1]) == {*range(8), 22, 23} and set(seen[2]) == {*range(8), 23}
    assert seen[3][23].endswith("write to <EMAIL> now") and seen[3][5] == prose(90, 5)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == {*range(8), 23} and len({r["sequence_id"] for r in out}) <= 3
    assert hashlib.sha256(b"").hexdigest() == brute.sha("")
