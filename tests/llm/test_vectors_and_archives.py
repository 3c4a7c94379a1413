"""Centroids, archives and hard negatives against brute force and DuckDB."""

import gzip
import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.llm import centroids, hard_negatives, warc

SF = "/root/testdata/sf0.001"


def against(spark, query, sql, name, sf=SF):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    df, rel = query(spark.read.parquet(f"{sf}/{name}.parquet")), con.execute(sql)
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(map(tuple, df.select(*names).collect())) == Counter(rel.fetchall())


@pytest.mark.parametrize("query, sql, name", [(centroids.cluster, centroids.ORACLE, "embeddings"), (warc.query, warc.ORACLE, "pages"), (hard_negatives.query, hard_negatives.ORACLE, "embeddings")])
def test_sql(spark, query, sql, name):
    against(spark, query, sql, name)


# ---- centroids ---------------------------------------------------------------------------------------------------------


def test_transform():
    h = centroids.transformed(np.eye(64, dtype=np.int64)).T
    assert [(r[1:] != r[:-1]).sum() for r in h] == list(range(64)) and (h @ h.T == 64 * np.eye(64)).all()


@pytest.mark.parametrize("size, spread, shift", [(64, 60, 0), (64, 3, 0), (8, 2, 0), (1, 4, 0), (64, 60, 25)])
def test_nearest(size, spread, shift):
    r = np.random.default_rng(size + spread)
    c = r.integers(-spread, spread + 1, (16, size)) << shift
    c[9], c[12] = c[4], c[4]  # ties go to the smallest number
    v = c[r.integers(0, 16, 500)] + (r.integers(-2, 3, (500, size)) << shift)
    counted: list = []
    cluster, distance = centroids.nearest(v, c, counted)
    exact = ((v.astype(object)[:, None] - c.astype(object)) ** 2).sum(axis=2)
    assert cluster.tolist() == [int(np.argmin(e)) for e in exact] and distance.tolist() == exact.min(axis=1).tolist()
    if size == 64 and spread == 60:
        assert counted[-1] < counted[0] / 4  # most centroids are gone before the finest coefficients


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    return df.selectExpr("*", "1 AS cluster", "2 AS v", "3 AS q", "4 AS block", "5 AS part", "6 AS rank", "7 AS n", "8 AS `a.b`")


def spoiled(size):
    """Rows that take no part."""
    good = [0.5] * size
    return [(900, 1, None), (901, 1, [*good[1:], None]), (902, 1, [*good[1:], math.nan]), (903, 1, [*good[1:], math.inf]), (904, 1, [-math.inf, *good[1:]])]


def test_clusters(spark):
    r = random.Random(5)
    rows = [(k, 0, [r.uniform(-1, 1) for _ in range(4)]) for k in range(60)]
    rows += [rows[7], rows[7], (None, None, [0.1, 0.2, 0.3, 0.4]), (70, 0, [0.5] * 3), (71, 0, [])]
    got = centroids.cluster(vectors(spark, rows + spoiled(4)), k=5, rounds=2, size=4).collect()
    v = [(i, [math.floor(64 * x) for x in e]) for i, _, e in rows if len(e) == 4]
    c = [list(e) for _, e in sorted(v, key=lambda t: ((0, hashlib.sha256(f"1:{t[0]}".encode()).hexdigest(), t[1]) if t[0] is not None else (1, "", t[1])))[:5]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda e: min(range(5), key=lambda k: (square(e, c[k]), k))
    for _ in range(2):
        held = defaultdict(list)
        for _, e in v:
            held[near(e)].append(e)
        for k, es in held.items():
            c[k] = [sum(x) // len(es) for x in zip(*es, strict=True)]
    final = [(i, near(e), square(e, c[near(e)])) for i, e in v]
    whole = Counter()
    for _, k, d in final:
        whole[k] += d
    digest = lambda k: hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()
    assert Counter(map(tuple, got)) == Counter((i, k, d, whole[k], sum(whole.values()), digest(k)) for i, k, d in final)


def test_clusters_edges(spark):
    assert centroids.cluster(vectors(spark, []), size=4).count() == 0
    assert centroids.cluster(vectors(spark, spoiled(4)), size=4).count() == 0
    few = centroids.cluster(vectors(spark, [(1, 0, [1.0, 2.0]), (2, 0, [9.0, 9.0])]), size=2).collect()
    assert {r["distance"] for r in few} == {0} and {r["cluster"] for r in few} == {0, 1}
    with pytest.raises(ValueError):
        centroids.cluster(vectors(spark, []), size=6)


# ---- archives ----------------------------------------------------------------------------------------------------------

PAGE = "page_id bigint, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGE).selectExpr("*", "1 AS payload", "2 AS salt", "3 AS first", "4 AS payload_digest", "5 AS path", "6 AS `a.b`")


@pytest.fixture(scope="module")
def web():
    hot = "the same page again " * 9
    rows = [(k, f"http://a.b/{k} \r\nx", "<p>" + "word " * (7 * k % 90)) for k in range(60)]
    rows += [(5, None, hot), (5, None, hot), *[(100 + k, "u", hot) for k in range(150)], (None, "u", hot), (None, None, "alone " * 40), (None, "", None), (300, None, None), (301, "é", "é" * 50), (302, "é", "é" * 50)]
    return [*rows, (303, "http://l", "long \x1f " * 60_000), (304, "x", "99 bytes" + "y" * 91), (305, "x", "99 bytes" + "y" * 91), (306, "z", "z" * 100), (307, "z", "z" * 100)]


def expected(rows, least=100):
    low: dict = {}
    for i, _, t in rows:
        b = (t or "").encode()
        if i is not None and len(b) >= least:
            low[b] = min(low.get(b, i), i)
    out = Counter()
    for i, _, t in rows:
        b = (t or "").encode()
        first = low.get(b) if low.get(b) != i else None
        out[i, len(b), hashlib.sha256(b).hexdigest(), "response" if first is None else "revisit", first] += 1
    return out


@pytest.mark.parametrize("split, file_bytes, bound", [(8 << 20, 1 << 28, 500_000), (97, 1, 0), (1009, 4000, 0), (100_000, 1 << 28, 0)])
def test_round_trip(spark, web, split, file_bytes, bound, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", bound)
    got = warc.query(pages(spark, web), split=split, file_bytes=file_bytes).collect()
    assert Counter(map(tuple, got)) == expected(web)


def test_archives_are_gzip(spark, web, tmp_path):
    manifest = warc.archived(pages(spark, web), str(tmp_path)).collect()
    assert sorted(m["path"] for m in manifest) == sorted(map(str, tmp_path.glob("*.warc.gz")))
    assert sum(m["records"] for m in manifest) == len(web)
    for m in manifest:
        raw = gzip.open(m["path"]).read()  # any reader of gzip sees the records one after the other
        assert raw.count(b"WARC/1.1\r\nWARC-Type: ") == m["records"] and raw.endswith(b"\r\n\r\n")
    read = warc.read_archives(warc.archived(pages(spark, web))).collect()
    assert all(r["intact"] for r in read)
    texts = Counter(r["payload"] for r in read if r["record_type"] == "response")
    assert texts[("long \x1f " * 60_000).encode()] == 1 and texts[("the same page again " * 9).encode()] == 2
    assert {r["uri"] for r in read if r["record_id"] == "urn:page:3"} == {"http://a.b/3%20%0D%0Ax"}


@pytest.mark.parametrize("split", [50, 333, 1 << 20])
def test_damaged_archives(spark, tmp_path, split):
    """False magic between members, a record cut short, a wrong length, a broken checksum and a torn end: sound records stay, others go."""
    whole = [warc.member(warc.record_bytes(k, "u", b"payload %d " % k * 30, len(b"payload %d " % k * 30), "")) for k in range(6)]
    plain = gzip.compress(b"no record " * 20)
    wrong = warc.member(warc.record_bytes(7, "u", b"x", 1, "").replace(b"msgtype=response\r\nContent-Length: ", b"msgtype=response\r\nContent-Length: 1"))
    broken = bytearray(whole[2])
    broken[-6] ^= 255
    data = whole[0] + warc.MAGIC * 3 + whole[1] + bytes(broken) + plain + wrong + whole[3][:40] + whole[4] + b"junk" * 30 + whole[5] + whole[3][:-5]
    (tmp_path / "a.warc.gz").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(b"")
    manifest = spark.createDataFrame([(str(tmp_path / "a.warc.gz"), len(data), 0), (str(tmp_path / "b.warc.gz"), 0, 0)], warc.MANIFEST)
    got = warc.read_archives(manifest, split=split).collect()
    assert sorted(r["record_id"] for r in got) == [f"urn:page:{k}" for k in (0, 1, 4, 5)] and not any(r["intact"] for r in got)
    assert all(data[r["offset"] : r["offset"] + r["length"]] == whole[int(r["record_id"][-1])] for r in got)


def test_archives_empty(spark):
    assert warc.query(pages(spark, [])).count() == 0


# ---- hard negatives ----------------------------------------------------------------------------------------------------


def mined(rows, n_positives=5, n_negatives=3):
    held: dict = {}
    for i, label, e in rows:
        if i is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            new = (label, [math.floor(256 * x) for x in e])
            held[i] = min(held.get(i, new), new)
    out = []
    for a, (label, q) in held.items():
        if a % 5:
            continue
        score = {i: sum(x * y for x, y in zip(q, p)) for i, (_, p) in held.items() if i != a}
        best = lambda ids, k: sorted(ids, key=lambda i: (-score[i], i))[:k]  # noqa: B023,E731
        for p in best([i for i in score if held[i][0] == label], n_positives):
            inside = [i for i in score if held[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(best(inside, n_negatives))]
    return sorted(out)


@pytest.mark.parametrize("seed, block, leaf, group", [(1, 8192, 256, 2048), (2, 40, 4, 7), (3, 16, 1, 3)])
def test_hard_negatives(spark, seed, block, leaf, group):
    r = random.Random(seed)
    centre = {k: [r.gauss(0, 1) for _ in range(6)] for k in range(4)}
    rows = [(k, k % 4 if k % 3 else 0, [x + r.gauss(0, 0.4) for x in centre[k % 4]]) for k in range(150)]
    rows += [(200 + k, k % 3, list(rows[5][2])) for k in range(40)]  # one vector many times: ties by id
    rows += [rows[10], (10, 3, rows[11][2]), (20, None, rows[1][2]), (None, 1, rows[1][2]), (300, 2, []), (301, 2, rows[3][2][:2]), (305, 9, rows[3][2]), *spoiled(6)]
    r.shuffle(rows)
    got = hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 5 == 0, block=block, leaf=leaf, group=group)
    assert sorted(map(tuple, got.collect())) == mined(rows)


def test_boxes():
    r = np.random.default_rng(4)
    q, labels, ids = r.integers(-9, 10, (500, 5)), r.integers(0, 3, 500), np.arange(500)
    parts = hard_negatives.tiles(q, labels, ids, 16)
    assert sorted(np.concatenate(parts).tolist()) == list(range(500)) and max(map(len, parts)) <= 16 and len(parts) <= 40


def test_hard_negatives_edges(spark):
    every = F.col("vec_id") % 1 == 0
    assert hard_negatives.mine(vectors(spark, []), every).count() == 0
    assert hard_negatives.mine(vectors(spark, [(1, 1, [1.0])]), every).count() == 0
    assert hard_negatives.mine(vectors(spark, [(1, 1, [1.0]), (2, 1, [1.0]), (3, 2, [0.6])]), F.col("vec_id") == 9).count() == 0
    big = [(1, 1, [2.0**20, 1.0]), (2, 1, [2.0**20, 0.5]), (3, 2, [2.0**19, 3.0])]  # beyond what doubles hold exactly
    assert sorted(map(tuple, hard_negatives.mine(vectors(spark, big), F.col("vec_id") == 1).collect())) == [(1, 2, 1, 3, 2**56 + 2**15, 2**55 + 3 * 2**16)]
