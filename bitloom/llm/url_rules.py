"""URL filter by a sorted digest array.

A rule is a host and the start of a path; it fits that host and all its subdomains. The index is one file: a header with the
path lengths that occur, the sorted 64-bit XXH64 digests of the rules' strings, and the strings themselves. Spark hands the file to
every executor, which maps it into memory; opening it reads the header alone, so a list of millions costs a task nothing but the
pages it touches. For each url all keys that a rule could have (each suffix of the host with each path prefix of a length that
some rule has) are probed by one vectorised binary search a batch, and every hit is confirmed against the stored string, so a
collision of digests decides nothing. The longest rule wins (of equals, the one with the longer host). Urls that no rule fits
are judged by the method's own entries: labels of a host that hold a listed term are blocked, all others allowed.

Rules and terms are lists or tables (`verdict, rule` and `term`). A table passes through the driver, which writes the file: it is
counted first, and more than MAX_ENTRIES rows are refused with an error, not cut.

Defined results: null url, and urls without `://`, have an empty host and path; a null page_id is kept; repeated rows keep their
own output row; very long urls are taken whole; of rules given twice in a list the last counts, in a table the block; rules that are
null or without a `/` are refused; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

#: The rules that the query is asked to judge by.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Terms of unwanted hosts; a label is cut at hyphens.
TERMS = """casino casinos bets betting gambling poker slots roulette blackjack jackpot lottery pills pharmacy viagra cialis levitra tramadol porn porno sex xxx nude
adult escort escorts camgirl webcams hentai warez cracked keygen nulled torrent torrents malware phishing ransomware spam clickbait payday loans forex""".split()
MAX_ENTRIES = 20_000_000
VERDICTS = ("allow", "block")


def digests(keys: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64)


def path_length(rule: str) -> int:
    if "/" not in rule:
        raise ValueError(f"{rule!r} is no rule: a host and the start of a path, like net/")
    return len(rule) - rule.index("/")


def index_bytes(rules: Iterable[tuple[str, str]], terms: Iterable[str] = ()) -> bytes:
    """The file: number of entries and of path lengths, path lengths, digests, end of each string, verdicts, strings. A rule's key
    is its string, a term's key is the term after a blank, which no host has. Of rules given twice the last counts."""
    entries = {rule: v for v, rule in rules}
    lengths = np.array(sorted({path_length(rule) for rule in entries}), dtype=np.int64)
    entries |= {f" {t}": "block" for t in terms}
    keys = list(entries)
    order = np.argsort(d := digests(keys), kind="stable")
    strings = [keys[i].encode() for i in order]
    ends = np.cumsum([len(s) for s in strings], dtype=np.int64) if keys else np.empty(0, np.int64)
    verdicts = np.array([VERDICTS.index(entries[keys[i]]) for i in order], dtype=np.int64)
    return np.array([len(keys), len(lengths)], np.int64).tobytes() + lengths.tobytes() + d[order].tobytes() + ends.tobytes() + verdicts.tobytes() + b"".join(strings)


class Index:
    """The file, mapped into memory."""

    def __init__(self, path: str):
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        self.n, k = (int(x) for x in raw[:16].view(np.int64))
        self.path_lengths = raw[16 : 16 + 8 * k].view(np.int64).tolist()
        at, n = 16 + 8 * k, self.n
        self.digests, self.ends, self.verdicts = (raw[at + 8 * n * c : at + 8 * n * (c + 1)].view(t) for c, t in enumerate((np.uint64, np.int64, np.int64)))
        self.strings = raw[at + 24 * n :]

    def string(self, i: int) -> str:
        return bytes(self.strings[self.ends[i - 1] if i else 0 : self.ends[i]]).decode()

    def same(self, keys: list[bytes], entry: np.ndarray) -> np.ndarray:
        """Whether each key is the string of its entry: all bytes of all pairs of equal length in one comparison."""
        ends, sizes = self.ends[entry], np.array([len(k) for k in keys], dtype=np.int64)
        starts = np.where(entry > 0, self.ends[np.maximum(entry - 1, 0)], 0)
        equal = ends - starts == sizes
        at = np.flatnonzero(equal & (sizes > 0))
        if len(at):
            first = np.cumsum(sizes[at]) - sizes[at]
            place = np.arange(sizes[at].sum()) - np.repeat(first, sizes[at]) + np.repeat(starts[at], sizes[at])
            mine = np.frombuffer(b"".join(keys[k] for k in at), np.uint8)
            equal[at] = np.logical_and.reduceat(self.strings[place] == mine, first)
        return equal

    def find(self, keys: list[str]) -> np.ndarray:
        """The entry of each key, or -1."""
        out = np.full(len(keys), -1)
        if not self.n or not keys:
            return out
        d = digests(keys)
        at = np.searchsorted(self.digests, d)
        asked = np.arange(len(keys))
        while len(asked := asked[at[asked] < self.n]) and len(asked := asked[self.digests[at[asked]] == d[asked]]):
            hit = self.same([keys[k].encode() for k in asked], at[asked])
            out[asked[hit]] = at[asked[hit]]
            asked = asked[~hit]
            at[asked] += 1  # equal digests stand together
        return out


LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def parts(url: str | None) -> tuple[str, str]:
    """Host and path."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    rest = rest.split("#", 1)[0].split("?", 1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(LOWER), slash + path


def judged(index: Index, urls: list[str | None]) -> tuple[list, list, list, list]:
    """host, path, rule (or None) and verdict of each url."""
    split = [parts(u) for u in urls]
    keys: dict[str, int] = {}
    owners, asked = [], []
    for row, (host, path) in enumerate(split):
        labels = host.split(".") if host else []
        starts = [path[:n] for n in index.path_lengths if len(path) >= n]
        probes = [".".join(labels[k:]) + s for k in range(len(labels)) for s in starts]
        probes += [f" {t}" for label in labels for t in label.split("-") if t]
        for p in probes:
            owners.append(row)
            asked.append(keys.setdefault(p, len(keys)))
    distinct = list(keys)
    entry = index.find(distinct)
    rule: list = [None] * len(urls)
    verdict = ["allow"] * len(urls)
    for row, k in zip(owners, asked, strict=True):
        if (e := entry[k]) >= 0:
            key = distinct[k]
            if key[0] == " ":
                if rule[row] is None:
                    verdict[row] = VERDICTS[index.verdicts[e]]
            elif rule[row] is None or (len(key), key.index("/")) > (len(rule[row]), rule[row].index("/")):
                rule[row], verdict[row] = key, VERDICTS[index.verdicts[e]]
    return [h for h, _ in split], [p for _, p in split], rule, verdict


def shipped(spark: SparkSession, content: bytes) -> str:
    """Gives the file to all executors, once a session; its name follows its content, so another index is another file."""
    name = f"url-rules-{hashlib.sha256(content).hexdigest()[:24]}.bin"
    if any(f.endswith(f"/{name}") for f in spark.sparkContext.listFiles):
        return name
    folder = tempfile.mkdtemp(prefix="url-rules-")  # the driver serves the file from here while it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(content)
    spark.sparkContext.addFile(path)
    return name


def listed(table: DataFrame, *columns: str) -> list[tuple]:
    """The rows of a table of at most MAX_ENTRIES rows."""
    n = table.count()
    if n > MAX_ENTRIES:
        raise ValueError(f"{n} entries; an index holds at most {MAX_ENTRIES}")
    at = table.select(*columns).toArrow()
    return list(zip(*(at.column(c).to_pylist() for c in columns), strict=True))


def judge(pages: DataFrame, rules: DataFrame | Iterable[tuple[str, str]] = RULES, terms: DataFrame | Iterable[str] = TERMS) -> DataFrame:
    """page_id, host, path, rule, verdict. rules: (verdict, rule) pairs or a table of them; terms: strings or a table `term`."""
    if isinstance(rules, DataFrame):
        rules = listed(rules.groupBy("rule").agg(F.max("verdict").alias("verdict")), "verdict", "rule")  # 'block' is the larger word
    if isinstance(terms, DataFrame):
        terms = [t for (t,) in listed(terms.distinct(), "term")]
    name = shipped(pages.sparkSession, index_bytes(rules, terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(SparkFiles.get(name))
        for batch in batches:
            out = judged(index, batch.column("url").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(c, pa.string()) for c in out)], names=["page_id", "host", "path", "rule", "verdict"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url").mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_replace(substr(url, strpos(url, '://') + 3), '[?#].*$', '', 's') ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN contains(rest, '/') THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM u),
r(rule, verdict, rhost, rpath) AS (VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
  ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
best AS (
  SELECT p.*, (SELECT arg_max(struct_pack(rule := rule, verdict := verdict), length(rule)) FROM r
               WHERE ends_with('.' || host, '.' || rhost) AND starts_with(path, rpath)) AS b FROM p)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, b.rule AS rule,
       coalesce(b.verdict, CASE WHEN regexp_matches(coalesce(host, ''), '(^|[.-])(@TERMS@)([.-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM best
""".replace("@TERMS@", "|".join(TERMS))
