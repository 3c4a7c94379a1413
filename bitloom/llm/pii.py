"""Personal data by weak supervision, as DataFrame operations alone.

Regular expressions propose candidate spans of ten kinds. Four labelers vote on each (+1, -1 or 0 for abstaining): a strict
form of the expression, a gazetteer, the words before the span, and the characters at its edges. Expectation-maximisation over
the counts of the vote patterns estimates how reliable each labeler is and how likely each pattern is personal data; a
logistic classifier over the patterns and the shape of the span is trained on those posteriors and decides. Only the table of
pattern counts reaches the driver: at most kinds x 3^4 x shapes rows, whatever the input.

Spans of the four base kinds that pass their base check always stay; the classifier adds spans of the kinds account (card-like
digits that fail the check sum), secret, ssn, iban (with a valid remainder), mac and name (after a title or a word for a name).

An expression cuts a text into matches and the gaps between them; these are rows, and a window sums up their lengths to offsets.
The votes look at the match and the gap before it. So the work is in proportion to the text and its matches, however many.

Defined results: null text is the empty text; repeated rows get the same spans, each its own row; a null doc_id is a document
like any other; very long texts are searched whole, and masked in blocks of SLICE code points; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import boxed, indices, let, scratch, unboxed, written

MARK = "\x01"
#: The base expressions, with possessive loops and without a start inside a run that was already tried.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,}+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "mac": r"(?<![0-9A-Fa-f:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:-])",
    "name": r"(?=\p{Lu})(?<=\b(?:Mr|Ms|Mrs|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20|[Nn]ame:\x20|[Nn]om:\x20|[Nn]ombre:\x20)\p{Lu}\p{Ll}++(?:\x20\p{Lu}\p{Ll}++){0,2}+",
}
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "account", "secret", "ssn", "iban", "mac", "name"]
#: What a text must hold for an expression to be tried.
TRIGGERS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]", "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24}", "ssn": r"[0-9]-[0-9]{2}-[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "mac": r"[0-9A-Fa-f][:-][0-9A-Fa-f]{2}[:-]", "name": r"[MDPHFSNn](?:rs?|s|me|rof|err|rau|ra|ame|om|ombre)[.:]?\x20\p{Lu}"}
#: Gazetteers: top-level domains, number prefixes of card issuers, country codes of accounts with their lengths, given names, prefixes of
#: keys that services give out, words that name a kind of data.
DOMAINS = """com org net edu gov int mil info biz name io co ai app dev me tv cc xyz online site shop store tech cloud blog news email live
ac ad ae ar at au be bg bo br by ca ch cl cn cr cu cy cz de dk do ec ee eg es eu fi fr gr gt hk hn hr hu id ie il in ir is it jp ke kr kz
lt lu lv ma md mk mt mx my ng ni nl no nz pa pe ph pk pl pr pt py ro rs ru sa se sg si sk sv th tn tr tw ua uk us uy ve vn za"""
IBANS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IT": 27, "LT": 20, "LU": 20, "LV": 21, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}
GIVEN = """james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah
charles karen daniel lisa matthew nancy anthony sandra mark paul steven andrew peter anna maria laura emma olivia sophia julia hans karl
heinz jürgen klaus wolfgang ursula monika petra sabine andrea stefan martin thomas jean pierre marie jacques michel françois philippe
nathalie isabelle sophie claire camille josé juan antonio manuel francisco carlos luis miguel carmen ana isabel pilar lucía elena"""
ISSUED = r"^(AKIA|ASIA|gh[pousr]_|glpat-|sk-|pk_|rk_|xox[abps]-|AIza|ya29|eyJ|SG|npm_|hf_)"
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|36|38|6011|65|35)"
NAMED = {
    "email": r"mail|contact|write|kontakt|correo",
    "ip": r"\bip\b|server|host|addr|adres|login|from",
    "card": r"card|visa|karte|carte|tarjeta|credit|pay",
    "phone": r"phone|tel|call|fax|mobil|contact|ruf",
    "account": r"card|account|iban|konto|compte|cuenta|number|pay",
    "secret": r"token|key|secret|passw|auth|bearer|api",
    "ssn": r"ssn|social|security",
    "iban": r"iban|account|bank|konto|compte|cuenta|transfer",
    "mac": r"mac|ether|device|hardware|adapter|addr",
    "name": r"name|nom|signed|contact|dear|by|author|sehr|chère|estimad",
}
AGAINST = r"version|isbn|order|page|chapter|figure|\bv$"
VOTES = ["strict", "gazetteer", "context", "edges"]
BEFORE = 30
SLICE = 4096
BROADCAST_SPANS = 300_000


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check sum."""

    def weight(i, n):
        d = F.substr(number, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    n = F.length(number)
    return (F.aggregate(F.transform(F.sequence(F.lit(1), n), lambda i: weight(i, n)), F.lit(0), lambda a, x: a + x) % 10) == 0


def passes(kind: str, match: Column) -> Column:
    """The base check of a match; a match that fails is dropped."""
    if kind == "ip":
        return ~F.exists(F.split(match, r"\."), lambda p: ~p.rlike("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return let(digits(match), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits(match)).between(9, 15)
    if kind == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    if kind == "iban":
        return let(F.replace(match, F.lit(" "), F.lit("")), lambda m: F.length(m).between(15, 34) & (account_remainder(m) == 1))
    return F.lit(True)


def account_remainder(number: Column) -> Column:
    """An international account number modulo 97, its first four characters moved to the end and letters read as 10 to 35."""
    turned = F.concat(F.substr(number, F.lit(5)), F.substr(number, F.lit(1), F.lit(4)))

    def step(a, c):
        return F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)


def cut(text: Column, kind: str) -> Column:
    """The text cut at the leftmost matches that do not overlap: gap, match, gap, ..., gap; empty without a match."""
    parts = F.split(F.regexp_replace(text, PATTERNS[kind], f"{MARK}$0{MARK}"), MARK)
    return F.when(text.rlike(TRIGGERS[kind]), parts).otherwise(F.array().cast("array<string>"))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, digest, kind, start, stop, match, before, edge: one row a candidate span."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64(text).alias("digest"), F.translate(text, MARK, "\x02").alias("t"))
    # rows of equal documents are told apart, as offsets are sums over the rows of one text
    keyed = keyed.withColumn("row", F.monotonically_increasing_id())

    def of(kind):
        def row(parts, k):
            gap, match, after = (F.get(parts, 2 * k + d) for d in range(3))
            edge = F.concat(F.right(gap, F.lit(1)), F.lit("|"), F.left(after, F.lit(1)))
            return F.struct(F.lit(kind).alias("of"), k.alias("k"), F.char_length(gap).alias("gap"), match.alias("match"), F.lower(F.right(gap, F.lit(BEFORE))).alias("before"), edge.alias("edge"))

        return let(cut(F.col("t"), kind), lambda parts: F.transform(indices(F.floor(F.size(parts) / 2).cast("int") - 1), lambda k: row(parts, k)))

    spans = keyed.select("doc_id", "digest", "row", F.explode(F.concat(*[of(k) for k in PATTERNS])).alias("c")).select("doc_id", "digest", "row", "c.*")
    upto = Window.partitionBy("row", "of").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.sum((F.col("gap") + F.char_length("match")).cast("bigint")).over(upto)
    spans = spans.withColumn("stop", stop.cast("int")).withColumn("start", F.col("stop") - F.char_length("match"))
    kind = F.when((F.col("of") == "card") & ~passes("card", F.col("match")), "account").otherwise(F.col("of"))
    good = F.when(F.col("of") == "card", F.length(digits(F.col("match"))).between(13, 19))
    for k in PATTERNS:
        good = good if k == "card" else good.when(F.col("of") == k, passes(k, F.col("match")))
    return spans.filter(good).select("doc_id", "digest", kind.alias("kind"), "start", "stop", "match", "before", "edge")


def vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def voted(spans: DataFrame) -> DataFrame:
    """The candidates with the four votes and the span's shape: length class, and letters beside digits."""
    kind, match, n = F.col("kind"), F.col("match"), F.length(digits(F.col("match")))
    case = lambda of: F.coalesce(*[F.when(kind == k, c) for k, c in of.items()], F.lit(0))
    yes, known = F.lit(True), F.create_map(*[F.lit(x) for pair in IBANS.items() for x in pair])
    strict = case({
        "email": vote(match.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@.*\.[A-Za-z]{2,24}$"), match.rlike(r"\.@|\.\.|-$")),
        "ip": vote(match.rlike(r"^(0|[1-9][0-9]*)(\.(0|[1-9][0-9]*)){3}$"), match.rlike(r"(^|\.)0[0-9]")),
        "card": vote(n.isin(13, 15, 16, 19), ~n.isin(13, 15, 16, 19)),
        "account": vote(n == 16, n < 13),
        "phone": vote(n.between(10, 13), n < 10),
        "secret": vote(match.rlike(r"^[0-9a-fA-F]{32,}$") | match.rlike(ISSUED), match.rlike(r"^[a-z]+[-_]|[-_]{2}") & ~match.rlike(ISSUED)),
        "ssn": vote(~match.rlike(r"^(000|666|9)"), match.rlike(r"^(000|666|9)")),
        "iban": vote(F.length(F.replace(match, F.lit(" "), F.lit(""))) >= 15, ~yes),
        "mac": vote(match.rlike(r"^..(:..){5}$") | match.rlike(r"^..(-..){5}$"), match.rlike(r":.*-|-.*:")),
        "name": vote(match.contains(" "), F.length(match) < 3),
    })
    gazetteer = case({
        "email": vote(F.lower(F.regexp_extract(match, r"\.([A-Za-z]+)$", 1)).isin(DOMAINS.split()), ~match.rlike(r"[A-Za-z]$")),
        "ip": vote(~match.rlike(r"^(0|127|255)\."), match.rlike(r"^(0|127|255)\.")),
        "card": vote(digits(match).rlike(ISSUERS), ~yes),
        "account": vote(digits(match).rlike(ISSUERS), ~yes),
        "phone": vote(match.rlike(r"^\+[1-9]"), match.rlike(r"^\+0")),
        "secret": vote(match.rlike(ISSUED) | match.rlike(r"^[0-9a-fA-F]+$"), match.rlike(r"^(.)\1+$")),
        "iban": vote(*[ok == (F.length(F.replace(match, F.lit(" "), F.lit(""))) == F.coalesce(F.get(F.map_values(known), F.array_position(F.map_keys(known), F.left(match, F.lit(2))).cast("int") - 1), F.lit(0))) for ok in (yes, ~yes)]),
        "mac": vote(~match.rlike(r"^(00[:-]){5}|^(ff[:-]){5}"), match.rlike(r"^(00[:-]){5}|^(ff[:-]){5}")),
        "name": vote(F.lower(F.substring_index(match, " ", 1)).isin(GIVEN.split()), ~yes),
    })
    named = F.coalesce(*[F.when(kind == k, F.col("before").rlike(p)) for k, p in NAMED.items()], F.lit(False))
    context = vote(named, F.col("before").rlike(AGAINST) & ~named)
    edges = vote(~F.col("edge").rlike(r"[A-Za-z0-9]\||\|[A-Za-z0-9]"), F.col("edge").rlike(r"[0-9.]\||\|[0-9]"))
    shape = F.least(F.floor(F.length(match) / 8), F.lit(5)).cast("int")
    return spans.select("*", strict.alias("strict"), gazetteer.alias("gazetteer"), context.alias("context"), edges.alias("edges"), shape.alias("shape"), (match.rlike("[0-9]") & match.rlike("[A-Za-z]")).cast("int").alias("mixed"))


def reliabilities(counts: dict, rounds: int = 50) -> tuple[list, dict]:
    """Expectation-maximisation. counts: (kind, votes) -> number. Returns for each labeler P(vote | label), and for each
    pattern its probability of being personal data. It starts from the share of positive votes."""
    post = {p: (1 + sum(v > 0 for v in p[1])) / (2 + sum(v != 0 for v in p[1])) for p in counts}
    tables: list = []
    for _ in range(rounds if counts else 0):
        tables = []
        for f in range(len(VOTES)):
            table = {(y, v): 1.0 + (1.0 if (v > 0) == bool(y) and v else 0.0) for y in (0, 1) for v in (-1, 0, 1)}
            for (kind, votes), c in counts.items():
                for y in (0, 1):
                    table[y, votes[f]] += c * (post[kind, votes] if y else 1 - post[kind, votes])
            for y in (0, 1):
                total = sum(table[y, v] for v in (-1, 0, 1))
                for v in (-1, 0, 1):
                    table[y, v] /= total
            tables.append(table)
        share: dict = {}
        for (kind, votes), c in counts.items():
            a, b = share.get(kind, (1.0, 2.0))
            share[kind] = (a + c * post[kind, votes], b + c)
        for kind, votes in counts:
            p = share[kind][0] / share[kind][1]
            yes, no = math.log(p), math.log(1 - p)
            for f, v in enumerate(votes):
                yes, no = yes + math.log(tables[f][1, v]), no + math.log(tables[f][0, v])
            post[kind, votes] = 1 / (1 + math.exp(min(700.0, no - yes)))
    return tables, post


def names(row: dict) -> list[str]:
    """The features of a pattern that are on."""
    return ["bias", f"kind={row['kind']}", f"shape={row['shape']}", f"mixed={row['mixed']}", *(f"{v}={row[v]}" for v in VOTES)]


def classifier(rows: list[dict], post: dict, rounds: int = 300, rate: float = 1.0, decay: float = 1e-3) -> dict:
    """Logistic regression on the posteriors, over the distinct patterns weighted by their numbers."""
    weights: dict = {}
    total = sum(r["n"] for r in rows) or 1
    seen: dict = {}
    for r in rows:
        for f in names(r):
            seen[f] = seen.get(f, 0) + r["n"] / total
    for _ in range(rounds):
        slope: dict = {}
        for r in rows:
            on = names(r)
            z = sum(weights.get(f, 0.0) for f in on)
            miss = post[r["kind"], tuple(r[v] for v in VOTES)] - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            for f in on:
                slope[f] = slope.get(f, 0.0) + miss * r["n"] / total
        for f, g in slope.items():
            weights[f] = weights.get(f, 0.0) * (1 - decay) + rate * g / (0.25 * len(VOTES) * 2 * seen[f])
    return weights


def probability(weights: dict) -> Column:
    z = F.lit(weights.get("bias", 0.0))
    for col in ("kind", "shape", "mixed", *VOTES):
        for f, w in sorted(weights.items()):
            if f.startswith(f"{col}="):
                z = z + F.when(F.col(col).cast("string") == f.split("=", 1)[1], F.lit(w)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def spans(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, digest, kind, start, stop, probability: all spans of personal data."""
    found = written(voted(candidates(docs)).drop("match", "before", "edge"), "pii")
    pattern = ["kind", *VOTES, "shape", "mixed"]
    rows = [r.asDict() for r in found.groupBy(*pattern).agg(F.count(F.lit(1)).alias("n")).sort(*pattern).collect()]  # bounded, see above
    counts: dict = {}
    for r in rows:
        key = (r["kind"], tuple(r[v] for v in VOTES))
        counts[key] = counts.get(key, 0) + r["n"]
    weights = classifier(rows, reliabilities(counts)[1])
    scored = found.withColumn("probability", probability(weights))
    return scored.filter(F.col("kind").isin(BASE) | (F.col("probability") >= least)).select("doc_id", "digest", "kind", "start", "stop", "probability")


def judge(docs: DataFrame) -> DataFrame:
    """One row a document: numbers by base kind, base_sha256 and spans (`kind:start:end`, comma-joined)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    order = F.element_at(F.create_map(*[F.lit(x) for k, i in zip(KINDS, range(len(KINDS))) for x in (k, i)]), F.col("kind"))
    one = F.struct(order.alias("o"), "start", "stop", "kind")
    by_doc = spans(docs).groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set(one)).alias("s"))
    by_doc = by_doc.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), "s")
    out = docs.select("doc_id", F.xxhash64(text).alias("digest")).join(by_doc, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left")
    found = F.coalesce(F.col("s"), F.array().cast("array<struct<o:int,start:int,stop:int,kind:string>>"))
    out = out.select("doc_id", found.alias("s"))
    said = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    number = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return out.select("doc_id", *[number(k) for k in BASE], F.sha2(said(F.filter("s", lambda x: x["o"] < len(BASE))), 256).alias("base_sha256"), said(F.col("s")).alias("spans"))


def masked(text: Column, found: Column, last: Column) -> Column:
    """The text with each span replaced by `<KIND>`. found: array of (start, stop, kind, upto), sorted, where upto is the largest
    stop before the span, so that a span that overlaps an earlier one only removes what is left of it; last: the largest stop.

    Pieces are cut from blocks of SLICE code points, as cutting them from the whole would walk it from its start each time."""

    def piece(blocks, a, b):
        at = F.sequence(F.floor(a / SLICE).cast("int"), F.floor((b - 1) / SLICE).cast("int"))
        low = lambda k: F.greatest(a - k * SLICE, F.lit(0)) + 1
        inner = F.transform(at, lambda k: F.substr(F.get(blocks, k), low(k), F.least(b - k * SLICE, F.lit(SLICE)) - low(k) + 1))
        return F.when(b > a, F.array_join(inner, "")).otherwise(F.lit(""))

    def label(s):
        return F.when(s["start"] >= s["upto"], F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(F.lit(""))

    def joined(blocks):
        said = F.transform(found, lambda s: F.concat(piece(blocks, s["upto"], s["start"]), label(s)))
        return F.concat(F.array_join(said, ""), piece(blocks, last, F.char_length(text)))

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{SLICE}}}"), F.lit(0)), joined)


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with their spans masked and n_chars set anew; all columns, in order."""
    key = ["doc_id", "digest"]
    upto = Window.partitionBy(*key).orderBy("start", "stop", "kind").rowsBetween(Window.unboundedPreceding, -1)
    with scratch() as keep:
        found = spans(docs).select(*key, "start", "stop", "kind").distinct().withColumn("upto", F.coalesce(F.max("stop").over(upto), F.lit(0)))
        by_doc = found.groupBy(F.col("doc_id").alias("its_id"), F.col("digest").alias("its_digest")).agg(F.sort_array(F.collect_list(F.struct("start", "stop", "kind", "upto"))).alias("found"), F.max("stop").alias("last"))
        by_doc = written(by_doc, "masks")
        keep(by_doc)
    keyed = boxed(docs, id=F.col("doc_id"), digest=F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    few = (by_doc.agg(F.sum(F.size("found"))).first()[0] or 0) <= BROADCAST_SPANS  # then no text is shuffled
    out = keyed.join(F.broadcast(by_doc) if few else by_doc, F.col("id").eqNullSafe(F.col("its_id")) & (F.col("digest") == F.col("its_digest")), "left")
    body = F.col("row.text")
    text = F.when(F.col("found").isNull(), body).otherwise(masked(body, F.col("found"), F.col("last")))
    return unboxed(out, docs, text=text, n_chars=F.char_length(text))
