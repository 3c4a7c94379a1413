"""Licence scan with an Aho-Corasick automaton and a parser of licence expressions.

One automaton over the lower-cased words of a text, joined by single blanks, finds the notice phrases; its hits are whole words
because each phrase is looked up with a blank at both ends. A second one over the lower-cased text finds identifier tags
(`SPDX-License-Identifier:`). What follows a tag, up to the end of the line, of the comment or the next tag, is read by a
shunting-yard parser with the operators `and`, `or` and `with` (`with` binds tightest, then `and`, then `or`) and evaluated to the
licences that bind: `or` takes the less restrictive side (of equals the left one), `and` joins both sides, `with` relaxes the
licence on its left by one step. An expression that cannot be read counts by its known identifiers, all of them together.

Labels: those of the base phrases, of the method's own phrases, for each expression `spdx:<id>` for the licences that it comes
down to, and `terms:<class>` for the strictest of them. score: 1 - prod(1 - w) over the distinct labels of phrases (w = 0.6) and
licences (w = 0.5 + 0.1 x restriction, 0.5 for those of an expression that cannot be read): how sure it is that terms bind the
text; 0 without labels.

Defined results: null text is empty; repeated rows keep their own output row; a null doc_id is kept; phrases that overlap count
each; very long texts and texts of many tags are scanned whole, in proportion to their length; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: The method's own phrases.
MORE = {
    "lesser general public license": "lgpl", "library general public license": "lgpl", "affero general public license": "agpl", "mozilla public license": "mpl",
    "eclipse public license": "epl", "european union public licence": "eupl", "common development and distribution license": "cddl", "microsoft public license": "ms-pl",
    "bsd license": "bsd", "redistribution and use in source and binary forms": "bsd", "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute": "isc", "isc license": "isc", "zlib license": "zlib", "boost software license": "bsl", "python software foundation license": "psf",
    "artistic license": "artistic", "academic free license": "afl", "open software license": "osl", "open font license": "ofl", "server side public license": "sspl",
    "business source license": "busl", "elastic license": "elastic", "creative commons": "cc", "licensed under cc by": "cc", "open database license": "odbl",
    "gnu free documentation license": "gfdl", "public domain": "public-domain", "do what the fuck you want to": "wtfpl", "all rights reserved": "proprietary",
    "proprietary and confidential": "proprietary", "the unlicense": "unlicense",
}
TAG = "spdx-license-identifier:"
#: Identifiers by how much they restrict: 0 none, 1 notice, 2 file copyleft, 3 copyleft, 4 network copyleft.
CLASSES = ["none", "notice", "file-copyleft", "copyleft", "network-copyleft"]
BY_CLASS = [
    "0bsd cc0-1.0 unlicense wtfpl mit-0 blueoak-1.0.0 pddl-1.0",
    """mit isc zlib libpng bsl-1.0 apache-1.1 apache-2.0 bsd-2-clause bsd-3-clause bsd-4-clause bsd-3-clause-clear cc-by-3.0 cc-by-4.0 python-2.0 psf-2.0
    postgresql ncsa x11 curl openssl php-3.01 ruby artistic-1.0 artistic-2.0 afl-3.0 ms-pl ofl-1.1 unicode-3.0 w3c vim odc-by-1.0""",
    """mpl-1.1 mpl-2.0 epl-1.0 epl-2.0 cddl-1.0 cddl-1.1 ms-rl lgpl-2.0 lgpl-2.1 lgpl-3.0 lgpl-2.0-only lgpl-2.0-or-later lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0-only
    lgpl-3.0-or-later""",
    """gpl-1.0-only gpl-1.0-or-later gpl-2.0 gpl-3.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0-only gpl-3.0-or-later cc-by-sa-3.0 cc-by-sa-4.0 eupl-1.1 eupl-1.2 cecill-2.1
    gfdl-1.3-only gfdl-1.3-or-later odbl-1.0 qpl-1.0 sleepycat""",
    "agpl-3.0 agpl-3.0-only agpl-3.0-or-later osl-3.0 sspl-1.0 busl-1.1 cpal-1.0",
]
IDS = {i: level for level, ids in enumerate(BY_CLASS) for i in ids.split()}
BINDS = {"or": 1, "and": 2, "with": 3}
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
NOT_WORD = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard. Raises ValueError where the tokens are no expression."""
    out, stack, operand = [], [], True
    for t in tokens:
        if t == "(" and operand:
            stack.append(t)
        elif t == ")" and not operand:
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ValueError("unmatched )")
            stack.pop()
        elif t in BINDS and not operand:
            while stack and stack[-1] != "(" and BINDS[stack[-1]] >= BINDS[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = True
        elif operand and t not in BINDS and t not in "()":
            out.append(t)
            operand = False
        else:
            raise ValueError(f"{t} is out of place")
    if operand or "(" in stack:
        raise ValueError("incomplete")
    return out + stack[::-1]


def evaluated(expression: str) -> tuple[dict[str, int], bool]:
    """The licences that a licence expression comes down to, with how much each restricts, and whether it could be read."""
    tokens = re.findall(r"[()]|[a-z0-9][a-z0-9.+-]*", expression)
    try:
        stack: list = []
        for t in postfix(tokens):
            if t not in BINDS:
                stack.append({t: IDS[t]} if t in IDS else {})
                continue
            right, left = stack.pop(), stack.pop()
            if t == "with":
                stack.append({k: max(0, v - 1) for k, v in left.items()})
            elif t == "and":
                stack.append(left | {k: max(v, left.get(k, 0)) for k, v in right.items()})
            else:
                known = [x for x in (left, right) if x]
                stack.append(min(known, key=lambda x: max(x.values()), default={}))
        return stack[0], True
    except ValueError:
        return {t: IDS[t] for t in tokens if t in IDS}, False


def automata():
    import ahocorasick

    phrases = ahocorasick.Automaton()
    for p, label in (PHRASES | MORE).items():
        phrases.add_word(f" {p} ", (p, label))
    phrases.make_automaton()
    tags = ahocorasick.Automaton()
    tags.add_word(TAG, TAG)
    tags.make_automaton()
    return phrases, tags


def expression_after(text: str, at: int, stop: int) -> str:
    """What follows a tag, up to the end of the line, what ends a comment, or stop."""
    for end in ("\n", "*/", "-->"):
        if (found := text.find(end, at, stop)) >= 0:
            stop = found
    return text[at:stop].strip()


def scanned(text: bytes | None, phrases, tags) -> dict:
    """n_words, base (label and first word of each base place), labels and the restriction of the strictest expression."""
    low = (text or b"").translate(LOWER)
    joined = NOT_WORD.sub(b" ", low).strip(b" ")
    n_words = joined.count(b" ") + 1 if joined else 0
    flat = f" {joined.decode()} " if joined else ""
    n_base, first, last, base, weights = 0, None, None, set(), {}
    for end, (phrase, label) in phrases.iter(flat) if flat else ():
        if phrase in PHRASES:
            at = end - len(phrase) - 1
            n_base, first, last = n_base + 1, at if first is None else min(first, at), at if last is None else max(last, at)
            base.add(label)
        weights[label] = 0.6
    strict = None
    if TAG.encode() in low:
        whole = low.decode()
        ends = [end + 1 for end, _ in tags.iter(whole)]
        for at, following in zip(ends, [*ends[1:], None]):
            found, read = evaluated(expression_after(whole, at, len(whole) if following is None else following - len(TAG)))
            for i, level in found.items():
                weights[f"spdx:{i}"] = max(weights.get(f"spdx:{i}", 0.0), 0.5 + 0.1 * level * read)
            if found:
                strict = max([*found.values(), *([] if strict is None else [strict])])
    miss = 1.0
    for label in sorted(weights):
        miss *= 1 - weights[label]
    labels = {*weights, *([] if strict is None else [f"terms:{CLASSES[strict]}"])}
    word = lambda at: None if at is None else flat.count(" ", 0, at + 1) - 1
    return {
        "n_words": n_words, "n_base": n_base, "first_word": word(first), "last_word": word(last), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": 1 - miss,
        "restriction": strict,
    }


FIELDS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "restriction": pa.int64()}


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id and the fields of `scanned`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, tags = automata()
        for batch in batches:
            rows = [scanned(t.as_py(), phrases, tags) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], kind) for k, kind in FIELDS.items())], names=["doc_id", *FIELDS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = {pa.int64(): "bigint", pa.string(): "string", pa.float64(): "double"}
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{k} {names[t]}" for k, t in FIELDS.items()))
