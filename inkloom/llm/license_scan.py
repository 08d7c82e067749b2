"""License scan: phrases and identifier tags by Aho-Corasick, expressions by shunting-yard.

A text is lower-cased (A-Z), cut into words of ASCII letters and digits and of all other
characters beyond ASCII, and written as one string with single spaces. One automaton over that
string finds all phrases in a single pass: the phrases that name a licence (``BASE``), notice phrases
(``NOTICES``), and identifier tags. Behind a tag, the rest of the line in the original text is read
as a licence expression. ``with`` binds tightest, then ``and``, then ``or``; the parser turns it into
postfix and evaluates it to the licences named and to a score: ``and`` takes the lower, ``or`` the
higher score of its sides. What cannot be parsed, or is not in ``OPENNESS``, counts as
``UNKNOWN``; a malformed expression still yields the licences that it names.

The score of a document says how freely it may be reused: the lowest over all its findings, 1 for
permissive, 0 where a notice forbids reuse or nothing is found.

Null and empty texts have no words, no places and null places of words. Texts are read whole; rows
are independent, so repeated rows repeat their result; other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.common import map_rows, slices

# Fixed values of the query's contract: phrase and label.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Notice phrases and the identifier that each stands for.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license": "apache-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl-2.0",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons attribution": "cc-by",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
TAGS = ["spdx license identifier", "license expression"]
# How freely texts under a licence may be reused.
OPENNESS = {
    "mit": 1.0, "isc": 1.0, "bsd": 1.0, "bsd-2-clause": 1.0, "bsd-3-clause": 1.0, "0bsd": 1.0,
    "zlib": 1.0, "unlicense": 1.0, "public-domain": 1.0, "cc0-1.0": 1.0, "apache-2": 1.0,
    "apache-2.0": 1.0, "cc-by": 0.9, "cc-by-4.0": 0.9, "mpl-2.0": 0.7, "lgpl": 0.6,
    "lgpl-2.1": 0.6, "lgpl-3.0": 0.6, "cc-by-sa-4.0": 0.6, "gpl": 0.5, "gpl-2.0": 0.5,
    "gpl-3.0": 0.5, "agpl": 0.4, "agpl-3.0": 0.4, "cc-by-nc": 0.2, "cc-by-nc-4.0": 0.2,
    "all-rights-reserved": 0.0,
}
UNKNOWN = 0.3
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TOKEN = re.compile(r"\(|\)|[a-z0-9][a-z0-9.+:_-]*")
_BINDING = {"or": 1, "and": 2, "with": 3}
SLICE = 4 << 20


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard; unbalanced parentheses are closed or ignored."""
    out: list[str] = []
    held: list[str] = []
    for t in tokens:
        if t == "(":
            held.append(t)
        elif t == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if held:
                held.pop()
        elif t in _BINDING:
            while held and _BINDING.get(held[-1], 0) >= _BINDING[t]:
                out.append(held.pop())
            held.append(t)
        else:
            out.append(t)
    return out + [t for t in reversed(held) if t != "("]


def openness(name: str) -> float:
    plain = re.sub(r"(-only|-or-later|\+)$", "", name)
    return OPENNESS.get(plain, UNKNOWN)


def expression_at(lowered: str, at: int) -> list[str]:
    """Tokens of the expression at ``at``; two names in a row, or the line's end, end it."""
    stop = lowered.find("\n", at)
    tokens: list[str] = []
    for m in _TOKEN.finditer(lowered, at, len(lowered) if stop < 0 else stop):
        name = m.group() not in _BINDING and m.group() not in "()"
        if name and tokens and tokens[-1] not in _BINDING and tokens[-1] != "(":
            break
        tokens.append(m.group())
    return tokens


def evaluate(tokens: list[str]) -> tuple[set[str], float] | None:
    """Licences named in an expression and its score; None if it names none."""
    names = {t.strip(".:") for t in tokens if t not in _BINDING and t not in "()"}
    if not names:
        return None
    stack: list[tuple[set[str], float]] = []
    for t in postfix(tokens):
        if t not in _BINDING:
            stack.append(({t.strip(".:")}, openness(t.strip(".:"))))
        elif len(stack) < 2:
            return names, UNKNOWN
        else:
            (right, y), (left, x) = stack.pop(), stack.pop()
            if t == "with":  # an exception widens the licence that it is attached to
                stack.append(({f"{'+'.join(sorted(left))} with {'+'.join(sorted(right))}"}, x))
            else:
                stack.append((left | right, max(x, y) if t == "or" else min(x, y)))
    return stack[0] if len(stack) == 1 else (names, UNKNOWN)


def _automaton():
    import ahocorasick

    kinds: dict[str, list[tuple[str, str]]] = {}
    for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", dict.fromkeys(TAGS, ""))):
        for phrase, label in phrases.items():
            kinds.setdefault(phrase, []).append((kind, label))
    a = ahocorasick.Automaton()
    for phrase, found in kinds.items():
        a.add_word(f" {phrase} ", (phrase.count(" ") + 1, len(phrase), found))
    a.make_automaton()
    return a


def scan_text(text: str, automaton) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, findings."""
    lowered = text.encode().lower().decode()  # bytes.lower() changes A-Z only
    words = WORD.findall(lowered)
    line = f" {' '.join(words)} "
    base, labels, starts, scores, findings = set(), set(), [], [], []
    seen_at, seen_words, ends = 0, 0, []
    for stop, (size, length, found) in automaton.iter(line):
        begin = stop - length - 1  # of the blank before the phrase
        # Ends come in order; starts may step back by less than a phrase.
        if begin >= seen_at:
            seen_words += line.count(" ", seen_at, begin)
            seen_at = begin
            word = seen_words
        else:
            word = seen_words - line.count(" ", begin, seen_at)
        for kind, label in found:
            if kind == "tag":
                ends = ends or [m.end() for m in WORD.finditer(lowered)]
                got = evaluate(expression_at(lowered, ends[word + size - 1]))
                if got is None:
                    continue
                labels |= got[0]
                scores.append(got[1])
                findings.append((word, "expression", ",".join(sorted(got[0]))))
                continue
            labels.add(label)
            scores.append(openness(label))
            findings.append((word, kind, label))
            if kind == "base":
                base.add(label)
                starts.append(word)
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), min(scores, default=0.0), findings)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts, places, labels, score and ``findings`` (word, kind, label) per document."""
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels",
             "score", "findings"]
    finding = pa.list_(pa.struct([("word", pa.int64()), ("kind", pa.string()), ("label", pa.string())]))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(),
             pa.float64(), finding]

    def start():
        automaton = _automaton()

        def work(batch: pa.RecordBatch):
            for part in slices(batch, "text", SLICE):
                rows = [scan_text(t or "", automaton) for t in part.column("text").to_pylist()]
                columns = [list(c) for c in zip(*rows, strict=True)]
                columns[-1] = [[dict(zip(("word", "kind", "label"), f, strict=True)) for f in fs]
                               for fs in columns[-1]]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"),
                     *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

        return work

    schema = ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, "
              "last_word bigint, base_labels string, labels string, score double, "
              "findings array<struct<word:bigint,kind:string,label:string>>")
    return map_rows(docs.select(F.col("doc_id").cast("bigint"), "text"), schema, start)


def query(docs: DataFrame) -> DataFrame:
    return scan(docs).drop("findings")
