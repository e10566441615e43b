"""Licence scans: an Aho-Corasick automaton over words finds notice phrases and identifier tags; the expression that
follows a tag is evaluated by a shunting-yard parser.

Words are runs of 0-9, a-z and non-ASCII bytes after lower-casing A-Z. Only stretches of words that some phrase has go
through the automaton. Each document is scanned where it is read: no shuffle.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C

#: The phrases whose places are counted, and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Further notice phrases and their labels.
NOTICE_PHRASES = {
    "affero general public license": "agpl",
    "apache license": "apache",
    "boost software license": "bsl",
    "bsd license": "bsd",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "creative commons attribution": "cc-by",
    "eclipse public license": "epl",
    "isc license": "isc",
    "lesser general public license": "lgpl",
    "mit license": "mit",
    "mozilla public license": "mpl",
    "no rights reserved": "public-domain",
    "permission is hereby granted free of charge": "mit",
    "public domain": "public-domain",
    "redistribution and use in source and binary forms": "bsd",
    "unlicense": "unlicense",
}
#: The words of the identifier tag; an expression follows it in the text.
TAG = "spdx license identifier"
_WORD, _LINE = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[ \t]*:?[ \t]*([^\r\n]*)")
#: An expression's tokens. A slash right between two identifiers means or, as older notices have it.
_TOKEN = re.compile(r"[()]|(?<=[0-9a-z.+)-])/(?=[0-9a-z(])|[0-9a-z.+-]+")

#: How freely text under a licence may be used, 0 to 1, by the beginning of its identifier; the longest one counts.
FREEDOM = {
    "agpl": 0.3, "apache": 0.9, "boost": 1.0, "bsd": 0.9, "bsl": 0.9, "cc-by": 0.8, "cc-by-nc": 0.2, "cc-by-nd": 0.2, "cc-by-sa": 0.6, "cc0": 1.0, "epl": 0.6,
    "gpl": 0.4, "isc": 0.9, "lgpl": 0.5, "mit": 0.9, "mpl": 0.6, "public-domain": 1.0, "reserved": 0.0, "unlicense": 1.0,
}
#: For a licence that is not known, and for a text without any notice.
UNKNOWN, NO_NOTICE = 0.1, 0.5
#: What an exception (WITH) adds.
EXCEPTION = 0.1


def freedom(name: str) -> float:
    known = [k for k in FREEDOM if name == k or name.startswith(k + "-")]
    return FREEDOM[max(known, key=len)] if known else UNKNOWN


def parse_expression(text: str) -> tuple[list[str], float] | None:
    """Identifiers and freedom of a licence expression (identifiers, and, or, with, parentheses), None if it is none.

    with binds closest, then and, then or. and: all must hold, the least freedom counts; or: one may choose, the most.
    An expression before with gets the exception on each of its identifiers, and each identifier of one behind it counts.
    The expression ends where the text stops to be one.
    """
    out: list[tuple[list[str], float]] = []
    waiting: list[str] = []
    order = {"with": 3, "and": 2, "or": 1}

    def apply() -> None:
        op, right, left = waiting.pop(), out.pop(), out.pop()
        if op == "with":
            out.append(([f"{a} with {b}" for a in left[0] for b in right[0]], min(1.0, left[1] + EXCEPTION)))
        else:
            out.append((left[0] + right[0], (min if op == "and" else max)(left[1], right[1])))

    operand = True  # whether one is due
    for token in _TOKEN.findall(text.lower()):
        token = "or" if token == "/" else token
        if operand:
            if token == "(":
                waiting.append(token)
            elif token in order or token == ")":
                break
            else:
                name = token.strip(".")
                out.append(([name.removesuffix("-only").removesuffix("-or-later").rstrip("+")], freedom(name)))
                operand = False
        elif token == ")":
            if "(" not in waiting:
                break
            while waiting[-1] != "(":
                apply()
            waiting.pop()
        elif token in order:
            while waiting and waiting[-1] != "(" and order[waiting[-1]] >= order[token]:
                apply()
            waiting.append(token)
            operand = True
        else:
            break
    if operand and waiting and waiting[-1] != "(":
        waiting.pop()  # an operator without a right side
    while waiting:
        if waiting[-1] == "(":
            waiting.pop()
        elif len(out) > 1:
            apply()
        else:
            waiting.pop()
    return out[-1] if out else None


class Automaton:
    """Aho-Corasick over small integers: step(state, word) and the patterns that end in each state."""

    def __init__(self, patterns: list[tuple[int, ...]]):
        self.next: list[dict[int, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for number, pattern in enumerate(patterns):
            state = 0
            for word in pattern:
                if word not in self.next[state]:
                    self.next[state][word] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                state = self.next[state][word]
            self.ends[state].append(number)
        self.fail = [0] * len(self.next)
        queue = deque(self.next[0].values())
        while queue:
            state = queue.popleft()
            for word, after in self.next[state].items():
                self.fail[after] = self.step(self.fail[state], word)
                self.ends[after] += self.ends[self.fail[after]]
                queue.append(after)

    def step(self, state: int, word: int) -> int:
        while word not in self.next[state] and state:
            state = self.fail[state]
        return self.next[state].get(word, 0)


class Scanner:
    def __init__(self, phrases: list[str]):
        self.phrases = [p.split() for p in phrases]
        words = sorted({w for p in self.phrases for w in p})
        (_, _, h, _), = C.hashed(pa.array([" ".join(words).encode()], pa.binary()), True, C.MARKS)
        number = {w: i for i, w in enumerate(words)}
        self.automaton = Automaton([tuple(number[w] for w in p) for p in self.phrases])
        self.order = np.argsort(h)
        self.known = h[self.order]

    def hits(self, h: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, word at which the phrase begins, phrase) of every place, over the hashed words of rows."""
        if not len(h):
            return []
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        place = np.flatnonzero(self.known[at] == h)
        ends = np.cumsum(sizes)
        row = np.searchsorted(ends, place, side="right")
        begin = (ends - sizes)[row]
        word = self.order[at[place]]
        found, state, before, row_before = [], 0, -2, -1
        step, final, phrases = self.automaton.step, self.automaton.ends, self.phrases
        for p, r, b, w in zip(place.tolist(), row.tolist(), begin.tolist(), word.tolist()):
            state = step(state if p == before + 1 and r == row_before else 0, w)
            before, row_before = p, r
            for k in final[state]:
                found.append((r, p - len(phrases[k]) + 1 - b, k))
        return found


def _outermost(hits: list[tuple[int, int]], phrases: list[list[str]]) -> set[int]:
    """Phrases with a place (first word, phrase) that no longer phrase's place holds."""
    spans = sorted({(p, -p - len(phrases[k]), k) for p, k in hits})
    out, reach = set(), 0
    for _, end, k in spans:  # of spans that begin no later, has none reached as far?
        if -end > reach:
            out.add(k)
            reach = -end
    return out


def _tagged(text: bytes, places: list[int]) -> Iterator[str]:
    """What stands behind each identifier tag, given the words at which tags begin, ascending: up to the line's end or the next
    tag. One pass over the words."""
    n = len(TAG.split())
    wanted = {*places, *(p + n - 1 for p in places)}
    spans = {i: m.span() for i, m in enumerate(_WORD.finditer(text)) if i in wanted}
    for p, after in zip(places, [*places[1:], None]):
        end = spans[after][0] if after is not None else len(text)
        yield _LINE.match(text, spans[p + n - 1][1], end)[1].decode(errors="replace").strip()


COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions of each row.

    A null or empty text has no words and no labels. score is the freedom of all that was found taken together (and),
    NO_NOTICE if nothing was; a phrase inside a longer one gives its label, but the longer one's freedom counts.
    expressions: those after identifier tags, in order, each up to its line's end or the next tag. Labels of an expression are its identifiers. Extra columns are
    ignored.
    """
    phrases = [*BASE_PHRASES, *NOTICE_PHRASES, TAG]
    labels = [*BASE_PHRASES.values(), *NOTICE_PHRASES.values(), None]
    base = len(BASE_PHRASES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases)
        for batch in batches:
            text = batch.column(1)
            for a, b, h, sizes in C.hashed(text, True, C.MARKS):
                n = b - a
                count = np.zeros(n, np.int64)
                first, last, base_labels, all_labels, score = ([None] * n, [None] * n, [""] * n, [""] * n, [NO_NOTICE] * n)
                expressions: list[list[str]] = [[] for _ in range(n)]
                by_row: dict[int, list[tuple[int, int]]] = {}
                for r, p, k in scanner.hits(h, sizes):
                    by_row.setdefault(r, []).append((p, k))
                for r, hits in by_row.items():
                    places = [p for p, k in hits if k < base]
                    if places:
                        count[r], first[r], last[r] = len(places), min(places), max(places)
                    base_labels[r] = ",".join(sorted({labels[k] for _, k in hits if k < base}))
                    names = {labels[k] for _, k in hits} - {None}
                    worth = [freedom(labels[k]) for k in _outermost(hits, scanner.phrases) if labels[k]]
                    if tags := sorted(p for p, k in hits if labels[k] is None):
                        for expression in _tagged((text[a + r].as_py() or b"").lower(), tags):
                            if got := parse_expression(expression):
                                names |= set(got[0])
                                worth.append(got[1])
                                expressions[r].append(expression)
                    all_labels[r] = ",".join(sorted(names))
                    if worth:
                        score[r] = min(worth)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, n), pa.array(sizes.astype(np.int64)), pa.array(count), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(base_labels), pa.array(all_labels), pa.array(score, pa.float64()), pa.array(expressions, pa.list_(pa.string()))],
                    ["doc_id", *(x.split()[0] for x in COLUMNS.split(", "))],
                )

    return C.as_bytes(docs, "doc_id").mapInArrow(run, f"doc_id long, {COLUMNS}")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(C.table(spark, sf_dir, "documents"))


BASE_COLUMNS = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def op3_license_scan_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3_license_scan that SQL can tell."""
    return op3_license_scan(spark, sf_dir).select(*BASE_COLUMNS)


ORACLE_BASE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
h AS (
  SELECT doc_id, 'cc-by' AS label, unnest(list_filter(range(1, len(ws) + 1), lambda i: ws[i] = 'cc' AND ws[i + 1] = 'by')) - 1 AS i FROM w
  UNION ALL SELECT doc_id, 'gpl', unnest(list_filter(range(1, len(ws) + 1), lambda i: ws[i] = 'general' AND ws[i + 1] = 'public' AND ws[i + 2] = 'license')) - 1 FROM w
  UNION ALL SELECT doc_id, 'reserved', unnest(list_filter(range(1, len(ws) + 1), lambda i: ws[i] = 'all' AND ws[i + 1] = 'rights' AND ws[i + 2] = 'reserved')) - 1 FROM w),
g AS (SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM h GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, coalesce(labels, '') AS base_labels FROM w LEFT JOIN g USING (doc_id)
"""
