"""Secret scans: all rules in one deterministic automaton, one pass over the bytes.

A rule is a prefix expression and a body class: it matches prefix, then one body byte or more, as many as there are. Its
position automaton (no empty moves) is stepped with threads ordered by age, the oldest first, so the leftmost match wins;
subset construction over all rules at once, over classes of bytes that no rule tells apart, gives the combined automaton;
partition refinement makes it minimal. A pass reports where a rule's body begins and ends; a second automaton, of the
reversed prefix, walks back from there to where the match begins.

Defined results. Null or empty text: no spans. Matches of one rule never overlap, and a match that is too short is
dropped only after it was passed over. Spans of different rules may overlap. Offsets are code points, the end exclusive.
Repeated rows give repeated results; null ids are carried; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import lean, text_of

DIGIT, LOWER, UPPER = frozenset(range(48, 58)), frozenset(range(97, 123)), frozenset(range(65, 91))


def one(*parts: str | frozenset[int]) -> tuple:
    """Any byte of the strings and sets."""
    return ("one", frozenset().union(*(p.encode() if isinstance(p, str) else p for p in parts)))


def cat(*parts: tuple) -> tuple:
    return ("cat", parts)


def alt(*parts: tuple) -> tuple:
    return ("alt", parts)


def opt(part: tuple) -> tuple:
    return ("alt", (part, ("cat", ())))


def star(part: tuple) -> tuple:
    return ("star", part)


def word(s: str, fold: bool = False) -> tuple:
    """The string itself, its ASCII letters in either case if fold."""
    return cat(*(one(c.lower(), c.upper()) if fold else one(c) for c in s))


def turned(e: tuple) -> tuple:
    """The expression of the reversed strings."""
    kind, x = e
    if kind == "one":
        return e
    if kind == "star":
        return (kind, turned(x))
    parts = tuple(turned(p) for p in x)
    return (kind, parts[::-1] if kind == "cat" else parts)


@dataclass(frozen=True)
class Rule:
    """least: body bytes that a match needs to be reported."""

    kind: str
    prefix: tuple
    body: frozenset[int]
    least: int


_VALUE = DIGIT | LOWER | UPPER | frozenset(b"+/_.=-")
_HEX = DIGIT | frozenset(b"abcdef")
_ALNUM = DIGIT | LOWER | UPPER
_GAP, _QUOTE = star(one(" ")), opt(one("\"'"))
_NAME = alt(*(word(w, fold=True) for w in ("password", "passwd", "secret", "token")), cat(word("api", fold=True), opt(one("_")), word("key", fold=True)))

#: The kinds that every scan reports.
BASE = (
    Rule("assign", cat(_NAME, _QUOTE, _GAP, one(":="), _GAP, _QUOTE), _VALUE, 8),
    Rule("access", word("AKIA"), DIGIT | UPPER, 12),
    Rule("hex", cat(*[("one", _HEX)] * 31), _HEX, 1),
)
#: Published shapes of further credentials.
MORE = (
    Rule("github", cat(word("gh"), one("pousr"), word("_")), _ALNUM, 36),
    Rule("slack", cat(word("xox"), one("abprs"), word("-")), _ALNUM | frozenset(b"-"), 20),
    Rule("jwt", word("eyJ"), _ALNUM | frozenset(b"_.-"), 40),
    Rule("pem", cat(word("-----BEGIN "), star(one(UPPER, " ")), word("PRIVATE KEY----")), frozenset(b"-"), 1),
)
RULES = BASE + MORE


class _Positions:
    """Position automaton of an expression: first positions, followers, last positions, and whether it may be empty."""

    def __init__(self, e: tuple):
        self.chars: list[frozenset[int]] = []
        self.follow: list[list[int]] = []
        self.empty, self.first, self.last = self._add(e)

    def _add(self, e: tuple) -> tuple[bool, list[int], list[int]]:
        kind, x = e
        if kind == "one":
            self.chars.append(x)
            self.follow.append([])
            return False, [len(self.chars) - 1], [len(self.chars) - 1]
        if kind == "star":
            _, first, last = self._add(x)
            self._link(last, first)
            return True, first, last
        if kind == "alt":
            got = [self._add(p) for p in x]
            return any(g[0] for g in got), [q for g in got for q in g[1]], [q for g in got for q in g[2]]
        empty, first, last = True, [], []
        for p in x:
            e2, f2, l2 = self._add(p)
            self._link(last, f2)
            first = first + f2 if empty else first
            last = last + l2 if e2 else l2
            empty = empty and e2
        return empty, first, last

    def _link(self, last: Iterable[int], first: Iterable[int]) -> None:
        for p in last:
            self.follow[p] += [q for q in first if q not in self.follow[p]]


def _determinised(start, step, classes: list[int]) -> tuple[list, list[list[int]]]:
    """States in the order of their discovery and, for each, the next state by byte class."""
    seen, states, moves = {start: 0}, [start], []
    for s in states:
        row = []
        for c in classes:
            t = step(s, c)
            if t not in seen:
                seen[t] = len(states)
                states.append(t)
            row.append(seen[t])
        moves.append(row)
    return states, moves


def _minimised(moves: list[list[int]], marks: list) -> tuple[list[list[int]], list, int]:
    """Blocks of states that no input tells apart: their moves and marks, and the block of state 0."""
    block = {m: i for i, m in enumerate(dict.fromkeys(marks))}
    of = [block[m] for m in marks]
    while True:
        keys = [(of[s], *(of[t] for t in row)) for s, row in enumerate(moves)]
        index = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        new = [index[k] for k in keys]
        if len(index) == len(set(of)):
            break
        of = new
    of = new
    members = {}
    for s, b in enumerate(of):
        members.setdefault(b, s)
    return [[of[t] for t in moves[members[b]]] for b in range(len(members))], [marks[members[b]] for b in range(len(members))], of[0]


def _byte_classes(sets: Iterable[frozenset[int]]) -> tuple[list[int], list[int]]:
    """The class of each byte, and one byte of each class."""
    sets = list(dict.fromkeys(sets))
    index: dict = {}
    of = [index.setdefault(tuple(b in s for s in sets), len(index)) for b in range(256)]
    return of, [of.index(i) for i in range(len(index))]


class Automaton:
    """rows[state][byte] is the next row; rows[state][256] has a bit for each rule whose body is being read."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        parts = [_Positions(cat(r.prefix, ("one", r.body))) for r in rules]
        for p in parts:  # the body repeats itself
            p.follow[-1].append(len(p.chars) - 1)
        of, some = _byte_classes(c for p in parts for c in p.chars)

        def step(state: tuple, byte: int) -> tuple:
            return tuple(self._threads(p, threads, byte) for p, threads in zip(parts, state, strict=True))

        states, moves = _determinised(tuple(() for _ in rules), step, some)
        marks = [sum(1 << i for i, (p, t) in enumerate(zip(parts, s, strict=True)) if t and t[-1] == len(p.chars) - 1) for s in states]
        moves, marks, first = _minimised(moves, marks)
        self.transitions = [[row[of[b]] for b in range(256)] for row in moves]
        self.marks, self.first = marks, first
        self.rows = [[] for _ in moves]
        for row, to, mark in zip(self.rows, self.transitions, marks, strict=True):
            row += [self.rows[t] for t in to]
            row.append(mark)
        self.back = [_Backward(turned(r.prefix)) for r in rules]

    @staticmethod
    def _threads(p: _Positions, threads: tuple[int, ...], byte: int) -> tuple[int, ...]:
        """The threads after a byte, the oldest first; none that is younger than one in its body."""
        body, out = len(p.chars) - 1, []
        for sources in (*(p.follow[t] for t in threads), p.first):
            for q in sources:
                if byte in p.chars[q] and q not in out:
                    out.append(q)
            if body in out:
                if out != [body]:
                    raise ValueError("a rule's match may begin while an older one is undecided")
                break
        return tuple(out)

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule's place) of each match in bytes, by start, then rule."""
        row, mark = self.rows[self.first], 0
        begun, passed, out = [0] * len(self.rules), [0] * len(self.rules), []

        def ended(gone: int, at: int) -> None:
            for r, rule in enumerate(self.rules):
                if gone >> r & 1:
                    if at - begun[r] >= rule.least:
                        out.append((self.back[r].start(data, begun[r], passed[r]), at, r))
                    passed[r] = at

        for i, c in enumerate(data):
            row = row[c]
            if row[256] != mark:
                ended(mark & ~row[256], i)
                new, mark = row[256] & ~mark, row[256]
                for r in range(len(self.rules)):
                    if new >> r & 1:
                        begun[r] = i
        ended(mark, len(data))
        return sorted(out, key=lambda s: (s[0], s[2]))


class _Backward:
    """Automaton of a reversed prefix."""

    def __init__(self, e: tuple):
        p = _Positions(e)
        of, some = _byte_classes(p.chars)
        step = lambda s, b: tuple(dict.fromkeys(q for t in s for q in (p.first if t < 0 else p.follow[t]) if b in p.chars[q]))
        states, moves = _determinised((-1,), step, some)
        moves, self.final, self.first = _minimised(moves, [any(t in p.last or t < 0 and p.empty for t in s) for s in states])
        dead = [all(t == s for t in row) and not self.final[s] for s, row in enumerate(moves)]
        self.moves = [[None if dead[row[of[b]]] else row[of[b]] for b in range(256)] for row in moves]

    def start(self, data: bytes, end: int, least: int) -> int:
        """The leftmost start, from least on, of a prefix that ends before end."""
        state, best = self.first, end
        for i in range(end - 1, least - 1, -1):
            state = self.moves[state][data[i]]
            if state is None:
                break
            if self.final[state]:
                best = i
        return best


@lru_cache(maxsize=4)
def automaton(rules: tuple[Rule, ...] = RULES) -> Automaton:
    return Automaton(rules)


def code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans in code points instead of bytes."""
    if not spans or data.isascii():
        return spans
    at, done, place = 0, 0, {}
    for o in sorted({x for s in spans for x in s[:2]}):
        done, at = done + len(data[at:o].decode("utf-8", "replace")), o
        place[o] = done
    return [(place[a], place[b], r) for a, b, r in spans]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end) by start, then as the rules are listed."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(rules)
        for b in batches:
            found = ((t, code_points(t, auto.spans(t))) for t in (x.as_py() for x in b.column(1)))
            spans = pa.array([[{"kind": rules[r].kind, "start": s, "end": e} for s, e, r in got] for _, got in found], pa.list_(_SPAN))
            yield pa.RecordBatch.from_arrays([b.column(0), spans], ["doc_id", "spans"])

    return docs.select("doc_id", text_of().cast("binary").alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with each found span in text replaced by mark; spans that overlap are replaced as one, null texts stay null."""
    schema, at = docs.schema, docs.columns.index("text")

    def cleaned(text: str | None, auto: Automaton) -> str | None:
        if text is None:
            return None
        data, out, done = text.encode("utf-8", "replace"), [], 0
        for s, e, _ in auto.spans(data):
            if s >= done:
                out += [data[done:s], mark.encode()]
            done = max(done, e)
        return b"".join([*out, data[done:]]).decode()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(rules)
        for b in batches:
            text = pa.array([cleaned(x.as_py(), auto) for x in b.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([text if i == at else b.column(i) for i in range(b.num_columns)], b.schema.names)

    return docs.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """The counts and digests of scan()'s rows."""
    base = F.filter("spans", lambda s: s["kind"].isin(*(r.kind for r in BASE)))
    joined = lambda a: F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(r.kind).alias(f"n_{r.kind}") for r in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
