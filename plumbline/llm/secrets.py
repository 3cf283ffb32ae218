"""Secret scanning with one deterministic automaton for all rules.

Rules are regular expressions over bytes. Their Thompson automata are joined, made deterministic by subset
construction and minimised by partition refinement; the result is one flat transition array that a text
passes once, byte by byte. A second, reversed automaton per rule finds where a match starts, and the rule's
own automaton where it ends, so only the bytes of matches, and those after matches that overlap, are read again.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import text_bytes, with_columns


@dataclass(frozen=True)
class Rule:
    """A match is any_case, head and pattern in a row; each may use literals, classes, groups, |, ?, *, +, {m}, {m,}
    and {m,n}. Letters in any_case stand for both cases."""

    kind: str
    pattern: str
    any_case: str = ""
    head: str = ""
    least: int = 0  # bytes that pattern's part needs, or the match is dropped after it has been consumed


#: The base kinds, in the order in which they are listed.
BASE = (
    Rule("assign", "[A-Za-z0-9+/_.=-]+", "(password|passwd|secret|token|api_?key)", r"""["']?\x20*[:=]\x20*["']?""", least=8),
    Rule("access", "AKIA[A-Z0-9]+", least=16),
    # A run of 8 or more is the whole run, since what ends a run is no hex digit; shorter ones need no look.
    Rule("hex", "[0-9a-f]{8,}", least=32),
)
#: Public formats of credentials, which the method adds. Lengths are checked after the match: counted repeats
#: of several rules would multiply in the joint automaton.
MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("google", "AIza[A-Za-z0-9_-]+", least=39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
    Rule("pem", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
)


class _Parser:
    """A pattern as a Thompson automaton: edges by bytes, and empty edges."""

    def __init__(self, pattern: str, any_case: bool, nfa: _Nfa):
        self.p, self.i, self.any_case, self.nfa = pattern, 0, any_case, nfa

    def parse(self):
        tree = self.either()
        if self.i != len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} at {self.i} of {self.p!r}")
        return tree

    def either(self):
        options = [self.sequence()]
        while self.i < len(self.p) and self.p[self.i] == "|":
            self.i += 1
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("either", options)

    def sequence(self):
        parts = []
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            parts.append(self.repeated())
        return ("sequence", parts)

    def repeated(self):
        unit = self.unit()
        while self.i < len(self.p) and self.p[self.i] in "?*+{":
            c = self.p[self.i]
            if c == "{":
                end = self.p.index("}", self.i)
                low, _, high = self.p[self.i + 1 : end].partition(",")
                least = int(low)
                most = (int(high) if high else None) if "," in self.p[self.i : end] else least
                self.i = end + 1
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
                self.i += 1
            unit = ("repeat", unit, least, most)
        return unit

    def unit(self):
        c = self.p[self.i]
        if c == "(":
            self.i += 1
            tree = self.either()
            self.i += 1
            return tree
        if c == "[":
            return self.char_class()
        return ("bytes", self.cased({self.one()}))

    def one(self) -> int:
        c = self.p[self.i]
        if c == "\\":
            if self.p[self.i + 1] == "x":
                self.i += 4
                return int(self.p[self.i - 2 : self.i], 16)
            self.i += 2
            return ord(self.p[self.i - 1])
        self.i += 1
        return ord(c)

    def char_class(self):
        self.i += 1
        negated = self.p[self.i] == "^"
        self.i += negated
        found: set[int] = set()
        while self.p[self.i] != "]":
            low = self.one()
            if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                found |= set(range(low, self.one() + 1))
            else:
                found.add(low)
        self.i += 1
        return ("bytes", set(range(256)) - found if negated else self.cased(found))

    def cased(self, found: set[int]) -> set[int]:
        return {ord(x) for b in found for x in (chr(b).lower(), chr(b).upper())} if self.any_case else found


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.edges: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.edges.append([])
        return len(self.empty) - 1

    def add(self, tree, start: int, backwards: bool) -> int:
        """Adds what matches tree from start on, and says where it ends."""
        kind = tree[0]
        if kind == "bytes":
            end = self.state()
            self.edges[start].append((frozenset(tree[1]), end))
            return end
        if kind == "sequence":
            for part in reversed(tree[1]) if backwards else tree[1]:
                start = self.add(part, start, backwards)
            return start
        if kind == "either":
            end = self.state()
            for option in tree[1]:
                self.empty[self.add(option, start, backwards)].append(end)
            return end
        _, unit, least, most = tree
        for _ in range(least):
            start = self.add(unit, start, backwards)
        if most is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(unit, loop, backwards)].append(loop)
            return loop
        end = self.state()
        self.empty[start].append(end)
        for _ in range(most - least):
            start = self.add(unit, start, backwards)
            self.empty[start].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


class Automaton:
    """Minimal deterministic automaton: flat[256 * state + byte] is 256 * the next state.

    States that end a match come last, from first_end on; ends[state] are the rules that match there.
    floating: a match may start anywhere; else all matches start where the reading starts.
    """

    def __init__(self, rules: tuple[Rule, ...], floating: bool, backwards: bool = False):
        nfa = _Nfa()
        start, finals = nfa.state(), {}
        for number, rule in enumerate(rules):
            trees = [_Parser(p, p is rule.any_case, nfa).parse() for p in (rule.any_case, rule.head, rule.pattern) if p]
            first = nfa.state()
            nfa.empty[start].append(first)
            finals[nfa.add(("sequence", trees), first, backwards)] = number
        self._build(nfa, nfa.closure([start]), finals, floating)

    def _build(self, nfa: _Nfa, first: frozenset[int], finals: dict[int, int], floating: bool) -> None:
        # Bytes that no edge tells apart are read as one.
        signs: dict[tuple[bool, ...], int] = {}
        kinds = list(dict.fromkeys(by for edges in nfa.edges for by, _ in edges))
        alike = [signs.setdefault(tuple(b in by for by in kinds), len(signs)) for b in range(256)]
        of = {by: {alike[b] for b in by} for by in kinds}
        number, todo, table, ends = {first: 0}, deque([first]), [], []
        while todo:  # subset construction
            states = todo.popleft()
            ends.append(tuple(sorted({finals[s] for s in states if s in finals})))
            reach: dict[int, set[int]] = {}
            for s in states | first if floating else states:
                for by, to in nfa.edges[s]:
                    for b in of[by]:
                        reach.setdefault(b, set()).add(to)
            row, known = [], {}
            for b in range(len(signs)):
                to = frozenset(reach.get(b, ()))
                if to not in known:
                    known[to] = nfa.closure(to | first if floating else to)
                    if known[to] not in number:
                        number[known[to]] = len(number)
                        todo.append(known[to])
                row.append(number[known[to]])
            table.append(row)
        group = {e: i for i, e in enumerate(dict.fromkeys(ends))}
        block = [group[e] for e in ends]
        count = len(group)
        while True:  # minimisation: states stay together while all their successors do
            seen: dict[tuple, int] = {}
            block = [seen.setdefault((block[i], *(block[t] for t in table[i])), len(seen)) for i in range(len(table))]
            if len(seen) == count:
                break
            count = len(seen)
        # The start is state 0; states that end matches are last.
        order = sorted(set(block), key=lambda b: (bool(ends[block.index(b)]), b != block[0], b))
        place = {b: i for i, b in enumerate(order)}
        self.start = 256 * place[block[0]]
        self.flat, self.ends, self.size = array("i", [0]) * (256 * len(order)), [()] * len(order), len(order)
        for i, row in enumerate(table):
            at = place[block[i]]
            self.ends[at] = ends[i]
            self.flat[256 * at : 256 * at + 256] = array("i", [256 * place[block[row[b]]] for b in alike])
        self.first_end = 256 * next((i for i, e in enumerate(self.ends) if e), len(order))
        dead = [i for i in range(self.size) if not self.ends[i] and all(t == 256 * i for t in self.flat[256 * i : 256 * i + 256])]
        self.dead = 256 * dead[0] if dead else -1


class SecretScanner:
    """Leftmost, longest, non-overlapping matches of each rule.

    Needed of a rule: when a match of it first ends, none that starts further left is still open. That holds
    if a match's start can't be part of another match's part before its first end, as with the rules here.

    The joint automaton also ends matches that overlap the one found last. On the first of these the rule's own
    automaton reads on from there once, and says where the next match ends; up to that place the joint one isn't
    asked again. So for each rule a byte is read a bounded number of times, whatever the text.
    """

    def __init__(self, rules: tuple[Rule, ...] = BASE + MORE):
        self.rules = rules
        self.all = Automaton(rules, floating=True)
        self.alone = [Automaton((r,), floating=True) for r in rules]
        self.forwards = [Automaton((r,), floating=False) for r in rules]
        self.backwards = [Automaton((r,), floating=False, backwards=True) for r in rules]
        self.heads = [Automaton((Rule("", r.head, r.any_case),), floating=False) if r.head else None for r in rules]

    def _extent(self, rule: int, data: bytes, end: int, low: int) -> tuple[int, int] | None:
        """The match of which the first end is known; None if it would start before low."""
        auto, state, start = self.backwards[rule], self.backwards[rule].start, -1
        for at in range(end - 1, low - 1, -1):
            state = auto.flat[state + data[at]]
            if state == auto.dead:
                break
            if state >= auto.first_end:
                start = at
        if start < 0:
            return None
        return start, self._reach(self.forwards[rule], data, start)

    @staticmethod
    def _reach(auto: Automaton, data: bytes, start: int) -> int:
        """The end of the longest match that starts there."""
        state, end = auto.start, start
        for at in range(start, len(data)):
            state = auto.flat[state + data[at]]
            if state == auto.dead:
                break
            if state >= auto.first_end:
                end = at + 1
        return end

    def _holds(self, rule: int, data: bytes, start: int, end: int) -> bool:
        head = self.heads[rule]
        return end - (self._reach(head, data, start) if head else start) >= self.rules[rule].least

    def _first_end(self, rule: int, data: bytes, start: int) -> int:
        """Where the first match that starts at start or later ends; past the data if there is none."""
        auto = self.alone[rule]
        state = auto.start
        for at in range(start, len(data)):
            state = auto.flat[state + data[at]]
            if state >= auto.first_end:
                return at + 1
        return len(data) + 1

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, by start, then by rule."""
        flat, state, first_end, ends = self.all.flat, self.all.start, self.all.first_end, self.all.ends
        # Of each rule, the end of the last match, and an end before which no further match ends.
        done, least, found = [0] * len(self.rules), [0] * len(self.rules), []
        for at, byte in enumerate(data):
            state = flat[state + byte]
            if state >= first_end:
                for rule in ends[state >> 8]:
                    if at >= done[rule] and at + 1 >= least[rule]:
                        span = self._extent(rule, data, at + 1, done[rule])
                        if span:
                            done[rule] = span[1]
                            if self._holds(rule, data, *span):
                                found.append((span[0], rule, span[1]))
                        else:
                            least[rule] = self._first_end(rule, data, done[rule])
        return sorted(found)


def in_code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of bytes as spans of characters."""
    if len(data) < 1 or not spans or data.isascii():
        return spans
    cuts = sorted({x for s, _, e in spans for x in (s, e)})
    place, so_far, last = {}, 0, 0
    for cut in cuts:
        so_far += len(data[last:cut].decode())
        place[cut], last = so_far, cut
    return [(place[s], r, place[e]) for s, r, e in spans]


def scan_documents(docs: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """Per document: the number of spans of each base rule, the digest of the base spans, and all spans as text.

    A span is kind:start:end in code points, the end not included; spans are joined by commas, by start and then
    as the rules are listed. A null or empty text has no spans. Time is linear in the length of a text. Rows are independent: repeated rows give repeated
    rows, a null doc_id stays null, other columns are left out.
    """
    rules, n = base + more, len(base)
    # Compiled once, on the driver; the size depends on the rules only.
    sent = docs.sparkSession.sparkContext.broadcast(SecretScanner(rules))
    counts = [f"n_{r.kind}" for r in base]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = sent.value
        for ids, texts in with_columns(batches):
            rows = []
            for doc, data in zip(ids, texts, strict=True):
                spans = in_code_points(data, scan.spans(data))
                said = [(r, f"{rules[r].kind}:{s}:{e}") for s, r, e in spans]
                plain = ",".join(x for r, x in said if r < n)
                rows.append((doc, *(sum(r == k for r, _ in said) for k in range(n)), hashlib.sha256(plain.encode()).hexdigest(), ",".join(x for _, x in said)))
            types = [pa.int64()] * (n + 1) + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", *counts, "base_sha256", "spans"])

    schema = f"doc_id long, {', '.join(f'{c} long' for c in counts)}, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(run, schema)
