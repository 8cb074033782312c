"""Combined deterministic automaton over bytes: regexes to NFA, subset construction, minimisation, flat tables.

Supported syntax: literals, ``\\xHH`` and escaped punctuation, classes ``[a-z]`` and ``[^...]``, groups,
alternation, ``? * +`` and ``{m}``, ``{m,}``, ``{m,n}``. Patterns are over bytes and must be ASCII.
"""

from __future__ import annotations

from dataclasses import dataclass, field

ALL = frozenset(range(256))


class _Parser:
    """Recursive descent to nested tuples: ("set", bytes), ("cat", [..]), ("alt", [..]), ("rep", node, low, high)."""

    def __init__(self, pattern: str) -> None:
        self.p, self.i = pattern, 0

    def parse(self):
        node = self.alt()
        if self.i < len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} at {self.i} in {self.p!r}")
        return node

    def peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def alt(self):
        options = [self.cat()]
        while self.peek() == "|":
            self.i += 1
            options.append(self.cat())
        return options[0] if len(options) == 1 else ("alt", options)

    def cat(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeat())
        return ("cat", parts)

    def repeat(self):
        node = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.i += 1
            if c == "{":
                end = self.p.index("}", self.i)
                low, comma, high = self.p[self.i : end].partition(",")
                self.i = end + 1
                node = ("rep", node, int(low), (int(high) if high else None) if comma else int(low))
            else:
                node = ("rep", node, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[c])
        return node

    def char(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c == "\\":
            c = self.p[self.i]
            self.i += 1
            if c == "x":
                self.i += 2
                return int(self.p[self.i - 2 : self.i], 16)
            if c.isalnum():
                raise ValueError(f"escape \\{c} isn't supported")
        return ord(c)

    def atom(self):
        c = self.peek()
        if c == "(":
            self.i += 1
            node = self.alt()
            if self.peek() != ")":
                raise ValueError(f"no closing bracket in {self.p!r}")
            self.i += 1
            return node
        if c == "[":
            self.i += 1
            negated = self.peek() == "^"
            self.i += negated
            found: set[int] = set()
            while self.peek() != "]":
                a = self.char()
                if self.peek() == "-" and self.p[self.i + 1] != "]":
                    self.i += 1
                    found.update(range(a, self.char() + 1))
                else:
                    found.add(a)
            self.i += 1
            return ("set", ALL - found if negated else frozenset(found))
        return ("set", frozenset([self.char()]))


def reverse(node):
    kind = node[0]
    if kind == "cat":
        return ("cat", [reverse(x) for x in reversed(node[1])])
    if kind == "alt":
        return ("alt", [reverse(x) for x in node[1]])
    return ("rep", reverse(node[1]), *node[2:]) if kind == "rep" else node


@dataclass
class _Nfa:
    moves: list[list[tuple[frozenset, int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, node, at: int) -> int:
        """Adds what node matches from state at; returns its end state."""
        kind = node[0]
        if kind == "set":
            to = self.state()
            self.moves[at].append((node[1], to))
            return to
        if kind == "cat":
            for x in node[1]:
                at = self.add(x, at)
            return at
        if kind == "alt":
            to = self.state()
            for x in node[1]:
                begin = self.state()
                self.free[at].append(begin)
                self.free[self.add(x, begin)].append(to)
            return to
        _, inner, low, high = node
        for _ in range(low):
            at = self.add(inner, at)
        if high is None:
            loop, to = self.state(), self.state()
            self.free[at].append(loop)
            self.free[loop].append(to)
            self.free[self.add(inner, loop)].append(loop)
            return to
        to = self.state()
        self.free[at].append(to)
        for _ in range(high - low):
            at = self.add(inner, at)
            self.free[at].append(to)
        return to

    def closed(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


@dataclass(frozen=True)
class Dfa:
    """next[state * 256 + byte]; accepts[state] is a bit mask of the rules with a match that ends there."""

    next: list[int]
    accepts: list[int]
    start: int
    dead: int | None

    @property
    def states(self) -> int:
        return len(self.accepts)


def build(patterns: list, searching: bool) -> Dfa:
    """Subset construction and minimisation of parsed patterns. searching: matches may begin anywhere."""
    nfa = _Nfa()
    start = nfa.state()
    if searching:
        nfa.moves[start].append((ALL, start))
    ends = {}
    for k, node in enumerate(patterns):
        begin = nfa.state()
        nfa.free[start].append(begin)
        ends[nfa.add(node, begin)] = 1 << k
    classes = _byte_classes(nfa)
    members = [min(c) for c in classes]
    ids: dict[frozenset, int] = {nfa.closed([start]): 0}
    order, rows = list(ids), []
    for states in order:
        row = []
        for byte in members:
            to = nfa.closed({t for s in states for chars, t in nfa.moves[s] if byte in chars})
            if to not in ids:
                ids[to] = len(ids)
                order.append(to)
            row.append(ids[to])
        rows.append(row)
    accepts = [sum({ends[s] for s in states if s in ends}) for states in order]
    return _minimised(rows, accepts, classes)


def _byte_classes(nfa: _Nfa) -> list[frozenset]:
    """Bytes that no transition tells apart."""
    parts = [ALL]
    for chars in {chars for moves in nfa.moves for chars, _ in moves}:
        parts = [x for p in parts for x in (p & chars, p - chars) if x]
    return parts


def _minimised(rows: list[list[int]], accepts: list[int], classes: list[frozenset]) -> Dfa:
    """Moore's partition refinement: states stay together while their accepts and successors' blocks agree."""
    block = {a: i for i, a in enumerate(dict.fromkeys(accepts))}
    of, count = [block[a] for a in accepts], len(block)
    while True:
        keys: dict[tuple, int] = {}
        new = [keys.setdefault((of[s], *(of[t] for t in row)), len(keys)) for s, row in enumerate(rows)]
        of, same, count = new, len(keys) == count, len(keys)
        if same:
            break
    table, marks = [0] * (count * 256), [0] * count
    for s, row in enumerate(rows):
        marks[of[s]] = accepts[s]
        for c, t in zip(classes, row, strict=True):
            for byte in c:
                table[of[s] * 256 + byte] = of[t]
    dead = next((s for s in range(count) if not marks[s] and all(t == s for t in table[s * 256 : s * 256 + 256])), None)
    return Dfa(table, marks, of[0], dead)


def parse(pattern: str):
    return _Parser(pattern).parse()


class Scanner:
    """All rules in one pass over the bytes.

    The pass reports where some rule has a match that ends. Only there, the rule's reversed automaton walks back
    for the furthest start after the rule's last match, and its own automaton walks forward for the longest end.
    Matches of a rule don't overlap; the one that is complete first wins, then the longest. That equals
    leftmost-first matching for rules in which no match can begin inside the fixed head of another, as here.
    """

    def __init__(self, patterns: list[str]) -> None:
        nodes = [parse(p) for p in patterns]
        self.all = build(nodes, searching=True)
        self.forward = [build([n], searching=False) for n in nodes]
        self.backward = [build([reverse(n)], searching=False) for n in nodes]
        # a state is its own row: row[byte] is the next row, row[256] the rules that end there
        rows: list[list] = [[None] * 257 for _ in range(self.all.states)]
        for s, row in enumerate(rows):
            row[:256] = [rows[t] for t in self.all.next[s * 256 : s * 256 + 256]]
            row[256] = self.all.accepts[s]
        self.begin = rows[self.all.start]

    def ends(self, data: bytes) -> list[tuple[int, int]]:
        """(end, mask of rules) wherever a match ends."""
        row, found, i = self.begin, [], 0
        for byte in data:
            i += 1
            row = row[byte]
            if row[256]:
                found.append((i, row[256]))
        return found

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) in bytes, by rule and start."""
        done: dict[int, int] = {}
        out = []
        for end, mask in self.ends(data):
            rule = 0
            while mask:
                if mask & 1 and end > done.get(rule, 0):
                    start = _furthest(self.backward[rule], data, end, done.get(rule, 0), -1)
                    if start is not None:
                        done[rule] = _furthest(self.forward[rule], data, start, len(data), 1)
                        out.append((rule, start, done[rule]))
                mask >>= 1
                rule += 1
        return sorted(out)


def _furthest(dfa: Dfa, data: bytes, at: int, limit: int, step: int) -> int | None:
    """The last accepting place when walking from at to limit."""
    state, best = dfa.start, at if dfa.accepts[dfa.start] else None
    while at != limit:
        state = dfa.next[state * 256 + data[at if step > 0 else at - 1]]
        if state == dfa.dead:
            break
        at += step
        if dfa.accepts[state]:
            best = at
    return best
