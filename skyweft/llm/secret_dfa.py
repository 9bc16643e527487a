"""Secret scans by one combined deterministic automaton.

The rules' regular expressions are compiled together: parsed, turned into one non-deterministic
automaton over bytes, made deterministic by subset construction over byte classes and minimised by
partition refinement. The result is one transition array. One pass reads each byte of a text once and
notes where each rule completes a match for the first time; most texts are done then. From there on
the rule's own automata take over: the reversed one finds the leftmost start, the anchored one the
longest end, and the open one starts afresh behind that end and goes on to the next completed match.
So matches are leftmost-longest and do not overlap within a rule, and no byte is read more than a few
times per rule, whatever the text. An extra condition of a rule (``check``) drops matches; what it
drops is not searched again.

A rule's first completed match has to have the leftmost start, which holds for rules that begin with
a fixed text or consist of one run of a byte class.

Defined cases: a null text counts as empty and has no spans. Spans are in code points, the end
exclusive. Repeated rows each get a row, a null doc_id stays null, an empty table gives no rows,
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache
from re import _constants as K
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweft.llm.batches import sliced

@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    check: Callable[[bytes], bool] | None = None


_ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
_ASSIGN_BYTES = re.compile(_ASSIGN.encode())


def _long_value(match: bytes) -> bool:
    found = _ASSIGN_BYTES.fullmatch(match)
    return found is not None and len(found[2]) >= 6


@dataclass(frozen=True)
class AtLeast:
    """A condition that compares equal after its way to a worker."""

    length: int

    def __call__(self, match: bytes) -> bool:
        return len(match) >= self.length


#: The contract's kinds, in its order. Lengths are checked on matches where that spares states.
BASE = (
    Rule("assign", _ASSIGN, _long_value),
    Rule("access", r"AKIA[A-Z0-9]+", AtLeast(20)),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Public forms of credentials, fixed by their issuers.
MORE = (
    Rule("hub", r"gh[oprsu]_[A-Za-z0-9]+", AtLeast(40)),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", AtLeast(20)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", AtLeast(40)),
    Rule("pem", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
)


class Nfa:
    """Thompson automaton over bytes: ``eps`` and ``step`` by state."""

    def __init__(self):
        self.eps: list[list[int]] = []
        self.step: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.eps.append([])
        self.step.append(None)
        return len(self.eps) - 1

    def build(self, tree, into: int, fold: bool, back: bool) -> int:
        """Adds a parsed pattern behind state ``into`` and returns its last state; ``back`` reverses it."""
        for op, arg in reversed(list(tree)) if back else tree:
            into = self._one(op, arg, into, fold, back)
        return into

    def _one(self, op, arg, into: int, fold: bool, back: bool) -> int:
        if op in (K.LITERAL, K.NOT_LITERAL, K.ANY, K.IN):
            out = self.state()
            self.step[into] = (self._bytes(op, arg, fold), out)
            after = self.state()
            self.eps[out].append(after)
            return after
        if op is K.SUBPATTERN:
            _, add, _, inner = arg
            return self.build(inner, into, fold or bool(add & re.I.value), back)
        if op is K.BRANCH:
            end = self.state()
            for branch in arg[1]:
                first = self.state()
                self.eps[into].append(first)
                self.eps[self.build(branch, first, fold, back)].append(end)
            return end
        if op is K.MAX_REPEAT:
            low, high, inner = arg
            for _ in range(low):
                into = self.build(inner, into, fold, back)
            if high is K.MAXREPEAT:
                loop, first, end = self.state(), self.state(), self.state()
                self.eps[into].append(loop)
                self.eps[loop] += [first, end]
                self.eps[self.build(inner, first, fold, back)].append(loop)
                return end
            end = self.state()
            self.eps[into].append(end)
            for _ in range(high - low):
                first = self.state()
                self.eps[into].append(first)
                into = self.build(inner, first, fold, back)
                self.eps[into].append(end)
            return end
        raise ValueError(f"a rule may not hold {op}")

    @staticmethod
    def _bytes(op, arg, fold: bool) -> frozenset[int]:
        found: set[int] = set()
        negate = op is K.NOT_LITERAL
        if op is K.ANY:
            return frozenset(range(256)) - {10}
        for kind, a in [(K.LITERAL, arg)] if op in (K.LITERAL, K.NOT_LITERAL) else arg:
            if kind is K.NEGATE:
                negate = True
            elif kind is K.LITERAL:
                found.add(a)
            elif kind is K.RANGE:
                found.update(range(a[0], a[1] + 1))
            else:
                raise ValueError(f"a class may not hold {kind} {a}")
        if any(b > 127 for b in found):
            raise ValueError("rules are over ASCII")
        if fold:
            found |= {b ^ 32 for b in found if chr(b).isalpha()}
        return frozenset(range(256)) - found if negate else frozenset(found)


class Dfa:
    """Minimal deterministic automaton: ``table[state * classes + class]``, ``mask[state]``."""

    def __init__(self, rules: tuple[Rule, ...], anchored: bool, back: bool = False):
        nfa, start, ends = Nfa(), [], {}
        for k, rule in enumerate(rules):
            first = nfa.state()
            start.append(first)
            ends[nfa.build(parser.parse(rule.pattern), first, False, back)] = 1 << k
        kinds = sorted({s[0] for s in nfa.step if s}, key=sorted)
        code: dict[tuple[bool, ...], int] = {}
        self.byte_class = bytes(code.setdefault(tuple(b in s for s in kinds), len(code)) for b in range(256))
        self.classes = len(code)
        samples = [self.byte_class.index(c) for c in range(self.classes)]

        @cache
        def closure(q: int) -> frozenset[int]:
            seen, todo = {q}, [q]
            while todo:
                for r in nfa.eps[todo.pop()]:
                    if r not in seen:
                        seen.add(r)
                        todo.append(r)
            return frozenset(x for x in seen if nfa.step[x] or x in ends)

        begin = frozenset().union(*(closure(q) for q in start))
        index, order, rows = {begin: 0}, [begin], []
        for subset in order:
            row = []
            for b in samples:
                to = set() if anchored else set(begin)
                for q in subset:
                    if nfa.step[q] and b in nfa.step[q][0]:
                        to |= closure(nfa.step[q][1])
                key = frozenset(to)
                if key not in index:
                    index[key] = len(order)
                    order.append(key)
                row.append(index[key])
            rows.append(row)
        mask = np.array([sum({ends[q] for q in s if q in ends}) for s in order], np.int64)
        self._minimise(np.array(rows, np.int64), mask)

    def _minimise(self, move: np.ndarray, mask: np.ndarray) -> None:
        """Moore's refinement; silent states come first, the start state is state ``start``."""
        block = np.unique(mask, return_inverse=True)[1].ravel()
        while True:
            new = np.unique(np.column_stack([block, block[move]]), axis=0, return_inverse=True)[1].ravel()
            if new.max() == block.max():
                break
            block = new
        n = block.max() + 1
        rep = np.zeros(n, np.int64)
        rep[block[::-1]] = np.arange(len(block))[::-1]
        rank = np.argsort(np.argsort(mask[rep] != 0, kind="stable"), kind="stable")
        table, masks = np.zeros((n, self.classes), np.int64), np.zeros(n, np.int64)
        table[rank], masks[rank] = rank[block[move[rep]]], mask[rep]
        self.states, self.start = n, int(rank[block[0]])
        self.accept = int((masks == 0).sum()) * self.classes  # rows from here on report
        self.table = (table * self.classes).ravel().tolist()
        self.mask = masks.tolist()
        dead = [i for i in range(n) if masks[i] == 0 and (table[i] == i).all()]
        self.dead = dead[0] * self.classes if dead else -1


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.all = Dfa(rules, anchored=False)
        self.open = [Dfa((r,), anchored=False) for r in rules]
        self.ahead = [Dfa((r,), anchored=True) for r in rules]
        self.behind = [Dfa((r,), anchored=True, back=True) for r in rules]

    def _first(self, data: bytes) -> dict[int, int]:
        """Rule -> where it completes its first match, from one pass over the bytes."""
        d = self.all
        table, accept, mask, s, out = d.table, d.accept, d.mask, d.start * d.classes, {}
        missing = (1 << len(self.rules)) - 1
        for i, c in enumerate(data.translate(d.byte_class), 1):
            s = table[s + c]
            if s >= accept and mask[s // d.classes] & missing:
                for k in range(len(self.rules)):
                    if mask[s // d.classes] & missing & (1 << k):
                        out[k] = i
                missing &= ~mask[s // d.classes]
                if not missing:
                    break
        return out

    @staticmethod
    def _next(d: Dfa, coded: bytes, at: int) -> int | None:
        """Where an open automaton that starts at ``at`` completes its first match."""
        table, accept, s = d.table, d.accept, d.start * d.classes
        for i in range(at, len(coded)):
            s = table[s + coded[i]]
            if s >= accept:
                return i + 1
        return None

    @staticmethod
    def _farthest(d: Dfa, data: bytes, at: int, step: int, bound: int) -> int:
        """How far a match of ``d`` reaches from ``at`` in the direction ``step``; there is one."""
        s, best, cls = d.start * d.classes, at, d.byte_class
        while at != bound:
            s = d.table[s + cls[data[at if step > 0 else at - 1]]]
            at += step
            if s >= d.accept:
                best = at
            elif s == d.dead:
                break
        return best

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes, by start, then rule."""
        found = []
        for k, end in self._first(data).items():
            done, check = 0, self.rules[k].check
            coded = data.translate(self.open[k].byte_class)
            while end is not None:
                start = self._farthest(self.behind[k], data, end, -1, done)
                done = self._farthest(self.ahead[k], data, start, 1, len(data))
                if check is None or check(data[start:done]):
                    found.append((start, done, k))
                end = self._next(self.open[k], coded, done)
        return sorted(found, key=lambda x: (x[0], x[2]))


@cache
def scanner(rules: tuple[Rule, ...] = BASE + MORE) -> Scanner:
    """One scanner for each worker."""
    return Scanner(rules)


def scan_text(text: str | None, rules: tuple[Rule, ...] = BASE + MORE) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all matches, in code points."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    found = scanner(rules).spans(data)
    if found and len(data) != len(text):
        lead = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
        found = [(int(lead[a]), int(lead[b]), k) for a, b, k in found]
    return [(a, b, rules[k].kind) for a, b, k in found]


def listed(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: tuple[Rule, ...] = MORE) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` for every row of ``docs``."""
    rules = BASE + more
    base = [r.kind for r in BASE]

    def run(batches):
        for batch in sliced(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans = scan_text(text, rules)
                kinds = [k for _, _, k in spans]
                own = listed(s for s in spans if s[2] in base)
                rows.append((doc, *(kinds.count(k) for k in base), hashlib.sha256(own.encode()).hexdigest(), listed(spans)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            cols = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
