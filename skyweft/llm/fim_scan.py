"""Fill-in-the-middle: texts cut into prefix, middle and suffix at unit boundaries, found by one automaton.

Units are runs of A-Z and a-z, and every other code point by itself. One Aho-Corasick automaton over
symbol classes knows the class changes (a letter after something else, something else after a letter)
and the sentinels. Its matches are the only events kept: between two changes the units follow by
arithmetic, one for a gap of letters and one a code point for any other gap, so the place of the k-th
unit is a binary search among the events. No node of the automaton is deeper than its longest pattern,
so the state at a place follows from that many last symbols and all places of a window are run at once.

Defined cases: a null or empty text is plain, with no units; a text that holds a sentinel is plain. A
null id draws its cut from an empty number. Repeated rows are cut alike, an empty table gives none,
further columns are ignored by :func:`fim_digests` and kept by :func:`fim_documents`. Long texts are
scanned in windows of WINDOW code points.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from skyweft.llm.batches import sliced

SENTINELS = ("<P>", "<S>", "<M>")
#: Code points scanned at a time.
WINDOW = 1 << 20
#: Of 100 texts, those that stay plain and, of the others, those with the suffix first.
PLAIN_PERCENT, SUFFIX_FIRST_PERCENT = 10, 20
LETTER, OTHER, SENTINEL = 1, 2, 4


class EventAutomaton:
    """Aho-Corasick automaton over symbol classes; ``events`` gives where patterns end and which."""

    def __init__(self, sentinels: tuple[str, ...] = SENTINELS):
        if len(set(sentinels)) != 3 or any(not s or s[0] in t[1:] for s in sentinels for t in sentinels) or any(s.startswith(t) for s in sentinels for t in sentinels if s != t):
            raise ValueError("three different sentinels, none the start of another, whose first characters occur nowhere else in them")
        self.sentinels = sentinels
        own = sorted({c for s in sentinels for c in s})
        self.own = np.array([ord(c) for c in own], np.uint32)
        letter = [c for c in own if c.isascii() and c.isalpha()]
        number = {c: i + 2 for i, c in enumerate(own)}  # 0: any other letter, 1: anything else
        letters, others = [0, *(number[c] for c in letter)], [1, *(number[c] for c in own if c not in letter)]
        patterns = [((a, b), LETTER) for a in others for b in letters] + [((a, b), OTHER) for a in letters for b in others]
        patterns += [(tuple(number[c] for c in s), SENTINEL) for s in sentinels]
        self._compile(patterns, len(own) + 2)
        low = np.ones(129, np.intp)  # 128 stands for all further code points
        low[[*range(65, 91), *range(97, 123)]] = 0
        for c in own:
            if ord(c) < 128:
                low[ord(c)] = number[c]
        self.low, self.high = low, [(ord(c), number[c]) for c in own if ord(c) >= 128]
        self.letter_symbols = np.isin(np.arange(len(own) + 2), letters)

    def _compile(self, patterns, symbols: int) -> None:
        tree, marks = [{}], [0]
        for word, mark in patterns:
            at = 0
            for s in word:
                if s not in tree[at]:
                    tree[at][s] = len(tree)
                    tree.append({})
                    marks.append(0)
                at = tree[at][s]
            marks[at] |= mark
        step, fail, queue = np.zeros((len(tree), symbols), np.uint16), [0] * len(tree), deque([0])
        while queue:  # breadth first: the node to fall back to is complete already
            at = queue.popleft()
            for s in range(symbols):
                fall = int(step[fail[at], s]) if at else 0
                to = tree[at].get(s)
                if to is None:
                    step[at, s] = fall
                else:
                    step[at, s] = to
                    fail[to] = fall
                    marks[to] |= marks[fall]
                    queue.append(to)
        # nodes are named by where their row of ``step`` starts, so that a step is one sum and one look-up
        self.step, self.marks = step.astype(np.intp).ravel() * symbols, np.zeros(len(tree) * symbols, np.uint8)
        self.marks[::symbols] = marks
        self.depth = max(len(w) for w, _ in patterns)

    def _symbols(self, codes: np.ndarray) -> np.ndarray:
        out = self.low.take(np.minimum(codes, 128))
        for code, symbol in self.high:
            out[codes == code] = symbol
        return out

    def events(self, text: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """``(places, marks, starts with a letter)``: the code point at which each match ends, in order."""
        places, marks, first = [], [], False
        for lo in range(0, len(text), WINDOW):
            before = min(lo, self.depth - 1)
            codes = np.frombuffer(text[lo - before : lo + WINDOW].encode("utf-32-le", "surrogatepass"), np.uint32)
            symbols = self._symbols(codes)
            if not lo:
                first = bool(self.letter_symbols[symbols[0]])
            padded = np.concatenate([np.zeros(self.depth - 1, np.intp), symbols])
            state = np.zeros(len(symbols), np.intp)
            for k in range(self.depth):
                state = self.step.take(state + padded[k : k + len(symbols)])
            mark = self.marks.take(state)
            if not lo:
                mark[: self.depth - 1] = self._head(symbols[: self.depth - 1])  # what stands before the text is no symbol
            at = np.flatnonzero(mark[before:])
            places.append(at + lo)
            marks.append(mark[before:][at])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8), False
        return np.concatenate(places), np.concatenate(marks), first

    def _head(self, symbols: np.ndarray) -> list[int]:
        state, out = 0, []
        for s in symbols:
            state = int(self.step[state + s])
            out.append(int(self.marks[state]))
        return out


@lru_cache(8)
def automaton(sentinels: tuple[str, ...] = SENTINELS) -> EventAutomaton:
    return EventAutomaton(sentinels)


class Units:
    """The units of a text by its events: their number, and where the first k of them end."""

    def __init__(self, text: str, machine: EventAutomaton):
        places, marks, first = machine.events(text)
        change = (marks & (LETTER | OTHER)) > 0
        self.sentinel_ends = places[(marks & SENTINEL) > 0]
        self.starts = np.concatenate([[0], places[change]]) if text else np.zeros(0, np.int64)
        self.letters = np.concatenate([[first], (marks[change] & LETTER) > 0]) if text else np.zeros(0, bool)
        self.ends = np.concatenate([self.starts[1:], [len(text)]]) if text else self.starts
        self.before = np.concatenate([[0], np.cumsum(np.where(self.letters, 1, self.ends - self.starts))])
        self.n = int(self.before[-1])

    def end(self, k: int) -> int:
        """Code points in the first ``k`` units."""
        if k <= 0:
            return 0
        gap = int(np.searchsorted(self.before, k)) - 1
        return int(self.ends[gap] if self.letters[gap] else self.starts[gap] + k - self.before[gap])


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from the digest of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[8 * i : 8 * i + 8], 16) for i in range(4))


def transform(text: str, doc_id: int | None, seed: int = 1, sentinels: tuple[str, ...] = SENTINELS, plain: int = PLAIN_PERCENT, suffix_first: int = SUFFIX_FIRST_PERCENT) -> tuple[int, str, int | None, int | None, str]:
    """``(units, form, prefix length, middle length, output)`` of one text."""
    units = Units(text, automaton(sentinels))
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or len(units.sentinel_ends) or h3 % 100 >= 100 - plain:
        return units.n, "plain", None, None, text
    a, b = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    a, b = units.end(a), units.end(b)
    p, s, m = sentinels
    if h4 % 100 < suffix_first:
        return units.n, "spm", a, b - a, f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"
    return units.n, "psm", a, b - a, f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"


def restore(output: str, form: str, sentinels: tuple[str, ...] = SENTINELS) -> str:
    """The text from its output and form. The same automaton finds the three sentinels."""
    if form == "plain":
        return output
    ends = Units(output, automaton(sentinels)).sentinel_ends + 1
    p, s, m = sentinels
    order = [s, p, m] if form == "spm" else [p, s, m]
    if form not in ("psm", "spm") or len(ends) != 3 or any(output[e - len(x) : e] != x for e, x in zip(ends, order, strict=True)):
        raise ValueError(f"no output of the form {form}")
    one, two, middle = output[ends[0] : ends[1] - len(order[1])], output[ends[1] : ends[2] - len(m)], output[ends[2] :]
    return two + middle + one if form == "spm" else one + middle + two


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fim_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "fim", form_col: str = "fim_form", seed: int = 1, sentinels: tuple[str, ...] = SENTINELS, plain: int = PLAIN_PERCENT, suffix_first: int = SUFFIX_FIRST_PERCENT) -> DataFrame:
    """``docs`` with the transformed text and its form added; a null text gives an empty plain output."""
    if {out_col, form_col} & set(docs.columns):
        raise ValueError(f"{out_col} or {form_col} is a column already")
    i, t = docs.columns.index(id_col), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = [transform(x or "", d, seed, sentinels, plain, suffix_first) for d, x in zip(batch.column(i).to_pylist(), batch.column(t).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([m[4] for m in made], pa.string()), pa.array([m[1] for m in made], pa.string())], names=[*batch.schema.names, out_col, form_col])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out_col, StringType()), StructField(form_col, StringType())]))


def restored_documents(docs: DataFrame, out_col: str = "fim", form_col: str = "fim_form", text_col: str = "restored", sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    """``docs`` with the text rebuilt from output and form; a null output or form gives null."""
    o, f = docs.columns.index(out_col), docs.columns.index(form_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = [None if x is None or form is None else restore(x, form, sentinels) for x, form in zip(batch.column(o).to_pylist(), batch.column(f).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, text_col])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(text_col, StringType())]))


_DIGESTS = {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output_sha256": pa.string(), "restored_sha256": pa.string()}


def fim_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """Units, form, lengths of the parts and digests of the output and of the text rebuilt from it, a row a document."""

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, form, prefix, middle, output = transform(text or "", doc, seed)
                rows.append((doc, n, form, prefix, middle, sha(output), sha(restore(output, form))))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _DIGESTS.values(), strict=True)], names=list(_DIGESTS))

    return _narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def digests_sql(table: str, seed: int = 1) -> str:
    """The same result by token lists, for a table with an integer ``doc_id``."""
    number = [f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)" for i in range(4)]
    p, s, m = SENTINELS
    return f"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM {table}
), drawn AS (
  SELECT doc_id, x, u, len(u) AS n, least({number[0]} % (len(u) + 1), {number[1]} % (len(u) + 1)) AS a,
    greatest({number[0]} % (len(u) + 1), {number[1]} % (len(u) + 1)) AS b,
    CASE WHEN x = '' OR contains(x, '{p}') OR contains(x, '{s}') OR contains(x, '{m}') OR {number[2]} % 100 >= {100 - PLAIN_PERCENT} THEN 'plain'
      WHEN {number[3]} % 100 < {SUFFIX_FIRST_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM cut
), parts AS (
  SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM drawn
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '{p}' || pre || '{s}' || suf || '{m}' || mid ELSE '{s}' || suf || '{p}' || pre || '{m}' || mid END) AS output_sha256,
  sha256(x) AS restored_sha256
FROM parts
"""
