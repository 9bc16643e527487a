"""Token counts of fields and sections, attributed through the character offsets of one encoding.

A document is encoded once as a whole. Each token's character span is joined with the intervals of
the document's fields or sections. A token inside one interval is counted there; one that crosses a
boundary is allocated by an explicit rule:

* ``majority``: to the interval that holds most of its characters, the earlier one of equals;
* ``start``: to the interval of its first character;
* ``share``: to all of them, in proportion to the characters each holds.

A character that several tokens encode in parts belongs to the token with its first byte; the other
tokens count as standing at that character.

Defined cases: a null or empty document has one section 0 of no characters and no tokens; a null
field counts as empty. A section ends behind its separator. Repeated rows each get rows. An empty
table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweft.llm.bpe_tree import encoder

RULES = ("majority", "start", "share")


def token_spans(ids: np.ndarray, text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans [start, end) of the tokens of ``text``; ``lengths`` has each id's bytes."""
    end = np.cumsum(lengths[ids])
    begin = end - lengths[ids]
    if text.isascii():
        return begin, end
    lead = (np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0) != 0x80
    char = np.concatenate([[0], np.cumsum(lead)])  # characters that begin before each byte
    start = char[begin] - ~lead[begin]
    return start, np.maximum(char[end], start + 1)


def attribute(start: np.ndarray, end: np.ndarray, edges: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section and crossing tokens that touch it; ``edges`` are the sections' starts, then the end."""
    n = len(edges) - 1
    counts, crossing = np.zeros(n), np.zeros(n, np.int64)
    if not len(start):
        return counts, crossing
    first = np.searchsorted(edges, start, "right") - 1
    last = np.searchsorted(edges, end - 1, "right") - 1
    one = first == last
    np.add.at(counts, first[one], 1)
    for i in np.flatnonzero(~one):  # tokens are short: each touches few sections
        own = np.arange(first[i], last[i] + 1)
        held = np.minimum(edges[own + 1], end[i]) - np.maximum(edges[own], start[i])
        crossing[own[held > 0]] += 1
        if rule == "share":
            counts[own] += held / held.sum()
        else:
            counts[own[0] if rule == "start" else own[int(np.argmax(held))]] += 1
    return counts, crossing


def _line_edges(text: str, separator: str) -> np.ndarray:
    ends, at = [0], text.find(separator)
    while at >= 0:
        ends.append(at + len(separator))
        at = text.find(separator, at + len(separator))
    if ends[-1] != len(text) or len(ends) == 1:
        ends.append(len(text))
    return np.array(ends, np.int64)


def _rows(path, pattern, rule, separator, n_fields):
    names = ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64() if rule == "share" else pa.int64(), pa.int64()]

    def run(batches):
        enc = encoder(path, pattern)
        lengths = np.zeros(max(enc.vocab) + 1, np.int64)
        for i, b in enc.vocab.items():
            lengths[i] = len(b)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                cols = [[] for _ in names]
                for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    values = [v or "" for v in row[1:]]
                    text = "".join(values) if n_fields else values[0]
                    edges = np.concatenate([[0], np.cumsum([len(v) for v in values])]) if n_fields else _line_edges(text, separator)
                    counts, crossing = attribute(*token_spans(enc.encode(text), text, lengths), edges, rule)
                    n = len(counts)
                    for col, new in zip(cols, ([row[0]] * n, range(n), edges[:-1].tolist(), edges[1:].tolist(), counts.tolist() if rule == "share" else counts.astype(np.int64).tolist(), crossing.tolist()), strict=True):
                        col.extend(new)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return run


def section_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    fields: list[str] | None = None,
    separator: str = "\n",
    rule: str = "majority",
    path: str | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """``(doc_id, section, start, end, n_tokens, n_crossing)`` per section of every row.

    With ``fields``, these columns are joined to one document in their order and each is a section;
    without, ``text_col`` is cut behind each ``separator``.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    cols = [F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(fields or [text_col])]
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), *cols)
    kind = "double" if rule == "share" else "long"
    return narrow.mapInArrow(_rows(path, pattern, rule, separator, len(fields or [])), f"doc_id long, section int, start long, end long, n_tokens {kind}, n_crossing long")
