"""Byte-level BPE by monoid tree reduction.

A text is cut into pieces by the tokenizer's pattern. A piece that is no token itself is cut into
leaves of LEAF_BYTES bytes, each leaf is merged directly, and neighbours are joined pairwise up a tree. To join, the last
tokens of the left side and the first of the right are encoded again as one window. The window
doubles until the tokens that touch it from outside are stable beside its ends: a pair of tokens is
stable when the encoding of its bytes is that pair. A sequence of tokens is the encoding of its
bytes exactly when all neighbours in it are stable, so what lies outside is then final. Joining is
associative with the empty sequence as identity. Decoding concatenates halves up the same tree.

Each worker remembers short pieces, leaves and neighbours already seen, up to a fixed number.

Defined cases: a null or empty text has no tokens; both digests are then those of no bytes. A piece
of any length costs about n log n. Repeated rows each get a row, a null doc_id stays null, an empty
table gives no rows, further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF_BYTES = 4
#: Pieces of up to this many characters are remembered by each worker, so many in each of two generations: 250 bytes or so each.
CACHED_CHARS, CACHED_PIECES = 40, 250_000
#: Entries of the tables of leaves and of neighbours, each.
REMEMBERED = 150_000
SHORT = 48
NO_RANK = 1 << 62


class TreeEncoder(dict):
    """Maps a piece to its packed ids; as a dict it remembers short pieces. ``trees``, ``joins`` and ``windows`` count the tree's work."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks = ranks
        self.vocab = {i: b for b, i in ranks.items()}
        self.byte = [ranks.get(bytes((c,)), -1) for c in range(256)]
        self.shift = max(self.vocab, default=0).bit_length()
        #: Two neighbours, as one number -> the token that both together are.
        self.merged = {ranks[x] << self.shift | ranks[y]: i for b, i in ranks.items() for k in range(1, len(b)) if (x := b[:k]) in ranks and (y := b[k:]) in ranks}
        self.pattern = regex.compile(pattern)
        self.leaves: dict[bytes, list[int]] = {}
        self.pair: dict[int, list[int] | None] = {}
        self.older: dict[str, bytes] = {}
        self.trees = self.joins = self.windows = 0

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            packed = self._packed(piece)
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed

    def _packed(self, piece: str) -> bytes:
        ids = array("I", self.piece_ids(piece.encode("utf-8", "surrogatepass")))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def merge(self, data: bytes) -> list[int]:
        """Merges the lowest-ranked neighbours first, the leftmost of equals, until none is left."""
        known = self.ranks.get(data)
        if known is not None:
            return [known]
        byte, get, shift, n = self.byte, self.merged.get, self.shift, len(data)
        parts = [byte[c] for c in data]
        if n <= SHORT:
            pairs = [get(x << shift | y, NO_RANK) for x, y in zip(parts, parts[1:], strict=False)]  # rank of joining the parts i and i + 1
            while pairs:
                best = min(pairs)
                if best == NO_RANK:
                    break
                i = pairs.index(best)
                parts[i : i + 2] = (best,)
                del pairs[i]
                if i:
                    pairs[i - 1] = get(parts[i - 1] << shift | best, NO_RANK)
                if i < len(pairs):
                    pairs[i] = get(best << shift | parts[i + 1], NO_RANK)
            return parts
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(parts[i] << shift | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = nxt[i] if parts[i] >= 0 else n
            if j >= n or get(parts[i] << shift | parts[j]) != r:
                continue
            parts[i], parts[j], nxt[i] = r, -1, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (r := get(parts[i] << shift | parts[nxt[i]])) is not None:
                    heapq.heappush(heap, (r, i))
            if prv[i] >= 0 and (r := get(parts[prv[i]] << shift | parts[i])) is not None:
                heapq.heappush(heap, (r, prv[i]))
        return [p for p in parts if p >= 0]

    def leaf(self, data: bytes) -> list[int]:
        """The encoding of a few bytes."""
        known = self.leaves.get(data)
        if known is None:
            if len(self.leaves) >= REMEMBERED:
                self.leaves.clear()
            known = self.leaves[data] = self.merge(data)
        return known

    def again(self, a: int, b: int) -> list[int] | None:
        """The encoding of two neighbours' bytes where it is another one than these two; None where they are stable."""
        key = a << self.shift | b
        known = self.pair.get(key, 0)
        if known == 0:
            if len(self.pair) >= REMEMBERED:
                self.pair.clear()
            known = self.merge(self.vocab[a] + self.vocab[b])
            known = self.pair[key] = None if known == [a, b] else known
        return known

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of what ``a`` and ``b`` encode, from their tokens."""
        if not a or not b:
            return a + b
        self.joins += 1
        again = self.again
        mid = again(a[-1], b[0])
        if mid is None:
            return a + b
        w = 1
        while True:
            self.windows += 1
            i, j = max(0, len(a) - w), min(len(b), w)
            if w > 1:
                mid = self.merge(b"".join(map(self.vocab.__getitem__, a[i:] + b[:j])))
            if (i == 0 or again(a[i - 1], mid[0]) is None) and (j == len(b) or again(mid[-1], b[j]) is None):
                return a[:i] + mid + b[j:]
            w *= 2

    def piece_ids(self, data: bytes) -> list[int]:
        """The tree over one piece: leaves, then neighbours joined level by level."""
        known = self.ranks.get(data)
        if known is not None:
            return [known]
        self.trees += 1
        leaf, join = self.leaf, self.join
        level = [leaf(data[i : i + LEAF_BYTES]) for i in range(0, len(data), LEAF_BYTES)]
        while len(level) > 1:
            up = [join(level[i], level[i + 1]) for i in range(0, len(level) - 1, 2)]
            if len(level) % 2:
                up.append(level[-1])
            level = up
        return level[0] if level else []

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        return np.frombuffer(b"".join(map(self.__getitem__, self.pattern.findall(text))), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) > 8192:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        return b"".join(map(self.vocab.__getitem__, ids.tolist()))


@cache
def encoder(path: str | None = None, pattern: str | None = None) -> TreeEncoder:
    """One encoder for each worker; ``path`` is a rank file: base64 token, space, rank."""
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return TreeEncoder(ranks, pattern or public_tokenizers.PATTERN)


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _token_rows(path: str | None, pattern: str | None, with_ids: bool):
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.list_(pa.int32())] * with_ids]

    def run(batches):
        enc = encoder(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                cols: list[list] = [[] for _ in names]
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = enc.encode(text)
                    row = (doc, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(enc.decode(ids)).hexdigest(), ids.view(np.int32))
                    for c, v in zip(cols, row, strict=False):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return run


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256, ids)``: the token ids of every text, with digests of them and of the bytes decoded from them."""
    return _narrow(docs, id_col, text_col).mapInArrow(_token_rows(path, pattern, True), DIGESTS + ", ids array<int>")


def encoding_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The same without carrying the ids."""
    return _narrow(docs, id_col, text_col).mapInArrow(_token_rows(path, pattern, False), DIGESTS)
