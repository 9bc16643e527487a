"""Benchmark decontamination: BM25 over an inverted index of test items with block-max WAND.

Index: test items are put in blocks of a few items, items of like length together. A term's impact on
an item is its BM25 weight divided by the item's full weight, so a passage that holds a whole item
scores 1 on it. For every term the index has its items with impacts, the maximum in each block, and
the maximum of all.

Query: every document is cut into overlapping passages, long enough that each item of the class of
lengths searched fits whole into one. A passage's terms are put in order of their maxima; terms before
the pivot, where the maxima add up to the threshold, cannot lift an item over it by themselves. So
only blocks that a term from the pivot on is in are looked at, all others are skipped. Their bound,
the block maxima of those terms and the sum before the pivot, has to reach the threshold; then the
bound by the block maxima of all terms has to; only then items are scored. No item at or above the
threshold is lost. Retrieved items are then verified: the shares of the item's, its question's and its
answer's five-word shingles that the document holds. The answer is the item's last sentence where it
has several, the question is the rest. An item with a null id is reported as item -1.

Words are cut by one function, for items and documents and however large the benchmark is. The index
is built from the items only. Its size is checked: items are dealt into shards by the bytes of their
text, and each shard is broadcast in a pass of its own. Passages are searched in groups of at most
GROUP_POSTINGS block entries.

Defined cases: null or empty texts and items match nothing; parts shorter than five words count as
one shingle; an item that stands several times counts once. Repeated documents each get rows. Empty
tables give no rows. Further columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweft.llm.batches import sliced
from skyweft.session import discard, materialize

WORD = re.compile(r"\w+")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
K1, B = 1.2, 0.75
BLOCK_ITEMS = 8
#: Bytes of item text in one broadcast index.
SHARD_BYTES = 8_000_000
CHUNK_WORDS = 60_000
#: Block entries of the passages that are searched at once: bounds the arrays of a search.
GROUP_POSTINGS = 1_000_000
#: Lengths of items, in words, up to which they share passages; longer ones by further powers of four.
FIRST_LENGTH = 32
SHINGLE = 5


def words_of(text: str | None) -> list[str]:
    """The words of an item or a document, in lower case."""
    return WORD.findall(text.lower()) if text else []


class BlockMaxIndex:
    """Arrays of the items of one shard and class of lengths: terms' postings (item, impact) and block maxima, both by term."""

    def __init__(self, items: list[tuple[int, str]], n_items: int, mean_len: float, df: dict[str, int]):
        self.ids = [i for i, _ in items]
        words = [words_of(t) for _, t in items]
        self.parts = [_split_item(t) for _, t in items]
        self.longest = max(map(len, words), default=0)
        rows: dict[str, list[tuple[int, float]]] = {}
        for d, ws in enumerate(words):
            tf: dict[str, int] = {}
            for w in ws:
                tf[w] = tf.get(w, 0) + 1
            norm = K1 * (1 - B + B * len(ws) / max(mean_len, 1e-9))
            weight = {w: np.log1p((n_items - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + norm) for w, c in tf.items()}
            full = sum(weight.values())
            for w, x in weight.items():
                rows.setdefault(w, []).append((d, x / full))
        self.vocab = {w: t for t, w in enumerate(rows)}
        self.start = np.zeros(len(rows) + 1, np.int64)
        np.cumsum([len(r) for r in rows.values()], out=self.start[1:])
        flat = [p for r in rows.values() for p in r]
        self.item = np.array([d for d, _ in flat], np.int64)
        self.impact = np.array([x for _, x in flat], np.float64)
        term = np.repeat(np.arange(len(rows)), np.diff(self.start))
        self.blocks = -(-len(items) // BLOCK_ITEMS)
        top = np.zeros(len(rows))
        np.maximum.at(top, term, self.impact)
        self.top = top
        key, inverse = np.unique(term * self.blocks + self.item // BLOCK_ITEMS, return_inverse=True)
        best = np.zeros(len(key))
        np.maximum.at(best, inverse, self.impact)
        self.block, self.block_max = key % max(self.blocks, 1), best
        self.block_start = np.searchsorted(key // max(self.blocks, 1), np.arange(len(rows) + 1))

    def retrieve(self, window: np.ndarray, term: np.ndarray, threshold: float):
        """Distinct (window, term) pairs, by window -> all (window, item, score) with score >= threshold."""
        none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        order = np.lexsort((self.top[term], window))
        window, term = window[order], term[order]
        upto = np.cumsum(self.top[term])
        first = np.flatnonzero(np.r_[True, window[1:] != window[:-1]]) if len(window) else np.empty(0, np.int64)
        upto -= np.repeat((upto - self.top[term])[first], np.diff(np.r_[first, len(window)]))
        pivot = upto >= threshold - 1e-9
        if not pivot.any():
            return none
        at, of = _ranges(self.block_start[term[pivot]], self.block_start[term[pivot] + 1])
        cells, inverse = np.unique(window[pivot][of] * self.blocks + self.block[at], return_inverse=True)
        before = dict(zip(window[~pivot].tolist(), upto[~pivot].tolist(), strict=True))  # the last one of each window stays
        bound = np.bincount(inverse, self.block_max[at], len(cells))
        rest = np.array([before.get(w, 0.0) for w in (cells // self.blocks).tolist()])
        cells = cells[bound + rest >= threshold - 1e-9]
        if not len(cells):
            return none
        pick = np.isin(window, cells // self.blocks)
        window, term = window[pick], term[pick]
        at, of = _ranges(self.block_start[term], self.block_start[term + 1])
        place, on = _found(cells, window[of] * self.blocks + self.block[at])
        cells = cells[np.bincount(place[on], self.block_max[at][on], len(cells)) >= threshold - 1e-9]
        if not len(cells):
            return none
        pick = np.isin(window, cells // self.blocks)
        window, term = window[pick], term[pick]
        at, of = _ranges(self.start[term], self.start[term + 1])
        win, item = window[of], self.item[at]
        _, on = _found(cells, win * self.blocks + item // BLOCK_ITEMS)
        key, inverse = np.unique(win[on] * len(self.ids) + item[on], return_inverse=True)
        score = np.bincount(inverse, self.impact[at][on], len(key))
        hit = score >= threshold
        return key[hit] // len(self.ids), key[hit] % len(self.ids), score[hit]


def _found(cells: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``wanted`` stands in the sorted ``cells``, and whether it does."""
    place = np.minimum(np.searchsorted(cells, wanted), len(cells) - 1)
    return place, cells[place] == wanted


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges [lo, hi), and the range that each is of."""
    n = hi - lo
    of = np.repeat(np.arange(len(lo)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + lo[of], of


def _shingles(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def _split_item(text: str) -> tuple[set, set, set]:
    cut = SENTENCE_END.split(text.strip())
    answer = words_of(cut[-1]) if len(cut) > 1 else []
    question = words_of(" ".join(cut[:-1] if len(cut) > 1 else cut))
    return _shingles(question + answer), _shingles(question), _shingles(answer)


def _share(part: set, words: list[str], held: set) -> float:
    if not part:
        return 1.0
    n = sum(1 for s in part if s in held)
    if n < len(part) and any(len(s) < SHINGLE for s in part):  # a part of fewer words than a shingle
        s = next(iter(part))
        n = int(any(tuple(words[i : i + len(s)]) == s for i in range(len(words) - len(s) + 1)))
    return n / len(part)


def search(indexes: list[BlockMaxIndex], texts: list[str | None], threshold: float) -> list[tuple]:
    """(row, item id, best score, overlap, question overlap, answer overlap) of all items retrieved."""
    out: list[tuple] = []
    chunk, n = [], 0
    for row, text in enumerate(texts):
        words = words_of(text)
        if words:
            chunk.append((row, words))
            n += len(words)
        if n >= CHUNK_WORDS:
            _search_chunk(indexes, chunk, threshold, out)
            chunk, n = [], 0
    if chunk:
        _search_chunk(indexes, chunk, threshold, out)
    return out


def _search_chunk(indexes: list[BlockMaxIndex], chunk: list, threshold: float, out: list[tuple]) -> None:
    held: dict[int, set] = {}
    for ix in indexes:
        get, n_terms, stride = ix.vocab.get, len(ix.vocab), max(FIRST_LENGTH, ix.longest)
        terms, wins, base, first = [], [], 0, []
        for _, words in chunk:
            ids = np.array([get(w, -1) for w in words], np.int64)
            w = base + np.arange(len(ids)) // stride
            terms += [ids, ids]
            wins += [w, np.where(w > base, w - 1, w)]  # a window is two strides long
            first.append(base)
            base += -(-len(ids) // stride)
        term, win = np.concatenate(terms), np.concatenate(wins)
        seen = term >= 0
        key = np.unique(win[seen] * n_terms + term[seen])
        if not len(key):
            continue
        win, term = key // n_terms, key % n_terms
        cost = np.cumsum(ix.block_start[term + 1] - ix.block_start[term])
        best: dict[tuple[int, int], float] = {}
        a = 0
        while a < len(key):  # a group of whole windows
            b = int(np.searchsorted(cost, (cost[a - 1] if a else 0) + GROUP_POSTINGS, "right"))
            b = max(b, a + 1)
            b = int(np.searchsorted(win, win[b], "left")) if b < len(key) and win[b] != win[a] else int(np.searchsorted(win, win[b - 1], "right"))
            for d, i, s in zip(*(x.tolist() for x in ix.retrieve(win[a:b], term[a:b], threshold)), strict=True):
                d = int(np.searchsorted(first, d, "right")) - 1
                best[d, i] = max(best.get((d, i), 0.0), s)
            a = b
        for (d, i), s in best.items():
            row, words = chunk[d]
            if d not in held:
                held[d] = _shingles(words)
            out.append((row, ix.ids[i], s, *(_share(p, words, held[d]) for p in ix.parts[i])))


def _is_leak(hit: tuple, overlap: float, part_overlap: float) -> bool:
    return hit[3] >= overlap and hit[4] >= part_overlap and hit[5] >= part_overlap


def _hit_rows(index, threshold: float):
    names = ["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"]
    kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 4]

    def run(batches):
        for batch in sliced(batches):
            ids = batch.column(0).to_pylist()
            hits = [(ids[h[0]], *h[1:]) for h in search(index.value, batch.column(1).to_pylist(), threshold)]
            cols = list(zip(*hits, strict=True)) if hits else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return run


def _clean_rows(index, threshold: float, text_at: int, overlap: float, part_overlap: float):
    def run(batches):
        for batch in sliced(batches):
            keep = np.ones(batch.num_rows, bool)
            for hit in search(index.value, batch.column(text_at).to_pylist(), threshold):
                if _is_leak(hit, overlap, part_overlap):
                    keep[hit[0]] = False
            yield batch.filter(pa.array(keep))

    return run


def _item_words(batches):
    """(shard, n words, distinct words) of every item."""
    for batch in sliced(batches):
        words = [words_of(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, words), pa.int64()), pa.array([sorted(set(w)) for w in words], pa.list_(pa.string()))], names=["shard", "n", "words"])


def n_shards(items: DataFrame, item_text: str = "text") -> int:
    """Shards that items are dealt into: at most SHARD_BYTES of text each, or so."""
    size = items.agg(F.sum(F.octet_length(F.col(item_text).cast("string"))).alias("bytes")).first()["bytes"] or 0
    return max(1, -(-size // SHARD_BYTES))


def build_indexes(items: DataFrame, item_id: str = "item_id", item_text: str = "text"):
    """Broadcast indexes of all shards of the items, one after another; each holds SHARD_BYTES of text or so."""
    spark = items.sparkSession
    it = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text is not null").distinct()
    shards = n_shards(items, item_text)
    tagged = it.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int"))
    cut = materialize(tagged.select("shard", "text").mapInArrow(_item_words, "shard int, n long, words array<string>").where("n > 0"), "bm25-words")
    lens = cut.agg(F.count(F.lit(1)).alias("n"), F.avg("n").alias("mean")).first()
    terms = cut.select("shard", F.explode("words").alias("w"))
    local = terms.distinct().join(terms.groupBy("w").agg(F.count(F.lit(1)).alias("df")), "w")
    local = materialize(local.select("shard", "w", "df"), "bm25-terms")
    for s in range(shards):
        rows = [(r["item_id"], r["text"]) for r in tagged.where(F.col("shard") == s).collect()]  # SHARD_BYTES or so
        df = {r["w"]: r["df"] for r in local.where(F.col("shard") == s).collect()}  # no more than the words of these
        yield _broadcast(spark, rows, lens["n"], float(lens["mean"] or 0), df)
    discard(cut)
    discard(local)


def _broadcast(spark, rows, n_items: int, mean_len: float, df: dict[str, int]):
    rows = sorted((-1 if i is None else i, t) for i, t in rows)
    classes: dict[int, list[tuple[int, str]]] = {}
    for i, t in rows:
        n = len(words_of(t))
        if n:
            classes.setdefault(max(0, math.ceil(math.log(n / FIRST_LENGTH, 4))), []).append((i, t))
    return spark.sparkContext.broadcast([BlockMaxIndex(classes[c], n_items, mean_len, df) for c in sorted(classes)])


def retrieve_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.6) -> DataFrame:
    """All (document, item) pairs with a passage at or above ``threshold``, with their overlaps.

    Shard by shard: the hits of one are written and its index is given up before the next is built.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"
    return _by_shard(items, lambda index: narrow.mapInArrow(_hit_rows(index, threshold), schema))


def _by_shard(items: DataFrame, run) -> DataFrame:
    """What ``run`` finds with each shard's index; with several shards as written tables, so that one index is held at a time."""
    shards, found = n_shards(items), []
    for index in build_indexes(items):
        here = run(index)
        if shards > 1:
            here = materialize(here, "bm25-hits")
            index.unpersist()
        found.append(here)
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def contaminated(docs: DataFrame, items: DataFrame, overlap: float = 0.8, part_overlap: float = 0.5, **names) -> DataFrame:
    """Verified pairs: ``overlap`` of the item's shingles, ``part_overlap`` of its question's and its answer's."""
    found = retrieve_items(docs, items, **names)
    return found.where((F.col("overlap") >= overlap) & (F.col("question_overlap") >= part_overlap) & (F.col("answer_overlap") >= part_overlap))


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", threshold: float = 0.6, overlap: float = 0.8, part_overlap: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text holds no verified item. Each row is judged where it stands, without a join.

    With several shards of items the rows that one leaves are written and meet the next one's index. Null and empty texts stay,
    repeated rows are judged alike and all stay or go, without items all rows stay, an empty table gives no rows, columns of any
    names pass as they are.
    """
    shards, out = n_shards(items), docs
    for index in build_indexes(items):
        kept = out.mapInArrow(_clean_rows(index, threshold, docs.columns.index(text_col), overlap, part_overlap), docs.schema)
        if shards > 1:
            kept = materialize(kept, "bm25-clean")
            index.unpersist()
            if out is not docs:
                discard(out)
        out = kept
    return out
