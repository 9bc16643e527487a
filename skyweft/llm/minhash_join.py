"""Near-duplicate documents by an inverted join over MinHash signature coordinates.

1. One pass turns each text into its set of word shingles, a 128-bit digest of the set and a
   signature of ``k`` minima, and numbers the rows in the table it writes. Rows with equal sets are
   one node from here on, named by the number of one of them.
2. Each node is posted under its (coordinate, value) pairs. Pairs held by one node link nothing and
   are dropped. A node's postings are put in order of rising frequency and only the first
   ``k - t + 1`` of its ``k`` coordinates stay (prefix merging): two nodes that agree on ``t``
   coordinates share at least one posting of their prefixes, and very common lines or passages come
   last, so that they seldom are in a prefix at all.
3. In each posting every member is compared with the one whose values are the most frequent, which
   among edited copies is the original or near it: collisions of the signatures are counted, pairs
   with ``t`` or more are confirmed on the full sets.
4. Postings whose members are all in one component by then are skipped (skip merging). For the
   members of the others the prefix merge is repeated on full sets, between components only, and
   what comes out is counted and confirmed the same way. No pair inside a component is ever made,
   so a group of m near copies costs m rows, not m * m / 2.
5. Components give the answer.

A pair of similarity s agrees on a coordinate with probability s; with k = 64 and t = 36 a pair at
exactly 0.8 is missed with probability below 1e-5 (binomial tail), higher similarities far less.

Counts per posting are written before they are joined back to the rows they count. The join is then
between two exchanges of its own, and Spark can split a very common value over several tasks. Rows
with very common sets get their answer from a broadcast of at most a thousand rows.

Defined cases: a null or empty text, or one without words, has no shingles and is linked with
nothing. A text with fewer words than ``width`` has its whole word sequence as its one shingle. Each
row is judged by its own text, also where rows share a doc_id. A row with a null doc_id is not
linked: its component_id is null and kept is true. Repeated rows each get a row. An empty table gives
no rows. Any further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweft.llm.batches import sliced
from skyweft.operators.components import connected_components
from skyweft.operators.skew import spread_join
from skyweft.session import discard, materialize

#: A-Z to a-z; words are runs of anything but space and the controls 9 to 13. Fixed by the contract.
IN_WORD = np.array([c != 32 and not 9 <= c <= 13 for c in range(256)])
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Node ids up to this many (some 150 bytes each as a hash table) are broadcast to filter texts; more are joined by a shuffle.
BROADCAST_IDS = 200_000
#: Members of one posting that are compared with its leader in one task.
LEADER_SLICE = 512


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _constants(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word: the sum of mixed (byte, place in the word) codes."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER), np.uint8) if text else np.empty(0, np.uint8)
    at = np.flatnonzero(IN_WORD[data])
    if not len(at):
        return np.empty(0, np.uint64)
    first = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
    place = at - np.repeat(at[first], np.diff(np.append(first, len(at))))
    return np.add.reduceat(_mix((data[at].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(8)) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), first)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of ``text``."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = min(width, len(h))
    mult = _constants(width, 7)
    acc = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        part = h[i : len(h) - n + 1 + i] * mult[i]
        acc += part ^ (part >> np.uint64(32))
    acc = _mix(acc + np.uint64(n))
    acc.sort()
    return acc[np.concatenate([[True], acc[1:] != acc[:-1]])]


def signature(shingles: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each of ``k`` linear hash orders over the set, as 32 bits each."""
    a, b = _constants(k, 101)[:, None], _constants(k, 977)[:, None]
    best = np.full(k, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(shingles), 4096):
        part = shingles[None, lo : lo + 4096] * a
        part += b
        best = np.minimum(best, part.min(axis=1))
    return (best >> np.uint64(32)).astype(np.uint32)


def _signatures(width: int, k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("content", pa.binary()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sig", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                ns, digests, sigs = [], [], []
                for text in part.column(2).to_pylist():
                    s = shingle_set(text, width)
                    ns.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sigs.append(signature(s, k).view(np.int32) if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))], schema=schema)

    return run, "doc_id long, content binary, n_shingles long, digest binary, sig array<int>"


def _confirm(width: int, num: int, den: int):
    """Rows come sorted by (leader, part), the leader's own text first; yields confirmed pairs."""

    def run(batches):
        now, base = None, None
        for batch in sliced(batches):
            src, dst = [], []
            leaders, parts, firsts, nodes, texts = (batch.column(i).to_pylist() for i in range(5))
            for a, p, first, b, text in zip(leaders, parts, firsts, nodes, texts, strict=True):
                s = shingle_set(text, width)
                if first == 0:
                    base = [s] if now != (a, p) else [*base, s]
                    now = (a, p)
                    continue
                for one in base if now == (a, p) else ():
                    both = len(np.intersect1d(one, s, assume_unique=True))
                    if len(s) and den * both >= num * (len(one) + len(s) - both):
                        src.append(b)
                        dst.append(a)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return run


def _confirmed(pairs: DataFrame, texts: _Texts, width: int, num: int, den: int) -> DataFrame:
    """Pairs (src, dst) whose full sets are similar enough. dst is the leader, shared by many."""
    texts = texts.of(pairs.select(F.col("src").alias("node")).unionByName(pairs.select(F.col("dst").alias("node"))))
    fan = pairs.groupBy("dst").agg(F.count(F.lit(1)).alias("n_pairs"))
    sliced = pairs.join(fan, "dst").withColumn("part", F.pmod(F.xxhash64("src"), F.ceil(F.col("n_pairs") / LEADER_SLICE)))
    member = sliced.join(texts, sliced.src == texts.node).select(F.col("dst").alias("a"), "part", F.lit(1).alias("later"), F.col("src").alias("b"), "text")
    heads = sliced.select("dst", "part").distinct()
    head = heads.join(texts, heads.dst == texts.node).select(F.col("dst").alias("a"), "part", F.lit(0).alias("later"), F.col("dst").alias("b"), "text")
    rows = head.unionByName(member)
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", "later").mapInArrow(_confirm(width, num, den), "src long, dst long")


def _agreeing(a: str, b: str):
    """On how many coordinates two signatures agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda acc, x: acc + x)


def _counted(pairs: DataFrame, sigs: DataFrame, t: int) -> DataFrame:
    """Pairs whose signatures agree on ``t`` coordinates or more."""
    left = sigs.select(F.col("node").alias("src"), F.col("sig").alias("sa"))
    right = sigs.select(F.col("node").alias("dst"), F.col("sig").alias("sb"))
    return pairs.join(left, "src").join(right, "dst").where(_agreeing("sa", "sb") >= t).select("src", "dst").distinct()


def _sets(width: int):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                sets = [shingle_set(t, width) for t in part.column(1).to_pylist()]
                sid = [int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True) for x in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sid, pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["node", "sid", "shingles"])

    return run


def _across(held: DataFrame, comp: DataFrame, texts: _Texts, width: int, num: int, den: int, keep) -> DataFrame:
    """Pairs (src, dst) of different components that may be similar, for the nodes of postings that span components.

    The prefix merge is repeated on the full sets of those nodes. In an order of rising frequency, two
    sets with a similarity of num / den share one of their first n - ceil(num / den * n) + 1 shingles, and
    at the first one they share enough shingles are left behind it in both. Both conditions are
    necessary, so no link is lost, and families of texts that stay below the threshold by their
    own rare shingles make no pairs.
    """
    placed = held.join(comp, "node", "left").select("node", "key", F.coalesce("component", "node").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("key")
    nodes = placed.join(mixed, "key").select("node", "comp").distinct()
    sets = keep(texts.of(nodes.select("node")).mapInArrow(_sets(width), "node long, sid long, shingles array<long>"), "sets")
    each = sets.select("node", "sid", F.size("shingles").alias("n"), F.explode("shingles").alias("g"))
    often = keep(each.groupBy("g").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "df")
    own = each.join(often, "g").groupBy("node", "sid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("own"))
    own = own.withColumns({"single": F.expr("n - size(own)"), "room": F.expr(f"size(own) - cast(floor(({num}L * n + {den - 1}) / {den}) as int) + 1")}).where("room > 0")
    first = own.select("node", "n", "single", F.posexplode(F.slice("own", F.lit(1), F.col("room"))).alias("i", "p"))
    first = first.join(nodes, "node").select("node", "comp", "n", F.col("p.g").alias("g"), (F.col("single") + F.col("i")).alias("at"))
    first = keep(first, "first")
    sizes = first.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("m"))
    split = sizes.groupBy("g").agg(F.max(F.struct("m", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")).where("comps > 1").select("g", F.col("top.comp").alias("big"))
    split = keep(split, "split")
    rows = first.join(split, "g")
    one = lambda p: [F.col(c).alias(f"{p}_{c}") for c in ("g", "node", "comp", "n", "at", "big")]
    fits = f"a_comp <> b_comp and (b_comp = b_big or a_node > b_node) and {num + den}L * (1 + least(a_n - a_at - 1, b_n - b_at - 1)) >= {num}L * (a_n + b_n)"
    pairs = rows.where("comp <> big").select(*one("a")).join(rows.select(*one("b")), (F.col("a_g") == F.col("b_g")) & F.expr(fits))
    return pairs.select(F.greatest("a_node", "b_node").alias("src"), F.least("a_node", "b_node").alias("dst")).distinct()


def _content(text: str):
    """128 bits that stand for a text in joins."""
    return F.unhex(F.md5(F.col(text).cast("string")))


class _Linked:
    """Rows with their sets' digests, and the component of every digest; ``discard`` deletes the tables behind them."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int, k: int, t: int):
        narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        run, schema = _signatures(width, k)
        rows = narrow.select("doc_id", _content("text").alias("content"), "text").mapInArrow(run, schema)
        self.rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "minhash-sig")
        used = [self.rows]

        def keep(df: DataFrame, label: str) -> DataFrame:
            used.append(materialize(df, f"minhash-{label}"))
            return used[-1]

        self.used = used
        linked = self.rows.where("doc_id is not null and digest is not null")
        first = F.min(F.struct("doc_id", "row", "content", "n_shingles", "sig")).alias("f")
        named = linked.groupBy("digest").agg(first, F.count(F.lit(1)).alias("n_rows"))
        sigs = keep(named.select(F.col("f.row").alias("node"), "digest", "n_rows", F.col("f.doc_id").alias("doc_id"), F.col("f.content").alias("content"), F.col("f.n_shingles").alias("size"), F.col("f.sig").alias("sig")), "node")
        posted = sigs.select("node", "size", F.posexplode("sig").alias("pos", "val")).select("node", "size", (F.shiftleft(F.col("pos").cast("long"), 32) + F.expr("val & 4294967295L")).alias("key"))
        often = keep(posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often")
        ordered = (
            posted.join(often, "key")
            .groupBy("node")
            .agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("own"), F.sum("n").alias("rank"), F.min("size").alias("low"), F.max("size").alias("high"))
            .withColumn("room", F.size("own") - F.lit(t - 1))
            .where("room > 0")
            .withColumn("keys", F.transform(F.slice("own", F.lit(1), F.col("room")), lambda p: p["key"]))
        )
        prefix = keep(ordered.select("node", "rank", "low", "high", "keys"), "prefix")
        held = prefix.select("node", "rank", "low", "high", F.explode("keys").alias("key"))

        lead = held.groupBy("key").agg(F.max(F.struct("rank", (-F.col("node")).alias("least"), F.col("low").alias("l"), F.col("high").alias("h"))).alias("top"), F.count(F.lit(1)).alias("m")).where("m > 1")
        lead = keep(lead.select("key", (-F.col("top.least")).alias("dst"), F.col("top.l").alias("l"), F.col("top.h").alias("h")), "lead")
        star = held.join(lead, "key").where(f"node <> dst and {den} * high >= {num} * l and {den} * h >= {num} * low").select(F.col("node").alias("src"), "dst").distinct()
        texts = _Texts(narrow, sigs)
        star = keep(_counted(star, sigs, t), "star")
        found = keep(_confirmed(star, texts, width, num, den), "link")
        comp = keep(connected_components(found), "comp")

        rest = keep(_across(held.select("node", "key"), comp, texts, width, num, den, keep), "across")
        rest = rest.join(star.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), ["src", "dst"], "left_anti")
        rest = keep(_counted(rest, sigs, t), "rest")
        if not rest.isEmpty():
            found = found.unionByName(_confirmed(rest, texts, width, num, den))
            comp = keep(connected_components(found), "comp")

        both = sigs.select("node", "digest", "n_rows", "doc_id", "content").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
        best = both.groupBy("component").agg(F.min(F.struct("doc_id", "node", "content")).alias("best"))
        #: (digest, n_rows, label, content): the smallest doc_id of the digest's component and that row's text, for digests of more than one row.
        label = both.join(best, "component").select("digest", "n_rows", "node", F.col("best.doc_id").alias("label"), F.col("best.content").alias("label_content"))
        self.label = keep(label, "label")

    def judged(self) -> DataFrame:
        """``(doc_id, content, n_shingles, label, label_content)`` per row; no label without shingles or id."""
        rows = self.rows.select("doc_id", "content", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
        return spread_join(rows, self.label.drop("node"), "digest", "n_rows").drop("digest")

    def discard(self) -> None:
        for df in self.used:
            discard(df)


class _Texts:
    """Texts by node, for the nodes of a table: a second pass over the documents that keeps theirs only."""

    def __init__(self, narrow: DataFrame, sigs: DataFrame):
        self.narrow, self.named = narrow, sigs.select("node", "content")

    def of(self, nodes: DataFrame) -> DataFrame:
        want = self.named.join(nodes.distinct(), "node")
        n = want.count()
        want = F.broadcast(want) if n <= BROADCAST_IDS else want
        some = self.narrow.where("doc_id is not null").select(_content("text").alias("content"), "text").join(want, "content")
        return some.select("node", "text").dropDuplicates(["node"])


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100, k: int = 64, t: int = 36
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row of ``docs``.

    Links two documents when ``den * |A and B| >= num * |A or B|`` for their sets of ``width``-word
    shingles; see the module text.
    """
    linked = _Linked(docs, id_col, text_col, width, num, den, k, t)
    out = linked.judged()
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    out = materialize(out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")), "minhash-answer")
    linked.discard()
    return out


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100, k: int = 64, t: int = 36) -> DataFrame:
    """``docs`` with one row of each group of near copies: that with the smallest id, of rows with this id one.

    Rows are judged by their texts: rows that share an id but not the text both stay where neither is a
    near copy of a row that stays. Rows without words or with a null id stay. Columns may have any names.
    """
    linked = _Linked(docs, id_col, text_col, width, num, den, k, t)
    groups = linked.label.groupBy("label", "label_content").agg(F.sum("n_rows").alias("n"), F.count(F.lit(1)).alias("sets"))
    several = materialize(groups.where("n > 1").select("label", "label_content"), "minhash-groups")
    judged = linked.judged().join(several.withColumn("more", F.lit(True)), ["label", "label_content"]).select("doc_id", "content", ((F.col("doc_id") == F.col("label")) & (F.col("content") == F.col("label_content"))).alias("best"))
    judged = materialize(judged.groupBy("doc_id", "content").agg(F.max("best").alias("best"), F.count(F.lit(1)).alias("n")), "minhash-kept")
    linked.discard()
    marks = judged.where("not best or n > 1").select(F.col("doc_id").alias("k_id"), F.col("content").alias("k_content"), (F.col("best") & (F.col("n") > 1)).alias("again"))
    marks = F.broadcast(marks) if marks.count() <= BROADCAST_IDS else marks
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), F.col(id_col).cast("long").alias("k_id"), _content(text_col).alias("k_content"))
    kept = whole.join(marks, ["k_id", "k_content"], "left").where("again is null or again")
    one = kept.where("again").groupBy("k_id", "k_content").agg(F.first("r").alias("r"))
    return kept.where("again is null").select("r.*").unionByName(one.select("r.*"))
