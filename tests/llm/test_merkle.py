"""The manifest against a tree built in lists, at every size of a tree around the runs and buckets."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from skyweft.llm import merkle_manifest, queries

def _plain(rows):
    sha = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()

    def build(hashes):
        levels = [list(hashes)]
        while len(levels[-1]) > 1:
            levels.append([sha(levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
        return levels

    def walk(levels, at, fold):
        siblings = []
        for nodes in levels[:-1]:
            lo = at - at % 16
            before, after = nodes[lo:at], nodes[at + 1 : lo + 16]
            siblings += before + after
            fold, at = sha([*before, fold, *after]), at // 16
        return siblings, fold

    trees = {}
    for tree, i, leaf, altered in rows:
        trees.setdefault(tree, []).append((i is not None, i or 0, leaf, altered, i))
    names = sorted(trees, key=lambda t: t.encode())
    built = {t: build([r[2] for r in sorted(trees[t], key=lambda r: r[:3])]) for t in names}
    top = build([built[t][-1][0] for t in names])
    out = []
    for k, t in enumerate(names):
        for at, (_, _, leaf, altered, i) in enumerate(sorted(trees[t], key=lambda r: r[:3])):
            inner, fold = walk(built[t], at, altered or leaf)
            outer, fold = walk(top, k, fold)
            out.append((i, leaf, built[t][-1][0], top[-1][0], sha(inner + outer), fold, fold == top[-1][0]))
    return out


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _lower(text):
    return None if text is None else text.translate({c: c + 32 for c in range(65, 91)})


def _leaves(rows):
    out = []
    for i, source, lang, n, text in rows:
        leaf = _sha("".join(map(_field, (i, source, lang, n, text))))
        altered = _sha("".join(map(_field, (i, source, lang, n, _lower(text))))) if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else None
        out.append(("-" if source is None else "=" + source, i, leaf, altered))
    return out


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def _want(leaves):
    return sorted(_plain(leaves), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_query_on_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    got = _rows(queries.op12_merkle_manifest(spark, sf))
    assert got == _want(_leaves(rows))
    assert {r[-1] for r in got} == {True, False} and len({r[3] for r in got}) == 1


def test_sql_states_the_same(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    docs = con.execute("SELECT doc_id, source, lang, n_chars, text FROM documents").fetchall()
    assert sorted(con.execute(queries.ORACLE_SQL["op12_merkle_manifest"]).fetchall()) == _want(_leaves(docs))


SIZES = [1, 2, 15, 16, 17, 255, 256, 257, 4095, 4096, 4097, 8193]


def test_sizes_around_runs_and_buckets(spark):
    """Trees of each size, 40 groups of one row besides, so that the tree over the groups has two levels."""
    leaves = [(f"={n:05d}", i, _sha(f"{n}/{i}"), _sha("other") if i % 97 == 5 else None) for n in SIZES for i in range(n)]
    leaves += [(f"=x{k}", k, _sha(f"x{k}"), None) for k in range(40)] + [("-", None, _sha("null"), None)]
    df = spark.createDataFrame(leaves, "tree string, id long, leaf string, altered string")
    assert _rows(merkle_manifest.tree_manifest(df)) == _want(leaves)


def test_hot_tree_and_repeated_rows(spark):
    """Two thirds of all rows are one row that repeats; it fills several buckets and partitions."""
    leaves = [("=hot", 7, _sha("same"), None)] * 9000 + [("=hot", i, _sha(str(i)), None) for i in range(3000)] + [("=b", i, _sha(f"b{i}"), _sha("t")) for i in range(300)]
    df = spark.createDataFrame(leaves, "tree string, id long, leaf string, altered string").repartition(6)
    assert _rows(merkle_manifest.tree_manifest(df)) == _want(leaves)


def test_nulls_empties_and_clashing_columns(spark):
    rows = [(1, None, None, None, None), (2, "", "", 0, ""), (None, "a", "en", 3, "ABC"), (3, "a", "en", 3, "ABC\u00c9"), (3, "a", "en", 3, "ABC\u00c9"), (5, "\u4e2d", "zh", 1, "X" * 300_000), (21, "Z", "en", 1, "Q")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({c: F.lit(1) for c in ("leaf", "tree", "id", "pos", "n", "root")})
    assert _rows(merkle_manifest.document_manifest(docs)) == _want(_leaves(rows))
    assert merkle_manifest.document_manifest(docs.limit(0)).count() == 0


def test_proofs_lead_to_the_root_and_forgeries_do_not(spark, sf):
    leaves = merkle_manifest.document_leaves(spark.read.parquet(f"{sf}/documents.parquet"))
    proofs = merkle_manifest.tree_proofs(leaves)
    good = merkle_manifest.folded_root(F.col("leaf"), F.col("path")) == F.col("root")
    forged = merkle_manifest.folded_root(F.sha2("leaf", 256), F.col("path")) == F.col("root")
    r = proofs.agg(F.count("*").alias("n"), F.sum(good.cast("int")).alias("good"), F.sum(forged.cast("int")).alias("forged"), F.countDistinct("root").alias("roots")).first()
    assert (r.n, r.good, r.forged, r.roots) == (leaves.count(), leaves.count(), 0, 1)


@pytest.mark.parametrize("n", [1, 16, 17, 256, 257, 4096, 4097, 10**9])
def test_levels_of_a_bucket(n):
    assert merkle_manifest._levels(n) == min(3, next(k for k in range(40) if 16**k >= n))
