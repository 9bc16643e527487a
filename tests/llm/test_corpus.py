"""Operators over the whole corpus against brute force, and their defined cases."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skyweft.llm import bm25_wand, host_reputation, minhash_join, pii_semicrf, pu_quality, queries

DOCS = "doc_id long, text string"


# ---- op4


def _sets(rows, width):
    out = {}
    for i, t in rows:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")
        w = [x for x in w if x]
        out.setdefault(i, set()).update({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else ())
    return out


def _components(sets, num=80, den=100):
    ids, up = sorted(sets), {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_near_duplicate_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    sets = _sets(rows, 4)
    want = _components(sets)
    got = queries.op4_minhash_near_dedup(spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def _family(seed, n, edits, length=120):
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[r.randrange(length)] = f"e{r.randrange(10**9)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("edits", [1, 3, 5, 8])
def test_families_of_near_copies(spark, edits):
    rows = list(enumerate(_family(edits, 60, edits) + _family(99 + edits, 5, 1) + _family(edits, 60, 2)))
    sets = _sets(rows, 4)
    want = _components(sets)
    got = minhash_join.near_duplicates(spark.createDataFrame(rows, DOCS), width=4).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_chain_of_links(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[8 * i : 8 * i + 100])) for i in range(30)]
    want = _components(_sets(rows, 4))
    assert len(set(want.values())) == 1
    got = minhash_join.near_duplicates(spark.createDataFrame(rows, DOCS), width=4).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_defined_cases_of_near_duplicates(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "A b"), (5, "a B"), (5, "a B"), (6, "a"), (None, "a b"), (7, "x y z w v " * 5000), (8, "X y z w v " * 5000), (9, None)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"node": F.lit(1), "sig": F.lit(2), "kept": F.lit(3), "digest": F.lit(4)})
    got = minhash_join.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got}
    assert by == {1: (0, 1, True), 2: (0, 2, True), 3: (0, 3, True), 4: (1, 4, True), 5: (1, 4, False), 6: (1, 6, True), None: (1, None, True), 7: (5, 7, True), 8: (5, 7, False), 9: (0, 9, True)}
    assert minhash_join.near_duplicates(df.where("false")).count() == 0
    kept = minhash_join.drop_near_duplicates(df).select("doc_id").collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 2, 3, 4, 6, 7, 9]


def test_rows_are_judged_by_their_texts_not_their_ids(spark):
    a, b, x, y = ("a b c d e f", "only here g h i j", "x one two three four five", "y six seven eight nine ten")
    rows = [(1, a), (5, b), (5, a), (7, x), (7, y), (8, y), (8, y), (9, "p q r s t u"), (9, "p q r s t u"), (None, a), (6, None), (6, None)]
    df = spark.createDataFrame([(i, t, "q", 1, 2, 3) for i, t in rows], "doc_id long, text string, __id string, k_id int, label int, best int").withColumnRenamed("best", "r")
    got = minhash_join.drop_near_duplicates(df)
    assert got.columns == df.columns and got.dtypes == df.dtypes
    assert sorted(((r.doc_id or 0, r.text or "") for r in got.collect())) == sorted([(1, a), (5, b), (7, x), (7, y), (9, "p q r s t u"), (0, a), (6, ""), (6, "")])
    near = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_join.near_duplicates(df).collect()}
    assert {(5, 2, 5, True), (5, 2, 1, False), (7, 2, 7, True), (8, 2, 7, False), (9, 2, 9, True), (None, 2, None, True)} <= near


def test_rows_that_repeat_stay_once(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "g h i j k l")], DOCS)
    assert sorted(r.doc_id for r in minhash_join.drop_near_duplicates(df).collect()) == [1, 2]


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        n, got = 300, []
        both = int(2 * n * share / (1 + share))
        for _ in range(200):
            v = r.integers(0, 2**63, 2 * n - both).astype(np.uint64)
            got.append((minhash_join.signature(v[:n], 64) == minhash_join.signature(v[n - both :], 64)).mean())
        assert abs(np.mean(got) - both / (2 * n - both)) < 0.015


# ---- op6


def _bm25(items, texts, least):
    """All (text, item) with a passage at or above ``least``, by sets of words; passages by an item's class of lengths."""
    words = {i: re.findall(r"\w+", t.lower()) for i, t in items}
    n, mean = len(items), np.mean([len(w) for w in words.values()])
    df = {}
    for w in words.values():
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    kind = {i: next(c for c in range(20) if len(w) <= 32 * 4**c) for i, w in words.items()}
    stride = {c: max(32, *(len(w) for i, w in words.items() if kind[i] == c)) for c in set(kind.values())}
    share = {}
    for i, iw in words.items():
        norm = 1.2 * (0.25 + 0.75 * len(iw) / mean)
        weight = {x: math.log1p((n - df[x] + 0.5) / (df[x] + 0.5)) * iw.count(x) * 2.2 / (iw.count(x) + norm) for x in set(iw)}
        share[i] = {x: v / sum(weight.values()) for x, v in weight.items()}
    out = {}
    for row, t in enumerate(texts):
        ws = re.findall(r"\w+", (t or "").lower())
        for c, step in stride.items():
            for lo in range(0, len(ws), step):
                seen = set(ws[lo : lo + 2 * step])
                for i in words:
                    if kind[i] == c:
                        score = sum(v for x, v in share[i].items() if x in seen)
                        if score >= least:
                            out[row, i] = max(out.get((row, i), 0), score)
    return out


def test_retrieval_equals_brute_force(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()][:30]
    items += [(9001, "short one"), (9002, " ".join(f"long{k % 90}" for k in range(300))), (9003, "short one two three")]
    docs = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    docs += [docs[0][:300] + " " + items[3][1].upper() + " " + docs[1][:300], items[5][1], None, "", "a short one here", items[-2][1] + " x"]
    for threshold in (0.35, 0.6):
        want = _bm25(items, docs, threshold)
        ix = next(bm25_wand.build_indexes(spark.createDataFrame(items, "item_id long, text string"))).value
        assert len(ix) > 1
        for group in (bm25_wand.GROUP_POSTINGS, 50):
            bm25_wand.GROUP_POSTINGS, kept = group, bm25_wand.GROUP_POSTINGS
            got = {(h[0], h[1]): h[2] for h in bm25_wand.search(ix, docs, threshold)}
            bm25_wand.GROUP_POSTINGS = kept
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_blocks_without_a_pivot_term_are_skipped(spark):
    items = [(i, f"common words of all items and rare{i} unlike{i}") for i in range(400)]
    ix = next(bm25_wand.build_indexes(spark.createDataFrame(items, "item_id long, text string"))).value[0]
    seen = []
    ranges = bm25_wand._ranges
    bm25_wand._ranges = lambda lo, hi: seen.append(int((hi - lo).sum())) or ranges(lo, hi)
    try:
        got = bm25_wand.search([ix], ["the common words of all items and rare7 unlike7 stand here"], 0.6)
        assert [h[1] for h in got] == [7] and seen[0] <= 2  # of 402 entries only those of rare words
        seen.clear()
        assert bm25_wand.search([ix], ["common words of all items"], 0.95) == [] and sum(seen) == 0
    finally:
        bm25_wand._ranges = ranges


def test_leak_query(spark, sf):
    """All rows of the query against retrieval and shares of shingles by brute force."""
    items = sorted({(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r.text})
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    cut = lambda t: re.findall(r"\w+", t.lower())
    text = dict(items)
    want = {}
    for (row, item), score in _bm25(items, [t for _, t in docs], 0.6).items():
        held, sentences = grams(cut(docs[row][1])), re.split(r"(?<=[.!?])\s+", text[item].strip())
        parts = [cut(text[item]), cut(" ".join(sentences[:-1] or sentences)), cut(sentences[-1]) if len(sentences) > 1 else []]
        own = "\n".join(["", *cut(docs[row][1]), ""])
        share = [(float("\n".join(["", *p, ""]) in own) if len(p) < 5 else len(grams(p) & held) / len(grams(p))) if p else 1.0 for p in parts]
        if share[0] >= 0.8 and min(share[1:]) >= 0.5:
            want[docs[row][0], item] = (score, *share)
    got = {(r.doc_id, r.item_id): (r.score, r.overlap, r.question_overlap, r.answer_overlap) for r in queries.op6_bm25_decontamination(spark, sf).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    assert {(d, i) for d, t in docs for i, b in items if " ".join(b.split()) in " ".join((t or "").split())} <= got.keys()


def test_words_are_cut_alike_in_all_sizes(spark, monkeypatch):
    items = spark.createDataFrame([(1, "कित x‿y İstanbul a\u200db one two three"), (2, "one two three four five six seven")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so कित x‿y İstanbul a\u200db one two three is here"), (2, "one two three four five six seven")], DOCS)
    one = sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in bm25_wand.retrieve_items(docs, items).collect())
    monkeypatch.setattr(bm25_wand, "SHARD_BYTES", 20)
    assert sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in bm25_wand.retrieve_items(docs, items).collect()) == one
    assert [x[:2] for x in one] == [(1, 1), (2, 2)]


def test_shards_find_the_same(spark, sf, monkeypatch):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = {(r.doc_id, r.item_id, round(r.score, 9)) for r in bm25_wand.contaminated(docs, items).collect()}
    monkeypatch.setattr(bm25_wand, "SHARD_BYTES", 3000)
    assert {(r.doc_id, r.item_id, round(r.score, 9)) for r in bm25_wand.contaminated(docs, items).collect()} == one


def test_defined_cases_of_decontamination(spark):
    items = spark.createDataFrame([(1, "one two three four five six. seven eight."), (2, None), (3, ""), (4, "x y"), (4, "x y")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "zero One two THREE four five six seven eight nine"), (None, "x y"), (3, None), (4, ""), (5, "one two seven eight"), (1, "clean")], DOCS).withColumn("score", F.lit("q"))
    assert sorted((r.doc_id or 0, r.item_id) for r in bm25_wand.contaminated(docs, items).collect()) == [(0, 4), (1, 1)]
    assert sorted(str(r.text) for r in bm25_wand.drop_contaminated(docs, items).collect()) == ["", "None", "clean", "one two seven eight"]
    assert bm25_wand.drop_contaminated(docs, items).columns == docs.columns
    assert bm25_wand.drop_contaminated(docs, items.where("false")).count() == 6
    assert bm25_wand.contaminated(docs.where("false"), items).count() == 0


# ---- op8


def _verdicts(urls, z=1.645, threshold=0.5):
    up = {c: c + 32 for c in range(65, 91)}
    rows = []
    for u in urls:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut].translate(up), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        fit = [(len(h + p), v, h + p) for v, h, p in host_reputation.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, key=lambda f: f[0], default=None)
        rows.append((host, path, best and best[2], best and best[1]))
    hosts = {}
    for h, _, _, v in rows:
        n, k = hosts.get(h, (0, 0))
        hosts[h] = (n + (v is not None), k + (v == "block"))

    def domain(h):
        labels = h.split(".")
        if len(labels) < 2 or not all(labels[-2:]):
            return h
        n = 3 if ".".join(labels[-2:]) in host_reputation.SUFFIXES and len(labels) > 2 and labels[-3] else 2
        return ".".join(labels[-n:])

    suffix = lambda d: ".".join(d.split(".")[-2:]) if ".".join(d.split(".")[-2:]) in host_reputation.SUFFIXES else d.rsplit(".", 1)[-1]

    def rolled(keys):
        out = {}
        for (n, k), key in keys:
            a, b = out.get(key, (0, 0))
            out[key] = (a + n, b + k)
        return out

    domains = rolled((v, domain(h)) for h, v in hosts.items())
    suffixes = rolled((v, suffix(d)) for d, v in domains.items())

    def strength(level):
        c = [(n, k) for n, k in level.values() if n]
        n, k = sum(x for x, _ in c), sum(x for _, x in c)
        if len(c) < 2 or k in (0, n):
            return 2.0
        p = k / n
        s = sum(a * (b / a - p) ** 2 for a, b in c) - (len(c) - 1) * p * (1 - p)
        rho = s / max(1e-9, (n - sum(a * a for a, _ in c) / n - (len(c) - 1)) * p * (1 - p))
        return 1 / min(0.999, max(0.001, rho)) - 1

    n, k = sum(x for x, _ in suffixes.values()), sum(x for _, x in suffixes.values())
    ms, md, mh = strength(suffixes), strength(domains), strength(hosts)
    out = []
    for h, p, rule, v in rows:
        s, d, g = suffixes[suffix(domain(h))], domains[domain(h)], hosts[h]
        rate = (ms * (k + 1) / (n + 2) + s[1]) / (ms + s[0])
        rate = (md * rate + d[1]) / (md + d[0])
        a, b = mh * rate + g[1], mh * (1 - rate) + g[0] - g[1]
        low = a / (a + b) - z * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
        out.append((h, p, rule, v or ("block" if low > threshold else "allow")))
    return out


def test_url_query(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()
    want = dict(zip([r.page_id for r in pages], _verdicts([r.url for r in pages]), strict=True))
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in queries.op8_host_reputation(spark, sf).collect()} == want


def test_defined_cases_of_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/71?x", "ftp://com/en/", "x://net/de/#f", "x://É.org/es/", "a://b://c/d", "x://h.example.com?/en/7", "x://h.example.com/en/8", "x://h.example.com/en/8", "x://:80/", "x://a.shop.co.uk/en/1", "x://b.shop.co.uk/", "x://co.uk/", "x://.co.uk/", "x://x.other.co.uk/", "x://a..b/", "x://b.example.org/es/1"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit(2)})
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in host_reputation.filter_urls(df).collect()}
    assert got == dict(enumerate(_verdicts(urls)))
    assert got[0][:3] == ("", "", None) and got[4][2] == "example.com/en/7" and got[5][2] == "com/en/"
    assert host_reputation.filter_urls(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        host_reputation.filter_urls(df, rules=(("block", "x'y", "/"),))


def test_url_plan_is_native(spark, sf):
    plan = queries.op8_host_reputation(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


# ---- op10


def test_quality_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op10_pu_quality(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == q for p, q in held]) > 0.95


def _feature_table(spark, seed, n=400, prior=0.3):
    """Texts of two made-up classes as (x, positive, fold); a third of the good ones is trusted."""
    r = random.Random(seed)
    texts, good = [], []
    for _ in range(n):
        good.append(r.random() < prior)
        words = [("w" if good[-1] or r.random() < 0.4 else "#!") + "".join(r.choice("abcdef") for _ in range(r.randint(2, 7))) for _ in range(r.randint(5, 40))]
        texts.append(" ".join(words))
    rows = [([float(np.float32(v)) for v in pu_quality.features(t)], g and r.random() < 0.33, r.randrange(pu_quality.FOLDS)) for t, g in zip(texts, good, strict=True)]
    return spark.createDataFrame(rows, "x array<float>, positive boolean, fold int").coalesce(3).cache(), rows, good


def test_the_fit_minimises_the_risk(spark):
    """The weights against the risk summed row by row: no direction lowers it, and its gradient by differences is zero."""
    table, rows, _ = _feature_table(spark, 1)
    at = pu_quality._Scale(table)
    x = (np.array([v for v, _, _ in rows]) - at.mean) / at.scale
    p, fold = np.array([b for _, b, _ in rows]), np.array([k for _, _, k in rows])

    def risk(w, ridge, rows_of):
        plus = minus = unl = 0.0
        for v, hit, ok in zip(x, p, rows_of, strict=True):
            if ok:
                z = float(v @ w)
                unl += math.log1p(math.exp(-abs(z))) + max(z, 0)
                if hit:
                    minus += math.log1p(math.exp(-abs(z))) + max(z, 0)
                    plus += math.log1p(math.exp(-abs(z))) + max(-z, 0)
        n, m = rows_of.sum(), (p & rows_of).sum()
        assert unl / n - prior * minus / m > 0
        return prior * plus / m + unl / n - prior * minus / m + ridge / 2 * float(w[1:] @ w[1:])

    prior = 0.1
    models = [(0.1, -1), (0.1, 1), (1.0, -1)]
    r = np.random.default_rng(0)
    for (ridge, left_out), w in zip(models, pu_quality._newton(table, at, prior, models), strict=True):
        own = fold != left_out
        here = risk(w, ridge, own)
        for _ in range(12):
            d = r.normal(size=len(w))
            d *= 1e-3 / np.linalg.norm(d)
            a, b = risk(w + d, ridge, own), risk(w - d, ridge, own)
            assert here <= a + 1e-12 and here <= b + 1e-12 and abs(a - b) / 2e-3 < 1e-4


def test_the_prior_comes_from_positives_and_unlabelled_texts(spark):
    for prior in (0.2, 0.5, 0.8):
        table, _, good = _feature_table(spark, 2, 1500, prior)
        assert abs(pu_quality.estimate_prior(table, pu_quality._Scale(table)) - np.mean(good)) < 0.08


def test_negative_labels_are_not_learnt_from(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    a, b = ({r.doc_id: r.score for r in pu_quality.score_quality(docs, x).collect()} for x in (labels, labels.where("quality = 1")))
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-6 for i in a)


def test_held_out_labels_are_not_learnt_from(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    lied = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in pu_quality.score_quality(docs, x).collect()} for x in (labels, lied))
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-6 for i in a)


def test_defined_cases_of_quality(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (4, "a b"), (4, "a b"), (5, "q " * 40_000)], DOCS).withColumns({"x": F.lit(1), "positive": F.lit(True)})
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (4, 1)], "doc_id long, quality int")
    rows = pu_quality.score_quality(docs, labels).collect()
    assert len(rows) == 6 and len({r.score for r in rows if r.doc_id == 4}) == 1 and len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert all(abs(r.score - 0.5) < 1e-9 for r in pu_quality.score_quality(docs, labels.where("false")).collect())
    assert pu_quality.score_quality(docs.where("false"), labels).count() == 0
    assert pu_quality.keep_quality(docs, labels.where("false")).columns == docs.columns


# ---- pipeline


def test_pipeline_equals_its_stages_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, items = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    good = {r.doc_id for r in pu_quality.score_quality(docs, labels).where("predicted = 1").select("doc_id").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    comp = _components(_sets(texts.items(), 5))
    texts = {i: t for i, t in texts.items() if comp[i] == i}
    leak = lambda t: any(" ".join(b.text.split()) in " ".join(t.split()) for b in items)
    clean = {i: t for i, t in texts.items() if not leak(t)}
    w = dict(pii_semicrf.default_weights())
    from skyweft.llm.bpe_tree import encoder

    want = {i: len(encoder().encode(pii_semicrf.masked(t, pii_semicrf.find_spans(t, w)[1]))) for i, t in clean.items()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert got.keys() == want.keys()
    assert all(r.n_tokens == want[i] == len(r.ids) for i, r in got.items())


def test_stages_judge_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = [r.text for r in docs.where("length(text) > 400").orderBy("doc_id").limit(4).collect()]
    made = spark.createDataFrame([(1, text[0]), (1, text[1]), (2, text[1]), (3, text[2]), (3, text[2]), (None, text[3]), (4, None), (4, "")], DOCS)
    made = made.withColumns({"__id": F.lit("a"), "k_id": F.lit(1), "r": F.lit(2), "content": F.lit(3), "label": F.lit(4), "n_chars": F.length("text")})
    stages = dict(corpus_pipeline.STAGES)
    got = stages["near_dedup"](spark, made, sf)
    assert got.columns == made.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted([(1, text[0]), (1, text[1]), (3, text[2]), (0, text[3]), (4, ""), (4, "")])
    assert stages["decontaminate"](spark, made, sf).columns == made.columns and stages["quality"](spark, made, sf).columns == made.columns
    assert stages["pii"](spark, made, sf).count() == stages["encode"](spark, made, sf).count() == made.count()


def test_stages_keep_the_columns_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "pii", "encode"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        assert stage(spark, docs.where("false"), sf).count() == 0
