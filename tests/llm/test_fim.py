"""Fill-in-the-middle: units, forms and digests against plain regular expressions."""

import hashlib
import random
import re

import pyarrow as pa
import pytest

from skyweft.llm import batches, fim_scan, queries

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def _plain_way(text, doc):
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("window", [5, 64, fim_scan.WINDOW])
def test_units_and_outputs_of_random_texts(monkeypatch, window):
    monkeypatch.setattr(fim_scan, "WINDOW", window)
    r = random.Random(window)
    forms = set()
    for k in range(3000):
        text = "".join(r.choice("abZP<>SM é中 .\n\U0001f600") for _ in range(r.randrange(40)))
        units, want = fim_scan.Units(text, fim_scan.automaton()), UNIT.findall(text)
        assert units.n == len(want)
        assert [units.end(i) for i in range(len(want) + 1)] == [len("".join(want[:i])) for i in range(len(want) + 1)]
        got = fim_scan.transform(text, k)
        assert got == _plain_way(text, k)
        assert fim_scan.restore(got[4], got[1]) == text
        forms.add(got[1])
    assert forms == {"plain", "psm", "spm"}


def test_query_on_the_whole_table(spark, sf):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n, form, pre, mid, out = _plain_way(r.text or "", r.doc_id)
        want[r.doc_id] = (n, form, pre, mid, sha(out), sha(r.text or ""))
    got = queries.op13_fim_scan(spark, sf).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def test_defined_cases(spark):
    long = "word, " * 400_000
    rows = [(1, None), (2, ""), (None, "a b c"), (4, "a <P> b"), (5, "twice"), (5, "twice"), (6, long), (7, "\x00\x0b 中")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string")
    got = {(r.doc_id, r.n): r for r in fim_scan.fim_digests(docs).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert tuple(got[1, 0])[2:] == tuple(got[2, 0])[2:] == ("plain", None, None, empty, empty)
    assert got[4, 7].form == "plain" and (None, 5) in got and (6, 1_200_000) in got
    assert all(r.restored_sha256 == hashlib.sha256((dict(rows)[r.doc_id] or "").encode()).hexdigest() for r in got.values())
    assert fim_scan.fim_digests(docs).count() == len(rows)
    assert fim_scan.fim_digests(docs.limit(0)).count() == 0


def test_texts_out_and_back_with_other_sentinels(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    marks = ("\u27e6pre\u27e7", "\u27e6suf\u27e7", "\u27e6mid\u27e7")
    out = fim_scan.fim_documents(docs, sentinels=marks, plain=0, suffix_first=50)
    back = fim_scan.restored_documents(out, sentinels=marks).select("text", "fim", "fim_form", "restored").collect()
    assert len(back) == docs.count() and all((r.text or "") == r.restored for r in back)
    assert {r.fim_form for r in back} >= {"psm", "spm"} and any(r.fim.startswith(marks[1]) for r in back)
    assert out.columns == [*docs.columns, "fim", "fim_form"]


@pytest.mark.parametrize("bad", [("<P>", "<P>", "<M>"), ("ab", "ba", "c"), ("<", "<S>", "<M>"), ("", "<S>", "<M>")])
def test_sentinels_that_can_not_be_told_apart(bad):
    with pytest.raises(ValueError):
        fim_scan.EventAutomaton(bad)


def test_outputs_that_are_none():
    with pytest.raises(ValueError):
        fim_scan.restore("no sentinels", "psm")


def test_slices_are_bounded_by_bytes():
    batch = pa.RecordBatch.from_pydict({"i": pa.array(range(7)), "t": pa.array(["a" * 10, None, "b" * 95, "c" * 300, "", "d" * 50, "e" * 50])})
    parts = list(batches.sliced([batch], rows=3, most=100))
    assert [p.num_rows for p in parts] == [2, 1, 1, 3]
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert list(batches.sliced([batch.slice(0, 0)])) == []
