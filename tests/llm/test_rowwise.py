"""Operators on single rows against brute force, and their defined cases."""

import hashlib
import html as H
import random
import re
import time
import zlib

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import public_tokenizers
from skyweft.llm import bpe_tree, html_maxsub, pii_semicrf, queries, secret_dfa, tiff_media, token_offsets

ODD = [(1, ""), (2, None), (None, "abc"), (4, "é日😀 x"), (4, "é日😀 x"), (5, "word " * 30_000), (6, "a" * 50_000), (7, " \n\t\x0b "), (8, "password=abcdef AKIA" + "0" * 16)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", "y", 0) for i, t in ODD], "doc_id long, text string, score string, node string, n_tokens int")


def _docs(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def test_each_operator_takes_odd_rows_and_empty_tables(odd):
    for run in (tiff_media.text_media, secret_dfa.find_secrets, bpe_tree.encoding_digests, bpe_tree.encode_documents, pii_semicrf.find_personal_data):
        rows = run(odd).collect()
        assert sorted(r.doc_id or 0 for r in rows) == sorted(i or 0 for i, _ in ODD)
        twice = [tuple(r) for r in rows if r.doc_id == 4]
        assert twice[0] == twice[1]
        assert run(odd.where("false")).count() == 0
    assert token_offsets.section_tokens(odd.where("false")).count() == 0
    assert [r.n_tokens for r in token_offsets.section_tokens(odd.where("doc_id in (1, 2)")).collect()] == [0, 0]


# ---- op1


def test_media_query(spark, sf):
    want = {}
    for i, t in _docs(spark, sf):
        raw = (t or "").encode()
        pay = raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0))
        want[i] = (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
    rows = queries.op1_tiff_media(spark, sf).collect()
    assert {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows} == want
    assert all(r.media_bytes > 0 and len(r.media_sha256) == 64 for r in rows)


def test_media_and_feature_of_the_query(spark, sf):
    """The stored form is read with zlib alone, the feature is counted byte by byte."""
    import struct

    texts = dict(_docs(spark, sf))
    media = {r.id: bytes(r.media) for r in tiff_media.text_tiffs(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    for r in queries.op1_tiff_media(spark, sf).collect()[:60]:
        blob, pay = media[r.doc_id], (texts[r.doc_id] or "").encode()
        pay += b"\0" * (-len(pay) % 64 or (64 if not pay else 0))
        assert (r.media_bytes, r.media_sha256) == (len(blob), hashlib.sha256(blob).hexdigest())
        at, pages, back = struct.unpack_from("<I", blob, 4)[0], 0, b""
        while at:
            n = struct.unpack_from("<H", blob, at)[0]
            tag = {}
            for k in range(n):
                t, _, count, value = struct.unpack_from("<HHII", blob, at + 2 + 12 * k)
                tag[t] = [value] if count == 1 else list(struct.unpack_from(f"<{count}I", blob, value))
            for a, size in zip(tag[273], tag[279], strict=True):
                raw = zlib.decompress(blob[a : a + size])
                for lo in range(0, len(raw), 64):
                    total = 0
                    for c in raw[lo : lo + 64]:
                        total = (total + c) % 256
                        back += bytes((total,))
            at, pages = struct.unpack_from("<I", blob, at + 2 + 12 * n)[0], pages + 1
        assert back == pay
        steps = sum(abs(x - y) for lo in range(0, len(pay), 64) for x, y in zip(pay[lo : lo + 63], pay[lo + 1 : lo + 64], strict=True))
        assert r.feature == f"64x{len(pay) // 64};pages={pages};sum={sum(pay)};steps={steps};values={len(set(pay))}"


def _tiff(tags, data):
    """A one-page file of whole numbers as tags and one segment of ``data``."""
    import struct

    tags = {273: 8, 279: len(data), 278: tags.get(257, 1)} | tags
    fields = b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in sorted(tags.items()))
    return b"II*\0" + struct.pack("<I", 8 + len(data)) + data + struct.pack("<H", len(tags)) + fields + b"\0\0\0\0"


@pytest.mark.parametrize("bits,data,want", [(1, b"\xa0\x40", [1, 0, 1, 0, 1, 0]), (4, b"\x12\x30\x45\x60", [1, 2, 3, 4, 5, 6]), (16, bytes(range(12)), None), (32, bytes(range(24)), None)])
def test_samples_of_other_widths(bits, data, want):
    page = next(tiff_media.walk_pages(_tiff({256: 3, 257: 2, 258: bits, 259: 1}, data)))
    assert list(page.data) == (want or list(data))


def test_sixteen_bit_predictor():
    steps = np.array([[300, 65535, 2], [1, 1, 1]], "<u2")
    page = next(tiff_media.walk_pages(_tiff({256: 3, 257: 2, 258: 16, 259: 1, 317: 2}, steps.tobytes())))
    assert np.frombuffer(page.data, "<u2").tolist() == [300, 299, 301, 1, 2, 3]


@pytest.mark.parametrize("tags", [{256: 0}, {257: 0}, {278: 0}, {277: 0}, {256: 2**31, 257: 2**31}, {257: 2**32 - 1}, {322: 0, 323: 16, 324: 8, 325: 6}, {322: 2**31, 323: 2**31, 324: 8, 325: 6}, {258: 7}, {259: 9}, {279: 2**32 - 1, 256: 2**20}])
def test_impossible_sizes_give_a_reason(spark, tags):
    blob = _tiff({256: 3, 257: 2, 258: 8, 259: 1} | tags, b"abcdef")
    got = tiff_media.tiff_pages(spark.createDataFrame([(1, blob)], "id long, b binary"), "id", "b").collect()
    assert [(r.page, bool(r.error)) for r in got] == [(-1, True)]


@pytest.mark.parametrize("compression", [tiff_media.NONE, tiff_media.LZW, tiff_media.DEFLATE, tiff_media.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, 16, 48])
def test_pages_round_trip(compression, predictor, tile):
    r = random.Random(compression * 10 + predictor)
    for rows in (1, 3, 70):
        data = bytes(r.choice((0, 0, 0, 65, r.randrange(256))) for _ in range(64 * rows))
        pages = list(tiff_media.walk_pages(tiff_media.write_tiff(data, compression, predictor, tile, page_rows=30)))
        assert b"".join(p.data for p in pages) == data
        assert [p.index for p in pages] == list(range(-(-rows // 30)))


def test_codecs_on_long_and_tight_data():
    r = random.Random(3)
    for n, kinds in ((0, 2), (1, 2), (20_000, 2), (20_000, 256), (5000, 1)):
        d = bytes(r.randrange(kinds) for _ in range(n))
        assert tiff_media.lzw_decode(tiff_media.lzw_encode(d), n) == d
        assert tiff_media.packbits_decode(tiff_media.packbits_encode(d), n) == d


def test_broken_media_gives_a_reason(spark):
    good = tiff_media.write_tiff(bytes(range(64)) * 4)
    ring = bytearray(good)
    ring[-4:] = good[4:8]
    rows = [(1, None), (2, b"no"), (3, good[:-30]), (4, bytes(ring)), (5, good), (6, good[:8])]
    got = tiff_media.tiff_pages(spark.createDataFrame(rows, "id long, b binary"), "id", "b").collect()
    assert {r.id for r in got if r.error} == {1, 2, 3, 4, 6}
    assert [(r.page, bytes(r.data)) for r in got if r.id == 5] == [(0, bytes(range(64)) * 4)]
    assert [r.page for r in got if r.id == 4] == [0, -1]


def test_big_endian_planar_pages():
    import struct

    planes = [bytes(range(12)), bytes(range(100, 112))]
    tags = [(256, 4, 1, 4), (257, 4, 1, 3), (258, 3, 2, (8 << 16) | 8), (259, 3, 1, 1 << 16), (277, 3, 1, 2 << 16), (278, 4, 1, 3), (284, 3, 1, 2 << 16)]
    data = b"".join(planes)
    at = 8 + len(data)
    body = struct.pack(">IIII", 8, 20, 12, 12)
    tags += [(273, 4, 2, at), (279, 4, 2, at + 8)]
    fields = b"".join(struct.pack(">HHII", *t) for t in sorted(tags))
    blob = b"MM\0*" + struct.pack(">I", at + 16) + data + body + struct.pack(">H", len(tags)) + fields + b"\0\0\0\0"
    page = next(tiff_media.walk_pages(blob))
    assert page.data == bytes(x for pair in zip(*planes, strict=True) for x in pair)


# ---- op2

ASSIGN = re.compile(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def _base_secrets(x):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(x) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", x) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", x) if m.end() - m.start() >= 24]
    return [(a, b, k) for a, _, b, k in sorted(out)]


def test_automaton_equals_the_patterns():
    r = random.Random(1)
    pool = ["password", "passwd", "SECRET", "toKen", "api_key", "APIKEY", '"', "'", " ", ":", "=", "AKIA", "ABCDEF0123456789", "deadbeef", "0123", "a", "é", "日", ".", "/", "x", "AK", "pass", "ghp_"]
    for _ in range(4000):
        x = "".join(r.choice(pool) for _ in range(r.randint(1, 25)))
        assert [s for s in secret_dfa.scan_text(x) if s[2] in ("assign", "access", "hex")] == _base_secrets(x)


def test_secret_query(spark, sf):
    got = {r.doc_id: r for r in queries.op2_secret_automaton(spark, sf).collect()}
    for i, t in _docs(spark, sf):
        base = _base_secrets(t or "")
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for *_, k in base) for n in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
        assert all(f"{k}:{a}:{b}" in r.spans.split(",") for a, b, k in base)


@pytest.mark.parametrize(
    "text",
    ["secret=token = " + "a" * 1_000_000, "secret" + " " * 1_000_000 + "=x", "token=" * 150_000, "AKIA" * 250_000, "a" * 1_000_000, "password: abc " * 70_000, "-----BEGIN " + "A " * 500_000, "eyJa.eyJ" * 120_000, "secret = " + "token=" * 100_000 + "\u00e9"],
)
def test_long_values_take_linear_time(text):

    start = time.perf_counter()
    got = secret_dfa.scan_text(text)
    assert time.perf_counter() - start < 30
    assert [s for s in got if s[2] in ("assign", "access", "hex")] == _base_secrets(text)


def test_automaton_is_minimal_and_more_kinds():
    d = secret_dfa.Dfa((secret_dfa.Rule("k", "(ab|cb)(x|y)"),), anchored=True)
    assert d.states == 5  # start, first letter, b, match, dead
    x = "gh ghp_" + "a1B2" * 9 + " -----BEGIN RSA PRIVATE KEY-----"
    assert [k for *_, k in secret_dfa.scan_text(x)] == ["hub", "pem"]
    with pytest.raises(ValueError):
        secret_dfa.Dfa((secret_dfa.Rule("k", r"a(?=b)"),), anchored=True)


# ---- op3


def _article(x):
    inner = re.search(r"<article>(.*?)(</article>|\Z)", x, re.S)[1]
    blocks = (re.sub(r"\s+", " ", H.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n\n".join(b for b in blocks if b)


def test_page_query(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op3_html_main_text(spark, sf).collect()
    assert len(rows) == len(pages) and all(r.text == _article(pages[r.page_id]) and r.n_chars == len(r.text) for r in rows)


def test_other_layouts_and_cut_pages():
    w = dict(html_maxsub.default_weights())
    pages = html_maxsub.labelled_pages(150, 77)
    assert np.mean([html_maxsub.main_text(page, w) == main for page, main in pages]) > 0.95
    for page, _ in pages:
        html_maxsub.main_text(page[: len(page) // 2], w)
    text = "one two three four five six"
    page = f"<body><header><h1>site</h1></header><div class='cookie-banner'>we use cookies</div><main><h2>A &amp; B</h2><p>{text}\n\n <i>more</i>x<ul><li>i<li>j</ul><script>var p='<p>no</p>'</script><div class='ad'>buy</div><form>send <input></form></main><section id='comments'><p>{text} {text} {text}</p></section></body>"
    assert html_maxsub.main_text(page, w) == f"A & B\n\n{text} morex\n\ni\n\nj"
    for empty in (None, "", "<p></p>", "<nav>a b c</nav>", "<!-- x", "<script>x", "<p>&nbsp;</p>"):
        assert html_maxsub.main_text(empty, w) == ""


#: Pages written by hand in the manner of real sites: the marks ``+`` and ``-`` begin text to keep and to leave out.
REAL = [
    "<html><head><title>-t</title></head><body class='home blog'><div id='top'><a href='/'>-Example News</a> <a href='/a'>-World</a> <a href='/b'>-Sport</a></div><div class='layout'><div class='story-body'><h1>+Rain floods the valley</h1><span class='byline'>+By A Writer</span><p>+Heavy rain fell on the valley for the third day in a row and closed two roads to the north of the town.</p><figure><img src='x'><figcaption>+The river on Monday morning</figcaption></figure><p>+People who live near the river were asked to move to higher ground until the water falls again.</p></div><div class='sidebar'><h3>-Most read</h3><ul><li><a href='/1'>-Old bridge sold</a></li><li><a href='/2'>-Team wins cup</a></li></ul></div></div><footer><p>-Copyright Example News</p></footer></body></html>",
    "<html><body><nav><ul><li><a href='/'>-Home</a><li><a href='/docs'>-Docs</a></ul></nav><main><header><h1>+Install guide</h1></header><p>+Unpack the archive and run the command below in a shell with enough rights.</p><pre>+make install</pre><div class='note'><p>+Older versions need a restart of the service after this step.</p></div><table><tr><td>+Option</td><td>+Meaning</td></tr><tr><td>+quiet</td><td>+Prints nothing at all</td></tr></table><nav class='pager'><a href='/p'>-Previous page</a> <a href='/n'>-Next page</a></nav></main><footer>-Built with care</footer></body></html>",
    "<html><body><div class='cookie-consent'><p>-This site uses cookies to work better. Accept or reject them here.</p><button>-Accept</button></div><div class='wrapper'><article class='post'><header class='entry-header'><h1>+A walk in the hills</h1></header><p>+We left before sunrise and took the narrow path that leads up through the pine wood.</p><div class='advert'><p>-Buy new boots today and save a third of the price</p></div><p>+From the top one sees both lakes and, on clear days, the sea behind the last range.</p><footer>-Filed under walks</footer></article><section id='comments'><h2>-Comments</h2><p>-What a lovely walk, I went there with my children last summer and we liked it a lot.</p><p>-Where does one park the car at the start of that path?</p></section></div></body></html>",
    "<html><body><center><table><tr><td><a href='/i'>-Index</a></td><td><a href='/s'>-Search</a></td></tr></table></center><div><h1>+Notes on sorting</h1><p>+Sorting by counting works when keys are small whole numbers, and takes time in proportion to their number.</p><ol><li>+Count each key</li><li>+Sum up the counts</li><li>+Place each row</li></ol><p>+Equal keys keep their order if rows are placed from the last one to the first one.</p></div><form><input>-Your mail <button>-Send</button></form></body></html>",
    "<html><body><header><div class='site-header'><h1>-Kitchen Stories</h1><p>-Cooking for every day</p></div></header><div id='content'><div class='breadcrumb'><a href='/'>-Home</a> <a href='/soup'>-Soups</a></div><section><h1>+Onion soup</h1><p>+Slice the onions thinly and let them brown slowly in butter over a low fire for forty minutes.</p></section><section><h2>+Serving</h2><p>+Put bread and cheese on top and bake the bowls until the cheese has melted and turned brown.</p></section><div class='share'><a href='/f'>-Share this</a> <a href='/t'>-Mail this</a></div></div><aside><p>-Sign up for our newsletter to get a recipe every week.</p></aside></body></html>",
    "<html><body><div role='banner'>-City Library</div><div role='main' class='page'><h1>+Opening hours in winter</h1><p>+From November to March the reading room closes at six on weekdays and at two on Saturdays.</p><p>+Books may be returned at any time through the box beside the north door of the building.</p></div><div role='contentinfo'>-Library of the city, Main Street</div></body></html>",
]


def _marked(page):
    """The page without marks, and its words to keep and to leave out."""
    parts = re.findall(r">([+-])([^<]*)", page)
    return re.sub(r">[+-]", ">", page).replace(" +", " "), {m: [x for sign, t in parts if sign == m for x in t.split()] for m in "+-"}


def test_words_of_hand_written_pages():
    w = dict(html_maxsub.default_weights())
    for page in REAL:
        html, words = _marked(page)
        got = html_maxsub.main_text(html, w).split()
        want = words["+"]
        rest, both = list(want), 0
        for x in got:
            if x in rest:
                rest.remove(x)
                both += 1
        assert both >= 0.95 * len(want) and both >= 0.95 * len(got), (both, len(want), len(got), rest, html_maxsub.main_text(html, w))


def test_the_region_bounds_the_text(monkeypatch):
    w = dict(html_maxsub.default_weights())
    long = " ".join(f"word{i}" for i in range(40))
    far = "<div><div><ul>" + "<li><a href='/x'>x</a></li>" * 60 + "</ul></div></div>"
    page = f"<body><div>stray words here</div>{far}<div><h1>Title</h1><p>{long}</p></div>{far}<div>other stray words</div></body>"
    assert html_maxsub.main_text(page, w) == f"Title\n\n{long}"
    monkeypatch.setattr(html_maxsub.Reader, "scores", lambda self, weights: [1.0] * len(self.blocks))
    plain = page.replace("<a href='/x'>x</a>", "")
    assert html_maxsub.main_text(plain, {"<>": -0.3}) == f"Title\n\n{long}"  # all words score alike, tags keep the strays out
    monkeypatch.setattr(html_maxsub, "best_region", lambda scores: (0, len(scores)))
    assert html_maxsub.main_text(plain, {"<>": -0.3}) == f"stray words here\n\nTitle\n\n{long}\n\nother stray words"


@pytest.mark.parametrize("part", ["<div>x", "<b>", "<p><b>", "<ul><li>", "<div class='a b'>x", "<table><tr><td>", "&nbsp;<p>", "</i>", "<p><b><h1>x"])
def test_reading_is_linear(part):

    w, took = dict(html_maxsub.default_weights()), []
    for n in (4000, 32_000):
        start = time.perf_counter()
        html_maxsub.main_text(part * n, w)
        took.append(time.perf_counter() - start)
    assert took[1] < 8 * 4 * took[0] + 0.5


@pytest.mark.parametrize(
    "inner",
    [
        "<div id='post'><h1>Title</h1><div class='body'><p>{long}</p><p>{long}</p></div></div>",
        "<div id='content'><section><h1>Title</h1><p>{long}</p><p>{long}</p><p>{long}</p><p>{long}</p><p>{long}</p></section><section><p>{long}</p></section></div>",
        "<main><h1>Title</h1><p>{short}</p><article><p>{long}</p><p>{long}</p><p>{long}</p><p>{long}</p><p>{long}</p></article></main>",
        "<div><h1>Title</h1><p>{long}</p></div>",
    ],
)
def test_nothing_beside_the_largest_part_is_lost(inner):
    page = inner.format(long=" ".join(f"word{i}" for i in range(30)), short="four words stand here")
    want = "\n\n".join(b for b in re.split(r"<[^>]*>", page) if b)
    links = "".join(f"<li><a href='/{i}'>page {i}</a></li>" for i in range(8))
    html = f"<html><body><div><ul>{links}</ul></div>{page}<footer><p>all rights reserved</p></footer></body></html>"
    assert html_maxsub.main_text(html, dict(html_maxsub.default_weights())) == want


@pytest.mark.parametrize(
    "inner",
    [
        "<body class='has-sidebar'><article><h1>Title</h1><p>{long}</p></article></body>",
        "<body><div class='content with-sidebar'><h1>Title</h1><p>{long}</p></div></body>",
        "<body><article class='post comments-open'><h1>Title</h1><p>{long}</p></article></body>",
        "<body><div id='search-page'><h1>Title</h1><p>{long}</p></div></body>",
        "<body><article><div class='entry-header'><h1>Title</h1></div><p>{long}</p></article></body>",
        "<body><div class='widget'><main><h1>Title</h1><p>{long}</p></main></div><div class='comments'><p>so many words</p></div></body>",
        "<body><div class='banner'><article><h1>Title</h1><p>{long}</p></article></div><div class='site-header'><p>so many words</p></div></body>",
        "<body><div class='sidebar'><h1>Title</h1><p>{long}</p></div></body>",
    ],
)
def test_names_of_side_matter_do_not_hide_the_content(inner):
    long = " ".join(f"word{i}" for i in range(40))
    assert html_maxsub.main_text(f"<html>{inner.format(long=long)}<footer><p>all rights reserved</p></footer></html>", dict(html_maxsub.default_weights())) == f"Title\n\n{long}"


def test_best_region_equals_brute_force():
    r = random.Random(2)
    for _ in range(300):
        s = [r.randint(-5, 5) for _ in range(r.randint(0, 12))]
        a, b = html_maxsub.best_region(s)
        assert sum(s[a:b]) == max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])


def _by_recursion(s, at=0):
    """The best region, and those to its left and right."""
    best = max(((sum(s[i:j]), i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    _, i, j = best
    return [*_by_recursion(s[:i], at), (at + i, at + j), *_by_recursion(s[j:], at + j)]


def test_maximal_regions_equal_recursion():
    r = random.Random(3)
    for _ in range(300):
        s = [r.gauss(-0.2, 1) for _ in range(r.randint(0, 14))]
        assert html_maxsub.maximal_regions(s) == _by_recursion(s)


def test_holes_are_found_by_the_second_scan(monkeypatch):
    w = dict(html_maxsub.default_weights())
    long = " ".join(f"word{i}" for i in range(40))
    page = f"<body><nav><a href='/'>home</a></nav><article><h1>Title</h1><p>{long}</p><div class='advert'><p>buy this now, it is cheap</p></div><p>short</p><aside><p>other things to read</p></aside><p>{long}</p></article></body>"
    assert html_maxsub.main_text(page, w) == f"Title\n\n{long}\n\nshort\n\n{long}"
    monkeypatch.setattr(html_maxsub, "maximal_regions", lambda scores: [])
    assert html_maxsub.main_text(page, w) == f"Title\n\n{long}\n\nbuy this now, it is cheap\n\nshort\n\nother things to read\n\n{long}"


def test_scores_of_tags_are_negative_and_of_words_positive():
    w = dict(html_maxsub.default_weights())
    for page, _ in html_maxsub.labelled_pages(40, 8):
        read = html_maxsub.Reader(page)
        line, _ = read.line(w)
        assert all((x > 0) if name is None else (x < 0) for x, (name, _, _) in zip(line[1:-1], read.tokens, strict=True)) and line[0] <= 0 and line[-1] <= 0


def test_reader_comments_and_a_bare_copyright_line_are_left_out():
    w = dict(html_maxsub.default_weights())
    long = " ".join(f"word{i}" for i in range(40))
    page = f"<body><div><h1>Title</h1><p>{long}</p><p>{long}</p></div><section class='discussion'><p>nice post I like it very much</p><p>me too</p></section><p>&copy; 2020 Acme Inc. All rights reserved.</p></body>"
    assert html_maxsub.main_text(page, w) == f"Title\n\n{long}\n\n{long}"


# ---- op5 and op7


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_tree.encoder().ranks, special_tokens={})


def test_encoding_query(spark, sf, library):
    got = {r.doc_id: r for r in queries.op7_bpe_tree(spark, sf).collect()}
    for i, t in _docs(spark, sf):
        ids = library.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_tree_equals_the_library_on_odd_texts(library):
    r = random.Random(1)
    e = bpe_tree.encoder()
    pool = [" ", "  ", "a", "ab", "\n", "\t", "!!", "...", "é", "ß", "日本", "1", "22", "'s", "'S", "the", "ing", "\x1c", "\x85", "\xa0", "²", "٣", "😀", "\r", "\x00"]
    for k in range(1500):
        x = "".join(r.choice(pool) for _ in range(r.randint(1, 40))) if k % 20 else r.choice(["a", "ab", " ", "é", "!?", "the", "xyz1"]) * r.randint(50, 2000)
        ids = e.encode(x)
        assert ids.tolist() == library.encode_ordinary(x) and e.decode(ids) == x.encode()


def test_joining_is_associative():
    r = random.Random(4)
    e = bpe_tree.encoder()
    for _ in range(300):
        a, b, c = ("".join(r.choice("abetinghs") for _ in range(r.randint(0, 30))).encode() for _ in range(3))
        t = [e.piece_ids(x) for x in (a, b, c)]
        left, right = e.join(e.join(t[0], t[1]), t[2]), e.join(t[0], e.join(t[1], t[2]))
        assert left == right == e.piece_ids(a + b + c)


def test_the_tree_does_the_work(spark, sf):
    e = bpe_tree.TreeEncoder(bpe_tree.encoder().ranks, public_tokenizers.PATTERN)
    texts = [t for _, t in _docs(spark, sf) if t]
    for t in texts:
        e.encode(t)
    pieces = {p for t in texts for p in e.pattern.findall(t)}
    long = [p for p in pieces if len(p.encode()) > bpe_tree.LEAF_BYTES and p.encode() not in e.ranks]
    assert e.trees >= len(long) > 1000 and e.joins >= len(long) and e.windows > e.joins / 4
    # every window is of the neighbours of one seam, and no leaf holds a whole long piece
    assert max(map(len, e.leaves)) <= bpe_tree.LEAF_BYTES
    plain = {p: e.merge(p.encode()) for p in long}
    e.merge = lambda data, merge=e.merge: merge(data) if data not in whole else pytest.fail("a whole piece was merged at once")  # type: ignore[method-assign]
    whole = {p.encode() for p in long if len(p) > 24}
    assert all(e.piece_ids(p.encode()) == plain[p] for p in long if len(p) > 24)


def test_neighbours_that_are_stable_make_an_encoding():
    r = random.Random(7)
    e = bpe_tree.encoder()
    ids = sorted(e.vocab)
    for _ in range(3000):
        run = [r.choice(ids) for _ in range(r.randint(2, 5))]
        data = b"".join(e.vocab[i] for i in run)
        assert (e.merge(data) == run) == (all(e.again(a, b) is None for a, b in zip(run, run[1:], strict=False)) and data not in e.ranks)


def test_token_query(spark, sf, library):
    got = {}
    for r in queries.op5_token_attribution(spark, sf).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in _docs(spark, sf)[:80]:
        rows = sorted(got[i], key=lambda r: r.section)
        assert sum(r.n_tokens for r in rows) == len(library.encode_ordinary(t))
        assert "".join(t[r.start : r.end] for r in rows) == t
        assert all(t[r.start : r.end].count("\n") <= 1 for r in rows)
        want = [0] * len(rows)
        at = 0
        data = t.encode()
        for tok in library.encode_ordinary(t):
            raw = library.decode_single_token_bytes(tok)
            lo, hi = len(data[:at].decode("utf-8", "ignore")), len(data[: at + len(raw)].decode("utf-8", "ignore"))
            hi = max(hi, lo + 1)
            at += len(raw)
            held = [max(0, min(r.end, hi) - max(r.start, lo)) for r in rows]
            want[held.index(max(held))] += 1
        assert [r.n_tokens for r in rows] == want


def test_rules_for_crossing_tokens(spark):
    df = spark.createDataFrame([(1, "inter", "national  ", None)], "doc_id long, a string, b string, c string")
    by = {rule: [r.n_tokens for r in token_offsets.section_tokens(df, fields=["a", "b", "c"], rule=rule).orderBy("section").collect()] for rule in token_offsets.RULES}
    n = len(bpe_tree.encoder().encode("international  "))
    assert all(abs(sum(v) - n) < 1e-9 for v in by.values())
    assert by["start"][0] == 1 and by["majority"][0] == 0 and 0 < by["share"][0] < 1 and by["start"][2] == 0
    with pytest.raises(ValueError):
        token_offsets.section_tokens(df, rule="half")


# ---- op9


def _base_personal(x):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = re.sub(r"[ -]", "", m[0])
        if 14 <= len(d) <= 19 and pii_semicrf.luhn(d):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii_semicrf.KINDS.index(s[2])))


def test_base_spans_equal_the_patterns():
    r = random.Random(3)
    pool = ["a", "b.c", "@", "@", ".", "com", "-", "1", "22", "255", "256", "+1", "+", "(", ")", " ", "4111 1111 1111 1111", "4111111111111111", "%", "_", "é", "192.168", "0001", "x@y.z"]
    for _ in range(8000):
        x = "".join(r.choice(pool) for _ in range(r.randint(1, 14)))
        assert pii_semicrf.base_spans(x) == _base_personal(x)


def test_personal_data_query(spark, sf):
    got = {r.doc_id: r for r in queries.op9_pii_semicrf(spark, sf).collect()}
    for i, t in _docs(spark, sf):
        base = _base_personal(t or "")
        assert tuple(got[i][f"n_{k}"] for k in pii_semicrf.KINDS) == tuple(sum(k == n for *_, k in base) for n in pii_semicrf.KINDS)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for a, b, k in base} <= set(got[i].spans.split(","))


def test_model_on_held_out_sentences():
    w = dict(pii_semicrf.default_weights())
    hit = wrong = missed = 0
    for x, spans in pii_semicrf.labelled_sentences(300, 91):
        got = set(pii_semicrf.decode(x, w))
        hit, wrong, missed = hit + len(got & set(spans)), wrong + len(got - set(spans)), missed + len(set(spans) - got)
    assert hit / (hit + wrong) > 0.95 and hit / (hit + missed) > 0.95


#: Sentences written by hand: spans that the field should find in them.
HAND = [
    ("Please meet at noon.Tomorrow we leave.", []),
    ("ISBN 978-3-16-148410-0 is out of print.", []),
    ("The host 192.168.1.300 does not exist.", []),
    ("Call tel 030 1234567 today.", ["phone:030 1234567"]),
    ("Mobil: 0171/1234567 abends", ["phone:0171/1234567"]),
    ("Invoice 2024-00123 of 12.05.2024 over 1,250.00 EUR", []),
    ("Write to jane dot doe at example dot org please", ["email:jane dot doe at example dot org"]),
    ("contact: sales [at] shop [dot] com", ["email:sales [at] shop [dot] com"]),
    ("Look at example.com for more.", []),
    ("Ring (020) 7946 0018 before five.", ["phone:(020) 7946 0018"]),
    ("Phone 555-867-5309, ask for Jo.", ["phone:555-867-5309"]),
    ("Born 1984-11-02, lives at 12 Elm Street.", []),
    ("Card 4111.1111.1111.1111 was charged", ["card:4111.1111.1111.1111"]),
    ("server 10[.]0[.]0[.]12 is down", ["ip:10[.]0[.]0[.]12"]),
    ("Version 2.14.0.1523 fixes it", []),
    ("between 1914-1918 and 1939-1945", []),
    ("The city has 3 645 000 people.", []),
    ("at 48.8566 2.3522 on the map", []),
    ("pages 120-1345 of the report", []),
    ("Telefon 06 12 34 56 78", ["phone:06 12 34 56 78"]),
    ("order no. 5521-88731 shipped", []),
    ("mail bob(at)mail(dot)de now", ["email:bob(at)mail(dot)de"]),
    ("He works at night.Then he sleeps.", []),
    ("Fax 0049 30 901820", ["phone:0049 30 901820"]),
    ("ZIP 90210-1234", []),
    ("They won 3-2 and 4-1.", []),
    ("ISSN 1234-5678 and EAN 4006381333931", []),
    ("$1,299.99 or 1.199,00 EUR", []),
    ("ssh to 10(.)1(.)2(.)3 first", ["ip:10(.)1(.)2(.)3"]),
    ("Call 1-800-555-0199 toll free", ["phone:1-800-555-0199"]),
    ("Room 204 opens at 10:30 on 3.4.2021.", []),
    ("pay 12 345 678 euros by 30.06.", []),
    ("amex 3782-822463-10005 expired", ["card:3782-822463-10005"]),
]


def test_model_on_hand_written_sentences():
    w = dict(pii_semicrf.default_weights())
    hit = wrong = missed = 0
    for x, want in HAND:
        got = {f"{k}:{x[a:b]}" for a, b, k in pii_semicrf.find_spans(x, w)[1]}
        hit, wrong, missed = hit + len(got & set(want)), wrong + len(got - set(want)), missed + len(set(want) - got)
    assert hit / (hit + wrong) >= 0.9 and hit / (hit + missed) >= 0.9, (hit, wrong, missed)


def test_decoding_is_optimal():
    w = dict(pii_semicrf.default_weights())
    for x, _ in pii_semicrf.labelled_sentences(40, 5):
        segs = [s[:4] for s in pii_semicrf._segments(x, w) if s[3] > 0][:12]
        best = 0.0
        for mask in range(1 << len(segs)):
            pick = sorted(s for i, s in enumerate(segs) if mask >> i & 1)
            if all(a[1] <= b[0] for a, b in zip(pick, pick[1:], strict=False)):
                best = max(best, sum(s[3] for s in pick))
        if len([s for s in pii_semicrf._segments(x, w) if s[3] > 0]) <= 12:
            score = {(a, b, k): v for a, b, k, v in segs}
            assert abs(sum(score[s] for s in pii_semicrf.decode(x, w)) - best) < 1e-9


def test_masking(spark):
    df = spark.createDataFrame([(1, "mail a.b@c.de or +1 (555) 123-4567!"), (2, None), (3, "x")], "doc_id long, text string")
    assert [r.text for r in pii_semicrf.mask_personal_data(df).orderBy("doc_id").collect()] == ["mail [EMAIL] or [PHONE]!", None, "x"]
    assert pii_semicrf.mask_personal_data(df).columns == df.columns
    assert df.select(F.length("text")).count() == 3


@pytest.mark.parametrize("part", ["1 ", "1.", "12 34 56 78 ", "0.123 4.567 8.910\n", "4111 1111 ", "a at b.c "])
def test_long_digit_tables_take_linear_time(part):
    w, took = pii_semicrf.Weights(pii_semicrf.default_weights()), []
    for n in (50_000, 400_000):
        text = part * (n // len(part))
        start = time.perf_counter()
        pii_semicrf.find_spans(text, w)
        took.append(time.perf_counter() - start)
    assert took[1] < 8 * 3 * took[0] + 0.5


def test_numbers_within_longer_ones_are_no_personal_data():
    w = pii_semicrf.Weights(pii_semicrf.default_weights())
    for text in ("dates 2020-01-01 2021-02-03 x", "ticket 0123456789 x", "1 2 3 4 5 6 7 8 9", "rows 1.5/2.5/3.5/4.5/5.5"):
        assert pii_semicrf.find_spans(text, w)[1] == []
    assert pii_semicrf.find_spans("call 030 1234567 now", w)[1] == [(5, 16, "phone")]


def test_lists_of_numbers_with_one_separator_are_looked_at():
    w = pii_semicrf.Weights(pii_semicrf.default_weights())
    phones = [f"0{i}71 {1234567 + 7654 * i}" for i in range(1, 10)]
    found = pii_semicrf.find_spans(" ".join(phones), w)[1]
    assert [(b - a, k) for a, b, k in found] == [(12, "phone")] * 9  # 18 groups, all parted by a space
    hit = wrong = missed = 0
    for x, spans in pii_semicrf.number_lists(200, 5):
        got = set(pii_semicrf.decode(x, w))
        hit, wrong, missed = hit + len(got & set(spans)), wrong + len(got - set(spans)), missed + len(set(spans) - got)
    assert hit / (hit + wrong) > 0.95 and hit / (hit + missed) > 0.95, (hit, wrong, missed)


def test_remembered_scores_are_the_same():
    plain, seen = dict(pii_semicrf.default_weights()), pii_semicrf.Weights(pii_semicrf.default_weights())
    seen.MOST = 20
    for text, _ in pii_semicrf.labelled_sentences(150, 3):
        assert pii_semicrf._segments(text, plain) == pii_semicrf._segments(text, seen)


def test_elements_whose_names_only_begin_like_raw_ones_hold_text():
    w = dict(html_maxsub.default_weights())
    words = " ".join(f"word{i}" for i in range(40))
    page = f"<body><header><svg-icon></svg-icon><title-card>site</title-card></header><article><h1>Title</h1><p>{words} <math><mi>x</mi></math> end</p><iframe-wrap></iframe-wrap></article></body>"
    assert html_maxsub.main_text(page, w) == f"Title\n\n{words} x end"
