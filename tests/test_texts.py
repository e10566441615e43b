"""Blocks of pages, quotes in pages and transcripts, addresses and locators without secrets."""

import random
import time

import pytest

from quillspark.functions import text as T
from quillspark.operators import quotes as Q


def test_normalized():
    cases = {
        "a &#8217;b&#x2019;&#X27; &ldquo;c&rdquo; &amp;lt; &nosuch; &#1114112; &#xD800;": "a 'b'' \"c\" &lt; &nosuch; &#1114112; &#xD800;",
        "see [our [very] list](http://x/y_(z)) and ![pic](p.png)": "see our [very] list and pic",
        "“x” ‘y’ 1–2 − 3  z": "\"x\" 'y' 1-2 - 3 z",
        "<script>no</SCRIPT >a<style>b": "a b",
        "1 < 2 and 3 > 2 < 4": "1 2 < 4",
    }
    assert {k: T.normalized(k) for k in cases} == cases


def test_blocks():
    page = "<div><p>the shop of\nAcme reports sales</p><ul><li>First &ndash; “item” 1</li><li>second</li></ul>Revenue<br>and <b>more</b><br>Next<x-y>own</x-y><script>var t='</p>'</script></div>"
    assert T.blocks(page) == ["the shop of Acme reports sales", 'First - "item" 1', "second", "Revenue and more", "Next", "own"]
    plain = "A line\nthat goes on\nAnother\n\nnot joined\n| a cell | <placeholder> b |\n| --- | :-: |\nafter"
    assert T.blocks(plain) == ["A line that goes on", "Another", "not joined", "a cell", "b", "after"]
    assert T.blocks("List<int> is\nno HTML") == ["List is no HTML"] and T.blocks("") == [] and T.blocks("<p> </p>") == []
    for unit in ("<script>x", "<", "<a ", "<p", "[", "[a](", "&#", "<style", "|"):
        began = time.time()
        T.blocks(unit * (400_000 // len(unit)))
        assert time.time() - began < 3, unit


def test_cited(spark):
    page = "<p>The shop sold 12 million tokens in May.</p><p>Costs were nothing to speak of.</p>"
    pages = spark.createDataFrame([("https://H.io/a/#x", page), ("https://h.io/a", "another text of the same page"), ("https://h.io/b?id=2", "b")], "url string, text string")
    rows = [
        (1, "HTTPS://h.io:443/a#y", "sold 12&nbsp;million tokens", "found"), (2, "https://h.io/a", "in May. Costs were nothing", "quote_spans_blocks"), (3, "https://h.io/b", "sold 12 million tokens", "not_fetched"), (4, "https://h.io/a/", "12 million", "quote_too_short"),
        (5, "https://h.io/a", "sold 13 million tokens", "quote_not_found"), (6, "https://h.io/a", "another text of the same", "found"), (7, "no address ", "whatever it is, it is long", "not_fetched"),
    ]
    quotes = spark.createDataFrame([r[:3] for r in rows], "quote_id long, url string, quote string")
    assert {r.quote_id: r.verdict for r in Q.cited(quotes, pages).collect()} == {r[0]: r[3] for r in rows}


@pytest.mark.parametrize("letters", ["ab", "abcdefgh é"])
def test_found_in(spark, letters):
    """Against a look at every piece; few letters make many equal fingerprints."""
    rng = random.Random(len(letters))
    pieces = [(k, i, " ".join("".join(rng.choice(letters) for _ in range(rng.randint(0, 60))).split())) for k in range(12) for i in range(4)]
    quotes = [(n, t[a : a + rng.randint(18, 40)]) for n, (_, _, t) in enumerate(rng.choices(pieces, k=60)) for a in [rng.randint(0, 20)]] + [(900, "nowhere in all of these pieces"), (901, None)]
    got = Q.found_in(spark.createDataFrame(quotes, "quote_id long, quote string"), spark.createDataFrame(pieces, "page long, piece int, text string"), "page")
    want = {(n, k, i) for n, q in quotes if q and len(T.normalized(q)) >= 20 for k, i, t in pieces if T.normalized(q) in t}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_transcripts(spark):
    text = "[00:01] we sold the first half\n[00:09] of the tokens in May and\nno segment\n[00:15] the rest later this year\n[100:20] and that is all there is"
    rows = [
        (1, "sold the first half of the tokens", "found", "00:01"), (2, "of the tokens in May and the rest", "found", "00:09"), (3, "first half of the tokens in May and the rest later", "found", "00:01"),
        (4, "half of the tokens in May and the rest later this year and", "quote_spans_blocks", None), (5, "[00:09] of the tokens in May", "quote_not_found", None), (6, "and that is all there", "found", "100:20"), (7, "no segment no segment", "quote_not_found", None), (8, "too short", "quote_too_short", None),
    ]
    quotes = spark.createDataFrame([(i, 5, q) for i, q, _, _ in rows] + [(9, 6, "whatever it is, it is long")], "quote_id long, doc_id long, quote string")
    docs = spark.createDataFrame([(5, text), (7, "no transcript")], "doc_id long, text string")
    got = {r.quote_id: (r.verdict, r.locator) for r in Q.cited_transcripts(quotes, docs).collect()}
    assert got == {i: (v, at) for i, _, v, at in rows} | {9: ("not_fetched", None)}


def test_addresses():
    cases = {
        "HTTPS://h.io/?apikey=S": "https://h.io/", "https://h.io/?api%4Bey=S&a=1": "https://h.io/?a=1", "https://h/p?a=b c&b=%20&&c": "https://h/p?a=b%20c&b=%20&&c", "https://h/p?a=b c&KEY=1&d": "https://h/p?a=b+c&d=",
        "http://H:80/a/../b/./c%2e?": "http://h/b/c%2e?", "wss://u:p@eth.DRPC.org:8443/network/abc": "wss://eth.drpc.org:8443/", "https:\\\\h\\v2\\secret_9": "https://h/v2", "ftp://h/?key=1": "ftp://h/?key=1", "https://": "https://",
        " https://h/#key=1": "https://h/", "https://a b/?key=1": "https://a b/?key=1", "https://bücher.example/ü": "https://xn--bcher-kva.example/%C3%BC", "https://h/" + "0x" + "a" * 40: "https://h/" + "0x" + "a" * 40,
        "https://x.infura.io/v3/abc/0x" + "a" * 40: "https://x.infura.io/v3", "https://h:99999/?key=1": "https://h:99999/?key=1",
    }
    assert {k: T._address(k) or k for k in cases} == cases


def test_locators(spark):
    locator = '{"url":"see https://h/v2/secret_9?x=1, HTTPS://h/?KEY=2","Api_Key":"k","a":[{"authorization":"b","token":"T","headers":["x"],"n":1.5},"wss://u:p@h/",null,true],"auth":{"k":1},"HEADERS":"x","key":3}'
    want = '{"url":"see https://h/v2?x=1, https://h/","a":[{"token":"T","headers":[],"n":1.5},"wss://h/",null,true],"auth":{},"HEADERS":"","key":3}'
    rows = [locator, '"https://h/?key=1"', "3", "no json https://h/?key=1", None]
    got = [r.v for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").select("i", T.scrubbed_locator("x").alias("v")).orderBy("i").collect()]
    assert got[1:] == ['"https://h/"', "3", None, None]
    assert got[0] == want


def test_quotes_of_pages(spark):
    """The next page's words are found in ranges as in one window over all pages; Python takes pages in short batches."""
    from quillspark.plans import texts

    pages = spark.createDataFrame([(3 * i, f"http://h/{i}", f'<h1>t</h1><p><b>{i}</b></p><div class="ad">words of page {i}</div>') for i in range(200)], "page_id long, url string, html string").repartition(7)
    due = spark.sql(texts._QUOTES, pages=pages).selectExpr("quote_id", "url", "coalesce(quote, '') as quote")
    got = texts._quotes(spark, pages)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in due.collect()}
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        texts._pages(spark, "/root/testdata/sf0.001")
        assert spark.conf.get(key) == "1000"
    finally:
        spark.conf.set(key, before)
