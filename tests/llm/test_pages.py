"""Pages: main text and archives."""

import base64
import hashlib
import io
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from csvharbor.llm import html, ranks, warc

ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "</p><p>words in a script";</script></head><body>
<div id="cookie-notice"><p>We use cookies on this page and would like you to accept every one of them</p></div>
<nav><ul><li><a href=/x>Home</a></li><li>About us and more</li></ul></nav><header>Site name and slogan of the site</header>
<div class="sidebar"><p>Popular posts of this week that you may have missed</p></div>
<article class="post"><h1>A &lt;title&gt; &amp; more</h1><p>First   paragraph with <b>bold</b>ness, <a href="/l">a link</a> and
a break.<br>After the break.</p><div class="advert">Buy this very nice thing now</div><p>Second &eacute;&#233;&#xe9; one.</p>
<form>Your name please <input name=q> <select><option>one</option></select></form><!-- hidden <p>words</p> --><ul><li>Item one</li><li>Item two</li></ul>
<section class="comments"><p>I like this article a lot, said a reader</p></section></article>
<aside>Related things to read next</aside><footer>&copy; The site, all rights reserved, imprint and contact</footer></body></html>"""
TEXT = "A <title> & more\nFirst paragraph with boldness, a link and a break.\nAfter the break.\nSecond ééé one.\nItem one\nItem two"


def test_article_alone():
    assert html.main_text(ARTICLE, html.Weights()) == TEXT
    learned = html.weigh(html.count(ARTICLE))
    assert html.main_text(ARTICLE, learned) == TEXT
    assert html.main_text(ARTICLE.replace("article", "div"), learned) == TEXT


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""), ("<p></p>", ""), ("just text", "just text"), ("<p>one<p>two", "one\ntwo"), ("<article><p>cut off &am", "cut off &am"),
        ("<nav>menu<article><h1>Not closed</h1><p>Text here</p></article>", "Not closed\nText here"), ("a < b and c > d", "a < b and c > d"),
        ("<p>un<i>broken</i></p>", "unbroken"), ("<p title='a > b'>attribute</p>", "attribute"), ("<article><p>x <script>y</p>", "x"),
        ("<ARTICLE><P>Upper</P></ARTICLE><FOOTER>no</FOOTER>", "Upper"), ("<p>a&nbsp;&nbsp;b\t c</p>", "a b c"), ('<p "broken <b>quote</p> after', "quote\nafter"),
    ],
)
def test_odd_pages(page, text):
    assert html.main_text(page, html.Weights()) == text


RUN = " ".join(f"word{k}" for k in range(60))
COMMENTS = "<section class='comments'>" + "".join(f"<article class='comment' id='comment-{k}'><p>I think {RUN} {k}</p></article>" for k in range(4)) + "</section>"


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<article class='post comments-open'><h1>Head</h1><p>{RUN}</p></article>{COMMENTS}", f"Head\n{RUN}"),
        (f"<article><p>{RUN}</p>{COMMENTS}<p>end</p></article>", f"{RUN}\nend"),
        (f"<article><p>{RUN}</p></article><div><article class='comment'><p>{RUN} {RUN}</p></article></div>", RUN),
        (f"<article><p>a {RUN}</p><div class='legal-text'><p>b {RUN}</p></div><section class='related-work'>c {RUN}</section><div class='teaser'><p>{RUN}</p></div></article>",
         f"a {RUN}\nb {RUN}\nc {RUN}\n{RUN}"),
        (f"<article><p>{RUN}</p><div class='share-links'>Share: <a href=x>one network</a> <a href=y>other network</a></div><div class='related'><a href=z>{RUN}</a></div><p>end</p></article>", f"{RUN}\nend"),
        (f"<form id=all><nav>menu things</nav><div><h1>Head</h1><p>{RUN}</p><p>{RUN}</p></div><footer>foot</footer></form>", f"Head\n{RUN}\n{RUN}"),
        (f"<div><p>{RUN}</p></div><form><p>Your name and address please</p></form>", RUN),
        (f"<article><p>{RUN}</p>{'<div><img></div>' * 40}<p>short tail</p></article>", f"{RUN}\nshort tail"),
        (f"<div><p>{RUN}</p>{'<div><img></div>' * 40}<p>tail {RUN}</p></div>", f"{RUN}\ntail {RUN}"),
    ],
)
def test_comments_forms_names_and_empty_elements(page, text):
    for weights in (html.Weights(), html.weigh(html.count(ARTICLE))):
        assert html.main_text(page, weights) == text


def test_draws_do_not_grow_with_the_table(spark):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("draw"), "id")
    taken = ranks.drawn(rows, "draw", 50)
    assert [r.id for r in taken.collect()] == [r.id for r in rows.orderBy("draw").limit(50).collect()]
    assert "Filter" in taken._jdf.queryExecution().optimizedPlan().toString() and ranks.drawn(rows.limit(10), "draw", 50).count() == 10


def test_pages_without_an_end_take_linear_time():
    assert html.main_text("<article>" + "<p>word " * 50_000, html.Weights()).count("word") == 50_000
    assert html.main_text("<div>" * 20_000 + "word", html.Weights()) in ("", "word")


def test_extraction_in_a_table(spark):
    rows = spark.createDataFrame([(1, "u", ARTICLE), (1, "u", ARTICLE), (2, None, None), (None, "u", ""), (3, "u", "<p>word</p> " * 50_000)], "page_id long, url string, html string")
    weights = html.train(rows)
    got = rows.select("page_id", html.extract(F.col("html"), weights).alias("text")).collect()
    assert [len(r.text.split("\n")) for r in got] == [6, 6, 1, 1, 50_000] and got[0].text == TEXT and got[2].text == got[3].text == ""
    none = rows.where("false")
    assert none.select(html.extract(F.col("html"), html.train(none)).alias("t")).count() == 0


def archive(*records, dictionary=None, packed=True):
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor()
    front = b""
    if dictionary:
        front = warc.dictionary_frame(dictionary) if packed else b"\x5d\x2a\x4d\x18" + len(dictionary).to_bytes(4, "little") + dictionary
    return front + b"".join(map(packer.compress, records))


@pytest.mark.parametrize("packed", [True, False, None])
def test_frames_with_and_without_a_dictionary(packed, monkeypatch):
    rng = random.Random(1)
    pages = [" ".join(rng.choices(["alpha", "beta", "gamma", "<p>", "</p>"], k=200)).encode() for _ in range(200)]
    dictionary = None if packed is None else zstandard.train_dictionary(4096, pages).as_bytes()
    data = archive(*pages, b"", dictionary=dictionary, packed=packed)
    for size in (1 << 20, 7):
        monkeypatch.setattr(warc, "READ_BYTES", size)
        assert list(warc.frames(io.BytesIO(data))) == [*pages, b""]
    with pytest.raises(warc.BrokenArchive):
        list(warc.frames(io.BytesIO(data[:-3])))
    with pytest.raises(warc.BrokenArchive):
        list(warc.frames(io.BytesIO(data + b"garbage")))


def test_empty_archive():
    assert list(warc.frames(io.BytesIO(b""))) == []


def test_records_are_checked():
    good = warc.record(7, "http://x/\r\ny", "héllo".encode())
    assert warc.parse(good)["payload"] == "héllo".encode() and warc.parse(good)["url"] == "http://x/%0D%0Ay"
    again = warc.parse(warc.record(8, None, b"hello", 7, True))
    assert (again["record_type"], again["refers_to"], again["payload_bytes"], again["url"], again["payload"]) == ("revisit", 7, 5, None, b"")
    for broken in (b"", good[1:], good[:-1], good + b"x", good.replace(b"h\xc3\xa9llo", b"hallo!"), good.replace(b"WARC-Type", b"WARC-Tipe"), good.replace(b"WARC-Date: ", b": ")):
        with pytest.raises(warc.BrokenArchive):
            warc.parse(broken)


@pytest.mark.parametrize("least", [0, 10])
def test_round_trip_of_a_table(spark, tmp_path, least):
    long = "<p>long text</p>" * 30_000
    rows = [(k, f"http://h/{k}", t) for k, t in enumerate(["same payload"] * 30 + ["short"] * 3 + [long, long, "", "", None, "ü\r\n\r\nWARC/1.1"])] + [(None, None, "same payload"), (3, "x", "same payload")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("head", F.lit(1)).repartition(4)
    archives = warc.write_archives(df, f"{tmp_path}/warc", revisit_from=least, archive_bytes=2000)
    assert archives.agg(F.sum("records")).first()[0] == len(rows) and archives.count() > 4
    (tmp_path / "warc" / "left-over.warc.zst").write_bytes(b"of a task that was lost")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.error) for r in warc.read_archives(archives).collect()), key=str)
    first = {}
    for key, _, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(text or "", key)
    expected = []
    for key, _, text in rows:
        payload = (text or "").encode()
        again = key is not None and len(payload) >= least and first[text or ""] != key
        expected.append((key, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if again else "response", first[text or ""] if again else None, None))
    assert got == sorted(expected, key=str)


def test_no_pages_and_broken_files(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(none, f"file://{tmp_path}/none")).count() == 0
    path = tmp_path / "x.warc.zst"
    path.write_bytes(archive(warc.record(1, "u", b"a"), b"no record", warc.record(2, "u", b"b")) + b"cut")
    rows = warc.read_archives(spark.createDataFrame([(f"file://{path}", 3)], "path string, records long")).orderBy("place").collect()
    assert [(r.page_id, r.error and r.error.split(":")[0]) for r in rows] == [(1, None), (None, "no WARC header"), (2, None), (None, "not a frame")] or rows[-1].error
