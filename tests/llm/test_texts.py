"""HTML, archive, URL lists, toxicity and repeated lines."""

import base64
import datetime
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from joinseek.llm import html_text, toxicity, url_filters, warc

DRAW = random.Random(2)
LONG = "This is a sentence of the article, with commas, and enough words to count as a paragraph. "


def page(article, before="", after=""):
    return (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p><p>no</p>';</script></head><body>"
        f"<header><h1>Site name</h1></header><nav><ul><li><a href='/a'>Home</a><li><a href='/b'>News</a></ul></nav>{before}"
        f"{article}<div id='comments'><p>{LONG * 3}</p></div>{after}<footer>&copy; nobody, {LONG}</footer></body></html>"
    )


ARTICLES = [
    (f"<article><h1>A &amp; B</h1><p>One,\n  two&nbsp;three.<br>four</p><p><b>{LONG}<br><p>Short</article>", f"A & B\nOne, two three. four\n{LONG.strip()}\nShort"),
    (f"<div class='cookie-notice'>We use cookies. {LONG}</div><main><p>{LONG}</p><div class='ad'>Buy</div><ul><li>x<li>y</ul></main>", f"{LONG.strip()}\nx\ny"),
    (f"<div><div class='sidebar'><p>{LONG}</p></div><div class='post'><h2>Title</h2><p>{LONG}</p><p>{LONG}</p><form><p>{LONG}</p></form></div></div>", f"Title\n{LONG.strip()}\n{LONG.strip()}"),
    (f"<div><p>{LONG}</p><p>{LONG}</p><ul><li><a>a b c</a></li><li><a>d e f</a></li><li><a>g h</a></li></ul></div>", f"{LONG.strip()}\n{LONG.strip()}"),
    (f"<article><section><p>{LONG}</p></section><section><p>{LONG}</p></section><aside><p>{LONG}</p></aside></article>", f"{LONG.strip()}\n{LONG.strip()}"),
    (f"<article><!-- <p>no</p> --><table><tr><td>1<td>2<tr><td>3</table><pre>a  b\n c</pre><p>{LONG}</article>", f"1\n2\n3\na b c\n{LONG.strip()}"),
    ("<article><p>Tiny</p></article>", "Tiny"),
    (f"<div style='overflow:hidden'><p title='hidden gems' data-role=menu>{LONG}</p><p style='color:red; display: none'>{LONG}</p><p HIDDEN>{LONG}</p><p class='x hidden'>{LONG}</p></div>", LONG.strip()),
    (f"<article><p aria-hidden=false>{LONG}</p><p aria-hidden='true'>{LONG}</p><script src=/a/b/>var x = '<p>no</p>';</script><svg/><p>End</p></article>", f"{LONG.strip()}\nEnd"),
]


@pytest.mark.parametrize(("article", "want"), ARTICLES)
def test_main_text(article, want):
    assert html_text.main_text(page(article)) == want


BODY = f"<p>{LONG}</p>" * 8
LINKS = "<ul><li><a>First source</a><li><a>Second source</a><li><a>Third source</a></ul>"
SOURCES = "First source\nSecond source\nThird source"
#: Elements that a word of their name or a form marks, and what is kept of them.
WRAPPED = [
    *((f"<div class='{c}'><article>{BODY}</article></div>", 8) for c in ("has-sidebar", "no-comments", "with-menu", "page-widget", "sidebar")),
    *((f"<div class='{c}'>{BODY}</div>", 8) for c in ("has-sidebar", "no-comments", "with-menu", "page-widget")),
    (f"<form id='aspnetForm'><div><article>{BODY}</article><div class='comments'><p>{LONG}</p></div></div></form>", 8),
    (f"<form id='aspnetForm'><div>{BODY}</div></form>", 8),
    (f"<article><h1></h1><form>{BODY}</form></article>", 8),
    (f"<main><article><p>{LONG}</p><div class='comment-list'><article class='comment'>{BODY}</article></div></article></main>", 1),
    (f"<article>{BODY}</article><div class='related-posts'><article><p>{LONG}</p></article></div>", 8),
    (f"<div><p>{LONG}</p><p>{LONG}</p></div><div class='comments-area'>{BODY}</div>", 2),
    (f"<article><p>{LONG}</p></article><div class='user-comments'>{BODY}</div>", 1),
]


@pytest.mark.parametrize(("article", "lines"), WRAPPED)
def test_a_name_or_form_discards_no_article(article, lines):
    assert html_text.main_text(page(article)) == "\n".join([LONG.strip()] * lines)


@pytest.mark.parametrize("tag", ["article", "main"])
def test_link_lists_of_an_article_stay(tag):
    inside = f"<p>{LONG}</p><h2>Sources</h2>{LINKS}<div class='related'>{LINKS}</div><nav>{LINKS}</nav>"
    assert html_text.main_text(page(f"<{tag}>{inside}</{tag}>")) == f"{LONG.strip()}\nSources\n{SOURCES}"


@pytest.mark.parametrize("html", ["", "<", "<p", "</p></div>", "<script>x", "<!-- x", "plain", "<a <b> <c", "<div" * 3000 + ">", '<p a="' * 2000])
def test_broken_pages_do_not_fail(html):
    assert isinstance(html_text.main_text(html), str)


def test_extract_rows(spark):
    rows = [(1, "u", None, "t"), (2, None, "", None), (3, "v", "<p>" + "<div>" * 3000 + LONG * 5000, "x"), (3, "v", "<p>same", "x"), (None, "w", "<p>same", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    out = html_text.extract(pages)
    assert out.columns == ["page_id", "url", "text"]
    assert [r.text for r in out.collect()] == ["", "", " ".join((LONG * 5000).split()), "same", "same"]
    assert html_text.extract(pages.limit(0)).count() == 0


def parse_warc(data):
    """Records of an archive by their stated lengths: [(headers, block)]."""
    at, out = 0, []
    while at < len(data.rstrip()):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        headers = dict(x.split(": ", 1) for x in lines[1:])
        length = int(headers["Content-Length"])
        out.append((headers, data[end + 4 : end + 4 + length]))
        at = end + 4 + length
        assert data[at : at + 4] == b"\r\n\r\n"
        at += 4
    return out


def test_archive_round_trip(spark, tmp_path):
    bodies = ["<p>ä€😀</p>\r\n\r\nWARC/1.1\r\n", "", None, "same", "same", "same", "x" * 300000]
    rows = [(10 - i, f"http://h/{i}\r\nx", b, 1) for i, b in enumerate(bodies)] + [(7, "http://h/3", "same", 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, payload int")
    warc.write_archive(pages, f"{tmp_path}/a")
    stored = spark.read.parquet(f"{tmp_path}/a/payloads")
    assert stored.count() == stored.select("address").distinct().count() == 4
    records = warc.read_archive(spark, f"{tmp_path}/a")
    got = records.collect()
    assert len(got) == len(rows) and all(r.verified for r in got)
    first = {}
    for i, _, b, _ in rows:
        first[b or ""] = min(i, first.get(b or "", 99))
    by_page = {i: (b or "") for i, _, b, _ in rows}
    for r in got:
        body = by_page[r.page].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert r.record_type == ("response" if r.page == first[by_page[r.page]] else "revisit")
        assert (int(r.refers_to) if r.refers_to else r.page) == first[by_page[r.page]]
        assert r.payload is None if r.record_type == "revisit" else r.payload == body
    warc.write_warc_files(records, f"{tmp_path}/w")
    parsed = [x for f in tmp_path.glob("w/part-*") for x in parse_warc(f.read_bytes())]
    assert sorted(h["WARC-Type"] for h, _ in parsed) == sorted(r.record_type for r in got)
    for headers, block in parsed:
        body = block.split(b"\r\n\r\n", 1)[1]
        if headers["WARC-Type"] == "response":
            assert headers["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        else:
            assert body == b"" and headers["WARC-Refers-To"]


def test_archive_of_small_payloads_and_nulls(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, None, "abcdef"), (4, "u", "abcdef"), (None, "u", "z")], "page_id bigint, url string, html string")
    warc.write_archive(pages, f"{tmp_path}/a", warc.WarcParams(min_bytes=4))
    got = {r.page: (r.record_type, r.refers_to) for r in warc.read_archive(spark, f"{tmp_path}/a").collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "response", 2: "response", 3: "response", 4: "revisit", None: "response"}
    assert got[4][1] == "3"
    warc.write_archive(pages.limit(0), f"{tmp_path}/e")
    assert warc.read_archive(spark, f"{tmp_path}/e").count() == 0


def test_url_patterns(spark):
    urls = ["HTTPS://u:p@A.b.Example.com.:80/x/y/?q#f", "http://h", "http://a.b/", "no url", None, "ftp://1.2.3.4/z"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(url_filters.url_patterns(F.col("u")).alias("p")).collect()
    host = "a.b.example.com"
    assert [r.p for r in rows] == [
        [f"{host}/x/y", f"{host}/x", host, "b.example.com", "example.com"],
        ["h"], ["a.b"], [], [], ["1.2.3.4/z", "1.2.3.4", "2.3.4", "3.4"],
    ]


def test_lists_hold_from_day_to_day(spark):
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
    hosts = [f"{a}.{b}.com" for a in "xyz" for b in "pq"]
    patterns = [*hosts, "p.com", "q.com", "x.p.com/en", "x.p.com/en/1"]
    entries = [(DRAW.choice(["l1", "l2"]), DRAW.choice(patterns), DRAW.choice(["block", "allow", "remove"]), day(DRAW.randint(0, 30))) for _ in range(80)]
    captures = [(i, f"http://{DRAW.choice(hosts)}/{DRAW.choice(['', 'en', 'en/1', 'de'])}", day(DRAW.randint(-2, 35))) for i in range(300)]
    captures += [(900, None, day(3)), (901, "http://x.p.com/", None), (902, "junk", day(3)), (0, *captures[0][1:])]
    listed = spark.createDataFrame([*entries, (None, "x.p.com", "block", day(0)), ("l1", None, "block", day(0))], "list string, pattern string, action string, listed_on date")
    seen = spark.createDataFrame(captures, "page_id bigint, url string, fetched_on date").withColumn("pattern", F.lit("clash")).withColumn("list", F.lit(1))
    got = url_filters.screened(seen, listed).collect()
    assert len(got) == len(captures)

    def state(pattern, when):
        """Actions in force: the last entry of each list up to that day."""
        now = {}
        for name, p, action, at in sorted(entries, key=lambda e: (e[3], e[2])):
            if p == pattern and at <= when:
                now[name] = action
        return [a for a in now.values() if a != "remove"]

    for r in got:
        blocked = False
        if r.url and r.fetched_on and r.url.startswith("http"):
            rest = r.url[7:].rstrip("/")
            options = [rest]
            while "/" in options[-1]:
                options.append(options[-1].rsplit("/", 1)[0])
            options.append(options[-1].split(".", 1)[1])
            for option in options:
                if actions := state(option, r.fetched_on):
                    blocked = "block" in actions
                    break
        assert r.blocked == blocked, r
    assert url_filters.screened(seen, listed.limit(0)).where("blocked").count() == 0
    assert url_filters.screened(seen.limit(0), listed).count() == 0


def test_as_of_join_of_a_hot_pattern(spark):
    """A pattern with many entries and captures gives one answer per day, and times count by their day."""
    listed = spark.range(400).selectExpr(
        "'l' AS list", "'h.com' AS pattern", "element_at(array('block', 'allow', 'remove'), CAST(id % 3 + 1 AS INT)) AS action",
        "date_add(DATE '2024-01-01', CAST(id * 2 AS INT)) AS listed_on",
    )
    seen = spark.range(3000).selectExpr("id", "concat('http://h.com/', id) AS url", "timestamp_seconds(1704067200 + id * 43200 - 1) AS fetched_on")
    asked = seen.selectExpr("'h.com' AS pattern", "CAST(fetched_on AS DATE) AS at").groupBy("pattern", "at").count()
    assert url_filters.in_force(asked, url_filters.validity(listed)).count() <= asked.count()
    got = url_filters.screened(seen, listed).collect()
    assert len(got) == 3000
    for r in got:
        day = (r.fetched_on.date() - datetime.date(2024, 1, 1)).days
        latest = min(day // 2, 399)
        action = None if day < 0 else ("block", "allow", "remove")[latest % 3]
        assert r.blocked == (action == "block"), r
        began = datetime.date(2024, 1, 1) + datetime.timedelta(2 * latest) if action in ("block", "allow") else None
        assert r.listed_on == began, r


def toxic_corpus(n):
    vocabulary = ["".join(DRAW.choice("aeioulnrst") for _ in range(DRAW.randint(2, 6))) for _ in range(300)]
    rows = []
    for i in range(n):
        found = [DRAW.choice(vocabulary) for _ in range(DRAW.randint(5, 400))]
        bad = DRAW.random() < 0.2
        for _ in range(3 * bad):
            found[DRAW.randrange(len(found))] = "zwork" + DRAW.choice(["", "ed", "er", "ing"])
        rows.append((i, " ".join(found), int(bad)))
    return rows


def test_toxicity_on_held_out_documents(spark):
    rows = toxic_corpus(900)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int").withColumn("__key", F.lit(0))
    labels = docs.select("doc_id", "toxic")
    params = toxicity.ToxicityParams(sample=150)
    model = toxicity.fit(docs.drop("toxic"), labels, params)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    truth = {i: bad for i, _, bad in rows}
    held = [i for i in got if got[i].held_out]
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == got[i].held_out for i in got)
    assert sum(got[i].predicted == truth[i] for i in held) / len(held) > 0.97
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    # Labels of held-out documents make no difference.
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs.drop("toxic"), flipped, params).bias == model.bias
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "zworker " * 300000), (1, "")], "doc_id bigint, text string")
    scores = [r.score for r in toxicity.score(odd, model).collect()]
    assert scores[0] == scores[1] == scores[3] < 0.3 < scores[2]
    assert toxicity.score(odd.limit(0), model).count() == 0
    empty = toxicity.fit(docs.drop("toxic"), labels.limit(0), params)
    assert {r.score for r in toxicity.score(odd, empty).collect()} == {0.5}


def test_ngrams_of_pieces_equal_those_of_the_whole(monkeypatch):
    text = " ".join(f"w{DRAW.randint(0, 99)}é" for _ in range(500))
    params = toxicity.ToxicityParams()
    whole = {(k, h) for k, part in enumerate(toxicity.ngrams(text, params)) for h in part.tolist()}
    monkeypatch.setattr(toxicity, "CHUNK", 64)
    assert {h for part in toxicity.ngrams(text, params) for h in part.tolist()} == {h for _, h in whole}
