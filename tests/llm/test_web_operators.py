"""URL filters, archives and template extraction against brute force, and their edge cases."""

import base64
import gzip
import hashlib
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from creditspark.llm.op01_url_filters import filter_urls, list_intervals, url_keys
from creditspark.llm.op02_arc_to_warc import ARC_FIELDS, arc_records, archive_pages, convert, read_arc, read_warc, warc_records, write_arc
from creditspark.llm.op08_template_extraction import deduce_container, extract_pages, extract_text, page_events

PAGE = "page_id long, url string, html string, host string, digest string, run long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 3) for r in rows], PAGE)


# ------------------------------------------------------------------ operator 1

ENTRY = "list string, kind string, pattern string, category string, day date, action string, extra string"
DAY = date(2021, 1, 1)


def test_intervals_follow_the_dated_events(spark):
    d = lambda n: DAY + timedelta(days=n)
    rows = [("block", "host", "a.com", "x", d(0), "add", "e"), ("block", "host", "a.com", "x", d(0), "add", "e"),
            ("block", "host", "a.com", None, d(5), "remove", "e"), ("block", "host", "a.com", "y", d(9), "add", "e"),
            ("block", "host", "a.com", "y", d(9), "remove", "e"), ("block", "host", "b.com", None, d(3), "add", "e"),
            ("block", "host", "c.com", "x", None, "add", "e"), (None, "host", "d.com", "x", d(1), "add", "e"),
            ("block", "odd", "e.com", "x", d(1), "add", "e")]
    got = sorted(tuple(r) for r in list_intervals(spark.createDataFrame(rows, ENTRY)).collect())
    assert got == [("block", "host", "a.com", "x", d(0), d(5)), ("block", "host", "b.com", "", d(3), None)]


def test_url_keys(spark):
    df = spark.createDataFrame([("HTTP://user@A.b.Example.com:80/x/y?q=1#f",), ("mailto:x",), (None,), ("https://h",)], "url string")
    got = [[(k.kind, k.key) for k in r.k] for r in df.select(url_keys(F.col("url")).alias("k")).collect()]
    assert set(got[0]) == {("url", "a.b.example.com/x/y?q=1"), ("host", "a.b.example.com"), ("domain", "a.b.example.com"), ("domain", "b.example.com"),
                           ("domain", "example.com"), ("path", "a.b.example.com/x"), ("path", "a.b.example.com/x/y")}
    assert got[1] == got[2] == []
    assert ("url", "h") in got[3]


def test_filter_matches_brute_force(spark):
    rng = random.Random(4)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org"]
    entries, captures = [], []
    for i in range(120):
        kind = rng.choice(["url", "path", "host", "domain"])
        host = rng.choice(hosts)
        pattern = {"url": f"{host}/p/{i % 4}", "path": f"{host}/p", "host": host, "domain": rng.choice(["a.com", "org", host])}[kind]
        entries.append((rng.choice(["block", "allow", "other"]), kind, pattern, "c", DAY + timedelta(days=rng.randrange(200)), rng.choice(["add", "add", "remove"]), "e"))
    for i in range(300):
        captures.append((i % 290, f"http://{rng.choice(hosts)}/p/{i % 4}", DAY + timedelta(days=rng.randrange(220)), "zz"))
    captures += [(500, None, DAY, "z"), (501, "http://a.com/", None, "z"), (502, "nothing", DAY, "z")] + captures[:2]
    got = filter_urls(spark.createDataFrame(captures, "page_id long, url string, fetched_on date, kind string"), spark.createDataFrame(entries, ENTRY)).collect()
    spans = [tuple(r) for r in list_intervals(spark.createDataFrame(entries, ENTRY)).collect()]
    order = ["url", "path", "host", "domain"]
    want = []
    for i, url, day, _ in captures:
        found = []
        if url and url.startswith("http://") and day:
            host, _, path = url[7:].partition("/")
            keys = {("url", url[7:]), ("host", host)}
            labels = host.split(".")
            keys |= {("domain", ".".join(labels[k:])) for k in range(max(len(labels) - 1, 1))}
            parts = [p for p in path.split("/") if p]
            keys |= {("path", host + "/" + "/".join(parts[:k + 1])) for k in range(max(len(parts), 1))}
            found = [(order.index(k), -len(p), 0 if name == "allow" else 1, name, k, p, c, a) for name, k, p, c, a, b in spans
                     if (k, p) in keys and a <= day and (b is None or day < b)]
        best = min(found, default=None)
        want.append((i, url, day, "unlisted" if best is None else "allowed" if best[3] == "allow" else "blocked",
                     best and best[4], best and best[5], len(found)))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.page_id, r.url, r.fetched_on, r.decision, r.matched_kind, r.matched_pattern, r.n_active) for r in got), key=key) == sorted(want, key=key)
    none = spark.createDataFrame([], ENTRY)
    assert filter_urls(spark.createDataFrame(captures, "page_id long, url string, fetched_on date, kind string"), none).where("decision = 'unlisted'").count() == len(captures)
    assert filter_urls(spark.createDataFrame([], "page_id long, url string, fetched_on date"), none).count() == 0


# ------------------------------------------------------------------ operator 2

def web_rows():
    return [(1, "http://a/ x", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (3, None, None), (4, "http://c", ""), (5, "http://d", "a\r\n\r\nWARC/1.1\r\nb\n\n"),
            (None, "http://e", "<p>é</p>"), (7, "http://f", "x" * 300_000), (7, "http://f", "x" * 300_000), (8, "http://g", "HTTP/1.1 200 OK\r\n\r\nbody")]


def test_archive_round_trip_and_revisits(spark):
    rows = web_rows()
    got = archive_pages(pages(spark, rows).repartition(3)).collect()
    want, largest = [], {}
    for i, _, html in rows:
        largest[html or ""] = max(largest.get(html or "", -1), -1 if i is None else i)
    for i, _, html in rows:
        data = (html or "").encode()
        first = largest[html or ""]
        kind = "response" if i == first else "revisit"
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, None if kind == "response" else first))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert all(r.block_digest_ok for r in got)
    ids = {r.record_id for r in got}
    assert all(r.refers_to_record in ids for r in got if r.record_type == "revisit")
    assert archive_pages(pages(spark, [])).count() == 0


def test_both_arc_versions_convert(spark, tmp_path):
    rows = [(i, f"http://h{i}/", f"<p>{i}</p>", "20010203040506") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, archive_date string").repartition(4)
    write_arc(df, str(tmp_path / "arc"))
    records = read_arc(spark, str(tmp_path / "arc")).collect()
    assert {r.arc_version for r in records} == {1, 2}
    assert sorted((r.page_id, r.url, bytes(r.payload).decode()) for r in records) == [r[:3] for r in rows]
    convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    out = read_warc(spark, str(tmp_path / "warc")).collect()
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in out) == [(r[0], r[2]) for r in rows]
    assert {r.warc_date for r in out} == {"2001-02-03T04:05:06Z"}


def test_arc_parser_reads_declared_lengths_and_refuses_others():
    body = f"1 0 someone\n{ARC_FIELDS[1]}\n"
    doc = "no http head\nhttp://fake 1.1.1.1 2000 text/html 5\n"
    text = f"filedesc://x 0.0.0.0 19990101000000 text/plain {len(body)}\n{body}\nhttp://u 1.2.3.4 199901010000 text/plain {len(doc)}\n{doc}\n"
    (record,) = arc_records(gzip.compress(text[:90].encode()) + gzip.compress(text[90:].encode()))
    assert record["payload"] == doc.encode() and record["page_id"] is None and record["archive_date"] == "199901010000"
    with pytest.raises(ValueError):
        list(arc_records(gzip.compress(text[:-20].encode())))
    with pytest.raises(ValueError):
        list(warc_records(gzip.compress(b"not a warc file\r\n")))
    assert list(arc_records(gzip.compress(b""))) == []


# ------------------------------------------------------------------ operator 8

def template(i, body, article="article"):
    return (f'<!DOCTYPE html><html><head><title>t{i}</title><script>var a="</p><p>no";</script><style>p{{}}</style></head><body>'
            f'<header class="site">Head {i}</header><nav><ul><li><a href=/x>menu {i}</a></ul></nav><!-- c --><div class="cookie-notice">we use cookies</div>'
            f'<div class="wrap"><{article}><h1>Title {i} &amp; more</h1>{body}<div class="comments"><p>reader {i}</p></div></{article}>'
            f'<aside>side {i}</aside></div><form><p>name</p></form><footer>&copy; foot {i}</footer></body></html>')


def test_extraction_by_template(spark):
    rows = []
    for i in range(30):
        body = f"<p>First&nbsp;  para {i}\n of <b>bold</b>text.<p>Second {i}<br>line<div class=ad>Buy {i}</div><ul><li>One {i}<li>Two</ul>"
        rows.append((i, "http://Site.example.com/a", template(i, body)))
    rows += [(100 + i, "http://div.example.com/", template(i, f"<p>{'long text ' * 30}{i}</p>", "div id=story")) for i in range(12)]
    got = {r.page_id: r for r in extract_pages(pages(spark, rows)).collect()}
    for i in range(30):
        assert got[i].text == f"Title {i} & more\nFirst para {i} of boldtext.\nSecond {i} line\nOne {i}\nTwo"
        assert got[i].n_chars == len(got[i].text)
    for i in range(12):
        assert got[100 + i].text == f"Title {i} & more\n" + f"{'long text ' * 30}{i}".strip()
        assert got[100 + i].container.endswith("div.story")


def test_extraction_edge_cases(spark):
    rows = [(1, None, None), (2, "x", ""), (3, "http://one.com", "just text &lt;b&gt;"), (3, "http://one.com", "just text &lt;b&gt;"),
            (None, "http://one.com/2", "<article><p>a<p>b</article>"), (5, "http://two.com", "<p title='unclosed>lost <script>x"), (6, "http://two.com", "<!-- never closed <p>x")]
    got = extract_pages(pages(spark, rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r.text)
    assert by[1] == by[2] == by[6] == [""] and by[3] == ["just text <b>"] * 2 and by[None] == ["a\nb"]
    assert extract_pages(pages(spark, [])).count() == 0


def test_pages_of_copies_keep_their_text(spark):
    rows = [(i, "http://same.com/", template(0, "<p>the very same article</p>")) for i in range(40)]
    assert {r.text for r in extract_pages(pages(spark, rows)).collect()} in ({"Title 0 & more\nthe very same article"},)


def test_events_close_unclosed_elements():
    paths = [e.path for kind, e, _ in page_events("<ul><li>a<li>b<ul><li>c</ul></ul><p>x<p>y</p></div>z") if kind == "text"]
    assert paths == ["/ul/li", "/ul/li", "/ul/li/ul/li", "/p", "/p", ""]
    assert extract_text("<b>a</b>b <i>c</i>", "") == "ab c"


def test_container_descends_by_slot_text():
    import pandas as pd

    classes = pd.DataFrame([("/html", 10, 10, 1000), ("/html/body", 10, 10, 1000), ("/html/body/div.a", 10, 10, 950), ("/html/body/div.b", 10, 10, 50),
                            ("/html/body/div.a/p", 10, 80, 950)], columns=["path", "pages", "times", "chars"])
    assert deduce_container(classes, 10) == "/html/body/div.a"
    assert deduce_container(classes.iloc[:0], 10) == ""


def test_repeated_notices_are_template_and_copies_are_not(spark):
    rows = []
    for host, n in (("many.com", 25), ("few.com", 4)):
        first = len(rows)
        rows += [(first + i, f"http://{host}/{i}", template(i, f"<p>Text {i} of {host}</p><p>Please share this story</p><ul><li>Mail</li><li>Print</li></ul>")) for i in range(n)]
    first = len(rows)
    rows += [(first + i, "http://copies.com/", template(0, "<p>Text of a copy</p>")) for i in range(30)]
    rows += [(first + 30 + i, "http://variants.com/", template(0, "<p>Text of a copy</p>") + f"<!-- {i} -->") for i in range(30)]
    got = {r.page_id: r for r in extract_pages(pages(spark, rows)).collect()}
    for i, url, _ in rows[:first]:
        host, k = url[7:].split("/")
        assert got[i].text == f"Title {k} & more\nText {k} of {host}"
    assert {got[i].text for i in range(first, len(rows))} == {"Title 0 & more\nText of a copy"}


def test_container_keeps_all_that_is_not_template(spark):
    page = '<html><body><div class="top">Our fine site</div><h1>Head {0}</h1><div class="lead">Lead {0}</div><div class="text">{1}{0}</div><div class="end">End {0}</div><div class="legal">All rights reserved</div></body></html>'
    rows = [(i, "http://plain.com/", page.format(i, "many words " * 40)) for i in range(8)]
    rows += [(100 + i, "http://one.com/", f'<body><div class="top">Our fine site</div><div class="text"><p>Words {i}<p>More {i}</div><div class="legal">All rights reserved</div></body>') for i in range(8)]
    got = {r.page_id: r for r in extract_pages(pages(spark, rows)).collect()}
    for i in range(8):
        assert got[i].text == f"Head {i}\nLead {i}\n{'many words ' * 40}{i}\nEnd {i}"
        assert got[100 + i].text == f"Words {i}\nMore {i}" and got[100 + i].container == "/body/div.text"


def test_class_words_make_no_furniture_of_the_content(spark):
    attributes = ['class="content has-sidebar"', "class='no-comments'", 'id="search-history"', 'aria-hidden="false"', 'title="the hidden life of bees"', 'data-class="menu"']
    rows = []
    for h, attribute in enumerate(attributes):
        for k, (a, z) in enumerate((("<article>", "</article>"), ("", ""))):
            page = f'<body><div class="share-menu">Share {{0}}</div><div {attribute}>{a}<h1>Head {{0}}</h1><p>The text of page number {{0}}</p><div aria-hidden="true">icon {{0}}</div>{z}</div></body>'
            rows += [(1000 * h + 100 * k + i, f"http://h{h}-{k}.com/", page.format(i)) for i in range(5)]
    rows.append((9999, "http://alone.com/", rows[0][2]))
    got = {r.page_id: r.text for r in extract_pages(pages(spark, rows)).collect()}
    assert {i: got[i] for i, _, _ in rows} == {i: f"Head {i % 100 if i < 9999 else 0}\nThe text of page number {i % 100 if i < 9999 else 0}" for i, _, _ in rows}


def test_template_without_article_or_telling_names(spark):
    page = "<body><div><b>Our site</b></div><div><table><tr><td><p>Text {0}</td></tr><tr><td>Print this page</td></tr></table></div><div>Imprint</div></body>"
    got = extract_pages(pages(spark, [(i, "http://bare.com/", page.format(i)) for i in range(6)])).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Text {i}" for i in range(6)}
