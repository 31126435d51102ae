"""HTML extraction, ARC to WARC and URL filters."""

import datetime
import gzip
import hashlib
import io
import random
import re
import zlib

import duckdb
import pytest

from pulsefeat.llm import html_extract, url_filter, warc

PAGES = "page_id long, url string, html string, digest string"
ARTICLE = "<article><h1>Title &amp; more</h1><p>First <b>bold</b>text.<p>Second &lt;x&gt; with <a href=y>link</a> in it, long enough to count.<ul><li>one<li>two</ul></article>"
WANT = "Title & more First boldtext. Second <x> with link in it, long enough to count. one two"


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><script>var a='</p>';</script></head><body>{body}</body></html>"


def test_main_text_of_many_layouts(spark):
    noise = '<nav><a href=x>Home</a></nav><header><p>Site name and claim</p></header><div class="cookie-notice">We use cookies</div><aside>Popular</aside>'
    end = "<section id=comments><p>A very long reader comment, longer than the article itself by far: " + "so long " * 60 + "</p></section><footer>c 2020</footer>"
    post = ARTICLE.replace("article", "div").replace("<div>", '<div class="post-17 content">')
    cases = [
        (page(noise + ARTICLE + end), WANT),
        (page(noise + f'<div class="wrap has-sidebar">{post}<div class="sidebar"><p>Other things</p></div></div>' + end), WANT),
        (page(noise + "<main>" + ARTICLE + "<form><label>Mail</label><input></form></main>"), WANT),
        (page(noise + ARTICLE)[:-40], None),
        ("", ""), (None, ""), ("<p>", ""), (page(""), ""), ("plain words only", "plain words only"),
        (page("<article><style>p{}</style><div class=ad>Buy</div><p>a\n\t b&nbsp;c</p><!-- x --><p>d<br>e</p></article>"), "a b c d e"),
    ]
    df = spark.createDataFrame([(i, f"http://h{i}.example.com/", h, "") for i, (h, _) in enumerate(cases)] + [(50, None, cases[0][0], None), (50, None, cases[0][0], None)], PAGES)
    got = html_extract.main_texts(df).orderBy("page_id").collect()
    for r, (_, want) in zip(got, cases):
        if want is not None:
            assert (r.page_id, r.text, r.n_chars) == (r.page_id, want, len(want))
    assert [r.text for r in got if r.page_id == 50] == [WANT, WANT]
    assert html_extract.main_texts(spark.createDataFrame([], PAGES)).collect() == []


def test_main_text_keeps_what_lies_around_the_best_container(spark):
    body = "".join(f"<p>Paragraph {c} of the story goes on and on for a while.</p>" for c in "abcdefgh")
    plain = " ".join(f"Paragraph {c} of the story goes on and on for a while." for c in "abcdefgh")
    noise = "<nav><a href=x>Home</a></nav><footer>c 2020</footer>"
    cases = [
        (f"<article><h1>Title</h1><p>Lead.</p><div class=entry-content>{body}</div></article>", f"Title Lead. {plain}"),
        (f"<article><header><h1>Title</h1></header><div class=entry-content>{body}</div></article>", f"Title {plain}"),
        (f"<article><section class=intro><p>Intro.</p></section><section class=text>{body}</section><section class=end><p>End.</p></section></article>", f"Intro. {plain} End."),
        (f"<main><h1>Title</h1><article>{body}</article></main>", f"Title {plain}"),
        (f"<div class=wrap><h1>Title</h1><div class=text>{body}</div><div class=end><p>End.</p></div></div>", f"Title {plain} End."),
        (f"<h1>Title</h1><div class=text>{body}</div>", f"Title {plain}"),
    ]
    df = spark.createDataFrame([(i, f"http://h{i}.example.com/", page(noise + h), "") for i, (h, _) in enumerate(cases)], PAGES)
    assert [r.text for r in html_extract.main_texts(df).orderBy("page_id").collect()] == [want for _, want in cases]


def test_host_takes_away_only_what_it_repeats(spark):
    long = "<p>" + "the story goes on " * 8 + "</p>"
    normal = lambda i: page(f"<div class=story>{long}<p>{i}</p></div><div class=extra><p>All rights reserved</p></div>")
    odd = page(f"<div class=story>{long}</div><div class=extra>{long * 2}</div>")
    rows = [(i, "http://one.example.com/a", normal(i), "") for i in range(5)] + [(9, "http://one.example.com/b", odd, ""), (10, "http://two.example.com/", normal(7), "")]
    rows += [(20 + i, "http://copies.example.com/", normal(8), "") for i in range(5)]
    got = {r.page_id: r for r in html_extract.main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    story = ("the story goes on " * 8).strip()
    assert got[9].host_path.endswith("div.story") and got[9].text == f"{story} {story} {story}"
    assert got[1].text == f"{story} 1"
    # One page, or copies of one page, repeat nothing.
    assert got[10].text == f"{story} 7 All rights reserved" and got[20].text == f"{story} 8 All rights reserved"


def test_five_pages_keep_their_text(spark):
    lead, links = "A short lead.", "".join(f"<p><a href=x{c}>Paragraph {c} of the story goes on and on for a while.</a></p>" for c in "abcdefgh")
    cases = [
        (f"<main><p>{lead}</p><section id=discussion>{STORY}</section></main>", f"{lead} {PLAIN}"),
        (f"<article><div class=header><h1>Title</h1><p>{lead}</p></div>{STORY}</article>", f"Title {lead} {PLAIN}"),
        (f"<div class=lead><p>{lead}</p></div><div class=body>{STORY}</div>", f"{lead} {PLAIN}"),
        (f"<div class=body>{links}</div>", PLAIN),
    ]
    rows = [(i, f"http://h{i}.example.com/", page(h), "") for i, (h, _) in enumerate(cases)]
    rows += [(10 + i, "http://nine.example.com/", page(f"<div class=one>{STORY}<p>{i}</p></div><div class=two><a href=q>Elsewhere there is more of this, page {i}</a></div>"), "") for i in range(9)]
    rows += [(30, "http://nine.example.com/", page(f"<div class=one><p>{lead}</p>{STORY}</div><div class=two>{STORY}</div>"), "")]
    got = {r.page_id: r.text for r in html_extract.main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert [got[i] for i in range(4)] == [want for _, want in cases]
    assert got[30] == f"{lead} {PLAIN} {PLAIN}" and got[13] == f"{PLAIN} 3"


def test_host_does_not_overrule_what_its_voters_lack(spark):
    summary, body = "<p>" + "the summary says so " * 8 + "</p>", "<p>" + "the long body goes on " * 12 + "</p>"
    short = page(f"<div class=summary>{summary}</div>")
    full = page(f"<div class=summary>{summary}</div><div class=body>{body}</div>")
    df = spark.createDataFrame([(i, "http://one.example.com/a", short, "") for i in range(5)] + [(9, "http://one.example.com/b", full, "")], PAGES)
    got = {r.page_id: r for r in html_extract.main_texts(df).collect()}
    assert got[9].host_path.endswith("div.summary")
    assert got[9].text == ("the summary says so " * 8 + "the long body goes on " * 12).strip() and got[1].text == ("the summary says so " * 8).strip()


STORY = "".join(f"<p>Paragraph {c} of the story goes on and on for a while.</p>" for c in "abcdefgh")
PLAIN = " ".join(f"Paragraph {c} of the story goes on and on for a while." for c in "abcdefgh")


def test_ordinary_html_loses_nothing(spark):
    noise = "<nav><a href=x>Home</a></nav><footer>c 2020</footer>"
    intro = "An introduction of some length that stands in a block of its own."
    cases = [
        (f"<html><head><title>T</title><meta charset=utf-8><body>{noise}<article>{STORY}</article></body></html>", PLAIN),
        (f"<html><head><title>T</title><style>p{{}}</style><div>{STORY}</div></html>", PLAIN),
        (f"<head><title>T</title>{PLAIN}", PLAIN),
        (page(f"<form id=aspnetForm><input type=hidden>{noise}<div class=content>{STORY}</div><button>Go</button></form>"), PLAIN),
        (page(f"<form><label>Mail address of the reader</label><input></form><div class=content>{STORY}</div>"), PLAIN),
        (page(f"{noise}<div class=intro><p>{intro}</p></div><div class=body>{STORY}</div>"), f"{intro} {PLAIN}"),
        (page(f"{noise}<div class=a><div class=intro><p>{intro}</p></div></div><div class=b><div class=body>{STORY}</div></div>"), f"{intro} {PLAIN}"),
        (page(f"{noise}<h2>A heading</h2><div class=body>{STORY}</div>{intro}"), f"A heading {PLAIN} {intro}"),
        (page(f"{noise}<ul><li><a href=a>One link that leads elsewhere</a><li><a href=b>Another link that leads on</a></ul><div class=body>{STORY}</div>"), PLAIN),
        (page(f"<main><div class=intro><p>{intro}</p></div><article>{STORY}</article></main><div><p>{intro}</p></div>"), f"{intro} {PLAIN}"),
        (page(f"<article>{STORY}<div class=social-science><p>Science.</p></div><div class=social-links>Share</div><section class=discussion><p>Discussed.</p></section><div id=post-comments><p>Reader.</p></div></article>"), f"{PLAIN} Science. Discussed."),
        (page(f"<div>{STORY}</div><section class=discussion><p>{'A reader says so. ' * 9}</p></section>"), PLAIN),
        (page(f"<article>{'<p>' + 'x' * 400_000 + '</p>'}{'<b>' * 3000}{STORY}</article>"), "x" * 400_000 + " " + PLAIN),
    ]
    df = spark.createDataFrame([(i, f"http://h{i}.example.com/", h, "", "clash", "clash") for i, (h, _) in enumerate(cases)], PAGES + ", text string, host string")
    got = html_extract.main_texts(df).orderBy("page_id").collect()
    assert [(r.page_id, r.text) for r in got] == [(i, want) for i, (_, want) in enumerate(cases)]


def test_known_articles_of_generated_hosts(spark):
    """Several layouts, one for each host, with short and long texts in each part; what is no article has
    class names that say nothing, so that only the host's pages together tell."""
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(["water", "stone", "light", "seven", "cold", "river", "house", "over"]) for _ in range(n)).capitalize() + "."
    layouts = [
        "<nav><a href=/>Home</a></nav><article><h1>{0}</h1><p>{1}</p><div class=e>{2}</div></article><aside>{3}</aside>",
        "<div class=w><h1>{0}</h1><p>{1}</p><div class='e x{4}'>{2}</div></div><div class=ads>{3}</div>",
        "<div class=k{4}><p>{0}</p></div><div class=l><p>{1}</p></div><div class=m>{2}</div><div class=z><a href=q>{3}</a></div>",
        "<main><section class=t><h2>{0}</h2></section><section class=u><p>{1}</p>{2}</section></main><div class=z><p>{3}</p></div>",
        "<div class=q><p>Ours since ninety-nine</p></div><div class=k><p>{0}</p></div><div class=l><p>{1}</p>{2}</div><div class=z><p>No part may be used, not even this</p></div>",
    ]
    rows, want = [], {}
    for i in range(500):
        layout = i % 5
        parts = [say(rng.randint(5, 12)), say(rng.randint(4, 60)), "".join(f"<p>{say(rng.randint(5, 60))}</p>" for _ in range(rng.randint(3, 9))), say(rng.randint(3, 12))]
        rows.append((i, f"http://host{layout}.example.com/{i}", page(layouts[layout].format(*parts, i)), ""))
        want[i] = " ".join(re.sub("<[^>]*>", " ", " ".join(parts[:3])).split())
    got = {r.page_id: r.text for r in html_extract.main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    wrong = [i for i in want if got[i] != want[i]]
    assert not wrong, (len(wrong), got[wrong[0]], want[wrong[0]])


def test_archives_round_trip(spark):
    big = "<p>é" + "x" * 200 + "\r\n\r\nWARC/1.1\r\n</p>"
    rows = [(3, "http://a/", big, ""), (1, "http://b/ c", big, ""), (7, None, big, ""), (4, "http://d/", "short", ""), (5, "http://e/", "short", ""), (6, "http://f/", None, ""), (8, "http://g/", big + "z", "")]
    df = spark.createDataFrame(rows, PAGES)
    got = {r.page_id: r for r in warc.archive_pages(df).collect()}
    for i, _, h, _ in rows:
        data = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("response", None), 3: ("revisit", 1), 7: ("revisit", 1), 4: ("response", None), 5: ("response", None), 6: ("response", None), 8: ("response", None)}
    assert warc.archive_pages(spark.createDataFrame([], PAGES)).collect() == []
    odd = warc.archive_pages(spark.createDataFrame([(None, "u", big, ""), (2, "u", big, ""), (9, "v", "s", "")], PAGES)).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in odd) == [("2", "response", None), ("9", "response", None), ("None", "revisit", 2)]


def test_both_arc_versions_and_payloads_with_line_ends():
    for version in (1, 2):
        body = f"{version} 0 org\n{' '.join(warc.FIELDS[version])}\n".encode()
        content = warc.arc_header(version, "filedesc://x", "20240101000000", "text/plain", "x", 0, body) + body + b"\n"
        blocks = [b"a\n\nb", b"", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\n"]
        for i, b in enumerate(blocks):
            content += warc.arc_header(version, f"http://{i}/x y", "20240102030405", "text/html", "x", 7, b) + b + b"\n"
        found = list(warc.parse_arc(content))
        assert [r["block"] for r in found] == blocks and [r["URL"] for r in found] == [f"http://{i}/x y" for i in range(3)]
    assert warc.split_http(blocks[2]) == (b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n", b"body\n")


def test_damaged_and_gzipped_arc():
    body = f"1 0 org\n{' '.join(warc.FIELDS[1])}\n".encode()
    content = warc.arc_header(1, "filedesc://x", "20240101000000", "text/plain", "x", 0, body) + body + b"\n"
    content += warc.arc_header(1, "http://a/", "20240102030405", "text/html", "x", 7, b"whole") + b"whole\n"
    cut_block = content + warc.arc_header(1, "http://b/", "20240102030405", "text/html", "x", 7, b"not whole") + b"not"
    for data in (cut_block, gzip.compress(content) + gzip.compress(cut_block[len(content) :])):
        assert [(r["block"], r["truncated"]) for r in warc.parse_arc(data)] == [(b"whole", False), (b"not", True)]
    with pytest.raises(ValueError, match="cut short"):
        list(warc.parse_arc(content + b"http://b/ 0.0.0.0 2024"))
    assert b"WARC-Truncated: unspecified\r\n" in warc.warc_record("response", "urn:uuid:1", "http://a/", "d", "i", "m", b"HTTP/1.1 200 OK\r\n\r\n", b"x", "d", None, True)


def test_warc_files_are_bounded_and_have_a_member_for_each_record(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    rng = random.Random(5)
    html = ["<p>" + "".join(rng.choice("abcdefgh ") for _ in range(rng.choice([5, 900, 60_000]))) for _ in range(40)]
    df = spark.createDataFrame([(i, f"http://h/{i}", h, "", 7) for i, h in enumerate(html)], PAGES + ", digest int").repartition(2)
    path = str(tmp_path / "warc")
    warc.write_warc(warc.convert(warc.arc_archives(df)), path)
    files = [f.read_bytes() for f in (tmp_path / "warc").glob("part-*")]
    assert len(files) > 8
    seen = []
    for data in filter(None, files):
        members = []
        while data:
            d = zlib.decompressobj(31)
            members.append(d.decompress(data))
            assert d.eof
            data = d.unused_data
        assert members[0].startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and members[-1] == b""
        for m in members[1:-1]:
            ((headers, block),) = warc.parse_warc(io.BytesIO(m))
            seen.append(block.partition(b"\r\n\r\n")[2].decode())
    assert sorted(seen) == sorted(html)
    got = {r.page_id: r.payload.decode() for r in warc.read_warc(spark, path).collect()}
    assert got == dict(enumerate(html))


def test_revisits_of_heads_without_a_length(spark):
    """Real ARC records may lack a content length: a revisit's size is then its target's."""
    body = f"1 0 org\n{' '.join(warc.FIELDS[1])}\n".encode()
    content = warc.arc_header(1, "filedesc://x", "20240101000000", "text/plain", "x", 0, body) + body + b"\n"
    for i in (4, 2):
        block = b"HTTP/1.1 200 OK\r\nX-Page-Id: %d\r\n\r\n" % i + b"x" * 300
        content += warc.arc_header(1, "http://a/", "20240102030405", "text/html", "x", 7, block) + block + b"\n"
    path = warc.new_path(spark, "warc")
    warc.write_warc(warc.convert(spark.createDataFrame([("x", bytearray(content))], "name string, content binary")), path)
    found = warc.read_warc(spark, path)
    assert {r.page_id: r.payload_bytes for r in found.collect()} == {2: 300, 4: None}
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.verdicts(found).collect()) == [(2, 300, "response", None), (4, 300, "revisit", 2)]


def test_warc_records_parse_by_length():
    one = warc.warc_record("response", "urn:uuid:1", "http://a/", "2024-01-01T00:00:00Z", "0.0.0.0", "text/html", b"HTTP/1.1 200 OK\r\n\r\n", b"x\r\n\r\nWARC/1.1\r\n", "d", None)
    two = warc.warc_record("revisit", "urn:uuid:2", "http://a/", "2024-01-01T00:00:00Z", "0.0.0.0", "text/html", b"HTTP/1.1 200 OK\r\n\r\n", b"gone", "d", "urn:uuid:1")
    found = list(warc.parse_warc(io.BytesIO(one + b"\r\n\r\n" + two + b"\r\n\r\n")))
    assert [h["warc-type"] for h, _ in found] == ["response", "revisit"]
    assert found[0][1].endswith(b"WARC/1.1\r\n") and found[1][1] == b"HTTP/1.1 200 OK\r\n\r\n" and found[1][0]["warc-refers-to"] == "<urn:uuid:1>"


def test_url_verdicts_as_of_fetch_time(spark):
    day = lambda n: datetime.datetime(2024, 1, n)
    entries = [("bad.com", "block", day(5)), ("bad.com", "remove", day(10)), ("BAD.com", "block", day(20)), ("ok.bad.com", "allow", day(1)), ("both.org", "allow", day(3)), ("both.org", "block", day(3)), (None, "block", day(1)), ("x.net", "noise", day(1)), ("x.net", "block", None)]
    captures = [
        (0, "http://bad.com/a", day(4), True), (1, "http://bad.com/a", day(5), False), (2, "http://www.bad.com:80/", day(9), False), (3, "http://bad.com/", day(10), True), (4, "https://u:p@Bad.COM?q", day(25), False),
        (5, "http://ok.bad.com/", day(25), True), (6, "http://both.org", day(4), False), (7, None, day(4), True), (8, "no url", day(4), True), (9, "http://bad.com/", None, True), (10, "http://x.net/", day(4), True), (11, "http://notbad.com/", day(25), True), (1, "http://bad.com/a", day(5), False),
    ]
    e = spark.createDataFrame(entries, "pattern string, action string, entry_date timestamp")
    c = spark.createDataFrame([(i, u, t, "host") for i, u, t, _ in captures], "page_id long, url string, fetched_at timestamp, host string")
    got = sorted((r.row.page_id, r.kept) for r in url_filter.judge_urls(c, e).collect())
    assert got == sorted((i, k) for i, _, _, k in captures)
    assert url_filter.filter_urls(c, e).columns == c.columns
    assert url_filter.judge_urls(c.limit(0), e).collect() == [] and url_filter.judge_urls(c, e.limit(0)).where("kept").count() == len(captures)


def test_queries_equal_sql(spark):
    from pulsefeat.llm.queries import ORACLES, QUERIES

    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    for name, sql in ORACLES.items():
        result = c.execute(sql)
        names = [d[0] for d in result.description]
        got = QUERIES[name](spark, "/root/testdata/sf0.001").select(*names)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, result.fetchall())), name
