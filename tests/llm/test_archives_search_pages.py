import gzip
import io

import numpy as np
import pytest

from gleanery.llm.archives import (
    archived_pages,
    as_arc,
    convert,
    convert_files,
    parse_arc,
    parse_warc,
    read_arc,
    read_warc,
    warc_date,
    write_warc,
)
from gleanery.llm.block_labeller import PAGE_BLOCKS, Vectors, extract_main_text, main_texts, runs_of
from gleanery.llm.impact_index import quantised, top_k
from gleanery.llm.markup_blocks import leaves
from gleanery.session import scratch_dir

PAGE = "<html><head><title>T</title></head><body><nav><ul><li><a href=x>Home</a><li><a href=y>More</a></ul></nav><article><h1>{0} title.</h1><p>First &amp; longer text, of page {0}.<p><b>Second<br>text</b> of page {0}.</article><div class=ad>Buy {0}</div><footer>&copy; {0}</footer></body></html>"
PAGES = "page_id long, url string, html string, text string, first long"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, f"http://h/{k}", PAGE.format(k), "t", 0) for k in range(40)]
    rows += [(50, "http://h/a b\n", PAGE.format(1), "t", 0), (51, None, None, "t", 0), (52, "u", "", None, None)]
    rows += [(53, "v", PAGE.format(1), "t", 1), (53, "v", PAGE.format(1), "t", 1), (None, "w", PAGE.format(2), "t", 0)]
    rows += [(None, "w", "alone\r\n\r\nWARC/1.1 é", "t", 0), (54, "x", "<p>" + "long text. " * 200_000, "t", 0)]
    return spark.createDataFrame(rows, PAGES).repartition(3)


def test_pages_come_back_from_the_archives(pages):
    rows = pages.collect()
    got = archived_pages(pages).collect()
    assert len(got) == len(rows)
    first = {}
    for r in rows:
        if r["page_id"] is not None:
            body = r["html"] or ""
            first[body] = min(first.get(body, r["page_id"]), r["page_id"])
    expected = []
    for r in rows:
        body = r["html"] or ""
        least = first.get(body)
        revisit = least is not None and least != r["page_id"]
        expected.append((r["page_id"], len(body.encode()), "revisit" if revisit else "response", least if revisit else None))
    assert sorted(map(str, expected)) == sorted(
        str((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"])) for r in got
    )
    assert archived_pages(pages.limit(0)).count() == 0


def test_arc_versions_and_files(spark, tmp_path):
    body = b"1 0 x\nURL IP-address Archive-date Content-type Archive-length\n"
    old = b"filedesc://a 0.0.0.0 19990101 text/plain %d\n%s\nhttp://a/b c 1.2.3.4 19990203040506 text/html 5\nhello\n" % (len(body), body)
    body = b"2 0 x\nURL ...\n"
    new = b"filedesc://a 0.0.0.0 19990101 text/plain %d\n%s\nhttp://d 1.2.3.4 2001 text/html 404 - - 9 f.arc 3\n\n\n\n\n" % (len(body), body)
    records = [*parse_arc(io.BytesIO(old)), *parse_arc(io.BytesIO(new))]
    assert [(r.url, r.code, r.payload) for r in records] == [("http://a/b c", "200", b"hello"), ("http://d", "404", b"\n\n\n")]
    assert warc_date(records[0].date) == "1999-02-03T04:05:06Z" and warc_date("2001") == "2001-01-01T00:00:00Z"
    with pytest.raises(ValueError):
        list(parse_arc(io.BytesIO(b"http://d 1.2.3.4 2001 text/html 30\nshort")))
    (tmp_path / "a.arc").write_bytes(old)
    (tmp_path / "b.arc.gz").write_bytes(gzip.compress(new))
    assert sorted(r["url"] for r in read_arc(spark, str(tmp_path)).collect()) == ["http://a/b c", "http://d"]


ANSWER = b"HTTP/1.0 404 Not Found\nContent-Type: text/plain\nServer: x\n\ngone\r\n\r\nfor good"


def test_answers_keep_their_heads(spark, tmp_path):
    """Files of ARC records become WARC files: status, type and digest are those of the answer."""
    import base64
    import hashlib

    line = b"http://a/%d 1.2.3.4 2001 text/plain %d\n%s\n"
    records = [ANSWER, ANSWER, b"HTTP/1.1 200 OK\r\n\r\n", b"no head at all", b"HTTP/1.1 200 without an end"]
    body = b"1 0 x\nURL\n"
    head = b"filedesc://a 0.0.0.0 19990101 text/plain %d\n%s\n" % (len(body), body)
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.arc").write_bytes(head + b"".join(line % (k, len(r), r) for k, r in enumerate(records)))
    target = str(tmp_path / "out")
    convert_files(spark, str(source), target)
    got = {r["url"]: r for r in read_warc(spark, target).collect()}
    bodies = [b"gone\r\n\r\nfor good"] * 2 + [b"", *records[3:]]
    for k, want in enumerate(bodies):
        row = got[f"http://a/{k}"]
        assert row["payload_bytes"] == len(want)
        assert row["payload_digest"] == base64.b32encode(hashlib.sha1(want).digest()).decode()
    assert sorted((got["http://a/0"]["record_type"], got["http://a/1"]["record_type"])) == ["response", "revisit"]
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "out").glob("*.gz"))
    answers = [block for _, block in parse_warc(io.BytesIO(raw))]
    assert sum(b.startswith(b"HTTP/1.0 404 Not Found\r\nContent-Type: text/plain\r\nServer: x\r\n\r\n") for b in answers) == 2
    assert all(b.count(b"HTTP/1") <= 1 or b"without an end" in b for b in answers)


def test_files_end_by_their_own_bytes(spark):
    """A few large pages among small ones: no file is longer than the limit and one record."""
    rows = [(k, f"http://h/{k}", ("x%d " % k) * (20_000 if k % 10 == 0 else 5), "t", 0) for k in range(200)]
    pages = spark.createDataFrame(rows, PAGES).coalesce(1)
    path = scratch_dir(spark, "warc")
    write_warc(convert(as_arc(pages)), path, 50_000)
    sizes = [len(gzip.decompress(bytes(r["content"]))) for r in spark.read.format("binaryFile").load(path).collect()]
    assert len(sizes) > 15 and max(sizes) < 50_000 + 110_000
    assert read_warc(spark, path).count() == 200


def test_reruns_write_the_same_records(spark, pages):
    one, two = (sorted(r["record"] for r in convert(as_arc(pages)).collect()) for _ in range(2))
    assert one == two
    path = scratch_dir(spark, "warc")
    write_warc(convert(as_arc(pages)), path, 10**9)
    assert read_warc(spark, path).count() == pages.count()


def test_main_text_of_pages(spark, pages):
    got = extract_main_text(pages).collect()
    assert len(got) == pages.count()
    for r in got:
        if r["page_id"] is not None and r["page_id"] < 40:
            k = r["page_id"]
            assert r["text"] == f"{k} title.\nFirst & longer text, of page {k}.\nSecond text of page {k}."
        assert r["n_chars"] == len(r["text"])
    texts = {r["page_id"]: r["text"] for r in got}
    assert texts[51] == texts[52] == "" and len(texts[54]) == 200_000 * 11 - 1
    assert extract_main_text(pages.limit(0)).count() == 0


def test_long_pages_are_learned_from(spark):
    def page(k):
        return PAGE.format(k).replace("<p><b>", f"<p>Some more text of page {k}, and so on. " * 1500 + "<p><b>")

    rows = [(None if k % 2 else k, page(k)) for k in range(12)]
    assert min(len(html) for _, html in rows) > 50_000
    frame = spark.createDataFrame(rows, "page_id long, html string").selectExpr("page_id", "string(page_id) url", "html")
    got = sorted(r["text"] for r in extract_main_text(frame).collect())
    more = "Some more text of page {0}, and so on.\n" * 1500
    expected = "{0} title.\nFirst & longer text, of page {0}.\n" + more + "Second text of page {0}."
    assert got == sorted(expected.format(k) for k in range(12))


def test_runs_cover_pages_from_first_to_last_block():
    vectors = Vectors()
    assert runs_of("", vectors) == runs_of("<br>", vectors) == []
    (whole,) = runs_of("<p>a.</p><nav>b</nav>", vectors)
    assert (whole.labels, whole.start, whole.end) == ([1, 0], 0.0, 1.0)
    runs = runs_of("<p>a" * (3 * PAGE_BLOCKS) + "<nav>b", vectors)
    assert sum(len(run.blocks) for run in runs) == PAGE_BLOCKS
    assert runs[0].start == 0.0 and runs[-1].end == 1.0 and runs[-1].labels[-1] == 0


def test_structure_decides_if_nothing_was_learned():
    assert main_texts([PAGE.format(3), ""], None, Vectors())[0].startswith("3 title.\nFirst & longer")


def test_leaves_of_broken_markup():
    def of(html):
        return [(x.path, x.text) for x in leaves(html)]

    assert of("a<p>b<p class='X y'>c</div>d<!-- e") == [((), "a"), (("p",), "b"), (("p", ".x", ".y"), "c"), (("p", ".x", ".y"), "d")]
    assert of("<script>x</p>") == [] and of("1 < 2 <b>x</b>y") == [((), "1 < 2 xy")]
    assert of("<ul><li>a<li>b</ul>c") == [(("ul", "li"), "a"), (("ul", "li"), "b"), ((), "c")]
    assert of('<p title="a>b">x&nbsp; &lt;y&gt;') == [(("p",), "x <y>")]
    assert of("<" * 20_000 + "<p " * 5_000 + "<!--" * 5_000)


def test_text_after_icons_is_kept():
    def of(html):
        return [(x.path, x.text) for x in leaves(html)]

    three = (("p",), "three")
    assert of("<p>one <svg-icon name='x'></svg-icon> two</p><p>three</p>") == [(("p",), "one"), (("p",), "two"), three]
    assert of("<p>one <svg class='i'/> two</p><p>three</p>") == [(("p",), "one two"), three]
    assert of("<p>one <svg/>two <svg a='>' />x<svg><path/>y</svg></p><p>three</p>") == [(("p",), "one two x"), three]
    assert of("<p>one</p><template-card>two</template-card><template>no</template><p>three</p><script-x>") == [
        (("p",), "one"), (("template-card",), "two"), three
    ]
    assert of("<svg " * 20_000 + "<svg a='" * 20_000)


def test_top_k_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(8)
    vectors = {k: rng.standard_normal(6).round(1).tolist() for k in range(400)}
    vectors |= {k: vectors[3] for k in range(400, 430)}
    vectors |= {500: None, 501: [1.0, None], 502: [float("nan")] * 6, 503: [float("inf")] * 6, 504: [], 505: [1e5] * 6}
    rows = [(k, v) for k, v in vectors.items()] + [(None, [1.0] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    frame = frame.select("vec_id", quantised(frame.embedding).alias("vector"))
    whole = {k: np.floor(256 * np.array((v + [0] * 6)[:6])).astype(int) for k, v in vectors.items() if k not in range(500, 504)}
    expected = []
    for q in (k for k in whole if k % 10 == 0):
        scores = sorted((-int(whole[q] @ v), k) for k, v in whole.items() if k != q)[:5]
        expected += [(q, n, k, -s) for n, (s, k) in enumerate(scores, 1)]
    got = top_k(frame, frame.where("vec_id % 10 = 0")).collect()
    assert sorted(expected) == sorted(tuple(r) for r in got)
    few = frame.where("vec_id in (0, 1, 2)")
    assert top_k(few, few.where("vec_id = 0")).count() == 2
    assert top_k(few.limit(0), few.limit(0)).count() == 0


def _in_article(html, block):
    """Behind the first paragraph of the article, or at its end where none is closed."""
    begin = html.find("<article>")
    at = html.find("</p>", begin)
    end = html.find("</article>", begin)
    at = at + 4 if -1 < at < end else end
    return html[:at] + block + html[at:]


def _prose(n, words):
    return "".join(f"<p>{words[(7 * n + k) % len(words)]}</p>" for k in range(n))


@pytest.fixture(scope="module")
def labeller():
    """A labeller of half of the pages, and the other half with what it should find."""
    import duckdb

    from gleanery.llm.block_labeller import learn, structure_labels

    rows = duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet' where html is not null order by hash(page_id)").fetchall()
    vectors = Vectors()
    known = learn([run for (html,) in rows[:128] for run in runs_of(html, vectors)])
    held = [html for (html,) in rows[128:]]
    want = ["\n".join(b.text for b, y in zip(p, structure_labels(p)) if y) for p in map(leaves, held)]
    words = [b.text for html in held[:20] for b in leaves(html) if len(b.text) > 30]
    return known, held, want, words


# Side blocks in and around the article, under names of the lists and names that say nothing.
VARIATIONS = {
    "comments inside": lambda html, w: html.replace("</article>", f'<section class="comments"><h3>Comments</h3>{_prose(3, w)}</section></article>'),
    "advert inside": lambda html, w: _in_article(html, f'<div class="ad">{w[3]}</div>'),
    "discussion after": lambda html, w: html.replace("</article>", f'</article><div class="discussion"><div class="reply">{_prose(1, w)}</div><div class="reply">{_prose(2, w)}</div></div>'),
    "thread inside": lambda html, w: html.replace("</article>", f'<div class="thread"><div class="msg">{_prose(1, w)}</div></div></article>'),
    "comments after": lambda html, w: html.replace("</article>", f'</article><div class="comments">{_prose(3, w)}</div>'),
    "cookie notice": lambda html, w: html.replace("<article>", f'<div class="cookie-notice"><p>{w[5]}</p></div><article>'),
    "sidebar": lambda html, w: html.replace("<article>", f'<aside class="sidebar"><ul><li><a href="x">{w[1]}</a></li></ul></aside><article>'),
    "form": lambda html, w: html.replace("</article>", f'</article><form class="subscribe"><p>{w[2]}</p></form>'),
    "other container": lambda html, w: html.replace("<article>", '<div class="content">').replace("</article>", "</div>"),
    "unnamed container": lambda html, w: html.replace("<article>", '<div class="zz">').replace("</article>", "</div>"),
    "as they are": lambda html, w: html,
}


@pytest.mark.parametrize("name", sorted(VARIATIONS))
def test_side_blocks_of_held_out_pages(labeller, name):
    known, held, want, words = labeller
    got = main_texts([VARIATIONS[name](html, words) for html in held], known, Vectors())
    right = sum(g == w for g, w in zip(got, want))
    assert right >= 0.9 * len(held), (name, right, len(held))
