"""Archives and page text."""

import base64
import hashlib
import random
import time

import pytest

from inventa.llm import op3_warc, op10_html
from inventa.llm.common import prepare, work_path

SCHEMA = "page_id long, url string, html string, digest string, rank int"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 3])
def test_warc_round_trip(spark, least):
    prepare(spark)
    rows = [(1, "u1", "<p>a"), (2, "u2", "<p>a"), (9, "u9\r\nX: y", "<p>a"), (9, None, "<p>a"), (3, None, None), (4, "u4", ""), (5, "é", "ü" * 70_000), (None, "n", "<p>a"), (6, "u6", "b"), (7, "u7", "b")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    archives = op3_warc.write_warc(df, work_path(spark, "t"), least=least)
    got = op3_warc.read_warc(archives).collect()
    assert len(got) == len(rows) == sum(r.n_records for r in archives.collect())
    expected = []
    for i, _, h in rows:
        size = len((h or "").encode())
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        top = max(same) if same and size >= least else i
        late = i != top and size >= least
        expected.append((op3_warc.urn(i), size, digest(h), "revisit" if late else "response", op3_warc.urn(top) if late else None))
    assert sorted([(r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == sorted(expected, key=str)
    for r in got:
        assert (r.payload is None) == (r.record_type == "revisit")
    assert all("\n" not in (r.url or "") for r in got)


def test_warc_of_nothing(spark):
    prepare(spark)
    archives = op3_warc.write_warc(spark.createDataFrame([], SCHEMA), work_path(spark, "t"))
    assert op3_warc.read_warc(archives).count() == 0


@pytest.fixture(scope="module")
def field():
    return op10_html.Field(*op10_html.model())


def test_held_out_pages(field):
    rng = random.Random(12345)
    right = every = 0
    for _ in range(150):
        blocks, labels = op10_html.labelled(op10_html.make_page(rng))
        right += sum(a == b for a, b in zip(labels, field.label(blocks)))
        every += len(labels)
    assert right / every > 0.985


CASES = [
    ("<nav><a href=/>x</a></nav><article><h1>T &amp; t</h1><p>One\n two<br>three <b>four</b></p><p>Five &copy; six.</article><footer>&copy; z</footer>", "T & t\n\nOne two three four\n\nFive © six."),
    ("<article><p>A sentence here.<p><b>Next &am", "A sentence here.\n\nNext &am"),
    ("<article><p>Kept text stands.</p><script>var a='<p>no</p>'</script><!-- <p>no</p> --><p>More text.</p></arti", "Kept text stands.\n\nMore text."),
    ("", ""), (None, ""), ("<", "<"), ("<style>p{}</style>", ""), ("<script>never ends <p>x", ""),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_pages(field, page, text):
    if page == "<":
        assert field.extract(page) in ("", "<")
    else:
        assert field.extract(page) == text


def test_surroundings_go(field):
    page = ('<body><header><h1>Site</h1></header><div class="cookie-banner"><p>We use cookies here.</p></div><article><h1>Title</h1><p>Body text of the page, long enough to read.</p>'
            '<form><label>Mail</label><button>Send</button></form></article><section class="comments"><p>I liked it very much, thanks.</p></section><aside><p>Other news today.</p></aside></body>')
    assert field.extract(page) == "Title\n\nBody text of the page, long enough to read."


def test_long_attributes_are_told_apart():
    style = "x" * 300
    blocks = op10_html.leaf_blocks(f'<div style="{style}" class="article-body">One</div><div style="{style}" class="comments">Two</div>')
    assert [(t, f.inner) for t, f, _ in blocks] == [("One", "content"), ("Two", "comment")]


def test_attributes_are_parsed():
    page = '<article><p title="a hidden gem">One</p><p data-id="comments">Two</p><p data-class=nav>Three</p><p title=\'id="footer"\'>Four</p><p HIDDEN>Five</p><p x="" class=comments>Six</p></article>'
    assert [(t, f.inner) for t, f, _ in op10_html.leaf_blocks(page)] == [("One", "content"), ("Two", "content"), ("Three", "content"), ("Four", "content"), ("Five", "notice"), ("Six", "comment")]


@pytest.mark.parametrize("depth", [10, 390, 420, 3000])
def test_depth_changes_nothing(field, depth):
    story = "<p>" + "A sentence of the story stands here. " * 3 + "</p>"
    page = f'<article><h1>Title</h1>{story}{"<div>" * depth}<div class="comments"><p>I liked it very much, thanks.</p></div>{"</div>" * depth}{story}</article>'
    text = "A sentence of the story stands here. " * 3
    assert field.extract(page) == f"Title\n\n{text.strip()}\n\n{text.strip()}"


BLOCKS = [
    ("<p>Energy is <math><mi>E</mi>=<mi>mc2</mi></math> and that.</p><p>Next</p>", ["Energy is E=mc2 and that.", "Next"]),
    ("<p>One<svg><path d=x>Label</p><p>Two</p>", ["OneLabel", "Two"]),
    ("<p>One</p><svg/><canvas><p>Two</p>", ["One", "Two"]),
    ("<p>One <object>three</object> four</p>", ["One three four"]),
    ("<p>One</p><template><p>Not</p></template><p>Two</p>", ["One", "Two"]),
    ("<div><template><p>Not</p></div><p>Two</p>", ["Two"]),
    ("<div><noscript>Not</div><p>Two</p>", ["Two"]),
    ("<head><title>Not</title><article><header><h1>One</h1></header><p>Two</p></article>", ["One", "Two"]),
    ("<head><meta name=x>One<p>Two", ["One", "Two"]),
    ("<head><noscript>Not<img></noscript></head><p>Two", ["Two"]),
    ("<p>One<iframe src=x><p>Two", ["One", "Two"]),
    ("<div>One<iframe src=x></div><p>Two", ["One", "Two"]),
    ("<svg><title>Not</title><style/><text>One</text></svg><scripty>Two</scripty><script>no</scripty></script>", ["OneTwo"]),
    ("<textarea>Not</textarea ><p>One", ["One"]),
]


@pytest.mark.parametrize(("page", "texts"), BLOCKS)
def test_only_what_is_never_shown_is_no_block(page, texts):
    assert [t for t, _, _ in op10_html.leaf_blocks(page)] == texts


def test_many_open_elements_are_no_burden():
    start = time.monotonic()
    assert len(op10_html.leaf_blocks("<b>x</i>" * 50_000)) == 1
    assert len(op10_html.leaf_blocks("<div><b>x" * 20_000)) == 20_000
    assert time.monotonic() - start < 20


LAYOUTS = [  # made by hand, unlike those of the generator
    ('<body class="post-template"><div id="page"><div class="site-top"><ul class="main-menu"><li><a href="/">Home</a></li><li><a href="/a">About</a></li></ul></div>'
     '<div class="entry-content"><h1>How to mend a kettle</h1><p>First, unplug it and let it cool for an hour.</p><ul><li>Screwdriver</li><li>New fuse</li></ul><p>Then open the base and look at the fuse.</p></div>'
     '<div class="sidebar"><h3>Popular</h3><ul><li><a href="/x">Ten mugs</a></li></ul></div><div class="footer">© 2020 Kettle House. All rights reserved.</div></div></body>',
     "How to mend a kettle\n\nFirst, unplug it and let it cool for an hour.\n\nScrewdriver\n\nNew fuse\n\nThen open the base and look at the fuse."),
    ('<main><nav class="breadcrumb"><a href=/>News</a> / <a href=/w>World</a></nav><article><h1>Rain in the hills</h1><p>The rain came early this year, and it stayed.</p>'
     '<aside class="ad-slot"><p>Buy boots today!</p></aside><blockquote><p>We have never seen so much water.</p></blockquote><p>Roads are closed until Monday.</p></article>'
     '<section id="comments"><h2>Comments</h2><article><p>Stay safe, all of you.</p></article></section></main>',
     "Rain in the hills\n\nThe rain came early this year, and it stayed.\n\nWe have never seen so much water.\n\nRoads are closed until Monday."),
]


@pytest.mark.parametrize(("page", "text"), LAYOUTS)
def test_layouts_made_by_hand(field, page, text):
    assert field.extract(page) == text


def test_deep_and_broken_pages_end(field):
    assert isinstance(field.extract("<div>" * 5000 + "x" + "</p>" * 5000), str)
    assert isinstance(field.extract('<a href="' * 2000 + ">x"), str)


def test_extract_rows(spark, field):
    rows = [(1, "u", CASES[0][0], "t"), (1, "u", CASES[0][0], None), (None, None, None, "t"), (2, "v", "", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = op10_html.extract(df).collect()
    assert sorted((str(r.page_id), r.text) for r in out) == sorted([("1", CASES[0][1])] * 2 + [("None", ""), ("2", "")])
    assert op10_html.extract(df.limit(0)).count() == 0


def test_gradient_of_the_field_separates():
    pages = [([("a",), ("b",), ("a",)], [1, 0, 1]), ([("b",), ("a",)], [0, 1])] * 5
    w, t = op10_html.train(pages)
    assert w["a"][1] > w["a"][0] and w["b"][0] > w["b"][1] and t.shape == (2, 2)
