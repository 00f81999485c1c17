"""Main text of pages and their archives."""

import hashlib
import html
import random
import time

import pytest
from pyspark.sql import functions as F

from tablescout.llm import html_text as H
from tablescout.llm import warc as W

TREE = H.trained_tree()
PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{x}</style></head><body>
<header><a href="/">Home</a> Site name</header><nav><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies &amp; more</div><!-- <p>not this</p> -->
<article><header><h1>Title &lt;one&gt;</h1></header>
<p><b>First &eacute; line<br>second&nbsp;line<p>A paragraph with a <a href=x>link</a>
 and   text.</p><script>var t="</p>";</script><p>Short.</p>
<div class="ad banner">Buy this</div><form><label>Mail</label><input></form><aside><p>Aside text is long enough to be a paragraph.</p></aside>
<p>Last one &#8364;5 &amp;amp; end</p>
<section id="comments"><p>I liked this a lot, thank you for the text.</p></section></article>
<div class="sidebar"><p>Something else that is quite long and stands beside the article.</p></div><footer>&copy; us</footer></body></html>"""


def test_article_alone_is_kept():
    assert H.main_text(PAGE, TREE) == "\n\n".join(
        ["Title <one>", "First é line second line", "A paragraph with a link and text.", "Short.", "Last one €5 &amp; end"]
    )


def test_pages_without_marked_article_and_broken_ones():
    words = " ".join(["word"] * 30)
    page = f"<body><ul><li><a>Home</a><li><a>News</a></ul><h2>Head line</h2><p>{words}<p>{words}</p><p>Ok.</p><p>{words}</p><div><a>More</a></div>"
    assert H.main_text(page, TREE) == "\n\n".join(["Head line", words, words, "Ok.", words])
    assert H.main_text(f"<article><p>{words}<p>cut <b", TREE) == f"{words}\n\ncut"
    assert H.main_text(f"<article><p>{words}<!-- open <p>x", TREE) == words
    assert H.main_text(f'<div class="has-sidebar"><main><p>{words}</p></main></div>', TREE) == words
    framed = f'<div id="site-header"><p>{words}</p></div><div class="content" style="overflow:hidden"><p>{words}<p>End.</div><div hidden><p>{words}</div>'
    assert H.main_text(framed, TREE) == f"{words}\n\nEnd."
    # A part of a name marks no article, so the paragraphs do not stand outside one.
    assert H.main_text(f'<div class="post-meta">By me</div><p>{words}<p>{words}', TREE).endswith(f"{words}\n\n{words}")
    assert H.main_text(f"<article><p>{words}</p><p>a < b &am", TREE) == f"{words}\n\na < b &am"
    assert H.main_text(None, TREE) == H.main_text("", TREE) == H.main_text("<<<>>>", TREE).strip("<>") == ""


WORDS = " ".join(["word"] * 30)
TEXT = f"<h2>Head line</h2><p>{WORDS}</p><p>{WORDS} end</p><p>{WORDS}</p>"
PLAIN = f"Head line\n\n{WORDS}\n\n{WORDS} end\n\n{WORDS}"


@pytest.mark.parametrize(
    "page",
    [
        f"<article><svg class='i'/>{TEXT}</article>",
        f"<article><math/><svg viewBox='0 0 1 1'><path d='M1'/><text>no</text></svg>{TEXT}</article>",
        f"<article><svg class='open'>{TEXT}<svg><text>no</text></svg></article>",
        f"<article><!-->{TEXT}<!----></article>",
        f"<article><!--->{TEXT}<!-- no --!></article>",
        f"<form action=/x><input>{TEXT}</form>",
        f"<form><nav><a>Menu</a></nav><article>{TEXT}</article><label>no</label></form>",
        f"<article class='legal-news'>{TEXT}</article>",
        f"<div class='social-impact'>{TEXT}</div>",
        f"<section class='announcement'>{TEXT}</section><footer>no</footer>",
        f"<section id='discussion'>{TEXT}</section>",
        f"<div class='related-story'>{TEXT}</div><div class='ad'>{WORDS} no</div><div class='cookie-banner'>{WORDS} no</div>",
        f"<article>{TEXT}<form><p>Write to us here</p><label>Name</label></form><div class='social-links'>Tell others</div></article>",
    ],
)
def test_article_text_is_not_lost(page):
    for whole in (page, f"<html><body><nav><a>One</a><a>Two</a></nav>{page}<footer>us</footer></body></html>"):
        assert H.main_text(whole, TREE) == PLAIN


def test_random_markup_keeps_every_word_of_an_article():
    """Words of a marked article whose markup names nothing else: all of them, in order, as a plain tag walk gives them."""
    draw = random.Random(8)
    for _ in range(300):
        out, want, open_tags = [], [], []
        for i in range(draw.randrange(1, 60)):
            kind = draw.randrange(8)
            if kind < 4:
                out.append(f"w{i} ")
                want.append(f"w{i}")
            elif kind == 4:
                tag = draw.choice(["p", "b", "div", "section", "i", "span", "blockquote"])
                open_tags.append(tag)
                out.append(f"<{tag} class='x{i}' title=\"a > b\">")
            elif kind == 5 and open_tags:
                out.append(f"</{open_tags.pop()}>")
            elif kind == 6:
                out.append(draw.choice(["<!-- no -->", "<!-->", "<svg/>", "<svg><g>no</g></svg>", "<script>no <p></script>", "<br>", "<img alt='no'>", "</li>", "<style>no</style>"]))
            else:
                out.append("&amp; ")
                want.append("&")
        got = H.main_text("<article><h1>t</h1>" + "".join(out) + f"</article><p>{WORDS}</p>", TREE)
        assert got.split()[1:] == want, "".join(out)


def test_time_grows_with_the_length():
    def took(n):
        started = time.perf_counter()
        H.blocks("<div>" * n + "</li>x" * n + "</div>" * n)
        return time.perf_counter() - started

    took(1000)
    assert took(40_000) < 20 * max(took(4_000), 0.01)


def test_labelled_blocks_are_learned():
    rows = H.np.array(H.LABELLED, float)
    assert (TREE.predict(rows[:, :-1]) == rows[:, -1]).all() and len(rows) < 200


def test_extract_edge_cases(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "", ""), (3, "x", "<article><p>" + "word " * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = H.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 5
    assert all(r.n_chars == len(r.text) for r in got.collect()) and H.extract(df.limit(0)).count() == 0


def page_rows():
    big = "<p>" + "é" * 700
    rows = [(i, f"http://x/{i}", big if i % 3 == 0 else f"<p>{i}" + "y" * (i * 37)) for i in range(60)]
    rows += [(100, None, None), (101, "a%0D\r\nb", "same small"), (102, "c", "same small"), (None, "n", big), (103, "long", "z" * 900_000)]
    return rows + [(57, "http://x/57", big), (104, "only", "q" * 2000), (104, "only", "q" * 2000)]


@pytest.mark.parametrize("frame,bundle", [(256_000, 4_000_000), (3000, 2000)])
def test_archives_round_trip(spark, monkeypatch, frame, bundle):
    monkeypatch.setattr(W, "FRAME_BYTES", frame)
    monkeypatch.setattr(W, "BUNDLE_BYTES", bundle)
    rows = page_rows()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("n", F.lit(1))
    bundles = W.settle(W.write_bundles(df.repartition(2)))
    got = W.read_bundles(bundles).collect()
    payload = {}
    for i, url, page in rows:
        data = (page or "").encode()
        payload.setdefault((i, url), []).append((len(data), hashlib.sha1(data).hexdigest(), page or ""))
    largest = {}
    for i, _, page in rows:
        if i is not None and len((page or "").encode()) >= 1000:
            largest[page] = max(i, largest.get(page, -1))
    assert len(got) == len(rows)
    for r in got:
        i = None if r.page_id is None else int(r.page_id)
        size, digest, page = payload[(i, r.url)][0]
        assert (r.payload_bytes, r.payload_digest) == (size, digest)
        if size < 1000 or largest[page] == i:
            assert (r.record_type, r.refers_to, r.payload.decode()) == ("response", None, page)
        else:
            assert (r.record_type, int(r.refers_to), r.payload) == ("revisit", largest[page], None)
    for b in bundles.collect():
        assert sum(size for _, _, size in W.seek_table(b.archive)) == sum(x.length for x in b.records)
        for x in b.records:
            fields, _ = W.read_record(b.archive, x.frame, x.offset)
            assert fields["WARC-Record-ID"] == x.record_id


def test_frames_are_readable_as_one_stream_and_damage_is_seen(spark):
    import io

    import zstandard

    df = spark.createDataFrame([(1, "u", "<p>" + "x" * 5000)], "page_id long, url string, html string")
    bundles = W.write_bundles(df)
    archive = bundles.first().archive
    # The seek table is a skippable frame, so any decoder reads the records in a row.
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(archive), read_across_frames=True).read()
    assert whole.startswith(b"WARC/1.1\r\n") and whole.endswith(b"\r\n\r\n")
    with pytest.raises(ValueError):
        W.seek_table(archive[:-1])
    assert W.archive_pages(df.limit(0)).count() == 0


def test_entities_decode_once():
    assert html.unescape("&amp;lt;") == "&lt;"
    assert H.main_text("<article><p>&amp;lt; b</p></article>", TREE) == "&lt; b"


def test_archive_files_are_read_back(spark, tmp_path):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string")
    folder = f"file://{tmp_path}/archives"
    bundles = W.settle(W.write_bundles(pages.repartition(3)))
    for _ in range(2):
        written = W.export_bundles(bundles, folder).collect()
    files = sorted(p.name for p in (tmp_path / "archives").iterdir() if not p.name.endswith(".crc"))
    assert files == sorted(f"{r.bundle}.warc.zst" for r in written) and len(files) == bundles.count()
    key = lambda df: sorted((r.page_id or "", r.record_id, r.bundle, r.frame, r.offset, r.payload or b"") for r in df.collect())
    assert key(W.read_bundles(W.import_bundles(spark, folder))) == key(W.read_bundles(bundles))
    assert W.export_bundles(W.write_bundles(pages.limit(0)), folder).count() == 0
