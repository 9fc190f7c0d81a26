import tracemalloc

import numpy as np
from logquarry.llm import html_extract as he

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header class="site-header"><a href="/">Site</a></header><div id="cookie-notice"><p>We use cookies.</p></div>
<ul class="menu"><li><a href=/a>Home</a><li><a href="/b">News</a></ul><!-- <p>x</p> --><article><h1>Head &amp; line</h1><p>First  para&nbsp;graph <a href=x>link</a>.<p><b>Bold.<br><p>Second &lt;one&gt;</p><div class="advert">Buy now</div><p>Last &am"""


def test_blocks():
    blocks = he.blocks_of(PAGE)
    assert [b.text for b in blocks] == ["Site", "We use cookies.", "Home", "News", "Head & line", "First para graph link.", "Bold.", "Second <one>", "Buy now", "Last &am"]
    assert he.blocks_of(None) == [] and [b.text for b in he.blocks_of("a < b <3 <p")] == ["a < b <3"]


def test_gradients():
    """Back-propagation through time against differences."""
    net, rng = he.Labeller(), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    pages = []
    for _ in range(2):
        markup, labels = he.generated_page(rng)
        pages.append((he.Page(he.blocks_of(markup)[:6]), np.array(labels[:6], np.float32)))
    loss, grads, *_ = net.gradients([p for p, _ in pages], [y for _, y in pages])
    for name, at in (("uf", (3, 5)), ("wb", (24, 9)), ("out", (4,)), ("bf", (20,)), ("skip", (25,))):
        eps, old = 1e-3, net.p[name][at]
        values = []
        for d in (eps, -eps):
            net.p[name][at] = old + d
            values.append(net.gradients([p for p, _ in pages], [y for _, y in pages])[0])
        net.p[name][at] = old
        assert abs((values[0] - values[1]) / (2 * eps) - grads[name][at]) < 2e-3


def test_extraction(spark):
    net = he.trained()
    rng, wrong, total = np.random.default_rng(77), 0, 0
    for _ in range(60):
        markup, labels = he.generated_page(rng)
        if len(blocks := he.blocks_of(markup)) == len(labels):
            wrong += int((net.label([he.Page(blocks)])[0] != np.array(labels)).sum())
            total += len(labels)
    assert wrong <= 0.02 * total
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (None, "u", PAGE), (1, "u", PAGE), (4, "u", "<article>" + "<p>Some words here.</p>" * 3000 + "</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS row")
    got = sorted(((r.page_id, r.text) for r in he.extract(pages).select("row.page_id", "text").collect()), key=repr)
    want = "Head & line First para graph link. Bold. Second <one> Last &am"
    assert got == sorted([(1, want), (1, want), (None, want), (2, ""), (3, ""), (4, " ".join(["Some words here."] * 3000))], key=repr)
    assert he.extract(pages.limit(0)).count() == 0


def test_long_and_deep_pages_are_read_whole():
    net, rng = he.Labeller(), np.random.default_rng(2)
    for k in ("path", "word"):
        net.p[k] = rng.standard_normal(net.p[k].shape).astype(np.float32)
    net.p["bf"][he.HIDDEN : 2 * he.HIDDEN] = net.p["bb"][he.HIDDEN : 2 * he.HIDDEN] = 8  # a memory that lasts
    page = he.Page(he.blocks_of("<section class=comments>" + "".join(f"<p>text {k}</p>" for k in range(3000))))
    z, _ = net.forward(net.inputs(page)[:, None, :], np.ones((3000, 1), np.float32))
    assert len(page) == 3000 and (net.label([page, page, he.Page([])])[1] == (z[:, 0] > 0)).mean() > 0.999
    last = he.blocks_of('<div class="comments">' + "<div>" * 40 + "deep")[-1]
    assert last.path.count("div") == 41 and "=comments" in last.path
    assert "=nine" in he.path_words("div", 'class="one two three four five six seven eight nine"')
    words = [f"w{k}" for k in range(60)]
    assert len(he.Page([he.Block(("p",), " ".join(words), 0.0)]).words[0]) == 60


def test_a_page_takes_space_by_its_length():
    markup = "".join(f'<div class="c{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}{chr(97 + k // 17576)}">t' for k in range(40_000))
    tracemalloc.start()
    page = he.Page(he.blocks_of(markup))
    sums = page.path_sums(np.ones((he.PATHS, 2), np.float32))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(page) == 40_000 and peak < 120e6
    assert sums[-1, 0] == 40_000 + 2  # every class, div and the last word


def test_path_sums():
    """Summed down the tree as from the words written out."""
    rng = np.random.default_rng(4)
    table = rng.integers(0, 100, (he.PATHS, 3)).astype(np.float32)
    pages = [he.Page(he.blocks_of(PAGE)), he.Page(he.blocks_of('loose<div class="a b a"><p class=b>x</p><div class="a">y</div></div>z'))]
    for page in [*pages, *[he.Page(he.blocks_of(he.generated_page(rng)[0])) for _ in range(20)]]:
        assert np.array_equal(page.path_sums(table), np.array([table[p].sum(axis=0) for p in page.paths]))
    blocks = he.blocks_of('<div class="a b a"><p class=b>x</p><div class="a c">y</div></div><p class=b>z')
    words = [{"div", "=a", "=b", "p"}, {"div", "=a", "=b", "=c"}, {"p", "=b"}]
    assert [set(b.path) for b in blocks] == words
    assert [sorted(p) for p in he.Page(blocks).paths] == [sorted(he.bucket(w, he.PATHS) for w in {*s, f"last {b.element.words[-1]}"}) for s, b in zip(words, blocks, strict=True)]


def test_a_hand_written_page():
    """A page of no generator's layout."""
    markup = """<html><body class="home-layout"><div id=topbar><a href=/>Daily Bugle</a> | <a href=/world>World</a> | <a href=/sport>Sport</a></div>
<table class=wrapper><tr><td><div class="article-body"><h2>Bridge reopens after repairs</h2><p>The old bridge over the river reopened on Monday after eleven months of repairs, the council said.</p>
<p>Engineers replaced four of its six piers and strengthened the deck. &ldquo;It will stand for another century,&rdquo; said the chief engineer.</p></div>
</td></tr></table><div class="footer"><p>&copy; Daily Bugle. All rights reserved.</p></div></body></html>"""
    want = "Bridge reopens after repairs The old bridge over the river reopened on Monday after eleven months of repairs, the council said. Engineers replaced four of its six piers and strengthened the deck. \u201cIt will stand for another century,\u201d said the chief engineer."
    assert he.main_text([markup], he.trained()) == [want]
