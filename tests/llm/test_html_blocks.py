import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import rows
from tidemark.llm import html_blocks as B
from tidemark.llm import queries

PAGES = {
    "divisions": (
        """<html><body><div id="top-menu"><a href=/>Home</a> <a href=/n>News</a></div><div class="cookie-banner">We use cookies. <button>OK</button></div>
        <div id="content"><h1>Rivers rise</h1><p>The river rose by two metres overnight, officials said.</p><p>Schools stay closed until <b>Friday</b>.</p><ul><li>Take warm clothes.</li><li>Stay inside.</li></ul></div>
        <div class="comments"><h3>Comments</h3><div class="comment"><p>I saw the water come up to our street last night.</p></div><div class="comment"><p>Stay safe everyone, it is very bad here.</p></div></div>
        <div id="footer">&copy; 2024 River Times</div></body></html>""",
        "Rivers rise\nThe river rose by two metres overnight, officials said.\nSchools stay closed until Friday.\nTake warm clothes.\nStay inside.",
    ),
    "landmarks with parts inside": (
        """<!doctype html><html><head><title>T</title><style>x</style></head><body class="home"><header class="site-header"><a href="/">The Paper</a></header><nav><a href=a>A</a></nav>
        <main><article><header><h1>Bread &amp; butter</h1></header><p>Bakers raise prices&nbsp;again.</p><aside class="related"><h4>Related</h4><a href=x>Milk prices fall</a></aside><p>Flour costs twice as much as last year.</p><div class="ad-slot">Buy cheap flour today</div><p>More rises may follow.</p></article>
        <section id="comments"><article class="comment"><p>Too expensive for families like mine.</p></article></section></main>
        <aside class="sidebar"><h3>Most read</h3><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></aside>
        <form action=/s><label>Search</label><input name=q><button>Go</button></form><footer><p>Imprint</p><p>Privacy</p></footer><script>var a="<p>no</p>";</script></body></html>""",
        "Bread & butter\nBakers raise prices again.\nFlour costs twice as much as last year.\nMore rises may follow.",
    ),
    "unclosed elements": (
        """<body><div class="wrapper"><div class="header"><h2>My blog</h2></div><ul class="nav"><li><a href=1>Home</a><li><a href=2>About</a></ul><div class="newsletter-popup"><p>Subscribe to our newsletter for weekly updates.</p></div>
        <div class="post"><h1 class="entry-title">On walking</h1><div class="entry-content"><p>I walk every day, and I walk for hours.<p>It clears the head.<blockquote>Walk on.</blockquote><p>That is all.</div><div class="share-buttons">Share this: <a href=t>Tweet</a></div></div>
        <div class="sidebar"><h3>Categories</h3><a href=c>Walking</a></div><ol class="commentlist"><li>anna: I walk too, every morning before work starts.</li></ol><div class="footer">Copyright 2020</div></div>""",
        "On walking\nI walk every day, and I walk for hours.\nIt clears the head.\nWalk on.\nThat is all.",
    ),
    "tables": (
        """<table><tr><td class="menu"><a href=1>Start</a><br><a href=2>Map</a></td><td class="content"><h1>Old towns</h1><p>Old towns have narrow streets.</p><p>Their walls still stand, mostly.</p></td><td class="right-sidebar"><p>Sponsored: hotels near you</p></td></tr></table>""",
        "Old towns\nOld towns have narrow streets.\nTheir walls still stand, mostly.",
    ),
}


def landmarks(page):
    """The truth on pages with landmarks, by the definition itself."""
    page = B.blocks(page)
    return B.main_text(page, B.taught(page))


@pytest.fixture(scope="module")
def weights(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    return B.trained(pages, B.Labeller())


def told(page, w):
    page = B.blocks(page)
    return B.main_text(page, B.labelled([B.features(page, B.Labeller(), {})], w)[0])


def test_query_equals_landmarks(spark, sf):
    got = {r["page_id"]: r for r in rows(queries.op12_block_lstm(spark, sf))}
    pages = rows(spark.read.parquet(f"{sf}/pages.parquet"))
    assert len(got) == len(pages)
    for p in pages:
        r = got[p["page_id"]]
        assert (r["url"], r["text"], r["n_chars"]) == (p["url"], landmarks(p["html"]), len(landmarks(p["html"])))


def test_pages_never_seen(spark, weights):
    """Trained on 240 of 250 pages of one table, held against all 2,500 of another."""
    pages = [r["html"] for r in rows(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"))]
    cut = [B.blocks(p) for p in pages]
    got = B.labelled([B.features(b, B.Labeller(), {}) for b in cut], weights)
    assert sum(B.main_text(b, y) != B.main_text(b, B.taught(b)) for b, y in zip(cut, got, strict=True)) <= 2


@pytest.mark.parametrize("name", PAGES)
def test_layouts_written_by_hand(name, weights):
    page, text = PAGES[name]
    assert told(page, weights) == text


def test_context_decides(weights):
    """The same block, between paragraphs of an article and in a list of comments without a name of its own."""
    rng = np.random.default_rng(4)
    wrong = total = 0
    for _ in range(200):
        page, label = B.laid_out([B._pseudo(rng, 12) for _ in range(6)], [B._pseudo(rng, 3) for _ in range(6)], rng)
        got = B.labelled([B.features(page, B.Labeller(), {})], weights)[0] > 0.5
        wrong, total = wrong + (got != label).sum(), total + len(label)
    assert wrong < 0.02 * total


@pytest.mark.parametrize(
    "page,want",
    [
        ("", []),
        ("plain", ["plain"]),
        ("<p>a &lt; b &amp c &#233; &am", ["a < b & c é &am"]),
        ("a<!-- x > y -->b", ["ab"]),
        ("<p>one\n\t two<br>three<p>four", ["one two three", "four"]),
        ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]),
        ("<script>if (a<b) '</p>'</script><style>p{}</style><p>t", ["t"]),
        ('<a title="a>b">l</a> m', ["l m"]),
        ("1 < 2 and <3 </ x> y", ["1 < 2 and <3 y"]),
        ('<p title="x>kept</p><p>and more', ["kept", "and more"]),
        ("text <p", ["text"]),
        ("<title>no<p>no", []),
        ("<svg/><p>yes", ["yes"]),
    ],
)
def test_blocks(page, want):
    assert [b.text for b in B.blocks(page)] == want


@pytest.mark.parametrize("page", ["<" * 300_000, "<a " * 300_000, '<a ">' * 100_000, "<div>" * 20_000 + "x", "<p>x " * 50_000])
def test_hostile_pages_end(page):
    B.blocks(page)


def test_network_learns_by_its_gradient():
    """The way back through both directions against differences of the loss."""
    how = B.Labeller(path_buckets=16, word_buckets=8, width=4, hidden=3)
    page = [B.Block(("p",), "a b"), B.Block(("div ad",), "c"), B.Block(("p",), "d a e.")]
    f, y = B.features(page, how, {}), np.array([1.0, 0.0, 1.0])
    w = B.started(how)

    def loss(w):
        p = B.labelled([f], w)[0]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    x, lengths = B._padded([B._inputs(f, w)])
    out, kept = B._lstm(x, w, "ahead", keep=True)
    back, _ = B._lstm(B._flipped(x, lengths), w, "back")
    top = np.concatenate([out, B._flipped(back, lengths), x], 2)
    dz = (B._sigmoid(top @ w["out"] + w["out_b"]) - y) / 3
    grad = {}
    B._lstm_back(x, w, "ahead", kept, dz[:, :, None] * w["out"][:3], grad)
    for name in ("ahead_x", "ahead_h", "ahead_b"):
        at = np.unravel_index(np.argmax(np.abs(grad[name])), grad[name].shape)
        w[name][at] += 1e-5
        high = loss(w)
        w[name][at] -= 2e-5
        assert abs((high - loss(w)) / 2e-5 - grad[name][at]) < 1e-6
        w[name][at] += 1e-5


def test_nulls_empties_repeats_and_clashing_names(spark):
    page = PAGES["divisions"][0]
    df = spark.createDataFrame([(1, "u", page), (1, "u", page), (None, None, page), (2, None, None), (3, "", ""), (4, "x", "<nav><a>Home</a></nav>"), (5, "y", "<p>long " * 20_000)], "page_id long, url string, html string")
    out = rows(B.extracted(df.withColumns({"text": F.lit(1), "n_chars": F.lit(2), "h": F.lit(3)})))
    assert len(out) == 7
    by = {r["page_id"]: r for r in out}
    assert {r["text"] for r in out if r["page_id"] in (1, None)} == {PAGES["divisions"][1]}
    assert [by[k]["text"] for k in (2, 3, 4)] == ["", "", ""] and all(r["n_chars"] == len(r["text"]) for r in out)


def test_empty_table(spark):
    assert B.extracted(spark.createDataFrame([], "page_id int, url string, html string")).count() == 0
