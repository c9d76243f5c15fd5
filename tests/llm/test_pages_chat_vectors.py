"""Main text, chat repair and nearest neighbours against brute force."""

import html as entities
import itertools
import random
import re
import time
from html.parser import HTMLParser

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from spindrift.llm import chat, forest, html

from .conftest import DATA

# -- pages


def test_articles_of_the_test_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    found = {r["page_id"]: r for r in html.main_text(pages).collect()}
    for r in pages.collect():
        inner = re.sub("<[^>]+>", " ", re.search(r"<article>(.*?)</article>", r["html"], re.S)[1])
        assert found[r["page_id"]]["text"] == " ".join(entities.unescape(inner).split())
        assert found[r["page_id"]]["n_chars"] == len(found[r["page_id"]]["text"])


PAGE = """<!doctype html><html><head><title>t</title><style>p{}</style></head><body class=home><header><p>Site name and a long slogan that is no news</p></header>
<nav><ul><li><a href=/>Home</a><li><a href=/b>Business and more</a></ul></nav><div class="cookie-notice"><p>We use cookies, as everybody does, for a better experience.</p></div>
<div id=page><div class="post-%d content"><h1>Head&amp;line</h1><p>First   paragraph of the story,<br>with a break &mdash; and more of it.<p>Second <b>bold</b>ness and <a href=x>a link</a>.
<div class="ad-box"><p>Buy now</p></div><script>var x = "<p>no</p>";</script><ul><li>one<li>two</ul><form><p>Your mail <input name=m></p></form><table><tr><td>c1<td>c2</table></div>
<aside><p>Related stories that go on for quite a while and then some more</p></aside><div class=comments><p>Reader: what a nice and very long story this is, I say, and so on, and on</p></div></div>
<footer><p>&copy; 2024</p></footer></body></html>"""
WANT = "Head&line First paragraph of the story, with a break — and more of it. Second boldness and a link. one two c1 c2"


def test_consensus_path(spark):
    rows = [(i, "https://www.Host.example/%d?x#y" % i, PAGE % i) for i in range(5)]
    rows += [(9, "http://host2.example/", None), (10, None, ""), (11, "http://www.host.example/z", "<div class='post-9 content'>only text"), (11, "http://www.host.example/z", "<div class='post-9 content'>only text")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "1 AS text", "2 AS paths")
    found = html.main_text(df).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["text"] == (WANT if r["page_id"] < 5 else "only text" if r["page_id"] == 11 else "")
    assert html.main_text(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/!-='\" pdivabclr&;#x1\n", max_size=200))
def test_any_markup_is_read(page):
    html.vote(page)
    text = html.extract(page, [">div"])
    assert text == " ".join(text.split())


def test_deep_and_long_pages():
    assert html.extract("<div>" * 5000 + "deep" + "</div>" * 5000, None) == "deep"
    assert len(html.extract("<article>" + "<p>word word</p>" * 50_000, None).split()) == 100_000


@pytest.mark.parametrize("depth", [5, 600, 5000])
def test_text_after_deep_elements(depth):
    inner = "<div>" * depth + "<nav><p>deep menu</p></nav><ul><li class=ad>deep advert<li>deep</ul>" + "</div>" * depth
    page = f"<body><div><article><p>first</p>{inner}<p>last words of the story</p></article><p>outside</p></div></body>"
    assert html.extract(page, None) == "first deep last words of the story"
    assert html.extract("<div>" * depth + f"<article>{'<p>word</p>' * 9}</article><p>x</p>" + "</div>" * depth, None) == " ".join(["word"] * 9)


@pytest.mark.parametrize("part", ["</b>", "<tr>", "<option>", "<hr>", "<li>", "<p>"])
def test_deep_pages_take_linear_time(part):
    began = time.process_time()
    html.extract("<b><table><tr>" + "<div>" * 50_000 + part * 50_000, None)
    assert time.process_time() - began < 10


@pytest.mark.parametrize("n", [65_000, 70_000, 1_000_000])
@pytest.mark.parametrize("quote", "\"'")
def test_long_attributes(n, quote):
    value = quote + "data:image/png;base64," + "A<b>" * (n // 4) + quote
    page = f"<nav data-x={value}><p>menu</p></nav><article data-y={value}><p>Before <img src={value} alt=x> and after.</p></article><p>end</p>"
    assert html.extract(page, None) == "Before and after."
    assert html.vote(page)[0] == ">article"


@pytest.mark.parametrize("part", ["<a \"", "<a '\"", "<a \"x", "<a href='", "<a\"'", "<a '\"' \"'"])
def test_unclosed_quotes_take_linear_time(part):
    began = time.process_time()
    html.parse(part * 100_000)
    assert time.process_time() - began < 10


BODY = "<body><nav><p>menu home about and more</p></nav><div class=page>%s</div><footer>foot</footer></body>"
LINES = "<p>The first paragraph of the page.</p><p>And the second one.</p>"
PLAIN = "The first paragraph of the page. And the second one."


@pytest.mark.parametrize(
    "inner, want",
    [
        (LINES, PLAIN),
        ('<img src="data:image/png;base64,' + "A" * 70_000 + '">' + LINES, PLAIN),  # a long attribute
        ("\u0130" * 300 + " <script>var a = 1;</script>" + LINES, "\u0130" * 300 + " " + PLAIN),  # lower case is longer
        ('<script src=/a/b/>alert("leak")</script>' + LINES, PLAIN),  # does not close itself
        ("<svg viewBox='0 0 1 1'/>" + LINES + "<svg><text>drawn</text></svg>", PLAIN),
        ("<p><a title=it's>A link</a> first.</p>" + LINES, "A link first. " + PLAIN),  # an apostrophe in a bare value
        ("<p title = 'a > b' data-x=\"c > d\">Values hold signs.</p>" + LINES, "Values hold signs. " + PLAIN),
        ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p>" + LINES, "Let x=2 be. " + PLAIN),
        ("<xmp><b>shown &amp; as is</b></xmp>" + LINES, "<b>shown &amp; as is</b> " + PLAIN),
        ('<p class="social-science">Of society.</p><p class="form">Of form.</p>' + LINES, "Of society. Of form. " + PLAIN),
        ('<div class="content-header"><h1>The title</h1></div>' + LINES, "The title " + PLAIN),
        ('<div class="social-share"><p>Like it</p></div><div class="post-comments"><p>Reader: fine</p></div>' + LINES + "<p class=ad>Buy</p>", PLAIN),
        ('<div class="cookie-notice"><p>Cookies</p></div><div id="sidebar-left"><p>Aside</p></div><div class="page-header"><p>Site</p></div>' + LINES, PLAIN),
        ("<textarea>typed</textarea><STYLE>p{}</STYLE><Script>x</sCript >" + LINES, PLAIN),
        ("<p>1 < 2 and a <b>bold</b> one, 3 > 2.</p>" + LINES, "1 < 2 and a bold one, 3 > 2. " + PLAIN),
        ("<!-- <p>no</p> -->" + LINES + "<!-- to the end", PLAIN),
    ],
)
def test_ordinary_markup(inner, want):
    assert html.extract(BODY % inner, None) == want
    path = html.vote(BODY % inner)[0]
    assert path == ">body>div.page" and html.extract(BODY % inner, [path]) == want


@pytest.mark.parametrize("cut", ['<div class="cut off', "<div class='a>b", "<a href=x", "</di", "<!-- cut", "<!doctype"])
def test_pages_cut_off_inside_a_tag(cut):
    assert html.extract(f"<body><div>{LINES}{cut}", None) == PLAIN


@pytest.mark.parametrize("part", ["<!", "<a x=", "<a x='", '<a x="y" ', "</", "<script/", "<p a = ", "<xmp"])
def test_broken_tags_take_linear_time(part):
    began = time.process_time()
    html.extract(part * 100_000, None)
    assert time.process_time() - began < 10


def test_a_path_with_little_text_does_not_win():
    page = f"<body><div class=note><p>tiny</p></div><div class=main>{LINES * 5}</div></body>"
    assert html.extract(page, [">body>div.note", ">body>div.main"]) == " ".join([PLAIN] * 5)


class Tree(HTMLParser):
    """The text of a marked element by the standard library's parser, without the elements to drop."""

    def __init__(self):
        super().__init__()
        self.inside, self.dropped, self.out = 0, 0, []

    def handle_starttag(self, tag, attrs):
        names = dict(attrs)
        self.dropped += bool(self.dropped) or tag in ("nav", "aside", "form", "script", "footer") or names.get("class") in ("ad", "comments", "cookie-notice")
        self.inside += bool(self.inside) or "data-main" in names
        if tag in html.BLOCKS:
            self.out.append(" ")

    def handle_endtag(self, tag):
        self.dropped -= bool(self.dropped)
        self.inside -= bool(self.inside)
        if tag in html.BLOCKS:
            self.out.append(" ")

    def handle_data(self, data):
        if self.inside and not self.dropped:
            self.out.append(data)


WORDS = st.lists(st.sampled_from("some words of a text &amp; more &lt;of&gt; them é 日本 x.".split()), min_size=8, max_size=30).map(" ".join)
PIECE = st.one_of(
    WORDS.map("<p>{}</p>".format), WORDS.map("<h2>{}</h2>".format), WORDS.map("<ul><li>{0}</li><li>more {0}</li></ul>".format), WORDS.map("<blockquote><p><b>{0}</b> {0}</p></blockquote>".format),
    WORDS.map("<div class='ad'><p>{}</p></div>".format), WORDS.map("<div class='part'><p>{}</p></div>".format), WORDS.map("<script>var s = '{}';</script>".format), WORDS.map("<aside><p>{}</p></aside>".format),
    WORDS.map("<table><tr><td>{0}</td><td>{0}</td></tr></table>".format), WORDS.map("<form><p>{}</p></form>".format),
)


@settings(max_examples=150, deadline=None)
@given(st.lists(PIECE, min_size=1, max_size=6), WORDS, st.lists(WORDS, max_size=2), st.sampled_from(["div", "section", "main"]))
def test_pages_without_an_article(pieces, text, comments, tag):
    long = "".join(f"<p>{text} {text} {k}</p>" for k in range(8))
    main = f"<{tag} class='story' data-main=1>{''.join(pieces)}{long}</{tag}>"
    around = "".join(f"<div class='comments'><p>{c}</p></div>" for c in comments)
    page = f"<html><body><nav><ul><li><a href=/>{text}</a></li></ul></nav><div class='wrap'>{main}{around}</div><footer><p>{text}</p></footer></body></html>"
    tree = Tree()
    tree.feed(page)
    assert html.extract(page, None) == " ".join("".join(tree.out).split())


# -- chat


def brute_cost(roles, costs):
    """The cheapest of all ways to assign states, merges and insertions."""
    best = {0: 0}
    for role in roles:
        step = {}
        for (before, cost), after in itertools.product(best.items(), (1, 2, 3)):
            name = 0 if role == after else costs.relabel_unknown if role is None else costs.relabel
            ways = [costs.merge] if before == after else []
            if (before, after) in chat.BETWEEN:
                ways.append(costs.insert * len(chat.BETWEEN[before, after]))
            for way in ways:
                step[after] = min(step.get(after, 1e9), cost + name + way)
        best = step
    return min(c + costs.end(s) for s, c in best.items())


def legal(rendered):
    roles = re.findall(r"<\|im_start\|>(\w+)\n", rendered)
    assert rendered.count("<|im_start|>") == rendered.count("<|im_end|>")
    body = roles[1:] if roles[:1] == ["system"] else roles
    return "system" not in body and all(r == ("user", "assistant")[k % 2] for k, r in enumerate(body)) and bool(body)


NAMES = ["system", "user", "assistant", "Human ", "gpt", "tool", None]


@pytest.mark.parametrize("partitions", [1, 7])
def test_repair(spark, partitions):
    rng = np.random.default_rng(partitions)
    rows = [(c, t, NAMES[rng.integers(7)], f"c{c}t{t}") for c in range(40) for t in range(rng.integers(1, 9))]
    rows += [(1000, t, NAMES[rng.integers(7)], "x") for t in range(300)] + [(None, 1, "user", None), (None, 1, "user", None), (None, None, "assistant", "a")]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(found) == len(rows)
    by_conv = {}
    for r in found:
        by_conv.setdefault(r["conv_id"], []).append(r)
    for conv, turns in by_conv.items():
        turns.sort(key=lambda r: r["seq"])
        assert [r["seq"] for r in turns] == list(range(len(turns)))
        assert legal("".join(r["rendered"] for r in turns)), conv
        assert sum(r["cost"] for r in turns) == brute_cost([chat.role_of(r["role"]) for r in turns], chat.Costs())


def test_legal_conversations_stay(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (2, 5, "user", "one"), (2, 6, "user", "two")]
    found = {(r["conv_id"], r["turn"]): r for r in chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [found[1, k]["action"] for k in range(3)] == ["keep"] * 3 and found[1, 2]["rendered"].endswith("hello<|im_end|>\n")
    assert found[2, 6]["action"] == "merge" and found[2, 6]["rendered"] == "\ntwo<|im_end|>\n"
    assert chat.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# -- vectors


def brute_nearest(rows, every, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = x @ x[q]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), s[i]) for i in order]
    return out


@pytest.mark.parametrize("blocks", [{}, {"block_rows": 128, "query_rows": 8}, {"share": 0.7}])
def test_recall_and_scores(spark, blocks):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = brute_nearest(rows, 20, 20)
    found = {}
    for r in forest.nearest(df, **blocks).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(found) == set(want)
    vectors = dict(rows)
    for q, near in found.items():
        assert len(near) == len(want[q]) and near == sorted(near, key=lambda x: (-x[1], x[0]))
        assert all(abs(s - np.dot(np.float64(vectors[q]), np.float64(vectors[i]))) < 1e-12 for i, s in near)
    hits = [len({i for i, _ in found[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want]
    assert np.mean(hits) >= 0.9


def test_clustered_vectors_need_few_candidates(spark):
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(150, 32))
    x = np.repeat(centers, 20, axis=0) + 0.15 * rng.normal(size=(3000, 32))
    assert forest.measured_share(x, 10, 32, 0.95) <= 0.1
    assert forest.measured_share(rng.normal(size=(1000, 64)), 20, 32, 0.95) >= 0.5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = brute_nearest([(i, v) for i, v in enumerate(x)], 50, 10)
    found = {}
    for r in forest.nearest(df, every=50, k=10).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(found[q] & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9


def test_forest_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8))
    planes = forest.hyperplanes(8, 4)
    codes = forest.strings(x, np.zeros(400), planes)
    block = forest.Block(np.arange(400), x, codes)
    lo, hi = block.ranges(codes[:5], 3)
    for q in range(5):
        for t in range(4):
            inside = set(block.order[t][lo[q, t] : hi[q, t]].tolist())
            assert inside == set(np.flatnonzero(codes[:, t] >> np.uint64(61) == codes[q, t] >> np.uint64(61)).tolist())
    assert (block.longest(codes[:5]) == 64).all()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [2.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (0, [1.0, 2.0]), (40, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS dim", "'x' AS v", "2 AS rank")
    found = [tuple(r) for r in forest.nearest(df).orderBy("query_id", "rank").collect()]
    assert found == [(0, 1, 20, 4.0), (0, 2, 1, 3.0), (0, 3, 2, 3.0), (20, 1, 0, 4.0), (20, 2, 1, 3.0), (20, 3, 2, 3.0)]
    assert forest.nearest(df.limit(0)).count() == 0


ARTICLE = "A long sentence of the article, which goes on for quite some time. " * 6


@pytest.mark.parametrize(
    "page",
    [
        '<body><div class="content-sidebar-wrap"><main>{}</main></div>', '<div id="page" class="has-sidebar">{}</div>', '<main class="site-main no-sidebar">{}</main>',
        '<div class="wrapper nav-fixed">{}</div>', '<div id="page" class="menu-closed">{}</div>', '<article class="post tag-cookies">{}</article>', '<article class="post comments-open">{}</article>',
        '<form id="aspnetForm"><input type="hidden" value="x"><div>{}</div></form>', "<body><!-->{}", "<body><!--->{}", "<body><!-- x --!>{}", "<body><svg><svg><text>in</text></svg><text>out</text></svg>{}",
        '<div class="page-with-sidebar"><div class="sidebar-inner"><p>Some words beside it.</p></div>{}<div class="blog-comments"><p>' + "A reader writes much. " * 60 + "</p></div></div>",
        '{}<form class="search"><label>Find</label><input></form><div class="cookie-banner"><p>We use cookies. ' + "And more. " * 40 + "</p></div>",
    ],
)
def test_names_do_not_drop_the_article(page):
    assert html.extract(page.format(f"<p>{ARTICLE}</p>"), None) == " ".join(ARTICLE.split())


def test_random_names_on_the_wrapper():
    """Whatever a wrapper's state classes say, the text in it stays, and boxes of nothing but such words go."""
    rng = random.Random(4)
    listed = sorted(html.DROPPED_WORDS)
    for _ in range(200):
        state = f"{rng.choice(['has', 'no', 'with', 'is', 'tag'])}-{rng.choice(listed)}"
        box = f"{rng.choice(listed)}-{rng.choice(sorted(html.PLACE_WORDS))}"
        wrapper = rng.choice(["div", "section", "main", "article"])
        page = f'<body><{wrapper} class="{state}"><p>{ARTICLE}</p><div class="{box}"><p>Not this.</p></div></{wrapper}>'
        assert html.extract(page, None) == " ".join(ARTICLE.split()), page


def test_labels_stay_in_sentences():
    assert html.extract(f"<p>{ARTICLE}Press <label>Enter</label> twice.</p><label for=x>Name</label>", None).endswith("time. Press Enter twice.")
