import html
import random
import re
import time
import tracemalloc

import pytest

from clicktide.llm import html_tree, wrappers
from clicktide.llm.html_tree import Matching, parse


def plain_match(a, b):
    """The size of the simple tree matching, written out."""
    if a.label != b.label:
        return 0
    table = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids, 1):
        for j, y in enumerate(b.kids, 1):
            table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + plain_match(x, y))
    return table[-1][-1] + 1


def made_up(seed, depth=3):
    draw = random.Random(seed)

    def part(depth):
        tag = draw.choice(["div", "ul", "b", "i"])
        inside = "".join(part(depth - 1) for _ in range(draw.randint(0, 4))) if depth else "text"
        return f"<{tag}>{inside}</{tag}>"

    return "<body>" + "".join(part(depth) for _ in range(4)) + "</body>"


@pytest.mark.parametrize("seed", range(60))
def test_matching_like_plain(seed):
    a, b = parse(made_up(seed)), parse(made_up(seed + 1000))
    matching = Matching(a, b)
    assert matching.size(a, b) == plain_match(a, b) == len(list(matching.pairs()))


def test_matching_of_long_lists(monkeypatch):
    a = parse("<ul>" + "<li>x</li><p>y</p>" * 300 + "</ul>")
    b = parse("<ul>" + "<li>x</li>" * 300 + "<p>z</p></ul>")
    full = Matching(a, b).size(a, b)
    monkeypatch.setattr(html_tree, "FULL_PAIRS", 10)
    assert Matching(a, b).size(a, b) == full


def page(title, paragraphs, menu="Home", slogan="Best site", extra=""):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (
        f"<html><head><title>{title}</title></head><body><div class='x1'>{menu}</div>"
        f"<div class='x2'><h1>{title}</h1><span>{slogan}</span>{body}</div>"
        f"<div class='x3'>All rights reserved{extra}</div></body></html>"
    )


def test_constant_texts_are_the_template():
    pages = [page(f"Title {at}", [f"First {at}", f"Second {at * 7}"][: 1 + at % 2]) for at in range(12)]
    texts = wrappers.extract_site([parse(p) for p in pages])
    for at, text in enumerate(texts):
        expected = [f"Title {at}", f"First {at}", f"Second {at * 7}"][: 2 + at % 2]
        assert text == "\n\n".join(expected)


def test_copies_have_no_vote():
    """Most pages of the host are copies of one article, which stays."""
    same = page("One title", ["One article", "of two paragraphs"], slogan="", menu="")
    others = [page(f"Other {at}", [f"Text {at}"], slogan="", menu="") for at in range(3)]
    texts = wrappers.extract_site([parse(p) for p in [same] * 20 + others])
    assert set(texts[:20]) == {"One title\n\nOne article\n\nof two paragraphs"}


def test_near_copies_have_no_vote():
    article = [f"Paragraph {at} of an article that is rather long: " + "more words " * 9 for at in range(8)]
    changed = [[*article[:at], f"Changed {at}", *article[at + 1 :]] for at in range(8)]
    pages = [page(f"T{at}", own, slogan="", menu="") for at, own in enumerate(changed)]
    for at, text in enumerate(wrappers.extract_site([parse(p) for p in pages])):
        assert text.count("Paragraph") == 7 and f"Changed {at}" in text


MARKED = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style></head><body>
<header>Site name</header><nav><ul><li>Home</li></ul></nav><div class="cookie-notice">We use</div>
<article><h1>Head&amp;line &eacute;</h1><!-- a comment --><p><b>Bold   text<br>after&nbsp;break.<p>Two
lines</p><aside>Aside</aside><form><input>Send</form><script>var t="</p>";</script>
<p>1 &lt; 2 &amp; 3 > 2</p><div id="comments"><p>Nice!</p></div><div class="ad">Buy</div></article>
<div class="sidebar">Side</div><footer>&copy; Foot</footer></body></html>"""


def test_marked_article():
    assert wrappers.extract_site([parse(MARKED)]) == [
        "Head&line é\n\nBold text after break.\n\nTwo lines\n\n1 < 2 & 3 > 2"
    ]


@pytest.mark.parametrize(
    "text, expected",
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        ("a < b and c <", "a < b and c <"),
        ("<p>one<p>two", "one\n\ntwo"),
        ("<p title='never closed>one</p><p>two</p>", "one\n\ntwo"),
        ("<script>only()", ""),
        ("<!-- never closed", ""),
        ("<article></article><p>out</p>", "out"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"),
        ("<p>a<em>b</em> c</p>", "ab c"),
        ("<p>a</p>\n<p hidden>b</p>", "a"),
        ("</p></div>x", "x"),
    ],
)
def test_odd_pages(text, expected):
    assert wrappers.extract_site([parse(text)]) == [expected]


def test_deep_and_long_pages():
    deep = "<div>" * 50_000 + "text" + "</div>" * 50_000
    assert wrappers.extract_site([parse(deep)] * 5) == ["text"] * 5
    long = "<article>" + "".join(f"<p>word {at}</p>" for at in range(20_000)) + "</article>"
    texts = wrappers.extract_site([parse(long), parse(long.replace("word 7<", "other<"))] * 2)
    assert texts[0].count("\n\n") == 19_999


def naive(page):
    """The article of the test pages, which mark it."""
    inside = re.search(r"<article>(.*?)(</article>|<footer>|$)", page, re.DOTALL).group(1)
    blocks = re.split(r"</?(?:p|h1)>", inside)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", block)).split()) for block in blocks]
    return "\n\n".join(text for text in texts if text)


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {row["page_id"]: row for row in wrappers.main_texts(pages).collect()}
    assert len(found) == pages.count()
    for row in pages.collect():
        mine = found[row["page_id"]]
        assert (mine["url"], mine["text"]) == (row["url"], naive(row["html"]))
        assert mine["n_chars"] == len(mine["text"])


def test_large_host_and_edge_rows(spark):
    rows = [(at, f"http://big.example/{at}", page(f"T{at}", [f"P{at}"]), "t") for at in range(300)]
    rows += [(400, None, "<p>x</p>", "t"), (401, "http://one.example/", None, "t")]
    rows += [(None, "http://two.example/", "<p>y</p>", None)] * 2
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = sorted(map(tuple, wrappers.main_texts(frame).collect()), key=repr)
    assert found == sorted(
        [(at, f"http://big.example/{at}", f"T{at}\n\nP{at}", len(f"T{at}P{at}") + 2) for at in range(300)]
        + [(400, None, "x", 1), (401, "http://one.example/", "", 0)]
        + [(None, "http://two.example/", "y", 1)] * 2,
        key=repr,
    )
    assert wrappers.main_texts(frame.where("false")).collect() == []


def test_deep_nesting_keeps_its_article():
    inside = "<div>" * 250 + "deep<nav>Menu</nav><div class='ad'>Buy</div>" + "</div>" * 250
    deep = f"<div><article><p>first</p>{inside}<p>rest</p></article></div><p>outside</p>"
    assert wrappers.extract_site([parse(deep)]) == ["first\n\ndeep\n\nrest"]


def test_deep_pages_of_unequal_shapes():
    def deep(tag):
        return parse("<div>" * 5_000 + f"<{tag}>x</{tag}>" + "</div>" * 5_000)

    a, b = deep("b"), deep("i")
    assert Matching(a, b).size(a, b) == 5_001 == len(list(Matching(a, b).pairs()))


def test_one_title_on_all_pages():
    pages = [
        f"<html><head><title>Untitled</title></head><body><div>Home News Shop</div>"
        f"<div><p>{f'Article {at} has its own words. ' * (4 + at % 3)}</p><p>More {at}</p></div>"
        f"<div>All rights reserved</div></body></html>"
        for at in range(64)
    ]
    for at, text in enumerate(wrappers.extract_site([parse(p) for p in pages])):
        article = " ".join((f"Article {at} has its own words. " * (4 + at % 3)).split())
        assert text == f"{article}\n\nMore {at}"


def mixed_list(seed, length, ends="b"):
    """A list of items of five shapes, with one at both ends that others needn't have."""
    draw = random.Random(seed)
    kinds = ["<li>x</li>", "<li><b>x</b></li>", "<li><b>x</b><i>y</i><u></u></li>", "<p>y</p>"]
    kinds.append("<li><i>x</i><b>y</b><b>z</b></li>")
    inside = "".join(draw.choice(kinds) for _ in range(length))
    return parse(f"<ul><{ends}>x</{ends}>{inside}<{ends}>x</{ends}></ul>")


@pytest.mark.parametrize("full", [None, 500])
def test_long_mixed_lists_like_plain(monkeypatch, full):
    a, b = mixed_list(1, 260), mixed_list(2, 240, "i")
    whole = [(id(x), id(y)) for x, y in Matching(a, b).pairs()]
    if full:
        monkeypatch.setattr(html_tree, "FULL_PAIRS", full)
    matching = Matching(a, b)
    assert matching.size(a, b) == plain_match(a, b)
    assert [(id(x), id(y)) for x, y in matching.pairs()] == whole
    assert len(whole) == plain_match(a, b)


def test_long_lists_take_little_memory():
    a, b = mixed_list(3, 4_000), mixed_list(4, 4_000, "i")
    tracemalloc.start()
    found = len(list(Matching(a, b).pairs()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == Matching(a, b).size(a, b) and peak < 50_000_000


def written(node, raw=False):
    """A tree as markup in which elements that mark anything are plain divisions without classes."""
    if node.tag == html_tree.TEXT:
        return node.text if raw else html.escape(node.text)
    kept = node.tag in ("html", "head", "title", "script", "style", "body", "br", "meta")
    tag = node.tag if kept else "div"
    inside = "".join(written(kid, tag in ("script", "style")) for kid in node.kids)
    if node.tag == "#page":
        return inside
    return f"<{tag}>" if tag in ("br", "meta") else f"<{tag}>{inside}</{tag}>"


def renamed(page):
    """The page's own markup, unclosed tags included, with divisions without classes throughout."""
    kept = ("html", "head", "title", "script", "style", "body", "br", "meta")

    def plain(tag):
        return tag.group(0) if tag.group(2).lower() in kept else f"<{tag.group(1)}div>"

    return re.sub(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>", plain, page)


@pytest.mark.parametrize("neutral", [renamed, lambda page: written(parse(page))], ids=["raw", "tree"])
def test_slots_are_found_without_names(spark, neutral):
    """The whole table with nothing but divisions gives the same texts (blocks aside)."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()
    hosts = {}
    for row in pages:
        hosts.setdefault(row["url"].split("/")[2].lower(), []).append(row["html"])
    same = total = 0
    for own in hosts.values():
        if len(own) > wrappers.MIN_VOTES:
            marked = wrappers.extract_site([parse(p) for p in own])
            plain = wrappers.extract_site([parse(neutral(p)) for p in own])
            same += sum("".join(a.split()) == "".join(b.split()) for a, b in zip(marked, plain))
            total += len(own)
    assert total > 2_000 and same >= 0.95 * total


def varied(at, extra=""):
    """A page whose menu, advert and footer vary in text, and nothing has a name."""
    menu = "".join(f"<div>Item {at * 7 + n}</div>" for n in range(3 + at % 4))
    advert = f"<div>Buy number {at} now</div>" if at % 3 else ""
    body = "".join(f"<div>Paragraph {n} of {at}: {'words of it ' * (5 + (at + n) % 9)}</div>" for n in range(2 + at % 5))
    return (
        f"<html><head><title>Headline number {at}</title></head><body><div>{menu}</div>{advert}"
        f"<div><div>Headline number {at}</div><div>{body}</div></div>"
        f"<div>Footer {at * 31}</div>{extra}</body></html>"
    )


def test_varying_menus_and_footers_are_left_out():
    for count in (8, 60):
        texts = wrappers.extract_site([parse(varied(at)) for at in range(count)])
        for at, text in enumerate(texts):
            lines = text.split("\n\n")
            assert lines[0] == f"Headline number {at}" and len(lines) == 3 + at % 5
            assert all(line.startswith("Paragraph") for line in lines[1:])


def test_closings_begin_alike_and_go_on_differently():
    def site(closing, count=12):
        pages = [varied(at).replace("</body>", "") for at in range(count)]
        # The footer stands inside the article's division, as a tag is never closed.
        return [parse(p.replace("</div></div><div>Footer", f"</div><div>{closing(at)}</div></div><div>Footer"))
                for at, p in enumerate(pages)]

    texts = wrappers.extract_site(site(lambda at: f"© example.com number {at}"))
    assert not any("example.com" in text for text in texts)
    # Copies of one article, with changes, keep their last paragraph.
    pages = [f"<title>One</title><div><div>One</div><div>Text {'of it ' * 20}</div>"
             f"<div>The end of it {at % 4}</div></div>" for at in range(12)]  # fmt: skip
    assert all("The end of it" in text for text in wrappers.extract_site([parse(p) for p in pages]))


def test_names_are_whole_names():
    words = "<p>" + "long text of the article " * 9 + "</p>"
    kept = " ".join(("long text of the article " * 9).split())
    for name in ("page has-sidebar", "no-comments", "widget-area-wrapper", "sidebar", "comments"):
        page = f"<div class='{name}'><article>{words}<div class='notice-period'><p>a</p></div>" \
            "<div id='ad-hoc'><p>b</p></div><div class='ad-box'><p>c</p></div></article></div>"  # fmt: skip
        assert wrappers.extract_site([parse(page)]) == [f"{kept}\n\na\n\nb"]


def test_all_articles_are_kept():
    page = (
        "<p>out</p><article><p>one</p></article><div><article><p>two is longer</p>"
        "<article class='comment'><p>Nice!</p></article></article></div>"
        "<article><a href='/x'>A teaser</a></article><article><p>three</p></article>"
    )
    assert wrappers.extract_site([parse(page)]) == ["one\n\ntwo is longer\n\nthree"]
    mains = "<main><p>a</p></main><nav>n</nav><main><p>b</p></main><article>c</article>"
    assert wrappers.extract_site([parse(mains)]) == ["a\n\nb"]


@pytest.mark.parametrize(
    "piece", ["<a ", '<a "', "<!-- x", "</", "<a '\"", "<script>", '<x "a" ', "<b>", "<a href='>"]
)
def test_pages_that_never_close_take_linear_time(piece):
    page = piece * (1_000_000 // len(piece))
    start = time.perf_counter()
    parse(page)
    assert time.perf_counter() - start < 5
