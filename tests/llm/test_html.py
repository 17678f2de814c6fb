"""HTML extraction: the parser on fixed pages, the template against a plain reading of the method."""

import random
import re
import time
from collections import Counter, defaultdict
from html import unescape

import pytest
from pyspark.sql import functions as F

from findloom.llm import html

SF = "/root/testdata/sf0.01"


def text_of(page):
    return html.extract(*html.parse(page or "")[:3])


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<body><nav>menu</nav><article><h1>T  itle</h1><p>one<br>two</p><p>three &eacute;</article><footer>f</footer>", "T itle\none two\nthree é"),
        ("<div class='ad'>buy</div><p>text<p>more<script>var x='<p>no</p>'</script><div id=comments>c</div>", "text\nmore"),
        ("<main><p>a<div>b</div>c</main><aside>x</aside>", "a\nb\nc"),
        ("<ul><li>one<li>two</ul><table><tr><td>x<td>y</table>", "one\ntwo\nx\ny"),
        ("<p>a<!-- <p>no --><b>b</b> c", "ab c"),
        ("<title>t</title><style>p{}</style><p>only &lt;this&gt;", "only <this>"),
        ("<article><p>cut off <a href='x", "cut off"),
        # Attributes are told from values, and a name has to be of words that name something.
        ("<div style='overflow:hidden'><article><p>kept</article></div>", "kept"),
        ("<article><p>a <a href='/hidden-gems' title=\"the hidden cave\">link</a> b</article>", "a link b"),
        ("<p>a <a href=\"/x?id=search\">b</a> <i data-id='ad' data-class=share>c</i>", "a b c"),
        ("<article><section id='related-work'><h2 id=search>Search</h2><p>text</p></section></article>", "Search\ntext"),
        ("<p>a<b hidden>no</b><b HIDDEN=''>no</b><b aria-hidden='true'>no</b><b aria-hidden=false>b</b>", "ab"),
        ("<div title='>' id='ad'>no</div><p>yes", "yes"),
        ("<div class='search-results'><p>yes</div><p class=price-alert>too</p><div class='comment-list'>no</div>", "yes\ntoo"),
        # Reader comments and adverts in an article go, and so does a comment's own article.
        ("<article><p>a</p><div id='comments'>no</div><div class='ad-slot'>no</div><div class=share>s</div></article>", "a\ns"),
        ("<article><p>a</article><article class=comment>no</article>", "a"),
        # The page's header goes, an article's own stays.
        ("<header>site</header><article><header><h1>Head</h1></header><p>a</article>", "Head\na"),
        # Raw elements end whatever their case, and no letter shifts the place.
        ("<body><p>one</p><Script>x</sCript><p>two</p><IFRAME>no</IFRAME>three", "one\ntwo\nthree"),
        ("İ" * 30 + "<script>x</SCRIPT><p>after", "İ" * 30 + "\nafter"),
        ("<p>one<script>never closed", "one"),
    ],
)
def test_pages(page, text):
    assert text_of(page) == text


def test_depth_costs_no_square():
    page = "<div>" * 30_000 + "x" + "<p>y" * 30_000
    began = time.time()
    assert text_of(page).startswith("x\ny\ny")
    assert time.time() - began < 10


def frame_of(i, notice="Share this"):
    return f"<body><div><span>Our site</span><p>Contact us here</p></div><div><h1>title {i}</h1><p>first text {i}</p><p>{notice}</p><p>more words {i * 7}</p></div><p>Made by us</p></body>"


def test_a_template_leaves_the_slots(spark):
    pages = [(i, f"http://a.example/{i}", frame_of(i)) for i in range(8)]
    pages += [(100, "http://b.example/1", frame_of(100)), (101, None, None), (102, "http://a.example/x", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.main_text(df).collect()}
    assert all(got[i] == f"title {i}\nfirst text {i}\nmore words {i * 7}" for i in range(8))
    assert got[100] == "Our site\nContact us here\ntitle 100\nfirst text 100\nShare this\nmore words 700\nMade by us"
    assert got[101] == got[102] == ""


def test_copies_of_an_article_are_no_template(spark):
    frame = "<body><p>{}</p><article><p>{}</p><p>a longer passage that all copies show</p></article></body>"
    pages = [(i, f"http://a.example/{i}", frame.format(i, "the same")) for i in range(40)]
    got = html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {"the same\na longer passage that all copies show"} and len(got) == 40


def test_names_in_an_article_drop_what_the_template_holds(spark):
    frame = "<body><p>Our site</p><article><p>{}</p><div class='share'>{}</div><section id='related-work'>{}</section></article><p>Made by us</p></body>"
    pages = [(i, f"http://a.example/{i}", frame.format(f"text {i} and more", f"s{i}", f"work {i}")) for i in range(8)]
    got = html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: f"text {i} and more\nwork {i}" for i in range(8)}


def article_of(page):
    """What stands in the one article of a page of the test tables."""
    inside = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1].replace("<br>", " ")
    parts = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", inside)]
    return "\n".join(x for x in parts if x)


def without_names(page):
    """The page with nothing to tell its parts by but their places."""
    page = re.sub(r"<(/?)(article|nav|footer)>", r"<\1div>", page)
    return page.replace(' class="ad"', "")


def test_the_template_alone_finds_the_article(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    hosts = Counter(re.match(r".*?://([^/?#]*)", p["url"])[1].lower() for p in pages)
    blind = spark.createDataFrame([(p["page_id"], p["url"], without_names(p["html"])) for p in pages], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.main_text(blind).collect()}
    many = [p for p in pages if hosts[re.match(r".*?://([^/?#]*)", p["url"])[1].lower()] >= 6]
    assert len(many) > 100 and all(got[p["page_id"]] == article_of(p["html"]) for p in many)
    # With the template withheld, none of these pages comes out right.
    assert not any(text_of(without_names(p["html"])) == article_of(p["html"]) for p in many)


def plain_classes(parsed):
    """Equivalence classes by full occurrence vectors, one page after another."""
    counts = [Counter(c for c in codes if c) for codes, *_ in parsed]
    by_vector = defaultdict(set)
    for token in set().union(*counts):
        vector = tuple(c[token] for c in counts)
        if sum(n > 0 for n in vector) >= html.SUPPORT * len(parsed):
            by_vector[vector].add(token)
    return [tokens for tokens in by_vector.values() if len(tokens) >= 2]


def plain_order(codes, tokens):
    seq = [c for c in codes if c in tokens]
    n = len(tokens)
    turns = {tuple(seq[i : i + n]) for i in range(0, len(seq), n)}
    return turns.pop() if len(turns) == 1 and len(seq) % n == 0 and set(seq[:n]) == tokens else None


def plain_place(codes, tokens, others):
    """The (class, gap) that all occurrences of a class stand in, or None."""
    at = [i for i, c in enumerate(codes) if c in tokens]
    places = set()
    for k in range(0, len(at), len(tokens)):
        mine = at[k : k + len(tokens)]
        inner = (0, 0)
        width = len(codes) + 1
        for number, other in others:
            theirs = [i for i, c in enumerate(codes) if c in other]
            for j in range(0, len(theirs), len(other)):
                occurrence = theirs[j : j + len(other)]
                gaps = {sum(i < m for i in occurrence) for m in mine}
                if gaps <= {0, len(other)} and len(gaps) == 1:
                    continue
                if len(gaps) > 1 and not all(occurrence[0] < m < occurrence[-1] for m in mine):
                    if mine[0] > occurrence[0]:
                        return None  # it begins within the other and ends beyond
                    continue
                if len(gaps) > 1:
                    return None
                if occurrence[-1] - occurrence[0] < width:
                    width, inner = occurrence[-1] - occurrence[0], (number, gaps.pop() - 1)
        places.add(inner)
    return places.pop() if len(places) == 1 else None


def test_classes_order_and_nesting_against_a_plain_reading(spark):
    rng = random.Random(3)
    pages = []
    for i in range(200):
        items = "".join(f"<li><a>n{rng.randrange(9)}</a><b>x</b></li>" for _ in range(rng.randint(1, 4)))
        body = "".join(f"<p>t{rng.randrange(10**6)}</p>" for _ in range(rng.randint(1, 5)))
        swapped = ["<i>one</i>", "<u>two</u>"]
        rng.shuffle(swapped)
        extra = "<div class=x>only</div>" if rng.random() < 0.8 else ""
        pages.append(f"<body><ul>{items}</ul>{extra}<div class=m><h1>h{i}</h1>{body}</div>{''.join(swapped)}<em>{rng.randrange(99)}</em></body>")
    df = spark.createDataFrame([(i, "http://h/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    keyed = df.select(F.col("page_id").alias("row_key"), "page_id", "url", F.lit("h").alias("host"), "html").repartition(3)
    parsed_df = keyed.mapInArrow(html._parsed_rows, html._PARSED)
    (row,) = html.classes(parsed_df).collect()
    found = defaultdict(set)
    for t in row["tokens"]:
        found[t["class"]].add(t["token"])
    parsed = [html.parse(p) for p in pages]
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, plain_classes(parsed)))
    class_of = {t: c for c, tokens in found.items() for t in tokens}
    need = Counter(class_of.values())
    ordered = Counter()
    for codes, marks, texts, _ in parsed:
        facts = list(html._layout(codes, marks, [len(t.strip()) for t in texts], class_of, need))
        told = {f[1]: f[2] for f in facts if f[0] == "order"}
        whole = {c: plain_order(codes, tokens) for c, tokens in found.items() if c in told}
        assert {c for c, o in told.items() if o} == {c for c, o in whole.items() if o}
        ordered.update(c for c, o in whole.items() if o)
        others = {c: tokens for c, tokens in found.items() if whole.get(c)}
        for kind, c, parent, gap, *_ in facts:
            if kind == "nest":
                place = plain_place(codes, found[c], [(o, t) for o, t in others.items() if o != c])
                assert (place is None and parent == -1) or place == (parent, gap)
    assert len(ordered) >= 4
