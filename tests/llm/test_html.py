"""HTML extraction: planted pages with known main text."""

import html
import re

from propensia.llm import html_extract as hx
from propensia.llm.queries import op5_html_extraction

SF001 = "/root/testdata/sf0.001"

PAGE = """<html><head><title>t</title><style>a{}</style></head><body><div id="cookie-notice">We use cookies to make all
of this much better for you.</div><header class="site-header"><h1>Site</h1><form><input name=q><button>Go</button></form></header>
<nav><ul><li><a href=x>Home</a></ul></nav>%s<h1>Title &amp; more</h1><p>First   paragraph with <a href=y>a link</a> in&nbsp;it.
<p>Second one<br>goes on.<aside>Read also this other great article now</aside><div class="ad-box">Buy this now please, very cheap
goods</div><script>if (a<b) "</p>"</script><ul><li>One item here<li>Two items here</ul><blockquote>Quote it</blockquote>%s
<div class="sidebar"><p>Side words are here to distract all of you</p></div><section class="comments"><p>Great article, I really
love it so much, thanks</p></section><footer>&copy; x</footer>"""
TEXT = "Title & more\nFirst paragraph with a link in it.\nSecond one goes on.\nOne item here\nTwo items here\nQuote it"


def by_markup(page: str) -> str:
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|article)>", body)
    clean = (" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in blocks)
    return "\n".join(b for b in clean if b)


def test_query_finds_the_article_of_every_page(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF001}/pages.parquet").collect()}
    rows = op5_html_extraction(spark, SF001).collect()
    assert len(rows) == len(pages)
    assert all(r.text == by_markup(pages[r.page_id]) and r.n_chars == len(r.text) for r in rows)


def test_learned_weights_find_content_without_an_article_element(spark):
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    weights = hx.learn_weights(pages)
    for r in pages.collect():
        hidden = r.html.replace("<article>", "<div>").replace("</article>", "</div>")
        assert hx.extract(hidden, weights) == by_markup(r.html)


def test_unnamed_text_beside_labelled_articles_does_not_empty_pages_without_article(spark):
    words = "some words of the text that stand here and go on for a while"
    labelled = [(i, "u", f"<body><div>Accept all of this {i}</div><article><p>{words}</p><p>{words}</p></article><p>Bare line {i}</p></body>")
                for i in range(50)]
    rows = labelled + [(50, "u", f"<body><div><div>{words}</div><div>{words} {words}</div></div></body>"),
                       (51, "u", f"<body><p>{words}</p><p>{words}</p></body>"),
                       (52, "u", f"<body><main></main><div><p>{words}</p></div></body>")]
    got = {r.page_id: r.text for r in hx.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got.pop(50) == f"{words}\n{words} {words}" and got.pop(51) == f"{words}\n{words}" and got.pop(52) == words
    assert set(got.values()) == {f"{words}\n{words}"}


def test_boilerplate_of_many_kinds_is_left_out():
    weights = hx.weights_of({})
    for opening, closing in (('<div class="content">', "</div>"), ("<main>", "</main>"), ("<article>", "</article>")):
        assert hx.extract(PAGE % (opening, closing), weights) == TEXT


def test_best_run_equals_brute_force():
    weights = {("word", "plain"): 1.0, ("word", "boilerplate"): -6.0, ("tag", "p"): -2.5}
    import random

    rnd = random.Random(2)
    for _ in range(200):
        seen = [hx.Token(("word", "plain"), rnd.randint(0, 4)) if rnd.random() < 0.5 else hx.Token(("tag", "p")) for _ in range(12)]
        score = [t.words if t.key[0] == "word" else -2.5 for t in seen]
        best = max((sum(score[a:b]) for a in range(12) for b in range(a + 1, 13)), default=0)
        a, b = hx.region(seen, weights)
        assert sum(score[a:b]) == max(best, 0)


def test_defined_cases(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p></p>"), (None, "u", "just text &lt; 5 < 6 &amp; more"), (5, "u", "<p>a" + "<b>" * 5000),
            (6, "u", "<article>" + "<p>word here</p>" * 20_000), (6, "u", "<!-- open"), (7, "u", '<p title="a>b">kept words</p>'), (8, "u", "<p>x<script>y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars", "3 AS `a.b`")
    got = {(r.page_id, r.text[:20]): r.n_chars for r in hx.extract_pages(df).collect()}
    assert got == {(1, ""): 0, (2, ""): 0, (3, ""): 0, (None, "just text < 5 < 6 & "): 24, (5, "a"): 1, (6, "word here\nword here\n"): 199_999,
                   (6, ""): 0, (7, "kept words"): 10, (8, "x"): 1}
    assert hx.extract_pages(df.limit(0)).count() == 0


BODY = "<h1>The title</h1><p>%s</p><p>%s</p>" % ("words of the first paragraph go on " * 6, "and of the second one, too " * 6)


def body_text():
    return "\n".join(" ".join(x.split()) for x in re.findall(r">([^<]+)</", BODY))


def test_names_never_empty_an_article(spark):
    trained = hx.learn_weights(spark.read.parquet(f"{SF001}/pages.parquet"))
    side = '<div class="sidebar"><p>Side words here</p></div><footer>&copy; x</footer>'
    for weights in (hx.weights_of({}), trained):
        for opening in ('<div class="page has-sidebar"><article>', '<div id="content" class="no-comments"><article>',
                        '<div class="topic social science"><article>', '<div><article class="post social">',
                        '<div class="with-nav layout"><article>', '<div class="widget"><main>', '<div class="header-fixed page"><article>',
                        '<svg class=a/><div><article>'):
            named = opening.rsplit("<", 1)[1].split(">")[0].split()[0]
            page = f"<body>{opening}{BODY}</{named}></div>{side}<svg><path d='x'/></svg></body>"
            assert hx.extract(page, weights) == body_text(), opening
            hidden = page.replace(f"<{named}", "<div").replace(f"</{named}>", "</div>")
            assert hx.extract(hidden, weights) == body_text(), opening


def test_an_article_of_comments_stays_out():
    page = f"<body><article>{BODY}</article><section id=comments><article><p>Great text, I love it so much</p></article></section></body>"
    assert hx.extract(page, hx.weights_of({})) == body_text()


def test_apostrophes_and_unclosed_quotes_in_attributes():
    weights = hx.weights_of({})
    words = "some words that stand in a paragraph of their own"
    for tag in ("<a title=it's>", "<a title=it's href='x'>", '<a data-x="a>b">', "<a title='it\"s'>", "<b \"odd>"):
        assert hx.extract(f"<article><p>{words} {tag}link</a> {words}</p></article>", weights) == f"{words} link {words}"


def test_names_of_elements():
    clear = ("has-sidebar page", "no-comments", "topic social science", "post social", "content", "tagsoup", "address", "shadow")
    assert [n for n in clear if hx.name_kind(n)] == []
    junk = ("sidebar", "social-links", "share tags", "related", "ad-box", "cookie-notice", "site-header", "nav1", "main-menu")
    assert [n for n in junk if hx.name_kind(n) != hx.LIKELY] == []
    assert hx.name_kind("comments") == hx.name_kind("post-comments big") == hx.SURE
