import html
import re
import time

import pytest
from helpers import SF

from folioscan.llm import host_text as H, queries

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head><body>"
    "<header class=top><a href=/>Home</a></header><nav><ul><li><a href=/a>Menu</a></li></ul></nav><div id=cookie-notice>We use cookies</div>"
    '<div class="wrap c12"><div class="post p{n}"><h1>Title &amp; &eacute;</h1><p>First   line<br>goes\n on &lt;b&gt;<p>Second <b>bold</b> '
    '<a href=x>link</a>.</p><div class="ad">Buy now</div><ul><li>one</li><li>two</li></ul><form><input><p>Mail</p></form>'
    '<aside>side</aside><section class=comments><p>Nice!</p></section><table><tr><td>cell</td></tr></table></div></div>'
    "<div class=sidebar><p>Other posts that are quite long, really, as long as anything else on this page is.</p></div><footer>&copy; me</footer></body></html>"
)


def test_main_text_of_a_page(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(n=i)) for i in range(3)]
    got = H.digest(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    for r in got:
        assert r.text.split("\n") == ["Title & é", "First line goes on <b>", "Second bold link.", "one", "two", "cell"]
        assert r.n_chars == len(r.text)


def test_a_host_outvotes_a_page_with_little_text(spark):
    full = "<body><div class=main7><p>" + "many words " * 50 + "</p></div><div class=box1><p>short</p></div></body>"
    odd = "<body><div class=main9><p>tiny</p></div><div class=box2><p>" + "other words " * 9 + "</p></div></body>"
    rows = [(i, "https://h.example:80/x", full) for i in range(5)] + [(9, "https://h.example/y", odd), (10, "https://alone.example/", odd)]
    got = {r.page_id: r.text for r in H.digest(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "tiny" and got[10] == ("other words " * 9).strip()


def _texts(page):
    return [t for _, t, _ in H.blocks_of(page)]


def test_boilerplate_blocks_end_with_their_own_tags():
    page = "<article><h1 class=entry-header>T</h1><p>one</p><p class=share>s</p><p>two</p><p class=share>s<p>three<blockquote class=ad>a<blockquote>b</blockquote>c</blockquote>"
    assert _texts(page + "<p hidden>h</p><div>four</div></article><p>five") == ["one", "two", "three", "four", "five"]
    assert _texts("<ul><li class=share>s<ul><li>x</li></ul>y</li><li>one</li><li class=ad>s<li>two</ul><h2 class=promo>s</h2>three") == ["one", "two", "three"]
    assert _texts("<table><tr><td class=ad>s<td>one<tr class=ad><td>s<tr><th class=ad>s<td>two</table><dl><dt class=ad>s<dd>three</dl>") == ["one", "two", "three"]


def test_only_names_and_whole_values_of_attributes_decide():
    other = "<div class=box><p>tiny</p></div>"
    long_ = "many words " * 9
    for box in ('div class="post" style="overflow:hidden"', 'article title="The hidden valley"', 'div data-id="sidebar"', "div data-hidden=1", 'div title="class=ad"',
                "div data-x='hidden' class=post", 'div class="post" class="ad"', 'div x=hidden y="a > b" z'):
        page = f"<body><{box}><p>{long_}</p></div></article>{other}</body>"
        assert H.text_at(page, []) == long_.strip(), box
    assert _texts('<p style="overflow:hidden">one</p><p title="hidden">two<p hidden=until-found>no<p HIDDEN>no<p aria-hidden = "true">no<p class = "a d">three') == ["one", "two", "three"]
    assert _texts("<div class='x y' / id=ad>no</div><div/><p>one<br/>two<p class=a/>three") == ["one two", "three"]


def test_broken_tags_are_not_text():
    assert _texts('<p title="x>Lost?</p><p>two') == ["Lost?", "two"]
    assert _texts('<p>one</p><a href="x>y</a> two') == ["one", "y two"]
    assert _texts("<p>one</p><a <b") == ["one"] and _texts("a < b <3 <") == ["a < b <3 <"] and _texts("<p a=>x") == ["x"] and _texts("<p a=") == []


@pytest.mark.parametrize("piece", ['<a "', "<a '", "<!", "&", "<", '<a x="', "<a x='>", "<p ", "</p", "<!--", "<script", "<p/", '<p x="y>'])
def test_broken_pages_take_linear_time(piece):
    page = "<p>one</p>" + piece * (5_000_000 // len(piece))
    start = time.process_time()
    assert H.text_at(page, []).startswith("one")
    assert time.process_time() - start < 15


def test_scripts_end_at_their_end_tags():
    for script in ("for(i=0;i<n;i++)f()", "a='<!--'", 'if(a<b)c="', "x<y>z", ""):
        assert _texts(f"<p>one</p><script>{script}</script><p>two</p><STYLE>p{{}}</style ><p>three") == ["one", "two", "three"]
    assert _texts("<p>one</p><textarea></textareas><p>no</textarea>two<script>x<p>no") == ["one", "two"]


def test_a_word_of_a_class_does_not_drop_a_whole_page():
    long_ = "many words " * 9
    for box in ('body class="single has-sidebar"', "article class=share-post", "div id=content-sidebar-wrap", "div class=sidebar"):
        assert _texts(f"<{box}><p>{long_}</p><div class=share>s</div>") == [long_.strip()]
    inner = f"<div id=content-sidebar-wrap><div class=post><p>{long_}</p></div><div class=sidebar-box>s</div></div><p>foot</p><div class=ad-box>ad</div>"
    assert _texts(inner) == [long_.strip(), "foot"] and H.text_at(inner, []) == long_.strip()
    assert _texts(f"<p>short</p><div class=comments><p>{long_}</p></div>") == ["short"]


def test_every_template_of_a_host_is_voted_on(spark):
    rows = []
    for i, c in enumerate("abcdefghijkl"):
        full = f"<body><div class=main-{c}><p>" + "many words " * 50 + f"</p></div><div class=box-{c}><p>short</p></div></body>"
        odd = f"<body><div class=main-{c}><p>tiny {c}</p></div><div class=box-{c}><p>" + "other words " * 9 + "</p></div></body>"
        rows += [(100 * i + k, None, full) for k in range(2 + i)] + [(100 * i + 99, None, odd)] * 2
    got = [(r.page_id, r.text) for r in H.digest(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert sorted(x for x in got if x[0] % 100 == 99) == sorted([(100 * i + 99, f"tiny {c}") for i, c in enumerate("abcdefghijkl")] * 2)
    assert len(got) == len(rows)


def test_query_equals_the_articles(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op7_host_paths(spark, SF).collect():
        inside = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"<br>|</?b>", "", inside))
        plain = (" ".join(html.unescape(re.sub(r"<[^>]*>?", "", b)).split()) for b in blocks)
        assert r.text == "\n".join(b for b in plain if b)


def test_awkward_rows(spark):
    rows = [
        (1, None, None), (None, "http://a/", ""), (3, "no url", "just text"), (4, "http://a/", "<p>un<b>closed <i>tags"), (5, "http://a/", "<<>><p a='>'>x</p></nope>"),
        (6, "http://a/", "<div>" * 3000 + "deep"), (7, "http://a/", "<!-- never closed <p>x"), (7, "http://a/", "<script>x<p>y"), (8, "http://a/", "a &am"),
    ]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, main_text string")
    got = {(r.page_id, r.url): r.text for r in H.digest(df).collect()}
    assert got[(1, None)] == "" and got[(3, "no url")] == "just text" and got[(4, "http://a/")] == "un closed tags".replace("un ", "un")
    assert got[(5, "http://a/")].endswith("x") and got[(6, "http://a/")] == "deep" and got[(8, "http://a/")] == "a &am"
    assert H.digest(df.limit(0)).collect() == []
