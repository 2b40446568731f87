import html
import random
import re

from cumulus.llm import wrappers
from cumulus.llm.queries import op9_main_text


def own(page):
    return wrappers.extract(page, wrappers._own_way(page))


def test_article_without_furniture():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header>Site</header><nav><ul><li><a href=/>Home</a></li></ul></nav><!-- ad --><div class="ad">Buy</div>
    <article><header><h1>Title &amp;  more</h1></header><p><b>One<br>two <i>t</i>hree<p>Four&nbsp;five
    <div class="share-box share">Share</div><ul><li>a<li>b</ul><form>q<input></form><table><tr><td>x<td>y</table>
    <aside>Note</aside><blockquote>Said</blockquote><script>no()</script><footer>by me</footer></article>
    <div id="comments"><article><p>Reader</p></article></div><aside>Side</aside><footer>&copy;</footer></body></html>"""
    assert own(page).split("\n\n") == ["Title & more", "One two three", "Four five", "a", "b", "x", "y", "Said"]


def test_odd_pages():
    assert own("plain &lt;text&gt; only") == "plain <text> only"
    assert own("<article><p>cut <a href='x") == "cut"
    assert own("<article><p>a &am</article>") == "a &am"
    assert own("<article></article>") == own("") == own("<!-- <article>x</article>") == ""
    assert own("<p>a<p>b") == "a\n\nb"
    assert own("<main>x <unknown>y</unknown></main>") == "x\n\ny"
    assert own("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert len(own("<article><p>" + "word " * 200_000)) == 5 * 200_000 - 1


def test_fold_and_align():
    li = ["li", "#", "/li"]
    assert wrappers.fold(["ul", *li, *li, *li, "/ul"]) == ["ul", ["+", li], "/ul"]
    one, two = wrappers.fold(["ul", *li, "/ul"]), wrappers.fold(["ul", *li, *li, "/ul"])
    assert wrappers.align(one, two) == two == wrappers.align(two, one)
    assert wrappers.align(["a", "b", "c"], ["a", "c"]) == ["a", ["?", ["b"]], "c"]
    both = wrappers.align(["a", "b", "c"], ["a", "d", "c"])
    assert both == ["a", ["?", ["b"]], ["?", ["d"]], "c"]
    assert wrappers.align(both, ["a", "d", "c"]) == both


def test_wrapper_of_a_host_without_article_elements():
    def page(k, n):
        body = "".join(f"<p>Text {k} {i} of some length</p>" for i in range(n))
        return (f"<body><div class=top><a href=/>Home</a> <a href=/b>Blog</a></div><ul><li><a>x</a></li><li><a>y</a></li></ul>"
                f"<div class=wrap><h2>Head {k}</h2>{body}</div><div class=end>Always the same words here</div></body>")

    whole = wrappers.Wrapper()
    for k in range(5):
        whole.add(page(k, k + 1))
    way = wrappers.plan(whole)
    assert wrappers.extract(page(9, 2), way) == "Head 9\n\nText 9 0 of some length\n\nText 9 1 of some length"
    again = wrappers.Wrapper()
    for k in range(5):
        part = wrappers.Wrapper()
        part.add(page(k, k + 1))
        again.merge(part)
    assert wrappers.plan(again) == way


def test_table_against_the_articles(spark):
    sf = "/root/testdata/sf0.001"
    out = {r.page_id: r for r in op9_main_text(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(out) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", p.html, re.S).group(1)
        blocks = re.split(r"</?(?:p|h1)>", inner.replace("<br>", " "))
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in blocks]
        r = out[p.page_id]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == p.url


def test_nulls_repeats_and_clashing_names(spark):
    page = "<article><p>x</p></article>"
    rows = [(1, "http://A.example/1", page, "c"), (1, "http://A.example/1", page, "c"), (2, None, page, "c"), (3, "http://a.example", None, "c"),
            (4, "", "", "c"), (None, "no url", page, "c")]
    out = wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, way string")).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in out) == [
        ("1", "x", 1), ("1", "x", 1), ("2", "x", 1), ("3", "", 0), ("4", "", 0), ("None", "x", 1)]
    assert wrappers.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_expression_decides_within_article_elements():
    def page(k, n):
        links = "".join(f"<li><a href=/{i}>Link {k} {i}</a></li>" for i in range(n))
        return (f"<body><article><h1>Head {k}</h1><p>Text {k} with <a>a link</a> and more words</p><p><a>Only {k}</a></p>"
                f"<ul class=notes><li>Note {k}</li><li><a>linked {k}</a></li></ul><ul class=more>{links}</ul>"
                f"<div class=follow>Follow us</div></article></body>")

    whole = wrappers.Wrapper()
    for k in range(5):
        whole.add(page(k, k + 1))
    assert wrappers.text_of(page(9, 3), wrappers.plan(whole)).split("\n\n") == [
        "Head 9", "Text 9 with a link and more words", "Only 9", "Note 9", "linked 9"]
    only_links = "<article><ul class=more><li><a>x</a></li><li><a>y</a></li></ul></article>"
    assert wrappers.text_of(only_links, wrappers.plan(whole)) == "x\n\ny"


def test_every_template_has_its_container_and_copies_are_not_constants():
    def page(side, k):
        return (f"<body><div class={side}><h2>Head {k}</h2><p>Text {side} {k} of some length</p></div>"
                f"<div class=end><p>The same words</p></div></body>")

    whole = wrappers.Wrapper()
    for k in range(9):
        whole.add(page("left", k))
    for k in range(4):
        whole.add(page("right", k))
    way = wrappers.plan(whole)
    for side in ("left", "right"):
        assert wrappers.text_of(page(side, 70), way) == f"Head 70\n\nText {side} 70 of some length"
    assert wrappers.text_of("<body><div class=other><p>One of its kind</p></div></body>", way) == "One of its kind"
    copies = wrappers.Wrapper()
    for k in range(20):
        copies.add(page("left", 1))
    assert wrappers.text_of(page("left", 1), wrappers.plan(copies)) == "Head 1\n\nText left 1 of some length"
    copies.add("<body><div class=short><p>x</p></div></body>")
    assert wrappers.text_of(page("left", 1), wrappers.plan(copies)) == "Head 1\n\nText left 1 of some length"


def test_pages_beyond_the_caps_use_their_own_expression():
    def page(k, n):
        links = "".join(f"<li class=x{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i // 100]}>"
                        f"<a href=/{i}>Link</a></li>" for i in range(n))
        return (f"<body><article><h1>Head {k}</h1><p>Text {k}</p><ul class=most><li><a>a</a></li><li><a>b</a></li></ul>"
                f"<ul class=more>{links}</ul></article></body>")

    large, small = page(0, 999), page(1, 3)
    for order in ([large, small, small], [small, large, small]):
        whole = wrappers.Wrapper()
        for p in order:
            whole.add(p)
        assert len(whole.items) <= wrappers.ITEMS and whole.own == 1
        way = wrappers.plan(whole)
        assert wrappers._covers(wrappers.steps_of(small), way, {}) and not wrappers._covers(wrappers.steps_of(large), way, {})
        assert wrappers.text_of(small, way).startswith("Head 1\n\nText 1")
        assert wrappers.text_of(large, way) == wrappers.text_of(large, wrappers._own_way(large))
    many = wrappers.Wrapper()
    for k in range(wrappers.SLOTS // 500 + 2):
        name = "abcdefghijklmnop"[k]
        many.add("<body>" + "".join(f"<div class={name}{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i // 100]}>"
                                    f"<p>w</p></div>" for i in range(500)) + "</body>")
    assert many.lost and len(many.slots) == wrappers.SLOTS
    last = "<body><div class=last><h2>Head</h2><p>Text of the last page</p></div><div class=end><p>End</p></div></body>"
    many.add(last)
    again = wrappers.Wrapper(many.state())
    assert again.lost and wrappers.text_of(last, wrappers.plan(again)) == "Head\n\nText of the last page"


def test_class_words_around_an_article_do_not_empty_the_page(spark):
    inner = "<h1>Head {k}</h1><p>Text {k} of some length</p>"
    menu = "<nav><ul><li><a href=/>Home</a></li></ul></nav><div class=cookie-notice>We use cookies</div>"
    comments = "<div id=comments><article class=comment><p>A reader's much longer words than those of the text</p></article></div>"
    forms = ["<body class='post no-sidebar'>{m}<article>{i}</article>{c}</body>",
             "<body><div class='wrapper has-menu'>{m}<article>{i}</article></div></body>",
             "<body>{m}<article class='post category-legal'>{i}</article></body>",
             "<body><div class='site with-sidebar'><div class='menu-open x'>{m}<main>{i}</main></div></div></body>",
             "<body><div class='wrapper has-menu'>{m}<div class=inner>{i}</div></div></body>"]
    rows = [(f * 10 + k, f"http://h{f}.example/{k}", form.format(m=menu, c=comments, i=inner.format(k=k)))
            for f, form in enumerate(forms) for k in range(5)]
    rows.append((100, "http://c.example/", f"<body>{comments.replace('article', 'div')}</body>"))
    out = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out.pop(100) == ""
    assert out == {i: f"Head {i % 10}\n\nText {i % 10} of some length" for i in out}


def test_hosts_of_any_size_are_read_by_their_wrapper(spark):
    letters = "abcdefghij"

    def page(k, n):
        links = "".join(f"<li class=x{letters[i % 10]}{letters[i // 10 % 10]}{letters[i // 100]}><a href=/{i}>Link {k}</a></li>" for i in range(n))
        slots = "".join(f"<div class=s{letters[k % 10]}{letters[i % 10]}{letters[i // 10 % 10]}{letters[i // 100]}><p>w</p></div>" for i in range(n // 2))
        return (f"<body><article><h1>Head {k}</h1><p>Text {k} of some length</p><ul class=more>{links}</ul>{slots}"
                f"<div class=follow>Follow us</div></article></body>")

    # Nine pages with 4500 slots of their own, and an expression of over 800 items: a bounded wrapper would know none of them.
    rows = [(k, f"http://large.example/{k}", page(k, 999 if k < 9 else 0)) for k in range(14)]
    assert max(len(wrappers.expression(p)) for _, _, p in rows) > 2 * wrappers.ITEMS
    out = {r.page_id: r.text.split("\n\n") for r in wrappers.main_text(
        spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for k in range(14):
        assert out[k][:2] == [f"Head {k}", f"Text {k} of some length"] and "Follow us" not in out[k]


def test_alignment_of_long_expressions_in_blocks(monkeypatch):
    draw = random.Random(3)
    pairs = [([draw.choice("abcdefgh") for _ in range(draw.randrange(40))], [draw.choice("abcdefgh") for _ in range(draw.randrange(40))])
             for _ in range(200)]
    whole = [wrappers.align(wrappers.fold(a), wrappers.fold(b)) for a, b in pairs]
    monkeypatch.setattr(wrappers, "CELLS", 1)
    assert [wrappers.align(wrappers.fold(a), wrappers.fold(b)) for a, b in pairs] == whole
