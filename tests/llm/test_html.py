from html.parser import HTMLParser

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearth.llm import html_extract, queries


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{x}}</style><script>var a="</p><article>no";</script></head><body class="has-sidebar">
<header><a href="/">Site</a></header><nav><ul><li>Home</li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>{title}</h1><p>{first}<br>after  break &amp; more &eacute;</p><p><b>{second}<div class="ad-banner">Buy</div><ul><li>one</li><li>two</ul></article>
<aside>side</aside><section id="comments"><article class="comment"><p>nice!</p></article></section><form><input><label>mail</label></form><footer>&copy; x</footer></body></html>"""


def test_html_text(spark, odd, empty):
    pages = [(i, f"http://a.example/{i}", PAGE.format(title=f"T{i}", first=f"first &lt;{i}&gt;", second=f"second   {i}")) for i in range(7)]
    pages += [(100, "http://b.example/", PAGE.format(title="solo", first="f", second="s")), (101, None, None), (102, "x", ""), (103, "http://c.example", "plain  text"), (104, "http://c.example/2", "<p>open <i>in</i>line<p>next <!-- <p>no</p> -->")]
    plain = [(200 + i, f"http://d.example/{i}", f"<html><body><div id='menu'>M</div><div id='wrap'><h2>H{i}</h2><p>{'body text ' * 20}{i}</p></div><div id='x'><p>Always the same line</p></div></body></html>") for i in range(6)]
    pages += [(105, "http://e.example", "<body><div class='page with-sidebar'><div role='main'><p>body</p></div><div class='sidebar'>s</div></div></body>"), (107, "http://g.example", "<head><title>no</title><body><article><p>a < b<p>c"), (106, "http://f.example", "<body><div class='widget'><p>only this</p></div></body>")]
    df = spark.createDataFrame(pages + plain + [pages[0]], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    for size in (200, 3):  # one group a host, and several
        got = {r.page_id: r.text for r in html_extract.html_text(df, group_pages=size).collect()}
        assert got[3] == "T3\nfirst <3>\nafter break & more é\nsecond 3\none\ntwo"
        assert got[100].startswith("solo\nf\n") and got[101] == got[102] == "" and got[103] == "plain text" and got[104] == "open inline\nnext"
        assert got[105] == "body" and got[106] == "only this" and got[107] == "a < b\nc"
        assert got[203] == f"H3\n{('body text ' * 20)}3".replace("  ", " ")
    assert html_extract.html_text(df).count() == df.count()
    assert html_extract.html_text(df.limit(0)).count() == 0


def frame(body, i):
    """A page without article, main or telling names: a menu, notices, a pool of adverts and a numbered foot around the text."""
    menu = "".join(f"<li><a href='/{x}'>{x}</a>" for x in ("Home", "World", "Sport"))
    return f"<html><body><div class=q1><ul>{menu}</ul></div><div class=k>We use biscuits to know you.</div>{body}<div class=z2>Buy {('tea', 'pie')[i % 2]} now!</div><div class=z3>© 2020 Example, page {i}</div></body></html>"


def body(i):
    return f"<div class=w><h1>Of {chr(97 + i)}mber</h1><p>It begins with {chr(98 + i) * 40} <a href=x>there</a>.</p><div class=b7><p>Then {chr(99 + i) * 50}.</p><p>Last {chr(100 + i) * 60}.</p></div></div>"


def test_html_template_alone_tells_text_from_chrome():
    want = [f"Of {chr(97 + i)}mber\nIt begins with {chr(98 + i) * 40} there.\nThen {chr(99 + i) * 50}.\nLast {chr(100 + i) * 60}." for i in range(6)]
    pages = [frame(body(i), i) for i in range(6)]
    assert html_extract.extract_group(pages) == want
    assert html_extract.extract_group(pages + pages[:3]) == want + want[:3]  # equal pages count once
    two = html_extract.extract_group(pages[:2])  # the classes are the same at any number of pages; a pool shows from three on
    assert two == [t + f"\nBuy {x} now!" for t, x in zip(want, ("tea", "pie"))]
    alone = html_extract.extract_group(pages[:1])[0]  # one page: a menu is told by its links, a notice is not
    assert "Sport" not in alone and want[0] in alone and "biscuits" in alone


def test_html_keeps_what_stands_beside_the_largest_slot():
    pages = [frame(f"<div class=head><h1>{c}</h1></div><div class=lead>Lead {c * 3}</div><div class=text><p>{c * 40}</p><p>{c * 30}</p></div>", i) for i, c in enumerate("abcdef")]
    assert html_extract.extract_group(pages)[2] == f"c\nLead ccc\n{'c' * 40}\n{'c' * 30}"
    pages = [f"<body><div class=bar>Daily</div><main><h1>{c}</h1><article><p>{c * 9}<div class=alert>{c}!</div><div class=ad>ad {c}</div></article></main><footer>f</footer>" for c in "abcdef"]
    assert html_extract.extract_group(pages)[1] == "b\nbbbbbbbbb\nb!"
    pages = [f"<body><div class=bar>Daily</div><h1>{c}</h1><article><p>{c * 9}</article><p>{c} beside" for c in "abcdef"]
    assert html_extract.extract_group(pages)[1] == "b\nbbbbbbbbb"


def test_html_names_yield_to_the_template():
    pages = [f"<body><div class=widget><p>{c * 50}</p></div><div class=note>{c}</div>" for c in "abcdef"]
    assert html_extract.extract_group(pages)[0] == "a" * 50 + "\na"


def test_html_template_decides_inside_an_article():
    links = "".join(f"<li><a href='/{x}'>{x} of the day</a>" for x in ("Read", "Watch"))

    def page(i, c):
        own = ("<section class='related-work'><h2>Related work</h2><p>Others, like " + c * 30 + "</p></section>") if i % 2 else ""
        own += f"<div class='comment-section-analysis'><p>What readers said of {c * 25}</p></div><aside class='pull'>Quoth <b>{c * 9}</b> twice</aside>"
        chrome = f"<div class=q7><p>Join our list today.</p></div><aside><ul>{links}</ul></aside><div class='related-posts'>{c} too</div><div class='promo-google'>{('Tea', 'Pie')[i % 2]}</div><div id='reader-comments'><p>{c} nice</p></div>"
        return f"<body><article><h1>{c}</h1><p>{c * 60}</p>{own}<p>{c * 50}</p>{chrome}</article></body>"

    pages = [page(i, c) for i, c in enumerate("abcdef")]
    got = html_extract.extract_group(pages)
    for i, (c, text) in enumerate(zip("abcdef", got)):
        related = f"Related work\nOthers, like {c * 30}\n" if i % 2 else ""
        assert text == f"{c}\n{c * 60}\n{related}What readers said of {c * 25}\nQuoth {c * 9} twice\n{c * 50}"
    alone = html_extract.extract_group(pages[:1])[0]  # one page: hints are all there is, and what no name tells stays
    assert "Quoth" not in alone and "of the day" not in alone and "Join our list" in alone and "nice" not in alone


def test_html_equal_boxes_of_few_pages_stay():
    pages = [f"<body><article><h1>{c}</h1><p>{c * 60}</p>{'<div class=box><p>Recipe for bread</p></div>' * (c in 'abc')}</article></body>" for c in "abcdef"]
    assert [("bread" in t) for t in html_extract.extract_group(pages)] == [True] * 3 + [False] * 3


class Article(HTMLParser):
    """The blocks of a page's article, read by the standard library's parser, without its adverts."""

    def __init__(self):
        super().__init__()
        self.depth, self.ads, self.blocks = 0, 0, [[]]

    def handle_starttag(self, tag, attrs):
        self.ads += tag == "div" and (self.ads > 0 or ("class", "ad") in attrs)
        self.depth += tag == "article"
        if tag in ("p", "h1", "br", "div"):
            self.blocks.append([])

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "div"):
            self.blocks.append([])
        self.ads -= tag == "div" and self.ads > 0
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth and not self.ads:
            self.blocks[-1].append(data)


def test_html_query_against_a_plain_reading(spark, sf):
    def plain(html):
        reader = Article()
        reader.feed(html or "")
        reader.close()
        return "\n".join(filter(None, (" ".join("".join(b).split()) for b in reader.blocks)))

    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    want = sorted((p.page_id, p.url, plain(p.html)) for p in pages)
    got = queries.op9_html_text(spark, sf).collect()
    assert sorted((r.page_id, r.url, r.text) for r in got) == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_html_near_copies_lose_nothing():
    pages = [f"<body><div class=w><h1>Same title</h1><p>One and the same paragraph but for {c}.</p></div>" for c in "abcdef"]
    assert html_extract.extract_group(pages)[0] == "Same title\nOne and the same paragraph but for a."


TAGS = st.recursive(st.sampled_from([("b", ()), ("i", ()), ("u", ())]), lambda x: st.tuples(st.sampled_from("bius"), st.lists(x, max_size=3).map(tuple)), max_leaves=7)


@given(st.lists(st.lists(TAGS, max_size=4), min_size=2, max_size=4))
@settings(max_examples=200, deadline=None)
def test_html_classes_against_brute_force(forests):
    def written(tree):
        return f"<{tree[0]}>{''.join(map(written, tree[1]))}</{tree[0]}>"

    paths = html_extract.Paths()
    orders = [html_extract.parse("".join(map(written, f)), paths).order for f in forests]
    found = html_extract.classes(orders, paths, 2)
    seen = {p: tuple((i, o.count(p)) for i, o in enumerate(orders) if p in o) for o in orders for p in o}
    placed = [p for c in found for p in c.paths]
    assert sorted(placed) == sorted(p for p, v in seen.items() if len(v) > 1)  # every tag of two pages or more, once

    def fits(group, vector):
        rows = [[p for p in o if p in group] for o in orders]
        first = next(r for r in rows if r)[: len(group)]
        above = {paths.parent[p] for p in group} - set(group)
        ones = all(n == 1 for _, n in vector) and len(vector) == len(orders)
        return all(r == first * (len(r) // len(group)) for r in rows) and sorted(first) == sorted(group) and (ones or len(above) == 1)

    for c in found:
        assert all(seen[p] == c.vector for p in c.paths) and fits(c.paths, c.vector)
    for vector in {seen[p] for p in placed}:  # a class is split only if it does not fit
        parts = [c for c in found if c.vector == vector]
        assert len(parts) == 1 or not fits([p for c in parts for p in c.paths], vector)


def test_html_hard_pages_take_linear_time():
    import time

    hard = ["<div>" * 10_000 + "deep" + "</div>" * 10_000, '<a href="x> y ' * 8_000, "<b>" * 10_000 + "</i>" * 4_000 + "<p>x" * 3_000, "<p><button>" + "<span>" * 5_000 + "<h1>q" * 5_000, "<article>a" * 5_000, "<!--" * 9_000, "<" * 50_000, "<script>" * 5_000]
    for page in hard:
        began = time.process_time()
        html_extract.extract_group([page, page + "<p>more"])
        assert time.process_time() - began < 2
