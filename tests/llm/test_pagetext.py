"""Page texts: pages by hand, templates of hosts against brute force, and the defined cases."""

import random
from collections import Counter, defaultdict

import pytest

from quantalake.llm.pagetext import Template, check, frequent_classes, items, main_text, page_texts


def alone(page):
    return "\n".join(t for _, t in main_text(items(page), Template()))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain text &amp; more", "plain text & more"),
        ("<p>one<p>two\n\n  three&nbsp;four</p>five", "one\ntwo three four\nfive"),
        ("<p>a<b>b</b>c <i>d</i><br>e<hr>f", "abc d\ne\nf"),
        ("<ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><th>3</table>", "x\ny\n1\n2\n3"),
        ("<nav>menu</nav><p>text</p><footer>foot</footer>", "text"),
        ("<div class='ad box'>buy</div><div class='address'>street</div>", "street"),
        ("<div id=cookie-notice>we use cookies</div><p>t", "t"),
        ("<header><h1>site</h1></header><article><header><h1>Title</h1></header><p>Body</p><footer>by x</footer></article><p>after</p>", "Title\nBody"),
        ("<main><p>kept</p><section class=comments><p>first!</p></section><form>name <input></form></main>", "kept"),
        ("<article>a<aside>b</aside>c<div class='sidebar'>d</div></article>", "a\nc"),
        ("<article>one</article><div>x</div><article>two</article>", "one\ntwo"),
        ("<nav><a href=1>never closed<article><p>still here</article>", "still here"),
        ("<aside><article>teaser</article></aside><article>real</article>", "real"),
        ("<script>var t='</p><p>no';</script><style>p{}</style><p>yes", "yes"),
        ("<script>open <p>end", ""),
        ("a<!-- <p>b</p> -->c<!-- d", "ac"),
        ("<title>T</title><p>&lt;b&gt; &#233; &#x41; &eacute &am &unknown;", "<b> é A é &am &unknown;"),
        ("2 < 3 and 4 > 3 <5", "2 < 3 and 4 > 3 <5"),
        ("<p title='a > b'>x</p><p title=\"open>y</p>", "x\ny"),
        ("<div hidden>h</div><div style='display: none'>n</div><div aria-hidden=true>s</div><div data-hidden-x=1>k</div>", "k"),
        ("<span class=ad>buy <span>this</span> now</span> stays", "stays"),
        ("<div role=navigation>n</div><div role=main>m</div><div>o</div>", "m"),
        ("<ul><li><a href=a>link one</a><li><a href=b>link two</a></ul><p>see <a href=c>this</a> long text", "see this long text"),
        ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
        ("<article></article><p>outside", "outside"),
        ("<select><option>1</select><button>go</button><p>z<textarea>t</textarea>", "z"),
        ("<p>a　b\tc\x0bd</p>", "a b c d"),
    ],
)
def test_pages_by_hand(page, text):
    assert alone(page) == text


def test_slow_pages():
    """Deep nesting, unmatched end tags and open quotes take time in proportion to the page."""
    assert alone("<div>" * 20_000 + "x" + "</div>" * 30_000) == "x"
    assert alone("</b></i>" * 20_000 + "<p>x" * 20_000).count("x") == 20_000
    assert alone('<a b="' * 500 + "x") == ""
    assert alone("<" * 50_000) == "<" * 50_000
    assert alone("<article>" + "word " * 300_000) == ("word " * 300_000).strip()


def test_checks():
    assert check([1, 2, 1, 2], {1: 0, 2: 0})[0][0] and not check([1, 2, 2, 1], {1: 0, 2: 0})[0][0]
    nested = check([1, 3, 4, 2], {1: 0, 2: 0, 3: 1, 4: 1})
    crossed = check([1, 3, 2, 4], {1: 0, 2: 0, 3: 1, 4: 1})
    assert nested[0][0] and nested[1][0] and crossed[0][0] and not crossed[1][0]
    assert check([1, 2], {1: 0, 2: 0})[0][1] != check([2, 1], {1: 0, 2: 0})[0][1]


SCHEMA = "page_id long, url string, html string, text int, host string, i int, slots string, content string"


def table(spark, pages):
    return spark.createDataFrame([(n, u, h, 1, "h", 2, "s", "c") for n, (u, h) in enumerate(pages)], SCHEMA).repartition(3)


def texts(spark, pages):
    return {r.page_id: r.text for r in page_texts(table(spark, pages)).collect()}


def test_template_of_a_host(spark):
    """No element says what is content: what all pages share is the template, but an article's text never is."""
    shell = "<html><body><div class=x1><p>Welcome to our site</p><p>Call us</p></div><div class=x2>%s</div><div class=x3>All rights reserved</div></body></html>"
    pages = [(f"http://a.example/{n}", shell % f"<p>Story {n}</p><p>Shared line</p><p>End of {n}</p>") for n in range(8)]
    pages += [("http://few.example/1", shell % "<p>Alone</p>")] * 2
    pages += [(f"https://user@Copy.example:8080/{n}?q=http://other", "<body><div>Top of all</div><article><p>Same on every page</p></article></body>") for n in range(6)]
    got = texts(spark, pages)
    for n in range(8):
        # every page has the shared line in the same place: it can't be told from the template without an article
        assert got[n] == f"Story {n}\nEnd of {n}"
    assert got[8] == got[9] == "Welcome to our site\nCall us\nAlone\nAll rights reserved"
    assert all(got[n] == "Same on every page" for n in range(10, 16))
    slots = {r.page_id: [s.slot for s in r.slots] for r in page_texts(table(spark, pages)).collect()}
    assert slots[8] == [0] * 4 and min(slots[0]) > 1 and len(set(map(tuple, (slots[n] for n in range(8))))) == 1


def test_slots_judged_by_the_host(spark):
    """A page that lost its article tag has its text in the slot that holds content on the host's other pages."""
    page = "<body><div>links %d</div><div class=body>%s<p>Text %d goes here</p>%s</div><div>more %d</div></body>"
    pages = [("http://s.example/", page % (n, "<article>", n, "</article>", n)) for n in range(12)] + [("http://s.example/x", page % (99, "", 99, "", 99))]
    got = texts(spark, pages)
    assert all(got[n] == f"Text {n} goes here" for n in range(12))
    assert "Text 99 goes here" in got[12]


def test_classes_by_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for host in "abcd":
        for _ in range(rng.choice([2, 5, 9])):
            rows.append((host, {t: rng.choice([1, 1, 2]) if t < 4 else 1 for t in range(8) if t < 3 or rng.random() < 0.6}))
    df = spark.createDataFrame([(h, list(t), list(t.values())) for h, t in rows], "host string, each array<long>, times array<int>")
    want = {}
    for host in "abcd":
        pages = [t for h, t in rows if h == host]
        vectors = defaultdict(set)
        for t in range(8):
            vector = tuple(p.get(t, 0) for p in pages)
            if sum(map(bool, vector)) >= len(pages) / 2:
                vectors[vector].add(t)
        if len(pages) >= 4 and vectors:
            want[host] = Counter(map(frozenset, vectors.values()))
    got = defaultdict(Counter)
    for r in frequent_classes(df).collect():
        got[r.host][frozenset(r.tokens)] += 1
    assert got == want


def test_defined_cases(spark):
    pages = [(None, None), (None, "<p>no url"), ("", ""), ("not a url", "<article>x</article>"), ("http://h.example/", "<p>" + "long " * 100_000)] + [("http://r.example/1", "<article>again</article>")] * 5
    got = texts(spark, pages)
    assert [got[n] for n in range(4)] == ["", "no url", "", "x"] and got[4] == ("long " * 100_000).strip()
    assert all(got[n] == "again" for n in range(5, 10))
    df = page_texts(table(spark, pages))
    assert df.columns == ["page_id", "url", "text", "n_chars", "slots"]
    assert all(r.n_chars == len(r.text) for r in df.collect())
    assert page_texts(table(spark, [])).count() == 0
