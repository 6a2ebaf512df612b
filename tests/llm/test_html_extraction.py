import math
import random
from collections import Counter, defaultdict

import pytest

from weftgraph.llm._html import Page, host
from weftgraph.llm.html_extraction import DAMPING, LEAST, content_key, extract, html_extraction, style_tree

SCHEMA = "page_id long, url string, html string"


def text(html, url="http://a.example/x"):
    return extract(Page(url, html), set())[0]


def soup(i, r):
    """A page of plain divs: only other pages of the host tell its text from what all of them show."""
    words = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(r.randrange(999)) for _ in range(n))
    own = [words(12) for _ in range(r.randint(1, 3))]
    body = "".join(f"<div class='c1'>{x}</div>" for x in own)
    html = f"<html><head><title>{words(4)}</title></head><body><div class='z9'><div>Welcome to us</div><div>Call 555</div></div><div class='k2'>{body}</div><div class='q4'><span>All rights</span> &amp; more</div></body></html>"
    return html, "\n".join(own)


@pytest.fixture(scope="module")
def pages():
    r = random.Random(5)
    out = []
    for i in range(40):
        out.append((i, f"https://Soup.example:8080/{i}", *soup(i, r)))
    for i in range(40, 50):
        body = f"<nav><a href=/>Home</a></nav><article><h1>Title {i}</h1><p>Shared text of a copied article.<p>Own {i}</article><footer>x</footer>"
        out.append((i, f"http://copies.example/{i}", f"<title>t{i}</title>{body}", f"Title {i}\nShared text of a copied article.\nOwn {i}"))
    for i in range(50, 90):  # copies of one page say nothing of the host
        out.append((i, f"http://same.example/{i}", "<title>One</title><div>Same text</div>", "Same text"))
    out += [(None, None, "<p>no host</p>", "no host"), (91, "http://alone.example", "<div>Only page</div>", "Only page"), (92, "::", "a<b", "a"), (93, "http://n.example", None, ""), (94, "http://n.example", "", ""), (94, "http://n.example", " \n", "")]
    return out


def got(df):
    return sorted(((r.page_id, r.url, r.text, r.n_chars) for r in df.collect()), key=str)


def frame(spark, pages):
    return spark.createDataFrame([p[:3] for p in pages], SCHEMA).repartition(3)


def test_text_of_pages(spark, pages):
    expected = sorted(((i, u, t, len(t)) for i, u, _, t in pages), key=str)
    df = frame(spark, pages)
    assert got(html_extraction(df)) == expected
    assert got(html_extraction(df, broadcast=0)) == expected
    assert got(html_extraction(df.selectExpr("*", "1 AS key", "'x' AS text", "2 AS n", "3 AS low", "4 AS u", "5 AS h1"), broadcast=0)) == expected
    assert sum(r.n_by_tree for r in html_extraction(df).collect()) == 3 * 40


def test_empty_and_repeats(spark, pages):
    df = frame(spark, pages)
    assert got(html_extraction(df.limit(0))) == []
    assert got(html_extraction(df.union(df))) == sorted([*got(html_extraction(df))] * 2, key=str)


def test_tree_like_brute_force(spark, pages):
    who, m, styles, contents, above = defaultdict(set), {}, defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, url, html, _ in pages:
        p = Page(url, html or "")
        if not p.host:
            continue
        one = p.title or "\n".join(t for _, t in p.blocks)
        for k, t in p.blocks:
            while k > 0:
                who[p.key[k], "page"].add(one)
                who[p.key[k], "style", tuple(p.children[k])].add(one)
                k = p.parent[k]
        for k, t in p.blocks:
            if k:
                who[p.key[k], "text", t].add(one)
            at = k
            while at > 0:
                above[p.key[at]].add(p.key[k])
                at = p.parent[at]
    for (key, kind, *value), pages_ in who.items():
        if kind == "page":
            m[key] = len(pages_)
        else:
            (styles if kind == "style" else contents)[key][value[0]] = len(pages_)
    expected = set()
    worth = lambda key, t: 1 - math.log(contents[key][t]) / math.log(m[key]) if m[key] > 1 else 1
    for key in m:
        if m[key] < 2:
            continue
        n = sum(styles[key].values())
        entropy = -sum(x / n * math.log(x / n) for x in styles[key].values()) / math.log(m[key])
        below = [(contents[k][t], worth(k, t)) for k in above[key] for t in contents[k]]
        inner = sum(a * b for a, b in below) / sum(a for a, _ in below)
        share = DAMPING ** len(styles[key])
        if (1 - share) * entropy + share * inner < LEAST:
            expected.add(key)
        expected |= {content_key(key, t) for t in contents[key] if worth(key, t) < LEAST}
    found = {r.key % (1 << 64) for r in style_tree(frame(spark, pages)).collect()}
    assert found == expected and len(found) > 6


def test_broken_markup():
    assert text('<script>var t="</p>";</script><article><h1>A</h1><p><b>one.<br><p>two &amp;amp; &copy three') == "A\none.\ntwo &amp; © three"
    assert text("<!-- <p>no</p> --><p>a <i>b</i>\n\t c&nbsp;d<!-- never closed") == "a b c d"
    assert text("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>x<td>y<tr><td>z</table>") == "a\nb\nc\nd\nx\ny\nz"
    assert text("<div" + " a='>' b=\">\"" + ">in</div></div></p>out<div title=\"never closed>x") == "in\nout\nx"
    assert text("a<" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "end") == "a<\ndeep\nend"
    assert len(text("<p>" + "word " * 200_000)) == 999_999


def test_what_is_no_article():
    page = """<body class='has-sidebar'><header><h1>Site</h1></header><form id=all><main><article class='post'><header class='entry-header'><h1>T</h1></header><p>One</p>
      <aside>S</aside><div class='share-buttons'>tweet</div><p class="cookie-notice">ok?</p><p>Two <span class=ad>AD</span>too <button>press</button></p><form>mail<input></form></article>
      <section id=comments><article>comment</article></section></main></form><div role=navigation>n</div><div hidden>h</div><div style='display: none'>h</div><footer>f</footer>"""
    assert text(page) == "T\nOne\nTwo too"
    assert text("<div class='content'><p>Long enough text</p></div><div>x</div>") == "Long enough text"
    assert text("<nav><ul><li>menu</ul><article><p>a</p></article>") == "a"
    assert text("<select><option>1<option>2</select><p>a") == "a"
    assert host("HTTPS://User@Host.Example:80/x") == "host.example" and host("http://[bad") == ""
