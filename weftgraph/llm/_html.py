"""Elements and blocks of text of one HTML page, read leniently."""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from urllib.parse import urlsplit

import xxhash

# Names of the HTML standard.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li listing main menu nav ol optgroup option p pre search section select datalist summary table caption tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes svg math template canvas object audio video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose start ends an open paragraph.
ENDS_P = BLOCKS - frozenset("body html caption tbody td tfoot th thead tr optgroup option legend".split())
#: Elements that end open ones of their kind, and up to where these are looked for.
SIBLINGS = {"li": ("li", "ul ol menu dir"), "dd": ("dd dt", "dl"), "dt": ("dd dt", "dl"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tr": ("td th tr", "table tbody thead tfoot"), "tbody": ("td th tr tbody thead tfoot", "table"), "thead": ("td th tr tbody thead tfoot", "table"), "tfoot": ("td th tr tbody thead tfoot", "table"), "option": ("option", "select optgroup datalist"), "optgroup": ("option optgroup", "select")}
SIBLINGS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in SIBLINGS.items()}
SCOPE = frozenset("table td th caption button".split())
#: Elements of running text: within an article they are its text, whatever they repeat.
PROSE = HEADINGS | frozenset("p ul ol li dl dt dd blockquote pre listing table caption thead tbody tfoot tr td th figure figcaption hgroup header".split())

# What is not the article, by element, role, and words of class and id.
NOT_TEXT = frozenset("nav aside footer button select datalist menu dialog search label legend fieldset".split())
NOT_TEXT_ROLES = frozenset("navigation contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist tooltip".split())
NOT_TEXT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored promo promos promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "footer sidebar aside widget widgets related recommended recommendations share sharing social comment comments respond disqus reply replies notice notices cookie cookies consent gdpr "
    "popup modal overlay newsletter subscribe subscription signup login pagination pager toolbar copyright banner masthead topbar alert toast paywall skip form search".split()
)
HEADER_WORDS = frozenset("header masthead topbar banner".split())
TEXT_WORDS = frozenset("article content post entry story main body text page".split())
NOT_ABOUT = frozenset("with has no without hide".split())
#: Elements nested deeper than this count as part of the one that deep, as in browsers.
DEPTH = 256

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'>]+)""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@lru_cache(100_000)
def about(tag: str, attrs: str) -> tuple[str, bool, bool, int]:
    """label, whether this is no text, whether only so outside of an article, and what container it is: 3 an
    article, 2 a main part, 1 by its class, 0 none."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attrs):
        found.setdefault((m[1] or m[5]).lower(), unescape(next((x for x in m.groups()[1:4] if x is not None), "")))
    role, names = found.get("role", "").lower(), [*found.get("class", "").split(), *found.get("id", "").split()]
    tokens = [[w.lower() for w in WORDS.findall(x)] for x in names]
    tokens = [t for t in tokens if t and t[0] not in NOT_ABOUT]
    is_text = any(set(t) <= TEXT_WORDS for t in tokens)
    noise = [t for t in tokens if not NOT_TEXT_WORDS.isdisjoint(t) and not (is_text and len(t) > 1)]
    header = tag == "header" or role == "banner" or any(not HEADER_WORDS.isdisjoint(t) for t in tokens)
    noise = [t for t in noise if HEADER_WORDS.isdisjoint(t) or not NOT_TEXT_WORDS.difference(HEADER_WORDS).isdisjoint(t)]
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    if tag in ("html", "body"):
        noise, header, hidden = [], False, False
    plain = tag in NOT_TEXT or role in NOT_TEXT_ROLES or hidden or bool(noise)
    kind = 3 if tag == "article" else 2 if tag == "main" or role == "main" or "articlebody" in found.get("itemprop", "").lower() else 1 if is_text and tag in BLOCKS and tag not in ("body", "html") else 0
    label = " ".join([tag, *sorted({re.sub(r"\d+", "", x) for x in found.get("class", "").split()})])
    return label, plain, header and not plain, 0 if plain else kind


class Page:
    """The elements of a page in order, element 0 above all, and its blocks of text.

    ``parent``, ``tag``, ``label`` (tag and classes), ``key`` (the chain of labels, hashed with the host), ``noise``, ``kind`` and the
    labels of ``children`` are by element; ``noise`` is 1 for no text, 2 for a form, in which an article still is; ``blocks`` has (element, text).  ``title`` is that of the page.
    """

    def __init__(self, url: str | None, html: str):
        self.host = host(url)
        self.parent, self.tag, self.noise, self.kind = [-1], ["#"], [0], [0]
        self.key, self.children, self.label = [xxhash.xxh3_64_intdigest(self.host)], [[]], [""]
        self.blocks: list[tuple[int, str]] = []
        self.title = ""
        self._read(html)

    def _read(self, html: str) -> None:
        stack, inline, buffer = [0], [], []  # inline: elements within a block that are no text
        at, n = 0, len(html)

        def flush():
            inline.clear()
            if buffer:
                text = " ".join(unescape("".join(buffer)).split())
                buffer.clear()
                if text:
                    self.blocks.append((stack[-1], text))

        def close(k: int) -> None:
            flush()
            del stack[k:]

        def find(tags, stop) -> int:
            for k in range(len(stack) - 1, 0, -1):
                t = self.tag[stack[k]]
                if t in tags:
                    return k
                if t in stop:
                    break
            return 0

        while at < n:
            m = TOKEN.search(html, at)
            if m is None:
                if not inline:
                    buffer.append(html[at:])
                break
            if m.start() > at and not inline:
                buffer.append(html[at : m.start()])
            at = m.end()
            name = m["tag"]
            if name is None:
                if m["cdata"] and not inline:
                    buffer.append(m["cdata"])
                continue
            name = name.lower()
            if m["end"]:
                if name in inline:
                    del inline[inline.index(name) :]
                elif name in BLOCKS:
                    tags = HEADINGS if name in HEADINGS else {name}
                    k = find(tags, () if name in ("table", "article", "main", "nav", "aside", "footer", "header", "form", "section") else SCOPE - {name})
                    if k:
                        close(k)
                    else:
                        flush()
                continue
            if name in RAW:
                m2 = re.compile(f"</{name}", re.I).search(html, at)
                end = m2.start() if m2 else n
                if name == "title" and not self.title:
                    self.title = " ".join(unescape(html[at:end]).split())
                if not m["attrs"].endswith("/") or name not in ("svg", "math"):
                    at = end
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                elif name == "br" and not inline:
                    buffer.append(" ")
                continue
            label, plain, outside, kind = about(name, m["attrs"])
            if name not in BLOCKS:
                if inline or plain:
                    inline.append(name)
                continue
            flush()
            if name in ENDS_P and (k := find({"p"}, SCOPE)):
                close(k)
            if name in HEADINGS and self.tag[stack[-1]] in HEADINGS:
                stack.pop()
            while name in SIBLINGS and (k := find(*SIBLINGS[name])):
                close(k)
            if name in ("article", "main") and (k := find({"nav"}, ())):  # a menu that nobody closed
                close(k)
            if name in ("html", "body") and len(stack) > 1 and name in map(self.tag.__getitem__, stack):
                continue
            if len(stack) > DEPTH:
                continue
            up = stack[-1]
            within = any(self.kind[k] for k in stack)
            if self.noise[up] == 1 or plain or (outside and not within):
                noise = 1
            elif name == "form" or self.noise[up]:
                noise = 0 if kind >= 2 else 2
            else:
                noise = 0
            self.parent.append(up)
            self.tag.append(name)
            self.noise.append(noise)
            self.kind.append(0 if noise else kind)
            self.key.append(_chain(self.key[up], label))
            self.children.append([])
            self.label.append(label)
            below = self.children[up]
            if not below or below[-1] != label:
                below.append(label)
            stack.append(len(self.tag) - 1)
        flush()

    def roots(self) -> set[int]:
        """The elements that hold the article: articles, else the main part, else the one of a telling class with
        half of all text, else the whole page.  Those without text do not count."""
        text = [0] * len(self.tag)
        for k, t in self.blocks:
            if not self.noise[k]:
                text[k] += len(t)
        for k in range(len(text) - 1, 0, -1):
            text[self.parent[k]] += text[k]
        for kind in (3, 2, 1):
            top = set()
            inside = [False] * len(self.tag)
            for k in range(1, len(self.tag)):
                inside[k] = inside[self.parent[k]] or self.kind[self.parent[k]] == kind
                if self.kind[k] == kind and not inside[k] and text[k]:
                    top.add(k)
            if kind == 1 and top:
                best = max(top, key=lambda k: (text[k], -k))
                top = {best} if 2 * text[best] >= text[0] else set()
            if top:
                return top
        return {0}


@lru_cache(500_000)
def _chain(above: int, label: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{above} {label}")


def host(url: str | None) -> str:
    """The host of ``url`` in lower case, without its port; empty if there is none."""
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""
