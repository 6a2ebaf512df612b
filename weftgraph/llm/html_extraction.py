"""The main text of web pages, by a style tree of each host.

The pages of a host are merged into one tree: elements with the same chain of tags and classes are one
element node.  Its presentation nodes are the different sequences of elements found below it, its content
nodes the different texts.  With n of its m pages showing a node alike, an element is as important as the
entropy of its presentations (base m), composed with the importance of the contents below; a content is worth
1 - log n / log m.  What most pages of a host show alike is not their article and goes, whole branches first.

What a single page says by itself is read too: elements, roles and classes that are never an article, and
elements that hold one (``_html``).  Running text right in such a holder stays even if it repeats, since
copies of an article are on many pages of a host, too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._html import PROSE, Page
from weftgraph.llm._work import joined, ranges, removed, written

#: Share that the presentation of an element loses with each of them, and least importance of what stays.
DAMPING, LEAST = 0.9, 0.3
#: Kinds of rows: a page that has an element, a sequence of elements below it, a text in it, an element above it.
PAGE, STYLE, CONTENT, ABOVE = 0, 1, 2, 3
#: Up to so many unimportant nodes are sent to every task, 8 bytes each; more are joined to the pages.
BROADCAST = 2_000_000


def content_key(element: int, text: str) -> int:
    return xxhash.xxh3_64_intdigest(text, element)


def chains(page: Page) -> tuple[set[int], dict[int, tuple[int, list[int]]]]:
    """The page's roots, and for each element with text in one of them whether its text is safe (1) or not (0),
    and the keys of the elements from it up to the root, without the root unless the text is right in it."""
    roots, out = page.roots(), {}
    held = roots != {0}
    for k in {k for k, _ in page.blocks if not page.noise[k]}:
        keys, safe, at = [], held, k
        while at not in roots and at > 0:
            if page.tag[at] not in ("html", "body"):
                keys.append(page.key[at])
            safe = safe and (page.tag[at] in PROSE and " " not in page.label[at] or page.kind[at] > 0)
            at = page.parent[at]
        if at in roots:
            out[k] = (int(safe), keys)
    return roots, out


def tree_rows(page: Page):
    """(element, kind, value) of all of a page's elements that have text below them."""
    chain: dict[int, list[int]] = {}
    live: set[int] = set()
    for k in {k for k, _ in page.blocks}:
        at, above = k, []
        while at > 0:
            above.append(at)
            at = page.parent[at]
        chain[k] = above
        live.update(above)
    for k in live:
        yield page.key[k], PAGE, 0
        yield page.key[k], STYLE, xxhash.xxh3_64_intdigest("\n".join(page.children[k]))
    for k, above in chain.items():
        for x in above:
            yield page.key[k], ABOVE, page.key[x]
    for k, text in page.blocks:
        if k > 0:
            yield page.key[k], CONTENT, content_key(page.key[k], text)


def extract(page: Page, low: set[int]) -> tuple[str, int, int]:
    """The text without what is unimportant, and how many blocks rules and the tree took out."""
    kept, by_rule, by_tree = [], 0, 0
    _, inside = chains(page)
    for k, text in page.blocks:
        if k not in inside:
            by_rule += 1
            continue
        safe, keys = inside[k]
        if not safe and (content_key(page.key[k], text) in low or any(x in low for x in keys)):
            by_tree += 1
        else:
            kept.append(text)
    return "\n".join(kept), by_rule, by_tree


def style_tree(pages: DataFrame, least: float = LEAST) -> DataFrame:
    """key of each unimportant node of the hosts' trees: elements, and contents of elements.

    Pages of a host with one title are one page, as copies say nothing of what a host repeats.
    """

    def rows(batches):
        for b in batches:
            out: set[tuple[int, int, int, int]] = set()
            for url, html in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
                page = Page(url, html or "")
                if page.host:
                    who = xxhash.xxh3_64_intdigest(page.title or "\n".join(t for _, t in page.blocks))
                    out.update((key, kind, value, 0 if kind == ABOVE else who) for key, kind, value in tree_rows(page))
            key, kind, value, who = zip(*out, strict=True) if out else ((),) * 4
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (key, value, who)]
            yield pa.RecordBatch.from_arrays([longs[0], pa.array(kind, pa.int32()), *longs[1:]], names=["key", "kind", "value", "who"])

    small_batches(pages)
    each = pages.select("url", "html").mapInArrow(rows, "key long, kind int, value long, who long").distinct()
    nodes = written(each.groupBy("key", "kind", "value").agg(F.count("*").alias("n")))
    n, only = F.col("n").cast("double"), lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    repeated = (F.col("kind") == CONTENT) & (F.col("n") > 1)
    elements = nodes.groupBy("key").agg(
        only(PAGE, n).alias("m"), only(STYLE, n).alias("shown"), only(STYLE, n * F.log(n)).alias("style"), only(STYLE, F.lit(1)).alias("styles"),
        only(CONTENT, n).alias("texts"), only(CONTENT, n * F.log(n)).alias("content"), F.count(F.when(repeated, 1)).alias("size"),
    )
    elements = written(elements)
    # of all contents below an element, by the pages that show them; one that one page has is worth 1
    worth = F.when(F.col("m") > 1, F.col("texts") - F.col("content") / F.log("m")).otherwise(F.col("texts"))
    above = nodes.filter(F.col("kind") == ABOVE).select("key", F.col("value").alias("over"))
    inner = above.join(elements.filter("texts > 0").select("key", "texts", worth.alias("worth")), "key").groupBy(F.col("over").alias("key")).agg((F.sum("worth") / F.sum("texts")).alias("inner"))
    style = (F.log("shown") - F.col("style") / F.col("shown")) / F.log("m")
    share = F.pow(F.lit(DAMPING), F.col("styles"))
    branches = elements.filter("m > 1").join(inner, "key").filter((F.lit(1) - share) * style + share * F.col("inner") < least).select("key")
    contents = joined(nodes.filter(repeated).select("key", "value", "n"), elements.filter("size > 0").select("key", "m", "size"), ["key"], "size", "value")
    contents = contents.filter((F.col("m") > 1) & (1 - F.log("n") / F.log("m") < least)).select(F.col("value").alias("key"))
    out = written(branches.union(contents).distinct())
    removed(nodes)
    removed(elements)
    return out


def small_batches(pages: DataFrame) -> None:
    """Pages are long: lowers the session's batch size for Python tasks."""
    conf = pages.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


OUT = "text string, n_chars long, n_blocks long, n_by_rule long, n_by_tree long"


def _rows(page_id, url, results):
    t, a, b = zip(*results, strict=True) if results else ((), (), ())
    arrays = [page_id, url, pa.array(t, pa.string()), pa.array([len(x) for x in t], pa.int64()), pa.array([x.count("\n") + 1 if x else 0 for x in t], pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars", "n_blocks", "n_by_rule", "n_by_tree"])


def html_extraction(pages: DataFrame, least: float = LEAST, broadcast: int = BROADCAST) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_by_rule, n_by_tree of each row of ``pages`` (page_id, url, html).

    ``text`` has the page's blocks in order, one a line, with character references decoded and white space
    made single spaces; blocks are left out by what the page says (``n_by_rule``) or since the host's tree
    holds them for unimportant (``n_by_tree``, below ``least``).  A null or empty html has an empty text.  A
    page without a host is judged by itself; so is the only page of a host.  Rows that repeat count as one
    page of their host and get the same text each; a null id stays null.  Broken markup is read as far as it
    goes; elements nested deeper than 256 count as part of the one that deep.
    """
    low = style_tree(pages, least)
    few = low.count() <= broadcast
    small_batches(pages)
    id_type = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {id_type}, url string, {OUT}"
    if few:
        keys = np.array([r.key for r in low.collect()], np.int64).astype(np.uint64)
        removed(low)
        shared = pages.sparkSession.sparkContext.broadcast(np.sort(keys))

        def run(batches):
            known = shared.value

            def among(page):
                mine = np.array([*{page.key[k] for k in range(len(page.tag))}, *(content_key(page.key[k], t) for k, t in page.blocks)], np.uint64)
                at = np.minimum(np.searchsorted(known, mine), max(0, len(known) - 1))
                return set(mine[known[at] == mine].tolist()) if len(known) else set()

            for b in batches:
                results = []
                for url, html in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
                    page = Page(url, html or "")
                    results.append(extract(page, among(page)))
                yield _rows(b.column("page_id"), b.column("url"), results)

        return pages.select("page_id", "url", "html").mapInArrow(run, schema)
    return _joined(pages, low, schema)


def _same() -> list[Column]:
    """Two hashes of a page; pages that have both alike are equal."""
    return [F.xxhash64("url", "html").alias("h1"), F.xxhash64("html", F.lit(1), "url").alias("h2")]


def _joined(pages: DataFrame, low: DataFrame, schema: str) -> DataFrame:
    """The texts where ``low`` is too long for every task: its keys travel to the pages that have them."""

    def keys(batches):
        for b in batches:
            out = [[], [], []]
            for url, html, h1, h2 in zip(*(b.column(c).to_pylist() for c in ("url", "html", "h1", "h2")), strict=True):
                page = Page(url, html or "")
                if page.host:
                    mine = {*(page.key[k] for k in range(1, len(page.tag))), *(content_key(page.key[k], t) for k, t in page.blocks)}
                    for column, x in zip(out, (np.array([*mine], np.uint64).view(np.int64).tolist(), [h1] * len(mine), [h2] * len(mine)), strict=True):
                        column += x
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["key", "h1", "h2"])

    def run(batches):
        for b in batches:
            results = []
            for url, html, low in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), b.column("low").to_pylist(), strict=True):
                results.append(extract(Page(url, html or ""), {x % (1 << 64) for x in low or []}))
            yield _rows(b.column("page_id"), b.column("url"), results)

    rows = pages.select("page_id", "url", "html", *_same())
    pairs = rows.mapInArrow(keys, "key long, h1 long, h2 long").distinct()
    hits = written(pairs.join(low, "key", "left_semi")).groupBy("h1", "h2").agg(F.collect_list("key").alias("low"))
    sizes = rows.groupBy("h1", "h2").agg(F.count("*").alias("size"))
    groups = sizes.join(hits, ["h1", "h2"], "left")
    return joined(rows.withColumn("u", F.monotonically_increasing_id()), groups, ["h1", "h2"], "size", "u").select("page_id", "url", "html", "low").mapInArrow(run, schema)
