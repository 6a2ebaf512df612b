"""Quality rules on repetition and on how far a text's histograms are from its language's, with
DataFrame functions only.

Two histograms of each text, of character classes and of common words, are compared by Jensen-Shannon
distance to references: the sums over all texts of the language.  Most words are not common ones, so the
distance of words is taken among the common ones, and their share of all words is judged by itself.
Texts below a minimum length have too few counts for that and are left to the base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._work import written

OTHERS = "[^A-Z0-9#*$%&|<>.,;:!?'\"()-]+"
SYMBOLS, UPPER, DIGITS, MARKS = "[#*$%&|<>]+", "[A-Z]+", "[0-9]+", "[.,;:!?'\"()-]+"
#: Function words of English, German, French and Spanish.
COMMON = (
    "the of and to in is was for that with on are "
    "der die und das den von ist mit des dem nicht auf "
    "le la les et un une que dans pour pas du sur "
    "el los las y del por con una se para es como"
).split()
#: Words of the sum over all rows that are added to each language's own counts.
PRIOR_WORDS = 200
#: The share of the common words is judged where a text has so many, or would have by its reference; their
#: distance where it has so many.  Among fewer, either is chance.
LEAST_COMMON = 20


def _let(value: Column, body) -> Column:
    """``body(value)``, with value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _number(text: Column, chars: str) -> Column:
    """How many characters are of a class."""
    return F.length(text) - F.length(F.regexp_replace(text, chars, ""))


def _rare(text: Column) -> Column:
    """The characters of the counted classes, which are few: one pass over the text serves all counts."""
    return F.regexp_replace(text, OTHERS, "")


def _histograms(text: Column, rare: Column, words: Column) -> list[Column]:
    """Counts of character classes, and of common words and the rest; ``rare`` is ``_rare(text)``."""
    upper, digits, marks, symbols = (_number(rare, x) for x in (UPPER, DIGITS, MARKS, SYMBOLS))
    white = F.length(text) - _word_chars(words)
    wide = F.octet_length(text) - F.length(text)
    classes = F.array(*(x.cast("double") for x in (F.length(text) - upper - digits - marks - symbols - white, upper, digits, marks, symbols, white, wide)))
    # most words are none of these, so the count of each looks at few
    hits = F.filter(words, lambda w: w.isin(COMMON))
    counts = _let(hits, lambda h: F.array(*((F.size(h) - F.size(F.array_remove(h, w))).cast("double") for w in COMMON), (F.size(words) - F.size(h)).cast("double")))
    return [classes, counts]


def _distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1); 1 where one of the two has no counts."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    inner = _let(
        F.struct(total(counts).alias("a"), total(reference).alias("b")),
        lambda s: F.when(
            (s["a"] > 0) & (s["b"] > 0),
            total(
                F.zip_with(
                    F.transform(counts, lambda c: c / s["a"]),
                    F.transform(reference, lambda r: r / s["b"]),
                    lambda p, q: (part(p, (p + q) / 2) + part(q, (p + q) / 2)) / 2,
                )
            ),
        ).otherwise(1.0),
    )
    return F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), inner)))


def _repeated_words(words: Column) -> Column:
    """Words in 5-word windows found twice or more: windows are hashed, and only texts in which two
    hashes are equal sort them."""
    at = lambda x, i: F.get(x, i)
    windows = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(*(at(h, i + j) for j in range(5))))

    def places(g: Column) -> Column:
        ordered = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda a, b: F.coalesce(a["x"] == b["x"], F.lit(False))
            return F.filter(F.transform(s, lambda e, k: F.when(same(e, at(s, k - 1)) | same(e, at(s, k + 1)), e["i"])), lambda i: i.isNotNull())

        spread = lambda p: F.aggregate(F.transform(p, lambda i, k: F.least(F.lit(5), F.coalesce(at(p, k + 1) - i, F.lit(5)))), F.lit(0), lambda a, b: a + b)
        return F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(_let(F.sort_array(_let(ordered, twice)), spread))

    return F.when(F.size(words) < 5, 0).otherwise(_let(_let(F.transform(words, lambda w: F.xxhash64(w)), windows), places))


def _word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, ""))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")


def references(docs: DataFrame, min_words: int) -> tuple[DataFrame, Column]:
    """lang and the summed histograms of its texts of ``min_words`` words or more, with PRIOR_WORDS of
    those of all rows; and a struct of the latter."""
    text = F.coalesce("text", F.lit(""))
    # a filter on x.n would be moved below and compute x twice, so the sums skip rows instead
    rows = docs.select(F.col("lang").cast("string").alias("lang"), _let(F.struct(_words(text).alias("w"), _rare(text).alias("r")), lambda t: F.struct(F.size(t["w"]).alias("n"), F.array(*_histograms(text, t["r"], t["w"])).alias("h"))).alias("x"))
    long = F.col("x.n") >= min_words
    cells = [F.sum(F.when(long, F.get(F.get("x.h", F.lit(k)), F.lit(i)))).alias(f"c{k}_{i}") for k, n in ((0, 7), (1, len(COMMON) + 1)) for i in range(n)]
    by_lang = written(rows.groupBy("lang").agg(F.count_if(long).alias("rows"), *cells))
    names = [c for c in by_lang.columns if c not in ("lang", "rows")]
    every = {c: float(n or 0) for c, n in by_lang.agg(*(F.sum(c).alias(c) for c in names)).first().asDict().items()}
    part = PRIOR_WORDS / max(1.0, sum(n for c, n in every.items() if c[1] == "1"))
    own = by_lang.filter(F.col("lang").isNotNull())
    arrays = lambda cell: (F.array(*(cell(c) for c in names if c[1] == k)).alias(name) for k, name in (("0", "classes"), ("1", "words")))
    return own.select("lang", *arrays(lambda c: F.coalesce(c, F.lit(0.0)) + part * every[c])), F.struct(*arrays(lambda c: F.lit(every[c])))


def quality_rules(docs: DataFrame, min_words: int = 10, max_repeat: int = 20, guard_words: int = 50, max_class_distance: float = 0.25, max_word_distance: float = 0.7, min_common_share: float = 0.2, keep_columns: bool = False) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and the two
    distances of each row of ``docs`` (doc_id, text, lang); with ``keep_columns`` the columns of ``docs``
    for the rows that are kept.

    base_failed: fewer than ``min_words`` words, or more than ``max_repeat`` per cent of them in 5-word
    windows that the text has twice.  Other rows are kept if they have fewer than ``guard_words`` words,
    or if neither distance to the reference of their language is above its limit and common words are at
    least ``min_common_share`` times and at most its inverse times as frequent as in it.  word_distance is that among the common words, 1 if
    there are none; it does not count for fewer than LEAST_COMMON of them, and it and the share do not count where text and reference both lead to fewer than
    LEAST_COMMON common words, as in languages that COMMON does not have.  A reference is the sum over the
    language, however few its rows, and PRIOR_WORDS words of the sum over all rows; a row whose lang is
    null is compared to the latter.  A null or empty text has no
    words, so it fails.  Rows are judged one by one; rows that repeat get the same result.
    """
    refs, every = references(docs, guard_words)
    text = F.coalesce("row.text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    x = _let(
        F.struct(_words(text).alias("w"), _rare(text).alias("r")),
        lambda t: F.struct(
            F.size(t["w"]).cast("long").alias("n_words"),
            _word_chars(t["w"]).cast("long").alias("word_chars"),
            _number(t["r"], SYMBOLS).cast("long").alias("n_symbols"),
            _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeated_words(t["w"]).cast("long").alias("n_repeat_words"),
            F.array(*_histograms(text, t["r"], t["w"])).alias("h"),
        ),
    )
    rows = docs.select(F.struct(*(docs.columns if keep_columns else [c for c in docs.columns if c in ("doc_id", "text", "lang")])).alias("row"))
    # a row a language: a hash join, unless languages are as many as rows
    rows = rows.select("row", x.alias("x")).join(refs.select(F.col("lang").alias("ref_lang"), F.struct("classes", "words").alias("ref")), F.col("row.lang").cast("string") == F.col("ref_lang"), "left")
    rows = rows.select("row", "x", F.coalesce("ref", every).alias("ref"))
    common = lambda counts: F.slice(counts, 1, len(COMMON))
    total = lambda counts: F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
    hits = F.col("x.n_words") - F.get(F.get("x.h", F.lit(1)), F.lit(len(COMMON)))
    expected = F.col("x.n_words") * total(common(F.col("ref.words"))) / F.greatest(F.lit(1.0), total(F.col("ref.words")))
    class_distance = F.round(_distance(F.get("x.h", F.lit(0)), F.col("ref.classes")), 9)
    word_distance = F.round(_distance(common(F.get("x.h", F.lit(1))), common(F.col("ref.words"))), 9)
    failed = (F.col("x.n_words") < min_words) | (100 * F.col("x.n_repeat_words") > max_repeat * F.col("x.n_words"))
    rows = rows.select("row", "x", failed.alias("base_failed"), class_distance.alias("class_distance"), word_distance.alias("word_distance"), hits.alias("hits"), expected.alias("expected"))
    usual = (F.greatest("hits", "expected") < LEAST_COMMON) | (((F.col("hits") < LEAST_COMMON) | (F.col("word_distance") <= max_word_distance)) & F.col("hits").between(min_common_share * F.col("expected"), F.col("expected") / min_common_share))
    kept = ~F.col("base_failed") & ((F.col("x.n_words") < guard_words) | ((F.col("class_distance") <= max_class_distance) & usual))
    if keep_columns:
        # what depends on a partition's number is not moved below, so nothing is computed twice
        rows = rows.select("row", kept.alias("kept"), F.spark_partition_id().alias("at")).filter(F.col("kept") & (F.col("at") >= 0))
        return rows.select(*(F.col("row")[c].alias(c) for c in docs.columns))
    return rows.select(F.col("row.doc_id").alias("doc_id"), *(F.col(f"x.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", kept.alias("kept"), "class_distance", "word_distance")
