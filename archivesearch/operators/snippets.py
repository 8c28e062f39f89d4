"""Snippets (X5, F23, F24): query-term windows over the content of the hits on a page.

Two strategies (``SearchConfig.snippet_strategy``): ``first`` shows the words around the first hits, ``best`` the
windows that cover most distinct query terms (then most hits, then the earliest), found by a
sliding aggregate over the hit positions.

Only the rows of the returned page reach this step; their content is fetched by a join on
doc_id, which adaptive execution turns into a broadcast of the page where that is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivesearch.functions import present as PR
from archivesearch.functions import text as T
from archivesearch.functions._util import let


def _fragment(words: Column, hits: Column, start_hit: Column, context: int, span: int,
              escape: bool) -> Column:
    lo = F.greatest(start_hit - context, F.lit(1))
    return _rendered(words, hits, lo, F.least(lo + span - 1, F.size(words)), escape)


def _rendered(words: Column, hits: Column, lo: Column, hi: Column, escape: bool) -> Column:
    """The words from place ``lo`` to ``hi``, those at places in ``hits`` marked."""
    idx = F.sequence(lo, hi)

    def render(i):
        w = F.element_at(words, i)
        w = PR.html_escape(w) if escape else w
        return F.when(F.array_contains(hits, i), F.concat(F.lit("<em>"), w, F.lit("</em>"))).otherwise(w)

    return F.array_join(F.transform(idx, render), " ")


def _after(bound: Column):
    return lambda i: i > bound


def snippet_column(content: Column, terms: Column, context: int = 20, length: int = 80,
                   escape: bool = False) -> Column:
    """Up to ``length // (2*context)`` fragments of ``2*context`` words around query hits,
    each followed by the ellipsis span; the fallback (first 500 characters) when no hit.

    The word array and the hit positions are bound once (``let``) and reused.
    """
    span = 2 * context
    n_frag = max(length // span, 1)

    def with_hits(words: Column, hits: Column) -> Column:
        frags = []
        prev_end = F.lit(0)
        for _ in range(n_frag):
            start = F.try_element_at(F.filter(hits, _after(prev_end)), F.lit(1))
            frags.append(F.when(start.isNotNull(), F.concat(
                _fragment(words, hits, start, context, span, escape), F.lit(PR.ELLIPSIS))))
            prev_end = F.coalesce(F.greatest(start - context, F.lit(1)) + span - 1, F.lit(1 << 30))
        return F.when(F.size(hits) > 0, F.concat_ws("", *frags)).otherwise(PR.snippet_fallback(content))

    def with_words(words: Column) -> Column:
        hits = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))),
                        lambda i: F.exists(T.tokens(F.element_at(words, i)),
                                           lambda t: F.array_contains(terms, t)))
        return let(hits, lambda h: with_hits(words, h))

    return let(F.split(F.trim(F.coalesce(content, F.lit(""))), r"\s+"), with_words)


ROW = ["qid", "doc_id"]


def _windows(hits: DataFrame, span: int) -> DataFrame:
    """Of each row's hits ``(qid, doc_id, pos, term)`` the window of ``span`` words that begins at each: distinct terms, hits, last place."""
    w = Window.partitionBy(*ROW).orderBy("pos").rangeBetween(0, span - 1)
    return hits.select(*ROW, "pos", F.size(F.collect_set("term").over(w)).alias("terms"), F.count(F.lit(1)).over(w).alias("n"),
                       F.max("pos").over(w).alias("last")).dropDuplicates([*ROW, "pos"])


def best_windows(hits: DataFrame, sizes: DataFrame, span: int, fragments: int) -> DataFrame:
    """``(qid, doc_id, windows)``: up to ``fragments`` pieces (lo, hi) of at most ``span`` words, in order of the text. A window is chosen by
    (most distinct terms, most hits, earliest), widened evenly to ``span`` words within the ``sizes`` (``n_words``)
    of the texts; the next one is chosen among windows that lie wholly outside those before."""
    left, chosen = _windows(hits, span), None
    for _ in range(fragments):
        best = F.max(F.struct("terms", "n", (-F.col("pos")).alias("at"), "last")).alias("b")
        one = left.groupBy(*ROW).agg(best).select(*ROW, (-F.col("b.at")).alias("pos"), F.col("b.last").alias("last")).join(sizes, ROW)
        lead = F.floor((F.lit(span) - (F.col("last") - F.col("pos") + 1)) / 2).cast("int")
        low = F.greatest(F.lit(1), F.least(F.col("pos") - lead, F.col("n_words") - span + 1))
        one = one.select(*ROW, F.struct(low.alias("lo"), F.least(low + span - 1, F.col("n_words")).alias("hi")).alias("w"))
        chosen = one if chosen is None else chosen.unionByName(one)
        outside = (F.col("pos") > F.col("w.hi")) | (F.col("last") < F.col("w.lo"))
        left = left.join(one, ROW).filter(outside).drop("w")
    return chosen.groupBy(*ROW).agg(F.array_sort(F.collect_list("w")).alias("windows"))


def _apart(windows: Column) -> Column:
    """Windows in order, each beginning after the one before."""
    return F.transform(windows, lambda w, k: F.struct(
        F.when(k > 0, F.greatest(w["lo"], windows[k - 1]["hi"] + 1)).otherwise(w["lo"]).alias("lo"), w["hi"].alias("hi")))


def best_snippets(page: DataFrame, docs: DataFrame, cfg) -> DataFrame:
    """Add ``snippet`` to page rows by the best windows; ``hl_terms`` are the terms of each row's query."""
    span = 2 * cfg.snippet_context
    keys = page.select(*ROW, "hl_terms").dropDuplicates(ROW)
    texts = keys.join(docs.select(F.col("id").alias("doc_id"), "content"), "doc_id")
    texts = texts.select(*ROW, "hl_terms", "content", F.split(F.trim(F.coalesce("content", F.lit(""))), r"\s+").alias("words"))
    asked = keys.select("qid", F.explode("hl_terms").alias("term")).distinct()
    spread = texts.select(*ROW, F.posexplode("words").alias("i", "word")).select(*ROW, (F.col("i") + 1).alias("pos"), F.explode(T.tokens("word")).alias("term"))
    hits = spread.join(asked, ["qid", "term"]).select(*ROW, "pos", "term").distinct()
    windows = best_windows(hits, texts.select(*ROW, F.size("words").alias("n_words")), span, max(cfg.snippet_length // span, 1))
    marks = hits.groupBy(*ROW).agg(F.collect_set("pos").alias("marks"))  # places in one text
    rendered = F.transform(_apart(F.col("windows")), lambda w: F.when(w["lo"] <= w["hi"], F.concat(
        _rendered(F.col("words"), F.col("marks"), w["lo"], w["hi"], cfg.escape_snippets), F.lit(PR.ELLIPSIS))).otherwise(F.lit("")))
    shown = (texts.join(windows, ROW, "left").join(marks, ROW, "left")
             .select(*ROW, F.when(F.col("windows").isNotNull(), F.array_join(rendered, "")).otherwise(PR.snippet_fallback("content")).alias("snippet")))
    return page.join(shown, ROW, "left")


def snippets(page: DataFrame, docs: DataFrame, cfg) -> DataFrame:
    """Add ``snippet`` to page rows (``qid``, ``doc_id``, ``hl_terms``) from the documents' content."""
    if cfg.snippet_strategy not in ("first", "best"):
        raise ValueError("snippet_strategy must be 'first' or 'best'")
    if cfg.snippet_strategy == "best":
        return best_snippets(page, docs, cfg)
    content = docs.select(F.col("id").alias("doc_id"), "content")
    j = page.join(content, "doc_id", "left")
    return j.withColumn("snippet", snippet_column(
        F.col("content"), F.col("hl_terms"), cfg.snippet_context, cfg.snippet_length,
        cfg.escape_snippets)).drop("content")
