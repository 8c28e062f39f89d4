"""Inverted index over version documents (X1, X7), stored as Parquet tables.

``postings(term, field, doc_id, tf, positions, field_len)`` is built within the row of each
document: its tokens are sorted there and cut into one entry for each distinct term, so neither texts
nor token rows are shuffled. The index is divided by documents, as search engines do: a file holds
all postings of its documents, in order of ``(term, doc_id)`` for pruning, and no file grows
with a frequent term. The statistics are aggregates over the stored postings.

With ``common_share`` the index also holds postings of pairs: where two terms that more than this share of the
documents of a field hold stand side by side, the pair is a term of its own (X7). A phrase then
reads the list of the pair instead of the two very long lists. There are few common terms: at most the average number of
distinct terms of a document, divided by the share.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivesearch.functions import text as T
from archivesearch.session import PACKED, path_exists, small, stored, write_table

# Fields indexed by default and the document column holding each.
DEFAULT_FIELDS = {"title": "titleString", "content": "content"}
# Optional stop-terms for the url field (X7): very common URL n-grams are not indexed.
URL_STOP_TERMS = ("http", "https", "www", "com", "org", "net", "html", "htm", "index", "php")
#: Bits of a place in a field (an int) where it is packed with other numbers into one long integer.
PLACE_BITS = 31


@dataclass(frozen=True)
class Index:
    postings: DataFrame     # term, field, doc_id, tf, positions, field_len
    term_stats: DataFrame   # term, field, df
    field_stats: DataFrame  # field, n_docs, avg_len
    pairs: DataFrame | None = None    # pairs of common terms: term ("a b"), field, doc_id, positions
    common: DataFrame | None = None   # term, field

    @staticmethod
    def read(spark, path: str) -> "Index":
        names = ["postings", "term_stats", "field_stats"]
        if path_exists(spark, f"{path}/pairs/_SUCCESS"):
            names += ["pairs", "common"]
        return Index(*(spark.read.parquet(f"{path}/{n}") for n in names))


def field_tokens(docs: DataFrame, fields: dict[str, str] | None = None,
                 url_stop_terms: tuple[str, ...] | None = None) -> DataFrame:
    """One row per ``(doc_id, field)`` with its token array (whole texts, no cap)."""
    fields = fields or DEFAULT_FIELDS
    per_field = [
        F.struct(F.lit(f).alias("field"), T.tokens(F.coalesce(F.col(c), F.lit(""))).alias("toks"))
        for f, c in fields.items()
    ]
    out = docs.select(F.col("id").alias("doc_id"), F.explode(F.array(*per_field)).alias("f"))
    out = out.select("doc_id", F.col("f.field").alias("field"), F.col("f.toks").alias("toks"))
    if url_stop_terms and "url" in fields:
        stop = F.array(*[F.lit(t) for t in url_stop_terms])
        out = out.withColumn("toks", F.when(F.col("field") == "url", F.filter(
            "toks", lambda t: ~F.array_contains(stop, t))).otherwise(F.col("toks")))
    return out


def _one_row_per_field(docs: DataFrame, fields: dict[str, str] | None, url_stop_terms: tuple[str, ...] | None) -> DataFrame:
    """``(doc_id, field, toks, at)``: the tokens of a field and their places; rows that share an id are one document."""
    ft = field_tokens(docs, fields, url_stop_terms).withColumn("at", F.transform("toks", lambda t, i: i))
    if docs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return ft
    return ft.groupBy("doc_id", "field").agg(F.flatten(F.collect_list("toks")).alias("toks"), F.flatten(F.collect_list("at")).alias("at"))


def _entries(rows: DataFrame, toks: Column, at: Column, *keep: Column | str) -> DataFrame:
    """A row for each distinct term of the tokens ``toks`` at the places ``at``: ``term`` and its sorted ``positions``, beside the columns ``keep``. Rows
    without tokens stay, as a null term without places. The tokens are sorted and cut within their row. ``sort_array``, not ``array_sort``: that one
    calls an interpreted function for each comparison."""
    def begins(s: Column) -> Column:
        term = lambda k: F.get(s, k)["term"]
        return F.when(F.size(s) > 0, F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: (k == 0) | (term(k) != term(k - 1))))

    rows = rows.select(*keep, F.sort_array(F.arrays_zip(toks.alias("term"), at.alias("pos"))).alias("s"))
    kept = rows.columns[:-1]
    rows = rows.select(*kept, "s", begins(F.col("s")).alias("b"))
    rows = rows.select(*kept, "s", "b", F.posexplode_outer("b").alias("j", "k"))  # the place of a term among the distinct ones, and where it begins
    places = F.slice("s", F.col("k") + 1, F.coalesce(F.get("b", F.col("j") + 1), F.size("s")) - F.col("k"))["pos"]
    return rows.select(*kept, F.get("s", F.col("k"))["term"].alias("term"), F.coalesce(places, F.array().cast("array<int>")).alias("positions"))


def build_index(docs: DataFrame, path: str, fields: dict[str, str] | None = None,
                url_stop_terms: tuple[str, ...] | None = None, partitions: int | None = None,
                common_share: float | None = None) -> Index:
    """Write postings with positions and the term and field statistics under ``path``; with ``common_share`` pairs
    of common terms too."""
    spark = docs.sparkSession
    # A document without tokens in a field keeps a row (term null), so that it counts as a document.
    ft = _one_row_per_field(docs, fields, url_stop_terms)
    if partitions:
        ft = ft.repartition(partitions, "doc_id")
    rows = _entries(ft, F.col("toks"), F.col("at"), "doc_id", "field", F.size("toks").alias("field_len"))
    postings = rows.select("term", "field", "doc_id", F.size("positions").alias("tf"), "positions", "field_len")
    write_table(postings.sortWithinPartitions("term", "doc_id"), f"{path}/postings", **PACKED)
    kept = spark.read.parquet(f"{path}/postings")
    write_table(kept.filter("term is not null").groupBy("term", "field").agg(F.count(F.lit(1)).alias("df")), f"{path}/term_stats", **PACKED)
    # Every token of a document's field lies in one of its postings.
    per_doc = kept.groupBy("doc_id", "field").agg(F.max("field_len").alias("field_len"))
    write_table(per_doc.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("field_len").alias("avg_len")), f"{path}/field_stats")
    if common_share is not None:
        _write_pairs(ft, Index.read(spark, path), path, common_share)
    return Index.read(spark, path)


def add_pairs(docs: DataFrame, index: Index, path: str, common_share: float, fields: dict[str, str] | None = None,
              url_stop_terms: tuple[str, ...] | None = None) -> Index:
    """The index of ``docs`` with pairs of common terms, written under ``path``; its postings and statistics stay where they are."""
    _write_pairs(_one_row_per_field(docs, fields, url_stop_terms), index, path, common_share)
    read = docs.sparkSession.read.parquet
    return replace(index, pairs=read(f"{path}/pairs"), common=read(f"{path}/common"))


def short_numbers(words: DataFrame) -> tuple[DataFrame, int]:
    """``words (term)`` with a number (``no``) in their order, and how many bits the numbers take. Spark's own numbers begin anew at a multiple
    of 2^33 in each part; here all parts count as long as the longest."""
    kept = stored(words.orderBy("term").withColumn("id", F.monotonically_increasing_id()), "numbers")
    part, place = F.shiftright("id", 33), F.col("id").bitwiseAND((1 << 33) - 1)
    last = kept.agg(F.max(part).alias("part"), F.max(place).alias("place")).first()
    longest = (last["place"] or 0) + 1
    return kept.select("term", (part * longest + place).alias("no")), max(1, (((last["part"] or 0) + 1) * longest - 1).bit_length())


def _write_pairs(ft: DataFrame, index: Index, path: str, share: float) -> None:
    """Postings of neighbouring common terms. A common word of a document and its place are one long integer on the way; the words of a document are one
    row, in which neighbours meet."""
    spark = ft.sparkSession
    stats = index.term_stats.join(F.broadcast(index.field_stats), "field")  # a row per field
    write_table(stats.filter(F.col("df") > share * F.col("n_docs")).select("term", "field"), f"{path}/common")
    common = spark.read.parquet(f"{path}/common")
    numbers, bits = short_numbers(common.select("term").distinct())
    numbered = stored(common.join(numbers, "term"), "common-numbers")
    words = ft.filter("size(toks) > 1").select("doc_id", "field", F.posexplode("toks").alias("pos", "term")).join(small(numbered), ["term", "field"])
    words = words.select("doc_id", "field", F.shiftleft(F.col("pos").cast("long"), bits).bitwiseOR(F.col("no")).alias("pos_no"))
    rows = words.groupBy("doc_id", "field").agg(F.sort_array(F.collect_list("pos_no")).alias("s"))
    place, no = (lambda k: F.shiftright(F.get("s", k), bits)), (lambda k: F.get("s", k).bitwiseAND((1 << bits) - 1))
    near = rows.filter("size(s) > 1").select("doc_id", "field", "s", F.filter(
        F.sequence(F.lit(0), F.size("s") - 2), lambda k: place(k + 1) == place(k) + 1).alias("at"))
    near = near.filter("size(at) > 0").select("doc_id", "field", F.transform("at", lambda k: F.shiftleft(no(k), bits).bitwiseOR(no(k + 1))).alias("ab"),
                                              F.transform("at", lambda k: place(k).cast("int")).alias("pos"))
    pairs = _entries(near, F.col("ab"), F.col("pos"), "field", "doc_id").withColumns({
        "a": F.shiftright("term", bits), "b": F.col("term").bitwiseAND((1 << bits) - 1)})
    for side in "ab":
        pairs = pairs.join(small(numbers.select(F.col("no").alias(side), F.col("term").alias(f"word_{side}"))), side)
    pairs = pairs.select(F.concat_ws(" ", "word_a", "word_b").alias("term"), "field", "doc_id", "positions")
    write_table(pairs.sortWithinPartitions("term", "doc_id"), f"{path}/pairs", **PACKED)
