"""Batch ranked text search.

A *batch* of queries is a DataFrame (one row per query); one plan answers it:

* match, BM25 and exclusions: one join of the postings with the batch's terms (each with its
  flags and statistics) and one ``groupBy(qid, doc_id)`` with partial aggregation;
* filters: sites and collections are equi-joins on exploded keys, title, type and time are
  predicates beside the document's summary columns. A query without terms starts from its most
  selective filter by equi-join; without any filter it reads only the heads that its page can
  show (P14), computed once per dedup field, never all documents for each query;
* collapse: one window pass over ``(qid, group_key)`` with the batch's constant limit, so Spark
  cuts hot groups map-side (``WindowGroupLimit``). A batch of plain terms is matched, scored and collapsed where the
  documents of a group lie together (``search_groups``). Only the page is stored, never all hits.

Branches that no query of the batch needs (phrases, sites, snippets, ...) are not planned: one
aggregate over the analysed batch says which.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as TT

from archivesearch.functions import present as PR
from archivesearch.functions import text as T
from archivesearch.functions import urls as U
from archivesearch.operators import fields as FD
from archivesearch.operators import filters as FL
from archivesearch.operators.docs import oldest_version
from archivesearch.operators.index import PLACE_BITS, Index, short_numbers
from archivesearch.session import PACKED, small, stored

# Fixed values of the query model.
DEFAULT_MAX_ITEMS = 50
DEFAULT_DEDUP_VALUE = 2
DEFAULT_DEDUP_FIELD = "title"
SITE_SEARCH_DEDUP_FIELD = "url"
# Dedup field (lower-cased) -> document column; anything else -> titleString.
DEDUP_KEYS = {"site": "surtOldest", "surt": "surtOldest", "mimetype": "type", "type": "type",
              "collection": "collection", "title": "titleString"}
# A query that is itself a URL is rejected.
URL_QUERY_RE = r"^\s*(((http|https)://)?([a-zA-Z\d][-\w.]*)\.([a-zA-Z.]{2,6})([-/\w\p{L}.~,;:%&=?!+$#*@()]*)/?)\s*$"
_OFF = "\u0000"  # key prefix of hits that are not collapsed


@dataclass(frozen=True)
class SearchConfig:
    k1: float = 1.2
    b: float = 0.75
    weights: dict = field(default_factory=lambda: {"title": 2.0, "content": 1.0})
    operator: str = "and"           # X2: "and" (default) or "or"
    off_value: int = -1             # W1 (-1) or legacy W3 (0)
    round_digits: int = 6
    require_query: bool = False     # P15: the API's rule, a request without q is refused
    strict: bool = False            # version filter before collapse
    match_fields: tuple[str, ...] | None = None   # P23: match and score only these fields
    with_snippet: bool = True
    snippet_context: int = 20
    snippet_length: int = 80
    escape_snippets: bool = False
    snippet_strategy: str = "first"   # "first" or "best" windows
    endpoints: PR.Endpoints = PR.Endpoints()


QUERY_SCHEMA = TT.StructType([
    TT.StructField("qid", TT.LongType()),
    TT.StructField("q", TT.StringType()),
    TT.StructField("offset", TT.IntegerType()),
    TT.StructField("max_items", TT.IntegerType()),
    TT.StructField("dedup_value", TT.IntegerType()),
    TT.StructField("dedup_field", TT.StringType()),
    TT.StructField("from", TT.StringType()),
    TT.StructField("to", TT.StringType()),
    TT.StructField("type", TT.ArrayType(TT.StringType())),
    TT.StructField("site", TT.ArrayType(TT.StringType())),
    TT.StructField("collection", TT.ArrayType(TT.StringType())),
    TT.StructField("fields", TT.ArrayType(TT.StringType())),
    TT.StructField("title_search", TT.StringType()),
])


def normalize_queries(queries: DataFrame, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """Fill the query model's defaults (Q1) and guard.

    Negative offsets and page sizes count as 0; any page size is honoured. Without a dedup
    field, a search by site is deduplicated by ``url``, any other by ``title``.
    """
    q = queries
    for f in QUERY_SCHEMA.fields:
        if f.name not in q.columns:
            q = q.withColumn(f.name, F.lit(None).cast(f.dataType))
    by_site = F.coalesce(F.size("site"), F.lit(0)) > 0
    q = q.withColumns({
        "offset": F.greatest(F.coalesce(F.col("offset"), F.lit(0)), F.lit(0)).cast("int"),
        "max_items": F.greatest(F.coalesce(F.col("max_items"), F.lit(DEFAULT_MAX_ITEMS)), F.lit(0)).cast("int"),
        "dedup_value": F.coalesce(F.col("dedup_value"), F.lit(DEFAULT_DEDUP_VALUE)).cast("int"),
        "dedup_field": F.coalesce(F.col("dedup_field"), F.when(by_site, F.lit(SITE_SEARCH_DEDUP_FIELD))
                                  .otherwise(F.lit(DEFAULT_DEDUP_FIELD))),
    })
    for name in ("site", "type", "collection", *FD.used(q)):  # an empty list is no filter
        q = q.withColumn(name, F.when(F.size(name) > 0, F.col(name)))
    rejected = F.col("q").isNotNull() & F.col("q").rlike(URL_QUERY_RE)
    missing = F.col("q").isNull() & F.lit(cfg.require_query)
    status = (F.when(rejected, F.lit("rejected_url")).when(missing, F.lit("bad_request")).otherwise(F.lit("ok")))
    message = (F.when(rejected, F.lit("URL queries are answered by the URL search"))
               .when(missing, F.lit("no query terms given")))
    return q.select(*[f.name for f in QUERY_SCHEMA.fields],
                    *[c for c in q.columns if c not in QUERY_SCHEMA.fieldNames()],
                    status.alias("status"), message.alias("message"))


def analyze_queries(queries: DataFrame) -> DataFrame:
    """``terms``, ``phrases`` and ``excludes`` of each query (empty arrays without ``q``),
    its canonical time bounds and the SURT prefixes of its sites, each computed once per query."""
    none = F.array().cast("array<string>")
    return queries.withColumns({
        "terms": F.coalesce(T.query_terms("q"), none),
        "phrases": F.coalesce(T.query_phrases("q"), F.array().cast("array<array<string>>")),
        "excludes": F.coalesce(T.query_excludes("q"), none),
        "lo": FL.canonical_bound("from") if "from" in queries.columns else F.lit(None).cast("string"),
        "hi": FL.canonical_bound("to") if "to" in queries.columns else F.lit(None).cast("string"),
        "prefixes": FL.site_prefixes("site") if "site" in queries.columns else F.lit(None).cast("array<string>"),
        "n_fields": FD.asked_fields(queries),
    })


def dedup_key(name) -> Column:
    """Dedup field -> document column name (as a Column of strings)."""
    n = F.lower(F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit("")))
    m = F.create_map(*[x for k, v in DEDUP_KEYS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[n], F.lit("titleString"))


# ------------------------------------------------------------------ match and score

def _batch_terms(aq: DataFrame, index: Index, cfg: SearchConfig) -> DataFrame:
    """(qid, term, field) of the batch with what a posting of it means: ``required`` (plain
    term), ``excluded``, ``scores``, and the idf and lengths of its field."""
    def rows(column, required, excluded):
        return aq.select("qid", F.explode(column).alias("term"), F.lit(required).alias("required"),
                         F.lit(excluded).alias("excluded"))

    terms = (rows("terms", True, False).unionByName(rows(F.flatten("phrases"), False, False))
             .unionByName(rows("excludes", False, True))
             .groupBy("qid", "term").agg(F.max("required").alias("required"), F.max("excluded").alias("excluded"),
                                         F.max(~F.col("excluded")).alias("scores")))
    weights = F.create_map(*[x for k, v in cfg.weights.items() for x in (F.lit(k), F.lit(float(v)))])
    own = F.col("field").isin(*cfg.match_fields) if cfg.match_fields else F.lit(True)
    idf = F.log(F.lit(1.0) + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # field_stats has one row per indexed field.
    return (terms.join(index.term_stats, "term").join(F.broadcast(index.field_stats), "field")
            .withColumn("excluded", F.col("excluded") & F.col("field").isin("title", "content"))
            .withColumn("required", F.col("required") & own).withColumn("scores", F.col("scores") & own)
            .filter("required or excluded or scores")
            .select("qid", "term", "field", "required", "excluded", "scores", "avg_len",
                    (F.coalesce(weights[F.col("field")], F.lit(1.0)) * idf).alias("weight")))


def match_terms(aq: DataFrame, index: Index, cfg: SearchConfig = SearchConfig(),
                within: DataFrame | None = None) -> DataFrame:
    """J7 + X2 + X4 + P13: ``(qid, doc_id, score)`` of the documents that hold the query terms
    and no excluded term, with BM25 scores.

    ``operator="or"``: any term. ``"and"``: every plain term must occur in some field. The postings
    of the batch's terms, each once and with a number for its term, are dealt out by document; there they meet the batch's terms (a small
    table) and are summed up, so the pairs of queries and documents are never shuffled. ``within`` gives
    the few pairs to look at instead.
    """
    if cfg.operator not in ("and", "or"):
        raise ValueError("operator must be 'and' or 'or'")
    terms = stored(_batch_terms(aq, index, cfg), "terms")
    asked, numbered = _numbered(index, terms)
    if within is None:
        hits = _spread(stored(_by_document(asked), "asked", **PACKED).repartition(_tasks(terms, index), "doc_id"), "doc_id").join(small(numbered), "no")
    else:
        wanted = within.join(small(stored(numbered.groupBy("qid").agg(F.collect_list("no").alias("nos")), "query-terms")), "qid")
        wanted = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("qid", "nos")).alias("w"))  # queries that have a phrase in one document
        pairs = _by_document(asked).join(wanted, "doc_id").withColumn("w", F.explode("w")).withColumns({"qid": F.col("w.qid"), "no": F.explode("w.nos")})
        pairs = pairs.withColumn("at", F.array_position("a_no", F.col("no")).cast("int"))
        found = pairs.filter("at > 0").select("qid", "doc_id", "no", F.element_at("a_tf", F.col("at")).alias("tf"), F.element_at("a_field_len", F.col("at")).alias("field_len"))
        hits = found.join(small(numbered), ["qid", "no"])
    out = _scored(hits, cfg, ["qid", "doc_id"], _bits(numbered) if cfg.operator == "and" else 0)
    if cfg.operator == "and":
        needed = stored(aq.select("qid", F.size("terms").alias("n_required")), "needed")
        out = out.join(small(needed), "qid").filter(F.col("matched") == F.col("n_required"))
        if within is None:
            out = out.filter("n_required > 0")
    return out.select("qid", "doc_id", F.round("raw_score", cfg.round_digits).alias("score"))


#: Pairs of a query term and a posting that one task meets: their groups, held twice while they are summed up, then fit in its memory
#: (110 bytes each). Where groups are ranked too, a group has more pairs, and each task sends the best of every query.
HITS_PER_TASK, RANKED_PER_TASK = 1_000_000, 2_000_000


def _numbered(index: Index, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The postings of a batch's terms, each once, and the batch's terms, both with a number (``no``) in place of term and field. ``bit``
    is the place of a plain term among those of its query, the same in all fields. Both meet postings as broadcasts while the batch is small (``small``)."""
    words = stored(terms.select("term", "field").distinct().withColumn("no", F.monotonically_increasing_id()), "words")
    postings = index.postings.select("term", "field", "doc_id", "tf", "field_len").join(small(words), ["term", "field"])
    own = Window.partitionBy("qid").orderBy("term")  # the terms of one query
    plain = terms.filter("required").select("qid", "term").distinct().withColumn("bit", F.row_number().over(own) - 1)
    numbered = terms.join(words, ["term", "field"]).join(plain, ["qid", "term"], "left")
    kept = [c for c in terms.columns if c not in ("term", "field")]
    return postings.select("doc_id", "no", "tf", "field_len"), stored(numbered.select(*kept, "no", "bit").sort("no", "qid"), "numbered", **PACKED)


def _by_document(asked: DataFrame) -> DataFrame:
    """The asked postings of a document as one row, three lists in the same order. A document lies in one file of the index, so this happens before
    anything is shuffled."""
    return asked.groupBy("doc_id").agg(*[F.collect_list(c).alias(f"a_{c}") for c in ("no", "tf", "field_len")])


def _spread(documents: DataFrame, *keep: str) -> DataFrame:
    """The postings in rows of documents (``_by_document``), a row for each, with the columns ``keep``."""
    a = F.arrays_zip(*[F.col(f"a_{c}").alias(c) for c in ("no", "tf", "field_len")])
    return documents.withColumn("a", F.explode(a)).select(*keep, "a.*")


def _bits(numbered: DataFrame) -> int:
    """How many plain terms the longest query has."""
    return (numbered.agg(F.max("bit")).first()[0] or 0) + 1


def _tasks(terms: DataFrame, index: Index, most: int = HITS_PER_TASK) -> int:
    """In how many parts documents are searched: by the number of hits, from the statistics."""
    hits = terms.join(index.term_stats, ["term", "field"]).agg(F.sum("df")).first()[0] or 0
    return max(int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-hits // most))


#: Plain terms of a query up to which those found are kept as bits of long integers; more are counted as distinct numbers.
MOST_BITS = 512


def _matched(bits: int) -> Column:
    """How many different plain terms were found: a bit for each, so that a group has a few numbers and not a row for each term."""
    if bits > MOST_BITS:
        return F.count_distinct(F.when(F.col("required"), F.col("bit")))
    one = F.expr("shiftleft(1L, bit % 64)")
    held = [F.bit_count(F.coalesce(F.bit_or(F.when(F.col("required") & (F.floor(F.col("bit") / 64) == i), one)), F.lit(0))) for i in range(-(-bits // 64))]
    return reduce(lambda a, b: a + b, held).cast("long")


def _scored(hits: DataFrame, cfg: SearchConfig, by: list[str], bits: int = 0) -> DataFrame:
    """BM25 sum (``raw_score``) and, for conjunctions, number of plain terms (``matched``) of each group; excluded ones left out."""
    norm = F.col("tf") * (cfg.k1 + 1) / (
        F.col("tf") + cfg.k1 * (1 - cfg.b + cfg.b * F.col("field_len") / F.col("avg_len")))
    aggs = [F.sum(F.when(F.col("scores"), F.col("weight") * norm)).alias("raw_score"),
            F.max("excluded").alias("excluded")]
    if cfg.operator == "and":
        aggs.append(_matched(bits).alias("matched"))
    return hits.groupBy(*by).agg(*aggs).filter(~F.col("excluded") & F.col("raw_score").isNotNull())


def phrase_terms(words: DataFrame, index: Index, fields: tuple[str, ...] | None = None) -> DataFrame:
    """What is looked up of the words ``(phrase, place, term)`` of phrases: a pair where two neighbours are common in
    every field searched, and the words that no pair covers."""
    searched = index.field_stats.select("field")
    if fields:
        searched = searched.filter(F.col("field").isin(*fields))
    common = (index.common.join(F.broadcast(searched), "field").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
              .filter(F.col("n") == searched.count()).select("term", F.lit(True).alias("common")))
    w = Window.partitionBy("phrase").orderBy("place")  # the words of one phrase
    marked = words.join(common, "term", "left").withColumn("common", F.coalesce("common", F.lit(False)))
    near = marked.select("phrase", "place", "term", "common", F.lead("term").over(w).alias("next"),
                         F.coalesce(F.lead("common").over(w), F.lit(False)).alias("next_common"),
                         F.coalesce(F.lag("common").over(w), F.lit(False)).alias("last_common"))
    pairs = near.filter("common and next_common").select("phrase", "place", F.concat_ws(" ", "term", "next").alias("term"))
    return near.filter("not common or not (next_common or last_common)").select("phrase", "place", "term").unionByName(pairs)


def match_phrases(aq: DataFrame, index: Index, fields: tuple[str, ...] | None = None) -> DataFrame:
    """``(qid, doc_id)`` of documents holding every phrase of the query.

    Each distinct phrase is searched once, by its links: pairs of neighbouring words. The links of a
    document are found in its own row, from the places of the batch's words; a link of common words is read
    from its list instead. A phrase begins where all its links lie at their places.
    """
    asked = stored(aq.select("qid", F.explode(F.array_distinct(F.transform("phrases", lambda p: F.array_join(p, " ")))).alias("phrase")), "asked-phrases")
    phrases = asked.select("phrase").distinct().withColumn("words", F.split("phrase", " "))
    rest = F.size("words") - 1
    links = stored(phrases.filter("size(words) > 1").select("phrase", rest.alias("n"), F.posexplode(F.transform(
        F.sequence(F.lit(1), rest), lambda i: F.array_join(F.slice("words", i, 2), " "))).alias("place", "link")), "links")
    single = stored(phrases.filter("size(words) = 1").select("phrase", F.col("phrase").alias("term")), "words")
    postings, pairs = index.postings.select("term", "field", "doc_id", "positions"), index.pairs
    if fields:
        postings = postings.filter(F.col("field").isin(*fields))
        pairs = pairs.filter(F.col("field").isin(*fields)) if pairs is not None else None
    found = [postings.join(small(single), "term").select("phrase", "doc_id")] if not single.isEmpty() else []
    sizes = links.agg(F.min("n").alias("a"), F.max("n").alias("b")).first()
    if sizes["a"] == 1:  # two words: any place of the link
        found.append(_places(postings, pairs, links.filter("n = 1"), index, fields, False).select("phrase", "doc_id"))
    if (sizes["b"] or 0) > 1:
        met = _places(postings, pairs, links.filter("n > 1"), index, fields, True)
        begun = met.groupBy("phrase", "n", "doc_id", "field", (F.col("pos") - F.col("place")).alias("start")).agg(F.count(F.lit(1)).alias("found"))
        found.append(begun.filter("found = n").select("phrase", "doc_id"))
    if not found:
        return postings.select(F.lit(0).cast(aq.schema["qid"].dataType).alias("qid"), "doc_id").limit(0)
    whole = len(found) == 1 and pairs is None
    found = reduce(DataFrame.unionByName, found).distinct()
    if not whole:  # parts that do not lie by document: their shuffled rows go before the next ones are
        found = stored(found, "found", **PACKED)
    needed = stored(asked.groupBy("qid").agg(F.count(F.lit(1)).alias("needed")), "needed-phrases")
    return (found.join(small(asked), "phrase").groupBy("qid", "doc_id").agg(F.count(F.lit(1)).alias("n"))
            .join(small(needed), "qid").filter("n = needed").select("qid", "doc_id"))


def _places(postings: DataFrame, pairs: DataFrame | None, links: DataFrame, index: Index, fields: tuple[str, ...] | None, spread: bool) -> DataFrame:
    """Where links stand, those of common words by their lists: a row for each place, or (not ``spread``) also one for each list."""
    words = links.select("link").distinct().select(F.col("link").alias("phrase"), F.posexplode(F.split("link", " ")).alias("place", "term"))
    if pairs is None:
        return _links_met(postings, links, words, index, spread)
    looked = stored(phrase_terms(words, index, fields), "looked")
    listed = looked.filter("phrase = term").select(F.col("term").alias("link"))
    own = pairs.withColumnRenamed("term", "link").join(small(stored(links.join(listed, "link", "left_semi"), "listed")), "link")
    own = own.withColumn("pos", F.explode("positions") if spread else F.lit(None).cast("int"))
    return (_links_met(postings, links, looked.filter("phrase <> term"), index, spread)
            .unionByName(own.select("phrase", "n", "doc_id", "field", "place", "pos")))


def _links_met(postings: DataFrame, links: DataFrame, words: DataFrame, index: Index, spread: bool = True) -> DataFrame:
    """Where the links ``(phrase, n, place, link)`` stand that ``words (phrase, place, term)`` spell, by document and field; not ``spread``: which
    links stand there, without places.

    Field, place and word are one long integer on the way, a link another. The places of a document are a list, made in its file of the index before
    they are shuffled; sorted, words that stand side by side in a field are neighbours in it. What is found stays where the document is.
    """
    names = [r["field"] for r in index.field_stats.select("field").orderBy("field").collect()]  # a row per field
    fields = F.array(*[F.lit(f) for f in names]).cast("array<string>")
    known = stored(words, "link-words")
    wanted = links.join(known.select(F.col("phrase").alias("link")).distinct(), "link", "left_semi")
    numbers, bits = short_numbers(known.select("term").distinct())
    if len(names).bit_length() + PLACE_BITS + bits > 63:  # over 10^8 distinct words in one batch
        raise ValueError(f"words of a batch and fields of the index are too many: {bits} bits and {len(names)} fields")
    for i, side in enumerate("ab"):
        wanted = wanted.withColumn("term", F.split("link", " ")[i]).join(numbers.withColumnRenamed("no", side), "term").drop("term")
    wanted = stored(wanted.select("phrase", "n", "place", F.shiftleft("a", bits).bitwiseOR(F.col("b")).alias("ab")), "wanted-links")
    at = F.shiftleft(F.array_position(fields, F.col("field")), PLACE_BITS)
    rows = postings.join(small(numbers), "term").select("doc_id", at.alias("f"), "no", F.explode("positions").alias("pos"))
    rows = rows.select("doc_id", F.shiftleft(F.col("f").bitwiseOR(F.col("pos").cast("long")), bits).bitwiseOR(F.col("no")).alias("pos_no"))
    rows = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list("pos_no")).alias("s"))  # the asked words of one document
    near = rows.select("doc_id", "s", F.posexplode("s").alias("i", "x")).select("doc_id", "x", F.get("s", F.col("i") + 1).alias("y"))
    near = near.filter(F.shiftright("y", bits) == F.shiftright("x", bits) + 1)
    word = (1 << bits) - 1
    near = near.select("doc_id", F.shiftright("x", bits).alias("at"), F.shiftleft(F.col("x").bitwiseAND(word), bits).bitwiseOR(F.col("y").bitwiseAND(word)).alias("ab"))
    pos = F.col("at").bitwiseAND((1 << PLACE_BITS) - 1).cast("int") if spread else F.lit(None).cast("int")
    return near.join(small(wanted), "ab").select(
        "phrase", "n", "doc_id", F.element_at(fields, F.shiftright("at", PLACE_BITS).cast("int")).alias("field"), "place", pos.alias("pos"))


# ------------------------------------------------------------------ the batch

HAS_TERMS = "(size(terms) > 0 or size(phrases) > 0)"
HAS_FILTER = ("(prefixes is not null or collection is not null or type is not null or title_search is not null"
              " or lo is not null or hi is not null or n_fields > 0)")


def batch_shape(aq: DataFrame, off_value: int = -1) -> Row:
    """One row about the whole (accepted) batch: which branches it needs, its deepest page and
    largest group. Aggregates only, whatever the number of queries."""
    def any_of(condition):
        return F.coalesce(F.max(F.expr(condition)), F.lit(False))

    names = F.collect_set(F.when(F.expr(f"not {HAS_TERMS} and not {HAS_FILTER}"), dedup_key("dedup_field")))
    return aq.filter("status = 'ok'").agg(
        any_of("size(terms) > 0 and size(phrases) = 0").alias("terms"), any_of("size(phrases) > 0").alias("phrases"),
        # Filters that hits must be checked for; hits of queries without terms come from their first one (``FL.filter_only_hits``).
        any_of(f"prefixes is not null and ({HAS_TERMS} or n_fields > 0)").alias("site"),
        any_of(f"collection is not null and ({HAS_TERMS} or n_fields > 0 or prefixes is not null or title_search is not null)").alias("collection"),
        any_of(f"not {HAS_TERMS} and {HAS_FILTER}").alias("filter_only"),
        any_of(f"not {HAS_TERMS} and not {HAS_FILTER}").alias("match_all"),
        any_of("type is not null or title_search is not null or lo is not null or hi is not null").alias("limited"),
        any_of("size(excludes) > 0 and not " + HAS_TERMS).alias("exclude_only"), any_of("n_fields > 0").alias("by_fields"),
        any_of("fields is null or exists(fields, f -> lower(f) = 'snippet')").alias("snippet"),
        (F.count("qid") > F.count_distinct("qid")).alias("repeated"), names.alias("keys"),  # at most the columns of DEDUP_KEYS
        F.coalesce(F.max("dedup_value"), F.lit(1)).alias("dedup"), F.coalesce(F.max(F.col("dedup_value") > off_value), F.lit(False)).alias("collapses"),
        F.coalesce(F.max(F.col("offset").cast("long") + F.col("max_items")), F.lit(0)).alias("depth")).first()


PARAMS = ["offset", "max_items", "dedup_value", "dedup_field", "lo", "hi", "type", "title_search"]


def candidates(aq: DataFrame, docs: DataFrame, versions: DataFrame, index: Index,
               cfg: SearchConfig = SearchConfig(), shape: Row | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """``(qid, doc_id, score)``: matched, phrase-checked, exclusion-filtered, and with score 0
    the documents of filter-only queries, found by their most selective filter: field filters (their
    versions in ``allowed``) before the others."""
    aq = aq.filter("status = 'ok'") if "status" in aq.columns else aq
    shape = shape or Row(terms=True, phrases=True, filter_only=False, exclude_only=False)
    parts = []
    if shape.terms:
        parts.append(match_terms(aq.filter("size(terms) > 0 and size(phrases) = 0"), index, cfg))
    if shape.phrases:
        phrased = aq.filter("size(phrases) > 0")
        parts.append(match_terms(phrased, index, cfg, within=stored(match_phrases(phrased, index, cfg.match_fields), "phrased", **PACKED)))
    if shape.filter_only:
        alone = aq.filter(f"not {HAS_TERMS} and {HAS_FILTER}")
        found = FL.filter_only_hits(alone.filter("n_fields = 0"), docs, versions)
        if allowed is not None:
            found = found.unionByName(allowed.join(alone.select("qid"), "qid").select("qid", "doc_id").distinct())
        found = found.withColumn("score", F.lit(0.0))
        if shape.exclude_only:
            found = found.join(_excluded(aq, index), ["qid", "doc_id"], "left_anti")
        parts.append(found)
    if not parts:
        return docs.sparkSession.createDataFrame([], "qid long, doc_id string, score double")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _excluded(aq: DataFrame, index: Index) -> DataFrame:
    ex = aq.select("qid", F.explode("excludes").alias("term"))
    held = index.postings.filter(F.col("field").isin("title", "content")).select("term", "doc_id")
    return held.join(ex, "term").select("qid", "doc_id").distinct()


_FILTERED = ["titleString", "type", "tstampOldest", "tstampLatest"]  # columns that cheap filters read
SUMMARY_COLS = ["titleString", "type", "tstampOldest", "tstampLatest", "surtOldest", "collection", "site"]


def apply_filters(hits: DataFrame, docs: DataFrame, versions: DataFrame, aq: DataFrame,
                  shape: Row | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """Hits joined with the document summary (``d_`` columns) and their query's
    parameters (``q_``), less those that a filter of the query refuses."""
    d = docs.select(F.col("id").alias("doc_id"), *[F.col(c).alias(f"d_{c}") for c in SUMMARY_COLS if c in docs.columns])
    params = aq.select("qid", *[F.col(c).alias("q_" + c) for c in PARAMS],
                       F.col("prefixes").isNotNull().alias("q_by_site"),
                       F.col("collection").isNotNull().alias("q_by_collection"), (F.col("n_fields") > 0).alias("q_by_fields"))
    j = hits.join(d, "doc_id").join(small(params), "qid")
    if allowed is not None:
        found = allowed.select("qid", "doc_id").distinct().withColumn("in_fields", F.lit(True))
        j = j.join(found, ["qid", "doc_id"], "left").filter("not q_by_fields or in_fields").drop("in_fields")
    for name, wanted, rows in (("site", shape is None or shape.site, FL.site_hits),
                               ("collection", shape is None or shape.collection, FL.collection_hits)):
        if wanted:
            j = (j.join(rows(aq, versions).withColumn("in_" + name, F.lit(True)), ["qid", "doc_id"], "left")
                 .filter(F.expr(f"not q_by_{name} or in_{name}")).drop("in_" + name))
    return j.filter(
        FL.time_overlap("d_tstampOldest", "d_tstampLatest", "q_lo", "q_hi")
        & FL.title_filter("d_titleString", "q_title_search") & FL.type_filter("d_type", "q_type")).drop("q_by_site", "q_by_collection", "q_by_fields")


def group_column(known: list[str], off_value: int = -1) -> Column:
    """The document column that a query (``q_`` columns) collapses by (W2; W3 for legacy); '' while collapsing is off for it, null for a
    column that documents lack. Legacy: the field as given, ``title`` means ``site``; a field that no document has does not collapse."""
    if off_value == 0:
        name = F.when(F.lower("q_dedup_field") == "title", F.lit("site")).otherwise(F.col("q_dedup_field"))
    else:
        name = dedup_key("q_dedup_field")
    off = (F.col("q_dedup_value") < off_value) | (F.col("q_dedup_value") == off_value)
    other = F.lit("") if off_value == 0 else F.lit(None).cast("string")
    return F.when(off, F.lit("")).when(name.isin(*known), name).otherwise(other)


def group_key(hits: DataFrame, off_value: int = -1) -> Column:
    """The collapse key of each hit by its query's ``group_column``, the document's own key while collapsing is off."""
    known = [c for c in SUMMARY_COLS if f"d_{c}" in hits.columns]
    by = group_column(known, off_value)
    key = F.when(by == "", F.concat(F.lit(_OFF), F.col("doc_id")))
    for c in known:
        key = key.when(by == c, F.col(f"d_{c}").cast("string"))
    return key


def short_key(key: Column) -> Column:
    """A key as it is or, where it is longer, by its digest: hits carry it, and a title may be a whole text."""
    return F.when(F.octet_length(key) > 45, F.concat(F.lit("\u0001"), F.base64(F.unhex(F.sha2(key, 256))))).otherwise(key)


def collapse_hits(keyed: DataFrame, max_keep: int, by: tuple[str, ...] = ("qid", "group_key")) -> DataFrame:
    """The best hits of each ``(qid, group_key)`` group with their ``group_rank`` and the group's head (``head_doc`` is null for
    itself): the head and ``N - 1`` more (0 and 1 keep the head). Hits without a key are dropped.
    ``max_keep``, the batch's largest N, is a constant limit that Spark applies before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("doc_id"))
    ranked = keyed.filter(F.col("group_key").isNotNull()).withColumns({
        "group_rank": F.row_number().over(w), "head_score": F.first("score").over(w), "head_doc": F.first("doc_id").over(w)})
    ranked = ranked.withColumn("head_doc", F.when(F.col("group_rank") > 1, F.col("head_doc")))
    return (ranked.filter(F.col("group_rank") <= F.lit(max(1, max_keep)))
            .filter(F.col("group_rank") <= F.greatest("q_dedup_value", F.lit(1))))


COLLAPSED = ["qid", "doc_id", "score", "group_rank", "head_score", "head_doc", "q_offset", "q_max_items"]


def alone(keyed: DataFrame) -> DataFrame:
    """Uncollapsed hits, each its own group."""
    return keyed.withColumns({"group_rank": F.lit(1), "head_score": F.col("score"), "head_doc": F.lit(None).cast("string")})


#: Documents of one group from which on they are dealt out further, and over how many parts.
LARGE_GROUP, GROUP_PARTS = 10_000, 64


def search_groups(aq: DataFrame, docs: DataFrame, index: Index, shape: Row, cfg: SearchConfig) -> DataFrame:
    """Match, score, filter and collapse a batch of term queries (any term) without shuffling its hits.

    What is dealt out are documents with their postings of the batch's terms, a row for each dedup field in use, so that a group of documents
    lies in one part; hits are made, summed and ranked there. Large groups are dealt out further and
    their best hits ranked again. A document without terms of the batch goes nowhere.
    """
    aq = aq.filter("status = 'ok' and size(terms) > 0")
    own = F.concat(F.lit(_OFF), F.col("id"))
    known = [c for c in SUMMARY_COLS if c in docs.columns]
    params = stored(aq.select("qid", *[F.col(c).alias("q_" + c) for c in PARAMS]).withColumn("by", group_column(known, cfg.off_value)), "params")
    kinds = [r["by"] for r in params.select("by").distinct().collect() if r["by"] is not None]  # at most the summary columns
    if not kinds:
        return docs.sparkSession.createDataFrame([], "qid long, doc_id string, score double, group_rank int, head_score double, head_doc string, q_offset int, q_max_items int")
    terms = stored(_batch_terms(aq, index, cfg).join(params.select("qid", "by").distinct(), "qid"), "terms")
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("by"), (short_key(F.col(k).cast("string")) if k else own).alias("group_key")) for k in kinds])).alias("k")
    read = _FILTERED if shape.limited else []
    units = docs.select(F.col("id").alias("doc_id"), *[F.col(c).alias(f"d_{c}") for c in read], keys)
    units = units.select("doc_id", *[f"d_{c}" for c in read], "k.by", "k.group_key").filter("group_key is not null")
    large = units.filter("by <> ''").groupBy("by", "group_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LARGE_GROUP)
    large = stored(large.select("by", "group_key", F.lit(True).alias("large")), "large")
    some = not large.isEmpty()
    place = ["group_key"]
    if some:
        place = ["group_key", "part"]
        part = F.when(F.col("large"), F.pmod(F.xxhash64("doc_id"), F.lit(GROUP_PARTS)) + 1).otherwise(0)
        units = units.join(small(large), ["by", "group_key"], "left").withColumn("part", part).drop("large")
    asked, numbered = _numbered(index, terms)
    dealt = _by_document(asked).join(units, "doc_id").repartition(_tasks(terms, index, RANKED_PER_TASK), *place)
    hits = _spread(dealt, *units.columns).join(small(numbered), ["no", "by"])
    limits = small(params.drop("by"))
    if shape.limited:
        hits = hits.join(small(params.drop("by").distinct()), "qid").filter(
            FL.time_overlap("d_tstampOldest", "d_tstampLatest", "q_lo", "q_hi")
            & FL.title_filter("d_titleString", "q_title_search") & FL.type_filter("d_type", "q_type"))
    scored = _scored(hits, cfg, ["qid", "by", *place, "doc_id"])
    scored = scored.withColumn("score", F.round("raw_score", cfg.round_digits)).join(limits, "qid")
    found = []
    single = "by = ''" if not shape.repeated else "false"
    if "" in kinds and not shape.repeated:
        found.append(alone(scored.filter(single)))
    if kinds != [""] or shape.repeated:
        near = collapse_hits(scored.filter(f"not ({single})"), shape.dedup, ("qid", *place))
        found.append(near.filter("part = 0") if some else near)
        if some:
            found.append(collapse_hits(near.filter("part > 0").drop("group_rank", "head_score", "head_doc"), shape.dedup))
    return reduce(DataFrame.unionByName, [f.select(*COLLAPSED) for f in found])


def match_all_groups(aq: DataFrame, docs: DataFrame, index: Index, shape: Row, cfg: SearchConfig) -> tuple[DataFrame, DataFrame]:
    """Page rows and group counts of queries without terms and filters.

    All documents match with score 0, so groups and their order (by doc_id) depend on the
    dedup field alone: they are computed once per field in use (at most the few of W2), and
    only down to the batch's deepest page.
    """
    plain = aq.filter(f"status = 'ok' and not {HAS_TERMS} and not {HAS_FILTER}")
    off = (F.col("dedup_value") <= cfg.off_value)
    asked = plain.select("qid", "offset", "max_items", "dedup_value", F.when(off, F.lit("")).otherwise(
        dedup_key("dedup_field")).alias("by"))
    kinds = [F.struct(F.lit("").alias("by"), F.concat(F.lit(_OFF), F.col("id")).alias("group_key"))]
    kinds += [F.struct(F.lit(c).alias("by"), F.col(c).alias("group_key")) for c in sorted(shape["keys"])]
    keyed = (docs.select(F.col("id").alias("doc_id"), F.explode(F.array(*kinds)).alias("k"))
             .select("doc_id", "k.by", "k.group_key").filter("group_key is not null"))
    counts = (keyed.groupBy("by", "group_key").agg(F.lit(1).alias("one")).groupBy("by")
              .agg(F.count(F.lit(1)).alias("groups")))
    inside = Window.partitionBy("by", "group_key").orderBy("doc_id")
    members = (keyed.withColumn("group_rank", F.row_number().over(inside))
               .filter(F.col("group_rank") <= F.lit(max(1, shape.dedup))))
    order = Window.partitionBy("by").orderBy("doc_id")
    heads = (members.filter("group_rank = 1").withColumn("rank", F.row_number().over(order))
             .filter(F.col("rank") <= F.lit(shape.depth)).select("by", "group_key", "rank"))
    page = (members.join(heads, ["by", "group_key"]).join(asked, "by")
            .filter("rank > offset and rank <= offset + max_items and group_rank <= greatest(dedup_value, 1)"))
    return (page.select("qid", "doc_id", F.lit(0.0).alias("score"), "rank", "group_rank"),
            asked.join(counts, "by", "left").select("qid", F.coalesce("groups", F.lit(0)).alias("estimated_results")))


def page_hits(collapsed: DataFrame, depth: int) -> DataFrame:
    """T2 + W4: the groups whose heads rank ``offset+1 .. offset+max_items`` in their query by (score desc, doc_id), members
    with the head's rank. ``depth``, the batch's deepest page, is a constant limit that Spark applies before the shuffle."""
    w = Window.partitionBy("qid").orderBy(F.desc("head_score"), F.asc(F.coalesce("head_doc", "doc_id")))
    return (collapsed.withColumn("rank", F.dense_rank().over(w)).filter(F.col("rank") <= F.lit(depth))
            .filter("rank > q_offset and rank <= q_offset + q_max_items"))


def group_counts(collapsed: DataFrame) -> DataFrame:
    """A5: groups found per query."""
    return collapsed.filter("group_rank = 1").groupBy("qid").agg(F.count(F.lit(1)).alias("estimated_results"))


def page_summary(counts: DataFrame, aq: DataFrame) -> DataFrame:
    """A5 + T3 + T4: per query (refused ones too): groups found, heads on the page, last page,
    page links, status and message."""
    s = aq.select("qid", "offset", "max_items", "status", "message").join(counts, "qid", "left")
    est = F.coalesce(F.col("estimated_results"), F.lit(0)).cast("long")
    end = F.col("offset").cast("long") + F.col("max_items")
    last = est <= end
    return s.select(
        "qid", est.alias("estimated_results"),
        F.greatest(F.least(est - F.col("offset"), F.col("max_items").cast("long")), F.lit(0)).alias("number_results"),
        last.alias("last_page"), F.when(~last, end).alias("next_offset"),
        F.when(F.col("offset") != 0, F.greatest(F.col("offset") - F.col("max_items"), F.lit(0))).alias("previous_offset"),
        "status", "message")


def version_filtered(rows: DataFrame, versions: DataFrame, aq: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """P10 + P11 + A7: rows ``(qid, doc_id, ...)`` with the ``oldest`` of the document's versions
    that pass the query's exact filters (field filters: those in ``allowed``); rows left without a version go."""
    params = aq.select("qid", "lo", "hi", F.col("collection").alias("wanted"), "prefixes", "n_fields")
    keys = rows.select("qid", "doc_id").distinct()
    kept = (keys.join(params, "qid").join(versions, "doc_id")
            .filter(FL.version_keeps("tstamp", "surt", "collection", "lo", "hi", "prefixes", "wanted")))
    if allowed is not None:
        kept = (kept.withColumn("version", FD.version_key()).join(allowed.withColumn("passes", F.lit(True)), ["qid", "doc_id", "version"], "left")
                .filter("n_fields = 0 or passes"))
    return rows.join(oldest_version(kept, ["qid", "doc_id"]), ["qid", "doc_id"])


def distinct_requests(aq: DataFrame, off_value: int = -1) -> tuple[DataFrame, DataFrame | None]:
    """Queries that ask for the same are searched once: the queries to search, and ``(asked, qid, copies)``, whose answer each query gets
    how often (null if no two are equal). The hits of a batch then do not grow with the square of the queries that share a request.

    A qid in several rows keeps them as they are, unless they are equal and not collapsed (rows of a group are ranked with
    their copies)."""
    names = [f.name for f in QUERY_SCHEMA.fields if f.name != "qid"] + FD.used(aq)
    request = F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)
    keyed = aq.filter("status = 'ok' and qid is not null").withColumn("request", request)
    seen = keyed.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("request").alias("k")).first()
    if seen["n"] == seen["k"]:
        return aq, None
    plain = F.max((F.col("dedup_value") <= off_value) & F.expr(f"{HAS_TERMS} or {HAS_FILTER}"))
    own = keyed.groupBy("qid").agg(F.min("request").alias("request"), F.count(F.lit(1)).alias("rows"), F.count_distinct("request").alias("k"), plain.alias("plain"))
    own = stored(own.select("qid", "request", F.col("rows").cast("int").alias("copies"), F.expr("k = 1 and (rows = 1 or plain)").alias("shared")), "requests")
    first = own.filter("shared").groupBy("request").agg(F.min("qid").alias("asked"))
    turns = own.filter("shared").join(first, "request").select("asked", "qid", "copies")
    turns = stored(turns.unionByName(own.filter("not shared").select(F.col("qid").alias("asked"), "qid", F.lit(1).alias("copies"))), "turns")
    chosen = own.join(turns.filter("asked = qid").select("qid"), "qid", "left_semi").select("qid", "shared")
    kept = aq.filter("status = 'ok'").join(chosen, "qid")
    kept = kept.filter("shared").dropDuplicates(["qid"]).unionByName(kept.filter("not shared")).select(*aq.columns)
    return stored(kept, "asked"), turns


# Reply fields that ``fields`` of a query selects (P16); the keys of a row are always there.
ROW_KEYS = ["qid", "rank", "group_rank", "doc_id", "score"]


def present_results(page: DataFrame, docs: DataFrame, versions: DataFrame, aq: DataFrame,
                    cfg: SearchConfig = SearchConfig(), with_snippet: bool = True, allowed: DataFrame | None = None) -> DataFrame:
    """Reply fields of each surviving hit (oldest version -> URL, time, links);
    fields that its query did not ask for are null. Of documents and versions only those on the ``page`` (a stored table) are shuffled."""
    from archivesearch.operators.snippets import snippets

    shown = small(page.select("doc_id"))
    docs = docs.join(shown.withColumnRenamed("doc_id", "id"), "id", "left_semi")
    versions = versions.join(shown, "doc_id", "left_semi")
    r = version_filtered(page, versions, aq, allowed)
    r = r.join(docs.select(F.col("id").alias("doc_id"), "titleString", "type"), "doc_id")
    r = r.withColumns({
        "originalURL": U.surt_to_url(F.col("oldest.surt")),
        "tstamp": F.col("oldest.tstamp"),
        "collection": F.col("oldest.collection"),
    })
    r = PR.with_links(r, "originalURL", "tstamp", cfg.endpoints)
    out = r.select(
        *ROW_KEYS,
        F.coalesce(F.col("titleString"), F.lit("")).alias("title"),
        "originalURL",
        F.coalesce(F.col("type"), F.lit("")).alias("mimeType"),
        F.col("tstamp").cast("long").alias("tstamp"),
        F.col("doc_id").alias("digest"),
        "collection",
        F.col("doc_id").alias("id"),
        *PR.link_columns("originalURL", "tstamp", cfg.endpoints).keys(),
    )
    asked = F.when(F.size("fields") > 0, F.transform("fields", lambda f: F.lower(f)))
    terms = aq.select("qid", asked.alias("q_fields"),
                      F.array_distinct(F.concat("terms", F.flatten("phrases"))).alias("hl_terms"))
    out = out.join(terms, "qid")
    if with_snippet:
        out = snippets(out, docs, cfg)
    replies = [c for c in out.columns if c not in (*ROW_KEYS, "hl_terms", "q_fields")]
    return out.select(*ROW_KEYS, *[
        F.when(F.col("q_fields").isNull() | F.array_contains("q_fields", c.lower()), F.col(c)).alias(c) for c in replies])


def page_search(queries: DataFrame, docs: DataFrame, versions: DataFrame, index: Index,
                cfg: SearchConfig = SearchConfig(), keys: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A batch of text searches -> ``(results, summary)``. ``keys``: the stored keys of field filters, for batches that use some.

    Order as in the reference: analyse -> match -> exclude -> score -> coarse filters ->
    collapse -> count -> page -> exact version filter -> oldest version -> snippet/links.
    With ``cfg.strict`` the exact version filter runs before the collapse.
    """
    batch = stored(analyze_queries(normalize_queries(queries, cfg)), "queries")
    shape = batch_shape(batch, cfg.off_value)
    aq, turns = distinct_requests(batch, cfg.off_value)
    allowed = None
    if shape.by_fields:
        if keys is None:
            raise ValueError(f"the batch uses the field filters {FD.used(aq)}, but no keys are given")
        allowed = stored(FD.matching_versions(aq.filter("status = 'ok'"), keys), "allowed")
    if (shape.terms and cfg.operator == "or" and not cfg.strict
            and not (shape.phrases or shape.filter_only or shape.site or shape.collection or shape.by_fields)):
        collapsed = search_groups(aq, docs, index, shape, cfg)
    else:
        hits = candidates(aq, docs, versions, index, cfg, shape, allowed)
        filtered = apply_filters(hits, docs, versions, aq, shape, allowed)
        if cfg.strict:
            filtered = version_filtered(filtered, versions, aq, allowed).drop("oldest")
        keyed = filtered.withColumn("group_key", group_key(filtered, cfg.off_value))
        off = F.col("group_key").startswith(_OFF) & F.lit(not shape.repeated)
        collapsed = alone(keyed.filter(off)).select(*COLLAPSED)
        if shape.collapses or shape.repeated:
            collapsed = collapsed.unionByName(collapse_hits(keyed.filter(~off), shape.dedup).select(*COLLAPSED))
    page = page_hits(collapsed, shape.depth).select("qid", "doc_id", "score", "rank", "group_rank")
    counts = group_counts(collapsed)
    if shape.match_all:
        more, more_counts = match_all_groups(aq, docs, index, shape, cfg)
        page, counts = page.unionByName(more), counts.unionByName(more_counts)
    page = stored(page, "page")
    results = present_results(page, docs, versions, aq, cfg, cfg.with_snippet and shape.snippet, allowed)
    if turns is not None:
        counts = counts.withColumnRenamed("qid", "asked").join(turns, "asked").select("qid", "estimated_results")
        results = (results.withColumnRenamed("qid", "asked").join(turns, "asked")
                   .withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*results.columns))
    return results, page_summary(counts, batch)
