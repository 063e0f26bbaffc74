"""Hybrid retrieval for batches of queries: rank fusion, filters after fusion, duplicate folding and diversity.

Pools are cut before filters on purpose: a selective filter may leave fewer than k results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import language_hint, normalize_search, strip_stopwords
from .common import cut

RRF_K = 60
PER_DOC = 2
MOST_HITS, QUERY_CHARS = 10, 500


def fuse(keyword: DataFrame, vector: DataFrame) -> DataFrame:
    """(qid, pid, score, fts_rank, vec_rank, rank from 0): weighted reciprocal ranks; keyword terms are weighed by their share of the query's best BM25.

    One union and one aggregation instead of an outer join; a side's ranks are null where it hasn't the passage.
    """
    best = F.min("score").over(W.partitionBy("qid"))
    strength = F.when(F.coalesce(best, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("score") / best)
    words = keyword.select("qid", "pid", (strength / (RRF_K + F.col("rank"))).alias("part"), F.col("rank").alias("fts_rank"), F.lit(None).cast("int").alias("vec_rank"))
    near = vector.select("qid", "pid", (F.lit(1.0) / (RRF_K + F.col("rank"))).alias("part"), F.lit(None).cast("int").alias("fts_rank"), F.col("rank").alias("vec_rank"))
    # Both sides are parted by query, and Spark puts no exchange above a union of such sides; folded hits had doubled rows without parting them anew.
    both = words.unionByName(near).repartition("qid").groupBy("qid", "pid").agg(F.round(F.sum("part"), 12).alias("score"), F.max("fts_rank").alias("fts_rank"), F.max("vec_rank").alias("vec_rank"))
    order = W.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("fts_rank"), F.asc_nulls_last("vec_rank"))
    # Written, since folding reads it twice.
    return cut(both.withColumn("rank", F.row_number().over(order) - 1))


def search_filter(doc_ids: list | None = None, region: str | None = None, topic: str | None = None, lang: str | None = None) -> Column:
    """Conjunction of the given filters; empty lists and strings don't filter. Region and topic ignore case, null counts as empty."""
    out = F.lit(True)
    if doc_ids:
        out = out & F.col("doc_id").isin(list(doc_ids))
    for name, value in (("region", region), ("topic", topic)):
        if value:
            out = out & (F.lower(F.coalesce(F.col(name), F.lit(""))) == value.lower())
    return out & (F.col("lang") == lang) if lang else out


def fold_duplicates(hits: DataFrame, content: str = "content_hash", label: str = "label") -> DataFrame:
    """Best hit of each content and query; ``alternates`` has the labels of the others in rank order. Hits without content stay by themselves."""
    key = F.coalesce(F.col(content).cast("string"), F.concat(F.lit("\x00"), F.col("pid").cast("string")))
    rows = hits.withColumn("_key", key)
    others = rows.groupBy("qid", "_key").agg(F.sort_array(F.collect_list(F.struct("rank", label))).alias("_all"))
    first = rows.withColumn("_n", F.row_number().over(W.partitionBy("qid", "_key").orderBy("rank"))).where("_n = 1").drop("_n")
    joined = first.join(others, ["qid", "_key"])
    return joined.withColumn("alternates", F.transform(F.slice("_all", 2, F.size("_all")), lambda x: x[label])).drop("_all", "_key")


def diverse(hits: DataFrame, k: int = 5, per_doc: int = PER_DOC) -> DataFrame:
    """The first k by rank with at most ``per_doc`` of one document, refilled by the skipped ones: order by (over the cap, rank)."""
    in_doc = F.row_number().over(W.partitionBy("qid", "doc_id").orderBy("rank"))
    over = hits.withColumn("_over", (in_doc > per_doc).cast("int"))
    place = F.row_number().over(W.partitionBy("qid").orderBy("_over", "rank"))
    return over.withColumn("place", place).where(F.col("place") <= k).drop("_over")


def expand_aliases(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(qid, terms): alias terms of a query. ``aliases`` (key, terms) of one word match a whole word, longer ones a substring of the query.

    Single words meet by an equi-join. Phrases meet by their first word and are then held against the query.
    """
    words = queries.select("qid", "query", F.explode(F.array_distinct(F.split("query", " "))).alias("_w")).where("_w != ''")
    keys = aliases.where("length(key) > 0").select("key", "terms", F.split_part("key", F.lit(" "), F.lit(1)).alias("_w"))
    # A phrase may begin within a word, so its first word is a suffix of one of the query's words.
    single = words.join(keys.where(~F.contains("key", F.lit(" "))), "_w")
    suffix = words.withColumn("_w", F.explode(F.transform(F.sequence(F.lit(1), F.length("_w")), lambda i: F.substr("_w", i)))).distinct()
    phrase = suffix.join(keys.where(F.contains("key", F.lit(" "))), "_w").where(F.contains("query", F.col("key")))
    return single.select("qid", "key", "terms").unionByName(phrase.select("qid", "key", "terms")).distinct()


def hybrid(passages: DataFrame, keyword: DataFrame, vector: DataFrame, where: Column | None = None, k: int = 5) -> DataFrame:
    """Fusion, filter, folding and diversity over passages (pid, doc_id, content_hash, label, ...)."""
    hits = fuse(keyword, vector).join(passages, "pid")
    return diverse(fold_duplicates(hits.where(where) if where is not None else hits), k)


def glossary(aliases: DataFrame) -> DataFrame:
    """(key, terms) as they are held against queries: keys and terms normalized, keys that begin with an underscore are notes."""
    rows = aliases.where(~F.col("key").startswith("_"))
    return rows.select(normalize_search(F.col("key")).alias("key"), F.transform("terms", normalize_search).alias("terms"))


def asked(queries: DataFrame, aliases: DataFrame, hints: dict[str, str] | None = None) -> DataFrame:
    """Queries (qid, query, and lang, region, topic, doc_ids, k as they are given) with what the keyword side searches for.

    ``bag``: the normalized query without stop words, and the terms of the aliases it names (a term that comes twice counts
    twice). ``lang`` is the one asked for, else the one that the query hints at (``hinted``). ``expansions``: the aliases' keys.
    """
    normal = queries.withColumn("_normal", normalize_search(F.substr("query", F.lit(1), F.lit(QUERY_CHARS))))
    applied = expand_aliases(normal.select("qid", F.col("_normal").alias("query")), aliases)
    applied = applied.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("key", "terms"))).alias("_all"))
    hint = language_hint(F.col("query"), hints)
    rows = normal.join(applied, "qid", "left").withColumn("hinted", F.col("lang").isNull() & hint.isNotNull())
    extra = F.array_join(F.flatten(F.transform(F.coalesce("_all", F.array().cast("array<struct<key:string,terms:array<string>>>")), lambda x: x["terms"])), " ")
    keys = F.transform(F.coalesce("_all", F.array().cast("array<struct<key:string,terms:array<string>>>")), lambda x: x["key"])
    bag = F.trim(F.concat(strip_stopwords(F.col("_normal")), F.lit(" "), extra))
    return rows.select(*[c for c in queries.columns if c != "lang"], F.coalesce("lang", hint).alias("lang"), "hinted", bag.alias("bag"), keys.alias("expansions"))


def own_filters() -> Column:
    """As ``search_filter``, with each query's own parameters (columns asked_lang, asked_region, asked_topic, asked_docs) beside the passage's."""
    given = lambda name: F.length(F.coalesce(F.col(name), F.lit(""))) > 0
    same = lambda name: F.lower(F.coalesce(F.col(name), F.lit(""))) == F.lower(f"asked_{name}")
    out = (F.coalesce(F.size("asked_docs"), F.lit(0)) <= 0) | F.array_contains("asked_docs", F.col("doc_id"))
    for name in ("region", "topic"):
        out = out & (~given(f"asked_{name}") | same(name))
    return out & (~given("asked_lang") | F.coalesce(F.col("lang") == F.col("asked_lang"), F.lit(False)))


def search(queries: DataFrame, passages: DataFrame, keyword: DataFrame, vector: DataFrame) -> DataFrame:
    """Hits (qid, place, and the passage's columns, alternates) of a batch of ``asked`` queries, each with its own filters and k.

    ``keyword`` and ``vector`` are the ranked pools: filters come after they are cut.
    """
    own = queries.select("qid", F.col("lang").alias("asked_lang"), F.col("region").alias("asked_region"), F.col("topic").alias("asked_topic"), F.col("doc_ids").alias("asked_docs"), "k")
    hits = fuse(keyword, vector).join(passages, "pid").join(own, "qid").where(own_filters()).drop("asked_lang", "asked_region", "asked_topic", "asked_docs")
    return diverse(fold_duplicates(hits), MOST_HITS).where(F.col("place") <= F.col("k")).drop("k")


def answers(queries: DataFrame, hits: DataFrame, vector: DataFrame) -> DataFrame:
    """(qid, mode, warnings, expansions, n_results): one row per query. The mode is keyword_only where the query has no vector hits."""
    found = hits.groupBy("qid").agg(F.count("*").alias("n_results"), F.max(F.col("text_truncated").cast("int")).alias("_cut"))
    rows = queries.join(found, "qid", "left").join(vector.select("qid").distinct().withColumn("_vector", F.lit(True)), "qid", "left")
    alone = F.col("_vector").isNull()
    warnings = F.array_compact(F.array(F.when(F.col("hinted"), "language_hint"), F.when(alone, "keyword_only"), F.when(F.col("n_results").isNull(), "no_match"), F.when(F.col("_cut") == 1, "truncated")))
    return rows.select("qid", F.when(alone, "keyword_only").otherwise("hybrid").alias("mode"), warnings.alias("warnings"), "expansions", F.coalesce("n_results", F.lit(0)).alias("n_results"))


def hit_rate(retrieved: DataFrame, evidence: DataFrame, cases: DataFrame, traps: list[str] | None = None) -> DataFrame:
    """(kind, n, hits, rate) over the cases (qid, kind): a hit retrieves any (doc_id, pdf_page) of its evidence. Kinds among ``traps`` aren't scored."""
    hit = retrieved.join(evidence, ["qid", "doc_id", "pdf_page"], "left_semi").select("qid").distinct().withColumn("_hit", F.lit(1))
    scored = cases.where(~F.col("kind").isin(traps)) if traps else cases
    return scored.join(hit, "qid", "left").groupBy("kind").agg(F.count("*").alias("n"), F.count("_hit").alias("hits"), F.round(F.count("_hit") / F.count("*"), 6).alias("rate"))
