"""Registered queries of the reference's operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..operators import chunk, gates, index, ingest, ledger, retrieve, selection, tables, vectors
from ..operators.common import cut, workspace

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
K = 5
LONG_CAP = 12
LABEL = r"(?:^|[^0-9A-Za-z])([0-9]{1,3})(?:[^0-9A-Za-z]|$)"
COLLECTION = ("https://books.example", "user provided", "r1")
HINTS = {"en": T.ENGLISH_HINT + "|^(register|survey|notes)", "fr": "^(carnets|registre)", "ar": "^(سجل|دليل)"}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def once(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The columns of a table, repeated rows once."""
    return read(spark, sf_dir, table).select(*columns).distinct()


# --- scalars and gates


@query
def normalize_text(spark, sf_dir):
    return once(spark, sf_dir, "passages", "pid", "text_raw").select("pid", T.normalize_lines(F.col("text_raw")).alias("normalized"))


@query
def normalize_glued(spark, sf_dir):
    """Raw pages of several lines: line breaks go as control characters, so words beside them are glued."""
    return once(spark, sf_dir, "pages", "doc_id", "pdf_page", "raw_text").select("doc_id", "pdf_page", T.normalize_search(F.col("raw_text")).alias("normalized"))


@query
def stopword_strip(spark, sf_dir):
    return read(spark, sf_dir, "documents").where("title is not null").select("doc_id", T.strip_stopwords(T.normalize_lines(F.col("title"))).alias("terms"))


@query
def language_hint_filter(spark, sf_dir):
    """Titles that name a kind of book of one language, beside those that ask for English."""
    hint = T.language_hint(F.col("title"), HINTS)
    return read(spark, sf_dir, "documents").select("doc_id", "lang", hint.alias("hint")).where("hint is not null")


@query
def script_ratio(spark, sf_dir):
    pages = once(spark, sf_dir, "pages", "doc_id", "pdf_page", "raw_text").where("raw_text is not null")
    ratio = T.arabic_ratio(F.col("raw_text"))
    return pages.select("doc_id", "pdf_page", ratio.alias("ratio"), T.language_label(ratio).alias("label"), T.replacement_count(F.col("raw_text")).alias("lost"))


@query
def content_hash(spark, sf_dir):
    rows = once(spark, sf_dir, "passages", "pid", "derivation", "text_raw", "content_hash")
    return rows.select("pid", T.content_hash(F.col("derivation"), F.col("text_raw")).alias("hash"), "content_hash")


@query
def page_gate(spark, sf_dir):
    status, reason = gates.page_gate(F.col("raw_text"))
    rows = once(spark, sf_dir, "pages", "doc_id", "pdf_page", "raw_text", "raw_chars")
    return rows.select("doc_id", "pdf_page", status.alias("status"), reason.alias("reason"), gates.inventory_gate(F.col("raw_chars")).alias("inventory_reason"))


@query
def gate_summary(spark, sf_dir):
    return page_gate(spark, sf_dir).groupBy("doc_id", "status", "reason").agg(F.count("*").alias("pages"))


def page_texts(spark, sf_dir):
    """(doc_id, pdf_page, other_text): the text of each page as its passages have it, in reading order. A page has a bounded number of passages."""
    rows = read(spark, sf_dir, "passages").select("pid", "doc_id", "pdf_page", "ordinal", T.display_text(F.col("text_reviewed"), F.col("text_raw")).alias("_t")).dropDuplicates(["pid"])
    lines = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "pid", "_t"))), lambda x: x["_t"])
    return rows.groupBy("doc_id", "pdf_page").agg(F.array_join(lines, "\n").alias("other_text"))


def recognized(spark, sf_dir):
    """Scanned pages with what the recognizer gave: text, words, confidence of the results that hold for the current file, or an error."""
    docs = tables.current(read(spark, sf_dir, "doc_catalog")).select(F.col("doc_id").alias("stem"), F.substring("checksum", 1, 12).alias("_now"))
    cache = read(spark, sf_dir, "ocr_cache").join(docs, "stem", "left").withColumn("_ok", F.coalesce(F.col("_now") == F.col("checksum12"), F.lit(False)))
    valid = lambda c: F.max(F.when(F.col("_ok"), F.col(c))).alias(c)
    cache = cache.groupBy(F.col("stem").alias("doc_id"), "pdf_page").agg(valid("words"), valid("mean_conf"), F.max("_ok").alias("_ok"), F.max("checksum12").alias("_sum"))
    error = F.when(~F.col("_ok"), F.concat(F.lit("stale_checksum: "), "_sum")).when(F.col("mean_conf") == 0, F.concat(F.lit("no_confidence: "), "_sum"))
    pages = read(spark, sf_dir, "pages").where("engine like 'ocr%'").select("doc_id", "pdf_page", "raw_text").dropDuplicates(["doc_id", "pdf_page"])
    rows = pages.join(cache, ["doc_id", "pdf_page"], "left").join(page_texts(spark, sf_dir), ["doc_id", "pdf_page"], "left")
    return rows.select("doc_id", "pdf_page", "raw_text", F.col("other_text").alias("ocr_text"), "words", "mean_conf", error.alias("error"))


OCR = ("ocr_text", "words", "mean_conf", "error")


@query
def ocr_gate(spark, sf_dir):
    status, reason = gates.ocr_gate(*(F.col(c) for c in OCR))
    return recognized(spark, sf_dir).select("doc_id", "pdf_page", status.alias("status"), reason.alias("reason"))


@query
def ocr_resolve(spark, sf_dir):
    """Stored text and recognized text of the scanned pages: which of them an import takes."""
    status, reason = gates.page_gate(F.col("raw_text"))
    ocr_status, ocr_reason = gates.ocr_gate(*(F.col(c) for c in OCR))
    has_result = F.col("words").isNotNull() | F.col("error").isNotNull()
    rows = recognized(spark, sf_dir).select("doc_id", "pdf_page", status.alias("s"), reason.alias("r"), F.when(has_result, ocr_status).alias("os"), ocr_reason.alias("o"), "error")
    final, why, used = gates.resolve(*(F.col(c) for c in ("s", "r", "os", "o", "error")))
    return rows.select("doc_id", "pdf_page", final.alias("status"), why.alias("reason"), F.coalesce(used, F.lit(False)).alias("used_ocr"))


@query
def error_histogram(spark, sf_dir):
    """Recognition errors by what stands before the colon."""
    return recognized(spark, sf_dir).where("error is not null").groupBy(F.split_part("error", F.lit(":"), F.lit(1)).alias("error")).agg(F.count("*").alias("pages"))


@query
def ocr_clean(spark, sf_dir):
    return once(spark, sf_dir, "passages", "pid", "text_raw", "derivation").where("derivation = 'ocr'").select("pid", T.clean_fragments(F.col("text_raw")).alias("cleaned"))


@query
def engine_choice(spark, sf_dir):
    """The engine rule on the two texts that a page has: as stored, and as its passages have it; with the length of the one not chosen."""
    rows = read(spark, sf_dir, "pages").where("engine not like 'ocr%'").select("doc_id", "pdf_page", "engine", "raw_text").dropDuplicates(["doc_id", "pdf_page"])
    rows = rows.join(page_texts(spark, sf_dir), ["doc_id", "pdf_page"], "left").withColumn("choice", gates.choose_engine(F.col("raw_text"), F.col("other_text")))
    alt = F.length(F.coalesce(F.when(F.col("choice") == "a", F.col("other_text")).otherwise(F.col("raw_text")), F.lit("")))
    return rows.select("doc_id", "pdf_page", "engine", "choice", alt.alias("alt_chars"))


@query
def label_parse(spark, sf_dir):
    """Number among a page's first three lines, as printed label, within the pages of a book; the label of reviewed pages goes before it."""
    rows = once(spark, sf_dir, "pages", "doc_id", "pdf_page", "raw_text", "printed_label").where("raw_text is not null")
    reviewed = read(spark, sf_dir, "passages").where("derivation = 'reviewed_transcription'").select("doc_id", "pdf_page", F.lit(True).alias("_r")).distinct()
    rows = rows.join(reviewed, ["doc_id", "pdf_page"], "left")
    own = F.when(F.col("_r"), F.col("printed_label"))
    return rows.select("doc_id", "pdf_page", T.printed_label(F.col("raw_text"), LABEL, 1, 999, own).alias("label"), "printed_label")


# --- tables


@query
def document_listing(spark, sf_dir):
    return tables.current(read(spark, sf_dir, "doc_catalog")).select("doc_id", "filename", F.coalesce("title", F.regexp_replace("filename", r"\.[^.]*$", "")).alias("title"), "source_url_status").orderBy("filename")


@query
def metadata_left_join(spark, sf_dir):
    docs = tables.current(read(spark, sf_dir, "doc_catalog"))
    pages = once(spark, sf_dir, "pages", "doc_id", "pdf_page", "engine")
    joined = pages.join(docs.select("doc_id", "title", "publisher", "geography", "geography_provenance"), "doc_id", "left")
    return joined.select("doc_id", "pdf_page", "engine", "title", "publisher", "geography", F.coalesce("geography_provenance", F.lit("unverified")).alias("geography_provenance"))


def embedded(spark, sf_dir):
    """Passages that the embedding cache has: those with the hash of their own text."""
    return read(spark, sf_dir, "passages").where(T.content_hash(F.col("derivation"), F.col("text_raw")) == F.col("content_hash")).select("pid")


@query
def coverage_catalog(spark, sf_dir):
    return tables.coverage(read(spark, sf_dir, "doc_catalog"), read(spark, sf_dir, "pages"), read(spark, sf_dir, "passages"), vectors=embedded(spark, sf_dir))


@query
def coverage_of_region(spark, sf_dir):
    """The catalogue's filters: by the documents' geography and topics."""
    return tables.coverage(read(spark, sf_dir, "doc_catalog"), read(spark, sf_dir, "pages"), read(spark, sf_dir, "passages"), geography="INLAND DISTRICT", topic="food")


@query
def coverage_report(spark, sf_dir):
    vectors_ = read(spark, sf_dir, "embeddings").select(F.col("embedding").alias("vector"))
    return tables.coverage_report(coverage_catalog(spark, sf_dir), ledger.totals(read(spark, sf_dir, "usage_log")), vectors_)


@query
def coverage_totals(spark, sf_dir):
    return coverage_catalog(spark, sf_dir).groupBy("geography").agg(F.count("*").alias("documents"), F.sum("approved_pages").alias("approved_pages"), F.sum("passages").alias("passages"))


@query
def excluded_pages(spark, sf_dir):
    return tables.excluded_pages(read(spark, sf_dir, "pages"))


@query
def neighbors(spark, sf_dir):
    return tables.neighbours(read(spark, sf_dir, "passages"))


@query
def passage_fetch(spark, sf_dir):
    return tables.fetch(read(spark, sf_dir, "passages"), read(spark, sf_dir, "pages"), read(spark, sf_dir, "doc_catalog"))


@query
def hit_projection(spark, sf_dir):
    return tables.hit_rows(read(spark, sf_dir, "passages"), read(spark, sf_dir, "doc_catalog"), read(spark, sf_dir, "pages"), *COLLECTION)


@query
def hit_json(spark, sf_dir):
    """Hits as JSON, non-ASCII as it is."""
    fields = ["pid", "title", "pdf_page", "lang", "derivation", "text_truncated"]
    return hit_projection(spark, sf_dir).select("pid", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("hit"))


@query
def filter_search_params(spark, sf_dir):
    rows = once(spark, sf_dir, "passages", "pid", "doc_id", "region", "topic", "lang")
    return rows.where(retrieve.search_filter(region="jabal ruqishir", lang="en"))


@query
def page_selection(spark, sf_dir):
    """Selection built from the catalogue: the first three pages and the last of every book."""
    docs = tables.current(read(spark, sf_dir, "doc_catalog")).where("pdf_pages >= 1")
    ends = F.explode(F.array(F.struct(F.lit(1).alias("first"), F.least(F.lit(3), "pdf_pages").alias("last")), F.struct(F.col("pdf_pages").alias("first"), F.col("pdf_pages").alias("last")))).alias("r")
    ranges = docs.select("doc_id", ends).select("doc_id", "r.*")
    return selection.select_pages(once(spark, sf_dir, "pages", "doc_id", "pdf_page", "engine"), ranges)


# --- index and retrieval


def keyword_queries(spark, sf_dir):
    """Titles of every document whose id is divisible by 20, as queries: normalized, stop words left out."""
    rows = read(spark, sf_dir, "documents").where((F.col("doc_id") % 20 == 0) & F.col("title").isNotNull())
    return rows.select(F.col("doc_id").alias("qid"), T.strip_stopwords(T.normalize_lines(F.substr("title", F.lit(1), F.lit(500)))).alias("query"))


#: Folders of the indexes that this process has built, by session, tables and their age.
BUILT: dict[tuple, str] = {}


def age_of(spark, path):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).getModificationTime()


def stored_index(spark, sf_dir, table):
    """The stored index of documents or passages; built by the first query that asks for it."""
    key = (spark.sparkContext.applicationId, sf_dir, table, age_of(spark, f"{sf_dir}/{table}.parquet"))
    if key not in BUILT:
        if table == "documents":
            rows, pid, text = read(spark, sf_dir, table).select("doc_id", T.normalize_lines(F.col("text")).alias("text")), "doc_id", "text"
        else:
            rows, pid, text = read(spark, sf_dir, table).select("pid", "text_search").dropDuplicates(["pid"]), "pid", "text_search"
        root = workspace(spark, f"index-{table}")
        index.Index.build(rows, pid, text, root)
        BUILT[key] = root
    return index.Index(spark, BUILT[key])


def keyword_pool(spark, sf_dir, queries=None):
    asked = keyword_queries(spark, sf_dir) if queries is None else queries
    return index.pool(stored_index(spark, sf_dir, "documents"), asked, "qid", "query")


def vector_pool(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), F.col("embedding").alias("vector"))
    return vectors.top_k(rows, rows.where("pid % 20 = 0").withColumnRenamed("pid", "qid"))


def sources_of(spark, sf_dir):
    """Documents as passages: the source is the document they belong to."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("pid"), F.col("source").alias("doc_id"), "lang", "topic", F.lit(None).cast("string").alias("region"), F.substring(F.sha2("text", 256), 1, 32).alias("content_hash"), F.concat_ws(" p", "source", F.col("doc_id").cast("string")).alias("label"))


@query
def tokenize(spark, sf_dir):
    tokens = index.tokenized(once(spark, sf_dir, "passages", "pid", "text_search"), "pid", "text_search")
    return tokens.select("pid", "dl", F.size(F.array_distinct("tokens")).alias("terms"))


@query
def doc_frequency(spark, sf_dir):
    return index.doc_frequency(index.tokenized(once(spark, sf_dir, "passages", "pid", "text_search"), "pid", "text_search"))


@query
def corpus_stats(spark, sf_dir):
    stats = index.corpus_stats(index.tokenized(once(spark, sf_dir, "passages", "pid", "text_search"), "pid", "text_search"))
    return stats.select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query
def bm25_topk(spark, sf_dir):
    return keyword_pool(spark, sf_dir).select("qid", F.col("pid").alias("doc_id"), "score", "rank")


@query
def phrase_match(spark, sf_dir):
    """Names of regions as quoted phrases over the passages: adjacent tokens only."""
    # Written first, else the filter goes below the distinct and every passage's region is normalized, once for each reader.
    titles = cut(once(spark, sf_dir, "passages", "region").select(F.lower("region").alias("qid")).distinct())
    titles = cut(titles.select("qid", F.array_join(index.search_tokens(T.normalize_lines(F.col("qid"))), " ").alias("phrase")).where("phrase != ''"))
    return titles.join(stored_index(spark, sf_dir, "passages").hits(titles), "phrase").select("qid", "pid", F.col("tf").cast("long").alias("occurrences"))


def topic_glossary(spark, sf_dir):
    """Glossary of the catalogue's topics: each topic stands for those it shares books with."""
    topics = tables.current(read(spark, sf_dir, "doc_catalog")).where("topics is not null").select("doc_id", F.explode(F.split("topics", ", ")).alias("topic"))
    pairs = topics.alias("a").join(topics.alias("b"), "doc_id").where("a.topic != b.topic").select(F.col("a.topic").alias("key"), F.col("b.topic").alias("term")).distinct()
    return pairs.groupBy("key").agg(F.sort_array(F.collect_set("term")).alias("terms"))


@query
def alias_expand(spark, sf_dir):
    """Queries are the documents' topics and titles."""
    queries = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), T.normalize_lines(F.concat_ws(" ", "title", "topic")).alias("query"))
    return retrieve.expand_aliases(queries, retrieve.glossary(topic_glossary(spark, sf_dir))).select("qid", "key", F.array_join("terms", ",").alias("terms"))


@query
def vector_topk(spark, sf_dir):
    return vector_pool(spark, sf_dir).select("qid", F.col("pid").alias("vec_id"), "sim", "rank")


def fused(spark, sf_dir):
    return retrieve.fuse(keyword_pool(spark, sf_dir), vector_pool(spark, sf_dir))


@query
def rrf_fuse(spark, sf_dir):
    return fused(spark, sf_dir).select("qid", F.col("pid").alias("doc_id"), F.round("score", 9).alias("score"), "fts_rank", "vec_rank", "rank")


@query
def post_filter(spark, sf_dir):
    """Language filter after the pools are cut."""
    hits = fused(spark, sf_dir).join(sources_of(spark, sf_dir), "pid").where(retrieve.search_filter(lang="ar"))
    return hits.select("qid", "pid", "rank")


@query
def dedup_alt_provenance(spark, sf_dir):
    hits = fused(spark, sf_dir).join(sources_of(spark, sf_dir), "pid")
    return retrieve.fold_duplicates(hits).select("qid", "pid", "rank", F.array_join("alternates", ",").alias("alternates"))


@query
def diversity_topk(spark, sf_dir):
    hits = fused(spark, sf_dir).join(sources_of(spark, sf_dir), "pid")
    return retrieve.diverse(hits, K).select("qid", "pid", "place")


@query
def hybrid_topk(spark, sf_dir):
    found = retrieve.hybrid(sources_of(spark, sf_dir), keyword_pool(spark, sf_dir), vector_pool(spark, sf_dir), k=K)
    return found.select("qid", "pid", F.col("doc_id").alias("source"), "lang", F.array_join("alternates", ",").alias("alternates"), "place")


def batch(spark, sf_dir):
    """Search requests: title and topic of every document whose id is divisible by 20. Hints in the title choose the language; every request of a source in two asks for its own topic."""
    rows = read(spark, sf_dir, "documents").where((F.col("doc_id") % 20 == 0) & F.col("title").isNotNull())
    none = F.lit(None).cast("string")
    asked = rows.select(F.col("doc_id").alias("qid"), F.concat_ws(" ", "title", "topic").alias("query"), none.alias("lang"), none.alias("region"), F.when(F.col("doc_id") % 40 == 0, F.col("topic")).alias("topic"), F.array().cast("array<string>").alias("doc_ids"), (F.lit(1) + F.floor(F.col("doc_id") / 20) % 10).cast("int").alias("k"))
    return retrieve.asked(asked, retrieve.glossary(topic_glossary(spark, sf_dir)), HINTS)


def searched(spark, sf_dir):
    queries, near = batch(spark, sf_dir), vector_pool(spark, sf_dir)
    words = keyword_pool(spark, sf_dir, queries.select("qid", F.col("bag").alias("query")))
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("pid"), (F.length("text") > tables.TEXT_SHOWN).alias("text_truncated"))
    hits = retrieve.search(queries, sources_of(spark, sf_dir).join(d, "pid"), words, near)
    return queries, hits, near


@query
def search_batch(spark, sf_dir):
    """The whole search: hints, aliases, stop words, BM25 and vectors, fusion, each request's own filters, folding, diversity, its own k."""
    _, hits, _ = searched(spark, sf_dir)
    return hits.select("qid", "pid", F.col("doc_id").alias("source"), "lang", F.array_join("alternates", ",").alias("alternates"), "place")


@query
def search_answers(spark, sf_dir):
    """Mode, warnings and expansions of each request."""
    found = retrieve.answers(*searched(spark, sf_dir))
    return found.select("qid", "mode", F.array_join("warnings", ",").alias("warnings"), F.array_join("expansions", ",").alias("expansions"), "n_results")


@query
def eval_hit_at_k(spark, sf_dir):
    """Titles as eval cases; a case's evidence is every document of its topic and source. Cases without a language are traps."""
    d = read(spark, sf_dir, "documents").select("doc_id", "title", "topic", "source", "lang").where("title is not null and topic is not null")
    cases = d.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), F.coalesce("lang", F.lit("none")).alias("kind"), "topic", "source")
    found = retrieve.diverse(fused(spark, sf_dir).join(sources_of(spark, sf_dir), "pid"), K).select("qid", "doc_id", F.col("pid").alias("pdf_page"))
    # A case has very many documents as evidence: the few retrieved ones are held against it instead of listing them.
    titled = d.select(F.col("doc_id").alias("pdf_page"), F.col("topic").alias("_topic"), F.col("source").alias("_source"))
    evidence = found.join(titled, "pdf_page").join(cases, "qid").where("topic = _topic and source = _source").select("qid", "doc_id", "pdf_page")
    return retrieve.hit_rate(found, evidence, cases.select("qid", "kind"), traps=["none"])


# --- chunks and imports


@query
def chunk_lines(spark, sf_dir):
    """Pages in chunks of at most 300 tokens."""
    return chunk.chunk_rows(once(spark, sf_dir, "pages", "doc_id", "pdf_page", "raw_text"), ["doc_id", "pdf_page"], "raw_text", 300)


@query
def chunk_long_lines(spark, sf_dir):
    """Articles in chunks of 12 tokens, so that most lines are split into sentences and many of these into words."""
    return chunk.chunk_rows(read(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], "text", LONG_CAP)


@query
def chunk_stats(spark, sf_dir):
    rows = chunk_lines(spark, sf_dir)
    return rows.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("most"))


@query
def build_passages(spark, sf_dir):
    return ingest.build_passages(read(spark, sf_dir, "pages"))


def review_records(spark, sf_dir):
    """Reviewed pages with their paragraphs, from the reviewed passages; a paragraph's region and topic are given where they aren't null."""
    rows = read(spark, sf_dir, "passages").where("derivation = 'reviewed_transcription'").select("pid", "doc_id", "pdf_page", "ordinal", "text_reviewed", "region", "topic", "lang").dropDuplicates(["pid"])
    given = F.map_filter(F.create_map(F.lit("region"), F.col("region"), F.lit("topic"), F.col("topic")), lambda _, v: v.isNotNull())
    paras = F.sort_array(F.collect_list(F.struct("ordinal", "pid", "text_reviewed")))
    metas = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "pid", F.map_entries(given).alias("m")))), lambda x: F.map_from_entries(x["m"]))
    pages = rows.groupBy("doc_id", "pdf_page").agg(F.min("lang").alias("lang"), F.transform(paras, lambda x: x["text_reviewed"]).alias("paragraphs"), metas.alias("para_meta"))
    docs = tables.current(read(spark, sf_dir, "doc_catalog")).select("doc_id", F.create_map(F.lit("region"), F.col("geography"), F.lit("topic"), F.get(F.split("topics", ", "), F.lit(0))).alias("doc_meta"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    labels = read(spark, sf_dir, "pages").select("doc_id", "pdf_page", F.col("printed_label").alias("label")).dropDuplicates(["doc_id", "pdf_page"])
    return pages.withColumn("meta", none).join(docs, "doc_id", "left").join(labels, ["doc_id", "pdf_page"], "left")


@query
def reviewed_passages(spark, sf_dir):
    return ingest.build_reviewed(review_records(spark, sf_dir)).drop("text_raw")


@query
def import_result(spark, sf_dir):
    """The tables imported again from the stored texts: every passage after the import, and what became of it."""
    pages = read(spark, sf_dir, "pages").select("doc_id", "pdf_page", "engine", F.col("raw_text").alias("text"), "status", "exclude_reason").dropDuplicates(["doc_id", "pdf_page"])
    asked = pages.select("doc_id", "pdf_page", "engine", "text").join(page_texts(spark, sf_dir), ["doc_id", "pdf_page"], "left")
    meta = tables.current(read(spark, sf_dir, "doc_catalog")).select("doc_id", F.col("geography").alias("region"), F.get(F.split("topics", ", "), F.lit(0)).alias("topic"))
    stored = read(spark, sf_dir, "passages").dropDuplicates(["pid"])
    resolved = ingest.resolve_pages(asked, recognized(spark, sf_dir).drop("raw_text"), review_records(spark, sf_dir))
    done = ingest.import_documents(asked, recognized(spark, sf_dir).drop("raw_text"), review_records(spark, sf_dir), meta, resolved.limit(0), stored)
    return done.passages.groupBy("doc_id", "derivation").agg(F.count("*").alias("passages"), F.sum("tokens").alias("tokens"))


@query
def import_upsert_merge(spark, sf_dir):
    """The catalogue's first imports overwritten by its latest ones."""
    catalog = read(spark, sf_dir, "doc_catalog").distinct()
    oldest = W.partitionBy("doc_id").orderBy("imported_at", "source_url_status", F.asc_nulls_first("source_url"))
    first = catalog.withColumn("_n", F.row_number().over(oldest)).where("_n = 1").drop("_n")
    again = catalog.groupBy("doc_id").agg(F.count("*").alias("_k")).where("_k > 1").select("doc_id")
    latest = tables.current(catalog).join(again, "doc_id", "left_semi")
    return ingest.upsert(first, latest, ["doc_id"]).select("doc_id", "filename", "title", "source_url_status", F.col("imported_at").cast("date").alias("imported"))


@query
def stale_anti_join(spark, sf_dir):
    """Stored passages that chunking their pages anew no longer gives, those of pages that give none at all included."""
    return stale_passages(read(spark, sf_dir, "pages"), read(spark, sf_dir, "passages"))


def stale_passages(pages: DataFrame, stored: DataFrame) -> DataFrame:
    built = ingest.build_passages(pages)
    # Reviewed pages are approved whatever the gate says, so their passages stay where the recognized text gives none.
    without = pages.select("doc_id", "pdf_page").join(built.select("doc_id", "pdf_page"), ["doc_id", "pdf_page"], "left_anti")
    unreviewed = stored.where(~F.col("derivation").eqNullSafe("reviewed_transcription"))
    return ingest.stale(stored, built, built).unionByName(ingest.stale(unreviewed, built, without))


@query
def embed_cache_anti(spark, sf_dir):
    """Passages to embed, where the cache holds what has the hash of its own text."""
    rows = once(spark, sf_dir, "passages", "pid", "content_hash", "derivation", "text_raw")
    cache = rows.select("pid", T.content_hash(F.col("derivation"), F.col("text_raw")).alias("content_hash"))
    return ingest.to_embed(rows.select("pid", "content_hash"), cache, ["pid"])


@query
def cache_validity(spark, sf_dir):
    valid = ingest.valid_cache(read(spark, sf_dir, "ocr_cache"), read(spark, sf_dir, "doc_catalog"), "ara+eng", 1)
    return valid.select("stem", "pdf_page", "mean_conf", "words")


@query
def dry_run_estimate(spark, sf_dir):
    """Pages through gate and chunker, by document: what an import would store and what embedding it would cost."""
    gated = page_gate(spark, sf_dir).groupBy("doc_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("approved", "excluded")])
    built = build_passages(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"))
    rows = gated.join(built, "doc_id", "left").select("doc_id", "approved", "excluded", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    usd = ledger.cost(F.col("tokens"))
    return rows.select("*", F.round(usd, 9).alias("usd"), F.round(usd * ledger.WORST_CASE, 9).alias("worst_usd"))


# --- ledger


@query
def batch_packing(spark, sf_dir):
    """Batches of each document's passages in reading order: at most 2,000 tokens or 20 items."""
    items = once(spark, sf_dir, "passages", "doc_id", "pdf_page", "ordinal", "pid", "tokens")
    packed = ledger.batches(items, "doc_id", ["pdf_page", "ordinal", "pid"], "tokens", 2000, 20, F.floor(F.col("pdf_page") / 256))
    return packed.groupBy("doc_id", "batch").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"))


@query
def budget_admission(spark, sf_dir):
    """Days of commits as batches against a cap of half of all spend."""
    days = once(spark, sf_dir, "usage_log", "id", "ts", "kind", "cost_est_usd").where("kind = 'commit'").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.sum(ledger.money(F.col("cost_est_usd"))), 6).cast("double").alias("cost"))
    cap = F.broadcast(days.agg((F.sum("cost") / 2).alias("_cap")))  # one row
    out = ledger.admitted(days.join(cap), ["day"], F.col("_cap"), stretch=F.trunc("day", "month"))
    return out.select("day", "cost", F.round("spent_before", 6).alias("spent_before"), "admitted")


@query
def ledger_totals(spark, sf_dir):
    return ledger.totals(read(spark, sf_dir, "usage_log"))


@query
def ledger_by_note(spark, sf_dir):
    return ledger.totals(read(spark, sf_dir, "usage_log"), ["note"])


@query
def open_reserves(spark, sf_dir):
    return ledger.open_reserves(read(spark, sf_dir, "usage_log"))


@query
def expired_reserves(spark, sf_dir):
    return ledger.expired(read(spark, sf_dir, "usage_log"), 0)
