"""Corpus tables: current versions, joins, neighbours, fetch, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import display_derivation, display_text

EXCLUDED_SHOWN = 200
TEXT_SHOWN = 1500
PAGE_RANGE = 1024


def current(catalog: DataFrame) -> DataFrame:
    """Latest import of each document; ties by status and url, so that the choice is fixed."""
    newest = W.partitionBy("doc_id").orderBy(F.desc("imported_at"), F.desc("source_url_status"), F.desc_nulls_last("source_url"))
    return catalog.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def neighbours(passages: DataFrame) -> DataFrame:
    """(pid, prev_pid, next_pid) in reading order (pdf_page, ordinal), across pages; null at a document's ends.

    The ends of pages are linked within ranges of PAGE_RANGE pages and the ends of ranges by document, so that a book with a great share of all rows isn't one task.
    """
    rows = passages.select("pid", "doc_id", "pdf_page", "ordinal").distinct()
    on_page = W.partitionBy("doc_id", "pdf_page").orderBy("ordinal", "pid")
    rows = rows.withColumn("_prev", F.lag("pid").over(on_page)).withColumn("_next", F.lead("pid").over(on_page))
    ends = rows.groupBy("doc_id", "pdf_page").agg(F.min_by("pid", F.struct("ordinal", "pid")).alias("_first"), F.max_by("pid", F.struct("ordinal", "pid")).alias("_last"))
    ends = ends.withColumn("_range", F.floor(F.col("pdf_page") / PAGE_RANGE))
    by_page, by_range = W.partitionBy("doc_id", "_range").orderBy("pdf_page"), W.partitionBy("doc_id").orderBy("_range")
    ranges = ends.groupBy("doc_id", "_range").agg(F.min_by("_first", "pdf_page").alias("_f"), F.max_by("_last", "pdf_page").alias("_l"))
    ranges = ranges.select("doc_id", "_range", F.lag("_l").over(by_range).alias("_from"), F.lead("_f").over(by_range).alias("_to"))
    ends = ends.select("doc_id", "pdf_page", "_range", F.lag("_last").over(by_page).alias("_b"), F.lead("_first").over(by_page).alias("_a")).join(ranges, ["doc_id", "_range"])
    ends = ends.select("doc_id", "pdf_page", F.coalesce("_b", "_from").alias("_before"), F.coalesce("_a", "_to").alias("_after"))
    joined = rows.join(ends, ["doc_id", "pdf_page"])
    return joined.select("pid", F.coalesce("_prev", "_before").alias("prev_pid"), F.coalesce("_next", "_after").alias("next_pid"))


def fetch(passages: DataFrame, pages: DataFrame, catalog: DataFrame, context: int = 600) -> DataFrame:
    """Full passages with document, printed label, the page's raw text where reviewed, and context of the neighbours cut to ``context``."""
    rows = passages.select("pid", "doc_id", "pdf_page", "ordinal", "text_raw", "text_reviewed", "derivation", "content_hash").dropDuplicates(["pid"])
    shown = rows.withColumn("text", display_text(F.col("text_reviewed"), F.col("text_raw"))).withColumn("shown_derivation", display_derivation(F.col("text_reviewed"), F.col("derivation")))
    page = pages.select("doc_id", "pdf_page", "printed_label", "raw_text").dropDuplicates(["doc_id", "pdf_page"])
    docs = current(catalog).select("doc_id", "filename", F.coalesce("title", F.regexp_replace("filename", r"\.[^.]*$", "")).alias("title"))
    near = neighbours(passages)
    cut = (lambda c: F.substr(c, F.lit(1), F.lit(context))) if context else (lambda c: F.lit(None).cast("string"))
    around = shown.select(F.col("pid").alias("_pid"), "text")
    out = shown.join(docs, "doc_id").join(page, ["doc_id", "pdf_page"], "left").join(near, "pid")
    for side in ("prev", "next"):
        out = out.join(around.select(F.col("_pid").alias(f"{side}_pid"), cut(F.col("text")).alias(f"{side}_text")), f"{side}_pid", "left")
    raw = F.when(F.col("shown_derivation") == "reviewed_transcription", F.col("raw_text"))
    return out.select("pid", "doc_id", "title", "pdf_page", "printed_label", F.col("shown_derivation").alias("derivation"), "text", raw.alias("raw_extraction"), "prev_pid", "prev_text", "next_pid", "next_text")


def coverage(catalog: DataFrame, pages: DataFrame, passages: DataFrame, geography: str | None = None, vectors: DataFrame | None = None, topic: str | None = None) -> DataFrame:
    """One row per document: pages by status, passages and (of one model) ``vectors`` (pid); every count is aggregated once and joined.

    ``geography`` is held against the document's, not against the passages' regions; ``topic`` against the document's topics.
    """
    docs = current(catalog)
    if topic:
        docs = docs.where(F.array_contains(F.split(F.lower("topics"), ", *"), topic.lower()))
    if geography:
        docs = docs.where(F.lower(F.coalesce("geography", F.lit(""))) == geography.lower())
    by_status = pages.select("doc_id", "pdf_page", "status").distinct().groupBy("doc_id").agg(*[F.count_if(F.col("status") == s).alias(f"{s}_pages") for s in ("approved", "excluded", "pending")])
    texts = passages.select("doc_id", "pid").distinct().groupBy("doc_id").agg(F.count("*").alias("passages"))
    out = docs.join(by_status, "doc_id", "left").join(texts, "doc_id", "left")
    counts = ["approved_pages", "excluded_pages", "pending_pages", "passages"]
    if vectors is not None:
        counts.append("vectors")
        out = out.join(vector_counts(passages, vectors), "doc_id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in counts]
    return out.select("doc_id", "filename", F.coalesce("title", F.regexp_replace("filename", r"\.[^.]*$", "")).alias("title"), "geography", "source_url_status", "pdf_pages", *zero)


def vector_counts(passages: DataFrame, vectors: DataFrame) -> DataFrame:
    """(doc_id, vectors): passages of each document that have a vector."""
    with_vector = passages.select("pid", "doc_id").distinct().join(vectors.select("pid").distinct(), "pid")
    return with_vector.groupBy("doc_id").agg(F.count("*").alias("vectors"))


def coverage_report(catalog: DataFrame, spent: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row over a coverage catalogue: documents, pages, passages, vectors indexed and their dimensions, mode, spend."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("approved_pages", "excluded_pages", "pending_pages", "passages", "vectors")]
    total = catalog.agg(F.count("*").alias("documents"), *sums)
    dims = vectors.agg(F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dims"), F.count("*").alias("vectors_indexed"))
    mode = F.when(F.col("vectors_indexed") > 0, "hybrid").otherwise("keyword_only")
    # Three tables of one row each.
    return total.join(dims).join(spent.select("committed_usd", "reserved_usd")).withColumn("search_mode", mode)


def excluded_pages(pages: DataFrame, shown: int = EXCLUDED_SHOWN) -> DataFrame:
    """First excluded pages by (doc_id, pdf_page): a capped listing."""
    rows = pages.where("status = 'excluded'").select("doc_id", "pdf_page", "engine", "exclude_reason").distinct()
    return rows.orderBy("doc_id", "pdf_page").limit(shown)


def hit_rows(passages: DataFrame, catalog: DataFrame, pages: DataFrame, collection_url: str = "", collection_provenance: str = "", revision: str = "") -> DataFrame:
    """Passages as search results show them: document, label, collection, revision, text cut to TEXT_SHOWN with a flag."""
    rows = passages.select("pid", "doc_id", "pdf_page", "ordinal", "text_raw", "text_reviewed", "derivation", "region", "topic", "lang", "content_hash").dropDuplicates(["pid"])
    docs = current(catalog).select("doc_id", "filename", F.col("title").alias("doc_title"), "publisher", "source_url", "source_url_status")
    labels = pages.select("doc_id", "pdf_page", "printed_label").distinct()
    text = display_text(F.col("text_reviewed"), F.col("text_raw"))
    joined = rows.join(docs, "doc_id").join(labels, ["doc_id", "pdf_page"], "left")
    return joined.select(
        "pid", "doc_id", F.coalesce("doc_title", F.regexp_replace("filename", r"\.[^.]*$", "")).alias("title"), "filename", "publisher", "pdf_page", "printed_label", "region", "topic", "lang",
        "source_url", F.coalesce("source_url_status", F.lit("unresolved")).alias("source_url_status"), F.lit(collection_url).alias("collection_url"), F.lit(collection_provenance).alias("collection_provenance"), F.lit(revision).alias("corpus_revision"), "content_hash",
        display_derivation(F.col("text_reviewed"), F.col("derivation")).alias("derivation"), F.substr(text, F.lit(1), F.lit(TEXT_SHOWN)).alias("text"), (F.length(text) > TEXT_SHOWN).alias("text_truncated"),
    )
