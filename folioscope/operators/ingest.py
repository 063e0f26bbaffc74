"""Imports: upserts as rewrites, stale passages, embedding cache, snapshots with a manifest."""

from __future__ import annotations

import json
import time
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import arabic_ratio, content_hash, language_label, normalize_search, passage_id, replacement_count, token_estimate
from .chunk import chunk_rows, chunks
from .common import cut
from .gates import choose_engine, ocr_gate, page_gate, resolve


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and the old ones without a new version; all columns are overwritten, by nulls too. ``new`` has one row per key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def build_passages(pages: DataFrame) -> DataFrame:
    """Passages of approved pages: (pid, doc_id, pdf_page, ordinal, text_raw, text_search, derivation, content_hash, tokens, lang)."""
    status, _ = page_gate(F.col("raw_text"))
    once = pages.select("doc_id", "pdf_page", "engine", "raw_text").distinct().where(status == "approved")
    derivation = F.when(F.col("engine").startswith("ocr"), "ocr").otherwise("extracted")
    rows = chunk_rows(once.withColumn("derivation", derivation), ["doc_id", "pdf_page", "derivation"], "raw_text")
    return rows.select(
        passage_id(F.col("doc_id"), F.col("pdf_page"), F.col("ordinal")).alias("pid"), "doc_id", "pdf_page", "ordinal", F.col("text").alias("text_raw"), normalize_search(F.col("text")).alias("text_search"),
        "derivation", content_hash(F.col("derivation"), F.col("text")).alias("content_hash"), "tokens", language_label(arabic_ratio(F.col("text"))).alias("lang"),
    )


def build_reviewed(records: DataFrame) -> DataFrame:
    """Passages of reviewed pages, ordinals continuous over their paragraphs.

    ``records``: (doc_id, pdf_page, lang, paragraphs array, para_meta array of map, meta map, doc_meta map). Region and topic go by presence of the key:
    a paragraph's explicit null wins over the record's, and that over the document's.
    """
    each = records.select("doc_id", "pdf_page", "lang", "meta", "doc_meta", F.posexplode("paragraphs").alias("para", "_t"), "para_meta")
    each = each.withColumn("own", F.coalesce(F.get("para_meta", F.col("para")), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    pieces = each.select("*", F.posexplode(chunks(F.col("_t"))).alias("piece", "text"))
    ordinal = F.row_number().over(W.partitionBy("doc_id", "pdf_page").orderBy("para", "piece")) - 1

    def named(key: str) -> Column:
        has = lambda column: F.coalesce(F.map_contains_key(column, key), F.lit(False))
        return reviewed_precedence(F.col("own")[key], F.col("meta")[key], F.col("doc_meta")[key], has("own"), has("meta")).alias(key)

    rows = pieces.withColumn("ordinal", ordinal)
    lang = F.coalesce("lang", language_label(arabic_ratio(F.col("text"))))
    derivation = F.lit("reviewed_transcription")
    return rows.select(
        passage_id(F.col("doc_id"), F.col("pdf_page"), F.col("ordinal")).alias("pid"), "doc_id", "pdf_page", "ordinal", F.lit("").alias("text_raw"), normalize_search(F.col("text")).alias("text_search"), F.col("text").alias("text_reviewed"),
        derivation.alias("derivation"), content_hash(derivation, F.col("text")).alias("content_hash"), token_estimate(F.col("text")).alias("tokens"), named("region"), named("topic"), lang.alias("lang"),
    )


def resolve_pages(pages: DataFrame, recognized: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Imported pages: text of the chosen source, status and reason.

    ``pages`` (doc_id, pdf_page, engine, text, other_text): the two engines' texts; ``recognized`` (doc_id, pdf_page, ocr_text, words, mean_conf, error); ``reviewed``
    (doc_id, pdf_page, label). Recognition is asked only of pages whose text fails the gate; reviewed pages are approved whatever it says.
    """
    keys = ["doc_id", "pdf_page"]
    rows = pages.join(recognized, keys, "left").join(reviewed.select(*keys, "label", F.lit(True).alias("_reviewed")).dropDuplicates(keys), keys, "left")
    first = choose_engine(F.col("text"), F.col("other_text")) == "a"
    both = F.when(first, F.struct(F.col("text").alias("t"), F.col("other_text").alias("o"))).otherwise(F.struct(F.col("other_text").alias("t"), F.col("text").alias("o")))
    rows = rows.withColumn("_both", both).withColumns({"_text": F.col("_both.t"), "alt_chars": F.length(F.coalesce(F.col("_both.o"), F.lit("")))})
    status, reason = page_gate(F.col("_text"))
    has_result = F.col("words").isNotNull() | F.col("error").isNotNull()
    ocr_status, ocr_reason = ocr_gate(F.col("ocr_text"), F.col("words"), F.col("mean_conf"), F.col("error"))
    rows = rows.withColumns({"_s": status, "_r": reason, "_os": F.when(has_result, ocr_status), "_or": ocr_reason})
    final, why, used = resolve(F.col("_s"), F.col("_r"), F.col("_os"), F.col("_or"), F.col("error"))
    used = F.coalesce(used, F.lit(False))
    is_reviewed = F.coalesce("_reviewed", F.lit(False))
    text = F.when(used, F.col("ocr_text")).otherwise(F.col("_text"))
    return rows.select(
        *keys, F.when(used, "ocr").otherwise(F.col("engine")).alias("engine"), text.alias("raw_text"), F.length(F.coalesce(text, F.lit(""))).alias("raw_chars"), F.when(used, 0).otherwise(F.col("alt_chars")).alias("alt_chars"),
        arabic_ratio(text).alias("arabic_ratio"), replacement_count(text).alias("repl_count"), F.when(used, F.col("mean_conf")).alias("ocr_conf"), F.col("label").alias("printed_label"),
        F.when(is_reviewed, "approved").otherwise(final).alias("status"), F.when(is_reviewed, "reviewed_transcription").otherwise(why).alias("exclude_reason"),
    )


PASSAGE = ["pid", "doc_id", "pdf_page", "ordinal", "text_raw", "text_search", "text_reviewed", "derivation", "content_hash", "tokens", "region", "topic", "lang"]


def import_passages(resolved: DataFrame, records: DataFrame, doc_meta: DataFrame) -> DataFrame:
    """Passages of resolved pages: those of reviewed records, and of approved text, with the document's region and topic (doc_id, region, topic)."""
    text = resolved.where("status = 'approved' and exclude_reason != 'reviewed_transcription'")
    extracted = build_passages(text).join(doc_meta.select("doc_id", "region", "topic"), "doc_id", "left").withColumn("text_reviewed", F.lit(None).cast("string"))
    return extracted.select(*PASSAGE).unionByName(build_reviewed(records).select(*PASSAGE))


class Imported(NamedTuple):
    """What an import makes: the tables after it, and the passages that it takes away (their vectors and postings go too)."""

    pages: DataFrame
    passages: DataFrame
    stale: DataFrame


def import_documents(pages: DataFrame, recognized: DataFrame, records: DataFrame, doc_meta: DataFrame, stored_pages: DataFrame, stored_passages: DataFrame) -> Imported:
    """One import: gate, recognition, reviewed pages, chunks, upsert; passages that touched pages no longer have are stale. Importing again changes nothing."""
    # Both are read several times, and must be the same each time.
    resolved = cut(resolve_pages(pages, recognized, records))
    built = cut(import_passages(resolved, records, doc_meta))
    gone = stale(stored_passages, built, resolved)
    kept = stored_passages.join(gone.select("pid"), "pid", "left_anti")
    return Imported(upsert(stored_pages, resolved, ["doc_id", "pdf_page"]), upsert(kept, built, ["pid"]), gone)


def run_import(spark: SparkSession, root: str, pages: DataFrame, recognized: DataFrame, records: DataFrame, doc_meta: DataFrame) -> Imported:
    """import_documents() on the tables stored below ``root``; only the buckets of touched documents are written anew, and both manifests change last."""
    stored = {name: Snapshots(spark, f"{root}/{name}", "doc_id") for name in ("pages", "passages")}
    touched = pages.select("doc_id").distinct()
    empty_pages = resolve_pages(pages.limit(0), recognized, records)
    empty_passages = import_passages(empty_pages, records.limit(0), doc_meta)
    old_pages, old_passages = (stored[n].read_touched(touched, e) for n, e in (("pages", empty_pages), ("passages", empty_passages)))
    done = import_documents(pages, recognized, records, doc_meta, old_pages, old_passages)
    written = {name: stored[name].stage(df) for name, df in (("pages", done.pages), ("passages", done.passages))}
    for name, paths in written.items():
        stored[name].commit(paths, stored[name].buckets_of(touched))
    return Imported(stored["pages"].read(), stored["passages"].read(), done.stale)


def stale(stored: DataFrame, built: DataFrame, touched: DataFrame) -> DataFrame:
    """Stored passages on touched pages that the import no longer has."""
    on_touched = stored.select("pid", "doc_id", "pdf_page").distinct().join(touched.select("doc_id", "pdf_page").distinct(), ["doc_id", "pdf_page"], "left_semi")
    return on_touched.join(built.select("pid"), "pid", "left_anti")


def reviewed_precedence(para: Column, record: Column, document: Column, para_has: Column, record_has: Column) -> Column:
    """Region or topic by presence of the key, not by null: a paragraph's explicit null wins over the record and the document."""
    return F.when(para_has, para).when(record_has, record).otherwise(document)


def to_embed(passages: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Passages whose (keys, content_hash) the cache doesn't have; changed content counts as missing."""
    return passages.join(cache.select(*keys, "content_hash").distinct(), [*keys, "content_hash"], "left_anti")


def valid_cache(cache: DataFrame, catalog: DataFrame, langs: str, clean: int) -> DataFrame:
    """OCR results that still hold: checksum prefix of the current document, languages and clean flag agree."""
    docs = catalog.select(F.col("doc_id").alias("stem"), F.substring("checksum", 1, 12).alias("checksum12")).distinct()
    return cache.distinct().where((F.col("langs") == langs) & (F.col("clean") == clean)).join(docs, ["stem", "checksum12"], "left_semi")


class Snapshots:
    """Versions of a table as parquet folders by bucket of ``key``, and a manifest that names the current folder of each bucket.

    New versions of the touched buckets are written beside the old ones and the manifest changes last, so a failed import leaves
    the old version readable. Without a key the whole table is one bucket.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, root: str, key: str | None = None) -> None:
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.BUCKETS)).cast("int") if self.key else F.lit(0)

    def current(self) -> dict[str, str]:
        """Folder of each bucket, by the newest manifest."""
        fs, at = self._fs(f"{self.root}/manifest")
        if not fs.exists(at):
            return {}
        rows = self.spark.read.schema("version long, paths map<string,string>").json(f"{self.root}/manifest").collect()
        return max(rows, key=lambda r: r["version"])["paths"] if rows else {}

    def read(self) -> DataFrame | None:
        paths = self.current()
        return self.spark.read.parquet(*paths.values()) if paths else None

    def buckets_of(self, touched: DataFrame) -> set[str]:
        return {str(r[0]) for r in touched.select(self.bucket()).distinct().collect()}

    def read_touched(self, touched: DataFrame, empty: DataFrame) -> DataFrame:
        """Rows in the buckets of ``touched`` (key); there are at most BUCKETS of them."""
        wanted = self.buckets_of(touched)
        paths = [p for b, p in self.current().items() if b in wanted]
        return self.spark.read.schema(empty.schema).parquet(*paths) if paths else empty.limit(0)

    def stage(self, df: DataFrame) -> dict[str, str]:
        """Write the rows' buckets into a new version; (bucket, folder) of each."""
        path = f"{self.root}/v{time.time_ns()}"
        rows = df.withColumn("_bucket", self.bucket())
        (rows.repartition("_bucket", F.pmod(F.xxhash64(*df.columns[:1]), F.lit(4))) if self.key else rows).write.mode("errorifexists").partitionBy("_bucket").parquet(path)
        fs, at = self._fs(path)
        names = [x.getPath().getName() for x in fs.listStatus(at)]
        return {n.split("=")[1]: f"{path}/{n}" for n in names if n.startswith("_bucket=")}

    def commit(self, paths: dict[str, str], replaced: set[str] = frozenset()) -> None:
        """Make the staged folders current; ``replaced`` buckets that have no folder any more are empty."""
        kept = {b: p for b, p in self.current().items() if b not in replaced}
        entry = json.dumps({"version": time.time_ns(), "paths": kept | paths})
        self.spark.createDataFrame([(entry,)], "value string").coalesce(1).write.mode("append").text(f"{self.root}/manifest")

    def write(self, df: DataFrame) -> None:
        self.commit(self.stage(df))
