"""The pN_ queries: every one runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import p01_format_duplicates as p01
from . import p02_scan_noise as p02
from . import p03_page_kinds as p03
from . import p04_encodings as p04
from . import p05_repeated_lines as p05
from . import p06_visual_forms as p06
from . import p07_languages as p07
from . import p08_containers as p08
from . import p09_mixing as p09
from . import p10_shared_spans as p10
from .common import load

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p01.duplicate_pairs(load(spark, sf_dir, "passages"), "pid", "text_search").toDF("pid_a", "pid_b")


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p01.collapse(load(spark, sf_dir, "passages"), "pid", "text_search")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p02.defects(load(spark, sf_dir, "pages")).select("doc_id", "pdf_page", "line_no", "defect").distinct()


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p02.repaired(load(spark, sf_dir, "pages"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = p03.kinds(load(spark, sf_dir, "pages"), load(spark, sf_dir, "common_words"), ["doc_id", "pdf_page"])
    return kinds.where(F.col("kind").isin("list", "table", "junk")).select("doc_id", "pdf_page", "kind").distinct()


def p3_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p03.kinds(load(spark, sf_dir, "pages"), load(spark, sf_dir, "common_words"), ["doc_id", "pdf_page"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    return p04.restore(pages, p04.train(pages), ["doc_id", "pdf_page"]).select("doc_id", "pdf_page").distinct()


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    return p04.restore(pages, p04.train(pages), ["doc_id", "pdf_page"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p05.page_lines(load(spark, sf_dir, "pages")).select("doc_id", "pdf_page", "line_no")


def p5_clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p05.without_repeated(load(spark, sf_dir, "pages"))


def p5_source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p05.document_lines(load(spark, sf_dir, "documents"))


def p5_clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p05.clean_documents(load(spark, sf_dir, "documents"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p06.look_alike_pairs(load(spark, sf_dir, "passages"), "pid", "text_raw").toDF("pid_a", "pid_b")


def p6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p06.consistent(load(spark, sf_dir, "passages"), "pid", "text_raw")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = p07.train(load(spark, sf_dir, "lang_samples"))
    return p07.wanting(load(spark, sf_dir, "passages"), model, "pid", "text_raw", "lang").withColumnRenamed("id", "pid")


def p7_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = p07.train(load(spark, sf_dir, "lang_samples"))
    return p07.identify(load(spark, sf_dir, "passages"), model, "pid", "text_raw").withColumnRenamed("id", "pid")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p08.pack(load(spark, sf_dir, "documents"), load(spark, sf_dir, "container_specs"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p08.fill(p8_containers(spark, sf_dir))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p09.mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p09.shares(p9_mix(spark, sf_dir), load(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10.sharing_pairs(load(spark, sf_dir, "documents"))


def p10_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10.shared_portions(load(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit() and callable(f)}
