"""Sources and sinks: file listings, JSON side inputs, recognizer tables, inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, name, checksum, bytes) of a folder's files; contents are hashed on the executors."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("checksum"), F.col("length").alias("bytes")).orderBy("name")


def json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON side input, or no rows where the file is missing."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def recognizer_table(spark: SparkSession, path: str) -> DataFrame:
    """(page_num, text, mean_conf, words) of a recognizer's tab-separated words: rows of level 5 with text; 0.0 where no confidence reads."""
    rows = spark.read.csv(path, sep="\t", header=True, quote="")
    words = rows.where((F.col("level").try_cast("int") == 5) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    place = F.struct(*[F.col(c).try_cast("int") for c in ("block_num", "par_num", "line_num", "word_num")])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("at"), "text"))), lambda x: x["text"]), " ")
    return words.groupBy("page_num").agg(text.alias("text"), F.coalesce(F.round(F.avg(F.col("conf").try_cast("double")), 1), F.lit(0.0)).alias("mean_conf"), F.count("*").alias("words"))


def write_inventory(pages: DataFrame, path: str) -> None:
    pages.write.mode("errorifexists").json(path)


def write_front_matter(pages: DataFrame, path: str, first: int = 3) -> None:
    """Text files of each document's first pages, a folder per document."""
    pages.where(F.col("pdf_page") <= first).select("doc_id", F.col("raw_text").alias("value")).where("value is not null").write.mode("errorifexists").partitionBy("doc_id").text(path)


def write_trace(results: DataFrame, path: str) -> None:
    """Trace of an evaluation: one JSON line per retrieved passage, in order of query and place, non-ASCII as it is."""
    results.repartitionByRange("qid").sortWithinPartitions("qid", "place").write.mode("errorifexists").json(path)
