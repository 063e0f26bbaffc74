"""Problem 5: lines that stand on many pages of one book, or in many documents of one source.

Copies of a document are collapsed first; then each line is counted over distinct clusters of its source (and, where a
date is given, over distinct dates), so that a republished text doesn't make its lines boilerplate. Counting is two
partial aggregations on (source, line): a source with a tenth or a third of all rows is spread by its lines.

Lines are compared by their letters and digits only, without case, after taking off one free-standing number at the line's
start and one at its end. Lines with fewer than ``MIN_CHARS`` letters and digits never count.

Defined cases: null, empty and blank texts have no lines; pages without a doc_id belong to no book; a null source of
articles is a source of its own; repeated rows count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_key
from .p01_format_duplicates import letters_and_digits

MIN_CHARS = 15
MIN_CLUSTERS = 5
#: Keys that the lines of one spelling are spread over.
SALTS = 16


def bare_line(line: Column) -> Column:
    """Letters and digits that a line is compared by."""
    bare = F.regexp_replace(line, r"^[^\p{L}\p{N}]*\p{N}+[^\p{L}\p{N}\s\p{Z}]*(?=[\s\p{Z}]|$)", "")
    bare = F.regexp_replace(bare, r"(?<![^\s\p{Z}])[^\p{L}\p{N}\s\p{Z}]*\p{N}+[^\p{L}\p{N}]*$", "")
    return letters_and_digits(bare)


def lines_of(rows: DataFrame, source: str, ids: list[str], text: str) -> DataFrame:
    """Lines with their number from 1: source, ids, ``line_no``, ``line``, ``line_id`` (null for lines that can't count).

    The key is made before the lines are exploded, so that it is made once and not again by every filter on it.
    """
    keyed = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), bare_line(x).alias("bare")))
    columns = list(dict.fromkeys([source, *ids]))
    lines = rows.select(*columns, F.posexplode(keyed).alias("_pos", "_line"))
    line_id = F.when(F.length("_line.bare") >= MIN_CHARS, text_key(F.col("_line.bare")))
    return lines.select(*columns, (F.col("_pos") + 1).cast("int").alias("line_no"), F.col("_line.line").alias("line"), line_id.alias("line_id"))


def spread(lines: DataFrame, cluster: list[str]) -> DataFrame:
    """The lines that can count, (group, line_id, cluster, line_no), in one exchange that serves counting and looking up.

    A cluster's lines have one salt, so that a line that stands in all of a source's documents is in no one task.
    """
    salt = F.pmod(F.xxhash64(*cluster), F.lit(SALTS)).cast("int").alias("_salt")
    return lines.where("line_id is not null").select("group", "line_id", *cluster, "line_no", salt).repartition("group", "line_id", "_salt")


def repeated(lines: DataFrame, cluster: list[str], dates: str | None = None, least: int = MIN_CLUSTERS, least_dates: int = 1) -> DataFrame:
    """(group, line_id, clusters, dates): lines (of ``spread``) on at least ``least`` distinct clusters of their group, and ``least_dates`` distinct dates where dates are given.

    Clusters are counted by salt, where each has its own, and summed. A line has at most as many days as the calendar.
    """
    keys = ["group", "line_id"]
    seen = lines.groupBy(*keys, "_salt", *cluster).agg(F.min("line_no").alias("_first"))  # reads every column, so that the exchange is shared
    days = F.collect_set(dates) if dates else F.array(F.lit(None).cast("date"))
    part = seen.where("_first > 0").groupBy(*keys, "_salt").agg(F.count("*").alias("_n"), days.alias("_days"))
    count = part.groupBy(*keys).agg(F.sum("_n").cast("int").alias("clusters"), F.size(F.array_distinct(F.flatten(F.collect_list("_days")))).alias("dates"))
    return count.where((F.col("clusters") >= least) & (F.col("dates") >= least_dates))


def standing(lines: DataFrame, counts: DataFrame) -> DataFrame:
    """The lines (of ``spread``) that are among the repeated ones."""
    each = counts.select("group", "line_id", "clusters", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return lines.join(each, ["group", "line_id", "_salt"]).drop("_salt")


def page_lines(pages: DataFrame) -> DataFrame:
    """Repeated lines of each book: (doc_id, pdf_page, line_no, clusters). The clusters are the book's pages; repeated rows of a page collapse into one."""
    lines = spread(lines_of(pages.where("doc_id is not null").withColumn("group", F.col("doc_id")), "group", ["pdf_page"], "raw_text"), ["pdf_page"])
    found = standing(lines, repeated(lines, ["pdf_page"]))
    return found.select(F.col("group").alias("doc_id"), "pdf_page", "line_no", "clusters").distinct()


def without_repeated(pages: DataFrame) -> DataFrame:
    """(doc_id, pdf_page, clean_text, removed_lines) of every page with text, its repeated lines taken out."""
    found = page_lines(pages).groupBy(F.col("doc_id").alias("_doc"), F.col("pdf_page").alias("_page")).agg(F.collect_set("line_no").alias("_out"))
    once = pages.select("doc_id", "pdf_page", "raw_text").where("raw_text is not null").dropDuplicates()
    kept = F.filter(F.split("raw_text", "\n"), lambda _, i: ~F.array_contains(F.col("_out"), (i + 1).cast("int")))
    joined = once.join(found, F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("pdf_page").eqNullSafe(F.col("_page")), "left")
    return joined.select("doc_id", "pdf_page", F.when(F.col("_out").isNull(), F.col("raw_text")).otherwise(F.array_join(kept, "\n")).alias("clean_text"), F.coalesce(F.size("_out"), F.lit(0)).cast("int").alias("removed_lines"))


def article_lines(documents: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, lines by cluster, repeated lines) of the articles.

    Documents with the same text of one source are one cluster, dated by its first publication, so that an article
    published again counts once. A group is a source; the null source is a group of its own.
    """
    group = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    once = documents.select(group.alias("group"), "text", "created_at").where("text is not null")
    clusters = once.groupBy("group", text_key(F.col("text")).alias("cluster")).agg(F.any_value("text").alias("text"), F.to_date(F.min("created_at")).alias("day"))
    lines = lines_of(clusters, "group", ["cluster", "day"], "text")
    apart = spread(lines, ["cluster", "day"])
    return lines, apart, repeated(apart, ["cluster", "day"], "day", least, 2)


def document_lines(documents: DataFrame, least: int = MIN_CLUSTERS) -> DataFrame:
    """Repeated lines of each source of the articles: (source, line, clusters, dates)."""
    lines, _, counts = article_lines(documents, least)
    named = lines.where("line_id is not null").groupBy("group", "line_id").agg(F.min("line").alias("line"))
    source = F.when(F.col("group") != "", F.substr("group", F.lit(2)))
    return counts.join(named, ["group", "line_id"]).select(source.alias("source"), "line", "clusters", "dates")


def clean_documents(documents: DataFrame, least: int = MIN_CLUSTERS) -> DataFrame:
    """(doc_id, clean_text, removed_lines) of every article with text, without the lines repeated within its source."""
    _, apart, counts = article_lines(documents, least)
    found = standing(apart, counts).groupBy("group", "cluster").agg(F.collect_set("line_no").alias("_out"))
    # Copies of one text may be a third of all documents: they meet their cluster's lines in as many tasks as there are salts.
    found = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    group = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    rows = documents.select("doc_id", group.alias("group"), "text").where("text is not null").dropDuplicates()
    rows = rows.withColumns({"cluster": text_key(F.col("text")), "_salt": F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")})
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(F.col("_out"), (i + 1).cast("int")))
    joined = rows.join(found, ["group", "cluster", "_salt"], "left")
    return joined.select("doc_id", F.when(F.col("_out").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("clean_text"), F.coalesce(F.size("_out"), F.lit(0)).cast("int").alias("removed_lines"))
