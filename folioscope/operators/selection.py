"""Page selections: ``doc:1-3,5;other:2``, parsed on the driver into a small table and joined."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_pages(text: str) -> list[tuple[str, int, int]]:
    """(doc_id, from, to) ranges of a selection."""
    out = []
    for part in filter(None, (x.strip() for x in text.split(";"))):
        doc, colon, pages = part.rpartition(":")
        if not colon or not doc:
            raise ValueError(f"{part!r} isn't document:pages")
        for piece in filter(None, (x.strip() for x in pages.split(","))):
            low, _, high = piece.partition("-")
            first, last = int(low), int(high or low)
            if first < 1 or last < first:
                raise ValueError(f"{piece!r} is no range of pages")
            out.append((doc, first, last))
    return out


def selection(demo: list[tuple[str, int]] | None = None, docs: str | None = None, pages: str | None = None, everything: bool = False) -> tuple[list[tuple[str, int, int]], list[str]]:
    """(ranges, whole documents) of exactly one form: given anchor pages, names of documents, ``pages`` as above, or all; no names at all stand for all."""
    if sum([demo is not None, docs is not None, pages is not None, everything]) != 1:
        raise ValueError("choose exactly one of demo, docs, pages, everything")
    if demo is not None:
        return [(doc, page, page) for doc, page in demo], []
    if docs is not None:
        names = [x.strip() for x in docs.split(",") if x.strip()]
        if not names:
            raise ValueError("no document is named")
        return [], names
    return (parse_pages(pages), []) if pages is not None else ([], [])


def selected(table: DataFrame, ranges: list[tuple[str, int, int]], docs: list[str]) -> DataFrame:
    """Pages of a selection()."""
    if ranges:
        return select_pages(table, table.sparkSession.createDataFrame(ranges, "doc_id string, first int, last int"))
    return table.where(F.col("doc_id").isin(docs)) if docs else table


def select_pages(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pages within any of the (doc_id, first, last) ranges, once each."""
    wanted = ranges.select("doc_id", F.explode(F.sequence("first", "last")).alias("pdf_page")).distinct()
    return pages.join(wanted, ["doc_id", "pdf_page"], "left_semi")


def ranges_table(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(parse_pages(text), "doc_id string, first int, last int")


@dataclass(frozen=True)
class SearchParams:
    """Checked inputs of a search."""

    query: str
    top_k: int = 5
    doc_ids: tuple[str, ...] = ()
    region: str | None = None
    topic: str | None = None
    lang: str | None = None
    pid: str | None = None
    context_chars: int = 600

    def __post_init__(self) -> None:
        if not 1 <= len(self.query) <= 500:
            raise ValueError("query must have 1 to 500 characters")
        if not 1 <= self.top_k <= 10:
            raise ValueError("top_k must be 1 to 10")
        if len(self.doc_ids) > 10:
            raise ValueError("at most 10 documents")
        if any(len(x or "") > 80 for x in (self.region, self.topic)):
            raise ValueError("region and topic have at most 80 characters")
        if self.pid is not None and not 1 <= len(self.pid) <= 200:
            raise ValueError("a passage id has 1 to 200 characters")
        if not 0 <= self.context_chars <= 2000:
            raise ValueError("context must be 0 to 2000 characters")
