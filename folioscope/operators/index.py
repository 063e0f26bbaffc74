"""Inverted index of passages and BM25 ranking of batches of queries.

Postings are stored by term, in one row per block of passages. Queries read their terms' postings only; every task adds up the scores of a
block of queries over a span of blocks and keeps the best of each query, so no row stands for a query and a passage that it merely meets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import SPACE, search_tokens
from .common import cut, small

K1, B = 1.2, 0.75
FLOOR = 1e-6
POOL = 100
MAX_TERMS, MAX_TERM_CHARS = 32, 64
BUCKETS = 16
#: Passages of a block of the index, blocks of the index and queries that one task scores at once, blocks whose postings share a bucket's file.
BLOCK, SPAN, ASKED, IN_FILE = 8192, 16, 4096, 64


def tokenized(passages: DataFrame, pid: str, text: str) -> DataFrame:
    """(pid, tokens, dl) of every passage, those without tokens too."""
    tokens = passages.select(F.col(pid).alias("pid"), F.coalesce(search_tokens(F.col(text)), F.array().cast("array<string>")).alias("tokens"))
    return tokens.withColumn("dl", F.size("tokens"))


def corpus_stats(tokens: DataFrame) -> DataFrame:
    return tokens.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def doc_frequency(tokens: DataFrame) -> DataFrame:
    return tokens.select("pid", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def phrases(query: Column) -> Column:
    """Quoted terms of a query: runs of non-space, quotes stripped at the ends; those over MAX_TERM_CHARS (inner quotes doubled) are dropped, then the first MAX_TERMS stay."""
    terms = F.transform(F.split(query, f"{SPACE}+"), lambda t: F.regexp_replace(t, '^"+|"+$', ""))
    usable = lambda t: (t != "") & (F.length(F.replace(t, F.lit('"'), F.lit('""'))) <= MAX_TERM_CHARS)
    return F.slice(F.filter(terms, usable), 1, MAX_TERMS)


def query_phrases(queries: DataFrame, qid: str, text: str) -> DataFrame:
    """(qid, phrase, weight): one quoted term's tokens, parted by spaces. Repeated phrases weigh more; phrases without token match nothing and are gone."""
    each = queries.select(F.col(qid).alias("qid"), F.explode(phrases(F.col(text))).alias("_t")).select("qid", F.array_join(search_tokens(F.col("_t")), " ").alias("phrase"))
    return each.where("phrase != ''").groupBy("qid", "phrase").agg(F.count("*").alias("weight"))


def posted(pid_type: pa.DataType) -> Callable[[pa.Table], pa.Table]:
    """Postings of one block (block, pid, text of tokens parted by spaces): a row per term, and one without term that has the passages and their lengths."""

    def post(block: pa.Table) -> pa.Table:
        block = block.sort_by("pid")
        words = [t.split(" ") if t else [] for t in block["text"].to_pylist()]
        dls = np.fromiter(map(len, words), dtype=np.int32, count=len(words))
        codes, terms = pd.factorize(np.array([*chain.from_iterable(words), None], dtype=object)[:-1])
        doc = np.repeat(np.arange(len(words), dtype=np.int32), dls)
        place = (np.arange(len(doc)) - np.repeat(np.cumsum(dls) - dls, dls)).astype(np.int32)
        order = np.argsort(codes, kind="stable")
        codes, doc, place = codes[order], doc[order], place[order]
        at = np.flatnonzero(np.diff(codes, prepend=-1).astype(bool) | np.diff(doc, prepend=-1).astype(bool))
        counts, n = np.diff(at, append=len(doc)).astype(np.int32), np.arange(len(terms) + 1)
        lists = lambda values, bounds: pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, type=values.type if isinstance(values, pa.Array) else pa.int32()))
        by_doc, none = np.searchsorted(codes[at], n), np.zeros(len(terms) + 1)
        id_ = block["block"][0].as_py()
        rows = pa.table({
            "term": pa.array([*terms], type=pa.string()), "block": pa.array(np.full(len(terms), id_), type=pa.int32()),
            "docs": lists(doc[at], by_doc), "counts": lists(counts, by_doc), "places": lists(place, np.searchsorted(codes, n)),
            "pids": lists(pa.array([], type=pid_type), none), "dls": lists(np.zeros(0, dtype=np.int32), none),
        })
        whole, empty = np.array([0, len(words)]), np.zeros(2)
        nothing = lists(np.zeros(0, dtype=np.int32), empty)
        pids = block["pid"].combine_chunks().cast(pid_type)
        own = pa.table({"term": pa.array([None], type=pa.string()), "block": pa.array([id_], type=pa.int32()), "docs": nothing, "counts": nothing, "places": nothing, "pids": lists(pids, whole), "dls": lists(dls, whole)})
        return pa.concat_tables([rows, own])

    return post


def lists_of(table: pa.Table, name: str) -> list[np.ndarray]:
    """A column of lists of whole numbers, as arrays."""
    column = table[name].combine_chunks()
    bounds = column.offsets.to_numpy()
    return np.split(column.values.to_numpy()[bounds[0] : bounds[-1]], bounds[1:-1] - bounds[0]) if len(column) else []


def side_by_side(block: pa.Table, wanted: pa.Table) -> pa.Table:
    """(phrase, block, docs, counts) of the phrases of several words in one block. The rarest word's places are held against the others'."""
    out: dict[str, list] = {"phrase": [], "docs": [], "counts": []}
    terms = block["term"].to_pylist()
    keys = dict(zip(terms, zip(*(lists_of(block, x) for x in ("docs", "counts", "places")), strict=True), strict=True))
    keys = {t: (np.repeat(d.astype(np.int64), c) << 32) + p for t, (d, c, p) in keys.items()}
    for phrase in wanted["phrase"].to_pylist():
        words = phrase.split(" ")
        if any(w not in keys for w in words):
            continue
        rare = min(range(len(words)), key=lambda i: len(keys[words[i]]))
        at = keys[words[rare]] - rare
        for i, w in enumerate(words):
            if i != rare and len(at):
                found = np.searchsorted(keys[w], at + i)
                at = at[keys[w][np.minimum(found, len(keys[w]) - 1)] == at + i]
        if len(at):
            docs, counts = np.unique(at >> 32, return_counts=True)
            out["phrase"].append(phrase)
            out["docs"].append(docs)
            out["counts"].append(counts)
    n = len(out["phrase"])
    id_ = block["block"][0].as_py() if block.num_rows else 0
    whole = pa.list_(pa.int32())
    return pa.table({"phrase": pa.array(out["phrase"], type=pa.string()), "block": pa.array([id_] * n, type=pa.int32()), "docs": pa.array(out["docs"], type=whole), "counts": pa.array(out["counts"], type=whole)})


class Index:
    """Stored inverted index in a folder, by ``bucket`` of the term: ``postings`` (term, block, docs, counts, places), one row per term and block of
    passages, and ``lengths`` (block, pids, dls), one row per block. ``docs`` are places in the block's sorted ``pids``.

    The rows of a bucket are sorted by term and block, so a query reads its terms' buckets and row groups only. A frequent term
    has no more rows than there are blocks.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        rows = spark.read.parquet(root)
        self.postings = rows.where("bucket >= 0").select("term", "block", "docs", "counts", "places", "bucket")
        self.lengths = rows.where("bucket = -1").select("block", "pids", "dls")

    @staticmethod
    def write(texts: DataFrame, root: str) -> None:
        """Index of passages (pid, text), the text being its tokens parted by spaces."""
        n = texts.count()
        blocks = max(1, -(-n // BLOCK))
        kind = texts.schema["pid"].dataType
        schema = f"term string, block int, docs array<int>, counts array<int>, places array<int>, pids array<{kind.simpleString()}>, dls array<int>"
        rows = texts.select("pid", "text", F.pmod(F.xxhash64("pid"), F.lit(blocks)).cast("int").alias("block"))
        arrow = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[kind.simpleString()]
        made = rows.groupBy("block").applyInArrow(posted(arrow), schema)
        if not n:  # One block of nothing, since a folder without rows has no schema.
            made = texts.sparkSession.createDataFrame([(None, 0, [], [], [], [], [])], schema)
        made = made.withColumn("bucket", F.when(F.col("term").isNull(), -1).otherwise(bucket_of(F.col("term"))))
        parts = -(-blocks // IN_FILE)
        spread = made.repartition((BUCKETS + 1) * parts, "bucket", F.pmod("block", F.lit(parts)))
        spread.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(root)

    @classmethod
    def build(cls, passages: DataFrame, pid: str, text: str, root: str) -> Index:
        """Index of all passages in a new folder."""
        cls.write(as_texts(tokenized(passages, pid, text)), root)
        return cls(passages.sparkSession, root)

    def members(self) -> DataFrame:
        """(block, doc, pid, dl) of every passage."""
        each = self.lengths.select("block", F.posexplode(F.arrays_zip("pids", "dls")).alias("doc", "_x"))
        return each.select("block", "doc", F.col("_x.pids").alias("pid"), F.col("_x.dls").alias("dl"))

    def updated(self, passages: DataFrame, pid: str, text: str, removed: DataFrame, root: str) -> Index:
        """The index in a new folder with these passages instead of their old versions, and without those in ``removed`` (pid)."""
        new = as_texts(tokenized(passages, pid, text))
        gone = new.select("pid").unionByName(removed.select("pid")).distinct()
        stay = self.members().join(gone, "pid", "left_anti")
        each = self.postings.select("term", "block", "docs", "counts", "places").mapInArrow(one_by_one, "block int, doc int, place int, term string")
        words = each.join(stay.select("block", "doc", "pid"), ["block", "doc"]).groupBy("pid").agg(F.sort_array(F.collect_list(F.struct("place", "term"))).alias("_all"))
        old = stay.select("pid").join(words, "pid", "left").select("pid", F.coalesce(F.array_join(F.col("_all.term"), " "), F.lit("")).alias("text"))
        self.write(old.unionByName(new), root)
        return Index(passages.sparkSession, root)

    def found(self, wanted: DataFrame) -> DataFrame:
        """(phrase, block, docs, counts): passages with phrases, whose words stand side by side, and how often."""
        phrases = wanted.select("phrase").distinct()
        terms = lambda df: small(df.select(F.explode(F.split("phrase", " ")).alias("term")).distinct().withColumn("bucket", bucket_of(F.col("term"))))
        several = F.contains("phrase", F.lit(" "))
        single = self.postings.join(terms(phrases.where(~several)), ["bucket", "term"]).select(F.col("term").alias("phrase"), "block", "docs", "counts")
        longer = phrases.where(several)
        rows = self.postings.join(terms(longer), ["bucket", "term"]).select("term", "block", "docs", "counts", "places")
        asked = longer.join(self.lengths.select(F.col("block").alias("_block")))
        met = rows.groupBy("block").cogroup(asked.groupBy("_block")).applyInArrow(side_by_side, "phrase string, block int, docs array<int>, counts array<int>")
        return single.unionByName(cut(met))

    def hits(self, wanted: DataFrame) -> DataFrame:
        """(phrase, pid, tf): occurrences of phrases."""
        each = self.found(wanted).select("phrase", "block", F.explode(F.arrays_zip("docs", "counts")).alias("_x"))
        each = each.select("phrase", "block", F.col("_x.docs").alias("doc"), F.col("_x.counts").cast("long").alias("tf"))
        return each.join(self.members(), ["block", "doc"]).select("phrase", "pid", "tf")


def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, doc, place, term): postings by occurrence, some rows at a time."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        for i in range(0, table.num_rows, 1024):
            part = table.slice(i, 1024)
            docs, counts, places = (lists_of(part, x) for x in ("docs", "counts", "places"))
            n = np.fromiter(map(len, places), dtype=np.int64, count=len(places))
            doc = np.concatenate([np.repeat(d, c) for d, c in zip(docs, counts, strict=True)])
            which = pa.array(np.repeat(np.arange(len(n)), n))
            yield from pa.table({"block": part["block"].take(which), "doc": pa.array(doc, type=pa.int32()), "place": pa.array(np.concatenate(places), type=pa.int32()), "term": part["term"].take(which)}).to_batches()


def as_texts(tokens: DataFrame) -> DataFrame:
    return tokens.select("pid", F.array_join("tokens", " ").alias("text"))


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def idf() -> Column:
    out = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return F.when(out <= 0, FLOOR).otherwise(out)


def bm25(index: Index, queries: DataFrame, qid: str, query: str) -> DataFrame:
    """(qid, pid, score): negative, the best least; rounded to 9 decimals, since the order of addition isn't fixed."""
    wanted = query_phrases(queries, qid, query)
    hits = index.hits(wanted)
    df = hits.groupBy("phrase").agg(F.count("*").alias("df"))
    # One row of corpus statistics.
    stats = F.broadcast(corpus_stats(index.members()))
    weighed = df.join(stats).select("phrase", "avgdl", idf().alias("idf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    parts = hits.join(weighed, "phrase").join(index.members(), "pid").select("phrase", "pid", part.alias("part"))
    scored = parts.join(small(wanted), "phrase").groupBy("qid", "pid").agg(F.sum(F.col("weight") * F.col("part")).alias("s"))
    return scored.select("qid", "pid", F.round(-F.col("s"), 9).alias("score"))


def ranked(scores: DataFrame, pool: int = POOL) -> DataFrame:
    """(qid, pid, score, rank from 0) of the best ``pool`` of each query; ties by pid."""
    by = W.partitionBy("qid").orderBy("score", "pid")
    return scores.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= pool).withColumn("rank", F.col("rank") - 1)


def best_of_span(k: int, avgdl: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The best ``k`` passages of a span of blocks for each query of a block, ties by pid."""

    def best(found: pa.Table, asked: pa.Table) -> pa.Table:
        of_blocks = found.filter(pc.is_null(found["phrase"])) if found.num_rows else found
        if not (of_blocks.num_rows and asked.num_rows):
            return pa.table({"qid": asked["qid"].slice(0, 0), "pid": found["pids"].combine_chunks().flatten().slice(0, 0), "score": pa.array([], type=pa.float64())})
        # Passages of all blocks in the order of their ids.
        pids = of_blocks["pids"].combine_chunks().flatten()
        by_pid = pc.sort_indices(pids).to_numpy()
        pids, place = pids.take(pa.array(by_pid)), np.empty(len(by_pid), dtype=np.int64)
        place[by_pid] = np.arange(len(by_pid))
        dls = lists_of(of_blocks, "dls")
        starts = dict(zip(of_blocks["block"].to_pylist(), np.cumsum([0, *map(len, dls)]).tolist(), strict=False))
        norm = np.empty(len(by_pid))
        norm[place] = K1 * (1 - B + B * np.concatenate(dls) / avgdl)
        rows = found.filter(pc.is_valid(found["phrase"]))
        each: dict[str, list] = {}
        for phrase, block, docs, counts in zip(rows["phrase"].to_pylist(), rows["block"].to_pylist(), lists_of(rows, "docs"), lists_of(rows, "counts"), strict=True):
            each.setdefault(phrase, []).append((place[docs + starts[block]], counts))
        part = {}
        for phrase, met in each.items():
            at, tf = (np.concatenate(x) for x in zip(*met, strict=True))
            part[phrase] = at, tf, norm[at]
        weighed = {}
        for phrase, idf_ in zip(asked["phrase"].to_pylist(), asked["idf"].to_pylist(), strict=True):
            if phrase in part and phrase not in weighed:
                at, tf, n = part.pop(phrase)
                weighed[phrase] = at, idf_ * tf * (K1 + 1) / (tf + n)
        bags: dict = {}
        for qid, phrase, weight in zip(asked["qid"].to_pylist(), asked["phrase"].to_pylist(), asked["weight"].to_pylist(), strict=True):
            if phrase in weighed:
                bags.setdefault(qid, []).append((phrase, weight))
        alike: dict[tuple, list] = {}
        for qid, bag in bags.items():
            alike.setdefault(tuple(sorted(bag)), []).append(qid)
        out_q, out_at, out_s = [], [], []
        total = np.zeros(len(by_pid))
        for bag, qids in alike.items():
            for phrase, weight in bag:
                at, s = weighed[phrase]
                total[at] += weight * s
            met = np.flatnonzero(total)
            s = total[met]
            total[met] = 0
            if len(met) > k:
                # Scores are ranked as rounded: all that may tie with the k-th stay until then.
                kept = s >= np.partition(s, len(s) - k)[len(s) - k] - 2e-9
                met, s = met[kept], s[kept]
            s = np.round(-s, 9)
            order = np.lexsort((met, s))[:k]
            for qid in qids:
                out_q += [qid] * len(order)
                out_at.append(met[order])
                out_s.append(s[order])
        at = np.concatenate(out_at) if out_at else np.zeros(0, dtype=np.int64)
        return pa.table({"qid": pa.array(out_q, type=asked.schema.field("qid").type), "pid": pids.take(pa.array(at)), "score": np.concatenate(out_s) if out_s else np.zeros(0)})

    return best


def pool(index: Index, queries: DataFrame, qid: str, query: str, k: int = POOL) -> DataFrame:
    """``ranked`` of ``bm25``: (qid, pid, score, rank from 0) of the best ``k`` of each query, without a row for every passage that a query meets.

    A task gets a block of queries and a span of blocks of passages, with the postings of its queries' phrases; only each query's best leave it.
    """
    wanted = cut(query_phrases(queries, qid, query))
    found = cut(index.found(wanted))
    stats = corpus_stats(index.members()).collect()[0]
    kind = index.lengths.schema["pids"].dataType.elementType.simpleString()
    spans, n_queries = max(1, -(-index.lengths.count() // SPAN)), max(1, -(-wanted.select("qid").distinct().count() // ASKED))
    df = found.groupBy("phrase").agg(F.sum(F.size("docs")).alias("df")).withColumn("n_docs", F.lit(stats["n_docs"]))
    asked = wanted.join(small(df.select("phrase", idf().alias("idf"))), "phrase").withColumn("_q", F.pmod(F.xxhash64("qid"), F.lit(n_queries)))
    every = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)
    span = F.pmod("block", F.lit(spans)).cast("long").alias("_s")
    none = F.array().cast(f"array<{kind}>"), F.array().cast("array<int>")
    rows = found.join(small(asked.select("phrase", "_q").distinct()), "phrase").select("_q", span, "phrase", "block", "docs", "counts", none[0].alias("pids"), none[1].alias("dls"))
    own = index.lengths.select(every(n_queries, "_q"), span, F.lit(None).cast("string").alias("phrase"), "block", none[1].alias("docs"), none[1].alias("counts"), "pids", "dls")
    asked = asked.select(F.col("_q").alias("_for"), every(spans, "_over"), "qid", "phrase", F.col("weight").cast("int").alias("weight"), "idf")
    schema = f"qid {asked.schema['qid'].dataType.simpleString()}, pid {kind}, score double"
    best = rows.unionByName(own).groupBy("_q", "_s").cogroup(asked.groupBy("_for", "_over")).applyInArrow(best_of_span(k, stats["avgdl"]), schema)
    # Written, since folding and fusion read the pool more than once.
    return ranked(cut(best), k)
