"""Problem 10: spans of at least ``LEAST`` characters that stand verbatim in more than one document.

Relative Lempel-Ziv parsing, distributed. Every document is a reference: its blocks of ``BLOCK`` characters that are the least by
hash within ``STEP`` neighbouring ones are indexed, so that any ``LEAST`` characters hold an indexed block, at the same place
in every document that has them. Every document is then parsed from left to right against every reference that has one of its
blocks: a factor begins at the first block that the reference has at that distance, takes in greedily every further one that it
has at the same distance, as long as blocks overlap (so that everything between is equal too), and ends where none follows. At
both boundaries of a factor the characters are compared, so that it is the longest match; factors of ``LEAST`` characters and more are spans.

Documents with one text are parsed once, as a class. Blocks shared by very many documents are keyed more narrowly, by the
characters around them, in ``WAYS`` ways of which any two documents with a long enough span agree in one; nothing is capped.
The entries of one block are spread over ``SALTS`` keys until the block's size is known.

Defined cases: null and empty texts and texts under ``LEAST`` characters share nothing; documents with equal text share all
of it; repeated rows (same id and text) count once; ids are otherwise unique. Positions count characters from 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import GROUP_SLICE, Bloom, cut, met_in_groups, pairs_in_groups, text_key

LEAST = 200
BLOCK = 120
STEP = LEAST - BLOCK + 1
ROOM = LEAST - BLOCK
WAYS = 8
PERIOD = 40
HOT = 2 * GROUP_SLICE
#: Keys that the entries of one block are spread over.
SALTS = 16

_MIX = np.uint64(0x9E3779B97F4A7C15)


def block_hashes(codes: np.ndarray, length: int = BLOCK) -> np.ndarray:
    """Hash of every run of ``length`` characters, by doubling: runs of 1, 2, 4, ... and then the bits of ``length``."""
    mix = lambda x: (x ^ (x >> np.uint64(29))) * _MIX
    with np.errstate(over="ignore"):
        run, size, out, done = mix(codes.astype(np.uint64) + np.uint64(1)), 1, None, 0
        while True:
            if length & size:
                out = run if out is None else mix(out[: len(out) - size] * _MIX + run[done : done + len(out) - size])
                done += size
            if (size << 1) > length:
                return out ^ (out >> np.uint64(31))
            run = mix(run[:-size] * _MIX + run[size:])
            size <<= 1


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Positions that are the (last) least value of some window of ``width`` values, ascending; the whole when it is shorter."""
    n = len(values)
    if n <= width:
        return np.array([n - 1 - int(np.argmin(values[::-1]))]) if n else np.array([], dtype=np.int64)
    low, size = values, 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: n - width + 1], low[width - size : width - size + n - width + 1])
    # A value is least in some window if the least of one of the windows around it is the value itself.
    back = np.full(n + width - 1, np.uint64(0))
    back[width - 1 : width - 1 + len(low)] = low
    high, size = back, 1
    while size * 2 <= width:
        high = np.maximum(high[:-size], high[size:])
        size *= 2
    high = np.maximum(high[:n], high[width - size : width - size + n])
    return np.flatnonzero(values == high)


def thinned(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Entries without most of those of text that repeats itself within PERIOD characters, where one block stands at every period.

    Those near the ends of such a stretch stay, since every long enough overlap of two stretches can be moved to where it meets
    an end; between them one in ROOM characters stays, so that the whole stretch is still found to be shared.
    """
    again = (hashes[at[1:]] == hashes[at[:-1]]) & (np.diff(at) <= PERIOD)
    if not again.any():
        return at
    edges = np.flatnonzero(np.diff(np.concatenate([[False], again, [False]]).astype(np.int8)))
    keep = np.ones(len(at), dtype=bool)
    for first, last in edges.reshape(-1, 2):
        period = int(at[first + 1] - at[first])
        k = np.arange(first, last + 1)
        near = STEP + 2 * period
        keep[k] = (at[k] <= at[first] + near) | (at[k] >= at[last] - near) | ((k - first) % (ROOM // period) == 0)
    return at[keep]


def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Index entries of whole texts; copies of a text within a task give them once."""
    seen = set()
    for batch in batches:
        keys, places, hashes = [], [], []
        for key, text in zip(batch["text_id"], batch["text"], strict=True):
            if key in seen:
                continue
            seen.add(key)
            h = block_hashes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
            at = thinned(h, least_in_windows(h, STEP))
            keys += [key] * len(at)
            places.append(at)
            hashes.append(h[at])
        if keys:
            yield pd.DataFrame({"block": np.concatenate(hashes).view(np.int64), "text_id": keys, "place": np.concatenate(places).astype(np.int32)})


def agreeing(a: Column, b: Column) -> Column:
    """Length of the common beginning of two strings of at most ROOM (under 128) characters, by halving."""
    grow = lambda n, step: F.when((n + step <= F.least(F.length(a), F.length(b))) & (F.substr(a, F.lit(1), n + step) == F.substr(b, F.lit(1), n + step)), n + step).otherwise(n)
    return F.aggregate(F.array(*[F.lit(2**k) for k in range(6, -1, -1)]), F.lit(0), grow)


def classes_of(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_id, class_id, members) of every document with text: documents of one text are a class, named by its least id."""
    rows = documents.select(F.col(id_col).alias("doc_id"), text_key(F.col(text)).alias("text_id")).where("doc_id is not null and text_id is not null").distinct()
    named = rows.groupBy("text_id").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("members"))
    # A class may hold a third of all documents: they meet their class's name spread over the salts.
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    many = named.where("members > 1").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = salted.join(many, ["text_id", "_salt"], "left")
    return joined.select("doc_id", "text_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("members", F.lit(1)).alias("members"))


def shared_blocks(long: DataFrame) -> DataFrame:
    """(block, text_id, place, n) of the index entries whose block stands in more than one text; ``n`` is the block's size."""
    salt = F.pmod(F.xxhash64("text_id"), F.lit(SALTS)).cast("int").alias("_salt")
    index = long.select("text_id", "text").mapInPandas(entries, "block long, text_id binary, place int")
    # One exchange serves both readers of the index, since both read all its columns.
    index = index.select("block", "text_id", "place", salt).repartition("block", "_salt")
    one = F.xxhash64("text_id")
    part = index.groupBy("block", "_salt").agg(F.count("*").alias("n"), F.min(one).alias("a"), F.max(one).alias("b"), F.max("place").alias("last"))
    sizes = part.where("last >= 0").groupBy("block").agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b")).where("a != b")
    sizes = sizes.select("block", "n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return index.join(sizes, ["block", "_salt"]).select("block", "text_id", "place", "n").distinct()


def surroundings(documents: DataFrame, hits: DataFrame) -> DataFrame:
    """``hits`` (class_id, block, place, n) with the ROOM characters before (reversed) and after each block.

    Only texts with hits leave the scan, by a Bloom filter of bounded size; the list of a document's hits is bounded by its text.
    """
    places = hits.groupBy("class_id").agg(F.collect_list(F.struct("block", "place", "n")).alias("_hits"))
    with_hits = Bloom(hits.select("class_id").distinct(), "class_id")
    texts = documents.where(with_hits.may_have(F.col("doc_id"))).select(F.col("doc_id").alias("class_id"), "text")
    spread = texts.join(places, "class_id").select("class_id", "text", F.explode("_hits").alias("_h")).select("class_id", "text", "_h.*")
    before = F.reverse(F.substr("text", F.greatest(F.col("place") - ROOM, F.lit(0)) + 1, F.least("place", F.lit(ROOM))))
    # A repeated row of a document would repeat its hits.
    return spread.select("class_id", "block", "place", "n", before.alias("before"), F.substr("text", F.col("place") + BLOCK + 1, F.lit(ROOM)).alias("after")).dropDuplicates(["class_id", "place"])


def parse(met: DataFrame) -> DataFrame:
    """Factors (class_a, class_b, start_a, start_b, length) of each class_b parsed against each class_a.

    ``met`` has the blocks that both have: (class_a, class_b, place_a, place_b) and how far the characters agree at either side
    (``back``, ``on``; at most ROOM). A block within a long enough span agrees with ROOM characters around it, so others are gone before.
    """
    reading = W.partitionBy("class_a", "class_b", "lag").orderBy("place_b")
    met = met.where(F.col("back") + F.col("on") >= ROOM).withColumn("lag", F.col("place_a") - F.col("place_b"))
    follows = F.col("place_b") - F.lag("place_b").over(reading) <= BLOCK
    factors = met.withColumn("_begins", F.when(follows, 0).otherwise(1)).withColumn("_factor", F.sum("_begins").over(reading.rowsBetween(W.unboundedPreceding, 0)))
    ends = factors.groupBy("class_a", "class_b", "lag", "_factor").agg(F.min(F.col("place_b") - F.col("back")).alias("start_b"), F.max(F.col("place_b") + F.col("on") + BLOCK).alias("end_b"))
    spans = ends.where(F.col("end_b") - F.col("start_b") >= LEAST)
    return spans.select("class_a", "class_b", (F.col("start_b") + F.col("lag")).alias("start_a"), "start_b", (F.col("end_b") - F.col("start_b")).alias("length"))


def factors(documents: DataFrame, classes: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Longest common spans between classes of documents: (class_a, class_b, start_a, start_b, length), class_a < class_b."""
    long = documents.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).where((F.length("text") >= LEAST) & F.col("doc_id").isNotNull())
    shared = shared_blocks(long.select(text_key(F.col("text")).alias("text_id"), "text"))
    named = classes.where("doc_id = class_id").select("text_id", "class_id")
    hits = cut(shared.join(named, "text_id").select("class_id", "block", "place", "n"))
    blocks = surroundings(long, hits)
    step = ROOM // WAYS
    narrow = lambda k: F.xxhash64("block", F.lit(k), F.substr("before", F.lit(1), F.lit(k * step)), F.substr("after", F.lit(1), F.lit(ROOM - (k + 1) * step)))
    keys = F.when(F.col("n") <= HOT, F.array(F.col("block"))).otherwise(F.array(*[narrow(k) for k in range(WAYS)]))
    keyed = cut(blocks.select("class_id", "place", "before", "after", F.explode(keys).alias("key")))
    met = met_in_groups(keyed, "key", "class_id", F.count_distinct("class_id"))
    both = [F.col(f"{x}.{name}").alias(f"{as_}_{y}") for x, y in (("l", "a"), ("r", "b")) for name, as_ in (("class_id", "class"), ("place", "place"))]
    met = met.select(*both, agreeing(F.col("l.before"), F.col("r.before")).alias("back"), agreeing(F.col("l.after"), F.col("r.after")).alias("on"))
    return parse(met)


def sharing_pairs(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every two documents (doc_a < doc_b) with at least LEAST characters in common."""
    classes = cut(classes_of(documents.where(F.length(text) >= LEAST), id_col, text))
    between = factors(documents, classes, id_col, text).select("class_a", "class_b").distinct()
    # Members of large classes are spread over slices of it; most classes have one slice.
    slices = F.ceil(F.col("members") / GROUP_SLICE)
    sizes = classes.where("doc_id = class_id")
    pairs = between
    for x in "ab":
        name = f"class_{x}"
        pairs = pairs.join(sizes.select(F.col("class_id").alias(name), slices.alias("_slices")), name).withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slices") - 1))).drop("_slices")
        members = classes.select(F.col("doc_id").alias(f"doc_{x}"), F.col("class_id").alias(name), F.pmod(F.xxhash64("doc_id"), slices).alias("_slice"))
        pairs = pairs.join(members, [name, "_slice"]).drop("_slice", name)
    within = pairs_in_groups(classes.where("members > 1"), "class_id", "doc_id").toDF("doc_a", "doc_b")
    pairs = pairs.unionByName(within)
    return pairs.select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b")).distinct()


def shared_portions(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_share, spans, copies): how much of each document stands elsewhere too."""
    sizes = documents.select(F.col(id_col).alias("doc_id"), F.length(text).alias("n_chars")).where("doc_id is not null and n_chars is not null").distinct()
    classes = cut(classes_of(documents, id_col, text))
    found = cut(factors(documents, classes, id_col, text).distinct())
    spans = found.select(F.col("class_a").alias("class_id"), F.col("start_a").alias("start"), (F.col("start_a") + F.col("length")).alias("end"))
    spans = spans.unionByName(found.select(F.col("class_b").alias("class_id"), F.col("start_b").alias("start"), (F.col("start_b") + F.col("length")).alias("end")))
    # Of the spans that begin at one place only the longest matters, so a document's spans are bounded by its length.
    spans = spans.groupBy("class_id", "start").agg(F.max("end").alias("end"))
    so_far = F.max("end").over(W.partitionBy("class_id").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    covered = spans.withColumn("_to", F.coalesce(so_far, F.lit(-1)))
    covered = covered.groupBy("class_id").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "_to"))).alias("covered"), F.count_if(F.col("start") > F.col("_to")).alias("spans"))
    out = sizes.join(classes, "doc_id").join(covered, "class_id", "left")
    whole = (F.col("members") > 1) & (F.col("n_chars") >= LEAST)
    shared = F.when(whole, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0))).cast("int")
    return out.select("doc_id", "n_chars", shared.alias("shared_chars"), F.round(shared / F.greatest("n_chars", F.lit(1)), 6).alias("shared_share"), F.when(whole, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("int").alias("spans"), F.col("members").cast("int").alias("copies"))
