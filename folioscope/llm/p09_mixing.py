"""Problem 9: sources mixed to target shares of all tokens, by Poisson replication.

Every distinct text gets a uniform number from a seeded hash of its id, and the number of its copies is the inverse of a Poisson
distribution, cut at the source's cap, at that number; the mean is the source's target repetition rate. For fixed numbers the copies only grow
with the mean, so the mean of each source is then adjusted on the numbers drawn until its tokens meet the target (sums per source
over a grid of means, nothing else comes to the driver). The copies are exploded and shuffled globally by a hash.

The total is the largest that every source can give below its cap (HEADROOM of it), or ``total_tokens``.

Defined cases: sources without target, null sources and texts without tokens get nothing; documents with one text are one text, of the
least id's source, so that no text is used more often than its cap; targets without documents give nothing and show a share of 0; a cap of null or below 1 is taken as 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_key
from .tokens import token_counter

HEADROOM = 0.9
GRID = 9
ROUNDS = 5
SEED = 20


def cumulative(mean: float, cap: int) -> list[float]:
    """P(count <= k) for k below the cap: a text with number u has as many copies as there are entries not above u."""
    p, out, total = math.exp(-mean), [], 0.0
    for k in range(cap):
        total += p
        out.append(min(total, 1.0))
        p *= mean / (k + 1)
    return out


def mean_for(rate: float, cap: int) -> float:
    """Poisson mean whose expectation, cut at the cap, is the rate."""
    lo, hi = 0.0, 60.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(1 - c for c in cumulative(mid, cap)) < rate else (lo, mid)
    return hi


def uniform(*of: str) -> Column:
    """Number in [0, 1) from a seeded hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *of), 11) / float(1 << 53)


def texts_of(documents: DataFrame, id_col: str, text: str, source: str, counter: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, source, tokens) of every distinct text, under its least id."""
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("_text")).where("doc_id is not null and length(_text) > 0")
    rows = rows.select("doc_id", "source", text_key(F.col("_text")).alias("_key"), counter(F.col("_text")).alias("tokens"))
    return rows.groupBy("_key").agg(F.min_by(F.struct("doc_id", "source", "tokens"), "doc_id").alias("_d")).select("_d.*")


def mix(documents: DataFrame, targets: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", total_tokens: int | None = None, counter: Callable[[Column], Column] | None = None) -> DataFrame:
    """(source, doc_id, copy, tokens, shuffle_key), in the order of shuffle_key: the selection, one row per use of a text."""
    spark = documents.sparkSession
    wanted = {r["source"]: (r["target_share"], max(0, r["max_repeats"] or 0)) for r in targets.select("source", "target_share", "max_repeats").where("source is not null and target_share > 0").collect()}
    listed = F.broadcast(spark.createDataFrame([(s,) for s in wanted], "source string"))
    texts = cut(texts_of(documents, id_col, text, source, counter or token_counter()).join(listed, "source", "left_semi").withColumn("u", uniform("doc_id")))
    have = {r["source"]: r["n"] for r in texts.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    usable = {s: x for s, x in wanted.items() if have.get(s) and x[1]}
    total = total_tokens or HEADROOM * min((cap * have[s] / share for s, (share, cap) in usable.items()), default=0)
    goal = {s: min(total * share, cap * have[s]) for s, (share, cap) in usable.items()}
    means = {s: mean_for(goal[s] / have[s], usable[s][1]) for s in usable}
    width = {s: 0.5 for s in usable}
    for _ in range(ROUNDS if usable else 0):
        grid = [(s, j, cumulative(means[s] * (1 + width[s] * (2 * j / (GRID - 1) - 1)), usable[s][1])) for s in usable for j in range(GRID)]
        tried = texts.join(F.broadcast(spark.createDataFrame(grid, "source string, j int, cdf array<double>")), "source")
        sums = {(r["source"], r["j"]): r["n"] for r in tried.groupBy("source", "j").agg(F.sum(copies() * F.col("tokens")).alias("n")).collect()}
        for s in usable:
            j = min(range(GRID), key=lambda j: (abs(sums[(s, j)] - goal[s]), j))
            means[s] *= 1 + width[s] * (2 * j / (GRID - 1) - 1)
            width[s] /= (GRID - 1) / 2
    table = F.broadcast(spark.createDataFrame([(s, cumulative(means[s], usable[s][1])) for s in usable], "source string, cdf array<double>"))
    used = texts.join(table, "source").withColumn("n", copies()).where("n > 0")
    used = used.select("source", "doc_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"), "tokens")
    return used.withColumn("shuffle_key", F.xxhash64(F.lit(SEED + 1), "doc_id", "copy")).orderBy("shuffle_key")


def copies() -> Column:
    return F.size(F.filter("cdf", lambda c: c <= F.col("u")))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, texts, most_repeats, max_repeats) of every target."""
    each = mixed.groupBy("source", "doc_id").agg(F.sum("tokens").alias("tokens"), F.max("copy").alias("most"))
    each = each.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("texts"), F.max("most").alias("most_repeats"))
    total = each.agg(F.sum("tokens").alias("_total"))
    out = targets.select("source", "target_share", "max_repeats").join(each, "source", "left").join(F.broadcast(total), how="left")
    share = F.round(F.coalesce(F.col("tokens") / F.col("_total"), F.lit(0.0)), 6)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("source", "target_share", share.alias("actual_share"), zero("tokens"), zero("texts"), zero("most_repeats"), "max_repeats")
