"""Problem 8: texts laid into containers of fixed capacity, by large-item matching.

Sizes are whole numbers of tokens up to the capacity, so the plan works on the histogram of sizes, which has at most one entry per
size whatever the corpus: items above a third of the capacity are matched greedily, two to a container at most (the largest with
the largest that fits beside it); the smaller ones, in falling size, fill the tightest gap that takes them. Containers filled alike
are one pattern with a number. Only the histogram comes to the driver and only the patterns go back; every text then finds its container by
its rank among the texts of its size, ranked in slices so that a size with a third of all rows is spread.

Texts above the capacity are cut into pieces of the capacity, and the rest is an item like any other; nothing else is cut.

Defined cases: null and empty texts have no tokens and are laid nowhere; repeated rows (same id and text) count once; specs with null or
no capacity are left out; ties among texts of one size go by slice and id.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import cut
from .tokens import token_counter

#: Rows of one size that are ranked together, about.
SLICE = 200_000


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (size, first rank, end rank, items per container, first container) for items of at most the capacity."""
    left = {s: n for s, n in histogram.items() if n > 0}
    patterns: list[tuple[tuple[tuple[int, int], ...], int]] = []  # of (size, items), and how many containers
    sizes = sorted(s for s in left if 3 * s > capacity)
    while sizes:
        s = sizes.pop()
        n = left.pop(s)
        while n:
            at = bisect.bisect_right(sizes, capacity - s) - 1
            if 2 * s <= capacity and n > 1:
                patterns.append((((s, 2),), n // 2))
                n %= 2
            elif at >= 0:
                t = sizes[at]
                k = min(n, left[t])
                patterns.append((((s, 1), (t, 1)), k))
                n -= k
                left[t] -= k
                if not left[t]:
                    sizes.pop(at)
                    del left[t]
            else:
                patterns.append((((s, 1),), n))
                n = 0
    gaps: defaultdict[int, list[int]] = defaultdict(list)
    counts = []
    for i, (items, k) in enumerate(patterns):
        gaps[capacity - sum(s * q for s, q in items)].append(i)
        counts.append(k)
    shapes = [items for items, _ in patterns]
    open_gaps = sorted(gaps)

    def put(shape: tuple, k: int, gap: int) -> None:
        if k:
            shapes.append(shape)
            counts.append(k)
            if gap not in gaps or not gaps[gap]:
                bisect.insort(open_gaps, gap)
            gaps[gap].append(len(shapes) - 1)

    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            at = bisect.bisect_left(open_gaps, s)
            if at == len(open_gaps):
                q = capacity // s
                put(((s, q),), n // q, capacity - q * s)
                if n % q:
                    put(((s, n % q),), 1, capacity - n % q * s)
                n = 0
                break
            gap = open_gaps[at]
            i = gaps[gap].pop()
            if not gaps[gap]:
                open_gaps.pop(at)
            q, k, shape = gap // s, counts[i], shapes[i]
            full = min(k, n // q)
            counts[i] = 0
            put((*shape, (s, q)), full, gap - q * s)
            n -= full * q
            if full < k:
                put((*shape, (s, n)) if n else shape, 1 if n else 0, gap - n * s)
                put(shape, k - full - (1 if n else 0), gap)
                n = 0
    slots, ranks, first = [], defaultdict(int), 0
    for shape, k in zip(shapes, counts, strict=True):
        if k:
            for s, q in shape:
                slots.append((s, ranks[s], ranks[s] + q * k, q, first))
                ranks[s] += q * k
            first += k
    return slots


def pieces_of(sizes: DataFrame, specs: list[tuple[str, int]]) -> DataFrame:
    """(spec, doc_id, piece, first_token, tokens): every text for every spec, cut where it exceeds the capacity."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("spec"), F.lit(c).cast("long").alias("capacity")) for i, (_, c) in enumerate(specs)]))
    rows = sizes.where("tokens > 0").select("doc_id", "tokens", each.alias("_s")).select("doc_id", "tokens", "_s.*")
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("tokens") / F.col("capacity")).cast("int") - 1)))
    first = F.col("piece") * F.col("capacity")
    return rows.select("spec", "doc_id", "piece", first.alias("first_token"), F.least("capacity", F.col("tokens") - first).alias("tokens"))


def place(slots: list[tuple[int, int, int, int, int, int]]) -> Callable[[Column, Column, Column], Column]:
    """Column function of (spec, size, rank): the container."""
    table = np.array(sorted(slots), dtype=np.int64).reshape(-1, 6)
    # Ranks restart with every (spec, size), so one search finds the spec and size and then the rank.
    starts = {}
    for i, row in enumerate(table):
        starts.setdefault((int(row[0]), int(row[1])), [i, i])[1] = i + 1

    @F.pandas_udf(T.LongType())
    def container(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for spec, size, rank in batches:
            out = np.full(len(spec), -1, dtype=np.int64)
            frame = pd.DataFrame({"spec": spec.to_numpy(), "size": size.to_numpy(), "rank": rank.to_numpy()})
            for key, part in frame.groupby(["spec", "size"], sort=False):
                lo, hi = starts[(int(key[0]), int(key[1]))]
                ranks = part["rank"].to_numpy()
                i = lo + np.searchsorted(table[lo:hi, 2], ranks, side="right") - 1
                out[part.index.to_numpy()] = table[i, 5] + (ranks - table[i, 2]) // table[i, 4]
            yield pd.Series(out)

    return container


def pack(documents: DataFrame, specs: DataFrame, id_col: str = "doc_id", text: str = "text", counter: Callable[[Column], Column] | None = None) -> DataFrame:
    """(spec_name, capacity_tokens, container, doc_id, piece, first_token, tokens): every text of every spec in its container."""
    chosen = sorted({(r["spec_name"], int(r["capacity_tokens"])) for r in specs.select("spec_name", "capacity_tokens").where("capacity_tokens > 0").collect()}, key=str)
    counter = counter or token_counter()
    sizes = documents.select(F.col(id_col).alias("doc_id"), F.col(text).alias("_text")).where(F.col("doc_id").isNotNull())
    sizes = cut(sizes.select("doc_id", counter(F.col("_text")).alias("tokens")).distinct())
    if not chosen:
        chosen = [("none", 0)]
        sizes = sizes.limit(0)
    items = pieces_of(sizes, [(name, max(c, 1)) for name, c in chosen])
    histogram = items.groupBy("spec", "tokens").agg(F.count("*").alias("n")).toPandas()
    slices = max(1, -(-int(histogram["n"].max() if len(histogram) else 0) // SLICE))
    slots = []
    for i, (_, capacity) in enumerate(chosen):
        own = histogram[histogram["spec"] == i]
        slots += [(i, *row) for row in plan(dict(zip(own["tokens"].astype(int), own["n"].astype(int), strict=True)), capacity)]
    items = items.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)).cast("int"))
    before = F.sum("_n").over(W.partitionBy("spec", "tokens").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
    offsets = items.groupBy("spec", "tokens", "_slice").agg(F.count("*").alias("_n")).select("spec", "tokens", "_slice", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(W.partitionBy("spec", "tokens", "_slice").orderBy("doc_id", "piece")) - 1
    ranked = items.withColumn("_rank", rank)
    ranked = (ranked.join(offsets, ["spec", "tokens", "_slice"]).withColumn("_rank", F.col("_rank") + F.col("_before")) if slices > 1 else ranked).withColumn("_rank", F.col("_rank").cast("long"))
    names = F.array(*[F.lit(name) for name, _ in chosen])
    capacities = F.array(*[F.lit(c) for _, c in chosen])
    return ranked.select(names[F.col("spec")].alias("spec_name"), capacities[F.col("spec")].alias("capacity_tokens"), place(slots)(F.col("spec"), F.col("tokens"), F.col("_rank")).alias("container"), "doc_id", "piece", "first_token", "tokens")


def fill(packed: DataFrame) -> DataFrame:
    """(spec_name, capacity_tokens, containers, tokens, pieces, fill_share) of each spec."""
    each = packed.groupBy("spec_name", "capacity_tokens", "container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    total = each.groupBy("spec_name", "capacity_tokens").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.sum("pieces").alias("pieces"), F.max("tokens").alias("fullest"))
    return total.withColumn("fill_share", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))
