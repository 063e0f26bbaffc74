"""Spend ledger: totals, batches, admission against a cap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Price, worst-case factor, batch limits.
PRICE_PER_MILLION, WORST_CASE = 0.02, 1.5
BATCH_TOKENS, BATCH_ITEMS = 150_000, 100


def cost(tokens: Column, price: float = PRICE_PER_MILLION) -> Column:
    return tokens / 1e6 * price


def money(value: Column) -> Column:
    """Exact sums: no order of addition changes the last digit."""
    return value.cast("decimal(18,8)")


def totals(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Committed (reported cost, else estimate), reserved (reserves less releases) and tokens; 0 where empty. Repeated rows count once."""
    of = lambda kind, value: F.coalesce(F.sum(F.when(F.col("kind") == kind, money(value))), money(F.lit(0)))
    committed = of("commit", F.coalesce("cost_reported_usd", "cost_est_usd"))
    reserved = of("reserve", F.col("cost_est_usd")) - of("release", F.col("cost_est_usd"))
    tokens = F.coalesce(F.sum(F.when(F.col("kind") == "commit", F.coalesce("tokens_reported", "tokens_est"))), F.lit(0))
    rows = log.distinct()
    usd = lambda x, name: F.round(x, 6).cast("double").alias(name)
    out = [usd(committed, "committed_usd"), usd(reserved, "reserved_usd"), tokens.alias("tokens")]
    return rows.groupBy(*by).agg(*out) if by else rows.agg(*out)


def batches(items: DataFrame, group: str, order: list[str], tokens: str, max_tokens: int = BATCH_TOKENS, max_items: int = BATCH_ITEMS, segment: Column | None = None) -> DataFrame:
    """``items`` with ``batch`` (from 0 in each group): greedy packing in order; a batch closes at max_items, or before it would exceed max_tokens.

    ``segment`` cuts a group into ranges of its order that go to different tasks. Which batch is open where a segment begins depends on
    the one before, but a batch ends within max_items items: every segment first tells, for each item that a batch may begin
    at, where the first batch of the next segment begins and how many batches that takes; these short tables are followed
    from segment to segment, and then every segment packs its items for itself.
    """
    rows = items.withColumn("_segment", (segment if segment is not None else F.lit(0)).cast("long"))
    keys = [group, "_segment"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    of_group, columns = items.schema[group].dataType.simpleString(), items.columns

    def packed(sizes: list[int], start: int) -> tuple[list[int], int]:
        """Where batches begin from ``start`` on, and the items of the last one."""
        begins, n, total = [], 0, 0
        for i in range(start, len(sizes)):
            if not begins or n >= max_items or total + sizes[i] > max_tokens:
                begins.append(i)
                n, total = 0, 0
            n, total = n + 1, total + sizes[i]
        return begins, n

    def exits(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        """For each item at which a batch may begin: how many batches begin from there on, and the open one's items and tokens."""
        sizes = part.sort_values(order)[tokens].fillna(0).astype("int64").tolist()
        # Backwards: where the batch that begins at an item ends.
        n = len(sizes)
        ends, end, total = [0] * n, n, 0
        for i in range(n - 1, -1, -1):
            total += sizes[i]
            while end - i > max_items or (total > max_tokens and end - i > 1):
                end -= 1
                total -= sizes[end]
            ends[i] = end
        count, last = [0] * (n + 1), list(range(n + 1))
        for i in range(n - 1, -1, -1):
            count[i], last[i] = (1, i) if ends[i] == n else (count[ends[i]] + 1, last[ends[i]])
        prefix = np.concatenate([[0], np.cumsum(sizes)])
        most = min(n, max_items) + 1
        table = [[count[i], n - last[i] if i < n else 0, int(prefix[n] - prefix[last[i]]) if i < n else 0] for i in range(most)]
        return pd.DataFrame({group: [key[0]], "_segment": [key[1]], "_n": [n], "_sizes": [sizes[:max_items]], "_table": [table]})

    def follow(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        """Per segment: how many of its first items the open batch takes, and the number of the first batch that begins in it."""
        out, taken, batch, held, total = [], 0, 0, 0, 0
        for segment_, n, sizes, table in part.sort_values("_segment")[["_segment", "_n", "_sizes", "_table"]].itertuples(index=False):
            taken = 0
            while held and taken < n and held < max_items and total + sizes[taken] <= max_tokens:
                held, total, taken = held + 1, total + sizes[taken], taken + 1
            out.append((key[0], segment_, taken, batch))
            if taken < n:
                begun, held, total = (int(x) for x in table[taken])
                batch += begun
        return pd.DataFrame(out, columns=[group, "_segment", "_taken", "_batch"])

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        sizes, taken, batch = part[tokens].fillna(0).astype("int64").tolist(), int(part["_taken"].iloc[0]), int(part["_batch"].iloc[0])
        begins, _ = packed(sizes, taken)
        number = np.full(len(sizes), batch - 1)
        for i in begins:
            number[i:] += 1
        return part.assign(batch=number)[[*columns, "batch"]]

    tables = rows.groupBy(*keys).applyInPandas(exits, f"`{group}` {of_group}, _segment long, _n long, _sizes array<long>, _table array<array<long>>")
    starts = tables.groupBy(group).applyInPandas(follow, f"`{group}` {of_group}, _segment long, _taken long, _batch long")
    met = rows.join(starts.withColumnsRenamed({group: "_g", "_segment": "_s"}), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_segment") == F.col("_s"))).drop("_g", "_s")
    return met.groupBy(*keys).applyInPandas(pack, f"{schema}, batch int")


def admitted(batch_costs: DataFrame, order: list[str], cap: Column | float, spent: float = 0.0, stretch: Column | None = None) -> DataFrame:
    """``batch_costs`` with running spend and ``admitted``: a batch goes through while spend so far plus WORST_CASE times its cost is within the cap, up to the first that isn't.

    ``stretch`` cuts the order into ranges (of months, say): sums within a range and over the ranges before it are taken apart,
    so that only one row per range meets in one window.
    """
    rows = batch_costs.withColumn("_stretch", stretch if stretch is not None else F.lit(0))
    within, ranges = W.partitionBy("_stretch").orderBy(*order), W.orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("_stretch").agg(F.sum(money(F.col("cost"))).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(ranges), money(F.lit(0))))
    rows = rows.join(sums.select("_stretch", "_before"), "_stretch")
    before = F.coalesce(F.sum(money(F.col("cost"))).over(within.rowsBetween(W.unboundedPreceding, -1)), money(F.lit(0))) + F.col("_before")
    limit = cap if isinstance(cap, Column) else F.lit(cap)
    rows = rows.withColumn("spent_before", F.round(before.cast("double") + F.lit(spent), 9)).withColumn("_ok", F.col("spent_before") + WORST_CASE * F.col("cost") <= limit)
    stopped = F.max(F.when(~F.col("_ok"), 1).otherwise(0)).over(within.rowsBetween(W.unboundedPreceding, 0))
    firsts = rows.groupBy("_stretch").agg(F.max(F.when(~F.col("_ok"), 1).otherwise(0)).alias("_bad")).withColumn("_bad_before", F.coalesce(F.max("_bad").over(ranges), F.lit(0)))
    rows = rows.join(firsts.select("_stretch", "_bad_before"), "_stretch")
    return rows.withColumn("admitted", (stopped == 0) & (F.col("_bad_before") == 0)).drop("_ok", "_stretch", "_before", "_bad_before")


LOG_COLUMNS = ["ts", "kind", "tokens_est", "tokens_reported", "cost_est_usd", "cost_reported_usd", "note"]


def reserved(batch_costs: DataFrame, ts: Column) -> DataFrame:
    """Reserve entries of admitted batches (batch, tokens, cost, admitted): WORST_CASE times the estimate."""
    rows = batch_costs.where("admitted").select(ts.alias("ts"), F.lit("reserve").alias("kind"), F.col("tokens").cast("int").alias("tokens_est"), F.lit(None).cast("int").alias("tokens_reported"), (F.col("cost") * WORST_CASE).alias("cost_est_usd"))
    return rows.select(*rows.columns, F.lit(None).cast("double").alias("cost_reported_usd"), F.lit("batch").alias("note"))


def settled(reserves: DataFrame, results: DataFrame, key: str, ts: Column) -> DataFrame:
    """Entries that close reserves (key, tokens_est, cost_est_usd): a release for each that has a result (key, ok, tokens_reported, cost_reported_usd), and a commit where it is ok. Reserves without result stay open."""
    met = reserves.select(key, "tokens_est", "cost_est_usd").join(results, key)
    release = met.select(ts.alias("ts"), F.lit("release").alias("kind"), F.lit(0).alias("tokens_est"), F.lit(None).cast("int").alias("tokens_reported"), "cost_est_usd", F.lit(None).cast("double").alias("cost_reported_usd"), F.when(F.col("ok"), "done").otherwise("failed").alias("note"))
    tokens = F.coalesce("tokens_reported", "tokens_est")
    commit = met.where("ok").select(ts.alias("ts"), F.lit("commit").alias("kind"), "tokens_est", "tokens_reported", cost(tokens).alias("cost_est_usd"), "cost_reported_usd", F.lit("done").alias("note"))
    return release.unionByName(commit)


def expired(log: DataFrame, days: int = 7) -> DataFrame:
    """(day, open_usd): days whose reserves were not all released and which lie ``days`` before the log's last entry: what a crash leaked, to be released."""
    rows = log.distinct().withColumn("day", F.to_date("ts"))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, money(F.col("cost_est_usd")))), money(F.lit(0)))
    by_day = rows.groupBy("day").agg((of("reserve") - of("release")).alias("_open"))
    last = rows.agg(F.max("day").alias("_last"))  # one row
    return by_day.join(F.broadcast(last)).where((F.col("_open") > 0) & (F.col("day") < F.date_sub("_last", days))).select("day", F.round("_open", 6).cast("double").alias("open_usd"))


def append(entries: DataFrame, path: str) -> None:
    """Add entries to the log's folder; nothing in it changes."""
    entries.select(*LOG_COLUMNS).write.mode("append").parquet(path)


def open_reserves(log: DataFrame) -> DataFrame:
    """Reserves by day with what was released and committed: what stays open was leaked by a crash."""
    rows = log.distinct().withColumn("day", F.to_date("ts"))
    of = lambda kind: F.count_if(F.col("kind") == kind).alias(f"{kind}s")
    return rows.groupBy("day").agg(of("reserve"), of("release"), of("commit")).withColumn("open", F.col("reserves") - F.col("releases"))
