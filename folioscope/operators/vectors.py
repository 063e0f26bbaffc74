"""Exact vector search of a query set against all rows, in blocks.

Rows and queries are cut into blocks; every task multiplies one block of rows by one block of queries and keeps the best ``k`` of
each query, so its size is fixed and no side is broadcast whole. A window over the blocks' survivors gives the final ranks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

POOL = 300
BLOCK = 8192
#: Queries of a block that are multiplied at once: AT_ONCE x BLOCK doubles, 16 MB.
AT_ONCE = 256


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def best_of_block(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def best(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"qid": [], "pid": [], "sim": []}).astype({"qid": "int64", "pid": "int64", "sim": "float64"})
        if rows.empty or queries.empty:
            return none
        rows = rows.sort_values("pid")
        q, m, pids, qids = matrix(queries["vector"]), matrix(rows["vector"]).T, rows["pid"].to_numpy(), queries["qid"].to_numpy()
        norm = np.linalg.norm(q, axis=1, keepdims=True)
        q /= np.where(norm == 0, 1, norm)
        out = []
        for at in range(0, len(q), AT_ONCE):
            sims = np.round(q[at : at + AT_ONCE] @ m, 9)
            # The k-th best bounds what can be kept; all that tie with it stay until the order by pid decides.
            least = -np.partition(-sims, k - 1, axis=1)[:, k - 1] if k < sims.shape[1] else np.full(len(sims), -np.inf)
            i, j = np.nonzero(sims >= least[:, None])
            order = np.lexsort((j, -sims[i, j], i))
            i, j = i[order], j[order]
            first = np.searchsorted(i, np.arange(len(sims)))
            kept = np.arange(len(i)) - first[i] < k
            i, j = i[kept], j[kept]
            out.append(pd.DataFrame({"qid": qids[at + i], "pid": pids[j], "sim": sims[i, j]}))
        return pd.concat(out)

    return best


def top_k(vectors: DataFrame, queries: DataFrame, k: int = POOL, block: int = BLOCK) -> DataFrame:
    """(qid, pid, sim, rank from 0): vectors (pid, vector) against queries (qid, vector). Queries are normalized (norm 0 stays 0), rows are taken as stored."""
    vectors, queries = (df.where("vector is not null") for df in (vectors, queries))
    n_rows, n_queries = max(1, -(-vectors.count() // block)), max(1, -(-queries.count() // block))
    rows = vectors.withColumn("_r", F.pmod(F.xxhash64("pid"), F.lit(n_rows))).withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_queries - 1).cast("long"))))
    asked = queries.withColumn("_q", F.pmod(F.xxhash64("qid"), F.lit(n_queries))).withColumn("_r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_rows - 1).cast("long"))))
    best = rows.groupBy("_r", "_q").cogroup(asked.groupBy("_r", "_q")).applyInPandas(best_of_block(k), "qid long, pid long, sim double")
    by = W.partitionBy("qid").orderBy(F.desc("sim"), "pid")
    return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)
