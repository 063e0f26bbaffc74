"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one group that one join task pairs with the group; larger groups are spread over several tasks.
GROUP_SLICE = 4096
#: Largest groups that every task knows beforehand.
HOT_GROUPS = 1000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table into the reliable checkpoint folder and read on from there, so that later stages don't run its plan again.

    The folder is the cluster's spark.checkpoint.dir; a local one is made only in a local session that has none, as in tests.
    The table goes when the session ends.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="folioscope-checkpoint-"))
    path = f"{context._jsc.sc().getCheckpointDir().get()}/table-{uuid4().hex}"
    df.write.parquet(path)
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(at)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text: Column) -> Column:
    """128-bit key of a text, to compare and shuffle long texts by."""
    return F.unhex(F.md5(text.cast("binary")))


def in_slices(rows: DataFrame, group: str, member: str, many: Column) -> DataFrame:
    """``rows`` of the groups for which ``many`` is over 1, with ``_slices``: how many slices of about GROUP_SLICE rows the group has.

    Rows learn the size of their group by a join. The largest HOT_GROUPS groups are known to every task beforehand (a top-k report,
    so its broadcast is bounded), and their rows are spread over as many keys as the group has slices: no task gets a whole hot group.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"), many.alias("_many")).where("_many > 1")
    sizes = sizes.select(group, F.ceil(F.col("_n") / GROUP_SLICE).cast("int").alias("_slices"))
    hot = sizes.where("_slices > 1").orderBy(F.desc("_slices"), group).limit(HOT_GROUPS).select(group, F.col("_slices").alias("_hot"))
    spread = lambda df: df.join(F.broadcast(hot), group, "left").withColumn("_hot", F.coalesce("_hot", F.lit(1)))
    salted = spread(rows).withColumn("_salt", F.pmod(F.xxhash64(member), F.col("_hot")).cast("int"))
    each = spread(sizes).select(group, "_slices", F.explode(F.sequence(F.lit(0), F.col("_hot") - 1)).alias("_salt"))
    return salted.join(each, [group, "_salt"]).drop("_salt", "_hot")


def met_in_groups(members: DataFrame, group: str, member: str, many: Column) -> DataFrame:
    """Rows ``l`` and ``r`` (aliases) of one group whose members are in order (l before r).

    Each row is on the left in one slice of its group, and on the right once per slice.
    """
    rows = in_slices(members.where(F.col(group).isNotNull() & F.col(member).isNotNull()), group, member, many)
    left = rows.withColumn("_slice", F.pmod(F.xxhash64(member), F.col("_slices")).cast("int"))
    right = rows.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))
    on = (F.col(f"l.{group}") == F.col(f"r.{group}")) & (F.col("l._slice") == F.col("r._slice")) & (F.col(f"l.{member}") < F.col(f"r.{member}"))
    return left.alias("l").join(right.alias("r"), on)


def pairs_in_groups(members: DataFrame, group: str, member: str, unlike: str | None = None) -> DataFrame:
    """All pairs (a, b), a < b, of different members of a group; with ``unlike`` only pairs that differ in that column.

    The pairs are the result, so their number can't be reduced. Rows with a null group or member pair with nothing. Members of
    groups of one are gone before the pairs are made.
    """
    met = met_in_groups(members, group, member, F.count_distinct(unlike or member))
    if unlike:
        met = met.where(F.col(f"l.{unlike}") != F.col(f"r.{unlike}"))
    return met.select(F.col(f"l.{member}").alias("a"), F.col(f"r.{member}").alias("b")).distinct()


class Bloom:
    """Filter for whole numbers: false for most that aren't in it, never for one that is.

    It has ten bits for each number up to MOST bits (16 MB), whatever the data; beyond that more numbers pass, and none is lost.
    The driver gets the bits packed, PACKED words of 32 in a row: a row for each word would be hundreds of MB there.
    """

    MOST, WAYS, PACKED = 1 << 27, 4, 1 << 12

    def __init__(self, numbers: DataFrame, column: str) -> None:
        wanted = numbers.select(column).count() * 10
        self.bits = min(self.MOST, 1 << max(12, (wanted - 1).bit_length()))
        first, step = self.hashes(F.col(column))
        at = F.explode(F.array(*[(first + step * i).bitwiseAND(F.lit(self.bits - 1)) for i in range(self.WAYS)])).alias("at")
        words = numbers.select(at).groupBy(F.shiftright("at", 5).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("on"))
        table, width = np.zeros(self.bits >> 5, dtype=np.uint32), self.PACKED

        def pack(part: pd.DataFrame) -> pd.DataFrame:
            on = np.zeros(width, dtype=np.uint32)
            on[part["word"].to_numpy() % width] = part["on"].to_numpy(dtype=np.int64).astype(np.uint32)
            return pd.DataFrame({"part": part["part"].iloc[:1], "bits": [on.tobytes()]})

        for row in words.withColumn("part", F.floor(F.col("word") / width).cast("int")).groupBy("part").applyInPandas(pack, "part int, bits binary").collect():
            at = row["part"] * width
            table[at : at + width] = np.frombuffer(row["bits"], dtype=np.uint32)[: len(table) - at]
        self.table = numbers.sparkSession.sparkContext.broadcast(table)

    @staticmethod
    def hashes(number: Column) -> tuple[Column, Column]:
        return tuple(F.xxhash64(number, F.lit(seed)).bitwiseAND(F.lit((1 << 31) - 1)) for seed in (1, 2))

    def may_have(self, number: Column) -> Column:
        table, bits, ways = self.table, self.bits, self.WAYS

        @F.pandas_udf("boolean")
        def look(first: pd.Series, step: pd.Series) -> pd.Series:
            a, b, out = first.to_numpy(), step.to_numpy(), np.ones(len(first), dtype=bool)
            for i in range(ways):
                at = (a + b * i) & (bits - 1)
                out &= (table.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1
            return pd.Series(out)

        return look(*self.hashes(number))
