"""Lines packed into chunks of at most ``cap`` tokens, as one ordered fold over each page's units.

A line is a unit. A line above the cap is split into sentences, and a sentence above it into words; such units are packed by
themselves: the chunk before is closed, and so is the last one of the line. A chunk that ends a sentence and holds half the cap is closed early.
Token counts are additive over units (``token_estimate``), so chunk limits differ from those of a tokenizer that isn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, token_estimate

CAP = 600
# What parts sentences, and what ends one.
SENTENCE = f"(?<=[.!?؟…:]){SPACE}+"
ENDS = r"[.!?؟…:]['\"”’)]*$"


def units(text: Column, cap: int = CAP) -> Column:
    """Array of (text, tokens, alone, first): ``alone`` units come from a split line, ``first`` begins such a line or an oversized sentence."""
    lines = F.filter(F.transform(F.split(text, r"\R"), lambda x: F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")), lambda x: x != "")

    def unit(t: Column, alone: bool, first: Column, last: Column) -> Column:
        return F.struct(t.alias("text"), token_estimate(t).alias("tokens"), F.lit(alone).alias("alone"), first.alias("first"), last.alias("last"))

    def of_sentence(s: Column, first: Column, last: Column) -> Column:
        words = F.filter(F.split(s, f"{SPACE}+"), lambda w: w != "")
        parts = F.transform(words, lambda w, i: unit(w, True, i == 0, last & (i == F.size(words) - 1)))
        return F.when(token_estimate(s) <= cap, F.array(unit(s, True, first, last))).otherwise(parts)

    def of_line(x: Column) -> Column:
        sentences = F.filter(F.split(x, SENTENCE), lambda s: F.trim(s) != "")
        parts = F.flatten(F.transform(sentences, lambda s, i: of_sentence(s, i == 0, i == F.size(sentences) - 1)))
        return F.when(token_estimate(x) <= cap, F.array(unit(x, False, F.lit(False), F.lit(False)))).otherwise(parts)

    return F.flatten(F.transform(lines, of_line))


def chunks(text: Column, cap: int = CAP) -> Column:
    """Array of chunk texts."""
    empty = F.struct(F.lit("").alias("cur"), F.lit(0).alias("tokens"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, u: Column) -> Column:
        has = state["cur"] != ""
        fits = state["tokens"] + u["tokens"] <= cap
        full = has & ~u["alone"] & state["cur"].rlike(ENDS) & (state["tokens"] * 2 >= cap)
        closes = has & (~fits | full | u["first"])
        out = F.when(closes, F.concat(state["out"], F.array(state["cur"]))).otherwise(state["out"])
        cur = F.when(closes | ~has, u["text"]).otherwise(F.concat_ws(" ", state["cur"], u["text"]))
        tokens = F.when(closes | ~has, u["tokens"]).otherwise(state["tokens"] + u["tokens"])
        ended = u["last"]
        return F.struct(F.when(ended, F.lit("")).otherwise(cur).alias("cur"), F.when(ended, F.lit(0)).otherwise(tokens).alias("tokens"), F.when(ended, F.concat(out, F.array(cur))).otherwise(out).alias("out"))

    return F.aggregate(units(text, cap), empty, step, lambda s: F.when(s["cur"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(s["cur"]))))


def chunk_rows(pages: DataFrame, keys: list[str], text: str, cap: int = CAP) -> DataFrame:
    """(keys, ordinal, text, tokens) of each page's chunks; blank pages have none."""
    rows = pages.select(*keys, F.posexplode(chunks(F.col(text), cap)).alias("ordinal", "chunk"))
    return rows.select(*keys, "ordinal", F.col("chunk").alias("text"), token_estimate(F.col("chunk")).alias("tokens"))
