"""Problem 3: statistics of each page's text, and its kind where it is mostly not prose.

The statistics are taken in one pass over the characters of each batch. For every language a mergeable KLL quantile sketch of each
statistic is built (partial sketches per task, merged per language); the languages' sketches are merged once more by script. Every page is
then held against the sketches of its language, or of its script where its common words tell no language or the language has under
``LEAST_PAGES`` pages: as percentile, and as robust z-score (distance from the median in quartile ranges).

A statistic beyond its limit (``LOW``, ``HIGH``, else TAIL) is in a tail of the distribution, and the tails decide the kind. Every kind needs the low tail of
common words. ``junk``: no language, and an extreme tail of short tokens, endless tokens, ASCII marks or tripled letters. ``table``, ``list``: the high tail of
lines with the same columns, or of items, which must be most of the lines.

Defined cases: null, empty and blank texts have statistics of 0 and the kind ``blank``; repeated rows count once; pages with few
common words are of language ``und``. Where under LEAST_PAGES pages have a language, PRIOR stands for the sketches.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Share of common words from which on they tell the language.
FEW = 0.1
LEAST_PAGES = 30
#: Lines that a kind must have: "mostly".
MOST = 0.7
EDGE = 2
AT_ONCE = 500_000
STATISTICS = ["n_words", "mean_word", "symbol_ratio", "ended_lines", "common_share", "digit_ratio", "short_share", "mean_line", "table_lines", "item_lines", "mean_token", "ascii_marks", "tripled", "arabic_ratio"]
#: Least spread of a statistic (a standard deviation), where a language's pages hardly differ.
FLOORS = {"n_words": 20.0, "mean_word": 0.2, "mean_line": 5.0, "mean_token": 1.0, "ascii_marks": 0.02, "short_share": 0.02, "common_share": 0.02, "table_lines": 0.05, "item_lines": 0.05}
FLOOR = 0.01
#: z-scores from which on a statistic is in a tail.
TAIL, EXTREME = 3.5, 16.0
JUNK = ["short_share", "mean_token", "ascii_marks", "tripled"]
LOW, HIGH = {"common_share": -2.2}, dict.fromkeys(JUNK, EXTREME)
#: Median and quartile range of prose, for tables with too few pages to have sketches of their own.
PRIOR = {"n_words": (150.0, 100.0), "mean_word": (4.5, 0.5), "ended_lines": (0.3, 0.2), "common_share": (0.32, 0.05), "short_share": (0.2, 0.05), "mean_line": (65.0, 15.0), "mean_token": (4.7, 0.5)}
QUANTILES = [i / 100 for i in range(1, 100)]

# What begins or marks an item of a list, what ends a sentence, what parts the cells of a compact table.
ITEM = re.compile(r"\s*(?:[-–—*•·●▪◦‣]\s|\(?\d{1,3}[.)]\s|\(?[^\W\d_][.)]\s)|.*?(?<![^\W_])[^\W\d_]-\d{3,6}(?!\d)")
ENDS, CELL_MARKS = ".!?؟…:؛", "|;,،"
WORD, NUMBER, SPACE, ASCII_MARK, LETTER, ARABIC = 1, 2, 4, 8, 16, 32


@cache
def classes() -> np.ndarray:
    """What each character is, as bits."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for n in range(0x110000):
        c, kind = chr(n), unicodedata.category(chr(n))
        bits = (WORD if kind[0] in "LNM" else 0) | (NUMBER if kind[0] == "N" else 0) | (LETTER if kind[0] == "L" else 0)
        bits |= SPACE if kind[0] == "Z" or c in "\t\n\v\f\r" else 0
        bits |= ASCII_MARK if 0x21 <= n < 0x7F and not c.isalnum() else 0
        out[n] = bits
    for low, high in ((0x600, 0x6FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC)):
        out[low : high + 1] |= ARABIC
    return out


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of true flags."""
    d = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def measure(texts: list[str], words_of: dict[str, list[str]]) -> pd.DataFrame:
    """Statistics of every text, from one array of all their characters."""
    n, joined = len(texts), "\n".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = classes()[codes]
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=n)
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    sums = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    within = lambda total, a, b: total[b] - total[a]
    share = lambda part, whole: np.round(part / np.maximum(whole, 1), 6)
    of_text = lambda places: np.searchsorted(ends, places, side="right")
    count = lambda bit: within(sums(kind & bit > 0), begins, ends)
    solid = kind & SPACE == 0
    chars = within(sums(solid), begins, ends)
    # Words and tokens.
    w0, w1 = runs(kind & WORD > 0)
    t0, t1 = runs(solid)
    word_text, token_text = of_text(w0), of_text(t0)
    n_words, n_tokens = np.bincount(word_text, minlength=n), np.bincount(token_text, minlength=n)
    word_chars = np.bincount(word_text, weights=w1 - w0, minlength=n)
    short = np.bincount(token_text, weights=t1 - t0 <= 2, minlength=n)
    thrice = np.flatnonzero((codes[:-2] == codes[1:-1]) & (codes[1:-1] == codes[2:]) & (kind[:-2] & LETTER > 0)) if len(codes) > 2 else np.array([], dtype=np.int64)
    tripled = np.bincount(token_text[np.unique(np.searchsorted(t0, thrice, side="right") - 1)], minlength=n) if len(thrice) else np.zeros(n)
    # The cells of compact tables are words; an endless string has no marks that part it.
    c0, c1 = runs(solid & ~np.isin(codes, [ord(c) for c in CELL_MARKS]))
    cell_text = of_text(c0)
    cells, cell_chars = np.bincount(cell_text, minlength=n), np.bincount(cell_text, weights=c1 - c0, minlength=n)
    mean_token = np.where(cells > 0, np.minimum(share(chars, n_tokens), share(cell_chars, cells)), share(chars, n_tokens))
    # Common words.
    languages = sorted(words_of)
    every = sorted({w for ws in words_of.values() for w in ws})
    ids = {w: i for i, w in enumerate(every)}
    low = joined.lower()
    found = (low[a:b] for a, b in zip(w0.tolist(), w1.tolist(), strict=True)) if len(low) == len(joined) else (joined[a:b].lower() for a, b in zip(w0.tolist(), w1.tolist(), strict=True))
    common = np.fromiter((ids.get(w, -1) for w in found), dtype=np.int64, count=len(w0))
    hit, hit_text = common[common >= 0], word_text[common >= 0]
    n_common = np.bincount(hit_text, minlength=n)
    by = np.zeros((n, max(1, len(languages))))
    for j, language in enumerate(languages):
        has = np.zeros(len(every))
        has[[ids[w] for w in words_of[language]]] = 1
        by[:, j] = np.bincount(hit_text, weights=has[hit], minlength=n)
    best = by.shape[1] - 1 - by[:, ::-1].argmax(1)
    common_share = share(n_common, n_words)
    lang = [languages[j] if languages and s >= FEW else "und" for j, s in zip(best, common_share, strict=True)]
    # Lines.
    breaks = np.flatnonzero(codes == 10)
    l0, l1 = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(codes)]])
    filled = within(sums(solid), l0, l1) > 0
    l0, l1 = l0[filled], l1[filled]
    line_text = np.searchsorted(ends, l0, side="right")
    n_lines = np.bincount(line_text, minlength=n)
    last = lambda flags: np.maximum.accumulate(np.where(flags, np.arange(len(codes)), -1)) if len(codes) else np.array([], dtype=np.int64)
    last_end, last_word = last(np.isin(codes, [ord(c) for c in ENDS])), last(kind & WORD > 0)
    ended = (last_end[l1 - 1] >= l0) & (last_end[l1 - 1] > last_word[l1 - 1]) if len(l0) else np.array([], dtype=bool)
    items = np.fromiter((ITEM.match(joined, a, b) is not None for a, b in zip(l0.tolist(), l1.tolist(), strict=True)), dtype=bool, count=len(l0))
    after, before = np.concatenate([codes[1:], [10]])[: len(codes)], np.concatenate([[10], codes[:-1]])[: len(codes)]
    is_ = lambda c: codes == ord(c)
    dots = np.zeros(len(codes), dtype=bool)
    if len(codes) > 3:
        dots[:-3] = (codes[:-3] == 32) & (codes[1:-2] == 46) & (codes[2:-1] == 46) & (codes[3:] == 32)
    marks = [is_("\t"), is_("|"), is_(";"), (is_(",") | is_("،")) & ~np.isin(after, [32, 9, 11, 12, 13]), is_(" ") & (after == 32) & (before != 32), dots]
    columns = np.zeros(n)
    for mark in marks:
        per_line = within(sums(mark), l0, l1)
        some = per_line > 0
        if some.any():
            key, lines = np.unique(line_text[some] * 100_000 + np.minimum(per_line[some], 99_999), return_counts=True)
            np.maximum.at(columns, key // 100_000, lines)
    # Lines at the edges may be running lines or the page's number: up to EDGE of them at either end don't count against a kind.
    inner = np.maximum(1, n_lines - np.minimum(2 * EDGE, np.maximum(0, n_lines - 3)))
    of_inner = lambda lines: np.minimum(1.0, share(lines, inner))
    arabic, letters = count(ARABIC), within(sums((kind & LETTER > 0) & (kind & ARABIC == 0)), begins, ends)
    return pd.DataFrame({
        "lang": lang, "n_lines": n_lines.astype(np.int32), "n_words": n_words.astype(np.int32), "mean_word": share(word_chars, n_words), "symbol_ratio": share(within(sums(solid & (kind & WORD == 0)), begins, ends), chars),
        "ended_lines": share(np.bincount(line_text, weights=ended, minlength=n), n_lines), "common_share": common_share, "digit_ratio": share(count(NUMBER), chars), "short_share": share(short, n_tokens),
        "mean_line": share(np.bincount(line_text, weights=l1 - l0, minlength=n), n_lines), "table_lines": of_inner(columns), "item_lines": of_inner(np.bincount(line_text, weights=items, minlength=n)),
        "mean_token": mean_token, "ascii_marks": share(count(ASCII_MARK), chars), "tripled": share(tripled, n_tokens), "arabic_ratio": np.round(arabic / np.maximum(arabic + letters, 1), 3),
    })


def reader(words_of: dict[str, list[str]], ids: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # As many texts at once as have AT_ONCE characters: the arrays over them take some 100 bytes a character.
            part = batch["_text"].str.len().cumsum() // AT_ONCE
            for _, some in batch.groupby(part, sort=False):
                yield pd.concat([some[ids].reset_index(drop=True), measure(some["_text"].tolist(), words_of)], axis=1)

    return read


def statistics(pages: DataFrame, common_words: DataFrame, ids: list[str], text: str = "raw_text") -> DataFrame:
    """One row per distinct (ids, statistics): language, number of lines, statistics. The common words are a fixed small table."""
    words_of: dict[str, list[str]] = {}
    for row in common_words.select("lang", F.lower("word").alias("word")).where("lang is not null and word is not null").distinct().collect():
        words_of.setdefault(row["lang"], []).append(row["word"])
    rows = pages.select(*ids, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*ids).schema)
    kinds = ", ".join(f"{s} {'int' if s == 'n_words' else 'double'}" for s in STATISTICS)
    return rows.mapInPandas(reader(words_of, ids), f"{columns}, lang string, n_lines int, {kinds}").dropDuplicates()


def script() -> Column:
    return F.when(F.col("arabic_ratio") >= 0.5, "arabic").otherwise("other")


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, script, n, and a sketch of each statistic) of every language in each script, from the pages with a language."""
    # The sketch wants doubles.
    return stats.where("lang != 'und'").groupBy("lang", script().alias("script")).agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(F.col(s).cast("double")).alias(s) for s in STATISTICS])


def quantiles(merged: DataFrame) -> DataFrame:
    """References that pages are held against: (ref, n, q_<statistic>), ref a language or a script.

    The rows are as many as the languages of the common words, in two scripts; their sketches are merged by language and by script.
    """
    each = merged.select(F.explode(F.array("lang", "script")).alias("ref"), "n", *STATISTICS)
    whole = each.groupBy("ref").agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(s).alias(s) for s in STATISTICS])
    at = F.array(*[F.lit(q) for q in QUANTILES])
    return whole.where(F.col("n") >= LEAST_PAGES).select("ref", *[F.kll_sketch_get_quantile_double(s, at).alias(f"q_{s}") for s in STATISTICS])


def held(stats: DataFrame) -> DataFrame:
    """``stats`` with z-scores (``z_<statistic>``) and the quantiles (``q_<statistic>``) that they are held against."""
    # A few rows: one per language and script.
    refs = quantiles(sketches(stats))
    by_language, by_script = (F.broadcast(refs.select(F.struct(*[f"q_{s}" for s in STATISTICS]).alias(name), F.col("ref").alias(f"_{name}"))) for name in ("own", "of_script"))
    joined = stats.join(by_language, F.col("lang") == F.col("_own"), "left").join(by_script, script() == F.col("_of_script"), "left")
    joined = joined.withColumn("_q", F.coalesce("own", "of_script")).drop("own", "of_script", "_own", "_of_script")

    def z(s: str) -> Column:
        q, (middle, spread) = F.col("_q")[f"q_{s}"], PRIOR.get(s, (0.0, 0.0))
        median, quartiles = F.coalesce(q[49], F.lit(middle)), F.coalesce(q[74] - q[24], F.lit(spread))
        return F.round((F.col(s) - median) / F.greatest(quartiles / F.lit(1.349), F.lit(FLOORS.get(s, FLOOR))), 4)

    return joined.select("*", *[z(s).alias(f"z_{s}") for s in STATISTICS])


def kinds(pages: DataFrame, common_words: DataFrame, ids: list[str], text: str = "raw_text") -> DataFrame:
    """The statistics with percentiles, robust z-scores, ``tails`` (names of the statistics in one, with its side) and ``kind``."""
    rows = held(cut(statistics(pages, common_words, ids, text)))
    beyond = lambda s: [F.when(F.col(f"z_{s}") >= HIGH.get(s, TAIL), F.lit(f"+{s}")), F.when(F.col(f"z_{s}") <= LOW.get(s, -TAIL), F.lit(f"-{s}"))]
    rows = rows.withColumn("tails", F.array_compact(F.array(*[x for s in STATISTICS for x in beyond(s)])))
    tail = lambda name: F.array_contains("tails", name)
    most = lambda s: tail(f"+{s}") & (F.col(s) >= MOST)
    no_prose = tail("-common_share")
    kind = (
        F.when(F.col("n_lines") == 0, "blank")
        .when(no_prose & (F.col("lang") == "und") & reduce(lambda a, b: a | b, [tail(f"+{s}") for s in JUNK]), "junk")
        .when(no_prose & most("table_lines") & (F.col("table_lines") >= F.col("item_lines")), "table")
        .when(no_prose & most("item_lines"), "list")
        .otherwise("prose")
    )
    percentile = lambda s: F.round(F.size(F.filter(F.col("_q")[f"q_{s}"], lambda q: q <= F.col(s))) / F.lit(len(QUANTILES) + 1.0), 3)
    return rows.select(*ids, "lang", *STATISTICS, *[F.greatest(F.coalesce(percentile(s), F.lit(0.0)), F.lit(0.0)).alias(f"{s}_pct") for s in STATISTICS], *[f"z_{s}" for s in STATISTICS], "tails", kind.alias("kind"))
