"""Problem 6: text that looks the same but is stored with different characters.

One table, built by rule from the Unicode database and two short lists, maps grapheme clusters to one form: full- and
half-width and presentation forms, ligatures, decomposed letters, invisible characters, special spaces and look-alike letters.
It is compiled to one pattern that matches the longest cluster (a letter with its marks and the invisible characters between
them), and every text goes through it once. Look-alikes follow the text's own script: in a text written mostly in Latin letters,
Cyrillic and Greek look-alikes become Latin, and the other way round; Arabic and Persian kaf and yeh follow the language's letters.
What is visibly different stays different: accents, dots, digits, superscripts and fractions are no part of the table.

Defined cases: a null text stays null, an empty one empty; texts of any length go through whole; equal texts stay equal.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pairs_in_groups, text_key

# Letters of other scripts and the Latin letters that they look like.
CYRILLIC = dict(zip("аеорсухіѕјһԁԛԝӏАВЕКМНОРСТХУІЈЅԌԚԜ", "aeopcyxisjhdqwlABEKMHOPCTXYIJSGQW", strict=True))
GREEK = dict(zip("οανρυικΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳ", "oavpuıĸABEZHIKMNOPTYXcj", strict=True))
# Letters of Arabic that other languages of its script write with another character.
ARABIC = dict(zip("یکھہە", "يكههه", strict=True))
PERSIAN = dict(zip("يكھہە", "یکههه", strict=True))
#: Letters that Persian has and Arabic has not.
PERSIAN_ONLY = re.compile("[پچژگ]")
#: Compatibility forms with these tags look like the letters that they stand for.
ALIKE_TAGS = {"<wide>", "<narrow>", "<isolated>", "<initial>", "<medial>", "<final>", "<noBreak>"}
LIGATURES = set("ﬀﬁﬂﬃﬄﬅﬆĲĳǄǅǆǇǈǉǊǋǌ…")


def invisible(c: str) -> bool:
    return unicodedata.category(c) in ("Cf", "Cc") and c not in "\t\n\r\x0b\x0c\x85" and not 0x600 <= ord(c) <= 0x605 or 0xFE00 <= ord(c) <= 0xFE0F or ord(c) in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0)


def alike(c: str) -> str:
    """The ordinary characters that a single character stands for and looks like; accents apart, no look-alike letters yet."""
    if invisible(c):
        return ""
    if unicodedata.category(c) == "Zs":
        return " "
    tag = unicodedata.decomposition(c).partition(" ")[0]
    return unicodedata.normalize("NFKD" if tag in ALIKE_TAGS or c in LIGATURES else "NFD", c)


@cache
def table(script: str, persian: bool) -> dict[str, str]:
    """Single characters that change, by rule over the basic plane of Unicode, for a text of this script."""
    to_own = {"latin": CYRILLIC | GREEK, "cyrillic": {v: k for k, v in CYRILLIC.items()}, "greek": {v: k for k, v in GREEK.items()}}[script]
    letters = to_own | (PERSIAN if persian else ARABIC)
    out = {}
    for n in range(0x80, 0x10000):
        c = chr(n)
        if 0xD800 <= n < 0xE000 or 0xAC00 <= n < 0xD7B0 or unicodedata.category(c) in ("Cn", "Co"):
            continue
        new = unicodedata.normalize("NFC", "".join(letters.get(x, x) for x in alike(c)))
        if new != c:
            out[c] = new
    for c, new in letters.items():
        out[c] = new
    out |= {chr(n): "" for n in [*range(9), *range(14, 32), 127]}
    return out


def conflicts(script: str = "latin", persian: bool = False) -> list[str]:
    """Entries whose result would change again, or that would drop a visible mark: the table must have none."""
    t = table(script, persian)
    marks = lambda s: [m for m in unicodedata.normalize("NFD", s) if unicodedata.combining(m)]
    return [c for c, new in t.items() if any(x in t for x in new) or (not invisible(c) and marks(c) and marks(new) != marks(c))]


@cache
def transducer(script: str, persian: bool) -> tuple[re.Pattern, re.Pattern, dict[str, str]]:
    """Patterns of what changes at all and of the longest cluster, and the memo; clusters with marks are added to it as they come."""
    t = table(script, persian)
    marks = "".join(re.escape(chr(n)) for n in range(0x300, 0x10000) if unicodedata.combining(chr(n)) and not 0x64B <= n <= 0x652)
    hidden = "".join(re.escape(c) for c, new in t.items() if not new)
    single = "".join(re.escape(c) for c in t)
    return re.compile(f"[{marks}{single}]"), re.compile(f"[^{marks}{hidden}](?:[{hidden}]*[{marks}][{marks}{hidden}]*)|[{single}]+"), dict(t)


LATIN, CYRILLIC_LETTERS, GREEK_LETTERS = re.compile("[A-Za-zÀ-ɏ]"), re.compile("[Ѐ-ӿ]"), re.compile("[Ͱ-Ͽ]")


def canonical(text: str | None) -> str | None:
    """One consistent form of a text; equal for texts that look the same."""
    if not text or text.isascii() and text.isprintable():
        return text
    script = "latin"
    other = len(CYRILLIC_LETTERS.findall(text)), len(GREEK_LETTERS.findall(text))
    if max(other) and max(other) > len(LATIN.findall(text)):
        script = "cyrillic" if other[0] >= other[1] else "greek"
    any_change, longest, memo = transducer(script, bool(PERSIAN_ONLY.search(text)))
    if not any_change.search(text):
        return text

    def write(match: re.Match) -> str:
        cluster = match.group()
        new = memo.get(cluster)
        if new is None:
            whole = "".join(memo.get(c, c) for c in cluster)
            new = memo[cluster] = unicodedata.normalize("NFC", "".join(memo.get(c, c) for c in unicodedata.normalize("NFD", whole)))
        return new

    return longest.sub(write, text)


@F.pandas_udf(T.StringType())
def canonical_text(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(canonical, na_action="ignore")


def one_space(text: Column) -> Column:
    return F.regexp_replace(text, "[ \t\n]+", " ")


def consistent(rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, ``form``, ``changed``): every text in its consistent form, runs of white space as one space."""
    forms = rows.select(id_col, text).distinct().withColumn("form", one_space(canonical_text(text)))
    return forms.select(id_col, "form", F.coalesce(F.col("form") != one_space(F.col(text)), F.lit(False)).alias("changed"))


def look_alike_pairs(rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """Every two ids (a < b) whose texts differ, white space apart, and have the same consistent form; empty texts are left out."""
    texts = rows.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).where(F.length("_text") > 0).distinct()
    keyed = texts.select("_id", text_key(one_space(F.col("_text"))).alias("stored"), text_key(one_space(canonical_text("_text"))).alias("form"))
    return pairs_in_groups(keyed, "form", "_id", unlike="stored")
