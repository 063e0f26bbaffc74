"""Scalar text functions as Column expressions: search normalization, stop words, script ratio, hashes, sizes, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words left out of keyword queries.
STOP_EN = (
    "a an the and or but if then else when what which who whom whose where why how is are was were be been being do does did have has had having "
    "i you he she it we they them this that these those in on at to for of with by from as into through during about into over after before between "
    "out up down off again further once here there all any both each few more most other some such no nor not only own same so than too very can will "
    "just should now according available source sources passage mention mentioned say says said give provide made make makes many much like likely use "
    "used using often name named part tell tells describe describes explain explains include includes including contain contains within without also "
    "well may might must shall per one two three first second list"
).split()
STOP_AR = (
    "من في على إلى عن مع هذا هذه ذلك التي الذي الذين ما ماذا كيف هل قد لا نعم هو هي هم نحن أن إن أو و ثم إذا كان كانت يكون تكون بين بعد قبل عند غير كل بعض كما هل "
    "وما وهل المرجع المصدر المصادر المتاحة يذكر تذكر اذكر أعطني يقول تقول التالي التالية"
).split()
# What in a query asks for sources in English.
ENGLISH_HINT = "الانجليز|الإنجليز|english"

# White space as Unicode has it, for character classes; Java's own is ASCII.
SPACES = r"\s\p{Z}\x1c-\x1f\x{85}"
SPACE, NOT_SPACE = f"[{SPACES}]", f"[^{SPACES}]"
# Blocks, digits, spellings and marks that normalization knows; the pattern of tokens that the recognizer makes of stray marks.
ARABIC_CLASS = r"\x{600}-\x{6ff}\x{fb50}-\x{fdff}\x{fe70}-\x{fefc}"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
SHORT_LATIN, LONG_LATIN = "^[^A-Za-z0-9]*[A-Za-z]{1,3}[^A-Za-z0-9]*$", "[A-Za-z]{4,}"


def normalize_search(text: Column) -> Column:
    """Form that keyword search compares: one alef, one yeh, ASCII digits, no marks, no control characters, lower case, single spaces.

    Control characters go before white space is collapsed, so a line break glues the words beside it; text that was chunked first
    has none. Use ``normalize_lines`` for raw text of several lines.
    """
    t = F.regexp_replace(text, "ا([أإآ])ل", "ال$1")
    t = F.regexp_replace(t, "اال(?=[؀-ۿ])", "الا")
    t = F.translate(t, ARABIC_DIGITS, "0123456789")
    t = F.regexp_replace(t, "[ً-ْٰـ]", "")
    t = F.translate(t, "أإآٱؤئةى", "ااااويهي")
    t = F.lower(F.regexp_replace(t, r"[\x{fffd}\p{Cc}\p{Cf}\p{Co}]", ""))
    return F.trim(F.regexp_replace(t, f"{SPACE}+", " "))


def normalize_lines(text: Column) -> Column:
    """``normalize_search`` of text whose line breaks part words."""
    return normalize_search(F.regexp_replace(text, r"[\r\n\t]+", " "))


def normalize_word(word: str) -> str:
    """``normalize_search`` of one word on the driver, for word lists."""
    table = str.maketrans("أإآٱؤئةى" + ARABIC_DIGITS, "ااااويهي" + "0123456789")
    return word.translate(table).lower()


STOP_WORDS = sorted({*STOP_EN, *map(normalize_word, STOP_AR)})


def words_of(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda w: w != "")


def strip_stopwords(normalized: Column) -> Column:
    return F.array_join(F.filter(F.split(normalized, " "), lambda w: (w != "") & ~w.isin(STOP_WORDS)), " ")


def language_hint(query: Column, hints: dict[str, str] | None = None) -> Column:
    """Language that a query asks its sources to have, by the first matching pattern of ``hints`` (language to pattern), or null."""
    out = F.lit(None).cast("string")
    for lang, pattern in reversed((hints or {"en": ENGLISH_HINT}).items()):
        out = F.when(F.lower(query).rlike(pattern), F.lit(lang)).otherwise(out)
    return out


def arabic_ratio(text: Column) -> Column:
    """Share of Arabic-block characters among them and all other letters, 3 decimals; 0 without letters."""
    arabic = F.regexp_count(text, F.lit(f"[{ARABIC_CLASS}]"))
    other = F.regexp_count(text, F.lit(rf"[\p{{L}}&&[^{ARABIC_CLASS}]]"))
    return F.round(F.coalesce(arabic / F.nullif(arabic + other, F.lit(0)), F.lit(0.0)), 3)


def language_label(ratio: Column) -> Column:
    return F.when(ratio >= 0.5, "ar").otherwise("en")


def replacement_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))


def content_hash(derivation: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\n", derivation, text), 256), 1, 32)


def token_estimate(text: Column) -> Column:
    """Additive stand-in for a tokenizer: a quarter of each word's characters, rounded up. 0 for null and empty text."""
    words = F.filter(F.split(text, f"{SPACE}+"), lambda w: F.length(w) > 0)
    return F.coalesce(F.aggregate(words, F.lit(0), lambda n, w: n + F.ceil(F.length(w) / 4).cast("int")), F.lit(0))


# Letters with marks of the Latin alphabet's extensions, and the letters without.
MARKED = "àáâãäåāăąçćĉċčďḍèéêëēĕėęěĝğġģĥḥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšṣţťṭùúûüũūŭůűųŵýÿŷźżžẓ"
UNMARKED = "aaaaaaaaacccccddeeeeeeeeegggghhiiiiiiiijklllnnnnoooooooorrrsssssttttuuuuuuuuuuwyyyzzzz"


def search_tokens(text: Column) -> Column:
    """Tokens of the inverted index: lower case, marks folded, runs of letters and numbers."""
    folded = F.translate(F.lower(text), MARKED, UNMARKED)
    return F.regexp_extract_all(folded, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def clean_fragments(text: Column) -> Column:
    """Text without short Latin words that have no longer one beside them; the white space around them stays."""
    parts = F.regexp_extract_all(text, F.lit(f"({SPACE}+|{NOT_SPACE}+)"), F.lit(1))

    def kept(all_: Column) -> Column:
        anchored = lambda i: (i >= 0) & F.coalesce(F.get(all_, F.greatest(i, F.lit(0))), F.lit("")).rlike(LONG_LATIN)
        return F.array_join(F.filter(all_, lambda p, i: ~(p.rlike(SHORT_LATIN) & ~anchored(i - 2) & ~anchored(i + 2))), "")

    # The lambda gives the parts a name, so that they are made once.
    return F.get(F.transform(F.array(parts), kept), 0)


def printed_label(text: Column, pattern: str, least: int, most: int, reviewed: Column | None = None) -> Column:
    """Label of a page: the reviewed one, else the number that ``pattern`` finds in the first three lines, within the book's range."""
    head = F.translate(F.array_join(F.slice(F.split(text, "\n"), 1, 3), " "), ARABIC_DIGITS, "0123456789")
    number = F.regexp_extract(head, pattern, 1).try_cast("int")
    parsed = F.when(number.between(least, most), number.cast("string"))
    return parsed if reviewed is None else F.coalesce(F.nullif(reviewed, F.lit("")), parsed)


def display_text(reviewed: Column, raw: Column) -> Column:
    return F.when(F.length(F.coalesce(reviewed, F.lit(""))) > 0, reviewed).otherwise(raw)


def display_derivation(reviewed: Column, derivation: Column) -> Column:
    return F.when(F.length(F.coalesce(reviewed, F.lit(""))) > 0, "reviewed_transcription").otherwise(F.coalesce(F.nullif(derivation, F.lit("")), F.lit("extracted")))


def passage_id(doc_id: Column, page: Column, ordinal: Column) -> Column:
    """Zero padding is a least width: order by (pdf_page, ordinal), never by this."""
    return F.format_string("%s:p%03d:%02d", doc_id, page, ordinal)
