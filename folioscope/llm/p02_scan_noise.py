"""Problem 2: noise in the text of scanned pages, and the text without it.

Running lines are found by how many pages of a book carry them, some at their edges, lines that nearly agree (a misread letter in twenty) included. Page
numbers are lines of nothing but a number at a page's edge whose distance from pdf_page fits the book's. Line ends inside a word are told
from compounds by the corpus's own vocabulary: how often the joined word and the compound stand within lines. Misread words are words
that only scanned pages have and that one confusion turns into a much more frequent word of the vocabulary; which single characters
are confused is learned, by contrast of the scanned pages' words with the other pages' words.

The vocabulary is counted by Spark over all pages (per batch, then summed). Keys of lines, hyphens and numbers leave the tasks as
small rows; no book is gathered anywhere. The misread words go to the tasks as a set only up to ``SET_LIMIT`` of them, and are joined otherwise.

Defined cases: null, empty and blank texts have no defects; engines that don't begin with ``ocr`` and junk pages are left out; repeated
rows count once; a line may have several defects, each once.
"""

from __future__ import annotations

import re
import string
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Bloom, cut

LEAST_PAGES = 3
EDGE_LINES = 4
#: Least letters and digits of a running line, and letters for one misread letter beside the first.
LEAST_KEY, LETTERS_EACH = 8, 20
#: Keys that the pages of one book or running line are spread over.
SALTS = 16
#: A key that so many pages have at an edge counts wherever it stands.
AT_EDGE = 2
#: A misread word's pattern must be so much more frequent, and stand so often on pages that weren't scanned.
RATIO, LEAST_CLEAN = 10, 3
SET_LIMIT = 200_000
#: Longer runs of letters are no words that one confusion could explain.
LONGEST_WORD = 40
# Groups of Latin letters that scanning takes for one another, as read and as printed.
GROUPS = [("rn", "m"), ("ri", "n"), ("ii", "u"), ("cl", "d"), ("vv", "w"), ("li", "h"), ("nn", "m"), ("iii", "m"), ("tl", "d"), ("fi", "h"), ("m", "rn"), ("d", "cl"), ("u", "ii"), ("w", "vv"), ("h", "li")]
# Marks that part a word at a line's end; the first two may also belong to a compound.
HYPHENS, SOFT = "-‐", "¬\xad‑"
MARKS_AT_END = {*HYPHENS, *SOFT}

WORD = re.compile(r"\w+")
COMPOUND = re.compile(r"(?<!\w)[^\W\d_]+[-‐][^\W\d_]+")
BREAK = re.compile(r"[-‐‑¬\xad][ \t]*\n")
END = re.compile(r"([^\W\d_]+)([-‐‑¬\xad])\s*$")
BEGIN = re.compile(r"\s*([^\W\d_]+)")
NUMBER = re.compile(r"[\W_]*(?:(\d{1,9})|([ivxlcIVXLC]{1,7}))[\W_]*$")
NOT_KEY = re.compile(r"[^\w\n]+")
EDGE_NUMBER = re.compile(r"^(?:[^\w\n]|_)*\d+(?!\w)|(?<!\w)\d+(?:[^\w\n]|_)*$", re.MULTILINE)
ARABIC, LATIN = re.compile("[\u0620-\u06ff\ufb50-\ufdff\ufe70-\ufefc]"), re.compile(r"[A-Za-z]")
FRAGMENT = re.compile(r"^[A-Za-z]{1,4}[.,،؛;:]?$")
LONG_LATIN = re.compile(r"[A-Za-zÀ-ɏ]{4}")
TRIPLED = re.compile(r"([^\W\d_])\1\1\S*")
MARK_BYTES = string.punctuation.encode()
IS_MARK = np.isin(np.arange(256), list(MARK_BYTES))
#: ASCII that no key has, and what may stand around a number at a line's end. Bytes of other characters aren't ASCII in UTF-8.
NOT_KEY_BYTES = bytes(b for b in range(128) if not chr(b).isalnum() and chr(b) != "\n")
AROUND = string.punctuation + " \t"
AROUND_WORD = AROUND.replace("_", "")
CELL = re.compile(r"[^\s|;,،]+")
MARKS = re.compile("[\u0300-\u036f\u0653-\u0655]")
#: For Arrow's search: texts whose words aren't those between spaces (İ has a mark of its own in lower case), and spaces that Arrow doesn't part ASCII at.
NOT_PLAIN, ODD_SPACE = f"{MARKS.pattern}|İ|[-‐‑¬\xad][ \t]*\n", "[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Pages whose lines are read together.
PAGES_TOGETHER = 2048


def composed(text: str) -> str:
    return text if text.isascii() or not MARKS.search(text) else unicodedata.normalize("NFC", text)


def junk(text: str) -> bool:
    """Page of kind junk by its tokens, as the page kinds have it."""
    sizes = list(map(len, text.split()))
    n, chars = len(sizes), sum(sizes)
    if not n:
        return False
    if chars > 30 * n and (not (cells := CELL.findall(text)) or sum(map(len, cells)) > 30 * len(cells)):
        return True
    raw = text.encode("utf-8", "surrogatepass")
    if sizes.count(1) + sizes.count(2) > 0.6 * n or len(raw) - len(raw.translate(None, MARK_BYTES)) > 0.35 * chars:
        return True
    # Where over 0.3 of the tokens have three letters of a kind, their mean length is well above that of prose.
    if chars <= 5 * n:
        return False
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    same = codes[1:] == codes[:-1]
    # No more tokens can have three of a kind than there are places that do.
    return int(np.count_nonzero(same[1:] & same[:-1])) > 0.3 * n and len(TRIPLED.findall(text)) > 0.3 * n


def junk_pages(texts: pa.Array) -> np.ndarray:
    """``junk`` of each text; most are told from junk by counts over all texts at once."""
    raw = np.frombuffer(b"".join(pc.cast(texts, pa.large_binary()).to_pylist()), dtype=np.uint8)
    tokens = pc.ascii_split_whitespace(texts)
    sizes = pc.utf8_length(tokens.flatten()).to_numpy()
    by_token, by_byte = (np.append(0, np.cumsum(x.to_numpy(zero_copy_only=False))) for x in (pc.list_value_length(tokens), pc.binary_length(texts)))
    each = lambda those, at: np.diff(np.searchsorted(np.flatnonzero(those), at))
    n, short, chars = each(sizes > 0, by_token), each((sizes == 1) | (sizes == 2), by_token), np.diff(np.append(0, np.cumsum(sizes, dtype=np.int64))[by_token])
    marks, tripled = each(IS_MARK[raw], by_byte), each(three_of_a_kind(raw), by_byte)
    maybe = (chars > 30 * n) | (short > 0.6 * n) | (marks > 0.35 * chars) | ((chars > 5 * n) & (tripled > 0.3 * n))
    maybe |= pc.match_substring_regex(texts, ODD_SPACE).to_numpy(zero_copy_only=False)
    maybe[maybe] = [junk(x) for x in texts.filter(pa.array(maybe)).to_pylist()]
    return maybe


def three_of_a_kind(raw: np.ndarray) -> np.ndarray:
    """Where bytes of UTF-8 have the same character three times, by the first of its bytes."""
    out = np.zeros(len(raw), dtype=bool)
    for width, first, last in ((1, 0, 0x7F), (2, 0xC2, 0xDF), (3, 0xE0, 0xEF), (4, 0xF0, 0xF4)):
        if len(raw) >= 3 * width:
            same = raw[width:] == raw[:-width]
            found = (raw >= first)[: len(same)] & (raw <= last)[: len(same)]
            for i in range(2 * width):
                found = found[: len(same) - i] & same[i:]
            out[: len(found)] |= found
    return out


def roman(word: str) -> int:
    values = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c] for c in word.lower()]
    return sum(-v if any(x > v for x in values[i + 1 : i + 2]) else v for i, v in enumerate(values))


def unbroken(text: str) -> str:
    """The text without the words that its line ends break."""
    if not BREAK.search(text):
        return text
    lines = text.split("\n")
    for i in range(len(lines) - 1):
        if lines[i].rstrip(" \t")[-1:] in MARKS_AT_END and (cut_ := END.search(lines[i])):
            lines[i] = lines[i][: cut_.start()]
            if head := BEGIN.match(lines[i + 1]):
                lines[i + 1] = lines[i + 1][head.end() :]
    return "\n".join(lines)


def scanned() -> Column:
    return F.col("engine").startswith("ocr")


def in_arrow(texts: pd.Series) -> pa.Array:
    try:
        return pa.array(list(texts), pa.large_string())
    except UnicodeEncodeError:  # single surrogates are in no word
        return pa.array([x.encode("utf-8", "replace").decode() for x in texts], pa.large_string())


def in_python(values: pa.Array) -> list:
    return values.to_numpy(zero_copy_only=False).tolist()


def plain(texts: pa.Array) -> pa.Array:
    """Texts that have between spaces the words that count, in any case: none that a line's end breaks."""
    odd = pc.match_substring_regex(texts, NOT_PLAIN)
    changed = [unbroken(composed(x.lower())) for x in texts.filter(odd).to_pylist()]
    return pc.replace_with_mask(texts, odd, pa.array(changed, texts.type)) if changed else texts


def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words and compounds within lines, of scanned and of other pages. Words broken at a line's end don't count."""
    for batch in batches:
        counts, texts, ocr = (defaultdict(int), defaultdict(int)), plain(in_arrow(batch["text"])), batch["ocr"].to_numpy(dtype=bool)
        # Words and compounds lie between spaces: what comes again is taken apart once.
        for count, some in zip(counts, (~ocr, ocr), strict=True):
            tokens = pc.ascii_split_whitespace(texts.filter(pa.array(some))).flatten().value_counts()
            for token, n in zip(in_python(tokens.field("values")), in_python(tokens.field("counts")), strict=True):
                token = token.lower()
                if (bare := token.strip(AROUND_WORD)).isalnum():
                    count[bare] += n
                    continue
                for word in WORD.findall(token):
                    count[word] += n
                if "-" in token or "‐" in token:
                    for word in COMPOUND.findall(token):
                        count[word] += n
        words = [w for w in counts[0].keys() | counts[1].keys() if not w.isdigit()]
        if words:
            yield pd.DataFrame({"word": words, "n_clean": [counts[0].get(w, 0) for w in words], "n_ocr": [counts[1].get(w, 0) for w in words]})


def vocabulary(pages: DataFrame) -> DataFrame:
    """(word, n_clean, n_ocr) of the whole corpus."""
    rows = pages.select(scanned().alias("ocr"), F.col("raw_text").alias("text")).where("text is not null and ocr is not null")
    return rows.mapInPandas(count_words, "word string, n_clean long, n_ocr long").groupBy("word").agg(F.sum("n_clean").alias("n_clean"), F.sum("n_ocr").alias("n_ocr"))


def with_gap(words: DataFrame, keep: list[str]) -> DataFrame:
    """Every word once per character, with that character taken out: words that differ in one character meet."""
    places = F.explode(F.sequence(F.lit(1), F.length("word")))
    rows = words.withColumn("_at", places)
    gap = F.concat(F.substr("word", F.lit(1), F.col("_at") - 1), F.lit("\x00"), F.substr("word", F.col("_at") + 1))
    return rows.select(*keep, gap.alias("gap"), F.substr("word", F.col("_at"), F.lit(1)).alias("char"))


def misread_words(words: DataFrame) -> DataFrame:
    """(word, printed): words of scanned pages with the word that was printed."""
    lettered = words.where(F.length("word").between(3, LONGEST_WORD) & ~F.col("word").rlike("[-‐]") & F.col("word").rlike(r"\p{L}.*\p{L}"))
    # Printed words have no numerals: one confusion explains one at most. Most words of a large corpus are codes with more.
    lettered = cut(lettered.where(~F.col("word").rlike(r"\p{N}.*\p{N}")).withColumn("numbered", F.col("word").rlike(r"\p{N}")))
    only = lambda a, b: (F.col(a) > 0) & (F.col(a) >= 20 * F.col(b))
    odd = lettered.where(only("n_ocr", "n_clean")).select("word", F.col("n_ocr").alias("n"), F.lit(True).alias("ocr"), "numbered")
    # Words that only the other pages have show how often two sound words differ in that way.
    odd = odd.unionByName(lettered.where((F.col("n_ocr") == 0) & (F.col("n_clean") > 0)).select("word", F.col("n_clean").alias("n"), F.lit(False).alias("ocr"), "numbered"))
    # No word stands less than once, so that no pattern is rarer than RATIO.
    known = lettered.where((F.col("n_clean") >= LEAST_CLEAN) & ~F.col("numbered")).select("word", (F.col("n_clean") + F.col("n_ocr")).alias("total")).where(F.col("total") >= RATIO)
    gaps = with_gap(known, ["word", "total"]).select(F.col("word").alias("printed"), "total", "gap", F.col("char").alias("to"))
    near = with_gap(odd, ["word", "n", "ocr"]).join(gaps, "gap").where((F.col("char") != F.col("to")) & (F.col("total") >= RATIO * F.col("n")))
    near = near.select("word", "n", "ocr", "printed", "total", "char", "to")
    kinds = near.groupBy("char", "to").agg(F.count_distinct(F.when(F.col("ocr"), F.col("word"))).alias("_o"), F.count_distinct(F.when(~F.col("ocr"), F.col("word"))).alias("_c"))
    learned = kinds.where((F.col("_o") >= 3) & (F.col("_o") >= 3 * F.col("_c"))).select("char", "to")
    single = near.where("ocr").join(learned, ["char", "to"]).select("word", "printed", "total")
    # Groups: the word as read, with every occurrence of a group replaced in turn.
    groups = F.explode(F.array(*[F.struct(F.lit(r).alias("read"), F.lit(p).alias("as_printed")) for r, p in GROUPS])).alias("_g")
    tries = odd.where("ocr and not numbered").select("word", "n", groups).select("word", "n", "_g.*").where(F.contains("word", F.col("read")))
    tries = tries.withColumn("_at", F.explode(F.sequence(F.lit(1), F.length("word")))).where(F.substr("word", F.col("_at"), F.length("read")) == F.col("read"))
    grouped = tries.select("word", "n", F.concat(F.substr("word", F.lit(1), F.col("_at") - 1), F.col("as_printed"), F.substr("word", F.col("_at") + F.length("read"))).alias("printed"))
    grouped = grouped.join(known.withColumnRenamed("word", "printed"), "printed").where(F.col("total") >= RATIO * F.col("n")).select("word", "printed", "total")
    return single.unionByName(grouped).groupBy("word").agg(F.max_by("printed", F.struct("total", "printed")).alias("printed"))


def keys_of(text: str) -> list[str]:
    """What each line is compared by: letters and digits in one case, without a number that stands by itself at an end."""
    lines = text.split("\n")
    for i, x in enumerate(lines):
        # Most lines begin and end with letters.
        if x and not (x[0].isalpha() and x[-1].isalpha()) and may_have_number(x.strip(AROUND)):
            lines[i] = EDGE_NUMBER.sub("", x)
    lines = "\n".join(lines).encode("utf-8", "surrogatepass").translate(None, NOT_KEY_BYTES).decode("utf-8", "surrogatepass").split("\n")
    return [(x if x.isascii() else NOT_KEY.sub("", x)).lower() for x in lines]


def may_have_number(line: str) -> bool:
    """False for most lines that have no number at an end; given without the marks around it."""
    return line != "" and (line[0].isdecimal() or line[-1].isdecimal() or not (line[0].isalnum() and line[-1].isalnum()))


LINE_SCHEMA = "doc_id string, pdf_page int, ocr boolean, ids array<long>, nos array<int>, edges array<int>, near array<struct<id:long, line_no:int, key:string>>, numbers array<struct<line_no:int, value:int>>, hyphens array<struct<line_no:int, cut:string, heads:string>>"


def read_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One small row per page: ids of its lines by book and key, with their places; and of scanned pages the keys of lines at edges, numbers at edges, and words cut at line ends with what follows."""
    for batch in batches:
        for at in range(0, len(batch), PAGES_TOGETHER):
            some = batch.slice(at, PAGES_TOGETHER)
            yield lines_of(some.filter(pa.array(~junk_pages(some["text"]))))


def lines_of(pages: pa.RecordBatch) -> pa.RecordBatch:
    marked = pc.match_substring_regex(pages["text"], MARKS.pattern).to_pylist()
    texts = [composed(x) if m else x for x, m in zip(pages["text"].to_pylist(), marked, strict=True)]
    ocr, books = pages["ocr"].to_numpy(zero_copy_only=False), [f"{x}\x00" for x in pages["doc_id"].to_pylist()]
    text = "\n".join(texts)
    lines, keys = text.split("\n"), keys_of(text)
    many = np.array([x.count("\n") + 1 for x in texts])
    of_page, begin = np.repeat(np.arange(len(texts)), many), np.cumsum(many) - many
    # Of lines that aren't blank: their place among all, their page, and how far the page's nearer edge is.
    at = np.array([i for i, x in enumerate(lines) if x and not x.isspace()], dtype=np.int64)
    page = of_page[at]
    full = np.bincount(page, minlength=len(texts))
    place = np.arange(len(at)) - (np.cumsum(full) - full)[page]
    edge, no, scan = np.minimum(place, full[page] - 1 - place), at - begin[page] + 1, ocr[page]
    is_line = np.ones(len(at), dtype=bool)
    numbers, values, hyphens, cuts, heads = [], [], [], [], []
    for k in np.flatnonzero(scan & (edge <= 1)).tolist():
        if m := NUMBER.match(lines[at[k]]):
            is_line[k] = False
            numbers.append(k)
            values.append(int(m[1]) if m[1] else roman(m[2]))
    for k in np.flatnonzero(scan & is_line).tolist():
        line = lines[at[k]]
        if line.rstrip()[-1] in MARKS_AT_END and (cut_ := END.search(line)):
            after = [lines[at[j]] for j in range(k + 1, min(k + 4, len(at))) if page[j] == page[k]]
            hyphens.append(k)
            cuts.append(cut_[1].lower() + cut_[2])
            heads.append(" ".join(m[1].lower() for x in after if (m := BEGIN.match(x))))
    keyed = np.flatnonzero(is_line & (np.fromiter(map(len, keys), np.int64, len(keys))[at] >= LEAST_KEY))
    ids = np.array([xxhash.xxh3_64_intdigest(books[p] + keys[i]) for p, i in zip(page[keyed].tolist(), at[keyed].tolist(), strict=True)], dtype=np.uint64)
    ids = (ids ^ np.uint64(1 << 63)).view(np.int64)
    near = edge[keyed] < 2

    def by_page(of: np.ndarray, values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(page[of], np.arange(len(texts) + 1)), pa.int32()), values)

    def rows(of: np.ndarray, **fields: pa.Array) -> pa.ListArray:
        return by_page(of, pa.StructArray.from_arrays([*fields.values()], [*fields]))

    numbers, hyphens = np.array(numbers, dtype=np.int64), np.array(hyphens, dtype=np.int64)
    columns = {
        "doc_id": pages["doc_id"], "pdf_page": pages["pdf_page"], "ocr": pages["ocr"],
        "ids": by_page(keyed, pa.array(ids)), "nos": by_page(keyed, pa.array(no[keyed], pa.int32())), "edges": by_page(keyed, pa.array(edge[keyed], pa.int32())),
        "near": rows(keyed[near], id=pa.array(ids[near]), line_no=pa.array(no[keyed[near]], pa.int32()), key=pa.array([keys[i] for i in at[keyed[near]].tolist()], pa.string())),
        "numbers": rows(numbers, line_no=pa.array(no[numbers], pa.int32()), value=pa.array(values, pa.int32())),
        "hyphens": rows(hyphens, line_no=pa.array(no[hyphens], pa.int32()), cut=pa.array(cuts, pa.string()), heads=pa.array(heads, pa.string())),
    }
    return pa.RecordBatch.from_pydict(columns)


def salt() -> Column:
    return F.pmod(F.xxhash64("pdf_page"), F.lit(SALTS)).cast("int").alias("_salt")


def each_salt() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")


def grams(length: Column, key: Column) -> Column:
    """Hashed runs of letters of a key, as long as at least one of them stays whole in any line that nearly agrees with it."""
    size = gram_size(length)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(key) - size + 1), lambda i: F.xxhash64("doc_id", F.substr(key, i, size))))


def gram_size(length: Column) -> Column:
    return F.when(length < 20, 4).when(length < 40, 6).otherwise(8)


def asked_grams(key: Column) -> Column:
    """Hashed runs that begin the parts of a line's key, one part more than letters may be misread: at least one part stays whole in any key that nearly agrees."""
    length = F.length(key)
    # A longer key may have a letter more misread: at most one for LETTERS_EACH - 1 of this one's.
    parts = 2 + F.floor((length + 1) / (LETTERS_EACH - 1)).cast("int")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.xxhash64("doc_id", F.substr(key, 1 + F.floor(i * length / parts).cast("int"), gram_size(length)))))


def running_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, pdf_page, line_no) of running lines on scanned pages.

    ``id`` is of book and key. Keys at the edges of two pages are counted first; of all other lines only those with such a key
    leave the scan, by a Bloom filter of bounded size, and are counted exactly.
    """
    places = F.explode(F.arrays_zip("ids", "nos", "edges")).alias("x")
    keyed = lines.select("doc_id", "pdf_page", "ocr", places).select("doc_id", "pdf_page", "ocr", F.col("x.ids").alias("id"), F.col("x.nos").alias("line_no"), F.col("x.edges").alias("edge"))
    near = lines.select("doc_id", "pdf_page", "ocr", F.explode("near").alias("x")).select("doc_id", "pdf_page", "ocr", "x.*")
    edges = keyed.where(F.col("edge") < EDGE_LINES).groupBy("id").agg(F.min("pdf_page").alias("_a"), F.max("pdf_page").alias("_b"))
    twice = Bloom(cut(edges.where("_a != _b").select("id")), "id")
    often = keyed.where(twice.may_have(F.col("id"))).groupBy("id", "pdf_page").agg(F.min("edge").alias("edge"))
    often = often.groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.col("edge") < EDGE_LINES).alias("at_edge"))
    often = cut(often.where((F.col("n") >= LEAST_PAGES) & (F.col("at_edge") >= AT_EDGE)).select("id"))
    # A book's title may stand on a third of all pages: its lines are spread.
    known = often.select("id", each_salt())
    running = Bloom(often, "id")
    passed = running.may_have(F.col("id"))
    exact = keyed.where(F.col("ocr") & passed).withColumn("_salt", salt()).join(known, ["id", "_salt"], "left_semi").select("doc_id", "pdf_page", "line_no")
    at_edges = cut(near.withColumn("_passed", passed).withColumn("_salt", salt()))
    named = at_edges.where("_passed").join(known, ["id", "_salt"], "left_semi").groupBy("id").agg(F.max("doc_id").alias("doc_id"), F.max("key").alias("key"))
    others = at_edges.where("ocr and not _passed").drop("_salt").unionByName(at_edges.where("ocr and _passed").join(known, ["id", "_salt"], "left_anti").drop("_salt"))
    return exact.unionByName(nearly(others, named)).distinct()


def nearly(read: DataFrame, often: DataFrame) -> DataFrame:
    """Lines that one letter, and one more for every LETTERS_EACH, keeps from being a running line of their book.

    They meet by a run of letters of the book that both have: all runs of a running line are known, and a line asks for one in each of its parts.
    Only runs of running lines leave the scan.
    """
    errors = 1 + F.floor(F.length("_key") / LETTERS_EACH).cast("int")
    named = often.select("doc_id", F.col("key").alias("_key"))
    lengths = F.explode(F.array_distinct(F.array(F.length("_key") - errors, F.length("_key"), F.length("_key") + errors)))
    known = cut(named.withColumn("_length", lengths).select("doc_id", "_key", F.explode(grams(F.col("_length"), F.col("_key"))).alias("gram")).distinct())
    tried = read.select("doc_id", "pdf_page", "line_no", "key", F.explode(asked_grams(F.col("key"))).alias("gram"))
    met = tried.where(Bloom(known, "gram").may_have(F.col("gram"))).join(known.withColumnRenamed("doc_id", "_doc"), "gram").where("doc_id = _doc and key != _key")
    met = met.where(F.abs(F.length("key") - F.length("_key")) <= errors).select("doc_id", "pdf_page", "line_no", "key", "_key").distinct()
    return met.where(F.levenshtein("key", "_key") <= errors).select("doc_id", "pdf_page", "line_no")


def page_numbers(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Numbers at edges whose distance from pdf_page is within 3 of the book's commonest, or that are the printed label."""
    numbers = lines.select("doc_id", "pdf_page", F.explode("numbers").alias("x")).select("doc_id", "pdf_page", "x.*").withColumn("_lag", F.col("pdf_page") - F.col("value"))
    common = numbers.groupBy("doc_id", "_lag").agg(F.count("*").alias("_n")).groupBy("doc_id").agg(F.max_by("_lag", F.struct("_n", -F.abs("_lag"))).alias("_usual"))
    digits = F.translate(F.lower("printed_label"), "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")
    labels = pages.where("printed_label is not null").select("doc_id", "pdf_page", F.try_to_number(digits, F.lit("999999999")).cast("int").alias("_label")).groupBy("doc_id", "pdf_page").agg(F.max("_label").alias("_label"))
    held = numbers.withColumn("_salt", salt()).join(common.withColumn("_salt", each_salt()), ["doc_id", "_salt"]).join(labels, ["doc_id", "pdf_page"], "left")
    small = (F.col("value") <= 60) & (F.col("pdf_page") <= 60) & (F.abs("_lag") <= 20)
    return held.where((F.abs(F.col("_lag") - F.col("_usual")) <= 3) | F.coalesce(F.col("value") == F.col("_label"), F.lit(False)) | small).select("doc_id", "pdf_page", "line_no")


def broken_words(lines: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, pdf_page, line_no): line ends inside a word."""
    cuts = lines.select("doc_id", "pdf_page", F.explode("hyphens").alias("x")).select("doc_id", "pdf_page", "x.line_no", F.expr("left(x.cut, length(x.cut) - 1)").alias("left"), F.right("x.cut", F.lit(1)).alias("mark"), F.split("x.heads", " ").alias("heads"))
    soft = cuts.where(F.col("mark").isin(*SOFT)).select("doc_id", "pdf_page", "line_no")
    hard = cuts.where(F.col("mark").isin(*HYPHENS))
    heads = hard.select("doc_id", "pdf_page", "line_no", "left", F.posexplode("heads").alias("at", "right"))
    asked = {"joined": F.concat("left", "right"), "compound": F.concat("left", F.lit("-"), "right"), "n_left": F.col("left"), "n_right": F.col("right")}
    each = heads.select("*", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), word.alias("word")) for name, word in asked.items()])).alias("_q")).select("doc_id", "pdf_page", "line_no", "at", "left", "_q.*")
    known = words.select("word", (F.col("n_clean") + F.col("n_ocr")).alias("_n"))
    counted = each.join(known, "word", "left").groupBy("doc_id", "pdf_page", "line_no", "at", "left")
    asked = counted.agg(*[F.coalesce(F.max(F.when(F.col("name") == name, F.col("_n"))), F.lit(0)).alias(name) for name in asked])
    first = F.col("at") == 0
    is_compound = (F.col("compound") > F.col("joined")) | ((F.col("joined") == 0) & first & ((F.col("left") == "al") | ((F.col("n_left") >= 20) & (F.col("n_right") >= 20) & (F.length("left") > 2))))
    judged = asked.groupBy("doc_id", "pdf_page", "line_no").agg(F.max((F.col("joined") > 0) & (F.col("joined") >= F.col("compound"))).alias("_joins"), F.max(first & is_compound).alias("_compound"))
    return soft.unionByName(judged.where(F.col("_joins") | ~F.col("_compound")).select("doc_id", "pdf_page", "line_no")).distinct()


def fragments(tokens: list[str]) -> list[int]:
    """Places of stray Latin fragments in a line of Arabic script: short, small, and with no longer Latin word beside them."""
    return [i for i, t in enumerate(tokens) if FRAGMENT.match(t) and t.islower() and not any(LONG_LATIN.search(x) for x in tokens[max(0, i - 1) : i] + tokens[i + 1 : i + 2])]


def in_arabic(line: str) -> bool:
    return len(ARABIC.findall(line)) > len(LATIN.findall(line))


def misread_reader(known: frozenset[str] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines with stray fragments (word null) and with words of the set, or with all their words where there is no set."""

    def asked(token: str) -> list[str]:
        token = token.lower()
        words = [bare] if (bare := token.strip(AROUND_WORD)).isalnum() else WORD.findall(token)
        return words if known is None else [w for w in words if w in known]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, PAGES_TOGETHER) for b in batches for at in range(0, len(b), PAGES_TOGETHER)):
            batch = batch.filter(pa.array(~junk_pages(batch["text"])))
            lines = pc.split_pattern(plain(batch["text"]), "\n")
            tokens = pc.ascii_split_whitespace(lines.flatten())
            # What comes again between spaces is taken apart once.
            coded = tokens.flatten().dictionary_encode()
            words = [asked(t) for t in in_python(coded.dictionary)]
            codes = coded.indices.to_numpy()
            at = np.flatnonzero(np.array([bool(w) for w in words], dtype=bool)[codes])
            line = np.searchsorted(tokens.offsets.to_numpy(), at, "right") - 1
            begin = lines.offsets.to_numpy()
            page = np.searchsorted(begin, line, "right") - 1
            out = {(p, no, w) for p, no, code in zip(page.tolist(), (line - begin[page] + 1).tolist(), codes[at].tolist(), strict=True) for w in words[code]}
            arabic = pc.match_substring_regex(batch["text"], ARABIC.pattern).to_numpy(zero_copy_only=False)
            for p in np.flatnonzero(arabic).tolist():
                for no, x in enumerate(batch["text"][p].as_py().split("\n"), 1):
                    if LATIN.search(x) and in_arabic(x) and fragments(x.split()):
                        out.add((p, no, None))
            page, nos, found = zip(*out, strict=True) if out else ((), (), ())
            of = batch.select(["doc_id", "pdf_page"]).take(pa.array(page, pa.int64()))
            yield pa.RecordBatch.from_pydict({"doc_id": of["doc_id"], "pdf_page": of["pdf_page"], "line_no": pa.array(nos, pa.int32()), "word": pa.array(found, pa.string())})

    return read


def defects(pages: DataFrame) -> DataFrame:
    """(doc_id, pdf_page, line_no, defect, word, printed) of the scanned pages; the last two only where a word was misread."""
    texts = pages.select("doc_id", "pdf_page", scanned().alias("ocr"), F.col("raw_text").alias("text"), "printed_label").where("doc_id is not null and pdf_page is not null and text is not null and ocr is not null")
    lines = texts.select("doc_id", "pdf_page", "ocr", "text").mapInArrow(read_lines, LINE_SCHEMA)
    lines = cut(lines)
    words = cut(vocabulary(pages))
    misread = cut(misread_words(words))
    known = None
    if misread.count() <= SET_LIMIT:
        known = frozenset(r["word"] for r in misread.select("word").collect())
    read = texts.where("ocr").select("doc_id", "pdf_page", "text").mapInArrow(misread_reader(known), "doc_id string, pdf_page int, line_no int, word string")
    read = read.join(misread, "word", "left").where("word is null or printed is not null")
    tag = lambda df, kind: df.select("doc_id", "pdf_page", "line_no", F.lit(kind).alias("defect"), F.lit(None).cast("string").alias("word"), F.lit(None).cast("string").alias("printed"))
    found = tag(running_lines(lines), "running_line").unionByName(tag(page_numbers(lines, texts), "page_number")).unionByName(tag(broken_words(lines, words), "hyphen_break"))
    return found.unionByName(read.select("doc_id", "pdf_page", "line_no", F.lit("misread").alias("defect"), "word", "printed")).distinct()


def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages in continuous paragraphs: running lines and numbers out, broken words joined, misread words as printed, fragments out."""
    for batch in batches:
        out = []
        for text, found in zip(batch["text"], batch["defects"], strict=True):
            by: dict[int, list] = {}
            for d in found:
                by.setdefault(d["line_no"], []).append(d)
            parts, joins, longest = [], False, max((len(x) for x in text.split("\n")), default=0)
            for no, line in enumerate(text.split("\n"), 1):
                kinds = {d["defect"] for d in by.get(no, [])}
                if kinds & {"running_line", "page_number"} or not line.strip():
                    continue
                short, ended = len(line) < 0.8 * longest, bool(re.search(r"[.!?؟…:]\W*$", line))
                if "misread" in kinds:
                    fixes = {d["word"]: d["printed"] for d in by[no] if d["word"]}
                    line = WORD.sub(lambda m: as_read(m.group(), fixes.get(m.group().lower())), line)
                    tokens = line.split()
                    stray = set(fragments(tokens)) if in_arabic(line) else set()
                    line = " ".join(t for i, t in enumerate(tokens) if i not in stray)
                line = line.strip()
                if joins and parts:
                    parts[-1] += line
                elif parts and parts[-1] and not parts[-1].endswith("\n"):
                    parts[-1] += " " + line
                else:
                    parts.append(line)
                joins = "hyphen_break" in kinds
                if joins:
                    parts[-1] = parts[-1].rstrip()[:-1]
                elif short and ended:
                    parts[-1] += "\n"
            out.append("".join(parts).strip())
        yield pd.DataFrame({"doc_id": batch["doc_id"], "pdf_page": batch["pdf_page"], "clean_text": out, "mended": [len(x) for x in batch["defects"]]})


def as_read(word: str, printed: str | None) -> str:
    if not printed:
        return word
    return printed.upper() if word.isupper() and len(word) > 1 else printed.capitalize() if word[:1].isupper() else printed


def repaired(pages: DataFrame) -> DataFrame:
    """(doc_id, pdf_page, clean_text, mended) of every scanned page with text; pages of kind junk have no defects and stay as they are."""
    found = defects(pages).groupBy("doc_id", "pdf_page").agg(F.collect_list(F.struct("line_no", "defect", "word", "printed")).alias("defects"))
    texts = pages.where(scanned()).select("doc_id", "pdf_page", F.col("raw_text").alias("text")).where("text is not null").distinct()
    empty = F.array().cast("array<struct<line_no:int,defect:string,word:string,printed:string>>")
    held = texts.join(found, ["doc_id", "pdf_page"], "left").withColumn("defects", F.coalesce("defects", empty))
    return held.mapInPandas(mend, "doc_id string, pdf_page int, clean_text string, mended int")
