"""Problem 1: records that differ only in white space, letter case, punctuation or the order of their fields.

Byte-identical texts are collapsed first, with counts; only the distinct survivors are brought to their canonical text, and
these are grouped again with the counts summed. All of it is built-in expressions.

Canonical text: the letters and digits (Unicode L and N) of the text in one case. A record is a text of two or more
parts, each ``label: value``, parted by semicolons, bullets, bars, slashes, line ends or commas; its canonical text is the sorted
list of its fields, each label kept with its own value.

Defined cases: null texts belong to no group; texts without any letter or digit (empty ones too) have the empty
canonical text and are one group; repeated rows (same id and text) count once; an id with two texts belongs to both groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pairs_in_groups, text_key

#: A text of one field has the same fields as another exactly if it has the same letters and digits.
MIN_FIELDS = 2
#: Marks between the fields of a record, and between a label and its value.
FIELD_MARKS = r"[;؛；•·●▪|¦｜\n\r\t]|\s[/–—-]\s|[,،](?=[^,،:：=]+[:：=])"
LABEL_MARKS = r"[:：=]"


def letters_and_digits(text: Column) -> Column:
    """Letters and digits only, without regard to case. Upper case first, so that letters with one capital between them agree; ß is SS in capitals."""
    return F.replace(F.lower(F.upper(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))), F.lit("ß"), F.lit("ss"))


def record_fields(text: Column) -> Column:
    """Sorted canonical fields of a ``label: value`` record, or null where the text is no such record."""
    parts = F.filter(F.split(text, FIELD_MARKS), lambda p: F.length(F.regexp_replace(p, r"[^\p{L}\p{N}]+", "")) > 0)
    label = lambda p: letters_and_digits(F.regexp_extract(p, rf"^([^:：=]+){LABEL_MARKS}", 1))
    value = lambda p: letters_and_digits(F.regexp_replace(p, rf"^[^:：=]*{LABEL_MARKS}", ""))
    fields = F.transform(parts, lambda p: F.concat(label(p), F.lit("\x1f"), value(p)))
    whole = F.forall(fields, lambda f: ~f.startswith("\x1f"))
    return F.when(text.rlike(LABEL_MARKS) & (F.size(parts) >= MIN_FIELDS) & whole, F.array_sort(fields))


def canonical_texts(rows: DataFrame, text: str) -> DataFrame:
    """One row per distinct text: ``text_id``, ``copies`` (rows with it), ``plain`` and ``record`` keys of its canonical forms."""
    raw = rows.where(F.col(text).isNotNull()).select(text_key(F.col(text)).alias("text_id"), F.col(text).alias("_text"))
    distinct = raw.groupBy("text_id").agg(F.count("*").alias("copies"), F.any_value("_text").alias("_text"))
    return distinct.select("text_id", "copies", text_key(letters_and_digits(F.col("_text"))).alias("plain"), text_key(F.array_join(record_fields(F.col("_text")), "\x1e")).alias("record"))


def collapse(rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row per canonical text: ``record_id`` (least id), ``copies`` (distinct ids) and ``spellings`` (distinct raw texts).

    Records go by their fields, whatever the order; anything else by its letters and digits.
    """
    rows = rows.select(id_col, text).where(F.col(id_col).isNotNull()).distinct()
    keyed = canonical_texts(rows, text).select("text_id", "copies", F.coalesce("record", "plain").alias("canonical"))
    least = rows.where(F.col(text).isNotNull()).select(F.col(id_col).alias("_id"), text_key(F.col(text)).alias("text_id")).groupBy("text_id").agg(F.min("_id").alias("_id"))
    return keyed.join(least, "text_id").groupBy("canonical").agg(F.min("_id").alias("record_id"), F.sum("copies").alias("copies"), F.count("*").alias("spellings")).select("record_id", "copies", "spellings")


def duplicate_pairs(rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """Every two ids (a < b) whose texts have the same canonical form."""
    members = rows.select(F.col(id_col).alias("_id"), F.col(text).alias("_t")).where(F.col("_id").isNotNull()).distinct()
    members = members.select("_id", text_key(F.col("_t")).alias("text_id"))
    keyed = canonical_texts(rows.select(id_col, text).distinct(), text)
    # The two key spaces are kept apart by a leading letter, so one join serves both.
    keys = keyed.select("text_id", "copies", F.explode(F.array_compact(F.array(F.concat(F.lit(b"p"), "plain"), F.concat(F.lit(b"r"), "record")))).alias("canonical"))
    shared = keys.groupBy("canonical").agg(F.sum("copies").alias("_n")).where("_n > 1").select("canonical")
    return pairs_in_groups(members.join(keys.join(shared, "canonical", "left_semi"), "text_id").select("_id", "canonical"), "canonical", "_id")
