from __future__ import annotations

import random
import re
import unicodedata
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from folioscope.llm import oracles, queries
from folioscope.llm import p01_format_duplicates as p01
from folioscope.llm import p02_scan_noise as p02
from folioscope.llm import p03_page_kinds as p03
from folioscope.llm import p04_encodings as p04
from folioscope.llm import p05_repeated_lines as p05
from folioscope.llm import p06_visual_forms as p06
from folioscope.llm import p07_languages as p07
from folioscope.llm import p08_containers as p08
from folioscope.llm import p09_mixing as p09
from folioscope.llm import p10_shared_spans as p10
from folioscope.llm.common import Bloom, pairs_in_groups

from ..compare import DATA, engine, rows

PAGES = "doc_id string, pdf_page int, engine string, raw_text string, printed_label string, text string, ocr boolean, line_id int, clusters int, kind string"
PASSAGES = "pid string, text_search string, text_raw string, lang string, id string, label string, form string, copies int"
DOCUMENTS = "doc_id long, text string, source string, created_at timestamp, tokens int, class_id long, u double, copy int, container int"
ENGLISH = "The walls of the tower rise about forty metres and are made of stone. The report of the old town lists nine pieces, among them a bowl."
ARABIC = "يقع الحصن القديم على مرتفع يطل على الوادي، وكان قد أهمل منذ عام بعيد. أشاد الزوار بما في المدينة من الكرم."


def pages(spark, data):
    return spark.createDataFrame([(*r, *[None] * 5) for r in data], PAGES)


def passages(spark, data):
    return spark.createDataFrame([(*r, *[None] * 4) for r in data], PASSAGES)


def documents(spark, data):
    return spark.createDataFrame([(*r, *[None] * 6) for r in data], DOCUMENTS)


@pytest.fixture(scope="module")
def common_words(spark):
    return spark.read.parquet(f"{DATA}/common_words.parquet")


@pytest.fixture(scope="module")
def languages(spark):
    return p07.train(spark.read.parquet(f"{DATA}/lang_samples.parquet"))


@pytest.fixture(scope="module")
def encodings(spark):
    return p04.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def count_words(text):
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda w: w != "")).cast("long")


EDGES = {
    "p1_pairs": (passages, lambda s, d, f: p01.duplicate_pairs(d, "pid", "text_search")),
    "p1_collapse": (passages, lambda s, d, f: p01.collapse(d, "pid", "text_search")),
    "p6_pairs": (passages, lambda s, d, f: p06.look_alike_pairs(d, "pid", "text_raw")),
    "p6_forms": (passages, lambda s, d, f: p06.consistent(d, "pid", "text_raw")),
    "p7_wanting": (passages, lambda s, d, f: p07.wanting(d, f("languages"), "pid", "text_raw", "lang")),
    "p7_identify": (passages, lambda s, d, f: p07.identify(d, f("languages"), "pid", "text_raw")),
    "p2_defects": (pages, lambda s, d, f: p02.defects(d)),
    "p2_repaired": (pages, lambda s, d, f: p02.repaired(d)),
    "p3_kinds": (pages, lambda s, d, f: p03.kinds(d, f("common_words"), ["doc_id", "pdf_page"])),
    "p4_restore": (pages, lambda s, d, f: p04.restore(d, p04.train(d), ["doc_id", "pdf_page"])),
    "p5_lines": (pages, lambda s, d, f: p05.page_lines(d)),
    "p5_clean": (pages, lambda s, d, f: p05.without_repeated(d)),
    "p5_documents": (documents, lambda s, d, f: p05.clean_documents(d)),
    "p5_sources": (documents, lambda s, d, f: p05.document_lines(d)),
    "p8_pack": (documents, lambda s, d, f: p08.fill(p08.pack(d, s.createDataFrame([("a", 8), ("b", None), (None, 9)], "spec_name string, capacity_tokens int"), counter=count_words))),
    "p9_mix": (documents, lambda s, d, f: p09.shares(p09.mix(d, t := s.createDataFrame([("s", 0.5, 2), (None, 0.2, 1), ("none", 0.3, None)], "source string, target_share double, max_repeats int"), counter=count_words), t)),
    "p10_pairs": (documents, lambda s, d, f: p10.sharing_pairs(d)),
    "p10_shared": (documents, lambda s, d, f: p10.shared_portions(d)),
}
ROWS = {
    pages: [(None, None, None, None, None), ("d", 1, "ocr-x", None, None), ("d", None, "ocr-x", "", "1"), (None, 2, "pdfium", " \n ", None), ("d", 3, "ocr-x", ENGLISH, "x"), ("d", 3, "ocr-x", ENGLISH, "x"), ("d", 4, "ocr-x", ENGLISH * 400, None), ("d", 5, "ocr-x", "x" * 50_000, None)],
    passages: [(None, None, None, None), ("a", None, None, "en"), ("b", "", "", None), (None, "x", "x", "x"), ("c", ENGLISH, ENGLISH, ""), ("c", ENGLISH, ENGLISH, ""), ("e", "...", "123", "?"), ("f", ENGLISH * 300, ENGLISH * 300, "en")],
    documents: [(None, None, None), (1, None, "s"), (2, "", None), (None, "x", "s"), (3, ENGLISH * 2, "s"), (3, ENGLISH * 2, "s"), (4, ENGLISH * 300, "s"), (5, ENGLISH * 2, None)],
}


@pytest.mark.parametrize("empty", [True, False])
@pytest.mark.parametrize("name", sorted(EDGES))
def test_edges(spark, request, name, empty):
    """Empty tables; nulls in any column, empty and long texts, ties, repeated rows, columns of clashing names."""
    make, run = EDGES[name]
    got = run(spark, make(spark, [] if empty else ROWS[make]), request.getfixturevalue).collect()
    assert not got if empty and name != "p9_mix" else isinstance(got, list)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_both_engines_agree(spark, name):
    got, want = queries.queries()[name](spark, DATA).toPandas(), engine().sql(oracles.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_pairs_of_sliced_groups(spark, monkeypatch):
    monkeypatch.setattr("folioscope.llm.common.GROUP_SLICE", 3)
    df = spark.createDataFrame([("g", i, i % 2) for i in range(11)] + [("h", 1, 1), (None, 5, 1)], "g string, i int, k int")
    assert {tuple(r) for r in pairs_in_groups(df, "g", "i").collect()} == {(a, b) for a in range(11) for b in range(a + 1, 11)}
    assert {tuple(r) for r in pairs_in_groups(df, "g", "i", "k").collect()} == {(a, b) for a in range(11) for b in range(a + 1, 11) if (a - b) % 2}


def test_bloom_filter_loses_nothing(spark, monkeypatch):
    numbers = spark.range(0, 3000, 3).withColumnRenamed("id", "n")
    for most in (1 << 27, 1 << 12):
        monkeypatch.setattr(Bloom, "MOST", most)
        held = Bloom(numbers, "n")
        passed = {r["id"] for r in spark.range(3000).where(held.may_have(F.col("id"))).collect()}
        assert set(range(0, 3000, 3)) <= passed and (most < 1 << 20 or len(passed) < 1100)
    assert not spark.range(9).where(Bloom(numbers.where("n < 0"), "n").may_have(F.col("id"))).collect()


def test_format_duplicates(spark):
    texts = {
        "k": "Site: fort B; Period: 12", "l": "PERIOD: 12; site of a label that is longer than forty characters as it may well be: x", "m": "Site of a label that is longer than forty characters as it may well be: X; period: 12", "n": "period: 12; SITE: Fort B",
        "a": "The old well, of Fayba.", "b": "THE OLD WELL of fayba", "c": "the old well of faybb", "d": "of Fayba the old well",
        "e": "Site: fort A; Period: 12; Material: stone", "f": "material : STONE / site: Fort A / period:12.", "g": "Site: stone; Period: 12; Material: fort A", "h": "Site: fort A, Period: 12, Material: stone", "i": "straße", "j": "STRASSE",
    }
    df = passages(spark, [(k, v, "", None) for k, v in texts.items()])
    got = {tuple(r) for r in p01.duplicate_pairs(df, "pid", "text_search").collect()}
    assert got == {("a", "b"), ("e", "f"), ("e", "h"), ("f", "h"), ("i", "j"), ("k", "n"), ("l", "m")}
    records = {r["record_id"]: (r["copies"], r["spellings"]) for r in p01.collapse(df.union(df), "pid", "text_search").collect()}
    assert records == {"a": (2, 2), "c": (1, 1), "d": (1, 1), "e": (3, 3), "g": (1, 1), "i": (2, 2), "k": (2, 2), "l": (2, 2)}


def test_scan_noise(spark):
    prose = ["the old harbour store was rebuilt by the fishermen of the coast before the", "harvest and the walls of the quarter were measured by the survey team. The", "market inspector kept the well-kept gate of the quarter for many years."]
    data = [("d", i, "pdfium", "\n".join(["Register of the old forts", *prose, str(i)]), None) for i in range(1, 40)]
    scan = ["Register of the old f0rts", "the old harbour store was rebuilt by the fisher-", "men of the coast and the well-", "kept gate frorn the quarfer. The market in¬", "spector kept the walls.", "— 41 —"]
    arabic = "يقع الحصن ee القديم على مرتفع يطل على الوادي (The walls of the)"
    data += [("d", 41, "ocr-x", "\n".join(scan), None), ("d", 42, "ocr-x", "\n".join([*prose, arabic, "[42]"]), None), ("d", 43, "ocr-x", "c x 1 q b ن " * 30, None)]
    words = " ".join(["fishermen from quarter"] * 30)
    data += [("w", i, "pdfium", words, None) for i in range(3)]
    data += [("o", i, "ocr-x", f"{ENGLISH} quarfer, mosfly, aboufs", None) for i in range(1)]
    df = pages(spark, data)
    got = {(r["pdf_page"], r["line_no"], r["defect"]) for r in p02.defects(df).where("doc_id = 'd'").collect()}
    assert {(41, 1, "running_line"), (41, 6, "page_number"), (42, 5, "page_number"), (41, 2, "hyphen_break"), (41, 4, "hyphen_break"), (41, 4, "misread"), (42, 4, "misread")} <= got
    assert (41, 3, "hyphen_break") not in got and not [x for x in got if x[0] == 43]
    clean = {r["pdf_page"]: r["clean_text"] for r in p02.repaired(df).where("doc_id = 'd'").collect()}
    assert "fishermen of the coast and the well-kept gate from" in clean[41].replace("well- kept", "well-kept") and "inspector" in clean[41] and "41" not in clean[41] and " ee " not in clean[42]


def test_running_lines_below_the_edge(spark):
    notice, title = "The plates of this book may not be copied", "The register of the old forts and of the wells of the coast as the survey team had measured them before the harvest"
    filler = lambda p, n: [f"{w} stood by the {w} wall of Fayba" for w in ("".join(random.Random(f"{p}-{i}").choices("abcdefgh", k=9)) for i in range(n))]
    data = []
    for page, above in enumerate([3, 3, 9, 9, 9], 1):  # two at the fourth line, three in the middle
        data.append(("n", page, "ocr-x", "\n".join([*filler(page, above), notice, *filler(page + 50, 12)]), None))
        data.append(("t", page, "ocr-x", "\n".join([title, *filler(page + 100, 12)]), None))
    got = {(r["doc_id"], r["pdf_page"], r["line_no"]) for r in p02.defects(pages(spark, data)).where("defect = 'running_line'").collect()}
    assert 72 < len(title) <= 120
    assert got == {("n", 1, 4), ("n", 2, 4), ("n", 3, 10), ("n", 4, 10), ("n", 5, 10), *(("t", p, 1) for p in range(1, 6))}


def test_titles_of_few_pages_in_a_large_book(spark):
    """A chapter's title on 5 of 800 pages, a line of 150 characters, misread ones, and a page number of five digits."""
    title, notice = "The wells and cisterns of the lower quarter", "This plate and all others of the register were made by the field unit of the survey and may not be copied or lent to others without leave of the unit"
    def filler(p):
        words = random.Random(p).choices("abcdefgh", k=60)
        return [f"{''.join(words[i : i + 9])} stood by the wall of {''.join(words[i + 2 : i + 8])}" for i in range(0, 48, 6)]

    data = [("b", p, "ocr-x", "\n".join([*([title] if 300 <= p < 305 else ["The wells and cistems of the lower quarter"] if p == 305 else [notice] if p < 5 else [notice.replace("plate", "p1ate")] if p == 5 else []), *filler(p)]), None) for p in range(1, 801)]
    data += [("n", p, "ocr-x", "\n".join([*filler(p), str(p)]), None) for p in range(12_340, 12_346)]
    got = {(r["doc_id"], r["pdf_page"], r["line_no"], r["defect"]) for r in p02.defects(pages(spark, data)).where("defect != 'misread'").collect()}
    assert len(notice) > 140
    assert got == {*(("b", p, 1, "running_line") for p in (1, 2, 3, 4, 5, *range(300, 306))), *(("n", p, 9, "page_number") for p in range(12_340, 12_346))}


def test_repaired_pages_are_the_printed_ones(spark):
    """Planted noise on every scanned page goes: the text comes back whole."""
    r = random.Random(8)
    sentences = ["the old harbour store was rebuilt by the fishermen of the coast before the harvest.", "The walls of the quarter were measured by the survey team in the morning.", "The market inspector kept the gate of the quarter for many years.", "Visitors praised the careful weaving of the northern villages."]
    data, want = [("w", i, "pdfium", "\n".join(sentences * 3), None) for i in range(12)], {}
    for page in range(1, 31):
        # A name of its own in every place, so that no two pages have a line in common.
        text = " ".join(f"{''.join(r.choices('KPTZQ', k=2))}{''.join(r.choices('aeiouqxz', k=5))}. {x}" for x in r.choices(sentences, k=6))
        text = " ".join(w if i % 4 else f"{w} {''.join(r.choices('qxzkjw', k=6))}" for i, w in enumerate(text.split()))
        lines, words = [], text.split()
        while words:
            line = words.pop(0)
            while words and len(line) + len(words[0]) < 60:
                line += " " + words.pop(0)
            if words and len(words[0]) > 7 and "." not in words[0]:
                line, words[0] = f"{line} {words[0][:4]}-", words[0][4:]
            lines.append(line)
        data.append(("s", page, "ocr-x", "\n".join(["Register of the old forts and wells", *lines, f"- {page} -"]), None))
        want[page] = text
    got = {x["pdf_page"]: x["clean_text"] for x in p02.repaired(pages(spark, data)).where("doc_id = 's'").collect()}
    assert {k: " ".join(v.split()) for k, v in got.items()} == want


def test_fragments_and_roman():
    assert p02.fragments("a b (The walls of the) ii".split()) == [0, 1, 6]
    assert p02.fragments("ا ee ب".split()) == [1]
    assert [p02.roman(x) for x in ("iv", "XII", "xc")] == [4, 12, 90]


def test_page_kinds(spark, common_words):
    table = "\n".join(["T1234a ; stone ; clay", *[f"Fayba{i} ; {i}82 ; K{i}123" for i in range(9)]])
    listing = "\n".join([f"{i}. R-{i}1234 basket, Fayba" for i in range(1, 10)])
    data = [("d", i, "pdfium", ENGLISH + f" And the {i} of it.", None) for i in range(12)]
    data += [("t", 1, "x", table, None), ("l", 1, "x", listing, None), ("j", 1, "x", "(cid:12)(cid:99) (cid:7)\n" * 9, None), ("j", 2, "x", "f 9 x ن 4 r 2 qq 1 z " * 12, None), ("b", 1, "x", " \n", None), ("m", 1, "x", ARABIC.encode().decode("cp1252", "replace"), None)]
    got = {(r["doc_id"], r["pdf_page"]): r["kind"] for r in p03.kinds(pages(spark, data), common_words, ["doc_id", "pdf_page"]).collect()}
    assert [got[k] for k in (("d", 3), ("t", 1), ("l", 1), ("j", 1), ("j", 2), ("b", 1), ("m", 1))] == ["prose", "table", "list", "junk", "junk", "blank", "prose"]
    for text, want in (("f 9 x ن 4 r 2 qq 1 z " * 12, True), (ENGLISH, False), (listing, False)):
        assert p02.junk(text) is want


@pytest.mark.parametrize("mark", [",", "|", ";", "،"])
def test_compact_tables_are_no_junk(spark, common_words, mark):
    table = "\n".join([mark.join(["T4761a", "marble", "glazed-tile", "wood-carving", "acacia-beams"]), *[mark.join(["Dumifala", f"{i}9040", f"M{i}70279", "9200.5", "T85944"]) for i in range(18)]])
    endless = "ebdf90bb3886064cc43ecfb6aca45c3d30361bf5e51a2f37207\n" * 9
    got = {r["doc_id"]: r["kind"] for r in p03.kinds(pages(spark, [("t", 1, "x", table, None), ("j", 1, "x", endless, None)]), common_words, ["doc_id", "pdf_page"]).collect()}
    assert got == {"t": "table", "j": "junk"}
    for text, want in ((table, False), (endless, True)):
        assert p02.junk(text) is want


def test_sketches_merge_to_the_quantiles(spark):
    values = [F.lit(0.0).alias(s) if s == "arabic_ratio" else F.col("id").cast("double").alias(s) for s in p03.STATISTICS]
    stats = spark.range(1000).select(F.when(F.col("id") % 2 == 0, "en").otherwise("fr").alias("lang"), *values)
    q = {r["ref"]: r["q_common_share"] for r in p03.quantiles(p03.sketches(stats.repartition(7))).collect()}
    assert set(q) == {"en", "fr", "other"}
    for got in q.values():
        assert np.allclose(got, [1000 * x for x in p03.QUANTILES], atol=25)


def brute_statistics(text, common):
    lines = [x for x in text.split("\n") if x.strip()]
    words = [w for w in re.findall(r"[^\W_]+", text.lower()) if w]
    tokens = text.split()
    chars = sum(map(len, tokens))
    return {
        "n_lines": len(lines), "n_words": len(words), "mean_word": sum(map(len, words)) / max(1, len(words)), "common_share": sum(w in common for w in words) / max(1, len(words)),
        "short_share": sum(len(t) <= 2 for t in tokens) / max(1, len(tokens)), "digit_ratio": sum(c.isdigit() for c in text) / max(1, chars), "mean_line": sum(map(len, lines)) / max(1, len(lines)),
        "ended_lines": sum(bool(re.search(r"[.!?؟…:؛][\W_]*$", x)) for x in lines) / max(1, len(lines)), "tripled": sum(bool(re.search(r"([^\W\d_])\1\1", t)) for t in tokens) / max(1, len(tokens)),
        "symbol_ratio": sum(not c.isalnum() and not c.isspace() for c in text) / max(1, chars),
    }


def test_statistics_against_brute_force():
    r = random.Random(2)
    texts = ["", "\n", " ", "x", ENGLISH, ARABIC, "aaa bbb. ccc\nThe of 12!\n\n - last (٣٤) …", *["".join(r.choices("ab cC.\n1;ن،é😀|", k=r.randrange(300))) for _ in range(40)]]
    words = {"en": ["the", "of", "a"], "fr": ["b", "a"]}
    got = p03.measure(texts, words)
    for text, row in zip(texts, got.to_dict("records"), strict=True):
        for name, value in brute_statistics(text, {"the", "of", "a", "b"}).items():
            assert row[name] == pytest.approx(value, abs=1e-6), (text, name)


def test_the_sketches_decide_the_kind(spark, common_words):
    """The same page is short words' junk among long words, and prose where every page has as short ones."""
    page = "b c d e f g hh ii the jj kk " * 3 + "longest words of it"
    of = lambda words: [("d", i, "x", f"the {words} of the {words} and the {words} of {i}", None) for i in range(80)]
    tails = lambda data: next(r["tails"] for r in p03.kinds(pages(spark, [*data, ("p", 1, "x", page, None)]), common_words, ["doc_id", "pdf_page"]).where("doc_id = 'p'").collect())
    assert "+short_share" in tails(of("harbours quarters fishermen")) and "+short_share" not in tails(of("b c d e hh kk ii jj") + [("e", i, "x", "the " + "b c d e " * i + "harbours " * (40 - i), None) for i in range(40)])


SENTENCES = ["La nécropole fut bâtie en pierre de corail où l’on enseignait la torréfaction du café.", "يقع الجدار المتهدم على مرتفع يطل على الوادي، ثم صور الصيادون جزءا منه في أواخر الخريف.", "At the gate the café of the old town cost ½ a coin… or so the “façade” claimed."]


@pytest.mark.parametrize("sentence", SENTENCES)
@pytest.mark.parametrize("chain", [["cp1252"], ["latin-1"], ["mac_roman"], ["cp437"], ["cp1252", "cp1252"], ["latin-1", "latin-1"]])
def test_wrong_encodings_come_back(encodings, sentence, chain):
    garbled = sentence
    for wrong in chain:
        of = {b: c for c, b in p04.bytes_of(wrong).items()}
        garbled = "".join(chr(b) if b < 0x80 else of[b] for b in garbled.encode())
    restored, used = p04.repair(f"first line\n{garbled}", encodings)
    assert restored == f"first line\n{sentence}" and used


@pytest.mark.parametrize("sentence", SENTENCES[:2])
@pytest.mark.parametrize("outer", ["cp1252", "latin-1", "mac_roman"])
@pytest.mark.parametrize("inner", ["mac_roman", "cp437", "cp850", "cp1251", "cp1256"])
def test_any_encoding_twice(encodings, sentence, inner, outer):
    garbled = sentence
    for wrong in (inner, outer):
        of = {b: c for c, b in p04.bytes_of(wrong).items()}
        garbled = "".join(chr(b) if b < 0x80 else of[b] for b in garbled.encode())
    assert p04.repair(garbled, encodings)[0] == sentence


def test_single_bytes_within_utf8(encodings):
    of = {b: c for c, b in p04.bytes_of("cp1252").items()}
    garbled = "".join(chr(b) if b < 0x80 else of[b] for b in SENTENCES[1].encode("cp1256"))
    garbled = "".join(chr(b) if b < 0x80 else of[b] for b in garbled.encode())
    restored = p04.repair(garbled, encodings)[0]
    assert sum(a == b for a, b in zip(restored, SENTENCES[1], strict=False)) > 0.97 * len(SENTENCES[1])


def test_one_rare_transition_is_enough():
    lines = ["la rivalité de Fayba"] * 3000 + ["la Ã© de Fayba"] * 100
    model = p04.Model(next(p04.count_pairs([pd.DataFrame({"text": ["\n".join(lines)]})])))
    garbled = "la rivalitÃ© de Fayba"
    assert (model.steps(garbled) <= p04.RARE).sum() == 1
    assert p04.repair(garbled, model)[0] == lines[0]


def test_the_margin_is_that_of_all_held_out_lines(spark):
    lines = [f"il était ce qu'il était en été {i}" for i in range(24_000)] + [f"Ã©tait Ã©tait Ã©tait Ã©tait Ã©tait {i}" for i in range(1200)]
    data = [("d", i, "x", "\n".join(lines[i : i + 600]), None) for i in range(0, len(lines), 600)]
    margins = {p04.train(pages(spark, rows)).margin for rows in (data, data[::-1])}
    assert len(margins) == 1 and margins.pop() > p04.LEAST_MARGIN


def test_single_byte_chains(encodings):
    for right, wrong, sentence in (("cp1256", "cp1252", SENTENCES[1]), ("cp1256", "mac_roman", SENTENCES[1]), ("cp1252", "cp437", SENTENCES[0].replace("’", "'"))):
        of = {b: c for c, b in p04.bytes_of(wrong).items()}
        garbled = "".join(chr(b) if b < 0x80 else of[b] for b in sentence.encode(right))
        restored = p04.repair(garbled, encodings)[0]
        assert sum(a == b for a, b in zip(restored, sentence, strict=False)) > 0.97 * len(sentence)


@pytest.mark.parametrize("text", [*SENTENCES, "Qāṣīshit ḥaṭ – “Rafish façade” near Ḥāfaṭn’s.", "وا�ي براليم � حول", "(Древние колодцы и башни, № 8951)", "™ and † mark casts", "f 9 x ن 4 § ¤ 1 z " * 9, "", "É"])
def test_sound_text_stays(encodings, text):
    assert p04.repair(text, encodings) == (text, [])


def brute_key(line):
    words = re.split(r"\s", line.replace(" ", " "))
    bare = lambda w: "".join(c for c in w if unicodedata.category(c)[0] in "LN")
    number = lambda w: bare(w) and all(unicodedata.category(c)[0] == "N" for c in bare(w))
    words = [w for w in words if bare(w)]
    if words and number(words[0]):
        words = words[1:]
    if words and number(words[-1]):
        words = words[:-1]
    key = "".join(map(bare, words)).lower()
    return key if len(key) >= 15 else None


def test_repeated_lines_against_brute_force(spark):
    r = random.Random(3)
    lines = ["Register of the old forts", "REGISTER of the — old forts 12", "31 Register of the old forts", "[7] Register of the old forts", "short line", "٣ Notes on dyeing in Fayba ٤", "Notes on dyeing in Fayba", "", "3.5 metres of the old long wall", "of the old long wall T-12345"]
    data = [(f"b{i % 3}", i, "x", "\n".join(r.choices(lines, k=5)), None) for i in range(24)]
    df = pages(spark, data + data[:3])
    where: dict = {}
    for doc, page, _, text, _ in data:
        for no, line in enumerate(text.split("\n"), 1):
            if key := brute_key(line):
                where.setdefault((doc, key), {}).setdefault(page, []).append(no)
    want = {(doc, page, no) for (doc, _), at in where.items() if len(at) >= 5 for page, nos in at.items() for no in nos}
    assert {tuple(x)[:3] for x in p05.page_lines(df).select("doc_id", "pdf_page", "line_no").collect()} == want
    cleaned = {(x["doc_id"], x["pdf_page"]): x["clean_text"] for x in p05.without_repeated(df).collect()}
    for doc, page, _, text, _ in data:
        kept = [x for n, x in enumerate(text.split("\n"), 1) if (doc, page, n) not in want]
        assert cleaned[(doc, page)] == "\n".join(kept)


def test_republished_articles_are_no_boilerplate(spark):
    day = lambda i: datetime(2024, 1, 1) + timedelta(days=i)
    data = [(i, "One article with a line of its own", "s", day(i), *[None] * 5) for i in range(9)]
    data += [(100 + i, f"Article number {i} of them\nFrom the desk of the herald", "s", day(i), *[None] * 5) for i in range(6)]
    got = p05.document_lines(spark.createDataFrame(data, DOCUMENTS)).collect()
    assert [(r["line"], r["clusters"], r["dates"]) for r in got] == [("From the desk of the herald", 6, 6)]
    clean = {r["doc_id"]: (r["clean_text"], r["removed_lines"]) for r in p05.clean_documents(spark.createDataFrame(data + data[-2:], DOCUMENTS)).collect()}
    assert clean == {r[0]: (r[1].split("\n")[0], r[1].count("\n")) for r in data}


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Ｆｏｒｔ", "Fort", True), ("fоrt", "fort", True), ("était", "était", True), ("a​b c", "ab c", True), ("a b", "a b", True), ("ﻻمن", "لامن", True), ("ﻻ", "لا", True), ("فی كل", "في كل", True), ("ﬁn", "fin", True), ("وُ", "و", False),
        ("m²", "m2", False), ("½", "1⁄2", False), ("cafe", "café", False), ("على", "علي", False), ("3", "٣", False), ("گفت", "كفت", False), ("naïνe", "naïve", True), ("ö‍", "ö", True), ("Ωmega", "Omega", False),
    ],
)
def test_visual_forms(a, b, same):
    a, b = (x.replace("ﻻ", "ﻻ") for x in (a, b))
    assert (p06.canonical(a) == p06.canonical(b)) is same


@pytest.mark.parametrize("persian", [True, False])
@pytest.mark.parametrize("script", ["latin", "cyrillic", "greek"])
def test_the_table_has_no_conflicts(script, persian):
    assert p06.conflicts(script, persian) == []
    assert p06.canonical(p06.canonical(SENTENCES[0])) == p06.canonical(SENTENCES[0])


def test_look_alike_pairs(spark):
    df = passages(spark, [("a", "", "Fort of the well", None), ("b", "", "Fort  of\tthe well", None), ("c", "", "Fоrt of the well", None), ("d", "", "Fort of the wéll", None)])
    assert {tuple(r) for r in p06.look_alike_pairs(df, "pid", "text_raw").collect()} == {("a", "c"), ("b", "c")}


def test_languages(spark, languages):
    samples = spark.read.parquet(f"{DATA}/lang_samples.parquet").toPandas()
    mixed = samples.sample(frac=1, random_state=4)
    held = mixed[:60]
    few = p07.Model(mixed[60:].text.tolist(), mixed[60:].lang.tolist())
    best = few.probabilities(held.text.tolist())[0].argmax(1)
    assert np.mean([few.languages[j] == x for j, x in zip(best, held.lang, strict=True)]) >= 0.95
    text = {x: " ".join(samples[samples.lang == x].text.head(2)) for x in ("ar", "en", "fr", "de", "fa")}
    data = [("1", "", text["en"], "eng"), ("2", "", text["en"], "fr"), ("3", "", text["fr"] + " " + text["ar"], "fr"), ("4", "", text["fa"], None), ("5", "", text["de"], "German"), ("6", "", text["en"] + " (Selon les voyageurs)", "en-GB"), ("7", "", "", None), ("8", "", "12 34", None)]
    got = sorted(tuple(r) for r in p07.wanting(passages(spark, data), languages, "pid", "text_raw", "lang").collect())
    assert got == [("2", "en"), ("3", "ar"), ("3", "fr"), ("4", "fa")]
    segments = {r["id"]: [(s["lang"]) for s in r["segments"]] for r in p07.identify(passages(spark, data), languages, "pid", "text_raw").collect()}
    assert segments["3"] == ["fr", "ar"] and segments["1"] == ["en"]


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ("AR", "ara", "fr-FR", " English ", "unknown", "?", "", None, "fas", "en_GB")], "l string")
    assert [r[0] for r in df.select(p07.label_language(F.col("l"))).collect()] == ["ar", "ar", "fr", "en", None, None, None, None, "fa", "en"]


@pytest.mark.parametrize("seed", range(6))
def test_containers(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 97, 512])
    sizes = [min(capacity, max(1, int(r.expovariate(3 / capacity)))) for _ in range(400)] + [capacity // 3 + 1] * r.randrange(60)
    histogram = {s: sizes.count(s) for s in set(sizes)}
    slots = p08.plan(histogram, capacity)
    used: dict = {}
    for size in histogram:
        own = sorted(x for x in slots if x[0] == size)
        assert [x[1] for x in own] == [0, *[x[2] for x in own][:-1]] and own[-1][2] == histogram[size]
        for _, start, end, q, first in own:
            for rank in range(start, end):
                used.setdefault(first + (rank - start) // q, []).append(size)
    assert sorted(used) == list(range(len(used))) and all(sum(x) <= capacity for x in used.values())
    assert all(sum(3 * s > capacity for s in x) <= 2 for x in used.values())
    assert len(used) <= 1.25 * sum(sizes) / capacity + 2


def test_packing_cuts_only_what_exceeds(spark):
    data = [(i, "w " * n, "s") for i, n in enumerate([3, 5, 8, 21, 0, 4, 4, 1])]
    specs = spark.createDataFrame([("x", 8)], "spec_name string, capacity_tokens int")
    got = p08.pack(documents(spark, data), specs, counter=count_words).toPandas()
    assert (got.groupby("container").tokens.sum() <= 8).all()
    whole = got.groupby("doc_id").agg(n=("tokens", "sum"), k=("piece", "count"))
    assert whole.n.to_dict() == {0: 3, 1: 5, 2: 8, 3: 21, 5: 4, 6: 4, 7: 1} and whole.k.to_dict()[3] == 3 and (whole.drop(3).k == 1).all()
    assert got[got.doc_id == 3].sort_values("piece").first_token.tolist() == [0, 8, 16]


def test_mixing(spark):
    r = random.Random(1)
    data = [(i, " ".join(f"{i}x{j}" for j in range(r.randrange(5, 60))), "abcd"[min(3, i % 10)]) for i in range(3000)]
    data.append((9999, data[0][1], "b"))
    targets = spark.createDataFrame([("a", 0.5, 4), ("b", 0.3, 3), ("c", 0.2, 2)], "source string, target_share double, max_repeats int")
    mixed = p09.mix(documents(spark, data), targets, counter=count_words)
    got = p09.shares(mixed, targets).toPandas().set_index("source")
    assert (got.actual_share - got.target_share).abs().max() < 0.005 and (got.most_repeats <= got.max_repeats).all()
    keys = [x["shuffle_key"] for x in mixed.collect()]
    assert keys == sorted(keys) and 9999 not in {x["doc_id"] for x in mixed.select("doc_id").collect()}
    assert rows(mixed.toPandas()) == rows(p09.mix(documents(spark, data).repartition(7), targets, counter=count_words).toPandas())


def brute_pairs(texts, least=p10.LEAST):
    windows: dict = {}
    for doc, text in texts:
        for i in range(len(text) - least + 1):
            windows.setdefault(text[i : i + least], set()).add(doc)
    return {(a, b) for docs in windows.values() for a in docs for b in docs if a < b}


@pytest.mark.parametrize("hot", [False, True])
def test_shared_spans_against_brute_force(spark, monkeypatch, hot):
    if hot:  # the narrow keys of hot entries lose nothing either
        monkeypatch.setattr(p10, "HOT", 0)
    r = random.Random(5)
    noise = lambda n: "".join(r.choices("abcdefgh \nبت😀", k=n))
    shared = [noise(n) for n in (199, 200, 201, 260, 500, 1200)]
    texts = []
    for i in range(60):
        parts = [noise(r.randrange(0, 300)), r.choice(shared), noise(r.randrange(0, 40)), r.choice(shared)[r.randrange(0, 60) :], noise(r.randrange(0, 200))]
        texts.append((i, "".join(parts)))
    texts += [(60, shared[5]), (61, shared[5]), (62, "x" * 700), (63, "x" * 300), (64, shared[0])]
    df = documents(spark, [(i, t, "s") for i, t in texts])
    assert {tuple(x) for x in p10.sharing_pairs(df).collect()} == brute_pairs(texts)
    windows: dict = {}
    for doc, text in texts:
        for i in range(len(text) - p10.LEAST + 1):
            windows.setdefault(text[i : i + p10.LEAST], set()).add(doc)
    for x in p10.shared_portions(df).collect():
        text, covered = dict(texts)[x["doc_id"]], np.zeros(x["n_chars"], dtype=bool)
        for i in range(len(text) - p10.LEAST + 1):
            if len(windows[text[i : i + p10.LEAST]]) > 1:
                covered[i : i + p10.LEAST] = True
        assert x["shared_chars"] == covered.sum(), x


def test_hashes_and_windows():
    codes = np.frombuffer("abcabcabcabcabc".encode("utf-32-le"), dtype=np.uint32)
    h = p10.block_hashes(codes, 6)
    assert len(h) == 10 and h[0] == h[3] and h[0] != h[1]
    values = np.random.default_rng(1).integers(0, 50, 300).astype(np.uint64)
    least = set(p10.least_in_windows(values, 9).tolist())
    assert all(any(values[j] == values[i : i + 9].min() and j in least for j in range(i, i + 9)) for i in range(292))


def test_a_filters_bits_reach_the_driver_packed(spark, monkeypatch):
    # Before, the driver got a row for each word of 32 bits: 2.4 GB of Python rows for a full filter.
    monkeypatch.setattr(type(spark.range(1)), "toPandas", lambda df: pytest.fail("a row for each word"))
    numbers = spark.range(0, 60_000, 2).withColumnRenamed("id", "k")
    table = Bloom(numbers, "k")
    assert len(table.table.value) > 2 * Bloom.PACKED
    passed = spark.range(60_000).withColumnRenamed("id", "k").where(table.may_have(F.col("k")))
    assert passed.where("k % 2 = 0").count() == 30_000 and passed.count() < 31_500
    assert spark.range(9).where(Bloom(numbers.limit(0), "k").may_have(F.col("id"))).count() == 0


def test_a_line_asks_for_one_run_in_each_part(spark):
    # Before, a line asked for all its runs of letters: some 50 for each of 60 letters.
    draw = random.Random(7)
    near = []
    for length in [*range(8, 70), 99, 100, 101, 180, 400]:
        key = "".join(draw.choices("abcdef", k=length))
        for kind in range(6):
            line = list(key)
            for at in sorted(draw.sample(range(length), 1 + length // p02.LETTERS_EACH), reverse=True):
                line[at : at + 1] = [["x"], [], [line[at], "x"]][kind % 3]
            near.append(("d", "".join(line), key))
    keys = spark.createDataFrame([x for x in near if len(x[1]) >= p02.LEAST_KEY], "doc_id string, key string, _key string")
    errors = 1 + F.floor(F.length("_key") / p02.LETTERS_EACH).cast("int")
    known = F.flatten(F.array(*[p02.grams(n, F.col("_key")) for n in (F.length("_key") - errors, F.length("_key"), F.length("_key") + errors)]))
    got = keys.select(F.levenshtein("key", "_key") <= errors, F.arrays_overlap(p02.asked_grams(F.col("key")), known), F.size(p02.asked_grams(F.col("key"))) <= 2 + (F.length("key") + 1) / (p02.LETTERS_EACH - 1)).collect()
    assert len(got) > 300 and all(map(all, got))


ODD_TEXTS = [
    "", "\n", "12 Storia_9\n— 7 —\n٣ باب ٤\n_1_ x\n3rd row 4th\n²x 5²\n5́ a\n a 5́ \n\x1c8 y\x1c9", "É 9\nΣΑΣ_ 1\n_9\n9_", "aaa bbb cccc ddddddd", "AAAaaaa bbbbbbb cccccccc", "a b c d e", "x" * 31,
    "…,;: ..!! ab", "al-Bir al‐Bir x-9 a--b well-known. (well-known) re-\nadded a b-c", "日日日本本本 語語語語語語", "\ud800 x\n1 \ud800",
]


@pytest.mark.parametrize("text", ODD_TEXTS)
def test_readers_of_pages_against_their_rules(text):
    lines = [re.sub(p02.EDGE_NUMBER, "", x) for x in text.split("\n")]
    assert p02.keys_of(text) == ["".join(c for c in x if c.isalnum()) for x in "\n".join(lines).lower().split("\n")]
    tokens = text.split()
    n, chars, marks = len(tokens), sum(map(len, tokens)), sum(c.isascii() and c.isprintable() and not c.isalnum() and c != " " for c in text)
    cells = p02.CELL.findall(text)
    endless = chars > 30 * n and (not cells or len("".join(cells)) > 30 * len(cells))
    junk = n > 0 and (endless or sum(len(t) <= 2 for t in tokens) > 0.6 * n or marks > 0.35 * chars or (chars > 5 * n and len(p02.TRIPLED.findall(text)) > 0.3 * n))
    assert p02.junk(text) is junk
    frame = pd.DataFrame({"ocr": [True, False, True], "text": [text] * 3})
    counted = {w: (a, b) for part in p02.count_words(iter([frame])) for w, a, b in part.itertuples(index=False)}
    plain = p02.unbroken(p02.composed(text.lower()))
    words = p02.WORD.findall(plain) + p02.COMPOUND.findall(plain)
    assert counted == {w: (words.count(w), 2 * words.count(w)) for w in words if not w.isdigit()}


def test_what_comes_again_is_taken_apart_once(monkeypatch):
    # Before, every page was searched for words, and again for compounds.
    class Counted:
        def __init__(self, pattern):
            self.pattern, self.letters = pattern, 0

        def findall(self, text):
            self.letters += len(text)
            return self.pattern.findall(text)

    monkeypatch.setattr(p02, "WORD", Counted(p02.WORD))
    frame = pd.DataFrame({"ocr": [True] * 500, "text": ["A well, by the well-known road."] * 500})
    part = next(p02.count_words(iter([frame])))
    assert dict(zip(part["word"], part["n_ocr"], strict=True)) == {"a": 500, "well": 1000, "by": 500, "the": 500, "known": 500, "road": 500, "well-known": 500}
    assert p02.WORD.letters < 31


def odd_pages():
    draw = random.Random(5)
    pieces = ["a", "Zb", "aaa", "ككك", "日日日", "é", "Σ", "İ", "Ω", "e\u0301", "-", "‐\n", "-\n", "¬ \n", "\xad", "\n", "\n", " ", " ", "\t", "\x0b", "\x1c", "\xa0", "\u2009", "\r\n", "1", "42", "٣", "²", "½", "_", ";", "—", "iv", "𝒳𝒳𝒳", "x" * 31, "al-", "frorn", "\x00"]
    texts = [x for x in ODD_TEXTS if "\ud800" not in x] + ["".join(draw.choices(draw.sample(pieces, draw.choice([2, 5, len(pieces)])), k=draw.randrange(60))) for _ in range(600)]
    return texts + [f"{ENGLISH}\n{i}" for i in range(300)]


def test_pages_of_a_batch_are_told_from_junk_together(monkeypatch):
    # Before, each page was taken apart by itself, in two readers.
    texts = odd_pages()
    want, calls = [p02.junk(x) for x in texts], []
    monkeypatch.setattr(p02, "junk", lambda text, rule=p02.junk: calls.append(text) or rule(text))
    assert p02.junk_pages(pa.array(texts)).tolist() == want and 50 < sum(want) < len(calls) < len(texts) - 300


def test_pages_of_a_batch_are_read_together(monkeypatch):
    # Before, keys and words were taken from each page by itself.
    texts = odd_pages()
    batch = pa.RecordBatch.from_pydict({"doc_id": [f"d{i % 3}" for i in range(len(texts))], "pdf_page": pa.array(range(len(texts)), pa.int32()), "ocr": [i % 2 == 0 for i in range(len(texts))], "text": texts})
    calls = []
    monkeypatch.setattr(p02, "keys_of", lambda text, rule=p02.keys_of: calls.append(text) or rule(text))
    monkeypatch.setattr(p02, "PAGES_TOGETHER", 400)
    read = {x["pdf_page"]: x for part in p02.read_lines(iter([batch])) for x in part.to_pylist()}
    assert len(calls) == -(-len(texts) // 400) and sorted(read) == [i for i, x in enumerate(texts) if not p02.junk(x)]
    for i, row in read.items():
        lines = [(no, x) for no, x in enumerate(p02.composed(texts[i]).split("\n"), 1) if x and not x.isspace()]
        numbers = [no for k, (no, x) in enumerate(lines) if row["ocr"] and min(k, len(lines) - 1 - k) < 2 and p02.NUMBER.match(x)]
        keys = [(no, min(k, len(lines) - 1 - k), p02.keys_of(x)[0]) for k, (no, x) in enumerate(lines) if no not in numbers and len(p02.keys_of(x)[0]) >= p02.LEAST_KEY]
        cuts = [(no, " ".join(m[1].lower() for _, y in lines[k + 1 : k + 4] if (m := p02.BEGIN.match(y)))) for k, (no, x) in enumerate(lines) if row["ocr"] and no not in numbers and p02.END.search(x)]
        assert [x["line_no"] for x in row["numbers"]] == numbers and list(zip(row["nos"], row["edges"], strict=True)) == [x[:2] for x in keys]
        assert row["ids"] == [xxhash.xxh3_64_intdigest(f"{row['doc_id']}\x00{key}") - (1 << 63) for *_, key in keys]
        assert [(x["line_no"], x["key"]) for x in row["near"]] == [(no, key) for no, edge, key in keys if edge < 2] and [(x["line_no"], x["heads"]) for x in row["hyphens"]] == cuts
    for known in (None, frozenset(["frorn", "zb", "σ"])):
        got = [(x["pdf_page"], x["line_no"], x["word"]) for part in p02.misread_reader(known)(iter([batch])) for x in part.to_pylist() if x["word"] is not None]
        want = {(i, no, w) for i in read for no, x in enumerate(p02.unbroken(p02.composed(texts[i].lower())).split("\n"), 1) for w in p02.WORD.findall(x) if known is None or w in known}
        assert len(got) == len(set(got)) and set(got) == want and want


def test_words_with_numerals_are_tried_where_they_may_be_explained(spark, monkeypatch):
    # Before, every code of letters and numerals was written out once per character.
    rows = [("quarter", 50, 5), ("modern", 50, 5), *[(f"quar{x}er", 0, 1) for x in "f5"], *[(f"show{x}", 50, 0) for x in "st"], *[(f"sh0w{x}", 0, 1) for x in "st"], ("h0use", 0, 1), ("house", 50, 0), ("modem", 0, 1), *[(f"k9{i}71f", 0, 1) for i in range(300)]]
    tried = []
    monkeypatch.setattr(p02, "with_gap", lambda words, keep, rule=p02.with_gap: tried.append(words) or rule(words, keep))
    got = {(r["word"], r["printed"]) for r in p02.misread_words(spark.createDataFrame(rows, "word string, n_clean long, n_ocr long")).collect()}
    assert got == {("sh0ws", "shows"), ("sh0wt", "showt"), ("h0use", "house"), ("modem", "modern")}
    assert sum(x.count() for x in tried) < 20


def test_unclean_lines_are_those_of_the_rules():
    draw = random.Random(3)
    chars = "aZb  éÉāṣḥ–’“†№дЖПبتΩ\u0091�▓½ª·ÂÃ" + "".join(c for e in ("cp1256", "cp1251") for c in p04.bytes_of(e))
    lines = ["".join(draw.choices(chars, k=draw.randrange(12))) for _ in range(4000)] + ["".join(draw.choices("abcZ éāṣ’", k=9)) for _ in range(2000)]
    want = [bool(p04.unclean().search(x)) for x in lines]
    assert [p04.is_unclean(x) for x in lines] == want and 500 < sum(want) < 5500


def test_transitions_are_counted_alike(monkeypatch):
    texts = pd.DataFrame({"text": [*SENTENCES, "x 𝒳𝒴 y", "aa\naa\n\né", ""]})
    want = {}
    for x in (x for t in texts["text"] for x in p04.clean_lines(t) if not p04.held_out(x)):
        codes = [min(ord(c), 0xFFFF) for c in f" {x} "]
        for pair in zip(codes, codes[1:], strict=False):
            want[pair] = want.get(pair, 0) + 1
    for most, lines in ((p04.COUNTED, p04.LINES_TOGETHER), (2, 2), (p04.COUNTED, 1)):
        monkeypatch.setattr(p04, "COUNTED", most)
        monkeypatch.setattr(p04, "LINES_TOGETHER", lines)
        assert {(a, b): n for a, b, n in next(p04.count_pairs(iter([texts]))).itertuples(index=False)} == want


def test_words_of_many_pages_are_tried_together(encodings, monkeypatch):
    # Before, every suspicious line was tried by itself with all chains.
    of = {b: c for c, b in p04.bytes_of("cp1252").items()}
    shown = lambda text: "".join(chr(b) if b < 0x80 else of[b] for b in text.encode())
    texts = [f"{shown(SENTENCES[0])} {i}\n{SENTENCES[0]} №½{i}" for i in range(40)] + ["", "ab", SENTENCES[1], "f 9 x ن 4 § ¤ 1 z " * 9]
    monkeypatch.setattr(encodings, "repairs", {})
    want = [p04.repair(t, encodings) for t in texts]
    calls = []
    tried = p04.changed_words
    monkeypatch.setattr(p04, "changed_words", lambda words, model: calls.append(len(words)) or tried(words, model))
    for name in ("repairs", "shown", "changed"):
        monkeypatch.setattr(encodings, name, {})
    assert list(p04.repair_all(texts, encodings)) == want and want[0][1]
    assert calls[0] > 40 and p04.views(["№½0"], encodings.changed, pytest.fail, encodings)
    monkeypatch.setattr(p04, "WORDS_HELD", 3)
    for name in ("repairs", "shown", "changed"):
        monkeypatch.setattr(encodings, name, {})
    assert list(p04.repair_all(texts, encodings)) == want and len(encodings.changed) <= 3



def test_candidates_of_many_lines_are_tried_together(encodings, monkeypatch):
    # Before, the second chains of each line were tried by themselves.
    of = {b: c for c, b in p04.bytes_of("cp1252").items()}
    shown = lambda text: "".join(chr(b) if b < 0x80 else of[b] for b in text.encode())
    texts = [shown(f"é{i}ā la nécropole où l’on {i} vît") for i in range(60)] + [shown(shown(f"l’été{i} où “{i}” fut bâti")) for i in range(60)]
    for name in ("repairs", "shown", "changed"):
        monkeypatch.setattr(encodings, name, {})
    want = [p04.repair(t, encodings) for t in texts]
    calls = []
    for of_words in ("shown_words", "changed_words"):
        monkeypatch.setattr(p04, of_words, lambda words, model, tried=getattr(p04, of_words): calls.append(len(words)) or tried(words, model))
    for name in ("repairs", "shown", "changed"):
        monkeypatch.setattr(encodings, name, {})
    assert list(p04.repair_all(texts, encodings)) == want and [t for t, _ in want[60:]] == [f"l’été{i} où “{i}” fut bâti" for i in range(60)]
    assert len(calls) < 40


def test_chains_of_long_words_in_parts(encodings, monkeypatch):
    words = ["nÃ©cropole", "oÃ¹", "يقع", "№½0", "Î©", "a\u2009b"]
    want = p04.changed_words(words, encodings)
    monkeypatch.setattr(p04, "TOGETHER", 1)
    assert p04.changed_words(words, encodings) == want
    chains, become = p04.byte_chains()
    score = lambda word: encodings.steps(f" {word} ").sum(dtype="float64")
    for word, (gains, counts, gaining, most, _) in zip(words, want, strict=True):
        texts = ["".join(become.get(c, (c,) * len(chains))[k] for c in word) for k in range(len(chains))]
        assert gains == pytest.approx([score(x) - score(word) for x in texts], abs=1e-5)
        assert counts == [sum(a != b for a, b in zip(word, x, strict=True)) for x in texts]
        assert gaining == tuple(k for k, x in enumerate(gains) if x > 0) and most == max(0, *gains)


def test_strict_order_of_chains_decides(encodings):
    # Single bytes after UTF-8 make the same of this line as UTF-8 after single bytes: what the first way doesn't pass isn't accepted by the second.
    line = "taken as a sign of ѕteаdу contact wіth the coast. In Zahoqa, Віrаhіуа still keeps thе craft of"
    assert p04.repair(line, encodings) == (line, [])


def test_unclean_lines_of_whole_texts():
    draw = random.Random(4)
    chars = "aZb  éÉāṣḥ–’“†№дЖПبتΩ\u0091�▓½ª·ÂÃ" + "".join(c for e in ("cp1256", "cp1251") for c in p04.bytes_of(e)) + "𝒳\r\u2028"
    lines = ["".join(draw.choices(chars, k=draw.randrange(9))) for _ in range(5000)]
    want = [bool(p04.unclean().search(x)) for x in lines]
    assert p04.are_unclean("\n".join(lines)).tolist() == want and 500 < sum(want) < 4500
    assert p04.clean_lines("\n".join(lines)) == [x for x, bad in zip(lines, want, strict=True) if not bad and len(x) > 1]
    assert p04.are_unclean("").tolist() == [False] and p04.are_unclean("a\n\n").tolist() == [False] * 3
