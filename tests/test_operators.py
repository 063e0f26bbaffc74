from __future__ import annotations

import sqlite3

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import chunk, gates, index, ingest, ledger, retrieve, selection, tables, vectors


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'int'}" for k, v in columns.items()))


def value(spark, column, **columns):
    return one(spark, **columns).select(column.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("األبعاد", "الابعاد"),
        ("الأبعاد", "الابعاد"),
        ("أحمد إلى آخر", "احمد الي اخر"),
        ("مَدْرَسَة", "مدرسه"),
        ("Page ٣٤ ABC", "page 34 abc"),
        ("a�b  c", "ab c"),
        ("x\ny", "xy"),
        ("", ""),
    ],
)
def test_normalize_search(spark, raw, want):
    assert value(spark, T.normalize_search(F.col("t")), t=raw) == want


def test_normalize_lines_keeps_words_apart(spark):
    assert value(spark, T.normalize_lines(F.col("t")), t="x\ny") == "x y"


def test_stop_words_and_hint(spark):
    assert value(spark, T.strip_stopwords(F.col("t")), t="what is the fort from في البرج") == "fort البرج"
    assert value(spark, T.language_hint(F.col("t")), t="the English reference") == "en"
    assert value(spark, T.language_hint(F.col("t")), t="coffee") is None


@pytest.mark.parametrize(("text", "want"), [("مرحبا", 1.0), ("hello", 0.0), ("", 0.0), ("abc مرح", 0.5)])
def test_arabic_ratio(spark, text, want):
    assert value(spark, T.arabic_ratio(F.col("t")), t=text) == want


def test_hash_depends_on_derivation(spark):
    a, b = (value(spark, T.content_hash(F.lit(d), F.col("t")), t="same") for d in ("ocr", "extracted"))
    assert a != b and len(a) == 32


@pytest.mark.parametrize(
    ("text", "want"),
    [(None, "blank_or_no_text"), ("  \n ", "blank_or_no_text"), ("x" * 49, "too_short"), ("x" * 50, ""), (" " * 60, "blank_or_no_text"), ("x" * 98 + "��", ""), ("x" * 97 + "���", "high_replacement_ratio")],
)
def test_page_gate(spark, text, want):
    assert value(spark, gates.page_gate(F.col("t"))[1], t=text) == want


def test_reviewed_pages_pass(spark):
    assert value(spark, F.concat_ws("|", *gates.page_gate(F.col("t"), F.lit(True))), t="") == "approved|reviewed_transcription"


@pytest.mark.parametrize(
    ("text", "words", "conf", "error", "want"),
    [("x" * 60, 9, 80.0, "", ""), ("x" * 60, 9, 59.9, "", "ocr_low_confidence"), ("x" * 60, 4, 80.0, "", "ocr_too_few_words"), ("x", 9, 80.0, "", "ocr_too_short"), ("", 9, 80.0, "", "ocr_blank_or_no_text"), ("", 0, 0.0, "render_failed: x", "render_failed")],
)
def test_ocr_gate(spark, text, words, conf, error, want):
    column = gates.ocr_gate(F.col("t"), F.col("w"), F.col("c"), F.col("e"))[1]
    assert value(spark, column, t=text, w=words, c=conf, e=error) == want


@pytest.mark.parametrize(
    ("s", "o", "e", "want"),
    [("approved", "", None, "approved||true"), ("excluded", "ocr_low_confidence", None, "excluded|ocr_low_confidence|true"), ("excluded", "timeout", "timeout: 9", "excluded|ocr_too_short|false")],
)
def test_resolve(spark, s, o, e, want):
    column = F.concat_ws("|", *[c.cast("string") for c in gates.resolve(F.lit("excluded"), F.lit("too_short"), F.col("s"), F.col("o"), F.col("e"))])
    assert value(spark, column, s=s, o=o, e=e) == want


@pytest.mark.parametrize(("a", "b", "prefer", "want"), [("نص عربي", "x", False, "a"), ("abc", "x", False, "b"), ("abc", "", False, "a"), ("", "x", False, "b"), ("نص", "x", True, "b"), ("نص", "", True, "a")])
def test_engine_choice(spark, a, b, prefer, want):
    assert value(spark, gates.choose_engine(F.col("a"), F.col("b"), F.lit(prefer)), a=a, b=b) == want


def test_chunks(spark):
    df = spark.createDataFrame([(1, "word " * 2000), (2, " \n "), (3, "one line\nand another"), (4, None), (5, "x" * 9000)], "id int, t string")
    out = chunk.chunk_rows(df, ["id"], "t").collect()
    by = {i: sorted((r["ordinal"], r["tokens"], r["text"]) for r in out if r["id"] == i) for i in range(1, 6)}
    assert len(by[1]) > 1 and all(t <= 600 for _, t, _ in by[1]) and [o for o, _, _ in by[1]] == list(range(len(by[1])))
    assert " ".join(x for *_, x in by[1]).split() == ["word"] * 2000
    assert by[2] == by[4] == [] and by[3] == [(0, 5, "one line and another")]
    assert len(by[5]) == 1 and by[5][0][1] == 2250  # one word above the cap passes whole


def test_chunk_closes_after_a_sentence(spark):
    df = spark.createDataFrame([(1, "aaaa " * 5 + "end.\nnext line")], "id int, t string")
    assert [r["text"] for r in chunk.chunk_rows(df, ["id"], "t", 12).orderBy("ordinal").collect()] == ["aaaa aaaa aaaa aaaa aaaa end.", "next line"]


DOCS = ["the old well of the fort", "fort and well and fort", "qasr al hukm in the old town", "hukm al qasr", "", "well well well"]


def test_bm25_agrees_with_fts5(spark, tmp_path):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table d using fts5(id unindexed, t, tokenize = 'unicode61 remove_diacritics 1')")
    db.executemany("insert into d values (?, ?)", list(enumerate(DOCS)))
    want = {(q, int(i)): round(s, 6) for q, m in ((1, '"fort" OR "well"'), (2, '"al-hukm"'), (3, '"old" OR "old"')) for i, s in db.execute("select id, bm25(d) from d where d match ?", (m,))}
    passages = spark.createDataFrame(list(enumerate(DOCS)), "pid int, t string")
    queries = spark.createDataFrame([(1, "fort well"), (2, "al-hukm"), (3, "old old"), (4, "?")], "qid int, q string")
    stored = index.Index.build(passages, "pid", "t", str(tmp_path / "a"))
    got = {(r["qid"], r["pid"]): round(r["score"], 6) for r in index.bm25(stored, queries, "qid", "q").collect()}
    assert got == pytest.approx(want)
    # An import's update gives the index that building anew gives.
    new = spark.createDataFrame([(1, "qasr fort"), (9, "al hukm al")], "pid int, t string")
    updated = stored.updated(new, "pid", "t", spark.createDataFrame([(3,)], "pid int"), str(tmp_path / "b"))
    fresh = index.Index.build(spark.createDataFrame([(i, t) for i, t in enumerate(DOCS) if i not in (1, 3)], "pid int, t string").union(new), "pid", "t", str(tmp_path / "c"))
    for part in ("postings", "lengths"):
        assert sorted(map(tuple, getattr(updated, part).collect())) == sorted(map(tuple, getattr(fresh, part).collect()))


def test_a_query_reads_only_its_buckets(spark, tmp_path):
    words = [f"word{i}" for i in range(200)]
    stored = index.Index.build(spark.createDataFrame([(i, " ".join(words[i : i + 9])) for i in range(190)], "pid int, t string"), "pid", "t", str(tmp_path / "i"))
    hits = stored.hits(spark.createDataFrame([("word7 word8",), ("word8 word7",), ("word5",), ("none",)], "phrase string"))
    assert {(r["phrase"], r["pid"], r["tf"]) for r in hits.collect()} == {("word7 word8", i, 1) for i in range(0, 8)} | {("word5", i, 1) for i in range(6)}


def test_pools_without_a_row_for_each_passage_a_query_meets(spark, tmp_path, monkeypatch):
    # Small blocks, so that passages and queries are in several; ties are cut by pid, and pids aren't in the order of their blocks.
    for name, n in (("BLOCK", 30), ("SPAN", 2), ("ASKED", 3), ("IN_FILE", 2)):
        monkeypatch.setattr(index, name, n)
    texts = [(f"p{i * 7 % 200:03d}", " ".join(["old"] * (i % 3) + ["fort-well" if i % 5 else "fort"] + [f"w{i % 4}"] * (1 + i % 2)) if i % 11 else None) for i in range(200)]
    stored = index.Index.build(spark.createDataFrame(texts, "pid string, t string"), "pid", "t", str(tmp_path / "p"))
    queries = spark.createDataFrame([(1, "fort"), (2, "old old w1"), (3, "fort-well w2"), (4, "old old w1"), (5, "none"), (6, None), (7, "well-fort"), (8, "w3 fort-well w3")], "qid int, q string")
    made = index.pool(stored, queries, "qid", "q", 10)
    want = index.ranked(index.bm25(stored, queries, "qid", "q"), 10)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, want.collect()))
    assert made.count() == 10 * 5
    # A pool that is read twice is the same to both readers.
    assert made.groupBy("qid").count().join(made, "qid").count() == made.count()


def test_an_index_of_nothing(spark, tmp_path):
    stored = index.Index.build(spark.createDataFrame([], "pid long, t string"), "pid", "t", str(tmp_path / "n"))
    queries = spark.createDataFrame([(1, "fort old-well")], "qid int, q string")
    assert index.pool(stored, queries, "qid", "q").count() == stored.hits(spark.createDataFrame([("fort",), ("old well",)], "phrase string")).count() == 0


def test_a_frequent_term_has_one_row_per_block(spark, tmp_path):
    stored = index.Index.build(spark.createDataFrame([(i, "fort fort well") for i in range(100)], "pid int, t string"), "pid", "t", str(tmp_path / "f"))
    assert sorted((r["term"], len(r["docs"]), len(r["places"])) for r in stored.postings.collect()) == [("fort", 100, 200), ("well", 100, 100)]


def test_phrases(spark):
    assert value(spark, F.concat_ws("|", index.phrases(F.col("q"))), q='"a"  b"c x') == 'a|b"c|x'
    assert value(spark, F.size(index.phrases(F.col("q"))), q=" ".join("abcdefgh" * 5)) == 32
    # Terms of more than 64 characters are dropped, not cut; inner quotes count twice; the cap of 32 comes after that.
    long = " ".join(["x" * 65] * 40 + ["y" * 64, 'z"' + "z" * 61, 'z"' + "z" * 62, "end"])
    assert value(spark, F.concat_ws("|", index.phrases(F.col("q"))), q=long) == "|".join(["y" * 64, 'z"' + "z" * 61, "end"])
    assert value(spark, F.concat_ws("|", index.phrases(F.col("q"))), q="a\u00a0b\u2003c\x1fd \"\" e") == "a|b|c|d|e"


def test_white_space_is_that_of_unicode(spark):
    spaces = "".join(chr(n) for n in range(0x110000) if not 0xD800 <= n < 0xE000 and chr(n).isspace())
    assert len(spaces) == 29
    assert value(spark, T.token_estimate(F.col("t")), t="".join("word" + c for c in spaces)) == 29
    assert value(spark, gates.page_gate(F.col("t"))[1], t=spaces * 9) == "blank_or_no_text"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("G. Mursi and M. Kamal", "G. Mursi and M. Kamal"),
        ("نص a عربي", "نص  عربي"),
        ("نص ee عربي", "نص  عربي"),
        ("نص pee ge عربي", "نص   عربي"),
        ("Ayn Zubaydah", "Ayn Zubaydah"),
        ("a word of", "a word of"),
        ("a\u00a0word", "a\u00a0word"),
        ("ab 12 cd", " 12 "),
        ("", ""),
    ],
)
def test_fragments_are_cleaned(spark, text, want):
    assert value(spark, T.clean_fragments(F.col("t")), t=text) == want


def test_printed_labels(spark):
    label = lambda t, r=None: value(spark, T.printed_label(F.col("t"), r"Sector\s*(\d{1,3})", 1, 92, F.col("r")), t=t, r=r)
    assert [label("Heritage Sector ٤٢\nx"), label("Sector 93"), label("a\nb\nc\nSector 4"), label("Sector 5", "xi"), label("Sector 5", "")] == ["42", None, None, "xi", "5"]


def test_vectors_and_zero_query(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 0.0]), (4, None)], "pid long, vector array<float>")
    queries = spark.createDataFrame([(9, [3.0, 0.0]), (8, [0.0, 0.0])], "qid long, vector array<float>")
    got = [tuple(r) for r in vectors.top_k(rows, queries, 2, block=2).orderBy("qid", "rank").collect()]
    assert got == [(8, 1, 0.0, 0), (8, 2, 0.0, 1), (9, 1, 1.0, 0), (9, 3, 1.0, 1)]


def test_fusion_ties_and_sides(spark):
    keyword = spark.createDataFrame([(1, 10, -2.0, 0), (1, 11, -2.0, 1)], "qid int, pid int, score double, rank int")
    vector = spark.createDataFrame([(1, 12, 0.9, 0), (1, 11, 0.5, 1)], "qid int, pid int, sim double, rank int")
    got = [(r["pid"], r["rank"]) for r in retrieve.fuse(keyword, vector).orderBy("rank").collect()]
    assert got == [(11, 0), (10, 1), (12, 2)]


def test_cap_and_refill(spark):
    hits = spark.createDataFrame([(1, i, "a" if i < 6 else "b", i) for i in range(8)], "qid int, pid int, doc_id string, rank int")
    order = lambda k: [r["pid"] for r in retrieve.diverse(hits, k).orderBy("place").collect()]
    assert order(5) == [0, 1, 6, 7, 2] and order(8) == [0, 1, 6, 7, 2, 3, 4, 5]


def test_duplicates_fold_after_the_filter(spark):
    hits = spark.createDataFrame([(1, 1, "h", "A p1", 0, "en"), (1, 2, "h", "B p1", 1, "en"), (1, 3, "h", "C p1", 2, "ar"), (1, 4, None, "D p1", 3, "en"), (1, 5, None, "E p1", 4, "en")], "qid int, pid int, content_hash string, label string, rank int, lang string")
    got = {r["pid"]: r["alternates"] for r in retrieve.fold_duplicates(hits.where(retrieve.search_filter(lang="en"))).collect()}
    assert got == {1: ["B p1"], 4: [], 5: []}


def test_filters(spark):
    rows = spark.createDataFrame([("a", "East", None, "en"), ("b", None, "x", "ar")], "doc_id string, region string, topic string, lang string")
    ids = lambda **p: [r["doc_id"] for r in rows.where(retrieve.search_filter(**p)).orderBy("doc_id").collect()]
    assert ids() == ids(doc_ids=[], region="") == ["a", "b"] and ids(region="EAST") == ["a"] and ids(region="west") == [] and ids(doc_ids=["b"], lang="ar") == ["b"]


def test_aliases(spark):
    queries = spark.createDataFrame([(1, "the qasr tower"), (2, "old qasr al hukm")], "qid int, query string")
    aliases = spark.createDataFrame([("qasr", ["palace"]), ("qasr al", ["p"]), ("as", ["no"])], "key string, terms array<string>")
    assert sorted((r["qid"], r["key"]) for r in retrieve.expand_aliases(queries, aliases).collect()) == [(1, "qasr"), (2, "qasr"), (2, "qasr al")]


def test_hit_rate(spark):
    found = spark.createDataFrame([(1, "a", 1), (2, "a", 9)], "qid int, doc_id string, pdf_page int")
    evidence = spark.createDataFrame([(1, "a", 1), (2, "a", 2)], "qid int, doc_id string, pdf_page int")
    scored = spark.createDataFrame([(1, "s"), (2, "s"), (3, "t")], "qid int, kind string")
    assert sorted(map(tuple, retrieve.hit_rate(found, evidence, scored).collect())) == [("s", 2, 1, 0.5), ("t", 1, 0, 0.0)]
    assert sorted(map(tuple, retrieve.hit_rate(found, evidence, scored, traps=["t"]).collect())) == [("s", 2, 1, 0.5)]


def test_search_with_its_query_side(spark):
    requests = spark.createDataFrame(
        [(1, "English tower of the qasr", None, None, None, [], 2), (2, "tower", "ar", None, None, [], 5), (3, "tower", None, "EAST", None, ["A"], 5), (4, "zzz", None, None, None, [], 5)],
        "qid int, query string, lang string, region string, topic string, doc_ids array<string>, k int",
    )
    aliases = spark.createDataFrame([("Qasr", ["Palace", "palace"]), ("_note", ["x"]), ("of the", ["phrase"])], "key string, terms array<string>")
    asked = retrieve.asked(requests, retrieve.glossary(aliases))
    got = {r["qid"]: (r["bag"], r["lang"], r["hinted"], r["expansions"]) for r in asked.collect()}
    assert got[1] == ("english tower qasr phrase palace palace", "en", True, ["of the", "qasr"]) and got[2] == ("tower", "ar", False, []) and got[3][1] is None
    passages = spark.createDataFrame([(1, "A", "en", "x", "east", "h1", "A p1", False), (2, "A", "en", "x", "west", "h2", "A p2", True), (3, "B", "ar", "x", None, "h3", "B p1", False), (4, "A", "en", "x", "East", "h1", "A p4", False), (5, "C", "en", "x", "east", "h5", "C p1", False)], "pid int, doc_id string, lang string, topic string, region string, content_hash string, label string, text_truncated boolean")
    keyword = spark.createDataFrame([(q, p, -float(9 - p), p - 1) for q in (1, 2, 3) for p in range(1, 6)], "qid int, pid int, score double, rank int")
    vector = spark.createDataFrame([(1, 5, 0.9, 0)], "qid int, pid int, sim double, rank int")
    hits = retrieve.search(asked, passages, keyword, vector)
    by = lambda q: [(r["pid"], r["alternates"]) for r in hits.where(f"qid = {q}").orderBy("place").collect()]
    assert by(1) == [(5, []), (1, ["A p4"])] and by(2) == [(3, [])] and by(3) == [(1, ["A p4"])] and by(4) == []
    answers = {r["qid"]: (r["mode"], r["warnings"], r["n_results"]) for r in retrieve.answers(asked, hits, vector).collect()}
    assert answers == {1: ("hybrid", ["language_hint"], 2), 2: ("keyword_only", ["keyword_only"], 1), 3: ("keyword_only", ["keyword_only"], 1), 4: ("keyword_only", ["keyword_only", "no_match"], 0)}


def test_neighbours_cross_pages(spark):
    rows = spark.createDataFrame([("a", "d", 999, 0), ("b", "d", 1000, 0), ("c", "d", 1000, 1), ("z", "e", 1, 0), ("z", "e", 1, 0)], "pid string, doc_id string, pdf_page int, ordinal int")
    got = {r["pid"]: (r["prev_pid"], r["next_pid"]) for r in tables.neighbours(rows).collect()}
    assert got == {"a": (None, "b"), "b": ("a", "c"), "c": ("b", None), "z": (None, None)}


def test_neighbours_across_ranges_of_pages(spark, monkeypatch):
    monkeypatch.setattr(tables, "PAGE_RANGE", 3)
    data = [(f"p{p:02d}{o}", "d", p, o) for p in (1, 2, 4, 9, 10, 20) for o in range(2)]
    got = {r["pid"]: (r["prev_pid"], r["next_pid"]) for r in tables.neighbours(spark.createDataFrame(data, "pid string, doc_id string, pdf_page int, ordinal int")).collect()}
    order = [None, *[x[0] for x in data], None]
    assert got == {order[i]: (order[i - 1], order[i + 1]) for i in range(1, len(data) + 1)}


def test_coverage_counts_vectors_and_filters_by_the_document(spark):
    catalog = spark.createDataFrame([("a", "a.pdf", None, "h", 3, "East", "crafts, food", "s", "u", "2024-01-01"), ("b", "b.pdf", "B", "h", 3, None, None, "s", "u", "2024-01-01")], "doc_id string, filename string, title string, publisher string, pdf_pages int, geography string, topics string, source_url_status string, source_url string, imported_at string")
    pages = spark.createDataFrame([("a", 1, "approved"), ("a", 2, "excluded"), ("a", 2, "excluded")], "doc_id string, pdf_page int, status string")
    passages = spark.createDataFrame([("p", "a", "West"), ("q", "a", "West")], "pid string, doc_id string, region string")
    vectors_ = spark.createDataFrame([("p", [1.0, 2.0])], "pid string, vector array<double>")
    rows = {r["doc_id"]: r for r in tables.coverage(catalog, pages, passages, vectors=vectors_).collect()}
    assert (rows["a"]["title"], rows["a"]["approved_pages"], rows["a"]["excluded_pages"], rows["a"]["passages"], rows["a"]["vectors"]) == ("a", 1, 1, 2, 1) and rows["b"]["vectors"] == 0
    ids = lambda **x: [r["doc_id"] for r in tables.coverage(catalog, pages, passages, **x).collect()]
    assert ids(geography="EAST") == ["a"] and ids(geography="west") == [] and ids(topic="food") == ["a"]
    spent = spark.createDataFrame([(1.0, 0.5)], "committed_usd double, reserved_usd double")
    report = tables.coverage_report(tables.coverage(catalog, pages, passages, vectors=vectors_), spent, vectors_).collect()
    assert [(r["documents"], r["vectors"], r["dims"], r["vectors_indexed"], r["search_mode"], r["committed_usd"]) for r in report] == [(2, 1, 2, 1, "hybrid", 1.0)]


def test_upsert_overwrites_with_nulls(spark):
    old, new = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, "b")], [(2, None), (3, "c")]))
    assert sorted(map(tuple, ingest.upsert(old, new, ["k"]).collect()), key=str) == [(1, "a"), (2, None), (3, "c")]


def test_import_is_idempotent_and_finds_stale(spark):
    pages = spark.createDataFrame([("d", 1, "pdfium", "words " * 20), ("d", 2, "pdfium", "short")], "doc_id string, pdf_page int, engine string, raw_text string")
    built = ingest.build_passages(pages)
    assert built.exceptAll(ingest.build_passages(pages.union(pages))).count() == 0 and built.count() == 1
    stored = spark.createDataFrame([("d:p001:00", "d", 1), ("d:p001:01", "d", 1), ("d:p002:00", "d", 2)], "pid string, doc_id string, pdf_page int")
    assert [r["pid"] for r in ingest.stale(stored, built, built).collect()] == ["d:p001:01"]


def test_metadata_precedence_is_by_presence(spark):
    column = ingest.reviewed_precedence(F.lit(None).cast("string"), F.lit("rec"), F.lit("doc"), F.col("p") == 1, F.col("r") == 1)
    assert [value(spark, column, p=p, r=r) for p, r in ((1, 1), (0, 1), (0, 0))] == [None, "rec", "doc"]


LONG = "The walls of the tower rise about forty metres and are made of stone. "


def imported(spark):
    keys = "doc_id string, pdf_page int"
    pages = spark.createDataFrame([("d", 1, "pdfium", LONG * 3, ""), ("d", 2, "pdfium", "", None), ("d", 3, "pdfium", "short", None), ("d", 4, "pdfium", "", None), ("d", 5, "pdfium", "", "x")], f"{keys}, engine string, text string, other_text string")
    recognized = spark.createDataFrame([("d", 2, LONG, 20, 90.0, None), ("d", 3, None, None, None, "timeout: 9"), ("d", 4, "few", 2, 90.0, None)], f"{keys}, ocr_text string, words int, mean_conf double, error string")
    records = spark.createDataFrame(
        [("d", 5, None, ["First paragraph.", LONG * 40, "Last."], [{"region": None}, {"topic": "own"}], {"region": "rec"}, {"region": "doc", "topic": "doc"}, "v")],
        f"{keys}, lang string, paragraphs array<string>, para_meta array<map<string,string>>, meta map<string,string>, doc_meta map<string,string>, label string",
    )
    meta = spark.createDataFrame([("d", "doc", "doc")], "doc_id string, region string, topic string")
    return pages, recognized, records, meta


def test_pages_are_resolved(spark):
    pages, recognized, records, _ = imported(spark)
    got = {r["pdf_page"]: (r["engine"], r["status"], r["exclude_reason"], r["printed_label"], r["alt_chars"]) for r in ingest.resolve_pages(pages, recognized, records).collect()}
    assert got == {
        1: ("pdfium", "approved", "", None, 0), 2: ("ocr", "approved", "", None, 0), 3: ("pdfium", "excluded", "ocr_too_short", None, 0), 4: ("ocr", "excluded", "ocr_too_short", None, 0), 5: ("pdfium", "approved", "reviewed_transcription", "v", 0),
    }


def test_reviewed_passages_are_numbered_through_and_described_by_presence(spark):
    rows = ingest.build_reviewed(imported(spark)[2]).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in rows] == list(range(len(rows))) and len(rows) > 3
    assert (rows[0]["region"], rows[0]["topic"]) == (None, "doc") and {(r["region"], r["topic"]) for r in rows[1:-1]} == {("rec", "own")} and (rows[-1]["region"], rows[-1]["topic"]) == ("rec", "doc")
    assert all(r["text_raw"] == "" and r["lang"] == "en" and r["derivation"] == "reviewed_transcription" for r in rows) and rows[-1]["text_reviewed"] == "Last."


def test_an_import_again_changes_nothing(spark, tmp_path):
    pages, recognized, records, meta = imported(spark)
    root = str(tmp_path / "corpus")
    first = ingest.run_import(spark, root, pages, recognized, records, meta)
    kept = {name: sorted(map(str, df.collect())) for name, df in (("pages", first.pages), ("passages", first.passages))}
    assert len(kept["pages"]) == 5 and not first.stale.collect()
    again = ingest.run_import(spark, root, pages, recognized, records, meta)
    assert kept == {name: sorted(map(str, df.collect())) for name, df in (("pages", again.pages), ("passages", again.passages))} and not again.stale.collect()
    # Another document comes beside it; page 2 loses its text, and with it its passages.
    other = spark.createDataFrame([("e", 1, "pdfium", LONG * 2, None), ("d", 2, "pdfium", "", None)], pages.schema)
    third = ingest.run_import(spark, root, other, recognized.limit(0), records, meta)
    assert {(r["doc_id"], r["pdf_page"]) for r in third.pages.collect()} == {("d", i) for i in range(1, 6)} | {("e", 1)}
    assert {r["pid"] for r in third.stale.collect()} == {"d:p002:00"} and "d:p002:00" not in {r["pid"] for r in third.passages.collect()}
    assert {r["pid"] for r in third.passages.collect()} >= {"d:p001:00", "e:p001:00"}


def test_snapshots_keep_the_last_version(spark, tmp_path):
    table = ingest.Snapshots(spark, str(tmp_path / "t"))
    assert table.read() is None
    for n in (1, 2):
        table.write(spark.range(n))
        assert table.read().count() == n


def test_ledger(spark):
    log = spark.createDataFrame([(1, "reserve", 1, None, 1.0, None), (2, "release", 1, None, 1.0, None), (3, "commit", 5, 4, 0.5, 0.4), (3, "commit", 5, 4, 0.5, 0.4)], "id int, kind string, tokens_est int, tokens_reported int, cost_est_usd double, cost_reported_usd double")
    assert tuple(ledger.totals(log).collect()[0]) == (0.4, 0.0, 4)
    assert tuple(ledger.totals(log.limit(0)).collect()[0]) == (0.0, 0.0, 0)


def test_batches(spark):
    items = spark.createDataFrame([("d", i, n) for i, n in enumerate([900, 200, 5000, 10, 10])] + [("e", 0, 1)], "doc string, i int, tokens int")
    got = [(r["doc"], r["batch"]) for r in ledger.batches(items, "doc", ["i"], "tokens", 1000, 2).orderBy("doc", "i").collect()]
    assert got == [("d", 0), ("d", 1), ("d", 2), ("d", 3), ("d", 3), ("e", 0)]


@pytest.mark.parametrize("width", [1, 3, 7, 50])
def test_batches_over_segments_are_those_of_one_fold(spark, width):
    import random

    r = random.Random(width)
    data = [(d, i, r.choice([0, 1, 5, 9, 30, 200])) for d in "ab" for i in range(60)]
    want = []
    for d in "ab":
        batch, n, total = 0, 0, 0
        for _, _, size in [x for x in data if x[0] == d]:
            if n >= 6 or (n and total + size > 50):
                batch, n, total = batch + 1, 0, 0
            n, total = n + 1, total + size
            want.append(batch)
    items = spark.createDataFrame(data, "doc string, i int, tokens int")
    assert [r["batch"] for r in ledger.batches(items, "doc", ["i"], "tokens", 50, 6, F.floor(F.col("i") / width)).orderBy("doc", "i").collect()] == want


def test_the_ledger_protocol(spark, tmp_path):
    batches = spark.createDataFrame([(1, 1000, 1.0), (2, 2000, 1.0), (3, 9, 9.0)], "batch int, tokens int, cost double")
    now = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    held = ledger.admitted(batches, ["batch"], 3.0)
    reserves = ledger.reserved(held, now)
    assert [r["cost_est_usd"] for r in reserves.collect()] == [1.5, 1.5]
    keyed = reserves.withColumn("batch", F.when(F.col("tokens_est") == 1000, 1).otherwise(2))
    results = spark.createDataFrame([(1, True, 900, 0.4)], "batch int, ok boolean, tokens_reported int, cost_reported_usd double")
    path = str(tmp_path / "log")
    ledger.append(reserves, path)
    ledger.append(ledger.settled(keyed, results, "batch", now), path)
    log = spark.read.parquet(path)
    assert log.count() == 4 and tuple(ledger.totals(log).collect()[0]) == (0.4, 1.5, 900)
    failed = ledger.settled(keyed, results.withColumn("ok", F.lit(False)), "batch", now)
    assert [r["kind"] for r in failed.collect()] == ["release"]
    later = log.unionByName(log.limit(1).withColumns({"ts": F.to_timestamp(F.lit("2024-02-01 00:00:00")), "kind": F.lit("commit")}))
    assert [(str(r["day"]), r["open_usd"]) for r in ledger.expired(later).collect()] == [("2024-01-01", 1.5)]


@pytest.mark.parametrize("stretch", [1, 2, 9])
def test_admission_over_stretches(spark, stretch):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate([1.0, 0.5, 2.0, 0.1, 0.1, 3.0])], "i int, cost double")
    got = ledger.admitted(rows, ["i"], 4.5, stretch=F.floor(F.col("i") / stretch)).orderBy("i").collect()
    assert [r["admitted"] for r in got] == [True, True, True, True, True, False]
    assert [r["spent_before"] for r in got] == [0.0, 1.0, 1.5, 3.5, 3.6, 3.7]
    got = ledger.admitted(rows, ["i"], 3.5, stretch=F.floor(F.col("i") / stretch)).orderBy("i").collect()
    assert [r["admitted"] for r in got] == [True, True, False, False, False, False]


def test_admission_stops_at_the_first_over_the_cap(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 0.1)], "i int, cost double")
    assert [r["admitted"] for r in ledger.admitted(rows, ["i"], 2.5).orderBy("i").collect()] == [True, True, True]
    assert [r["admitted"] for r in ledger.admitted(rows, ["i"], 2.4).orderBy("i").collect()] == [True, False, False]


def test_selection(spark):
    assert selection.parse_pages("a:1-3,5;b:2") == [("a", 1, 3), ("a", 5, 5), ("b", 2, 2)]
    for bad in ("a", "a:0", "a:3-1"):
        with pytest.raises(ValueError):
            selection.parse_pages(bad)
    pages = spark.createDataFrame([("a", i) for i in range(1, 7)], "doc_id string, pdf_page int")
    assert sorted(r["pdf_page"] for r in selection.select_pages(pages, selection.ranges_table(spark, "a:1-3,2-5")).collect()) == [1, 2, 3, 4, 5]
    for wrong in ({"query": ""}, {"query": "x" * 501}, {"query": "x", "top_k": 11}, {"query": "x", "doc_ids": tuple("abcdefghijk")}, {"query": "x", "topic": "t" * 81}, {"query": "x", "pid": "p" * 201}, {"query": "x", "context_chars": 2001}):
        with pytest.raises(ValueError):
            selection.SearchParams(**wrong)
    docs = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "doc_id string, pdf_page int")
    of = lambda **form: sorted(map(tuple, selection.selected(docs, *selection.selection(**form)).collect()))
    assert of(demo=[("a", 2)]) == [("a", 2)] and of(docs="a, ") == [("a", 1), ("a", 2)] and of(pages="b:1") == [("b", 1)] and len(of(everything=True)) == 3
    for none in ({}, {"docs": "a", "everything": True}, {"docs": " "}):
        with pytest.raises(ValueError):
            selection.selection(**none)


def test_sources(spark, tmp_path):
    from folioscope import sources

    (tmp_path / "b.pdf").write_bytes(b"x")
    (tmp_path / "a.pdf").write_bytes(b"y")
    assert [r["name"] for r in sources.files(spark, str(tmp_path)).collect()] == ["a.pdf", "b.pdf"]
    assert sources.json_table(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "j.json").write_text('[{"a": 1}, {"a": 2}]')
    assert sorted(r["a"] for r in sources.json_table(spark, str(tmp_path / "j.json"), "a int").collect()) == [1, 2]
    pages = spark.createDataFrame([("d", i, f"نص {i}\nline") for i in range(1, 6)], "doc_id string, pdf_page int, raw_text string")
    sources.write_inventory(pages, str(tmp_path / "inventory"))
    assert spark.read.json(str(tmp_path / "inventory")).count() == 5 and "نص" in next((tmp_path / "inventory").glob("*.json")).read_text()
    sources.write_front_matter(pages, str(tmp_path / "front"))
    assert sorted("".join(f.read_text() for f in (tmp_path / "front" / "doc_id=d").glob("*.txt")).split("\n")) == ["", *["line"] * 3, *[f"نص {i}" for i in (1, 2, 3)]]
    sources.write_trace(spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "qid int, place int, pid string"), str(tmp_path / "trace"))
    assert [r["pid"] for r in spark.read.json(str(tmp_path / "trace")).orderBy("place").collect()] == ["a", "b"]
    tsv = tmp_path / "w.tsv"
    tsv.write_text("level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tconf\ttext\n5\t1\t1\t1\t1\t2\t80\tworld\n5\t1\t1\t1\t1\t1\t90\thello\n4\t1\t1\t1\t1\t0\t-1\t\n5\t2\t1\t1\t1\t1\tbad\tx\n")
    assert sorted(map(tuple, sources.recognizer_table(spark, str(tsv)).collect())) == [("1", "hello world", 85.0, 2), ("2", "x", 0.0, 1)]


def test_stream_agrees_with_batch(spark, tmp_path):
    from folioscope.streaming import ledger as stream

    (tmp_path / "log").mkdir()
    log = spark.createDataFrame([(1, "2024-01-01 01:00:00", "commit", 1.0, None), (2, "2024-01-01 02:00:00", "commit", 2.0, 1.5), (2, "2024-01-01 02:00:00", "commit", 2.0, 1.5), (3, "2024-03-01 00:00:00", "commit", 9.0, None)], "id long, ts string, kind string, cost_est_usd double, cost_reported_usd double")
    log.withColumn("ts", F.to_timestamp("ts")).write.mode("append").parquet(str(tmp_path / "log"))
    query = stream.windowed(stream.read_log(spark, str(tmp_path / "log"))).writeStream.format("memory").queryName("spend").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert [(r["entries"], r["usd"]) for r in spark.table("spend").collect()] == [(2, 2.5)]


def test_excluded_pages_lose_their_passages(spark):
    from folioscope.plans import queries

    text = "The walls of the tower rise about forty metres and are made of stone. " * 9
    pages = spark.createDataFrame([("d", 1, "pdfium", text), ("d", 2, "pdfium", ""), ("d", 3, "pdfium", None)], "doc_id string, pdf_page int, engine string, raw_text string")
    kept = ingest.build_passages(pages).select("pid", "doc_id", "pdf_page", "derivation")
    stored = kept.unionByName(spark.createDataFrame([("d:old", "d", 1, "extracted"), ("d:2", "d", 2, "extracted"), ("d:3", "d", 3, "ocr"), ("d:r", "d", 2, "reviewed_transcription"), ("e:1", "e", 1, "extracted")], kept.schema))
    assert kept.count() and {r["pid"] for r in queries.stale_passages(pages, stored).collect()} == {"d:old", "d:2", "d:3"}
