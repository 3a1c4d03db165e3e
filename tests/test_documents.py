"""Chunking, layout, statements and files on small cases."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions.text import plain_integer, sentences, tokens
from ledgerlake.operators import chunking, layout, quality, statements
from ledgerlake.sources import files
from ledgerlake.streaming import ingest


def split_plain(text, most):
    if len(text) <= most:
        return [text]
    out, held = [], []
    for line in (x for x in text.split("\n") if x.strip()):
        if held and sum(len(h) + 1 for h in held) + len(line) + 1 > most:
            out.append("\n".join(held))
            held = []
        if len(line) > most:
            out += [line[k : k + most] for k in range(0, len(line), most)]
        else:
            held.append(line)
    return out + (["\n".join(held)] if held else [])


def pack_plain(units, target, most):
    out, held, n = [], [], 0
    for unit in units:
        if held and n + len(unit) + 1 > most:
            out, held, n = [*out, " ".join(held)], [], 0
        held, n = [*held, unit], n + len(unit) + 1
        if n >= target:
            out, held, n = [*out, " ".join(held)], [], 0
    return out + ([" ".join(held)] if held else [])


def test_chunks_match_plain_loops(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcåäö .!?\nAB1") for _ in range(rng.randrange(1, 30)))
    texts = ["", "x", "A. B! C? d", "z" * 500, "\n".join(["rad"] * 90), *("".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(40)), None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", sentences(F.col("t")).alias("s"), chunking.split_oversized(F.col("t"), 70).alias("o"), chunking.chunk_text(F.col("t"), 60, 90).alias("c")).collect():
        text = texts[r.i]
        if text is None:
            assert r.s is None and r.c is None
            continue
        plain = [s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-ZÅÄÖ0-9])", text) if s.strip()]
        assert r.s == plain
        assert r.o == split_plain(text, 70)
        assert r.c == pack_plain([p for s in plain for p in split_plain(s, 90)], 60, 90)


def test_tokens_and_numbers(spark):
    df = spark.createDataFrame([("Åäö_1 x-Y 8.5", "–36.046"), (None, "4 613 193"), ("", "12a"), ("½²", None)], "t string, v string")
    got = df.select(tokens(F.col("t")).alias("t"), plain_integer(F.col("v")).alias("v")).collect()
    assert [r.t for r in got] == [["åäö_1", "x", "y", "8", "5"], None, [], ["½²"]]
    assert [r.v for r in got] == [-36046, 4613193, None, None]


def test_byte_split(spark):
    df = spark.createDataFrame([("a", "ö. ö. ö. z"), ("b", "kort"), ("c", None)], "chunk_id string, text string")
    assert sorted(map(tuple, chunking.byte_split(df, 8).collect()), key=str) == sorted([("a::del1", "ö. ö. "), ("a::del2", "ö. z"), ("b", "kort"), ("c", None)], key=str)


def test_byte_split_looks_into_long_texts_only(spark):
    """The fold over pieces once ran on every text, and copied text at each step; other columns and odd texts are kept."""
    texts = ["", ". ", ". . ", "ö. " * 9, "x" * 20, "x" * 20 + ". ", "a. " + "y" * 12 + ". b", None, "kort. text. ", "å" * 4 + ". " + "z" * 8]
    df = spark.createDataFrame([(k, str(k), t) for k, t in enumerate(texts)], "n int, chunk_id string, text string")
    split = chunking.byte_split(df, 8)
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan and split.columns == df.columns
    want = []
    for k, text in enumerate(texts):
        if text is None or len(text.encode()) <= 8:
            want.append((k, str(k), text))
            continue
        parts, now = [], ""
        units = text.split(". ")
        for piece in [u + ". " for u in units[:-1]] + units[-1:]:
            if now and len((now + piece).encode()) > 8:
                parts.append(now)
                now = ""
            now += piece
        want += [(k, f"{k}::del{n}", part) for n, part in enumerate([*parts, now][: len(parts) + bool(now)], 1)]
    assert sorted(map(tuple, split.collect()), key=str) == sorted(want, key=str)


def test_repeats_of_a_document_are_dropped(spark):
    text = "Samma text som är lång nog att räknas."
    pages = spark.createDataFrame([("d", 1, text), ("d", 2, f" {text} "), ("e", 1, text), ("e", 2, "kort"), ("e", 3, None)], "document string, page_number int, text string")
    assert sorted((r.document, r.page_number, r.piece) for r in chunking.text_chunks(pages).collect()) == [("d", 1, 0), ("e", 1, 0)]


def test_facts_and_tables(spark):
    filings = spark.createDataFrame([("volvo_2023.pdf", "volvo", "2023", {"resultaträkning": [2, 2], "balansräkning": []})], "document string, company string, fiscal_year string, statement_pages map<string,array<int>>")
    rows = spark.createDataFrame([(7, "volvo_2023.pdf", "Omsättning", ["5", None], ["–2023-12-31", "2022"], 2), (8, "volvo_2023.pdf", "Kostnad", [None], ["2023"], 2), (9, "volvo_2023.pdf", "Annat", ["1"], ["2023"], 3)], "row_id long, document string, label string, row_values array<string>, row_columns array<string>, page int")
    stated = chunking.statement_rows(rows, filings, spark.createDataFrame([], "company string, display_name string"))
    facts = {r.chunk_id: r.text for r in chunking.fact_chunks(stated).collect()}
    assert len(facts) == 4 and facts["volvo_2023.pdf::resultaträkning::rad0"] == "Volvo resultaträkning 2023: Omsättning var 5 (2023-12-31)."
    assert facts["volvo_2023.pdf::resultaträkning::rad3"] == "Volvo resultaträkning 2023: Kostnad var inget värde angivet."
    table = chunking.table_chunks(stated, chunking.statement_pages(filings)).collect()
    assert len(table) == 1 and table[0].pages == [2, 2] and table[0].text.startswith("Volvo resultaträkning 2023. Volvo")


def test_lines_are_anchored(spark):
    words = spark.createDataFrame([("d", 1, k, f"w{k}", 10.0 * k, 10.0 * k + 5, t, t + 10) for k, t in enumerate([0.0, 1.5, 3.0, 4.5, 10.0])], "document string, page int, ord int, text string, x0 double, x1 double, top double, bottom double")
    lined = layout.line_groups(words)
    assert [r.line for r in lined.orderBy("ord").collect()] == [0, 0, 1, 1, 2]
    assert layout.lines_to_text(lined).first().text == "w0 w1\nw2 w3\nw4"
    assert [r.text for r in layout.phrases(lined).orderBy("line").collect()] == ["w0 w1", "w2 w3", "w4"]


def word(text, x0, width=20, top=0.0):
    return {"text": text, "x0": float(x0), "x1": float(x0 + width), "top": top}


def test_numbers(spark):
    lines = [
        [word("8", 0, 5), word("150", 8, 10)], [word("–", 0, 4), word("36", 6, 8)], [word("–", 0, 4), word("36.046", 6, 8)], [word("8", 0, 5), word("150", 20, 10), word("x", 40)],
        [word("4", 0, 5), word("613", 6, 9), word("193", 16, 9), word("12", 26, 5)], [word("x", 0, 5), word("150", 6, 9)], [word("-", 0, 2), word("8", 3, 5), word("733", 9, 9)],
    ]
    df = spark.createDataFrame([(k, n, w["text"], w["x0"], w["x1"]) for k, line in enumerate(lines) for n, w in enumerate(line)], "line int, ord int, text string, x0 double, x1 double")
    got = {}
    for r in layout.number_merge(df, ["line"]).orderBy("line", "token").collect():
        got.setdefault(r.line, []).append((r.text, r.kind))
    assert [got[k] for k in range(len(lines))] == [
        [("8 150", "number")], [("–36", "number")], [("–", "dash"), ("36.046", "number")], [("8", "number"), ("150", "number"), ("x", "word")],
        [("4 613 193", "number"), ("12", "number")], [("x", "word"), ("150", "number")], [("-8 733", "number")],
    ]


def test_columns(spark):
    cases = [
        ([(100.0, "a"), (104.0, "b")], [100.0, 150.0], ["a", "b"]), ([(100.0, "a")], [50.0, 100.0, 150.0], [None, "a", None]), ([], [], []), ([], [1.0], [None]),
        ([(90.0, "a"), (101.0, "b")], [50.0, 100.0], ["a", "b"]), ([(100.0, "a"), (101.0, "b"), (102.0, "c")], [100.0, 150.0], ["a", "b"]), ([(99.0, "a"), (101.0, "b"), (149.0, "c")], [100.0, 150.0], ["a", "c"]),
    ]
    df = spark.createDataFrame([(k, n, c) for k, (n, c, _) in enumerate(cases)], "k int, numbers array<struct<at:double,text:string>>, centres array<double>")
    got = {r.k: r.held for r in df.select("k", layout.column_assign(F.col("numbers"), F.col("centres")).alias("held")).collect()}
    assert [got[k] for k in range(len(cases))] == [held for _, _, held in cases]


def test_page_rows(spark):
    def rows_of(words, page=1):
        return [("d", page, k, w["text"], w["x0"], w["x1"], w["top"], w["top"] + 10) for k, w in enumerate(words)]

    head = [word("Mkr", 40), word("2023", 300), word("2022", 380)]
    body = [word("Rubrik", 40, 40, 12.0), word("Omsättning", 40, 60, 24.0), word("8", 296, 5, 24.0), word("150", 303, 12, 24.0), word("–", 385, 5, 24.0), word("Kostnad", 40, 50, 36.0), word("-7", 385, 8, 36.0), word("fotnot", 40, 30, 90.0), word("12", 300, 10, 90.0)]
    twice = [word("Industri", 290, 50), word("Koncern", 450, 50), word("Mkr", 20, 20, 12.0)] + [word(y, x, 20, 12.0) for y, x in (("2023", 280), ("2022", 320), ("2023", 440), ("2022", 480))] + [word("Post", 20, 20, 24.0)] + [word(v, x, 10, 24.0) for v, x in (("1", 285), ("2", 325), ("3", 445), ("4", 485))]
    broken = [word("Mkr", 40, 20, 4.0), word("2023", 300, 20, 4.0), word("2022", 380, 20, 8.5), word("Post", 40, 20, 24.0), word("5", 305, 8, 24.0), word("x" * 121, 40, 200, 36.0), word("6", 305, 8, 36.0), word("2021", 300, 20, 48.0), word("tkr:", 40, 20, 48.0), word("Annat", 40, 20, 60.0), word("7", 305, 8, 60.0)]
    schema = "document string, page int, ord int, text string, x0 double, x1 double, top double, bottom double"
    df = spark.createDataFrame(rows_of(head + body) + rows_of(twice, 3) + rows_of(broken, 4) + [("d", 2, 0, "ensam", 0.0, 1.0, 0.0, 1.0), (None, 1, 0, "2020", 0.0, 1.0, 0.0, 1.0), ("d", 5, 0, None, 0.0, 1.0, 0.0, 1.0)], schema)
    got = [tuple(r)[1:] for r in layout.extract_rows(df).orderBy("page", "row_no").collect()]
    assert got == [
        (1, 1, "Rubrik Omsättning", ["8 150", None], ["2023", "2022"]), (1, 2, "Kostnad", [None, "-7"], ["2023", "2022"]),
        (3, 1, "Post", ["1", "2", "3", "4"], ["Industri 2023", "Industri 2022", "Koncern 2023", "Koncern 2022"]),
        (4, 1, "Post", ["5", None], ["2023", "2022"]), (4, 2, "Annat", ["7"], ["2021"]),
    ]
    assert layout.extract_rows(df.limit(0)).count() == 0


def test_gutter(spark):
    words = [("d", 1, k, "w", x, x + 100, 10.0 * k, 10.0 * k + 8) for k, x in enumerate([60.0, 150.0, 330.0])] + [("d", 2, 0, "w", 0.0, 600.0, 0.0, 8.0), ("d", 3, 0, "stor", 250.0, 350.0, 0.0, 40.0)]
    df = spark.createDataFrame(words, "document string, page int, ord int, text string, x0 double, x1 double, top double, bottom double")
    widths = spark.createDataFrame([("d", p, 600.0) for p in (1, 2, 3)], "document string, page int, page_width double")
    assert [tuple(r) for r in layout.gutters(df, widths).collect()] == [("d", 1, 290.0)]
    assert {r.page: r.text for r in layout.column_text(df, widths).collect()} == {1: "w\nw\nw", 2: "w", 3: "stor"}


def test_texts_from_elsewhere_count_for_pages_without_columns(spark):
    """Of a page with a gutter the columns are read; other pages, and those without words, take the text that was given."""
    words = [("d", 1, k, t, x, x + 100, 10.0 * k, 10.0 * k + 8) for k, (t, x) in enumerate([("a", 60.0), ("c", 350.0), ("b", 150.0)])] + [("d", 2, 0, "w", 0.0, 600.0, 0.0, 8.0), ("d", 4, 0, "v", 0.0, 600.0, 0.0, 8.0)]
    df = spark.createDataFrame(words, "document string, page int, ord int, text string, x0 double, x1 double, top double, bottom double")
    widths = spark.createDataFrame([("d", p, 600.0) for p in (1, 2, 4)], "document string, page int, page_width double")
    other = spark.createDataFrame([("d", 1, "x"), ("d", 2, "y"), ("d", 3, "z")], "document string, page int, text string")
    assert {r.page: r.text for r in layout.column_text(df, widths, other).collect()} == {1: "a\nb\nc", 2: "y", 3: "z", 4: "v"}


def test_headings(spark):
    text = "Koncernens balansräkning\n  KONCERNENS RESULTATRÄKNING 2023\nKoncernens balansräkning " + "x" * 60 + "\nModerbolagets balansräkning\nKoncernens balansräkning"
    df = spark.createDataFrame([(1, "d", 4, text), (2, "d", 5, None)], "page_id long, document string, page_number int, text string")
    assert [(r.line_no, r.section) for r in statements.locate_headings(df).orderBy("line_no").collect()] == [(1, "balansräkning"), (2, "resultaträkning"), (5, "balansräkning")]
    assert [r.line_no for r in statements.locate_headings(df, F.lit("moderbolag")).collect()] == [4]
    with pytest.raises(ValueError, match="unknown level"):
        statements._section_of(F.lit("x"), "annat")


def test_ratios_and_balance(spark):
    rows = spark.createDataFrame([(1, "d", "Nettoomsättning", ["200"]), (2, "d", "mkr: Rörelseresultat", ["15"]), (3, "d", "Eget kapital per aktie", ["9"]), (4, "d", "Summa tillgångar", ["100"]), (5, "d", "Summa eget kapital och skulder", [None, "1 00"]), (6, "e", "Summa tillgångar", ["1"])], "row_id long, document string, label string, row_values array<string>")
    money = spark.createDataFrame([(1, 1, "sek", 200), (1, 2, "sek", 100), (2, 1, "sek", 15), (3, 1, "sek", 9), (4, 1, "sek", 100)], "row_id long, col_no int, unit string, amount long")
    assert [(r.ratio, float(r.percent)) for r in statements.ratios(rows, money).collect()] == [("rörelsemarginal", 7.5)]
    assert [(r.item, float(r.change_percent)) for r in statements.year_on_year(rows, money).collect()] == [("nettoomsättning", 100.0)]
    assert [tuple(r) for r in statements.balance_check(rows).collect()] == [("d", 100, 100, True)]


def test_liquidity_and_free_cash_flow(spark):
    labels = ["Omsättningstillgångar", "Varulager not 12", "Kortfristiga skulder", "Kassaflöde från den löpande verksamheten", "Investeringar i materiella tillgångar"]
    rows = spark.createDataFrame([(k, "d", x, ["1"]) for k, x in enumerate(labels)], "row_id long, document string, label string, row_values array<string>")
    columns = [(90, 30, 40, 50, -20), (90, 30, 0, 50, 60), (90, None, 40, 50, None)]  # a denominator of 0; operands that are missing
    money = spark.createDataFrame([(k, n, "sek", v) for n, values in enumerate(columns) for k, v in enumerate(values) if v is not None], "row_id long, col_no int, unit string, amount long")
    got = sorted((r.col_no, r.ratio, r.percent and float(r.percent), r.amount and int(r.amount)) for r in statements.ratios(rows, money).collect())
    assert got == [(0, "fritt kassaflöde", None, 30), (0, "kassalikviditet", 150.0, None), (1, "fritt kassaflöde", None, -10)]
    assert statements.year_on_year(rows, money).count() == 0


def test_violations(spark):
    rows = spark.createDataFrame([(1, "Omsättning", ["5", None], ["2023", "2022"]), (2, None, None, None), (3, "12", ["x"], ["a", "b"])], "row_id long, label string, row_values array<string>, row_columns array<string>")
    assert sorted(map(tuple, quality.row_violations(rows).collect())) == [(2, "label length"), (2, "no value"), (3, "arity"), (3, "label without letters"), (3, "not a number")]


def test_files_round_trip(spark, tmp_path):
    doc = {"document": "volvo_2023.pdf", "statement_level": "koncern", "statement_pages": {"resultaträkning": [1]}, "pages": [{"page": 1, "text": "Å", "table_rows": [{"label": "x", "values": [None, "1"], "columns": ["a", "b"]}]}, {"page": 2, "text": "t"}]}
    (tmp_path / "volvo_2023.pdf.json").write_text(json.dumps(doc, ensure_ascii=False, indent=2))
    processed = files.read_processed(spark, str(tmp_path))
    assert [(r.company, r.fiscal_year) for r in processed.collect()] == [("volvo", "2023")]
    assert [(r.page_number, r.statement_type) for r in files.pages_of(processed).collect()] == [(1, None), (2, None)]
    chunks = spark.createDataFrame([("a", "d", "volvo", "2023", "fact", "x", [87, 88], "text ett"), ("b", "d", "volvo", "2023", "text", None, [], "text två")], "chunk_id string, document string, company string, fiscal_year string, chunk_type string, section string, pages array<int>, text string")
    assert sorted(files.from_export(files.flat_export(chunks)).collect()) == sorted(chunks.select("chunk_id", "document", "company", "fiscal_year", "chunk_type", "section", "pages", "text").collect())
    files.build_index(chunks, spark.createDataFrame([("a", [1.0, 0.0])], "chunk_id string, vector array<float>"), str(tmp_path / "index"))
    vectors, postings = files.read_index(spark, str(tmp_path / "index"))
    assert vectors.count() == 1 and sorted((r.doc, r.term) for r in postings.collect()) == [("a", "ett"), ("a", "text"), ("b", "text"), ("b", "två")]
    asked = spark.createDataFrame([("q", "text två", [0.6, 0.8], None, []), ("r", "ett", None, ["annat"], None)], "query_id string, text string, vector array<float>, companies array<string>, years array<string>")
    near, found = files.search_index(spark, str(tmp_path / "index"), asked, 2)
    assert [tuple(r) for r in near.select("query", "doc", "distance", "rank").collect()] == [("q", "a", 0.4, 1)]
    assert {(r["query"], r["doc"]) for r in found.collect()} <= {("q", "a"), ("q", "b")} and not found.where("query = 'r'").count()
    files.write_json(chunks.select("document", "chunk_id", "text"), str(tmp_path / "json"))
    assert sorted(r.chunk_id for r in spark.read.json(str(tmp_path / "json")).collect()) == sorted(r.chunk_id for r in chunks.collect())
    assert tuple(files.split_report(files.byte_split(chunks)).first()) == (chunks.count(), 0, chunks.count())


def test_stream_of_pages(spark, tmp_path):
    schema = "page_id long, document string, page_number int, text string, extracted_at timestamp"
    text = "En sida som är lång nog för ett stycke. Slut."
    spark.sql(f"select 1L page_id, 'd' document, 1 page_number, '{text}' text, timestamp'2024-01-01 00:00:00' extracted_at union all select 2L, 'd', 1, '{text}', timestamp'2024-01-01 00:10:00'").coalesce(1).write.parquet(str(tmp_path / "in"))
    pages = ingest.read_pages(spark, str(tmp_path / "in"), schema)
    ingest.write_chunks(ingest.chunk_stream(pages), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [text]
