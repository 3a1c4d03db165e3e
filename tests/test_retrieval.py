"""Filters, rankings, fusion and answers against literal cases and brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import answer, bm25, evaluate, filters, hybrid, vectors

YEARS = [("hexatronic", ["2023", "2024", "2025"]), ("volvo", ["2023", "2024", "2025"]), ("skistar", ["2022-23", "2023-24", "2024-25"])]
CASES = [
    ("Vad var Hexatronics nettoomsättning 2023?", "hexatronic", ["2023"]),
    ("Vad var Volvos rörelseresultat 2024?", "volvo", ["2024"]),
    ("Volvokoncernens eget kapital 2023", "volvo", ["2023"]),
    ("Vad var SkiStars nettoomsättning 2023/24?", "skistar", ["2023-24"]),
    ("SkiStars nettoomsättning 2024", "skistar", ["2023-24"]),
    ("SkiStars summa tillgångar 2025", "skistar", ["2024-25"]),
    ("SkiStars omsättning 2019", "skistar", []),
    ("Hur har soliditeten utvecklats?", None, []),
    ("Hur har Hexatronics nettoomsättning utvecklats 2023-2025?", "hexatronic", ["2023", "2024", "2025"]),
    ("Hur har Volvos rörelseresultat förändrats från 2023 till 2024?", "volvo", ["2023", "2024"]),
    ("SkiStars nettoomsättning 2023/24", "skistar", ["2023-24"]),
    ("Omsättning 2024 i alla bolag", None, ["2023-24", "2024"]),
]


def test_filter_cases(spark):
    queries = spark.createDataFrame([(k, c[0]) for k, c in enumerate(CASES)], "query_id int, text string")
    got = {r["query_id"]: (r["company"], r["years"]) for r in filters.parse_filters(queries, spark.createDataFrame(YEARS, "company string, fiscal_years array<string>")).collect()}
    assert [got[k] for k in range(len(CASES))] == [(c, y) for _, c, y in CASES]


def test_filters_without_companies(spark):
    queries = spark.createDataFrame([(1, "Volvo 2024"), (2, None)], "query_id int, text string")
    got = filters.parse_filters(queries, spark.createDataFrame([], "company string, fiscal_years array<string>")).collect()
    assert {r["query_id"]: r["company"] for r in got} == {1: None, 2: None}


def test_expansion(spark):
    df = spark.createDataFrame([("Rörelsemarginal och ROE?",), ("Oroande utfall",), ("Inget",), (None,)], "t string").select(filters.expand_query(F.col("t")).alias("x"))
    assert [r.x for r in df.collect()] == ["Rörelsemarginal och ROE? rörelseresultat nettoomsättning omsättning nettoresultat eget kapital", "Oroande utfall nettoresultat summa tillgångar", "Inget", None]


DOCS = [(1, "Kassan växer. Kassan växer igen"), (2, "kassan är tom"), (3, "ÖRE åäö räntan"), (4, ""), (5, None), (6, "räntan växer 2023"), (7, "kassan kassan kassan")]


def okapi(query, docs, k1=1.5, b=0.75):
    words = {i: re.findall(r"\w+", (t or "").lower()) for i, t in docs}
    n, mean = len(docs), sum(map(len, words.values())) / len(docs)
    df = Counter(w for ws in words.values() for w in set(ws))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    out = {}
    for i, ws in words.items():
        tf = Counter(ws)
        s = sum((floor if raw[q] < 0 else raw[q]) * tf[q] * (k1 + 1) / (tf[q] + k1 * (1 - b + b * len(ws) / mean)) for q in re.findall(r"\w+", query.lower()) if tf[q])
        if round(s, 6) > 0:
            out[i] = round(s, 6)
    return out


def test_bm25_matches_the_formula(spark):
    queries = [(1, "räntan växer"), (2, "kassan Kassan tom"), (3, "okänt"), (4, "åäö öre")]
    got = {}
    for r in bm25.scores(spark.createDataFrame(queries, "query_id int, text string"), spark.createDataFrame(DOCS, "doc int, text string")).collect():
        got.setdefault(r["query"], {})[r["doc"]] = r["score"]
    for q, text in queries:
        assert got.get(q, {}) == pytest.approx(okapi(text, DOCS))


def test_search_is_exact(spark):
    """Against all scores, in small blocks and slices, with every kind of filter, repeated texts, empty and null ones."""
    import random

    rng = random.Random(8)
    words = ["kassa", "ränta", "lager", "skuld", "vinst", "mål", "åäö", "2023"]
    docs = [(n, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9))) if n % 17 else None, rng.choice(["a", "b", None]), rng.choice(["2023", "2024", None])) for n in range(120)]
    asked = [(q, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 4))) if q else None, rng.choice(["a", "b", None]), rng.choice([["2023"], [], None, ["2024", "2023"]])) for q in range(30)]
    corpus = spark.createDataFrame(docs, "doc int, text string, company string, year string")
    queries = spark.createDataFrame(asked, "query_id int, text string, own string, years array<string>")
    full = {(r["query"], r["doc"]): r["score"] for r in bm25.scores(queries, corpus).collect()}
    index = bm25.build(corpus, keep=("company", "year"))
    for same, within, allowed in ((None, (), None), (("company", "own"), (), None), (None, (("year", "years"),), None), (("company", "own"), (("year", "years"),), F.col("doc") % 2 == 0)):
        got = {(r["query"], r["rank"]): (r["doc"], r["score"]) for r in bm25.search(index, queries, 5, allowed=allowed, same=same, within=within, block=7, postings_slice=60).collect()}
        want = {}
        for q, _, own, years in asked:
            fits = [(d, full[q, d]) for d, _, company, year in docs if (q, d) in full and (not same or own and own == company) and (not within or not years or year in years) and (allowed is None or d % 2 == 0)]
            want |= {(q, k + 1): hit for k, hit in enumerate(sorted(fits, key=lambda x: (-x[1], x[0]))[:5])}
        assert got == want


def test_wide_search_moves_no_postings(spark):
    """Many blocks and slices, rare and frequent terms, repeated texts, ids that aren't numbers: exact, and what is shuffled after the index is stored holds queries and hits only."""
    import random

    rng = random.Random(3)
    words = [f"w{n}" for n in range(200)]
    docs = [(f"d{n}", " ".join(rng.choices(words, [1 / (1 + n) for n in range(200)], k=rng.randrange(1, 12)))) for n in range(800)]
    docs = [(d, docs[n - 1][1] if n % 9 == 0 and n else t) for n, (d, t) in enumerate(docs)]
    asked = [(q, " ".join(rng.sample(words[:20], 2) + rng.sample(words, 3))) for q in range(40)]
    index = bm25.build(spark.createDataFrame(docs, "doc string, text string").repartition(6))
    found = bm25.search(index, spark.createDataFrame(asked, "query_id int, text string"), 4, block=9, postings_slice=300)
    got = {(r["query"], r["rank"]): (r["doc"], r["score"]) for r in found.collect()}
    want = {(q, k + 1): hit for q, text in asked for k, hit in enumerate(sorted(okapi(text, docs).items(), key=lambda x: (-x[1], x[0]))[:4])}
    assert got == want
    assert "CoGroup" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "grouped"), [("source_summary", 0), ("question_contexts", 0), ("result_lines", 0), ("base_results", 0), ("rrf_fuse", 1), ("hybrid_trace", 1)])
def test_queries_on_the_wide_search(spark, name, grouped):
    """Only vectors are still dealt to groups by a shuffle."""
    from ledgerlake.plans import core

    plan = core.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == grouped


@pytest.mark.parametrize("cells", [10_000_000, 2000])
def test_long_queries_by_a_matrix_of_frequent_terms(spark, monkeypatch, cells):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{n}" for n in rng.zipf(1.3, size) % 300) for size in rng.integers(0, 80, 400)]
    docs = spark.createDataFrame([(k, t, k % 3) for k, t in enumerate(texts + texts[:60])], "doc long, text string, part int")
    index = bm25.build(docs, keep=("part",))
    files = sorted(bm25.durable_table(bm25.inverted(index.stored.repartition(3, "doc"), ["part"], 4000), "slices").inputFiles())
    said = bm25.query_terms(docs.where("doc % 5 = 0"), "doc", "text").join(index.weights, "term").groupBy("query").agg(F.collect_list(F.struct("term", (F.col("qtf") * F.col("idf")).alias("w"))).alias("terms"))
    queries = said.withColumn("_part", F.when(F.col("query") % 2 == 0, F.array(F.lit(1), F.lit(2)))).toArrow()
    built = []
    monkeypatch.setattr(bm25, "CELLS", cells)
    monkeypatch.setattr(bm25._Matrix, "__init__", lambda self, often, *more, old=bm25._Matrix.__init__: (built.append(int(often.sum())), old(self, often, *more))[1])
    dense = bm25._best_of_slices(queries, files, 20, index.mean, ["part"])
    assert len(built) > 1 and all(n > 2 for n in built)
    monkeypatch.setattr(bm25, "DENSE", math.inf)
    assert dense.equals(bm25._best_of_slices(queries, files, 20, index.mean, ["part"]))


def test_companies_are_found_by_their_beginning(spark):
    companies = spark.createDataFrame([("volvo", ["2023"]), ("volvo cars", ["2023"]), ("ab", ["2023"]), ("", None), (None, None)], "company string, fiscal_years array<string>")
    queries = spark.createDataFrame([(1, "Volvo Cars 2023"), (2, "grabb"), (3, "volv"), (4, ""), (5, None)], "query_id int, text string")
    assert {r["query_id"]: r["company"] for r in filters.parse_filters(queries, companies).collect()} == {1: "volvo", 2: "ab", 3: None, 4: None, 5: None}


def test_nearest_in_small_blocks(spark):
    rng = np.random.default_rng(5)
    data = np.round(rng.normal(size=(90, 4)))
    rows = spark.createDataFrame([(i, v.tolist(), "hot" if i % 3 else None) for i, v in enumerate(data)] + [(100, [1.0], "hot"), (101, [], "hot"), (102, None, "hot"), (103, [1.0, None, 0.0, 0.0], "hot")], "doc long, vector array<double>, label string")
    unit = data / np.maximum(np.linalg.norm(data, axis=1, keepdims=True), 1e-12)
    for same in (None, ("label", "label")):
        got = {(r["query"], r["rank"]): r["doc"] for r in vectors.nearest(rows, rows.withColumnRenamed("doc", "query"), 3, same=same, block=8, rows_slice=10).where("query < 90").collect()}
        want = {}
        for q in range(90):
            like = np.round(unit @ unit[q], 6)
            near = sorted((i for i in range(90) if not same or i % 3 and q % 3), key=lambda i: (-like[i], i))[:3]
            want |= {(q, k + 1): i for k, i in enumerate(near)}
        assert got == want
    assert vectors.nearest(rows.limit(0), rows.withColumnRenamed("doc", "query"), 3).count() == 0


def test_bm25_without_documents(spark):
    assert bm25.scores(spark.createDataFrame([(1, "a")], "query_id int, text string"), spark.createDataFrame([], "doc int, text string")).count() == 0


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(60, 8))
    data[7] = data[8]
    rows = spark.createDataFrame([(int(i), v.tolist(), int(i % 3)) for i, v in enumerate(data)] + [(99, None, 1)], "doc long, vector array<double>, label int").repartition(5)
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    for same in (None, ("label", "label")):
        got = vectors.nearest(rows, rows.where("doc % 20 = 0").withColumnRenamed("doc", "query"), 4, same=same).collect()
        for q in (0, 20, 40):
            like = np.round(unit @ unit[q], 6)
            want = sorted((i for i in range(60) if not same or i % 3 == q % 3), key=lambda i: (-like[i], i))[:4]
            assert [r["doc"] for r in sorted(got, key=lambda r: r["rank"]) if r["query"] == q] == want


def test_nearest_filters_before_the_cut(spark):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(300, 8))
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    company = ["volvo" if i % 6 else None if i % 12 else "skistar" for i in range(300)]
    year = [("2023", "2024", "2025", None)[i % 4] for i in range(300)]
    rows = spark.createDataFrame([(i, v.tolist(), company[i], year[i]) for i, v in enumerate(data)], "doc long, vector array<double>, company string, fiscal_year string").repartition(3)
    filtered = [(0, ["volvo"], ["2023"]), (1, ["volvo"], []), (2, None, ["2024", "2025"]), (3, None, []), (4, ["volvo"], ["1999"])]
    asked = spark.createDataFrame([(q, data[q].tolist(), c, y) for q, c, y in filtered], "query long, vector array<double>, companies array<string>, years array<string>")
    got = vectors.nearest(rows, asked, 100, within=[("company", "companies"), ("fiscal_year", "years")]).collect()
    for q, c, y in filtered:
        like = np.round(unit @ unit[q], 6)
        want = sorted((i for i in range(300) if (not c or company[i] in c) and (not y or year[i] in y)), key=lambda i: (-like[i], i))[:100]
        found = sorted((r["rank"], r["doc"]) for r in got if r["query"] == q)
        assert found == [(k + 1, i) for k, i in enumerate(want)]


def test_questions_search_chunks_of_their_year_only(spark, tmp_path):
    """150 chunks of another year are nearer to the question; those of its year keep ranks from 1."""
    from ledgerlake.plans import core

    chunk = lambda n, year, text: (n, text, "volvo", year, f"volvo_{year}_1.pdf", "text", None, [1])
    chunks = [chunk(n, "2023", "Nettoomsättning volvo 2024") for n in range(150)] + [chunk(n, "2024", "Nettoomsättning " + "övrigt " * (n - 149)) for n in range(150, 155)]
    spark.createDataFrame(chunks, "chunk_no long, text string, company string, fiscal_year string, document string, chunk_type string, section string, pages array<int>").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([(20, "Nettoomsättning", "volvo_2024_1.pdf")], "row_id long, label string, document string").write.parquet(f"{tmp_path}/financial_rows.parquet")
    spark.createDataFrame([("volvo", ["2023", "2024"])], "company string, fiscal_years array<string>").write.parquet(f"{tmp_path}/company_years.parquet")
    got = core.hybrid_questions(spark, str(tmp_path)).collect()
    assert {r["doc"]: r["vector_rank"] for r in got} == {150 + k: k + 1 for k in range(5)}


def test_evaluation_of_rows_without_values(spark, tmp_path):
    """A row whose values are all null, none or unknown expects nothing; its question is judged all the same."""
    from ledgerlake.plans import core

    values = {20: ["5", "4"], 40: [None, None], 60: [], 80: None, 100: [None, "7"]}
    chunks = [(n, f"Volvo 2024: Post{n} var {v and v[0]} (2024).", "volvo", "2024", "volvo_2024_1.pdf", "fact", None, [1]) for n, v in values.items()]
    spark.createDataFrame(chunks, "chunk_no long, text string, company string, fiscal_year string, document string, chunk_type string, section string, pages array<int>").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([(n, f"Post{n}", "volvo_2024_1.pdf", v) for n, v in values.items()], "row_id long, label string, document string, row_values array<string>").write.parquet(f"{tmp_path}/financial_rows.parquet")
    spark.createDataFrame([("volvo", ["2024"])], "company string, fiscal_years array<string>").write.parquet(f"{tmp_path}/company_years.parquet")
    got = {r["query_id"]: r for r in core.evaluation_run(spark, str(tmp_path)).collect()}
    assert {n: r["expected"] for n, r in got.items()} == {20: "5", 40: None, 60: None, 80: None, 100: "7"}
    assert got[20]["outcome"] == "right" and got[40]["outcome"] == "partial"


def test_fusion_literals(spark):
    rank = lambda docs: spark.createDataFrame([(1, d, k + 1) for k, d in enumerate(docs)], "query int, doc string, rank int")
    best = lambda *lists: [r["doc"] for r in hybrid.fuse(list(map(rank, lists))).orderBy("fused_rank").collect()]
    assert best(["x", "consensus", "y"], ["z", "consensus", "w"])[0] == "consensus"
    assert best(["p", "q", "r"], ["r", "q", "p"]) == best(["r", "q", "p"], ["p", "q", "r"])


def test_fallback_and_base(spark):
    schema = "query int, doc string, rank int"
    narrow = [spark.createDataFrame([(1, "a", 1), (2, "a", 1), (2, "b", 2)], schema), spark.createDataFrame([(2, "a", 1)], schema)]
    wide = [spark.createDataFrame([(q, d, k) for q in (1, 2, 3) for k, d in ((1, "z"), (2, "y"))], schema)] * 2
    chosen = hybrid.with_fallback(narrow, wide, spark.createDataFrame([(1, True), (2, True), (3, False)], "query int, filtered boolean"))
    assert sorted(map(tuple, chosen[0].collect())) == [(1, "y", 2), (1, "z", 1), (2, "a", 1), (2, "b", 2)]
    fused = spark.createDataFrame([(1, "c::del2", 1), (1, "c::del1", 2), (1, "d", 3), (1, "gone::del1", 4)], "query int, doc string, fused_rank int")
    known = spark.createDataFrame([("c",), ("d",)], "doc string")
    assert [(r["base"], r["rank"]) for r in hybrid.best_of_base(fused, known, 5).orderBy("rank").collect()] == [("c", 1), ("d", 2)]


def test_bases_are_ranked_in_one_shuffle(spark, tmp_path, monkeypatch):
    """A base is taken where its first part comes, whole ids that look like parts stay; the hits move once for both windows, and the parts' texts aren't stored."""
    from ledgerlake.operators import bm25 as searched
    from ledgerlake.plans import core

    hits = [(q, doc, 1.0 - k / 9, k + 1) for q in range(3) for k, doc in enumerate(["c::del2", "e::del1", "c", "gone", "e", "c::del1::del1", "d"])]
    known = spark.createDataFrame([(x,) for x in ("c", "d", "e", "e::del1")], "doc string")
    best = hybrid.best_of_base(spark.createDataFrame(hits, "query int, doc string, score double, fused_rank int"), known, 3)
    assert best._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(query#") == 1
    assert sorted((r["query"], r["rank"], r["base"], r["doc"]) for r in best.collect()) == [(q, *x) for q in range(3) for x in ((1, "c", "c::del2"), (2, "e::del1", "e::del1"), (3, "e", "e"))]
    stored = []
    monkeypatch.setattr(core, "durable_table", lambda df, name: stored.append(name) or df)
    monkeypatch.setattr(searched, "durable_table", lambda df, name, keep=searched.durable_table: stored.append(name) or keep(df, name))
    core.base_results(spark, "/root/testdata/sf0.001")
    assert stored == ["index", "terms", "slices"]


def test_prompts_and_answers(spark):
    questions = spark.createDataFrame([(1, "Vad var nettoomsättningen 2023? "), (2, "Vem är störst?")], "query_id int, text string")
    results = spark.createDataFrame([(1, 1, "v.pdf", [62, 63], "resultaträkning", " Volvo: nettoomsättningen var 5 (2023). "), (1, 2, "w.pdf", [], None, "Annat.")], "query_id int, rank int, document string, pages array<int>, section string, text string")
    rows = {r["query_id"]: r for r in answer.prompts(questions, results).collect()}
    assert rows[1]["context"] == "[1] (v.pdf, s. 62, 63) | resultaträkning\nVolvo: nettoomsättningen var 5 (2023).\n\n[2] (w.pdf, sida okänd)\nAnnat."
    assert rows[2]["user"] == "KÄLLUTDRAG\n(inga källutdrag hittades)\n\nFRÅGA\nVem är störst?"
    got = {r["query_id"]: r for r in answer.answers(answer.prompts(questions, results), answer.provider("extractive")).collect()}
    assert "(v.pdf, s. 62, 63)" in got[1]["answer"] and not got[1]["is_no_answer"] and got[2]["is_no_answer"]
    with pytest.raises(ValueError, match="unknown provider"):
        answer.provider("x")


def test_recall(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 4), (3, None)], "query int, rank int")
    assert tuple(evaluate.recall_mrr(ranks).first()) == (3, 0.333333, 0.333333, 0.666667, 0.416667)


def test_lift_and_summary(spark):
    trace = spark.createDataFrame([(1, "a", 1, 20, 0.5, 1), (1, "b", None, 3, 0.25, 2), (1, "c", 2, 2, 0.2, 3), (1, "d", 11, None, 0.1, 4)], "query int, doc string, vector_rank int, bm25_rank int, rrf_score double, fused_rank int")
    lifted = answer.ranking_lift(trace)
    assert [(r.doc, r.bar, r.lift) for r in lifted.orderBy("fused_rank").collect()] == [("a", 1.0, "vector"), ("b", 0.5, "text"), ("c", 0.4, None), ("d", 0.2, None)]
    assert tuple(answer.trace_summary(lifted).first()) == (1, 4, 0.5, 1, 1)
    assert answer.trace_summary(lifted.limit(0)).count() == 0


def test_question_limits(spark):
    asked = [(k, f"fråga {k}", "s" if k < 12 else None, k) for k in range(14)] + [(20, " ", "s", 0), (21, "x" * 301, "s", 0), (22, None, "s", 0)]
    df = spark.createDataFrame(asked, "query_id int, text string, session string, asked_at int")
    assert answer.valid_questions(df).count() == 14
    assert sorted(r.query_id for r in answer.valid_questions(df, session_col="session", order_col="asked_at").collect()) == [*range(10), 12, 13]


def test_progress(spark):
    from ledgerlake.operators.progress import Progress

    seen = []
    progress = Progress(seen.append)
    df = progress.step(progress.step(spark.range(10), "all").where("id < 4"), "some")
    assert progress.run("count", lambda: len(df.collect())) == 4
    assert progress.rows() == {"all": 10, "some": 4} and seen[0]["step"] == "count" and progress.total_ms() >= 0
