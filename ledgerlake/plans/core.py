"""The registered queries of the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_id, capitalised, plain_integer, sentences
from ..operators import answer, bm25, chunking, evaluate, filters, hybrid, layout, quality, quantities, statements, vectors
from ..scratch import durable_table
from ..sources import files
from ..tables import spread, table, union_all
from .core_sql import SQL as SQL

#: Every row whose id is divisible by this is a query.
EACH = 20


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number of the financial rows in the common unit of its kind."""
    return quantities.quantities(spread(table(spark, sf_dir, "financial_rows")), table(spark, sf_dir, "page_texts"))


def p2_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number of the financial rows in base units, whatever its dimension."""
    return quantities.base_quantities(spread(table(spark, sf_dir, "financial_rows")), table(spark, sf_dir, "page_texts"))


# Questions and rankings


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id and text: the label, company and year of every row whose id is divisible by EACH."""
    rows = table(spark, sf_dir, "financial_rows").where((F.col("row_id") % EACH == 0) & F.col("label").isNotNull() & F.col("document").isNotNull())
    name = F.regexp_replace("document", r"_\d+\.pdf$", "")
    return rows.select(F.col("row_id").alias("query_id"), F.concat(F.col("label"), F.lit(" "), F.regexp_replace(name, "_", " ")).alias("text"), "document", "label")


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "chunks")).select(F.col("chunk_no").alias("doc"), "text", "company", "fiscal_year", "document", "chunk_type", "section", "pages")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best chunks of each question."""
    return bm25.search(bm25.build(_corpus(spark, sf_dir)), questions(spark, sf_dir), 10)


def bm25_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best fact chunks of each question; statistics of all chunks."""
    index = bm25.build(_corpus(spark, sf_dir), keep=("chunk_type",))
    return bm25.search(index, questions(spark, sf_dir), 10, allowed=F.col("chunk_type") == "fact")


def idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency and weight of every term of the chunks."""
    chunks = spread(table(spark, sf_dir, "chunks"))
    weights = bm25.term_weights(bm25.postings(chunks, "chunk_no", "text"), chunks.count())
    return weights.select("term", "df", F.round("idf", 6).alias("idf"))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest embeddings of every embedding whose id is divisible by EACH."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))
    return vectors.nearest(rows, rows.where(F.col("doc") % EACH == 0).withColumnRenamed("doc", "query"), 10)


def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among embeddings with the query's label."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"), "label")
    return vectors.nearest(rows, rows.where(F.col("doc") % EACH == 0).withColumnRenamed("doc", "query"), 10, same=("label", "label"))


def _two_rankings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, bm25.Index, DataFrame]:
    """Documents, embeddings of documents, the index of their texts, and the queries: every document whose id is divisible by EACH, with its text and, if it has one, its embedding."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text", "company")
    held = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector")).join(docs.select("doc", "company"), "doc", "left")
    asked = docs.where(F.col("doc") % EACH == 0).join(held.select("doc", "vector"), "doc", "left").withColumnRenamed("doc", "query")
    return docs, held, bm25.build(spread(docs), keep=("company",)), durable_table(asked, "asked")


def _everywhere(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Embeddings ranked by vector and documents by text, to the usual depth."""
    _, held, index, asked = _two_rankings(spark, sf_dir)
    return [vectors.nearest(held, asked, hybrid.DEPTH), bm25.search(index, asked, hybrid.DEPTH, "query")]


def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rankings fused."""
    return hybrid.fuse(_everywhere(spark, sf_dir)).where("fused_rank <= 10")


def hybrid_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused ranking with the rank that each method gave."""
    return hybrid.trace(*_everywhere(spark, sf_dir))


def hybrid_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rankings among the documents of the query's company; among all where that leaves fewer than three hits or names none."""
    _, held, index, asked = _two_rankings(spark, sf_dir)

    def rank(some: DataFrame, narrow: bool) -> list[DataFrame]:
        same = ("company", "company") if narrow else None
        return [vectors.nearest(held, some, hybrid.DEPTH, same=same), bm25.search(index, some, hybrid.DEPTH, "query", same=same)]

    chosen = hybrid.search_with_fallback(rank, asked.withColumn("filtered", F.col("company").isNotNull()))
    return hybrid.trace(*chosen).where("fused_rank <= 10").select("query", "doc", "vector_rank", "bm25_rank", "rrf_score", "fused_rank")


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions over chunks from end to end: filters, expansion, hashed vectors and text, fallback, fusion."""
    corpus = _corpus(spark, sf_dir)
    parsed = filters.parse_filters(questions(spark, sf_dir), table(spark, sf_dir, "company_years")).withColumn("text", filters.expand_query(F.col("text")))
    some = parsed.select(F.col("query_id").alias("query"), "text", "company", "years", (F.col("company").isNotNull() | (F.size("years") > 0)).alias("filtered"))
    hashed = durable_table(vectors.embed(corpus, "doc", "text", ["company", "fiscal_year"], vectors.HashingEmbedder(), "passage: "), "vectors")
    embedded = vectors.embed(some, "query", "text", ["company", "years", "filtered"], vectors.HashingEmbedder(), "query: ")
    asked = durable_table(embedded.join(some.select("query", "text"), "query"), "asked")
    index = bm25.build(corpus, keep=("company", "fiscal_year"))

    def rank(these: DataFrame, narrow: bool) -> list[DataFrame]:
        if not narrow:
            return [vectors.nearest(hashed, these, hybrid.DEPTH), bm25.search(index, these, hybrid.DEPTH, "query")]
        years, own = (("fiscal_year", "years"),), ("company", "company")
        named, unnamed = these.where("company is not null"), these.where("company is null")
        return [
            union_all(vectors.nearest(hashed, named, hybrid.DEPTH, same=own, within=years), vectors.nearest(hashed, unnamed, hybrid.DEPTH, within=years)),
            union_all(bm25.search(index, named, hybrid.DEPTH, "query", same=own, within=years), bm25.search(index, unnamed, hybrid.DEPTH, "query", within=years)),
        ]

    return hybrid.trace(*hybrid.search_with_fallback(rank, asked))


def hybrid_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question's eight best chunks."""
    return _hybrid(spark, sf_dir).where("fused_rank <= 8").select("query", "doc", "vector_rank", "bm25_rank", "rrf_score", "fused_rank")


def ranking_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question's eight best chunks with the method that lifted them."""
    return answer.ranking_lift(hybrid_questions(spark, sf_dir))


def trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question's ranking in one row."""
    return answer.trace_summary(ranking_lift(spark, sf_dir))


def vector_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest chunks of each question by vector alone, with what a result shows and its distance."""
    corpus = _corpus(spark, sf_dir)
    near = vectors.nearest(vectors.embed(corpus, "doc", "text", [], vectors.HashingEmbedder(), "passage: "), vectors.embed(questions(spark, sf_dir), "query_id", "text", [], vectors.HashingEmbedder(), "query: "), 5, query_id="query_id")
    return near.join(corpus, "doc").select("query", "rank", "doc", "document", "pages", "section", "chunk_type", F.round(1 - F.col("similarity"), 6).alias("distance"))


def base_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents of each question, searched by the parts that a hosted store takes."""
    parts = byte_split(spark, sf_dir).select(F.col("chunk_id").alias("doc"), "text")  # read and split again where they are counted; the texts aren't stored
    found = bm25.search(bm25.build(parts), questions(spark, sf_dir), hybrid.DEPTH)
    known = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc"))
    return hybrid.best_of_base(found.withColumnRenamed("rank", "fused_rank"), known, 5).select("query", "base", "score", "rank")


def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents a hosted store takes whole."""
    return files.split_report(byte_split(spark, sf_dir))


def evaluation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question with the answer given, whether it found nothing, and the outcome: right if it states the row's first value, partial if it only says something."""
    first = F.get(F.filter("row_values", lambda v: v.isNotNull()), 0)  # null where a row has no value
    expected = table(spark, sf_dir, "financial_rows").select(F.col("row_id").alias("query_id"), first.alias("expected"))
    judged = answers(spark, sf_dir).join(questions(spark, sf_dir).join(expected, "query_id").select("query_id", "text", "expected"), "query_id")
    outcome = F.when(F.col("is_no_answer"), "wrong").when(F.coalesce(F.contains("answer", F.col("expected")), F.lit(False)), "right").otherwise("partial")
    return judged.select("query_id", F.col("text").alias("question"), "expected", "answer", "is_no_answer", outcome.alias("outcome"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extractive provider's answer to every question from its eight best chunks; the provider stands in for a language model."""
    found = hybrid_questions(spark, sf_dir).withColumnRenamed("fused_rank", "rank").join(_corpus(spark, sf_dir), "doc").withColumnRenamed("query", "query_id")
    prompted = answer.prompts(questions(spark, sf_dir), found)
    return answer.answers(prompted, answer.provider("extractive"))


def question_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context that each question's three best chunks give."""
    found = bm25_topk(spark, sf_dir).where("rank <= 3").join(_corpus(spark, sf_dir), "doc")
    return answer.contexts(found, "query")


def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages that each question's best chunks come from."""
    return answer.sources(bm25_topk(spark, sf_dir).join(_corpus(spark, sf_dir), "doc"), "query")


def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's best chunks as lines for reading."""
    found = bm25_topk(spark, sf_dir).join(_corpus(spark, sf_dir), "doc")
    return found.select("query", "rank", answer.result_line(F.col("rank"), F.col("document"), F.col("pages"), F.col("chunk_type"), F.col("section"), F.lit(float("nan")), F.col("text")).alias("line"))


def no_answer_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document's text begins as an answer that found nothing."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", answer.is_no_answer(F.col("text")).alias("is_no_answer"))


def _ranks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    asked = questions(spark, sf_dir)
    facts = _corpus(spark, sf_dir).where("chunk_type = 'fact'").select("doc", "document", F.col("text").alias("fact"))
    right = asked.select(F.col("query_id").alias("query"), "document", "label").join(facts, "document").where(F.col("fact").contains(F.concat(F.lit(": "), F.col("label"), F.lit(" var "))))
    return evaluate.best_ranks(bm25_filtered_topk(spark, sf_dir), right.select("query", "doc").distinct(), right.select("query")), asked


def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and mean reciprocal rank of the filtered search, where a fact of the same document states the label asked for."""
    return evaluate.recall_mrr(_ranks(spark, sf_dir)[0])


def outcome_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions on amounts per share and on other items, by how well they are answered."""
    ranks, asked = _ranks(spark, sf_dir)
    kind = F.when(F.col("label").contains("per aktie"), "per aktie").otherwise("post")
    judged = ranks.join(asked.select(F.col("query_id").alias("query"), kind.alias("type")), "query")
    outcome = F.when(F.col("rank") == 1, "right").when(F.col("rank").isNotNull(), "partial").otherwise("wrong")
    return evaluate.outcomes_by_type(judged.select("type", outcome.alias("outcome")), ["right", "partial", "wrong"])


# Filters


def filing_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id and text: five ways to ask about each filing's company and year."""
    filings = table(spark, sf_dir, "filings").where("company is not null and fiscal_year is not null").select("document", "company", "fiscal_year").distinct()
    year = F.substring("fiscal_year", 1, 4)
    forms = [
        F.concat(F.lit("Vad var "), capitalised(F.col("company")), F.lit("s nettoomsättning "), F.col("fiscal_year"), F.lit("?")),
        F.concat(F.lit("Hur har soliditeten i "), F.col("company"), F.lit(" utvecklats "), (year.cast("int") - 1).cast("string"), F.lit("-"), year, F.lit("?")),
        F.concat(capitalised(F.col("company")), F.lit("koncernens rörelsemarginal och ROE "), year),
        F.concat(F.lit("Summa tillgångar "), F.regexp_replace("fiscal_year", "-", "/"), F.lit(" hos "), F.upper("company")),
        F.concat(F.lit("Fritt kassaflöde från "), year, F.lit(" till "), (year.cast("int") + 1).cast("string"), F.lit(", alla bolag")),
    ]
    return filings.select("document", F.posexplode(F.array(*forms)).alias("form", "text")).select(F.concat_ws("#", "document", F.col("form").cast("string")).alias("query_id"), "text")


def parse_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company and years of every question about a filing."""
    return filters.parse_filters(filing_questions(spark, sf_dir), table(spark, sf_dir, "company_years"))


def expand_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question about a filing with the items of the ratios it names."""
    return filing_questions(spark, sf_dir).select("query_id", filters.expand_query(F.col("text")).alias("text"))


def company_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The years that each company has filings of."""
    return table(spark, sf_dir, "filings").where("company is not null").groupBy("company").agg(F.sort_array(F.collect_set("fiscal_year")).alias("fiscal_years"))


# Chunks


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every document by the plain rule."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(sentences(F.col("text"))).alias("seq", "sentence"))


def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sentences packed to chunks."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(chunking.chunk_text(F.col("text"))).alias("seq", "piece"))


def oversize_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one unit, split by lines and size."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(chunking.split_oversized(F.col("text"))).alias("seq", "piece"))


def byte_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document split to the bytes that a hosted store takes."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    return chunking.byte_split(spread(docs))


def _latest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.latest(table(spark, sf_dir, "page_texts"), ["document", "page_number"], "extracted_at", "page_id")


def _latest_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.latest(table(spark, sf_dir, "filings"), ["document"], "received_at", "company")


def latest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last extraction of every page."""
    return _latest_pages(spark, sf_dir).select("document", "page_number", "page_id")


def text_pages_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose pages: listed by no statement and not nearly empty."""
    return chunking.text_pages(_latest_pages(spark, sf_dir), chunking.statement_pages(_latest_filings(spark, sf_dir))).select("document", "page_number", "page_id")


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of prose pages without the texts that a document repeats."""
    return chunking.text_chunks(chunking.text_pages(_latest_pages(spark, sf_dir), chunking.statement_pages(_latest_filings(spark, sf_dir))))


def _statement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.statement_rows(table(spark, sf_dir, "financial_rows"), _latest_filings(spark, sf_dir), table(spark, sf_dir, "company_years"))


def fact_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk for each row of a statement."""
    return chunking.fact_chunks(_statement_rows(spark, sf_dir))


def table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk for each statement."""
    return chunking.table_chunks(_statement_rows(spark, sf_dir), chunking.statement_pages(_latest_filings(spark, sf_dir)))


def all_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of every document: tables, facts and texts."""
    heads = _latest_filings(spark, sf_dir).select("document", "company", "fiscal_year")
    texts = text_chunks(spark, sf_dir).join(heads, "document").select(
        F.concat(F.col("document"), F.lit("::p"), F.col("page_number").cast("string"), F.lit("::"), F.col("piece").cast("string")).alias("chunk_id"),
        "document", "company", "fiscal_year", F.lit("text").alias("chunk_type"), F.lit(None).cast("string").alias("section"), F.array("page_number").alias("pages"), "text",
    )
    return union_all(table_chunks(spark, sf_dir), fact_chunks(spark, sf_dir), texts)


# Statements, quality, export


def locate_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading lines of statements at the level of the filing."""
    levels = _latest_filings(spark, sf_dir).select("document", "statement_level")
    return statements.locate_headings(spread(table(spark, sf_dir, "page_texts")).join(levels, "document", "left"), F.coalesce("statement_level", F.lit("koncern")))


def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its statement."""
    return statements.page_sections(table(spark, sf_dir, "page_texts"), chunking.statement_pages(_latest_filings(spark, sf_dir)))


def balance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether balance sheets balance."""
    return statements.balance_check(table(spark, sf_dir, "financial_rows"))


def plain_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values printed as whole numbers."""
    values = table(spark, sf_dir, "financial_rows").select("row_id", F.posexplode("row_values").alias("place", "value"))
    return values.select("row_id", "place", plain_integer(F.col("value")).alias("number")).where("number is not null")


def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios of each document and column from quantities in common units."""
    return statements.ratios(table(spark, sf_dir, "financial_rows"), p2_found(spark, sf_dir))


def yoy_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of each item against the period before."""
    return statements.year_on_year(table(spark, sf_dir, "financial_rows"), p2_found(spark, sf_dir))


def row_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.row_violations(table(spark, sf_dir, "financial_rows"))


def chunk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.chunk_violations(table(spark, sf_dir, "chunks"))


def repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repeated_ids(table(spark, sf_dir, "chunks"))


def repeated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repeated_texts(table(spark, sf_dir, "chunks"))


def metadata_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as a vector store keeps them."""
    return files.flat_export(table(spark, sf_dir, "chunks"))


def metadata_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export read back."""
    return files.from_export(metadata_export(spark, sf_dir))


def document_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.document_overview(_latest_filings(spark, sf_dir), table(spark, sf_dir, "page_texts"))


def base_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of split documents and the ids they go back to."""
    return byte_split(spark, sf_dir).select("chunk_id", base_id(F.col("chunk_id")).alias("base"))


# Layout


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with places from order lines: an order is a page; a part's number, size and supplier place the word."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    x0 = (F.col("l_partkey") * 7 % 560).cast("double")
    top = (F.col("l_suppkey") % 40 * 1.25).cast("double")
    order = ((F.col("l_linenumber") * 100_000 + F.col("l_partkey")) * 1000 + F.col("l_quantity")).cast("long")
    return lines.select(F.lit("orders").alias("document"), F.col("l_orderkey").alias("page"), order.alias("ord"), F.col("p_name").alias("text"), x0.alias("x0"), (x0 + F.col("l_quantity")).alias("x1"), top.alias("top"), (top + 10).alias("bottom"))


def line_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.line_groups(_boxes(spark, sf_dir)).select("page", "ord", "line")


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of each page, all its words taken for one line."""
    return layout.phrases(_boxes(spark, sf_dir).withColumn("line", F.lit(0))).select("page", "phrase", "text", "x0", "x1")


def year_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of words that hold a year; the year of shipping stands for the text."""
    lines = table(spark, sf_dir, "lineitem")
    x0 = (F.col("l_partkey") * 7 % 560).cast("double")
    words = lines.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("ord"), F.date_format("l_shipdate", "yyyy").alias("text"), x0.alias("x0"), (x0 + 24).alias("x1"))
    return layout.year_clusters(words, ["page"]).select("page", "ord", "cluster")


def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.merged_intervals(_boxes(spark, sf_dir).select("page", "x0", "x1"), ["page"])


def gutter_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    return layout.gutters(boxes, boxes.select("document", "page", F.lit(600.0).alias("page_width")).distinct()).select("page", "gutter")


def column_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of words read column by column."""
    boxes = _boxes(spark, sf_dir)
    return layout.column_text(boxes, boxes.select("document", "page", F.lit(600.0).alias("page_width")).distinct())


def extract_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table rows of every page, from words placed by the page's own text."""
    return layout.extract_rows(layout.words_of_text(_latest_pages(spark, sf_dir)))


def number_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed values as words, five points a character, and the numbers that they are together."""
    values = table(spark, sf_dir, "financial_rows").select("row_id", F.posexplode("row_values").alias("place", "value"))
    words = values.withColumn("_w", F.split("value", " ")).select("row_id", "place", "_w", F.posexplode("_w").alias("ord", "text"))
    x0 = 5.0 * (F.length(F.array_join(F.slice("_w", 1, F.col("ord")), " ")) + (F.col("ord") > 0).cast("int"))
    placed = words.withColumn("x0", x0).withColumn("x1", F.col("x0") + 5.0 * F.length("text"))
    return layout.number_merge(placed, ["row_id", "place"]).select("row_id", "place", "token", "text", "kind")


def column_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each order on five columns."""
    numbers = _boxes(spark, sf_dir).groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("x0", "ord", "text"))), lambda w: F.struct(w["x0"].alias("at"), w["text"].alias("text"))).alias("n"))
    centres = F.array(*(F.lit(100.0 * k) for k in range(1, 6)))
    return numbers.select("page", layout.column_assign(F.col("n"), centres).alias("held"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        bm25_topk, p2_found, p2_base, bm25_filtered_topk, idf_table, vector_topk, vector_topk_filtered, rrf_fuse, hybrid_trace, hybrid_fallback, hybrid_questions, ranking_lift, trace_summary, vector_results, base_results, split_report, evaluation_run, answers, question_contexts, source_summary,
        result_lines, no_answer_flag, recall_mrr, outcome_pivot, parse_filters, expand_query, company_years, sentence_split, chunk_pack, oversize_split, byte_split, base_ids, latest_pages, text_pages_anti,
        text_chunks, fact_chunks, table_chunks, all_chunks, locate_headings, page_sections, balance_check, plain_integers, ratios, yoy_trend, row_violations, chunk_violations, repeated_ids, repeated_texts,
        metadata_export, metadata_import, document_overview, line_groups, phrases, year_clusters, interval_merge, gutter_detect, column_text, extract_rows, number_merge, column_assign,
    )
}
