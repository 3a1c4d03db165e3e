"""The registered queries of this subpackage, and SQL that DuckDB checks them by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import spread, table, union_all
from . import boilerplate, bpe, lookalike, neardup, packing, quality, sentences


def p1_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence unit of pages and chunks with its place."""
    pages = table(spark, sf_dir, "page_texts").select(F.lit("page_texts").alias("tab"), F.col("page_id").alias("rec_id"), "text")
    chunks = table(spark, sf_dir, "chunks").select(F.lit("chunks").alias("tab"), F.col("chunk_no").alias("rec_id"), "text")
    texts = spread(union_all(pages, chunks))
    return sentences.split_sentences(texts, ["tab", "rec_id"], "text")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each sentence unit of pages and chunks ends."""
    return p1_sentences(spark, sf_dir).select("tab", "rec_id", "end_pos")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractions of one page or row that differ in characters but not in look."""
    pages = lookalike.same_looking_texts(table(spark, sf_dir, "page_texts"), "page_id", ["document", "page_number"], "text")
    rows = lookalike.same_looking_values(table(spark, sf_dir, "financial_rows"), "row_id", ["document", "page", "label"], "row_values")
    return pages.select(F.lit("page_texts").alias("tab"), "id_a", "id_b").unionByName(rows.select(F.lit("financial_rows").alias("tab"), "id_a", "id_b"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page and row with the class of those of its page or row that look the same."""
    pages = lookalike.text_classes(table(spark, sf_dir, "page_texts"), "page_id", ["document", "page_number"], "text")
    rows = lookalike.value_classes(table(spark, sf_dir, "financial_rows"), "row_id", ["document", "page", "label"], "row_values")
    return union_all(pages.withColumn("tab", F.lit("page_texts")), rows.withColumn("tab", F.lit("financial_rows")))


def p3_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's text in one form."""
    return lookalike.one_form(table(spark, sf_dir, "page_texts"), "page_id", "text")


def p3_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's values in one form."""
    return lookalike.one_form_values(table(spark, sf_dir, "financial_rows"), "row_id", "row_values")


#: Least likeness of the pairs asked for, and of documents that count as copies.
LIKENESS, COPIES = 0.7, 0.8


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chunks = table(spark, sf_dir, "chunks").where("chunk_type = 'text'").select("chunk_no", "text")
    return neardup.near_duplicates(spread(chunks), "chunk_no", "text", LIKENESS)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of text chunks that are at least 0.7 alike."""
    pairs = neardup.all_pairs(*_near(spark, sf_dir))
    return pairs.select(F.col("first").alias("chunk_a"), F.col("second").alias("chunk_b"))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text chunk with its class of equal texts and the number of classes near to it."""
    return neardup.class_links(*_near(spark, sf_dir)).withColumnRenamed("id", "chunk_no")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that recur on at least six pages of a filing; a page extracted again counts once."""
    pages = table(spark, sf_dir, "page_texts")
    return boilerplate.repeated_lines(pages, "page_id", "text", "document", "page_number").select("page_id", F.col("line_no").cast("int").alias("line_no"))


def p5_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page without the lines of p5_found."""
    pages = table(spark, sf_dir, "page_texts")
    return boilerplate.without_lines(pages.select("page_id", "text"), p5_found(spark, sf_dir), "page_id", "text")


def p5_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines repeated within a source of the documents, over clusters of near copies and distinct dates."""
    docs = table(spark, sf_dir, "documents")
    clusters = neardup.components(*neardup.near_duplicates(spread(docs.select("doc_id", "text")), "doc_id", "text", COPIES))
    docs = docs.join(clusters.withColumnRenamed("id", "doc_id"), "doc_id")
    return boilerplate.repeated_lines(docs, "doc_id", "text", "source", "cluster", "crawled_at", min_dates=3)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_texts(spread(table(spark, sf_dir, "documents")))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a token, in containers of 2,048 tokens."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack_items(bpe.count_tokens(spread(docs.select("doc_id", "text"))), docs.count())


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Space left in each container."""
    return packing.container_report(p7_containers(spark, sf_dir))


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "common_words"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that aren't natural prose."""
    return _quality(spark, sf_dir).where("kind is not null").select("doc_id", "kind")


def p8_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document."""
    rounded = ["mean_word_length", "symbol_ratio", "line_end_share", "common_share", "list_share", "table_share", "junk_share"]
    return _quality(spark, sf_dir).withColumns({c: F.round(c, 6) for c in rounded})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found, "p1_sentences": p1_sentences, "p3_found": p3_found, "p3_classes": p3_classes, "p3_texts": p3_texts, "p3_values": p3_values,
    "p4_found": p4_found, "p4_classes": p4_classes, "p5_found": p5_found, "p5_pages": p5_pages, "p5_sources": p5_sources, "p6_ids": p6_ids, "p7_containers": p7_containers, "p7_report": p7_report,
    "p8_found": p8_found, "p8_stats": p8_stats,
}

_LIKE = r"regexp_replace(trim(regexp_replace(lower(line), '[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{85}\x0B]+', ' ', 'g')), '[0-9]+', '0', 'g')"
_LINES = f"""
lines AS (SELECT page_id, document, page_number, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM page_texts WHERE text IS NOT NULL),
likes AS (SELECT page_id, document, page_number, CAST(line_no AS INTEGER) AS line_no, line, {_LIKE} AS likeness FROM lines),
often AS (SELECT document, likeness FROM likes WHERE likeness <> '' AND document IS NOT NULL GROUP BY ALL HAVING count(DISTINCT page_number) >= 6)
"""

SQL: dict[str, str] = {
    "p5_found": f"WITH {_LINES} SELECT page_id, line_no FROM likes JOIN often USING (document, likeness) WHERE page_number IS NOT NULL",
    "p5_pages": f"""WITH {_LINES},
gone AS (SELECT page_id, line_no FROM likes JOIN often USING (document, likeness) WHERE page_number IS NOT NULL),
kept AS (SELECT page_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM likes ANTI JOIN gone USING (page_id, line_no) GROUP BY page_id)
SELECT p.page_id, CASE WHEN p.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text FROM page_texts p LEFT JOIN kept USING (page_id)""",
}
