"""Files in and out: processed documents and chunks as JSON, the index as Parquet, the flat export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import base_id, tokens
from ..operators import bm25, vectors
from ..operators.chunking import byte_split


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    """Processed documents, one JSON object a file; company and year from the file's name where the object lacks them.

    The file's path is kept as `source`, the order of a corpus.
    """
    docs = spark.read.schema(schemas.PROCESSED).json(path, multiLine=True).withColumn("source", F.input_file_name())
    stem = F.regexp_extract("source", r"([^/]+?)(?:\.pdf)?\.json$", 1)
    named = F.split(stem, "_", 2)
    return docs.withColumns({"company": F.coalesce("company", named[0]), "fiscal_year": F.coalesce("fiscal_year", F.get(named, F.lit(1)))})


def pages_of(processed: DataFrame) -> DataFrame:
    """One row per page of processed documents."""
    return processed.select("document", "company", "fiscal_year", F.explode("pages").alias("p")).select("document", "company", "fiscal_year", F.col("p.page").alias("page_number"), "p.text", "p.statement_type", "p.table_rows")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk files: a JSON array each."""
    return spark.read.schema(schemas.CHUNK).json(path, multiLine=True)


def write_json(df: DataFrame, path: str, by: str = "document") -> None:
    """One folder a document, rewritten; rows of a document meet in one file."""
    df.repartition(by).write.mode("overwrite").partitionBy(by).json(path)


def build_index(chunks: DataFrame, vectors: DataFrame, path: str) -> None:
    """Vectors and postings of chunks, rewritten whole; parted by company and year, so that filters prune files.

    vectors: chunk_id and vector (of unit length). Chunks without text have no postings, without a vector no vector row.
    """
    keyed = chunks.select("chunk_id", "company", "fiscal_year", "text")
    keyed.join(vectors, "chunk_id").select("chunk_id", "company", "fiscal_year", "vector").write.mode("overwrite").partitionBy("company", "fiscal_year").parquet(f"{path}/vectors")
    bm25.postings(keyed, "chunk_id", "text").join(keyed.select(F.col("chunk_id").alias("doc"), "company", "fiscal_year"), "doc").write.mode("overwrite").partitionBy("company", "fiscal_year").parquet(f"{path}/postings")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vectors and postings."""
    return spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/postings")


def search_index(spark: SparkSession, path: str, queries: DataFrame, documents: int, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """The k best chunks of each query by the stored vectors (query, doc, distance, rank) and by the stored postings (query, doc, score, rank).

    queries: query_id, text, vector and, to search within filters, `companies` and `years` (null or empty: any); filters reach the folders that the index is parted by.
    `documents` is the number of chunks indexed.
    """
    stored_vectors, stored = read_index(spark, path)
    limits = tuple((column, array) for column, array in (("company", "companies"), ("fiscal_year", "years")) if array in queries.columns)
    rows = stored_vectors.withColumn("_n", F.xxhash64("chunk_id"))
    asked = queries.withColumn("_q", F.xxhash64("query_id"))
    near = vectors.nearest(rows, asked, k, id_col="_n", query_id="_q", within=list(limits))
    named = near.join(rows.select("chunk_id", F.col("_n").alias("doc")), "doc").join(asked.select("query_id", F.col("_q").alias("query")), "query")
    by_vector = named.select(F.col("query_id").alias("query"), F.col("chunk_id").alias("doc"), F.round(1 - F.col("similarity"), 6).alias("distance"), "rank")
    counted = stored.groupBy("doc", "dl", "company", "fiscal_year").agg(F.collect_list(F.struct("term", "tf")).alias("terms"))
    return by_vector, bm25.search(bm25.index_of(counted, documents), queries, k, within=limits)


def split_report(parts: DataFrame) -> DataFrame:
    """One row on the parts of a hosted copy: chunks, how many of them had to be split, and parts."""
    sizes = parts.groupBy(base_id(F.col("chunk_id")).alias("base")).agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("chunks"), F.count_if(F.col("n") > 1).alias("split"), F.coalesce(F.sum("n"), F.lit(0)).alias("parts"))


def flat_export(chunks: DataFrame) -> DataFrame:
    """Chunks as a vector store keeps them: pages as one string, a missing section as an empty one."""
    return chunks.select(F.col("chunk_id").alias("id"), "text", "document", "company", "fiscal_year", "chunk_type", F.coalesce("section", F.lit("")).alias("section"), F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


def from_export(flat: DataFrame) -> DataFrame:
    """The chunks of a flat export."""
    pages = F.transform(F.filter(F.split("pages", ","), lambda p: p != ""), lambda p: p.cast("int"))
    return flat.select(F.col("id").alias("chunk_id"), "document", "company", "fiscal_year", "chunk_type", F.when(F.col("section") != "", F.col("section")).alias("section"), F.coalesce(pages, F.array().cast("array<int>")).alias("pages"), "text")


def hosted_copy(chunks: DataFrame) -> DataFrame:
    """The export with texts split to the size that a hosted store takes."""
    return flat_export(byte_split(chunks))


def document_overview(filings: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per document: company, year, pages stated and pages held, words held."""
    held = pages.groupBy("document").agg(F.count_distinct("page_number").alias("pages_held"), F.sum(F.coalesce(F.size(tokens(F.col("text"))), F.lit(0))).cast("long").alias("words"))
    return filings.select("document", "company", "fiscal_year", "n_pages").join(held, "document", "left")
