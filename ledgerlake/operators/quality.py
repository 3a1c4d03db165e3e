"""Checks that return violations; no rows means no fault."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def row_violations(rows: DataFrame, least: int = 2, most: int = 120) -> DataFrame:
    """row_id and `violation` of table rows: label length, a label without letters, no value, another number of values than columns, a value that is no number."""
    number = r"^[−\-–]?\d[\d\s.,]*$"
    values = F.filter("row_values", lambda v: v.isNotNull())
    checks = [
        ("label length", F.col("label").isNull() | ~F.length("label").between(least, most)),
        ("label without letters", F.col("label").isNotNull() & ~F.col("label").rlike(r"\p{L}")),
        ("no value", F.coalesce(F.size(values), F.lit(0)) <= 0),
        ("arity", F.col("row_values").isNotNull() & F.col("row_columns").isNotNull() & (F.size("row_values") != F.size("row_columns"))),
        ("not a number", F.exists(values, lambda v: ~v.rlike(number))),
    ]
    found = F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in checks)), lambda x: x.isNotNull())
    return rows.select("row_id", F.explode(found).alias("violation"))


def repeated_texts(chunks: DataFrame) -> DataFrame:
    """Texts that a document's chunks of one type hold more than once: document, chunk_type, text hash, copies."""
    return chunks.where("text is not null").groupBy("document", "chunk_type", F.md5(strip(F.col("text"))).alias("text_md5")).agg(F.count("*").alias("copies")).where("copies > 1")


def repeated_ids(chunks: DataFrame) -> DataFrame:
    """Chunk ids that occur more than once."""
    return chunks.groupBy("chunk_id").agg(F.count("*").alias("copies")).where("copies > 1")


def chunk_violations(chunks: DataFrame, most: int = 3000) -> DataFrame:
    """chunk_no and `violation`: section missing or superfluous, pages missing, a fact of several pages, a text too long."""
    pages = F.coalesce(F.size("pages"), F.lit(0))
    checks = [
        ("section", (F.col("chunk_type") == "text") != F.col("section").isNull()),
        ("no page", pages <= 0),
        ("fact pages", (F.col("chunk_type") == "fact") & (pages != 1)),
        ("text length", (F.col("chunk_type") == "text") & (F.length("text") > most)),
        ("no document", F.coalesce("document", F.lit("")) == ""),
    ]
    found = F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in checks)), lambda x: x.isNotNull())
    return chunks.select("chunk_no", F.explode(found).alias("violation"))
