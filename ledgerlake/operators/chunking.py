"""Chunks of paged documents: sentences packed to size, tables and their rows as sentences.

All of it is column expressions and windows; texts stay in the JVM, but for those that exceed the bytes of a hosted record. Packing
is a fold over an ordered array (each step depends on the one before), everything else joins and groupings on the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import row_sentence, sentences, strip
from ..tables import union_all

#: Characters that a chunk aims at, at most has, and at least has; bytes of a hosted record.
TARGET, MOST, LEAST, BYTES = 1000, 1400, 30, 15_000


def split_oversized(unit: Column, most: int = MOST) -> Column:
    """A unit in pieces of at most `most` characters: whole lines packed together, a longer line cut into slices."""
    lines = F.filter(F.split(unit, "\n"), lambda x: strip(x) != "")
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"), F.lit(0).alias("n"))

    def step(acc: Column, line: Column) -> Column:
        size = F.length(line)
        flush = (acc["n"] > 0) & (acc["n"] + size + 1 > most)
        out = F.when(flush, F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"])
        cur = F.when(flush | (acc["n"] == 0), F.lit("")).otherwise(F.concat(acc["cur"], F.lit("\n")))
        n = F.when(flush, F.lit(0)).otherwise(acc["n"])
        slices = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / most).cast("int")), lambda k: F.substring(line, k * most + 1, F.lit(most)))
        return (
            F.when(size > most, F.struct(F.concat(out, slices).alias("out"), F.lit("").alias("cur"), F.lit(0).alias("n")))
            .otherwise(F.struct(out.alias("out"), F.concat(cur, line).alias("cur"), (n + size + 1).alias("n")))
        )

    packed = F.aggregate(lines, empty, step, lambda acc: F.when(acc["n"] > 0, F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"]))
    return F.when(F.length(unit) <= most, F.array(unit)).otherwise(packed)


def pack(units: Column, target: int = TARGET, most: int = MOST) -> Column:
    """Units joined by blanks: a chunk is closed before it would pass `most`, and once it has `target`."""
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"), F.lit(0).alias("n"))

    def step(acc: Column, unit: Column) -> Column:
        size = F.length(unit)
        flush = (acc["n"] > 0) & (acc["n"] + size + 1 > most)
        out = F.when(flush, F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"])
        cur = F.when(flush | (acc["n"] == 0), unit).otherwise(F.concat(acc["cur"], F.lit(" "), unit))
        n = F.when(flush, F.lit(0)).otherwise(acc["n"]) + size + 1
        return (
            F.when(n >= target, F.struct(F.concat(out, F.array(cur)).alias("out"), F.lit("").alias("cur"), F.lit(0).alias("n")))
            .otherwise(F.struct(out.alias("out"), cur.alias("cur"), n.alias("n")))
        )

    return F.aggregate(units, empty, step, lambda acc: F.when(acc["n"] > 0, F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"]))


def chunk_text(text: Column, target: int = TARGET, most: int = MOST) -> Column:
    """The chunks of a text; null gives null, an empty text none."""
    return pack(F.flatten(F.transform(sentences(text), lambda s: split_oversized(s, most))), target, most)


def split_bytes(text: str, most: int) -> list[str]:
    """A text cut after ". " to parts of at most `most` bytes, as far as its pieces allow."""
    parts, held, size = [], [], 0
    units = text.split(". ")
    for piece in [*(u + ". " for u in units[:-1]), units[-1]]:
        more = len(piece.encode("utf-8", "surrogatepass"))
        if size and size + more > most:
            parts.append("".join(held))
            held, size = [], 0
        held.append(piece)
        size += more
    return [*parts, "".join(held)] if size else parts


def byte_split(chunks: DataFrame, most: int = BYTES) -> DataFrame:
    """`chunks` with texts beyond `most` bytes split after ". " into parts `id::del1`, `id::del2` and so on; others as they are, and without a look at their pieces."""
    kinds = chunks.dtypes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, texts = [], [], []
            for row, (name, text) in enumerate(zip(batch["chunk_id"].to_pylist(), batch["text"].to_pylist(), strict=True)):
                for k, part in enumerate(split_bytes(text, most), 1):
                    rows.append(row)
                    ids.append(None if name is None else f"{name}::del{k}")
                    texts.append(part)
            new = {"chunk_id": pa.array(ids, pa.string()), "text": pa.array(texts, pa.string())}
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([new.get(c, kept[c]) for c, _ in kinds], names=[c for c, _ in kinds])

    fits = F.col("text").isNull() | (F.octet_length("text") <= most)
    schema = ", ".join(f"`{c}` {'string' if c in ('chunk_id', 'text') else kind}" for c, kind in kinds)
    return union_all(chunks.where(fits).withColumn("chunk_id", F.col("chunk_id").cast("string")), chunks.where(~fits).mapInArrow(run, schema))


def latest(df: DataFrame, keys: list[str], when: str, tie: str) -> DataFrame:
    """Of rows with equal keys the one that came last; rows delivered again replace the earlier ones."""
    order = Window.partitionBy(*keys).orderBy(F.col(when).desc_nulls_last(), F.col(tie).desc())
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def statement_pages(filings: DataFrame) -> DataFrame:
    """One row per entry of a filing's page lists: document, section, `place` in the list, page. Repeated pages stay."""
    lists = filings.select("document", F.explode("statement_pages").alias("section", "pages"))
    return lists.select("document", "section", F.posexplode("pages").alias("place", "page"))


def text_pages(pages: DataFrame, listed: DataFrame, least: int = LEAST) -> DataFrame:
    """Pages that no statement lists and that hold more than a running header."""
    taken = listed.select("document", F.col("page").alias("page_number")).distinct()
    return pages.join(taken, ["document", "page_number"], "left_anti").where(F.length(strip(F.col("text"))) >= least)


def text_chunks(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Chunks of prose pages: document, page_number, `piece` (from 0, counted before repeats are dropped), text.

    Of texts that a document repeats word by word the first is kept. Groups are keyed by (document,
    text), so a document of any size spreads over tasks.
    """
    pieces = F.filter(chunk_text(strip(F.col("text"))), lambda p: F.length(strip(p)) >= least)
    rows = pages.select("document", "page_number", F.posexplode(pieces).alias("piece", "text")).withColumn("_same", strip(F.col("text")))
    first = Window.partitionBy("document", "_same").orderBy("page_number", "piece")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_same")


def statement_rows(rows: DataFrame, filings: DataFrame, companies: DataFrame) -> DataFrame:
    """Rows of the pages that a filing lists: a page listed twice gives its rows twice, under two statements to both.

    Adds section, the company's display name (else its name capitalised), fiscal year and `place_no`,
    the row's place within (document, section) by page list and row id. Null labels have no sentence and are left out.
    """
    from ..functions.text import capitalised

    heads = filings.select("document", "company", "fiscal_year").join(companies.select("company", "display_name"), "company", "left")
    heads = heads.select("document", F.coalesce("display_name", capitalised(F.col("company"))).alias("display"), F.col("company").alias("filing_company"), "fiscal_year")
    some = rows.where("label is not null").select("row_id", "document", "page", "label", "row_values", "row_columns")
    joined = statement_pages(filings).join(some, ["document", "page"]).join(heads, "document")
    order = Window.partitionBy("document", "section").orderBy("place", "row_id")
    return joined.withColumn("place_no", F.row_number().over(order) - 1)


def fact_chunks(rows: DataFrame) -> DataFrame:
    """One chunk per row of statement_rows, with the row's own page."""
    text = row_sentence(F.col("display"), F.col("section"), F.col("fiscal_year"), F.col("label"), F.col("row_columns"), F.col("row_values"))
    return rows.select(F.concat_ws("::", "document", "section", F.concat(F.lit("rad"), F.col("place_no").cast("string"))).alias("chunk_id"), "document", F.col("filing_company").alias("company"), "fiscal_year", F.lit("fact").alias("chunk_type"), "section", F.array("page").alias("pages"), text.alias("text"))


def table_chunks(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """One chunk per (document, section): an opening and the sentences of its rows in order; its pages sorted, repeats kept."""
    text = row_sentence(F.col("display"), F.col("section"), F.col("fiscal_year"), F.col("label"), F.col("row_columns"), F.col("row_values"))
    whole = rows.groupBy("document", "section", "display", F.col("filing_company").alias("company"), "fiscal_year").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place_no", text.alias("t")))), lambda x: x.t), " ").alias("_body"))
    pages = listed.groupBy("document", "section").agg(F.sort_array(F.collect_list("page")).alias("pages"))
    opening = F.concat("display", F.lit(" "), "section", F.lit(" "), "fiscal_year", F.lit("."))
    return whole.join(pages, ["document", "section"]).select(F.concat_ws("::", "document", "section").alias("chunk_id"), "document", "company", "fiscal_year", F.lit("table").alias("chunk_type"), "section", "pages", F.concat(opening, F.lit(" "), "_body").alias("text"))
