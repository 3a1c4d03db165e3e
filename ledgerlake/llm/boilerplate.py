"""Lines repeated over the documents of one source, and their removal.

Method: duplicates are collapsed before anything is counted. Each line is reduced to what makes it
alike to others; equal (source, line, cluster) rows become one, where a cluster is a set of documents
that are copies of each other (of a filing's page: its extractions; of a web document: equal texts). A
line is boilerplate if it occurs in enough distinct clusters and, where asked for, on enough distinct
dates, so that an article published again and again isn't taken for it.

Nothing is gathered by source: the shuffle key is (source, line), after map-side combination, so one
source may hold any share of the rows. Lines travel as 128 bits of hash instead of their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_CLUSTERS = 6


def line_likeness(line: Column) -> Column:
    """A line in lower case, each run of white space one blank, trimmed, each run of the digits 0-9 one sign."""
    low = F.regexp_replace(F.lower(line), r"(?U)\s+", " ")
    return F.regexp_replace(F.trim(low), "[0-9]+", "0")


def lines_of(df: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """One row per line that isn't blank: the id, the columns to keep, `line_no` (from 1, blank lines counted) and `line`."""
    lines = df.select(id_col, *keep, F.posexplode(F.split(text_col, "\n")).alias("_pos", "line"))
    return lines.where(F.col("line").rlike(r"(?U)\S")).select(id_col, *keep, (F.col("_pos") + 1).alias("line_no"), "line")


def repeated_lines(df: DataFrame, id_col: str, text_col: str, source_col: str, cluster_col: str, date_col: str | None = None, min_clusters: int = MIN_CLUSTERS, min_dates: int = 1) -> DataFrame:
    """One row per line to remove: the id, `line_no` and, of its like within the source, `clusters`.

    Null and empty texts have no lines. Rows with a null source or cluster aren't judged, as nothing
    says where they belong. Repeated rows of an id are rows of their own; they count once.
    """
    keep = [c for c in dict.fromkeys([source_col, cluster_col, *([date_col] if date_col else [])]) if c != id_col]
    known = df.where(F.col(source_col).isNotNull() & F.col(cluster_col).isNotNull() & F.col(text_col).isNotNull())
    lines = lines_of(known, id_col, text_col, *keep).withColumn("_like", line_likeness(F.col("line")))
    lines = lines.withColumns({"_a": F.xxhash64("_like"), "_b": F.xxhash64(F.lit(1), F.reverse("_like"))}).drop("line", "_like")
    once = lines.select(F.col(source_col).alias("_source"), F.col(cluster_col).alias("_cluster"), "_a", "_b", *([F.to_date(date_col).alias("_date")] if date_col else [])).distinct()
    counted = once.groupBy("_source", "_a", "_b").agg(F.count_distinct("_cluster").alias("clusters"), *([F.count_distinct("_date").alias("_dates")] if date_col else []))
    often = counted.where((F.col("clusters") >= min_clusters) & (F.col("_dates") >= min_dates if date_col else F.lit(True)))
    found = lines.join(often, (lines[source_col] == often["_source"]) & (lines["_a"] == often["_a"]) & (lines["_b"] == often["_b"]))
    return found.select(lines[id_col], "line_no", "clusters")


def without_lines(df: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`df` with the found lines taken out of the text; every other line stays as it is. The id must be unique."""
    gone = found.groupBy(F.col(id_col).alias("_id")).agg(F.collect_set(F.col("line_no").cast("int")).alias("_gone"))
    joined = df.join(gone, df[id_col] == gone["_id"], "left")
    kept = F.filter(F.split(text_col, "\n"), lambda _, k: ~F.array_contains(F.col("_gone"), k + 1))
    text = F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn(text_col, text).select(*df.columns)
