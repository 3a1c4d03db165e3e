"""Exact nearest neighbours of a stated query set, in blocks, and a substitute embedding.

Queries are dealt into blocks and rows into slices, both of bounded size, within each value of the column that has
to be equal, if there is one; every block meets every slice of its value in a group of its own, as one matrix
product. A group passes on the k best rows of each of its queries, so what is ranked at the end is k rows for
each query and slice, not all pairs. Nothing is collected: the numbers of blocks and slices come from joins
on counts, and a value that holds any share of the rows is only cut into more slices.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors of a block and rows of a slice, about; and dimensions of the substitute embedding.
BLOCK, SLICE, DIMENSIONS = 1024, 8192, 64


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of unit length."""
    out = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _allowed(given: list, sets: list[frozenset]) -> np.ndarray:
    """Whether each query's set of values (empty: any) holds each row's value: queries x rows. A null value is in no set."""
    values, kinds = {v: n for n, v in enumerate(dict.fromkeys(given))}, {s: n for n, s in enumerate(dict.fromkeys(sets))}
    held = np.array([[not s or v in s for v in values] for s in kinds], bool)
    return held[np.array([kinds[s] for s in sets])][:, np.array([values[v] for v in given])]


def _best(queries: pa.Table, rows: pa.Table, k: int, limits: int) -> pa.Table:
    """The k most alike rows of each query of a group, ties by id: all that reach the k-th likeness, then ranked."""
    found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    if len(queries) and len(rows):
        ids, docs = queries["query"].to_numpy(), rows["doc"].to_numpy()
        like = np.round(_matrix(queries["vector"]) @ _matrix(rows["vector"]).T, 6)
        like[~np.isfinite(like)] = -np.inf
        for n in range(limits):
            like[~_allowed(rows[f"_w{n}"].to_pylist(), [frozenset(x or ()) for x in queries[f"_w{n}"].to_pylist()])] = -np.inf
        floor = np.partition(like, -k, axis=1)[:, -k] if k < len(docs) else np.full(len(ids), -np.inf)
        q, d = ((like >= floor[:, None]) & np.isfinite(like)).nonzero()
        s = like[q, d]
        order = np.lexsort((docs[d], -s, q))
        q, d, s = q[order], d[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < k
        found = [ids[q[keep]], docs[d[keep]], s[keep]]
    return pa.Table.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query", "doc", "similarity"])


def nearest(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "doc", vector_col: str = "vector", query_id: str = "query", query_vector: str = "vector", same: tuple[str, str] | None = None, within: list[tuple[str, str]] = (), block: int = BLOCK, rows_slice: int = SLICE) -> DataFrame:
    """The k most alike rows of each query by cosine (six decimals): query, doc, similarity, rank; ties by id.

    `same` names a column of rows and one of queries that have to be equal (null equals nothing); `within` pairs of a column of rows and an array
    of queries that has to hold its value (null or empty: any). Both apply before the k are taken. Null and empty vectors have no row and
    ask nothing, vectors of different lengths aren't compared; a vector of zeros has likeness 0. Ids are unique; a query finds itself if it is a row.
    """
    own, asked = [F.col(c) if same else F.lit(0) for c in (same or ("", ""))]
    ks = ["_k", "_size"]
    data = rows.select(F.col(id_col).cast("long").alias("doc"), F.col(vector_col).alias("vector"), own.alias("_k"), F.size(vector_col).alias("_size"), *(F.col(c).alias(f"_w{n}") for n, (c, _) in enumerate(within)))
    given = queries.select(F.col(query_id).cast("long").alias("query"), F.col(query_vector).alias("vector"), asked.alias("_k"), F.size(query_vector).alias("_size"), *(F.col(c).alias(f"_w{n}") for n, (_, c) in enumerate(within)))
    data, given = (df.where("_size > 0 and _k is not null") for df in (data, given))
    slices = data.groupBy(*ks).agg(F.ceil(F.count("*") / rows_slice).alias("_slices"))
    blocks = given.groupBy(*ks).agg(F.ceil(F.count("*") / block).alias("_blocks"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = given.join(slices, ks).join(blocks, ks).withColumn("_b", F.pmod(F.xxhash64("query"), "_blocks")).withColumn("_s", every("_slices")).drop("_slices", "_blocks")
    right = data.join(slices, ks).join(blocks, ks).withColumn("_s", F.pmod(F.xxhash64("doc"), "_slices")).withColumn("_b", every("_blocks")).drop("_slices", "_blocks")

    def run(one: pa.Table, other: pa.Table) -> pa.Table:
        return _best(one, other, k, len(within))

    out = left.groupBy(*ks, "_s", "_b").cogroup(right.groupBy(*ks, "_s", "_b")).applyInArrow(run, "query long, doc long, similarity double")
    order = Window.partitionBy("query").orderBy(F.col("similarity").desc(), "doc")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Embedder(Protocol):
    """Whatever turns texts into vectors; it is shipped to the tasks and called with whole batches."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """A substitute for a learned embedding: tokens counted in hashed places with hashed signs. Not a model."""

    def __init__(self, dimensions: int = DIMENSIONS) -> None:
        self.dimensions = dimensions

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions))
        known: dict[str, int] = {}
        for row, text in enumerate(texts):
            for word in re.findall(r"\w+", text.lower()):
                h = known.get(word)
                if h is None:
                    h = known[word] = int(hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16)
                out[row, (h >> 1) % self.dimensions] += 1 - 2 * (h & 1)
        return out


def embed(texts: DataFrame, id_col: str, text_col: str, keep: list[str], embedder: Embedder, prefix: str = "") -> DataFrame:
    """The id, the columns to keep and `vector`, of unit length; null for null texts and where nothing is counted."""
    kinds = dict(texts.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(batch.num_columns - 1).to_pylist()
            vectors = embedder.encode([prefix + t if t else "" for t in given]).astype(np.float64)
            length = np.linalg.norm(vectors, axis=1, keepdims=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(given) + 1) * vectors.shape[1], pa.int32()), pa.array((vectors / np.maximum(length, 1e-12)).reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.compute.if_else(pa.array(length[:, 0] > 0), lists, None)], names=[id_col, *keep, "vector"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (id_col, *keep)) + ", vector array<double>"
    return texts.select(id_col, *keep, text_col).mapInArrow(run, schema)
