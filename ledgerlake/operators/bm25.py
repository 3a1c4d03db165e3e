"""Okapi BM25 over a stored index.

The corpus is tokenised once, into one row per document (its terms and how often it has them), written to the
shared folder; statistics and every search read that. Statistics come from the whole corpus, also where a filter
restricts what may be found; the scalars of the corpus are single numbers on the driver.

A search over all documents writes the index once more, inverted: slices of bounded size, each one row of sorted
postings. Queries are dealt into blocks, and each block reads one slice after another from the shared folder, so the
shuffle moves queries and k hits of each, never postings. The k-th best score so far bounds what a slice can add: terms
that together can't reach it are only looked up for documents that hold another term of the query, which is exact. Where
queries are as long as documents, little can be left out: there the frequent terms of a slice are a matrix, its product with
the queries in short floats tells what may be among the k best, with a bound on its error, and only that is scored exactly.

A search within each value of a column (`same`) deals documents into slices too, and every block meets every slice of
its value in a group of its own. There the postings of the terms that the block asks for are sorted by term, so each
query adds up short runs of them and touches no other posting. A group passes on its k best documents of each query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..scratch import durable_table

#: The usual parameters of the formula.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Queries of a block and postings of a slice, about.
BLOCK, SLICE = 1024, 400_000
#: The same of a search over all documents; and what rounding and order of addition may change in a score.
WIDE_BLOCK, WIDE_SLICE, SLACK = 4096, 4_000_000, 2e-6
#: The work of looking up a term, and one document in it, in postings that are added up instead.
LOOK, SEEK = 3000, 4
#: Postings a document that a block's queries ask for on average, from which a slice's frequent terms are a matrix; the share of all pairs
#: of a query and a document from which a term is one of them; cells of the matrix and of a product, at most.
DENSE, OFTEN, CELLS, PRODUCT = 2.0, 0.006, 10_000_000, 4_000_000


class Index(NamedTuple):
    """Stored documents (doc, dl, `terms` of term and tf, columns to filter by), weights (term, df, idf), number of documents and mean length."""

    stored: DataFrame
    weights: DataFrame
    documents: int
    mean: float


def postings(corpus: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc, term, tf and dl (tokens of the document, repetitions counted) and the columns to keep. Texts without tokens have no row.

    Texts are hashed to partitions by document once; whatever is grouped by document later stays there.
    """
    words = corpus.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), *keep, F.col(text_col).alias("_text")).repartition("doc").select("doc", *keep, tokens(F.col("_text")).alias("_words"))
    return words.select("doc", *keep, F.size("_words").alias("dl"), F.explode("_words").alias("term")).groupBy("doc", "term", "dl", *keep).agg(F.count("*").alias("tf"))


def term_weights(index: DataFrame, documents: int, epsilon: float = EPSILON) -> DataFrame:
    """term, df and idf; where more than half of the documents hold the term, epsilon times the mean idf of all terms."""
    counts = durable_table(index.groupBy("term").agg(F.count("*").alias("df")), "terms")
    raw = counts.withColumn("raw", F.log(F.lit(documents) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw")).first()[0] or 0.0
    return raw.select("term", "df", F.when(F.col("raw") < 0, epsilon * mean).otherwise(F.col("raw")).alias("idf"))


def counted(corpus: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc, the columns to keep, dl and `terms` (term and tf) of each text with tokens, counted where the text lies: nothing is shuffled."""
    kinds = dict(corpus.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            length = pc.list_value_length(lists).to_numpy()
            words = pc.dictionary_encode(lists.flatten())
            size = max(len(words.dictionary), 1)
            pair, tf = np.unique(np.repeat(np.arange(len(lists)), length) * size + words.indices.to_numpy(), return_counts=True)
            terms = pa.StructArray.from_arrays([words.dictionary.take(pa.array(pair % size)), pa.array(tf, pa.int64())], names=["term", "tf"])
            edges = pa.array(np.searchsorted(pair // size, np.arange(len(lists) + 1)), pa.int32())
            out = pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(length, pa.int32()), pa.ListArray.from_arrays(edges, terms)], names=["doc", *keep, "dl", "terms"])
            yield out.filter(pa.array(length > 0))

    spoken = corpus.select(F.col(id_col).alias("doc"), *keep, F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>")).alias("_words"))
    return spoken.mapInArrow(run, f"doc {kinds[id_col]}, " + "".join(f"`{c}` {kinds[c]}, " for c in keep) + "dl int, terms array<struct<term:string,tf:long>>")


def index_of(rows: DataFrame, documents: int) -> Index:
    """The index of counted documents; every document counts in the mean length, also one without tokens."""
    stored = durable_table(rows, "index")
    held = stored.agg(F.sum("dl")).first()[0] or 0
    weights = term_weights(stored.select(F.explode("terms.term").alias("term")), documents)
    return Index(stored, weights, documents, held / documents if held else 1.0)


def build(corpus: DataFrame, id_col: str = "doc", text_col: str = "text", keep: tuple[str, ...] = ()) -> Index:
    """Tokenises the corpus and stores its index. Ids are unique."""
    return index_of(counted(corpus, id_col, text_col, keep), corpus.count())


def query_terms(queries: DataFrame, query_id: str, text_col: str) -> DataFrame:
    """query, term and how often the query says it."""
    return queries.select(F.col(query_id).alias("query"), F.explode(tokens(F.col(text_col))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qtf"))


def _pairs(lists: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of a column of lists of pairs: the row, the first and the second of each pair."""
    array = lists.combine_chunks()
    flat = array.flatten()
    return np.repeat(np.arange(len(array)), pc.list_value_length(array).to_numpy(zero_copy_only=False)), flat.field(0), flat.field(1).to_numpy(zero_copy_only=False)


def _group_best(queries: pa.Table, docs: pa.Table, k: int, mean: float, limits: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """For the queries of a block their k best documents of a slice: places of queries, places of documents, scores."""
    q_row, q_term, weight = _pairs(queries["terms"])
    d_row, d_term, tf = _pairs(docs["terms"])
    vocabulary = pc.unique(q_term)
    asked = pc.index_in(d_term, value_set=vocabulary)
    held = asked.is_valid().to_numpy(zero_copy_only=False)
    d_row, tf, term = d_row[held], tf[held].astype(np.float64), asked.drop_null().to_numpy()
    length = docs["dl"].to_numpy()[d_row]
    part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
    order = np.argsort(term, kind="stable")
    d_row, part = d_row[order], part[order]
    edge = np.searchsorted(term[order], np.arange(len(vocabulary) + 1))
    place = np.empty(len(docs), np.int64)  # of equal scores the least id counts
    place[pc.sort_indices(docs["doc"]).to_numpy()] = np.arange(len(docs))
    codes = [(col, pc.dictionary_encode(docs[col]).combine_chunks(), queries[f"_{col}"].to_pylist()) for col in limits]
    q_term = pc.index_in(q_term, value_set=vocabulary).to_numpy()
    found: tuple[list, list, list] = ([], [], [])
    starts = np.searchsorted(q_row, np.arange(len(queries) + 1))
    for q in range(len(queries)):
        mine = slice(starts[q], starts[q + 1])
        runs = [(edge[t], edge[t + 1], w) for t, w in zip(q_term[mine], weight[mine], strict=True) if edge[t] < edge[t + 1]]
        if not runs:
            continue
        score = np.round(np.bincount(np.concatenate([d_row[a:b] for a, b, _ in runs]), np.concatenate([part[a:b] * w for a, b, w in runs]), len(docs)), 6)
        for _, values, sets in codes:
            if sets[q]:
                fits = np.append(pc.is_in(values.dictionary, value_set=pa.array(sets[q], values.dictionary.type)).to_numpy(zero_copy_only=False), False)
                score[~fits[values.indices.fill_null(len(fits) - 1).to_numpy(zero_copy_only=False)]] = 0
        best = (score > 0).nonzero()[0]
        if len(best) > k:
            best = best[score[best] >= np.partition(score[best], -k)[-k]]
        best = best[np.lexsort((place[best], -score[best]))][:k]
        found[0].append(np.full(len(best), q))
        found[1].append(best)
        found[2].append(score[best])
    return found


def inverted(rows: DataFrame, keep: list[str], postings_slice: int) -> DataFrame:
    """One row per slice of counted documents: `doc`, `dl` and the columns to keep in order of ids, its `terms`, and `edges`, `place` and `tf` of their postings as int32."""
    kinds = dict(rows.dtypes)

    def one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        docs = pa.Table.from_batches(held)
        row, term, tf = _pairs(docs["terms"])
        order = pc.sort_indices(docs["doc"]).to_numpy()
        place = np.empty(len(docs), np.int64)
        place[order] = np.arange(len(docs))
        words = pc.dictionary_encode(term)
        key = words.indices.to_numpy().astype(np.int64) * len(docs) + place[row]
        at = np.argsort(key)
        key = key[at]
        edges = np.searchsorted(key, np.arange(len(words.dictionary) + 1) * len(docs))
        raw = [x.astype(np.int32).tobytes() for x in (edges, key % len(docs), tf[at])]
        lists = [docs[c].combine_chunks().take(pa.array(order)) for c in ("doc", "dl", *keep)] + [words.dictionary]
        return pa.RecordBatch.from_arrays([*(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists), *(pa.array([x], pa.binary()) for x in raw)], names=["doc", "dl", *keep, "terms", "edges", "place", "tf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += pc.sum(pc.list_value_length(batch.column("terms"))).as_py() or 0
            if size >= postings_slice:
                yield one(held)
                held, size = [], 0
        if size:
            yield one(held)

    schema = ", ".join(f"`{c}` array<{kinds[c]}>" for c in ("doc", "dl", *keep))
    return rows.select("doc", "dl", *keep, "terms").mapInArrow(run, f"{schema}, terms array<string>, edges binary, place binary, tf binary")


def _slices(files: list[str]) -> Iterator[dict]:
    """The slices of stored files, read one by one."""
    for file in files:
        system, path = FileSystem.from_uri(file)
        with system.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=1):
                for n in range(len(batch)):
                    yield {c: v[n] for c, v in zip(batch.schema.names, batch.columns, strict=True)}


def _ranked(found: pa.Table, k: int) -> pa.Table:
    """The k best of each query (by its place), equal scores by id."""
    found = found.take(pc.sort_indices(found, [("q", "ascending"), ("score", "descending"), ("doc", "ascending")]))
    q = found["q"].to_numpy()
    return found.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < k))


def _within(codes: list[tuple[pa.DictionaryArray, list]], q: int, hits: np.ndarray) -> np.ndarray:
    """Which documents of a slice hold a value that the query allows, in each column to filter by."""
    out = np.ones(len(hits), bool)
    for values, given in codes:
        if given[q]:
            known = np.append(pc.is_in(values.dictionary, value_set=pa.array(given[q], values.dictionary.type)).to_numpy(zero_copy_only=False), False)
            out &= known[values.indices.fill_null(len(known) - 1).to_numpy(zero_copy_only=False)[hits]]
    return out


class _Matrix:
    """The postings of the frequent terms of a slice as a matrix, documents by terms, and what the queries ask of these terms."""

    def __init__(self, often: np.ndarray, begin: np.ndarray, size: np.ndarray, place: np.ndarray, part: np.ndarray, documents: int, asked: tuple[np.ndarray, np.ndarray, np.ndarray], queries: int, most: np.ndarray) -> None:
        number = np.cumsum(often) - 1
        self.held = np.zeros((documents, number[-1] + 1))
        for n, (a, b) in enumerate(zip(begin[often].tolist(), (begin + size)[often].tolist(), strict=True)):
            self.held[place[a:b], n] = part[a:b]
        row, code, weight = (x[often[asked[1]]] for x in asked)
        self.asks = np.zeros((queries, number[-1] + 1))
        self.asks[row, number[code]] = weight
        #: What rounding can change in a product of short floats, at most: 2 ** -24 for each factor and each addition, of what the terms can add.
        self.error = (number[-1] + 8) * 2.0**-23 * (np.abs(self.asks) @ most[often])

    def products(self, todo: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each query with the scores of all documents by these terms, about."""
        rows, short = max(1, PRODUCT // len(self.held)), self.held.T.astype(np.float32)
        for at in range(0, len(todo), rows):
            some = todo[at : at + rows]
            yield from zip(some.tolist(), self.asks[some].astype(np.float32) @ short, strict=True)

    def exact(self, q: int, hits: np.ndarray) -> np.ndarray:
        return self.held[hits] @ self.asks[q]


def _best_of_slices(queries: pa.Table, files: list[str], k: int, mean: float, limits: list[str]) -> pa.Table | None:
    """q (the place of a query), doc and score of the k best documents that the slices hold for each query; None if there are none."""
    q_row, q_term, weight = _pairs(queries["terms"])
    vocabulary = pc.unique(q_term)
    q_code = pc.index_in(q_term, value_set=vocabulary).to_numpy()
    starts = np.searchsorted(q_row, np.arange(len(queries) + 1))
    sets = {c: queries[f"_{c}"].to_pylist() for c in limits}
    best, floor = np.zeros((len(queries), k)), np.zeros(len(queries))  # the k best scores of each query so far, and the least of them
    found: list[pa.Table] = []
    asked = np.bincount(q_code, minlength=len(vocabulary))

    def keep(new: tuple[list, list, list], q: int, hits: np.ndarray, value: np.ndarray) -> None:
        value = np.round(value, 6)
        fits = (value > 0) & (value >= floor[q])
        hits, value = hits[fits], value[fits]
        if len(hits) > k:
            fits = value >= np.partition(value, -k)[-k]
            hits, value = hits[fits], value[fits]
            fits = np.lexsort((hits, -value))[:k]
            hits, value = hits[fits], value[fits]
        if len(hits):
            best[q] = np.partition(np.concatenate([best[q], value]), -k)[-k:]
            floor[q] = best[q].min()
            for to, x in zip(new, (np.full(len(hits), q), hits, value), strict=True):
                to.append(x)

    for one in _slices(files):
        docs, dl = one["doc"].values, one["dl"].values.to_numpy()
        edges, place, tf = (np.frombuffer(one[c].as_buffer(), np.int32) for c in ("edges", "place", "tf"))
        at = pc.index_in(vocabulary, value_set=one["terms"].values).fill_null(-1).to_numpy()
        size = np.where(at >= 0, edges[at + (at >= 0)] - edges[at], 0) if len(at) else np.zeros(0, np.int64)
        begin = np.cumsum(size) - size
        picked = np.repeat(np.where(at >= 0, edges[at], 0) - begin, size) + np.arange(size.sum())
        place, tf = place[picked].astype(np.intp), tf[picked]
        del picked
        part = (K1 * (1 - B + B * dl / mean))[place]
        part += tf
        np.divide(tf * (K1 + 1), part, out=part)
        most = np.zeros(len(size))
        if len(part):
            most[size > 0] = np.maximum.reduceat(part, begin[size > 0])
        bound = np.maximum(weight * most[q_code], 0)  # what a term can add at most
        order = np.lexsort((bound, q_row))
        bound, code, w = bound[order], q_code[order], weight[order]
        total = np.concatenate([[0], np.cumsum(bound)])
        rest = total[1:] - total[starts[q_row]]  # the terms of a query up to this one, together
        spread = np.concatenate([[0], np.cumsum(size[code])])
        idle = np.concatenate([[0], np.cumsum(rest + SLACK < floor[q_row])])
        codes = [(pc.dictionary_encode(one[c].values), sets[c]) for c in limits]
        score = np.zeros(len(docs))
        new: tuple[list, list, list] = ([], [], [])
        todo = np.flatnonzero((total[starts[1:]] - total[starts[:-1]] > 0) & (idle[starts[1:]] - idle[starts[:-1]] < np.diff(starts)))
        pairs = asked * size
        often = pairs > OFTEN * len(queries) * len(docs)
        if often.sum() > (most_terms := CELLS // len(docs)):
            often[np.argsort(np.where(often, -pairs, 0), kind="stable")[most_terms:]] = False
        matrix = _Matrix(often, begin, size, place, part, len(docs), (q_row, q_code, weight), len(queries), most) if spread[-1] > DENSE * len(queries) * len(docs) and often.any() else None
        if matrix:  # its postings, most of all, aren't kept twice
            seldom = np.repeat(~often, size)
            place, part = place[seldom], part[seldom]
            size = np.where(often, 0, size)
            begin = np.cumsum(size) - size
        for q, near in matrix.products(todo) if matrix else ((q, None) for q in todo.tolist()):
            first, last, low = starts[q], starts[q + 1], floor[q]
            if matrix:
                own = code[first:last]
                seldom = ~often[own]
                own, x = own[seldom], w[first:last][seldom]
                runs = list(zip(begin[own].tolist(), (begin[own] + size[own]).tolist(), strict=True)) or [(0, 0)]
                rare = np.bincount(np.concatenate([place[a:b] for a, b in runs]), np.concatenate([part[a:b] for a, b in runs]) * np.repeat(x, size[own]), len(docs))
                near = np.add(rare, near, out=score)
                hits = np.flatnonzero(near >= low - SLACK - matrix.error[q])
                hits = hits[_within(codes, q, hits)]
                if len(hits) > k:
                    hits = hits[near[hits] >= np.partition(near[hits], -k)[-k] - SLACK - 2 * matrix.error[q]]
                keep(new, q, hits, rare[hits] + matrix.exact(q, hits))
                continue
            split = first + idle[last] - idle[first]
            runs = [(begin[t], begin[t] + size[t], x) for t, x in zip(code[split:last].tolist(), w[split:last].tolist(), strict=True) if size[t]]
            left = total[split] - total[first]
            if sum(b - a for a, b, _ in runs) * 3 > len(docs):
                score = np.bincount(np.concatenate([place[a:b] for a, b, _ in runs]), np.concatenate([part[a:b] * x for a, b, x in runs]), len(docs))
                hits = np.flatnonzero((score != 0) & (score + left >= low - SLACK))
                value = score[hits]
                score[:] = 0
            else:
                for a, b, x in runs:
                    score[place[a:b]] += part[a:b] * x
                some: tuple[list, list] = ([], [])
                for a, b, _ in runs:  # a document is taken where it comes first
                    value = score.take(place[a:b])
                    fits = np.flatnonzero((value != 0) & (value + left >= low - SLACK))
                    some[0].append(place[a:b][fits])
                    some[1].append(value[fits])
                    score[place[a:b]] = 0
                hits, value = map(np.concatenate, some)
            for n in range(split - 1, first - 1, -1):  # the terms that can't reach the k best by themselves
                if not len(hits):
                    break
                if (n + 1 - first) * (LOOK + len(hits) * SEEK) > spread[n + 1] - spread[first]:  # adding up all that is left is less work
                    runs = [(begin[t], begin[t] + size[t], x) for t, x in zip(code[first : n + 1].tolist(), w[first : n + 1].tolist(), strict=True) if size[t]]
                    if runs:
                        value = value + np.bincount(np.concatenate([place[a:b] for a, b, _ in runs]), np.concatenate([part[a:b] * x for a, b, x in runs]), len(docs))[hits]
                    break
                a, b = begin[code[n]], begin[code[n]] + size[code[n]]
                if a < b:
                    where = np.minimum(np.searchsorted(place[a:b], hits), b - a - 1)
                    value = value + np.where(place[a + where] == hits, part[a + where] * w[n], 0)
                    fits = value + (total[n] - total[first]) >= low - SLACK
                    hits, value = hits[fits], value[fits]
            inside = _within(codes, q, hits)
            keep(new, q, hits[inside], value[inside])
        if new[0]:
            q, hits, value = map(np.concatenate, new)
            found.append(pa.table({"q": q, "doc": docs.take(pa.array(hits)), "score": value}))
            if sum(map(len, found)) > 2 * k * len(queries):
                found = [_ranked(pa.concat_tables(found), k)]
        del one, docs, place, tf, part, matrix  # before the next slice is read
        pa.default_memory_pool().release_unused()
    return _ranked(pa.concat_tables(found), k) if found else None


def search(index: Index, queries: DataFrame, k: int, query_id: str = "query_id", query_text: str = "text", allowed: Column | None = None, same: tuple[str, str] | None = None, within: tuple[tuple[str, str], ...] = (), block: int | None = None, postings_slice: int | None = None) -> DataFrame:
    """The k best documents of each query: query, doc, score (six decimals, above 0) and rank; equal scores by id.

    Filters apply before the k are taken, all on kept columns of the index: `allowed` is one for all queries; `same` names a column and one of the
    queries that have to be equal (null equals nothing); `within` names pairs of a column and an array of the queries that has
    to hold its value (null or empty: any). Null texts and terms that no document holds ask nothing.
    """
    said = query_terms(queries, query_id, query_text).join(index.weights, "term").groupBy("query").agg(F.collect_list(F.struct("term", (F.col("qtf") * F.col("idf")).alias("w"))).alias("terms"))
    rows = index.stored if allowed is None else index.stored.where(allowed)
    if same:
        return _search_same(rows, queries, said, index.mean, k, query_id, same, within, block or BLOCK, postings_slice or SLICE)
    limits, size = [c for c, _ in within], postings_slice or WIDE_SLICE
    given = queries.select(F.col(query_id).alias("query"), *(F.col(a).alias(f"_{c}") for c, a in within)).join(said, "query") if within else said
    cores = queries.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, math.ceil(index.mean * index.documents / size))
    files = sorted(durable_table(inverted(rows.coalesce(parts), limits, size), "slices").inputFiles())
    blocks = max(1, math.ceil(queries.count() / (block or WIDE_BLOCK)))
    stripes = max(1, min(len(files), math.ceil(2 * cores / blocks)))  # several tasks share a block's slices if there are few blocks
    of = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long")))
    dealt = given.withColumn("_b", F.pmod(F.xxhash64("query"), F.lit(blocks))).withColumn("_s", of).select("query", "terms", *(f"_{c}" for c in limits), "_s", (F.col("_b") * stripes + F.col("_s")).cast("int").alias("_p"))
    mean, kinds = index.mean, (given.schema["query"].dataType.simpleString(), rows.schema["doc"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := list(batches)) or not (table := pa.Table.from_batches(held)).num_rows:
            return
        for part in pc.unique(table["_p"]):
            mine = table.filter(pc.equal(table["_p"], part))
            found = _best_of_slices(mine, files[mine["_s"][0].as_py() :: stripes], k, mean, limits)
            if found is not None:
                yield from pa.table({"query": mine["query"].take(found["q"]), "doc": found["doc"], "score": found["score"]}).combine_chunks().to_batches()

    return top_k(dealt.repartitionById(blocks * stripes, "_p").mapInArrow(run, f"query {kinds[0]}, doc {kinds[1]}, score double"), k)


def _search_same(stored: DataFrame, queries: DataFrame, said: DataFrame, mean: float, k: int, query_id: str, same: tuple[str, str], within: tuple[tuple[str, str], ...], block: int, postings_slice: int) -> DataFrame:
    """The search within each value of a column."""
    own, asked = map(F.col, same)
    limits = [c for c, _ in within]
    given = queries.select(F.col(query_id).alias("query"), asked.alias("_k"), *(F.col(a).alias(f"_{c}") for c, a in within)).where("_k is not null").join(said, "query")
    rows = stored.select("doc", "dl", "terms", own.alias("_k"), *limits).where("_k is not null")
    slices = rows.groupBy("_k").agg(F.ceil(F.sum(F.size("terms")) / postings_slice).alias("_slices"))
    blocks = given.groupBy("_k").agg(F.ceil(F.count("*") / block).alias("_blocks"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = given.join(slices, "_k").join(blocks, "_k").withColumn("_b", F.pmod(F.xxhash64("query"), "_blocks")).withColumn("_s", every("_slices")).drop("_slices", "_blocks")
    right = rows.join(slices, "_k").join(blocks, "_k").withColumn("_s", F.pmod(F.xxhash64("doc"), "_slices")).withColumn("_b", every("_blocks")).drop("_slices", "_blocks")

    def run(one: pa.Table, other: pa.Table) -> pa.Table:
        found = _group_best(one, other, k, mean, limits) if len(one) and len(other) else ([], [], [])
        q, d, s = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
        return pa.Table.from_arrays([one["query"].take(pa.array(q, pa.int64())), other["doc"].take(pa.array(d, pa.int64())), pa.array(s, pa.float64())], names=["query", "doc", "score"])

    kinds = given.schema["query"].dataType.simpleString(), rows.schema["doc"].dataType.simpleString()
    out = left.groupBy("_k", "_s", "_b").cogroup(right.groupBy("_k", "_s", "_b")).applyInArrow(run, f"query {kinds[0]}, doc {kinds[1]}, score double")
    return top_k(out, k)


def scores(queries: DataFrame, corpus: DataFrame, query_id: str = "query_id", query_text: str = "text", id_col: str = "doc", text_col: str = "text") -> DataFrame:
    """query, doc and score of every document that holds a term of the query and scores above 0: all hits, as a join of postings."""
    index = build(corpus, id_col, text_col)
    asked = query_terms(queries, query_id, query_text).join(index.weights, "term")
    tf = F.col("t.tf").cast("double")
    part = F.col("qtf") * F.col("idf") * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("dl") / index.mean))
    held = index.stored.select("doc", "dl", F.explode("terms").alias("t")).join(asked, F.col("t.term") == asked["term"])
    return held.groupBy("query", "doc").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")


def top_k(scored: DataFrame, k: int, tie: Column | None = None) -> DataFrame:
    """The k best of each query with `rank` from 1; equal scores by id."""
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc") if tie is None else tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
