"""Encoding of a corpus with a public byte-level BPE vocabulary.

Method: a rank queue on a hierarchical bitmap. The symbols of a pre-token form a linked list; every
rank that some adjacent pair could merge at has a bucket of list positions; a two-level bitmap marks
the non-empty buckets, so find-first-set gives the next rank. Entries that an earlier merge made
stale are skipped when they come up. A pre-token of n bytes takes O(n) queue steps, so very long
pre-tokens (unspaced scripts, encoded data) stay linear.

Within a task, results of repeated words are kept in bounded dictionaries, which change the speed
only. Texts are encoded whole; a null or empty text gets an empty list.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"

#: Fixed value: the published pre-token pattern of this vocabulary.
PRE_TOKEN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A pre-token never runs across a blank that stands before a character other than white space.
CUT = re.compile(r" (?=\S)")

#: Entries a task keeps of words and of pre-tokens before it starts afresh, and the longest key kept.
CACHE_ENTRIES = 200_000
CACHE_KEY = 80


def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file: token bytes and rank, which is also the id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class RankQueue:
    """Buckets of list positions by merge rank, with a two-level bitmap of the non-empty ones."""

    __slots__ = ("buckets", "low", "top")

    WIDTH = 8

    def __init__(self, size: int) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * ((size >> self.WIDTH) + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            word = rank >> 8
            self.low[word] |= 1 << (rank & 255)
            self.top |= 1 << word
        else:
            bucket.append(position)

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank and its positions; the bucket is emptied."""
        word = (self.top & -self.top).bit_length() - 1
        bits = self.low[word]
        rank = (word << 8) | ((bits & -bits).bit_length() - 1)
        bits &= bits - 1
        self.low[word] = bits
        if not bits:
            self.top &= self.top - 1
        return rank, self.buckets.pop(rank)


class Encoder:
    """Encodes texts with one vocabulary; lives within one task."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import regex

        self.ranks = ranks
        self.split = regex.compile(PRE_TOKEN).findall
        self.queue = RankQueue(max(ranks.values(), default=0))
        self.pieces: dict[str, array] = {}
        self.words: dict[str, array] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        get = self.ranks.get
        whole = get(piece)
        if whole is not None:
            return [whole]
        n, queue = len(piece), self.queue
        push = queue.push
        symbols: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        for i in range(n - 1):
            rank = get(piece[i : i + 2])
            if rank is not None:
                push(rank, i)
        while queue.top:
            rank, positions = queue.pop()
            if len(positions) > 1:
                positions.sort()
            for k, i in enumerate(positions):
                left = symbols[i]
                j = after[i]
                if left is None or j >= n:
                    continue
                both = left + symbols[j]
                if get(both) != rank:
                    continue  # stale: an earlier merge took one of the two
                symbols[i], symbols[j] = both, None
                right = after[j]
                after[i] = right
                lower = False
                if right < n:
                    before[right] = i
                    new = get(both + symbols[right])
                    if new is not None:
                        push(new, i)
                        lower = new < rank
                p = before[i]
                if p >= 0:
                    new = get(symbols[p] + both)
                    if new is not None:
                        push(new, p)
                        lower = lower or new < rank
                if lower and k + 1 < len(positions):  # a lower rank comes before the rest of this bucket
                    for rest in positions[k + 1 :]:
                        push(rank, rest)
                    break
        return [self.ranks[s] for s in symbols if s is not None]

    def word(self, text: str) -> array:
        """Ids of a stretch that no pre-token leaves."""
        out, pieces = array("i"), self.pieces
        for piece in self.split(text):
            ids = pieces.get(piece)
            if ids is None:
                ids = array("i", self.merge(piece.encode("utf-8", "replace")))
                if len(piece) <= CACHE_KEY:
                    if len(pieces) >= CACHE_ENTRIES:
                        pieces.clear()
                    pieces[piece] = ids
            out.extend(ids)
        return out

    def stretches(self, text: str) -> Iterator[array]:
        """Ids of a text, stretch by stretch."""
        first, *rest = CUT.split(text)
        if first:
            yield self.word(first)
        words = self.words
        for key in rest:
            ids = words.get(key)
            if ids is None:
                ids = self.word(" " + key)
                if len(key) <= CACHE_KEY:
                    if len(words) >= CACHE_ENTRIES:
                        words.clear()
                    words[key] = ids
            yield ids

    def encode(self, text: str) -> array:
        out = array("i")
        extend = out.extend
        for ids in self.stretches(text):
            extend(ids)
        return out

    def count(self, text: str) -> int:
        return sum(map(len, self.stretches(text)))


def send(df: DataFrame, path: str) -> str:
    """Sends the vocabulary along with the job, so that executors needn't have it; its name among the files sent."""
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of `df`: its id and `ids`, the token ids of its text without special tokens.

    Strings of special tokens are ordinary text. Null and empty texts have an empty list. Rows are
    independent, so there is no shuffle; other columns of `df` are pruned.
    """
    name = send(df, f"{tokenizer_dir}/{vocabulary}.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(load_ranks(SparkFiles.get(name)))
        for batch in batches:
            flat, ends = array("i"), [0]
            for text in batch.column(1).to_pylist():
                if text:
                    for ids in encoder.stretches(text):
                        flat.extend(ids)
                ends.append(len(flat))
            values = pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of `df`: its id and `n_tokens`; 0 for a null or empty text."""
    name = send(df, f"{tokenizer_dir}/{vocabulary}.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(load_ranks(SparkFiles.get(name)))
        for batch in batches:
            counts = [encoder.count(text) if text else 0 for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=[id_col, "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long")
