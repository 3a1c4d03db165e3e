"""Statistics of each document's words, lines and symbols, and the kind that follows from them.

Method: a line is a row of segments, cut after the last white space within `SEGMENT` characters, so where it
is cut depends on the line alone; its features are the sums over its segments. A text beyond `CHUNK`
characters is split into chunks of whole segments. Each chunk is reduced to a partial state: counts over its
whole lines, the features of the unfinished lines at its two ends, its distinct words and pairs of words. States
merge associatively: where a line runs over the boundary its two parts are joined before it is judged, and
the pair of words across the boundary is added, so every result is the same wherever the chunks were cut.
Runs of chunks are merged first, then the runs of a document (a tree of two levels); ratios and rules come
last. Texts of one chunk take the same functions without a shuffle.

Kinds: "list", "table" and "junk" by what holds more than half of the characters, else null (prose). A text that
says the same over and over is junk: its words or its pairs of words are few for its length.
Null, empty and blank texts have statistics of 0 and no kind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from math import sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a segment of a line and of a chunk, and chunks of a run.
SEGMENT = 4096
CHUNK = 16_384
RUN = 64
#: Fixed parameters of repetition: least words, times that a word or pair recurs on average in prose and in lists or tables, and distinct words for the root of all.
WORDS, TIMES, TIMES_LISTED, PER_ROOT = 12, 6, 20, 3.0

SYMBOL = re.compile("[!-/:-@\\[-`{-~¡-©«-±´-¸»¿‐-‧‰-⁞₠-⃏←-⯿、-〃〈-〟�]")
NUMBER = re.compile("[-+(\u2013\u2212]?[0-9][0-9.,' \xa0\u2009\u202f]*[)%*]?$|[-\u2013\u2212]$|n/a$|e[.]t[.]$|$")
FIGURE = re.compile(r"[0-9–−-]")
LEADING = frozenset("0123456789-–−(+")
GAP = re.compile("[  ]{2,}|[\t|]|;(?=\\S)")
MARK = re.compile(r"\s*(?:[-–—•·▪‣◦*○●■→]|\(?\d{1,3}[.)]|\(?[A-Za-zåäöα-ωا-ي][.)]|\([ivxIVX]{1,5}\)|[0-9]{1,3}[、．])\s+\S")
LEADER = re.compile(r"(?:\.{3,}|…{2,}|(?:\.\s){3,}|·{3,}|_{3,})\s*\d{1,4}\s*$")
ENDS, CLOSES = frozenset(".!?…;:。！？؟।．"), "\"'”’»«“)]」』"
STOP = re.compile(r"[.!?…][\"'”’»«“)\]]*(?=\s+[\"'“”‘«„(\[¿¡]?[^\W\d_a-zåäöæøüßéα-ω]|\s*$)|[。！？؟।][”»」』]?")
DENSE = re.compile(r"[A-Za-z0-9+/=_-]{24,}$")
SOUP = re.compile("[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ|1]{5,}")
THAI = re.compile("[ก-๛]")


class Line(NamedTuple):
    """Features of a line or of some of its segments: sums, how it ends, its first two and its last four words."""

    chars: int = 0
    tokens: int = 0
    numbers: int = 0
    cells: int = 0  # that a bar, tab, gap or semicolon parts from the cell before
    figures: int = 0  # of these, numbers
    bars: int = 0
    symbols: int = 0
    stops: int = 0
    dense: int = 0
    soup: int = 0
    damage: int = 0
    thai: int = 0
    ends: bool = False
    head: str = ""
    tail: str = ""

    def __add__(self, other: Line) -> Line:  # type: ignore[override]
        if not other.chars:
            return self
        if not self.chars:
            return other
        sums = [a + b for a, b in zip(self[:12], other[:12], strict=True)]
        if not other.tokens:
            return Line(*sums, self.ends, self.head, self.tail)
        head = self.head if self.tokens > 1 else f"{self.head} {other.head}".lstrip()[:24]
        tail = other.tail if other.tokens > 3 else " ".join(f"{self.tail} {other.tail}".split()[-4:])[-48:]
        return Line(*sums, other.ends, head, tail)


def segments(line: str, size: int = SEGMENT) -> list[str]:
    """A line in parts of at most `size` characters, each cut after its last white space if it has any."""
    out, at = [], 0
    while len(line) - at > size:
        end = next((k for k in range(at + size, at, -1) if line[k - 1].isspace()), at + size)
        out.append(line[at:end])
        at = end
    return [*out, line[at:]]


def segment_features(text: str) -> Line:
    tokens = text.split()
    cells = figures = bars = 0
    if "  " in text or "\t" in text or ";" in text or "|" in text or "\u00a0" in text:
        first, *rest = GAP.split(text.strip())
        cells = len(rest)
        if cells:
            figures = sum(1 for c in rest if NUMBER.match(c.strip()))
            bars = text.count("|") + text.count("\t")
    return Line(
        len(text), len(tokens), sum(1 for t in tokens if t[0] in LEADING and len(t) < 20 and NUMBER.match(t)) if FIGURE.search(text) else 0, cells, figures, bars,
        len(SYMBOL.findall(text)), len(STOP.findall(text)), sum(len(t) for t in tokens if DENSE.match(t)) if len(text) >= 24 > 6 * len(tokens) - len(text) and max(map(len, tokens), default=0) >= 24 else 0,
        len(SOUP.findall(text)), text.count("�") + text.count("Ã") + text.count("Â"), len(text) if THAI.search(text) else 0,
        bool(tokens) and tokens[-1].rstrip(CLOSES)[-1:] in ENDS, " ".join(tokens[:2])[:24], " ".join(tokens[-4:])[-48:],
    )


def features(line: str, size: int = SEGMENT) -> Line:
    if len(line) <= size:
        return segment_features(line)
    return reduce(Line.__add__, map(segment_features, segments(line, size)))


def judge(line: Line) -> str:
    """Class of a line: junk, list, table or plain."""
    if line.dense > 0.6 * line.chars or line.damage > 1 and 3 * line.damage > line.tokens or line.soup > 1 and 7 * line.soup > line.tokens:
        return "junk"
    if line.tail[-1:].isdigit() and LEADER.search(line.tail):
        return "list"
    if line.cells and line.figures >= 1 and line.figures >= 0.4 * line.cells and (line.stops == 0 or line.figures > line.stops):
        return "table"
    if line.bars >= 2 and line.head[:1] == "|":
        return "table"
    if line.symbols > 0.3 * line.chars and line.numbers < 0.5 * line.tokens:
        return "junk"
    if line.numbers < 4 and MARK.match(line.head):
        return "list"
    if line.numbers >= 2 and line.numbers >= 0.3 * line.tokens and line.stops == 0 and not (line.tokens - line.numbers > 6 and line.numbers < 3):
        return "table"
    if MARK.match(line.head):
        return "list"
    return "plain"


COUNTS = ("lines", "ends", "list", "table", "junk", "plain", "plain_lines", "plain_stops", "plain_thai")
PLACE = {name: k for k, name in enumerate(COUNTS)}
NONE = np.zeros(0, np.int64)


class State(NamedTuple):
    """Of a stretch of text: counts of its whole lines and words; the unfinished lines at its ends; its distinct words and pairs of neighbours, hashed."""

    counts: tuple[int, ...] = (0,) * len(COUNTS)
    words: tuple[int, int, int] = (0, 0, 0)  # words, their characters, common words
    symbols: int = 0
    broken: bool = False  # holds a line feed; if not, first has the one part
    first: Line = Line()
    last: Line = Line()
    vocabulary: np.ndarray = NONE
    pairs: np.ndarray = NONE
    ends: tuple[int, ...] = ()  # hashes of the first and the last word


def close(counts: tuple[int, ...], line: Line) -> tuple[int, ...]:
    """The counts with one more whole line."""
    if not line.tokens:
        return counts
    out, kind = list(counts), PLACE[judge(line)]
    out[0] += 1
    out[1] += line.ends
    out[kind] += line.chars
    if kind == 5:
        out[6] += 1
        out[7] += line.stops
        out[8] += line.thai
    return tuple(out)


def bare(words: list[str]) -> list[str]:
    """The words without the marks around them."""
    return [w.strip(".,;:!?") for w in words]


def spoken(words: list[str], plain: list[str], common: frozenset[str]) -> tuple[int, int, int]:
    return len(words), sum(map(len, words)), sum(1 for w in plain if w in common or w.lower() in common)


def line_state(text: str, size: int) -> tuple[tuple[int, ...], int, bool, Line, Line]:
    parts = [features(x, size) if x else Line() for x in text.split("\n")]
    counts = State().counts
    for part in parts[1:-1]:
        counts = close(counts, part)
    return counts, sum(p.symbols for p in parts), len(parts) > 1, parts[0], parts[-1] if len(parts) > 1 else Line()


def pair_hash(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (one * np.int64(0x5851F42D4C957F2D) + np.int64(0x14057B7EF767814F)) ^ two


def state(text: str, common: frozenset[str], size: int = SEGMENT) -> State:
    """The state of one chunk."""
    words = text.split()
    plain = bare(words)
    known = {w: int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for w in set(plain)}
    hashes = np.array([known[w] for w in plain], np.int64)
    counts, symbols, broken, first, last = line_state(text, size)
    ends = (int(hashes[0]), int(hashes[-1])) if len(hashes) else ()
    return State(counts, spoken(words, plain, common), symbols, broken, first, last, np.unique(hashes), np.unique(pair_hash(hashes[:-1], hashes[1:])), ends)


def merge(a: State, b: State) -> State:
    """The state of two stretches in a row; associative."""
    counts = tuple(x + y for x, y in zip(a.counts, b.counts, strict=True))
    words = tuple(x + y for x, y in zip(a.words, b.words, strict=True))
    across = pair_hash(np.array(a.ends[-1:], np.int64), np.array(b.ends[:1], np.int64)) if a.ends and b.ends else NONE
    vocabulary = np.union1d(a.vocabulary, b.vocabulary)
    pairs = np.unique(np.concatenate([a.pairs, b.pairs, across]))
    ends = (a.ends or b.ends)[:1] + (b.ends or a.ends)[-1:]
    if a.broken and b.broken:
        counts, first, last = close(counts, a.last + b.first), a.first, b.last
    elif a.broken:
        first, last = a.first, a.last + b.first
    else:
        first, last = a.first + b.first, b.last
    return State(counts, words, a.symbols + b.symbols, a.broken or b.broken, first, last, vocabulary, pairs, ends)


RESULT = "n_words long, n_lines long, mean_word_length double, symbol_ratio double, line_end_share double, common_share double, list_share double, table_share double, junk_share double, kind string"


def result(s: State, chars: int, distinct: int, pairs: int) -> tuple:
    """Statistics and kind of a whole document of so many characters, distinct words and distinct pairs of neighbours."""
    counts = close(s.counts, s.first)
    if s.broken:
        counts = close(counts, s.last)
    lines, ends, listed, table, junk, plain, plain_lines, stops, thai = counts
    words, word_chars, common = s.words
    if not words:
        return (0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, None)
    total = listed + table + junk + plain
    times = TIMES_LISTED if 2 * (listed + table) > total else TIMES
    if words >= WORDS and (words >= times * distinct and distinct <= PER_ROOT * sqrt(words) or words >= times * max(pairs, 1)):
        junk, listed, table, plain = total, 0, 0, 0  # the same over and over
    elif plain_lines >= 3 and plain > 250 * stops and plain < (40 if 2 * thai > plain else 80) * plain_lines:
        listed, plain = listed + plain, 0  # short lines without a sentence among them
    shares = [x / total for x in (listed, table, junk)]
    kind = next((k for k, x in zip(("list", "table", "junk"), shares, strict=True) if x > 0.5), None)
    return (words, lines, word_chars / words, s.symbols / chars, ends / lines, common / words, *shares, kind)


def whole_text(text: str, common: frozenset[str], size: int = SEGMENT) -> tuple:
    """The result of a text of one chunk; words are told apart as they are, not by hashes."""
    words = text.split()
    plain = bare(words)
    counts, symbols, broken, first, last = line_state(text, size)
    return result(State(counts, spoken(words, plain, common), symbols, broken, first, last), len(text), len(set(plain)), len(set(zip(plain, plain[1:], strict=False))))


def cut(text: str, size: int = CHUNK, segment: int = SEGMENT) -> Iterator[str]:
    """Chunks of a text: whole segments, with the line feeds after them, of about `size` characters together; no word is cut."""
    begin = at = 0
    for line in text.split("\n"):
        parts = segments(line, segment)
        for k, part in enumerate(parts):
            at += len(part) + (k == len(parts) - 1)
            if at - begin >= size and at < len(text) and text[at - 1].isspace():
                yield text[begin:at]
                begin = at
    yield text[begin:]


LINE = pa.struct([(name, pa.bool_() if name == "ends" else pa.string() if name in ("head", "tail") else pa.int64()) for name in Line._fields])
STATE = [("counts", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("symbols", pa.int64()), ("broken", pa.bool_()), ("first", LINE), ("last", LINE), ("vocabulary", pa.list_(pa.int64())), ("pairs", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))]
_LINE_SQL = "struct<" + ",".join(f"{name}:{'boolean' if name == 'ends' else 'string' if name in ('head', 'tail') else 'bigint'}" for name in Line._fields) + ">"
STATE_SQL = f"counts array<long>, words array<long>, symbols long, broken boolean, first {_LINE_SQL}, last {_LINE_SQL}, vocabulary array<long>, pairs array<long>, ends array<long>"


def state_columns(s: State) -> list[pa.Array]:
    """One row of the columns of STATE."""
    values = [list(s.counts), list(s.words), s.symbols, s.broken, s.first._asdict(), s.last._asdict(), s.vocabulary, s.pairs, list(s.ends)]
    return [pa.array([v], kind) for v, (_, kind) in zip(values, STATE, strict=True)]


def state_of(batch: pa.RecordBatch, at: int, row: int) -> State:
    """The state in the columns from `at` of a row."""
    counts, words, symbols, broken, first, last = (batch.column(at + k)[row].as_py() for k in range(6))
    vocabulary, pairs = (batch.column(at + k)[row].values.to_numpy(zero_copy_only=False) for k in (6, 7))
    return State(tuple(counts), tuple(words), symbols, broken, Line(**first), Line(**last), vocabulary, pairs, tuple(batch.column(at + 8)[row].as_py()))


def quality(docs: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, run: int = RUN, segment: int = SEGMENT) -> DataFrame:
    """One row per row of `docs`: id, `n_chars`, the statistics of RESULT and `kind`.

    `common_words` (column `word`) is a closed list that doesn't grow with the data; it is sent to
    the tasks once its size is checked. The id must be unique. Other columns are pruned. The state of a
    long text grows with its distinct words and pairs of words.
    """
    words = frozenset(r[0].lower() for r in common_words.select("word").where("word is not null").distinct().limit(100_001).collect())
    if len(words) > 100_000:
        raise ValueError("common_words is meant to be a closed list of frequent words")
    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    short, long = named.where(F.length("_text") <= chunk), named.where(F.length("_text") > chunk)

    def table(rows: list[tuple], ids: pa.Array) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(11)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.float64()] * 7, pa.string()]
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[id_col, "n_chars", *(x.split()[0] for x in RESULT.split(", "))])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield table([(len(t), *whole_text(t, words, segment)) for t in batch.column(1).to_pylist()], batch.column(0))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                parts = list(cut(text, chunk, segment))
                for k in range(0, len(parts), run):
                    some = parts[k : k + run]
                    ids = pa.concat_arrays([batch.column(0).slice(i, 1)] * len(some))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(range(k, k + len(some)), pa.int32()), pa.array(some, pa.string())], names=["_id", "_no", "_chunk"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by id and chunk; one state for each run."""
        key, so_far, chars = None, State(), 0
        for batch in batches:
            for i, no, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if key != (i, no // run):
                    if key is not None:
                        yield packed(key, so_far, chars)
                    key, so_far, chars = (i, no // run), State(), 0
                so_far, chars = merge(so_far, state(text, words, segment)), chars + len(text)
        if key is not None:
            yield packed(key, so_far, chars)

    def packed(key: tuple, s: State, chars: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int32()), pa.array([chars], pa.int64()), *state_columns(s)], names=["_id", "_run", "_chars", *(n for n, _ in STATE)])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by id and run; one result for each id."""
        key, so_far, chars = None, State(), 0

        def done() -> pa.RecordBatch:
            return table([(chars, *result(so_far, chars, len(so_far.vocabulary), len(so_far.pairs)))], pa.array([key[0]]))

        for batch in batches:
            for row, (i, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if key != (i,):
                    if key is not None:
                        yield done()
                    key, so_far, chars = (i,), State(), 0
                so_far, chars = merge(so_far, state_of(batch, 3, row)), chars + n
        if key is not None:
            yield done()

    schema = f"`{id_col}` {kind}, n_chars long, {RESULT}"
    run_no = F.expr(f"_no div {run}")
    states = long.mapInArrow(chunks, f"_id {kind}, _no int, _chunk string").repartition(F.col("_id"), run_no).sortWithinPartitions("_id", "_no").mapInArrow(runs, f"_id {kind}, _run int, _chars long, {STATE_SQL}")
    merged = states.repartition("_id").sortWithinPartitions("_id", "_run").mapInArrow(documents, schema)
    return short.mapInArrow(whole, schema).unionByName(merged)
