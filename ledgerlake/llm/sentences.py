"""Sentence units of texts in many languages and scripts.

Method: a hidden-event n-gram model. Between two words of a block there may be a boundary token. Where
the form alone leaves it open (after a mark that can end a sentence, after a mark within closing
quotes or brackets, at white space of scripts that write none between words), the model weighs

    P(boundary | words before) * P(next word | start of a sentence)   against
    P(none | words before)     * P(next word | within a sentence),

with back-off from the word pair to the word to the shape of the word. Within a block, boundaries
depend on each other through the number of words between them; forward-backward passes over the gaps
of the block give each gap's posterior, and gaps of at least one half are boundaries.

The model is fitted without labels: ends and starts of blocks are boundaries whatever they look
like, words that go on in small letters mostly aren't, and expectation-maximisation settles the rest. It is
a table of n-grams, and a round is joins and groupings on it, so it covers all texts, whatever their number, and
never leaves the tasks; only two sums do. Each text is read once: its gaps are stored with their words, n-grams are
counted from these, and the fitted odds are joined back to them.

What needs no model: a blank line and the end of the text end a unit; list items, table lines, copyright notices and other
lines that aren't filled to the block's width are units of their own; Thai ends a unit at white
space between two Thai letters; colons and semicolons end nothing, except after Greek.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.forms import clean
from ..scratch import durable_table

ROUNDS = 6
#: Fixed parameters: pseudo-counts of back-off, share of the exact word, odds of a sentence of one or two words, least and most probability of a boundary.
BACK, EXACT, LENGTH, LEAST = 2.0, 0.85, {0: 0.02, 1: 0.05, 2: 0.6}, 1e-4

#: The odds by number of words, the last for more of them.
LENGTHS = np.array([LENGTH.get(n, 1.0) for n in range(max(LENGTH) + 2)])

HIDDEN = "­​-‏⁠﻿"
CLOSE = "\"'”’»«“›)\\]」』”）］】"
CJK_CLOSE = "\"'”’»」』）)】"
#: Marks that end a sentence only before white space, as they have other uses within one.
SPACED = ".!?…؟।॥．;;‼⁇⁈⁉﹒"
#: All other characters that Unicode calls terminal for sentences; they end one wherever they stand.
TERMINAL = "".join(c for c in regex.findall(r"\p{Sentence_Terminal}", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x1FFFF)]))) if c not in SPACED and c not in ".!?")
ENDING = SPACED + TERMINAL
ENDING_NOT_STOP = tuple(c for c in ENDING if c not in ".．﹒")
INVISIBLE = "".join(map(chr, [0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF]))
#: Occurrences of a pair of words from which its own counts give the first guess; behind closing signs the word's do, as what they enclose is mixed.
PAIRS = 8
#: A place where a unit may end: marks, closing signs, then white space or, after other terminal marks, anything.
def gap_pattern(spaced: str, terminal: str) -> re.Pattern[str]:
    return re.compile(f"[{spaced}{terminal}](?:(?<=[{spaced}])[{spaced}{terminal}{HIDDEN}]*[{CLOSE}{HIDDEN}]*(?=\\s)|(?<=[{terminal}])[{terminal}]*[{CJK_CLOSE}{HIDDEN}]*)")


GAP = gap_pattern(SPACED, TERMINAL)
#: The same for texts that hold none of the rarer marks, as most do: small classes are searched faster.
COMMON = ".!?…;;؟।", "。！？"
COMMON_GAP = gap_pattern(*COMMON)
RARE = frozenset(ENDING) - frozenset("".join(COMMON))
#: And for ASCII texts.
ASCII_GAP = re.compile("[.!?;]+[\"')\\]]*(?=\\s)")
THAI = "฀-๿"
#: White space before a Thai letter, after a Thai letter or after a digit, sign or Latin letter.
THAI_GAP = re.compile(f"(?<=\\S)\\s+(?=[{HIDDEN}]*[{THAI}])")
HAS_THAI = re.compile(f"[{THAI}]")
#: Lao, Burmese, Khmer, Han and kana: no white space between words, so what there is may end a sentence. In Han and kana a line feed is a mere break.
OTHER_UNSPACED = "\u0e80-\u0eff\u1000-\u109f\u1780-\u17ff"
BLANK_GAP = re.compile(f"(?<=[{OTHER_UNSPACED}])\\s+(?=[{OTHER_UNSPACED}])|(?<=[぀-ヿ一-鿿])[^\\S\\n]+(?=[぀-ヿ一-鿿])")
HAS_BLANK_GAP = re.compile(f"[{OTHER_UNSPACED}]|[぀-ヿ一-鿿][^\\S\\n]+[぀-ヿ一-鿿]")
BLANK_LINE = re.compile(f"\\n[^\\S\\n{HIDDEN}]*\\n\\s*")
MARK = re.compile(rf"[\s{HIDDEN}]*(?:[-–—•·▪‣◦*○●■→][\s{HIDDEN}]+|\(?\d{{1,3}}[.)][\s{HIDDEN}]+|\(?[A-Za-zÅÄÖåäöΑ-Ωα-ω][.)][\s{HIDDEN}]+|\([ivxIVX]{{1,5}}\)[\s{HIDDEN}]+)(?=\S)")
NOTICE = re.compile(rf"[\s{HIDDEN}]*(?:©|\([cC]\)|Copyright\b)[^\n]*$")
CELLS = re.compile(r"\S(?: {2,}|\t|\s*\|\s*)\S")
NEXT_WORD = re.compile(r"\s*(\S{1,40})")
NEXT_WORDS = re.compile(r"\s*(\S{1,40})(?:\s+(\S{1,40}))?")
GREEK = re.compile("[Ͱ-Ͽἀ-῿]")
LETTER = re.compile(r"[^\W\d_]")
#: An end without a mark, of scripts in which white space may part sentences.
BARE_END = re.compile(f"[{OTHER_UNSPACED}぀-ヿ一-鿿]$")
UNSPACED = re.compile(f"[぀-ヿ一-鿿{THAI}{OTHER_UNSPACED}]")
#: The same as sets: a text's characters are looked up once instead of searching it for each class.
THAI_LETTERS = frozenset(map(chr, range(0xE00, 0xE80)))
UNSPACED_LETTERS = frozenset(c for c in map(chr, [*range(0xE00, 0x1800), *range(0x3040, 0xA000)]) if UNSPACED.match(c))

#: What most texts hold nothing of: letters of the unspaced scripts' blocks, rarer marks, and anything beyond the first plane; one fast search.
SPECIAL = re.compile(f"[\u0e00-\u17ff\u3040-\u9fff{''.join(sorted(re.escape(c) for c in RARE if c < chr(0x10000)))}\U00010000-\U0010ffff]")

OPENING = "\"'“„”‘‚«»‹([「『（［【"
CLOSING = "\"'”’»«“›)]」』）］】"


@lru_cache(maxsize=100_000)
def word_form(word: str) -> str:
    """A word as the model knows it: in small letters, each digit run one zero."""
    return re.sub(r"\d+(?:[.,'’/–-]\d+)*", "0", clean(word)).lower()


@lru_cache(maxsize=100_000)
def before_form(word: str) -> str:
    return word_form(word)[-12:]


@lru_cache(maxsize=100_000)
def left_form(word: str) -> str:
    left = word_form(word).lstrip(OPENING)[-24:]
    return left[-6:] if UNSPACED.search(left) else left


def right_form(text: str, at: int = 0) -> str:
    """The word after a gap; its first letter's case is kept as a sign in front. Unspaced scripts give their first characters."""
    found = NEXT_WORD.match(text, at)
    if not found:
        return ""
    word = found[1]
    return _right_form(word, NEXT_WORDS.match(text, at)[2] or "" if word.lstrip(OPENING)[:1].isdigit() else "")


@lru_cache(maxsize=200_000)
def _right_form(word: str, then: str) -> str:
    word = clean(word)
    bare = word.lstrip(OPENING)
    if UNSPACED.match(bare):
        return "x:" + word[: 5 if HAS_THAI.search(word) else 3]
    opened = "(" if word[:1] in "([（" and word else "q" if bare != word else ""
    first = bare[:1]
    if not first:
        kind = "o"
    elif first.isdigit():
        kind = "d"
    elif first.islower():
        kind = "c" if any(c.isupper() for c in bare[1:]) else "l"
    elif first.isupper():
        kind = "U"
    elif first.isalpha():
        kind = "n"
    else:
        kind = "o"
    if kind == "d":  # a number says little; the word after it more
        glued = UNSPACED.search(bare)
        bare = bare[: glued.start() + 3] if glued else bare + " " + clean(then)
    return f"{opened}{kind}:{re.sub(r'[0-9]+(?:[.,][0-9]+)*', '0', bare).lower().rstrip('.,;:!?…”’»)')[:20]}"


@lru_cache(maxsize=100_000)
def left_class(left: str) -> str:
    """The shape of a word before a gap."""
    body = left.rstrip(CLOSING)
    closed = "b" if left[len(body) :].startswith((")", "]")) else "q" if len(body) < len(left) else ""
    mark = "..." if body.endswith("...") else "." if body[-1:] in (".", "．", "﹒") else body[-1:] if body[-1:] and body[-1:] in ENDING else ""
    core = body.rstrip(ENDING)
    if mark not in ("", "."):
        return f"{closed}{mark}"
    if not core:
        size = "none"
    elif "." in core:
        size = "dotted"
    elif core.isdigit():
        size = "number"
    elif not any(c.isalpha() for c in core):
        size = "sign"
    else:
        size = "1" if len(core) == 1 else "short" if len(core) < 4 else "long"
    return f"{closed}{mark}{size}"


def hard_lines(lines: list[str], unspaced: bool = True, tables: bool = True) -> list[bool]:
    """For each line of a block but the last, whether the line feed after it ends a unit. The lines may be known to hold no letter of an unspaced script, or nothing that parts cells."""
    n = len(lines)
    if n < 2:
        return []
    marked = [MARK.match(x) is not None for x in lines]
    if (marked[0] and sum(marked) > 0.5 * n) or sum(marked) > 1 and sum(marked) >= 0.6 * n:
        return [True] * (n - 1)
    cells = [CELLS.search(x) is not None for x in lines] if tables else ()
    if tables and sum(cells) >= 0.6 * n and not all(len(re.findall(r"\S {2,}\S", x)) > 0.6 * (len(x.split()) - 1) for x in lines if len(x.split()) > 2):
        return [True] * (n - 1)
    width = [len(x.strip()) for x in lines]
    most = max(width)
    filled = sum(width[k] + 1 + len((lines[k + 1].split() or [""])[0]) > most - 4 or unspaced and (HAS_THAI.search(lines[k]) is not None or UNSPACED.search(lines[k]) is not None and width[k] > 0.6 * most) for k in range(n - 1))
    return [filled < 0.6 * (n - 1)] * (n - 1)


def parts(text: str, unspaced: bool = True) -> Iterator[tuple[int, int, bool]]:
    """Stretches (start, end, table line) that no unit leaves: blocks, or their lines where these are units."""
    at = 0
    for stop in [*((m.start(), m.end()) for m in BLANK_LINE.finditer(text)), (len(text), len(text))]:
        block = text[at : stop[0]]
        if block.strip():
            if "\n" not in block:
                yield at, stop[0], False
            else:
                lines = block.split("\n")
                tables = "  " in block or "|" in block or "\t" in block
                hard = hard_lines(lines, unspaced, tables)
                begin, here = at, at
                for line, ends in zip(lines, [*hard, True], strict=True):
                    here += len(line)
                    if ends:
                        yield begin, here, tables and hard[0] and CELLS.search(line) is not None
                        begin = here + 1
                    here += 1
        at = stop[1]


def gaps(text: str, start: int, end: int, number: int, pattern: re.Pattern[str], thai: bool = True, blanks: bool = True, notices: bool = True) -> tuple[list[tuple], list[int]]:
    """The open places of a stretch as stops of chain `number` (see `observe`), and its certain ends but for the last.

    The pattern finds marks. The text may be known to hold no Thai, no white space that parts an unspaced script, or no copyright sign.
    """
    part = text[start:end]
    if notices and NOTICE.match(part):
        return [], []
    mark = MARK.match(part)
    skip = mark.end() if mark else 0
    found: list[int] = []
    size = len(part.rstrip())
    for m in pattern.finditer(part, skip):
        at = m.start()
        if part[at] == ";":  # the Greek question mark, where most letters before it are Greek
            clause = part[max(part.rfind(c, skip, at) for c in ".!;") + 1 : at]
            if clause.isascii() or 2 * len(GREEK.findall(clause)) <= len(LETTER.findall(clause)):
                continue
        if m.end() < size:
            found.append(m.end())
    certain: list[int] = []
    if thai and HAS_THAI.search(part):
        ends = set(found)
        for m in THAI_GAP.finditer(part, skip):
            last = part[max(0, m.start() - 8) : m.start()].rstrip(INVISIBLE)[-1:]
            if m.start() not in ends:
                (certain if HAS_THAI.match(last) else found).append(m.start())
    if blanks and HAS_BLANK_GAP.search(part):
        found += {m.start() for m in BLANK_GAP.finditer(part, skip)} - set(found)
    found.sort()
    out, past = [], 0
    for stop in found:  # no white space before it, a word after it
        words = part[past:stop].rsplit(None, 3)
        n = len(words)
        near = NEXT_WORD.match(part, stop)
        word = near[1]
        then = NEXT_WORDS.match(part, stop)[2] or "" if (word[0].isdigit() or word[0] in OPENING) and word.lstrip(OPENING)[:1].isdigit() else ""
        out.append((start + stop, start + near.start(1), number, n if n < 3 else 3, before_form(words[-2]) if n > 1 else "", left_form(words[-1]) if n else "", _right_form(word, then)))
        past = stop
    return out, certain


def first_guess(left: str, right: str, often: tuple[float, float], rate: float) -> float:
    """What a gap is taken for before the first round, by the kind of the word after it, and by how often the words
    before it end a block (of `often`, the first) beside other places (the second): words that end sentences do so at the usual rate."""
    kind = right.split(":", 1)[0]
    shape = left_class(left)
    if kind == "l":
        return 0.02
    if kind in ("n", "x") and shape.startswith("q"):
        return 0.5
    if shape.lstrip("qb")[:1] in ENDING_NOT_STOP or shape.endswith("..."):
        return 0.95
    at_end, elsewhere = often
    if not any(c in ENDING for c in left):  # a blank without a mark
        if kind != "x" or not BARE_END.search(left):
            return 0.1
        return min(0.97, max(0.01, (at_end + 0.2) / (rate * (at_end + elsewhere)))) if at_end + elsewhere >= 8 else 0.5
    if at_end + elsewhere >= 8:
        guess = min(0.97, max(0.01, (at_end + 0.2) / (rate * (at_end + elsewhere))))
    else:
        guess = 0.03 if shape == ".1" else 0.25 if shape in ("", ".dotted", ".none") else 0.9 if shape.endswith(("long", "sign")) else 0.5
    return guess * (0.3 if kind in ("d", "(d", "o", "(l") else 1.0)


def odds_of(chain: list[tuple[float, float, int]]) -> list[float]:
    """Posteriors of the gaps of a stretch (weight of a boundary, weight of none, words since the gap before) by forward and backward passes; the state is whether the gap is a boundary."""
    n = len(chain)
    step = [LENGTH.get(words, 1.0) for _, _, words in chain]  # from boundary to boundary
    forward, one, none = [], 0.0, 0.0
    for k in range(n):
        b, c, _ = chain[k]
        if k == 0:
            one, none = b * step[0], c
        else:
            one, none = b * (one * step[k] + none), c * (one + none)
        total = one + none or 1.0
        one, none = one / total, none / total
        forward.append((one, none))
    out, one, none = [0.0] * n, 1.0, 1.0
    for k in range(n - 1, -1, -1):
        f1, f0 = forward[k]
        out[k] = f1 * one / ((f1 * one + f0 * none) or 1.0)
        b, c, _ = chain[k]
        one, none = b * step[k] * one + c * none, b * one + c * none
        total = one + none or 1.0
        one, none = one / total, none / total
    return out


STOPS = "array<struct<at:int,next:int,chain:int,words:int,before:string,left:string,right:string>>"
EDGES = "array<struct<before:string,left:string,right:string>>"


def observe(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """One row per text that isn't null or blank: the keys, `first` (where its first unit begins), `stops` (every place where a unit may or must end: end of
    the unit before and start of the one after, the chain of open places it belongs to or -1 where it is certain, and the n-gram) and `edges` (n-grams of block ends, with no word after, and starts, with none before)."""
    kinds = dict(texts.dtypes)
    stop_kind = pa.struct([("at", pa.int32()), ("next", pa.int32()), ("chain", pa.int32()), ("words", pa.int32()), ("before", pa.string()), ("left", pa.string()), ("right", pa.string())])
    edge_kind = pa.struct([("before", pa.string()), ("left", pa.string()), ("right", pa.string())])

    def lists(rows: list[list[tuple]], kind: pa.StructType) -> pa.ListArray:
        flat = list(zip(*(x for row in rows for x in row), strict=True)) or [()] * kind.num_fields
        fields = [pa.array(c, kind[k].type) for k, c in enumerate(flat)]
        edges = [0]
        for row in rows:
            edges.append(edges[-1] + len(row))
        return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays(fields, names=[f.name for f in kind]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, first, stops, edges = [], [], [], []
            for row, text in enumerate(batch.column(len(keys)).to_pylist()):
                found = read(text)
                if found:
                    kept.append(row)
                    for into, x in zip((first, stops, edges), found, strict=True):
                        into.append(x)
            at = pa.array(kept, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(len(keys))), pa.array(first, pa.int32()), lists(stops, stop_kind), lists(edges, edge_kind)], names=[*keys, "first", "stops", "edges"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + f", first int, stops {STOPS}, edges {EDGES}"
    return texts.where(F.col(text_col).isNotNull() & (F.length(text_col) > 0)).select(*keys, text_col).mapInArrow(run, schema)


def read(text: str) -> tuple[int, list[tuple], list[tuple]] | None:
    """first, stops and edges of a text; None if it is blank."""
    stops: list[tuple] = []
    edges: list[tuple] = []
    size = len(text)
    first = size - len(text.lstrip())
    if first == size:
        return None

    def stop(at: int) -> None:
        end, after = at, at
        while end and text[end - 1].isspace():
            end -= 1
        while after < size and text[after].isspace():
            after += 1
        stops.append((end, after, -1, 0, None, None, None))

    plain = text.isascii()
    letters = frozenset() if SPECIAL.search(text) is None else frozenset(text)
    thai, unspaced = not THAI_LETTERS.isdisjoint(letters), not UNSPACED_LETTERS.isdisjoint(letters)
    blanks = unspaced and HAS_BLANK_GAP.search(text) is not None
    pattern = ASCII_GAP if plain else COMMON_GAP if RARE.isdisjoint(letters) else GAP
    notices = "\u00a9" in text or "(c)" in text or "(C)" in text or "Copyright" in text
    for number, (start, end, table_line) in enumerate(parts(text, unspaced)):
        chain, certain = ([], []) if table_line else gaps(text, start, end, number, pattern, thai, blanks, notices)
        here = len(stops)
        stops += chain
        for at in certain:
            stop(start + at)
        if certain:
            stops[here:] = sorted(stops[here:], key=itemgetter(0))
        stop(end)
        for at in certain:
            edges.append(("^", "", right_form(text[start:end], at)))
        if chain:
            part = text[start:end].strip()
            if not MARK.match(part):
                edges.append(("^", "", right_form(part)))
            if part.rstrip(CLOSING)[-1:] in ENDING or thai and HAS_THAI.search(part[-12:]) or BARE_END.search(part) and not any(c in ENDING for g in chain for c in g[5]):
                words = part.rsplit(None, 2)[-2:]
                edges.append((word_form(words[-2])[-12:] if len(words) > 1 else "", left_form(words[-1]), ""))
    return first, stops, edges


def ngrams(observed: DataFrame) -> DataFrame:
    """The distinct n-grams of open places and edges: before, left, right, n, `shape` of the left and `kind` of the right word, `open`."""
    seen = observed.select(F.explode(F.filter("stops", lambda x: x["chain"] >= 0)).alias("x")).select("x.before", "x.left", "x.right", F.lit(True).alias("open"))
    edges = observed.select(F.explode("edges").alias("x")).select("x.before", "x.left", "x.right", F.lit(False).alias("open"))
    counts = seen.union(edges).groupBy("before", "left", "right", "open").agg(F.count("*").alias("n"))

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shape = pa.array([left_class(x) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, shape], names=["before", "left", "right", "open", "n", "shape"])

    return counts.mapInArrow(shapes, "before string, left string, right string, open boolean, n long, shape string").withColumn("kind", F.substring_index("right", ":", 1))


def start_guess(grams: DataFrame) -> DataFrame:
    """`grams` with `p`, what each is taken for before the first round; block ends are boundaries for certain."""
    sums = lambda *keys: grams.where("left <> ''").groupBy(*keys).agg(F.sum(F.when(F.col("open"), 0).otherwise(F.col("n"))).cast("double").alias("at_end"), F.sum(F.when(F.col("open"), F.col("n")).otherwise(0)).cast("double").alias("elsewhere"))
    rate = grams.where("shape in ('!', '?')").agg(F.sum(F.when(F.col("open"), 0).otherwise(F.col("n"))), F.sum("n")).first()
    usual = max(0.02, (rate[0] or 0) / max(1.0, rate[1] or 0))
    pairs = sums("before", "left").select("before", "left", F.col("at_end").alias("pair_end"), F.col("elsewhere").alias("pair_else"))
    asked = grams.where("open").join(sums("left"), "left").join(pairs, ["before", "left"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, *counts = (batch.column(k).to_pylist() for k in (1, 2, 6, 7, 8, 9))
            p = [first_guess(a, b, (d, e) if d + e >= PAIRS and not left_class(a).startswith(("b", "q")) else (m, n), usual) for a, b, m, n, d, e in zip(left, right, *counts, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(6)), pa.array(p, pa.float64())], names=["before", "left", "right", "n", "shape", "kind", "p"])

    return asked.select("before", "left", "right", "n", "shape", "kind", "at_end", "elsewhere", "pair_end", "pair_else").mapInArrow(run, "before string, left string, right string, n long, shape string, kind string, p double")


def weighed(open_grams: DataFrame, edges: DataFrame) -> DataFrame:
    """`open_grams` with the weights `b` of a boundary and `c` of none that follow from their `p`: one round on the table."""
    ends = edges.where("left <> ''").select("before", "left", "shape", F.col("n").alias("all"), F.col("n").cast("double").alias("yes"))
    begun = edges.where("left = ''").select("right", "kind", F.col("n").cast("double").alias("start"), F.lit(0.0).alias("inside"))
    pairs = open_grams.select("before", "left", "shape", F.col("n").alias("all"), (F.col("n") * F.col("p")).alias("yes")).union(ends).groupBy("before", "left", "shape").agg(F.sum("all").alias("pair_all"), F.sum("yes").alias("pair_yes"))
    lefts = pairs.groupBy("left", "shape").agg(F.sum("pair_all").alias("left_all"), F.sum("pair_yes").alias("left_yes"))
    shapes = lefts.groupBy("shape").agg(F.sum("left_all").alias("shape_all"), F.sum("left_yes").alias("shape_yes"))
    back = lambda yes, total, p: (F.col(yes) + BACK * p) / (F.col(total) + BACK)
    by_left = lefts.join(F.broadcast(shapes), "shape").select("left", back("left_yes", "left_all", (F.col("shape_yes") + 0.5) / (F.col("shape_all") + 1)).alias("of_left"))  # as many rows as there are shapes
    by_pair = pairs.join(by_left, "left").select("before", "left", F.least(F.greatest(back("pair_yes", "pair_all", F.col("of_left")), F.lit(LEAST)), F.lit(1 - LEAST)).alias("boundary"))
    words = open_grams.select("right", "kind", (F.col("n") * F.col("p")).alias("start"), (F.col("n") * (1 - F.col("p"))).alias("inside")).union(begun).groupBy("right", "kind").agg(F.sum("start").alias("start"), F.sum("inside").alias("inside"))
    kinds = words.groupBy("kind").agg(F.sum("start").alias("kind_start"), F.sum("inside").alias("kind_inside"), (F.count("*") + 1).alias("size"))
    every = Window.partitionBy(F.lit(0))  # over a handful of kinds
    kinds = kinds.withColumns({"starts": F.sum("kind_start").over(every) + 1, "insides": F.sum("kind_inside").over(every) + 1})
    chance = lambda exact, of_kind, n: EXACT * F.col(exact) / F.col(n) + (1 - EXACT) * (F.col(of_kind) + 0.1) / (F.col(n) + 2) / F.col("size")
    by_word = words.join(F.broadcast(kinds), "kind").select("right", chance("start", "kind_start", "starts").alias("begins"), chance("inside", "kind_inside", "insides").alias("goes_on"))
    joined = open_grams.join(by_pair, ["before", "left"]).join(by_word, "right")
    return joined.withColumns({"b": F.col("boundary") * F.col("begins"), "c": (1 - F.col("boundary")) * F.col("goes_on")})


def fit(observed: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """before, left, right and the fitted weights b and c of every n-gram of an open place, by expectation-maximisation over all of them."""
    grams = durable_table(ngrams(observed), "ngrams")
    edges = grams.where("not open").select("before", "left", "right", "n", "shape", "kind")
    table = durable_table(start_guess(grams), "guess")
    for n in range(rounds):
        table = weighed(table, edges).select("before", "left", "right", "n", "shape", "kind", "b", "c", (F.col("b") / (F.col("b") + F.col("c"))).alias("p"))
        table = durable_table(table, "round")
    return table.select("before", "left", "right", "b", "c")


def gram_key(*words: Column) -> Column:
    return F.xxhash64(*words)


def split_sentences(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """One row per unit: the keys, `unit_no` (from 1), `start_pos`, `end_pos` (characters, from 1, both included).

    Null, empty and blank texts have no rows. Each text is split whole, by a model of all of them; equal keys don't clash.
    """
    observed = durable_table(observe(texts, keys, text_col).withColumn("_t", F.monotonically_increasing_id()), "gaps")
    kinds = dict(texts.dtypes)
    odds = fit(observed).select(gram_key(F.col("before"), F.col("left"), F.col("right")).alias("_g"), "b", "c")
    places = observed.select("_t", F.posexplode("stops").alias("_at", "x")).where("x.chain >= 0").select("_t", "_at", gram_key(F.col("x.before"), F.col("x.left"), F.col("x.right")).alias("_g"))
    scored = places.join(odds, "_g").groupBy("_t").agg(F.array_sort(F.collect_list(F.struct("_at", "b", "c"))).alias("_w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, lists = batch.column(len(keys)).to_numpy(), [batch.column(len(keys) + k) for k in range(1, 7)]
            places, weights = lists[0].offsets.to_numpy(), lists[4].offsets.to_numpy()
            at, after, chain, words = (x.values.to_numpy()[places[0] : places[-1]] for x in lists[:4])
            boundary, none = (x.values.to_numpy()[weights[0] : weights[-1]] for x in lists[4:])
            row = np.repeat(np.arange(len(batch)), np.diff(places))
            chosen = chosen_stops(row, chain, words, boundary, none)
            row, end, after = row[chosen], at[chosen].astype(np.int64), after[chosen].astype(np.int64)
            begin = np.empty(len(row), np.int64)  # where the stop before says, but never before an earlier one
            begin[1:] = after[:-1]
            new = np.diff(row, prepend=-1) > 0
            begin[new] = first[row[new]]
            most = max(int(after.max(initial=0)), int(first.max(initial=0))) + 1
            begin = np.maximum.accumulate(begin + row * most) - row * most
            held = begin < end
            row, begin, end = row[held], begin[held], end[held]
            no = np.arange(1, len(row) + 1) - np.searchsorted(row, row)
            taken = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(taken) for c in range(len(keys))), pa.array(no, pa.int32()), pa.array(begin + 1, pa.int64()), pa.array(end, pa.int64())], names=[*keys, "unit_no", "start_pos", "end_pos"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", unit_no int, start_pos long, end_pos long"
    none = F.array().cast("array<double>")
    told = observed.select("_t", *keys, "first", *(F.col(f"stops.{c}").alias(f"_{c}") for c in ("at", "next", "chain", "words"))).join(scored, "_t", "left")
    return told.select(*keys, "first", "_at", "_next", "_chain", "_words", F.coalesce(F.col("_w.b"), none).alias("_b"), F.coalesce(F.col("_w.c"), none).alias("_c")).mapInArrow(run, schema)


def chosen_stops(row: np.ndarray, chain: np.ndarray, words: np.ndarray, boundary: np.ndarray, none: np.ndarray) -> np.ndarray:
    """Which places of texts (by row) end a unit: the certain ones, and open ones whose posterior in their chain is at least one half. boundary and none: the weights of the open places.

    The passes of `odds_of` run over all chains at once, from place to place.
    """
    out = np.ones(len(chain), bool)
    places = np.flatnonzero(chain >= 0)
    if len(places) != len(boundary):
        raise ValueError("as many weights as open places are needed")
    row, chain, step = row[places], chain[places], LENGTHS[np.minimum(words[places], len(LENGTHS) - 1)]
    start = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(chain, prepend=-1) != 0))
    size = np.diff(start, append=len(places))
    single = start[size == 1]
    out[places[single]] = boundary[single] * step[single] >= none[single]
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 1]
    start, size = start[order], size[order]  # the longest first, so those that go on are the first ones
    going = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0))
    forward = np.zeros((2, len(places)))
    one, zero = np.zeros(len(size)), np.ones(len(size))
    for k, n in enumerate(going.tolist()):
        at, one, zero = start[:n] + k, one[:n], zero[:n]
        b, c = boundary[at], none[at]
        one, zero = (b * step[at], c * zero) if k == 0 else (b * (one * step[at] + zero), c * (one + zero))
        total = one + zero
        total[total == 0] = 1.0
        one, zero = one / total, zero / total
        forward[0, at], forward[1, at] = one, zero
    ahead = np.ones((2, len(size)))
    for k, n in enumerate(going.tolist()):
        at = start[:n] + size[:n] - 1 - k
        one, zero = ahead[0, :n], ahead[1, :n]
        yes, no = forward[0, at] * one, forward[1, at] * zero
        total = yes + no
        total[total == 0] = 1.0
        out[places[at]] = yes / total >= 0.5
        b, c = boundary[at], none[at]
        one, zero = b * step[at] * one + c * zero, b * one + c * zero
        total = one + zero
        total[total == 0] = 1.0
        ahead[0, :n], ahead[1, :n] = one / total, zero / total
    return out
