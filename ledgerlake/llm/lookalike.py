"""One form for texts that look the same but differ in their characters.

Method: text is parted into words; words that hold nothing but characters known to be in final form
are left (a quick check). The others are exploded, each distinct word once, to positioned code points; a broadcast join gives
each code point its decomposition with look-alike letters replaced and the combining class of each
part; parts are grouped into a base and its marks, marks ordered by class; a second broadcast join
recomposes; words and texts are rebuilt in order.

The form: full and half width and ligatures resolved, letters of other scripts replaced by the Latin
letter of the same shape, accents composed where one character has the base and all its marks (else marks in the
order of their classes), conjoining jamo as syllables, invisible characters dropped, each run of white space one
blank, none at the ends. Case, accents, superscripts and other signs stay.

Both mappings follow from the Unicode character data of Python by rule; their size is bounded by
the standard (some ten thousand short rows), so they are broadcast.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.forms import shapes
from ..scratch import durable_table

#: Signs taken for a dash or a minus sign.
DASHES = "-‐‑‒–—―−﹘﹣－"
#: White space of any kind, as a Java character class.
BLANK = r"[\s\u0085   -     　\u001C-\u001F]"
#: Characters in final form whatever stands beside them, as a Java character class.
FINAL = r"[!-~¡-¬®-´¶-İĲ-ňŊ-ž‒-‧‰-⁞−€、-〩ぁ-ゖァ-ヾ一-鿿가-힣]"


@lru_cache(maxsize=1)
def mappings() -> tuple[list, list]:
    """Rows (code point, parts with class) of every code point that isn't its own only part, and rows (parts, composed)."""
    same = shapes()
    resolved = ("<wide>", "<narrow>", "<noBreak>", "<font>")
    follows = lambda c: "\u1160" <= c <= "\u11ff"  # vowels and finals of Hangul stand behind a base as marks do
    order = lambda c: 1 if follows(c) else unicodedata.combining(c)

    def parts(c: str) -> str:
        if unicodedata.category(c) == "Cf" or "︀" <= c <= "️" or c == "͏":
            return ""
        if "가" <= c <= "힣":
            return unicodedata.normalize("NFD", c)
        how = unicodedata.decomposition(c)
        ligature = how.startswith("<compat>") and 0xFB00 <= ord(c) <= 0xFB06
        if how and (not how.startswith("<") or how.split()[0] in resolved or ligature):
            return "".join(parts(chr(int(x, 16))) for x in how.split() if x[0] != "<")
        return same.get(c, c)

    split, joined = [], {}
    for n in range(0xA0, 0x30000):
        c = chr(n)
        if 0xD800 <= n <= 0xDFFF or unicodedata.category(c) == "Cn":
            continue
        to = parts(c)
        if to != c or order(c):
            split.append((c, [(x, order(x)) for x in to]))
        full = unicodedata.normalize("NFD", c)
        if len(full) > 1 and unicodedata.normalize("NFC", full) == c:
            joined[full] = c
    for full, c in list(joined.items()):  # a base replaced by its look-alike composes too
        other = same.get(full[0], full[0]) + full[1:]
        joined.setdefault(other, unicodedata.normalize("NFC", other))
        if unicodedata.normalize("NFC", other) == other:
            joined.pop(other)
    return split, sorted(joined.items())


def mapping_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    split, joined = mappings()
    return (
        F.broadcast(spark.createDataFrame(split, "c string, parts array<struct<p:string,k:int>>").coalesce(1)),
        F.broadcast(spark.createDataFrame(joined, "cluster string, composed string").coalesce(1)),
    )


def one_form(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per row of `df`: the id (unique, of any type that groups) and `look`, the one form of its text.

    A null text has a null look, an empty or blank one an empty look. Other columns are pruned.
    """
    split, joined = mapping_tables(df.sparkSession)
    words = F.split(F.regexp_replace(text_col, f"^{BLANK}+|{BLANK}+$", ""), f"{BLANK}+")
    texts = df.select(F.col(id_col).alias("_id"), words.alias("_words"))
    numbered = F.transform("_words", lambda w, i: F.struct(i.alias("i"), w.alias("w")))
    final = f"^{FINAL}*$"
    others = texts.select("_id", F.explode(F.filter(numbered, lambda x: ~x.w.rlike(final))).alias("_x")).select("_id", F.col("_x.i").alias("i"), F.col("_x.w").alias("w"))
    word = ["_a", "_b"]  # 128 bits of a word
    hashed = others.withColumns({"_a": F.xxhash64("w"), "_b": F.xxhash64(F.lit(1), F.reverse("w"))})
    points = hashed.select(*word, "w").distinct().select(*word, F.posexplode(F.regexp_extract_all("w", F.lit(r"(?s)(.)"), F.lit(1))).alias("_at", "c"))
    parts = points.join(split, "c", "left").select(*word, "_at", F.posexplode(F.coalesce("parts", F.array(F.struct(F.col("c").alias("p"), F.lit(0).alias("k"))))).alias("_j", "x"))
    # base letters count clusters up; marks come in the order of their class, equal ones as written
    order = Window.partitionBy(*word).orderBy("_at", "_j")
    numbers = parts.select(*word, "_at", "_j", "x.p", "x.k", F.sum((F.col("x.k") == 0).cast("int")).over(order).alias("n"))
    clusters = numbers.groupBy(*word, "n").agg(F.array_join(F.array_sort(F.collect_list(F.struct("k", "_at", "_j", "p")))["p"], "").alias("cluster"))
    composed = clusters.join(joined, "cluster", "left").select(*word, "n", F.coalesce("composed", "cluster").alias("s"))
    folded = composed.groupBy(*word).agg(F.array_join(F.array_sort(F.collect_list(F.struct("n", "s")))["s"], "").alias("look"))
    lists = hashed.drop("w").join(folded, word, "left").groupBy("_id").agg(F.collect_list(F.struct("i", F.coalesce("look", F.lit("")).alias("w"))).alias("_folded"))
    together = texts.join(lists, "_id", "left")
    kept = F.filter(numbered, lambda x: x.w.rlike(final))
    words = F.array_sort(F.concat(kept, F.coalesce("_folded", F.array().cast("array<struct<i:int,w:string>>"))))
    look = F.array_join(F.filter(F.transform(words, lambda x: x.w), lambda w: w != ""), " ")
    return together.select(F.col("_id").alias(id_col), F.when(F.col("_words").isNotNull(), look).alias("look"))


def value_look(look: Column) -> Column:
    """The look of a single value: a dash or minus sign of any kind at its start is a hyphen."""
    return F.regexp_replace(look, f"^[{DASHES.replace('-', '')}-]", "-")


def _known(df: DataFrame, keys: list[str], content: Column) -> DataFrame:
    """The rows with keys and content, with `_raw`, 128 bits of the content."""
    return df.withColumn("_raw", F.md5(content)).where(" and ".join(f"`{k}` is not null" for k in keys) + " and _raw is not null")


def _differing(df: DataFrame, keys: list[str], content: Column) -> DataFrame:
    """Those of them whose keys other rows with other content share."""
    known = _known(df, keys, content)
    several = known.groupBy(*keys).agg(F.min("_raw").alias("_least"), F.max("_raw").alias("_most")).where("_least < _most").select(*keys)
    return known.join(several, keys, "left_semi")


def _pairs(looks: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Pairs of ids that share keys and look but not the raw content."""
    one = looks.select(*keys, "_look", F.col(id_col).alias("id_a"), F.col("_raw").alias("_a"))
    two = looks.select(*keys, "_look", F.col(id_col).alias("id_b"), F.col("_raw").alias("_b"))
    return one.join(two, [*keys, "_look"]).where("id_a < id_b and _a <> _b").select("id_a", "id_b")


def _classes(looks: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """One row per row with keys and content: the id, `class` (the least id with the same keys and look), `members` and `forms` (different contents) of the class."""
    one = looks.groupBy(*keys, "_look").agg(F.min(id_col).alias("class"), F.count("*").alias("members"), F.count_distinct("_raw").alias("forms"))
    return looks.select(id_col, *keys, "_look").join(one, [*keys, "_look"]).select(F.col(id_col).alias("id"), "class", "members", "forms")


def _kept(rows: DataFrame, id_col: str, keys: list[str], look: Column) -> DataFrame:
    """Ids, keys and 128 bits of content and look, written once: whatever joins them with themselves doesn't make the looks again."""
    return durable_table(rows.select(id_col, *keys, "_raw", F.md5(look).alias("_look")), "looks")


def _text_looks(df: DataFrame, id_col: str, keys: list[str], text_col: str, some) -> DataFrame:  # noqa: ANN001
    rows = some(df.select(id_col, *keys, text_col), keys, F.col(text_col))
    return _kept(rows.join(one_form(rows, id_col, text_col), id_col), id_col, keys, F.col("look"))


def _value_looks(df: DataFrame, id_col: str, keys: list[str], values_col: str, some) -> DataFrame:  # noqa: ANN001
    rows = some(df.select(id_col, *keys, values_col), keys, place_key(F.col(values_col)))
    return _kept(rows.join(one_form_values(rows, id_col, values_col), id_col), id_col, keys, place_key(F.col("looks")))


def text_classes(df: DataFrame, id_col: str, keys: list[str], text_col: str) -> DataFrame:
    """Classes of texts that look the same, without pairs. Rows with a null key or text have no row."""
    return _classes(_text_looks(df, id_col, keys, text_col, _known), keys, id_col)


def value_classes(df: DataFrame, id_col: str, keys: list[str], values_col: str) -> DataFrame:
    """Classes of arrays that look the same place by place, without pairs."""
    return _classes(_value_looks(df, id_col, keys, values_col, _known), keys, id_col)


def same_looking_texts(df: DataFrame, id_col: str, keys: list[str], text_col: str) -> DataFrame:
    """Pairs of rows (`id_a` < `id_b`) with equal keys whose texts differ but look the same. Null keys and texts have no pairs."""
    return _pairs(_text_looks(df, id_col, keys, text_col, _differing), keys, id_col)


def one_form_values(df: DataFrame, id_col: str, values_col: str) -> DataFrame:
    """One row per row of `df`: the id and `looks`, the array of its values, each in one form; nulls stay null."""
    places = df.select(F.col(id_col).alias("_row"), F.posexplode(values_col).alias("_at", "_value")).withColumn("_key", F.struct("_row", "_at"))
    looks = one_form(places, "_key", "_value").select(F.col("_key._row").alias("_row"), F.struct(F.col("_key._at").alias("at"), value_look(F.col("look")).alias("look")).alias("_x"))
    arrays = looks.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list("_x")), lambda x: x.look).alias("_looks"))
    joined = df.select(F.col(id_col), F.col(values_col)).join(arrays, F.col(id_col) == F.col("_row"), "left")
    return joined.select(id_col, F.when(F.size(values_col) == 0, F.array().cast("array<string>")).otherwise(F.col("_looks")).alias("looks"))


def place_key(values: Column) -> Column:
    """A string that two arrays share only if they are equal place by place, nulls included."""
    return F.array_join(F.transform(values, lambda x: F.coalesce(F.concat(F.lit("="), x), F.lit("~"))), "\u0001")


def same_looking_values(df: DataFrame, id_col: str, keys: list[str], values_col: str) -> DataFrame:
    """Pairs of rows (`id_a` < `id_b`) with equal keys whose values differ but look the same place by place."""
    return _pairs(_value_looks(df, id_col, keys, values_col, _differing), keys, id_col)
