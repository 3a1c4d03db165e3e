"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Java character class (all of Unicode's, and the separators U+001C to U+001F).
SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(text: Column) -> Column:
    """Without white space at either end; `trim` knows the blank only."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def tokens(text: Column) -> Column:
    """Words of letters, digits and underscores in lower case, with repetitions; null gives null."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def sentences(text: Column) -> Column:
    """Split at white space after . ! ? before a capital or digit; each stripped, empty ones dropped."""
    split = F.split(text, rf"(?<=[.!?]){SPACE}+(?=[A-ZÅÄÖ0-9])")
    return F.filter(F.transform(split, strip), lambda s: s != "")


def capitalised(name: Column) -> Column:
    """The first letter in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name)))


def period_label(column: Column) -> Column:
    """A column's head without the dash and blanks that a period may start with."""
    return strip(F.regexp_replace(column, "^[−– -]+", ""))


def values_phrase(columns: Column, values: Column) -> Column:
    """`value (column)` of each value that is present, in order; a fixed phrase if there is none."""
    pairs = F.filter(F.arrays_zip(columns.alias("c"), values.alias("v")), lambda p: p["v"].isNotNull() & p["c"].isNotNull())
    listed = F.array_join(F.transform(pairs, lambda p: F.concat(p["v"], F.lit(" ("), period_label(p["c"]), F.lit(")"))), ", ")
    return F.when(F.size(pairs) > 0, listed).otherwise("inget värde angivet")


def row_sentence(company: Column, section: Column, year: Column, label: Column, columns: Column, values: Column) -> Column:
    """A table row as one sentence."""
    return F.concat(company, F.lit(" "), section, F.lit(" "), year, F.lit(": "), label, F.lit(" var "), values_phrase(columns, values), F.lit("."))


def plain_integer(value: Column) -> Column:
    """An amount printed with any separators as a whole number; null if it holds anything else."""
    bare = F.regexp_replace(F.regexp_replace(value, "^[−–-]", "-"), f"[.,]|{SPACE}", "")
    return bare.try_cast("bigint")


def base_id(chunk_id: Column) -> Column:
    """The id of the chunk that a part was split from."""
    return F.regexp_replace(chunk_id, r"::del\d+$", "")
