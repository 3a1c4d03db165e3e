"""Characters that look alike, for parsers that must not trip over them."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

#: Letters with the shape of a Latin letter, by script, and the Latin letters.
CYRILLIC = "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁԛԝһ", "ABESIJKMHOPCTYXaesijopcyxdqwh"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναιρυγκϳ", "ABEZHIKMNOPTYXovaipuykj"
ARMENIAN = "ԼՍՏՕհոսցօ", "LUSOhnugo"
CHEROKEE = "ᎪᏴᏟᎠᎬᏀᎻᏆᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHIJKLMPRSTVWZ"
OTHER = "ⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿ‐‑ɑɡıℓµ", "IVXLCDMivxlcdm--agilμ"


def shapes() -> dict[str, str]:
    """Letter to the Latin letter of its shape."""
    return {a: b for one, two in (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, OTHER) for a, b in zip(one, two, strict=True)}


SHAPES = str.maketrans(shapes())


@lru_cache(maxsize=4096)
def _clean_char(c: str) -> str:
    if unicodedata.category(c) == "Cf":
        return ""
    how = unicodedata.decomposition(c)
    if how.startswith(("<wide>", "<narrow>", "<noBreak>")) or how.startswith("<compat>") and c.isspace():
        c = unicodedata.normalize("NFKC", c)
    return " " if c.isspace() and c != "\n" else c.translate(SHAPES)


def clean(text: str) -> str:
    """`text` without invisible characters, in plain width, blanks and Latin letters; superscripts stay."""
    if text.isascii():
        return text.replace("\t", " ").strip()
    return unicodedata.normalize("NFC", "".join(map(_clean_char, text))).strip()
