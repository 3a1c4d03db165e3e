"""A grammar of numbers and unit expressions.

A unit is a dimension (a vector of exponents over DIMENSIONS), a scale and an offset: the value in
base units is `number * scale + offset`. Expressions combine scale words, prefixes, powers, products and
quotients: vectors add, subtract and multiply with their units. An offset belongs to a temperature that
stands alone; within a product or quotient a temperature is a difference and has none. CANONICAL
names the dimensions that have a canonical unit. Numbers are exact decimals.
"""

from __future__ import annotations

import re
from decimal import ROUND_HALF_EVEN, Context, Decimal
from functools import lru_cache
from typing import NamedTuple

from .forms import clean

CURRENCY_NAMES = ("sek", "eur", "usd", "gbp", "nok", "dkk", "chf")
DIMENSIONS = (*CURRENCY_NAMES, "length", "mass", "time", "temperature", "count", "share")
#: Digits that arithmetic keeps: more than any printed number has.
EXACT = Context(prec=200, rounding=ROUND_HALF_EVEN)


class Unit(NamedTuple):
    """Exponents over DIMENSIONS, scale and offset; the base units are one of each currency, m, g, s, K, pieces and the whole."""

    vector: tuple[int, ...]
    scale: Decimal
    offset: Decimal = Decimal(0)

    def __mul__(self, other: Unit) -> Unit:  # type: ignore[override]
        offset = self.offset if not any(other.vector) else other.offset if not any(self.vector) else Decimal(0)
        return Unit(tuple(a + b for a, b in zip(self.vector, other.vector, strict=True)), EXACT.multiply(self.scale, other.scale), offset)

    def __truediv__(self, other: Unit) -> Unit:
        return self * other.power(-1)

    def power(self, n: int) -> Unit:
        return self if n == 1 else Unit(tuple(n * a for a in self.vector), Context(prec=40).power(self.scale, n))

    @property
    def money(self) -> bool:
        return any(self.vector[: len(CURRENCY_NAMES)])


def dim(name: str = "", exponent: int = 1, **more: int) -> tuple[int, ...]:
    exponents = {name: exponent} | more
    return tuple(exponents.get(d, 0) for d in DIMENSIONS)


NUMBER = dim()
ENERGY, POWER = dim(mass=1, length=2, time=-2), dim(mass=1, length=2, time=-3)
#: Dimension vector to the canonical unit's name and how many of it the base unit is.
CANONICAL = {
    dim("sek"): ("sek", "100"), dim("eur"): ("eur", "100"), dim("usd"): ("usd", "100"), ENERGY: ("kj", "0.000001"), dim("mass"): ("g", "1"),
    dim("length"): ("m", "1"), dim("length", 2): ("m2", "1"), dim("length", 3): ("l", "1000"), dim("count"): ("count", "1"), dim("share"): ("ppm", "1000000"),
}
#: Words of scale.
SCALES = {
    "tusen": 3, "tusental": 3, "thousand": 3, "000": 3, "000-tal": 3, "1000-tal": 3, "milj": 6, "miljon": 6, "miljoner": 6, "million": 6, "millions": 6, "mn": 6, "mio": 6,
    "mdr": 9, "md": 9, "miljard": 9, "miljarder": 9, "bn": 9, "billion": 9, "mrd": 9,
}
#: Names of currencies, and prefixes and endings that scale them.
CURRENCIES = {
    "kr": "sek", "krona": "sek", "kronor": "sek", "sek": "sek", "eur": "eur", "euro": "eur", "€": "eur", "usd": "usd", "dollar": "usd", "$": "usd", "gbp": "gbp", "£": "gbp", "pund": "gbp",
    "nok": "nok", "dkk": "dkk", "chf": "chf",
}
MONEY_PREFIXES = {"t": 3, "k": 3, "m": 6, "mn": 6, "md": 9}
#: Units with prefixes, in base units; a litre is 0.001 m3, a joule 1,000 g m2 s-2.
PREFIXED = {
    "wh": (ENERGY, "3600000"), "j": (ENERGY, "1000"), "w": (POWER, "1000"), "g": (dim("mass"), "1"), "t": (dim("mass"), "1000000"), "ton": (dim("mass"), "1000000"), "m": (dim("length"), "1"), "l": (dim("length", 3), "0.001"),
}
PREFIXES = {"k": 3, "m": 6, "g": 9, "t": 12}
#: Units before which a small m is a thousandth.
MILLI = {"g", "l", "m"}
#: Other units.
PLAIN = {
    "öre": (dim("sek"), "0.01"), "cent": (dim("eur"), "0.01"), "meter": (dim("length"), "1"), "mil": (dim("length"), "10000"), "cm": (dim("length"), "0.01"), "mm": (dim("length"), "0.001"), "dm": (dim("length"), "0.1"),
    "ha": (dim("length", 2), "10000"), "hektar": (dim("length", 2), "10000"), "kvm": (dim("length", 2), "1"), "kvadratmeter": (dim("length", 2), "1"), "kvadratkilometer": (dim("length", 2), "1000000"), "kilometer": (dim("length"), "1000"),
    "kubikmeter": (dim("length", 3), "1"), "kbm": (dim("length", 3), "1"), "liter": (dim("length", 3), "0.001"), "dl": (dim("length", 3), "0.0001"), "cl": (dim("length", 3), "0.00001"), "ml": (dim("length", 3), "0.000001"),
    "tonnes": (dim("mass"), "1000000"), "tonne": (dim("mass"), "1000000"), "tons": (dim("mass"), "1000000"), "gram": (dim("mass"), "1"), "kilogram": (dim("mass"), "1000"), "kilo": (dim("mass"), "1000"),
    "st": (dim("count"), "1"), "styck": (dim("count"), "1"), "stycken": (dim("count"), "1"), "antal": (dim("count"), "1"), "pcs": (dim("count"), "1"),
    "%": (dim("share"), "0.01"), "procent": (dim("share"), "0.01"), "percent": (dim("share"), "0.01"), "procentenheter": (dim("share"), "0.01"), "‰": (dim("share"), "0.001"), "promille": (dim("share"), "0.001"), "ppm": (dim("share"), "0.000001"),
    "baspunkt": (dim("share"), "0.0001"), "baspunkter": (dim("share"), "0.0001"), "räntepunkt": (dim("share"), "0.0001"), "räntepunkter": (dim("share"), "0.0001"), "bps": (dim("share"), "0.0001"), "bp": (dim("share"), "0.0001"),
    "kvot": (dim("share"), "1"), "andel": (dim("share"), "1"), "ratio": (dim("share"), "1"),
    "s": (dim("time"), "1"), "sekund": (dim("time"), "1"), "sekunder": (dim("time"), "1"), "min": (dim("time"), "60"), "minut": (dim("time"), "60"), "minuter": (dim("time"), "60"),
    "h": (dim("time"), "3600"), "tim": (dim("time"), "3600"), "timme": (dim("time"), "3600"), "timmar": (dim("time"), "3600"), "hours": (dim("time"), "3600"), "dag": (dim("time"), "86400"), "dagar": (dim("time"), "86400"),
    "dygn": (dim("time"), "86400"), "days": (dim("time"), "86400"), "år": (dim("time"), "31557600"), "years": (dim("time"), "31557600"), "k": (dim("temperature"), "1"), "kelvin": (dim("temperature"), "1"),
}
#: Temperatures with an offset.
TEMPERATURES = {"°c": ("1", "273.15"), "celsius": ("1", "273.15"), "℃": ("1", "273.15"), "°f": ("0.5555555555555555555555555555", "255.3722222222222222222222222222"), "fahrenheit": ("0.5555555555555555555555555555", "255.3722222222222222222222222222")}
#: Words that name a unit only beside a number, in brackets or within an expression; at a text's end they are mostly something else.
WEAK = {"s", "h", "k", "w", "min"}
#: What a quotient may be by without changing the kind of the amount.
EACH = {"aktie", "aktier", "share"}
#: Signs taken for a minus sign, as a character class.
MINUS = r"\-‐‑‒–—―−﹘﹣－"
RAISED = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789")


@lru_cache(maxsize=50_000)
def atom(word: str) -> Unit | None:
    """One word without a blank."""
    low = word.lower().rstrip(".")
    if low in SCALES:
        return Unit(NUMBER, Decimal(10) ** SCALES[low])
    if low in CURRENCIES:
        return Unit(dim(CURRENCIES[low]), Decimal(1))
    if low in PLAIN:
        return Unit(PLAIN[low][0], Decimal(PLAIN[low][1]))
    if low in TEMPERATURES:
        return Unit(dim("temperature"), *map(Decimal, TEMPERATURES[low]))
    for name, of in CURRENCIES.items():
        if low.endswith(name) and low[: -len(name)] in MONEY_PREFIXES:
            return Unit(dim(of), Decimal(10) ** MONEY_PREFIXES[low[: -len(name)]])
        if low.startswith(name) and low[len(name) :] in ("m", "mn", "k", "t", "bn"):
            return Unit(dim(of), Decimal(10) ** {"m": 6, "mn": 6, "k": 3, "t": 3, "bn": 9}[low[len(name) :]])
    raised = re.fullmatch(r"([^\W\d]+)(\^?)([-−⁻]?)([0-9]|[⁰¹²³⁴-⁹])", word.rstrip("."))
    if raised:
        base, explicit = atom(raised[1]), raised[2] or raised[3] or raised[4] in "⁰¹²³⁴⁵⁶⁷⁸⁹"
        if base is None or not any(base.vector) or not (explicit or base.vector == dim("length") and raised[4] in "23"):
            return None
        return base.power(int(raised[4].translate(RAISED)) * (-1 if raised[3] else 1))
    if low in PREFIXED:
        return Unit(PREFIXED[low][0], Decimal(PREFIXED[low][1]))
    if low[:1] in PREFIXES and low[1:] in PREFIXED:
        exponent = -3 if word[0] == "m" and low[1:] in MILLI else PREFIXES[low[0]]
        return Unit(PREFIXED[low[1:]][0], Decimal(PREFIXED[low[1:]][1]) * Decimal(10) ** exponent)
    return None


def product(text: str) -> Unit | None:
    """Scale words and one unit, or several units with signs of multiplication between them."""
    whole = Unit(NUMBER, Decimal(1))
    for factor in re.split(r"\s*[·⋅×*]\s*", text):
        part, empty = Unit(NUMBER, Decimal(1)), True
        for word in re.findall(r"000-tal|1000-tal|[€$£%‰]|[^\s€$£%‰]+", factor):
            one = Unit(NUMBER, Decimal(1_000_000)) if part.money and word.lower() in ("m", "mn") else atom(word)
            if one is None or any(one.vector) and any(part.vector):
                return None
            part, empty = part * one, False
        if empty or part.money and whole.money:
            return None
        whole *= part
    return whole


@lru_cache(maxsize=50_000)
def parse_unit(text: str) -> Unit | None:
    """The unit that a cleaned expression states, or None: `tkr`, `SEK 000`, `milj. kr`, `km²`, `kr/aktie`, `tusen m³`, `kWh/m2`, `m·s⁻¹`."""
    first, *below = re.split(r"\s*/\s*|\s+per\s+", re.sub(r"^i\s+", "", text.strip()))
    whole = product(first)
    if whole is None:
        return None
    if not any(whole.vector):  # a scale alone counts pieces
        whole = Unit(dim("count"), whole.scale)
    each = False
    for q in below:
        if q.lower().rstrip(".") in EACH:
            each = True
            continue
        part = product(q)
        if part is None or not any(part.vector):
            return None
        whole = whole / part
        if not any(whole.vector):  # equal kinds: a plain quotient
            whole = Unit(dim("share"), whole.scale)
    return whole if whole.money or not each else None


def unit_text(unit: Unit) -> str:
    """The dimension in base units: `m s-1`."""
    names = {"length": "m", "mass": "g", "time": "s", "temperature": "K"}
    return " ".join(names.get(d, d) + (str(n) if n != 1 else "") for d, n in zip(DIMENSIONS, unit.vector, strict=True) if n)


FOOTNOTE = re.compile(r"(?:\s*\*+|\s*[⁰¹²³⁴-⁹]+[⁾)]?|(?<![\d.,])\s*\d{1,2}\)|\s*\(\s*not\s+\d+\s*\)|\s*\bnot\s+\d+)\s*$", re.I)


def without_footnotes(text: str) -> list[str]:
    """`text`, and what is left of it as footnote marks are taken off its end one by one."""
    out = [text]
    while (less := FOOTNOTE.sub("", out[-1], count=1)) != out[-1]:
        out.append(less)
    return out


def unitlike(word: str) -> bool:
    return atom(word) is not None or word.lower() == "per" or word.lower().rstrip(".") in EACH or any(c in word for c in "/·⋅×*€$£%‰")


def bare_unit(words: list[str]) -> Unit | None:
    """The unit of words without a sign that they are one; times and weak symbols aren't taken for it."""
    if len(words) == 1 and words[0].lower() in WEAK:
        return None
    unit = parse_unit(" ".join(words))
    return unit if unit and unit.vector != dim("time") else None


def last_unit(text: str) -> Unit | None:
    """The unit that a text of other words ends with: the longest ending that is one."""
    words = text.split()
    at = len(words)
    while at > 1 and unitlike(words[at - 1]):
        at -= 1
    return next((u for k in range(max(at, 1), len(words)) if (u := bare_unit(words[k:]))), None)


@lru_cache(maxsize=50_000)
def label_unit(label: str) -> Unit | None:
    """The unit that a row's label states: in brackets, before a colon, after a dash or comma, or as its last words."""
    text = clean(label)
    for text in without_footnotes(text):
        bracket = re.search(r"[(\[]([^()\[\]]*)[)\]]$", text)
        if bracket and (u := parse_unit(bracket[1])):
            return u
        before = re.match(r"([^:]+):\s", text)
        if before and (u := parse_unit(before[1])):
            return u
        after = re.split(r"\s[-–—−]\s|,\s", text)
        if len(after) > 1 and (u := parse_unit(after[-1])):
            return u
        if u := last_unit(text):
            return u
    return None


DATE = re.compile(rf"[{MINUS}]?\b(?:19|20)\d\d(?:[-/]\d\d(?:-\d\d)?)?\b")


@lru_cache(maxsize=50_000)
def column_unit(column: str) -> Unit | None:
    """The unit that a column's head states beside its period and segment."""
    for part in re.split(r"[,()\[\]:]", DATE.sub(" ", clean(column))):
        words = part.split()
        for n in range(len(words), 0, -1):
            if u := bare_unit(words[:n]) or bare_unit(words[-n:]):
                return u
    return None


#: Words around the unit in a line that states it for a table.
LEAD = re.compile(r"^(?:(?:alla |samtliga )?(?:belopp(?:en)?|siffror)(?: i (?:denna|tabellen))?(?: tabell)?(?: är| anges)? i|(?:all )?(?:amounts|figures)(?: in this table)?(?: are)? in|i|in)\s+", re.I)
STATES = re.compile(r"(?:alla|samtliga|belopp|siffror|all|amounts|figures)\b|beloppen\b", re.I)
TRAIL = re.compile(r"\s*,?\s*(?:om inget annat anges|om inte annat anges|där inte annat sägs|där inget annat sägs|unless otherwise (?:stated|indicated))\.?$", re.I)


@lru_cache(maxsize=200_000)
def line_unit(line: str) -> str | None:
    """The unit that a line states for a table and says nothing else, or None. A line on the currency of the whole report states no unit of a table.

    A line that only holds a unit, without words that say what it is for, has to name a currency: others are mostly column heads or the ends of sentences.
    """
    text = clean(line)
    bracket = re.fullmatch(r"[(\[]\s*([^()\[\]]*?)\s*[)\]]", text)
    body = LEAD.sub("", bracket[1] if bracket else text)
    first = re.match(r"[€$£%‰]|[^\s€$£%‰/]+", body)
    if first is None or not unitlike(first[0]):
        return None
    body = TRAIL.sub("", body)
    said = body != (bracket[1] if bracket else text)
    if not said and not bracket and body.endswith(".") and not body.lower().endswith("milj."):
        return None  # the last word of a sentence
    body = body.rstrip(".") if said or bracket else body
    unit = parse_unit(body)
    return body if unit and (unit.money or STATES.match(text.lstrip("([ ")) and unit.vector != dim("time")) else None


DIGITS = r"\d{1,3}(?: \d{3})+(?!\d)(?:[.,]\d+)?|\d+(?:[.,'’]\d+)*"
VALUE = re.compile(rf"(?P<pre>[^\d({MINUS}]*?)\s*(?P<minus>[{MINUS}]?)\s*(?P<open>\(?)\s*(?P<inner>[{MINUS}]?)\s*(?P<number>{DIGITS})\s*(?P<close>\)?)(?P<rest>.*)", re.S)
ABOUT = re.compile(r"^(?:ca\.?|c:a|cirka|circa|approx\.?|omkring|about|~|≈)\s*", re.I)


def parse_digits(text: str) -> Decimal:
    """A separator before exactly three digits groups thousands, unless only a zero stands before it; any other last separator is decimal."""
    parts = re.split(r"[ .,'’]", text)
    last = re.search(r"[ .,'’](\d+)$", text)
    if last is None or len(last[1]) == 3 and not (len(parts) == 2 and parts[0] == "0"):
        return Decimal("".join(parts))
    return Decimal("".join(parts[:-1]) + "." + parts[-1])


@lru_cache(maxsize=200_000)
def parse_value(value: str) -> tuple[Decimal, Unit | None] | None:
    """Number and unit, if it states one, of a printed value; None if it is no number or has other words in it."""
    text = ABOUT.sub("", clean(value))
    thousands = re.search(r"\s(?:1\s?)?000-tal$", text)
    if thousands:
        text = text[: thousands.start()] + " tusental"
    found = VALUE.fullmatch(text)
    if found is None:
        return None
    unit = None
    if found["pre"]:
        unit = parse_unit(found["pre"])
        if unit is None:
            return None
    rest = found["rest"].strip() if found["open"] or not found["close"] else (found["close"] + found["rest"]).strip()
    if found["open"] and not found["close"]:
        return None
    if rest:
        left = without_footnotes(rest)
        after = next((u for x in left if x.strip() and (u := parse_unit(x.strip()))), None)
        if after is None and left[-1].strip():
            return None
        unit = after or unit
    negative = bool(found["minus"] or found["inner"] or found["open"])
    number = parse_digits(found["number"])
    return (-number if negative else number), unit


def base_amount(number: Decimal, unit: Unit) -> Decimal:
    """The value in base units."""
    return EXACT.add(EXACT.multiply(number, unit.scale), unit.offset)


def amount(number: Decimal, unit: Unit) -> tuple[str, int | None] | None:
    """Name of the canonical unit and the whole number of it (null beyond 64 bits), or None if the dimension has none."""
    canonical = CANONICAL.get(unit.vector)
    if canonical is None:
        return None
    whole = int(EXACT.multiply(base_amount(number, unit), Decimal(canonical[1])).to_integral_value(ROUND_HALF_EVEN, EXACT))
    return canonical[0], whole if -(2**63) <= whole < 2**63 else None
