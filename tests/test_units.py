"""Numbers, units and where they are stated."""

from decimal import Decimal

import pytest

from ledgerlake.functions.units import CANONICAL, amount, base_amount, column_unit, label_unit, line_unit, parse_digits, parse_unit, parse_value, unit_text
from ledgerlake.operators.quantities import base_quantities, quantities

ROWS = "row_id long, document string, company string, label string, row_values array<string>, row_columns array<string>, page int"
PAGES = "page_id long, document string, page_number int, text string"


@pytest.mark.parametrize("text, number", [("1,612", "1612"), ("0,612", "0.612"), ("12,1", "12.1"), ("1.234,567", "1234567"), ("1,234.5", "1234.5"), ("92 874 064", "92874064"), ("1'475", "1475"), ("0.26", "0.26"), ("7", "7")])
def test_separators(text, number):
    assert parse_digits(text) == Decimal(number)


@pytest.mark.parametrize(
    "text, unit, whole",
    [
        ("(621,7) MSEK", "sek", -62_170_000_000), ("ca (826,2) MKR", "sek", -82_620_000_000), ("SEK –0,5", "sek", -50), ("1'475 öre per aktie", "sek", 1475), ("12 kr/aktie", "sek", 1200),
        ("92 874 064 tusen euro", "eur", 9_287_406_400_000), ("-27.676 EUR million", "eur", -2_767_600_000_000), ("3 USD 000", "usd", 300_000), ("−0.26 mdkr", "sek", -26_000_000_000), ("2 mdr kr", "sek", 200_000_000_000),
        ("7.157.646 MJ", "kj", 7_157_646_000), ("1,5 kWh", "kj", 5400), ("9,93 kt", "g", 9_930_000_000), ("4 ton", "g", 4_000_000), ("2,5 mil", "m", 25_000), ("3,3 km² 1)", "m2", 3_300_000), ("2 ha", "m2", 20_000),
        ("1 tusen m³", "l", 1_000_000), ("16.2 milj.", "count", 16_200_000), ("22,503.1 000-tal", "count", 22_503_100), ("1 000-tal", "count", 1000), ("1,7%", "ppm", 17_000), ("35 baspunkter", "ppm", 3500), ("0,3 andel", "ppm", 300_000),
        ("ｃа ５ kr", "sek", 500), ("5​ kr", "sek", 500),
    ],
)
def test_values_with_units(text, unit, whole):
    number, found = parse_value(text)
    assert amount(number, found) == (unit, whole)


@pytest.mark.parametrize("text", ["–", "n/a", "e.t.", "", "-", "abc 5", "5 parsec"])
def test_no_number(text):
    assert not text or parse_value(text) is None


@pytest.mark.parametrize("text, number", [("5 320¹", 5320), ("12.809 2)", 12809), ("360 *", 360), ("(1 271 516) 2)", -1271516)])
def test_footnotes(text, number):
    assert parse_value(text) == (Decimal(number), None)


def test_labels_columns_lines():
    name = lambda u: u and CANONICAL[u.vector][0]
    assert [name(label_unit(x)) for x in ("km²: Yta", "Räntor m.m.", "Rätter, inkl. mark 1) – MKR", "Tonnage t", "Resultat per aktie", "Aktier [miljoner]", "Antal skiddagar", "Kostnad (not 3) (kkr)")] == ["m2", None, "sek", "g", None, "count", None, "sek"]
    assert [column_unit(x) and column_unit(x).scale for x in ("2022, tusental kronor", "SEK m –2018-08-31", "SEK 000 2022-12-31", "2019/20", "Drift 2020 (KSEK)")] == [1000, 1_000_000, 1000, None, 1000]
    assert [line_unit(x) for x in ("Belopp i SEK m om inget annat anges", "(mkr)", "Samtliga siffror i denna tabell är i Tkr.", "Belopp anges i svenska kronor där inget annat sägs.", "MSEK.", "procent.")] == ["SEK m", "mkr", "Tkr", None, None, None]
    assert parse_unit("kr i öre") is None


@pytest.mark.parametrize(
    "text, dimension, base",
    [
        ("36 km/h", "m s-1", "10"), ("2 kWh/m2", "g s-2", "7200000000"), ("5 kr/kg", "sek g-1", "0.005"), ("20 °C", "K", "293.15"), ("-40 °F", "K", "233.15"), ("3 MW", "m2 g s-3", "3000000000"), ("2 tusen GBP", "gbp", "2000"),
        ("7 NOK", "nok", "7"), ("1,5 h", "s", "5400"), ("4 kr/°C", "sek K-1", "4"), ("6 m·s⁻¹", "m s-1", "6"), ("8 ton/år", "g s-1", "0.2535047025122"), ("3 kr/kr", "share", "3"), ("9 mg", "g", "0.009"), ("2 m^-2", "m-2", "2"),
    ],
)
def test_exponents_and_offsets(text, dimension, base):
    number, unit = parse_value(text)
    assert unit_text(unit) == dimension and float(base_amount(number, unit)) == pytest.approx(float(base), abs=1e-9, rel=1e-9)


def test_numbers_beyond_64_bits():
    number, unit = parse_value("12345678901234567890 tkr")
    assert amount(number, unit) == ("sek", None)
    number, unit = parse_value("9" * 300 + " mdkr")
    assert amount(number, unit) == ("sek", None)


@pytest.mark.parametrize("line, expression", [
    ("Belopp i milj. kr", "milj. kr"), ("(milj. kr)", "milj. kr"), ("Amounts in milj. kr unless otherwise stated", "milj. kr"), ("Siffror i GWh om inget annat anges", "GWh"), ("ton", None), ("i procent", None),
    ("Bolaget växte med 5 mkr. Det gick bra.", None), ("Belopp i" + " " * 200 + "tkr", "tkr"),
])
def test_lines(line, expression):
    assert line_unit(line) == expression


def test_statement_above_the_row_counts(spark):
    page = "Belopp i mkr\nVaror  5\nBelopp i GWh\nEl  7\nVatten  8"
    rows = [(1, "d", None, "Varor", ["5"], ["2020"], 1), (2, "d", None, "El", ["7"], ["2020"], 1), (3, "d", None, "saknas", ["8"], ["2020"], 1), (4, "d", None, "Fart", ["36 km/h", "12345678901234567890 tkr"], ["2020", "2019"], 1)]
    data = spark.createDataFrame(rows, ROWS), spark.createDataFrame([(1, "d", 1, page), (2, "d", 1, "Belopp i tkr")], PAGES)
    mkr = 100_000_000
    assert sorted(map(tuple, quantities(*data).collect())) == [(1, 1, "sek", 5 * mkr), (2, 1, "kj", 25_200_000_000), (3, 1, "sek", 8 * mkr), (4, 2, "sek", None)]
    assert (4, 1, "m s-1", 10.0) in [tuple(r) for r in base_quantities(*data).collect()]


def test_nearest_statement_counts(spark):
    rows = [
        (1, "d", None, "Resultat", ["5 MSEK", "6", None, "–"], ["2020", "2019", "2018", "2017"], 1),
        (2, "d", None, "Resultat, tkr", ["5 MSEK", "6"], ["2020 kr", "2019 kr"], 1),
        (3, "d", None, "Resultat", ["7"], ["2020 kr"], 1),
        (4, "d", None, "Resultat", ["7"], ["2020"], 2),
        (5, None, None, None, ["7"], None, None),
        (6, "d", None, "x", None, None, 1),
        (7, "d", None, "x", [], [], 1),
        (1, "d", None, "Resultat", ["5 MSEK"], [], 1),
    ]
    pages = [(9, "d", 1, "Rubrik\n(mkr)\nkr"), (8, "d", 1, None), (10, "e", 2, "kr"), (11, None, None, "kr")]
    got = sorted(map(tuple, quantities(spark.createDataFrame(rows, ROWS), spark.createDataFrame(pages, PAGES)).collect()))
    mkr = 100_000_000
    assert got == [(1, 1, "sek", 5 * mkr), (1, 1, "sek", 5 * mkr), (1, 2, "sek", 6 * mkr), (2, 1, "sek", 5 * mkr), (2, 2, "sek", 600_000), (3, 1, "sek", 700)]


def test_empty_tables(spark):
    assert quantities(spark.createDataFrame([], ROWS), spark.createDataFrame([], PAGES)).count() == 0
