"""Quantities of table rows in one common unit of their kind.

The unit written nearest counts: with the value, in the label, over the column, or in a line of the
same page that states it for the table. Every line of every page is read; pages that state a unit are
reduced to one row each by a grouped minimum and joined to the rows; each row is then parsed where it
stands, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.forms import clean
from ..functions.units import Unit, amount, base_amount, column_unit, label_unit, line_unit, parse_unit, parse_value, unit_text

STATED = "array<struct<line_no:int,expression:string>>"


def page_units(pages: DataFrame) -> DataFrame:
    """One row per page that states a unit: document, page, `stated` (its lines that do, in order) and, only if they state different ones, `page_text`; of several extractions the first."""
    kind = pa.list_(pa.struct([("line_no", pa.int32()), ("expression", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, stated, texts = [], [], []
            for row, text in enumerate(batch.column(3).to_pylist()):
                found = [{"line_no": k, "expression": e} for k, line in enumerate(text.split("\n")) if line and (e := line_unit(line))]
                if found:
                    kept.append(row)
                    stated.append(found)
                    texts.append(text if len({f["expression"] for f in found}) > 1 else None)
            at = pa.array(kept, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(3)), pa.array(stated, kind), pa.array(texts, pa.string())], names=["document", "page", "page_id", "stated", "page_text"])

    known = pages.where("document is not null and page_number is not null and text is not null").select("document", "page_number", "page_id", "text")
    found = known.mapInArrow(run, f"document string, page int, page_id long, stated {STATED}, page_text string")
    return found.groupBy("document", "page").agg(F.min(F.struct("page_id", "stated", "page_text")).alias("first")).select("document", "page", "first.stated", "first.page_text")


def nearest_statement(label: str | None, stated: list[dict], page_text: str | None) -> str:
    """The expression that a page states for a row: of different ones the last above the line that begins with the row's label, else the first."""
    if page_text is None or not label:
        return stated[0]["expression"]
    bare = clean(label)
    at = next((k for k, line in enumerate(page_text.split("\n")) if clean(line).startswith(bare)), -1)
    above = [s["expression"] for s in stated if s["line_no"] <= at]
    return above[-1] if above else stated[0]["expression"]


def _parsed(rows: DataFrame, pages: DataFrame, convert, kinds: list[tuple[str, str, pa.DataType]]) -> DataFrame:  # noqa: ANN001
    """row_id, col_no and what `convert` makes of number and unit, for every value that holds a number with a known unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row_id, label, values, columns, stated, page_text in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                for k, value in enumerate(values):
                    parsed = parse_value(value) if value else None
                    if parsed is None:
                        continue
                    number, unit = parsed
                    unit = unit or (label_unit(label) if label else None)
                    unit = unit or (column_unit(columns[k]) if columns and k < len(columns) and columns[k] else None)
                    unit = unit or (parse_unit(nearest_statement(label, stated, page_text)) if stated else None)
                    if unit and (common := convert(number, unit)):
                        out.append((row_id, k + 1, *common))
            types = [pa.int64(), pa.int32(), *(t for _, _, t in kinds)]
            columns_out = list(zip(*out, strict=True)) or [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns_out, types, strict=True)], names=["row_id", "col_no", *(n for n, _, _ in kinds)])

    some = rows.where(F.size("row_values") > 0).select("row_id", "label", "row_values", "row_columns", "document", "page")
    joined = some.join(page_units(pages), ["document", "page"], "left").select("row_id", "label", "row_values", "row_columns", "stated", "page_text")
    return joined.mapInArrow(run, "row_id long, col_no int, " + ", ".join(f"{n} {t}" for n, t, _ in kinds))


def quantities(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per value that holds a number with a unit of a kind that has a canonical one: `row_id`, `col_no` (from 1), `unit`, `amount`.

    Null arrays and values, dashes and other texts without a number have no row, nor has a number for
    which nothing states a unit. A null label or a missing column states none. Row ids may repeat. An
    amount that 64 bits can't hold is null.
    """
    return _parsed(rows, pages, amount, [("unit", "string", pa.string()), ("amount", "long", pa.int64())])


def base_quantities(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """The same for units of every dimension: `dimension` (exponents of base units, as `kW` gives `m2 g s-3`) and `amount` in base units."""

    def convert(number, unit: Unit) -> tuple[str, float]:  # noqa: ANN001
        return unit_text(unit), float(base_amount(number, unit))

    return _parsed(rows, pages, convert, [("dimension", "string", pa.string()), ("amount", "double", pa.float64())])
