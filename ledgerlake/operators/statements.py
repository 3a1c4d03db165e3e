"""Where statements stand, whether they balance, and the ratios that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_integer, strip

#: The longest line that is a heading, and the openings of headings by level and statement.
HEADING = 55
HEADINGS = {
    "koncern": {
        "resultaträkning": ["koncernens resultaträkning", "koncernens rapport över rörelseresultat", "koncernens rapport över totalresultat"],
        "balansräkning": ["koncernens balansräkning", "rapport över finansiell ställning för koncernen"],
        "kassaflödesanalys": ["koncernens kassaflödesanalys", "koncernens rapport över kassaflöden", "rapport över kassaflöden för koncernen"],
    },
    "moderbolag": {
        "resultaträkning": ["resultaträkning för moderbolaget", "moderbolagets resultaträkning", "moderföretagets resultaträkning"],
        "balansräkning": ["balansräkning för moderbolaget", "moderbolagets balansräkning", "moderföretagets balansräkning"],
        "kassaflödesanalys": ["kassaflödesanalys för moderbolaget", "moderbolagets kassaflödesanalys", "moderföretagets kassaflödesanalys", "moderbolagets rapport över kassaflöden", "moderföretagets rapport över kassaflöden"],
    },
}


def _section_of(line: Column, level: str) -> Column:
    """The statement whose heading the line opens with; of several, the first."""
    if level not in HEADINGS:
        raise ValueError(f"unknown level {level!r}; there are {', '.join(HEADINGS)}")
    found = F.lit(None).cast("string")
    for section, phrases in reversed(HEADINGS[level].items()):
        starts = F.lit(False)
        for phrase in phrases:
            starts = starts | line.startswith(phrase)
        found = F.when(starts, section).otherwise(found)
    return found


def locate_headings(pages: DataFrame, level: Column | None = None) -> DataFrame:
    """One row per heading line: page_id, document, page_number, `line_no` (from 1), section. A page with two has two rows.

    `level` names the level of each row ("koncern" or "moderbolag"); null and unknown levels count as "koncern".
    """
    lines = pages.withColumn("_level", F.lit("koncern") if level is None else level).select("page_id", "document", "page_number", "_level", F.posexplode(F.split("text", "\n")).alias("_pos", "_line"))
    bare = lines.withColumn("_line", strip(F.col("_line"))).where(F.length("_line") <= HEADING).withColumn("_low", F.lower("_line"))
    section = F.when(F.col("_level") == "moderbolag", _section_of(F.col("_low"), "moderbolag")).otherwise(_section_of(F.col("_low"), "koncern"))
    return bare.select("page_id", "document", "page_number", (F.col("_pos") + 1).alias("line_no"), section.alias("section")).where("section is not null")


def page_sections(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """Every page with the statement that lists it; of several the last in the statements' order, null without one."""
    order = F.create_map(*(x for k, s in enumerate(HEADINGS["koncern"]) for x in (F.lit(s), F.lit(k))))
    last = listed.groupBy("document", F.col("page").alias("page_number")).agg(F.max_by("section", F.try_element_at(order, F.col("section"))).alias("section"))
    return pages.select("page_id", "document", "page_number").join(last, ["document", "page_number"], "left").select("page_id", "document", "page_number", "section")


def balance_check(rows: DataFrame) -> DataFrame:
    """Per document the two totals of its balance sheet and whether they agree; documents that lack one have no row.

    Of each row the first value that is present counts, of several rows with a label the last.
    """
    first = F.element_at(F.filter("row_values", lambda v: v.isNotNull()), 1)
    present = rows.where(F.exists("row_values", lambda v: v.isNotNull())).select("document", "row_id", "label", plain_integer(first).alias("amount"))
    pick = lambda label: F.max_by(F.when(F.col("label") == label, F.col("amount")), F.when(F.col("label") == label, F.col("row_id")))
    totals = present.groupBy("document").agg(pick("Summa tillgångar").alias("assets"), pick("Summa eget kapital och skulder").alias("liabilities"))
    return totals.where("assets is not null and liabilities is not null").withColumn("balances", F.col("assets") == F.col("liabilities"))


#: Ratio, numerator and denominator, as openings of row labels; all amounts in the same currency.
RATIOS = {
    "bruttomarginal": ("bruttoresultat", "nettoomsättning"), "rörelsemarginal": ("rörelseresultat", "nettoomsättning"), "vinstmarginal": ("årets resultat", "nettoomsättning"),
    "soliditet": ("eget kapital", "summa tillgångar"), "skuldsättningsgrad": ("summa skulder", "eget kapital"), "roe": ("årets resultat", "eget kapital"), "roa": ("årets resultat", "summa tillgångar"),
}
ITEMS = sorted({x for pair in RATIOS.values() for x in pair})
#: A ratio whose numerator is a difference, and a difference that is an amount; the second operand of that is spending, whichever sign it is reported with.
LIQUIDITY = ("omsättningstillgångar", "varulager", "kortfristiga skulder")
CASH_FLOW = ("kassaflöde från den löpande verksamheten", "investeringar")


def amounts_by_item(rows: DataFrame, quantities: DataFrame, items: list[str] = ITEMS) -> DataFrame:
    """document, column place, currency and amount of the rows whose labels name one of the items; of several rows the last."""
    low = F.lower(strip(F.regexp_replace("label", r"^[^:]{1,24}:\s", "")))
    item = F.lit(None).cast("string")
    for name in items:
        item = F.when(low.startswith(name) & ~low.startswith(name + " per aktie") & ~low.startswith(name + " och skulder"), name).otherwise(item)
    named = rows.select("row_id", "document", item.alias("item")).where("item is not null and document is not null")
    money = quantities.where("unit in ('sek', 'eur', 'usd')")
    return named.join(money, "row_id").groupBy("document", "col_no", "unit", "item").agg(F.max_by("amount", "row_id").alias("amount"))


def ratios(rows: DataFrame, quantities: DataFrame) -> DataFrame:
    """document, column, ratio and its value: `percent` with one decimal, rounded half up, or of the free cash flow `amount`; operands all present, denominator not 0."""
    items = sorted({*ITEMS, *LIQUIDITY, *CASH_FLOW})
    wide = amounts_by_item(rows, quantities, items).groupBy("document", "col_no", "unit").pivot("item", items).agg(F.first("amount"))
    of = lambda item: F.col(f"`{item}`").cast("decimal(28,0)")
    option = lambda name, a, b: F.struct(F.lit(name).alias("ratio"), a.cast("decimal(28,0)").alias("a"), b.alias("b"))
    assets, stock, debts = map(of, LIQUIDITY)
    flow, spent = map(of, CASH_FLOW)
    options = [*(option(name, of(a), of(b)) for name, (a, b) in RATIOS.items()), option("kassalikviditet", assets - stock, debts), option("fritt kassaflöde", flow - F.abs(spent), F.lit(None).cast("decimal(28,0)"))]
    free = F.col("r.ratio") == "fritt kassaflöde"
    long = wide.select("document", "col_no", "unit", F.explode(F.array(*options)).alias("r")).where(F.col("r.a").isNotNull() & (free | F.coalesce(F.col("r.b") != 0, F.lit(False))))
    return long.select("document", "col_no", "unit", "r.ratio", F.round(F.col("r.a") * 100 / F.col("r.b"), 1).cast("decimal(20,1)").alias("percent"), F.when(free, F.col("r.a")).alias("amount"))


def year_on_year(rows: DataFrame, quantities: DataFrame) -> DataFrame:
    """document, item, column: the amount, that of the next column (the period before) and the change in per cent."""
    items = amounts_by_item(rows, quantities)
    before = F.lead("amount").over(Window.partitionBy("document", "item", "unit").orderBy("col_no"))
    change = F.round((F.col("amount") - F.col("before")).cast("decimal(28,0)") * 100 / F.abs(F.col("before")).cast("decimal(28,0)"), 1).cast("decimal(20,1)")
    return items.withColumn("before", before).where("before is not null and before <> 0").select("document", "item", "unit", "col_no", "amount", "before", change.alias("change_percent"))
