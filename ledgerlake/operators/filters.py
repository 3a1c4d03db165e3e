"""What a question says about company and year, and the terms it implies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ratios that questions name, and the items they are made of.
EXPANSIONS = {
    "bruttomarginal": ["bruttovinst", "nettoomsättning", "omsättning"],
    "rörelsemarginal": ["rörelseresultat", "nettoomsättning", "omsättning"],
    "vinstmarginal": ["nettoresultat", "årets resultat", "nettoomsättning", "omsättning"],
    "soliditet": ["eget kapital", "summa tillgångar"],
    "skuldsättningsgrad": ["summa skulder", "eget kapital"],
    "kassalikviditet": ["omsättningstillgångar", "varulager", "kortfristiga skulder"],
    "roe": ["nettoresultat", "eget kapital"],
    "avkastning på eget kapital": ["nettoresultat", "eget kapital"],
    "roa": ["nettoresultat", "summa tillgångar"],
    "avkastning på totalt kapital": ["nettoresultat", "summa tillgångar"],
    "fritt kassaflöde": ["kassaflöde från den löpande verksamheten", "investeringar"],
    "ebitda": ["rörelseresultat", "avskrivningar"],
}
#: Characters that a company's name is looked up by.
GRAM = 4
RANGE = r"((?:19|20)\d{2})\s*[/\-–]\s*(\d{4}|\d{2})"


def expand_query(query: Column) -> Column:
    """The question, followed by the items of every ratio it names (anywhere in it), each once, in order."""
    low = F.lower(query)
    terms = F.flatten(F.array(*(F.when(low.contains(name), F.array(*map(F.lit, items))).otherwise(F.array().cast("array<string>")) for name, items in EXPANSIONS.items())))
    return F.when(F.size(terms) > 0, F.concat(query, F.lit(" "), F.array_join(F.array_distinct(terms), " "))).otherwise(query)


def year_candidates(query: Column) -> Column:
    """Fiscal years a question may mean: `2023/24` one broken year, `2023-2025` each year, a year alone itself; a year may also end a broken one."""
    firsts, lasts = F.regexp_extract_all(query, F.lit(RANGE), F.lit(1)), F.regexp_extract_all(query, F.lit(RANGE), F.lit(2))
    pairs = F.arrays_zip(firsts.alias("a"), lasts.alias("b"))
    both = lambda y: F.array(y.cast("string"), F.concat((y - 1).cast("string"), F.lit("-"), F.substring(y.cast("string"), -2, 2)))
    short = F.transform(F.filter(pairs, lambda p: F.length(p["b"]) == 2), lambda p: F.concat(p["a"], F.lit("-"), p["b"]))
    years = F.transform(F.filter(pairs, lambda p: (F.length(p["b"]) == 4) & (p["b"] >= p["a"])), lambda p: F.flatten(F.transform(F.sequence(p["a"].cast("int"), p["b"].cast("int")), both)))
    alone = F.regexp_extract_all(F.regexp_replace(query, RANGE, "~"), F.lit(r"((?:19|20)\d{2})"), F.lit(1))
    return F.array_distinct(F.concat(short, F.flatten(years), F.flatten(F.transform(alone, lambda y: both(y.cast("int"))))))


def named_companies(queries: DataFrame, companies: DataFrame, query_id: str, text_col: str) -> DataFrame:
    """query_id, text and the alphabetically first company that the text contains, of the texts that contain one.

    A name is looked up by its first GRAM characters among all stretches of that length of a text, then compared whole: a join on
    short keys, whatever the number of companies. A name of fewer characters is looked up by itself.
    """
    names = companies.where("company is not null and company <> ''").select("company", F.substring("company", 1, GRAM).alias("_gram")).distinct()
    low = F.lower(text_col)
    lengths = F.sequence(F.lit(1), F.lit(GRAM))
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(text_col)), lambda at: F.transform(lengths, lambda n: F.substring(low, at, n)))))
    texts = queries.where(F.length(text_col) > 0).select(query_id, text_col).distinct().select(query_id, text_col, F.explode(grams).alias("_gram"))
    return texts.join(names, "_gram").where(F.contains(low, F.col("company"))).groupBy(query_id, text_col).agg(F.min("company").alias("company"))


def parse_filters(queries: DataFrame, company_years: DataFrame, query_id: str = "query_id", text_col: str = "text") -> DataFrame:
    """`queries` with `company` (null if none is named) and `years` (sorted, empty if none is valid).

    The company is the alphabetically first that the question contains; valid years are its own, or
    those of all companies (distinct fiscal years, a list that the calendar bounds). A year that straddles the edge of a range isn't told apart from it.
    """
    own = company_years.groupBy(F.col("company").alias("_company")).agg(F.array_distinct(F.flatten(F.collect_list("fiscal_years"))).alias("_own"))
    every = company_years.select(F.explode("fiscal_years").alias("y")).distinct().agg(F.collect_set("y")).first()[0]
    named = named_companies(queries, company_years, query_id, text_col).select(F.col(query_id).alias("_id"), F.col(text_col).alias("_text"), "company")
    some = queries.join(named, F.col(query_id).eqNullSafe(F.col("_id")) & (F.col(text_col) == F.col("_text")), "left").withColumn("_candidates", year_candidates(F.col(text_col)))
    joined = some.join(own, F.col("company") == F.col("_company"), "left")
    valid = F.when(F.col("company").isNotNull(), F.coalesce("_own", F.array().cast("array<string>"))).otherwise(F.array(*map(F.lit, sorted(every))) if every else F.array().cast("array<string>"))
    return joined.withColumn("years", F.sort_array(F.array_intersect("_candidates", valid))).select(*queries.columns, "company", "years")
