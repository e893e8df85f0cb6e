"""Column profiles and type inference over any table."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrelight.functions.values import half_up
from acrelight.sources.shared import stage


def unpivoted(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value string): one row for each cell."""
    return df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))))


def medians(values: DataFrame) -> DataFrame:
    """(column, median) of weighted numbers (column, number, n): the middle one, or the mean of both.

    Numbers are dealt into ranges and staged; from the counts of each range, one
    row for each column and range, follows which ranges hold the middle, and
    only these are counted through. No task holds a column or a map of it.
    """
    dealt = stage(values.repartitionByRange("column", "number").withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("column", "_part").agg(F.sum("n").alias("_size"))
    ranges = Window.partitionBy("column").orderBy("_part")
    placed = sizes.withColumns({"_before": F.sum("_size").over(ranges.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"), "_all": F.sum("_size").over(Window.partitionBy("column"))})
    low, high = F.floor((F.col("_all") - 1) / 2), F.ceil((F.col("_all") - 1) / 2)
    middle = placed.where((F.col("_before") <= high) & (F.col("_before") + F.col("_size") > low))
    within = Window.partitionBy("column", "_part").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    upto = dealt.join(middle, ["column", "_part"]).withColumn("_upto", F.col("_before") + F.sum("n").over(within))
    at = lambda rank: F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("n") <= rank), F.col("number")))
    return upto.groupBy("column").agg(((at(low) + at(high)) / 2).alias("median"))


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Type, null and distinct counts, and number statistics of each column.

    Values are counted first by column and value, so that the distinct count and
    the statistics come from far fewer rows, and staged, as all else reads them.
    An empty string is null. A column is numeric if all its values are numbers,
    and 'empty' without any; statistics are there if any value is a number.
    """
    columns = columns or df.columns
    cell = unpivoted(df, columns).withColumn("value", F.when(F.col("value") != "", F.col("value")))
    values = stage(cell.groupBy("column", "value").agg(F.count("*").alias("n")).withColumn("number", F.col("value").try_cast("double")))
    number, n = F.col("number"), F.col("n")
    known = F.sum(F.when(F.col("value").isNotNull(), n).otherwise(0))
    numbers = F.sum(F.when(number.isNotNull(), n).otherwise(0))
    out = values.groupBy("column").agg(
        F.when(known == 0, "empty").when(numbers == known, "numeric").otherwise("text").alias("dtype"),
        F.sum(F.when(F.col("value").isNull(), n).otherwise(0)).alias("null_count"),
        F.count("value").alias("unique_count"),
        F.min("number").alias("min"),
        F.max("number").alias("max"),
        half_up(F.try_divide(F.sum(number * n), numbers), 4).alias("mean"),
    )
    # a row for each column
    return out.join(medians(values.where("number is not null").select("column", "number", "n")), "column", "left")


def profile_typed(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Declared type, nulls, and distinct values with null counted as one."""
    columns = columns or df.columns
    kinds = dict(df.dtypes)
    values = unpivoted(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))
    kind = reduce(lambda c, x: c.when(F.col("column") == x, kinds[x]), columns[1:], F.when(F.col("column") == columns[0], kinds[columns[0]]))
    return values.groupBy("column").agg(F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"), F.count("*").alias("unique_values")).withColumn("declared", kind)


def infer_column_types(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Type of each column of document tables, from cells (keys..., value): empty, currency, percentage, numeric or text, tried in this order."""
    v = F.trim("value")
    here = F.col("value").isNotNull()
    every = lambda test: F.bool_and(F.when(here, test))
    return cells.groupBy(*keys).agg(
        F.when(F.count_if(here) == 0, "empty")
        .when(every(v.rlike(r"^\$[\d,]+(\.\d+)?")), "currency")
        .when(every(v.rlike(r"^-?\d+(\.\d+)?%")), "percentage")
        .when(every(v.rlike(r"^-?[\d,]+(\.\d+)?\z") | F.lower(v).isin("-", "n/a", "")), "numeric")
        .otherwise("text")
        .alias("column_type")
    )


# Column categories and the words that put a column into them, in the order in which they are tried.
CATEGORIES = [
    ("property_info", r"property|building|asset|name|year|built|type|brand"),
    ("financial_data", r"price|rent|cost|revenue|expense|income|noi|cap|value|amount|tax"),
    ("unit_mix", r"unit|bed|bath|sqft|sq_ft|square|size|floor"),
    ("amenities", r"amenit|feature|facility|parking|pool|gym"),
    ("location_data", r"address|city|state|zip|county|location|region"),
]


def category_of(column: str) -> str:
    return next((name for name, pattern in CATEGORIES if re.search(pattern, column, re.I)), "other")


def categorize_columns(df: DataFrame, key: str) -> DataFrame:
    """(key, category, data): for each row, a map of column to value for each category with a value."""
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        if c != key:
            groups.setdefault(category_of(c), []).append(c)
    pairs = lambda cs: F.filter(F.array(*(F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in cs)), lambda x: x["v"].isNotNull())
    each: list[Column] = [F.struct(F.lit(name).alias("category"), F.map_from_entries(pairs(cs)).alias("data")) for name, cs in groups.items()]
    return df.select(key, F.inline(F.array(*each))).where(F.size("data") > 0)
