"""Deal arithmetic: income, caps, trailing totals, rent gaps, comparables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrelight.sources.shared import stage


def implied_cap(revenue: Column, expenses: Column, price: Column) -> Column:
    """Net operating income over price; null where the price is zero or missing."""
    return F.try_divide(revenue - expenses, price)


def price_per_unit(price: Column, units: Column) -> Column:
    return F.try_divide(price, units)


def trailing_totals(ledger: DataFrame, as_of: Column, months: tuple[int, ...] = (12, 6, 3)) -> DataFrame:
    """(property_id, t12, t6, t3): sums of (property_id, month, amount) over the last months up to ``as_of``."""
    sums = [F.sum(F.when((F.col("month") > F.add_months(as_of, -m)) & (F.col("month") <= as_of), F.col("amount"))).alias(f"t{m}") for m in months]
    return ledger.groupBy("property_id").agg(*sums)


def rent_gap(asking: Column, effective: Column, market: Column) -> Column:
    """Asking less effective rent, and the premium over the market in money and as a share."""
    return F.struct((asking - effective).alias("gap"), (asking - market).alias("premium"), F.try_divide(asking - market, market).alias("premium_share"))


def statement(ledger: DataFrame, units: DataFrame, as_of: Column, months: tuple[int, ...] = (12, 6, 3)) -> DataFrame:
    """(property_id, period, revenue, expenses, noi, expense_ratio, revenue_per_unit, noi_per_unit, occupancy) of each trailing period.

    ``ledger`` (property_id, month, kind, amount) has kinds revenue and expense;
    ``units`` (property_id, total_units, occupied_units) one row for each
    property. Ratios over zero are null.
    """
    within = lambda m: (F.col("month") > F.add_months(as_of, -m)) & (F.col("month") <= as_of)
    total = lambda m, kind: F.coalesce(F.sum(F.when(within(m) & (F.col("kind") == kind), F.col("amount"))), F.lit(0.0))
    sums = ledger.groupBy("property_id").agg(*(total(m, k).alias(f"{k}{m}") for m in months for k in ("revenue", "expense")))
    each = F.inline(F.array(*(F.struct(F.lit(f"T{m}").alias("period"), F.col(f"revenue{m}").alias("revenue"), F.col(f"expense{m}").alias("expenses")) for m in months)))
    rows = sums.select("property_id", each).join(units, "property_id", "left").withColumn("noi", F.col("revenue") - F.col("expenses"))
    per_unit = lambda c: F.try_divide(F.col(c), F.col("total_units"))
    return rows.select("property_id", "period", "revenue", "expenses", "noi", F.try_divide("expenses", "revenue").alias("expense_ratio"), per_unit("revenue").alias("revenue_per_unit"), per_unit("noi").alias("noi_per_unit"), F.try_divide("occupied_units", "total_units").alias("occupancy"))


def rank_comparables(comps: DataFrame, by: str = "rent_per_sf", group: str = "market") -> DataFrame:
    """Comparables ranked within their market, with its mean.

    Equal values are counted first. Values are dealt into ranges by market and
    value, and staged; a value's rank follows from the counts of the ranges
    before its own, so no task holds a market. Ranks and means are joined to the
    rows, of which adaptive execution splits a large market. A missing value
    ranks last, a missing market is one of its own.
    """
    key, low = F.coalesce(F.to_json(F.struct(group)), F.lit("")), F.col(by).isNull()
    keyed = comps.withColumns({"_key": key, "_low": low})
    counts = keyed.groupBy("_key", "_low", by).agg(F.count("*").alias("_n"))
    order = ["_low", F.desc(by)]
    dealt = stage(counts.repartitionByRange("_key", *order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_key", "_part").agg(F.sum("_n").alias("_size"))
    ranges = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    before = sizes.select("_key", "_part", (F.sum("_size").over(ranges) - F.col("_size")).alias("_before"))
    within = Window.partitionBy("_key", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranks = dealt.join(before, ["_key", "_part"]).select("_key", F.col(by).alias("_value"), (F.col("_before") + F.sum("_n").over(within) - F.col("_n") + 1).cast("int").alias("rank"))
    means = dealt.groupBy("_key").agg((F.sum(F.col(by) * F.col("_n")) / F.sum(F.when(~F.col("_low"), F.col("_n")))).alias("market_mean"))
    left = keyed.alias("c")
    ranked = left.join(ranks.alias("r"), (F.col("c._key") == F.col("r._key")) & F.col(by).eqNullSafe(F.col("r._value"))).drop(F.col("r._key"), "_value")
    return ranked.join(means, "_key").select(*comps.columns, "rank", "market_mean")


def comparable_summary(comps: DataFrame, group: str = "market") -> DataFrame:
    """(group, comparables, means of rent per unit and foot and vacancy, ranges of year and units) of comps (rent_per_unit, rent_per_sf, vacancy, year_built, units)."""
    return comps.groupBy(group).agg(F.count("*").alias("comparables"), *(F.avg(c).alias(f"avg_{c}") for c in ("rent_per_unit", "rent_per_sf", "vacancy")), *(f(c).alias(f"{n}_{c}") for c in ("year_built", "units") for n, f in (("min", F.min), ("max", F.max))))


def sales_by_star(sales: DataFrame) -> DataFrame:
    """(star, sales, volume, price_per_unit) of sales (star, price, units)."""
    return sales.groupBy("star").agg(F.count("*").alias("sales"), F.sum("price").alias("volume"), F.try_divide(F.sum("price"), F.sum("units")).alias("price_per_unit"))


def top_buyers(sales: DataFrame, since: Column, n: int = 10) -> DataFrame:
    """(buyer, units, volume): the ``n`` buyers of the greatest volume since a date; ties by name. A top-k, so no task sorts more than n."""
    bought = sales.where((F.col("sold_on") >= since) & F.col("buyer").isNotNull()).groupBy("buyer").agg(F.sum("units").alias("units"), F.sum("price").alias("volume"))
    return bought.orderBy(F.desc("volume"), "buyer").limit(n)
