"""Scalar rules on the documented examples and at their edges."""

import pytest
from pyspark.sql import functions as F

from acrelight.functions import values as V


def one(spark, value, rule):
    return spark.createDataFrame([(value,)], "c string").select(rule(F.col("c")).alias("v")).first()[0]


@pytest.mark.parametrize(("value", "wanted"), [("1,234 Main Street, Apt. #5", "1 234 main st apt 5"), ("12 Oak AVENUE", "12 oak ave"), (None, ""), ("  ", "")])
def test_addresses(spark, value, wanted):
    assert one(spark, value, V.normalize_address) == wanted


@pytest.mark.parametrize(("value", "wanted"), [("$1,234.50", 1234.5), ("12.5%", 0.125), ("(10)", 10.0), ("1-2", 1.0), ("-", None), ("", None), (None, None), ("n/a", None), ("-.", None)])
def test_numbers(spark, value, wanted):
    assert one(spark, value, V.parse_numeric) == wanted


@pytest.mark.parametrize(("value", "wanted"), [("14 Units", 14), ("(10) Units", -10), ("none", None)])
def test_units(spark, value, wanted):
    assert one(spark, value, V.parse_units) == wanted


def test_money_and_shares(spark):
    assert one(spark, "$1.50 /SF", V.parse_currency) == 1.5
    assert one(spark, "9.7%", V.parse_percent) == 9.7


@pytest.mark.parametrize(("value", "wanted"), [("863 SF", 863.0), ("24 Hour", 24.0), ("6.5%", 6.5), ("n/a", None)])
def test_leading_numbers(spark, value, wanted):
    assert one(spark, value, V.normalize_value_text)["number"] == wanted


def test_tagged_values(spark):
    assert one(spark, "Mar 2019", V.normalize_value)["date"].isoformat() == "2019-03-01"
    assert one(spark, "183 Units", V.normalize_value)["number"] == 183
    assert one(spark, "6.0%", V.normalize_value)["number"] == pytest.approx(0.06)
    assert one(spark, "Garden", V.normalize_value)["text"] == "Garden"


@pytest.mark.parametrize(
    ("name", "value", "wanted"),
    [("divide_by_100", "6.0", "0.06"), ("to_number", "$27,450,000", "2.745E7"), ("extract_city", "Phoenix, Arizona - Central", "Phoenix"), ("extract_state_abbrev", "Phoenix, Arizona - Central", "AZ"), ("extract_property_name", "Juniper Court 183 Unit Apartment", "Juniper Court"), ("years_since_purchase", "Purchased Mar 2019", "6"), ("unknown", "x", "x")],
)
def test_transforms(spark, name, value, wanted):
    assert one(spark, value, lambda c: V.apply_transform(name, c, F.lit("2025-06-30").cast("date"))) == wanted


def test_rounding_goes_up_at_ties(spark):
    assert spark.range(1).select(V.half_up(F.lit(0.125), 2)).first()[0] == 0.13


def test_keys_and_slugs(spark):
    assert one(spark, "Asking Rent / SF", V.camel_key) == "askingRent/Sf"
    assert one(spark, "No. of Units:", V.property_key) == "no_of_units"
    assert one(spark, "Lot Size sq. ft:", V.property_key) == "lot_size_sq_ft"
    assert one(spark, "St. Louis", lambda c: V.slug(c, "-")) == "st-louis"
    assert one(spark, "a/b/e_12-ab3_report.pdf", V.extraction_id) == "e_12-ab3"
    assert one(spark, "report.pdf", V.extraction_id) is None
    assert one(spark, "a   b  c d", V.split_table_row) == ["a", "b", "c d"]
