"""Regions, the default scorecard, section patterns."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

# Region key, display name, states.
REGIONS = [
    ("northeast", "Northeast", ["CT", "ME", "MA", "NH", "NJ", "NY", "PA", "RI", "VT"]),
    ("midwest", "Midwest", ["IL", "IN", "IA", "KS", "MI", "MN", "MO", "NE", "ND", "OH", "SD", "WI"]),
    ("south", "South", ["AL", "AR", "DE", "FL", "GA", "KY", "LA", "MD", "MS", "NC", "OK", "SC", "TN", "TX", "VA", "WV", "DC"]),
    ("west", "West", ["AK", "AZ", "CA", "CO", "HI", "ID", "MT", "NV", "NM", "OR", "UT", "WA", "WY"]),
]
# State names by abbreviation.
STATE_NAMES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut",
    "DE": "Delaware", "DC": "District of Columbia", "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois",
    "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland",
    "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska",
    "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York", "NC": "North Carolina",
    "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island",
    "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia",
    "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
}
# Section slug, and upper-cased patterns in the order in which they are tried.
SECTION_PATTERNS = {
    "subject_property": ["SUBJECT PROPERTY", "PROPERTY SUMMARY", "PROPERTY OVERVIEW", "PROPERTY DETAILS"],
    "rent_comps": ["RENT COMPS", "RENT COMPARABLES", "RENTAL COMPARABLES", "COMPARABLE RENTALS", "LEASE COMPS"],
    "construction": ["CONSTRUCTION", "UNDER CONSTRUCTION", "PIPELINE", "DEVELOPMENT PIPELINE", "NEW CONSTRUCTION"],
    "sale_comps": ["SALE COMPS", "SALE COMPARABLES", "SALES COMPARABLES", "COMPARABLE SALES", "RECENT SALES"],
    "demographics": ["DEMOGRAPHICS", "POPULATION", "DEMOGRAPHIC ANALYSIS", "AREA DEMOGRAPHICS"],
    "submarket_report": ["SUBMARKET REPORT", "SUBMARKET ANALYSIS", "SUBMARKET OVERVIEW", "MULTI-FAMILY SUBMARKET"],
    "market_report": ["MARKET REPORT", "MARKET ANALYSIS", "MARKET OVERVIEW", "MULTI-FAMILY MARKET"],
}
SECTION_NAMES = {
    "subject_property": "Subject Property", "rent_comps": "Rent Comparables", "construction": "Construction", "sale_comps": "Sale Comparables",
    "demographics": "Demographics", "submarket_report": "Submarket Report", "market_report": "Market Report", "unknown": "Unknown Section",
}


@dataclass(frozen=True)
class Factor:
    """A factor: its value's path in the record, and the value needed for each score from 10 down to 1."""

    key: str
    name: str
    weight: float
    path: str
    lower_is_better: bool
    thresholds: tuple[float | None, ...]


@dataclass(frozen=True)
class Scorecard:
    factors: tuple[Factor, ...]
    forward: float = 7.0
    review: float = 5.5

    def factor(self, key: str) -> Factor:
        return next(f for f in self.factors if f.key == key)

    def with_factor(self, key: str, **changes) -> Scorecard:
        return replace(self, factors=tuple(replace(f, **changes) if f.key == key else f for f in self.factors))


# The default scorecard.
DEFAULT_SCORECARD = Scorecard((
    Factor("population", "Population", 0.075, "demographics.population_3mile", False, (70000, 65000, 60000, 55000, 50000, 45000, 40000, 35000, 30000, 25000)),
    Factor("populationGrowth", "Population Growth", 0.10, "demographics.population_growth_3mile", False, (0.0100, 0.0075, 0.0050, 0.0025, 0.0000, -0.0025, -0.0050, -0.0075, -0.0100, -0.0125)),
    Factor("medianHHIncome", "Median HH Income", 0.10, "demographics.median_hh_income_3mile", False, (70000, 65000, 60000, 55000, 50000, 45000, 40000, 35000, 30000, 25000)),
    Factor("medianHomeValue", "Median Home Value", 0.075, "demographics.median_home_value_3mile", False, (525000, 475000, 425000, 375000, 325000, 275000, 225000, 175000, 125000, 75000)),
    Factor("renterHouseholdsPercent", "Renter Households %", 0.05, "demographics.renter_households_pct_3mile", False, (0.50, 0.45, 0.40, 0.35, 0.30, 0.25, 0.20, 0.15, 0.10, 0.05)),
    Factor("violentCrimeRate", "Violent Crime Rate", 0.05, "external.crime.violent_crime_index", True, (20.0, 25.0, 30.0, 35.0, 40.0, 45.0, 50.0, 55.0, 60.0, 65.0)),
    Factor("propertyCrimeRate", "Property Crime Rate", 0.05, "external.crime.property_crime_index", True, (30.0, 35.0, 40.0, 45.0, 50.0, 55.0, 60.0, 65.0, 70.0, 75.0)),
    Factor("schoolRatings", "School Ratings", 0.075, "external.schools.average_rating", False, (9.0, 8.0, 7.0, 6.0, 5.0, 4.0, 3.0, 2.0, 1.0, 0.0)),
    Factor("walkScore", "Walk Score", 0.075, "external.walkScore.walk_score", False, (80, 70, 60, 50, 40, 30, 20, 10, 5, 0)),
    Factor("transitScore", "Transit Score", 0.075, "external.walkScore.transit_score", False, (80, 70, 60, 50, 40, 30, 20, 10, 5, 0)),
    Factor("submarketVacancy", "Submarket Vacancy", 0.10, "submarket.vacancy_rate", True, (0.060, 0.070, 0.080, 0.090, 0.100, 0.110, 0.120, 0.130, 0.140, 0.150)),
    Factor("submarketDeliveredPercent", "Submarket Delivered % of Inventory", 0.10, "submarket.delivered_pct_of_inventory", False, (0.025, 0.030, 0.035, 0.040, 0.045, 0.050, 0.055, 0.060, 0.065, 0.070)),
    Factor("submarketConstructionPercent", "Submarket Construction % of Inventory", 0.075, "submarket.construction_pct_of_inventory", True, (0.025, 0.030, 0.035, 0.040, 0.045, 0.050, 0.055, 0.060, 0.065, 0.070)),
))


def states(spark: SparkSession) -> DataFrame:
    """The state dimension: 51 rows of (state_abbr, state_name, region, region_name, region_ord)."""
    rows = [(s, STATE_NAMES[s], key, name, i) for i, (key, name, members) in enumerate(REGIONS) for s in members]
    return spark.createDataFrame(rows, "state_abbr string, state_name string, region string, region_name string, region_ord int")
