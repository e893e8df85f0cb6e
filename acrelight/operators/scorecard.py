"""The weighted threshold scorecard, one projection for any number of properties."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelight.dims import DEFAULT_SCORECARD, Factor, Scorecard
from acrelight.functions.values import half_up


def value_of(factor: Factor) -> Column:
    return F.col(factor.path).try_cast("double")


def factor_score(value: Column, factor: Factor) -> Column:
    """The highest score whose threshold the value meets; 0 for a missing value or none met."""
    met = (lambda t: value <= F.lit(float(t))) if factor.lower_is_better else (lambda t: value >= F.lit(float(t)))
    cases = [(10 - i, met(t)) for i, t in enumerate(factor.thresholds) if t is not None]
    known = value.isNotNull() & ~F.isnan(value)
    return reduce(lambda c, case: c.when(known & case[1], case[0]), cases[1:], F.when(known & cases[0][1], cases[0][0])).otherwise(0)


def total_score(card: Scorecard = DEFAULT_SCORECARD) -> Column:
    """The weighted sum, added in factor order on doubles and rounded up at ties; missing values cost their weight."""
    return half_up(reduce(lambda s, f: s + factor_score(value_of(f), f) * F.lit(f.weight), card.factors, F.lit(0.0)), 2)


def decision(score: Column, card: Scorecard = DEFAULT_SCORECARD) -> Column:
    return F.when(score >= card.forward, "Move Forward").when(score >= card.review, "Needs Review").otherwise("Rejected")


def color(score: Column, card: Scorecard = DEFAULT_SCORECARD) -> Column:
    return F.when(score >= card.forward, "green").when(score >= card.review, "yellow").otherwise("red")


def score(records: DataFrame, card: Scorecard = DEFAULT_SCORECARD) -> DataFrame:
    """``records`` with total_score, decision, color, and coverage: the share of weights whose value is there."""
    scored = records.withColumn("total_score", total_score(card))
    have = reduce(lambda s, f: s + F.when(value_of(f).isNotNull(), F.lit(f.weight)).otherwise(0.0), card.factors, F.lit(0.0))
    return scored.withColumns({"decision": decision(F.col("total_score"), card), "color": color(F.col("total_score"), card), "coverage": half_up(have, 3)})


def plain_number(c: Column) -> Column:
    """A number as text without a trailing '.0'."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def breakdown(records: DataFrame, key: str, card: Scorecard = DEFAULT_SCORECARD) -> DataFrame:
    """A row for each record and factor: value, score, weight, weighted score and how it came about."""

    def entry(i: int, f: Factor) -> Column:
        value, points = value_of(f), factor_score(value_of(f), f)
        needed = F.element_at(F.array(*(F.lit(None if t is None else float(t)).cast("double") for t in f.thresholds)), F.when(points > 0, 11 - points).otherwise(1))
        told = F.when(value.isNull() | F.isnan(value), "No data").when(points == 0, F.concat(plain_number(value), F.lit(" meets no threshold"))).otherwise(F.concat(plain_number(value), F.lit(" <= " if f.lower_is_better else " >= "), plain_number(needed)))
        return F.struct(F.lit(i).alias("ord"), F.lit(f.key).alias("factor"), F.lit(f.name).alias("name"), value.alias("value"), points.alias("score"), F.lit(f.weight).alias("weight"), half_up(points * F.lit(f.weight), 3).alias("weighted"), told.alias("explanation"), F.lit(f.lower_is_better).alias("lower_is_better"))

    return records.select(key, F.inline(F.array(*(entry(i, f) for i, f in enumerate(card.factors)))))


def scorecard_rows(spark: SparkSession, cards: Mapping[str, Scorecard]) -> DataFrame:
    """(scorecard_id, ord, factor, weight, path, lower_is_better, points, threshold): config as a small table."""
    rows = [(name, i, f.key, f.weight, f.path, f.lower_is_better, 10 - j, None if t is None else float(t)) for name, card in cards.items() for i, f in enumerate(card.factors) for j, t in enumerate(f.thresholds)]
    return spark.createDataFrame(rows, "scorecard_id string, ord int, factor string, weight double, path string, lower_is_better boolean, points int, threshold double")


def score_many(records: DataFrame, key: str, cards: Mapping[str, Scorecard]) -> DataFrame:
    """(key, scorecard_id, total_score, decision): the same records under other scorecards.

    Each card is a generated expression, so all cards are scored in one pass
    without a shuffle.
    """
    each = [F.struct(F.lit(name).alias("scorecard_id"), total_score(card).alias("total_score")) for name, card in cards.items()]
    cuts = lambda s: reduce(lambda c, x: c.when(F.col("scorecard_id") == x[0], decision(s, x[1])), cards.items(), F.when(F.lit(False), ""))
    return records.select(key, F.inline(F.array(*each))).withColumn("decision", cuts(F.col("total_score")))


def validate_scorecards(rows: DataFrame) -> DataFrame:
    """(scorecard_id, total_weight, valid): whether weights add up to 1 within 0.001."""
    weights = rows.select("scorecard_id", "ord", "weight").distinct().groupBy("scorecard_id").agg(F.array_sort(F.collect_list(F.struct("ord", "weight"))).alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda s, x: s + x["weight"])
    return weights.select("scorecard_id", half_up(total, 6).alias("total_weight"), (F.abs(total - 1) <= 0.001).alias("valid"))


def merge_scorecard(base: Scorecard, patch: Mapping) -> Scorecard:
    """``base`` with known factors and cut-offs of ``patch`` replaced; a patch whose own weights don't add up to 1 is refused."""
    changes = {k: v for k, v in patch.get("factors", {}).items() if any(f.key == k for f in base.factors)}
    weights = [v["weight"] for v in changes.values() if "weight" in v]
    if weights and abs(sum(weights) - 1) > 0.001:
        raise ValueError(f"the weights of a patch must add up to 1, not {sum(weights):g}")
    for key, change in changes.items():
        base = base.with_factor(key, **change)
    return replace(base, **{k: patch["thresholds"][k] for k in ("forward", "review") if k in patch.get("thresholds", {})})


def with_snapshot(scored: DataFrame, card: Scorecard) -> DataFrame:
    """``scored`` with the scorecard's JSON beside each score."""
    import json
    from dataclasses import asdict

    return scored.withColumn("config_snapshot", F.lit(json.dumps(asdict(card), sort_keys=True)))
