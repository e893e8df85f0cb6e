"""Operators against independent folds, and invariants of snapshots."""

import math
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from acrelight.dims import DEFAULT_SCORECARD
from acrelight.operators import features as X
from acrelight.operators import lifecycle as L
from acrelight.operators import lines as N
from acrelight.operators import portfolio as P
from acrelight.operators import scorecard as S
from acrelight.operators import tables as T
from acrelight.sources import tables as R


def fold(values):
    """The scorecard by its definition: from 10 down, the first threshold met; a float sum in factor order."""
    total = 0.0
    for f, v in zip(DEFAULT_SCORECARD.factors, values):
        points = 0
        if v is not None and not math.isnan(v):
            for i, t in enumerate(f.thresholds):
                if (v <= t) if f.lower_is_better else (v >= t):
                    points = 10 - i
                    break
        total += points * f.weight
    return math.floor(total * 100 + 0.5) / 100


def test_scores_match_an_independent_fold(spark):
    draw = random.Random(1)
    rows = []
    for i in range(400):
        values = [None if draw.random() < 0.1 else float("nan") if draw.random() < 0.05 else float(draw.choice(f.thresholds)) if draw.random() < 0.5 else draw.uniform(-1, 2) * max(map(abs, f.thresholds)) for f in DEFAULT_SCORECARD.factors]
        rows.append((i, *values))
    flat = spark.createDataFrame(rows, "id int, " + ", ".join(f"f{i} double" for i in range(13)))
    card = DEFAULT_SCORECARD
    for i, f in enumerate(card.factors):
        card = card.with_factor(f.key, path=f"f{i}")
    found = {r["id"]: r["total_score"] for r in S.score(flat, card).collect()}
    assert found == {r[0]: fold(r[1:]) for r in rows}
    assert {r["id"]: r["total_score"] for r in S.score_many(flat, "id", {"x": card}).collect()} == found


def test_scorecard_patches(spark):
    assert R.load_scorecard('{"thresholds": {"moveForward": 8}}').forward == 8
    with pytest.raises(ValueError, match="add up"):
        S.merge_scorecard(DEFAULT_SCORECARD, {"factors": {"population": {"weight": 0.5}}})
    assert S.merge_scorecard(DEFAULT_SCORECARD, {"thresholds": {"review": 5.0}, "factors": {"nothing": {"weight": 1}}}).review == 5.0


def test_restore_undoes_soft_delete_of_live_rows(spark):
    props = spark.createDataFrame([(i, date(2024, 1, 1) if i % 5 == 0 else None) for i in range(50)], "property_id int, deleted_at date")
    live = props.where("deleted_at is null")
    now = F.lit("2024-03-01").cast("date")
    gone = L.soft_delete({"properties": props}, live, now)
    assert gone["properties"].where("deleted_at is null").count() == 0
    back = L.restore(gone, live, now)["properties"]
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, props.collect()), key=str)


def test_upsert_is_idempotent(spark):
    props = spark.createDataFrame([(7, "1 Main St", "A", "TX", None)], "property_id long, street string, city string, state_abbr string, deleted_at date")
    new = spark.createDataFrame([(1, "1 main street", "a", "tx"), (2, "2 Oak Ave", "A", "TX"), (3, "2 Oak Avenue", "A", "TX"), (4, None, None, None)], "incoming_id long, street string, city string, state_abbr string")
    made = {r["incoming_id"]: (r["property_id"], r["created"]) for r in P.upsert_properties(new, props).collect()}
    assert made == {1: (7, False), 2: (8, True), 3: (8, True), 4: (9, True)}


def test_numbers_follow_order_over_many_partitions(spark):
    df = spark.range(1000).withColumn("id", F.col("id") * 3)
    assert [r["n"] for r in P.numbered_rows(df, "id").orderBy("id").collect()] == list(range(1, 1001))


def test_ranks_of_all_and_of_the_first(spark):
    df = spark.createDataFrame([(i, float(i % 7), date(2024, 1, 1 + i % 5)) for i in range(200)], "property_id int, total_score double, created_at date")
    every = {r["property_id"]: r["rank"] for r in P.rank_properties(df).collect()}
    first = {r["property_id"]: r["rank"] for r in P.rank_properties(df, 50).collect()}
    assert sorted(every.values()) == list(range(1, 201))
    assert first == {k: v for k, v in every.items() if v <= 50}


def test_lookup_tiers(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, i, h, v) for i, (h, v) in enumerate([("Label", "Median Rent"), ("1 Mile", "$5"), ("3 Mile", "$7")])], "doc_id int, src_ord int, table_index int, row_idx int, col_idx int, header string, value string")
    assert T.table_lookup(cells, "median", "3 Mile").first()["value"] == "$7"
    assert T.table_lookup(cells, "median", "mile").first()["value"] == "$5"
    assert T.table_lookup(cells, "median", None).first()["value"] == "$5"
    assert T.table_lookup(cells, "absent", None).count() == 0


def test_markdown_drops_blank_headers_but_not_cells(spark):
    text = "|  | 1 Mile | 3 Mile |\n|---|---|---|\n| Pop | 5 | 7 |"
    tables = spark.createDataFrame([(1, 0, 0, text)], "doc_id int, src_ord int, table_index int, markdown string")
    assert [(r["header"], r["value"]) for r in T.parse_markdown(tables).orderBy("col_idx").collect()] == [("1 Mile", "Pop"), ("3 Mile", "5")]


def test_submarket_example(spark):
    rows = [(0, "Current Quarter", "Submarket"), (0, "Units", "31,741"), (0, "Under Constr Units", "507"), (0, "Vacancy Rate", "8.6%"), (1, "Current Quarter", "Delivered Units"), (1, "Units", "1,086")]
    cells = spark.createDataFrame([(1, 0, 0, r, i, h, v) for i, (r, h, v) in enumerate(rows)], "doc_id int, src_ord int, table_index int, row_idx int, col_idx int, header string, value string")
    r = X.submarket_features(cells).first()
    assert (r["vacancy_rate"], r["delivered_pct_of_inventory"], r["construction_pct_of_inventory"]) == pytest.approx((0.086, 1086 / 31741, 507 / 31741))
    texts = spark.createDataFrame([(1, "Submarket vacancy rate is 9.7 %.")], "doc_id int, text string")
    assert X.submarket_features(cells, texts).first()["vacancy_rate"] == pytest.approx(0.097)


def test_policies(spark):
    df = spark.createDataFrame([("Dogs Allowed\nNo pets\nDeposit $300\nDeposit $1,200\nFree gas and WiFi",)], "t string")
    r = df.select(X.pet_policy(F.col("t")).alias("p"), X.one_time_fees(F.col("t")).alias("f"), X.recurring_expenses(F.col("t")).alias("u")).first()
    assert (r["p"]["dogs_allowed"], r["f"]["deposit"], r["f"]["admin_fee"], r["u"]) == (False, 1200.0, None, ["Gas", "Wifi"])


def test_table_detection_carries_positions(spark):
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(["intro", "a   b   c", "d   e   f", "g   h   i", "end", "x   y   z"])], "doc_id long, line_idx int, line string")
    r = N.detect_tables(lines).collect()
    assert [(x["first_line"], x["last_line"], x["n_rows"]) for x in r] == [(1, 3, 3)]
    assert len(r[0]["positions"]) == 3


def test_section_files(spark, tmp_path):
    for name, text in (("e_1-a_demographics.json", '{"section": "demographics", "raw_text": "x"}'), ("e_1-a.json", '{"section": "all"}'), ("bad_construction.json", "{oops")):
        (tmp_path / name).write_text(text)
    found = {(r["base"], r["section"]): r["status"] for r in R.read_sections(spark, str(tmp_path)).collect()}
    assert found == {("e_1-a", "demographics"): "success", ("e_1-a", "combined"): "success", ("bad", "construction"): "error"}


def test_files(spark, tmp_path):
    (tmp_path / "e_report.pdf").write_text("x")
    (tmp_path / "b.zip").write_text("xy")
    found = {r["file_name"]: (r["size"], r["display_name"], r["kind"], r["error"]) for r in R.route_files(R.file_registry(spark, str(tmp_path))).collect()}
    assert found == {"e_report.pdf": (1, "report", "pdf", None), "b.zip": (2, "b", None, "unsupported type: zip")}
    (tmp_path / "t.csv").write_text("a, b\n 1 , x \n\n2,y\n")
    assert [tuple(r) for r in R.read_csv(spark, str(tmp_path / "t.csv")).collect()] == [(1, "x"), (2, "y")]
