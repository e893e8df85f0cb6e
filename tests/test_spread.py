"""What one task holds doesn't grow with a part of the input that can't be split."""

from pyspark.sql import functions as F

from acrelight.operators import features, freetext, sectiondocs, tables
from acrelight.plans import section_queries
from acrelight.plans.feature_queries import address_items
from acrelight.plans.source_queries import info_cells
from acrelight.sources.shared import fresh_path
from acrelight.sources.versions import VersionedTable

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_bucket_is_written_by_several_tasks(spark):
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    for name, value in small.items():
        spark.conf.set(name, value)
    try:
        table = VersionedTable(spark, fresh_path(spark), "a long, b long, text string", ["a", "b"], 1)
        rows = spark.range(20000).select((F.col("id") % 50).alias("a"), F.col("id").alias("b"), F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1)
        table.upsert(rows, ["text"])
        assert len(table.read().inputFiles()) > 1 and table.read().count() == 20000
    finally:
        for name in small:
            spark.conf.unset(name)


def test_section_documents_are_spread_before_they_expand(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(sectiondocs, "stage", lambda df: seen.append(plan(df)) or df)
    sections = section_queries.as_sections(section_queries.edition_documents(spark, SF).where("v = 0").coalesce(1))
    sectiondocs.section_records(sections)
    assert "hashpartitioning(base" in seen[0]


def test_unit_row_is_matched_once(spark):
    lines = spark.createDataFrame([("1 2 1,050 7 12.5% 3 6.3% $1,2,3 $1.50 $1,400 $1.45 0.5% more\nlines $1",), ("Totals",), (None,)], "line string")
    found = lines.select(freetext.parse_unit_row(F.col("line")).alias("u"))
    rows = [r["u"] for r in found.collect()]
    assert rows[1:] == [None, None]
    assert (rows[0]["beds"], rows[0]["avg_sf"], rows[0]["units"], rows[0]["asking_rent"], rows[0]["effective_rent_sf"], rows[0]["concessions"]) == (1, 1050.0, 7, None, 1.45, 0.5)
    assert plan(found).count(r"(\d+)\s+(\d+)\s+") <= 2


def test_cells_right_of_the_values_leave_before_labels(spark):
    lines = plan(tables.property_info(info_cells(spark, SF))).split("\n")
    window = next(i for i, x in enumerate(lines) if "Window" in x)
    assert any("Generate" in x for x in lines[window:])
    assert any("Filter" in x and "col_idx" in x and "<= 1" in x for x in lines[window + 1 :])


def test_items_meet_by_document_before_they_are_sorted(spark):
    lines = plan(features.extract_address(address_items(spark, SF))).split("\n")
    last = lambda word: max(i for i, x in enumerate(lines) if word in x)
    assert last("Aggregate") < last("Exchange")


def test_table_lookup_sorts_shuffled_parts_of_documents(spark):
    from acrelight.plans import registry

    plan = registry.queries()["table_lookup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.split("\n") if "Exchange" in line]
    # before, there were three, and the first came after a sort of the whole file's part
    assert len(shuffles) == 1 and "hashpartitioning(doc_id" in shuffles[0]
    assert "Sort" not in plan[plan.index("Exchange") :]


def test_pages_are_taken_apart_only_where_an_element_may_be(spark):
    from acrelight.operators import enrich, html

    rows = [(1, '<div CLASS = "a my-crime"><b>5.5 violent</b></div>'), (2, "<p id='crime'>7 property</p>"), (3, "<p>crime class=x</p>"), (4, None), (5, '<p>Violent Crime: 3</p><p>Property: 4</p>')]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    tag = lambda t: html.class_has(t, "crime") | (html.attribute(t, "id") == "crime")
    mark = html.named("crime", attributes="class|id")
    assert {r["page_id"] for r in pages.where(F.col("html").rlike(mark)).collect()} == {1, 2}
    assert sorted(html.elements(pages, tag, mark).collect()) == sorted(html.elements(pages, tag).collect())
    found = {r["page_id"]: r["tier"] for r in enrich.crime_indices(pages).collect()}
    assert found == {1: 3, 2: 3, 3: None, 4: None, 5: 2}


def test_filters_on_indices_do_not_work_them_out_again(spark):
    from acrelight.operators import enrich

    pages = spark.createDataFrame([(1, "<p>Violent Crime: 3</p>")], "page_id long, html string")
    text = plan(enrich.crime_indices(pages).where("violent_crime_index is not null or property_crime_index is not null"))
    # before, there were 47: in the filter, in the selection, and once for each index of each tier
    assert text.count("regexp_extract_all(html") <= 15


def test_assigned_schools_are_found_once(spark):
    from acrelight.plans import registry

    # before, the pages were taken apart for them in the union and again in the join beside it
    assert "school-list(?:" not in plan(registry.queries()["schools_by_level"](spark, SF)) and "array_contains" not in plan(registry.queries()["schools_by_level"](spark, SF))


def test_cells_are_dealt_out_before_they_are_grouped(spark):
    from acrelight.plans import registry

    # before, the first aggregate of each branch went over a whole part of the file
    for name in ("demographics_lookups", "unit_mix_cells", "rescore"):
        lines = plan(registry.queries()[name](spark, SF)).split("\n")
        scans = [i for i, x in enumerate(lines) if "Scan parquet" in x and ("l_orderkey" in x or "o_totalprice" in x) and "o_custkey" not in x]
        assert scans
        for i in scans:
            up = next(x for x in reversed(lines[:i]) if "Exchange" in x or "Aggregate" in x)
            assert "REPARTITION_BY_NUM" in up, (name, up)
