"""Versioned tables, section files in batches, lookups in both forms."""

import json

import pytest
from pyspark.sql import functions as F

from acrelight.operators.sectiondocs import rescore_sections
from acrelight.operators.tables import table_lookups
from acrelight.sources.tables import read_sections
from acrelight.sources.versions import VersionedTable
from acrelight.streaming.sections import score_table, section_stream, section_table, stream_sections


def table(spark, path, **more):
    return VersionedTable(spark, str(path), "a string, b int, x double, tags map<string,string>", ["a", "b"], **more)


def rows(spark, *found):
    return spark.createDataFrame([(a, b, x, {"v": str(x)}) for a, b, x in found], "a string, b int, x double, tags map<string,string>")


def held(t, version=None):
    return sorted(((r.a, r.b, r.x) for r in t.read(version).collect()), key=str)


def test_upserts_keep_the_newest_and_old_versions(spark, tmp_path):
    t = table(spark, tmp_path, buckets=3)
    assert held(t) == []
    assert t.upsert(rows(spark, ("p", 1, 1.0), ("q", 1, 5.0), (None, None, 1.0)), ["x"]) == 1
    assert t.upsert(rows(spark, ("p", 1, 2.0), ("q", 1, 4.0), ("p", 2, 9.0), (None, None, 2.0)), ["x"]) == 2
    assert held(t) == sorted([("p", 1, 2.0), ("q", 1, 5.0), ("p", 2, 9.0), (None, None, 2.0)], key=str)
    assert held(t, 1) == sorted([("p", 1, 1.0), ("q", 1, 5.0), (None, None, 1.0)], key=str)
    assert sorted(r.b for r in t.read_beside(rows(spark, ("p", 7, 0.0))).collect()) == [1, 2]


def test_a_failed_write_leaves_the_former_version(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(rows(spark, ("p", 1, 1.0)), ["x"])
    with pytest.raises(Exception, match="cut off"):
        t.upsert(rows(spark, ("p", 1, 2.0)).withColumn("x", F.when(F.col("b") == 1, F.raise_error(F.lit("cut off")).cast("double"))), ["x"])
    assert held(t) == [("p", 1, 1.0)]
    before = t.manifest()
    t._publish = lambda manifest: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError, match="lost"):
        t.upsert(rows(spark, ("p", 1, 3.0)), ["x"])
    assert (t.manifest(), held(t)) == (before, [("p", 1, 1.0)])


def test_two_writers_of_one_version(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(rows(spark, ("p", 1, 1.0)), ["x"])
    with pytest.raises(Exception, match="(?i)exist"):
        t._publish(t.manifest())


def test_a_batch_counts_once_for_each_source(spark, tmp_path):
    t = table(spark, tmp_path)
    for _ in range(2):
        assert t.upsert(rows(spark, ("p", 1, 1.0)), ["x"], "s", 4) == 1
    assert t.upsert(rows(spark, ("p", 1, 7.0)), ["x"], "s", 3) == 1
    assert t.upsert(rows(spark, ("p", 1, 7.0)), ["x"], "other", 3) == 2
    assert held(t) == [("p", 1, 7.0)]


def test_compaction_removes_what_no_version_names(spark, tmp_path):
    t = table(spark, tmp_path, buckets=2)
    for i in range(5):
        t.upsert(rows(spark, (f"k{i % 3}", 1, float(i))), ["x"])
    wanted = held(t)
    (tmp_path / "data" / "000000000099-left").mkdir()
    assert t.compact(2) == [4, 5]
    named = {f.split("/")[1] for v in (4, 5) for f in t.manifest(v)["buckets"].values()}
    assert {p.name for p in (tmp_path / "data").iterdir()} == named
    assert held(t) == wanted


def document(date, population, vacancy="5%", tables=None):
    cells = [{"Label": "2024 Population", "3 Mile": population}]
    return json.dumps({"metadata": {"extraction_date": date}, "pages": [{"page_number": 1, "text_items": [{"text": f"vacancy rate of {vacancy}"}]}], "tables": tables or [{"headers": ["Label", "3 Mile"], "rows": cells}]})


def test_files_in_batches_give_what_one_scan_of_the_newest_gives(spark, tmp_path):
    inbox = tmp_path / "in"
    sections, scores = section_table(spark, f"{tmp_path}/sections", 4), score_table(spark, f"{tmp_path}/scores", 4)

    def deliver(folder, **files):
        (inbox / folder).mkdir(parents=True)
        for name, text in files.items():
            (inbox / folder / f"{name}.json").write_text(text)
        stream_sections(section_stream(spark, str(inbox)), sections, scores, f"{tmp_path}/checkpoint").awaitTermination()
        return {r.base: (r.total_score, r.error, r.batch) for r in scores.read().collect()}

    first = deliver("1", x_demographics=document("2024-01-01", "45,000"), y_demographics=document("2024-01-01", "70,000"), z_demographics="{ no document")
    assert first["z"][1] == "no section could be read"
    second = deliver("2", x_construction=document("2024-02-01", "1", "15%"), z_demographics=document("2024-02-02", "30,000"))
    assert second["x"][0] != first["x"][0]
    assert second["y"] == first["y"]
    third = deliver("3", x_demographics=document("2024-03-01", "90,000"), y_demographics=document("2024-01-01", "70,000"))
    fourth = deliver("4", x_demographics=document("2023-01-01", "20,000"))
    assert {b: s[0] for b, s in fourth.items()} == {b: s[0] for b, s in third.items()}
    (tmp_path / "last").mkdir()
    newest = {"x_demographics": ("3", "x_demographics"), "x_construction": ("2", "x_construction"), "y_demographics": ("1", "y_demographics"), "z_demographics": ("2", "z_demographics")}
    for name, (folder, file) in newest.items():
        (tmp_path / "last" / f"{name}.json").write_text((inbox / folder / f"{file}.json").read_text())
    at_once = {r.base: r.total_score for r in rescore_sections(read_sections(spark, f"{tmp_path}/last")).collect()}
    assert {b: s[0] for b, s in fourth.items()} == at_once


def test_lookups_take_markdown_first_and_rows_next(spark):
    cell = lambda t, form, row, *values: [("d", 0, t, form, row, i, h, v) for i, (h, v) in enumerate(zip(("Label", "1 Mile", "3 mile", "Note"), values))]
    data = [*cell(0, 1, 0, "Median Rent", "-", "7", "x"), *cell(0, 0, 5, "median rent (all)", "1", "", "x"), *cell(1, 0, 0, "Growth", "a", "b", "c"), *cell(1, 1, 0, "Walk Score", "none", "none", "88 of 100"), *cell(1, 1, 1, "walk score", "1", "2", "3")]
    cells = spark.createDataFrame(data, "doc_id string, src_ord int, table_index int, form int, row_idx int, col_idx int, header string, value string")
    found = table_lookups(cells, {"rent": ("Median Rent", "3 Mile"), "note": ("median", "NOTE"), "growth": ("growth", None), "walk": ("Walk Score", ""), "none": ("absent", "3 Mile")}).head()
    assert (found.rent, found.note, found.growth, found.walk, found.none) == ("", "x", "a", "88 of 100", None)
