"""Operators with plans of their own, against plain versions of their rules."""

import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from acrelight.operators.formulas import rank_comparables
from acrelight.operators.html import elements, table_rows
from acrelight.operators.lines import detect_tables, looks_like_table, related_lines
from acrelight.operators.portfolio import link_documents
from acrelight.operators.profile import profile
from acrelight.sources.tables import load_jdbc_tables, load_mappings, read_jdbc, read_mappings


def test_medians_and_counts_of_all_columns(spark):
    draw = random.Random(1)
    rows = [(draw.choice([None, 1.5, 2.0, 1e6, -3.25]), draw.choice(["x", "", None, "7"]), draw.randrange(40), None) for _ in range(501)] + [(7.0, "y", 3, None)]
    found = {r.column: r for r in profile(spark.createDataFrame(rows, "a double, b string, c int, d string").repartition(5)).collect()}
    a, c = [r[0] for r in rows if r[0] is not None], [r[2] for r in rows]
    assert (found["a"].median, found["c"].median) == (statistics.median(a), statistics.median(c))
    assert (found["a"].dtype, found["b"].dtype, found["c"].dtype, found["d"].dtype) == ("numeric", "text", "numeric", "empty")
    assert (found["b"].median, found["b"].unique_count, found["d"].median, found["d"].null_count) == (7.0, 3, None, len(rows))


def test_tables_by_running_positions(spark):
    draw = random.Random(2)
    data = []
    for doc in range(30):
        for i in range(40):
            wide = draw.random() < 0.8
            cells = [draw.choice(["a", "bb", "$9", "c c"]) + " " * draw.randrange(2, 9) for _ in range(draw.randrange(3, 6))]
            data.append((doc, i, "".join(cells) + "end" if wide else "plain words"))
    lines = spark.createDataFrame(data, "doc_id long, line_idx int, line string")
    like = {(r.doc_id, r.line_idx) for r in lines.where(looks_like_table(F.col("line"))).collect()}
    wanted = []
    for doc in range(30):
        runs, run = [], []
        for d, i, line in [x for x in data if x[0] == doc]:
            if (d, i) in like:
                run.append((i, [float(j) for j, ch in enumerate(line) if ch != " " and (j == 0 or line[j - 2 : j] == "  ")]))
            elif run:
                runs, run = [*runs, run], []
        for run in [r for r in [*runs, run] if len(r) >= 3]:
            at = []
            for _, starts in run:
                for s in starts:
                    close = next((k for k, p in enumerate(at) if abs(p - s) <= 1), None)
                    if close is None:
                        at.append(s)
                    else:
                        at[close] = (2 * at[close] + s) / 3
            wanted.append((doc, run[0][0], run[-1][0], len(run), sorted(at)))
    assert sorted((r.doc_id, r.first_line, r.last_line, r.n_rows, r.positions) for r in detect_tables(lines).collect()) == sorted(wanted)


def test_lines_under_the_first_key_that_they_mention(spark):
    draw = random.Random(3)
    names = ["Rent", "rent roll", "Year", "No", "", "é", "Units", "abc", "abcd", "abcde"]
    data = [(d, i, f" {draw.choice(names)} : {draw.choice(names)}: x" if draw.random() < 0.3 else draw.choice(["", "  ", " ".join(draw.choice([n.upper(), n, "word", "ABCDEF"]) for n in draw.sample(names, 3))])) for d in range(40) for i in range(12)]
    wanted = []
    for d in range(40):
        keys = {}
        for _, i, line in [x for x in data if x[0] == d]:
            if ":" in line:
                keys.setdefault(line.split(":")[0].strip(), i)
            elif line.strip():
                key = next((k for k, _ in sorted(keys.items(), key=lambda x: x[1]) if k.lower() in line.lower()), None)
                if key is not None:
                    wanted.append((d, i, key, line.strip()))
    found = related_lines(spark.createDataFrame(data, "doc_id long, line_idx int, line string"))
    assert sorted((r.doc_id, r.line_idx, r.key, r.related) for r in found.collect()) == sorted(wanted)


def test_links_as_if_put_in_one_by_one(spark):
    draw = random.Random(4)
    row = lambda i: (i, draw.randrange(3), draw.choice([None, "p1", "p2", "p3", "p4"]), draw.choice([None, "f1", "f2", "f3", "f4"]))
    there, incoming = [row(i) for i in range(4)], [row(i) for i in range(100, 160)] + [(200, None, "p1", "f1")]
    inserted = list(there)
    for r in sorted(incoming, key=lambda r: r[0]):
        if r[1] is not None and not any(r[1] == x[1] and ((r[2] is not None and r[2] == x[2]) or (r[3] is not None and r[3] == x[3])) for x in inserted):
            inserted.append(r)
    frame = lambda rows: spark.createDataFrame(rows, "id long, property_id long, storage_path string, file_name string")
    assert sorted(map(tuple, link_documents(frame(incoming + incoming[:5]), frame(there)).collect()), key=str) == sorted(inserted[4:], key=str)
    assert link_documents(frame([]), frame(there)).collect() == []


def test_ranks_without_a_window_by_market(spark):
    draw = random.Random(5)
    rows = [(i, draw.choice(["a", "b", None]), draw.choice([None, 1.0, 2.0, 3.5])) for i in range(200)]
    found = rank_comparables(spark.createDataFrame(rows, "id long, market string, rent_per_sf double").repartition(7))
    assert found.columns == ["id", "market", "rent_per_sf", "rank", "market_mean"]
    for r in found.collect():
        same = [x[2] for x in rows if x[1] == r.market]
        known = [v for v in same if v is not None]
        assert r["rank"] == (len(known) if r.rent_per_sf is None else sum(v > r.rent_per_sf for v in known)) + 1
        assert r.market_mean == pytest.approx(sum(known) / len(known))
    assert found.count() == 200


def test_elements_by_nesting(spark):
    html = '<div class="a"><p>one<div class=\'b\'>two</div><br><!-- <div class="b"> --></div><script>"<div class=b>"</script><div class="b">three<span>'
    pages = spark.createDataFrame([(1, html), (2, "no tags"), (3, None)], "page_id long, html string")
    found = sorted((r.page_id, r.at, r.inner) for r in elements(pages, lambda t: F.contains(t, F.lit("class="))).collect())
    assert [x[2] for x in found] == ["<p>one<div class='b'>two</div><br><!-- <div class=\"b\"> -->", "two", "three<span>"]
    rows = spark.createDataFrame([("<table><tr><th>a<th> b <tr><td>1</td><td><b>2</b></table><tr><td>x",)], "h string").select(table_rows(F.col("h"))).head()[0]
    assert rows == [["a", "b"], ["1", "2"], ["x"]]


def test_a_database_is_read_in_ranges(spark):
    url = "jdbc:derby:memory:acrelight;create=true"
    rows = spark.range(5, 105).selectExpr("id", "concat('n', id % 7) AS name")
    rows.write.format("jdbc").option("url", url).option("dbtable", "properties").mode("overwrite").save()
    read = read_jdbc(spark, url, "properties", "id", 8)
    assert read.rdd.getNumPartitions() == 8
    assert sorted(r[0] for r in read.collect()) == list(range(5, 105))
    assert all(len(part) < 20 for part in read.rdd.glom().collect())
    plan = read.where("name = 'n3'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(name,n3)" in plan
    spark.createDataFrame([], "id long, name string").write.format("jdbc").option("url", url).option("dbtable", "scores").mode("overwrite").save()
    found = load_jdbc_tables(spark, url, {"properties": "id", "scores": "id"})
    assert (found["properties"].count(), found["scores"].count()) == (100, 0)


def test_mappings_from_a_text_and_from_a_table(spark):
    text = '{"sheets": {"Summary": {"fields": [{"cell": "B2", "json_path": "a.b"}, {"cell": "B3", "transform": "to_number"}]}, "Units": {"fields": [{"cell": "C1", "label": "First", "json_path": "u[0]", "source": "external"}]}, "Empty": {}}}'
    listed = [(m.sheet, m.cell, m.label, m.json_path, m.transform, m.source) for m in load_mappings(text)]
    assert listed == [("Summary", "B2", "", "a.b", None, "pdf_extract"), ("Summary", "B3", "", None, "to_number", "pdf_extract"), ("Units", "C1", "First", "u[0]", None, "external")]
    sheets = spark.createDataFrame([(k, json.dumps(v)) for k, v in json.loads(text)["sheets"].items()] + [("Bad", "{ cut")], "sheet string, json string")
    found = read_mappings(sheets).select("sheet", "cell", "label", "json_path", "transform", "source").collect()
    assert sorted(map(tuple, found), key=str) == sorted(listed, key=str)
