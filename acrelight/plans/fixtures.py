"""Views over the driver's tables that stand for the domain's inputs.

Each view is SQL that Spark and the oracle's engine read alike; ``{table}``
stands for a table. ``view`` makes one a DataFrame, ``cte`` puts it into SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

STATES = ["AZ", "NC", "TX", "CA", "NY", "FL", "OH", "IL", "GA", "WA", "CO", "PA", "MI", "VA", "NJ", "MA", "TN", "IN", "MO", "WI", "MN", "OR", "nv", "ZZ"]


def ratio(expression: str, by: int) -> str:
    return f"(CAST({expression} AS DOUBLE) / CAST({by} AS DOUBLE))"


K = "c_custkey"
VIEWS: dict[str, str] = {
    "properties_fx": f"""
        SELECT {K} AS property_id, c_name AS name,
          CASE c_nationkey {" ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STATES))} END AS state_abbr,
          CASE WHEN {K} % 97 = 0 THEN NULL ELSE concat('City ', CAST({K} % 7 AS STRING)) END AS city,
          concat(CAST({K} % 20 + 1 AS STRING), ' Main ', CASE {K} % 3 WHEN 0 THEN 'Street' WHEN 1 THEN 'St.' ELSE 'st' END) AS street,
          DATE '2023-01-01' + CAST({K} % 365 AS INT) AS created_at,
          CASE WHEN {K} % 11 = 0 THEN DATE '2024-01-01' + CAST({K} % 60 AS INT) END AS deleted_at
        FROM {{customer}}""",
    "home_fx": "SELECT o_custkey AS k, max(CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice END) AS price FROM {orders} GROUP BY o_custkey",
    "features_fx": f"""
        SELECT {K} AS property_id,
          CASE WHEN {K} % 13 = 0 THEN NULL ELSE CAST(20000 + ({K} * 7919) % 55000 AS DOUBLE) END AS population,
          {ratio(f"({K} * 31) % 300 - 150", 10000)} AS growth,
          CAST(20000 + ({K} * 104729) % 60000 AS DOUBLE) AS income,
          price * {ratio(f"({K} % 10) + 1", 10)} AS home_value,
          {ratio(f"({K} * 17) % 60", 100)} AS renter,
          {ratio(f"({K} * 13) % 800", 10)} AS violent,
          {ratio(f"({K} * 29) % 900", 10)} AS property_crime,
          CASE WHEN {K} % 5 = 0 THEN NULL ELSE {ratio(f"({K} * 3) % 101", 10)} END AS school,
          CAST(({K} * 7) % 101 AS DOUBLE) AS walk, CAST(({K} * 11) % 101 AS DOUBLE) AS transit,
          {ratio(f"({K} * 19) % 200", 1000)} AS vacancy, {ratio(f"({K} * 23) % 80", 1000)} AS delivered, {ratio(f"({K} * 27) % 90", 1000)} AS building
        FROM {{customer}} LEFT JOIN {{home_fx}} h ON {K} = h.k""",
    "units_fx": """
        SELECT l_orderkey AS property_id,
          CASE l_linenumber WHEN 7 THEN 'Totals' WHEN 6 THEN 'All 2 Beds' ELSE CAST(l_linenumber % 3 + 1 AS STRING) END AS bed,
          l_linenumber % 2 + 1 AS bath, 500 + l_partkey % 700 AS avg_sf, CAST(l_quantity AS INT) AS units,
          CAST(floor(l_quantity * l_discount) AS INT) AS available, l_extendedprice / CAST(100 AS DOUBLE) AS asking_rent
        FROM {lineitem}""",
    "cells_fx": """
        SELECT l_orderkey AS doc_id, l_suppkey % 2 AS table_index, l_linenumber AS row_idx, l_partkey AS t1, l_suppkey AS t2, l_extendedprice AS t3,
          CASE l_linenumber WHEN 1 THEN '2024 Population' WHEN 7 THEN '2024 Population' WHEN 2 THEN 'Pop Growth 2024-2029' WHEN 3 THEN 'Median Household Income'
            WHEN 4 THEN 'Median Home Value' WHEN 5 THEN 'Renter Occupied' ELSE 'Household Growth' END AS label,
          CASE WHEN l_partkey % 19 = 0 THEN '-' WHEN l_linenumber IN (1, 7) THEN CAST(l_partkey AS STRING)
            WHEN l_linenumber IN (3, 4) THEN concat('$', CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING))
            ELSE concat(CAST(CAST(l_quantity AS INT) AS STRING), '%') END AS value
        FROM {lineitem}""",
    "pages_fx": "SELECT conv_id AS doc_id, turn AS page_number, role AS header, text FROM {conversations}",
    "documents_fx": "SELECT o_orderkey AS id, o_custkey AS property_id, CAST(o_orderdate AS DATE) AS uploaded_at, concat('store/e_', CAST(o_orderkey AS STRING), '-ab', CAST(o_orderkey % 10 AS STRING), '_file.pdf') AS path FROM {orders}",
    "extracted_fx": "SELECT l_orderkey AS property_id, CASE l_linenumber WHEN 1 THEN 'subject_property' WHEN 2 THEN 'demographics' WHEN 3 THEN 'construction' WHEN 4 THEN 'rent_comps' ELSE 'market_report' END AS section, l_partkey AS id, CAST(l_partkey AS STRING) AS content FROM {lineitem}",
    "html_fx": """
        SELECT page_id, concat(html, CASE WHEN page_id % 4 <> 0 THEN concat('<img alt="', CAST(page_id % 101 AS STRING), ' Walk Score of X">') ELSE '' END,
          CASE WHEN page_id % 3 <> 0 THEN concat('<p>Violent Crime: ', CAST(page_id % 80 AS STRING), '.5</p>') ELSE '' END,
          CASE WHEN page_id % 2 = 0 THEN concat('<p>Property Crime: ', CAST(page_id % 70 AS STRING), '.3</p>') ELSE '' END,
          CASE WHEN page_id % 5 = 0 THEN concat('<p>Overall Crime: ', CAST(page_id % 60 + 1 AS STRING), '.1</p>') ELSE '' END,
          '<div class="school"><span class="circle-rating--', CAST(page_id % 11 AS STRING), '"></span>Elementary School</div>') AS html
        FROM {pages}""",
    "captured_fx": r"""
        SELECT page_id, concat(html,
          CASE page_id % 6
            WHEN 0 THEN concat('<img aria-label="Violent, 22.7. USA"><img aria-label="Violent, ', CAST(page_id % 80 + 1 AS STRING), '.4. Some State."><svg role="img" aria-label="Property, ', CAST(page_id % 70 + 1 AS STRING), '.5. Some State."></svg>')
            WHEN 1 THEN concat('<p>Violent Crime: ', CAST(page_id % 80 + 1 AS STRING), '.4</p><table><tr><th>Kind<th>Index</tr><tr><td>Property crime</td><td>about ', CAST(page_id % 70 + 1 AS STRING), '.5</td></tr><tr><td>Overall<td>', CAST(page_id % 60 + 1 AS STRING), '</table>')
            WHEN 2 THEN concat('<p>99 violent storms elsewhere</p><div class="crime-data"><div>It is ', CAST(page_id % 80 + 1 AS STRING), '.4 for violent acts</div> while the property crime rate is ', CAST(page_id % 70 + 1 AS STRING), '.5</div>')
            WHEN 3 THEN concat('<div class="progress-bar" aria-label="Violent" aria-valuenow="', CAST(page_id % 80 + 1 AS STRING), '.4"></div><div class="meter" aria-label="Property level" style="width: ', CAST(page_id % 70 + 1 AS STRING), '.5%"></div>')
            WHEN 4 THEN concat('<div class="violent"><div><svg><text>', CAST(page_id % 80 + 1 AS STRING), '.4</text></svg></div></div><div class="box property"><span class="chart-value">', CAST(page_id % 70 + 1 AS STRING), '.5</span></div>')
            ELSE '' END,
          CASE page_id % 4
            WHEN 0 THEN concat('<div class="school-list"><ul><li class="school-card"><div><a href="/school/1">North School</a><div class="circle-rating--search-page circle-rating--', CAST(page_id % 10 + 1 AS STRING), '"></div></div><div class="assigned-tag">Assigned: Mesa Elementary District</div></li>',
              '<li><section><a href="/school/2">East</a><span class="circle-rating--search-page circle-rating--9">9</span> High School<div><div class="assigned-tag">Assigned</div></div></section></li><li><section><a href="/school/3">Other Elementary School</a></section></li></ul></div>')
            WHEN 1 THEN concat('<article class="big school"><h3>Hill School</h3><span class="rating" data-rating="', CAST(page_id % 10 + 1 AS STRING), '"></span><p>for K-5</article><article class="school"><div class="title">Dale Middle</div><i class="score">4/10</i></article>')
            WHEN 2 THEN concat('<div class="school-card"><h2>Alpha Academy</h2><span class="circle" aria-label="rated ', CAST(page_id % 10 + 1 AS STRING), '"></span><span class="grades">K</span></div><div class="school-card"><h2>Beta Academy</h2><span class="grades">10-12</span></div>')
            ELSE concat('<table><tr><td>Lake Middle</td><td>Rating ', CAST(page_id % 10 + 1 AS STRING), '</td></tr><tr><td>none</td><td>x</td></tr></table>') END) AS html
        FROM {pages}""",
}
SOURCES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


def needs(name: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", VIEWS[name])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in SOURCES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(VIEWS[name], **{n: view(spark, sf_dir, n) for n in needs(name)})


def dealt_out(df: DataFrame, key: str) -> DataFrame:
    """``df`` by ``key`` over all shuffle partitions: left alone, adaptive execution makes few of them, and what one task sorts or hashes is many times its packed bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def cte(*names: str) -> str:
    """'name AS (...)' of the views and those that they need, in order."""
    found: dict[str, str] = {}

    def add(name: str) -> None:
        if name in VIEWS and name not in found:
            for n in needs(name):
                add(n)
            found[name] = f"{name} AS ({VIEWS[name].format(**{n: n for n in needs(name)})})"

    for name in names:
        add(name)
    return ",\n".join(found.values())
