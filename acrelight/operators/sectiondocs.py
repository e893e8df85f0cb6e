"""Section documents of a base, as read from section files, to scorecard records with every fallback.

Documents are (base, section, document): nested pages, tables and raw text. Of
each base the tables of several sections are gathered in a fixed order, a
section's own tables before those of its pages.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrelight.dims import DEFAULT_SCORECARD, Scorecard
from acrelight.functions.values import parse_numeric
from acrelight.operators import features as X
from acrelight.operators import scorecard as S
from acrelight.operators.freetext import match_source_document
from acrelight.operators.portfolio import link_documents, link_new, upsert_properties
from acrelight.operators.sections import has_property_data
from acrelight.operators.tables import parse_markdown, table_lookups
from acrelight.sources.shared import stage

#: Sections whose tables and prose a feature group comes from, in the order in which they are looked through.
DEMOGRAPHICS = ["submarket_report", "demographics"]
SUBMARKET = ["construction", "submarket_report", "demographics"]
PROPERTY = ["subject_property"]


def _place(order: Sequence[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, order)), F.col("section")).cast("int")


def section_tables(sections: DataFrame, order: Sequence[str]) -> DataFrame:
    """(doc_id, src_ord, table_index, headers, rows, markdown) of the tables of sections in ``order``."""
    here = sections.where(F.col("section").isin(*order))
    pages = F.flatten(F.transform(F.coalesce("document.pages", F.array()), lambda p: F.coalesce(p["tables"], F.array())))
    lists = F.array(F.struct(F.lit(0).alias("of"), F.coalesce("document.tables", F.array()).alias("tables")), F.struct(F.lit(1).alias("of"), pages.alias("tables")))
    each = here.select(F.col("base").alias("doc_id"), _place(order).alias("at"), F.inline(lists)).select("doc_id", (F.col("at") * 2 + F.col("of")).alias("src_ord"), F.posexplode("tables").alias("table_index", "t"))
    return each.select("doc_id", "src_ord", "table_index", "t.headers", "t.rows", "t.markdown")


def table_cells(tables: DataFrame) -> DataFrame:
    """(doc_id, src_ord, table_index, form, row_idx, col_idx, header, value) of both forms of each table.

    Form 0 is a table's markdown, form 1 its rows, whose columns go by the
    headers, or by the row's own keys without any.
    """
    at = ["doc_id", "src_ord", "table_index"]
    markdown = parse_markdown(tables.where(F.col("markdown").isNotNull())).withColumn("form", F.lit(0))
    rows = tables.select(*at, F.coalesce("headers", F.array()).alias("h"), F.posexplode("rows").alias("row_idx", "row")).where(F.col("row").isNotNull())
    names = F.when(F.size("h") > 0, F.filter("h", lambda h: F.map_contains_key("row", h))).otherwise(F.map_keys("row"))
    cells = rows.select(*at, "row_idx", "row", F.posexplode(F.array_distinct(names)).alias("col_idx", "header")).withColumn("value", F.coalesce(F.try_element_at("row", F.col("header")), F.lit(""))).withColumn("form", F.lit(1))
    columns = [*at, "form", "row_idx", "col_idx", "header", "value"]
    return markdown.select(*columns).unionByName(cells.select(*columns))


def section_texts(sections: DataFrame, order: Sequence[str]) -> DataFrame:
    """(doc_id, src_ord, page_number, item_idx, text) of the text items of sections in ``order``; pages by their place."""
    here = sections.where(F.col("section").isin(*order)).select(F.col("base").alias("doc_id"), _place(order).alias("src_ord"), F.posexplode("document.pages").alias("page_number", "p"))
    return here.select("doc_id", "src_ord", "page_number", F.posexplode("p.text_items").alias("item_idx", "i")).select("doc_id", "src_ord", "page_number", "item_idx", F.coalesce("i.text", F.lit("")).alias("text"))


def demographics(sections: DataFrame, years: Sequence[str] = ("2024",)) -> DataFrame:
    """(doc_id, five 3-mile features): the last row that matches, else a lookup in any table, for renters else the prose."""
    cells = table_cells(section_tables(sections, DEMOGRAPHICS))
    found = X.with_lookups(X.demographics_features(cells.where("form = 1"), years=years), cells, X.DEMOGRAPHICS_LOOKUPS)
    return X.renters_from_prose(found, section_texts(sections, ["demographics"]))


def submarket(sections: DataFrame) -> DataFrame:
    """(doc_id, vacancy_rate, delivered_pct_of_inventory, construction_pct_of_inventory): prose and tables, for vacancy at last a lookup."""
    cells = table_cells(section_tables(sections, SUBMARKET))
    own = X.submarket_features(cells.where("form = 1"), section_texts(sections, SUBMARKET))
    found = table_lookups(cells, {"_vacancy": ("Submarket", "Vacancy Rate")})
    text = F.when(F.col("_vacancy") != "", F.col("_vacancy"))
    rate = F.when(X.nonzero(F.col("vacancy_rate")).isNull() & text.isNotNull(), parse_numeric(text, True)).otherwise(F.col("vacancy_rate"))
    return own.join(found, "doc_id", "full").select("doc_id", rate.alias("vacancy_rate"), "delivered_pct_of_inventory", "construction_pct_of_inventory")


def property_scores(sections: DataFrame) -> DataFrame:
    """(doc_id, walk_score, transit_score) of the subject section: its tables first, then its prose."""
    cells = table_cells(section_tables(sections, PROPERTY))
    found = table_lookups(cells, {"_walk": ("Walk Score", None), "_transit": ("Transit Score", None)})
    prose = X.property_metrics(X.joined_prose(section_texts(sections, PROPERTY)).withColumnRenamed("_text", "text"))
    both = found.join(prose, "doc_id", "full")
    pick = lambda own, told: F.coalesce(X.nonzero(parse_numeric(F.col(own))), F.col(told).cast("double"), parse_numeric(F.col(own))).alias(told)
    return both.select("doc_id", pick("_walk", "walk_score"), pick("_transit", "transit_score"))


def section_records(sections: DataFrame, years: Sequence[str] = ("2024",)) -> DataFrame:
    """(base, demographics, submarket, property, external, unreadable): a scorecard record of every base.

    ``sections`` (base, section, document, status) may hold sections that could
    not be read, which count in ``unreadable`` and nowhere else; a base of which
    none could be read has null features. What a base lacks is null.
    """
    # read once for all groups of features, in parts of even size: documents grow as their tables become rows
    sections = stage(sections.select("base", "section", "document", "status").repartition("base"))
    good = sections.where(F.coalesce(F.col("status"), F.lit("success")) == "success")
    pack = lambda df, name: df.select(F.col("doc_id").alias("base"), F.struct(*[c for c in df.columns if c != "doc_id"]).alias(name))
    bases = sections.groupBy("base").agg(F.count_if(F.col("status") != "success").alias("unreadable"), F.count("*").alias("sections"))
    external = good.where("section = 'external'").groupBy("base").agg(F.first(F.struct("document.crime", "document.schools", "document.walkScore")).alias("external"))
    parts = [pack(demographics(good, years), "demographics"), pack(submarket(good), "submarket"), pack(property_scores(good), "property"), external]
    for part in parts:
        bases = bases.join(part, "base", "left")
    return bases


def rescore_sections(sections: DataFrame, card: Scorecard = DEFAULT_SCORECARD, years: Sequence[str] = ("2024",)) -> DataFrame:
    """(base, total_score, decision, color, coverage, unreadable, error) of every base, its features rebuilt from its sections.

    A base without a readable section has an error in place of a score.
    """
    scored = S.score(section_records(sections, years), card)
    lost = F.col("unreadable") == F.col("sections")
    out = [F.when(~lost, F.col(c)).alias(c) for c in ("total_score", "decision", "color", "coverage")]
    return scored.select("base", *out, "unreadable", F.when(lost, F.lit("no section could be read")).alias("error"))


def subject_items(sections: DataFrame) -> DataFrame:
    """(doc_id, kind, page_number, item_idx, text): what addresses are looked for in, from the subject section, else the combined one.

    Headers, text items, lines of the raw text and cells of tables, each in its order.
    """
    here = sections.where(F.col("section").isin("subject_property", "combined"))
    first = here.groupBy("base").agg(F.min_by("document", F.col("section") != "subject_property").alias("document"))
    doc = first.select(F.col("base").alias("doc_id"), "document")
    pages = doc.select("doc_id", F.posexplode("document.pages").alias("page_number", "p"))
    item = lambda df, kind, page, at, text: df.select("doc_id", F.lit(kind).alias("kind"), page.cast("int").alias("page_number"), at.cast("int").alias("item_idx"), text.alias("text"))
    headers = pages.select("doc_id", "page_number", F.posexplode("p.headers").alias("at", "x"))
    texts = pages.select("doc_id", "page_number", F.posexplode("p.text_items").alias("at", "x"))
    raw = doc.select("doc_id", F.posexplode(F.split("document.raw_text", "\n")).alias("at", "x"))
    cells = table_cells(section_tables(sections, ["subject_property", "combined"]).where(F.col("rows").isNotNull())).where("form = 1")
    zero, c = F.lit(0), F.col
    parts = [item(headers, "header", c("page_number"), c("at"), c("x.text")), item(texts, "text", c("page_number"), c("at"), c("x.text")), item(raw, "raw", zero, c("at"), c("x")), item(cells, "cell", c("src_ord") * 100_000 + c("table_index"), c("row_idx") * 1000 + c("col_idx"), c("value"))]
    return reduce(DataFrame.unionByName, parts).where(F.col("text").isNotNull())


def build_portfolio(sections: DataFrame, files: DataFrame, props: DataFrame, documents: DataFrame, extracted: DataFrame, card: Scorecard = DEFAULT_SCORECARD) -> dict[str, DataFrame]:
    """From section documents to linked and scored properties; what is to be put into each table, and what became of each base.

    ``sections`` (base, section, document, status) of which some may be
    unreadable; ``files`` (file_name, storage_path) are the sources that bases
    may be from; ``props``, ``documents`` (id, property_id, storage_path,
    file_name) and ``extracted`` (property_id, section) are there already.

    ``bases`` (base, property_id, created, status, reason): a base without
    property data, or without a readable section, is left out and says why.
    ``documents``, ``extracted``: links that aren't there yet; of the bases of
    one property the least one links a section. ``scores``: one for each
    property, that of its greatest base.
    """
    sections = stage(sections.select("base", "section", "document", "status"))
    good = sections.where("status = 'success'")
    kept = has_property_data(good)
    known = kept.select("base").distinct()
    unread = sections.groupBy("base").agg(F.count_if(F.col("status") == "success").alias("_good"))
    found = known.join(X.extract_address(subject_items(kept)).select(F.col("doc_id").alias("base"), "street", "city", "state_abbr"), "base", "left")
    matched = stage(upsert_properties(found.withColumnRenamed("base", "incoming_id"), props).withColumnRenamed("incoming_id", "base"))
    reason = F.when(F.col("property_id").isNotNull(), None).when(F.col("_good") == 0, "no section could be read").otherwise("no property data")
    bases = unread.join(matched, "base", "left").select("base", "property_id", F.coalesce("created", F.lit(False)).alias("created"), F.when(reason.isNull(), "processed").otherwise("skipped").alias("status"), reason.alias("reason"))
    source = match_source_document(matched.select("base"), files).where("file_name is not null").join(files, "file_name").join(matched, "base")
    links = link_documents(source.select(F.col("base").alias("id"), "property_id", "storage_path", "file_name"), documents)
    sectioned = kept.join(matched, "base").groupBy("property_id", "section").agg(F.min("base").alias("base"))
    scored = rescore_sections(kept, card).where("error is null").join(matched, "base")
    scores = scored.groupBy("property_id").agg(F.max_by(F.struct("total_score", "decision", "color"), "base").alias("s")).select("property_id", "s.*")
    return {"bases": bases, "documents": links.withColumnRenamed("id", "base"), "extracted": link_new(sectioned, extracted, ["property_id", "section"]), "scores": scores}


def rescore_report(scored: DataFrame) -> DataFrame:
    """(rescored, errors, unreadable): how many bases were scored and not, and sections that could not be read."""
    return scored.agg(F.count_if(F.col("error").isNull()).alias("rescored"), F.count("error").alias("errors"), F.coalesce(F.sum("unreadable"), F.lit(0)).alias("unreadable"))
