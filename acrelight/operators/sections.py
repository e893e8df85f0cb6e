"""Report pages: items to pages, section detection, sticky fill, assembly."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrelight import dims

TEXT_ITEMS = 5


def items_to_pages(items: DataFrame) -> DataFrame:
    """(doc_id, page_number, headers, text_items, table_count) from items (doc_id, page_number, item_idx, kind, text)."""
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("item_idx", "text")))), lambda x: x["text"])
    page = F.coalesce("page_number", F.lit(1)).alias("page_number")
    return items.groupBy("doc_id", page).agg(of("header").alias("headers"), of("text").alias("text_items"), F.count_if(F.col("kind") == "table").alias("table_count"))


def clean_pages(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page_number", F.size("text_items").alias("n_text"), F.size("headers").alias("n_headers"), "table_count")


def first_pages(pages: DataFrame, n: int = 7) -> DataFrame:
    return pages.where(F.col("page_number") <= n)


def section_of(text: Column, patterns: Mapping[str, list[str]] = dims.SECTION_PATTERNS) -> Column:
    """The first section one of whose patterns is in the upper-cased text, null without one."""
    upper = F.upper(text)
    tests = [(slug, reduce(lambda a, b: a | b, (F.contains(upper, F.lit(p)) for p in found))) for slug, found in patterns.items()]
    return reduce(lambda c, t: c.when(t[1], t[0]), tests[1:], F.when(tests[0][1], tests[0][0]))


def detect_sections(items: DataFrame, patterns: Mapping[str, list[str]] = dims.SECTION_PATTERNS) -> DataFrame:
    """(doc_id, page_number, detected): a page's first header with a section, else one of its first text items."""
    rank = F.row_number().over(Window.partitionBy("doc_id", "page_number", "kind").orderBy("item_idx"))
    near = items.where("kind in ('header', 'text')").withColumn("_rank", rank).where((F.col("kind") == "header") | (F.col("_rank") <= TEXT_ITEMS))
    found = near.withColumn("slug", section_of(F.col("text"), patterns))
    order = F.when(F.col("slug").isNotNull(), F.struct((F.col("kind") != "header").cast("int"), "item_idx"))
    return found.groupBy("doc_id", "page_number").agg(F.min_by("slug", order).alias("detected"))


def sticky_fill(pages: DataFrame, by: str = "doc_id", order: str = "page_number", column: str = "detected", default: str = "unknown") -> DataFrame:
    """``pages`` with section: the last value of ``column`` up to each row."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn("section", F.coalesce(F.last(column, ignorenulls=True).over(before), F.lit(default)))


def assemble_sections(pages: DataFrame, texts: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """(doc_id, section, first_page, last_page, n_pages, n_tables, raw_text) from pages with a section and texts (doc_id, page_number, text)."""
    own = pages.select("doc_id", "page_number", "section").join(texts.select("doc_id", "page_number", "text"), ["doc_id", "page_number"], "left")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda x: x["text"]), "\n")
    out = own.groupBy("doc_id", "section").agg(F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"), F.countDistinct("page_number").alias("n_pages"), body.alias("raw_text"))
    if tables is None:
        return out.withColumn("n_tables", F.lit(0).cast("long"))
    placed = tables.join(pages.select("doc_id", "page_number", "section"), ["doc_id", "page_number"], "left").withColumn("section", F.coalesce("section", F.lit("unknown")))
    counts = placed.groupBy("doc_id", "section").agg(F.count("*").alias("n_tables"))
    return out.join(counts, ["doc_id", "section"], "full").withColumn("n_tables", F.coalesce("n_tables", F.lit(0)))


def section_documents(pages: DataFrame, texts: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, section, first_page, last_page, pages, tables, raw_text): sections with their pages and tables, not only counts.

    ``pages`` have a section, ``texts`` (doc_id, page_number, text), ``tables``
    (doc_id, page_number, table_index, ...). A table on a page that isn't there
    is in the section 'unknown'. One row gathers one section of one document.
    """
    placed = pages.select("doc_id", "page_number", "section")
    own = placed.join(texts.select("doc_id", "page_number", "text"), ["doc_id", "page_number"], "left")
    gathered = F.array_sort(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("text"))))
    out = own.groupBy("doc_id", "section").agg(F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"), gathered.alias("pages"))
    rest = [c for c in tables.columns if c not in ("doc_id", "page_number", "table_index")]
    listed = tables.join(placed, ["doc_id", "page_number"], "left").withColumn("section", F.coalesce("section", F.lit("unknown"))).groupBy("doc_id", "section").agg(F.array_sort(F.collect_list(F.struct("table_index", "page_number", *rest))).alias("tables"))
    both = out.join(listed, ["doc_id", "section"], "full")
    empty = lambda c: F.coalesce(c, F.array().cast(both.schema[c].dataType)).alias(c)
    body = F.array_join(F.transform(F.col("pages"), lambda p: p["text"]), "\n")
    return both.select("doc_id", "section", "first_page", "last_page", empty("pages"), empty("tables"), F.coalesce(body, F.lit("")).alias("raw_text"))


def section_inventory(pages: DataFrame) -> DataFrame:
    """(section, documents, pages, first_page, last_page)."""
    return pages.groupBy("section").agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("pages"), F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"))


def bundle_sections(sections: DataFrame) -> DataFrame:
    """(base, documents): each base's section contents in a map, from (base, section, content)."""
    return sections.groupBy("base").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("section", "content")))).alias("documents"))


def has_property_data(sections: DataFrame) -> DataFrame:
    """Rows of bases that have data beside external pages."""
    bases = sections.where(F.col("section").isin("subject_property", "demographics", "construction", "combined")).select("base").distinct()
    return sections.join(bases, "base", "left_semi")


def with_subject(sections: DataFrame) -> DataFrame:
    return sections.join(sections.where("section = 'subject_property'").select("base").distinct(), "base", "left_semi")
