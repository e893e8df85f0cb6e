"""Text lines: segmentation by headers, key-value pairs, tables in plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How plain-text headers, tables and list items look.
TABLE_LIKE = r"\S {2,}\S.* {2,}\S"
LIST_ITEM = r"^[•\-*]\s+"
KEY_VALUE = r"^([^:]{1,60}):\s*(.*)$"
ORPHAN_COUNT = r"^\d+\s*Units?\z"
#: Keys meet lines by so many of their first letters.
KEY_START = 4
METRIC_ORDER = ["Current", "Last Quarter", "Year Ago", "Competitors", "Submarket"]


def text_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_idx, line)."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("line_idx", "line"))


def _ordered() -> Window:
    return Window.partitionBy("doc_id").orderBy("line_idx")


def segment_lines(lines: DataFrame, is_header: Column) -> DataFrame:
    """(doc_id, segment, line_idx, line, is_header): a header opens a segment; lines before the first are dropped.

    Windows are by document; a document is what one task holds.
    """
    segment = F.sum(is_header.cast("int")).over(_ordered().rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    return lines.withColumns({"is_header": is_header, "segment": segment}).where("segment > 0")


def segment_text(lines: DataFrame, is_header: Column) -> DataFrame:
    """(doc_id, segment, title, n_lines, body) of each segment."""
    own = segment_lines(lines, is_header)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_header"), F.struct("line_idx", "line")))), lambda x: x["line"]), "\n")
    return own.groupBy("doc_id", "segment").agg(F.max(F.when(F.col("is_header"), F.col("line"))).alias("title"), F.count_if(~F.col("is_header")).alias("n_lines"), body.alias("body"))


def nest_sections(sections: DataFrame, is_main: Column) -> DataFrame:
    """Sections (doc_id, segment, ...) with the main section that they belong to; null before the first."""
    before = Window.partitionBy("doc_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    return sections.withColumn("main", F.last(F.when(is_main, F.col("segment")), ignorenulls=True).over(before))


def drop_orphan_counts(lines: DataFrame) -> DataFrame:
    """Lines without lone unit counts and the line after each."""
    orphan = F.col("line").rlike(ORPHAN_COUNT)
    return lines.withColumn("_skip", orphan | F.coalesce(F.lag(orphan).over(_ordered()), F.lit(False))).where("not _skip").drop("_skip")


def looks_like_table(c: Column) -> Column:
    return c.rlike(TABLE_LIKE) | F.contains(c, F.lit(" | "))


# Words that mark section headers, sections of tables and of keys, and rows of table headers.
SECTION_WORDS = ["PROPERTY", "OWNER", "VACANCY", "ASKING RENTS", "ABSORPTION", "OCCUPANCY", "LEASE EXPIRY", "UNIT MIX"]
TABLE_SECTIONS = ["UNIT MIX", "RENT ROLL", "LEASE EXPIRY", "MARKET SURVEY", "ASKING RENTS"]
KEY_SECTIONS = ["PROPERTY", "OWNER", "VACANCY", "ABSORPTION", "OCCUPANCY"]
TABLE_HEADER_WORDS = r"(?i)(?:TYPE|SIZE|UNITS?|RENT|DATE|TOTAL)"


def _names(c: Column, words: list[str]) -> Column:
    return c.rlike("|".join(words))


def is_section_header(c: Column) -> Column:
    """A line in capitals, a numbered or a named section, or one with a known section's word."""
    return c.rlike(r"^[A-Z][A-Z\s]{3,}\z") | c.rlike(r"^(?:\d+\.)*\d+\s+[A-Z]") | c.rlike(r"(?i)^(?:SECTION|PART|CHAPTER)\s+\w+") | _names(F.upper(c), SECTION_WORDS)


def is_table_header(c: Column) -> Column:
    """A line of columns that doesn't begin with a digit and has a word of table headers."""
    return c.rlike(r"\s{2,}") & ~c.rlike(r"^\s*\d") & c.rlike(TABLE_HEADER_WORDS)


def is_table_end(c: Column) -> Column:
    """A blank line, a section header or a rule."""
    return (F.trim(c) == "") | is_section_header(F.trim(c)) | F.trim(c).rlike(r"^[\-=]{3,}\z")


def section_kind(header: Column) -> Column:
    """table, key_value or text, by the words of a section's header."""
    return F.when(_names(F.upper(header), TABLE_SECTIONS), "table").when(_names(F.upper(header), KEY_SECTIONS), "key_value").otherwise("text")


def line_kind(c: Column) -> Column:
    """table, list_item, key_value, blank or text."""
    return F.when(F.trim(c) == "", "blank").when(looks_like_table(c), "table").when(c.rlike(LIST_ITEM), "list_item").when(c.rlike(KEY_VALUE), "key_value").otherwise("text")


def key_values(lines: DataFrame, last_wins: bool = False) -> DataFrame:
    """(doc_id, key, value): the first value of each key, or the last."""
    found = lines.where(F.col("line").rlike(KEY_VALUE)).select("doc_id", "line_idx", F.trim(F.regexp_extract("line", KEY_VALUE, 1)).alias("key"), F.trim(F.regexp_extract("line", KEY_VALUE, 2)).alias("value"))
    return found.groupBy("doc_id", "key").agg((F.max_by if last_wins else F.min_by)("value", "line_idx").alias("value"))


def related_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, key, line_idx, related): each line without a colon under the first key above it that it mentions, in any case.

    Keys are what stands before a line's first colon, in order of their first
    line. Blank lines and lines that mention no key have no row.

    Lines and keys meet by the key's first letters, which a line that mentions
    it has somewhere, so rows grow with what lines and keys have in common.
    """
    named = F.contains("line", F.lit(":"))
    lower = F.lower("key")
    keys = lines.where(named).groupBy("doc_id", F.trim(F.substring_index("line", ":", 1)).alias("key")).agg(F.min("line_idx").alias("key_at"))
    keys = keys.withColumns({"size": F.least(F.length("key"), F.lit(KEY_START)), "start": F.left(lower, F.lit(KEY_START))})
    sizes = keys.groupBy("doc_id").agg(F.collect_set("size").alias("sizes"))  # of a document no more than KEY_START + 1
    plain = lines.where(~named & (F.trim("line") != "")).withColumn("low", F.lower("line"))
    starts = F.flatten(F.transform("sizes", lambda n: F.when(n == 0, F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length("low") - n + 1, F.lit(1))), lambda i: F.substring(F.col("low"), i, n)))))
    parts = plain.join(sizes, "doc_id").select("doc_id", "line_idx", "line", "low", F.explode(F.array_distinct(starts)).alias("start"))
    met = parts.join(keys, ["doc_id", "start"]).where((F.col("key_at") < F.col("line_idx")) & F.contains("low", lower))
    return met.groupBy("doc_id", "line_idx").agg(F.min_by("key", "key_at").alias("key"), F.trim(F.first("line")).alias("related"))


def subsection_counts(nested: DataFrame) -> DataFrame:
    """(doc_id, main, subsections): how many sections each main section of ``nest_sections`` holds beside itself."""
    return nested.where("main is not null").groupBy("doc_id", "main").agg(F.count_if(F.col("segment") != F.col("main")).alias("subsections"))


def section_summary(lines: DataFrame) -> DataFrame:
    """(doc_id, total_lines, tables, list_items, key_values): line kinds counted."""
    kind = line_kind(F.col("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("total_lines"), *(F.count_if(kind == k).alias(n) for k, n in (("table", "tables"), ("list_item", "list_items"), ("key_value", "key_values"))))


def segment_tables(lines: DataFrame, is_header: Column, is_end: Column) -> DataFrame:
    """(doc_id, block, line_idx, line): a header opens a block, which ends before the first line that ends a table."""
    upto = _ordered().rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumns({"block": F.sum(is_header.cast("int")).over(upto).cast("int"), "_end": is_end & ~is_header})
    inside = Window.partitionBy("doc_id", "block").orderBy("line_idx").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("_ended", F.max("_end").over(inside)).where("block > 0 and not _ended").drop("_end", "_ended")


def split_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, page_number, text): pages end at a form feed or at three line feeds or more."""
    pages = F.filter(F.split(text_col, "\f|\n{3,}"), lambda p: F.trim(p) != "")
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(pages).alias("page_idx", "page_text")).select("doc_id", (F.col("page_idx") + 1).alias("page_number"), F.col("page_text").alias("text"))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def page_stats(pages: DataFrame) -> DataFrame:
    """(doc_id, pages, words, longest_page)."""
    n = word_count(F.col("text"))
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(n).alias("words"), F.max(n).alias("longest_page"))


def order_metric_keys(df: DataFrame, key: str = "metric") -> DataFrame:
    """``df`` with metric_ord: known metrics first, in their fixed order."""
    at = F.array_position(F.array(*map(F.lit, METRIC_ORDER)), F.col(key))
    return df.withColumn("metric_ord", F.when(at > 0, at).otherwise(len(METRIC_ORDER) + 1).cast("int"))


def clean_outside_tables(lines: DataFrame, tables: DataFrame, clean) -> DataFrame:
    """Lines outside of ``tables`` (doc_id, first_line, last_line) cleaned, those inside as they are."""
    inside = lines.alias("l").join(tables.alias("t"), (F.col("l.doc_id") == F.col("t.doc_id")) & F.col("line_idx").between(F.col("first_line"), F.col("last_line")), "left")
    return inside.select("l.doc_id", "line_idx", F.when(F.col("first_line").isNull(), clean(F.col("line"))).otherwise(F.col("line")).alias("line"))


def describe_columns(rows: DataFrame) -> DataFrame:
    """(doc_id, table_idx, col_idx, header, column_type) of fixed-width tables, from their lines (doc_id, table_idx, line_idx, line).

    The first line's cells, each of which begins the line or follows two spaces,
    are the headers, and their places cut up all other lines. A type is that of
    all cells below a header that aren't blank. Tables of one line have none.
    """
    table = ["doc_id", "table_idx"]
    head = rows.groupBy(*table).agg(F.min_by("line", "line_idx").alias("_head"), F.min("line_idx").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    starts = F.array_compact(F.transform(F.split("_head", ""), lambda c, i: F.when((c != " ") & ((i == 0) | (F.substring("_head", i - 1, F.lit(2)) == "  ")), i)))
    placed = rows.join(head.withColumn("_starts", starts), table).select(*table, "line_idx", "line", "_first", "_starts", F.posexplode("_starts").alias("col_idx", "_from"))
    upto = F.coalesce(F.get("_starts", F.col("col_idx") + 1), F.length("line"))
    cells = placed.withColumn("value", F.trim(F.substring("line", F.col("_from") + 1, F.greatest(upto - F.col("_from"), F.lit(0)))))
    v = F.col("value")
    below = (F.col("line_idx") > F.col("_first")) & (v != "")
    every = lambda test: F.bool_and(F.when(below, test))
    kind = (
        F.when(F.count_if(below) == 0, "empty")
        .when(every(F.replace(v, F.lit(","), F.lit("")).rlike(r"^-?\d+(?:\.\d+)?\z")), "numeric")
        .when(every(v.rlike(r"^\$[\d,.]+\z")), "currency")
        .when(every(v.rlike(r"^\d+(?:\.\d+)?%\z")), "percentage")
        .otherwise("text")
    )
    return cells.groupBy(*table, "col_idx").agg(F.min_by("value", "line_idx").alias("header"), kind.alias("column_type"))


def detect_tables(lines: DataFrame, least_rows: int = 3, near: int = 1) -> DataFrame:
    """(doc_id, table_idx, first_line, last_line, n_rows, positions) of fixed-width tables in plain text.

    Consecutive table-like lines form a table if at least ``least_rows`` follow
    one another. Column positions are carried along the rows: each row's starts
    within ``near`` of a running position move it, old weighing 2 to 1. That
    recurrence is a fold over the rows of one run, the only rows that are
    gathered; a document's lines are only put in order.
    """
    starts = F.array_compact(F.transform(F.split("line", ""), lambda c, i: F.when((c != " ") & ((i == 0) | (F.substring("line", i - 1, F.lit(2)) == "  ")), i.cast("double"))))
    table_like = lines.where(looks_like_table(F.col("line"))).select("doc_id", "line_idx", starts.alias("starts"))
    runs = table_like.withColumn("run", F.col("line_idx") - F.row_number().over(_ordered()))
    none = F.array().cast("array<double>")

    def moved(at: Column, start: Column) -> Column:
        found = F.array_position(F.transform(at, lambda p: F.abs(p - start) <= near), True)
        return F.when(found == 0, F.concat(at, F.array(start))).otherwise(F.transform(at, lambda p, i: F.when(i + 1 == found, (2 * p + start) / 3).otherwise(p)))

    rows = F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "starts"))), lambda r: r["starts"])
    tables = runs.groupBy("doc_id", "run").agg(F.min("line_idx").cast("int").alias("first_line"), F.max("line_idx").cast("int").alias("last_line"), F.count("*").cast("int").alias("n_rows"), rows.alias("rows")).where(F.col("n_rows") >= least_rows)
    positions = F.array_sort(F.aggregate("rows", none, lambda at, row: F.aggregate(row, at, moved)))
    index = (F.row_number().over(Window.partitionBy("doc_id").orderBy("first_line")) - 1).cast("int")
    return tables.withColumns({"positions": positions, "table_idx": index}).select("doc_id", "table_idx", "first_line", "last_line", "n_rows", "positions")
