"""The structure of captured pages by built-in functions: elements by nesting, table cells, attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrelight.functions.values import blank_to_null, extracted

#: Comments, scripts and styles as a whole, tags, and text between tags.
TOKEN = r"(?is)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)>|<[^<>]+>|[^<]+|<"
#: Elements that have no end.
VOID = "area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr"


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a tag, in double or single quotes; null without one."""
    return F.coalesce(extracted(tag, rf'(?is)\s{name}\s*=\s*"([^"]*)"'), extracted(tag, rf"(?is)\s{name}\s*=\s*'([^']*)'"))


def text_of(html: Column) -> Column:
    """The text of a piece of HTML: no comments, scripts, styles or tags, single spaces."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"\s+", " "))


def table_rows(html: Column) -> Column:
    """The rows of all tables of a page, in order, each an array of its cells' texts."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=</tr>|<tr\b|</table>|\z)"), F.lit(1))
    cells = lambda row: F.regexp_extract_all(row, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)(?=</t[dh]>|<t[dh]\b|\z)"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(cells(r), text_of))


def named(*parts: str, attributes: str = "class") -> str:
    """A pattern that every page has in which one of ``attributes``, parted by '|', contains one of ``parts``."""
    return rf"""\s(?i:{attributes})\s*=\s*(?:"[^"]*|'[^']*)(?:{"|".join(parts)})"""


def once(df: DataFrame, *columns: Column | str) -> DataFrame:
    """As ``select``; later filters and selections don't work out ``columns`` again."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def elements(pages: DataFrame, wanted, mark: str | None = None) -> DataFrame:
    """(page_id, at, last, tag, inner): the elements whose opening tag is ``wanted``, a function of the tag, with their inner HTML.

    ``at`` and ``last`` are the places of their tags among the page's pieces, so
    one element is in another if its places are between the other's. Nesting is
    counted among elements of one name, so one that was left open spoils no
    others; it reaches to the end of the page. Windows are by page and name, so
    one task holds a page, not a site. Pages without such elements have no row.
    Only pages with ``mark``, a pattern that no page with a wanted tag lacks, are
    taken apart.
    """
    if mark is not None:
        pages = pages.where(F.col("html").rlike(mark))
    pieces = pages.select("page_id", F.regexp_extract_all("html", F.lit(TOKEN), F.lit(0)).alias("pieces"))
    tags = pieces.where(F.exists("pieces", lambda p: p.startswith("<") & wanted(p))).select("page_id", F.posexplode("pieces").alias("at", "tag"))
    named = tags.withColumn("name", F.lower(F.regexp_extract("tag", r"^</?([A-Za-z][A-Za-z0-9]*)", 1))).where(~F.col("name").rlike(rf"^(?:{VOID})?\z") & F.col("tag").rlike(r"^<[^<>]*>\z") & ~F.col("tag").rlike(r"/>\z"))
    ends = F.startswith("tag", F.lit("</"))
    upto = Window.partitionBy("page_id", "name").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    level = F.sum(F.when(ends, -1).otherwise(1)).over(upto) + F.when(ends, 1).otherwise(0)
    after = Window.partitionBy("page_id", "name", "level").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    ended = F.first(F.when(ends, F.col("at")), ignorenulls=True).over(after)
    found = named.withColumn("level", level).withColumn("last", ended).where(~ends & wanted(F.col("tag"))).select("page_id", "at", "last", "tag")
    whole = found.join(pieces, "page_id")
    last = F.coalesce("last", F.size("pieces"))
    return whole.select("page_id", "at", last.alias("last"), "tag", F.array_join(F.slice("pieces", F.col("at") + 2, F.greatest(last - F.col("at") - 1, F.lit(0))), "").alias("inner"))


def class_has(tag: Column, *parts: str) -> Column:
    """Whether a tag's class contains one of ``parts``."""
    names = F.coalesce(attribute(tag, "class"), F.lit(""))
    out = F.lit(False)
    for part in parts:
        out = out | F.contains(names, F.lit(part))
    return out


def class_is(tag: Column, name: str) -> Column:
    """Whether ``name`` is one of a tag's classes."""
    return F.array_contains(F.split(F.coalesce(attribute(tag, "class"), F.lit("")), r"\s+"), name)


def first_text(html: Column, *patterns: str) -> Column:
    """The text of the first element that any of ``patterns``, in order, finds; each has the element's inner HTML as its group."""
    return F.coalesce(*(blank_to_null(text_of(extracted(html, p))) for p in patterns))
