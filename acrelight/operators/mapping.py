"""Field mappings: from structured documents to cell values, with coverage."""

from __future__ import annotations

from dataclasses import dataclass

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrelight.functions.values import apply_transform
from acrelight.operators.tables import drop_total_rows


@dataclass(frozen=True)
class FieldMapping:
    """A target cell and the JSON path of its value; without a path it is filled from elsewhere."""

    sheet: str
    cell: str
    label: str
    json_path: str | None = None
    fallback_path: str | None = None
    transform: str | None = None
    fallback_transform: str | None = None
    source: str = "pdf_extract"


def json_path(document: Column, path: str) -> Column:
    """The value at a dotted path with [i] indices; a key that holds the whole dotted path goes first, out of range is null."""
    literal = F.get_json_object(document, f"$['{path}']")
    return F.coalesce(literal, F.get_json_object(document, f"$.{path}")) if "." in path else literal if "[" not in path else F.get_json_object(document, f"$.{path}")


def resolve_mappings(docs: DataFrame, mappings: list[FieldMapping], as_of: Column, json_col: str = "json") -> DataFrame:
    """(doc_id, sheet, cell, label, status, value): an outcome for each document and mapping.

    Mappings are configuration: each becomes an expression, so all are resolved
    in the one pass that reads the documents.
    """

    def outcome(m: FieldMapping) -> Column:
        if m.source == "external" or m.json_path is None:
            status, value = F.lit("external"), F.lit(None).cast("string")
        else:
            value = json_path(F.col(json_col), m.json_path)
            if m.fallback_path:
                other = json_path(F.col(json_col), m.fallback_path)
                value = F.coalesce(value, apply_transform(m.fallback_transform, other, as_of))
            status = F.when(value.isNull(), "skipped").otherwise("filled")
            value = apply_transform(m.transform, value, as_of)
        return F.struct(F.lit(m.sheet).alias("sheet"), F.lit(m.cell).alias("cell"), F.lit(m.label).alias("label"), status.alias("status"), value.alias("value"))

    return docs.select("doc_id", F.inline(F.array(*map(outcome, mappings))))


def mapping_report(outcomes: DataFrame) -> DataFrame:
    """(sheet, status, n), with a null sheet for all sheets."""
    return outcomes.groupingSets([["sheet", "status"], ["status"]], "sheet", "status").agg(F.count("*").alias("n"))


def coverage(outcomes: DataFrame, *by: str) -> DataFrame:
    """(sheet or ``by``, filled, total, share) of the mapped fields."""
    filled = F.count_if(F.col("status") == "filled")
    return outcomes.groupBy(*(by or ("sheet",))).agg(filled.alias("filled"), F.count("*").alias("total"), (F.floor(filled * 10000 / F.count("*") + 0.5) / 10000).alias("share"))


def with_source(outcomes: DataFrame, mappings: Sequence[FieldMapping]) -> DataFrame:
    """``outcomes`` with the kind of source of their field."""
    known = F.create_map(*(F.lit(x) for m in mappings for x in (f"{m.sheet}!{m.cell}", m.source)))
    return outcomes.withColumn("source", F.try_element_at(known, F.concat_ws("!", "sheet", "cell")))


def resolve_array_mapping(units: DataFrame, first_row: int, columns: dict[str, str], order: str) -> DataFrame:
    """(property_id, row, column, value): a cell for each unit row and column.

    Rows count from ``first_row`` in ``order``; summary rows leave their row
    number unused. ``columns`` names a source column, or the derived bed_bath_label
    and occupied, for each target column.
    """
    placed = units.withColumn("row", (F.row_number().over(Window.partitionBy("property_id").orderBy(order)) - 1 + first_row).cast("int"))
    derived = {"bed_bath_label": F.concat("bed", F.lit("B/"), F.col("bath").cast("string"), F.lit("Ba")), "occupied": (F.col("units") - F.col("available")).cast("string")}
    value = lambda source: derived.get(source, F.col(source).cast("string") if source not in derived else None)
    cells = [F.struct(F.lit(target).alias("column"), value(source).alias("value")) for target, source in columns.items()]
    return drop_total_rows(placed).select("property_id", "row", F.inline(F.array(*cells)))
