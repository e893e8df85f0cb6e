"""Deleting, restoring and purging properties, as snapshots in and snapshots out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrelight.functions.values import address_key

#: Tables whose rows follow their property; scores stay when it is only marked as deleted.
MARKED = ("properties", "documents", "extracted_files", "generated_files")
KEEP_DAYS = 30


def _mark(tables: Mapping[str, DataFrame], ids: DataFrame, deleted: bool, at: Column, now: Column) -> dict[str, DataFrame]:
    chosen = ids.select("property_id").distinct().withColumn("_hit", F.lit(True))
    out = dict(tables)
    for name in MARKED:
        if name in tables:
            df = tables[name].join(chosen, "property_id", "left")
            applies = F.col("_hit") & (F.col("deleted_at").isNull() if deleted else F.col("deleted_at").isNotNull())
            set_to = {"deleted_at": F.when(applies, at).otherwise(F.col("deleted_at"))}
            if "updated_at" in df.columns:
                set_to["updated_at"] = F.when(applies, now).otherwise(F.col("updated_at"))
            out[name] = df.withColumns(set_to).select(*tables[name].columns)
    return out


def soft_delete(tables: Mapping[str, DataFrame], ids: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Mark live rows of the properties in ``ids`` as deleted at ``now``; earlier deletions keep their time."""
    return _mark(tables, ids, True, now, now)


def restore(tables: Mapping[str, DataFrame], ids: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Take the mark back."""
    return _mark(tables, ids, False, F.lit(None), now)


def purge(tables: Mapping[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without rows of the properties in ``ids``."""
    return {name: df.join(ids.select("property_id").distinct(), "property_id", "left_anti") for name, df in tables.items()}


def expired(props: DataFrame, now: Column, days: int = KEEP_DAYS) -> DataFrame:
    """Properties deleted more than ``days`` before ``now``, oldest first."""
    return props.where(F.col("deleted_at") < now - F.make_interval(days=F.lit(days))).orderBy("deleted_at", "property_id")


def retention_purge(tables: Mapping[str, DataFrame], now: Column, days: int = KEEP_DAYS) -> dict[str, DataFrame]:
    return purge(tables, expired(tables["properties"], now, days))


def deletion_countdown(props: DataFrame, now: Column, days: int = KEEP_DAYS) -> DataFrame:
    """Deleted properties with the time of their purge and the whole days until then, at least 0."""
    purge_at = F.col("deleted_at").cast("timestamp_ntz") + F.make_interval(days=F.lit(days))
    left = (F.unix_seconds(purge_at.cast("timestamp")) - F.unix_seconds(now.cast("timestamp"))) / F.lit(86400.0)
    return props.where("deleted_at is not null").withColumns({"permanent_delete_at": purge_at, "days_remaining": F.greatest(F.lit(0), F.ceil(left)).cast("int")})


PATCHED = ("name", "street", "city", "state_abbr")


def patch(props: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """``props`` with the non-null fields of ``updates`` by property_id, and a new address key where an address part changed."""
    fields = [c for c in PATCHED if c in updates.columns]
    new = updates.select("property_id", *(F.col(c).alias(f"_{c}") for c in fields), F.lit(True).alias("_hit"))
    joined = props.join(new, "property_id", "left")
    moved = F.col("_hit") & F.coalesce(*(F.col(f"_{c}") for c in fields if c != "name")).isNotNull()
    fresh = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in fields}
    part = lambda c: fresh.get(c, F.col(c))
    key = F.when(moved, address_key(part("street"), part("city"), part("state_abbr"))).otherwise(F.col("address_key"))
    return joined.withColumns({**fresh, "address_key": key, "updated_at": F.when(F.col("_hit"), now).otherwise(F.col("updated_at"))}).select(*props.columns)
