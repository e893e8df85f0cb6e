"""Portfolio views: filters, joins, roll-ups and ranking of scored properties."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrelight import dims
from acrelight.functions.values import address_key, half_up
from acrelight.sources.shared import stage


def live(df: DataFrame, mode: str = "active") -> DataFrame:
    """Rows that aren't deleted; 'all' keeps both, 'deleted' only the deleted ones."""
    gone = F.col("deleted_at").isNotNull()
    return {"active": df.where(~gone), "all": df, "deleted": df.where(gone)}[mode]


def by_id(df: DataFrame, property_id: int, include_deleted: bool = False) -> DataFrame:
    return live(df, "all" if include_deleted else "active").where(F.col("property_id") == property_id)


def to_property_view(df: DataFrame) -> DataFrame:
    """Flat address columns as a struct; the score as a double."""
    return df.select("property_id", "name", F.struct("street", "city", "state_abbr").alias("address"), F.col("total_score").try_cast("double").alias("score"), "decision")


def with_scores(props: DataFrame, scores: DataFrame) -> DataFrame:
    return props.join(scores, "property_id", "left")


def with_region(df: DataFrame) -> DataFrame:
    """Region and state name by state, whatever its case; an unknown state has no region and is its own name."""
    states = dims.states(df.sparkSession).withColumnRenamed("state_abbr", "_abbr")
    joined = df.join(F.broadcast(states), F.upper("state_abbr") == F.col("_abbr"), "left").drop("_abbr")
    return joined.withColumn("state_name", F.coalesce("state_name", F.upper("state_abbr")))


def city_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"\s+", "_")


def drill_filter(df: DataFrame, region: str | None = None, state: str | None = None, city: str | None = None) -> DataFrame:
    """Rows of a region, state and city; a city by its name or its group key."""
    if region:
        df = df.where(F.col("region") == region.lower())
    if state:
        df = df.where(F.upper("state_abbr") == state.upper())
    if city:
        df = df.where(city_key(F.col("city")) == city_key(F.lit(city)))
    return df


def _counts() -> list[Column]:
    """Group counts: anything but the two better decisions, or none, counts as red."""
    green, yellow = F.coalesce(F.col("decision") == "Move Forward", F.lit(False)), F.coalesce(F.col("decision") == "Needs Review", F.lit(False))
    return [F.count_if(green).alias("green"), F.count_if(yellow).alias("yellow"), F.count_if(~green & ~yellow).alias("red"), F.count("*").alias("total")]


def rollup_region(df: DataFrame) -> DataFrame:
    return df.where("region is not null").groupBy("region", "region_name", "region_ord").agg(*_counts()).orderBy("region_ord")


def rollup_state(df: DataFrame) -> DataFrame:
    return df.where("state_abbr is not null").groupBy(F.upper("state_abbr").alias("state"), "state_name").agg(*_counts()).orderBy(F.desc("total"), "state")


def rollup_city(df: DataFrame) -> DataFrame:
    """Cities by key; the name is the newest row's."""
    newest = F.max_by("city", F.struct("created_at", "property_id")).alias("city")
    return df.where("city is not null").groupBy(city_key(F.col("city")).alias("city_key")).agg(newest, *_counts()).orderBy(F.desc("total"), "city_key")


def rollup_property(df: DataFrame) -> DataFrame:
    """A row for each property with 0/1 flags; only an outright rejection is red."""
    flag = lambda d: F.coalesce((F.col("decision") == d).cast("int"), F.lit(0))
    return df.select("property_id", "name", F.col("total_score").alias("score"), flag("Move Forward").alias("green"), flag("Needs Review").alias("yellow"), flag("Rejected").alias("red")).orderBy(F.coalesce("score", F.lit(0.0)).desc(), "property_id")


def drilldown_cube(df: DataFrame) -> DataFrame:
    """All levels of the drill-down at once: portfolio, region, state, city."""
    keyed = df.withColumns({"state": F.upper("state_abbr"), "city_key": city_key(F.col("city"))})
    levels = keyed.groupingSets([[], ["region"], ["region", "state"], ["region", "state", "city_key"]], "region", "state", "city_key")
    return levels.agg(F.grouping_id().cast("int").alias("level"), *_counts())


def breadcrumb(region: str | None = None, state: str | None = None, city: str | None = None) -> list[str]:
    """The labels of a drill-down path."""
    names = {key: name for key, name, _ in dims.REGIONS}
    path = ["All Regions"]
    if region:
        path.append(names.get(region.lower(), region))
    if state:
        path.append(dims.STATE_NAMES.get(state.upper(), state))
    return [*path, city] if city else path


def breadcrumb_path(region: Column, state: Column, city: Column) -> Column:
    """The labels of a drill-down path as a column: names of region and state, as given where unknown; a missing part ends nothing."""
    names = lambda pairs: F.create_map(*(F.lit(x) for pair in pairs for x in pair))
    known = lambda table, key, given: F.coalesce(F.try_element_at(names(table), key), given)
    given = lambda c: F.when(c != "", c)
    parts = [F.lit("All Regions"), known([(k, n) for k, n, _ in dims.REGIONS], F.lower(given(region)), given(region)), known(dims.STATE_NAMES.items(), F.upper(given(state)), given(state)), given(city)]
    return F.array_compact(F.array(*parts))


def filter_summary(df: DataFrame) -> DataFrame:
    """Counts of a selection; red counts outright rejections only."""
    return df.agg(F.count("*").alias("total"), *(F.count_if(F.col("decision") == d).alias(n) for n, d in (("green", "Move Forward"), ("yellow", "Needs Review"), ("red", "Rejected"))))


def portfolio_summary(df: DataFrame) -> DataFrame:
    """Live and deleted counts, decisions and mean score of live properties, in one pass."""
    here = F.col("deleted_at").isNull()
    decided = lambda d: F.count_if(here & (F.col("decision") == d))
    return df.agg(
        F.count_if(here).alias("active"),
        F.count_if(~here).alias("deleted"),
        decided("Move Forward").alias("move_forward"),
        decided("Needs Review").alias("needs_review"),
        decided("Rejected").alias("rejected"),
        half_up(F.avg(F.when(here, F.col("total_score"))), 4).alias("avg_score"),
    )


def score_summary(df: DataFrame, forward: float = 7.0, review: float = 5.5) -> DataFrame:
    """Counts by score, a missing one being 0, with mean, least and greatest; all zero without rows."""
    s = F.coalesce(F.col("total_score"), F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.agg(
        F.count("*").alias("n"),
        F.count_if(s >= forward).alias("move_forward"),
        F.count_if((s >= review) & (s < forward)).alias("needs_review"),
        F.count_if(s < review).alias("rejected"),
        zero(half_up(F.avg(s), 2)).alias("mean_score"),
        zero(F.min(s)).alias("min_score"),
        zero(F.max(s)).alias("max_score"),
    )


def score_list(df: DataFrame, forward: float = 7.0, review: float = 5.5) -> DataFrame:
    """(property_id, score, bucket): the scores that ``score_summary`` counts, one row each rather than one list."""
    s = F.coalesce(F.col("total_score"), F.lit(0.0))
    return df.select("property_id", s.alias("score"), F.when(s >= forward, "move_forward").when(s >= review, "needs_review").otherwise("rejected").alias("bucket"))


def rank_properties(df: DataFrame, n: int | None = None) -> DataFrame:
    """Ranked by score, then newest, then least id; with ``n`` only the first n, so no task sorts more than those."""
    order = [F.coalesce("total_score", F.lit(0.0)).desc(), F.desc("created_at"), F.asc("property_id")]
    if n is None:
        return numbered_rows(df, *order).withColumnRenamed("n", "rank")
    return df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def children(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """(property_id, name): each property's rows as a sorted array of structs."""
    return df.groupBy("property_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def with_related(props: DataFrame, **lists: DataFrame) -> DataFrame:
    """Properties with one array for each child table; children are aggregated first, so rows don't multiply."""
    for name, child in lists.items():
        props = props.join(children(child, name, *[c for c in child.columns if c != "property_id"]), "property_id", "left")
    return props


def first_file(files: DataFrame) -> DataFrame:
    """Each property's live file with the least id; files without deleted_at are all live."""
    files = live(files) if "deleted_at" in files.columns else files
    return files.groupBy("property_id").agg(F.min_by("path", "id").alias("path"))


def link_new(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose keys aren't there yet."""
    return incoming.join(existing, keys, "left_anti")


def link_documents(incoming: DataFrame, existing: DataFrame, owner: str = "property_id", names: tuple[str, str] = ("storage_path", "file_name"), order: str = "id") -> DataFrame:
    """Incoming rows that none of their owner's rows equals in either of two ``names``, as if put in one by one in ``order``.

    A missing name equals none. Against what exists, that is an equal anti join
    for each name. Among the incoming, a row whose names no earlier undecided
    one has is put in, which decides those that share a name with it; that is
    repeated until all are decided, in as many staged rounds as the longest
    chain of shared names has links. Rows of equal ``order`` go by both names;
    equal rows are put in once.
    """
    first, second = names
    rest = incoming.where(F.col(owner).isNotNull()).dropDuplicates([owner, *names, order])
    for name in names:
        rest = rest.join(existing.select(owner, name).where(F.col(name).isNotNull()).distinct(), [owner, name], "left_anti")
    rest, taken = stage(rest.select(*incoming.columns)), []
    while not rest.isEmpty():
        mine = F.struct(order, *(F.coalesce(F.col(n), F.lit("")) for n in names))
        leads = rest.withColumn("_mine", mine)
        for i, name in enumerate(names):
            least = leads.where(F.col(name).isNotNull()).groupBy(owner, name).agg(F.min("_mine").alias(f"_least{i}"))
            leads = leads.join(least, [owner, name], "left")
        now = stage(leads.where((F.coalesce(F.col("_least0"), F.col("_mine")) == F.col("_mine")) & (F.coalesce(F.col("_least1"), F.col("_mine")) == F.col("_mine"))).select(*incoming.columns))
        taken.append(now)
        rest = rest.join(now.select(owner, order, *(F.coalesce(F.col(n), F.lit("")).alias(f"_{n}") for n in names)), (rest[owner] == now[owner]) & (rest[order] == now[order]) & (F.coalesce(rest[first], F.lit("")) == F.col(f"_{first}")) & (F.coalesce(rest[second], F.lit("")) == F.col(f"_{second}")), "left_anti")
        for name in names:
            rest = rest.join(now.select(owner, name).where(F.col(name).isNotNull()).distinct(), [owner, name], "left_anti")
        rest = stage(rest.select(*incoming.columns))
    return reduce(DataFrame.unionByName, taken) if taken else rest


def changed(incoming: DataFrame, existing: DataFrame, keys: list[str], hash_col: str = "data_hash") -> DataFrame:
    """Incoming rows whose content differs from the row with the same keys."""
    old = existing.select(*keys, F.col(hash_col).alias("_old"))
    return incoming.join(old, keys).where(F.col(hash_col) != F.col("_old")).drop("_old")


def latest_per_key(df: DataFrame, key: str, *newest: str) -> DataFrame:
    """The newest row of each key; aggregates before it shuffles, so hot keys don't matter."""
    rest = [c for c in df.columns if c != key]
    row = F.max_by(F.struct(*rest), F.struct(*newest)).alias("_row")
    return df.groupBy(key).agg(row).select(key, "_row.*")


def with_address_key(df: DataFrame) -> DataFrame:
    return df.withColumn("address_key", address_key(F.col("street"), F.col("city"), F.col("state_abbr")))


def dedupe_addresses(df: DataFrame) -> DataFrame:
    """(property_id, canonical_id): rows with one address share the least id; rows without an address stay apart."""
    keyed = with_address_key(df)
    first = keyed.where("address_key <> ''").groupBy("address_key").agg(F.min("property_id").alias("canonical_id"))
    return keyed.join(first, "address_key", "left").select("property_id", F.coalesce("canonical_id", "property_id").alias("canonical_id"))


def match_by_address(incoming: DataFrame, props: DataFrame) -> DataFrame:
    """Incoming rows with the least live property id of their address key, null without one."""
    known = with_address_key(live(props)).where("address_key <> ''").groupBy("address_key").agg(F.min("property_id").alias("match_id"))
    return with_address_key(incoming).join(known, "address_key", "left")


def upsert_properties(incoming: DataFrame, props: DataFrame) -> DataFrame:
    """Incoming (incoming_id, street, city, state_abbr) with their property's id: found by address, or new.

    New ids follow the greatest known one in the order of each new address's
    least incoming id; rows without an address are new each for itself.
    """
    matched = match_by_address(incoming, props)
    own = F.when(F.col("address_key") != "", F.col("address_key")).otherwise(F.concat(F.lit("#"), F.col("incoming_id").cast("string")))
    fresh = matched.where("match_id is null").withColumn("own", own).groupBy("own").agg(F.min("incoming_id").alias("first_id"))
    last = props.agg(F.coalesce(F.max("property_id"), F.lit(0)).alias("last_id"))
    numbered = numbered_rows(fresh, "first_id").crossJoin(F.broadcast(last)).select("own", (F.col("last_id") + F.col("n")).alias("new_id"))
    return matched.withColumn("own", own).join(numbered, "own", "left").select("incoming_id", F.coalesce("match_id", "new_id").alias("property_id"), F.col("match_id").isNull().alias("created"))


def numbered_rows(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` with n = 1, 2, ... in ``order``, without sorting all rows in one task.

    Rows are dealt into ranges and staged, so that counting and numbering see
    the same ranges; each is numbered from the sizes of those before it.
    """
    dealt = stage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").count()
    before = sizes.withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    here = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    # one row for each range
    return dealt.join(F.broadcast(before), "_part").withColumn("n", (F.col("_before") + here).cast("long")).drop("_part", "_before")


def enrich_key(df: DataFrame) -> DataFrame:
    """Rows that can be enriched, with their lookup key: the zip code, else the city."""
    have = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return df.where(have("state_abbr") & (have("city") | have("zip"))).withColumn("lookup_key", F.when(have("zip"), F.col("zip")).otherwise(F.col("city")))
