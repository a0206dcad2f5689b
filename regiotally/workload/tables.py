"""The order tables in the roles of incidents, population and supply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from regiotally.operators.combine import attach
from regiotally.operators.recode import region_from_area
from regiotally.operators.reshape import Split, levels_of
from regiotally.plans.explore import joined_cells
from regiotally.plans.prepare import clean_incidents, population_features, prepare, roll_up
from regiotally.plans.prepare import supply_by_quarter as quarterly
from regiotally.plans.spec import Incidents, Panel, RegionRecode, Study

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
REGIONS = ("SOUTH", "WEST", "EAST", "EUROPE", "GULF")
YEARS = (1995, 1996, 1997, 1998, 1999, 2000)

TRADE = Study(
    incidents=Incidents(flags=("returned", "filled")),
    recode=RegionRecode(
        balance="MIDDLE EAST",
        areas={"NATION_4": "EAST", "NATION_9": "SOUTH", "NATION_14": "EUROPE"},
        regions={"AFRICA": "SOUTH", "AMERICA": "WEST", "ASIA": "EAST", "MIDDLE EAST": "GULF"},
        fallback="GULF",
    ),
    flag_codes={"R": 1, "A": 0, "N": 0, "F": 1, "O": 0},
    supply_regions={"AFRICA": "SOUTH", "AMERICA": "WEST", "ASIA": "EAST", "EUROPE": "EUROPE", "MIDDLE EAST": "GULF"},
    population_splits=(
        Split("standing", ("credit", "debit")),
        Split("segment", SEGMENTS, lambda level: f"pop_{level.lower()}"),
    ),
    total_population="total_population",
    split_prefix="pop_",
    measures=("supply", "returned_supply"),
    regions=REGIONS,
    reference="WEST",
    region_prefix="region_",
    panel=Panel(
        category="01 URGENT",
        flags=(("returned", "returned_rows"), ("filled", "filled_rows")),
        extra=("credit",),
        levels=REGIONS,
        reference="WEST",
        variant_levels=("EAST", "EUROPE", "GULF"),
    ),
    partial_year=2001,
)


# Declared, so that opening a table starts no job to read footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}


def schema_of(text: str) -> StructType:
    return StructType.fromDDL(text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")


def incident_rows(spark: SparkSession, sf_dir: str, without_year: int | None = None) -> DataFrame:
    """Quantity ordered and source rows, by nation, month, priority, kind and flags.

    The kind of a line is its number in the order and its tax, the flags are whether it came back and whether it was
    sold at half the usual discount or more: three things that do not depend on each other. The date parts are taken per order, the lines are counted by nation key, and the names are attached to
    the counts: the lines themselves carry two flags and a quantity through one join. Both sides of that
    join grow with the data, so it is asked to sort both: hot orders are then split by adaptive execution.
    """
    orders = table(spark, sf_dir, "orders")
    if without_year:
        # on the date itself, so that the scan can skip the year; orders without a date stay
        orders = orders.filter(F.col("o_orderdate").isNull() | ~within("o_orderdate", without_year, without_year))
    orders = orders.select(
        "o_orderkey",
        "o_custkey",
        F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month"),
        "o_orderpriority",
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    kind = F.concat_ws("-", F.col("l_linenumber").cast("string"), F.round(F.col("l_tax") * 100).cast("int").cast("string"))
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", kind.alias("kind"), "l_returnflag", F.when(F.col("l_discount") >= 0.05, "F").otherwise("O").alias("reduced"), "l_quantity"
    )
    placed = orders.join(customer, orders.o_custkey == customer.c_custkey)
    counted = (
        lines.hint("merge")
        .join(placed, lines.l_orderkey == placed.o_orderkey)
        .groupBy("c_nationkey", "year", "month", "o_orderpriority", "kind", "l_returnflag", "reduced")
        .agg(F.sum(F.col("l_quantity").cast("long")).alias("incidents"), F.count(F.lit(1)).alias("source_rows"))
    )
    named = counted.join(places(spark, sf_dir), counted.c_nationkey == F.col("n_nationkey"))
    return named.select(
        F.col("r_name").alias("reporting_region"),
        F.col("n_name").alias("area"),
        "year",
        "month",
        F.concat(F.lit("0"), F.replace("o_orderpriority", F.lit("-"), F.lit(" "))).alias("category"),
        "kind",
        F.col("l_returnflag").alias("returned"),
        F.col("reduced").alias("filled"),
        "incidents",
        "source_rows",
    )


def population_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an order in a year, by region, sign of the balance and segment."""
    # A range on the date itself, so that the scan can skip the other years.
    orders = table(spark, sf_dir, "orders").filter(within("o_orderdate", YEARS[0], YEARS[-1]))
    active = orders.select(F.year("o_orderdate").alias("year"), "o_custkey").distinct()
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    standing = F.when(F.col("c_acctbal") < 0, "debit").otherwise("credit")
    counted = (
        active.join(customer, active.o_custkey == customer.c_custkey)
        .groupBy("year", "c_nationkey", standing.alias("standing"), F.col("c_mktsegment").alias("segment"))
        .agg(F.count(F.lit(1)).alias("Population"))
    )
    named = counted.join(places(spark, sf_dir), counted.c_nationkey == F.col("n_nationkey"))
    return named.select("year", region_of("r_name", "n_name").alias("region"), "standing", "segment", "Population")


def supply_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity shipped by quarter and region of the supplier.

    Lines are counted per supplier before the join, so that a supplier with very many lines is one row
    per quarter by the time it is shuffled.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity", "l_returnflag")
    quantity = F.col("l_quantity").cast("long")
    per_supplier = lines.groupBy(
        "l_suppkey", F.year("l_shipdate").alias("_year"), F.quarter("l_shipdate").alias("_quarter")
    ).agg(
        F.sum(quantity).alias("supply"),
        F.sum(F.when(F.col("l_returnflag") == "R", quantity).otherwise(0)).alias("returned_supply"),
    )
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    counted = (
        per_supplier.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("_year", "_quarter", "s_nationkey")
        .agg(F.sum("supply").alias("supply"), F.sum("returned_supply").alias("returned_supply"))
    )
    named = counted.join(places(spark, sf_dir), counted.s_nationkey == F.col("n_nationkey"))
    end_of_quarter = F.last_day(F.make_date("_year", F.col("_quarter") * 3, F.lit(1)))
    return named.select(
        end_of_quarter.alias("quarter_ending"),
        F.col("r_name").alias("region"),
        F.col("supply").cast("double").alias("supply"),
        F.col("returned_supply").cast("double").alias("returned_supply"),
    )


def moment(day: str) -> Column:
    return F.lit(day).cast("timestamp_ntz")


def within(column: str, first_year: int, last_year: int) -> Column:
    return (F.col(column) >= moment(f"{first_year}-01-01")) & (F.col(column) < moment(f"{last_year + 1}-01-01"))


def region_of(region: str, area: str) -> Column:
    r = TRADE.recode
    return region_from_area(region, area, r.balance, r.areas, r.regions, r.fallback)


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = incident_rows(spark, sf_dir, TRADE.partial_year)
    return clean_incidents(rows, TRADE, "reporting_region", "area", ["source_rows"])


def rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roll_up(clean(spark, sf_dir), TRADE)


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population_features(population_rows(spark, sf_dir), TRADE, (1995, 2000))


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarterly([supply_rows(spark, sf_dir)], TRADE, "quarter_ending")


def reported_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supply as a source with a gap tells it: nothing is known of the last two quarters of 2000."""
    unknown = (F.col("year") == 2000) & (F.col("quarter") >= 3)
    return supply(spark, sf_dir).withColumns({m: F.when(~unknown, F.col(m)) for m in TRADE.measures})


def with_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents by every dimension with population, for summaries that need no supply."""
    return attach(rolled(spark, sf_dir), population(spark, sf_dir), ["year", "region"])


def with_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents by every dimension with supply, gaps left open."""
    return attach(rolled(spark, sf_dir), reported_supply(spark, sf_dir), TRADE.incidents.cell)


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(clean(spark, sf_dir), population(spark, sf_dir), reported_supply(spark, sf_dir), TRADE)


def month_cells(spark: SparkSession, sf_dir: str, digits: int = 1) -> DataFrame:
    return joined_cells(clean(spark, sf_dir), population(spark, sf_dir), reported_supply(spark, sf_dir), TRADE, digits)


def years(spark: SparkSession, sf_dir: str) -> tuple[int, ...]:
    """The years that incidents are kept of, found in the orders."""
    orders = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"))
    return levels_of(orders.filter(F.col("year") != TRADE.partial_year), "year")
