"""Domain tables made from the shared test tables: census, plan elements, scores, counts, links, coordinates, flows."""

from __future__ import annotations

import os
import sqlite3
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import s_to_hms, web_mercator
from ..operators.ipf import Spec
from ..sources.writers import write_plans_xml
from ..storage import shared_path

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["F", "O", "P"]
IMPOSSIBLE = [("AUTOMOBILE", "1-URGENT"), ("BUILDING", "nowhere")]
SPEC_2D = Spec([SEGMENTS, PRIORITIES], IMPOSSIBLE)
#: Two segments that can only have the two first priorities.
SPEC_BLOCKED = Spec([SEGMENTS, PRIORITIES], [(a, b) for a in SEGMENTS[:2] for b in PRIORITIES[2:]])
SPEC_FREE = Spec([SEGMENTS, PRIORITIES])
SPEC_3D = Spec([SEGMENTS, PRIORITIES, STATUSES])
SPEC_3D_IMPOSSIBLE = Spec([SEGMENTS, PRIORITIES, STATUSES], [("AUTOMOBILE", "1-URGENT", "P")])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each section (nation of the customer) with a count of orders for each category."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    # orders are counted by customer first, so that few rows are joined
    own = orders.groupBy("o_custkey", "o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    joined = own.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    count = lambda column, values: [F.sum(F.when(F.col(column) == v, F.col("n")).otherwise(0)).cast("double").alias(v) for v in values]
    return joined.groupBy(F.col("c_nationkey").cast("string").alias("section")).agg(*count("c_mktsegment", SEGMENTS), *count("o_orderpriority", PRIORITIES), *count("o_orderstatus", STATUSES))


def plan_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events of a week as a plan: every event is an activity, and a leg leads to the next one."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(F.col("event_type") == "view", "h").when(F.col("event_type") == "purchase", "w").when(F.col("event_type") == "signup", "l").when(F.col("event_type") == "click", "car interaction").otherwise("pt interaction")
    routing = F.when(k % 3 == 0, "car").when(k % 3 == 1, "bus").otherwise("subway")
    dep = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    travel = F.floor(F.col("value") * 10).cast("int")
    base = e.select(
        F.floor((F.dayofmonth("ts") - 1) / 7).cast("int").alias("iteration"), F.col("user_id").alias("person_id"), F.lit(0).alias("plan_idx"), "ts", "event_id", kind.alias("type"),
        F.when(k % 3 == 0, "car").when(F.col("event_id") % 2 == 0, "pt").otherwise("walk").alias("mode"), routing.alias("routing_mode"), F.round(F.col("value") * 100).alias("distance_m"),
        travel.alias("travel_s"), (F.col("event_id") % 300).cast("int").alias("wait_s"), dep.alias("dep_s"), (dep + travel).alias("arr_s"), (F.col("event_id") % 50 == 0).alias("stuck"),
    )
    place = F.row_number().over(Window.partitionBy("iteration", "person_id", "plan_idx").orderBy("ts", "event_id")) - 1
    two = F.array(F.struct((2 * F.col("i")).alias("pos"), F.lit("activity").alias("kind")), F.struct((2 * F.col("i") + 1).alias("pos"), F.lit("leg").alias("kind")))
    return base.withColumn("i", place).withColumn("x", F.explode(two)).withColumns({"pos": F.col("x.pos"), "kind": F.col("x.kind")}).withColumn("type", F.when(F.col("kind") == "activity", F.col("type"))).drop("x", "i", "ts", "event_id")


def scored_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("person_id"), F.col("o_orderkey").alias("plan_id"), F.col("o_totalprice").alias("score"), F.year("o_orderdate").alias("iteration"), (F.col("o_orderstatus") == "F").alias("selected"))


def link_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("link_id"), (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).alias("time_s"), "event_type")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a part to the next one in its order."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    following = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    made = li.withColumn("to_node", following).where("to_node is not null")
    return made.select(F.concat_ws("-", "l_orderkey", "l_partkey", "to_node").alias("link_id"), F.col("l_partkey").alias("from_node"), "to_node")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as points around the city; every 97th has no longitude."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    lon = F.when(F.col("c_custkey") % 97 != 0, -8.7 + (F.col("c_custkey") % 1000) * 0.0002)
    return c.select("c_custkey", lon.alias("x"), (41.1 + (F.col("c_custkey") % 700) * 0.0002).alias("y"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as nodes of a network in EPSG:3857, some way inside of the points."""
    s = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") * 0.008 - 8.69).alias("lon"), (F.col("s_nationkey") * 0.005 + 41.11).alias("lat"))
    x, y = web_mercator(F.col("lon"), F.col("lat"))
    return s.select(x.alias("x"), y.alias("y"))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf rows of commuters by area, sex, occupation and destination, from orders."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(
        F.col("c_nationkey").cast("string").alias("geocod"),
        F.when(F.col("o_orderstatus") == "F", "H").otherwise("M").alias("genero"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "Estudante").otherwise("Empregada").alias("ocupacao"),
        F.when(F.col("o_orderkey") % 2 == 0, "Na freguesia onde reside").otherwise("Noutra freguesia, do mesmo município").alias("destino"),
    ).agg(F.count("*").alias("valor"))


def indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flows as nested indicator text, one document for each area; areas 5 and 6 have one name."""
    n = table(spark, sf_dir, "nation")
    name = F.when(F.col("n_nationkey") == 6, "area-5").otherwise(F.concat(F.lit("area-"), F.col("n_nationkey").cast("string")))
    named = flows(spark, sf_dir).join(F.broadcast(n.select(F.col("n_nationkey").cast("string").alias("geocod"), name.alias("geodsg"))), "geocod")
    axis = F.explode(F.array(F.lit("T"), F.lit("1")))
    record = F.struct("geocod", "geodsg", F.lit("3").alias("dim_3"), F.col("genero").alias("dim_3_t"), F.lit("4").alias("dim_4"), F.col("ocupacao").alias("dim_4_t"), "dim_5", F.lit("x").alias("dim_5_t"), F.lit("6").alias("dim_6"), F.col("destino").alias("dim_6_t"), F.col("valor").cast("string").alias("valor"))
    by_area = named.withColumn("dim_5", axis).groupBy("geocod").agg(F.collect_list(record).alias("records"))
    return by_area.select(F.to_json(F.struct(F.create_map(F.lit("2021"), F.col("records")).alias("Dados"))).alias("text"))


# --- the stand-ins in the formats that the readers take, written to the shared folder ----------------------------


def indicator_files(spark: SparkSession, sf_dir: str) -> str:
    """A JSON file for each area."""
    path = shared_path(spark, "indicator")
    indicator(spark, sf_dir).write.option("maxRecordsPerFile", 1).text(path)
    return path


def census_files(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """The census as CSV with a header and as Parquet."""
    csv, parquet = shared_path(spark, "census") + ".csv", shared_path(spark, "census")
    whole = census(spark, sf_dir)
    whole.write.option("header", True).csv(csv)
    whole.write.parquet(parquet)
    return csv, parquet


def census_geopackage(spark: SparkSession, sf_dir: str) -> str:
    """The census as a GeoPackage: SQLite is written by one process, and there is a row for each nation."""
    rows = census(spark, sf_dir).select("section", *[F.col(f"`{c}`").cast("long") for c in SEGMENTS]).collect()
    path = shared_path(spark, "census") + ".gpkg"
    local = path.removeprefix("file://")
    os.makedirs(os.path.dirname(local), exist_ok=True)
    with closing(sqlite3.connect(local)) as base:
        base.execute("create table gpkg_contents (table_name text, data_type text)")
        base.execute("insert into gpkg_contents values ('census', 'features')")
        base.execute(f"create table census (fid integer primary key, geom blob, section text, {', '.join(f'"{c}" integer' for c in SEGMENTS)})")
        base.executemany(f"insert into census (section, {', '.join(f'"{c}"' for c in SEGMENTS)}) values ({', '.join('?' * (1 + len(SEGMENTS)))})", [tuple(r) for r in rows])
        base.commit()
    return path


def plan_files(spark: SparkSession, sf_dir: str) -> str:
    """Plans in XML: a user's events of a week are a plan, the last week's is the selected one."""
    elements = plan_elements(spark, sf_dir)
    whole = Window.partitionBy("person_id", "iteration")
    act = F.col("kind") == "activity"
    rows = elements.select(
        "person_id", F.col("iteration").alias("plan_idx"), (F.col("iteration") == F.max("iteration").over(Window.partitionBy("person_id"))).alias("selected"), (F.count("*").over(whole) / 4).alias("score"), "pos", "kind", "type",
        F.when(~act, F.col("mode")).alias("mode"), F.when(~act, F.col("routing_mode")).alias("routing_mode"), F.when(act, "1").alias("link"), F.when(act, F.col("distance_m") / 8).alias("x"), F.when(act, 0.5).alias("y"),
        F.when(~act, F.col("dep_s")).alias("start_s"), F.when(act, F.col("dep_s")).otherwise(F.col("arr_s")).alias("end_s"), F.lit(None).cast("int").alias("max_dur_s"),
    )
    path = shared_path(spark, "plans")
    write_plans_xml(rows, path)
    return path


def network_files(spark: SparkSession, sf_dir: str) -> str:
    """Parts as nodes and the links between them in XML; the path matches both."""
    path = shared_path(spark, "network")
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("_id"), (F.col("p_retailprice") / 2).alias("_x"), F.col("p_size").cast("double").alias("_y"))
    nodes.write.format("xml").option("rootTag", "nodes").option("rowTag", "node").save(f"{path}/nodes")
    made = links(spark, sf_dir).select(F.col("link_id").alias("_id"), F.col("from_node").cast("string").alias("_from"), F.col("to_node").cast("string").alias("_to"), (F.length("link_id") / 2).alias("_length"))
    made.write.format("xml").option("rootTag", "links").option("rowTag", "link").save(f"{path}/links")
    return f"{path}/*"


def activity_files(spark: SparkSession, sf_dir: str) -> str:
    """A configuration whose activity types are the events' types, with times from their numbers."""
    kinds = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.floor(F.avg("event_id")).alias("m"))
    param = lambda name, value: F.struct(F.lit(name).alias("_name"), value.alias("_value"))
    one = F.struct(F.lit("activityParams").alias("_type"), F.array(param("activityType", F.col("event_type")), param("priority", F.col("n").cast("string")), param("typicalDuration", s_to_hms(F.col("m") % 86400)), param("openingTime", F.lit("")), param("closingTime", F.lit("undefined"))).alias("param"))
    module = kinds.groupBy(F.lit("scoring").alias("_name")).agg(F.collect_list(one).alias("parameterset"))
    path = shared_path(spark, "configuration")
    module.write.format("xml").option("rootTag", "config").option("rowTag", "module").save(path)
    return path


def facility_files(spark: SparkSession, sf_dir: str) -> str:
    """Customers as facilities, for work or leisure by their segment and for living."""
    c = table(spark, sf_dir, "customer")
    kinds = F.array(F.struct(F.lit("h").alias("_type")), F.struct(F.when(F.col("c_mktsegment") == "BUILDING", "l").otherwise("w").alias("_type")))
    path = shared_path(spark, "facilities")
    rows = c.select(F.col("c_custkey").alias("_id"), (F.col("c_acctbal") * 2).alias("_x"), F.col("c_nationkey").cast("double").alias("_y"), kinds.alias("activity"))
    rows.write.format("xml").option("rootTag", "facilities").option("rowTag", "facility").save(path)
    return path


def zone_files(spark: SparkSession, sf_dir: str) -> str:
    """A square for each nation as bare GeoJSON, in a folder of its name."""
    n = F.col("n_nationkey").cast("double")
    corner = lambda a, b: F.array(n + a, F.lit(0.0) + b)
    square = F.array(F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0))))
    path = shared_path(spark, "zones")
    text = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), square.alias("coordinates")))
    table(spark, sf_dir, "nation").select(F.col("n_name").alias("zone"), text.alias("value")).write.partitionBy("zone").text(path)
    return path


def iteration_files(spark: SparkSession, sf_dir: str) -> str:
    """Events by type and hour as a tab-separated table for each week, a column for each type that the week has, and a footer."""
    e = table(spark, sf_dir, "events").select(F.floor((F.dayofmonth("ts") - 1) / 7).cast("int").alias("iteration"), F.hour("ts").alias("hour"), "event_type").where("iteration > 0 or event_type != 'error'")
    counts = e.groupBy("iteration", "hour", "event_type").agg(F.count("*").alias("n"))
    names = counts.groupBy("iteration").agg(F.sort_array(F.collect_set("event_type")).alias("names"))
    rows = counts.groupBy("iteration", "hour").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m")).join(names, "iteration")
    line = F.concat_ws("\t", F.col("hour").cast("string"), F.array_join(F.transform("names", lambda c: F.coalesce(F.element_at("m", c), F.lit(0)).cast("string")), "\t"))
    files = rows.groupBy("iteration").agg(F.first("names").alias("names"), F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("body"))
    text = F.concat(F.lit("hour\t"), F.array_join("names", "\t"), F.lit("\n"), F.col("body"), F.lit("\n\nall hours"))
    path = shared_path(spark, "tables")
    files.select("iteration", text.alias("value")).write.partitionBy("iteration").text(path)
    return path


def zones(spark: SparkSession) -> DataFrame:
    """A square with a square hole, and one with two parts."""
    square = lambda a, b, c, d: [[a, c], [b, c], [b, d], [a, d], [a, c]]
    rows = [
        ("inner", [[square(-8.65005, -8.55005, 41.12005, 41.20005), square(-8.62005, -8.59005, 41.14005, 41.17005)]]),
        ("outer", [[square(-8.70005, -8.66005, 41.10005, 41.15005)], [square(-8.54005, -8.50005, 41.10005, 41.23005)]]),
    ]
    return spark.createDataFrame(rows, "zone string, polygons array<array<array<array<double>>>>")
