"""Readers. Every schema is explicit."""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterator
from contextlib import closing
from urllib.parse import quote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, StructType

from ..functions.scalars import hms_to_s
from ..operators.flows import records_of

RECORD = "struct<geocod:string,geodsg:string,dim_3:string,dim_3_t:string,dim_4:string,dim_4_t:string,dim_5:string,dim_5_t:string,dim_6:string,dim_6_t:string,valor:string>"
INDICATOR = f"Dados map<string,array<{RECORD}>>"
FLOWS = "freguesia string, genero string, ocupacao string, destino string, valor long"


def read_indicator(spark: SparkSession, path: str, year: str) -> DataFrame:
    """Records of one year of landed indicator files (JSON arrays with the field Dados)."""
    return records_of(spark.read.schema(INDICATOR).option("multiLine", True).json(path), year)


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """Flow CSV with a header, UTF-8, quoted commas."""
    return spark.read.schema(FLOWS).option("header", True).csv(path)


def read_census(spark: SparkSession, path: str, label_col: str, category_cols: list[str], layer: str | None = None, where: str | None = None) -> DataFrame:
    """Label as text and categories as numbers, from Parquet, CSV with a header, or a GeoPackage (by the path's ending).

    Of a GeoPackage, ``layer`` names the table and ``where`` is a condition for SQLite; Parquet and CSV take filters on the frame.
    """
    if path.endswith(".gpkg"):
        spark.dataSource.register(GeoPackageSource)
        fields = ", ".join([f"`{label_col}` string", *(f"`{c}` double" for c in category_cols)])
        return spark.read.format("geopackage").schema(fields).options(**{k: v for k, v in (("layer", layer), ("where", where)) if v}).load(path)
    if path.endswith(".csv"):
        header = [F.col(f"`{label_col}`").cast("string").alias(label_col), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in category_cols]]
        return spark.read.option("header", True).csv(path).select(*header)
    return spark.read.parquet(path).select(F.col(f"`{label_col}`").cast("string").alias(label_col), *[F.col(f"`{c}`").cast("double").alias(c) for c in category_cols])


class GeoPackageSource(DataSource):
    """Attributes of a GeoPackage's first (or named, ``layer``) feature table, without geometry.

    The table's rowids are cut into ``partitions`` ranges (8 by default), which tasks read side by side, as SQLite allows many readers of a
    file. The option ``where`` is a condition that SQLite checks, as part of its SQL text. (Spark's own pushing of filters to Python sources
    is not used: in 4.1 a frame that is read again without a filter still has the last one's.) Every task opens the file itself, so it has to lie
    where the driver and all executors see it under one path.
    """

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def reader(self, schema: StructType) -> DataSourceReader:
        return GeoPackageReader(self.options, schema)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class GeoPackageReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.layer, self.parts = options["path"].removeprefix("file://"), options.get("layer"), int(options.get("partitions", 8))
        self.fields = [(f.name, isinstance(f.dataType, DoubleType)) for f in schema.fields]
        self.where = options.get("where")

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{quote(self.path)}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        with closing(self._open()) as base:
            layer = self.layer or base.execute("select table_name from gpkg_contents where data_type in ('features', 'attributes') order by table_name limit 1").fetchone()[0]
            low, high = base.execute(f"select min(rowid), max(rowid) from {_quoted(layer)}").fetchone()
        if low is None:
            return [InputPartition((layer, 0, -1))]
        step = -(-(high - low + 1) // self.parts)
        return [InputPartition((layer, a, min(a + step - 1, high))) for a in range(low, high + 1, step)]

    def sql(self, layer: str) -> str:
        """The text of a range's query; its two values are the range."""
        return f"select {', '.join(_quoted(n) for n, _ in self.fields)} from {_quoted(layer)} where rowid between ? and ?{f' and ({self.where})' if self.where else ''}"

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        layer, low, high = partition.value
        with closing(self._open()) as base:
            for row in base.execute(self.sql(layer), (low, high)):
                yield tuple(None if v is None else float(v) if number else str(v) for v, (_, number) in zip(row, self.fields, strict=True))


#: Columns of an element as they stand in a file; times are still text.
ELEMENT = "person_id string, plan_idx int, selected boolean, score double, pos int, kind string, type string, mode string, routing_mode string, link string, x double, y double, start string, end string, max_dur string, dep string, trav string"
OPEN_PERSON = re.compile(r"<person(?=[\s>])")


def _elements(person: ElementTree.Element) -> Iterator[tuple]:
    """A row for each activity and leg of a person's plans, numbered as they follow each other."""
    number = lambda e, name: float(v) if (v := e.get(name)) not in (None, "", "undefined") else None
    for plan_idx, plan in enumerate(person.iter("plan")):
        common = (person.get("id"), plan_idx, plan.get("selected") == "yes", number(plan, "score"))
        for pos, e in enumerate(c for c in plan if c.tag in ("activity", "act", "leg")):
            if e.tag == "leg":
                routing = next((a.text for a in e.iterfind("attributes/attribute") if a.get("name") == "routingMode"), None)
                yield *common, pos, "leg", None, e.get("mode"), routing, None, None, None, None, None, None, e.get("dep_time"), e.get("trav_time")
            else:
                yield *common, pos, "activity", e.get("type"), None, None, e.get("link"), number(e, "x"), number(e, "y"), e.get("start_time"), e.get("end_time"), e.get("max_dur"), None, None


def _parsed_persons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in ELEMENT.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}[c.split()[1]] for c in ELEMENT.split(", ")]
    for batch in batches:
        for text in batch.column(0).to_pylist():
            # what stands before the person: the file's head, or persons without plans, which are closed in their own tag
            opens = [m.start() for m in OPEN_PERSON.finditer(text)]
            body = text[opens[-1] :] if opens else ""
            if "<plan" in body:
                rows = list(_elements(ElementTree.fromstring(body + "</person>")))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_plans(spark: SparkSession, path: str, iteration: int = 0) -> DataFrame:
    """Plan elements of plans files, in the order in which they stand: (iteration, person_id, plan_idx, selected, score, pos, kind, type, mode, routing_mode, link, x, y, start_s, end_s, max_dur_s).

    ``pos`` counts a plan's activities and legs from 0 on; they need not alternate. Files are cut after each person, so uncompressed ones are split
    like any text, wherever they lie. Persons without plans and plans without elements give no rows; a person that is no XML is an error.
    """
    texts = spark.read.option("lineSep", "</person>").text(path)
    start = lambda c: hms_to_s(F.col(c))
    leg = F.col("kind") == "leg"
    return texts.mapInArrow(_parsed_persons, ELEMENT).select(
        F.lit(iteration).alias("iteration"), "person_id", "plan_idx", "selected", "score", "pos", "kind", "type", "mode", "routing_mode", "link", "x", "y",
        F.when(leg, start("dep")).otherwise(start("start")).alias("start_s"), F.when(leg, start("dep") + start("trav")).otherwise(start("end")).alias("end_s"), start("max_dur").alias("max_dur_s"),
    )


def read_network(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes(node_id, x, y) and links(link_id, from_node, to_node, length) of a network file."""
    nodes = spark.read.format("xml").option("rowTag", "node").schema("_id string, _x double, _y double").load(path)
    links = spark.read.format("xml").option("rowTag", "link").schema("_id string, _from string, _to string, _length double").load(path)
    return nodes.select(F.col("_id").alias("node_id"), F.col("_x").alias("x"), F.col("_y").alias("y")), links.select(F.col("_id").alias("link_id"), F.col("_from").alias("from_node"), F.col("_to").alias("to_node"), F.col("_length").alias("length"))


PARAMS = "array<struct<_name:string,_value:string>>"
#: Output column, name in the configuration, whether it is a time.
ACTIVITY_PARAMS = [("priority", "priority", False), ("typical_s", "typicalDuration", True), ("opening_s", "openingTime", True), ("latest_start_s", "latestStartTime", True), ("earliest_end_s", "earliestEndTime", True), ("closing_s", "closingTime", True)]


def read_activity_params(spark: SparkSession, path: str) -> DataFrame:
    """A row for each activity type of a configuration file, from parameter sets one or two levels deep."""
    inner = f"array<struct<_type:string,param:{PARAMS},parameterset:array<struct<_type:string,param:{PARAMS}>>>>"
    modules = spark.read.format("xml").option("rowTag", "module").schema(f"_name string, parameterset {inner}").load(path)
    outer = modules.select(F.explode("parameterset").alias("s"))
    flat = outer.select("s._type", "s.param").unionByName(outer.select(F.explode("s.parameterset").alias("t")).select("t._type", "t.param"))
    named = flat.where("_type = 'activityParams'").select(F.map_from_entries(F.transform("param", lambda p: F.struct(p["_name"], p["_value"]))).alias("m"))
    value = lambda name: F.element_at("m", F.lit(name))
    return named.select(value("activityType").alias("activity_type"), *[(hms_to_s(value(n)) if time else value(n).try_cast("double")).alias(c) for c, n, time in ACTIVITY_PARAMS])


def read_facilities(spark: SparkSession, path: str) -> DataFrame:
    """(facility_id, x, y, activity_type), a row for each facility and type."""
    rows = spark.read.format("xml").option("rowTag", "facility").schema("_id long, _x double, _y double, activity array<struct<_type:string>>").load(path)
    return rows.select(F.col("_id").alias("facility_id"), F.col("_x").alias("x"), F.col("_y").alias("y"), F.explode("activity._type").alias("activity_type"))


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """(zone, polygons) of bare MultiPolygon files; a zone is named by its file, or by its folder ``zone=name``."""
    rows = spark.read.schema("type string, coordinates array<array<array<array<double>>>>").option("multiLine", True).json(path)
    path_, in_folder = F.input_file_name(), r"/zone=([^/]+)/"
    name = F.when(path_.rlike(in_folder), F.regexp_extract(path_, in_folder, 1)).otherwise(F.regexp_extract(path_, r"([^/]+)\.geojson$", 1))
    return rows.select(name.alias("zone"), F.col("coordinates").alias("polygons"))


def read_iteration_table(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(iteration, key, column, value) of per-iteration text tables whose columns differ.

    ``path`` matches the tables of all iterations; the iteration is the number in front of the file's name, or in its folder's name ``iteration=n``. A file's first line
    names its columns; lines with another number of cells (footers) and cells without a number give no rows.
    """
    path_, in_folder = F.input_file_name(), r"/iteration=(\d+)/"
    number = F.when(path_.rlike(in_folder), F.regexp_extract(path_, in_folder, 1)).otherwise(F.regexp_extract(path_, r"(\d+)\.[^/]+$", 1))
    lines = spark.read.text(path, wholetext=True).select(number.cast("int").alias("iteration"), F.split("value", "\r?\n").alias("lines"))
    header = F.split(F.get("lines", F.lit(0)), "\t")
    rows = lines.select("iteration", header.alias("names"), F.explode(F.slice("lines", 2, F.size("lines"))).alias("line"))
    # a footer is told by having no cells, or others than the header
    cells = rows.select("iteration", "names", F.split("line", "\t").alias("v")).where((F.size("v") > 1) & (F.size("v") == F.size("names")))
    long = cells.select("iteration", F.get("v", F.lit(0)).alias(key), F.explode(F.arrays_zip(F.slice("names", 2, F.size("names")).alias("column"), F.slice("v", 2, F.size("v")).alias("value"))).alias("c"))
    return long.select("iteration", key, F.trim("c.column").alias("column"), F.col("c.value").try_cast("double").alias("value")).where("column is not null and column != '' and value is not null")


def union_iterations(parts: list[DataFrame]) -> DataFrame:
    """Wide iteration tables put together; a column that one lacks is 0 there."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.na.fill(0)
